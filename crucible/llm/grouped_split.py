"""Problem 4: splits that keep related records together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.functions.molecule_key import molecule_key
from crucible.operators.components import groups_by_shared_values
from crucible.operators.text import blank_to_null
from crucible.runtime import written

SPLITS = ("train", "valid", "test")
#: Components that one annealing task searches over, at most about.
BLOCK = 10_000
#: A size class (sizes within a factor of two) with fewer components than this is searched with the other such classes.
FEW = 64
#: Steps of a chain for each component of its block.
SWEEPS = 4


def related_groups(rows: DataFrame, id_col: str = "record_id", text_col: str = "smiles", ref_cols: tuple = ("doc_ref",)) -> DataFrame:
    """(id, component): records are related when they share a non-null reference or denote one molecule, over any number of steps.

    Null, blank and unreadable texts relate nothing by molecule, except that equal unreadable texts are equal.
    """
    r = rows.select(F.col(id_col).alias("id"), blank_to_null(text_col).alias("text"), *[F.col(c).alias(f"ref{i}") for i, c in enumerate(ref_cols)])
    r = r.withColumn("key", F.when(F.col("text").isNotNull(), F.coalesce(molecule_key("text"), F.concat(F.lit("text "), "text"))))
    r = written(r.drop("text"))
    return groups_by_shared_values(r, "id", [*[f"ref{i}" for i in range(len(ref_cols))], "key"])


def leaking_records(rows: DataFrame, id_col: str = "record_id", split_col: str = "split", groups: DataFrame | None = None, **kw) -> DataFrame:
    """(id): records with a recorded split whose group holds at least two different ones.

    Splits are compared without case and outer white space; a null or blank one is none.
    """
    g = groups if groups is not None else related_groups(rows, id_col, **kw)
    r = rows.select(F.col(id_col).alias("id"), F.lower(blank_to_null(split_col)).alias("split")).join(g, "id")
    mixed = r.where("split is not null").groupBy("component").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi").select("component")
    return r.where("split is not null").join(mixed, "component", "left_semi").select(F.col("id").alias(id_col))


def anneal(sizes: np.ndarray, labels: np.ndarray, target: np.ndarray, label_target: np.ndarray, start: np.ndarray, steps: int, seed: int, weight: float = 0.5) -> tuple[np.ndarray, float]:
    """The best assignment found and its cost.

    A step moves one component or exchanges two of different splits; the cost is the squared deviation of the splits' sizes
    plus `weight` times that of their label counts, as shares of all records. Worse steps are taken while it is hot.
    """
    rng = np.random.default_rng(seed)
    total, n, k = max(1.0, float(sizes.sum())), len(sizes), len(target)
    s, l = sizes / total, labels / total
    where = start.copy()
    got, lab = np.zeros(k), np.zeros((k, labels.shape[1]))
    np.add.at(got, where, s)
    np.add.at(lab, where, l)
    want, label_want = target / total, label_target / total
    cost = float(((got - want) ** 2).sum() + weight * ((lab - label_want) ** 2).sum())
    journal: list[tuple[int, int]] = []  # (component, split it left), to go back to the best
    best_cost, best_at = cost, 0
    heat = max(cost, 1e-12)
    picks, others, luck, ways = rng.integers(0, n, steps), rng.integers(0, n, steps), rng.random(steps), rng.integers(1, k, steps)
    for t in range(steps):
        i = picks[t]
        a = where[i]
        j = others[t] if t % 2 else -1
        b = where[j] if j >= 0 else (a + ways[t]) % k
        if a == b:
            continue
        ds, dl = (s[i] - s[j], l[i] - l[j]) if j >= 0 else (s[i], l[i])
        ga, gb = got[a] - want[a], got[b] - want[b]
        la, lb = lab[a] - label_want[a], lab[b] - label_want[b]
        change = 2 * ds * (ds + gb - ga) + weight * 2 * float((dl * (dl + lb - la)).sum())
        if change <= 0 or luck[t] < np.exp(-change / (heat * 0.02 * (1 - t / steps) ** 3 + 1e-18)):
            where[i] = b
            journal.append((i, a))
            if j >= 0:
                where[j] = a
                journal.append((j, b))
            got[a] -= ds
            got[b] += ds
            lab[a] -= dl
            lab[b] += dl
            cost += change
            if cost < best_cost - 1e-15:
                best_cost, best_at = cost, len(journal)
    for i, a in reversed(journal[best_at:]):
        where[i] = a
    return where, best_cost


def _hashed(ids: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Split of each component by a hash of its id, in the given shares."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    u = ((x ^ (x >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.minimum(np.searchsorted(np.cumsum(shares), u, side="right"), len(shares) - 1)


def _chain(pdf: pd.DataFrame, cols: list[str], part: np.ndarray, label_part: np.ndarray, chain: int, seed: int, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """One annealing chain over the components of a block, towards `part` of its rows a split and `label_part` of its rows a split and label."""
    sizes, lab = pdf["n"].to_numpy(float), pdf[cols].to_numpy(float)
    want, label_want = part * sizes.sum(), label_part * lab.sum(axis=0)
    if start is None:
        start = _hashed(pdf["component"].to_numpy() + chain, part)
    return anneal(sizes, lab, want, label_want, start, SWEEPS * len(pdf) + 200, seed + chain)


def _shares(wanted: np.ndarray) -> np.ndarray:
    """Columns scaled to a sum of 1, equal parts where there is nothing."""
    w = np.maximum(wanted, 0)
    total = w.sum(axis=0)
    return np.where(total > 0, w / np.where(total > 0, total, 1), 1 / len(w))


def grouped_split(
    rows: DataFrame, id_col: str = "record_id", label_col: str = "source", shares: tuple = (0.8, 0.1, 0.1), splits: tuple = SPLITS, groups: DataFrame | None = None, chains: int = 3, rounds: int = 2, seed: int = 11, label_bins: int = 16, **kw
) -> DataFrame:
    """(id, component, new_split): a split of nearly the given shares with every group of related records in one split.

    Components are classed by size within a factor of two. Classes of fewer than FEW components, under 64 * FEW components
    together, are annealed first on the driver, starting from largest into the emptiest split. The others are hashed into
    blocks within their class, so that no block holds one component that outweighs it; each block starts from a hashed
    assignment and is annealed by several chains, a task a block and chain, towards its part of what is left of sizes and
    label counts, and the best chain's assignment is kept. Further rounds deal the components into other blocks and start from
    what they have. Labels are hashed into `label_bins` classes; a null label is a class of its own. Ids must be unique; an
    empty table gives an empty result.
    """
    g = groups if groups is not None else related_groups(rows, id_col, **kw)
    k = len(splits)
    label = F.when(F.col(label_col).isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(F.col(label_col)), F.lit(label_bins - 1))).cast("int")
    g = written(rows.select(F.col(id_col).alias("id"), label.alias("label")).join(g, "id"))
    cols = [f"l{i}" for i in range(label_bins)]
    comps = g.groupBy("component").agg(F.count("*").alias("n"), *[F.count_if(F.col("label") == i).alias(c) for i, c in enumerate(cols)])
    comps = written(comps.withColumn("class", F.floor(F.log2("n")).cast("int")))
    classes = comps.groupBy("class").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in cols]).collect()  # at most 64 rows
    total, labels = sum(r.n for r in classes), np.array([sum(r[c] for r in classes) for c in cols], float)
    share = np.array(shares, float) / sum(shares)
    target, label_target = share * total, share[:, None] * labels[None, :]
    few = [r["class"] for r in classes if r.comps < FEW]
    spark = rows.sparkSession
    large = comps.where(F.col("class").isin(few)).orderBy(F.desc("n"), "component").toPandas() if few else None
    schema = "component long, to int"
    placed = spark.createDataFrame([], schema)
    if large is not None:
        left, start = target.copy(), np.zeros(len(large), int)
        for i, n in enumerate(large["n"]):
            start[i] = int(np.argmax(left))  # the split that lacks most records
            left[start[i]] -= n
        where, _ = min((_chain(large, cols, share, np.repeat(share[:, None], label_bins, 1), c, seed, start) for c in range(chains)), key=lambda x: x[1])
        np.subtract.at(target, where, large["n"].to_numpy(float))
        np.subtract.at(label_target, where, large[cols].to_numpy(float))
        placed = spark.createDataFrame([(int(c), int(w)) for c, w in zip(large["component"], where, strict=True)], schema)
    part, label_part = _shares(target), _shares(label_target)
    many = [r for r in classes if r.comps >= FEW]
    names = F.array(*[F.lit(s) for s in splits])
    if many:
        blocks = F.create_map(*[F.lit(x) for r in many for x in (r["class"], -(-r.comps // BLOCK))])
        state = comps.where(~F.col("class").isin(few) if few else F.lit(True)).drop("to")
        def searcher(turn: int):  # noqa: ANN202
            def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values("component")
                start = pdf["to"].to_numpy() if turn else None
                where, cost = _chain(pdf, cols, part, label_part, int(key[2]), seed + 1000 * turn, start)
                return pd.DataFrame({"class": [key[0]], "block": [key[1]], "chain": [key[2]], "cost": [cost], "components": [pdf["component"].to_numpy()], "to": [where.astype(np.int32)]})

            return search

        for turn in range(rounds):
            dealt = state.withColumn("block", F.pmod(F.xxhash64("component", F.lit(turn)), F.element_at(blocks, F.col("class")).cast("long"))).withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))
            found = dealt.groupBy("class", "block", "chain").applyInPandas(searcher(turn), "class int, block long, chain int, cost double, components array<long>, to array<int>")
            best = found.groupBy("class", "block").agg(F.min_by(F.struct("components", "to"), F.struct("cost", "chain")).alias("b"))
            moved = written(best.select(F.inline(F.arrays_zip("b.components", "b.to"))).toDF("component", "to"))
            state = state.drop("to").join(moved, "component")
        placed = placed.union(moved)
    to = placed.select("component", F.get(names, "to").alias("new_split"))
    return g.select(F.col("id").alias(id_col), "component").join(to, "component").select(id_col, "component", "new_split")


def split_report(assigned: DataFrame) -> DataFrame:
    """Records and groups of each new split and its share of all."""
    per = assigned.groupBy("new_split").agg(F.count("*").alias("records"), F.count_distinct("component").alias("groups"))
    return per.crossJoin(F.broadcast(assigned.agg(F.count("*").alias("total")))).select("new_split", "records", "groups", (F.col("records") / F.col("total")).alias("share"))
