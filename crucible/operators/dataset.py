"""Curation, splitting and pruning of compound tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crucible.operators import farthest
from crucible.operators.text import blank_to_null

#: Rows that sphere exclusion takes in its one task; more raise an error. Memory follows the rows, time their square.
SEQUENTIAL_ROWS = 20_000
#: Rows up to which the other sequential splitters look at every row a step; with more they use `farthest`, which chooses the same.
SCANNED_ROWS = 5_000


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def guess_columns(df: DataFrame) -> dict[str, str | None]:
    """The likely SMILES, id and target columns by parts of their names; the first fitting one of each."""
    wanted = {"smiles": ("smiles", "smi", "structure"), "id": ("id", "name", "compound"), "target": ("target", "activity", "pic50", "ic50", "value", "y")}
    return {k: next((c for p in parts for c in df.columns if p in c.lower()), None) for k, parts in wanted.items()}


def cleanse(df: DataFrame, text_col: str, order_col: str) -> DataFrame:
    """Rows with a non-blank text, stripped; of equal texts the row with the smallest order_col stays.

    The row is found by a minimum per text and a join, so a hot text is met by partial aggregation. order_col must be unique.
    """
    t = df.withColumn(text_col, blank_to_null(text_col)).where(F.col(text_col).isNotNull())
    first = t.groupBy(text_col).agg(F.min(order_col).alias(order_col)).select(order_col)
    return t.join(first, order_col, "left_semi")


def p_activity(value: Column | str, factor: float = 1e-9) -> Column:
    """-log10 of a concentration; null for what isn't positive. factor brings it to mol/L."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v > 0, -F.log10(v * factor))


def curate(df: DataFrame, key_col: str, value_col: str, keep: Column | None = None, low: float | None = None, high: float | None = None, how: str = "median", first_of: tuple[str, ...] = (), order_col: str | None = None) -> DataFrame:
    """Filter, then one row a key: (key, value, n, first_of...). how is mean, median, min or max.

    first_of are further columns of which the first value that isn't null is kept, in the order of order_col.
    """
    d = df.where(F.col(value_col).isNotNull() & F.col(key_col).isNotNull())
    if keep is not None:
        d = d.where(keep)
    if low is not None:
        d = d.where(F.col(value_col) >= low)
    if high is not None:
        d = d.where(F.col(value_col) <= high)
    f = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max}[how]
    if first_of and order_col is None:
        raise ValueError("first_of needs order_col")
    extra = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order_col))).alias(c) for c in first_of]
    return d.groupBy(key_col).agg(f(value_col).alias("value"), F.count("*").alias("n"), *extra)


def curate_molecules(df: DataFrame, smiles_col: str, value_col: str, **kw) -> DataFrame:  # noqa: ANN003
    """As `curate` with molecules as keys: rows whose text can't be read are left out, writings of one molecule are one row."""
    from crucible.functions.molecule_key import molecule_key

    return curate(df.withColumn("molecule", molecule_key(smiles_col)), "molecule", value_col, **kw)


def standardise(df: DataFrame, cols: list[str], least: float = 1e-6) -> DataFrame:
    """Mean-imputed z-scores by the population deviation; a column that hardly varies is dropped.

    One aggregation; the row of moments is a literal in the second pass.
    """
    stats = df.agg(*[f(c).alias(f"{p}{i}") for i, c in enumerate(cols) for p, f in (("m", F.avg), ("n", F.count), ("s", F.stddev_pop))], F.count("*").alias("rows")).first()
    keep = []
    for i, c in enumerate(cols):
        if stats[f"s{i}"] is None or not stats["rows"]:
            continue
        sd = stats[f"s{i}"] * (stats[f"n{i}"] / stats["rows"]) ** 0.5  # imputed rows have no deviation
        if sd > least:
            keep.append(((F.coalesce(F.col(c), F.lit(stats[f"m{i}"])) - stats[f"m{i}"]) / sd).alias(c))
    return df.select(*[x for x in df.columns if x not in cols], *keep)


def random_split(df: DataFrame, id_col: str, ratio: float, seed: int = 42, split_col: str = "split_status") -> DataFrame:
    """Train for exactly int(n * ratio) rows, those of smallest hash of id and seed, Test for the others; ids must be unique.

    The hash below which rows are Train is found from counts by its first 16 bits, then by the rest within one such bucket, so
    no task sorts all rows. Reproducible.
    """
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    high = F.shiftright(h, 48)
    counts = df.groupBy(high.alias("b")).count().orderBy("b").collect()  # at most 65,536 rows
    want = int(sum(c["count"] for c in counts) * ratio)
    before, at = 0, None
    for c in counts:
        if before + c["count"] > want:
            at = c["b"]
            break
        before += c["count"]
    if at is None:
        return df.withColumn(split_col, F.lit("Train"))
    inside = df.where(high == at).select(h.alias("h"), F.col(id_col).alias("i")).orderBy("h", "i").limit(want - before)  # a 65,536th of the rows
    last = inside.agg(F.max(F.struct("h", "i")).alias("m")).first()["m"]
    kind = df.schema[id_col].dataType  # structs compare only if their fields' types are the same
    within = F.lit(False) if last is None else F.struct(h.alias("h"), F.col(id_col).alias("i")) <= F.struct(F.lit(last["h"]).cast("long").alias("h"), F.lit(last["i"]).cast(kind).alias("i"))
    return df.withColumn(split_col, F.when((high < at) | ((high == at) & within), "Train").otherwise("Test"))


def group_packing(df: DataFrame, group_col: str, ratio: float, split_col: str = "split_status") -> DataFrame:
    """Whole groups, largest first, go to Train while they fit into int(n * ratio) rows; one that doesn't goes there only if that is nearer to the target, ties by the group's value.

    Once the target is reached or passed everything else is Test. Groups are many, so the rule is run on the sizes: only the
    distinct sizes with their number of groups reach the driver, and a group is in Train by its rank among those of its size,
    counted within ranges of a sort and offset by the ranges' totals. A null group is a group.
    """
    sizes = df.groupBy(group_col).agg(F.count("*").alias("n"))
    room = int(df.count() * ratio)
    fits, used = [], 0
    for n, groups in sizes.groupBy("n").count().orderBy(F.desc("n")).collect():
        take = min(groups, (room - used) // n) if used < room else 0
        used += take * n
        if take < groups and used < room and (used + n) - room < room - used:
            take, used = take + 1, used + n
        fits.append((n, take))
    spark = df.sparkSession
    takes = spark.createDataFrame(fits, "n long, take long")
    # the place in a sorted partition is written, so that ranks don't change when a task runs again
    from crucible.runtime import cut

    placed = cut(sizes.repartitionByRange("n", group_col).sortWithinPartitions("n", group_col).withColumn("at", F.monotonically_increasing_id()))
    runs = placed.groupBy(F.shiftright("at", 33).alias("part"), "n").agg(F.count("*").alias("c"), F.min("at").alias("first")).orderBy("part", "n").collect()
    start, met = [], {}
    for part, n, c, first in runs:
        start.append((part, n, first, met.get(n, 0)))
        met[n] = met.get(n, 0) + c
    begins = spark.createDataFrame(start, "part long, n long, first long, before long")
    ranked = placed.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(begins), ["part", "n"]).join(F.broadcast(takes), "n")  # a row a partition and size
    chosen = ranked.select(F.col(group_col).alias("_g"), F.when(F.col("at") - F.col("first") + F.col("before") < F.col("take"), "Train").otherwise("Test").alias(split_col))
    return df.join(chosen, df[group_col].eqNullSafe(chosen["_g"])).drop("_g")


def split_statistics(df: DataFrame, split_col: str, target_col: str) -> DataFrame:
    """(split, n, pct, mean, std): rows of each split, their share in percent, mean and population deviation of the target."""
    per = df.groupBy(split_col).agg(F.count("*").alias("n"), F.avg(target_col).alias("mean"), F.stddev_pop(target_col).alias("std"))
    total = df.count()
    return per.withColumn("pct", F.col("n") * 100.0 / F.lit(max(1, total)))


def _sequential(df: DataFrame, id_col: str, features_col: str, pick, most: int | None = None) -> DataFrame:  # noqa: ANN001
    if most is not None and (n := df.count()) > most:
        raise ValueError(f"{n} rows; this splitter takes {most}")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        x = t["x"].combine_chunks()
        x = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), -1)
        train = np.zeros(len(x), bool)
        train[pick(x)] = True
        return pa.table({"id": t["id"], "split_status": pa.array(np.where(train, "Train", "Test").tolist())})

    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(features_col).cast("array<double>").alias("x"), F.lit(0).alias("one"))
    return rows.groupBy("one").applyInArrow(run, f"id {kind}, split_status string").withColumnRenamed("id", id_col)


def _distance(x: np.ndarray, i: int) -> np.ndarray:
    """Squared distances of all rows from the i-th."""
    d = x - x[i]
    return np.einsum("ij,ij->i", d, d)


def _farthest_pair(x: np.ndarray) -> tuple[int, int]:
    """The first of the farthest pairs; rows of distances are made and dropped one by one, so memory follows the rows only."""
    if len(x) > SCANNED_ROWS and len(rows := farthest.far_rows(x)) < len(x):
        i, j = _farthest_pair(x[rows])
        return int(rows[i]), int(rows[j])
    best, pair = -1.0, (0, 0)
    for i in range(len(x)):
        d = _distance(x, i)
        j = int(np.argmax(d))
        if d[j] > best:
            best, pair = float(d[j]), (i, j)
    return pair


def kennard_stone(df: DataFrame, id_col: str, features_col: str, ratio: float) -> DataFrame:
    """The farthest pair, then always the row farthest from those taken; ties go to the smaller id. Takes at least two."""

    def pick(x: np.ndarray) -> list[int]:
        k = int(len(x) * ratio)
        if k <= 0 or k >= len(x):
            return list(range(max(0, min(k, len(x)))))
        i, j = _farthest_pair(x)
        if len(x) > SCANNED_ROWS:
            taken, near = [], farthest.Nearest(farthest.Leaves(x))
            while len(taken) < max(2, k):
                taken.append((i, j)[len(taken)] if len(taken) < 2 else near.farthest())
                near.drop(taken[-1])
                near.add(x[taken[-1]])
            return taken
        taken, near = [i, j], np.minimum(_distance(x, i), _distance(x, j))
        near[taken] = -1
        while len(taken) < k:
            i = int(np.argmax(near))
            taken.append(i)
            near = np.minimum(near, _distance(x, i))
            near[taken] = -1
        return taken

    return _sequential(df, id_col, features_col, pick)


def duplex(df: DataFrame, id_col: str, features_col: str, ratio: float) -> DataFrame:
    """The two farthest pairs start Train and Test; then the side that is behind the ratio takes the row farthest from its own.

    Train takes while its share of the rows placed is below the ratio and it isn't full, Test otherwise; ties go to the smaller
    id. Fewer than one or all rows for Train are taken by id.
    """

    def pick(x: np.ndarray) -> list[int]:
        n, k = len(x), int(len(x) * ratio)
        if k <= 0 or k >= n:
            return list(range(max(0, min(k, n))))
        free = np.ones(n, bool)
        sides = []
        for _ in range(2):
            own = np.flatnonzero(free)
            if len(own) < 2:
                sides.append(own.tolist())
                free[own] = False
                continue
            i, j = _farthest_pair(x[own])
            sides.append([int(own[i]), int(own[j])])
            free[sides[-1]] = False
        if n > SCANNED_ROWS:
            tree = farthest.Leaves(x)
            far = [farthest.Nearest(tree) for _ in sides]
            for side, own in zip(sides, far, strict=True):
                for i in side:
                    own.add(x[i])
                    for both in far:
                        both.drop(i)
            for _ in range(int(free.sum())):
                to = 0 if len(sides[0]) / (len(sides[0]) + len(sides[1])) < ratio and len(sides[0]) < k else 1
                i = far[to].farthest()
                sides[to].append(i)
                for both in far:
                    both.drop(i)
                far[to].add(x[i])
            return sides[0]
        near = [np.min([_distance(x, i) for i in side], axis=0) if side else np.zeros(n) for side in sides]
        while free.any():
            to = 0 if len(sides[0]) / (len(sides[0]) + len(sides[1])) < ratio and len(sides[0]) < k else 1
            i = int(np.argmax(np.where(free, near[to], -1)))
            sides[to].append(i)
            free[i] = False
            near[to] = np.minimum(near[to], _distance(x, i))
        return sides[0]

    return _sequential(df, id_col, features_col, pick)


def d_optimal(df: DataFrame, id_col: str, features_col: str, ratio: float, ridge: float = 1e-4) -> DataFrame:
    """Greedy choice of the row of largest leverage given those taken."""

    def pick(x: np.ndarray) -> list[int]:
        if len(x) > SCANNED_ROWS:
            return farthest.by_leverage(x, int(len(x) * ratio), ridge)
        inv, taken, free = np.eye(x.shape[1]) / ridge, [], np.ones(len(x), bool)
        for _ in range(int(len(x) * ratio)):
            i = int(np.argmax(np.where(free, np.einsum("ij,jk,ik->i", x, inv, x), -1)))
            v = inv @ x[i]
            inv -= np.outer(v, v) / (1 + x[i] @ v)
            taken.append(i)
            free[i] = False
        return taken

    return _sequential(df, id_col, features_col, pick)


def sphere_exclusion(df: DataFrame, id_col: str, features_col: str, ratio: float, rounds: int = 15) -> DataFrame:
    """Seeds of spheres are Test; the radius is bisected until the share of seeds is nearest to 1 - ratio."""

    def pick(x: np.ndarray) -> list[int]:
        n = len(x)

        def seeds(r: float) -> list[int]:
            """A seed is the free row of least mean distance to the free ones; sums are kept up as rows leave."""
            free, out = np.ones(n, bool), []
            total = np.array([np.sqrt(_distance(x, i)).sum() for i in range(n)])
            while free.any():
                own = np.flatnonzero(free)
                i = int(own[np.argmin(total[own])])
                out.append(i)
                gone = free & (np.sqrt(_distance(x, i)) <= r)
                gone[i] = True
                for j in np.flatnonzero(gone):
                    total -= np.sqrt(_distance(x, j))
                free &= ~gone
            return out

        i, j = _farthest_pair(x) if n > 1 else (0, 0)
        lo, hi, best = 0.0, float(np.sqrt(_distance(x, i)[j])) if n else 0.0, list(range(n))
        want = n - int(n * ratio)
        for _ in range(rounds):
            r = (lo + hi) / 2
            s = seeds(r)
            if abs(len(s) - want) < abs(len(best) - want):
                best = s
            lo, hi = (r, hi) if len(s) > want else (lo, r)
        return [i for i in range(n) if i not in set(best)]

    return _sequential(df, id_col, features_col, pick, SEQUENTIAL_ROWS)


def variances(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, variance), one pass."""
    row = df.agg(*[F.var_samp(c).alias(c) for c in cols])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("variance")) for c in cols])))


def correlations(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """(feature, r) with the target, one pass."""
    row = df.agg(*[F.corr(c, target).alias(c) for c in cols])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in cols])))


def prune_features(df: DataFrame, cols: list[str], target: str, min_variance: float = 0.0, min_target: float = 0.0, max_pair: float = 0.9) -> list[str]:
    """Features that vary, correlate with the target, and win every pair of larger correlation than max_pair.

    All moments come from one aggregation over the rows; only the matrix of features reaches the driver.
    """
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    aggs = [F.var_samp(c) for c in cols] + [F.corr(c, target) for c in cols] + [F.corr(a, b) for a, b in pairs]
    row = df.agg(*[a.alias(f"v{i}") for i, a in enumerate(aggs)]).first()
    n = len(cols)
    var, cor, mutual = row[:n], [abs(v or 0.0) for v in row[n : 2 * n]], dict(zip(pairs, row[2 * n :], strict=True))
    alive = [c for i, c in enumerate(cols) if (var[i] or 0) > min_variance and cor[i] >= min_target]
    strength = dict(zip(cols, cor, strict=True))
    for a, b in sorted(pairs, key=lambda p: -abs(mutual[p] or 0)):
        if a in alive and b in alive and abs(mutual[a, b] or 0) > max_pair:
            alive.remove(b if strength[a] >= strength[b] else a)
    return alive


def bit_statistics(df: DataFrame, bits_col: str) -> DataFrame:
    """(bit, ones, frequency, variance) of arrays of set bits; bits never set don't come out."""
    n = df.where(F.col(bits_col).isNotNull()).count()
    f = F.col("ones") / F.lit(n)
    return df.select(F.explode(bits_col).alias("bit")).groupBy("bit").agg(F.count("*").alias("ones")).select("bit", "ones", f.alias("frequency"), (f * (1 - f)).alias("variance"))


def prune_bits(df: DataFrame, bits_col: str, bits: int, min_variance: float = 0.0, min_frequency: float = 0.0, max_frequency: float = 1.0, duplicates: bool = True) -> DataFrame:
    """(bit, frequency, variance): the bits of a fingerprint kept by population variance and frequency; of bits set in the same rows the first.

    Without any left, those that vary. Rows in which a bit is set are told apart by a sum of two hashes of a number by row,
    so no list of rows is made; rows need no id. Null fingerprints are left out.
    """
    from crucible.runtime import written

    rows = written(df.where(F.col(bits_col).isNotNull()).select(F.col(bits_col).alias("b")).withColumn("r", F.monotonically_increasing_id()))
    n = max(1, rows.count())
    part = lambda seed: F.sum(F.xxhash64("r", F.lit(seed)).cast("decimal(38,0)"))
    seen = rows.select("r", F.explode(F.array_distinct("b")).alias("bit")).groupBy("bit").agg(F.count("*").alias("ones"), part(1).alias("p"), part(2).alias("q"))
    every = df.sparkSession.range(bits).select(F.col("id").cast("int").alias("bit")).join(seen, "bit", "left")
    f = F.coalesce("ones", F.lit(0)) / F.lit(n)
    every = every.select("bit", f.alias("frequency"), (f * (1 - f)).alias("variance"), "p", "q")
    kept = every.where((F.col("variance") >= min_variance) & F.col("frequency").between(min_frequency, max_frequency))
    if not kept.limit(1).count():
        kept = every.where("variance > 0")
    if duplicates:
        kept = kept.groupBy(F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q")).agg(F.min(F.struct("bit", "frequency", "variance")).alias("k")).select("k.*")
    return kept.select("bit", "frequency", "variance")


def concat_columns(tables: list[DataFrame], order: list[str]) -> DataFrame:
    """Tables side by side by their rows' place in the order of a column each (order[i] of the i-th): place, then all columns with the prefixes t0_, t1_, ...

    Places come from a range sort whose partitions are counted and offset, so no task holds a table. Shorter tables end in
    nulls.
    """
    out = None
    for i, (t, by) in enumerate(zip(tables, order, strict=True)):
        x = with_place(t, by).select("place", *[F.col(c).alias(f"t{i}_{c}") for c in t.columns])
        out = x if out is None else out.join(x, "place", "full")
    return out


def with_place(df: DataFrame, by: str) -> DataFrame:
    """df with the place of every row, from 0, in the order of a column; ties stand in any order."""
    from crucible.runtime import cut

    placed = cut(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    start, offsets = 0, []
    for part, n in placed.groupBy("_part").count().orderBy("_part").collect():  # one row a partition
        offsets.append((part, start))
        start += n
    first = df.sparkSession.createDataFrame(offsets, "_part long, _first long")
    return placed.join(F.broadcast(first), "_part").withColumn("place", F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_first")


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)


SPLITTERS = ("Random", "Scaffold", "Kennard-Stone", "D-Optimal", "Duplex", "Sphere Exclusion", "Boruta")


def split_dataset(df: DataFrame, algorithm: str, ratio: float, smiles_col: str, id_col: str, target_col: str | None = None, feature_cols: list[str] | None = None, descriptors: list[str] | None = None) -> DataFrame:
    """(id, smiles, split_status): rows cleansed (blank and repeated texts dropped, the smallest id kept), then split by name.

    Random and Scaffold need texts only. The others need features: the numeric columns `feature_cols`, or descriptors worked
    out from the text (a small set by default); features are imputed and standardised first, and rows whose text can't be
    read are left out then. Boruta needs a target.
    """
    from crucible.functions import molecules as M

    if algorithm not in SPLITTERS:
        raise ValueError(f"unknown algorithm {algorithm}; there are {', '.join(SPLITTERS)}")
    c = cleanse(df, smiles_col, id_col)
    if algorithm == "Random":
        return random_split(c, id_col, ratio).select(id_col, smiles_col, "split_status")
    if algorithm == "Scaffold":
        return scaffold_split(c, smiles_col, id_col, ratio).select(id_col, smiles_col, "split_status")
    if feature_cols:
        x = standardise(c.select(id_col, *feature_cols, *([target_col] if target_col else [])), feature_cols)
    else:
        names = descriptors or ["MolecularWeight", "HeavyAtomCount", "RingCount", "HeteroAtomCount", "RotatableBonds", "SP3Proportion"]
        x = standardise(M.descriptor_table(c, id_col, smiles_col, names), names)
        if target_col:
            x = x.join(c.select(id_col, target_col), id_col)
    cols = [n for n in x.columns if n not in (id_col, target_col)]
    if algorithm == "Boruta":
        if target_col is None:
            raise ValueError("Boruta needs a target")
        cols = boruta_features(x, cols, target_col)
    v = x.select(id_col, F.array(*[F.col(n).cast("double") for n in cols]).alias("x"))
    f = {"Kennard-Stone": kennard_stone, "Boruta": kennard_stone, "D-Optimal": d_optimal, "Duplex": duplex, "Sphere Exclusion": sphere_exclusion}[algorithm]
    return f(v, id_col, "x", ratio).join(c.select(id_col, smiles_col), id_col).select(id_col, smiles_col, "split_status")


def scaffold_split(df: DataFrame, smiles_col: str, id_col: str, ratio: float) -> DataFrame:
    """Rows of one scaffold in one set, by `group_packing`; a molecule without rings, or one that can't be read, is a group of its own.

    Scaffolds are told apart by their molecule key, so writing order doesn't matter.
    """
    from crucible.functions import molecules as M
    from crucible.functions.molecule_key import molecule_key
    from crucible.runtime import spread, written

    s = F.nullif(M.scaffold(smiles_col), F.lit(""))
    g = spread(df).withColumn("_s", s).withColumn("scaffold", F.coalesce(molecule_key("_s"), F.concat(F.lit("acyclic "), F.col(id_col).cast("string")))).drop("_s")
    return group_packing(written(g), "scaffold", ratio)


def boruta_features(df: DataFrame, cols: list[str], target_col: str, trials: int = 10, hits: int = 5, seed: int = 0) -> list[str]:
    """Features that a random forest finds more important than every shuffled shadow of a feature in at least `hits` of the trials.

    A shadow is another row's value, rows being paired by the order of a hash. A target of at most five values is a class.
    With fewer than two features left the five most important ones are taken. Only importances reach the driver.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    from crucible.runtime import written

    d = written(df.where(F.col(target_col).isNotNull()).select(*cols, F.col(target_col).cast("double").alias("_y")).dropna().withColumn("_r", F.monotonically_increasing_id()))
    classes = d.select("_y").distinct().limit(6).count() <= 5
    if classes:
        d = StringIndexer(inputCol="_y", outputCol="_c").fit(d).transform(d).drop("_y").withColumnRenamed("_c", "_y")
    make = (RandomForestClassifier if classes else RandomForestRegressor)(labelCol="_y", featuresCol="_f", numTrees=50, maxDepth=5, seed=seed)

    def importances(data: DataFrame, names: list[str]) -> np.ndarray:
        model = make.fit(VectorAssembler(inputCols=names, outputCol="_f").transform(data))
        return model.featureImportances.toArray()

    won = np.zeros(len(cols))
    for trial in range(trials):
        a = with_place(d, "_r")
        b = with_place(d.select(*[F.col(c).alias(f"_s_{c}") for c in cols], F.xxhash64("_r", F.lit(trial)).alias("_h")), "_h").drop("_h")
        v = importances(a.join(b, "place"), [*cols, *[f"_s_{c}" for c in cols]])
        won += v[: len(cols)] > v[len(cols) :].max(initial=0.0)
    kept = [c for c, w in zip(cols, won, strict=True) if w >= hits]
    if len(kept) < 2:
        kept = [cols[i] for i in np.argsort(-importances(d, cols), kind="stable")[:5]]
    return kept
