"""Similarity of vectors and bit sets; nearest neighbours of a stated query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024  # query vectors of a block; blocks of rows are twice as large


def tanimoto(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two arrays of set bits; `empty` where both are empty."""
    c = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(empty)).otherwise(c / (F.size(a) + F.size(b) - c))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distances(queries: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Rows of x against queries: euclidean, cityblock, cosine, hamming, tanimoto or dice."""
    if metric in ("cityblock", "hamming"):
        out = np.empty((len(x), len(queries)))
        step = max(1, (1 << 22) // max(1, queries.size))  # so that differences take some 32 MB at a time
        for at in range(0, len(x), step):
            d = x[at : at + step, None, :] - queries[None, :, :]
            out[at : at + step] = np.abs(d).sum(axis=2) if metric == "cityblock" else (d != 0).mean(axis=2)
        return out
    # not by BLAS, whose last bits depend on a row's place: equal rows must be equally far
    p, a, b = np.einsum("id,jd->ij", x, queries), (x * x).sum(axis=1)[:, None], (queries * queries).sum(axis=1)[None, :]
    if metric == "euclidean":
        return np.sqrt(np.maximum(a + b - 2 * p, 0))
    if metric == "cosine":
        return 1 - p / np.maximum(np.sqrt(a * b), 1e-300)
    if metric == "tanimoto":
        return np.clip(1 - p / np.maximum(a + b - p, 1e-12), 0, 1)
    if metric == "dice":
        return np.clip(1 - 2 * p / np.maximum(a + b, 1e-12), 0, 1)
    raise ValueError(metric)


def _packed(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """(prefix_ids, prefix_vectors): about `size` rows (id, v) a block, dealt by a hash of the id."""
    blocks = max(1, -(-rows.count() // size))
    g = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("b").agg(F.collect_list(F.struct("id", "v")).alias("r"))
    return g.select(F.col("r")["id"].alias(f"{prefix}_ids"), F.flatten(F.col("r")["v"]).alias(f"{prefix}_vectors"))


def nearest(rows: DataFrame, id_col: str, vector_col: str, k: int, metric: str = "euclidean", queries: DataFrame | None = None) -> DataFrame:
    """(query, id, distance, rank): the k nearest rows of every query row, itself excluded; ties by id.

    By default the queries are the rows whose id is divisible by 100. Blocks of about `BLOCK` queries meet blocks of about
    twice as many rows, a task several pairs of blocks; a pair gives k rows a query, and the k nearest of these are kept
    before and after the shuffle. Nothing passes through the driver; Spark sends the query blocks to all tasks where its own
    size check allows. Null vectors are left out; vectors must have one length.
    """
    x = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    q = (queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")) if queries is not None else x.where("id % 100 = 0")).where("v is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, vectors, own, mine in zip(b["q_ids"], b["q_vectors"], b["r_ids"], b["r_vectors"], strict=True):
                ids, own = np.asarray(ids), np.asarray(own)
                order = np.argsort(own, kind="stable")
                own = own[order]
                d = distances(np.asarray(vectors, float).reshape(len(ids), -1), np.asarray(mine, float).reshape(len(own), -1)[order], metric)
                d[(own[:, None] == ids[None, :]) | ~np.isfinite(d)] = np.inf
                keep = min(k, len(own))
                # all rows nearer than the k-th, filled up by the smallest ids of those as near
                last = np.partition(d, keep - 1, axis=0)[keep - 1]
                tied = d == last
                top = (d < last) | (tied & (np.cumsum(tied, axis=0) <= keep - (d < last).sum(axis=0)))
                row, col = np.nonzero(top & np.isfinite(d))
                yield pd.DataFrame({"query": ids[col], "id": own[row], "distance": d[row, col]})

    pairs = _packed(x, 2 * BLOCK, "r").crossJoin(_packed(q, BLOCK, "q"))  # blocks of a stated query set against blocks of all rows
    out = pairs.mapInPandas(run, "query long, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def fuzzy_union(edges: DataFrame, mix: float = 1.0) -> DataFrame:
    """(i, j, w): mix * (a + b - ab) + (1 - mix) * ab of each directed edge and its reverse, without loops."""
    e = edges.where("i <> j").groupBy("i", "j").agg(F.max("w").alias("a"))
    r = e.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("a").alias("b"))
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return e.join(r, ["i", "j"], "full").select("i", "j", (mix * (a + b - a * b) + (1 - mix) * a * b).alias("w"))
