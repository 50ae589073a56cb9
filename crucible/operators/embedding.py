"""Low-dimensional maps of vectors: UMAP in stages, t-SNE of a bounded table, and isolation of outliers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.operators.similarity import distances, fuzzy_union, nearest
from crucible.operators.structure import smooth_knn
from crucible.runtime import written

#: Rows that the layout takes: its steps depend on each other, so it runs in one task; more raise an error.
LAYOUT_ROWS = 50_000


def curve_parameters(spread: float = 1.0, min_dist: float = 0.1, rounds: int = 100) -> tuple[float, float]:
    """a and b for which 1 / (1 + a x^(2b)) is nearest, by squares over 300 places up to three spreads, to 1 up to min_dist and exp(-(x - min_dist) / spread) beyond; damped Gauss-Newton."""
    x = np.linspace(0, 3 * spread, 300)
    y = np.where(x <= min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p, damp = np.array([1.0, 1.0]), 1e-3
    log_x = np.log(np.where(x > 0, x, 1.0))

    def model(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = np.where(x > 0, x, 0.0) ** (2 * p[1])
        f = 1 / (1 + p[0] * t)
        return f, np.stack([-t * f * f, -2 * p[0] * t * log_x * f * f], axis=1)

    f, j = model(p)
    for _ in range(rounds):
        step = np.linalg.solve(j.T @ j + damp * np.diag(np.diag(j.T @ j)), j.T @ (y - f))
        new = p + step
        if (new > 0).all():
            g, k = model(new)
            if ((y - g) ** 2).sum() < ((y - f) ** 2).sum():
                p, f, j, damp = new, g, k, damp / 3
                if np.abs(step).max() < 1e-10:
                    break
                continue
        damp *= 4
        if damp > 1e12:
            break
    return float(p[0]), float(p[1])


def fuzzy_graph(rows: DataFrame, id_col: str, vector_col: str, neighbours: int = 15, metric: str = "euclidean", mix: float = 1.0) -> DataFrame:
    """(i, j, w): the fuzzy neighbour graph of all rows, both directions, weights over the largest."""
    directed = written(smooth_knn(nearest(rows, id_col, vector_col, neighbours, metric, queries=rows), neighbours))  # both directions read it
    e = written(fuzzy_union(directed, mix))
    most = e.agg(F.max("w")).first()[0]
    return e.withColumn("w", F.col("w") / F.lit(most) if most else F.col("w"))


def spectral_start(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """Eigenvectors of the normalised graph after the first, scaled to a deviation of 1e-4; random where the graph falls apart.

    Found by subspace iteration on the edges, so memory follows their number.
    """
    rng = np.random.default_rng(seed)
    root = np.arange(n)
    while True:  # smallest node of each part
        low = root.copy()
        np.minimum.at(low, i, root[j])
        low = low[low]
        if (low == root).all():
            break
        root = low
    if n <= dims + 1 or len(np.unique(root)) > 1:
        return 1e-4 * rng.standard_normal((n, dims))
    degree = np.zeros(n)
    np.add.at(degree, i, w)
    scale = 1 / np.sqrt(np.maximum(degree, 1e-12))
    v = w * scale[i] * scale[j]
    first = np.sqrt(np.maximum(degree, 0))
    first /= np.linalg.norm(first)
    q = rng.standard_normal((n, dims + 4))
    for _ in range(300):
        q -= np.outer(first, first @ q)
        y = q.copy()  # (I + graph) / 2 has no negative eigenvalues
        np.add.at(y, i, v[:, None] * q[j])
        q = np.linalg.qr(y / 2)[0]
    s = np.zeros_like(q)
    np.add.at(s, i, v[:, None] * q[j])
    values, turn = np.linalg.eigh(q.T @ s)
    out = (q @ turn)[:, np.argsort(-values)[:dims]]
    sd = out.std(axis=0)
    return out / np.where(sd > 0, sd, 1.0) * 1e-4


def layout(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, start: np.ndarray, a: float, b: float, epochs: int = 200, rate: float = 1.0, negatives: int = 5, seed: int = 42, block: int = 256) -> np.ndarray:
    """Stochastic gradient layout: every edge pulls its ends by its weight, `negatives` random points push the first; moves are clipped at 4.

    Edges are shuffled in every epoch and moved in blocks, within which positions are those at the block's start.
    """
    rng, y = np.random.default_rng(seed), start.copy()
    for epoch in range(epochs):
        step, order = rate * (1 - epoch / epochs), rng.permutation(len(i))
        for at in range(0, len(order), block):
            own = order[at : at + block]
            p, q, u = i[own], j[own], w[own][:, None]
            d = y[p] - y[q]
            r = (d * d).sum(axis=1, keepdims=True) + 1e-12
            pull = np.clip(u * (-a * b * r ** (b - 1) / (1 + a * r**b)) * d, -4, 4)
            move = np.zeros_like(y)
            np.add.at(move, p, pull)
            np.add.at(move, q, -pull)
            for k in rng.integers(0, n, (negatives, len(own))):
                away = (k != p) & (k != q)
                d = y[p] - y[k]
                r = (d * d).sum(axis=1, keepdims=True) + 1e-12
                push = np.clip((1 - u) * (2 * b / ((1e-3 + r) * (1 + a * r**b))) * d, -4, 4)
                np.add.at(move, p[away], push[away])
            y += step * move
    return y


class Umap(NamedTuple):
    """A fitted map: (id, y) of the rows it was fitted on, their vectors, and its parameters."""

    embedding: DataFrame
    rows: DataFrame
    id_col: str
    vector_col: str
    a: float
    b: float
    neighbours: int
    metric: str
    dims: int


def fit_umap(rows: DataFrame, id_col: str, vector_col: str, neighbours: int = 15, dims: int = 2, min_dist: float = 0.1, spread: float = 1.0, metric: str = "euclidean", epochs: int = 200, seed: int = 42) -> Umap:
    """Distances, neighbours and the fuzzy graph are Spark's; the layout, whose steps follow each other, runs in one task of at most LAYOUT_ROWS rows.

    Null vectors are left out. One row lies at the origin; no rows give an empty map.
    """
    x = written(rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col), F.col(vector_col).cast("array<double>").alias(vector_col)))
    n = x.count()
    if n > LAYOUT_ROWS:
        raise ValueError(f"{n} rows; the layout takes {LAYOUT_ROWS}")
    a, b = curve_parameters(spread, min_dist)
    k = min(neighbours, n - 1)
    schema = "id long, y array<double>"
    if n <= 1:
        e = x.select(F.col(id_col).cast("long").alias("id"), F.array(*[F.lit(0.0)] * dims).alias("y"))
        return Umap(e, x, id_col, vector_col, a, b, neighbours, metric, dims)
    graph = fuzzy_graph(x, id_col, vector_col, k, metric)
    # isolated rows come along without an edge
    packed = graph.select(F.lit(0).alias("one"), "i", "j", "w").union(x.select(F.lit(0), F.col(id_col).cast("long"), F.lit(None).cast("long"), F.lit(0.0)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(pdf.loc[pdf["j"].isna(), "i"].to_numpy(np.int64))
        e = pdf[pdf["j"].notna()].sort_values(["i", "j"])
        i, j, w = np.searchsorted(ids, e["i"].to_numpy(np.int64)), np.searchsorted(ids, e["j"].to_numpy(np.int64)), e["w"].to_numpy(float)
        y = layout(len(ids), i, j, w, spectral_start(len(ids), i, j, w, dims, seed), a, b, epochs, seed=seed)
        return pd.DataFrame({"id": ids, "y": list(y)})

    return Umap(written(packed.groupBy("one").applyInPandas(run, schema)), x, id_col, vector_col, a, b, neighbours, metric, dims)


def transform_umap(model: Umap, rows: DataFrame, id_col: str, vector_col: str, epochs: int = 30, rate: float = 1.0) -> DataFrame:
    """(id, y) of new rows: the mean of their nearest fitted rows' places, weighted by exp(-d / mean d), then pulled towards these in `epochs` steps.

    New ids must differ from the fitted ones, as a row isn't its own neighbour.
    """
    near = nearest(model.rows, model.id_col, model.vector_col, model.neighbours, model.metric, queries=rows.select(F.col(id_col).alias(model.id_col), F.col(vector_col).alias(model.vector_col)))
    near = near.join(model.embedding, "id")
    a, b, dims = model.a, model.b, model.dims

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["distance", "id"])
        d, y = pdf["distance"].to_numpy(float), np.array(pdf["y"].tolist(), float).reshape(-1, dims)
        w = np.exp(-d / max(float(d.mean()), 1e-12))
        w = w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))
        p = w @ y
        for _ in range(epochs):
            for u, t in zip(w, y, strict=True):
                g = p - t
                r = float(g @ g) + 1e-12
                p = p + rate * np.clip(u * (-2 * a * b * r ** (b - 1) / (1 + a * r**b)) * g, -4, 4)
        return pd.DataFrame({"id": [pdf["query"].iloc[0]], "y": [p]})

    return near.groupBy("query").applyInPandas(run, "id long, y array<double>")


#: Rows that t-SNE takes: every pair of rows counts in every step.
TSNE_ROWS = 5_000


def tsne(rows: DataFrame, id_col: str, vector_col: str, perplexity: float = 30.0, dims: int = 2, steps: int = 500, seed: int = 42) -> DataFrame:
    """(id, y) by exact t-SNE from the first principal axes, in one task of at most TSNE_ROWS rows."""
    n = rows.where(F.col(vector_col).isNotNull()).count()
    if n > TSNE_ROWS:
        raise ValueError(f"{n} rows; t-SNE takes {TSNE_ROWS}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.array(pdf["x"].tolist(), float)
        n = len(x)
        if n < 3:
            return pd.DataFrame({"id": pdf["id"], "y": list(np.zeros((n, dims)))})
        d = np.square(distances(x, x, "euclidean"))
        goal, p = np.log(min(perplexity, (n - 1) / 3)), np.zeros((n, n))
        for i in range(n):
            lo, hi, beta = 0.0, np.inf, 1.0
            own = np.delete(d[i], i)
            for _ in range(60):
                e = np.exp(-(own - own.min()) * beta)
                s = e.sum()
                h = np.log(s) + beta * float((own - own.min()) @ e) / s
                if abs(h - goal) < 1e-6:
                    break
                if h > goal:
                    lo, beta = beta, beta * 2 if hi == np.inf else (beta + hi) / 2
                else:
                    hi, beta = beta, (beta + lo) / 2
            p[i] = np.insert(e / s, i, 0.0)
        p = np.maximum((p + p.T) / (2 * n), 1e-12)
        c = x - x.mean(axis=0)
        u, s, _ = np.linalg.svd(c, full_matrices=False)
        y = u[:, :dims] * s[:dims]
        y = np.hstack([y, np.zeros((n, dims - y.shape[1]))]) if y.shape[1] < dims else y
        y = y / max(float(y[:, 0].std()), 1e-12) * 1e-4
        y += 1e-6 * np.random.default_rng(seed).standard_normal(y.shape)
        v, gain, rate = np.zeros_like(y), np.ones_like(y), max(n / 12 / 4, 50.0)
        for t in range(steps):
            q = 1 / (1 + np.square(distances(y, y, "euclidean")))
            np.fill_diagonal(q, 0.0)
            f = ((12 if t < steps // 4 else 1) * p - np.maximum(q / q.sum(), 1e-12)) * q
            g = 4 * (f.sum(axis=1)[:, None] * y - f @ y)
            gain = np.maximum(np.where(np.sign(g) != np.sign(v), gain + 0.2, gain * 0.8), 0.01)
            v = (0.5 if t < steps // 4 else 0.8) * v - rate * gain * g
            y = y + v
            y -= y.mean(axis=0)
        return pd.DataFrame({"id": pdf["id"], "y": list(y)})

    kind = dict(rows.dtypes)[id_col]
    x = rows.where(F.col(vector_col).isNotNull()).select(F.lit(0).alias("one"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    return x.groupBy("one").applyInPandas(run, f"id {kind}, y array<double>").withColumnRenamed("id", id_col)


def isolation_scores(rows: DataFrame, id_col: str, vector_col: str, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """(id, score): how early random cuts isolate a row, between 0 and 1, higher for outliers.

    Trees are grown on the driver from samples of `sample` rows each (documented bound: trees * sample rows, those of the
    smallest hashes) and sent to the workers; every row is scored. Null vectors are left out.
    """
    x = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    got = np.array([r.x for r in x.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(trees * sample).collect()], float)
    rng = np.random.default_rng(seed)

    def depth_left(n: int) -> float:
        return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def grow(own: np.ndarray, depth: int, most: int) -> tuple:
        spread = np.ptp(own, axis=0) if len(own) else np.zeros(0)
        able = np.flatnonzero(spread > 0)
        if depth >= most or len(own) <= 1 or not len(able):
            return (depth + depth_left(len(own)),)
        k = int(rng.choice(able))
        at = float(rng.uniform(own[:, k].min(), own[:, k].max()))
        left = own[:, k] < at
        return (k, at, grow(own[left], depth + 1, most), grow(own[~left], depth + 1, most))

    size = min(sample, len(got))
    forest = [grow(got[rng.choice(len(got), size, replace=False)], 0, int(np.ceil(np.log2(max(size, 2))))) for _ in range(trees)] if size else []
    sent = rows.sparkSession.sparkContext.broadcast(forest)  # trees of at most 2 * sample nodes
    norm = max(depth_left(size), 1e-12)

    def walk(node: tuple, v: np.ndarray, own: np.ndarray, out: np.ndarray) -> None:
        if not len(own):
            return
        if len(node) == 1:
            out[own] += node[0]
            return
        left = v[own, node[0]] < node[1]
        walk(node[2], v, own[left], out)
        walk(node[3], v, own[~left], out)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            v = np.array(b["x"].tolist(), float)
            total = np.zeros(len(v))
            for tree in sent.value:
                walk(tree, v, np.arange(len(v)), total)
            yield pd.DataFrame({"id": b["id"], "score": 2.0 ** (-total / max(1, len(sent.value)) / norm)})

    return x.mapInPandas(score, f"id {dict(rows.dtypes)[id_col]}, score double").withColumnRenamed("id", id_col)


def outliers(rows: DataFrame, id_col: str, vector_col: str, share: float = 0.05, **kw: int) -> DataFrame:
    """(id, score, outlier): the rows above the (1 - share) quantile of the scores."""
    s = isolation_scores(rows, id_col, vector_col, **kw)
    at = s.agg(F.percentile("score", F.lit(1 - share))).first()[0]
    return s.withColumn("outlier", F.col("score") > F.lit(at if at is not None else 1.0))
