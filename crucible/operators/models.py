"""Models on feature tables, over pyspark.ml."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crucible.operators.statistics import regression_metrics

REGRESSORS = {
    "ols": lambda: LinearRegression(), "ridge": lambda: LinearRegression(regParam=0.1), "lasso": lambda: LinearRegression(regParam=0.1, elasticNetParam=1.0),
    "forest": lambda: RandomForestRegressor(seed=42), "boosted": lambda: GBTRegressor(seed=42),
}


def assembled(df: DataFrame, cols: list[str], scale: bool = True, fitted_on: DataFrame | None = None) -> DataFrame:
    """df with a vector column `features`; rows with a null feature are left out. Scaling is fitted on `fitted_on` or df."""
    va = VectorAssembler(inputCols=cols, outputCol="_raw", handleInvalid="skip")
    x = va.transform(df)
    if not scale:
        return x.withColumnRenamed("_raw", "features")
    fit = va.transform(fitted_on) if fitted_on is not None else x
    return StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(fit).transform(x).drop("_raw")


def regression(df: DataFrame, cols: list[str], target: str, split_col: str, kind: str = "ols") -> DataFrame:
    """(set, n, rmse, mae, r2, ...): a model fitted on the rows whose split starts like train, judged on both sets."""
    s = F.lower(F.trim(split_col))
    d = df.where(F.col(target).isNotNull()).withColumn("set", F.when(s.rlike("^(train|tr|1)"), "train").when(s.rlike("^(test|te|ext|valid|2)"), "test")).where("set is not null")
    train = d.where("set = 'train'")
    model = REGRESSORS[kind]().setLabelCol(target).setFeaturesCol("features").fit(assembled(train, cols))
    p = model.transform(assembled(d, cols, fitted_on=train))
    return p.groupBy("set").agg(*regression_metrics(target, "prediction"))


def principal_components(df: DataFrame, cols: list[str], k: int = 2) -> DataFrame:
    """df with `pc`, an array of the k first components of the centred, scaled features; signs are arbitrary."""
    x = assembled(df, cols)
    return PCA(k=k, inputCol="features", outputCol="_pc").fit(x).transform(x).withColumn("pc", vector_to_array("_pc")).drop("_pc", "features")


def k_means(df: DataFrame, cols: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    x = assembled(df, cols)
    return KMeans(k=k, seed=seed).fit(x).transform(x).drop("features").withColumnRenamed("prediction", "cluster")


# --- models from sums over the rows ---------------------------------------------


class Moments:
    """Count, means and centred cross products of columns and a target, from one aggregation; rows with a null are left out.

    Linear models, their cross-validation by folds and the search for features read these and never the rows again.
    """

    def __init__(self, cols: list[str], n: float, total: np.ndarray, cross: np.ndarray):
        self.cols, self.n, self.total, self.cross = cols, n, total, cross

    @staticmethod
    def by_fold(df: DataFrame, cols: list[str], target: str, fold: Column | None = None) -> dict[int, Moments]:
        names = [*cols, target]
        d = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)], (fold if fold is not None else F.lit(0)).cast("int").alias("fold")).dropna()
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        aggs = [F.count("*").cast("double").alias("n"), *[F.sum(f"c{i}").alias(f"s{i}") for i in range(len(names))], *[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"p{i}_{j}") for i, j in pairs]]
        out = {}
        for r in d.groupBy("fold").agg(*aggs).collect():  # a row a fold
            cross = np.zeros((len(names), len(names)))
            for i, j in pairs:
                cross[i, j] = cross[j, i] = r[f"p{i}_{j}"]
            out[r.fold] = Moments(cols, r.n, np.array([r[f"s{i}"] for i in range(len(names))]), cross)
        return out

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.cols, self.n + other.n, self.total + other.total, self.cross + other.cross)

    def centred(self) -> np.ndarray:
        return self.cross - np.outer(self.total, self.total) / max(self.n, 1.0)

    def ridge(self, use: list[int] | None = None, penalty: float = 0.0) -> tuple[np.ndarray, float]:
        """Coefficients on standardised features (brought back to the columns' scale) and intercept."""
        use = list(range(len(self.cols))) if use is None else use
        s, m = self.centred(), self.total / max(self.n, 1.0)
        sd = np.sqrt(np.maximum(np.diag(s)[use] / max(self.n, 1.0), 1e-300))
        a = s[np.ix_(use, use)] / np.outer(sd, sd) + penalty * self.n * np.eye(len(use))
        w = np.linalg.lstsq(a, s[use, -1] / sd, rcond=None)[0] / sd
        return w, float(m[-1] - m[use] @ w)

    def pls(self, parts: int, use: list[int] | None = None) -> tuple[np.ndarray, float]:
        """Partial least squares with that many components, on standardised features, from the cross products alone."""
        use = list(range(len(self.cols))) if use is None else use
        s, m = self.centred(), self.total / max(self.n, 1.0)
        sd = np.sqrt(np.maximum(np.diag(s)[use] / max(self.n, 1.0), 1e-300))
        a, b = s[np.ix_(use, use)] / np.outer(sd, sd), s[use, -1] / sd
        basis, c = [], b.copy()
        for _ in range(min(parts, len(use))):
            for v in basis:  # the next direction, orthogonal in the features' scores to those before
                c = c - v * float(v @ a @ c) / max(float(v @ a @ v), 1e-300)
            if np.linalg.norm(c) < 1e-12:
                break
            basis.append(c / np.linalg.norm(c))
            w = np.array(basis).T
            fit = w @ np.linalg.lstsq(w.T @ a @ w, w.T @ b, rcond=None)[0]
            c = b - a @ fit
        w = (fit if basis else np.zeros(len(use))) / sd
        return w, float(m[-1] - m[use] @ w)

    def error(self, w: np.ndarray, b: float, use: list[int] | None = None) -> float:
        """Sum of squared errors of a linear model on these rows."""
        use = list(range(len(self.cols))) if use is None else use
        v = np.zeros(len(self.total))
        v[use], v[-1] = -w, 1.0
        return float(v @ self.cross @ v - 2 * b * (v @ self.total) + b * b * self.n)

    def r2(self, use: list[int]) -> float:
        total = self.centred()[-1, -1]
        return 1 - self.error(*self.ridge(use), use) / total if total > 0 else 0.0


def _fold(id_col: str, folds: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(folds)).cast("int")


def cross_validate(df: DataFrame, id_col: str, cols: list[str], target: str, folds: int = 5, kind: str = "ols", seed: int = 42, **kw: float) -> DataFrame:
    """(fold, n, rmse) of every held-out fold and fold -1 for all together, with q2 there: one aggregation over the rows.

    kind is ols, ridge (penalty) or pls (parts). Folds go by a hash of the id.
    """
    m = Moments.by_fold(df, cols, target, _fold(id_col, folds, seed))
    rows, press, n = [], 0.0, 0.0
    for k in sorted(m):
        others = [m[j] for j in m if j != k]
        if not others:
            continue
        train = others[0]
        for o in others[1:]:
            train = train + o
        w, b = train.pls(int(kw.get("parts", 2))) if kind == "pls" else train.ridge(None, kw.get("penalty", 0.1) if kind == "ridge" else 0.0)
        e = max(0.0, m[k].error(w, b))
        rows.append((k, int(m[k].n), float(np.sqrt(e / m[k].n)), None))
        press, n = press + e, n + m[k].n
    if rows:
        whole = m[rows[0][0]]
        for k, *_ in rows[1:]:
            whole = whole + m[k]
        tss = whole.centred()[-1, -1]
        rows.append((-1, int(n), float(np.sqrt(press / n)), float(1 - press / tss) if tss > 0 else None))
    return df.sparkSession.createDataFrame(rows, "fold int, n long, rmse double, q2 double")


def leave_one_out(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """(n, press, q2) of least squares with each row held out in turn, by its leverage: no model is fitted again."""
    m = Moments.by_fold(df, cols, target).get(0)
    if m is None or m.n <= len(cols) + 1:
        return df.sparkSession.createDataFrame([], "n long, press double, q2 double")
    w, b = m.ridge()
    mean, inv = m.total[:-1] / m.n, np.linalg.pinv(m.centred()[:-1, :-1])
    d = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)], F.col(target).cast("double").alias("y")).dropna()
    dev = [F.col(f"c{i}") - float(v) for i, v in enumerate(mean)]
    h = sum((dev[i] * dev[j] * float(inv[i, j]) for i in range(len(cols)) for j in range(len(cols))), F.lit(1 / m.n))
    e = F.col("y") - sum((F.col(f"c{i}") * float(v) for i, v in enumerate(w)), F.lit(b))
    press = F.sum(F.pow(e / (1 - h), 2))
    return d.agg(F.count("*").alias("n"), press.alias("press"), (1 - press / F.lit(float(m.centred()[-1, -1]))).alias("q2"))


def select_by_genes(df: DataFrame, cols: list[str], target: str, least: int = 1, most: int = 5, population: int = 30, generations: int = 30, seed: int = 42) -> list[str]:
    """Features of highest adjusted determination by a genetic search: tournaments of three, uniform crossover in nine of ten, flips of eight in a hundred; the best stays.

    The rows are read once, for their cross products; the search runs on these.
    """
    m, rng, p = Moments.by_fold(df, cols, target).get(0), np.random.default_rng(seed), len(cols)
    if m is None:
        return []
    known: dict[bytes, float] = {}

    def fitness(g: np.ndarray) -> float:
        key = g.tobytes()
        if key not in known:
            use = np.flatnonzero(g).tolist()
            known[key] = 1 - (1 - m.r2(use)) * (m.n - 1) / max(m.n - len(use) - 1, 1) if use else -1.0
        return known[key]

    def repaired(g: np.ndarray) -> np.ndarray:
        while g.sum() > min(most, p):
            g[rng.choice(np.flatnonzero(g))] = False
        while g.sum() < min(least, p):
            g[rng.choice(np.flatnonzero(~g))] = True
        return g

    herd = [repaired(rng.random(p) < 0.5) for _ in range(population)]
    for _ in range(generations):
        def winner(herd: list = herd) -> np.ndarray:
            return max((herd[i] for i in rng.integers(0, len(herd), 3)), key=fitness)

        new = [max(herd, key=fitness).copy()]
        while len(new) < population:
            a, b = winner().copy(), winner()
            if rng.random() < 0.9:
                a = np.where(rng.random(p) < 0.5, a, b)
            new.append(repaired(a ^ (rng.random(p) < 0.08)))
        herd = new
    best = max(herd, key=fitness)
    return [c for c, g in zip(cols, best, strict=True) if g]


def select_by_foxes(df: DataFrame, cols: list[str], target: str, size: int, population: int = 20, rounds: int = 50, seed: int = 42) -> list[str]:
    """`size` features of highest determination: in each round the worse half of the foxes give up one feature for one they lack, of the best fox's where it has such, and keep the change when it helps."""
    m, rng, p = Moments.by_fold(df, cols, target).get(0), np.random.default_rng(seed), len(cols)
    size = min(size, p)
    if m is None or size == 0:
        return []
    foxes = [sorted(rng.choice(p, size, replace=False).tolist()) for _ in range(population)]
    score = [m.r2(f) for f in foxes]
    for _ in range(rounds):
        order = np.argsort(score)[::-1]
        best = set(foxes[order[0]])
        for i in order[len(order) // 2 :]:
            lacks = [c for c in best if c not in foxes[i]] or [c for c in range(p) if c not in foxes[i]]
            if not lacks:
                continue
            new = foxes[i].copy()
            new[int(rng.integers(size))] = int(rng.choice(lacks if rng.random() < 0.5 else [c for c in range(p) if c not in foxes[i]]))
            v = m.r2(new)
            if v > score[i]:
                foxes[i], score[i] = sorted(new), v
    return [cols[c] for c in foxes[int(np.argmax(score))]]


def shuffled_targets(df: DataFrame, id_col: str, cols: list[str], target: str, trials: int = 20, seed: int = 42) -> DataFrame:
    """(trial, r2): determination of least squares on targets dealt to other rows by hash, trial 0 being the true one; how many reach it tells what chance gives.

    Every trial is one aggregation; rows are paired by their places in two orders.
    """
    from crucible.operators.dataset import with_place
    from crucible.runtime import written

    d = written(df.select(F.col(id_col).alias("_i"), *cols, F.col(target).alias("_y")).dropna())
    out = []
    for t in range(trials + 1):
        x = d if t == 0 else with_place(d.drop("_y"), "_i").join(with_place(d.select("_y", F.xxhash64("_i", F.lit(seed + t)).alias("_h")), "_h").drop("_h"), "place")
        m = Moments.by_fold(x, cols, "_y").get(0)
        out.append((t, float(m.r2(list(range(len(cols))))) if m else None))
    return df.sparkSession.createDataFrame(out, "trial int, r2 double")


CLASSIFIERS = {
    "logistic": lambda: LogisticRegression(), "forest": lambda: RandomForestClassifier(seed=42), "bayes": lambda: NaiveBayes(modelType="gaussian"),
}


def classification(df: DataFrame, cols: list[str], target: str, split_col: str, kind: str = "logistic", mode: str | None = None) -> DataFrame:
    """One row of `class_metrics` for each set: a classifier fitted on the training rows, nulls filled with the training means, judged on both sets.

    mode checks the number of classes (Binary, Ternary, Multiclass).
    """
    from crucible.operators.statistics import check_classes, class_metrics

    if mode:
        check_classes(df, target, mode)
    s = F.lower(F.trim(split_col))
    d = df.where(F.col(target).isNotNull()).withColumn("set", F.when(s.rlike("^(train|tr|1)"), "train").when(s.rlike("^(test|te|ext|valid|2)"), "test")).where("set is not null")
    train = d.where("set = 'train'")
    means = train.agg(*[F.avg(c).alias(c) for c in cols]).first()
    filled = lambda t: t.select("set", target, *[F.coalesce(F.col(c).cast("double"), F.lit(float(means[c] or 0.0))).alias(c) for c in cols])
    index = StringIndexer(inputCol=target, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip").fit(train)
    fitted = filled(train)
    model = CLASSIFIERS[kind]().setLabelCol("_label").setFeaturesCol("features").fit(assembled(index.transform(fitted), cols))
    p = model.transform(assembled(index.transform(filled(d)), cols, fitted_on=fitted))
    out = None
    for name in ("train", "test"):
        r = class_metrics(p.where(F.col("set") == name), "_label", "prediction").withColumn("set", F.lit(name))
        out = r if out is None else out.union(r)
    return out
