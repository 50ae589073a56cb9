"""Comparison of distributions and quality of models, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crucible.runtime import written


def kolmogorov_smirnov(df: DataFrame, group_col: str, value_col: str, reference: str) -> DataFrame:
    """(group, ks): largest difference of each group's distribution from the reference group's.

    The difference is largest at a value of the group or just before it, so every group is met at its own distinct values only.
    Values are sorted by range; running sums go within a range and are offset by the sums of the ranges before, so no window
    holds all values. Nulls are left out.
    """
    d = df.where(F.col(value_col).isNotNull() & F.col(group_col).isNotNull()).select(F.col(group_col).alias("g"), F.col(value_col).cast("double").alias("v"))
    cells = d.groupBy("g", "v").agg(F.count("*").alias("c"))
    up = lambda *by: Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    before = lambda *by: Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)

    at = cells.groupBy("v").agg(F.coalesce(F.sum(F.when(F.col("g") == reference, F.col("c"))), F.lit(0)).alias("r"))
    at = written(at.repartitionByRange("v").withColumn("part", F.spark_partition_id()))  # a value's range mustn't change between its uses
    parts = at.groupBy("part").agg(F.sum("r").alias("s")).withColumn("below", F.coalesce(F.sum("s").over(before(F.lit(0))), F.lit(0))).select("part", "below")  # a row a partition
    at = at.withColumn("run", F.sum("r").over(up("part"))).join(F.broadcast(parts), "part").select("v", "part", "r", (F.col("run") + F.col("below")).alias("ref"))
    rn = cells.where(F.col("g") == reference).agg(F.sum("c")).first()[0] or 0
    own = cells.where(F.col("g") != reference).join(at, "v").withColumn("run", F.sum("c").over(up("part", "g")))
    base = own.groupBy("g", "part").agg(F.sum("c").alias("s"))
    base = base.withColumn("n", F.sum("s").over(Window.partitionBy("g"))).withColumn("base", F.coalesce(F.sum("s").over(before("g")), F.lit(0))).select("g", "part", "n", "base")  # a row a group and partition
    j = own.join(base, ["g", "part"])
    after = F.abs((F.col("run") + F.col("base")) / F.col("n") - F.col("ref") / F.lit(max(1, rn)))
    ahead = F.abs((F.col("run") + F.col("base") - F.col("c")) / F.col("n") - (F.col("ref") - F.col("r")) / F.lit(max(1, rn)))
    return j.groupBy(F.col("g").alias(group_col)).agg(F.max(F.greatest(after, ahead)).alias("ks"))


def kullback_leibler(df: DataFrame, group_col: str, value_col: str, reference: str, bins: int = 49, floor: float = 1e-10) -> DataFrame:
    """(group, kl): divergence of the reference's histogram from each group's over common equal bins, `floor` added and renormalised."""
    d = df.where(F.col(value_col).isNotNull() & F.col(group_col).isNotNull()).select(F.col(group_col).alias("g"), F.col(value_col).cast("double").alias("v"))
    span = d.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    width = F.greatest((F.col("hi") - F.col("lo")) / bins, F.lit(1e-300))
    h = d.join(F.broadcast(span)).groupBy("g", b.cast("int").alias("b"), width.alias("w")).agg(F.count("*").alias("c"))
    n = d.groupBy("g").agg(F.count("*").alias("n"))
    grid = n.join(F.broadcast(span)).select("g", "n", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("b"))
    p = grid.join(h.drop("w"), ["g", "b"], "left").select("g", "b", (F.coalesce("c", F.lit(0)) / F.col("n") / F.col("w") + floor).alias("p"))
    p = p.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("g")))  # bins a group
    r = p.where(F.col("g") == reference).select("b", F.col("p").alias("r"))
    return p.where(F.col("g") != reference).join(F.broadcast(r), "b").groupBy(F.col("g").alias(group_col)).agg(F.sum(F.col("r") * F.log(F.col("r") / F.col("p"))).alias("kl"))


def regression_metrics(y: str, p: str) -> list[Column]:
    """Aggregates: n, rmse, mae, r2, ccc_samp, ccc_pop, q2, slope."""
    e = F.col(y) - F.col(p)
    return [
        F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.pow(F.corr(y, p), 2).alias("r2"),
        (2 * F.covar_samp(y, p) / (F.var_samp(y) + F.var_samp(p) + F.pow(F.avg(y) - F.avg(p), 2))).alias("ccc_samp"),
        (2 * F.covar_pop(y, p) / (F.var_pop(y) + F.var_pop(p) + F.pow(F.avg(y) - F.avg(p), 2))).alias("ccc_pop"),
        (1 - F.sum(e * e) / (F.var_pop(y) * F.count(y))).alias("q2"), F.regr_slope(y, p).alias("slope"),
    ]


def external_q2(train: DataFrame, test: DataFrame, y: str, p: str) -> DataFrame:
    """(q2_f1, q2_f2, q2_f3) of predictions on a test set."""
    a = train.agg(F.avg(y).alias("tm"), F.var_pop(y).alias("tv"))
    t = test.join(F.broadcast(a))
    e = F.sum(F.pow(F.col(y) - F.col(p), 2))
    return t.agg(
        (1 - e / F.sum(F.pow(F.col(y) - F.col("tm"), 2))).alias("q2_f1"), (1 - e / (F.var_pop(y) * F.count(y))).alias("q2_f2"), (1 - e / F.count(y) / F.max("tv")).alias("q2_f3")
    )


def adjusted_r2(r2: Column, n: Column, p: int) -> Column:
    return 1 - (1 - r2) * (n - 1) / (n - p - 1)


def lack_of_fit(sse: Column, n: Column, p: int) -> Column:
    return (sse / n) / F.pow(1 - (p + 1) / n, 2)


def classification_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """Accuracy, balanced accuracy, Matthews' coefficient, Cohen's kappa, precision, recall and F1 of a binary truth and prediction (1 is positive)."""
    c = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).agg(
        *[F.count_if((F.col(y) == a) & (F.col(p) == b)).cast("double").alias(n) for n, a, b in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0))]
    )
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    acc = (tp + tn) / n
    return c.select(
        acc.alias("accuracy"), ((F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2).alias("balanced_accuracy"), F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
        F.try_divide(acc - chance, 1 - chance).alias("kappa"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the ROC curve by ranks of distinct scores; ties count half."""
    c = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"))
    c = c.repartitionByRange("s").withColumn("part", F.spark_partition_id())
    below = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = c.withColumn("below", below).groupBy("part").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    u = parts.withColumn("u", F.col("u") + F.col("p") * before)
    return u.agg((F.sum("u") / (F.sum("p") * F.sum("n"))).alias("auc"))


def leverages(df: DataFrame, id_col: str, features_col: str, intercept: bool = False, fitted_on: DataFrame | None = None) -> DataFrame:
    """(id, leverage): diagonal of X (X'X)^+ X', between 0 and 1. The Gram matrix is summed by partition; its size is that of the features.

    With `intercept` a column of ones comes first and values aren't clipped. The matrix is that of `fitted_on` or df, so new
    rows may be judged by a model's training rows.
    """
    import numpy as np
    import pandas as pd

    def gram(batches):  # noqa: ANN001, ANN202
        g = None
        for b in batches:
            x = np.array(b["x"].tolist(), float)
            g = x.T @ x if g is None else g + x.T @ x
        if g is not None:
            yield pd.DataFrame({"i": np.repeat(np.arange(len(g)), len(g)), "j": np.tile(np.arange(len(g)), len(g)), "v": g.ravel()})

    def taken(t: DataFrame) -> DataFrame:
        x = F.col(features_col).cast("array<double>")
        return t.where(x.isNotNull()).select(F.col(id_col).alias("id"), (F.concat(F.array(F.lit(1.0)), x) if intercept else x).alias("x"))

    x = taken(df)
    cells = taken(df if fitted_on is None else fitted_on).mapInPandas(gram, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    k = max((c.i for c in cells), default=-1) + 1
    m = np.zeros((k, k))
    for c in cells:
        m[c.i, c.j] = c.v
    inv = np.linalg.pinv(m) if k else m

    def diag(batches):  # noqa: ANN001, ANN202
        for b in batches:
            v = np.array(b["x"].tolist(), float)
            yield pd.DataFrame({"id": b["id"], "leverage": np.einsum("ij,jk,ik->i", v, inv, v) if intercept else np.clip(np.einsum("ij,jk,ik->i", v, inv, v), 0, 1)})

    return x.mapInPandas(diag, f"id {dict(df.dtypes)[id_col]}, leverage double").withColumnRenamed("id", id_col)


def standardised_residuals(df: DataFrame, y: str, p: str) -> DataFrame:
    """df with `residual` and `std_residual`, the residual over the sample deviation of all residuals; one aggregation."""
    e = F.col(y) - F.col(p)
    sd = df.agg(F.stddev_samp(e)).first()[0]
    return df.withColumn("residual", e).withColumn("std_residual", e / F.lit(sd) if sd else F.lit(None).cast("double"))


def applicability_domain(df: DataFrame, id_col: str, features_col: str, y: str, p: str, train: Column) -> DataFrame:
    """(id, leverage, std_residual, inside): leverage by the training rows with intercept, below 3 (k + 1) / n, and a residual within three deviations of the training rows'."""
    t = df.where(train)
    n = t.count()
    k = t.select(F.size(features_col)).first()
    limit = 3 * ((k[0] if k else 0) + 1) / max(1, n)
    sd = t.agg(F.stddev_samp(F.col(y) - F.col(p))).first()[0]
    h = leverages(df, id_col, features_col, True, t)
    r = df.select(id_col, ((F.col(y) - F.col(p)) / F.lit(sd) if sd else F.lit(None).cast("double")).alias("std_residual"))
    return h.join(r, id_col).withColumn("inside", (F.col("leverage") <= limit) & (F.abs("std_residual") <= 3))


def external_criteria(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row of an external set: r2, k and k_prime (slopes of the predicted on the true values and the other way round, with intercept), r2_zero_diff, and the criteria with `passed` for all.

    The criteria: r2 above 0.5, the difference of the two determinations through the origin below 0.3, both slopes from 0.85 to 1.15.
    """
    e2 = F.sum(F.pow(F.col(y) - F.col(p), 2))
    m = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).agg(
        (1 - F.try_divide(e2, F.var_pop(y) * F.count(y))).alias("r2"), F.regr_slope(p, y).alias("k"), F.regr_slope(y, p).alias("k_prime"),
        F.abs((1 - F.try_divide(e2, F.sum(F.pow(y, 2)))) - (1 - F.try_divide(e2, F.sum(F.pow(p, 2))))).alias("r2_zero_diff"),
    )
    tests = {"r2_ok": F.col("r2") > 0.5, "zero_ok": F.col("r2_zero_diff") < 0.3, "k_ok": F.col("k").between(0.85, 1.15), "k_prime_ok": F.col("k_prime").between(0.85, 1.15)}
    m = m.select("*", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in tests.items()])
    return m.withColumn("passed", F.col("r2_ok") & F.col("zero_ok") & F.col("k_ok") & F.col("k_prime_ok"))


def class_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """Accuracy, balanced accuracy, Matthews' coefficient, kappa, macro precision, recall and F1, and weighted F1, over any number of classes.

    From the confusion counts; a class that is never predicted has precision 0. Rows with a null are left out.
    """
    c = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(F.col(y).cast("string").alias("y"), F.col(p).cast("string").alias("p")).agg(F.count("*").cast("double").alias("c"))
    t, q = c.groupBy(F.col("y").alias("k")).agg(F.sum("c").alias("t")), c.groupBy(F.col("p").alias("k")).agg(F.sum("c").alias("q"))
    hit = c.where("y = p").select(F.col("y").alias("k"), F.col("c").alias("hit"))
    k = t.join(q, "k", "full").join(hit, "k", "left").na.fill(0.0)
    precision, recall = F.coalesce(F.try_divide("hit", "q"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "t"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("t") + F.col("q")), F.lit(0.0))
    s = k.agg(
        F.sum("t").alias("n"), F.sum("hit").alias("h"), F.sum(F.col("t") * F.col("q")).alias("tq"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("q") * F.col("q")).alias("qq"), F.avg(precision).alias("precision_macro"), F.avg(recall).alias("recall_macro"), F.avg(f1).alias("f1_macro"),
        (F.sum(f1 * F.col("t")) / F.sum("t")).alias("f1_weighted"), F.avg(F.when(F.col("t") > 0, recall)).alias("balanced_accuracy"),
    )
    n, h, chance = F.col("n"), F.col("h"), F.col("tq") / (F.col("n") * F.col("n"))
    mcc = F.coalesce(F.try_divide(h * n - F.col("tq"), F.sqrt((n * n - F.col("qq")) * (n * n - F.col("tt")))), F.lit(0.0))
    return s.select((h / n).alias("accuracy"), "balanced_accuracy", mcc.alias("mcc"), F.try_divide(h / n - chance, 1 - chance).alias("kappa"), "precision_macro", "recall_macro", "f1_macro", "f1_weighted")


def average_precision(df: DataFrame, y: str, score: str) -> DataFrame:
    """(pr_auc): sum over falling distinct scores of the gain in recall times the precision there; running counts within ranges of scores are offset by the ranges above."""
    c = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count("*").alias("n"))
    c = c.repartitionByRange(F.desc("s")).withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("part").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    c = c.select("part", "p", F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("all"))
    parts = c.groupBy("part").agg(F.sum("p").alias("ps"), F.max("all").alias("ns"))
    up = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = parts.select("part", F.coalesce(F.sum("ps").over(up), F.lit(0)).alias("p0"), F.coalesce(F.sum("ns").over(up), F.lit(0)).alias("n0"))
    c = c.join(F.broadcast(parts), "part")
    return c.agg((F.sum(F.col("p") * (F.col("tp") + F.col("p0")) / (F.col("all") + F.col("n0"))) / F.sum("p")).alias("pr_auc"))


def class_counts(df: DataFrame, y: str) -> DataFrame:
    """(classes, least, most): the number of classes and of the rows of the smallest and largest."""
    return df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count("*").alias("n")).agg(F.count("*").alias("classes"), F.coalesce(F.min("n"), F.lit(0)).alias("least"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))


def check_classes(df: DataFrame, y: str, mode: str) -> int:
    """The number of classes; ValueError where it isn't 2 for Binary, 3 for Ternary or at least 3 for Multiclass."""
    n = df.where(F.col(y).isNotNull()).select(y).distinct().limit(4).count()
    if (mode == "Binary" and n != 2) or (mode == "Ternary" and n != 3) or (mode == "Multiclass" and n < 3):
        raise ValueError(f"{n} classes for {mode}")
    return n


def class_scores(raw: Column, classes: int) -> Column:
    """Scores between 0 and 1 from decision values: for two classes the logistic of the one value and its rest, else the softmax of an array."""
    if classes == 2:
        pos = 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), raw))))
        return F.array(1 - pos, pos)
    e = F.transform(raw, lambda v: F.exp(F.greatest(F.lit(-50.0), v - F.array_max(raw))))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
