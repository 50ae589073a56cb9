"""Queries of the dataset, statistics, similarity and join operators over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crucible.operators import dataset as D
from crucible.operators import joins as J
from crucible.operators import models as Q
from crucible.operators import similarity as S
from crucible.operators import statistics as T
from crucible.operators import structure as G
from crucible.runtime import table
from crucible.streaming import streams

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def cleanse_dedup(spark: SparkSession, d: str) -> DataFrame:
    return D.cleanse(table(spark, d, "compounds"), "smiles", "record_id").select("record_id", "smiles")


def curate_filter_agg(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "activities")
    keep = (F.col("standard_type") == "IC50") & (F.col("standard_units") == "nM") & F.regexp_replace("standard_relation", "'", "").isin("=")
    return D.curate(a, "molecule_ref", "ic50", keep, low=0.001).select("molecule_ref", F.round("value", 6).alias("value"), "n")


def pactivity(spark: SparkSession, d: str) -> DataFrame:
    """-log10 of every activity in mol/L, whatever the unit it is stated in."""
    from crucible.operators import units

    c = units.to_common_unit(table(spark, d, "activities"), table(spark, d, "assays"))
    return c.select("activity_id", F.round(D.p_activity("value_nm"), 5).alias("p"))


def streamed_counts(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream with a watermark of ten minutes: counts of the hours that are over."""
    import os
    import uuid

    from crucible.runtime import shared_dir

    at = os.path.join(shared_dir(spark), f"stream-{uuid.uuid4().hex}")
    e = table(spark, d, "events")
    source = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    counts = streams.tumbling_counts(source.withColumn("ts", F.col("ts").cast("timestamp")))
    q = counts.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out").select("start", "event_type", "n", F.round("total", 4).alias("total"))


def standardised(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "compounds").select("record_id", *[F.nullif(F.col(x), F.lit(-999.0)).alias(x) for x in ("descriptor_1", "descriptor_2", "descriptor_3")])
    r = D.standardise(c, ["descriptor_1", "descriptor_2", "descriptor_3"])
    return r.select("record_id", *[F.round(x, 5).alias(x) for x in r.columns if x != "record_id"])


def group_packing(spark: SparkSession, d: str) -> DataFrame:
    return D.group_packing(table(spark, d, "part"), "p_brand", 0.8).select("p_partkey", "split_status")


def split_stats(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "compounds").withColumn("s", F.lower(F.trim("split")))
    r = D.split_statistics(c, "s", "target")
    return r.select("s", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def random_split(spark: SparkSession, d: str) -> DataFrame:
    return D.random_split(table(spark, d, "compounds"), "record_id", 0.8).select("record_id", "split_status")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


def kennard_stone(spark: SparkSession, d: str) -> DataFrame:
    return D.kennard_stone(_vectors(spark, d), "id", "x", 0.8)


def duplex_split(spark: SparkSession, d: str) -> DataFrame:
    return D.duplex(_vectors(spark, d), "id", "x", 0.8)


def d_optimal_split(spark: SparkSession, d: str) -> DataFrame:
    return D.d_optimal(_vectors(spark, d), "id", "x", 0.8)


def sphere_exclusion_split(spark: SparkSession, d: str) -> DataFrame:
    return D.sphere_exclusion(_vectors(spark, d), "id", "x", 0.8)


def feature_variances(spark: SparkSession, d: str) -> DataFrame:
    return D.variances(table(spark, d, "lineitem"), FEATURES).select("feature", F.round("variance", 5).alias("variance"))


def top_correlations(spark: SparkSession, d: str) -> DataFrame:
    return D.correlations(table(spark, d, "lineitem"), [f for f in FEATURES if f != "l_extendedprice"], "l_extendedprice").select("feature", F.round("r", 5).alias("r")).orderBy(F.desc(F.abs("r")), "feature").limit(2)


def pruned_features(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "compounds").where("descriptor_1 <> -999 and descriptor_2 <> -999 and descriptor_3 <> -999")
    return spark.createDataFrame([(f,) for f in D.prune_features(c, ["descriptor_1", "descriptor_2", "descriptor_3"], "target")], "feature string")


def ks_two_sample(spark: SparkSession, d: str) -> DataFrame:
    return T.kolmogorov_smirnov(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", "N").select("l_returnflag", F.round("ks", 8).alias("ks"))


def kl_histogram(spark: SparkSession, d: str) -> DataFrame:
    return T.kullback_leibler(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "N").select("l_returnflag", F.round("kl", 6).alias("kl"))


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))


def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    r = _predicted(spark, d).groupBy("l_returnflag").agg(*T.regression_metrics("y", "p"))
    return r.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in ("rmse", "mae", "r2", "ccc_samp", "ccc_pop", "q2", "slope")])


def external_q2(spark: SparkSession, d: str) -> DataFrame:
    x = _predicted(spark, d)
    r = T.external_q2(x.where("l_linenumber <= 4"), x.where("l_linenumber > 4"), "y", "p")
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select((F.col("l_returnflag") == "N").cast("int").alias("y"), (F.col("l_linestatus") == "O").cast("int").alias("p"))
    r = T.classification_metrics(x, "y", "p")
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_quantity").alias("s"))
    return T.roc_auc(x, "y", "s").select(F.round("auc", 8).alias("auc"))


def leverage(spark: SparkSession, d: str) -> DataFrame:
    """Leverages sum to the rank of the features."""
    return T.leverages(_vectors(spark, d), "id", "x").agg(F.round(F.sum("leverage"), 4).alias("rank"), F.count("*").alias("n"))


def embedding_knn(spark: SparkSession, d: str) -> DataFrame:
    r = S.nearest(_vectors(spark, d), "id", "x", 5)
    return r.select("query", "id", "rank", F.round("distance", 5).alias("distance"))


def cosine_knn(spark: SparkSession, d: str) -> DataFrame:
    r = S.nearest(_vectors(spark, d), "id", "x", 5, "cosine")
    return r.select("query", "id", "rank", F.round("distance", 5).alias("distance"))


def cityblock_knn(spark: SparkSession, d: str) -> DataFrame:
    r = S.nearest(_vectors(spark, d), "id", "x", 3, "cityblock")
    return r.select("query", "id", "rank", F.round("distance", 4).alias("distance"))


def fuzzy_union(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").where("l_partkey <> l_suppkey").groupBy(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).agg((F.count("*") / 100).alias("w"))
    return S.fuzzy_union(e, 0.7).select("i", "j", F.round("w", 8).alias("w"))


def bit_frequencies(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select(F.filter(F.transform("embedding", lambda v, i: F.when(v > 0, i)), lambda v: v.isNotNull()).alias("bits"))
    return D.bit_statistics(x, "bits").select("bit", "ones", F.round("frequency", 6).alias("frequency"), F.round("variance", 6).alias("variance"))


def range_join_dist(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    r = J.range_join(e, e, 0.05, ["label"], ["x", "y", "z"]).where("vec_id < r_vec_id")
    return r.select("vec_id", "r_vec_id", F.round("dist", 6).alias("dist"))


def interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user within the hour after a purchase of that user."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    p = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("t").alias("start"), (F.col("t") + F.lit(3_600_000_000)).alias("end"))
    return J.interval_join(e, p, "user_id", "t", "start", "end", 3_600_000_000).select("purchase", "event_id")


def pair_by_rank(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    a, b = (li.where(F.col("l_linestatus") == s).select("l_orderkey", "l_linenumber", "l_returnflag") for s in ("O", "F"))
    return J.pair_by_rank(a, b, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "r_l_linenumber")


def event_islands(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("at", F.struct(F.unix_micros(F.col("ts").cast("timestamp")), "event_id"))
    r = J.islands(e, "user_id", "at", "event_type")
    return r.select("user_id", "event_type", F.col("first.event_id").alias("first"), F.col("last.event_id").alias("last"), "length").where("length > 1")


def dihedral_angles(spark: SparkSession, d: str) -> DataFrame:
    """Torsions of the points in the first 12 numbers of each embedding."""
    e = F.col("embedding")
    t = J.dihedral([[e[3 * k + i].cast("double") for i in range(3)] for k in range(4)])
    return table(spark, d, "embeddings").select("vec_id", F.round(F.cos(F.radians(t)), 5).alias("cos"))


def radius_of_gyration(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    m = p.groupBy("label").agg(*[F.avg(c).alias(c) for c in "xyz"], F.avg(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("s"))
    return m.select("label", F.round(F.sqrt(F.col("s") - F.col("x") ** 2 - F.col("y") ** 2 - F.col("z") ** 2), 6).alias("rg"))


def degree_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy in bits of the shipping flags of every supplier."""
    c = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy("l_suppkey"))
    return c.withColumn("p", p).groupBy("l_suppkey").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("h"))


def tumbling_window_count(spark: SparkSession, d: str) -> DataFrame:
    return streams.tumbling_counts(table(spark, d, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


def session_counts(spark: SparkSession, d: str) -> DataFrame:
    return streams.sessions(table(spark, d, "events")).select("user_id", "start", "n")


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])


def dbscan_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Noise by density: fewer than 4 points within 0.08 and no such point near."""
    c = G.dbscan(_points(spark, d), "vec_id", ["x", "y", "z"], 0.08, 4)
    return c.select("vec_id", (F.col("cluster") < 0).alias("noise"))


def umap_edges(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of all rows, fuzzy weights, union of both directions."""
    x = _vectors(spark, d)
    return S.fuzzy_union(G.smooth_knn(S.nearest(x, "id", "x", 15, queries=x), 15))


def qsar_regression(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "compounds").where("descriptor_1 <> -999 and descriptor_2 <> -999 and descriptor_3 <> -999 and target is not null")
    r = Q.regression(c, ["descriptor_1", "descriptor_2", "descriptor_3"], "target", "split")
    return r.select("set", "n", F.round("rmse", 6).alias("rmse"))


def pca_variances(spark: SparkSession, d: str) -> DataFrame:
    """Variances of the two first components over coordinates sum to at most the number of scaled features."""
    r = Q.principal_components(_points(spark, d), ["x", "y", "z"], 2)
    return r.agg(F.round(F.var_samp(F.col("pc")[0]), 5).alias("first"), F.round(F.var_samp(F.col("pc")[1]), 5).alias("second"))


def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    return Q.k_means(_points(spark, d), ["x", "y", "z"], 5).groupBy("cluster").agg(F.count("*").alias("n"))


def shapes_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Shape descriptors of the points of each label, all of one element."""
    p = _points(spark, d).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id").select(F.col("label").cast("long").alias("mol_id"), F.lit("C").alias("symbol"), "x", "y", "z")
    return G.shape_descriptors(p).select("mol_id", F.round("RadiusOfGyration", 6).alias("rg"), F.round("MeanAtomicDistance3D", 6).alias("mean_distance"), F.round("MolecularDiameter", 6).alias("diameter"))


def queries() -> dict:
    own = (
        streamed_counts, dbscan_clusters, umap_edges, qsar_regression, pca_variances, kmeans_clusters, shapes_by_label,
        cleanse_dedup, curate_filter_agg, pactivity, standardised, group_packing, split_stats, random_split, kennard_stone, duplex_split, d_optimal_split, sphere_exclusion_split, feature_variances, top_correlations, pruned_features, ks_two_sample, kl_histogram,
        regression_metrics, external_q2, class_metrics, roc_auc, leverage, embedding_knn, cosine_knn, cityblock_knn, fuzzy_union, bit_frequencies, range_join_dist, interval_join, pair_by_rank, event_islands, dihedral_angles, radius_of_gyration, degree_entropy,
        tumbling_window_count, session_counts,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from crucible.operators import units

    units_sql = units.oracle_sql()["values"]
    trim = "trim(smiles, E' \\t\\n\\r\\x0b\\x0c')"
    reg = "SELECT l_returnflag, l_linenumber, l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem"
    knn = "SELECT a.vec_id AS query, b.vec_id AS id, {d} AS dd, row_number() OVER (PARTITION BY a.vec_id ORDER BY {d}, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id"
    z = ", ".join(f"round((coalesce({c}, m{i}) - m{i}) / s{i}, 5) AS {c}" for i, c in enumerate(("descriptor_1", "descriptor_2", "descriptor_3")))
    c0 = "SELECT record_id, " + ", ".join(f"nullif({c}, -999.0) AS {c}" for c in ("descriptor_1", "descriptor_2", "descriptor_3")) + " FROM compounds"
    mom = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) * sqrt(count({c}) * 1.0 / count(*)) AS s{i}" for i, c in enumerate(("descriptor_1", "descriptor_2", "descriptor_3")))
    return {
        "dbscan_clusters": """WITH e AS (SELECT vec_id, embedding[1]::double AS x, embedding[2]::double AS y, embedding[3]::double AS z FROM embeddings),
            n AS (SELECT a.vec_id AS i, b.vec_id AS j FROM e a JOIN e b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 0.08::double * 0.08::double), c AS (SELECT i FROM n GROUP BY i HAVING count(*) >= 4)
            SELECT vec_id, vec_id NOT IN (SELECT i FROM n WHERE j IN (SELECT i FROM c)) AS noise FROM e""",
        "shapes_by_label": """WITH e AS (SELECT vec_id, label::bigint AS mol_id, embedding[1]::double AS x, embedding[2]::double AS y, embedding[3]::double AS z FROM embeddings),
            g AS (SELECT mol_id, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS rg FROM e GROUP BY 1), p AS (SELECT a.mol_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS dd FROM e a JOIN e b ON a.mol_id = b.mol_id AND a.vec_id < b.vec_id)
            SELECT mol_id, round(max(rg), 6) AS rg, round(avg(dd), 6) AS mean_distance, round(max(dd), 6) AS diameter FROM p JOIN g USING (mol_id) GROUP BY 1""",
        "cleanse_dedup": f"SELECT record_id, smiles FROM (SELECT record_id, {trim} AS smiles, row_number() OVER (PARTITION BY {trim} ORDER BY record_id) AS k FROM compounds WHERE smiles IS NOT NULL AND {trim} <> '') WHERE k = 1",
        "curate_filter_agg": "SELECT molecule_ref, round(median(ic50), 6) AS value, count(*) AS n FROM activities WHERE ic50 IS NOT NULL AND molecule_ref IS NOT NULL AND standard_type = 'IC50' AND standard_units = 'nM' AND replace(standard_relation, '''', '') = '=' AND ic50 >= 0.001 GROUP BY molecule_ref",
        "pactivity": f"SELECT activity_id, CASE WHEN value_nm > 0 THEN round(-log10(value_nm * 1e-9), 5) END AS p FROM ({units_sql})",
        "streamed_counts": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
        "leverage": "SELECT 64.0::DOUBLE AS rank, count(*) AS n FROM embeddings",
        "dihedral_angles": f"""WITH e AS (SELECT vec_id, {', '.join(f'embedding[{3 * k + i + 1}]::DOUBLE AS p{k}{c}' for k in range(4) for i, c in enumerate('xyz'))} FROM embeddings),
            b AS (SELECT vec_id, {', '.join(f'p{k + 1}{c} - p{k}{c} AS b{k}{c}' for k in range(3) for c in 'xyz')} FROM e), n AS (SELECT vec_id, b1x, b1y, b1z, {', '.join(f'b{k}{u} * b{k + 1}{v} - b{k}{v} * b{k + 1}{u} AS n{k}{w}' for k in range(2) for u, v, w in ('yzx', 'zxy', 'xyz'))} FROM b)
            SELECT vec_id, round((n0x * n1x + n0y * n1y + n0z * n1z) / sqrt((n0x ** 2 + n0y ** 2 + n0z ** 2) * (n1x ** 2 + n1y ** 2 + n1z ** 2)), 5) AS cos FROM n""",
        "standardised": f"WITH c AS ({c0}), m AS (SELECT {mom} FROM c) SELECT record_id, {z} FROM c, m",
        "split_stats": "SELECT lower(trim(split)) AS s, count(*) AS n, round(avg(target), 6) AS mean, round(stddev_pop(target), 6) AS std FROM compounds GROUP BY 1",
        "feature_variances": "SELECT unnest([" + ", ".join(f"{{'feature': '{f}', 'variance': round(v{i}, 5)}}" for i, f in enumerate(FEATURES)) + "], recursive := true) FROM (SELECT " + ", ".join(f"var_samp({f}) AS v{i}" for i, f in enumerate(FEATURES)) + " FROM lineitem)",
        "top_correlations": "SELECT feature, round(r, 5) AS r FROM (SELECT 'l_quantity' AS feature, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'l_discount', corr(l_discount, l_extendedprice) FROM lineitem UNION ALL SELECT 'l_tax', corr(l_tax, l_extendedprice) FROM lineitem) ORDER BY abs(r) DESC, feature LIMIT 2",
        "ks_two_sample": """WITH t AS (SELECT l_returnflag AS g, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT g, n FROM t WHERE g <> 'N'),
            s AS (SELECT o.g, l_extendedprice AS v, sum(CASE WHEN l_returnflag = 'N' THEN 1.0 / (SELECT n FROM t WHERE g = 'N') ELSE -1.0 / o.n END) AS step FROM lineitem JOIN o ON l_returnflag IN ('N', o.g) GROUP BY 1, 2),
            c AS (SELECT g, sum(step) OVER (PARTITION BY g ORDER BY v) AS f FROM s) SELECT g AS l_returnflag, round(max(abs(f)), 8) AS ks FROM c GROUP BY 1""",
        "kl_histogram": """WITH s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), h AS (SELECT l_returnflag AS g, least(48, floor((l_quantity - lo) / (hi - lo) * 49))::int AS b, count(*) AS c FROM lineitem, s GROUP BY 1, 2),
            n AS (SELECT g, sum(c) AS n FROM h GROUP BY 1), p AS (SELECT n.g, r.b, coalesce(c, 0) / n / ((SELECT hi - lo FROM s) / 49) + 1e-10 AS p FROM n CROSS JOIN (SELECT unnest(range(49)) AS b) r LEFT JOIN h ON h.g = n.g AND h.b = r.b),
            q AS (SELECT g, b, p / sum(p) OVER (PARTITION BY g) AS p FROM p) SELECT a.g AS l_returnflag, round(sum(r.p * ln(r.p / a.p)), 6) AS kl FROM q a JOIN q r ON r.g = 'N' AND a.b = r.b WHERE a.g <> 'N' GROUP BY 1""",
        "regression_metrics": f"""SELECT l_returnflag, count(*) AS n, round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(corr(y, p) ** 2, 4) AS r2, round(2 * covar_samp(y, p) / (var_samp(y) + var_samp(p) + (avg(y) - avg(p)) ** 2), 4) AS ccc_samp,
            round(2 * covar_pop(y, p) / (var_pop(y) + var_pop(p) + (avg(y) - avg(p)) ** 2), 4) AS ccc_pop, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 4) AS q2, round(regr_slope(y, p), 4) AS slope FROM ({reg}) GROUP BY 1""",
        "external_q2": f"""WITH x AS ({reg}), a AS (SELECT avg(y) AS tm, var_pop(y) AS tv FROM x WHERE l_linenumber <= 4) SELECT round(1 - sum((y - p) ** 2) / sum((y - tm) ** 2), 6) AS q2_f1, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS q2_f2,
            round(1 - sum((y - p) ** 2) / count(*) / max(tv), 6) AS q2_f3 FROM x, a WHERE l_linenumber > 4""",
        "class_metrics": """WITH c AS (SELECT count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'O')::double AS tp, count(*) FILTER (l_returnflag <> 'N' AND l_linestatus <> 'O')::double AS tn, count(*) FILTER (l_returnflag <> 'N' AND l_linestatus = 'O')::double AS fp,
            count(*) FILTER (l_returnflag = 'N' AND l_linestatus <> 'O')::double AS fn FROM lineitem), k AS (SELECT *, tp + tn + fp + fn AS n, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (tp + tn + fp + fn) ** 2 AS e FROM c)
            SELECT round((tp + tn) / n, 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(((tp + tn) / n - e) / (1 - e), 6) AS kappa,
            round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM k""",
        "roc_auc": """WITH c AS (SELECT l_quantity AS s, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY 1),
            w AS (SELECT *, sum(n) OVER (ORDER BY s) - n AS below FROM c) SELECT round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 8) AS auc FROM w""",
        "embedding_knn": f"SELECT query, id, rank, round(dd, 5) AS distance FROM ({knn.format(d='list_distance(a.embedding::double[], b.embedding::double[])')}) WHERE rank <= 5",
        "cosine_knn": f"SELECT query, id, rank, round(dd, 5) AS distance FROM ({knn.format(d='list_cosine_distance(a.embedding::double[], b.embedding::double[])')}) WHERE rank <= 5",
        "cityblock_knn": f"SELECT query, id, rank, round(dd, 4) AS distance FROM ({knn.format(d='list_sum(list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda t: abs(t[1] - t[2])))')}) WHERE rank <= 3",
        "fuzzy_union": """WITH e AS (SELECT l_partkey AS i, l_suppkey AS j, count(*) / 100.0 AS w FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2), f AS (SELECT coalesce(a.i, b.j) AS i, coalesce(a.j, b.i) AS j, coalesce(a.w, 0) AS a, coalesce(b.w, 0) AS b
            FROM e a FULL JOIN e b ON a.i = b.j AND a.j = b.i) SELECT i, j, round(0.7 * (a + b - a * b) + 0.3 * a * b, 8) AS w FROM f""",
        "bit_frequencies": """WITH b AS (SELECT unnest(list_filter(list_transform(embedding, lambda v, i: CASE WHEN v > 0 THEN i - 1 END), lambda x: x IS NOT NULL)) AS bit FROM embeddings), n AS (SELECT count(*) AS n FROM embeddings)
            SELECT bit, count(*) AS ones, round(count(*) * 1.0 / max(n), 6) AS frequency, round(count(*) * 1.0 / max(n) * (1 - count(*) * 1.0 / max(n)), 6) AS variance FROM b, n GROUP BY bit""",
        "range_join_dist": """WITH e AS (SELECT vec_id, label, embedding[1]::double AS x, embedding[2]::double AS y, embedding[3]::double AS z FROM embeddings)
            SELECT a.vec_id, b.vec_id AS r_vec_id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) AS dist FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 0.0025""",
        "interval_join": "SELECT p.event_id AS purchase, e.event_id FROM events p JOIN events e ON p.user_id = e.user_id AND p.event_type = 'purchase' AND e.ts BETWEEN p.ts AND p.ts + INTERVAL 1 HOUR",
        "pair_by_rank": """WITH r AS (SELECT l_orderkey, l_linenumber, l_linestatus, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber) AS k FROM lineitem)
            SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS r_l_linenumber FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.k = b.k AND a.l_linestatus = 'O' AND b.l_linestatus = 'F'""",
        "event_islands": """WITH n AS (SELECT *, coalesce(lag(event_type) OVER w <> event_type, true)::int AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM n)
            SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first, arg_max(event_id, (ts, event_id)) AS last, count(*) AS length FROM r GROUP BY user_id, run, event_type HAVING count(*) > 1""",
        "radius_of_gyration": "SELECT label, round(sqrt(avg(embedding[1]::double ** 2 + embedding[2]::double ** 2 + embedding[3]::double ** 2) - avg(embedding[1]::double) ** 2 - avg(embedding[2]::double) ** 2 - avg(embedding[3]::double) ** 2), 6) AS rg FROM embeddings GROUP BY label",
        "degree_entropy": "WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS c FROM lineitem GROUP BY 1, 2), p AS (SELECT l_suppkey, c / sum(c) OVER (PARTITION BY l_suppkey) AS p FROM c) SELECT l_suppkey, round(-sum(p * log2(p)), 6) AS h FROM p GROUP BY 1",
        "tumbling_window_count": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
        "session_counts": """WITH s AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTE, true)::int AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
            SELECT user_id, min(ts) AS start, count(*) AS n FROM r GROUP BY user_id, k""",
    }
