"""Connected components of rows that share values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.runtime import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an undirected edge list; the component is its smallest node.

    Alternating large-star and small-star steps; each is one aggregation and one join over edges, and a hub is met by the
    aggregation's partial step and by splitting of skewed joins. Every round is written to the shared folder. Edges with a
    null end and self-loops are left out; an empty table gives an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e, before = cut(e), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every edge now runs from a larger to a smaller node
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        e = cut(small)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def groups_by_shared_values(rows: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """(id, component): rows are in one component when a chain of shared non-null key values joins them.

    Each key value stands for its smallest id, so the graph's nodes are ids and its edges join representatives only. A row
    with no keys is its own component. Ids must be unique and not null.
    """
    r = rows.select(F.col(id_col).alias("id"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    for i in range(len(keys)):
        rep = r.where(F.col(f"k{i}").isNotNull()).groupBy(f"k{i}").agg(F.min("id").alias(f"m{i}"))
        r = r.join(rep, f"k{i}", "left").drop(f"k{i}")
    reps = [F.col(f"m{i}") for i in range(len(keys))]
    r = cut(r.withColumn("home", F.coalesce(*reps, F.col("id"))))
    links = None
    for i in range(len(keys)):
        x = r.where(f"m{i} is not null and m{i} <> home").select(F.col("home").alias("a"), F.col(f"m{i}").alias("b")).distinct()
        links = x if links is None else links.union(x)
    cc = connected_components(links)
    return r.join(cc.withColumnRenamed("node", "home"), "home", "left").select("id", F.coalesce("component", "home").alias("component"))
