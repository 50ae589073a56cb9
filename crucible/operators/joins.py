"""Range and interval joins on grid cells, and rank joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, radius: float, on: list[str], coords: list[str], how: str = "inner") -> DataFrame:
    """Rows of equal `on` columns whose coordinates lie within the radius (distance <= radius), with dist.

    The left row goes to the 3^k neighbour cells of a grid with the radius as width, so the join is on equal cells; columns of
    the right side get the prefix r_. Rows with a null coordinate match nothing. how is inner or left_semi.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], *[cell(c).alias(f"_c{i}") for i, c in enumerate(coords)])
    l = left
    for i, c in enumerate(coords):
        l = l.withColumn(f"_c{i}", F.explode(F.array(*[cell(c) + d for d in (-1, 0, 1)])))
    cells = [f"_c{i}" for i in range(len(coords))]
    d2 = reduce(lambda a, b: a + b, [F.pow(F.col(c) - F.col(f"r_{c}"), 2) for c in coords])
    cond = [l[c] == r[c] for c in cells] + [l[c] == r[f"r_{c}"] for c in on] + [d2 <= radius * radius]
    if how == "left_semi":
        return l.join(r, reduce(lambda a, b: a & b, cond), "left_semi").drop(*cells).distinct()
    j = l.join(r, reduce(lambda a, b: a & b, cond))
    return j.withColumn("dist", F.sqrt(d2)).drop(*[l[c] for c in cells], *[r[c] for c in cells])


def interval_join(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, width: float) -> DataFrame:
    """Points with the ranges of equal key that hold them (start <= at <= end); a range is laid into buckets of `width`."""
    p = points.withColumn("_b", F.floor(F.col(at) / width).cast("long"))
    r = ranges.where(F.col(start) <= F.col(end)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long"))))
    return p.join(r, [key, "_b"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_b")


def pair_by_rank(a: DataFrame, b: DataFrame, key: str, order: str, same: str | None = None) -> DataFrame:
    """The k-th rows of both sides within a key, side by side (columns of b get the prefix r_), cut to the shorter; `same` keeps pairs equal in a column."""
    w = Window.partitionBy(key).orderBy(order)
    x = a.withColumn("place", F.row_number().over(w))
    y = b.withColumn("place", F.row_number().over(w)).select(F.col(key), F.col("place"), *[F.col(c).alias(f"r_{c}") for c in b.columns if c != key])
    j = x.join(y, [key, "place"])
    return j.where(F.col(same) == F.col(f"r_{same}")) if same else j


def dihedral(p: list[list[Column]]) -> Column:
    """Signed torsion in degrees of four points given as columns x, y, z."""

    def sub(a, b):  # noqa: ANN001, ANN202
        return [x - y for x, y in zip(a, b, strict=True)]

    def cross(a, b):  # noqa: ANN001, ANN202
        return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]

    def dot(a, b):  # noqa: ANN001, ANN202
        return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]

    b1, b2, b3 = sub(p[1], p[0]), sub(p[2], p[1]), sub(p[3], p[2])
    n1, n2 = cross(b1, b2), cross(b2, b3)
    return F.degrees(F.atan2(dot(cross(n1, n2), b2) / F.sqrt(dot(b2, b2)), dot(n1, n2)))


def islands(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Runs of equal values in order: (key, value, first, last, length)."""
    w = Window.partitionBy(key).orderBy(order)
    new = (F.coalesce(F.lag(value).over(w) != F.col(value), F.lit(True))).cast("int")
    run = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(key, "_run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("_run")
