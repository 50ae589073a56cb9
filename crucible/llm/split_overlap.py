"""Problem 1: records of evaluation splits that also stand in the training split, exactly or almost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crucible.functions.molecule_key import molecule_key
from crucible.operators.text import blank_to_null
from crucible.runtime import written


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and size of the i-th of `parts` even segments of a string of that length; the later ones are longer."""
    base, rest = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    return F.lit(i) * base + F.greatest(F.lit(0), F.lit(i - parts) + rest), base + (F.lit(i) >= F.lit(parts) - rest).cast("int")


def _slot(length: Column, i: int, piece: Column) -> Column:
    return F.xxhash64(length.cast("int"), F.lit(i), piece)


def evaluation_slots(text: str, k: int) -> Column:
    """The hashed k+1 segments of an evaluation string; k edits leave at least one of them whole."""
    n = F.length(text)
    out = []
    for i in range(k + 1):
        start, size = _segment(n, i, k + 1)
        out.append(_slot(n, i, F.substring(F.col(text), start + 1, size)))
    return F.array(*out)


def training_slots(text: str, k: int) -> Column:
    """The hashed substrings of a training string that can equal a segment of an evaluation string within k edits.

    For an evaluation string shorter by `d`, segment i starting at p can be met only where at most i edits lie before it and
    k - i after it: from max(p - i, p + d - (k - i)) to min(p + i, p + d + (k - i)).
    """
    n = F.length(text)
    out = []
    for d in range(-k, k + 1):
        length = n - d
        for i in range(k + 1):
            start, size = _segment(length, i, k + 1)
            for shift in range(max(-i, d - (k - i)), min(i, d + (k - i)) + 1):
                at = start + shift
                fits = (length >= 0) & (at >= 0) & (at + size <= n)
                out.append(F.when(fits, _slot(length, i, F.substring(F.col(text), at + 1, size))))
    return F.array_distinct(F.array_compact(F.array(*out)))


def close_texts(evaluation: DataFrame, training: DataFrame, k: int = 2) -> DataFrame:
    """(e, t): ids of all evaluation and training texts at an edit distance of at most k.

    Both tables hold (tid, text) with distinct texts. Only hashes and ids are shuffled for the candidates; texts join the
    distinct candidates, and Spark's banded Levenshtein (threshold k) decides.
    """
    e = evaluation.select(F.col("tid").alias("e"), F.explode(evaluation_slots("text", k)).alias("slot"))
    t = training.select(F.col("tid").alias("t"), F.explode(training_slots("text", k)).alias("slot"))
    pairs = e.join(t, "slot").select("e", "t").distinct()
    return (
        pairs.join(evaluation.select(F.col("tid").alias("e"), F.col("text").alias("x")), "e")
        .join(training.select(F.col("tid").alias("t"), F.col("text").alias("y")), "t")
        .where(F.levenshtein("x", "y", k) >= 0)
        .select("e", "t")
    )


def split_overlaps(
    rows: DataFrame, id_col: str = "record_id", text_col: str = "smiles", split_col: str = "split", train: tuple = ("train",), evaluation: tuple = ("valid", "test"), k: int = 2, carry: tuple = ()
) -> DataFrame:
    """All (train_id, eval_id) pairs of a training and an evaluation record that denote one molecule or differ by at most k edits.

    Splits are compared without case and outer white space, texts without outer white space. Rows with a null or blank text,
    or with another or no split, are in no pair. A text that can't be read as a molecule is compared by its characters only.
    Records that repeat a text are compared once and expanded at the end; every pair comes out once. `carry` names further
    columns, returned with the prefixes train_ and eval_. Columns that the table has besides are ignored.
    """
    side = F.lower(blank_to_null(split_col))
    r = rows.select(
        F.col(id_col).alias("id"), blank_to_null(text_col).alias("text"), side.isin(*evaluation).alias("ev"), *[F.col(c).alias(f"c_{c}") for c in carry]
    ).where(F.col("text").isNotNull() & side.isin(*train, *evaluation))
    texts = r.groupBy("text").agg(F.max((~F.col("ev")).cast("int")).alias("tr"), F.max(F.col("ev").cast("int")).alias("ev"))
    texts = written(texts.withColumn("tid", F.monotonically_increasing_id()).withColumn("key", molecule_key("text")))
    near = close_texts(texts.where("ev = 1"), texts.where("tr = 1"), k)
    keyed = r.join(texts.select("text", "tid", "key"), "text").drop("text")
    extra = [f"c_{c}" for c in carry]
    keyed = written(keyed.select("id", "ev", "tid", "key", *extra))

    def named(df: DataFrame, p: str, x: str) -> DataFrame:
        return df.select(F.col("id").alias(f"{p}_id"), F.col("tid").alias(x), F.col("key").alias(f"{x}_key"), *[F.col(f"c_{c}").alias(f"{p}_{c}") for c in carry])

    tr, ev = named(keyed.where("not ev"), "train", "t"), named(keyed.where("ev"), "eval", "e")
    out = ["train_id", "eval_id", *[f"{p}_{c}" for p in ("train", "eval") for c in carry]]
    same = tr.join(ev, F.col("t_key") == F.col("e_key")).select(*out, F.lit("molecule").alias("reason"))
    edit = near.join(ev, "e").join(tr, "t").where(F.coalesce(F.col("t_key") != F.col("e_key"), F.lit(True))).select(*out, F.lit("edit").alias("reason"))
    return same.union(edit)


def overlap_report(rows: DataFrame, id_col: str = "record_id", text_col: str = "smiles", split_col: str = "split", source_col: str = "source", **kw) -> DataFrame:
    """Per evaluation split and source: records, records that overlap with training, and pairs.

    A null source is its own group. Records without a usable text count as records that don't overlap.
    """
    pairs = split_overlaps(rows, id_col, text_col, split_col, **kw)
    hits = pairs.groupBy(F.col("eval_id").alias(id_col)).agg(F.count("*").alias("pairs"))
    r = rows.select(id_col, F.lower(blank_to_null(split_col)).alias("split"), F.col(source_col).alias("source")).where(F.col("split").isin(*kw.get("evaluation", ("valid", "test"))))
    return r.join(hits, id_col, "left").groupBy("split", "source").agg(F.count("*").alias("records"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
