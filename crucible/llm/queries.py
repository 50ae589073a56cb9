"""Queries over the given tables for the operators of this package, and the SQL they are checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crucible.llm import garbled, grouped_split, packing, similar_sets, split_overlap, term_counts, tokens
from crucible.runtime import table

TERM_SQL = r"\[[^\]]*\]|Br|Cl|%[0-9][0-9]|\S"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = split_overlap.split_overlaps(table(spark, d, "compounds"))
    return pairs.select(F.least("train_id", "eval_id").alias("record_id_a"), F.greatest("train_id", "eval_id").alias("record_id_b"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlap_report(table(spark, d, "compounds"))


def _readable(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "molecules").where("smiles is not null and error is null")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.term_frequencies(_readable(spark, d), "smiles").where("mark is not null").select("term")


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.term_frequencies(_readable(spark, d), "smiles")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return grouped_split.leaking_records(table(spark, d, "compounds"))


def p4_split(spark: SparkSession, d: str) -> DataFrame:
    return grouped_split.grouped_split(table(spark, d, "compounds"), "record_id")


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """What a split must keep: every record placed once, no group in two splits, shares within a hundredth."""
    r = grouped_split.grouped_split(table(spark, d, "compounds"), "record_id")
    g = r.groupBy("component").agg(F.count("*").alias("n"), F.min("new_split").alias("lo"), F.max("new_split").alias("hi"))
    near = F.lit(True)
    for name, share in zip(grouped_split.SPLITS, (0.8, 0.1, 0.1), strict=True):
        near = near & (F.abs(F.sum(F.when(F.col("lo") == name, F.col("n")).otherwise(0)) / F.sum("n") - share) <= 0.01)
    return g.agg(F.sum("n").alias("records"), F.count_if(F.col("lo") != F.col("hi")).alias("torn"), near.alias("near"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    records = _readable(spark, d).select(F.col("mol_id").alias("id"), "smiles").union(table(spark, d, "structures").select("id", "smiles"))
    return similar_sets.similar_records(records, "id", "smiles").select("id_a", "id_b")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """What containers must keep: every text with a character in some, none too full, under a hundredth of the room unused in all but one."""
    c = packing.pack_texts(table(spark, d, "documents"))
    per = c.groupBy("container").agg(F.sum("tokens").alias("t"))
    full = per.agg(F.count_if(F.col("t") > 2048).alias("too_full"), (F.sum("t") >= 0.99 * 2048 * (F.count("*") - 1)).alias("tight"))
    return c.agg(F.count_distinct("doc_id").alias("texts")).crossJoin(F.broadcast(full))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled_texts(table(spark, d, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled_texts(table(spark, d, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_report, p3_found, p3_terms, p4_found, p4_split, p4_shares, p5_found, p6_ids, p7_containers, p7_fill, p8_found, p8_restored)}


def oracle_sql() -> dict[str, str]:
    terms = f"""WITH r AS (SELECT mol_id, smiles FROM molecules WHERE smiles IS NOT NULL AND error IS NULL),
        t AS (SELECT mol_id, unnest(regexp_extract_all(smiles, '{TERM_SQL}')) AS term FROM r),
        c AS (SELECT term, count(*) AS occurrences, count(DISTINCT mol_id) AS records FROM t GROUP BY term),
        m AS (SELECT term, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.8 * (SELECT count(*) FROM r) THEN 'common' END AS mark FROM c)"""
    return {
        "p3_found": f"{terms} SELECT term FROM m WHERE mark IS NOT NULL",
        "p3_terms": f"{terms} SELECT term, occurrences, records, mark FROM m",
        "p4_shares": "SELECT count(*) AS records, 0::BIGINT AS torn, true AS near FROM compounds",
        "p7_fill": "SELECT count(*) AS texts, 0::BIGINT AS too_full, true AS tight FROM documents WHERE length(text) > 0",
        "p5_found": """WITH r AS (SELECT mol_id AS id, trim(smiles, E' \\t\\n\\r\\x0b\\x0c') AS s FROM molecules WHERE smiles IS NOT NULL AND error IS NULL
                UNION ALL SELECT id, trim(smiles, E' \\t\\n\\r\\x0b\\x0c') FROM structures WHERE smiles IS NOT NULL),
            g AS (SELECT DISTINCT id, substr(s, i, 6) AS piece FROM (SELECT id, s, unnest(range(1, length(s) - 4)) AS i FROM r)),
            n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
            c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM g a JOIN g b ON a.piece = b.piece AND a.id < b.id GROUP BY 1, 2)
            SELECT id_a, id_b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c >= 0.7 * (x.n + y.n - c)""",
    }
