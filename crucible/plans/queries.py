"""Queries over the given tables and the SQL they are checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crucible.operators import units
from crucible.plans import graph_queries, molecule_queries, more_queries, table_queries
from crucible.plans.molecule_queries import mol_basic  # noqa: F401
from crucible.runtime import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return units.same_quantity_pairs(units.to_common_unit(table(spark, d, "activities"), table(spark, d, "assays")))


def p2_converted(spark: SparkSession, d: str) -> DataFrame:
    c = units.to_common_unit(table(spark, d, "activities"), table(spark, d, "assays"))
    return c.select("activity_id", "unit", "said_by", F.round(F.log10("value_nm"), 6).alias("log_nm"))


def p2_conversions(spark: SparkSession, d: str) -> DataFrame:
    return units.conversion_table(units.stated_quantities(table(spark, d, "activities"), table(spark, d, "assays")))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_converted, p2_conversions)} | molecule_queries.queries() | graph_queries.queries() | more_queries.queries() | table_queries.queries()


#: Columns whose SQL type is narrower or another than the query's, by query.
TYPES = {
    "mol_basic": {"weight": "DOUBLE", "heavy": "BIGINT", "hydrogens": "BIGINT"}, "descriptors_chain": dict.fromkeys(("zagreb1", "platt", "weight", "walks2"), "DOUBLE"), "descriptors_ring": dict.fromkeys(("zagreb1", "rings", "cyclomatic", "radius"), "DOUBLE"),
    "descriptors_alcohol": dict.fromkeys(("oxygens", "hydroxyls", "acceptors", "hydrogens", "weight", "ethers", "hetero"), "DOUBLE"), "wiener_by_edges": {"wiener": "BIGINT", "polarity": "BIGINT"}, "zagreb_by_degrees": {"zagreb1": "BIGINT"},
    "atom_table": {"n": "BIGINT", "hydrogens": "BIGINT"}, "bond_table": {"n": "BIGINT", "in_ring": "BIGINT", "single": "BIGINT"}, "sele_and_or_not": {"n": "BIGINT"}, "sele_bonded": {"n": "BIGINT"}, "sele_within_bonds": {"n": "BIGINT"}, "sele_ring": {"n": "BIGINT"},
    "sum_prop": {"total": "DOUBLE"}, "sql_functions": {"weight": "DOUBLE"}, "udtf_substructure": {"n": "BIGINT"}, "structure_synonyms": {"k": "INTEGER"}, "embedding_knn": {"rank": "INTEGER"}, "cosine_knn": {"rank": "INTEGER"}, "cityblock_knn": {"rank": "INTEGER"}, "bit_frequencies": {"bit": "INTEGER"},
}


def oracle_sql() -> dict[str, str]:
    sql = {k: v for k, v in units.oracle_sql().items() if k != "values"} | molecule_queries.oracle_sql() | graph_queries.oracle_sql() | more_queries.oracle_sql() | table_queries.oracle_sql()
    sql["group_packing"] = sql["packed_brands"]
    for name, types in (TYPES | graph_queries.TYPES | more_queries.TYPES).items():
        sql[name] = f"SELECT * REPLACE ({', '.join(f'CAST("{c}" AS {t}) AS "{c}"' for c, t in types.items())}) FROM ({sql[name]})"
    return sql
