"""Queries over molecules made from part sizes (closed forms in SQL) and over the molecules table.

A chain of n carbons, a ring of n carbons and an alcohol of n - 1 carbons stand for part.p_size = n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crucible.functions import molecules as M
from crucible.operators.selection import Selector
from crucible.runtime import gathered, spread, table, written


def _made(spark: SparkSession, d: str, kind: str) -> DataFrame:
    n = F.col("p_size")
    smiles = {"chain": F.expr("repeat('C', p_size)"), "ring": F.expr("concat('C1', repeat('C', p_size - 2), 'C1')"), "alcohol": F.expr("concat(repeat('C', p_size - 1), 'O')")}[kind]
    p = table(spark, d, "part").where(n >= (3 if kind == "ring" else 1))
    return spread(p.select(F.col("p_partkey").alias("mol_id"), n.alias("n"), smiles.alias("smiles")))


def mol_basic(spark: SparkSession, d: str) -> DataFrame:
    """Weight, formula and heavy atoms of every part's alkane, from its array of atoms and a literal table of elements; no shuffle."""
    from crucible.chem.elements import MASS

    m = M.molecules(_made(spark, d, "chain"), "mol_id", "smiles")
    mass = F.create_map(*[F.lit(x) for kv in MASS.items() for x in kv])
    weight = F.aggregate("atoms", F.lit(0.0), lambda acc, a: acc + F.coalesce(F.try_element_at(mass, a["symbol"]), F.lit(0.0)) + 1.008 * a["n_h"])
    hydrogens = F.aggregate("atoms", F.lit(0).cast("long"), lambda acc, a: acc + a["n_h"])
    return m.where("error is null").select("mol_id", "formula", F.round(weight, 4).alias("weight"), F.size(F.filter("atoms", lambda a: a["symbol"] != "H")).cast("long").alias("heavy"), hydrogens.alias("hydrogens"))


def _descriptors(kind: str, names: dict[str, str]):  # noqa: ANN202
    def q(spark: SparkSession, d: str) -> DataFrame:
        r = _made(spark, d, kind).select("mol_id", M.descriptors("smiles", list(names)).alias("x"))
        return r.select("mol_id", *[F.round(F.col(f"x.{k}"), 6).alias(v) for k, v in names.items()])

    return q


CHAIN = {"WienerIndex": "wiener", "ZagrebIndex1": "zagreb1", "PlattIndex": "platt", "ConnectivityIndexChi0": "chi0", "HararyIndex": "harary", "KirchhoffIndex": "kirchhoff", "PathCount3": "paths3", "HyperWienerIndex": "hyper", "LongestShortestPath": "diameter", "MolecularWeight": "weight", "PolarityNumber": "polarity", "WalkCount2": "walks2"}
RING = {"WienerIndex": "wiener", "ZagrebIndex1": "zagreb1", "KirchhoffIndex": "kirchhoff", "RingCount": "rings", "CyclomaticNumber": "cyclomatic", "LogSpanningTreeCount": "trees", "SpectralRadius": "radius", "BondCount": "bonds"}
ALCOHOL = {"OxygenCount": "oxygens", "HydroxylGroupCount": "hydroxyls", "LipinskiHBA": "acceptors", "HydrogenCount": "hydrogens", "RotatableBonds": "rotatable", "MolecularWeight": "weight", "EtherCount": "ethers", "HeteroAtomCount": "hetero"}


def wiener_by_edges(spark: SparkSession, d: str) -> DataFrame:
    """The Wiener index from the table of shortest paths."""
    p = M.shortest_paths(_made(spark, d, "chain"), "mol_id", "smiles")
    return p.groupBy("mol_id").agg(F.sum("d").cast("long").alias("wiener"), F.count_if(F.col("d") == 3).alias("polarity"))


def zagreb_by_degrees(spark: SparkSession, d: str) -> DataFrame:
    deg = M.degrees(M.molecules(_made(spark, d, "ring"), "mol_id", "smiles"))
    return deg.groupBy("mol_id").agg(F.sum(F.col("deg") * F.col("deg")).alias("zagreb1"), F.max("deg").alias("most"))


def atom_table(spark: SparkSession, d: str) -> DataFrame:
    a = M.atoms(M.molecules(_made(spark, d, "alcohol"), "mol_id", "smiles"))
    return a.groupBy("mol_id", "symbol").agg(F.count("*").alias("n"), F.sum("n_h").alias("hydrogens"))


def bond_table(spark: SparkSession, d: str) -> DataFrame:
    b = M.bonds(M.molecules(_made(spark, d, "ring"), "mol_id", "smiles"))
    return b.groupBy("mol_id").agg(F.count("*").alias("n"), F.count_if("in_ring").alias("in_ring"), F.count_if(F.col("order_kek") == 1).alias("single"))


def _selector(spark: SparkSession, d: str, kind: str) -> Selector:
    m = written(M.molecules(_made(spark, d, kind), "mol_id", "smiles"))  # atoms, bonds and rings read it
    return Selector(M.atoms(m), M.bonds(m), M.rings(m))


def _plain_selector(spark: SparkSession, d: str, kind: str) -> Selector:
    """For selections without bonded and within: atoms are read once, and whether one is in a ring, of any size, is found in the molecule's row."""
    m = M.molecules(_made(spark, d, kind), "mol_id", "smiles", cyclic=True)
    return Selector(m.select("mol_id", F.inline(F.transform("atoms", lambda a: a.withField("in_ring", F.array_contains("cyclic", a["idx"]))))), M.bonds(m))


def sele_and_or_not(spark: SparkSession, d: str) -> DataFrame:
    return _selector(spark, d, "alcohol").count("(C or O) and not heteroatom")


def sele_bonded(spark: SparkSession, d: str) -> DataFrame:
    return _selector(spark, d, "alcohol").count("bonded O")


def sele_within_bonds(spark: SparkSession, d: str) -> DataFrame:
    return _selector(spark, d, "alcohol").count("C and within 3 bonds of oxygen")


def sele_ring(spark: SparkSession, d: str) -> DataFrame:
    return _plain_selector(spark, d, "ring").count("ring and mass > 12")


def sum_prop(spark: SparkSession, d: str) -> DataFrame:
    return _plain_selector(spark, d, "alcohol").sum_property("mass", "heavy").select("mol_id", F.round("total", 4).alias("total"))


def substructure_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Alcohols that hold the fragment CCO, with the number of atom sets it stands on."""
    r = _made(spark, d, "alcohol").select("mol_id", F.size(M.substructure_matches("smiles", "CCO")).alias("n"))
    return r.where("n > 0")


def substructure_paths(spark: SparkSession, d: str) -> DataFrame:
    r = _made(spark, d, "chain").select("mol_id", F.size(M.substructure_matches("smiles", "CCCC")).alias("n"))
    return r


def scaffold_of_rings(spark: SparkSession, d: str) -> DataFrame:
    """A ring with a tail of two atoms keeps the ring only."""
    r = _made(spark, d, "ring").select("mol_id", "n", M.scaffold(F.concat(F.lit("OC"), "smiles")).alias("s"))
    return r.select("mol_id", F.length(F.regexp_replace("s", "[0-9]", "")).alias("atoms"))


def smiles_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Molecules written again denote the same molecule."""
    from crucible.functions.molecule_key import molecule_key

    m = spread(table(spark, d, "molecules").where("smiles is not null and error is null").select("mol_id", "smiles"))
    r = m.select("mol_id", molecule_key("smiles").alias("a"), molecule_key(M.rewritten("smiles")).alias("b"))
    return r.select("mol_id", (F.col("a").isNotNull() & F.col("a").eqNullSafe(F.col("b"))).alias("same"))


def morgan_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    m = spread(table(spark, d, "molecules").where("error is null and smiles is not null"))
    return m.select("mol_id", M.fingerprint("smiles").alias("bits"))


def descriptor_table(spark: SparkSession, d: str) -> DataFrame:
    """A wide selection of descriptors of the molecules table, as name and value."""
    from crucible.chem.descriptors import names

    wanted = names(("composition", "bonding", "rings", "groups", "degrees"))
    m = spread(table(spark, d, "molecules").where("error is null and smiles is not null"))
    x = M.descriptor_table(m, "mol_id", "smiles", wanted)
    return x.select("mol_id", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.round(n, 6).alias("value")) for n in wanted])))


def all_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """All descriptors of the reference structures."""
    from crucible.chem.descriptors import names

    return M.descriptor_table(spread(table(spark, d, "structures")), "id", "smiles", names())


def all_descriptors_of_molecules(spark: SparkSession, d: str) -> DataFrame:
    """All descriptors that need no coordinates, of the whole molecules table."""
    from crucible.chem.descriptors import FAMILIES, names

    m = gathered(table(spark, d, "molecules").where("error is null and smiles is not null").select("mol_id", "smiles"), "smiles")
    return M.descriptor_table(m, "mol_id", "smiles", names(tuple(f for f in FAMILIES if f != "space")))


def groups_of_molecules(spark: SparkSession, d: str) -> DataFrame:
    """Scaffold, functional groups and graph of every real molecule."""
    from crucible.functions import graphs as H

    m = gathered(table(spark, d, "molecules").where("error is null and smiles is not null").select("mol_id", "smiles"), "smiles", per_core=4)
    r = m.select("mol_id", H.overview("smiles", "C(=O)N").alias("o"))
    return r.select("mol_id", "o.scaffold", "o.groups", F.col("o.matches").alias("amides"), "o.graph")


def molecule_weights(spark: SparkSession, d: str) -> DataFrame:
    """Molecules that can't be read keep a row with null values and the reason."""
    m = M.molecules(spread(table(spark, d, "molecules")), "mol_id", "smiles")
    return m.select("mol_id", F.round("weight", 3).alias("weight"), "formula", F.col("error").alias("parse_error"))


def structure_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """Up to three synonyms of each structure, in order, repeated ones once."""
    from pyspark.sql import Window

    s = table(spark, d, "synonyms").distinct()
    r = s.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("synonym"))).where("k <= 3")
    return table(spark, d, "structures").join(r, "id").select("id", "name", "synonym", "k")


def structure_lookup(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "structures")
    return s.where("inchikey is not null and name like 'a%' or id = 7").join(table(spark, d, "synonyms").distinct(), "id", "left").select("id", "inchikey", "synonym")


def graph_of_chains(spark: SparkSession, d: str) -> DataFrame:
    from crucible.functions.graphs import graph_properties

    return _made(spark, d, "chain").select("mol_id", graph_properties("smiles").alias("g")).select("mol_id", "g.connected", "g.tree", "g.has_cycle", "g.diameter", "g.bridges", "g.matching", "g.symmetry_classes")


def graph_of_rings(spark: SparkSession, d: str) -> DataFrame:
    from crucible.functions.graphs import graph_properties

    return _made(spark, d, "ring").select("mol_id", graph_properties("smiles").alias("g")).select("mol_id", "g.tree", "g.cycle", "g.euler", "g.diameter", "g.bridges", "g.matching", "g.symmetry_classes")


def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """Registered functions, called from SQL."""
    from crucible.functions import registry

    registry.load(spark, "molecules")
    _made(spark, d, "alcohol").createOrReplaceTempView("_alcohols")
    return spark.sql("SELECT mol_id, round(mol_weight(smiles), 4) AS weight, length(mol_scaffold(smiles)) AS ring_atoms FROM _alcohols")


def udtf_substructure(spark: SparkSession, d: str) -> DataFrame:
    from crucible.functions import registry

    registry.load(spark, "substructures")
    _made(spark, d, "chain").createOrReplaceTempView("_chains")
    return spark.sql("SELECT mol_id, count(*) AS n FROM _chains, LATERAL substructure_matches(smiles, 'CCC') GROUP BY mol_id")


def queries() -> dict:
    own = (
        graph_of_chains, graph_of_rings, sql_functions, udtf_substructure,
        mol_basic, wiener_by_edges, zagreb_by_degrees, atom_table, bond_table, sele_and_or_not, sele_bonded, sele_within_bonds, sele_ring, sum_prop, substructure_semi_join, substructure_paths, scaffold_of_rings, smiles_round_trip,
        morgan_fingerprints, descriptor_table, all_descriptors, all_descriptors_of_molecules, groups_of_molecules, molecule_weights, structure_synonyms, structure_lookup,
    )
    q = {f.__name__: f for f in own}
    return q | {"descriptors_chain": _descriptors("chain", CHAIN), "descriptors_ring": _descriptors("ring", RING), "descriptors_alcohol": _descriptors("alcohol", ALCOHOL)}


def oracle_sql() -> dict[str, str]:
    chain, ring = "(SELECT p_partkey AS mol_id, p_size AS n FROM part WHERE p_size >= 1)", "(SELECT p_partkey AS mol_id, p_size AS n FROM part WHERE p_size >= 3)"
    return {
        "mol_basic": f"SELECT mol_id, round(12.011 * n + 1.008 * (2 * n + 2), 4) AS weight, n AS heavy, 2 * n + 2 AS hydrogens, 'C' || CASE WHEN n > 1 THEN n::varchar ELSE '' END || 'H' || (2 * n + 2)::varchar AS formula FROM {chain}",
        "descriptors_chain": f"""SELECT mol_id, round(n * (n * n - 1) / 6.0, 6) AS wiener, CASE n WHEN 1 THEN 0.0 WHEN 2 THEN 2.0 ELSE 4.0 * n - 6 END AS zagreb1, CASE n WHEN 1 THEN 0.0 WHEN 2 THEN 2.0 ELSE 4.0 * n - 6 END AS platt,
            round(CASE n WHEN 1 THEN 0.0 WHEN 2 THEN 2.0 ELSE 2 + (n - 2) / sqrt(2.0) END, 6) AS chi0, round(coalesce(list_sum(list_transform(range(1, n), lambda k: (n - k) / k::double)), 0), 6) AS harary, round(n * (n * n - 1) / 6.0, 6) AS kirchhoff,
            greatest(n - 2, 0)::double AS paths3, round(coalesce(list_sum(list_transform(range(1, n), lambda k: (n - k) * (k + k * k) / 2.0)), 0), 6) AS hyper, (n - 1)::double AS diameter, round(12.011 * n + 1.008 * (2 * n + 2), 6) AS weight,
            greatest(n - 3, 0)::double AS polarity, CASE n WHEN 1 THEN 0.0 WHEN 2 THEN 2.0 ELSE 4.0 * n - 6 END AS walks2 FROM {chain}""",
        "descriptors_ring": f"""SELECT mol_id, round(n * floor(n * n / 4.0) / 2.0, 6) AS wiener, 4.0 * n AS zagreb1, round(n * (n * n - 1) / 12.0, 6) AS kirchhoff, CASE WHEN n <= 20 THEN 1.0 ELSE 0.0 END AS rings, 1.0 AS cyclomatic, round(log10(n), 6) AS trees,
            2.0 AS radius, n::double AS bonds FROM {ring}""",
        "descriptors_alcohol": f"""SELECT mol_id, 1.0 AS oxygens, 1.0 AS hydroxyls, 1.0 AS acceptors, 2.0 * n AS hydrogens, greatest(n - 1, 0)::double AS rotatable, round(12.011 * (n - 1) + 15.999 + 1.008 * 2 * n, 6) AS weight, 0.0 AS ethers, 1.0 AS hetero FROM {chain}""",
        "wiener_by_edges": f"SELECT mol_id, n * (n * n - 1) // 6 AS wiener, greatest(n - 3, 0) AS polarity FROM {chain} WHERE n > 1",
        "zagreb_by_degrees": f"SELECT mol_id, 4 * n AS zagreb1, 2 AS most FROM {ring}",
        "atom_table": f"SELECT mol_id, 'O' AS symbol, 1 AS n, CASE WHEN n = 1 THEN 2 ELSE 1 END AS hydrogens FROM {chain} UNION ALL SELECT mol_id, 'C', n - 1, 2 * n - 1 FROM {chain} WHERE n > 1",
        "bond_table": f"SELECT mol_id, n, CASE WHEN n <= 20 THEN n ELSE 0 END AS in_ring, n AS single FROM {ring}",
        "sele_and_or_not": f"SELECT mol_id, n - 1 AS n FROM {chain}",
        "sele_bonded": f"SELECT mol_id, least(n, 2) AS n FROM {chain}",
        "sele_within_bonds": f"SELECT mol_id, least(n - 1, 3) AS n FROM {chain}",
        "sele_ring": f"SELECT mol_id, n FROM {ring}",
        "sum_prop": f"SELECT mol_id, round(12.011 * (n - 1) + 15.999, 4) AS total FROM {chain}",
        "substructure_semi_join": f"SELECT mol_id, 1 AS n FROM {chain} WHERE n >= 3",
        "substructure_paths": f"SELECT mol_id, greatest(n - 3, 0) AS n FROM {chain}",
        "scaffold_of_rings": f"SELECT mol_id, CASE WHEN n <= 20 THEN n ELSE 0 END AS atoms FROM {ring}",
        "graph_of_chains": f"SELECT mol_id, true AS connected, true AS tree, false AS has_cycle, n - 1 AS diameter, n - 1 AS bridges, n // 2 AS matching, (n + 1) // 2 AS symmetry_classes FROM {chain}",
        "graph_of_rings": f"SELECT mol_id, false AS tree, true AS cycle, true AS euler, n // 2 AS diameter, 0 AS bridges, n // 2 AS matching, 1 AS symmetry_classes FROM {ring}",
        "sql_functions": f"SELECT mol_id, round(12.011 * (n - 1) + 15.999 + 1.008 * 2 * n, 4) AS weight, 0 AS ring_atoms FROM {chain}",
        "udtf_substructure": f"SELECT mol_id, n - 2 AS n FROM {chain} WHERE n >= 3",
        "smiles_round_trip": "SELECT mol_id, true AS same FROM molecules WHERE smiles IS NOT NULL AND error IS NULL",
        "structure_synonyms": "SELECT id, name, synonym, k FROM (SELECT id, synonym, row_number() OVER (PARTITION BY id ORDER BY synonym) AS k FROM (SELECT DISTINCT id, synonym FROM synonyms)) JOIN structures USING (id) WHERE k <= 3",
        "structure_lookup": "SELECT id, inchikey, synonym FROM structures LEFT JOIN (SELECT DISTINCT id, synonym FROM synonyms) USING (id) WHERE inchikey IS NOT NULL AND name LIKE 'a%' OR id = 7",
    }
