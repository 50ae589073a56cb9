"""Queries of notations, fingerprints, graph operators, edits and structure files, with their SQL.

Chains, rings and alcohols stand for part.p_size as in molecule_queries; the texts of `molecules` are compared with regular
expressions over them.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crucible.functions import graphs as H
from crucible.functions import molecules as M
from crucible.functions import notation as N
from crucible.plans.molecule_queries import _made
from crucible.runtime import shared_dir, spread, table, written
from crucible.sources import readers, writers


def _readable(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "molecules").where("error is null and smiles is not null").select("mol_id", "smiles"))


def smiles_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every molecule by kind."""
    t = _readable(spark, d).select("mol_id", F.inline(N.tokens("smiles")))
    return t.groupBy("mol_id", "kind").agg(F.count("*").alias("n"), F.max("at").alias("last"))


def bracket_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Every bracket atom taken apart."""
    t = _readable(spark, d).select("mol_id", F.inline(N.tokens("smiles"))).where("kind = 'bracket'")
    return t.select("mol_id", F.col("at").alias("place"), "token", N.bracket_atom("token").alias("b")).select("mol_id", "place", "token", "b.*").where("symbol is not null")


def element_counts(spark: SparkSession, d: str) -> DataFrame:
    """Atoms by element, charge, isotopes and rings of the real molecules."""
    m = M.molecules(_readable(spark, d), "mol_id", "smiles").where("error is null")
    count = lambda *s: F.size(F.filter("atoms", lambda a: a["symbol"].isin(*s))).cast("long")
    total = lambda f: F.aggregate("atoms", F.lit(0), lambda acc, a: acc + f(a)).cast("long")
    return m.select(
        "mol_id", count("C").alias("carbon"), count("N").alias("nitrogen"), count("O").alias("oxygen"), count("S").alias("sulfur"), count("F", "Cl", "Br", "I").alias("halogen"), F.size("atoms").cast("long").alias("atoms"),
        total(lambda a: a["formal_charge"]).alias("charge"), total(lambda a: F.coalesce(a["isotope"], F.lit(0))).alias("isotopes"),
    )


COUNTED = {"CarbonCount": "carbon", "NitrogenCount": "nitrogen", "OxygenCount": "oxygen", "HalogenCount": "halogen", "FluorineCount": "fluorine", "SulfurCount": "sulfur", "FormalCharge": "charge"}


def descriptors_of_molecules(spark: SparkSession, d: str) -> DataFrame:
    """Descriptors of the real molecules that their texts tell."""
    x = M.descriptor_table(_readable(spark, d), "mol_id", "smiles", list(COUNTED))
    return x.select("mol_id", *[F.col(k).alias(v) for k, v in COUNTED.items()])


def descriptors_of_structures(spark: SparkSession, d: str) -> DataFrame:
    s = spread(table(spark, d, "structures").where("smiles is not null"))
    x = M.descriptor_table(s, "id", "smiles", list(COUNTED))
    return x.select("id", *[F.col(k).alias(v) for k, v in COUNTED.items()])


def structural_keys(spark: SparkSession, d: str) -> DataFrame:
    """Structural keys of the real molecules, those that elements decide."""
    k = _readable(spark, d).select("mol_id", F.explode(M.fingerprint("smiles", "keys")).alias("key"))
    return k.where("key not in (162, 165)")


def morgan_of_chains(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d, "chain").select("mol_id", F.explode(M.fingerprint("smiles", "morgan")).alias("bit"))


def paths_of_chains(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d, "chain").select("mol_id", F.explode(M.fingerprint("smiles", "topological")).alias("bit"))


def combined_of_chains(spark: SparkSession, d: str) -> DataFrame:
    """Circular and path bits side by side: how many of each."""
    c = _made(spark, d, "chain").select("mol_id", M.fingerprint("smiles", "combined").alias("bits"))
    return c.select("mol_id", F.size(F.filter("bits", lambda b: b >= 2048)).alias("paths"), F.array_min(F.filter("bits", lambda b: b >= 2048)).alias("first"))


def path_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return _readable(spark, d).select("mol_id", M.fingerprint("smiles", "topological").alias("bits"))


def formulas_read(spark: SparkSession, d: str) -> DataFrame:
    """Condensed formulas of the alkanes denote the chains."""
    from crucible.functions.molecule_key import molecule_key

    c = _made(spark, d, "chain").where("n > 1").withColumn("formula", F.expr("case when n = 2 then 'CH3CH3' else concat('CH3(CH2)', n - 2, 'CH3') end"))
    return c.select("mol_id", "formula", N.reversed_formula("formula").alias("reversed"), molecule_key(N.formula_to_smiles("formula")).eqNullSafe(molecule_key("smiles")).alias("same"))


def _inchi() -> F.Column:
    """The InChI-like text of an alkane whose atoms are numbered along the chain."""
    return F.expr("concat('InChI=1S/C', if(n = 1, '', cast(n as string)), 'H', 2 * n + 2, if(n = 1, '/h1H4', concat('/c', array_join(sequence(1, n), '-'), '/h', case when n = 2 then '' when n = 3 then '2H2,' else concat('2-', n - 1, 'H2,') end, '1,', n, 'H3')))")


def inchi_read(spark: SparkSession, d: str) -> DataFrame:
    from crucible.functions.molecule_key import molecule_key

    c = _made(spark, d, "chain").withColumn("inchi", _inchi())
    r = c.select("mol_id", N.inchi_layers("inchi").alias("layers"), molecule_key(N.inchi_to_smiles("inchi")).eqNullSafe(molecule_key("smiles")).alias("same"), N.inchi_key("inchi").alias("key"))
    return r.select("mol_id", F.col("layers")["formula"].alias("formula"), "same", F.length("key").alias("key_length"), F.substring("key", 15, 1).alias("dash"), F.substring("key", 24, 4).alias("tail"))


def inchi_keys_known(spark: SparkSession, d: str) -> DataFrame:
    """Keys of compounds whose keys are published."""
    known = [(i, text) for i, (text, _) in enumerate(KNOWN_KEYS)]
    return spark.createDataFrame(known, "id int, inchi string").select("id", N.inchi_key("inchi").alias("key"))


# Published identifiers of ethanol, methane, benzene, water, aspirin and caffeine.
KNOWN_KEYS = (
    ("InChI=1S/C2H6O/c1-2-3/h3H,2H2,1H3", "LFQSCWFLJHTTHZ-UHFFFAOYSA-N"), ("InChI=1S/CH4/h1H4", "VNWKTOKETHGBQD-UHFFFAOYSA-N"), ("InChI=1S/C6H6/c1-2-4-6-5-3-1/h1-6H", "UHOVQNZJYSORNB-UHFFFAOYSA-N"), ("InChI=1S/H2O/h1H2", "XLYOFNOQVPJJNP-UHFFFAOYSA-N"),
    ("InChI=1S/C9H8O4/c1-6(10)13-8-5-3-2-4-7(8)9(11)12/h2-5H,1H3,(H,11,12)", "BSYNRYMUTXBXSQ-UHFFFAOYSA-N"), ("InChI=1S/C8H10N4O2/c1-10-4-9-6-5(10)7(13)12(3)8(14)11(6)2/h4H,1-3H3", "RYYVLZVUVIJVGH-UHFFFAOYSA-N"),
)


def key_checks(spark: SparkSession, d: str) -> DataFrame:
    """The check letter of the earlier key form over the first 25 letters of the stored keys."""
    s = table(spark, d, "structures").where("inchikey is not null")
    return s.select("id", N.check_key(F.substring("inchikey", 1, 25)).alias("ok"))


def list_columns(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings written as texts of lists, read back and spread over columns; four of them summed."""
    e = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda v: v.cast("string")), ", "), F.lit("]")).alias("e"))
    x = N.expand_lists(e, ["e"])
    return x.select("vec_id", F.lit(len(x.columns) - 1).alias("cols"), *[F.col(f"e_{i}").cast("float").cast("double").alias(f"e_{i}") for i in (0, 1, 32, 63)])


def graph_parts_of_chains(spark: SparkSession, d: str) -> DataFrame:
    """Bridges, ring systems, longest chain, unique numbers and a path of the chains."""
    c = _made(spark, d, "chain")
    return c.select(
        "mol_id", F.size(H.of_molecule("smiles", "bridges")).alias("bridges"), F.size(H.of_molecule("smiles", "ring_systems")).alias("ring_systems"), F.size(H.of_molecule("smiles", "longest_chain")).alias("longest"), F.array_max(H.of_molecule("smiles", "unique_numbers")).alias("numbers"),
        F.size(H.of_molecule("smiles", "symmetry_classes")).alias("classes"), F.size(H.path_between("smiles", 0, 3)).alias("path"), F.size(H.of_molecule("smiles", "cycles")).alias("cycles"),
    )


def graph_parts_of_rings(spark: SparkSession, d: str) -> DataFrame:
    r = _made(spark, d, "ring")
    return r.select("mol_id", F.size(H.of_molecule("smiles", "cycles")).alias("cycles"), F.size(H.of_molecule("smiles", "bridges")).alias("bridges"), F.size(F.get(H.of_molecule("smiles", "ring_systems"), F.lit(0))).alias("system"), F.get(H.of_molecule("smiles", "named_rings"), F.lit(0))["name"].alias("name"), F.size(H.path_between("smiles", 0, 2, (1,))).alias("around"))


def morgan_ranks_of_chains(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of both ends of a chain are equal, and the least."""
    r = _made(spark, d, "chain").select("mol_id", H.of_molecule("smiles", "morgan_ranks").alias("r"))
    return r.select("mol_id", (F.element_at("r", 1) == F.element_at("r", -1)).alias("ends_equal"), (F.element_at("r", 1) == F.array_min("r")).alias("end_least"), F.size("r").alias("n"))


def equal_graphs(spark: SparkSession, d: str) -> DataFrame:
    """Alcohols written from either end have one structure hash and one key."""
    from crucible.functions.molecule_key import molecule_key

    a = _made(spark, d, "alcohol").withColumn("back", F.reverse("smiles"))
    return a.select("mol_id", (H.of_molecule("smiles", "structure_hash") == H.of_molecule("back", "structure_hash")).alias("hash"), (molecule_key("smiles") == molecule_key("back")).alias("key"))


def fragment_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Fragments of the real molecules."""
    r = _readable(spark, d).select("mol_id", H.of_molecule("smiles", "fragments").alias("f")).where("f is not null")
    return r.select("mol_id", F.size("f").alias("fragments"), F.size(F.flatten("f")).alias("atoms"))


def stereo_centres(spark: SparkSession, d: str) -> DataFrame:
    """Marked tetrahedral centres of the real molecules."""
    r = _readable(spark, d).select("mol_id", H.of_molecule("smiles", "centres").alias("c")).where("size(c) > 0")
    return r.select("mol_id", F.size("c").alias("centres"), F.size(F.filter("c", lambda x: x["mark"] == "@@")).alias("clockwise"))


def group_search(spark: SparkSession, d: str) -> DataFrame:
    """Functional groups of the alcohols."""
    return _made(spark, d, "alcohol").select("mol_id", F.inline(H.of_molecule("smiles", "functional_groups"))).select("mol_id", "name", F.size("atoms").alias("atoms"))


def atom_types(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d, "alcohol").select("mol_id", F.explode(H.of_molecule("smiles", "sybyl_types")).alias("type")).groupBy("mol_id", "type").agg(F.count("*").alias("n"))


def valences_checked(spark: SparkSession, d: str) -> DataFrame:
    """Carbons forced to five bonds are found."""
    c = _made(spark, d, "chain").select("mol_id", F.concat(F.lit("[CH5]"), "smiles").alias("smiles"))
    return c.select("mol_id", H.of_molecule("smiles", "bad_valences").alias("bad")).select("mol_id", F.size("bad").alias("n"), F.array_min("bad").alias("first"))


def explicit_hydrogens(spark: SparkSession, d: str) -> DataFrame:
    """Alcohols with their hydrogens as atoms."""
    h = _made(spark, d, "alcohol").select("mol_id", H.with_hydrogens("smiles").alias("m"))
    return h.select("mol_id", F.size("m.atoms").alias("atoms"), F.size("m.bonds").alias("bonds"), F.size(F.filter("m.atoms", lambda a: a["symbol"] == "H")).alias("hydrogens"))


def atoms_removed(spark: SparkSession, d: str) -> DataFrame:
    """Chains without their second atom; atoms are numbered anew."""
    m = written(M.molecules(_made(spark, d, "chain"), "mol_id", "smiles"))
    r = H.without_atoms(m, M.atoms(m).where("idx = 1").select("mol_id", "idx"))
    return r.select("mol_id", F.size("atoms").alias("atoms"), F.size("bonds").alias("bonds"), F.array_max(F.transform("atoms", lambda a: a["idx"])).alias("last"), F.array_min(F.transform("bonds", lambda b: b["a"])).alias("from"))


def bonds_removed(spark: SparkSession, d: str) -> DataFrame:
    m = written(M.molecules(_made(spark, d, "ring"), "mol_id", "smiles"))
    r = H.without_bonds(m, M.bonds(m).where("idx in (0, 2)").select("mol_id", "idx"))
    return r.select("mol_id", F.size("atoms").alias("atoms"), F.size("bonds").alias("bonds"))


def bonds_added(spark: SparkSession, d: str) -> DataFrame:
    """Chains with a further atom and a bond to it; a bond that is there, twice given, to itself or to a missing atom isn't added."""
    m = written(H.with_atom(M.molecules(_made(spark, d, "chain"), "mol_id", "smiles"), "O"))
    n = m.select("mol_id", F.size("atoms").alias("n"))
    new = n.select("mol_id", F.explode(F.array(*[F.struct(F.lit(a).cast("int").alias("a"), b.cast("int").alias("b")) for a, b in ((0, F.col("n") - 1), (0, F.lit(1)), (0, F.lit(0)), (0, F.lit(500)))], F.struct((F.col("n") - 1).cast("int").alias("a"), F.lit(0).cast("int").alias("b")))).alias("e"), F.lit(1).alias("order_kek"))
    r = H.with_bonds(m, new.select("mol_id", "e.a", "e.b", "order_kek"))
    return r.select("mol_id", F.size("atoms").alias("atoms"), F.size("bonds").alias("bonds"), F.element_at("bonds", -1)["b"].alias("last"))


# --- structure files ----------------------------------------------------------


def _filed(spark: SparkSession, d: str) -> DataFrame:
    """The structures as records of a file: coordinates from the atom's number, charges and isotopes from the text."""
    s = spread(table(spark, d, "structures").where("smiles is not null").select(F.col("id").alias("mol_id"), "smiles"))
    m = M.molecules(s, "mol_id", "smiles").where("error is null")
    atoms = F.transform("atoms", lambda a: F.struct(a["idx"].alias("idx"), a["symbol"].alias("symbol"), (a["idx"] * 1.5).alias("x"), (F.lit(0.25) * (a["idx"] % 7)).alias("y"), (-F.lit(1.0) * (a["idx"] % 3)).alias("z"), a["formal_charge"].alias("formal_charge"), F.coalesce(a["isotope"], F.lit(0)).alias("isotope")))
    bonds = F.transform("bonds", lambda b: F.struct(b["idx"].alias("idx"), b["a"].alias("a"), b["b"].alias("b"), b["order_kek"].alias("kind"), F.lit(0).alias("stereo")))
    return m.select("mol_id", F.col("mol_id").cast("string").alias("name"), atoms.cast(readers.ATOM).alias("atoms"), bonds.cast(readers.BOND).alias("bonds"), F.create_map(F.lit("FORMULA"), "formula").alias("props"), "formula", "weight")


def _out(spark: SparkSession, suffix: str) -> str:
    return os.path.join(shared_dir(spark), f"files-{uuid.uuid4().hex}.{suffix}")


def sdf_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Structures written as SDF and read back."""
    path = _out(spark, "sdf")
    writers.export(_filed(spark, d), path)
    r = readers.load(spark, path)
    charge = lambda f: F.aggregate("atoms", F.lit(0), lambda acc, a: acc + a[f]).cast("long")
    return r.select(F.col("name").cast("long").alias("id"), F.size("atoms").cast("long").alias("atoms"), charge("formal_charge").alias("charge"), charge("isotope").alias("isotopes"), F.aggregate("atoms", F.lit(0.0), lambda acc, a: acc + a["x"]).alias("x"), F.size(F.filter("atoms", lambda a: a["symbol"] == "N")).cast("long").alias("nitrogen"), (F.col("props")["MOLECULAR_FORMULA"] == F.col("props")["FORMULA"]).alias("formula"))


def mol2_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _out(spark, "mol2")
    writers.export(_filed(spark, d), path)
    r = readers.load(spark, path)
    return r.select(F.col("name").cast("long").alias("id"), F.size("atoms").cast("long").alias("atoms"), F.aggregate("atoms", F.lit(0.0), lambda acc, a: acc + a["x"]).alias("x"), F.size(F.filter("atoms", lambda a: a["symbol"] == "N")).cast("long").alias("nitrogen"))


def mmcif_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Structures written as mmCIF and read back by category: a record's atoms, charges and bonds."""
    path = _out(spark, "cif")
    writers.export(_filed(spark, d), path)
    c = written(readers.cif_categories(spark, path))
    a = c.where("category = 'atom_site'").groupBy("block").agg(F.count_if(F.col("item") == "id").alias("atoms"), F.sum(F.when(F.col("item") == "pdbx_formal_charge", F.col("value").cast("long"))).alias("charge"), F.sum(F.when(F.col("item") == "Cartn_x", F.col("value").cast("double"))).alias("x"))
    return a.select(F.col("block").cast("long").alias("id"), "atoms", "charge", "x")


def pdb_lines(spark: SparkSession, d: str) -> DataFrame:
    """Structures written as fixed-column lines, a residue each, and read back."""
    atom = F.transform("atoms", lambda a: F.format_string("HETATM%5d %-4s UNL A%4d    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", a["idx"] + 1, a["symbol"], F.col("mol_id").cast("int"), a["x"], a["y"], a["z"], F.lit(1.0), F.lit(0.0), a["symbol"]))
    path = _out(spark, "pdb")
    _filed(spark, d).select(F.array_join(atom, "\n").alias("value")).write.text(path)
    a = readers.load(spark, path).where("is_hetatm and chain_id = 'A'")
    return a.groupBy(F.col("res_seq").cast("long").alias("id")).agg(F.count("*").alias("atoms"), F.sum("x").alias("x"), F.count_if(F.col("symbol") == "N").alias("nitrogen"))


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Compounds as tab-separated text, read back with the separator found and types inferred."""
    path = _out(spark, "csv")
    table(spark, d, "compounds").select("record_id", "target", "source").write.option("header", True).option("sep", "\t").csv(path)
    return readers.load(spark, path).select(F.col("record_id").cast("long").alias("record_id"), F.col("target").cast("double").alias("target"), "source")


def smiles_files(spark: SparkSession, d: str) -> DataFrame:
    path = _out(spark, "smi")
    s = table(spark, d, "structures").where("smiles is not null and trim(smiles) <> ''")
    s.select(F.concat_ws(" ", F.trim("smiles"), F.col("id").cast("string")).alias("value")).write.text(path)
    return readers.load(spark, path).select(F.col("name").cast("long").alias("id"), "smiles")


def queries() -> dict:
    own = (
        smiles_tokens, bracket_atoms, element_counts, descriptors_of_molecules, descriptors_of_structures, structural_keys, morgan_of_chains, paths_of_chains, combined_of_chains, path_fingerprints, formulas_read, inchi_read, inchi_keys_known, key_checks, list_columns,
        graph_parts_of_chains, graph_parts_of_rings, morgan_ranks_of_chains, equal_graphs, fragment_atoms, stereo_centres, group_search, atom_types, valences_checked, explicit_hydrogens, atoms_removed, bonds_removed, bonds_added,
        sdf_round_trip, mol2_round_trip, mmcif_round_trip, pdb_lines, csv_round_trip, smiles_files,
    )
    return {f.__name__: f for f in own}


TYPES = {
    "inchi_read": {"key_length": "INTEGER"}, "list_columns": {"cols": "INTEGER"}, "graph_parts_of_chains": dict.fromkeys(("bridges", "ring_systems", "longest", "numbers", "classes", "path", "cycles"), "INTEGER"), "graph_parts_of_rings": dict.fromkeys(("cycles", "bridges", "system", "around"), "INTEGER"),
    "morgan_ranks_of_chains": {"n": "INTEGER"}, "fragment_atoms": {"fragments": "INTEGER", "atoms": "INTEGER"}, "stereo_centres": {"centres": "INTEGER", "clockwise": "INTEGER"}, "group_search": {"atoms": "INTEGER"}, "atom_types": {"n": "BIGINT"}, "valences_checked": {"n": "INTEGER", "first": "INTEGER"},
    "explicit_hydrogens": dict.fromkeys(("atoms", "bonds", "hydrogens"), "INTEGER"), "atoms_removed": {"atoms": "INTEGER", "bonds": "INTEGER", "last": "INTEGER", "from": "INTEGER"}, "bonds_removed": {"atoms": "INTEGER", "bonds": "INTEGER"}, "bonds_added": dict.fromkeys(("atoms", "bonds", "last"), "INTEGER"),
    "smiles_tokens": {"last": "INTEGER"}, "combined_of_chains": {"paths": "INTEGER", "first": "INTEGER"}, "morgan_of_chains": {"bit": "INTEGER"}, "paths_of_chains": {"bit": "INTEGER"}, "structural_keys": {"key": "INTEGER"}, "inchi_keys_known": {"id": "INTEGER"},
    "bracket_atoms": dict.fromkeys(("place", "isotope", "hydrogens", "charge", "class"), "INTEGER"),
}


def oracle_sql() -> dict[str, str]:
    chain, ring = "(SELECT p_partkey AS mol_id, p_size AS n FROM part WHERE p_size >= 1)", "(SELECT p_partkey AS mol_id, p_size AS n FROM part WHERE p_size >= 3)"
    every = r"\[[^\]]*\]|Br|Cl|[BCNOPSFIbcnops*]|%[0-9][0-9]|[0-9]|[-=#:$/\\~]|[()]|\."
    tok = f"(SELECT mol_id, unnest(t) AS token, generate_subscripts(t, 1) AS place FROM (SELECT mol_id, regexp_extract_all(smiles, '{every}') AS t FROM molecules WHERE error IS NULL AND smiles IS NOT NULL))"
    kind = r"CASE WHEN token LIKE '[%' THEN 'bracket' WHEN regexp_full_match(token, '%[0-9][0-9]|[0-9]') THEN 'ring' WHEN token = '.' THEN 'dot' WHEN token IN ('(', ')') THEN 'branch' WHEN regexp_full_match(token, '[A-Za-z*]+') THEN 'atom' ELSE 'bond' END"

    def atoms(source: str, key: str) -> str:
        """(key, symbol, charge, isotope) of every atom in the texts."""
        return rf"""(SELECT {key}, CASE WHEN s LIKE '[%' THEN regexp_extract(s, '\[[0-9]*([A-Z][a-z]?|se|as|te|si|[a-z*])', 1) ELSE s END AS raw, CASE WHEN s LIKE '[%' THEN regexp_extract(s, '([-+]+)[0-9]*(?::[0-9]+)?\]$', 1) ELSE '' END AS signs,
            CASE WHEN s LIKE '[%' THEN regexp_extract(s, '[-+]+([0-9]*)(?::[0-9]+)?\]$', 1) ELSE '' END AS number, CASE WHEN s LIKE '[%' THEN regexp_extract(s, '\[([0-9]*)', 1) ELSE '' END AS iso
            FROM (SELECT {key}, unnest(regexp_extract_all(smiles, '\[[^\]]*\]|Br|Cl|[BCNOPSFIbcnops*]')) AS s FROM {source}))"""

    def counts(source: str, key: str) -> str:
        return f"""SELECT {key}, count(*) FILTER (upper(raw) = 'C') AS carbon, count(*) FILTER (upper(raw) = 'N') AS nitrogen, count(*) FILTER (upper(raw) = 'O') AS oxygen, count(*) FILTER (upper(raw) = 'S') AS sulfur, count(*) FILTER (raw IN ('F', 'Cl', 'Br', 'I')) AS halogen,
            count(*) FILTER (raw = 'F') AS fluorine, count(*) FILTER (upper(raw) = 'P') AS phosphorus, count(*) AS atoms, sum(CASE WHEN signs = '' THEN 0 ELSE (CASE WHEN signs LIKE '+%' THEN 1 ELSE -1 END) * coalesce(TRY_CAST(number AS BIGINT), length(signs)) END)::BIGINT AS charge,
            sum(coalesce(TRY_CAST(iso AS BIGINT), 0))::BIGINT AS isotopes, sum(1.0)::DOUBLE AS one FROM {atoms(source, key)} GROUP BY 1"""

    mols = "(SELECT mol_id, smiles FROM molecules WHERE error IS NULL AND smiles IS NOT NULL)"
    structures = "(SELECT id, smiles FROM structures WHERE smiles IS NOT NULL)"
    little = lambda text: f"('0x' || substr(md5({text}), 7, 2) || substr(md5({text}), 5, 2) || substr(md5({text}), 3, 2) || substr(md5({text}), 1, 2))::BIGINT"
    step = lambda c: f"CASE WHEN lo IS NULL THEN {little(f"{c}::VARCHAR")} WHEN hi IS NULL THEN {little(f"{c} || ',1,' || lo")} ELSE {little(f"{c} || ',1,' || lo || ',1,' || hi")} END"
    near = "least(coalesce(p, q), coalesce(q, p)) AS lo, CASE WHEN p IS NULL OR q IS NULL THEN NULL ELSE greatest(p, q) END AS hi"
    w = "OVER (PARTITION BY n ORDER BY i)"
    morgan = f"""WITH n AS (SELECT DISTINCT p_size AS n FROM part WHERE p_size >= 1), a AS (SELECT n, unnest(range(n)) AS i FROM n),
        z AS (SELECT n, i, CASE WHEN n = 1 THEN '0,0,6,None,0,0' WHEN i IN (0, n - 1) THEN '1,1.0,6,None,0,0' ELSE '2,2.0,6,None,0,0' END AS t FROM a), r0 AS (SELECT n, i, {little("t")} AS v FROM z),
        s1 AS (SELECT n, i, v, lag(v) {w} AS p, lead(v) {w} AS q FROM r0), r1 AS (SELECT n, i, {step("v")} AS v FROM (SELECT n, i, v, {near} FROM s1)),
        s2 AS (SELECT n, i, v, lag(v) {w} AS p, lead(v) {w} AS q FROM r1), r2 AS (SELECT n, i, {step("v")} AS v FROM (SELECT n, i, v, {near} FROM s2)),
        b AS (SELECT DISTINCT n, v % 2048 AS bit FROM (SELECT n, v FROM r0 UNION ALL SELECT n, v FROM r1 UNION ALL SELECT n, v FROM r2)) SELECT p_partkey AS mol_id, bit FROM part JOIN b ON n = p_size"""
    path = f"(SELECT n, unnest(list_distinct(list_transform(range(1, least(n, 8)), lambda k: {little("'6' || repeat(',1,6', k::INT)")} % 2048))) AS bit FROM (SELECT DISTINCT p_size AS n FROM part))"
    weights = (1, 3, 5, 7, 9, 11, 15, 17, 19, 21, 23, 25, 1, 3, 5, 7, 9, 11, 15, 17, 19, 21, 23)
    total = " + ".join(f"{x} * ascii(substr(k, {i + 1}, 1))" for i, x in enumerate(weights))
    file = f"SELECT id, atoms, charge, isotopes, nitrogen, 1.5 * atoms * (atoms - 1) / 2 AS x FROM ({counts(structures, 'id')})"
    return {
        "smiles_tokens": f"SELECT mol_id, kind, count(*) AS n, max(place) AS last FROM (SELECT mol_id, place, {kind} AS kind FROM {tok}) GROUP BY 1, 2",
        "bracket_atoms": rf"""WITH b AS (SELECT mol_id, place, token, regexp_extract(token, '^\[([0-9]*)([A-Z][a-z]?|se|as|te|si|[bcnops]|\*)(@{{0,2}}(?:[A-Z]{{2}}[0-9]+)?)(H?)([0-9]*)([-+]*)([0-9]*)(?::([0-9]+))?\]$', ['i', 'symbol', 'chirality', 'h', 'hn', 'q', 'qn', 'c']) AS g FROM {tok} WHERE token LIKE '[%')
            SELECT mol_id, place, token, TRY_CAST(g.i AS INT) AS isotope, g.symbol AS symbol, g.chirality AS chirality, CASE WHEN g.h = 'H' THEN coalesce(TRY_CAST(g.hn AS INT), 1) ELSE 0 END AS hydrogens,
            (CASE WHEN g.q LIKE '+%' THEN 1 WHEN g.q LIKE '-%' THEN -1 ELSE 0 END) * coalesce(TRY_CAST(g.qn AS INT), length(g.q)) AS charge, TRY_CAST(g.c AS INT) AS class FROM b WHERE g.symbol <> ''""",
        "element_counts": f"SELECT mol_id, carbon, nitrogen, oxygen, sulfur, halogen, atoms, charge, isotopes FROM ({counts(mols, 'mol_id')})",
        "descriptors_of_molecules": f"SELECT mol_id, {', '.join(f'{v}::DOUBLE AS {v}' for v in COUNTED.values())} FROM ({counts(mols, 'mol_id')})",
        "descriptors_of_structures": f"SELECT id, {', '.join(f'{v}::DOUBLE AS {v}' for v in COUNTED.values())} FROM ({counts(structures, 'id')})",
        "structural_keys": f"WITH c AS ({counts(mols, 'mol_id')}) SELECT mol_id, 114 AS key FROM c WHERE halogen > 0 UNION ALL SELECT mol_id, 137 FROM c WHERE sulfur > 0 UNION ALL SELECT mol_id, 139 FROM c WHERE oxygen > 0 UNION ALL SELECT mol_id, 142 FROM c WHERE phosphorus > 0 UNION ALL SELECT mol_id, 161 FROM c WHERE nitrogen > 0",
        "morgan_of_chains": morgan,
        "paths_of_chains": f"SELECT p_partkey AS mol_id, bit FROM part JOIN {path} ON n = p_size",
        "combined_of_chains": f"SELECT mol_id, count(bit) AS paths, min(bit) + 2048 AS first FROM {chain} c LEFT JOIN {path} b ON b.n = c.n GROUP BY 1",
        "formulas_read": f"SELECT mol_id, CASE WHEN n = 2 THEN 'CH3CH3' ELSE 'CH3(CH2)' || (n - 2) || 'CH3' END AS formula, CASE WHEN n = 2 THEN 'H3CH3C' ELSE 'H3C(H2C)' || CASE WHEN n = 3 THEN '' ELSE (n - 2)::VARCHAR END || 'H3C' END AS reversed, true AS same FROM {chain} WHERE n > 1",
        "inchi_read": f"SELECT mol_id, 'C' || CASE WHEN n = 1 THEN '' ELSE n::VARCHAR END || 'H' || (2 * n + 2) AS formula, true AS same, 27 AS key_length, '-' AS dash, 'SA-N' AS tail FROM {chain}",
        "inchi_keys_known": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}')" for i, (_, k) in enumerate(KNOWN_KEYS)) + ") AS t(id, key)",
        "key_checks": f"SELECT id, regexp_full_match(s, '[A-Z]{{14}}-[A-Z]{{9}}[A-Z]') AND chr((({total}) % 26 + 65)::INT) = substr(s, 25, 1) AS ok FROM (SELECT id, substr(inchikey, 1, 25) AS s, substr(inchikey, 1, 14) || substr(inchikey, 16, 9) AS k FROM structures WHERE inchikey IS NOT NULL)",
        "list_columns": "SELECT vec_id, 64 AS cols, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e_{i}" for i in (0, 1, 32, 63)) + " FROM embeddings",
        "graph_parts_of_chains": f"SELECT mol_id, n - 1 AS bridges, 0 AS ring_systems, n AS longest, (n + 1) // 2 AS numbers, (n + 1) // 2 AS classes, CASE WHEN n > 3 THEN 4 END AS path, 0 AS cycles FROM {chain}",
        "graph_parts_of_rings": f"SELECT mol_id, 1 AS cycles, 0 AS bridges, n AS system, CASE WHEN n <= 20 THEN n || ' saturated' END AS name, CASE WHEN n = 3 THEN 2 ELSE n - 1 END AS around FROM {ring}",
        "morgan_ranks_of_chains": f"SELECT mol_id, true AS ends_equal, true AS end_least, n FROM {chain}",
        "equal_graphs": f"SELECT mol_id, true AS hash, true AS key FROM {chain}",
        "fragment_atoms": f"SELECT mol_id, fragments, atoms FROM ({counts(mols, 'mol_id')}) JOIN (SELECT mol_id, length(smiles) - length(replace(smiles, '.', '')) + 1 AS fragments FROM {mols}) USING (mol_id)",
        "stereo_centres": f"SELECT mol_id, count(*) AS centres, count(*) FILTER (token LIKE '%@@%') AS clockwise FROM {tok} WHERE token LIKE '[%@%' GROUP BY 1",
        "group_search": f"SELECT mol_id, 'hydroxyl' AS name, 2 AS atoms FROM {chain} WHERE n > 1",
        "atom_types": f"SELECT mol_id, 'O.3' AS type, 1 AS n FROM {chain} UNION ALL SELECT mol_id, 'C.3', n - 1 FROM {chain} WHERE n > 1",
        "valences_checked": f"SELECT mol_id, 1 AS n, 0 AS first FROM {chain}",
        "explicit_hydrogens": f"SELECT mol_id, 3 * n AS atoms, 3 * n - 1 AS bonds, 2 * n AS hydrogens FROM {chain}",
        "atoms_removed": f'SELECT mol_id, CASE WHEN n = 1 THEN 1 ELSE n - 1 END AS atoms, CASE WHEN n <= 3 THEN 0 ELSE n - 3 END AS bonds, CASE WHEN n = 1 THEN 0 ELSE n - 2 END AS last, CASE WHEN n > 3 THEN 1 END AS "from" FROM {chain}',
        "bonds_removed": f"SELECT mol_id, n AS atoms, n - 2 AS bonds FROM {ring}",
        "bonds_added": f"SELECT mol_id, n + 1 AS atoms, n AS bonds, n AS last FROM {chain}",
        "sdf_round_trip": f"SELECT id, atoms, charge, isotopes, x::DOUBLE AS x, nitrogen, true AS formula FROM ({file})",
        "mol2_round_trip": f"SELECT id, atoms, x::DOUBLE AS x, nitrogen FROM ({file})",
        "mmcif_round_trip": f"SELECT id, atoms, charge, x::DOUBLE AS x FROM ({file})",
        "pdb_lines": f"SELECT id, atoms, x::DOUBLE AS x, nitrogen FROM ({file})",
        "csv_round_trip": "SELECT record_id, target, source FROM compounds",
        "smiles_files": "SELECT id, trim(smiles) AS smiles FROM structures WHERE smiles IS NOT NULL AND trim(smiles) <> ''",
    }
