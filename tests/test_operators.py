"""Operators on small tables, with nulls, ties, empty tables and clashing names."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crucible.functions import molecules as M
from crucible.operators import components, dataset, joins, selection, similarity, statistics, units
from crucible.sources import readers, writers


def test_components(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (3, None, "y"), (4, None, None), (5, "b", None), (6, "b", "z"), (7, None, "z"), (8, None, None)]
    df = spark.createDataFrame(rows, "record_id long, k0 string, u string")
    got = {r.id: r.component for r in components.groups_by_shared_values(df, "record_id", ["k0", "u"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5, 8: 8}
    assert components.groups_by_shared_values(df.limit(0), "record_id", ["k0", "u"]).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    cc = {r.node: r.component for r in components.connected_components(chain).collect()}
    assert len(cc) == 203 and {cc[i] for i in range(201)} == {0} and cc[501] == 500


ACTIVITIES = "activity_id long, molecule_ref long, assay_id int, ic50 double, standard_type string, standard_units string, activity_comment string, mol_weight double, extra string"


def test_units(spark):
    rows = [
        (1, 1, 1, 250.0, "IC50", "nM", None, 400.0), (2, 1, 1, 0.25, "IC50", " uM ", "ATP at 10 mM", 400.0), (3, 1, 1, 6.60206, "pIC50", "nM", None, 400.0), (4, 1, 1, -6.60206, "logIC50", None, None, 400.0), (5, 1, 1, 0.1, "IC50", "ug/mL", None, 400.0),
        (6, 1, 1, None, "IC50", None, "IC50 = 0,25 uM", 400.0), (7, 1, 1, -999.0, "IC50", "nM", "2.5 x 10^2 nM", 400.0), (8, 1, 1, 0.25, "IC50", None, "reported in µM, n=3", None), (9, 1, 1, 250.0, "Inhibition", "%", None, None), (10, 1, 2, 0.25, "IC50", None, "ATP at 5 nM", None),
        (11, 1, 3, 0.25, "IC50", None, None, None), (12, None, 1, 0.25, "IC50", "uM", None, None), (13, 1, 1, 0.0, "IC50", "nM", None, None), (14, 1, 1, 0.1, "IC50", "ug/mL", None, None), (15, 1, 1, 250.0, "IC50", "furlong", None, None), (16, 1, 1, 250.0, None, "nmol/L", "", None),
    ]
    a = spark.createDataFrame([(*r, "x") for r in rows], ACTIVITIES)
    s = spark.createDataFrame([(1, "Cell test. ATP kept at 2 mM."), (2, "Test at 37 C. Substrate at 4 uM. Values without a unit are in micromolar."), (None, "in nM"), (3, None)], "assay_id int, description string")
    got = {r.activity_id: r for r in units.to_common_unit(a, s).collect()}
    for i in (1, 2, 3, 4, 5, 6, 7, 8, 10, 16):
        assert got[i].value_nm == pytest.approx(250, rel=1e-5), i
    assert all(got[i].value_nm is None for i in (9, 11, 13, 14, 15)) and got[10].said_by == "assay" and got[6].said_by == "comment"
    pairs = {tuple(r) for r in units.same_quantity_pairs(units.to_common_unit(a, s)).collect()}
    assert (1, 2) in pairs and (3, 4) in pairs and (2, 6) not in pairs and (1, 16) not in pairs and not any(12 in p or 10 in p for p in pairs)
    assert units.same_quantity_pairs(units.to_common_unit(a.limit(0), s.limit(0))).count() == 0


def test_unit_graph_learns_spellings_and_overrules_wrong_ones(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):  # every value twice: in nM and in a unit no table knows, by scale, weight or logarithm; some labels are wrong
        v, w = 10 ** rng.uniform(0, 4), rng.uniform(150, 600)
        other = [(v / 1000, "IC50", "kilo-nm"), (v * w * 1e-6, "IC50", "gamma"), (9 - math.log10(v), "pIC50", None), (v * 1000, "IC50", "uM")][i % 4]
        rows += [(2 * i, i, 1, v, "IC50", "nM", None, w, ""), (2 * i + 1, i, 1, v / 1000 if i % 16 == 0 else other[0] * (1000 if i % 11 == 5 else 1), other[1], other[2], None, w, "")]
    rows += [(1000 + i, 500 + i // 2, 1, 7.0 * (1 + i), "IC50", ("nM", "furlong")[i % 2], None, None, "") for i in range(8)]
    a = spark.createDataFrame(rows, ACTIVITIES)
    none = spark.createDataFrame([], "assay_id int, description string")
    for spellings in (True, False):  # the table of spellings isn't what converts
        t = {r.label: (r.sign, r.mass, r.shift, r.source) for r in units.conversion_table(units.stated_quantities(a, none), spellings).collect()}
        assert t == {"nM": (1, 0, 0, "links"), "kilo-nm": (1, 0, 3, "links"), "gamma": (1, -1, 6, "links"), "-log10 M": (-1, 0, 9, "links"), "uM": (1, 0, -3, "links")}
    got = {r.activity_id: r.value_nm for r in units.to_common_unit(a, none, spellings=False).collect()}
    good = [i for i in range(60) if i % 11 != 5 and i % 16]
    assert all(got[2 * i + 1] == pytest.approx(got[2 * i], rel=1e-6) for i in good) and got[1001] is None


def test_unit_graph_reaches_over_labels(spark):
    rows = []
    for i in range(40):
        v = 10.0 ** (i % 7) * (1.3 + 0.11 * i)
        first, second = (("nM", v), ("aa", v / 1e3)) if i % 2 else (("aa", v / 1e3), ("bb", v / 1e6))
        rows += [(2 * i, i, 1, first[1], "IC50", first[0], None, None, ""), (2 * i + 1, i, 1, second[1], "IC50", second[0], None, None, "")]
    t = units.conversion_table(units.stated_quantities(spark.createDataFrame(rows, ACTIVITIES), spark.createDataFrame([], "assay_id int, description string")))
    assert {r.label: r.shift for r in t.collect()} == {"nM": 0, "aa": 3, "bb": 6}


def test_selection(spark):
    df = spark.createDataFrame([(1, "CCO"), (2, "c1ccccc1Cl"), (3, None), (4, "C(")], "mol_id long, smiles string")
    m = M.molecules(df, "mol_id", "smiles")
    assert m.where("error is not null").count() == 2
    s = selection.Selector(M.atoms(m), M.bonds(m), M.rings(m))
    n = lambda t: {r.mol_id: r.n for r in s.count(t).collect()}
    assert n("C and not ring or Cl") == {1: 2, 2: 1} and n("bonded oxygen") == {1: 2, 2: 0} and n("ring within 1 bond of Cl") == {1: 0, 2: 1}
    assert n("halogen") == {1: 0, 2: 1} and n("not (C or O)") == {1: 0, 2: 1} and n("mass > 12.5") == {1: 1, 2: 1} and n("lipo") == {1: 1, 2: 7}
    for bad in ("C and", "(C", "within x of C", "nosuchthing", "foo > 3", ""):
        with pytest.raises(selection.SelectionError):
            s.select(bad).count()


def test_joins(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, None, 0.0), (4, 1.0, 0.0)], "id long, x double, y double").withColumn("k", F.lit(1))
    got = {(r.id, r.r_id) for r in joins.range_join(a, a, 1.0, ["k"], ["x", "y"]).collect()}
    assert got == {(i, j) for i in (1, 2, 4) for j in (1, 2, 4)}
    assert joins.range_join(a, a.limit(0), 1.0, ["k"], ["x", "y"]).count() == 0
    p = spark.createDataFrame([("u", 5), ("u", 15), ("v", 5)], "k string, at long")
    r = spark.createDataFrame([("u", 0, 10), ("u", 5, 5), ("u", 9, 3), (None, 0, 99)], "k string, start long, end long")
    assert joins.interval_join(p, r, "k", "at", "start", "end", 4).count() == 2


def test_dataset(spark):
    df = spark.createDataFrame([(1, " C "), (2, "C"), (3, ""), (4, None), (5, "\t"), (6, "N")], "id long, smiles string")
    assert [tuple(r) for r in dataset.cleanse(df, "smiles", "id").orderBy("id").collect()] == [(1, "C"), (6, "N")]
    assert dataset.cleanse(df.limit(0), "smiles", "id").count() == 0
    g = spark.createDataFrame([(i, "a" if i < 6 else "b" if i < 9 else None) for i in range(10)], "id long, g string")
    got = {(r.g, r.split_status) for r in dataset.group_packing(g, "g", 0.7).select("g", "split_status").distinct().collect()}
    assert got == {("a", "Train"), ("b", "Test"), (None, "Train")}
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)], "id long, x array<double>")
    for f in (dataset.kennard_stone, dataset.duplex, dataset.d_optimal, dataset.sphere_exclusion):
        c = {r.split_status: r["count"] for r in f(v, "id", "x", 0.8).groupBy("split_status").count().collect()}
        assert sum(c.values()) == 10 and c["Train"] >= 6, f
    ks = {r.id for r in dataset.kennard_stone(v, "id", "x", 0.3).where("split_status = 'Train'").collect()}
    assert ks >= {0, 9}


def test_statistics(spark):
    x = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0), ("c", 1.0), ("c", 2.0), ("c", None), (None, 3.0)], "g string, v double")
    assert {r.g: round(r.ks, 9) for r in statistics.kolmogorov_smirnov(x, "g", "v", "a").collect()} == {"b": 1.0, "c": 0.0}
    s = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (None, 0.3)], "y int, s double")
    assert statistics.roc_auc(s, "y", "s").first().auc == pytest.approx(0.875)
    assert statistics.classification_metrics(s.selectExpr("y", "y as p"), "y", "p").first().accuracy == 1.0


def test_nearest(spark):
    x = spark.createDataFrame([(100 * i, [float(i), 1.0]) for i in range(5)] + [(7, None), (1, [0.0, 1.0])], "id long, v array<double>")
    got = [(r.query, r.id) for r in similarity.nearest(x, "id", "v", 1).orderBy("query").collect()]
    assert got == [(0, 1), (100, 0), (200, 100), (300, 200), (400, 300)]
    assert similarity.nearest(x.limit(0), "id", "v", 1).count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "cityblock"])
def test_nearest_gives_ties_to_the_smallest_ids(spark, metric):
    vector = lambda i: [3.1, 0.7, 1.9] if i % 3 else [0.3 + i, 4.0, 0.1]
    ids = list(range(1, 3001))
    random.Random(6).shuffle(ids)
    q = spark.createDataFrame([(100, [3.0, 0.7, 2.0])], "id long, v array<double>")
    for parts in (1, 3):
        x = spark.createDataFrame([(i, vector(i)) for i in ids], "id long, v array<double>").repartition(parts)
        got = [r.id for r in similarity.nearest(x, "id", "v", 5, metric, q).orderBy("rank").collect()]
        assert got == [1, 2, 4, 5, 7]


def test_umap_edges_join_all_rows(spark, tmp_path):
    from crucible.plans import table_queries

    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 4))
    spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    w = {(r.i, r.j): r.w for r in table_queries.umap_edges(spark, str(tmp_path)).collect()}
    assert {i for i, _ in w} == set(range(1, 61)) and all(w[j, i] == pytest.approx(v) for (i, j), v in w.items())
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    near = {(i + 1, int(j) + 1) for i in range(60) for j in np.argsort(d[i])[1:16]}
    assert set(w) == near | {(j, i) for i, j in near}
    mutual = [(i, j) for i, j in near if (j, i) in near and d[i - 1, j - 1] == d[i - 1][d[i - 1] > 0].min()]
    assert mutual and all(w[p] == pytest.approx(1.0) for p in mutual)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a b", [(0, "C", 0.0, 1.0, 2.0, 0, 13), (1, "N", 1.0, 1.0, 2.0, 1, 0)], [(0, 0, 1, 2, 0)], {"k": "v"})], f"name string, atoms {readers.ATOM}, bonds {readers.BOND}, props map<string,string>")
    writers.write_sdf(df.union(df), str(tmp_path / "x.sdf"))
    got = readers.sdf(spark, str(tmp_path / "x.sdf")).collect()
    assert len(got) == 2 and got[0].name == "a b" and got[0].atoms[1].symbol == "N" and got[0].atoms[1].x == 1.0
    assert [(a.formal_charge, a.isotope) for a in got[0].atoms] == [(0, 13), (1, 0)]
    assert got[0].bonds[0].kind == 2 and got[0].props == {"k": "v"}
    writers.write_mol2(df, str(tmp_path / "x.mol2"))
    m = readers.mol2(spark, str(tmp_path / "x.mol2")).first()
    assert m.name == "a b" and [a.symbol for a in m.atoms] == ["C", "N"] and m.bonds[0].a == 0 and m.bonds[0].b == 1
    writers.write_mmcif(df, str(tmp_path / "x.cif"))
    assert [r.symbol for r in readers.mmcif_atoms(spark, str(tmp_path / "x.cif")).orderBy("serial").collect()] == ["C", "N"]
    (tmp_path / "x.pdb").write_text(
        "HELIX    1   1 ALA A    1  ALA A    5  1\nATOM      1  CA  ALA A   1      11.000  12.000  13.500  1.00 20.00           C\nHETATM    2  O   HOH A   2       1.000   2.000   3.000  1.00 10.00           O\nATOM      x  CA  ALA A   1      bad\nCONECT    1    2\nCONECT    2    1\n"
    )
    p = readers.pdb(spark, str(tmp_path / "x.pdb")).orderBy("serial").collect()
    assert [(r.symbol, r.res_name, r.x, r.is_hetatm) for r in p] == [("C", "ALA", 11.0, False), ("O", "HOH", 1.0, True)]
    assert readers.pdb_structure_ranges(spark, str(tmp_path / "x.pdb")).first().end == 5 and readers.pdb_conect(spark, str(tmp_path / "x.pdb")).count() == 1
    (tmp_path / "x.smi").write_text("CCO ethanol\n\nC\n")
    assert [tuple(r) for r in readers.load(spark, str(tmp_path / "x.smi")).collect()] == [("CCO", "ethanol"), ("C", None)]


def test_many_charges_and_old_codes(spark, tmp_path):
    atoms = [(i, "N", float(i), 0.0, 0.0, (i % 5) - 2, i % 3) for i in range(40)]
    df = spark.createDataFrame([("", atoms, [], None)], f"name string, atoms {readers.ATOM}, bonds {readers.BOND}, props map<string,string>")
    writers.export(df, str(tmp_path / "y.sdf"))
    assert [tuple(a) for a in readers.load(spark, str(tmp_path / "y.sdf")).first().atoms] == atoms
    (tmp_path / "old.mol").write_text("x\n\n\n  2  0  0  0  0  0  0  0  0  0999 V2000\n    0.0000    0.0000    0.0000 N   0  3\n    0.0000    0.0000    0.0000 O   0  5\nM  CHG  1   2   0\nM  END\n")
    assert [a.formal_charge for a in readers.load(spark, str(tmp_path / "old.mol")).first().atoms] == [1, 0]
    with pytest.raises(ValueError):
        writers.export(df, str(tmp_path / "y.xyz"))


def test_more_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("n\tv\nGr\u00f6\u00dfe\t1\n".encode("latin-1"))
    assert [tuple(r) for r in readers.load(spark, str(tmp_path / "a.csv")).collect()] == [("Größe", 1)]
    (tmp_path / "l.pdbqt").write_text("ATOM      1  C1  LIG A   1       1.000   2.000   3.000  1.00  0.00     0.123 A \nBRANCH   1   2\nATOM      2  O1  LIG A   1       1.000   2.000   4.000  1.00  0.00    -0.300 OA\nBRANCH   5   2\nENDBRANCH   5   2\nENDBRANCH   1   2\nBRANCH   1   9\nENDBRANCH 1 9\n")
    assert [(r.symbol, r.aromatic, r.partial_charge) for r in readers.pdbqt(spark, str(tmp_path / "l.pdbqt")).orderBy("serial").collect()] == [("C", True, 0.123), ("O", True, -0.3)]
    assert [(r.a, r.b, r.depth) for r in readers.pdbqt_branches(spark, str(tmp_path / "l.pdbqt")).orderBy("a", "b").collect()] == [(1, 2, 1), (1, 9, 1), (2, 5, 2)]
    (tmp_path / "s.cif").write_text("data_X # note\n_entry.id 'a b'\nloop_\n_struct_conn.conn_type_id\n_struct_conn.ptnr1_auth_asym_id\n_struct_conn.ptnr1_auth_seq_id\n_struct_conn.ptnr2_label_atom_id\nDISULF A 5 ?\ncovale 'B' . O4\n_x.text\n;two\nlines\n;\n")
    c = {(r.category, r.row, r.item): r.value for r in readers.cif_categories(spark, str(tmp_path / "s.cif")).collect()}
    assert c["entry", 0, "id"] == "a b" and c["x", 0, "text"] == "two\nlines" and c["struct_conn", 1, "ptnr1_auth_seq_id"] is None
    b = [(r.conn_type, r.chain1, r.seq1, r.atom2) for r in readers.mmcif_bonds(spark, str(tmp_path / "s.cif")).orderBy("conn_type").collect()]
    assert b == [("covale", "B", 0, "O4"), ("disulf", "A", 5, "SG")]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "q.sdf").write_text("x")
    assert [(r.suffix, r.bytes) for r in readers.folder(spark, str(tmp_path), ("sdf",)).collect()] == [("sdf", 1)]


def test_descriptor_stream(spark, tmp_path):
    from crucible.streaming.streams import descriptor_stream

    spark.createDataFrame([(1, "CCO"), (2, "see file")], "mol_id long, smiles string").write.parquet(str(tmp_path / "in"))
    q = descriptor_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), ["MolecularWeight"])
    q.awaitTermination(120)
    got = spark.read.option("header", True).csv(str(tmp_path / "out")).orderBy("mol_id").collect()
    assert math.isclose(float(got[0].MolecularWeight), 46.069, abs_tol=1e-3) and got[1].MolecularWeight is None


def test_entry_without_llm(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    q = set(e.queries())
    assert set(e.oracle_sql()) <= q


def test_plain_sums_join_nothing(spark):
    """Sums over a selection of terms only are one pass over the atoms: no join, so nothing that grows with the rows is broadcast."""
    m = spark.createDataFrame([(1, "CCO"), (2, "[H][H]"), (3, "C1CC1O")], "mol_id long, smiles string")
    m = M.molecules(m, "mol_id", "smiles")
    total = selection.Selector(M.atoms(m), M.bonds(m)).sum_property("mass", "heavy")
    assert {r.mol_id: round(r.total, 3) for r in total.collect()} == {1: 40.021, 3: 52.032}
    assert "Join" not in total._jdf.queryExecution().toString()


def test_plain_counts_join_nothing(spark, tmp_path):
    """sele_ring reads what is in a ring from the molecule's row: no join; a ring of over 20 atoms counts as none and keeps its row."""
    from crucible.plans import molecule_queries

    spark.createDataFrame([(1, 3), (2, 20), (3, 21), (4, 1)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    r = molecule_queries.sele_ring(spark, str(tmp_path))
    assert {x.mol_id: x.n for x in r.collect()} == {1: 3, 2: 20, 3: 0}
    assert "Join" not in r._jdf.queryExecution().toString()


def test_groups_of_molecules_read_a_molecule_once(spark, tmp_path):
    """Scaffold, groups, matches and graph come from one pass of Python; a text that can't be read keeps a row of nulls."""
    from crucible.plans import molecule_queries

    spark.createDataFrame([(1, "CC(=O)NC", None), (2, "C((", None)], "mol_id long, smiles string, error string").write.parquet(str(tmp_path / "molecules.parquet"))
    r = molecule_queries.groups_of_molecules(spark, str(tmp_path))
    assert r._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    a, b = r.orderBy("mol_id").collect()
    assert (a.scaffold, a.amides, a.graph.diameter, b.scaffold, b.groups, b.amides, b.graph.diameter) == ("", 1, 3, None, None, None, None)


def test_sele_ring_holds_rings_of_any_size(spark, tmp_path):
    """A ring's size doesn't decide whether its atoms are in a ring; a bond between two rings puts none there."""
    from crucible.chem.graph import Molecule
    from crucible.plans import molecule_queries

    spark.createDataFrame([(1, 3), (2, 20), (3, 21), (4, 50), (5, 2)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    r = molecule_queries.sele_ring(spark, str(tmp_path))
    assert {x.mol_id: x.n for x in r.collect()} == {1: 3, 2: 20, 3: 21, 4: 50}
    assert "Join" not in r._jdf.queryExecution().toString()
    big = "C1" + "C" * 28 + "C1"  # 30 atoms
    assert Molecule(f"CC{big.replace('C1', 'C2', 1)[:-1]}2CCC3CC3").cyclic() == [*range(2, 32), 34, 35, 36] and Molecule("CCO").cyclic() == []
