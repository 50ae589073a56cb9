"""Notations, perception, cycles, edits and the force field against closed forms, brute force and known values."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crucible.chem import cycles as C
from crucible.chem import descriptors as D
from crucible.chem import forcefield as V
from crucible.chem import geometry as G
from crucible.chem import notation as N
from crucible.chem import patterns as P
from crucible.chem import perceive as R
from crucible.chem.graph import Molecule
from crucible.chem.identity import molecule_keys
from crucible.chem.smiles import SmilesError

ASPIRIN = "CC(=O)Oc1ccccc1C(=O)O"


@pytest.mark.parametrize(
    "formula, smiles, start",
    [("CH3COOH", "CC(=O)O", 0), ("CH3C(CH3)3", "CC(C)(C)C", 0), ("CH2C(CH3)3", "CC(C)(C)C", 1), ("(CH2)7Cl", "CCCCCCCCl", 1), ("C2H5OH", "CCO", 0), ("CHCH", "C#C", 0), ("CH3CN", "CC#N", 0), ("CH3(CH2)3CH3", "CCCCC", 0)],
)
def test_condensed_formulas(formula, smiles, start):
    a, b = molecule_keys([N.formula_to_smiles(formula, start), smiles])
    assert a == b and a


@pytest.mark.parametrize("bad", ["", "CH", "Xx2", "CH3(", "CH3)", "ch3", "CH3CH3CH3"])
def test_formulas_that_cannot_be(bad):
    with pytest.raises(SmilesError):
        N.formula_to_smiles(bad)


def test_inchi():
    assert N.inchi_key("InChI=1S/C6H10/c1-3-5-6-4-2/h3-6H,1-2H3/b5-3+,6-4+") == "APPOKADJQUIAHP-GGWOSOGESA-N"
    assert len(N._triplets()) == 1 << 14 and len(set(N._triplets())) == 1 << 14
    texts = {"InChI=1S/C9H8O4/c1-6(10)13-8-5-3-2-4-7(8)9(11)12/h2-5H,1H3,(H,11,12)": ASPIRIN, "InChI=1S/C8H10N4O2/c1-10-4-9-6-5(10)7(13)12(3)8(14)11(6)2/h4H,1-3H3": "Cn1cnc2c1c(=O)n(C)c(=O)n2C", "InChI=1S/C2H3N/c1-2-3/h1H3": "CC#N", "InChI=1S/CH4/h1H4": "C"}
    for inchi, smiles in texts.items():
        a, b = molecule_keys([N.inchi_to_smiles(inchi), smiles])
        assert a == b
    assert N.inchi_layers("InChI=1S/CH4/h1H4") == {"": "1S", "formula": "CH4", "h": "1H4"}
    for bad in ("", "InChI=1S", "InChI=2/C", "nothing/here"):
        with pytest.raises((SmilesError, IndexError, ValueError)):
            N.inchi_key(bad)
    base = "ABCDEFGHIJKLMN-ABCDEFGHI"
    good = [base + c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if N.check_key(base + c)]
    assert len(good) == 1 and not N.check_key("x")


def test_columns_of_notations(spark):
    from crucible.functions import notation as K

    df = spark.createDataFrame([("[13C@@H2+2:4]%12Cl.c-(",), (None,), ("",)], "s string")
    t = df.select(K.tokens("s").alias("t")).collect()
    assert [(x.token, x.kind) for x in t[0].t] == [("[13C@@H2+2:4]", "bracket"), ("%12", "ring"), ("Cl", "atom"), (".", "dot"), ("c", "atom"), ("-", "bond"), ("(", "branch")] and t[1].t is None and t[2].t == []
    b = df.select(K.bracket_atom(F.lit("[13C@@H2+2:4]")).alias("b"), K.bracket_atom(F.lit("C")).alias("n")).first()
    assert tuple(b.b) == (13, "C", "@@", 2, 2, 4) and b.n is None
    x = spark.createDataFrame([(1, "[1, 2.5]"), (2, "[]"), (3, None), (4, "no"), (5, "['3', x]")], "id long, v string")
    got = {r.id: (r.v_0, r.v_1) for r in K.expand_lists(x, ["v"]).collect()}
    assert got == {1: (1.0, 2.5), 2: (None, None), 3: (None, None), 4: (None, None), 5: (3.0, None)}
    assert [r.s for r in x.select(K.formula_to_smiles("v").alias("s")).collect()] == [None] * 5


def test_perception():
    a = Molecule(ASPIRIN)
    assert R.functional_groups(a) == [("ester", [1, 2, 3, 4]), ("carboxylic acid", [10, 11, 12])] or {n for n, _ in R.functional_groups(a)} == {"ester", "carboxylic acid"}
    assert R.named_rings(a) == [("6 aromatic", [4, 5, 6, 7, 8, 9])] and R.named_rings(Molecule("C1CCOC1"))[0][0] == "5 saturated O"
    assert R.sybyl_types(Molecule("CC(=O)N")) == ["C.3", "C.2", "O.2", "N.3"] and R.sybyl_types(Molecule("c1ccncc1"))[3] == "N.ar"
    assert [R.double_bond_stereo(Molecule(s))[0][2] for s in ("F/C=C/F", "F/C=C\\F", "F\\C=C\\F", "C(/F)=C/F")] == ["E", "Z", "E", "Z"]
    assert R.centres(Molecule("N[C@@H](C)C(=O)O")) == [(1, "@@", [0, 3, 2])] and R.centres(Molecule("[C@H4]")) == [(0, "@", [])]
    assert R.bad_valences(Molecule("[CH5]C")) == [0] and R.bad_valences(Molecule("C[N+](C)(C)C")) == [] and R.bad_valences(Molecule("c1ccccc1[N+](=O)[O-]")) == []
    assert R.query_matches(["Q"], "N") and not R.query_matches(["Q", "X"], "C") and R.query_matches(["A", "Br"], "C") and not R.query_matches(["A"], "H")
    assert R.structure_hash(Molecule("CCO")) == R.structure_hash(Molecule("OCC")) != R.structure_hash(Molecule("COC"))
    assert R.orders_from_valences(["C", "C", "N"], [3, 0, 0], [(0, 1), (1, 2)]) == [1, 3]
    ring = [[np.cos(t), np.sin(t), 0.0] for t in np.arange(6) * np.pi / 3]
    xyz = np.array([[1.39 * x, 1.39 * y, 0.0] for x, y, _ in ring] + [[1.39 + 1.22, 0.0, 0.0]])
    assert R.orders_from_lengths(["C"] * 6 + ["O"], xyz, [(k, (k + 1) % 6) for k in range(6)] + [(0, 6)], [list(range(6))]) == ["aromatic"] * 6 + ["double"]
    atoms, bonds = R.with_hydrogens(Molecule("CCO"))
    assert len(atoms) == 9 and len(bonds) == 8 and [b["a"] for b in bonds[2:]] == [0, 0, 0, 1, 1, 2]


def test_cycles_and_paths_by_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        n = rng.randrange(3, 7)
        ends = [e for e in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        near = [[(b if a == i else a, k) for k, (a, b) in enumerate(ends) if i in (a, b)] for i in range(n)]
        have = set(map(frozenset, ends))
        found = set()
        for size in range(3, n + 1):
            for p in itertools.permutations(range(n), size):
                if p[0] == min(p) and all(frozenset((p[k - 1], p[k])) in have for k in range(size)):
                    found.add((tuple(sorted(p)), frozenset(frozenset((p[k - 1], p[k])) for k in range(size))))
        assert sorted(map(tuple, C.all_cycles(near))) == sorted(a for a, _ in found)
        on_cycles = {e for _, es in found for e in es}
        assert C.bridges(near) == [k for k, e in enumerate(ends) if frozenset(e) not in on_cycles]
        for a, b in itertools.combinations(range(n), 2):
            p = C.path_between(near, a, b)
            lengths = [len(q) for size in range(2, n + 1) for q in itertools.permutations(range(n), size) if q[0] == a and q[-1] == b and all(frozenset(x) in have for x in itertools.pairwise(q))]
            assert (p is None) == (not lengths) and (p is None or (len(p) == min(lengths) and all(frozenset(x) in have for x in itertools.pairwise(p))))
    m = Molecule("CCC")
    assert C.path_between(m.near, 0, 2, frozenset({1})) is None and C.path_between_bonds(m.near, m.ends, 0, 1) == [0, 1] and C.induced(m.ends, {0, 1}) == [0] and C.atoms_of(m.ends, [1]) == [1, 2]


def test_longest_carbon_path_by_brute_force():
    def brute(m):
        best = 0

        def walk(i, seen):
            nonlocal best
            best = max(best, len(seen))
            for j, _ in m.near[i]:
                if j not in seen and m.symbol[j] == "C":
                    walk(j, seen | {j})

        for i in range(m.n):
            if m.symbol[i] == "C":
                walk(i, {i})
        return best

    for s in (ASPIRIN, "c1ccc2ccccc2c1CC(C)CC", "C1CC1CCC1CC1", "CCOCC", "O", "C1CC2CCC1CC2C", "CC(C)(C)CC(CC)CCC", "C.CC"):
        assert D.compute(Molecule(s), ["LongestChain"]) == [brute(Molecule(s))], s


def test_fingerprints_by_hand():
    methane, ethane = Molecule("C"), Molecule("CC")
    assert P.path_bits(methane) == [] and P.path_bits(ethane) == [P._hash((6, 1, 6)) % 2048]
    end = P._hash((1, 1.0, 6, None, 0, 0))
    first = P._hash((end, 1, end))
    assert P.morgan_bits(ethane) == sorted({x % 2048 for x in (end, first, P._hash((first, 1, first)))})
    assert P.key_bits(Molecule("CCCl")) == [114] and P.key_bits(Molecule("c1ccccc1O")) == [139, 162, 165] and P.key_bits(Molecule("NS")) == [137, 161]
    assert len(P.path_bits(Molecule("C" * 12))) <= 7


def test_charges_and_places():
    assert G.gasteiger(Molecule("CO")) == [0.1842, -0.1842] and G.gasteiger(Molecule("C")) == [0.0] and sum(G.gasteiger(Molecule("CC(=O)[O-]"))) == pytest.approx(-1, abs=1e-3)
    x = G.embed(Molecule(ASPIRIN))
    assert np.allclose(x, G.embed(Molecule(ASPIRIN))) and all(1.0 < np.linalg.norm(x[a] - x[b]) < 2.2 for a, b in Molecule(ASPIRIN).ends)
    assert G.embed(Molecule("[Na+].[Cl-]")).shape == (2, 3)
    e = G.conformers(Molecule("CCCCO"), 4)
    assert len(e) == 4 and [t for t, _ in e] == sorted(t for t, _ in e)
    v = dict(zip(D.names(), D.compute(Molecule(ASPIRIN), D.names()), strict=True))
    assert v["TPSA"] == pytest.approx(63.6) and v["PPSA1"] + v["PNSA1"] <= v["SASA"] + 1e-9 and D.info("TPSA")["category"] == "hybrid"
    for s in ("C", "[Na+].[Cl-]", "[H][H]", "*"):
        assert np.isfinite(D.compute(Molecule(s), D.names())).all()


def test_force_field():
    f = V.ForceField(Molecule("CC(=O)NC"))
    x = G.embed(Molecule("CC(=O)NC"))
    assert f.energy(x) == pytest.approx(sum(f.terms(x).values()))
    turn = np.linalg.qr(np.random.default_rng(1).normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    assert f.energy(x @ turn.T + 3) == pytest.approx(f.energy(x), abs=1e-6)
    for run in (V.steepest_descent, V.lbfgs):
        y, e, _ = run(f, x + 0.1 * np.sin(np.arange(15)).reshape(5, 3), 25)
        assert e < f.energy(x + 0.1 * np.sin(np.arange(15)).reshape(5, 3)) and e == pytest.approx(f.energy(y))
    r = np.array([3.4])
    assert V.van_der_waals_energy(r, r, np.array([0.06]))[0] == pytest.approx(-0.06, rel=0.02) and V.bond_energy(r, r, r)[0] == 0
    assert V.torsion_energy(np.array([0.0]), np.array([[1.0, 2.0, 3.0]]))[0] == pytest.approx(4.0)
    assert V.exclusions(Molecule("CCCCC")) == {(i, j): j - i for i in range(5) for j in range(i + 1, min(5, i + 4))}
    assert V.optimised(Molecule("C"))[2]


def test_edits(spark):
    from crucible.functions import graphs as H
    from crucible.functions import molecules as M

    m = M.molecules(spark.createDataFrame([(1, "CCCO"), (2, "C"), (3, None)], "mol_id long, smiles string"), "mol_id", "smiles").where("error is null")
    gone = spark.createDataFrame([(1, 1), (1, 1), (9, 0)], "mol_id long, idx int")
    r = {x.mol_id: ([a.symbol for a in x.atoms], [(b.a, b.b) for b in x.bonds]) for x in H.without_atoms(m, gone).collect()}
    assert r == {1: (["C", "C", "O"], [(1, 2)]), 2: (["C"], [])}
    r = {x.mol_id: [(b.idx, b.a, b.b) for b in x.bonds] for x in H.without_bonds(m, gone).collect()}
    assert r == {1: [(0, 0, 1), (1, 2, 3)], 2: []}
    new = spark.createDataFrame([(1, 3, 0, 1), (1, 0, 3, 1), (1, 1, 0, 1), (1, 2, 2, 1), (1, 0, 9, 1)], "mol_id long, a int, b int, order_kek int")
    assert {x.mol_id: [(b.a, b.b) for b in x.bonds] for x in H.with_bonds(m, new).collect()} == {1: [(0, 1), (1, 2), (2, 3), (0, 3)], 2: []}
    o = m.select("mol_id", H.optimised("smiles", 5).alias("o")).collect()
    assert len(o) == 2 and set(o[0].o.terms) >= {"bond", "torsion"}


def test_graph_properties_of_many_molecules_follow_their_definitions(monkeypatch):
    """Molecules of one to several words of atoms are worked on side by side; nothing measures a molecule's distances pair by pair."""
    from crucible.chem.cycles import bridges
    from crucible.chem.matching import maximum_matching
    from crucible.functions.graphs import properties_of

    texts = ["C", "[H][H]", "CCO", "CC(=O)Nc1ccc2cc(O)ccc2c1", "[Na+].[Cl-]", "C1.C1", "C1C3CC3.C2.C12", "C(C1)CC1", "C12C3C4C1C5C2C3C45", "C1CC12CC2.CO", "[Br-].C1CC1CC1CC1", "C" * 64, "OC" + "C" * 63, "N" + "C" * 140 + "1CCCCCC1", "C1" + "C" * 28 + "C1", "C(C)(C)(C)" * 20]
    want = []
    for m in map(Molecule, texts):
        d, h = m.distances(), m.heavy()
        near = [[j for j, _ in x] for x in m.near]
        ends = [i for i in range(len(h)) if len(near[i]) <= 1]
        reach = d[np.isfinite(d)]
        want.append((
            int(reach.max(initial=0)), len({(m.symbol[i], tuple(sorted((float(x), m.symbol[j]) for x, j in zip(d[k], h, strict=True)))) for k, i in enumerate(h)}), int(max((d[i, j] for i in ends for j in ends if np.isfinite(d[i, j])), default=0)),
            len(bridges(m.near)), sum(x >= 0 for x in maximum_matching(near)) // 2, len(set(m._components())),
        ))
    monkeypatch.delattr(Molecule, "distances")
    got = [tuple(p[k] for k in ("diameter", "symmetry_classes", "longest_path_ends", "bridges", "matching", "components")) for p in properties_of([Molecule(x) for x in texts])]
    assert got == want


def test_small_queries_match_as_the_search_does():
    """Embeddings that are listed from a query's rarest bond are those of the search."""
    for text in ("CC(=O)Nc1ccc(C(=O)OC(=O)C)cc1S(=O)(=O)N", "CC(C)(C)C(C)(C)C", "NC(=O)NC(=O)O", "C1CC1C(=O)NC=O", "C"):
        m = Molecule(text)
        for query in ("C(=O)N", "O=COC=O", "CS(=O)(=O)C", "CCCC", "CC(C)(C)C", "C=O", "C", "C.O", "c1ccccc1", "C1CC1", "CCCCCCCCC"):
            q = Molecule(query)
            assert P.match_sets(m, q) == [list(s) for s in sorted({tuple(sorted(x)) for x in P.matches(m, q)})]


def test_equal_texts_of_groups_of_molecules_come_together(spark, tmp_path):
    """Rows of one text lie side by side, so that it is worked on once."""
    from crucible.plans import molecule_queries

    spark.createDataFrame([(k, "CCO" if k % 2 else "C1CC1N", None) for k in range(20)], "mol_id long, smiles string, error string").repartition(4).write.parquet(str(tmp_path / "molecules.parquet"))
    r = molecule_queries.groups_of_molecules(spark, str(tmp_path))
    assert "hashpartitioning(smiles" in r._jdf.queryExecution().executedPlan().toString()
    assert {(x.mol_id % 2, x.scaffold, tuple(x.groups), x.graph.bridges) for x in r.collect()} == {(1, "", ("hydroxyl",), 2), (0, "C1CC1", ("amine",), 1)} and r.count() == 20
