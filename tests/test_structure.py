import math

import numpy as np
import pytest

from crucible.chem import geometry as G
from crucible.chem.graph import Molecule
from crucible.operators import structure as S

ATOMS = "mol_id long, idx int, symbol string, x double, y double, z double, formal_charge int"


def test_kernels():
    assert G.surface([[0, 0, 0]], ["C"])[0] == pytest.approx(4 * math.pi * 3.1**2)
    two = G.surface([[0, 0, 0], [0, 0, 1.5]], ["C", "C"])
    assert two[0] == pytest.approx(two[1], rel=0.05) and two[0] < 4 * math.pi * 3.1**2
    assert G.volume([[0, 0, 0]], ["C"]) == pytest.approx(4 / 3 * math.pi * 1.7**3, rel=0.05)
    rng = np.random.default_rng(0)
    a = rng.normal(size=(9, 3))
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    r, t, e = G.kabsch(a, a @ turn.T + 5)
    assert e < 1e-9 and np.allclose(r, turn) and np.allclose(t, 5)
    b = a @ turn.T
    b[0] += 30
    assert G.superpose(a, b)[2] < 1e-6 and G.superpose(a, b)[3] == 8
    s = G.shape(a, ["C"] * 9)
    assert G.shape(a @ turn.T + 2, ["C"] * 9) == pytest.approx(s)
    assert G.shape(np.zeros((1, 3)), ["C"])["RadiusOfGyration"] == 0
    q = G.gasteiger(Molecule("CC(=O)[O-]"))
    assert sum(q) == pytest.approx(-1, abs=1e-3) and q[3] < q[2] < 0 < q[1]
    assert G.global_align("ACGT", "ACGT") == (4.0, [(0, 0), (1, 1), (2, 2), (3, 3)])
    assert G.global_align("AAAA", "AA", opening=-1)[0] == pytest.approx(0.5) and G.global_align("", "")[1] == []


def test_relations(spark):
    rows = [(1, 0, "C", 0.0, 0.0, 0.0, 0), (1, 1, "O", 0.0, 0.0, 1.43, 0), (1, 2, "N", 0.0, 3.0, 1.43, 1), (1, 3, "C", None, 0.0, 0.0, 0), (2, 0, "C", 0.0, 0.0, 0.0, 0)]
    a = spark.createDataFrame(rows, ATOMS)
    assert [(r.mol_id, r.a, r.b) for r in S.auto_bonds(a).collect()] == [(1, 0, 1)]
    c = S.contacts(a.where("symbol = 'O'"), a.where("symbol = 'N'")).collect()
    assert [(r.idx, r.r_idx, r.kind, r.dist) for r in c] == [(1, 2, "hydrogen bond", 3.0)]
    assert S.atom_surfaces(a).count() == 4 and S.shape_descriptors(a).count() == 2
    assert {r.mol_id: (round(r.rmsd, 6) if r.rmsd is not None else None, r.pairs) for r in S.align_to(a, a).collect()} == {1: (0.0, 3), 2: (None, 1)}
    assert S.auto_bonds(a.limit(0)).count() == 0 and S.shape_descriptors(a.limit(0)).count() == 0


def test_dbscan(spark):
    rows = [(i, 0.1 * i, 0.0) for i in range(6)] + [(10 + i, 50 + 0.1 * i, 0.0) for i in range(6)] + [(99, 9.0, 9.0)]
    got = {r.id: r.cluster for r in S.dbscan(spark.createDataFrame(rows, "id long, x double, y double"), "id", ["x", "y"], 0.25, 3).collect()}
    assert got == {**{i: 0 for i in range(6)}, **{10 + i: 10 for i in range(6)}, 99: -1}
