"""Reader, perception, identity and descriptors against closed forms and known molecules."""

import math

import pytest

from crucible.chem import descriptors as D
from crucible.chem import patterns as P
from crucible.chem.graph import Molecule
from crucible.chem.identity import molecule_keys
from crucible.chem.smiles import SmilesError, read

ASPIRIN = "CC(=O)Oc1ccccc1C(=O)O"


def value(smiles, *names):
    v = D.compute(Molecule(smiles), list(names))
    return v[0] if len(v) == 1 else v


@pytest.mark.parametrize("text", ["", "  ", "CC(=O", "C1CCC", "c1cccc1", "*(", "see file", "C==C", "[Xx]", "C)C", "C1C1"])
def test_rejected(text):
    with pytest.raises((SmilesError, KeyError)):
        Molecule(text)


def test_known_molecules():
    assert Molecule(ASPIRIN).formula() == "C9H8O4"
    assert value(ASPIRIN, "MolecularWeight") == pytest.approx(180.159, abs=1e-3)
    assert Molecule("Cn1cnc2c1c(=O)n(C)c(=O)n2C").formula() == "C8H10N4O2"
    assert Molecule("C%12CCCCC%12").formula() == "C6H12"
    assert len(read(" C C ")) == 2


def test_identity():
    same = ["c1ccccc1O", "OC1=CC=CC=C1", "[OH]c1ccccc1.Cl", "[O-]c1ccccc1.[Na+]", "[2H]c1ccccc1O", "C%10=CC=CC=C%10O", " Oc1ccccc1 "]
    keys = molecule_keys(same)
    assert len(set(keys)) == 1 and keys[0]
    other = molecule_keys(["C1CCC2CCCCC2C1", "C1CCCC1C1CCCC1", "Oc1ccccn1", "O=c1cccc[nH]1", "C[C@H](N)O", "C[C@@H](N)O", None, "", "see file"])
    assert len(set(other[:4])) == 4 and other[4] == other[5] and other[6:] == [None, None, None]
    assert molecule_keys(["C[N+](C)(C)C"]) != molecule_keys(["CN(C)C"])
    assert molecule_keys(["C[NH3+]"]) == molecule_keys(["CN"])


@pytest.mark.parametrize("n", [1, 2, 3, 7, 25])
def test_chains(n):
    w, z, h, k = value("C" * n, "WienerIndex", "ZagrebIndex1", "HararyIndex", "KirchhoffIndex")
    assert w == n * (n * n - 1) / 6 and z == (0 if n == 1 else 2 if n == 2 else 4 * n - 6)
    assert h == pytest.approx(sum((n - d) / d for d in range(1, n))) and k == pytest.approx(w)


@pytest.mark.parametrize("n", [3, 6, 20, 25])
def test_rings(n):
    w, z, t, r, c = value("C1" + "C" * (n - 2) + "C1", "WienerIndex", "ZagrebIndex1", "LogSpanningTreeCount", "RingCount", "CyclomaticNumber")
    assert (w, z, r, c) == (n * (n * n // 4) / 2, 4 * n, n <= 20, 1) and t == pytest.approx(math.log10(n))


def test_hueckel_delocalisation():
    assert value("c1ccccc1", "DelocalizationEnergy") == pytest.approx(2.0)
    assert value("C=CC=C", "DelocalizationEnergy") == pytest.approx(0.4721, abs=1e-3)
    assert value("C=C", "DelocalizationEnergy") == pytest.approx(0.0)


def test_groups():
    assert value(ASPIRIN, "EsterBondCount", "CarboxylGroupCount", "AromaticRingCount") == [1, 1, 1]
    assert value("CC(C)=O", "KetoneCount") == 1 and value("CC=O", "AldehydeCount") == 1 and value("CC#N", "NitrileCount") == 1
    assert value("CS(=O)(=O)N", "SulfonamideCount") == 1 and value("NC(N)=O", "UreaCount") == 1 and value("COC", "EtherCount") == 1
    assert value("C.C", "FragmentCount") == 2 and value("C1CC11CC1", "SpiroAtomCount") == 1


def test_atom_order_does_not_matter():
    names = D.names(tuple(f for f in D.FAMILIES if f != "space"))  # places are told apart by the atoms' order
    a, b = D.compute(Molecule("CC(N)C(=O)Oc1ccncc1"), names), D.compute(Molecule("n1ccc(cc1)OC(=O)C(C)N"), names)
    bad = [n for n, x, y in zip(names, a, b) if abs(x - y) > 1e-9 * max(1, abs(x))]
    assert not bad


def test_substructures_and_scaffold():
    q = Molecule("CCO")
    assert P.match_sets(Molecule("OCCO"), q) == [[0, 1, 2], [1, 2, 3]]
    assert P.match_sets(Molecule("c1ccccc1"), Molecule("c1ccccc1")) == [[0, 1, 2, 3, 4, 5]]
    assert P.match_sets(Molecule("C1CCCCC1"), Molecule("c1ccccc1")) == []
    assert Molecule(P.scaffold(Molecule("CCc1ccccc1CC2CC2"))).n == 10 and P.scaffold(Molecule("CCC")) == ""
    assert P.morgan_bits(Molecule("OCC")) == P.morgan_bits(Molecule("CCO"))
    assert P.path_bits(Molecule("OCC")) == P.path_bits(Molecule("CCO"))
    for s in (ASPIRIN, "C[N+](=O)[O-]", "[13CH4]", "C1CC1C#N.[Na+].[Cl-]", "c1ccc2[nH]ccc2c1", "[P]", "CC(C)(C)C(F)(F)F"):
        assert molecule_keys([P.write_smiles(Molecule(s))]) == molecule_keys([s])


def test_identity_is_exact_for_large_rings_and_symmetric_skeletons():
    for tail in ("", "C" * 387):  # 18 and 405 atoms
        a, b = molecule_keys([tail + "C12CCCCCCCCC1CCCCCCCC2", tail + "C1CCCCCCCC1C1CCCCCCCC1"])
        assert a and b and a != b
    for n in (30, 2000):
        ring, two = molecule_keys(["C1" + "C" * (n - 2) + "C1", "C1" + "C" * (n - 3) + "C1C"])
        assert ring != two
    assert molecule_keys(["C1OCCCCNC1"]) == molecule_keys(["N1CCCCOCC1"]) != molecule_keys(["C1OCCCNCC1"])


def test_identity_does_not_depend_on_the_order_of_atoms():
    import random

    from crucible.chem import identity as I

    rng = random.Random(4)
    cubane, star = "C12C3C4C1C5C2C3C45", "c1ccc(cc1)-c1c(-c2ccccc2)c(-c2ccccc2)c(-c2ccccc2)c(-c2ccccc2)c1-c1ccccc1"
    for s in (cubane, star, "Cc1ccc(C)cc1", "C1CC2CCC1CC2", "FC(F)(F)C(C(F)(F)F)C(F)(F)F", "C1CCCCCCCCC1", "C1CC1C1CC1", ASPIRIN):
        code, pairs = I.skeleton(read(s), False)[0]
        for _ in range(4):
            to = list(range(len(code)))
            rng.shuffle(to)
            moved = [0] * len(code)
            for i, x in enumerate(code):
                moved[to[i]] = x
            assert I._refine([(moved, rng.sample([(to[a], to[b]) for a, b in pairs], len(pairs)))]) == I._refine([(code, pairs)]), s


def test_identity_tells_all_small_cubic_graphs_apart():
    import itertools

    from crucible.chem import identity as I

    def isomorphic(p, q):
        q = {frozenset(e) for e in q}
        return any(all(frozenset((w[a], w[b])) in q for a, b in p) for w in itertools.permutations(range(6)))

    edges = list(itertools.combinations(range(6), 2))
    graphs = [g for k in (6, 7) for g in itertools.combinations(edges, k) if len({v for e in g for v in e}) == 6][::97]
    keys = [I._refine([([7] * 6, list(g))])[0] for g in graphs]
    for (i, g), (j, h) in itertools.combinations(list(enumerate(graphs))[:40], 2):
        assert (keys[i] == keys[j]) == (len(g) == len(h) and isomorphic(g, h)), (g, h)


def test_matching_is_maximum():
    import itertools
    import random

    from crucible.chem.matching import maximum_matching

    def best(edges):
        return max((len(s) for k in range(4, 0, -1) for s in itertools.combinations(edges, k) if len({v for e in s for v in e}) == 2 * len(s)), default=0)

    rng = random.Random(0)
    for _ in range(150):
        edges = [e for e in itertools.combinations(range(8), 2) if rng.random() < 0.3]
        links = [[b if a == i else a for a, b in edges if i in (a, b)] for i in range(8)]
        mate = maximum_matching(links)
        assert all(m < 0 or (mate[m] == i and m in links[i]) for i, m in enumerate(mate)) and sum(m >= 0 for m in mate) == 2 * best(edges)
    path = [[j for j in (i - 1, i + 1) if 0 <= j < 80] for i in range(80)]
    assert -1 not in maximum_matching(path)
