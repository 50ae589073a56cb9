"""Types, valences, stereo, ranks, groups and named rings of a molecule."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from crucible.chem.elements import Z_OF, element
from crucible.chem.graph import Molecule

# The most bonds, with hydrogens, that an uncharged atom takes.
MOST_BONDS = {"H": 1, "B": 3, "C": 4, "N": 5, "O": 2, "F": 1, "Si": 4, "P": 5, "S": 6, "Cl": 1, "Br": 1, "I": 1, "Se": 6}


def bad_valences(m: Molecule) -> list[int]:
    """Atoms with more bonds and hydrogens than their element and charge allow; an aromatic bond counts 1.5, half a bond is tolerated."""
    out = []
    for i in range(m.n):
        most = MOST_BONDS.get(m.symbol[i])
        if most is not None:
            total = sum(1.5 if m.arom_bond[k] else m.order[k] for _, k in m.near[i]) + m.hydrogens[i]
            if total > most - m.charge[i] + 0.5 and total > most + m.charge[i] + 0.5:
                out.append(i)
    return out


def sybyl_types(m: Molecule) -> list[str]:
    """SYBYL atom types from element, hybridisation, aromaticity and charge."""
    out = []
    for i in range(m.n):
        s, hyb = m.symbol[i], m.hyb[i]
        if m.aromatic[i] and s in ("C", "N", "O", "S"):
            out.append(f"{s}.ar")
        elif s == "C":
            out.append({"sp": "C.1", "sp2": "C.2"}.get(hyb, "C.3"))
        elif s == "N":
            beside_carbonyl = any(m.symbol[j] == "C" and any(m.symbol[x] == "O" and m.order[k] == 2 for x, k in m.near[j]) for j, _ in m.near[i])
            out.append("N.1" if hyb == "sp" else "N.am" if hyb == "sp2" and beside_carbonyl else "N.2" if hyb == "sp2" else "N.4" if m.charge[i] == 1 else "N.3")
        elif s == "O":
            out.append("O.2" if hyb == "sp2" else "O.co2" if m.charge[i] == -1 else "O.3")
        elif s == "S":
            out.append("S.2" if hyb == "sp2" else "S.3")
        elif s == "P":
            out.append("P.3")
        else:
            out.append(s)
    return out


def double_bond_stereo(m: Molecule) -> list[tuple[int, int, str]]:
    """(a, b, E or Z) of the double bonds with a direction mark on both sides; marks are read away from the double bond."""
    out = []
    for k, (a, b) in enumerate(m.ends):
        if m.order[k] != 2 or m.arom_bond[k]:
            continue
        side = []
        for x in (a, b):
            for j, e in m.near[x]:
                mark = m.marks[e]
                if j not in (a, b) and mark:
                    up = (mark == "/") == (m.ends[e][0] == x)  # the neighbour lies above the atom
                    side.append((j, up))
                    break
        if len(side) == 2:
            out.append((a, b, "Z" if side[0][1] == side[1][1] else "E"))
    return out


def priority(m: Molecule, i: int) -> tuple[int, ...]:
    """Element of an atom, then its neighbours' from the highest, a neighbour as often as its bond's order."""
    return (Z_OF.get(m.symbol[i], 0), *sorted((Z_OF.get(m.symbol[j], 0) for j, k in m.near[i] for _ in range(m.order[k])), reverse=True))


def centres(m: Molecule) -> list[tuple[int, str, list[int]]]:
    """(atom, @ or @@, neighbours from the highest priority) of the marked atoms with at least three neighbours and hydrogens."""
    out = []
    for i in range(m.n):
        if m.chiral[i] and len(m.near[i]) + m.hydrogens[i] >= 3:
            out.append((i, "@" if m.chiral[i] == 1 else "@@", sorted((j for j, _ in m.near[i]), key=lambda j: (priority(m, j), -j), reverse=True)))
    return out


def morgan_ranks(m: Molecule) -> list[int]:
    """Degrees, then sums over an atom and its neighbours, as long as the number of different values grows."""
    now, before = [len(x) for x in m.near], 0
    kept = now
    while len(set(now)) > before:
        kept, before = now, len(set(now))
        now = [kept[i] + sum(kept[j] for j, _ in m.near[i]) for i in range(m.n)]
    return kept


def profiles(m: Molecule) -> list[tuple]:
    """Per atom: the sorted symbols of the atoms at each distance, from itself outwards."""
    d = _all_distances(m)
    out = []
    for i in range(m.n):
        layers: dict[int, list[str]] = {}
        for j in range(m.n):
            if d[i][j] >= 0:
                layers.setdefault(d[i][j], []).append(m.symbol[j])
        out.append(tuple(tuple(sorted(layers[k])) for k in sorted(layers)))
    return out


def _all_distances(m: Molecule) -> list[list[int]]:
    out = []
    for s in range(m.n):
        d, todo = [-1] * m.n, [s]
        d[s] = 0
        for x in todo:
            for y, _ in m.near[x]:
                if d[y] < 0:
                    d[y] = d[x] + 1
                    todo.append(y)
        out.append(d)
    return out


def unique_numbers(m: Molecule) -> list[int]:
    """Numbers from 1 in the order of the atoms' profiles; atoms of one profile share a number."""
    p = profiles(m)
    order = {x: k + 1 for k, x in enumerate(sorted(set(p)))}
    return [order[x] for x in p]


def symmetry_classes(m: Molecule) -> list[list[int]]:
    """Atoms of equal profile, classes and atoms in order."""
    classes: dict[tuple, list[int]] = {}
    for i, p in enumerate(profiles(m)):
        classes.setdefault(p, []).append(i)
    return sorted(classes.values())


def structure_hash(m: Molecule) -> str:
    """SHA-1 of the sorted profiles: equal for renumbered molecules."""
    import hashlib

    return hashlib.sha1(repr(sorted(profiles(m))).encode()).hexdigest()


def longest_chain(m: Molecule) -> list[int]:
    """The longest of the shortest paths between two end atoms; of equal ones that of the smallest ends."""
    ends = [i for i in range(m.n) if len(m.near[i]) == 1]
    if m.n < 2:
        return list(range(m.n))
    best: list[int] = []
    for a in ends:
        before, todo = {a: -1}, [a]
        for x in todo:
            for y, _ in sorted(m.near[x]):
                if y not in before:
                    before[y] = x
                    todo.append(y)
        for b in ends:
            if b in before and b != a:
                path, at = [], b
                while at >= 0:
                    path.append(at)
                    at = before[at]
                if len(path) > len(best):
                    best = path[::-1]
    return best


# --- groups and named rings --------------------------------------------------

#: Query symbols that stand for several elements: fixed values.
QUERY: dict[str, Callable[[str], bool]] = {"A": lambda s: s != "H", "Q": lambda s: s not in ("H", "C"), "X": lambda s: s in ("F", "Cl", "Br", "I"), "R": lambda s: True}


def query_matches(query: list[str], symbol: str) -> bool:
    """Whether an element fits any of the symbols, of which A is any but H, Q any but H and C, X a halogen and R any."""
    return any(q == symbol or (q in QUERY and QUERY[q](symbol)) for q in query)


#: Functional groups by the fragment they are found by, the more specific first: fixed values.
GROUPS = {
    "carboxylic anhydride": "O=COC=O", "acyl halide": "ClC=O", "carbamate": "NC(=O)O", "urea": "NC(=O)N", "ester": "O=COC", "carboxylic acid": "O=CO", "amide": "NC=O", "sulfonamide": "NS(=O)=O", "sulfone": "CS(=O)(=O)C", "sulfoxide": "CS(=O)C",
    "nitrile": "C#N", "nitro": "O=[N+][O-]", "azo": "N=N", "imine": "C=N", "ketone": "CC(=O)C", "carbonyl": "C=O", "ether": "COC", "hydroxyl": "CO", "thioether": "CSC", "thiol": "CS", "amine": "CN", "alkyne": "C#C", "alkene": "C=C", "halide": "CX",
}


def functional_groups(m: Molecule) -> list[tuple[str, list[int]]]:
    """(group, atoms): the groups that stand in the molecule; atoms that a more specific group holds whole aren't named again.

    A hydroxyl, an acid and a thiol need their hydrogen, an ether, ester and ketone have none there.
    """
    from crucible.chem.patterns import match_sets

    taken: dict[int, list[set[int]]] = {}  # by atom
    flat = [x and len(m.near[i]) < 3 for i, x in enumerate(m.aromatic)]
    halogens = {s for s in set(m.symbol) if query_matches(["X"], s)}
    out = []
    for name, fragment in GROUPS.items():
        for atoms in match_sets(m, _fragment(fragment)) if "X" not in fragment else [[min(i, j), max(i, j)] for i, s in enumerate(m.symbol) if s in halogens for j, _ in m.near[i] if m.symbol[j] == "C"]:
            own = set(atoms)
            if any(own <= t for t in taken.get(atoms[0], ())) or (name != "halide" and any(flat[i] for i in atoms)):
                continue
            if name in ("hydroxyl", "carboxylic acid", "thiol"):
                s = "S" if name == "thiol" else "O"
                if not any(m.symbol[i] == s and m.hydrogens[i] and len(m.near[i]) == 1 for i in atoms):
                    continue
            for i in atoms:
                taken.setdefault(i, []).append(own)
            out.append((name, sorted(own)))
    return sorted(out, key=lambda x: (x[1], x[0]))


_FRAGMENTS: dict[str, Molecule] = {}


def _fragment(smiles: str) -> Molecule:
    if smiles not in _FRAGMENTS:
        _FRAGMENTS[smiles] = Molecule(smiles)
    return _FRAGMENTS[smiles]


def named_rings(m: Molecule) -> list[tuple[str, list[int]]]:
    """(name, atoms) of every ring: its size, whether aromatic, and its elements other than carbon in alphabetical order."""
    out = []
    for ring, bonds in zip(m.rings, m.ring_bonds, strict=True):
        kind = "aromatic" if all(m.arom_bond[k] for k in bonds) else "saturated" if all(m.order[k] == 1 for k in bonds) else "unsaturated"
        hetero = "".join(sorted(m.symbol[i] for i in ring if m.symbol[i] != "C"))
        out.append((f"{len(ring)} {kind}{' ' + hetero if hetero else ''}", sorted(ring)))
    return sorted(out, key=lambda x: (x[1], x[0]))


# --- edits ------------------------------------------------------------------


def with_hydrogens(m: Molecule) -> tuple[list[dict], list[dict]]:
    """Atoms and bonds with every hydrogen as an atom of its own, after the others, in the order of the atoms they are on."""
    atoms = [dict(idx=i, symbol=m.symbol[i], formal_charge=m.charge[i], isotope=m.isotope[i] or None, n_h=0, aromatic=m.aromatic[i], hyb=m.hyb[i]) for i in range(m.n)]
    bonds = [dict(idx=k, a=a, b=b, order_kek=m.order[k], aromatic=m.arom_bond[k], in_ring=m.ring_bond[k]) for k, (a, b) in enumerate(m.ends)]
    for i in range(m.n):
        for _ in range(m.hydrogens[i]):
            bonds.append(dict(idx=len(bonds), a=i, b=len(atoms), order_kek=1, aromatic=False, in_ring=False))
            atoms.append(dict(idx=len(atoms), symbol="H", formal_charge=0, isotope=None, n_h=0, aromatic=False, hyb="s"))
    return atoms, bonds


def orders_from_lengths(symbols: list[str], xyz: np.ndarray, bonds: list[tuple[int, int]], rings: list[list[int]]) -> list[str]:
    """single, double, triple or aromatic for each bond by its length; rings of five or six C, N, O, S atoms with all bonds from 1.28 to 1.48 are aromatic."""
    d = [float(np.linalg.norm(np.asarray(xyz[a], float) - np.asarray(xyz[b], float))) for a, b in bonds]
    at = {frozenset(e): k for k, e in enumerate(bonds)}
    flat = set()
    for r in rings:
        own = [at.get(frozenset((r[i - 1], r[i]))) for i in range(len(r))]
        if len(r) in (5, 6) and all(symbols[i] in ("C", "N", "O", "S") for i in r) and all(k is not None and 1.28 <= d[k] <= 1.48 for k in own):
            flat |= set(own)
    # Below which length a bond between two elements is double, and triple
    limits = {("C", "C"): (1.40, 1.25), ("C", "N"): (1.36, 1.18), ("C", "O"): (1.28, 0.0), ("N", "N"): (1.28, 0.0), ("N", "O"): (1.28, 0.0), ("O", "S"): (1.50, 0.0)}
    out = []
    for k, (a, b) in enumerate(bonds):
        two, three = limits.get(tuple(sorted((symbols[a], symbols[b]))), (0.0, 0.0))
        out.append("aromatic" if k in flat else "triple" if d[k] < three else "double" if d[k] < two else "single")
    return out


def orders_from_valences(symbols: list[str], hydrogens: list[int], bonds: list[tuple[int, int]]) -> list[int]:
    """Bond orders that fill the atoms' lowest valences: maximum matchings of the atoms with valences free, one order at a time."""
    from crucible.chem.matching import maximum_matching

    room = [(element(s).valences[0] if element(s) else 0) - h for s, h in zip(symbols, hydrogens, strict=True)]
    order = [1] * len(bonds)
    for a, b in bonds:
        room[a] -= 1
        room[b] -= 1
    for _ in range(2):
        links = [[b if a == i else a for a, b in bonds if i in (a, b) and room[a] > 0 and room[b] > 0] for i in range(len(symbols))]
        mate = maximum_matching(links)
        for k, (a, b) in enumerate(bonds):
            if mate[a] == b and order[k] < 3:
                order[k] += 1
                room[a] -= 1
                room[b] -= 1
    return order
