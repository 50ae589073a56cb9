"""A molecule with Kekulé bonds, hydrogens, rings, aromaticity and hybridisation perceived.

Rings are the shortest cycle through each bond, smallest first, kept while they bring a bond not yet in a kept ring, up to
20 atoms. Aromatic are rings of planar atoms with 4n+2 pi electrons. Fragments stay separate.
"""

from __future__ import annotations

from collections import deque

import numpy as np

from crucible.chem.cycles import bridges
from crucible.chem.elements import MASS
from crucible.chem.matching import maximum_matching
from crucible.chem.smiles import SmilesError, read, total_hydrogens

RING_CAP = 20
#: The kept rings of a part by its bonds, with atoms numbered in their order, and how many forms a worker keeps.
_FORMS: dict[tuple, list[list[int]]] = {}
FORMS_KEPT = 50_000


def _rings_of(n: int, ends: list[tuple[int, int]]) -> list[list[int]]:
    """The kept rings of a part of n atoms."""
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for k, (a, b) in enumerate(ends):
        near[a].append((b, k))
        near[b].append((a, k))
    found = {}
    for k, (a, b) in enumerate(ends):
        before, todo, depth = {a: -1}, deque([a]), {a: 1}
        while todo and b not in before:
            i = todo.popleft()
            if depth[i] >= RING_CAP:
                break
            for j, e in near[i]:
                if e != k and j not in before:
                    before[j], depth[j] = i, depth[i] + 1
                    todo.append(j)
        if b in before:
            ring, i = [], b
            while i >= 0:
                ring.append(i)
                i = before[i]
            found.setdefault(frozenset(ring), ring)
    seen, out = set(), []
    for ring in sorted(found.values(), key=lambda r: (len(r), sorted(r))):
        edges = {frozenset((ring[i - 1], ring[i])) for i in range(len(ring))}
        if not edges <= seen:
            seen |= edges
            out.append(ring)
    return out


class Molecule:
    """Per atom: symbol, charge, isotope, hydrogens, aromatic, hyb. Bonds are (a, b, order, aromatic); near lists (neighbour, bond)."""

    def __init__(self, smiles: str):
        g = read(smiles)
        self.symbol, self.charge, self.isotope, self.chiral = g.symbol, g.charge, g.isotope, g.chiral
        self.hydrogens = total_hydrogens(g)
        self.n = len(g)
        self.near: list[list[tuple[int, int]]] = [[] for _ in range(self.n)]
        for i, (a, b, *_) in enumerate(g.bonds):
            self.near[a].append((b, i))
            self.near[b].append((a, i))
        self.ends = [(a, b) for a, b, *_ in g.bonds]
        self.order = [o for _, _, o, _, _ in g.bonds]
        self.marks = [x for *_, x in g.bonds]
        self._kekulise(g)
        self._span()
        self.rings = self._rings()
        self.ring_bond = [False] * len(self.ends)
        index = {}
        for k in self.cyclic_bonds:
            x, y = self.ends[k]
            index[x, y] = index[y, x] = k
        self.ring_bonds = [[index[r[k - 1], r[k]] for k in range(len(r))] for r in self.rings]
        for bonds in self.ring_bonds:
            for i in bonds:
                self.ring_bond[i] = True
        self._aromatise()
        self.hyb = self._hybrids()

    def _kekulise(self, g) -> None:
        """Double bonds between aromatic atoms: a maximum matching of the atoms that need one; all must be met."""
        if not any(g.aromatic):
            return
        links: list[list[int]] = [[] for _ in range(self.n)]
        sigma = [0] * self.n
        for a, b, o, arom, _ in g.bonds:
            sigma[a] += o
            sigma[b] += o
            if arom:
                links[a].append(b)
                links[b].append(a)

        def needs(i: int) -> bool:
            s, used = self.symbol[i], sigma[i] + self.hydrogens[i]
            if s == "C":
                return used + abs(self.charge[i]) <= 3
            if s in ("N", "P", "As"):
                return used - self.charge[i] <= 2
            if s in ("O", "S", "Se", "Te"):
                return self.charge[i] > 0 and used <= 2
            return s == "B" and used <= 2

        need = [i for i in range(self.n) if links[i] and needs(i)]
        at = {i: k for k, i in enumerate(need)}
        mate = maximum_matching([[at[j] for j in links[i] if j in at] for i in need])
        if -1 in mate:
            raise SmilesError("no Kekulé structure")
        pairs = {(need[k], need[m]) for k, m in enumerate(mate)}
        for k, e in enumerate(self.ends):
            if e in pairs:
                self.order[k] = 2

    def _span(self) -> None:
        """component, the smallest atom of each atom's fragment, and cyclic_bonds, those that aren't bridges, in order.

        The first bond to an earlier atom is an atom's bond in a spanning tree; every other bond closes a cycle with the tree.
        Where a ring digit joins parts that the tree holds apart, both are searched for.
        """
        n, ends = self.n, self.ends
        up, via, rest = [-1] * n, [-1] * n, []
        for k, (a, b) in enumerate(ends):
            if a < b and up[b] < 0:
                up[b], via[b] = a, k
            else:
                rest.append(k)
        self.component = out = list(range(n))
        for i, a in enumerate(up):
            if a >= 0:
                out[i] = out[a]
        inside = set(rest)
        for k in rest:
            a, b = ends[k]
            if out[a] != out[b]:
                self.component = self._components()
                inside = set(range(len(ends))).difference(bridges(self.near))
                break
            while a != b:
                if a > b:
                    inside.add(via[a])
                    a = up[a]
                else:
                    inside.add(via[b])
                    b = up[b]
        self.cyclic_bonds = sorted(inside)

    def _components(self) -> list[int]:
        out = [-1] * self.n
        for s in range(self.n):
            if out[s] < 0:
                out[s], todo = s, [s]
                while todo:
                    for j, _ in self.near[todo.pop()]:
                        if out[j] < 0:
                            out[j] = s
                            todo.append(j)
        return out

    def _rings(self) -> list[list[int]]:
        """The kept rings of each part that cyclic bonds join; parts of one form are worked on once a worker."""
        near: dict[int, list[int]] = {}
        for k in self.cyclic_bonds:
            a, b = self.ends[k]
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        part: dict[int, int] = {}
        atoms: list[list[int]] = []
        for s in near:
            if s not in part:
                part[s], own = len(atoms), [s]
                for x in own:
                    for y in near[x]:
                        if y not in part:
                            part[y] = len(atoms)
                            own.append(y)
                atoms.append(sorted(own))
        at = {i: k for own in atoms for k, i in enumerate(own)}
        bonds: list[list[tuple[int, int]]] = [[] for _ in atoms]
        for k in self.cyclic_bonds:
            a, b = self.ends[k]
            bonds[part[a]].append((at[a], at[b]))
        out = []
        for own, e in zip(atoms, bonds, strict=True):
            form = tuple(e)
            rings = _FORMS.get(form)
            if rings is None:
                if len(_FORMS) >= FORMS_KEPT:
                    _FORMS.clear()
                rings = _FORMS[form] = _rings_of(len(own), e)
            out += [[own[i] for i in r] for r in rings]
        return sorted(out, key=lambda r: (len(r), sorted(r)))

    def cyclic(self) -> list[int]:
        """Atoms on a cycle of any size, also those that no kept ring holds."""
        return sorted({i for k in self.cyclic_bonds for i in self.ends[k]})

    def _aromatise(self) -> None:
        self.aromatic, self.arom_bond = [False] * self.n, [False] * len(self.ends)
        several: dict[int, list[tuple[int, int, int]]] = {}  # the double and triple bonds of atoms that have some
        for k, o in enumerate(self.order):
            if o == 2 or o == 3:
                a, b = self.ends[k]
                several.setdefault(a, []).append((o, b, k))
                several.setdefault(b, []).append((o, a, k))
        self.several = several
        for ring, bonds in zip(self.rings, self.ring_bonds, strict=True):
            inside, electrons, planar = set(ring), 0, True
            for i in ring:
                own = several.get(i)
                if own is None:
                    if self.symbol[i] in ("N", "O", "S", "P", "Se"):
                        electrons += 2
                    else:
                        planar = False
                elif any(o == 3 for o, _, _ in own):
                    planar = False
                elif any(j in inside or self.ring_bond[k] for _, j, k in own):
                    electrons += 1
                elif self.symbol[i] != "C":
                    planar = False
                if not planar:
                    break
            if planar and 3 <= len(ring) <= 22 and electrons % 4 == 2:
                for i in ring:
                    self.aromatic[i] = True
                for k in bonds:
                    self.arom_bond[k] = True

    def _hybrids(self) -> list[str]:
        out = ["sp2" if x else "sp3" for x in self.aromatic]
        for i, own in self.several.items():
            orders = [o for o, _, _ in own]
            if 3 in orders or (len(orders) >= 2 and len(self.near[i]) == 2):
                out[i] = "sp"
            else:
                out[i] = "sp2"
        return out

    # --- shared kernels -------------------------------------------------

    def heavy(self) -> list[int]:
        return [i for i in range(self.n) if self.symbol[i] != "H"]

    def adjacency(self) -> np.ndarray:
        """Of the heavy atoms, in their order."""
        h = self.heavy()
        at = {i: k for k, i in enumerate(h)}
        a = np.zeros((len(h), len(h)))
        for x, y in self.ends:
            if x in at and y in at:
                a[at[x], at[y]] = a[at[y], at[x]] = 1
        return a

    def distances(self) -> np.ndarray:
        """Shortest paths between heavy atoms; infinite between fragments."""
        h = self.heavy()
        at = {i: k for k, i in enumerate(h)}
        near = [[at[y] for y, _ in self.near[i] if y in at] for i in h]
        d, inf = np.empty((len(h), len(h))), float("inf")
        for s in range(len(h)):
            row = [inf] * len(h)
            row[s], front, k = 0, [s], 0
            while front:
                k, new = k + 1, []
                for x in front:
                    for y in near[x]:
                        if row[y] is inf:
                            row[y] = k
                            new.append(y)
                front = new
            d[s] = row
        return d

    def weight(self) -> float:
        """An isotope weighs its mass number."""
        return sum(i or MASS.get(s, 0.0) for s, i in zip(self.symbol, self.isotope, strict=True)) + 1.008 * sum(self.hydrogens)

    def formula(self) -> str:
        """Hill order: C, H, then the others by name; all by name without C."""
        count: dict[str, int] = {}
        for s, h in zip(self.symbol, self.hydrogens, strict=True):
            count[s] = count.get(s, 0) + 1
            if h:
                count["H"] = count.get("H", 0) + h
        names = sorted(count, key=lambda s: (0, s) if "C" in count and s in ("C", "H") else (1, s))
        return "".join(f"{s}{count[s] if count[s] > 1 else ''}" for s in names)
