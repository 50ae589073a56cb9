"""Fingerprints, substructure search, scaffolds and writing of line notations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from crucible.chem.elements import Z_OF
from crucible.chem.graph import Molecule
from crucible.chem.smiles import NORMAL


def _hash(values) -> int:
    """First four bytes of the MD5 of the numbers joined by commas."""
    return int.from_bytes(hashlib.md5(",".join(map(str, values)).encode()).digest()[:4], "little")


def morgan_bits(m: Molecule, radius: int = 2, bits: int = 2048) -> list[int]:
    """Set bits of a circular fingerprint.

    An atom starts with the hash of its number of bonds, the sum of their orders, element, isotope, charge and whether it
    lies in a ring; in each round it takes the hash of its own number and its neighbours' (bond order, number) in order. An
    aromatic bond has the order 1.5, of which sums keep the half and the rounds the whole part.
    """
    inside = {i for r in m.rings for i in r}
    order = [1.5 if m.arom_bond[k] else float(o) for k, o in enumerate(m.order)]
    own = []
    for i in range(m.n):
        total = sum(order[k] for _, k in m.near[i])
        own.append(_hash((len(m.near[i]), total, Z_OF.get(m.symbol[i], 0), m.isotope[i] or None, m.charge[i], int(i in inside))))
    seen = set(own)
    for _ in range(radius):
        own = [_hash((own[i], *(x for o, n in sorted((order[k], own[j]) for j, k in m.near[i]) for x in (int(o), n)))) for i in range(m.n)]
        seen.update(own)
    return sorted({h % bits for h in seen})


def path_bits(m: Molecule, shortest: int = 1, longest: int = 7, bits: int = 2048) -> list[int]:
    """Set bits of a topological fingerprint: simple paths of that many bonds as elements and bond kinds in turn, in the smaller direction.

    A bond's kind is the whole part of its order, and 10 more for an aromatic one.
    """
    found: set[tuple[int, ...]] = set()
    code = [Z_OF.get(s, 0) for s in m.symbol]
    kind = [11 if m.arom_bond[k] else o for k, o in enumerate(m.order)]
    for start in range(m.n):
        todo: list[tuple[tuple[int, ...], tuple[int, ...]]] = [((start,), (code[start],))]
        while todo:
            path, seen = todo.pop()
            if len(path) > shortest:
                found.add(min(seen, seen[::-1]))
            if len(path) <= longest:
                todo += [((*path, j), (*seen, kind[k], code[j])) for j, k in m.near[path[-1]] if j not in path]
    return sorted({_hash(p) % bits for p in found})


#: Structural keys that can be set, by number: fixed values.
KEYS = {
    114: lambda m: not {"F", "Cl", "Br", "I"}.isdisjoint(m.symbol),
    137: lambda m: "S" in m.symbol,
    139: lambda m: "O" in m.symbol,
    142: lambda m: "P" in m.symbol,
    161: lambda m: "N" in m.symbol,
    162: lambda m: bool(m.rings),
    165: lambda m: any(m.aromatic),
}


def key_bits(m: Molecule) -> list[int]:
    return [k for k, f in KEYS.items() if f(m)]


def matches(m: Molecule, q: Molecule) -> Iterator[tuple[int, ...]]:
    """Atoms of m, in the order of q's, of every embedding of q: equal symbols, aromatic to aromatic, bond orders equal or both aromatic."""
    if q.n == 0 or q.n > m.n:
        return
    order, seen = [], set()
    for s in range(q.n):  # connected order, so each new atom hangs on a placed one
        if s in seen:
            continue
        todo = [s]
        seen.add(s)
        while todo:
            i = todo.pop(0)
            order.append(i)
            for j, _ in q.near[i]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
    place, used = [-1] * q.n, set()
    links = [{j: k for j, k in x} for x in m.near]

    def fits(i: int, x: int) -> bool:
        if x in used or m.symbol[x] != q.symbol[i] or (q.aromatic[i] and not m.aromatic[x]) or len(m.near[x]) < len(q.near[i]):
            return False
        for j, k in q.near[i]:
            if place[j] >= 0:
                e = links[x].get(place[j])
                if e is None or not (m.arom_bond[e] if q.arom_bond[k] else m.order[e] == q.order[k] and not m.arom_bond[e]):
                    return False
        return True

    def extend(k: int) -> Iterator[tuple[int, ...]]:
        if k == len(order):
            yield tuple(place)
            return
        i = order[k]
        anchor = next((place[j] for j, _ in q.near[i] if place[j] >= 0), None)
        for x in (j for j, _ in m.near[anchor]) if anchor is not None else range(m.n):
            if fits(i, x):
                place[i] = x
                used.add(x)
                yield from extend(k + 1)
                place[i] = -1
                used.discard(x)

    yield from extend(0)


#: Atoms of the largest query whose embeddings are listed step by step; larger ones, and any with rings or aromatic bonds, are searched for by `matches`.
LISTED = 8


def _plans(q: Molecule) -> list[tuple[tuple, list[tuple[int, str, int]]]] | None:
    """For each bond of a small query without rings to start from: its (symbol, order, symbol), then (place of the atom it hangs on, symbol, order) of each further atom; None for other queries."""
    if "plans" not in q.__dict__:
        q.plans = None
        if 2 <= q.n <= LISTED and len(q.ends) == q.n - 1 and len(set(q.component)) == 1 and not any(q.aromatic):
            q.plans = []
            for e, (a, b) in enumerate(q.ends):
                placed, steps = [a, b], []
                for i in placed:
                    for j, k in q.near[i]:
                        if j not in placed:
                            steps.append((placed.index(i), q.symbol[j], q.order[k]))
                            placed.append(j)
                q.plans.append(((q.symbol[a], q.order[e], q.symbol[b]), steps))
    return q.plans


def _kinds(m: Molecule) -> dict[tuple, list[tuple[int, int]]]:
    """The bonds that aren't aromatic, in both directions, by (symbol, order, symbol)."""
    if "kinds" not in m.__dict__:
        m.kinds = out = {}
        symbol = m.symbol
        for (a, b), o, flat in zip(m.ends, m.order, m.arom_bond, strict=True):
            if not flat:
                out.setdefault((symbol[a], o, symbol[b]), []).append((a, b))
                out.setdefault((symbol[b], o, symbol[a]), []).append((b, a))
    return m.kinds


def match_sets(m: Molecule, q: Molecule) -> list[list[int]]:
    """The distinct atom sets that match, each sorted."""
    plans = _plans(q)
    if plans is None:
        return [list(s) for s in sorted({tuple(sorted(x)) for x in matches(m, q)})]
    kinds, found, rest = _kinds(m), None, []
    for kind, steps in plans:  # from the rarest bond
        got = kinds.get(kind)
        if got is None:
            return []
        if found is None or len(got) < len(found):
            found, rest = got, steps
    for at, s, o in rest:
        found = [(*x, j) for x in found for j, k in m.near[x[at]] if m.symbol[j] == s and m.order[k] == o and not m.arom_bond[k] and j not in x]
    return [list(s) for s in sorted({tuple(sorted(x)) for x in found})]


def write_smiles(m: Molecule, atoms: list[int] | None = None) -> str:
    """A SMILES of the molecule, or of the part on the given atoms, with Kekulé bonds; atoms start from the smallest number."""
    keep = set(range(m.n)) if atoms is None else set(atoms)
    whole = atoms is None
    seen: set[int] = set()
    ring_no: dict[int, list[tuple[int, int]]] = {}
    counter = 0
    organic = {"B", "C", "N", "O", "P", "S", "F", "Cl", "Br", "I"}
    mark = {1: "", 2: "=", 3: "#", 4: "$"}

    tree: dict[int, list[tuple[int, int]]] = {}
    roots, used = [], set()
    for s in sorted(keep):
        if s in seen:
            continue
        roots.append(s)
        seen.add(s)
        stack = [(s, iter(m.near[s]))]
        while stack:
            i, it = stack[-1]
            for j, k in it:
                if j not in keep or k in used:
                    continue
                used.add(k)
                if j in seen:
                    counter += 1
                    ring_no.setdefault(i, []).append((counter, k))
                    ring_no.setdefault(j, []).append((counter, k))
                else:
                    seen.add(j)
                    tree.setdefault(i, []).append((j, k))
                    stack.append((j, iter(m.near[j])))
                    break
            else:
                stack.pop()

    def atom(i: int) -> str:
        s = m.symbol[i]
        if s in organic and not m.charge[i] and not m.isotope[i]:
            if not whole:
                return s
            used = sum(m.order[k] for _, k in m.near[i])
            if next((v - used for v in NORMAL.get(s, ()) if v >= used), 0) == m.hydrogens[i]:
                return s
        h = m.hydrogens[i] if whole else 0
        q = m.charge[i]
        return f"[{m.isotope[i] or ''}{s}{'H' + (str(h) if h > 1 else '') if h else ''}{'' if not q else ('+' if q > 0 else '-') + (str(abs(q)) if abs(q) > 1 else '')}]"

    def digits(i: int) -> str:
        return "".join(mark[m.order[k]] + (str(n) if n < 10 else f"%{n % 100:02d}") for n, k in ring_no.get(i, ()))

    def text(root: int) -> str:
        out: list[str] = []
        todo: list = [root]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            out.append(atom(x) + digits(x))
            kids = tree.get(x, [])
            for n, (j, k) in enumerate(reversed(kids)):
                if n == 0:
                    todo += [j, mark[m.order[k]]]
                else:
                    todo += [")", j, mark[m.order[k]], "("]
        return "".join(out)

    return ".".join(text(r) for r in roots)


def scaffold_atoms(m: Molecule) -> list[int]:
    """What is left of the heavy atoms when ends are pruned until none is left; empty for an acyclic molecule."""
    alive = [s != "H" for s in m.symbol]
    degree = [len(x) for x in m.near] if all(alive) else [sum(alive[j] for j, _ in x) for x in m.near]
    ends = [i for i, x in enumerate(degree) if x <= 1]
    while ends:
        i = ends.pop()
        if not alive[i]:
            continue
        alive[i] = False
        for j, _ in m.near[i]:
            if alive[j]:
                degree[j] -= 1
                if degree[j] <= 1:
                    ends.append(j)
    return [i for i, x in enumerate(alive) if x]


def scaffold(m: Molecule) -> str:
    return write_smiles(m, scaffold_atoms(m)) if m.rings else ""
