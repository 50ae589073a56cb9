"""Keys under which two SMILES are equal exactly when they denote the same molecule.

Equality is that of the largest fragment's heavy-atom skeleton with the hydrogens of every atom, after charges that came from
gain or loss of hydrogen are undone; stereo marks, isotopes and map numbers don't count. Bond orders don't enter: the
hydrogens of the atoms fix them up to resonance, so Kekulé and aromatic writing agree.

The key is exact up to collisions of a 128-bit hash, at every size. Atoms start with (element, hydrogens, charge) as colour and
are refined by their neighbours' colours until no class splits. Where the stable colouring meets the known conditions under
which refinement tells a graph from every other one (Arvind, Koebler, Rattan, Verbitsky: On the Power of Color Refinement),
its colours are the key. Else every atom of the smallest class is singled out in turn, refined again, and the least outcome
counts; branches that an earlier one already covers by symmetry are left out. A batch of molecules is refined at once in
NumPy. Nothing in a key depends on the other molecules of a batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

from crucible.chem.elements import Z_OF
from crucible.chem.smiles import Graph, SmilesError, read, total_hydrogens

#: Atoms of the copies of a molecule that are refined at once when atoms are singled out.
AT_ONCE = 1 << 20

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x + np.uint64(salt)) * _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _fragments(n: int, bonds: list[tuple]) -> list[int]:
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b, *_ in bonds:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def skeleton(g: Graph, split: bool) -> list[tuple[list[int], list[tuple[int, int]]]]:
    """The largest fragment as (code of each heavy atom, bonds); several where fragments tie in size."""
    n, h = len(g), total_hydrogens(g)
    charge, symbol, bonds = list(g.charge), g.symbol, g.bonds
    if "H" in symbol:  # hydrogens written as atoms join their neighbour
        gone = set()
        for a, b, *_ in bonds:
            for x, y in ((a, b), (b, a)):
                if symbol[x] == "H" and symbol[y] != "H" and x not in gone:
                    h[y] += 1
                    gone.add(x)
                    break
        if len(gone) < n:
            keep = [i for i in range(n) if i not in gone]
            new = {i: k for k, i in enumerate(keep)}
            symbol, charge, h = [symbol[i] for i in keep], [charge[i] for i in keep], [h[i] for i in keep]
            bonds = [(new[b[0]], new[b[1]]) for b in bonds if b[0] in new and b[1] in new]
            n = len(keep)
    near: dict[int, list[int]] = {}
    if any(charge):
        for i, q in enumerate(charge):
            if q > 0:
                take = min(q, h[i])
                charge[i] -= take
                h[i] -= take
        for b in bonds:
            near.setdefault(b[0], []).append(b[1])
            near.setdefault(b[1], []).append(b[0])
        for i, q in enumerate(charge):
            if q < 0 and not any(charge[j] > 0 for j in near.get(i, ())):
                h[i] -= q
                charge[i] = 0
    code = [(Z_OF.get(s, 0) * 64 + min(h[i], 63)) * 32 + charge[i] + 16 for i, s in enumerate(symbol)]
    pairs = [(b[0], b[1]) for b in bonds]
    if not split:
        return [(code, pairs)]
    part = _fragments(n, pairs)
    sizes: dict[int, int] = {}
    for p in part:
        sizes[p] = sizes.get(p, 0) + 1
    most = max(sizes.values())
    out = []
    for p, size in sizes.items():
        if size == most:
            own = [i for i in range(n) if part[i] == p]
            new = {i: k for k, i in enumerate(own)}
            out.append(([code[i] for i in own], [(new[a], new[b]) for a, b in pairs if part[a] == p]))
    return out


class Refined(NamedTuple):
    """Stable colours of every atom, start of each molecule, whether its colours tell it from any other, and its hash."""

    colour: np.ndarray
    offset: np.ndarray
    told: np.ndarray
    key: list[tuple[int, int]]


def _edges(mols: list, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both directions of all bonds over the batch, sorted by their first atom."""
    count = [len(p) for _, p in mols]
    flat = np.fromiter((x for _, p in mols for e in p for x in e), np.int64, 2 * sum(count)).reshape(-1, 2) + np.repeat(offset[:-1], count)[:, None]
    src, dst = np.concatenate((flat[:, 0], flat[:, 1])), np.concatenate((flat[:, 1], flat[:, 0]))
    order = np.argsort(src, kind="stable")
    return src[order], dst[order]


def _told(cell: np.ndarray, size: np.ndarray, src: np.ndarray, dst: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """By molecule: whether its stable cells meet the conditions. cell and own (molecule) are by atom, size by cell.

    Only cells of several atoms matter. Inside a cell the bonds must be none, all, or one an atom; between two cells none, all,
    or stars. Cells joined by stars must form trees whose cells don't shrink away from a smallest one, and at most one of a
    tree's cells, a smallest, may hold bonds that are neither none nor all.
    """
    told = np.ones(n, bool)
    many = (size[cell[src]] > 1) & (size[cell[dst]] > 1)
    if not many.any():
        return told
    pair, first, links = np.unique(cell[src[many]] * len(size) + cell[dst[many]], return_index=True, return_counts=True)
    a, b = pair // len(size), pair % len(size)
    mol = own[src[many][first]]
    per = links // size[a]  # bonds of an atom of a into b
    back = links // size[b]
    inside, full = a == b, per == np.where(a == b, size[a] - 1, size[b])
    told[mol[~full & (per > 1) & (inside | (back > 1))]] = False
    mixed = set(a[inside & ~full].tolist())
    star = (~inside & ~full & (a < b)).nonzero()[0]
    near: dict[int, list[int]] = {}
    for i in star.tolist():
        if told[mol[i]]:
            near.setdefault(int(a[i]), []).append(int(b[i]))
            near.setdefault(int(b[i]), []).append(int(a[i]))
    owner = dict(zip(a.tolist(), mol.tolist(), strict=True))
    seen: set[int] = set()
    for start in near:
        if start in seen:
            continue
        part, stack, ends = [], [start], 0
        seen.add(start)
        while stack:
            x = stack.pop()
            part.append(x)
            ends += len(near[x])
            for y in near[x]:
                if y not in seen:
                    seen.add(y)
                    stack.append(y)
        least, odd = min(size[x] for x in part), [x for x in part if x in mixed]
        ok = ends == 2 * (len(part) - 1) and len(odd) <= 1 and all(size[x] == least for x in odd)
        if ok:
            root = odd[0] if odd else next(x for x in part if size[x] == least)
            stack = [(root, -1)]
            while stack and ok:
                x, via = stack.pop()
                for y in near[x]:
                    if y != via:
                        ok = ok and size[x] <= size[y]
                        stack.append((y, x))
        if not ok:
            told[owner[start]] = False
    return told


def _stable(colour: np.ndarray, offset: np.ndarray, src: np.ndarray, dst: np.ndarray) -> Refined:
    """Refines until no molecule's classes split; a molecule stops at its own round."""
    n, sizes = len(offset) - 1, np.diff(offset)
    own = np.repeat(np.arange(n), sizes)
    first = np.flatnonzero(np.r_[True, src[1:] != src[:-1]]) if len(src) else np.zeros(0, np.int64)
    rows = src[first]
    live, classes, rounds = np.ones(n, bool), np.zeros(n, np.int64), np.zeros(n, np.uint64)
    cell = np.zeros(len(colour), np.int64)
    while True:
        order = np.lexsort((colour, own))
        c, o = colour[order], own[order]
        new = np.r_[True, (c[1:] != c[:-1]) | (o[1:] != o[:-1])]
        now = np.bincount(o[new], minlength=n)
        cell[order] = np.cumsum(new) - 1
        live &= now > classes
        if not live.any():
            break
        classes = np.maximum(classes, now)
        rounds[live] += np.uint64(1)
        step = colour * _M3
        if len(src):
            step[rows] += np.add.reduceat(_mix(colour[dst], 3), first)
        colour = np.where(live[own], _mix(step, 4), colour)
    told = _told(cell, np.bincount(cell), src, dst, own, n)
    # the last round of a molecule split nothing, so its colours already hold how the classes are joined
    sums = [np.add.reduceat(_mix(colour, salt), offset[:-1]) for salt in (5, 6)]
    key = [tuple(map(int, k)) for k in zip(*(_mix(s ^ rounds, 7) for s in sums), strict=True)]
    return Refined(colour, offset, told, key)


def _least_rotation(x: list[int]) -> list[int]:
    """The smallest of the rotations of a cycle."""
    n, i, j, k = len(x), 0, 1, 0
    while i < n and j < n and k < n:
        a, b = x[(i + k) % n], x[(j + k) % n]
        if a == b:
            k += 1
            continue
        if a > b:
            i += k + 1
        else:
            j += k + 1
        if i == j:
            j += 1
        k = 0
    at = min(i, j)
    return x[at:] + x[:at]


def _ring(colour: np.ndarray, pairs: list[tuple[int, int]]) -> tuple[int, int] | None:
    """Hash of a molecule that is one single ring: the smaller of the least rotations of both directions; None for others."""
    near: list[list[int]] = [[] for _ in range(len(colour))]
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    if any(len(x) != 2 for x in near):
        return None
    way, before = [0], -1
    while True:
        at = way[-1]
        to = near[at][0] if near[at][0] != before else near[at][1]
        if to == 0:
            break
        before = at
        way.append(to)
    if len(way) < len(near):
        return None
    x = colour[way].tolist()
    h = np.array(min(_least_rotation(x), _least_rotation(x[::-1])), np.uint64)
    place = np.arange(len(h), dtype=np.uint64)
    return tuple(int(np.add.reduce(_mix(h ^ _mix(place, 10), salt))) for salt in (5, 6))


def _canonical(colour: np.ndarray, pairs: list[tuple[int, int]]) -> tuple[int, int]:
    """The least hash over the ways of singling atoms out until the colours tell the molecule from any other."""
    n = len(colour)
    ring = _ring(colour, pairs)
    if ring is not None:
        return ring

    def children(colour: np.ndarray) -> Refined:
        """Every atom of the smallest class singled out; ties between classes go by their colour."""
        values, count = np.unique(colour, return_counts=True)
        several = count > 1
        pick = values[several][np.lexsort((values[several], count[several]))[0]]
        atoms = np.flatnonzero(colour == pick)
        parts = []
        step = max(1, AT_ONCE // n)
        for at in range(0, len(atoms), step):
            own = atoms[at : at + step]
            k = len(own)
            new = np.tile(colour, k)
            new[np.arange(k) * n + own] = _mix(new[np.arange(k) * n + own], 8)
            offset = np.arange(k + 1) * n
            parts.append(_stable(new, offset, *_edges([(None, pairs)] * k, offset)))
        return Refined(np.concatenate([p.colour for p in parts]), np.arange(len(atoms) + 1) * n, np.concatenate([p.told for p in parts]), [x for p in parts for x in p.key])

    def least(r: Refined) -> list[int]:
        low = min(r.key)
        return [i for i, k in enumerate(r.key) if k == low]

    def leftmost(colour: np.ndarray, key: tuple[int, int], told: bool) -> tuple[int, int]:
        while not told:
            r = children(colour)
            i = least(r)[0]
            colour, key, told = r.colour[i * n : (i + 1) * n], r.key[i], bool(r.told[i])
        return key

    def search(colour: np.ndarray) -> tuple[int, int]:
        r = children(colour)
        best, met = None, set()
        for i in least(r):
            own = r.colour[i * n : (i + 1) * n]
            if r.told[i]:
                found = r.key[i]
            else:
                end = leftmost(own, r.key[i], False)
                if end in met:  # the same end on the same way: a symmetry maps this branch to one that was searched
                    continue
                met.add(end)
                found = search(own)
            best = found if best is None else min(best, found)
        return best

    return search(colour)


def _refine(mols: list[tuple[list[int], list[tuple[int, int]]]]) -> list[str]:
    """Key of each skeleton."""
    sizes = np.array([len(c) for c, _ in mols])
    offset = np.concatenate(([0], np.cumsum(sizes)))
    colour = _mix(np.fromiter((x for c, _ in mols for x in c), np.uint64, int(offset[-1])), 1)
    r = _stable(colour, offset, *_edges(mols, offset))
    out = []
    for i, (n, key) in enumerate(zip(sizes, r.key, strict=True)):
        if not r.told[i]:
            a, b = _canonical(r.colour[offset[i] : offset[i + 1]], mols[i][1])
            key = int(_mix(np.array([key[0]], np.uint64), 9)[0]) ^ a, key[1] ^ b
        out.append(f"{n}:{key[0]:016x}{key[1]:016x}")
    return out


def molecule_keys(texts: Sequence[str | None]) -> list[str | None]:
    """A key for each SMILES; None for a null, a blank or one that can't be read.

    Where fragments tie in size the smallest of their keys counts.
    """
    keys: list[str | None] = [None] * len(texts)
    classes: dict[int, list[tuple[int, tuple]]] = {}
    for i, text in enumerate(texts):
        if text is None:
            continue
        try:
            parts = skeleton(read(text), "." in text)
        except (SmilesError, KeyError):
            continue
        for part in parts:
            classes.setdefault(max(5, len(part[0]).bit_length()), []).append((i, part))
    for members in classes.values():
        for (i, _), key in zip(members, _refine([p for _, p in members]), strict=True):
            keys[i] = key if keys[i] is None else min(keys[i], key)
    return keys
