"""Cycles, paths and subgraphs of a molecular graph, given as neighbour lists of (atom, bond)."""

from __future__ import annotations

from collections import deque

Near = list[list[tuple[int, int]]]


def all_cycles(near: Near) -> list[list[int]]:
    """Atoms, sorted, of every simple cycle, from the shortest. Their number can grow exponentially with fused rings."""
    out = set()
    for s in range(len(near)):  # cycles whose smallest atom is s
        stack = [(s, (s,))]
        while stack:
            x, path = stack.pop()
            for y, _ in near[x]:
                if y == s and len(path) > 2 and path[1] < path[-1]:
                    out.add((tuple(sorted(path)), frozenset(frozenset(e) for e in zip(path, (*path[1:], s), strict=True))))
                elif y > s and y not in path:
                    stack.append((y, (*path, y)))
    return sorted(([*atoms] for atoms, _ in out), key=lambda c: (len(c), c))


def bridges(near: Near) -> list[int]:
    """Bonds whose removal splits a fragment."""
    number, low, out, clock = [-1] * len(near), [0] * len(near), [], 0
    for s in range(len(near)):
        if number[s] >= 0:
            continue
        number[s] = low[s] = clock
        clock += 1
        stack = [(s, -1, iter(near[s]))]
        while stack:
            i, via, it = stack[-1]
            for j, k in it:
                if k == via:
                    continue
                if number[j] < 0:
                    number[j] = low[j] = clock
                    clock += 1
                    stack.append((j, k, iter(near[j])))
                    break
                low[i] = min(low[i], number[j])
            else:
                stack.pop()
                if stack:
                    p = stack[-1][0]
                    low[p] = min(low[p], low[i])
                    if low[i] > number[p]:
                        out.append(via)
    return sorted(out)


def without_bridges(near: Near) -> list[list[int]]:
    """Atoms of the parts that stay joined when all bridges are cut, those of at least two atoms: the ring systems."""
    cut, seen, out = set(bridges(near)), [False] * len(near), []
    for s in range(len(near)):
        if seen[s]:
            continue
        part, todo = [], [s]
        seen[s] = True
        while todo:
            x = todo.pop()
            part.append(x)
            for y, k in near[x]:
                if k not in cut and not seen[y]:
                    seen[y] = True
                    todo.append(y)
        if len(part) > 1:
            out.append(sorted(part))
    return out


def path_between(near: Near, a: int, b: int, avoid: frozenset[int] = frozenset()) -> list[int] | None:
    """The shortest path from a to b that doesn't go through the atoms of `avoid`, the smallest atoms first; None where there is none."""
    before, todo = {a: -1}, deque([a])
    while todo:
        x = todo.popleft()
        if x == b:
            out = []
            while x >= 0:
                out.append(x)
                x = before[x]
            return out[::-1]
        for y, _ in sorted(near[x]):
            if y not in before and y not in avoid:
                before[y] = x
                todo.append(y)
    return None


def path_between_bonds(near: Near, ends: list[tuple[int, int]], e: int, f: int) -> list[int] | None:
    """The shortest run of bonds, each sharing an atom with the next, from bond e to bond f."""
    before, todo = {e: -1}, deque([e])
    while todo:
        x = todo.popleft()
        if x == f:
            out = []
            while x >= 0:
                out.append(x)
                x = before[x]
            return out[::-1]
        for atom in ends[x]:
            for _, k in near[atom]:
                if k not in before:
                    before[k] = x
                    todo.append(k)
    return None


def induced(ends: list[tuple[int, int]], atoms: set[int]) -> list[int]:
    """Bonds between the atoms: the subgraph they span, which also turns a set of atoms into one of bonds."""
    return [k for k, (a, b) in enumerate(ends) if a in atoms and b in atoms]


def atoms_of(ends: list[tuple[int, int]], bonds: list[int]) -> list[int]:
    return sorted({i for k in bonds for i in ends[k]})


def parts(near: Near) -> list[list[int]]:
    """Atoms of each fragment."""
    seen, out = [False] * len(near), []
    for s in range(len(near)):
        if not seen[s]:
            part, todo = [], [s]
            seen[s] = True
            while todo:
                x = todo.pop()
                part.append(x)
                for y, _ in near[x]:
                    if not seen[y]:
                        seen[y] = True
                        todo.append(y)
            out.append(sorted(part))
    return out
