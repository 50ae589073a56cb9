"""Maximum matching of a general graph by Edmonds' blossoms: polynomial, exact, without a limit on tries."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence


def maximum_matching(links: Sequence[Sequence[int]]) -> list[int]:
    """Mate of every vertex, -1 for a free one.

    A matching of neighbours first; then from each free vertex alternating trees are grown by breadth, odd cycles being
    contracted into their base, until no free vertex has an augmenting path.
    """
    n = len(links)
    mate = [-1] * n
    for i in range(n):
        if mate[i] < 0:
            for j in links[i]:
                if mate[j] < 0 and j != i:
                    mate[i], mate[j] = j, i
                    break
    for root in range(n):
        if mate[root] < 0:
            _augment(root, links, mate)
    return mate


def _augment(root: int, links: Sequence[Sequence[int]], mate: list[int]) -> bool:
    via: dict[int, int] = {}  # vertex at odd depth: the vertex it was reached from
    base: dict[int, int] = {}  # contracted vertices: their blossom's base
    even, todo = {root}, deque([root])

    def origin(v: int) -> int:
        return base.get(v, v)

    def meeting(a: int, b: int) -> int:
        """The base in which the tree paths of two even vertices meet."""
        seen = set()
        while True:
            a = origin(a)
            seen.add(a)
            if mate[a] < 0 or a == root:
                break
            a = via[mate[a]]
        while origin(b) not in seen:
            b = via[mate[origin(b)]]
        return origin(b)

    def contract(v: int, top: int, child: int, inside: set[int]) -> None:
        while origin(v) != top:
            inside |= {origin(v), origin(mate[v])}
            via[v] = child
            child = mate[v]
            v = via[mate[v]]

    while todo:
        v = todo.popleft()
        for w in links[v]:
            if origin(v) == origin(w) or mate[v] == w:
                continue
            if w == root or (mate[w] >= 0 and mate[w] in via):
                top, inside = meeting(v, w), set()
                contract(v, top, w, inside)
                contract(w, top, v, inside)
                for u in range(len(links)):
                    if origin(u) in inside:
                        base[u] = top
                        if u not in even:
                            even.add(u)
                            todo.append(u)
            elif w not in via:
                via[w] = v
                if mate[w] < 0:
                    while w >= 0:
                        u = via[w]
                        mate[w], mate[u], w = u, w, mate[u]
                    return True
                even.add(mate[w])
                todo.append(mate[w])
    return False
