"""SMILES reader: line notation to a molecular graph.

Written from the OpenSMILES grammar. `read` gives a `Graph` of the atoms and bonds as written; hydrogens,
Kekulé orders and rings are added by `crucible.chem.graph`. A text that can't be read raises `SmilesError`;
callers turn that into a null.
"""

from __future__ import annotations

import re

from crucible.chem.elements import Z_OF


class SmilesError(ValueError):
    pass


_TOKEN = re.compile(r"\[[^\[\]]*\]|Cl|Br|[BCNOPSFIbcnops*]|[-=#:$/\\~().]|%\d\d|\d", re.ASCII)
_BRACKET = re.compile(
    r"(?P<isotope>\d+)?(?P<symbol>[A-Z][a-z]?|se|as|te|si|[bcnops]|\*)(?P<chiral>@{1,2}(?:[A-Z]{2}\d+)?)?"
    r"(?:H(?P<h>\d*))?(?P<charge>\++\d*|-+\d*)?(?::(?P<map>\d+))?$",
    re.ASCII,
)
_ORDER = {"-": 1, "=": 2, "#": 3, "$": 4, ":": 1, "/": 1, "\\": 1, "~": 1}
_AROMATIC = {"b": "B", "c": "C", "n": "N", "o": "O", "p": "P", "s": "S", "se": "Se", "as": "As", "te": "Te", "si": "Si"}
_PLAIN = {s: (s, False) for s in ("B", "C", "N", "O", "P", "S", "F", "I", "Cl", "Br", "*")} | {s: (_AROMATIC[s], True) for s in "bcnops"}


class Graph:
    """Atoms and bonds in writing order.

    Per atom: symbol, charge, isotope (0: none), hydrogens (None: to be inferred), aromatic, chiral (0, 1 for @, 2 for @@).
    Per bond: (a, b, order, aromatic, stereo) where order counts 1 for an aromatic bond.
    """

    __slots__ = ("symbol", "charge", "isotope", "hydrogens", "aromatic", "chiral", "bonds", "explicit")

    def __init__(self):
        self.symbol: list[str] = []
        self.charge: list[int] = []
        self.isotope: list[int] = []
        self.hydrogens: list[int | None] = []
        self.aromatic: list[bool] = []
        self.chiral: list[int] = []
        self.bonds: list[tuple[int, int, int, bool, str]] = []

    def __len__(self) -> int:
        return len(self.symbol)


def _charge(text: str | None) -> int:
    if not text:
        return 0
    sign = 1 if text[0] == "+" else -1
    digits = text.lstrip("+-")
    return sign * (int(digits) if digits else len(text))


def _bracket(text: str) -> tuple[str, bool, int, int, int, int]:
    """Symbol, aromatic, isotope, chirality, hydrogens and charge of a bracket's content."""
    b = _BRACKET.match(text)
    if b is None:
        raise SmilesError(f"bracket [{text}]")
    s = b["symbol"]
    name, h, mark = _AROMATIC.get(s, s), b["h"], b["chiral"]
    if name != "*" and name not in Z_OF:
        raise SmilesError(f"element {name}")
    return name, s.islower(), int(b["isotope"] or 0), 0 if not mark else 2 if mark.startswith("@@") else 1, 0 if h is None else int(h or 1), _charge(b["charge"])


def read(text: str) -> Graph:
    """The graph of one SMILES; outer and inner white space is dropped."""
    text = "".join(text.split())
    if not text:
        raise SmilesError("empty")
    tokens = _TOKEN.findall(text)
    if sum(map(len, tokens)) != len(text):
        raise SmilesError("unexpected character")
    g = Graph()
    symbol, aromatic, bonds = g.symbol, g.aromatic, g.bonds
    special: dict[int, tuple] = {}
    last, pending, stack, rings, dot, n = -1, "", [], {}, False, 0
    for t in tokens:
        if t in _PLAIN or t[0] == "[":
            if t in _PLAIN:
                s, low = _PLAIN[t]
            else:
                s, low, *special[n] = _bracket(t[1:-1])
            symbol.append(s)
            aromatic.append(low)
            if last >= 0 and not dot:
                if pending:
                    bonds.append((last, n, _ORDER[pending], pending == ":", pending if pending in "/\\" else ""))
                    pending = ""
                else:
                    bonds.append((last, n, 1, low and aromatic[last], ""))
            elif pending:
                raise SmilesError("bond to nothing")
            last, dot = n, False
            n += 1
        elif t == "(":
            if last < 0:
                raise SmilesError("branch before an atom")
            stack.append(last)
        elif t == ")":
            if not stack or pending:
                raise SmilesError("unbalanced branch")
            last = stack.pop()
        elif t in _ORDER:
            if pending or last < 0:
                raise SmilesError("two bond symbols")
            pending = t
        elif t == ".":
            if pending:
                raise SmilesError("bond before a dot")
            dot = True
        else:
            if last < 0:
                raise SmilesError("ring digit before an atom")
            k = int(t.lstrip("%"))
            if k in rings:
                other, mark = rings.pop(k)
                mark = pending or mark
                if other == last:
                    raise SmilesError("ring bond to itself")
                bonds.append((other, last, _ORDER[mark] if mark else 1, (aromatic[other] and aromatic[last] and not mark) or mark == ":", ""))
            else:
                rings[k] = (last, pending)
            pending = ""
    if stack:
        raise SmilesError("unbalanced branch")
    if rings:
        raise SmilesError("open ring")
    if pending or dot or not symbol:
        raise SmilesError("ends in a bond")
    if len({(a, b) if a < b else (b, a) for a, b, *_ in bonds}) != len(bonds):
        raise SmilesError("two bonds between a pair")
    g.charge, g.isotope, g.chiral, g.hydrogens = [0] * n, [0] * n, [0] * n, [None] * n
    for i, (isotope, chiral, h, charge) in special.items():
        g.isotope[i], g.chiral[i], g.hydrogens[i], g.charge[i] = isotope, chiral, h, charge
    if "*" in symbol:
        for i, s in enumerate(symbol):
            if s == "*" and g.hydrogens[i] is None:
                g.hydrogens[i] = 0
    return g


#: Allowed valences of the atoms that may stand without brackets.
NORMAL = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1,)}


def total_hydrogens(g: Graph) -> list[int]:
    """Hydrogens of every atom, written or implied, without hydrogens that are atoms of their own.

    An aromatic atom spends one valence on its ring's double bonds unless its single bonds already fill the lowest valence.
    """
    used = [0] * len(g)
    for a, b, order, _, _ in g.bonds:
        used[a] += order
        used[b] += order
    out = list(g.hydrogens)
    for i, h in enumerate(out):
        if h is None:
            room = NORMAL[g.symbol[i]]
            u = used[i]
            if g.aromatic[i]:
                out[i] = max(0, room[0] - u - 1)
            else:
                out[i] = room[0] - u if u <= room[0] else next((v - u for v in room if v >= u), 0)
    return out
