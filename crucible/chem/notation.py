"""Other notations: condensed formulas and InChI, read into molecules, and InChI keys."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

from crucible.chem.elements import Z_OF, element
from crucible.chem.matching import maximum_matching
from crucible.chem.smiles import NORMAL, SmilesError


class Skeleton:
    """Atoms with bonds being built: symbols, charges, hydrogens, and order by pair of atoms."""

    def __init__(self):
        self.symbol: list[str] = []
        self.charge: list[int] = []
        self.room: list[int] = []
        self.order: dict[tuple[int, int], int] = {}

    def add(self, symbol: str, charge: int = 0, valence: int | None = None) -> int:
        if symbol not in Z_OF:
            raise SmilesError(f"element {symbol}")
        self.symbol.append(symbol)
        self.charge.append(charge)
        if valence is None:
            allowed = element(symbol).valences
            valence = max(0, allowed[0] + (charge if symbol in ("N", "O", "S", "P") else -abs(charge)))
        self.room.append(valence)
        return len(self.symbol) - 1

    def bond(self, a: int, b: int, order: int) -> None:
        key = (min(a, b), max(a, b))
        self.order[key] = self.order.get(key, 0) + order
        self.room[a] -= order
        self.room[b] -= order

    def smiles(self, leave: frozenset[int] = frozenset()) -> str:
        """Text of the heavy atoms; hydrogens on them are counted. `leave` are atoms left out, whose bonds hydrogens take."""
        n = len(self.symbol)
        near: dict[int, list[tuple[int, int]]] = {i: [] for i in range(n)}
        for (a, b), o in self.order.items():
            if o > 0:
                near[a].append((b, o))
                near[b].append((a, o))
        keep = [i for i in range(n) if i not in leave and (self.symbol[i] != "H" or all(self.symbol[j] == "H" for j, _ in near[i]))]
        inside, used, out, digit = set(keep), set(), [], {}
        mark = {1: "", 2: "=", 3: "#", 4: "$"}
        tree: dict[int, list[tuple[int, int]]] = {}
        roots, seen, rings = [], set(), 0
        for s in keep:
            if s in seen:
                continue
            roots.append(s)
            seen.add(s)
            stack = [s]
            while stack:
                i = stack[-1]
                step = next(((j, o) for j, o in near[i] if j in inside and (min(i, j), max(i, j)) not in used), None)
                if step is None:
                    stack.pop()
                    continue
                j, o = step
                used.add((min(i, j), max(i, j)))
                if j in seen:
                    rings += 1
                    digit.setdefault(i, []).append((rings, o))
                    digit.setdefault(j, []).append((rings, o))
                else:
                    seen.add(j)
                    tree.setdefault(i, []).append((j, o))
                    stack.append(j)

        def atom(i: int) -> str:
            h = sum(o if j in leave else self.symbol[j] == "H" for j, o in near[i]) if self.symbol[i] != "H" else 0
            total, q, s = sum(o for j, o in near[i] if j in inside), self.charge[i], self.symbol[i]
            ring = "".join(mark[o] + (str(k) if k < 10 else f"%{k:02d}") for k, o in digit.get(i, ()))
            if s in NORMAL and not q and next((v - total for v in NORMAL[s] if v >= total), 0) == h:
                return s + ring
            sign = "" if not q else ("+" if q > 0 else "-") + (str(abs(q)) if abs(q) > 1 else "")
            return f"[{s}{'H' + (str(h) if h > 1 else '') if h else ''}{sign}]" + ring

        def text(i: int) -> str:
            kids = [mark[o] + text(j) for j, o in tree.get(i, ())]
            return atom(i) + "".join(f"({k})" for k in kids[:-1]) + (kids[-1] if kids else "")

        out = [text(r) for r in roots]
        return ".".join(out)


# --- condensed formulas ------------------------------------------------------

_CHUNK = re.compile(r"([A-Z][a-z]?)(\d)?([+-])?")


def formula_parts(text: str) -> list[tuple[str, int, bool]]:
    """(part, how often, bracketed) of a condensed formula: brackets of the outer level and what stands between them."""
    out, depth, start = [], 0, 0
    for at, c in enumerate(text):
        if c == "(":
            if not depth and at > start:
                out.append((text[start:at], 1, False))
            if not depth:
                start = at + 1
            depth += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise SmilesError("unbalanced bracket")
            if not depth:
                m = re.match(r"\d+", text[at + 1 :])
                out.append((text[start:at], int(m[0]) if m else 1, True))
                start = at + 1 + (len(m[0]) if m else 0)
    if depth:
        raise SmilesError("unbalanced bracket")
    if start < len(text):
        out.append((text[start:], 1, False))
    return [p for p in out if p[0]]


def reversed_formula(text: str) -> str:
    """The formula with its tokens from right to left; brackets keep their content and count."""
    out = []
    for part, times, inside in reversed(formula_parts(text)):
        if inside:
            out.append(f"({reversed_formula(part)}){times if times > 1 else ''}")
        else:
            out.append("".join(m[0] for m in reversed(list(_CHUNK.finditer(part)))))
    return "".join(out)


def formula_to_smiles(text: str, start_valency: int = 0, end_valency: int = 0) -> str:
    """A condensed formula such as CH3COOH as SMILES.

    Atoms hang, in writing order, on the latest atom with a free valence, by as many bonds as both have free (at most three);
    where none is free, the latest multiple bond gives one up. A bracket hangs its content on that atom as often as its count
    says, or as a chain where the atom hasn't that many valences free. start_valency is that of what the formula hangs on,
    end_valency what its last atom leaves free. SmilesError where valences stay open or the atoms don't join.
    """
    g = Skeleton()
    dummy = [g.add("C", valence=start_valency)] if start_valency else []

    def free(own: list[int]) -> int | None:
        for i in reversed(own):
            if g.room[i] > 0:
                return i
        for a, b in zip(reversed(own), list(reversed(own))[1:], strict=False):
            key = (min(a, b), max(a, b))
            if g.order.get(key, 0) > 1:
                g.bond(a, b, -1)
                return b
        return own[-1] if own else None

    def hang(last: int | None, i: int, most: int = 3) -> None:
        if last is None:
            return
        if g.room[last] <= 0:  # nitrogen, phosphorus, sulphur and the like may take the next valence
            higher = [v for v in element(g.symbol[last]).valences if v > element(g.symbol[last]).valences[0]]
            if higher:
                g.room[last] += higher[0] - element(g.symbol[last]).valences[0]
        order = min(g.room[last], g.room[i], most)
        if order <= 0:
            raise SmilesError("no free valence")
        g.bond(last, i, order)

    def grow(part: str, own: list[int]) -> list[int]:
        """Adds a part to the atoms `own` it may hang on; returns the atoms added."""
        mine: list[int] = []
        for chunk, times, inside in formula_parts(part):
            if not inside:
                at = 0
                for m in _CHUNK.finditer(chunk):
                    if m.start() != at:
                        raise SmilesError(f"unexpected character in {chunk}")
                    at = m.end()
                    last = free(own + mine)
                    for _ in range(int(m[2] or 1)):
                        if last is not None and g.room[last] <= 0:
                            last = free(own + mine)
                        i = g.add(m[1], int(m[3] + "1") if m[3] else 0)
                        hang(last, i)
                        mine.append(i)
                        last = i if last is None else last
                if at != len(chunk):
                    raise SmilesError(f"unexpected character in {chunk}")
                continue
            last = free(own + mine)
            chain = last is None or g.room[last] < times
            for _ in range(times):
                stub = g.add("C", valence=1)  # the part's first atom hangs on it, then on what stands before
                added = grow(chunk, [stub])
                tie = next(((a, b) for a, b in g.order if stub in (a, b) and g.order[(a, b)] > 0), None)
                if tie is None:
                    raise SmilesError("bracket without a free valence")
                first = tie[0] if tie[1] == stub else tie[1]
                g.bond(stub, first, -1)
                gone.add(stub)
                if last is not None:
                    hang(last, first, 1)
                mine += added
                if chain:
                    last = added[-1] if g.room[added[-1]] > 0 and g.symbol[added[-1]] != "H" else next((i for i in reversed(added) if g.room[i] > 0), added[0])
        return mine

    gone: set[int] = set(dummy)
    added = grow(text, dummy)
    if not added:
        raise SmilesError("no atoms")
    for i in added:
        if i not in gone and g.room[i] > 0 and not (i == max(j for j in added if g.room[j] > 0) and g.room[i] == end_valency):
            raise SmilesError("open valence")
    out = g.smiles(frozenset(gone))
    if "." in out:
        raise SmilesError("not connected")
    return out


# --- InChI --------------------------------------------------------------------


def inchi_layers(text: str) -> dict[str, str]:
    """Layers by their letter; the version is '', the formula 'formula'. Layers after a fixed-hydrogen one carry its f."""
    text = text.strip().removeprefix("InChI=")
    parts = text.split("/")
    if len(parts) < 2:
        raise SmilesError("no layers")
    out, fixed = {"": parts[0], "formula": parts[1]}, ""
    for p in parts[2:]:
        if p[:1] == "f":
            fixed = "f"
            out["f"] = p[1:]
        elif p:
            out.setdefault(fixed + p[0], p[1:])
    return out


def _numbers(text: str) -> list[int]:
    """Atom numbers of a list such as 1-3,5."""
    out = []
    for x in text.split(","):
        a, _, b = x.partition("-")
        out += range(int(a), int(b or a) + 1)
    return out


def inchi_to_smiles(text: str) -> str:
    """The molecule of an InChI's formula, connection, hydrogen and charge layers as SMILES, without stereo.

    Movable hydrogens go to the first atoms of their group with room; charges to nitrogen and oxygen first; bonds left over
    are a maximum matching of the atoms with a free valence, taken again for triple bonds. Only one component can be read.
    """
    layers = inchi_layers(text)
    formula = layers["formula"]
    if "." in formula or re.match(r"\d", formula):
        raise SmilesError("several components")
    heavy, g = [], Skeleton()
    counts = {m[1]: int(m[2] or 1) for m in re.finditer(r"([A-Z][a-z]?)(\d*)", formula)}
    order = sorted((s for s in counts if s != "H"), key=lambda s: (s != "C", s)) or ["H"]
    for s in order:
        for _ in range(counts[s]):
            heavy.append(g.add(s))
    hydrogens = {i: 0 for i in range(len(heavy))}
    stack: list[int] = []
    last = None
    for m in re.finditer(r"(\d+)|([-(),])", layers.get("c", "")):
        if m[1]:
            i = int(m[1]) - 1
            if last is not None:
                g.bond(last, i, 1)
            last = i
        elif m[2] == "(":
            stack.append(last)
        elif m[2] == ",":
            last = stack[-1]
        elif m[2] == ")":
            last = stack.pop()
    movable: list[tuple[int, list[int]]] = []
    h = layers.get("h", "")
    for m in re.finditer(r"\(H(\d*)-?,([\d,]+)\)", h):
        movable.append((int(m[1] or 1), [int(x) - 1 for x in m[2].split(",")]))
    for m in re.finditer(r"([\d,-]+)H(\d*)", re.sub(r"\(H[^)]*\)", "", h)):
        for i in _numbers(m[1].strip(",")):
            hydrogens[i - 1] += int(m[2] or 1)
    charge = int(layers.get("q", "0").split(";")[0] or 0)
    protons = int(layers.get("p", "0") or 0)
    for number, atoms in movable:
        for i in atoms:
            if number and g.room[i] - hydrogens[i] > 0:
                hydrogens[i] += 1
                number -= 1
    total = charge + protons
    want = ("N", "P", "S", "O") if total > 0 else ("O", "S", "N")
    for i in sorted(range(len(heavy)), key=lambda i: (want.index(g.symbol[i]) if g.symbol[i] in want else 9, i)):
        if not total:
            break
        step = 1 if total > 0 else -1
        if protons < 0 and not hydrogens[i]:
            continue
        g.charge[i] += step
        g.room[i] += step if g.symbol[i] in ("N", "O", "S", "P") else -1
        if protons:
            hydrogens[i] += step
            protons -= step
        total -= step
    for i, k in hydrogens.items():
        for _ in range(k):
            g.bond(i, g.add("H"), 1)
    n = len(heavy)
    while True:
        open_ = [i for i in range(n) if g.room[i] > 0]
        at = {i: k for k, i in enumerate(open_)}
        links = [[at[j] for (a, b), o in g.order.items() if o > 0 and i in (a, b) for j in [b if a == i else a] if j in at] for i in open_]
        mate = maximum_matching(links)
        pairs = [(open_[k], open_[m]) for k, m in enumerate(mate) if 0 <= m and k < m]
        if not pairs:
            break
        for a, b in pairs:
            g.bond(a, b, 1)
    if any(g.room[i] > 0 and g.symbol[i] not in ("S", "P") for i in range(n)):
        raise SmilesError("open valence")
    return g.smiles()


@lru_cache(maxsize=1)
def _triplets() -> list[str]:
    """The 2^14 three-letter words of the key's alphabet: all but those from E and from TAA to TTV."""
    letters = [chr(65 + i) for i in range(26)]
    every = (a + b + c for a in letters for b in letters for c in letters)
    return [t for t in every if t[0] != "E" and not "TAA" <= t <= "TTV"]


def _code(data: str, words: int) -> str:
    """`words` three-letter words and one of two letters from the bits of a SHA-256, 14 a word and 9 for the last, from the lowest."""
    bits = int.from_bytes(hashlib.sha256(data.encode()).digest(), "little")
    out = "".join(_triplets()[bits >> 14 * k & 0x3FFF] for k in range(words))
    rest = bits >> 14 * words & 0x1FF
    return out + chr(65 + rest // 26) + chr(65 + rest % 26)


def inchi_key(text: str) -> str:
    """The key of a standard InChI."""
    parts = text.strip().removeprefix("InChI=").split("/")
    m = re.fullmatch(r"([123])S", parts[0])
    if m is None or len(parts) < 2:
        raise SmilesError("not a standard InChI")
    major, protons, at = [parts[1]], 0, 2
    while at < len(parts) and parts[at][:1] in ("c", "h", "q", "p"):
        if parts[at][0] == "p":
            protons += int(parts[at][1:])
        else:
            major.append(parts[at])
        at += 1
    minor = "".join(f"/{p}" for p in parts[at:])
    if len(minor) < 255:
        minor *= 2
    return f"{_code('/'.join(major), 4)}-{_code(minor, 2)}S{chr(64 + int(m[1]))}-{chr(65 + min(25, max(0, 13 + protons)))}"


#: Weights of the letters in the check letter of keys of the earlier form.
_WEIGHTS = (1, 3, 5, 7, 9, 11, 15, 17, 19, 21, 23, 25, 1, 3, 5, 7, 9, 11, 15, 17, 19, 21, 23)


def check_key(key: str) -> bool:
    """Whether a key of the earlier form (14 letters, 9 letters and a check letter) ends in the right letter."""
    m = re.fullmatch(r"([A-Z]{14})-([A-Z]{9})([A-Z])", key.strip().removeprefix("InChIKey="))
    return m is not None and chr(65 + sum(w * ord(c) for w, c in zip(_WEIGHTS, m[1] + m[2], strict=True)) % 26) == m[3]
