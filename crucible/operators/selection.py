"""The atom selection language, compiled to filters and joins.

    expr  := and_e ("or" and_e)*        and_e := unary ("and" unary)*
    unary := "not" unary | "within" NUM ["bond" | "bonds"] ["of" | "from" | "to"] (COM | unary) | "bonded" ["to"] unary | "(" expr ")" | term
    term  := PROP OP NUM | class word | "chain" ID | "resname" ID | "resid" INT | element | residue name

`near` and `around` mean `within`. A `within` or `bonded` selection holds its source atoms. The bare word `chain` means atoms
outside rings, `hetero` means heavy, `heteroatom` neither C nor H. Trees of terms only become one boolean column, which counts
and sums read in one pass over the atoms; only bonded and within need joins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crucible.chem.elements import MASS, elements
from crucible.operators.joins import range_join

_TOKEN = re.compile(r"\s*(\(|\)|==|!=|<=|>=|<|>|=|[^\s()<>=!]+)")
_NUMBER = re.compile(r"[+-]?\d+(\.\d+)?$")

# Words of the language.
NAMES = {"carbon": "C", "nitrogen": "N", "oxygen": "O", "sulfur": "S", "phosphorus": "P", "fluorine": "F", "chlorine": "Cl", "bromine": "Br", "iodine": "I", "boron": "B", "silicon": "Si", "selenium": "Se", "hydrogen": "H"}
WATER = ("HOH", "WAT", "SOL", "DOD")
RESIDUES = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLU", "GLN", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL", "MSE", "SEC", "PYL", *WATER)
WORDS = {
    "ring": ("ring", "rings"), "nonring": ("nonring", "non_ring", "non-ring", "chain"), "all": ("all", "*", "everything"), "none": ("none", "nothing"), "heavy": ("heavy", "hetero"), "heteroatom": ("heteroatom", "heteroatoms"),
    "halogen": ("halogen", "halogens"), "hetatm": ("hetatm",), "helix": ("helix", "alpha", "alpha-helix"), "sheet": ("sheet", "beta", "beta-sheet"), "coil": ("coil", "loop", "turn"), "ligand": ("organic", "ligand", "ligands"), "water": ("solvent", "water", "sol", "wat", "hoh"),
    "aromatic": ("aromatic",), "acceptor": ("acc", "acceptor"), "donor": ("donor",), "lipophilic": ("lipo", "lipophilic"), "polar": ("polar",),
}
_WORD = {w: k for k, ws in WORDS.items() for w in ws}


class SelectionError(ValueError):
    pass


@dataclass
class Node:
    kind: str
    args: tuple = field(default_factory=tuple)


def parse(text: str) -> Node:
    """The tree of an expression; errors name the place."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SelectionError(f"at {at}: {text[at:]}")
        tokens.append(m[1])
        at = m.end()
    pos = 0

    def peek(k: int = 0) -> str:
        return tokens[pos + k].lower() if pos + k < len(tokens) else ""

    def take() -> str:
        nonlocal pos
        if pos >= len(tokens):
            raise SelectionError("unexpected end")
        pos += 1
        return tokens[pos - 1]

    def either() -> Node:
        parts = [both()]
        while peek() == "or":
            take()
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    def both() -> Node:
        parts = [unary()]
        while peek() == "and" or peek() in ("within", "near", "around"):
            if peek() == "and":
                take()
            parts.append(unary())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def unary() -> Node:
        word = peek()
        if word == "not":
            take()
            return Node("not", (unary(),))
        if word in ("within", "near", "around"):
            take()
            number = take()
            if not _NUMBER.match(number):
                raise SelectionError(f"{word} needs a number, not {number}")
            bonds = peek() in ("bond", "bonds")
            if bonds:
                take()
            if peek() in ("of", "from", "to"):
                take()
            if not bonds and peek() == "com":
                take()
                return Node("com", (float(number),))
            return Node("hops", (int(float(number)), unary())) if bonds else Node("within", (float(number), unary()))
        if word == "bonded":
            take()
            if peek() == "to":
                take()
            return Node("hops", (1, unary()))
        if word == "(":
            take()
            inner = either()
            if take() != ")":
                raise SelectionError("missing )")
            return inner
        return term()

    def term() -> Node:
        raw = take()
        word = raw.lower()
        if word in ("and", "or", ")"):
            raise SelectionError(f"unexpected {raw}")
        if peek() in ("==", "!=", "<=", ">=", "<", ">", "="):
            op, number = take(), take()
            if not _NUMBER.match(number):
                raise SelectionError(f"not a number: {number}")
            return Node("compare", (word, "==" if op == "=" else op, float(number)))
        if word == "chain" and peek() and peek() not in ("and", "or", ")", "within", "near", "around"):
            return Node("equals", ("chain_id", take().upper()))
        if word in ("resname", "resn"):
            return Node("equals", ("res_name", take().upper()))
        if word in ("resid", "resi", "resnum"):
            return Node("equals", ("res_seq", int(take())))
        if word in ("atom", "atoms"):
            return unary() if peek() and peek() not in ("and", "or", ")") else Node("word", ("all",))
        if word in _WORD:
            return Node("word", (_WORD[word],))
        symbol = NAMES.get(word, raw[0].upper() + raw[1:].lower())
        if symbol in elements():
            return Node("equals", ("symbol", symbol))
        if raw.upper() in RESIDUES:
            return Node("equals", ("res_name", raw.upper()))
        raise SelectionError(f"unknown term {raw}")

    tree = either()
    if pos != len(tokens):
        raise SelectionError(f"unexpected {tokens[pos]}")
    return tree


class Selector:
    """Selects from an atoms table (mol_id, idx, symbol, ...) with a bonds table (mol_id, a, b, ...) and an optional rings table (mol_id, atoms)."""

    def __init__(self, atoms: DataFrame, bonds: DataFrame, rings: DataFrame | None = None):
        self.bonds = bonds.select("mol_id", F.col("a").alias("idx"), F.col("b").alias("other")).union(bonds.select("mol_id", F.col("b").alias("idx"), F.col("a").alias("other")))
        if rings is not None and "in_ring" not in atoms.columns:
            inside = rings.select("mol_id", F.explode("atoms").alias("idx")).distinct().withColumn("in_ring", F.lit(True))
            atoms = atoms.join(inside, ["mol_id", "idx"], "left").withColumn("in_ring", F.coalesce("in_ring", F.lit(False)))
        self.atoms = atoms

    def _has(self, c: str) -> Column:
        return F.col(c) if c in self.atoms.columns else F.lit(None)

    def column(self, n: Node) -> Column | None:
        """The tree as one boolean column; None where it needs joins."""
        if n.kind in ("and", "or"):
            parts = [self.column(x) for x in n.args]
            return None if any(p is None for p in parts) else reduce((lambda a, b: a & b) if n.kind == "and" else (lambda a, b: a | b), parts)
        if n.kind == "not":
            c = self.column(n.args[0])
            return None if c is None else ~c
        s = F.col("symbol")
        if n.kind == "compare":
            prop, op, x = n.args
            table = F.create_map(*[v for k, m in MASS.items() for v in (F.lit(k), F.lit(m))])
            if prop == "mass":
                c = F.coalesce(self._has("mass"), F.try_element_at(table, s))
            elif prop in ("charge", "sasa", "mlpc", "logpc"):
                c = self._has({"charge": "partial_charge"}.get(prop, prop)).cast("double")
            else:
                raise SelectionError(f"unknown property {prop}")
            c = F.coalesce(c, F.lit(0.0))
            return {"==": c == x, "!=": c != x, "<": c < x, "<=": c <= x, ">": c > x, ">=": c >= x}[op]
        if n.kind == "equals":
            c, x = n.args
            own = self._has(c)
            return F.coalesce((F.upper(own) if c == "res_name" else own) == F.lit(x), F.lit(False))
        if n.kind == "word":
            res, het, ss = F.upper(self._has("res_name").cast("string")), self._has("is_hetatm").cast("boolean"), self._has("ss_type").cast("string")
            plain = {
                "all": F.lit(True), "none": F.lit(False), "heavy": s != "H", "heteroatom": ~s.isin("C", "H"), "halogen": s.isin("F", "Cl", "Br", "I", "At"), "hetatm": het, "helix": ss == "H", "sheet": ss == "E", "coil": ss.isin("C", "T", "S"),
                "ligand": het & ~res.isin(*WATER), "water": res.isin(*WATER), "aromatic": self._has("aromatic").cast("boolean"), "acceptor": s.isin("N", "O", "S", "F", "Cl", "Br"), "polar": s.isin("N", "O", "F"), "ring": self._has("in_ring").cast("boolean"), "nonring": ~F.coalesce(self._has("in_ring").cast("boolean"), F.lit(False)),
            }
            return F.coalesce(plain[n.args[0]], F.lit(False)) if n.args[0] in plain else None
        return None

    def keys(self, n: Node) -> DataFrame:
        """(mol_id, idx) of the selected atoms."""
        c = self.column(n)
        if c is not None:
            return self.atoms.where(c).select("mol_id", "idx")
        on = ["mol_id", "idx"]
        if n.kind == "and":
            pure = [x for x in n.args if self.column(x) is not None]
            rest = [x for x in n.args if self.column(x) is None]
            base = self.atoms.where(self.column(Node("and", tuple(pure)))).select(*on) if pure else self.keys(rest.pop(0))
            return reduce(lambda a, x: a.join(self.keys(x), on, "left_semi"), rest, base)
        if n.kind == "or":
            return reduce(lambda a, b: a.union(b), [self.keys(x) for x in n.args]).distinct()
        if n.kind == "not":
            return self.atoms.select(*on).join(self.keys(n.args[0]), on, "left_anti")
        if n.kind == "hops":
            got = self.keys(n.args[1])
            for _ in range(n.args[0]):
                got = got.union(got.join(self.bonds, on).select("mol_id", F.col("other").alias("idx"))).distinct()
            return got
        if n.kind == "within":
            source = self.atoms.join(self.keys(n.args[1]), on, "left_semi").select("mol_id", "x", "y", "z")
            return range_join(self.atoms.select(*on, "x", "y", "z"), source, n.args[0], ["mol_id"], ["x", "y", "z"], "left_semi").select(*on).distinct()
        if n.kind == "com":
            m = F.coalesce(F.try_element_at(F.create_map(*[v for k, w in MASS.items() for v in (F.lit(k), F.lit(w))]), F.col("symbol")), F.lit(0.0))
            com = self.atoms.groupBy("mol_id").agg(*[(F.sum(m * F.col(k)) / F.sum(m)).alias(f"c{k}") for k in "xyz"])
            d2 = reduce(lambda a, b: a + b, [F.pow(F.col(k) - F.col(f"c{k}"), 2) for k in "xyz"])
            return self.atoms.join(com, "mol_id").where(d2 <= n.args[0] ** 2).select(*on)
        if n.kind == "word":
            symbol = self.atoms.select("mol_id", F.col("idx").alias("other"), F.col("symbol").alias("near"))
            near = self.bonds.join(symbol, ["mol_id", "other"])
            if n.args[0] == "donor":
                return self.atoms.where("symbol = 'H'").select(*on).join(near.where("near in ('N', 'O', 'S')"), on, "left_semi")
            kept = self.atoms.where("symbol in ('C', 'H')").select(*on).join(near.where("near in ('N', 'O', 'F')"), on, "left_anti")
            return kept.union(self.atoms.where("symbol in ('S', 'P', 'Si', 'Cl', 'Br', 'I')").select(*on))
        raise SelectionError(n.kind)

    def select(self, text: str) -> DataFrame:
        return self.keys(parse(text))

    def count(self, text: str) -> DataFrame:
        """(mol_id, n) with 0 for molecules without a selected atom."""
        c = self.column(parse(text))
        if c is not None:
            return self.atoms.groupBy("mol_id").agg(F.count_if(c).alias("n"))
        hit = self.select(text).groupBy("mol_id").agg(F.count("*").alias("k"))
        return self.atoms.select("mol_id").distinct().join(hit, "mol_id", "left").select("mol_id", F.coalesce("k", F.lit(0)).alias("n"))

    def sum_property(self, prop: str, text: str = "all") -> DataFrame:
        """(mol_id, total) of a numeric column, or of the element's mass, over the selected atoms."""
        value = F.col(prop) if prop in self.atoms.columns else F.try_element_at(F.create_map(*[v for k, w in MASS.items() for v in (F.lit(k), F.lit(w))]), F.col("symbol"))
        c = self.column(parse(text))
        chosen = self.atoms.where(c) if c is not None else self.atoms.join(self.select(text), ["mol_id", "idx"], "left_semi")
        return chosen.groupBy("mol_id").agg(F.sum(value).alias("total"))

    def summary(self) -> DataFrame:
        """(mol_id, atoms, donors, acceptors, lipophilic, polar, heavy): how many atoms of each kind a molecule has."""
        out = self.count("all").withColumnRenamed("n", "atoms")
        for name, text in (("donors", "donor"), ("acceptors", "acceptor"), ("lipophilic", "lipo"), ("polar", "polar"), ("heavy", "heavy")):
            out = out.join(self.count(text).withColumnRenamed("n", name), "mol_id")
        return out
