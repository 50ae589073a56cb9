"""Column functions on line notations. All are Arrow-batched; a text that can't be read gives null."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATOM = "struct<idx:int,symbol:string,formal_charge:int,isotope:int,n_h:int,aromatic:boolean,hyb:string>"
BOND = "struct<idx:int,a:int,b:int,order_kek:int,aromatic:boolean,in_ring:boolean>"
MOLECULE = f"formula string, weight double, atoms array<{ATOM}>, bonds array<{BOND}>, rings array<array<int>>, error string"


def _each(s: pd.Series, f: Callable) -> list:
    """f of the molecule of each text, None where the text can't be read; equal texts of a batch once."""
    from crucible.chem.graph import Molecule
    from crucible.chem.smiles import SmilesError

    known: dict[str, object] = {}
    out = []
    for text in s:
        if text is None or text != text:
            out.append(None)
            continue
        if text not in known:
            try:
                known[text] = f(Molecule(text))
            except (SmilesError, KeyError):
                known[text] = None
        out.append(known[text])
    return out


def shipped() -> None:
    """Gives the workers this package, where a session is there and its workers may not have it."""
    from pyspark.sql import SparkSession

    from crucible.runtime import ship

    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)


def _udf(kind: str, f: Callable) -> Callable[[Column | str], Column]:
    shipped()

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(_each(s, f()), dtype=object)

    return run


def parse(smiles: Column | str, once: bool = False, cyclic: bool = False) -> Column:
    """The molecule as a struct of formula, weight, atoms, bonds, rings and error; error tells why a text can't be read.

    With `cyclic` a last field holds the atoms that lie on a cycle of any size; rings end at 20 atoms.
    """
    shipped()

    @F.pandas_udf(MOLECULE + ", cyclic array<int>" * cyclic)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from crucible.chem.graph import Molecule
        from crucible.chem.smiles import SmilesError

        def one(text: str | None) -> tuple:
            try:
                if text is None or text != text:
                    raise SmilesError("no text")
                m = Molecule(text)
            except (SmilesError, KeyError) as e:
                return (None, None, None, None, None, str(e), *[None] * cyclic)
            atoms = [dict(idx=i, symbol=m.symbol[i], formal_charge=m.charge[i], isotope=m.isotope[i] or None, n_h=m.hydrogens[i], aromatic=m.aromatic[i], hyb=m.hyb[i]) for i in range(m.n)]
            bonds = [dict(idx=k, a=a, b=b, order_kek=m.order[k], aromatic=m.arom_bond[k], in_ring=m.ring_bond[k]) for k, (a, b) in enumerate(m.ends)]
            return (m.formula(), m.weight(), atoms, bonds, m.rings, None, *[m.cyclic()] * cyclic)

        for s in batches:
            known = {text: one(text) for text in s.unique()}
            rows = [known[text] for text in s]
            yield pd.DataFrame(rows, columns=["formula", "weight", "atoms", "bonds", "rings", "error", *["cyclic"] * cyclic])

    return (run.asNondeterministic() if once else run)(smiles)


def descriptors(smiles: Column | str, names: list[str]) -> Column:
    """A struct of doubles, one a name; only the kernels these need are run. Unknown names raise KeyError on the driver."""
    from crucible.chem.descriptors import FAMILY_OF

    shipped()
    for n in names:
        FAMILY_OF[n]

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from crucible.chem.descriptors import compute

        for s in batches:
            yield pd.Series(_each(s, lambda m: compute(m, names)), dtype=object)

    v = run(smiles)
    return F.when(v.isNotNull(), F.struct(*[F.element_at(v, i + 1).alias(n) for i, n in enumerate(names)]))


def descriptor_table(df: DataFrame, id_col: str, smiles_col: str, names: list[str]) -> DataFrame:
    """(id, one double a name) of the rows whose text can be read; the others don't come out. One pass, also for hundreds of names."""
    from crucible.chem.descriptors import FAMILY_OF

    shipped()
    for n in names:
        FAMILY_OF[n]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        from crucible.chem.descriptors import compute

        for b in batches:
            got = [(i, v) for i, v in zip(b["id"], _each(b["s"], lambda m: np.array(compute(m, names), float)), strict=True) if v is not None]
            out = pd.DataFrame(np.array([v for _, v in got]).reshape(-1, len(names)), columns=names)
            out.insert(0, "id", [i for i, _ in got])
            yield out

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), F.col(smiles_col).alias("s")).mapInPandas(run, f"id {kind}, " + ", ".join(f"`{n}` double" for n in names)).withColumnRenamed("id", id_col)


def fingerprint(smiles: Column | str, kind: str = "morgan", bits: int = 2048) -> Column:
    """The sorted numbers of the set bits; kinds are morgan, topological, combined (the two side by side) and keys."""

    def make() -> Callable:
        from crucible.chem import patterns as p

        return {
            "morgan": lambda m: p.morgan_bits(m, bits=bits),
            "topological": lambda m: p.path_bits(m, bits=bits),
            "combined": lambda m: p.morgan_bits(m, bits=bits) + [bits + b for b in p.path_bits(m, bits=bits)],
            "keys": p.key_bits,
        }[kind]

    return _udf("array<int>", make)(smiles)


def scaffold(smiles: Column | str) -> Column:
    """The ring systems with their linkers as a SMILES; empty for an acyclic molecule."""

    def make() -> Callable:
        from crucible.chem.patterns import scaffold as f

        return f

    return _udf("string", make)(smiles)


def rewritten(smiles: Column | str) -> Column:
    """The molecule written again with Kekulé bonds."""

    def make() -> Callable:
        from crucible.chem.patterns import write_smiles

        return write_smiles

    return _udf("string", make)(smiles)


def substructure_matches(smiles: Column | str, query: str) -> Column:
    """The distinct atom sets on which the query stands; the query is read once a worker."""

    def make() -> Callable:
        from crucible.chem.graph import Molecule
        from crucible.chem.patterns import match_sets

        q = Molecule(query)
        return lambda m: match_sets(m, q)

    return _udf("array<array<int>>", make)(smiles)


def has_substructure(smiles: Column | str, query: str) -> Column:
    return F.size(substructure_matches(smiles, query)) > 0


def formula_fragments(formula: Column | str) -> Column:
    """Tokens of a condensed formula: elements with counts and brackets."""
    return F.regexp_extract_all(formula if isinstance(formula, Column) else F.col(formula), F.lit(r"([A-Z][a-z]?[0-9]*|\(|\)[0-9]*)"), 1)


# --- tables -----------------------------------------------------------------


def molecules(df: DataFrame, id_col: str, smiles_col: str, cyclic: bool = False) -> DataFrame:
    """(mol_id, smiles, formula, weight, atoms, bonds, rings, error), with `cyclic` also the atoms on a cycle of any size.

    The reader counts as not deterministic here, so that Spark runs it once a row however often its parts are used or filtered
    by; filter rows before.
    """
    return df.select(F.col(id_col).alias("mol_id"), F.col(smiles_col).alias("smiles"), parse(smiles_col, once=True, cyclic=cyclic).alias("m")).select("mol_id", "smiles", "m.*")


def atoms(mols: DataFrame) -> DataFrame:
    return mols.select("mol_id", F.inline("atoms"))


def bonds(mols: DataFrame) -> DataFrame:
    return mols.select("mol_id", F.inline("bonds"))


def rings(mols: DataFrame) -> DataFrame:
    return mols.select("mol_id", F.posexplode("rings").alias("ring_id", "atoms"))


def neighbours(mols: DataFrame) -> DataFrame:
    """Bonds in both directions: (mol_id, idx, other, order_kek, aromatic)."""
    b = bonds(mols)
    return b.select("mol_id", F.col("a").alias("idx"), F.col("b").alias("other"), "order_kek", "aromatic").union(b.select("mol_id", F.col("b").alias("idx"), F.col("a").alias("other"), "order_kek", "aromatic"))


def degrees(mols: DataFrame) -> DataFrame:
    """(mol_id, idx, deg) with 0 for single atoms; one aggregation inside the molecule's row, no shuffle."""
    deg = F.transform("atoms", lambda x: F.struct(x["idx"].alias("idx"), x["symbol"].alias("symbol"), F.size(F.filter("bonds", lambda y: (y["a"] == x["idx"]) | (y["b"] == x["idx"]))).alias("deg")))
    return mols.where("atoms is not null").select("mol_id", F.inline(deg))


def shortest_paths(df: DataFrame, id_col: str, smiles_col: str) -> DataFrame:
    """(mol_id, i, j, d), i < j among heavy atoms; d is null between fragments."""

    @F.pandas_udf("array<struct<i:int,j:int,d:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        def pairs(m):  # noqa: ANN001, ANN202
            d = m.distances()
            return [dict(i=i, j=j, d=int(d[i, j]) if np.isfinite(d[i, j]) else None) for i in range(len(d)) for j in range(i + 1, len(d))]

        for s in batches:
            yield pd.Series(_each(s, pairs), dtype=object)

    return df.select(F.col(id_col).alias("mol_id"), F.inline(run(smiles_col)))
