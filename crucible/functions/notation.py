"""Column functions on other notations and on the texts of SMILES; those on texts stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The tokens of a SMILES, each with its kind: fixed values.
TOKENS = {"bracket": r"\[[^\]]*\]", "atom": r"Br|Cl|[BCNOPSFIbcnops*]", "ring": r"%[0-9][0-9]|[0-9]", "bond": r"[-=#:$/\\~]", "branch": r"[()]", "dot": r"\."}
_ALL = "|".join(TOKENS.values())


def tokens(smiles: Column | str) -> Column:
    """An array of (token, kind, at): the tokens from left to right, at counted from 1 in tokens; what is no token is left out."""
    found = F.regexp_extract_all(F.col(smiles) if isinstance(smiles, str) else smiles, F.lit(f"({_ALL})"), 1)

    def kind(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in reversed(TOKENS.items()):
            out = F.when(t.rlike(f"^(?:{pattern})$"), name).otherwise(out)
        return out

    return F.transform(found, lambda t, i: F.struct(t.alias("token"), kind(t).alias("kind"), (i + 1).cast("int").alias("at")))


def bracket_atom(token: Column | str) -> Column:
    """(isotope, symbol, chirality, hydrogens, charge, class) of a bracket atom with its brackets; null where it is none."""
    t = F.col(token) if isinstance(token, str) else token
    pattern = r"^\[([0-9]*)([A-Z][a-z]?|se|as|te|si|[bcnops]|\*)(@{0,2}(?:[A-Z]{2}[0-9]+)?)(H?)([0-9]*)([-+]*)([0-9]*)(?::([0-9]+))?\]$"
    g = lambda k: F.regexp_extract(t, pattern, k)
    number = lambda c, d: F.coalesce(F.nullif(c, F.lit("")).cast("int"), d)
    sign = F.when(g(6).startswith("+"), 1).when(g(6).startswith("-"), -1).otherwise(0)
    h = F.when(g(4) == "H", number(g(5), F.lit(1))).otherwise(0)
    return F.when(
        t.rlike(pattern),
        F.struct(number(g(1), F.lit(None).cast("int")).alias("isotope"), g(2).alias("symbol"), g(3).alias("chirality"), h.alias("hydrogens"), (sign * number(g(7), F.length(g(6)))).alias("charge"), number(g(8), F.lit(None).cast("int")).alias("class")),
    )


def _text(kind: str, name: str, *args: object):  # noqa: ANN202
    from crucible.functions.molecules import shipped

    shipped()

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from crucible.chem import notation
        from crucible.chem.smiles import SmilesError

        f = getattr(notation, name)

        def one(t: str | None) -> object:
            if t is None or t != t:
                return None
            try:
                return f(t, *args)
            except (SmilesError, KeyError, ValueError, IndexError):
                return None

        for s in batches:
            known = {t: one(t) for t in s.unique()}
            yield pd.Series([known[t] for t in s], dtype=object)

    return run


def formula_to_smiles(formula: Column | str, start_valency: int = 0, end_valency: int = 0) -> Column:
    """A condensed formula as SMILES; null where it can't be read."""
    return _text("string", "formula_to_smiles", start_valency, end_valency)(formula)


def reversed_formula(formula: Column | str) -> Column:
    return _text("string", "reversed_formula")(formula)


def inchi_layers(inchi: Column | str) -> Column:
    """A map from a layer's letter to its text; the formula is 'formula', the version ''."""
    return _text("map<string,string>", "inchi_layers")(inchi)


def inchi_to_smiles(inchi: Column | str) -> Column:
    return _text("string", "inchi_to_smiles")(inchi)


def inchi_key(inchi: Column | str) -> Column:
    return _text("string", "inchi_key")(inchi)


def check_key(key: Column | str) -> Column:
    """Whether a key of the earlier form (14 letters, 9 letters and a check letter) ends in the right letter; in the JVM."""
    from crucible.chem.notation import _WEIGHTS

    k = F.regexp_replace(F.trim(key), "^InChIKey=", "")
    letters = F.concat(F.substring(k, 1, 14), F.substring(k, 16, 9))
    total = sum((F.ascii(F.substring(letters, i + 1, 1)) * w for i, w in enumerate(_WEIGHTS)), F.lit(0))
    return k.rlike("^[A-Z]{14}-[A-Z]{9}[A-Z]$") & (F.chr(total % 26 + 65) == F.substring(k, 25, 1))


def parse_list(text: Column | str) -> Column:
    """The numbers of a text such as "[1, 2.5]"; null for a text without brackets, null for an entry that is no number."""
    t = F.trim(text)
    inner = F.trim(F.substring(t, 2, 1_000_000_000))
    inner = F.regexp_replace(inner, r"\]$", "")
    parts = F.filter(F.transform(F.split(inner, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(t.rlike(r"(?s)^\[.*\]$"), F.transform(parts, lambda p: F.regexp_replace(p, "^['\"]|['\"]$", "").try_cast("double")))


def expand_lists(df: DataFrame, cols: list[str]) -> DataFrame:
    """List columns (arrays, or texts of lists) as columns name_0, name_1, ..., as many as the longest has; the names come from one aggregation."""
    for c in cols:
        if df.schema[c].dataType.simpleString() == "string":
            df = df.withColumn(c, parse_list(c))
    longest = df.agg(*[F.coalesce(F.max(F.size(c)), F.lit(0)).alias(c) for c in cols]).first()
    return df.select(*[x for x in df.columns if x not in cols], *[F.get(c, F.lit(i)).alias(f"{c}_{i}") for c in cols for i in range(max(0, longest[c]))])
