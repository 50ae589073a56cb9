"""Column function: the identity key of a molecule."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def molecule_key(smiles: Column | str) -> Column:
    """A key equal for two SMILES of one molecule (largest fragment, without stereo, isotopes and protonation).

    Null where the text is null, blank or can't be read. Equal texts of a batch are worked out once.
    """
    from crucible.functions.molecules import shipped

    shipped()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from crucible.chem.identity import molecule_keys

        for s in batches:
            codes, texts = pd.factorize(s)
            texts = list(texts)
            keys = [k for i in range(0, len(texts), 1000) for k in molecule_keys(texts[i : i + 1000])]
            yield pd.Series([keys[c] if c >= 0 else None for c in codes], dtype=object)

    return run(smiles)
