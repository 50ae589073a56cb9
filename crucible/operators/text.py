"""Small column helpers on strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is cut from the ends of a line notation.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"


def stripped(c: Column | str) -> Column:
    """The text without outer white space; null stays null."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def blank_to_null(c: Column | str) -> Column:
    """The stripped text, null where nothing is left."""
    return F.nullif(stripped(c), F.lit(""))
