"""Column expressions on texts that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space is exactly these six characters: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[ \\x09-\\x0D]"


def without_spaces(text: Column) -> Column:
    """The text without any white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for ch in SPACES:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def words(text: Column) -> Column:
    """The runs of other characters than white space; an empty array for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    none = F.array().cast("array<string>")
    return F.when(inner == "", none).otherwise(F.split(inner, SPACE_CLASS + "+"))
