"""Words and normal forms shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a longest run of letters or digits.
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """The lower-cased words of a text in order; null gives null, a text without words an empty array."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def without_space(text: Column) -> Column:
    """The text without any white space, otherwise as it is."""
    return F.regexp_replace(text, r"(?U)\s+", "")
