"""Tokenisers as column expressions; a null text has no tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[a-z]+(?:'[a-z]+)?"
FEATURE = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """ASCII words of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def features(text: Column) -> Column:
    """Runs of letters, digits and ``_`` of the lower-cased text, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(FEATURE), F.lit(0))
