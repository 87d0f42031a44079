"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of characters that are neither alphabetic nor numeric.
SEPARATORS = r"[^\p{IsAlphabetic}\p{N}]+"


def tokens(text: Column) -> Column:
    """Words in order, repeats kept: split first, lower-cased afterwards. Null gives null."""
    return F.transform(F.filter(F.split(text, SEPARATORS), lambda t: t != ""), lambda t: F.lower(t))


def sanitized(name: Column) -> Column:
    """Everything but ASCII letters and digits replaced by an underscore."""
    return F.regexp_replace(name, "[^A-Za-z0-9]", "_")
