"""Nested values kept as text, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ints(text: Column, separator: str) -> Column:
    """Integers joined by a literal separator; empty items are skipped."""
    return F.transform(F.filter(F.split(text, f"\\Q{separator}\\E"), lambda x: x != ""), lambda x: x.cast("int"))


def joined(array: Column, separator: str) -> Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), separator)


def key_values(text: Column) -> Column:
    """Lines 'key:value', cut at the last colon, as map of doubles."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains(":"))
    key = lambda x: F.regexp_extract(x, "^(.*):[^:]*$", 1)
    value = lambda x: F.trim(F.regexp_extract(x, ":([^:]*)$", 1)).cast("double")
    pairs = F.transform(lines, lambda x: F.struct(key(x).alias("key"), value(x).alias("value")))
    return F.map_from_entries(pairs)


def key_value_text(features: Column) -> Column:
    """A map as lines 'key:value' in key order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(features)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), "\n")


def csv_block(text: Column) -> Column:
    """A header line and value lines as map: the first two columns go, the last value line counts."""
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    cells = lambda line: F.split(line, ",")
    body = lambda line: F.slice(cells(line), 3, F.greatest(F.size(cells(line)) - 2, F.lit(0)))
    return F.map_from_arrays(body(F.element_at(lines, 1)), F.transform(body(F.element_at(lines, -1)), lambda x: x.cast("double")))


def spaces(text: Column) -> Column:
    """Blocks 'Space:' with lines below, apart by empty lines, as array of (space, body)."""
    blocks = F.filter(F.split(text, "\n\n"), lambda b: b.contains(":\n"))
    return F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, r"^\s*([^\n]*?):\n", 1).alias("space"), F.regexp_replace(b, r"^\s*[^\n]*?:\n", "").alias("body")))


def samples(text: Column) -> Column:
    """Numbers on lines; what is no number or nan is left out."""
    numbers = F.transform(F.split(text, "\n"), lambda x: F.when(F.trim(x).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(x).cast("double")))
    return F.filter(numbers, lambda x: x.isNotNull())
