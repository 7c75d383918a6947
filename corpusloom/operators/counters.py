"""Nested counters: a map of maps of numbers for each key, counted from rows and merged between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _nested(cells: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Maps of (keys, outer, inner, n), inner and outer keys in order."""
    inner = cells.groupBy(*keys, "outer").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("inner", "n")))).alias("_m"))
    return inner.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("outer", F.map_entries("_m").alias("_e")))).alias("_o")).select(
        *keys, F.map_from_entries(F.transform("_o", lambda x: F.struct(x["outer"].alias("key"), F.map_from_entries(x["_e"]).alias("value")))).alias(column)
    )


def counted(rows: DataFrame, keys: list[str], outer: str, inner: str, column: str = "counters") -> DataFrame:
    """(keys, column): how many rows each pair of ``outer`` and ``inner`` has, as map<outer, map<inner, n>>. Rows are counted in
    each task before the shuffle, so a busy key sends its distinct pairs only. A null outer or inner counts as ""."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cells = rows.select(*keys, text(outer).alias("outer"), text(inner).alias("inner")).groupBy(*keys, "outer", "inner").agg(F.count("*").alias("n"))
    return _nested(cells, keys, column)


def merged(tables: list[DataFrame], keys: list[str], column: str = "counters") -> DataFrame:
    """One table out of several with a map<string, map<string, long>>: the maps of equal keys summed pair by pair, whatever the
    names in them. Null maps and empty inner maps add nothing; a null number counts as 0; keys without a pair are left out."""
    cells = None
    for t in tables:
        outer = t.select(*keys, F.explode(column).alias("outer", "_i"))
        part = outer.select(*keys, "outer", F.explode("_i").alias("inner", "n"))
        cells = part if cells is None else cells.unionByName(part)
    return _nested(cells.groupBy(*keys, "outer", "inner").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n")), keys, column)


def from_json(text: Column) -> Column:
    """A nested counter of its JSON text; null for what isn't one."""
    return F.from_json(text, "map<string, map<string, bigint>>")


def shown(counters: Column) -> Column:
    """outer:inner=n,inner=n;outer:... in the maps' order."""
    pairs = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return F.array_join(F.transform(F.map_entries(counters), lambda o: F.concat(o["key"], F.lit(":"), pairs(o["value"]))), ";")
