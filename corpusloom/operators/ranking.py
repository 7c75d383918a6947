"""Nearest samples to targets, top-k, batches, renumbering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.tokens import text_ids
from corpusloom.sources.shared import saver, shared_path

#: Targets, and characters of them as JSON, that are sent to every task at once.
MAX_BROADCAST_TARGETS, MAX_BROADCAST_CHARS = 10_000, 64_000_000


def target_distances(targets: DataFrame, samples: DataFrame, distance: Callable[[Column, Column], Column]) -> DataFrame:
    """Every sample's distance to every target (targets: target_id, target; samples: ..., features).

    The targets are the stated query set: they are broadcast in blocks of bounded rows and bytes, each
    of which is one pass over the samples, which aren't shuffled."""
    rows, chars = targets.agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct("target")))), F.lit(0))).first()
    n = max(1, -(-rows // MAX_BROADCAST_TARGETS), -(-chars // MAX_BROADCAST_CHARS))
    numbered = numbered_rows(targets, [F.col("target_id")], "_block") if n > 1 else targets
    found = None
    for k in range(n):
        block = numbered.where(F.col("_block") % n == k).drop("_block") if n > 1 else targets
        part = samples.crossJoin(F.broadcast(block))
        found = part if found is None else found.unionByName(part)
    return found.withColumn("dist", distance(F.col("target"), F.col("features")))


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key in a total order; Spark cuts each task's rows to k before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def batches(df: DataFrame, order: list, size: int, start: int = 0) -> DataFrame:
    """Columns of ``df``, then batch_num (from 1), offset, limit (where the next batch begins) and max_rows,
    for each row after ``start`` in a total order. No task sees all rows."""
    numbered = numbered_rows(df, order)
    total = numbered.count()
    at = F.col("row_num") - start
    offset = F.floor(at / size) * size + start
    return numbered.where(F.col("row_num") >= start).withColumns({"batch_num": F.floor(at / size) + 1, "offset": offset.cast("long"), "limit": (offset + size).cast("long"), "max_rows": F.lit(total).cast("long")})


def _sorted_once(df: DataFrame, order: list) -> DataFrame:
    """Rows in sorted range partitions, written once, with each row's partition and place in it."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return saver(df.sparkSession, "sorted")(ordered.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)}))


def _with_before(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """Adds _before: the sum of _n (sums: _part, _n; a row for each partition of a sort) over the partitions before."""
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(sums.select("_part", before.alias("_before"))), "_part")


def numbered_rows(df: DataFrame, order: list, column: str = "row_num") -> DataFrame:
    """Rows numbered from 0 in a total order, without a window over all rows.

    One written partitioning gives both the counts and the numbers. An empty table gives an empty table;
    equal rows get numbers of their own; columns named ``column``, _part, _at, _n and _before are replaced."""
    held = _sorted_once(df.drop(column), order)
    counts = held.groupBy("_part").agg(F.count("*").alias("_n"))
    return _with_before(held, counts).withColumn(column, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def running_sums(df: DataFrame, order: list, value: str, column: str = "before") -> DataFrame:
    """The sum of ``value`` over the rows before each row in a total order; a task sees one range of the
    order. Nulls add nothing; other rules as in numbered_rows."""
    held = _sorted_once(df.drop(column), order)
    sums = held.groupBy("_part").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_n"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    local = held.withColumn(column, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return _with_before(local, sums).withColumn(column, F.col(column) + F.col("_before")).drop("_part", "_at", "_before")


#: Left rows that a round of greedy_one_to_one settles.
ROUND_ROWS = 500


def greedy_one_to_one(pairs: DataFrame, left: str = "a", right: str = "b", dist: str = "dist", round_rows: int = ROUND_ROWS) -> DataFrame:
    """(left, right, dist): each left row in id order takes its nearest right row that is still free (ties: the least right id).

    In rounds of ``round_rows`` left rows, least ids first. When a round comes, all lesser rows have what they take; of a row's
    pairs with free right rows only the ``round_rows`` nearest can matter, as no more rows of the round choose before it. So a
    round is one task of round_rows x round_rows pairs at most, and each pair is read in one round only.
    Pairs with a null id are left out; of equal pairs the nearest counts; a left row without a free pair has no row."""
    spark = pairs.sparkSession
    rows = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(left, right).agg(F.min(dist).cast("double").alias(dist))
    order = numbered_rows(rows.select(left).distinct(), [F.col(left)], "_n").select(left, F.floor(F.col("_n") / round_rows).alias("_round"))
    path = shared_path(spark, "pairs")
    rows.join(order, left).write.partitionBy("_round").parquet(path)
    held = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_round", T.LongType())])).parquet(path)
    last = order.agg(F.max("_round")).first()[0]
    done = rows.limit(0)
    for k in range(0 if last is None else last + 1):
        own = held.where(F.col("_round") == k).drop("_round")
        near = top_k(own.join(done.select(right), right, "left_anti").select(left, right, dist), [left], [dist, right], round_rows, "_rank").drop("_rank")
        settled = saver(spark, "settled")(near.withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(_in_turn, rows.schema))
        done = settled if k == 0 else done.unionByName(settled)
    return done


def _in_turn(group):
    """(left, right, dist) of one round: left rows in order take their nearest free right row."""
    group = group.select([0, 1, 2])
    taken, out = set(), []
    a, b, d = (group.column(k).to_pylist() for k in range(3))
    for k in sorted(range(len(a)), key=lambda k: (a[k], d[k], b[k])):
        if b[k] not in taken and (not out or a[out[-1]] != a[k]):
            taken.add(b[k])
            out.append(k)
    return group.take(out)


def fixed_length_rows(df: DataFrame, order: list, ids: str, length: int, batch: int, copies: int = 1) -> DataFrame:
    """(row, ids): the ids of all rows of ``df``, one after the other in a total order, cut into rows of ``length`` that
    span them, and clipped to whole steps of ``copies`` x ``batch`` rows; copies beyond the first are not written out.

    ids: an array, or a text, whose code points are the ids; a text is sorted and written as it is. Each row of ``df`` gives
    its pieces by their offsets. A piece that fills a window is a row by itself; only the pieces at the ends of
    ``df``'s rows come together by the window's number, so nothing is concatenated as a whole. Null ids are none. Too
    little for one step is an error, as a step of nothing can't be trained on."""
    kind = dict(df.dtypes)[ids]
    size, none = (F.length, F.lit("")) if kind == "string" else (F.size, F.array().cast(kind))
    sized = df.select(*[c for c in df.columns if c != ids], F.coalesce(ids, none).alias("_ids")).withColumn("_size", size("_ids").cast("long"))
    placed = running_sums(sized, order, "_size", "_from")
    total = placed.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    rows = total // (batch * length * copies) * batch
    if not rows:
        raise ValueError(f"{total} ids are less than a step of {batch * length * copies}")
    begin, end = F.col("_from"), F.col("_from") + F.col("_size")
    first, last = F.floor(begin / length), F.least(F.floor((end - 1) / length), F.lit(rows - 1))
    placed = placed.where((F.col("_size") > 0) & (first <= last)).select(F.struct("_from", "_size").alias("_k"), "_ids")
    placed = (text_ids(placed, "_k", "_ids").withColumnRenamed("ids", "_ids") if kind == "string" else placed).select("_k.*", "_ids")

    def piece(window: Column) -> Column:
        low = F.greatest(window * length, begin)
        return F.struct(window.alias("row"), low.alias("low"), F.slice("_ids", (low - begin + 1).cast("int"), (F.least((window + 1) * length, end) - low).cast("int")).alias("ids"))

    def pieces(a: Column, b: Column) -> DataFrame:
        """The pieces of the windows from a to b."""
        return placed.where(a <= b).select(F.explode(F.transform(F.sequence(a, b), piece)).alias("p"))

    inner, outer = F.ceil(begin / length), F.least(F.floor(end / length) - 1, F.lit(rows - 1))
    ends = placed.select(F.explode(F.transform(F.filter(F.array_distinct(F.array(first, last)), lambda w: (w < inner) | (w > outer)), piece)).alias("p"))
    windows = ends.groupBy("p.row").agg(F.sort_array(F.collect_list(F.struct("p.low", "p.ids"))).alias("_p"))
    spanning = windows.select("row", F.flatten(F.transform("_p", lambda x: x["ids"])).alias("ids"))
    return pieces(inner, outer).select("p.row", "p.ids").unionByName(spanning)
