"""Operator 11: the trie of conversations' common beginnings, rolled up by pointer jumping.

A node is a sequence of first turns, known by a digest: four sums of turn hashes times powers of a
base, modulo primes below 2^31. Such sums can be put together, so the digests of all beginnings of a
conversation come from one sort by range, whatever its length: each task sums its own stretch, and
what a conversation has in the tasks before is added afterwards (one row for each task). A turn that
two conversations share at other places costs a multiplication by a power. Texts are never shuffled.

Children know their parent's digest. The rollup then doubles: in each round a node adds its sums to
those of the ancestor 2^r turns up, and learns that ancestor's own ancestor. After as many rounds as the
depth has binary digits each node holds the sums of its whole subtree. Nodes that nobody adds to and
that have no ancestor so far up are done and leave the rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common

#: Each below 2^31, so products of two remainders fit 62 bits.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1664525011, 1013904223, 1812433253)
#: Turns of another conversation that one begins with, at most; conversations of a family share them.
MOST_SHARED, FAMILY = 8, 5
_P = np.array(PRIMES, np.int64)


def _packed(lanes: list[Column], hi: str, lo: str) -> list[Column]:
    """Four remainders as two longs."""
    return [(F.shiftleft(a, 31) + b).alias(n) for n, a, b in ((hi, *lanes[:2]), (lo, *lanes[2:]))]


def _lanes(hi: Column, lo: Column) -> list[Column]:
    low = F.lit((1 << 31) - 1)
    return [x for c in (hi, lo) for x in (F.shiftright(c, 31), c.bitwiseAND(low))]


def _unpacked(hi: int, lo: int) -> list[int]:
    return [x for v in (hi, lo) for x in (v >> 31, v & ((1 << 31) - 1))]


def _powers(n: int) -> np.ndarray:
    """Row k: the bases to the power k, for k from 0 to n."""
    out = np.ones((1, 4), np.int64)
    while len(out) <= n:
        step = np.array([pow(b, len(out), p) for b, p in zip(BASES, PRIMES, strict=True)], np.int64)
        out = np.concatenate((out, out * step % _P))
    return out[: n + 1]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, digest, n_bytes): places of turns in the task's part of their conversation, and
    the sums up to each turn and before it."""
    part = TaskContext.get().partitionId()
    held, place, sums = None, 0, np.zeros(4, np.int64)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column(0).to_numpy()
        turn = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(n, 4).astype(np.int64) % _P
        starts = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
        sizes = np.diff(np.append(starts, n))
        at = np.arange(n) - np.repeat(starts, sizes) + 1
        term = turn * _powers(int(sizes.max()))[at] % _P
        first = int(sizes[0]) if conv[0] == held else 0  # turns of the conversation that the last batch ended in
        if first:
            term[:first] = term[:first] * np.array([pow(b, place, p) for b, p in zip(BASES, PRIMES, strict=True)], np.int64) % _P
            at[:first] += place
        up_to = np.cumsum(term, axis=0)
        up_to -= np.repeat(up_to[starts] - term[starts], sizes, axis=0)
        up_to[:first] += sums
        up_to %= _P
        before = (up_to - term) % _P
        held, place, sums = conv[-1], int(at[-1]), up_to[-1]
        longs = [pa.array(x[:, k] << 31 | x[:, k + 1]) for x in (up_to, before) for k in (0, 2)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), batch.column(0), pa.array(at), *longs, batch.column(2)], names=_TURNS)


_TURNS = ["part", "conv_id", "place", "hi", "lo", "up_hi", "up_lo", "n_bytes"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, hi, lo, up_hi, up_lo, n_bytes) of all turns: place from 1, digests of the beginnings
    that end with the turn and before it, UTF-8 bytes of the text.

    Turns stand by ``turn`` (null first), equal ones by the md5 of role and text; repeated rows are turns
    of their own. A null role or text is empty; rows with a null conv_id are left out."""
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    ranges = rows.repartitionByRange(common.shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    turns = common.written(ranges.select("conv_id", "digest", "n_bytes").mapInArrow(_summed, ", ".join(f"{c} long" for c in _TURNS)), "turns")

    # one row for each task: what its first conversation has in the tasks before
    ends = turns.groupBy("part").agg(F.min("conv_id"), F.max("conv_id"), F.max_by(F.struct("place", "hi", "lo"), F.struct("conv_id", "place"))).orderBy("part").collect()
    carried, last, place, sums = [], None, 0, [0] * 4
    for part, first, end, (at, hi, lo) in ends:
        now, own = at, _unpacked(hi, lo)
        if first == last:
            power = [pow(b, place, p) for b, p in zip(BASES, PRIMES, strict=True)]
            carried.append((part, first, place, *sums, *power))
            if first == end:
                now, own = place + at, [(s + w * o) % p for s, w, o, p in zip(sums, power, own, PRIMES, strict=True)]
        last, place, sums = end, now, own
    if not carried:
        return turns.drop("part")
    names = [f"{n}{k}" for n in ("sum", "power") for k in range(4)]
    before = spark.createDataFrame(carried, ", ".join(f"{c} long" for c in ["part", "conv_id", "more", *names]))
    joined = turns.join(F.broadcast(before), ["part", "conv_id"], "left")

    def moved(hi: str, lo: str) -> list[Column]:
        lanes = [(F.col(f"sum{k}") + F.col(f"power{k}") * x) % p for k, (x, p) in enumerate(zip(_lanes(F.col(hi), F.col(lo)), PRIMES, strict=True))]
        return [F.coalesce(c, F.col(n)).alias(n) for n, c in zip((hi, lo), _packed(lanes, hi, lo), strict=True)]

    return joined.select("conv_id", (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), *moved("hi", "lo"), *moved("up_hi", "up_lo"), "n_bytes")


def rebuilt_beginnings(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, hi, lo, up_hi, up_lo, n_bytes, last) of every beginning of every rebuilt conversation,
    from the one without turns (depth 0, digest 0, up null) on.

    A conversation c is rebuilt from the first h turns of c - c % 5 (c % 5 never negative; fewer if it has
    fewer, none if it isn't there) and its own turns after its first h; h is crc32(decimal c) % 9."""
    turns = numbered_turns(conversations)
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_SHARED + 1))
    per_conv = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("place") == shared, F.struct("hi", "lo"))).alias("skipped"))
    heads = turns.where((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("place") <= MOST_SHARED))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "hi", "lo", "up_hi", "up_lo", "n_bytes"))).alias("all_heads"))  # MOST_SHARED at most
    own = F.greatest(F.col("n") - shared, F.lit(0))
    convs = per_conv.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).join(heads, "base", "left")
    convs = convs.select("conv_id", F.coalesce(F.slice("all_heads", F.lit(1), shared.cast("int")), F.array().cast(heads.schema["all_heads"].dataType)).alias("heads"), "skipped", own.alias("own"))
    at = F.when(F.size("heads") > 0, F.element_at("heads", -1))
    convs = common.written(convs.withColumns({"n_heads": F.size("heads").cast("long"), "at_hi": F.coalesce(at["hi"], F.lit(0)), "at_lo": F.coalesce(at["lo"], F.lit(0))}), "conversations")

    deep = F.col("n_heads") + F.col("own")
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("hi"), zero.alias("lo"), none.alias("up_hi"), none.alias("up_lo"), zero.alias("n_bytes"), (deep == 0).alias("last"))
    first = convs.select("conv_id", deep.alias("deep"), F.explode("heads").alias("t")).select("conv_id", F.col("t.place").alias("depth"), "t.hi", "t.lo", "t.up_hi", "t.up_lo", "t.n_bytes", (F.col("t.place") == F.col("deep")).alias("last"))

    per_key = convs.where("own > 0").select("conv_id", "own", deep.alias("deep"), "n_heads", "at_hi", "at_lo", "skipped.*").withColumnsRenamed({"hi": "gone_hi", "lo": "gone_lo"})
    rest = common.join_evenly(turns.where(F.col("place") > shared), per_key, ["conv_id"], "own")
    nearer = (shared - F.col("n_heads")).cast("int")  # places that own turns move up

    def moved(hi: str, lo: str) -> list[Column]:
        lanes = []
        columns = zip(_lanes(F.col("at_hi"), F.col("at_lo")), _lanes(F.coalesce("gone_hi", zero), F.coalesce("gone_lo", zero)), _lanes(F.col(hi), F.col(lo)), BASES, PRIMES, strict=True)
        for at, gone, sums, b, p in columns:
            power = F.element_at(F.array(*[F.lit(pow(b, -e, p)).cast("long") for e in range(MOST_SHARED + 1)]), nearer + 1)
            lanes.append((at + (sums - gone + p) % p * power) % p)
        return _packed(lanes, hi, lo)

    rest = rest.select("conv_id", (F.col("place") - nearer).alias("depth"), *moved("hi", "lo"), *moved("up_hi", "up_lo"), "n_bytes", (F.col("place") - nearer == F.col("deep")).alias("last"))
    return common.written(roots.unionByName(first).unionByName(rest), "beginnings")


def rollup(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(hi, lo, values...) with each of ``values`` summed over the node and all below it.

    nodes: hi, lo (the key, once each), up_hi, up_lo (the parent's, null for a root), depth (from 0) and
    ``values`` (long, not null). All parents are rows. As many rounds as the greatest depth has binary
    digits; every round is written to the shared folder, so a lost executor repeats one round. An empty
    table gives an empty table."""
    now = common.written(nodes.select("hi", "lo", "up_hi", "up_lo", "depth", *values), "rollup")
    deepest = now.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    done, step = [], 1
    while step <= deepest:
        added = now.where(F.col("depth") >= step).groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(*[F.sum(v).alias(f"_{v}") for v in values], F.count("*").alias("_n"))
        met = common.written(now.join(added, ["hi", "lo"], "left"), "rollup-sums")
        ahead = met.where((F.col("depth") >= step) & F.col("_n").isNotNull()).select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("up_hi").alias("to_hi"), F.col("up_lo").alias("to_lo"), "_n")
        movers = met.where(F.col("depth") >= 2 * step).select("hi", "lo", "up_hi", "up_lo")
        jumps = common.join_evenly(movers, ahead, ["up_hi", "up_lo"], "_n").select("hi", "lo", "to_hi", "to_lo") if 2 * step <= deepest else None
        sums = [(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]
        over = F.col("_n").isNull() & (F.col("depth") < 2 * step) if jumps is not None else F.lit(True)
        done.append(met.where(over).select("hi", "lo", *sums))
        if jumps is not None:
            now = common.written(met.where(~over).join(jumps, ["hi", "lo"], "left").select("hi", "lo", F.col("to_hi").alias("up_hi"), F.col("to_lo").alias("up_lo"), "depth", *sums), "rollup")
        step *= 2
    if not done:
        return now.select("hi", "lo", *values)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (hi, lo, conv_id): the ids of each key in a batch as one text."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        hi, lo = (batch.column(k).to_numpy() for k in (0, 1))
        starts = np.flatnonzero(np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))))
        ids = [*map(str, batch.column(2).to_pylist())]
        texts = [",".join(ids[a:b]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True)]
        which = pa.array(starts)
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(which) for k in range(3)), pa.array(texts)], names=["hi", "lo", "first", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (hi, lo, first, ids): one digest for each key, read as a stream."""
    held, digest = None, None

    def row(keys: list, digests: list) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string())], names=["hi", "lo", "ends_sha256"])

    for batch in batches:
        keys, digests = [], []
        for hi, lo, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
            if (hi, lo) == held:
                digest.update(b"," + ids.encode())
                continue
            if held is not None:
                keys.append(held)
                digests.append(digest.hexdigest())
            held, digest = (hi, lo), hashlib.sha256(ids.encode())
        yield row(keys, digests)
    if held is not None:
        yield row([held], [digest.hexdigest()])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256): SHA-256 of the decimal conv_ids of each key, ascending, joined by commas.

    Ids are put together by ranges of key and id first; what one task then reads of a key of very many
    ids is a few long texts, one after the other."""
    n = common.shuffle_partitions(ends.sparkSession)
    listed = ends.select("hi", "lo", "conv_id").repartitionByRange(n, "hi", "lo", "conv_id").sortWithinPartitions("hi", "lo", "conv_id").mapInArrow(_listed, "hi long, lo long, first long, ids string")
    return listed.repartition(n, "hi", "lo").sortWithinPartitions("hi", "lo", "first").mapInArrow(_digested, "hi long, lo long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row (all long but the last) for each node of the trie of rebuilt conversations: conv_id (smallest
    member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens
    (UTF-8 bytes of texts that need not be stored again, summed over the subtree), ends_sha256, hi, lo.

    conversations: conv_id, turn, role, text; other columns are ignored, whatever their names. How turns are
    ordered and conversations rebuilt say ``numbered_turns`` and ``rebuilt_beginnings``. Rows with a null
    conv_id are left out, so a table of nothing else gives no node, as an empty one does; repeated rows
    are turns of their own. No conversation, however long or common, is gathered in one task."""
    begun = rebuilt_beginnings(conversations.select("conv_id", "turn", "role", "text"))
    nodes = begun.groupBy("depth", "hi", "lo").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("up_hi").alias("up_hi"), F.min("up_lo").alias("up_lo"), F.min("n_bytes").alias("n_bytes"))
    nodes = common.written(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.count("*").alias("n_children"))
    nodes = common.written(nodes.join(children, ["hi", "lo"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    summed = rollup(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")}), ["n_leaves", "saved_tokens"])
    whole = nodes.join(summed, ["hi", "lo"]).join(ends_digests(begun.where("last")), ["hi", "lo"], "left")
    whole = common.written(whole.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))), "nodes")
    parents = nodes.where("n_children > 0").select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = common.join_evenly(whole.where("depth > 0").withColumnRenamed("n_children", "children"), parents, ["up_hi", "up_lo"], "n_children").withColumnRenamed("children", "n_children")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "hi", "lo"]
    return below.select(*out).unionByName(whole.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*out))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(common.table(spark, sf_dir, "conversations")).drop("hi", "lo")


OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(text, '') AS text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, turn
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place FROM turns),
ids AS (
  SELECT conv_id, count(*) AS n, conv_id - ((conv_id % 5) + 5) % 5 AS base,
         xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
               lambda a, b: list_reduce([xor(a, b), 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT],
                 lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 9 AS h
  FROM turns GROUP BY conv_id),
conv AS (SELECT i.*, least(i.h, coalesce(b.n, 0)) AS heads FROM ids i LEFT JOIN ids b ON b.conv_id = i.base),
rebuilt AS (
  SELECT c.conv_id, p.place AS depth, p.digest, p.text FROM conv c JOIN placed p ON p.conv_id = c.base AND p.place <= c.h
  UNION ALL
  SELECT c.conv_id, p.place - c.h + c.heads, p.digest, p.text FROM conv c JOIN placed p ON p.conv_id = c.conv_id AND p.place > c.h),
steps AS (
  SELECT conv_id, depth, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key, strlen(text) AS n_bytes FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', 0 FROM conv),
ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM steps),
nodes AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(n_bytes) AS n_bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM ended GROUP BY key, depth),
children AS (SELECT key[:32 * (depth - 1)] AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.key = n.key),
subtree AS (
  SELECT s.key, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.n_bytes)::BIGINT AS saved_tokens
  FROM counted u JOIN steps s ON s.conv_id = u.conv_id AND s.depth <= u.depth GROUP BY s.key)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, t.n_leaves, t.saved_tokens, n.ends_sha256
FROM counted n JOIN subtree t ON t.key = n.key LEFT JOIN nodes p ON n.depth > 0 AND p.key = n.key[:32 * (n.depth - 1)]
"""
