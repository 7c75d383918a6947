"""Distances of samples to targets by blocks of vectors: the nearest ones of each target, and all pairs.

The number of pairs is quadratic by nature. Vectors are packed into blocks of bounded size; a task holds the blocks of
some samples, one at a time, against broadcast blocks of targets, and keeps each target's nearest ones only, so that
pairs are neither rows nor shuffled. Sums run over the components in order, in doubles, as Spark's aggregate does."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.operators.ranking import numbered_rows, top_k
from corpusloom.sources.shared import saver

#: Components in a block, and the most rows of one; targets and bytes of them that are broadcast at once.
BLOCK_CELLS, BLOCK_ROWS = 65_536, 1024
MAX_BROADCAST_TARGETS, MAX_BROADCAST_BYTES = 20_000, 64_000_000
#: Tasks over the samples, at least; rows of a block of targets whose distances are computed together; rows that wait for a cut.
LEAST_TASKS, TOGETHER, WAITING = 32, 32, 50_000
#: Pairs that a task gives as rows, about.
TASK_PAIRS = 8_000_000


def _packer(schema: pa.Schema, has_key: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, features[, key]) to blocks of vectors of one length; dim is -1 for vectors that are null or hold a null."""

    def pack(batches):
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            sizes = np.fromiter((-1 if v is None else v for v in vectors.value_lengths().to_pylist()), np.int64, len(ids))
            if vectors.flatten().null_count:
                sizes[[i for i, v in enumerate(vectors.to_pylist()) if v is not None and None in v]] = -1
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                rows = int(max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(1, dim))))
                for k in range(0, len(at), rows):
                    own = pa.array(at[k : k + rows])
                    cells = vectors.take(own).flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes() if dim > 0 else b""
                    row = [[int(dim)], [ids.take(own).to_pylist()], [cells]] + ([[batch.column(2).take(own).to_pylist()]] if has_key else [])
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    return pack


def _packed(df: DataFrame, id_col: str, vector: str, prefix: str, key: Column | None = None) -> DataFrame:
    """(dim, ids, cells[, keys]) with a prefix; rows without an id are left out."""
    columns = [F.col(id_col).cast("long"), F.col(vector).cast("array<double>")] + ([] if key is None else [key.alias("_key")])
    rows = df.where(F.col(id_col).isNotNull()).select(*columns)
    fields = [T.StructField(f"{prefix}dim", T.LongType()), T.StructField(f"{prefix}ids", T.ArrayType(T.LongType())), T.StructField(f"{prefix}cells", T.BinaryType())]
    if key is not None:
        fields.append(T.StructField(f"{prefix}keys", T.ArrayType(rows.schema["_key"].dataType)))
    schema = T.StructType(fields)
    return rows.mapInArrow(_packer(to_arrow_schema(schema), key is not None), schema)


def _met(targets: DataFrame, samples: DataFrame, scan, schema: T.StructType, key: Column | None = None, task_pairs: int | None = None) -> DataFrame:
    """``scan`` over each task's blocks of samples (vec_id, features), each with all blocks of targets (target_id, target).

    Targets are broadcast in parts of bounded rows and bytes, each of which is one pass over the samples. task_pairs: more
    pairs than that for each task of a pass make more tasks."""
    spark = targets.sparkSession
    blocks = saver(spark, "targets")(_packed(targets, "target_id", "target", "t_").withColumn("t_block", F.monotonically_increasing_id()))
    rows, size = blocks.agg(F.coalesce(F.sum(F.size("t_ids")), F.lit(0)), F.coalesce(F.sum(F.length("t_cells")), F.lit(0))).first()
    n = max(1, -(-rows // MAX_BROADCAST_TARGETS), -(-size // MAX_BROADCAST_BYTES))
    blocks = numbered_rows(blocks, [F.col("t_block")], "_part_of") if n > 1 else blocks
    tasks = max(LEAST_TASKS, 2 * spark.sparkContext.defaultParallelism)
    if task_pairs:
        tasks = max(tasks, -(-samples.count() * -(-rows // n) // task_pairs))
    dealt = _packed(samples.repartition(tasks, "vec_id"), "vec_id", "features", "s_", key)
    found = None
    for k in range(n):
        own = blocks.where(F.col("_part_of") % n == k).drop("_part_of") if n > 1 else blocks
        part = dealt.crossJoin(F.broadcast(own)).mapInArrow(scan, schema)
        found = part if found is None else found.unionByName(part)
    return found


def _block(batch: pa.RecordBatch, row: int, prefix: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Length, ids and vectors of a block."""
    dim = batch.column(f"{prefix}dim")[row].as_py()
    ids = batch.column(f"{prefix}ids")[row].values.to_numpy(zero_copy_only=False)
    return dim, ids, np.frombuffer(batch.column(f"{prefix}cells")[row].as_buffer(), np.float64).reshape(len(ids), max(dim, 0))


def _distances(t: np.ndarray, s: np.ndarray, metric: str) -> np.ndarray:
    """Rows of ``t`` by columns of ``s`` (components by rows); metric: feature (over squares), euclid."""
    out, one = np.zeros((len(t), s.shape[1])), np.empty((len(t), s.shape[1]))
    with np.errstate(all="ignore"):
        for d in range(t.shape[1]):
            np.subtract(t[:, d : d + 1], s[d], out=one)
            np.abs(one, out=one) if metric == "feature" else np.multiply(one, one, out=one)
            out += one
        return np.sqrt(out, out=out)


class _Best:
    """The nearest samples so far of each target of a block, by key."""

    def __init__(self, ids: np.ndarray, k: int, slack: float):
        self.ids, self.k, self.slack = ids, k, slack
        self.bound = np.full((len(ids), 0), np.inf)
        self.parts, self.waiting, self.held = [], 0, 0

    def add(self, first: int, dist: np.ndarray, samples: np.ndarray, code: int, left_out: np.ndarray | None = None) -> None:
        """dist: of targets ``first`` and following to samples of one key; left_out: pairs that aren't candidates."""
        if code >= self.bound.shape[1]:
            self.bound = np.pad(self.bound, ((0, 0), (0, code + 1 - self.bound.shape[1])), constant_values=np.inf)
        bound = self.bound[first : first + len(dist), code]
        near = ~(dist > bound[:, None])  # a NaN is no less than any bound, but the farthest of all
        if left_out is not None:
            near &= ~left_out
        if dist.shape[1] > self.k and near.sum() > 2 * self.k * len(dist):
            ranked = dist if left_out is None else np.where(left_out, np.nan, dist)
            with np.errstate(all="ignore"):
                most = np.partition(ranked, self.k - 1, axis=1)[:, self.k - 1] + self.slack
            np.copyto(bound, most, where=most < bound)
            near &= ~(dist > bound[:, None])
        at, place = np.nonzero(near)
        if len(at):
            self.parts.append((at + first, np.full(len(at), code), dist[at, place], samples[place]))
            self.waiting += len(at)
            if self.waiting > max(WAITING, 2 * self.held):
                self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        """Keeps the first k of each target and key, those within ``slack`` behind them, and of equal distances the k least ids."""
        if not self.parts:
            return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        at, code, dist, ids = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, dist, code, at))
        at, code, dist, ids = at[order], code[order], dist[order], ids[order]

        def rank(new: np.ndarray) -> np.ndarray:
            starts = np.flatnonzero(new)
            return np.arange(len(new)) - np.repeat(starts, np.diff(np.append(starts, len(new))))

        new = np.append(True, (at[1:] != at[:-1]) | (code[1:] != code[:-1]))
        place = rank(new)
        last = place == self.k - 1
        with np.errstate(all="ignore"):
            full = dist[last] + self.slack
            self.bound[at[last], code[last]] = np.where(np.isnan(full), np.inf, full)
            keep = place < self.k
            if self.slack:
                other = np.append(True, dist[1:] != dist[:-1])
                keep |= ~(dist > self.bound[at, code]) & (rank(new | other) < self.k)
        kept = (at[keep], code[keep], dist[keep], ids[keep])
        self.parts, self.held, self.waiting = [kept], int(keep.sum()), 0
        return kept


def nearest(targets: DataFrame, samples: DataFrame, k: int, metric: str = "feature", key: Column | None = None, digits: int | None = None, zero_apart: bool = False) -> DataFrame:
    """(target_id, vec_id, dist, key): pairs that hold the ``k`` nearest samples of each target, by distance and id, and of
    each value of ``key`` (a column of the samples with few values). Each task gives its own; the caller ranks them.

    targets: (target_id, target); samples: (vec_id, features, columns of ``key``). digits: the caller ranks by distances
    rounded to so many. zero_apart: the k nearest at distance 0 and the k nearest others. Pairs of vectors of different
    lengths, or with nulls, have no distance and are no candidates."""
    slack = 0.0 if digits is None else 1.01 * 10.0**-digits
    keyed = key is not None
    fields = [T.StructField("target_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("dist", T.DoubleType())]
    if keyed:
        fields.append(T.StructField("key", samples.select(key.alias("key")).schema["key"].dataType))
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def scan(batches):
        best: dict[int, _Best] = {}
        codes: dict = {}
        for batch in batches:
            for row in range(batch.num_rows):
                (dim, ids, t), (other, vec_ids, s) = _block(batch, row, "t_"), _block(batch, row, "s_")
                if dim != other or dim < 0:
                    continue
                own = best.setdefault(batch.column("t_block")[row].as_py(), _Best(ids, k, slack))
                kinds = np.array([codes.setdefault(x, len(codes)) for x in batch.column("s_keys")[row].as_py()]) if keyed else np.zeros(len(vec_ids), np.int64)
                order = np.lexsort((vec_ids, kinds))
                kinds, vec_ids, s = kinds[order], vec_ids[order], np.ascontiguousarray(s[order].T)
                if metric == "feature":
                    t, s = t * t, s * s
                cuts = [*np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1])), len(kinds)]
                for first in range(0, len(t), TOGETHER):
                    dist = _distances(t[first : first + TOGETHER], s, metric)
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        part, zero = dist[:, a:b], None
                        if zero_apart:
                            zero = part == 0
                            own.add(first, part, vec_ids[a:b], 2 * kinds[a] + 1, ~zero)
                        own.add(first, part, vec_ids[a:b], 2 * kinds[a], zero)
        values = list(codes)
        for own in best.values():
            at, code, dist, vec_ids = own.cut()
            columns = [pa.array(own.ids[at]), pa.array(vec_ids), pa.array(dist)]
            if keyed:
                columns.append(pa.array(values, arrow.field("key").type).take(pa.array(code // 2)))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return _met(targets, samples, scan, schema, key)


def pair_distances(targets: DataFrame, samples: DataFrame) -> DataFrame:
    """(target_id, vec_id, dist, euclid) of all pairs, with null distances where one is null, holds a null or is shorter.

    Its rows are targets times samples, so the result grows with the square of a table that gives both; the tasks become more, not larger."""
    schema = T.StructType([T.StructField("target_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("dist", T.DoubleType()), T.StructField("euclid", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def scan(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                (dim, ids, t), (other, vec_ids, s) = _block(batch, row, "t_"), _block(batch, row, "s_")
                same = dim == other and dim >= 0
                s = np.ascontiguousarray(s.T)
                squares = s * s
                for first in range(0, len(ids), TOGETHER):
                    own, x = ids[first : first + TOGETHER], t[first : first + TOGETHER]
                    n = len(own) * len(vec_ids)
                    far = [pa.array(_distances(a, b, m).ravel()) if same else pa.nulls(n, pa.float64()) for a, b, m in ((x * x, squares, "feature"), (x, s, "euclid"))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, len(vec_ids))), pa.array(np.tile(vec_ids, len(own))), *far], schema=arrow)

    return _met(targets, samples, scan, schema, task_pairs=TASK_PAIRS)


#: Targets, and nearest samples of each, that a round of one_to_one starts with.
ROUND_TARGETS, ROUND_NEAREST = 4096, 64


def one_to_one(targets: DataFrame, samples: DataFrame, digits: int, round_targets: int = ROUND_TARGETS, round_nearest: int = ROUND_NEAREST) -> DataFrame:
    """(a, b, dist): each target in id order takes its nearest sample that is still free, by rounded distance and id.

    A round ranks the nearest free samples of the next targets and lets them choose in turn, in one task of a bounded number
    of rows, up to the first target whose list is used up; the next round begins there. A round that settles less than a
    quarter makes the lists longer and takes fewer targets; one of as many samples as targets settles all of them."""
    spark = targets.sparkSession
    order = numbered_rows(targets, [F.col("target_id")], "_n")
    last = order.count()
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("dist", T.DoubleType()), T.StructField("n", T.LongType())])
    done, at, rows, k = spark.createDataFrame([], schema), 0, round_targets, round_nearest
    while at < last:
        own = order.where(F.col("_n").between(at, at + rows - 1))
        free = samples.join(done.select(F.col("b").alias("vec_id")), "vec_id", "left_anti")
        near = nearest(own.select("target_id", "target"), free, k, digits=digits).withColumn("dist", F.round("dist", digits))
        near = top_k(near, ["target_id"], ["dist", "vec_id"], k, "_rank").join(own.select("target_id", "_n"), "target_id").select("target_id", "vec_id", "dist", "_n")
        settled = saver(spark, "settled")(near.withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(_in_turn(k), schema))
        stop = settled.where("b is null").agg(F.min("n")).first()[0]
        done = done.unionByName(settled.where("b is not null"))
        new = at + rows if stop is None else stop
        if new - at < rows // 4 and k < rows:
            rows, k = max(1, rows // 2), 2 * k
        elif new - at == rows and k > round_nearest:
            rows, k = 2 * rows, k // 2
        at = new
    return done.select("a", "b", "dist")


def _in_turn(k: int):
    """Targets in order take their nearest free sample; a row with a null sample tells at which target's number a list of k was used up."""

    def choose(group: pa.Table) -> pa.Table:
        a, b, d, n = (group.column(c).to_numpy() for c in ("target_id", "vec_id", "dist", "_n"))
        order = np.lexsort((b, d, n))
        starts = np.flatnonzero(np.append(True, np.diff(n[order]) != 0))
        taken, out = set(), []
        for lo, hi in zip(starts, [*starts[1:], len(order)], strict=True):
            free = next((i for i in order[lo:hi] if b[i] not in taken), None)
            if free is not None:
                taken.add(b[free])
                out.append((int(a[free]), int(b[free]), float(d[free]), int(n[free])))
            elif hi - lo >= k:
                out.append((None, None, None, int(n[order[lo]])))
                break
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("a", "b", "dist", "n"), columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)})

    return choose
