"""Operator 7: near-duplicate classes by DartMinHash.

A document is the weighted set of its five-word shingles (weight: how often it stands). DartMinHash
(Christiani 2020) throws hashed darts into each element's region, weight by rank, and keeps the
dart of least rank for each coordinate. Coordinates are cut into bands; documents that agree on a
band share a bucket.

Buckets are never expanded into pairs. The least member of a bucket is its centre, and every other
member is compared with it exactly. Components of these links settle almost everything. Where
members of one centre still belong to several components, its members are dealt out to chunks of
bounded size, those of its largest component apart; each pair of chunks that may hold an unknown
link is one small task that compares all members of different components exactly and returns a
spanning forest of the links it finds. So every pair that shares
a bucket is decided, and what is returned grows with the members, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common
from corpusloom.llm.components import components
from corpusloom.llm.words import Shingler, mix, weighted_jaccard

BANDS, ROWS = 25, 5
#: Members and characters of a chunk.
CHUNK_ROWS, CHUNK_CHARS = 800, 6_000_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def dart_minhash(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """k coordinates for each weighted set (none may be empty).

    An element's darts are a Poisson process in rank for each of its weight cells [0,1), [1,2), [2,4)...:
    gaps between ranks and the weight of each dart follow from hashes alone, so sets that share an
    element share its darts up to the lesser weight. Darts of rank up to t / (sum of weights) are
    thrown, t = k ln k + 2 k; sets with an empty coordinate throw twice as far."""
    out = np.zeros((len(sets), k), np.uint64)
    reach = np.array([(k * np.log(k) + 2 * k) / w.sum() for _, w in sets])
    todo = np.arange(len(sets))
    while len(todo):
        element = np.concatenate([sets[d][0] for d in todo])
        weight = np.concatenate([sets[d][1] for d in todo])
        owner = np.repeat(np.arange(len(todo)), [len(sets[d][0]) for d in todo])
        cells = [(element, weight, owner, 0)]
        top, level = weight.max(), 1
        while 2.0 ** (level - 1) < top:
            more = weight > 2.0 ** (level - 1)
            cells.append((element[more], weight[more], owner[more], level))
            level += 1
        keys, ranks, marks = [], [], []
        for e, w, o, level in cells:
            low = 0.0 if level == 0 else 2.0 ** (level - 1)
            width = max(1.0, low)
            state = mix(e ^ mix(np.full(1, level + 1, np.uint64)))
            rank, limit = np.zeros(len(e)), reach[todo[o]]
            while len(state):
                state = state + _GOLDEN
                h = mix(state)
                rank = rank - np.log(((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / width
                stays = rank <= limit
                state, rank, limit, w, o, h = state[stays], rank[stays], limit[stays], w[stays], o[stays], h[stays]
                mark = mix(h ^ _GOLDEN)
                inside = low + width * ((mark >> np.uint64(32)).astype(float) * 2.0**-32) < w if level else np.ones(len(w), bool)
                keys.append((o * k + ((mark & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64))[inside])
                ranks.append(rank[inside])
                marks.append(mark[inside])
        key, rank, mark = np.concatenate(keys), np.concatenate(ranks), np.concatenate(marks)
        least = np.full(len(todo) * k, np.inf)
        np.minimum.at(least, key, rank)
        first = rank == least[key]
        found = np.zeros(len(todo) * k, np.uint64)
        found[key[first]] = mark[first]
        out[todo] = found.reshape(-1, k)
        again = np.isinf(least).reshape(-1, k).any(1)
        todo = todo[again]
        reach[todo] *= 2
    return out


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.tile(np.arange(bands, dtype=np.uint64), (len(signatures), 1))
    for r in range(rows):
        h = mix(h * _GOLDEN + signatures[:, r::rows][:, :bands])
    return h.view(np.int64)


def _banded(docs: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """(doc_id, h1, h2, bands) of every row with an id: 128 bits of the text, and its band hashes (none without words)."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            all_bands: list = [None] * batch.num_rows
            held: list[tuple[int, tuple]] = []
            size = 0

            def flush() -> None:
                if held:
                    for (k, _), b in zip(held, band_hashes(dart_minhash([s for _, s in held], bands * rows), bands, rows), strict=True):
                        all_bands[k] = b
                    held.clear()

            for k, found in enumerate(s for b in range(0, batch.num_rows, 500) for s in map(shingler.shingles_of, shingler.words_of(batch.column(3).slice(b, 500)))):
                if len(found[0]):
                    held.append((k, found))
                    size += len(found[0])
                if size > 400_000:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(all_bands, pa.list_(pa.int64()))], names=["doc_id", "h1", "h2", "bands"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows_in = docs.where("doc_id is not null").select("doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"), text.alias("text"))
    return rows_in.mapInArrow(common.tidy(signed), "doc_id long, h1 long, h2 long, bands array<long>")


def _compared(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """(a, b, sim) of the pairs whose exact similarity is ``least`` at least."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, held = Shingler(words), None, None
        for batch in batches:
            a, b, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            own, other = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
            for k in range(len(a)):
                theirs = other[k].as_py()
                if theirs != last:
                    last, held = theirs, shingler.shingles(theirs)
                sim = weighted_jaccard(shingler.shingles(own[k].as_py()), held)
                if sim >= least:
                    at.append((a[k], b[k], sim))
            columns = list(zip(*at, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["a", "b", "sim"])

    # merged at every size: what a small input could broadcast, a large one can't
    own, other = (texts.select(F.col("node").alias(n), F.col("text").alias(c)).hint("merge") for n, c in (("a", "own"), ("b", "other")))
    joined = pairs.join(own, "a").join(other, "b")
    return joined.select("a", "b", "own", "other").mapInArrow(common.tidy(measured), "a long, b long, sim double")


def _linked_in_chunks(members: DataFrame, texts: DataFrame, words: int, near: float) -> DataFrame:
    """(a, b): components of ``members`` (centre, node, component) that have a link within a centre's members.

    Chunks of the centre's largest component meet the chunks of all others, which also meet each other;
    two chunks of the largest component never meet. Texts are joined only where components are open."""
    sized = members.join(texts.select("node", F.length("text").alias("chars")).hint("merge"), "node")
    parts = sized.groupBy("centre", "component").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    whole = parts.groupBy("centre").agg(F.max(F.struct("n", "component", "chars")).alias("main"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.count("*").alias("parts")).where("parts > 1")
    chunks = lambda n, chars: F.greatest(F.ceil(n / CHUNK_ROWS), F.ceil(chars / CHUNK_CHARS)).cast("int")
    open_ = common.written(whole.select("centre", "n", F.col("main.component").alias("main"), chunks(F.col("main.n"), F.col("main.chars")).alias("own"), chunks(F.col("n") - F.col("main.n"), F.col("chars") - F.col("main.chars")).alias("others")), "open")
    h = F.xxhash64("node")
    dealt = common.join_evenly(members, open_, ["centre"], "n").withColumn("chunk", F.when(F.col("component") == F.col("main"), F.pmod(h, F.col("own"))).otherwise(F.col("own") + F.pmod(h, F.col("others"))).cast("int"))
    first = F.when(F.col("chunk") < F.col("own"), F.col("own")).otherwise(F.lit(0))
    own = dealt.withColumn("meets", F.sequence(first, F.col("own") + F.col("others") - 1)).select("centre", "node", "component", "chunk", "meets")
    with_text = own.join(texts.hint("merge"), "node").withColumn("other", F.explode("meets"))
    paired = with_text.select("centre", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "component", "text")

    def compared(key: tuple, group: pa.Table) -> pa.Table:
        shingler, same = Shingler(words), key[1].as_py() == key[2].as_py()
        chunk, component = group["chunk"].to_pylist(), group["component"].to_pylist()
        sets = [shingler.shingles(t) for t in common.as_bytes(group["text"].combine_chunks())]
        total = np.array([s[1].sum() for s in sets])
        rows = [k for k in range(len(sets)) if chunk[k] == key[1].as_py()]
        columns = rows if same else [k for k in range(len(sets)) if chunk[k] != key[1].as_py()]
        if not rows or not columns:
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 2, names=["a", "b"])
        shingle, weight = (np.concatenate([sets[c][k] for c in columns]) for k in (0, 1))
        order = np.argsort(shingle, kind="stable")
        owner = np.repeat(np.arange(len(columns)), [len(sets[c][0]) for c in columns])[order]
        shingle, weight = shingle[order], weight[order]
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        links, size = [], total[columns]
        for r in rows:
            first = np.searchsorted(shingle, sets[r][0])
            n = np.searchsorted(shingle, sets[r][0], "right") - first
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            least = np.bincount(owner[at], np.minimum(np.repeat(sets[r][1], n), weight[at]), len(columns))
            for k in np.flatnonzero(least >= near * (size + total[r] - least)).tolist():
                x, y = find(component[r]), find(component[columns[k]])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    links.append((component[r], component[columns[k]]))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return paired.groupBy("centre", "i", "j").applyInArrow(compared, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = 5, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id) for every distinct id: documents linked by weighted Jaccard similarity of
    ``similarity`` or more on ``words``-word shingles, directly or over others, share the least id as class.

    Equal texts share a class, empty and null ones too. A text of fewer words is one shingle. An id
    with several texts links their classes, so all of them are one. Rows with a null id are left out. A pair of
    similarity 0.8 shares a band with probability 0.9999. Other columns are not read. An empty table
    gives an empty table."""
    near = similarity - 1e-9
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = common.written(_banded(docs, bands, rows, words), "signatures")
    equal = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"))
    several_of = common.written(equal.where("n > 1"), "equal-texts")
    found = common.written(common.join_evenly(signed.select("doc_id", "h1", "h2"), several_of, ["h1", "h2"], "n").select("doc_id", "h1", "h2", "node").distinct(), "copies")
    copies, moved = found.select("doc_id", "node").distinct(), found.where("doc_id <> node")
    nodes = signed.join(moved.select("doc_id", "h1", "h2"), ["doc_id", "h1", "h2"], "left_anti")
    # texts of one id that stand for it in several nodes: other ids' that it copies, and its own
    own = nodes.select("doc_id").join(moved.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("doc_id").alias("node"))
    several = moved.select("doc_id", "node").union(own).groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b <> most").drop("most")
    united = moved.select("doc_id", "node").union(own).join(several, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")
    bucketed = common.written(nodes.select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket")).distinct(), "buckets")
    pairs = common.written(_with_centres(bucketed).select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "pairs")

    members = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = common.written(docs.join(members.hint("merge"), docs["doc_id"] == members["node"], "left_semi").select(F.col("doc_id").alias("node"), F.coalesce("text", F.lit("")).alias("text")), "texts")
    links = common.written(_compared(pairs, texts, words, near).select("a", "b").union(united).distinct(), "edges")
    named = components(links)
    placed = pairs.select(F.col("a").alias("node"), F.col("b").alias("centre")).join(named, "node", "left").select("centre", "node", F.coalesce("component", "node").alias("component"))
    more = components(_linked_in_chunks(common.written(placed, "placed"), texts, words, near))
    joined = more.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    ids = signed.select("doc_id").distinct()
    of_node = ids.join(copies, "doc_id", "left").groupBy("doc_id").agg(F.coalesce(F.min("node"), F.col("doc_id")).alias("node"))
    of_component = of_node.join(named, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    return of_component.join(joined, "component", "left").select("doc_id", F.coalesce("whole", "component").alias("class_id"))


def _with_centres(bucketed: DataFrame) -> DataFrame:
    """(bucket, node, centre) of the members of buckets with more than one, without the centre itself."""
    centres = common.written(bucketed.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1"), "centres")
    return common.join_evenly(bucketed, centres, ["bucket"], "n").where("node <> centre")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
