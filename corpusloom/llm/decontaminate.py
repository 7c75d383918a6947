"""Operator 6: passages of benchmark items in documents, within an edit distance in words.

Words are the alphabet. The CGK embedding (Chakraborty, Goldenberg and Koucky 2016) walks through a
window: each step puts the current word out, and a random bit for step and word says whether to go
on to the next; few edits change few steps. Windows of a document start at every STRIDE-th word;
an item is embedded from each of its first STRIDE words, so one window of a copy is in line with
it. Windows are as long as the size class of the item, and all classes share one walk. Sampled
steps are hashed, SAMPLES times for each of several walks; where a hash is an item's, the exact edit
distance of the item to the best part of the text around decides. Walks of long windows drift further
apart, so the number of walks is derived for each size class: as many as seeded trials need until
RECALL of randomly edited windows, with the most edits allowed, share a sample.

A long item would need ever more walks. It is cut into parts of PART_WORDS at most: a copy with so many edits for each
word has a part with no more than its share of them, so the parts are looked up like items, and a window that meets one
stands for the whole item at the place where it would then begin.

Windows that can't hold an item are not embedded: an edit costs a passage two bigrams of words at
most, so a part of the text with fewer bigrams of items than that leaves has no hit. This loses nothing.

Items are the stated query set: they are sent to all tasks in blocks of ITEM_BLOCK, each one pass
over the documents, which are neither shuffled nor gathered.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import common
from corpusloom.llm.words import Shingler, mix

SAMPLES, STEPS_IN_SAMPLE, RECALL, TRIALS = 16, 3, 0.95, 400
#: Words between windows, for items of LONG words or more; shorter items get windows at every word.
STRIDE, LONG, RATIO = 6, 12, 1.5
#: Items of more words are looked up by equal parts of as many words at most.
PART_WORDS = 200
ITEM_BLOCK, ITEM_WORDS = 5_000, 4_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _classes(longest: int) -> list[int]:
    out = [1]
    while out[-1] < longest:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return out


def _sample_steps(rng: np.random.Generator, c: int) -> list[int]:
    """One step from each of equal parts of the walk of a window of c words, so that they see different words."""
    edges = np.linspace(0, max(1, int(1.5 * c)), STEPS_IN_SAMPLE + 1).astype(int)
    return sorted({int(rng.integers(a, max(a + 1, b))) for a, b in zip(edges, edges[1:], strict=False)})


@functools.cache
def walks_for(c: int, edits: int, recall: float = RECALL) -> int:
    """Walks that a class of windows of c words needs: the least number with which ``recall`` of TRIALS
    pairs of windows share a sample. A pair is a window of distinct words and a copy with so many
    inserted, deleted and exchanged words, a third of each."""
    rng = np.random.default_rng(c)
    pad = np.zeros(3 * c + 3, np.uint64)
    own, other = [], []
    for _ in range(TRIALS):
        window = rng.integers(1, 2**63, c).astype(np.uint64)
        copy = window.tolist()
        for _ in range(edits):
            kind, at = rng.integers(3), int(rng.integers(len(copy)))
            copy[at : at + (kind > 0)] = [] if kind == 2 and len(copy) > 1 else [int(rng.integers(1, 2**63))]
        own.append(np.concatenate((window, pad))[: 3 * c + 3])
        other.append(np.concatenate((np.array(copy, np.uint64), pad))[: 3 * c + 3])
    both, row, steps = np.stack((np.stack(own), np.stack(other))), np.arange(TRIALS), max(1, int(1.5 * c))
    found = np.zeros(TRIALS, bool)
    for walk in itertools.count(1):
        place, equal = np.zeros((2, TRIALS), np.int64), np.zeros((steps, TRIALS), bool)
        for step in range(steps):
            out = np.stack((both[0][row, place[0]], both[1][row, place[1]]))
            equal[step] = out[0] == out[1]
            odd = rng.integers(0, 2**63, 1).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            place += (out * odd >> np.uint64(63)).astype(np.int64)
        for _ in range(SAMPLES):
            found |= equal[_sample_steps(rng, c)].all(0)
        if found.mean() >= recall:
            return walk


def _bigrams(words: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words."""
    return mix(words[:-1] * _ODD + words[1:])


def parts_of(n: int) -> list[tuple[int, int]]:
    """(begin, end) of the equal parts that an item of n words is looked up by."""
    count = -(-n // PART_WORDS)
    return [(n * k // count, n * (k + 1) // count) for k in range(count)]


class Index:
    """Hashes of the windows of items' parts, for one stride and least similarity. items: (item id, word hashes)."""

    def __init__(self, items: list[tuple[int, np.ndarray]], stride: int, similarity: float, seed: int = 1):
        self.items, self.stride = items, stride
        self.words = [w.tolist() for _, w in items]
        parts = [(k, begin, w[begin:end]) for k, (_, w) in enumerate(items) for begin, end in parts_of(len(w))]
        classes = _classes(max(len(w) for _, _, w in parts))
        of_class = defaultdict(list)  # the longest class that fits behind every first word
        for k, (_, _, w) in enumerate(parts):
            size = max(1, len(w) - stride + 1)
            of_class[max(c for c in classes if c <= size)].append(k)
        rng = np.random.default_rng(seed)
        self.steps = max(1, int(1.5 * max(of_class)))
        #: a window may hold more than its share of a part's edits, so the share is rounded up
        may_change = {c: any(int((1 - similarity) * len(parts[k][2]) + 1e-9) for k in members) for c, members in of_class.items()}
        walks = {c: walks_for(c, math.ceil((1 - similarity) * c - 1e-9) * may_change[c]) for c in sorted(of_class)}
        self.walks = max(walks.values())
        self.odd = rng.integers(0, 2**63, (self.walks, self.steps)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        #: by walk: steps to take, by step the numbers of the samples that take it, and the class of each sample
        self.length = [max(int(1.5 * c) for c in walks if walks[c] > walk) or 1 for walk in range(self.walks)]
        self.takes: list[list[list[int]]] = [[[] for _ in range(self.steps)] for _ in range(self.walks)]
        self.sample_class: list[list[int]] = [[c for c in walks if walks[c] > walk for _ in range(SAMPLES)] for walk in range(self.walks)]
        for walk, classes_of in enumerate(self.sample_class):
            for s, c in enumerate(classes_of):
                for step in _sample_steps(rng, c):
                    self.takes[walk][step].append(s)
        self.found: list[list[dict[int, list[tuple[int, int]]]]] = [[defaultdict(list) for _ in x] for x in self.sample_class]
        #: whether an item may have a hash, by its first bits: about sixteen slots for each of a class's starts
        most = max(sum(min(stride, len(parts[k][2])) for k in members) for members in of_class.values())
        self.rest = np.uint64(64 - min(16, max(8, int(16 * most).bit_length())))
        self.maybe = [np.zeros((len(x), 1 << 64 - int(self.rest)), bool) for x in self.sample_class]
        for c, members in of_class.items():
            text, at, length, starts = [], [], 0, []
            for number, begin, w in (parts[k] for k in members):
                for o in range(min(stride, len(w))):
                    starts.append((number, begin + o))
                    at.append(length)
                    text.append(np.concatenate((w[o:], np.zeros(self.steps + 1, np.uint64))))
                    length += len(text[-1])
            words, at = np.concatenate(text), np.array(at)
            for walk in range(walks[c]):
                hashes = self.embed(words, at, walk)
                for s, of in enumerate(self.sample_class[walk]):
                    if of == c:
                        self.maybe[walk][s, (hashes[s] >> self.rest).astype(np.int64)] = True
                        for h, start in zip(hashes[s].tolist(), starts, strict=True):
                            self.found[walk][s][h].append(start)
        self.keys = [[np.array(sorted(t), np.uint64) for t in row] for row in self.found]
        bigrams = np.concatenate([_bigrams(w) for _, w in items])
        self.shift = np.uint64(64 - min(24, max(12, int(64 * len(bigrams)).bit_length())))
        self.held = np.zeros(1 << 64 - int(self.shift), bool)
        self.held[(bigrams >> self.shift).astype(np.int64)] = True
        #: for each class: words before and behind a window's start that a part's passage may take, and the bigrams it has at least
        self.reach = []
        for members in of_class.values():
            sizes = np.array([len(parts[k][2]) for k in members])
            most = ((1 - similarity) * sizes + 1e-9).astype(int)
            self.reach.append((stride + int(most.max()), int((sizes + 2 * most).max()) + 2, int((sizes - 1 - 2 * most).min())))

    def possible(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Those of the windows around which there are enough bigrams of items."""
        held = self.held[(_bigrams(words) >> self.shift).astype(np.int64)]
        before = np.concatenate((np.zeros(1, np.int32), np.cumsum(held, dtype=np.int32)))
        passes = np.zeros(len(at), bool)
        for back, ahead, least in self.reach:
            passes |= before[np.minimum(at + ahead, len(held))] - before[np.maximum(at - back, 0)] >= least
        return at[passes]

    def embed(self, words: np.ndarray, at: np.ndarray, walk: int) -> list[np.ndarray]:
        """Sample hashes of the windows that start at ``at``; words are padded with zeros behind each text."""
        place = at.copy()
        hashes = [np.full(len(at), s + 1, np.uint64) for s in range(len(self.sample_class[walk]))]
        for step in range(self.length[walk]):
            out = words[place]
            for s in self.takes[walk][step]:
                np.multiply(hashes[s], _ODD, out=hashes[s])
                np.add(hashes[s], out, out=hashes[s])
            np.multiply(out, self.odd[walk, step], out=out)
            np.right_shift(out, np.uint64(63), out=out)
            np.add(place, out.view(np.int64), out=place)
        return hashes

    def candidates(self, words: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """(item's number, word where it would start) of windows that share a hash with an item."""
        out = set()
        for walk in range(self.walks):
            for s, h in enumerate(self.embed(words, at, walk)):
                likely = np.flatnonzero(self.maybe[walk][s][(h >> self.rest).astype(np.int64)])
                if len(likely):
                    keys = self.keys[walk][s]
                    likely = likely[keys[np.minimum(np.searchsorted(keys, h[likely]), len(keys) - 1)] == h[likely]]
                    for w in likely.tolist():
                        out.update((k, int(at[w]) - o) for k, o in self.found[walk][s][int(h[w])])
        return out


def nearest(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of an item to a part of a text, and the end of that part (first of equals)."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for w in item:
        new = row + 1
        np.minimum(new[1:], row[:-1] + (text != w), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


class Detector:
    def __init__(self, items: list[tuple[int, bytes]], similarity: float):
        self.shingler, self.similarity = Shingler(), similarity
        hashed = [(i, self.shingler.word_hashes(t)) for i, t in items]
        long, short = [x for x in hashed if len(x[1]) >= LONG], [x for x in hashed if 0 < len(x[1]) < LONG]
        self.indexes = [Index(x, stride, similarity) for x, stride in ((long, STRIDE), (short, 1)) if x]

    def hits(self, texts: pa.Array) -> list[dict[int, tuple[int, int, int]]]:
        """For each text: item id -> (distance, item's words, word where the passage ends)."""
        out: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        hashed = self.shingler.words_of(pc.fill_null(texts, ""))
        lengths = np.array([len(w) for w in hashed], np.int64)
        for index in self.indexes:
            checked: set[tuple[int, int, int]] = set()
            pad = np.zeros(index.steps + 1, np.uint64)
            words = np.concatenate([x for w in hashed for x in (w, pad)]) if len(texts) else pad
            begin = np.cumsum(lengths + len(pad)) - lengths - len(pad)
            counts = -(-lengths // index.stride)
            owner = np.repeat(np.arange(len(texts)), counts)
            at = begin[owner] + (np.arange(counts.sum()) - (np.cumsum(counts) - counts)[owner]) * index.stride
            at = index.possible(words, at)
            for k in range(0, len(at), 20_000):
                for number, start in sorted(index.candidates(words, at[k : k + 20_000])):
                    d = int(np.searchsorted(begin, max(start, 0), "right")) - 1 if start >= 0 else 0
                    # a start before the text belongs to the window's own text, whose first word is nearest
                    window = int(np.searchsorted(begin, min(start + index.stride, len(words) - 1), "right")) - 1
                    d = max(d, window)
                    start -= int(begin[d])
                    most = int((1 - self.similarity) * len(index.items[number][1]) + 1e-9)
                    slack = 0
                    if len(index.items[number][1]) > PART_WORDS:  # its parts give many starts, of which near ones are one check
                        slack = most
                        start -= start % (most + 1)
                        if (d, number, start) in checked:
                            continue
                        checked.add((d, number, start))
                    self._check(index, number, start, most, slack, hashed[d], out[d])
        return out

    def _check(self, index: Index, number: int, start: int, most: int, slack: int, text: np.ndarray, out: dict) -> None:
        """Looks for an item that begins at ``start``, or up to ``slack`` words behind it, give or take ``most``."""
        i, item = index.items[number]
        low = max(0, start - most - 1)
        part = text[low : max(0, start + slack + len(item) + most + 1)]
        if i in out and out[i][0] == 0:
            return
        if sum(map(set(part.tolist()).__contains__, index.words[number])) < len(item) - most:  # each word that isn't there costs an edit
            return
        distance, end = nearest(item, part)
        if distance <= most and (i not in out or (distance, low + end) < (out[i][0], out[i][2])):
            out[i] = (distance, len(item), low + end)


def _detector(tag: str, items: list[tuple[int, bytes]], similarity: float) -> Detector:
    """The detector of one block of items, kept by this worker from task to task."""
    return common.held_by_worker(("detector", tag), lambda: Detector(items, similarity))


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """Items in blocks whose number and words are bounded."""
    block, words = [], 0
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    for i, text in rows.orderBy("item_id", "text").toLocalIterator():
        block.append((i, text.encode()))
        words += text.count(" ") + 1
        if len(block) >= ITEM_BLOCK or words >= ITEM_WORDS:
            yield block
            block, words = [], 0
    if block:
        yield block


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, item_words, end_word) for every document with a passage whose edit
    distance in words to the item is at most (1 - similarity) of the item's words; the best passage.

    Words are runs without ASCII white space, A-Z lower-cased. Null and empty texts and items have no
    hits. Rows are independent: repeated rows give repeated hits, a null id stays null. Empty tables
    give no hits."""
    found = None
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    for block in _blocks(benchmark):
        sent, tag = docs.sparkSession.sparkContext.broadcast(block), common.uuid.uuid4().hex

        def scanned(batches: Iterator[pa.RecordBatch], sent=sent, tag=tag) -> Iterator[pa.RecordBatch]:
            detector = _detector(tag, sent.value, similarity)
            for whole in batches:
                for k in range(0, whole.num_rows, 200):
                    batch = whole.slice(k, 200)
                    hits = detector.hits(batch.column(1))
                    rows = [(d, i, *h) for d, one in zip(batch.column(0).to_pylist(), hits, strict=True) for i, h in sorted(one.items())]
                    columns = list(zip(*rows, strict=True)) or [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "distance", "item_words", "end_word"])

        hits = source.mapInArrow(common.tidy(scanned, holds=True), HITS)
        found = hits if found is None else found.union(hits)
    return found if found is not None else docs.sparkSession.createDataFrame([], HITS)


HITS = "doc_id long, item_id long, distance long, item_words long, end_word long"


def without_benchmark(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit, all columns as they are."""
    at = docs.columns.index(text_col)
    for block in _blocks(benchmark):
        sent, tag = docs.sparkSession.sparkContext.broadcast(block), common.uuid.uuid4().hex

        def clean(batches: Iterator[pa.RecordBatch], sent=sent, tag=tag) -> Iterator[pa.RecordBatch]:
            detector = _detector(tag, sent.value, similarity)
            for whole in batches:
                for k in range(0, whole.num_rows, 200):
                    batch = whole.slice(k, 200)
                    yield batch.filter(pa.array([not h for h in detector.hits(batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(common.tidy(clean, holds=True), T.StructType(docs.schema.fields))
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
