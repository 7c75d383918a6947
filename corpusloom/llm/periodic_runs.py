"""Operator 12: periodic runs of words, by names of power-of-two blocks.

Karp, Miller and Rosenberg: blocks of 2^j words get the same name exactly where they are equal. A
block's name is the rank of the pair of names of its halves, so each level is one sort of pairs, and
nothing is hashed. Blocks that stand once in their text can't be part of a longer repeat: they are
not paired again, so levels shrink and end where no block repeats. The common extension of two
places is read off by descending through the levels.

A run of period q and length max(24, 3q) at least holds a place of every grid of step q from which
it goes on for some known number of words; the names of that length at the grid's neighbours say
which pairs of places are candidates, and extending those both ways gives the runs. Texts of a batch
lie side by side in one array; level 0 numbers words by text, so no block is shared between texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import common

MIN_WORDS, MIN_PERIODS = 24, 3
#: Pairs of grid places looked at together.
PAIRS_AT_ONCE = 2_000_000


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of keys among those that stand more than once, and where those stand."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    often = counts > 1
    rank = np.cumsum(often) - 1
    where = np.flatnonzero(often[inverse])
    return rank[inverse[where]], where


class Names:
    """names[j][i]: of the 2^j words from i on. Names of blocks that stand once differ from all others."""

    def __init__(self, words: np.ndarray, owner: np.ndarray):
        """words: numbers; owner: rising number of the text of each."""
        n = len(words)
        self.names: list[np.ndarray] = []
        rank, where = _ranked(owner.astype(np.int64) * (int(words.max(initial=0)) + 1) + words)
        while len(where):
            level = np.arange(n, 2 * n, dtype=np.int64)
            level[where] = rank
            self.names.append(level.astype(np.int32 if 2 * n < 2**31 else np.int64))
            half = 1 << (len(self.names) - 1)
            first = where[where + half < n]
            second = level[first + half]
            both = second < n
            first = first[both]
            rank, which = _ranked(level[first] * n + second[both])
            where = first[which]

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest equal blocks that begin at a and at b > a."""
        length = np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            names = self.names[j]
            at, to = a + length, b + length
            fits = to < len(names)
            fits[fits] = names[at[fits]] == names[to[fits]]
            length[fits] += 1 << j
        return length

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest equal blocks that end before a and before b > a."""
        length = np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            names = self.names[j]
            at, to = a - length - (1 << j), b - length - (1 << j)
            fits = at >= 0
            fits[fits] = names[at[fits]] == names[to[fits]]
            length[fits] += 1 << j
        return length


def _surely_equal(q: np.ndarray) -> np.ndarray:
    """Words that stand again q words on, from the first grid place of any run of period q."""
    return np.maximum(MIN_WORDS, MIN_PERIODS * q) - 2 * q + 1


def find_runs(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of all runs, by start and period; words and owner as in Names."""
    n = len(words)
    table = Names(words, owner)
    none = np.zeros(0, np.int64)
    longest = int(np.bincount(owner).max()) if n else 0
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    q = 1
    while q <= longest // MIN_PERIODS and q < n:
        most = q  # periods q to most are looked at together
        total = 0
        while most <= longest // MIN_PERIODS and (total == 0 or total + n // most <= PAIRS_AT_ONCE) and most - q < 100_000:
            total += n // most
            most += 1
        periods = np.arange(q, most)
        level = np.log2(_surely_equal(periods) + 0.5).astype(np.int64)
        counts = np.where(level < len(table.names), (n - 1) // periods, 0)  # grid places whose neighbour is in the array
        period = np.repeat(periods, counts)
        at = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * period
        which = np.repeat(level, counts)
        for j in np.unique(which):
            some = which == j
            a, step = at[some], period[some]
            names = table.names[j]
            same = names[a] == names[a + step]
            a, step = a[same], step[same]
            if len(a):
                start, end = a - table.backward(a, a + step), a + step + table.forward(a, a + step)
                long = end - start >= np.maximum(MIN_WORDS, MIN_PERIODS * step)
                found.append((start[long], end[long], step[long]))
        q = most
    if not found:
        return none, none, none
    start, end, period = map(np.concatenate, zip(*found, strict=True))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    # multiples of the smallest period have the same stretch
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def repeated_tail(n: int, doc: str) -> np.ndarray:
    """For each of n words the number of the word that stands there: in a tenth of the documents, by
    the crc32 of their id, the words from some place on are a repeated stretch."""
    h = zlib.crc32(doc.encode())
    place = np.arange(n)
    if h % 10 == 0 and n > 0:
        g = h // 10
        a = g % n
        place[a:] = a + (place[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return place


NEW = [("n_runs", T.LongType()), ("start", T.LongType()), ("length", T.LongType()), ("period", T.LongType()), ("exponent_milli", T.LongType()), ("runs", T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))), ("collapsed", T.StringType())]


def _runs_of(texts: list[bytes], docs: list[str] | None) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """(start, length, period) of each text's runs, and the text without words that only repeat."""
    words = [t.split() for t in texts]
    if docs is not None:
        words = [[w[k] for k in repeated_tail(len(w), d).tolist()] if zlib.crc32(d.encode()) % 10 == 0 else w for w, d in zip(words, docs, strict=True)]
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size) - size
    numbered = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    start, end, period = find_runs(numbered, np.repeat(np.arange(len(words)), size))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
    text_of = np.searchsorted(begin, start, "right") - 1
    for d, s, e, q in zip(text_of.tolist(), (start - begin[text_of]).tolist(), (end - begin[text_of]).tolist(), period.tolist(), strict=True):
        runs[d].append((s, e - s, q))
    collapsed = []
    for w, found in zip(words, runs, strict=True):
        if found:
            depth = np.zeros(len(w) + 1, np.int64)
            for s, length, q in found:
                depth[s + q] += 1
                depth[s + length] -= 1
            w = [w[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
        collapsed.append(b" ".join(w))
    return runs, collapsed


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat_tails: bool = False, chars_at_once: int = 2_000_000) -> DataFrame:
    """Columns of ``docs``, then n_runs, start, length, period and exponent_milli (1000 length / period,
    rounded down) of the run of the greatest exact exponent (ties: smallest start, then period), runs (all of them,
    by start, then period) and collapsed (the words that aren't in a run after its first period,
    joined by one space).

    Words are stretches without [\\x20\\x09-\\x0D]. A run has the smallest period q, max(24, 3q) words at
    least and can't be extended. A null or empty text has no words, no runs and an empty ``collapsed``;
    without runs the four figures are null. Rows are independent: repeated rows give repeated results,
    a null id is a row like others. ``repeat_tails`` first repeats the tails of a tenth of the texts
    (repeated_tail), chosen by id (null as ""). Columns of the new names are replaced; other columns
    stay. A long text is looked at whole. An empty table gives an empty table. Nothing is shuffled."""
    kept = common.fields_without(docs, [n for n, _ in NEW])
    out = T.StructType([*kept, *(T.StructField(*x) for x in NEW)])
    names = [f.name for f in kept]
    at, id_at = names.index(text_col), names.index(id_col)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, at, chars_at_once):
                ids = [x or "" for x in pc.cast(batch.column(id_at), pa.string()).to_pylist()]
                runs, collapsed = _runs_of(common.as_bytes(batch.column(at)), ids if repeat_tails else None)
                best = [max(r, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if r else (None, None, None) for r in runs]
                figures = [pa.array(c, pa.int64()) for c in zip(*best, strict=True)] if best else [pa.array([], pa.int64())] * 3
                milli = pa.array([None if q is None else 1000 * length // q for _, length, q in best], pa.int64())
                listed = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs], pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])))
                more = [pa.array([*map(len, runs)], pa.int64()), *figures, milli, listed, pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=out.names)

    return docs.select(*[f"`{n}`" for n in names]).withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(scanned, out)


def runs_text(runs: list[tuple[int, int, int]]) -> str:
    """The list of runs that op12's digest is of."""
    return "".join(f"{s},{length},{q}\n" for s, length, q in runs)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return periodic_runs(docs, repeat_tails=True).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", digest(F.array_join(line, "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256")
    )
