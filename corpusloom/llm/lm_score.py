"""Operator 8: language-model scores from a weighted backoff automaton.

The model is a trigram model with Dirichlet smoothing (MacKay and Peto 1995): every order is smoothed
by the order below, the lowest by one for each word. As an automaton: a state is a history seen in
training, of two words or one, and the root has none. A state has an arc for each word that followed
its history, with that word's log10 probability; a failure arc, with the state's backoff weight, leads
to the history without its first word, so where no arc fits a shorter history is asked, and the root
has an arc for every word. One left-to-right traversal of a text carries the state and adds weights.

The model grows with the corpus and is never broadcast or gathered. Each task packs its documents into
blocks of bounded size, which are written as numbered tokens. A block asks for the training counts of
its own n-grams: hashed keys with the block's own counts go to ranges of the keys; a range sums them
and answers in the order of the keys. With its answers a block has the part of the automaton that its
texts can reach. A group takes asks of 2**FANOUT_BITS blocks at most: with more blocks, groups sum
their blocks' asks and ask for the sums in turn, so the rows grow as the blocks do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common
from corpusloom.llm.words import mix

#: Characters in a block at least, unless a task has fewer; blocks that a group takes, as a power of two.
BLOCK_CHARS, FANOUT_BITS = 6_000_000, 10
#: Strength of the prior in states of one and of two words, in tokens.
PRIOR, PAIR_PRIOR = 100.0, 20.0
_END = b"\n"  # token 0; no word has white space
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_KEY_BITS = 56
ASKED = "source long, prefix long, keys binary, counts binary"
ANSWERED = "source long, prefix long, counts binary, tokens long, distinct long"


def _packed(values: np.ndarray, width: int) -> bytes:
    """Unsigned integers of ``width`` bytes, the same byte of all of them together, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(values).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if len(values) else b"")


def _unpacked(blob: bytes, width: int) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(blob[8:], n * width, codec="zstd"), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


class _Texts:
    """Texts of a block as numbers of their words; every text ends in token 0."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {_END: 0}
        self.tokens: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.ids: list = []
        self.train: list[bool] = []
        self.chars = 0

    def add(self, ids: pa.Array, texts: pa.Array, train: pa.Array) -> None:
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        numbered = split.flatten().dictionary_encode()
        known = self.words
        of = np.array([known.setdefault(w, len(known)) if w else -1 for w in common.values_of(numbered.dictionary)], np.int64)
        found = of[numbered.indices.to_numpy()] if len(of) else np.zeros(0, np.int64)
        word = found >= 0  # white space at an end leaves an empty string
        lengths = np.diff(np.concatenate(([0], np.cumsum(word)))[split.offsets.to_numpy() - split.offsets[0].as_py()]) + 1
        tokens = np.zeros(int(lengths.sum()), np.int64)
        inside = np.ones(len(tokens), bool)
        inside[np.cumsum(lengths) - 1] = False
        tokens[inside] = found[word]
        self.tokens.append(tokens)
        self.lengths.append(lengths)
        self.ids += ids.to_pylist()
        self.train += train.to_pylist()
        self.chars += int(pc.sum(pc.binary_length(texts)).as_py() or 0)

    def row(self, block: int) -> list:
        tokens, lengths = np.concatenate(self.tokens), np.concatenate(self.lengths)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        return [block, self.ids, self.train, _packed(lengths, 8), _packed(tokens, 4), hashes.astype("<u8").tobytes()]


class Automaton:
    """The distinct n-grams of a block, their keys, and the traversal of its texts."""

    def __init__(self, lengths: bytes, tokens: bytes, hashes: bytes):
        self.lengths, self.tokens, words = _unpacked(lengths, 8).astype(np.int64), _unpacked(tokens, 4).astype(np.int64), np.frombuffer(hashes, "<u8")
        self.size = v = len(words)
        first = np.cumsum(self.lengths) - self.lengths
        before = np.concatenate((np.zeros(1, np.int64), self.tokens[:-1])) if len(self.tokens) else self.tokens
        before[first] = 0  # a text starts in the state of an end
        self.pairs, self.pair_of = np.unique(before * v + self.tokens, return_inverse=True)
        inner = np.ones(len(self.tokens), bool)
        inner[first] = False
        at = np.flatnonzero(inner)
        self.triples, which = np.unique(self.pair_of[at - 1] * v + self.tokens[at], return_inverse=True)
        self.triple_of = np.full(len(self.tokens), len(self.triples), np.int64)  # the first token of a text has none
        self.triple_of[at] = which
        one = np.uint64(1)
        of_pairs = mix(words[self.pairs // v] * _FACTOR + words[self.pairs % v])
        of_triples = mix((of_pairs[self.triples // v] + one) * _FACTOR + words[self.triples % v])
        shift = np.uint64(64 - _KEY_BITS)
        keys = np.concatenate((mix(words) >> shift | one, of_pairs >> shift & ~one, of_triples >> shift & ~one))  # the last bit: a word
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def counts_in(self, train: np.ndarray) -> np.ndarray:
        """How often each n-gram stands in training texts of the block, in the order of the keys."""
        of = np.repeat(train, self.lengths)
        per = [np.bincount(x[of], minlength=n)[:n] for x, n in ((self.tokens, self.size), (self.pair_of, len(self.pairs)), (self.triple_of, len(self.triples)))]
        return np.concatenate(per)[self.order]

    def scores(self, counts: np.ndarray, tokens: int, distinct: int, longest: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and score of each text, from the training counts in the order of the keys."""
        c = np.empty(len(counts), np.int64)
        c[self.order] = counts
        v, p = self.size, len(self.pairs)
        words, pairs, triples = c[:v], c[v : v + p], c[v + p :]
        plain = (words + 1) / (tokens + distinct + 1)
        of, to = self.pairs // v, self.pairs % v
        smooth = (pairs + PRIOR * plain[to]) / (words[of] + PRIOR)
        state, word = self.triples // v, self.triples % v
        # the pair that the arc of a triple would fall back to: the state's second word and the new one
        lower = smooth[np.searchsorted(self.pairs, to[state] * v + word)]
        arcs = np.log10(np.append((triples + PAIR_PRIOR * lower) / (pairs[state] + PAIR_PRIOR), 1.0))
        base, pair_arcs = np.log10(plain), np.log10(smooth)
        fail_word, fail_pair = np.log10(PRIOR / (words + PRIOR)), np.log10(PAIR_PRIOR / (pairs + PAIR_PRIOR))
        has_arc, has_pair = np.append(triples > 0, False), pairs > 0
        # states: 0 the root, then words, then pairs; after a token the longest history that training knows
        after = np.where(has_pair[self.pair_of], 1 + v + self.pair_of, np.where(words[self.tokens] > 0, 1 + self.tokens, 0))
        # texts in segments, the longest first; a later one begins two tokens early, after which its state is the text's
        parts = -(-self.lengths // longest)
        text = np.repeat(np.arange(len(parts)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = (np.cumsum(self.lengths) - self.lengths)[text] + nth * longest
        end = np.minimum(begin + longest, np.cumsum(self.lengths)[text])
        early = np.where(nth > 0, 2, 0)
        begin -= early
        by_length = np.argsort(begin - end, kind="stable")
        begin, size, early, text = begin[by_length], (end - begin)[by_length], early[by_length], text[by_length]
        held, total = np.where(early > 0, 0, int(words[0] > 0)), np.zeros(len(begin))
        for step in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -step, "left"))
            at, now = begin[:n] + step, held[:n]
            token, pair, triple = self.tokens[at], self.pair_of[at], self.triple_of[at]
            deep = now > v
            taken = deep & has_arc[triple]
            weight = np.where(taken, arcs[triple], 0.0)
            left = deep & ~taken
            weight[left] += fail_pair[now[left] - 1 - v]
            now = np.where(left, 1 + to[np.maximum(now - 1 - v, 0)], now)  # the failure arc
            single = ~taken & (now > 0)
            fits = single & has_pair[pair]
            weight[fits] += pair_arcs[pair[fits]]
            left = single & ~fits
            weight[left] += fail_word[now[left] - 1]
            root = left | (now == 0)
            weight[root] += base[token[root]]
            total[:n] += np.where(step < early[:n], 0.0, weight)
            held[:n] = after[at]
        starts = np.cumsum(self.lengths) - self.lengths
        known, lowest = (np.add.reduceat(x[self.tokens], starts) if len(starts) else np.zeros(0) for x in ((words > 0).astype(np.int64), base))
        return known, lowest, np.bincount(text, total, len(parts))


def _rows_by_digit(source: int, prefix: int, keys: np.ndarray, counts: np.ndarray, bits: int, level: int) -> list[tuple]:
    """Asks for sorted keys of one prefix, a row for each value of the next ``bits`` bits that occurs."""
    digit = (keys >> np.uint64(_KEY_BITS - bits * (level + 1))).astype(np.int64) & (1 << bits) - 1
    found = np.unique(digit)
    lo, hi = np.searchsorted(digit, found), np.searchsorted(digit, found, "right")
    return [(source, prefix << bits | int(d), _packed(keys[a:b], 7), _packed(counts[a:b], 5)) for d, a, b in zip(found, lo, hi, strict=True)]


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    types = [pa.binary() if k == "binary" else pa.int64() for k in kinds]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(names), types, strict=True)], names=list(names))


def _summed(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a group of asks, their totals, which of them each asked key is, and where rows end."""
    keys = [_unpacked(x, 7) for x in group["keys"].to_pylist()]
    counts = [_unpacked(x, 5) for x in group["counts"].to_pylist()]
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(which, np.concatenate(counts).astype(float), len(distinct)).astype(np.uint64)
    return distinct, totals, which, np.cumsum([0, *map(len, keys)])


def _answers(asks: DataFrame, sources: int, bits: int, level: int = 0) -> DataFrame:
    """For each ask the totals over all sources, in the order of its keys; tokens and distinct words are in one row a group."""

    def given(group: pa.Table, totals: np.ndarray, which: np.ndarray, ends: np.ndarray, tokens: int, distinct: int) -> pa.Table:
        rows = zip(group["source"].to_pylist(), group["prefix"].to_pylist(), strict=True)
        return _table([(s, p, _packed(totals[which[a:b]], 5), tokens if k == 0 else 0, distinct if k == 0 else 0) for k, ((s, p), a, b) in enumerate(zip(rows, ends, ends[1:], strict=False))], ANSWERED)

    def answer(group: pa.Table) -> pa.Table:
        keys, totals, which, ends = _summed(group)
        of_words = totals[keys & np.uint64(1) == 1]
        return given(group, totals, which, ends, int(of_words.sum()), int(np.count_nonzero(of_words)))

    if sources <= 1 << bits or bits * (level + 2) > _KEY_BITS - 1:
        return asks.groupBy("prefix").applyInArrow(answer, ANSWERED)

    groups = -(-sources >> bits)

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        keys, totals, _, _ = _summed(group)
        return _table(_rows_by_digit(key[1].as_py(), key[0].as_py(), keys, totals, bits, level + 1), ASKED)

    def split(group: pa.Table, summed: pa.Table) -> pa.Table:
        _, _, which, ends = _summed(group)
        summed = summed.sort_by("prefix")
        totals = np.concatenate([_unpacked(x, 5) for x in summed["counts"].to_pylist()])
        return given(group, totals, which, ends, sum(summed["tokens"].to_pylist()), sum(summed["distinct"].to_pylist()))

    grouped = common.written(asks, "asks").withColumn("merged", F.pmod(F.xxhash64("source"), F.lit(groups)))
    summed = _answers(grouped.groupBy("prefix", "merged").applyInArrow(merge, ASKED), groups, bits, level + 1)
    back = summed.withColumn("parent", F.shiftright("prefix", bits))
    return grouped.groupBy("prefix", "merged").cogroup(back.groupBy("parent", "source")).applyInArrow(split, ANSWERED)


def lm_scores(docs: DataFrame, train: Column, block_chars: int = BLOCK_CHARS, fanout_bits: int = FANOUT_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, train, n_tokens, n_known, train_tokens (long), base_score, score.

    Tokens: A-Z lower-cased runs without [\\x20\\x09-\\x0D], then one end, which is also the state a
    text starts in. ``train`` says which rows are learnt from; null is false. A null text is empty: one
    token. Repeated rows count and are returned each; very long texts fill a block by themselves. Other
    columns are not read. Without training rows every word weighs 0 and score is base_score. An empty
    table gives an empty table."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, id_type = TaskContext.get().partitionId() << 32, _Texts(), None

        def taken() -> pa.RecordBatch:
            types = [pa.int64(), pa.list_(id_type), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(held.row(block), types, strict=True)], names=["block", "ids", "train", "lengths", "tokens", "hashes"])

        for whole in batches:
            id_type = whole.column(0).type
            for batch in common.slices(whole, 1, min(block_chars, 2_000_000)):
                held.add(*batch.columns)
                if held.chars >= block_chars:
                    yield taken()
                    block, held = block + 1, _Texts()
        if held.ids:
            yield taken()

    blocks = common.written(rows.mapInArrow(packed, f"block long, ids array<{kind}>, train array<boolean>, lengths binary, tokens binary, hashes binary"), "blocks")
    n = blocks.count()
    bits = min(fanout_bits, max(1, (max(n, common.shuffle_partitions(spark)) - 1).bit_length()))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, train, *parts = (c[k].as_py() for c in batch.columns)
                own = Automaton(*parts)
                yield _table(_rows_by_digit(block, 0, own.keys, own.counts_in(np.array(train, bool)), bits, 0), ASKED).combine_chunks().to_batches()[0]

    answers = common.written(_answers(blocks.select("block", "train", "lengths", "tokens", "hashes").mapInArrow(ask, ASKED), n, bits), "answers")
    tokens, distinct = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()

    def scored(group: pa.Table, answer: pa.Table) -> pa.Table:
        own = Automaton(*(group[x][0].as_py() for x in ("lengths", "tokens", "hashes")))
        counts = np.concatenate([_unpacked(x, 5) for x in answer.sort_by("prefix")["counts"].to_pylist()]).astype(np.int64)
        known, base, score = own.scores(counts, tokens, distinct)
        columns = [pa.array(own.lengths, pa.int64()), pa.array(known.astype(np.int64), pa.int64()), pa.array(np.full(len(known), tokens), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
        return pa.Table.from_arrays([group["ids"].combine_chunks().flatten(), group["train"].combine_chunks().flatten(), *columns], names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(answers.select("source", "prefix", "counts").groupBy("source")).applyInArrow(scored, out)


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_scores(docs, common.crc_bucket("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
