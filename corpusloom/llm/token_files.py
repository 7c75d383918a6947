"""Operator 1: token ids in Re-Pair compressed shards.

Documents are dealt out by ranges of their ids and encoded in order. Every shard (about a million
ids) is compressed by itself: round after round, pairs that are frequent in the shard become
nonterminals wherever they stand, until none is left, never across the end of a document. A shard
row holds its rules, the length each rule expands to, its symbols, and for each document the first
symbol and first id, so a document, or a range of its ids, is decoded without the rest.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.llm import common

END_ID, SHARD_IDS, CHARS_AT_ONCE = 2, 1_000_000, 8_000_000
#: The least count of a pair that becomes a rule: a rule is three numbers in the file, a place saves one. Rounds before links.
MIN_COUNT, WIDE_ROUNDS = 4, 2
SHARD_SCHEMA = """part int, seq int, base int, rules binary, rule_lengths binary, symbols binary,
                  docs array<struct<doc_id bigint, at bigint, n_tokens bigint, first_symbol bigint>>"""


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: How the tokenizer's own pattern cuts lower-cased text.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Ids of texts, joined from ids of their words, which the library encodes once and the worker keeps.

    The tokenizer drops white space and never joins across it, so words cut at ASCII white space
    encode alone as they do in the text. Words of ASCII and Latin-1 letters are cut further into
    pre-tokens, of which fewer are distinct; other words are encoded whole, and a text that names a
    special token is encoded whole."""

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.model.model)  # for pre-tokens in lines, which are normalized and cut already
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.line_end = self.bare.encode("\n", add_special_tokens=False).ids[0]
        self.words, self.pretokens = common.Kept(most), common.Kept(most * 3 // 4)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.cut, self.plain = regex.compile(PRETOKEN + r"|\n").findall, regex.compile(r"[!-~¡-¬®-ÿ]+").fullmatch

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Arrow cuts the texts and numbers the distinct words; only those are looked up, and their ids
        are then laid out in the order of all words."""
        special = [any(x) for x in zip(*(pc.match_substring(texts, s).to_pylist() for s in self.special), strict=True)] if self.special else [False] * len(texts)
        plain = pc.if_else(pa.array(special, pa.bool_()), "", texts)
        split = pc.ascii_split_whitespace(plain)
        numbered = split.flatten().dictionary_encode()
        blobs = self.words.fetch(common.values_of(numbered.dictionary), self._learn)
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        starts = np.cumsum(sizes) - sizes
        which = numbered.indices.to_numpy()
        n = sizes[which]
        ends = np.cumsum(n)
        ids = np.frombuffer(b"".join(blobs), "<u4")[np.repeat(starts[which] - (ends - n), n) + np.arange(int(n.sum()))]
        at = np.concatenate(([0], ends))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [self._ids(texts[k].as_py()) if special[k] else ids[at[k] : at[k + 1]].tobytes() for k in range(len(texts))]

    def _ids(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[bytes]) -> list[bytes]:
        texts = b"\n".join(words).decode().split("\n")
        plain = [w.isprintable() if w.isascii() else self.plain(w) is not None for w in texts]
        laid = iter(())
        if any(plain):
            cut = self.cut("\n".join([w for w, p in zip(texts, plain, strict=True) if p]).lower() + "\n")
            distinct = [*set(cut)]
            of = dict(zip(distinct, self.pretokens.fetch(distinct, self._pretokens), strict=True))
            of["\n"] = _BETWEEN
            laid = iter(b"".join(map(of.__getitem__, cut)).split(_BETWEEN))
        return [next(laid) if p else self._ids(w) for w, p in zip(texts, plain, strict=True)]

    def _pretokens(self, fresh: list[str]) -> list[bytes]:
        """Ids of pre-tokens, thousands of lines in a call; the id of the line end stands between them."""
        out: list[bytes] = []
        for k in range(0, len(fresh), 5000):
            lines = "\n".join(" " if x == "\n" else x for x in fresh[k : k + 5000]) + "\n"
            ids = np.array(self.bare.encode_batch_fast([lines], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.line_end)
            starts, raw = np.concatenate(([0], ends[:-1] + 1)), ids.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return out


#: Between ids of words: an id has a zero as its highest byte, so this is never part of them.
_BETWEEN = b"\xff\xff\xff\xff"


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _slots(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """A slot of 2**bits for each pair of symbols."""
    h = left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE3D)
    h >>= np.uint32(32 - bits)
    return h


def _sorted_pairs(left: np.ndarray, right: np.ndarray, at: np.ndarray, known: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs as left << 32 | right with their places, by pair and place, and where each distinct pair begins."""
    symbol, place = int(known).bit_length(), max(1, int(n).bit_length())
    code = left.astype(np.int64) << symbol | right
    if 2 * symbol + place <= 63:
        code = code << place | at
        code.sort()
        at = code & (1 << place) - 1
        code >>= place
    else:
        order = np.argsort(code, kind="stable")
        code, at = code[order], at[order]
    begins = np.ones(len(code), bool)
    begins[1:] = code[1:] != code[:-1]
    return (code >> symbol) << 32 | code & (1 << symbol) - 1, at, np.flatnonzero(begins)


def compress(ids: np.ndarray, last: np.ndarray, base: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: symbols, where documents end, rules (pairs), and the length each rule expands to.

    Pairs are replaced until none stands ``min_count`` times (in a run of one symbol every second
    place counts). A round replaces all frequent pairs that lose no overlap to a more frequent one.
    The first WIDE_ROUNDS rounds look at every place and rank pairs by a hashed table; from then on
    neighbours are linked, and a round looks only at pairs that are still frequent and at those
    around the places just replaced: a pair once rare stays rare, as new places hold new symbols."""
    symbols, last = ids.astype(np.uint32), last.copy()
    rules: list[np.ndarray] = []
    for _ in range(WIDE_ROUNDS):
        if len(symbols) > 1:
            symbols, last, more = _wide_round(symbols, last, base + sum(map(len, rules)), min_count)
            rules.append(more)
    symbols, last, more = _linked_rounds(symbols, last, base + sum(map(len, rules)), min_count)
    both = np.concatenate([*rules, *more]) if rules or more else np.zeros((0, 2), np.int64)
    return symbols.astype("<u4"), last, both.astype("<u4"), _rule_lengths(both, base).astype("<u4")


def _wide_round(symbols: np.ndarray, last: np.ndarray, fresh: int, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bits = min(31, max(12, int(len(symbols)).bit_length()))
    slot = _slots(symbols[:-1], symbols[1:], bits)
    rank = np.bincount(slot, minlength=1 << bits).astype(np.int32)[slot]
    rank[last[:-1]] = 0  # no pair across documents
    take = rank >= min_count
    take[1:] &= rank[1:] > rank[:-1]
    take[:-1] &= rank[:-1] >= rank[1:]
    places = np.flatnonzero(take)
    pairs, places, first = _sorted_pairs(symbols[places], symbols[places + 1], places, fresh, len(symbols))
    counts = np.diff(np.append(first, len(pairs)))
    often = counts >= min_count
    replaced = np.repeat(often, counts)
    places = places[replaced]
    symbols[places] = fresh + np.repeat(np.cumsum(often) - 1, counts)[replaced]
    last[places] = last[places + 1]
    stays = np.ones(len(symbols), bool)
    stays[places + 1] = False
    chosen = pairs[first[often]]
    return symbols[stays], last[stays], np.stack([chosen >> 32, chosen & 0xFFFFFFFF], 1)


def _linked_rounds(symbols: np.ndarray, last: np.ndarray, fresh: int, min_count: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    n, rules = len(symbols), []
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # n and -1: nothing there
    after[last] = n
    before[1:][last[:-1]] = -1
    stays = np.ones(n, bool)
    rank = np.zeros(n + 1, np.int32)  # of the pair that begins at a place; 0 for rare ones and at both ends
    marked = np.zeros(n + 1, bool)
    at = np.flatnonzero(after < n)
    while len(at):
        left, right = symbols[at], symbols[after[at]]
        bits = min(31, max(12, int(len(at)).bit_length()))
        slot = _slots(left, right, bits)
        maybe = (np.bincount(slot, minlength=1 << bits) >= min_count)[slot]
        rank[at[~maybe]] = 0
        pairs, at, first = _sorted_pairs(left[maybe], right[maybe], at[maybe], fresh, n)
        if not len(at):
            break
        sizes = np.diff(np.append(first, len(at)))
        counts, second = sizes, None
        in_run = np.zeros(len(at), bool)
        in_run[1:] = before[at[1:]] == at[:-1]
        in_run[first] = False
        if in_run.any():
            k = np.arange(len(at))
            second = (k - np.maximum.accumulate(np.where(in_run, 0, k))) & 1 == 1
            counts = sizes - np.add.reduceat(second, first, dtype=np.int64)
        often = np.flatnonzero(counts >= min_count)
        often = often[np.argsort(counts[often], kind="stable")]
        of_pair = np.zeros(len(counts), np.int32)
        of_pair[often] = np.arange(1, len(often) + 1)
        mine = np.repeat(of_pair, sizes)
        still = at[mine > 0]
        if second is not None:
            mine[second] = 0
        rank[at] = mine
        counted = np.flatnonzero(mine)
        place, mine = at[counted], mine[counted]
        wins = (mine > rank[before[place]]) & (mine > rank[after[place]])
        place, mine = place[wins], mine[wins]
        won = np.bincount(mine, minlength=len(often) + 1)
        taken = won >= min_count  # and at least half of its places; the rest of them waits for the next round
        taken[1:] &= 2 * won[1:] >= counts[often]
        chosen = pairs[first[often[taken[1:]]]]
        rules.append(np.stack([chosen >> 32, chosen & 0xFFFFFFFF], 1))
        place, mine = place[taken[mine]], mine[taken[mine]]
        gone = after[place]
        symbols[place] = fresh + (np.cumsum(taken) - 1)[mine]
        fresh += len(chosen)
        stays[gone] = False
        following = after[place] = after[gone]
        inside = following < n
        before[following[inside]] = place[inside]
        rank[place] = rank[gone] = 0
        marked[still] = marked[place] = marked[before[place]] = True
        marked[gone] = marked[n] = False
        at = np.flatnonzero(marked)
        marked[at] = False
        at = at[after[at] < n]
    return symbols[stays], (after == n)[stays], rules


def _sizes(symbols: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """Ids that each symbol expands to."""
    known = np.concatenate((np.ones(1, np.int64), lengths))
    return known[np.maximum(symbols.astype(np.int64) - base + 1, 0)]


def _rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    lengths, todo = np.zeros(len(rules), np.int64), np.arange(len(rules))
    while len(todo):
        left, right = _sizes(rules[todo, 0], lengths, base), _sizes(rules[todo, 1], lengths, base)
        known = (left > 0) & (right > 0)
        lengths[todo[known]] = (left + right)[known]
        todo = todo[~known]
    return lengths


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """Ids of symbols: lengths tell where each goes, so a step touches only what is not yet expanded."""
    symbols, rules = symbols.astype(np.int64), rules.astype(np.int64)
    n = _sizes(symbols, lengths, base)
    at, out = np.cumsum(n) - n, np.empty(int(n.sum()), "<u4")
    while len(symbols):
        plain = symbols < base
        out[at[plain]] = symbols[plain]
        pair, at = rules[symbols[~plain] - base], at[~plain]
        symbols, at = np.concatenate((pair[:, 0], pair[:, 1])), np.concatenate((at, at + _sizes(pair[:, 0], lengths, base)))
    return out


def expand_range(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of symbols: expansion lengths tell which symbols to expand."""
    ends = np.cumsum(_sizes(symbols, lengths, base))
    start, stop = max(0, start), min(stop, int(ends[-1]) if len(ends) else 0)
    if start >= stop:
        return np.zeros(0, "<u4")
    lo, hi = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
    skipped = int(ends[lo - 1]) if lo else 0
    return expand(symbols[lo : hi + 1], rules, lengths, base)[start - skipped : stop - skipped]


def _shard(part: int, seq: int, at: int, ids: list, blobs: list[bytes], base: int) -> dict:
    tokens = np.frombuffer(b"".join(blobs), "<u4")
    sizes = np.array([len(b) // 4 for b in blobs], np.int64)
    last = np.zeros(len(tokens), bool)
    last[np.cumsum(sizes) - 1] = True
    symbols, ends, rules, lengths = compress(tokens, last, base)
    first = np.concatenate(([0], np.flatnonzero(ends)[:-1] + 1))
    starts = at + np.cumsum(sizes) - sizes
    docs = [{"doc_id": i, "at": int(a), "n_tokens": int(n), "first_symbol": int(f)} for i, a, n, f in zip(ids, starts, sizes, first, strict=True)]
    return {"part": part, "seq": seq, "base": base, "rules": rules.tobytes(), "rule_lengths": lengths.tobytes(), "symbols": symbols.tobytes(), "docs": docs}


_DOCS_TYPE = pa.list_(pa.struct([("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("first_symbol", pa.int64())]))
_SHARD_TYPE = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("base", pa.int32()), ("rules", pa.binary()), ("rule_lengths", pa.binary()), ("symbols", pa.binary()), ("docs", _DOCS_TYPE)])


def write_shards(docs: DataFrame, path: str, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Ids of all texts, END_ID behind each, as compressed shards in ascending id order.

    A null or empty text is END_ID alone. A null id comes first; rows with one id follow in the order
    of a hash of their texts, so many rows of one id fill several tasks. Other columns are not read. A document longer than ``shard_ids`` is a shard by
    itself. An empty table writes no shard."""
    model_file = model_file or model_path()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, model = TaskContext.get().partitionId(), encoder(model_file)
        base = model.model.get_vocab_size(with_added_tokens=True)
        end = np.array([END_ID], "<u4").tobytes()
        seq = at = held = 0
        ids, blobs = [], []
        for whole in batches:
            for batch in common.slices(whole, 1, CHARS_AT_ONCE):
                for i, blob in zip(batch.column(0).to_pylist(), model.encode(batch.column(1)), strict=True):
                    ids.append(i)
                    blobs.append(blob + end)
                    held += len(blob) // 4 + 1
                    if held >= shard_ids:
                        yield pa.RecordBatch.from_pylist([_shard(part, seq, at, ids, blobs, base)], _SHARD_TYPE)
                        seq, at, held, ids, blobs = seq + 1, at + held, 0, [], []
        if ids:
            yield pa.RecordBatch.from_pylist([_shard(part, seq, at, ids, blobs, base)], _SHARD_TYPE)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange("doc_id", "_hash", "_row").sortWithinPartitions("doc_id", "_hash", "text").select("doc_id", "text")
    ordered.mapInArrow(encoded, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids (binary), decoded from the files."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                base, symbols = row["base"], np.frombuffer(row["symbols"], "<u4")
                ids = expand(symbols, np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["rule_lengths"], "<u4"), base)
                first = row["docs"][0]["at"] if row["docs"] else 0
                blobs = [ids[d["at"] - first : d["at"] - first + d["n_tokens"]].tobytes() for d in row["docs"]]
                columns = [[row["part_start"] + d["at"] for d in row["docs"]], [d["n_tokens"] for d in row["docs"]], [zlib.crc32(b) for b in blobs]]
                yield pa.RecordBatch.from_arrays([pa.array([d["doc_id"] for d in row["docs"]], pa.int64()), *(pa.array(c, pa.int64()) for c in columns), pa.array(blobs, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # ids of a part: the end of its last document; parts are as many as the tasks that wrote them
    ends = shards.select("part", F.element_at("docs", -1).alias("d")).groupBy("part").agg(F.max(F.col("d.at") + F.col("d.n_tokens")).alias("n"))
    before = ends.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    # a few bytes for each task that wrote
    return shards.join(F.broadcast(before), "part").mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def read_documents(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, begin, end, ids) of the ids begin to end (within the document, cut at its end) of each
    distinct row of ``wanted`` (doc_id, begin, end: long), for every document of that id in the files.

    The index (the column docs) is read alone to find the shards; of those, each document's symbols
    are cut out by first_symbol, and only the symbols that rule_lengths places in the range are
    expanded. A null id, begin or end asks for nothing; an empty range gives no ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                symbols, rules, lengths = np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["rule_lengths"], "<u4")
                found = [(w["doc_id"], w["begin"], w["end"], expand_range(symbols[w["first"] : w["next"]], rules, lengths, row["base"], w["begin"], w["end"]).tobytes()) for w in row["wanted"]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "begin", "end", "ids"])

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    asked = wanted.select(*[F.col(c).cast("long").alias(c) for c in ("doc_id", "begin", "end")]).dropna().distinct()
    following = F.try_element_at("docs", F.col("k") + 2)["first_symbol"]
    index = shards.select("part", "seq", "docs", F.posexplode("docs").alias("k", "d")).select("part", "seq", F.col("d.doc_id").alias("doc_id"), F.col("d.first_symbol").alias("first"), following.alias("next"))
    hits = index.join(asked, "doc_id").groupBy("part", "seq").agg(F.collect_list(F.struct("doc_id", "begin", "end", "first", "next")).alias("wanted"))  # of one shard
    return shards.select("part", "seq", "base", "rules", "rule_lengths", "symbols").join(hits, ["part", "seq"]).mapInArrow(cut, "doc_id long, begin long, end long, ids binary")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_dir(spark, "token-shards")
    write_shards(common.table(spark, sf_dir, "documents"), path)
    return read_shards(spark, path).drop("ids")
