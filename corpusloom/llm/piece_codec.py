"""Operator 10: sentence-piece ids of texts and back, by a Viterbi search that words share.

A text falls into marked words (token_counts.chunks) that no piece crosses. The distinct ones of a
batch are sorted, which puts them in the order of a depth-first walk through their trie: each word
keeps the forward states of the prefix it shares with the word before and extends only the rest.

A prefix's state is the best sum of piece scores over its paths, and the last piece of that path. The
shipped model is a byte-pair model, whose scores are merge ranks: summing them freely would not give
its encoding. So the lattice has an edge between two pieces only where the model leaves the two as
they are when they stand alone together; the path that is left is the model's own encoding.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import common
from corpusloom.llm.token_counts import chunks, model_path

MARK = "▁"


#: Words kept in a worker are no longer than this, so that their number bounds their bytes.
KEPT_CHARS = 64


class Codec:
    """Ids of marked words and texts of ids, of one byte-pair model."""

    def __init__(self, path: str, most: int = 350_000, most_joins: int = 300_000):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m, n = self.model, self.model.get_piece_size()
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        pieces = {m.id_to_piece(i): i for i in plain}
        #: the trie of pieces, read from their ends: every end of a piece, with the piece's id if it is one, else -1
        self.ends = {p[k:]: -1 for p in pieces for k in range(1, len(p))} | pieces
        self.names = [m.id_to_piece(i) for i in range(n)]
        self.scores = [m.get_score(i) for i in range(n)]
        self.byte = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.worst = min((self.scores[i] for i in plain), default=0.0) - 10.0
        self.text = [b""] * n
        for p, i in pieces.items():
            self.text[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte):
            self.text[i] = bytes([b])
        self.joins: dict[int, bool] = {}  # left id * pieces + right id
        self.most_joins = most_joins
        self.known = common.Kept(most)

    def _stay(self, left: str, right: str) -> bool:
        """Whether the model leaves two pieces that stand together as they are."""
        both = left + right
        fenced = both[1:] if both[0] == MARK else "\n" + both
        got = self.model.encode(fenced, out_type=str)
        return got[0 if both[0] == MARK else 2 :] == [left, right]

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of each word, spaces as marks, in sorted order."""
        get, scores, joins, names, n = self.ends.get, self.scores, self.joins, self.names, len(self.names)
        before = ""
        best, last = [0.0], [-1]  # of each prefix: forward score and last piece (-1: a character in bytes)
        for word in words:
            shared = len(commonprefix((before, word)))
            del best[shared + 1 :], last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                one = get(word[end - 1], -1)
                top, piece = (self.worst + best[end - 1], -1) if one < 0 else (None, one)
                for start in range(end - 1, -1, -1):
                    i = get(word[start:end])
                    if i is None:
                        break
                    if i < 0:
                        continue
                    score = scores[i] + best[start]
                    if top is not None and score < top:
                        continue
                    q = last[start]
                    if start and q >= 0:
                        ok = joins.get(q * n + i)
                        if ok is None:
                            if len(joins) >= self.most_joins:
                                joins.clear()
                            ok = joins[q * n + i] = self._stay(names[q], names[i])
                        if not ok:
                            continue
                    top, piece = score, i
                best.append(self.worst if top is None else top)
                last.append(piece)
            before = word
            ids: list[int] = []
            end = len(word)
            while end:
                i = last[end]
                ids.extend([i] if i >= 0 else [self.byte[b] for b in reversed(word[end - 1].encode())])
                end -= len(names[i]) if i >= 0 else 1
            ids.reverse()
            yield ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; words are looked up where this worker knows them."""
        split = [chunks(t) for t in texts]
        wanted = set().union(*split)
        long = {c for c in wanted if len(c) > KEPT_CHARS}
        fresh = {c.replace(" ", MARK): c for c in self.known.missing(wanted - long) | long}
        ordered = sorted(fresh)
        long_ids = {}
        for w, ids in zip(ordered, self.encode_sorted(ordered), strict=True):
            (long_ids if fresh[w] in long else self.known.now)[fresh[w]] = np.array(ids, "<i4").tobytes()
        found = self.known.now
        get = (lambda c: long_ids[c] if c in long_ids else found[c]) if long else found.__getitem__
        return [b"".join(map(get, x)) for x in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces joined, marks as spaces, without the space before the first word."""
        joined = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return joined[1:].decode(errors="replace")


def codec(path: str) -> Codec:
    """The codec of a model, kept by this worker from task to task."""
    return common.held_by_worker(("codec", path), lambda: Codec(path))


NEW = [("token_ids", T.ArrayType(T.IntegerType())), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType()), ("decoded_sha256", T.StringType()), ("round_trip", T.BooleanType())]


def encode_texts(docs: DataFrame, model_file: str | None = None, text_col: str = "text", chars_at_once: int = 2_000_000) -> DataFrame:
    """Columns of ``docs``, then token_ids (array of int), n_tokens, ids_crc32 (of the ids as
    little-endian 32-bit integers), decoded_sha256 and round_trip (decoding the ids gives the text).

    A null text is empty: no ids. A written U+2581 means a space to the model and decodes to one, so
    its round_trip is false. Columns of those names are replaced. Rows are independent of each other,
    repeated ones too; a long text is encoded whole. An empty table gives an empty table."""
    path = model_file or model_path()
    kept = common.fields_without(docs, [n for n, _ in NEW])
    out = T.StructType([*kept, *(T.StructField(*x) for x in NEW)])
    at = [f.name for f in kept].index(text_col)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for whole in batches:
            texts = common.as_texts(whole.column(at))
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end]) <= chars_at_once):
                    size += len(texts[end])
                    end += 1
                some = texts[begin:end]
                blobs = model.encode(some)
                decoded = [*map(model.decode, blobs)]
                lengths = [len(b) // 4 for b in blobs]
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(np.frombuffer(b"".join(blobs), "<i4"), pa.int32()))
                more = [ids, pa.array(lengths, pa.int64()), pa.array([*map(zlib.crc32, blobs)], pa.int64()), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()), pa.array([a == b for a, b in zip(some, decoded, strict=True)])]
                yield pa.RecordBatch.from_arrays([*(c.slice(begin, end - begin) for c in whole.columns), *more], names=out.names)
                begin = end

    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(common.tidy(coded, holds=True), out)


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs).select("doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip")
