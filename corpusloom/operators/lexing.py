"""Vocabularies of lexer tokens, and texts to ids and back: tasks look tokens up by batches, and ask for the rare ones by joins."""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import lexer as lx
from corpusloom.functions.tokens import META
from corpusloom.operators.ranking import numbered_rows

#: Entries with the smallest indices, which are the most frequent, up to a length: sent to all tasks. All others are shuffled.
HOT_ENTRIES, HOT_CHARS = 100_000, 200
#: Bytes of texts, or ids, that a task looks at together: so many, and one row.
PART = 8_000_000


def lexer_vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, delimiter, index, n): meta tokens, then each printable character as "x-char-based", both
    written without a delimiter; then every token of the texts that is no literal and no name of a called
    function, by falling number of texts with it (n), ties by token, written with a space behind it.

    Tokens are counted before the shuffle and numbered by ranges, so a vocabulary can be of any size."""
    spark = docs.sparkSession
    first = [(m, "", k, 0) for k, m in enumerate(META)]
    first += [(f"{chr(c)}-char-based", "", len(META) + k, 0) for k, c in enumerate([*range(9, 14), *range(32, 127)])]
    seen = docs.select(F.coalesce(text_col, F.lit(""))).mapInArrow(_counted, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    numbered = numbered_rows(seen, [F.desc("n"), F.col("token")], "index").select("token", F.lit(" ").alias("delimiter"), (F.col("index") + lx.RESERVED).alias("index"), "n")
    return spark.createDataFrame(first, "token string, delimiter string, index long, n long").unionByName(numbered)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts (``lexer.text_words``) in their order, and the text of each. Where no token can hold white space, Arrow splits."""
    odd = functools.reduce(pc.or_, [pc.match_substring(texts, x) for x in lx.OPENING]).to_numpy(zero_copy_only=False)
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts.filter(pa.array(~odd)))).cast(pa.list_(pa.large_string()))
    words, text = split.flatten(), np.repeat(np.flatnonzero(~odd), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not some.all():
        words, text = words.filter(pa.array(some)), text[some]
    if odd.any():
        more = [lx.text_words(x) for x in texts.filter(pa.array(odd)).to_pylist()]
        text = np.append(text, np.repeat(np.flatnonzero(odd), [len(x) for x in more]))
        order = np.argsort(text, kind="stable")
        words, text = pa.concat_arrays([words, pa.array(itertools.chain(*more), pa.large_string())]).take(pa.array(order)), text[order]
    return words, text


def _coded(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens of texts, and each token's number among them and its text. Only distinct words are lexed."""
    words, text = _words(texts)
    held = words.dictionary_encode()
    distinct = held.dictionary.to_numpy(zero_copy_only=False).tolist()
    name = np.array([x.isalpha() for x in distinct], bool)  # letters are one token
    found, size = [], np.ones(len(distinct), np.int64)
    for k in np.flatnonzero(~name).tolist():
        w = lx.word_tokens(distinct[k])
        found += w
        size[k] = len(w)
    tokens = pa.concat_arrays([held.dictionary.filter(pa.array(name)), pa.array(found, pa.large_string())]).dictionary_encode()
    begin = np.where(name, np.cumsum(name) - 1, name.sum() + np.cumsum(size * ~name) - size)
    code, n = _spread(tokens.indices.to_numpy(), begin, size, held.indices.to_numpy())
    return tokens.dictionary.to_numpy(zero_copy_only=False).tolist(), code.astype(np.int64), np.repeat(text, n)


def _spread(values: np.ndarray, begin: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of groups, each from a beginning and of a size, for each place that names a group, and how many they are."""
    n = size[at]
    return values[np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def _unique(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _distinct(text: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of text and code, each once; n: of codes."""
    pairs = _unique(text * np.int64(max(n, 1)) + code)
    return pairs // max(n, 1), pairs % max(n, 1)


def _parts(size: pa.Array) -> list[tuple[int, int]]:
    """Begin and length of parts of a batch, by the size of its rows."""
    part = np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // PART
    ends = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return [(i, k - i) for i, k in zip(ends, ends[1:], strict=False) if k > i]


def _counted(batches):
    """(token, n): in how many texts of a part each token of the vocabulary stands."""
    for batch in batches:
        for at in _parts(pc.binary_length(batch.column(0))):
            names, code, text = _coded(batch.column(0).slice(*at))
            kept = np.array([x.isalpha() or not (lx.literal(x) or x in META) for x in names], bool)
            called = np.zeros(len(code), bool)
            if "(" in names:
                before = np.flatnonzero((code[1:] == names.index("(")) & (text[1:] == text[:-1]))
                name = {k: lx.named(names[k]) for k in set(code[before].tolist())}
                called[before] = [name[k] for k in code[before].tolist()]
            some = kept[code] & ~called
            n = np.bincount(_distinct(text[some], code[some], len(names))[1], minlength=len(names))
            found = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in found], pa.string()), pa.array(n[found].astype(np.int64))], names=["token", "n"])


def atoms(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, atoms) of each text, atoms: ids, n_characters. A token in the vocabulary is its index; any other falls apart into
    its characters' own entries, which n_characters counts. ids is null where a character isn't printable ASCII.

    id_col: one row each. Null texts are empty. A text moves once, as it is, and asks once for each token that isn't
    in the part of the vocabulary that all tasks have: tokens are no rows, and an answer names its token by its place
    among those that the text asks for. A frequent token that no vocabulary has, such
    as a called function's name, is left to the split of skewed joins."""
    spark = docs.sparkSession
    entry = vocabulary.where((F.col("index") >= lx.RESERVED) | F.col("index").between(0, len(META) - 1)).select("token", "index")
    hot = (F.col("index") < HOT_ENTRIES) & (F.length("token") <= HOT_CHARS)
    sent = spark.sparkContext.broadcast({r["token"]: r["index"] for r in entry.where(hot).collect()})

    def asked(batches):
        for batch in batches:
            for at in _parts(pc.binary_length(batch.column(1))):
                part = batch.slice(*at)
                names, code, text = _coded(part.column(1))
                text, code = _far(names, code, text, _index(names, sent.value))
                place = pa.array(np.arange(len(text)) - np.searchsorted(text, text), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), place, pa.array(names, pa.string()).take(pa.array(code))], names=[id_col, "_place", "token"])

    def encoded(texts: pa.Array, rare: pa.Array) -> pa.Array:
        out = [_encoded(texts.slice(*at), rare.slice(*at), sent.value) for at in _parts(pc.binary_length(texts))]
        return pa.concat_arrays(out) if out else pa.array([], _ATOMS)

    texts = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text"))
    questions = texts.mapInArrow(asked, f"{id_col} {dict(docs.dtypes)[id_col]}, _place long, token string")
    answers = questions.join(entry.where(~hot), "token").groupBy(id_col).agg(F.collect_list(F.struct("_place", "index")).alias("_rare"))
    rare = F.coalesce("_rare", F.array().cast("array<struct<_place: bigint, index: bigint>>"))
    return texts.join(answers, id_col, "left").select(id_col, F.arrow_udf(encoded, "ids array<bigint>, n_characters bigint")("_text", rare).alias("atoms"))


def atomized(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_characters): the fields of ``atoms``."""
    return atoms(docs, vocabulary, id_col, text_col).select(id_col, "atoms.ids", "atoms.n_characters")


def digested(found: Column) -> Column:
    """(n_atoms, n_characters, ids_sha256) of ``atoms``: the SHA-256 of their ids in decimal with commas; nulls for null ids."""

    def of(found: pa.Array) -> pa.Array:
        digest = []
        for at in _parts(pc.multiply(pc.list_value_length(found.field(0)), 8)):
            ids = found.field(0).slice(*at)
            ends = pa.array(np.append(0, np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy())), pa.int32())
            text = pc.binary_join(pa.ListArray.from_arrays(ends, ids.flatten().cast(pa.string())), ",")
            digest += [hashlib.sha256(x).hexdigest() for x in text.cast(pa.binary()).to_numpy(zero_copy_only=False)]
        none = pc.is_null(found.field(0))
        digest = pc.if_else(none, pa.scalar(None, pa.string()), pa.array(digest, pa.string()))
        return pa.StructArray.from_arrays([pc.list_value_length(found.field(0)).cast(pa.int64()), found.field(1), digest], names=["n_atoms", "n_characters", "ids_sha256"])

    return F.arrow_udf(of, "n_atoms bigint, n_characters bigint, ids_sha256 string")(found)


_ATOMS = pa.struct([("ids", pa.list_(pa.int64())), ("n_characters", pa.int64())])
#: Entries of ASCII characters, -1 for those without one.
_CHARACTERS = np.array([c - 9 + len(META) if 9 <= c <= 13 else c - 32 + 5 + len(META) if 32 <= c <= 126 else -1 for c in range(128)])


def _index(names: list[str], hot: dict[str, int]) -> np.ndarray:
    """Indices of tokens in the part that all tasks have, or -1."""
    return np.array([hot.get(x, -1) for x in names], np.int64)


def _far(names: list[str], code: np.ndarray, text: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of text and token to ask for, each once: by text, then by the token's first place in it, so that a text's
    come in the same order whatever texts stand beside it."""
    wanted = index < 0
    wanted[wanted] = [not lx.literal(names[k]) for k in np.flatnonzero(wanted).tolist()]
    far = wanted[code]
    text, code = text[far], code[far]
    first = np.sort(np.unique(text * np.int64(max(len(names), 1)) + code, return_index=True)[1])
    return text[first], code[first]


def _encoded(texts: pa.Array, rare: pa.Array, hot: dict[str, int]) -> pa.Array:
    names, code, text = _coded(texts)
    index = _index(names, hot)
    far_text, far = _far(names, code, text, index)
    answered = np.repeat(np.arange(len(rare)), pc.list_value_length(rare).to_numpy(zero_copy_only=False))
    place, found = (rare.flatten().field(k).to_numpy() for k in range(2))
    index[far[np.searchsorted(far_text, answered) + place]] = found
    spelled = np.flatnonzero(index < 0)
    letters = _CHARACTERS[np.minimum(np.frombuffer("".join([names[k] for k in spelled]).encode("utf-32-le"), "<u4"), 127)]
    size, begin = np.ones(len(names), np.int64), np.arange(len(names))
    size[spelled] = [len(names[k]) for k in spelled]
    begin[spelled] = len(names) + np.cumsum(size[spelled]) - size[spelled]
    missing = np.bincount(np.repeat(spelled, size[spelled]), letters < 0, len(names)) > 0
    ids, length = _spread(np.concatenate([index, letters]), begin, size, code)
    total, n, none = (np.bincount(text, x, len(texts)).astype(np.int64) for x in (length, length * (index < 0)[code], missing[code]))
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *total]), pa.int32()), pa.array(ids, pa.int64()), mask=pa.array(none > 0))
    return pa.StructArray.from_arrays([lists, pa.array(n)], fields=[*_ATOMS])


def written_out(encoded: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of (id, ids): entries with their delimiters, characters bare (a backslash twice, as the
    vocabulary writes it). Null ids give a null text, an id outside the vocabulary nothing.

    id_col: one row each. A row's ids move once, and ask once for each entry that not all tasks have."""
    spark = encoded.sparkSession
    plain = F.when(F.col("token").endswith("-char-based") & (F.col("delimiter") == ""), F.replace(F.regexp_replace("token", "-char-based$", ""), F.lit("\\"), F.lit("\\\\"))).otherwise(F.col("token"))
    entry = vocabulary.select("index", F.concat(plain, "delimiter").alias("word"))
    hot = (F.col("index") < HOT_ENTRIES) & (F.length("word") <= HOT_CHARS)
    sent = spark.sparkContext.broadcast({r["index"]: r["word"] for r in entry.where(hot).collect()})

    def asked(batches):
        for batch in batches:
            for at in _parts(pc.list_value_length(batch.column(1))):
                part = batch.slice(*at)
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
                code, number = _numbered(part.column(1))
                far = np.array([i not in sent.value for i in code.tolist()], bool)[number]
                row, number = _distinct(row[far], number[far], len(code))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(code[number], pa.int64())], names=[id_col, "index"])

    def written(ids: pa.Array, rare: pa.Array) -> pa.Array:
        out = [_written(ids.slice(*at), rare.slice(*at).flatten(), sent.value) for at in _parts(pc.list_value_length(ids))]
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    questions = encoded.select(id_col, F.col("ids").cast("array<bigint>").alias("ids")).mapInArrow(asked, f"{id_col} {dict(encoded.dtypes)[id_col]}, index long")
    answers = questions.join(entry.where(~hot), "index").groupBy(id_col).agg(F.collect_list(F.struct("index", "word")).alias("_rare"))
    rare = F.coalesce("_rare", F.array().cast("array<struct<index: bigint, word: string>>"))
    rows = encoded.select(id_col, "ids").join(answers, id_col, "left")
    return rows.select(id_col, F.arrow_udf(written, "string")(F.col("ids").cast("array<bigint>"), rare).alias("text"))


def _numbered(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids of lists, and the number of each id among them; a null id is -1, no entry's."""
    x = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
    code = _unique(x)
    return code, np.searchsorted(code, x)


def _written(ids: pa.Array, rare: pa.Array, hot: dict[int, str]) -> pa.Array:
    code, at = _numbered(ids)
    asked = dict(zip(*(rare.field(k).to_pylist() for k in range(2)), strict=True))
    words = pa.array([hot.get(i, asked.get(i, "")) for i in code.tolist()], pa.string()).take(pa.array(at))
    ends = np.cumsum([0, *pc.list_value_length(ids).fill_null(0).to_pylist()])
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words), "")
    return pc.if_else(ids.is_valid(), text, pa.scalar(None, pa.string()))
