"""Tokenizers and training instances."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import holes
from corpusloom.functions import tokens as tk
from corpusloom.operators import ranking
from corpusloom.plans.catalog import register
from corpusloom.plans.q_relational import t

#: Multi-character tokens for the greedy tokenizer.
WORDS = ["the", "tion", "ing", "thing", "er", "en", "is"]
_GREEDY = "(?s)thing|tion|ing|the|en|er|is|."


@register("character_vocabulary", """
WITH c AS (SELECT ch AS token, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY 1)
SELECT token, (row_number() OVER (ORDER BY n DESC, encode(token)) + 5)::INT AS "index", n FROM c""")
def character_vocabulary(spark, sf_dir):
    """Characters by falling count behind the six meta tokens."""
    return tk.character_vocabulary(t(spark, sf_dir, "documents")).where("n > 0")


@register("greedy_tokens", f"SELECT doc_id, len(regexp_extract_all(text, '{_GREEDY}'))::BIGINT AS n_tokens, len(list_filter(regexp_extract_all(text, '{_GREEDY}'), lambda x: length(x) > 1))::BIGINT AS n_words FROM documents")
def greedy_tokens(spark, sf_dir):
    """Longest tokens first, single characters elsewhere."""
    found = tk.greedy_tokens(F.col("text"), WORDS)
    return t(spark, sf_dir, "documents").select("doc_id", found.alias("x")).select("doc_id", F.size("x").cast("long").alias("n_tokens"), F.size(F.filter("x", lambda w: F.length(w) > 1)).cast("long").alias("n_words"))


@register("word_vocabulary", f"SELECT token, row_number() OVER (ORDER BY encode(token)) AS \"index\" FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '{_GREEDY}')) AS token FROM documents)")
def word_vocabulary(spark, sf_dir):
    """Observed tokens in order; the vocabulary is small, the corpus isn't."""
    seen = t(spark, sf_dir, "documents").select(F.explode(F.array_distinct(tk.greedy_tokens(F.col("text"), WORDS))).alias("token")).distinct()
    return seen.select("token", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("token")).cast("long").alias("index"))


_IDS = "list_transform(regexp_extract_all(source || ' ' || lang, '.'), lambda c: ascii(c)::INT)"


def _ids(spark, sf_dir):
    chars = F.split(F.concat_ws(" ", "source", "lang"), "")
    return t(spark, sf_dir, "documents").select("doc_id", F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.ascii(c)).alias("ids"))


#: Length that whole texts are padded to (sequence length of the reference's models).
SEQUENCE = 512
_TEXT_IDS = "list_transform(regexp_extract_all(text, '(?s).'), lambda c: unicode(c)::INT)"


def _text_ids(spark, sf_dir):
    """Code points of whole texts."""
    return tk.text_ids(t(spark, sf_dir, "documents"), "doc_id", "text")


def _text(array: str) -> str:
    return f"array_to_string({array}, ',')"


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@register("wrap_and_pad", f"""
WITH i AS (SELECT doc_id, list_concat([1000], {_IDS}, [1001]) AS a FROM documents)
SELECT doc_id, {_text("list_concat(a[1:12], list_resize([]::INT[], greatest(12 - len(a), 0), 0))")} AS ids, len(a)::BIGINT AS n FROM i""")
def wrap_and_pad(spark, sf_dir):
    """Start and end ids, cut and padded to 12; the length before padding."""
    w = _ids(spark, sf_dir).select("doc_id", tk.wrapped(F.col("ids"), 1000, 1001).alias("a"))
    return w.select("doc_id", _joined(tk.padded(F.col("a"), 12, 0)).alias("ids"), F.size("a").cast("long").alias("n"))


@register("text_wrap_and_pad", f"""
WITH i AS (SELECT doc_id, list_concat([-2], {_TEXT_IDS}, [-3]) AS a FROM documents)
SELECT doc_id, {_text(f"list_concat(a, list_resize([]::INT[], greatest({SEQUENCE} - len(a), 0), 0))")} AS ids, len(a)::BIGINT AS n FROM i""")
def text_wrap_and_pad(spark, sf_dir):
    """Whole texts between start and end ids (no character's), padded where they are shorter than a sequence; nothing is cut."""
    w = _text_ids(spark, sf_dir).select("doc_id", tk.wrapped(F.col("ids"), -2, -3).alias("a"))
    return w.select("doc_id", _joined(tk.padded_whole(F.col("a"), SEQUENCE, 0)).alias("ids"), F.size("a").cast("long").alias("n"))


@register("text_decoded_ids", "SELECT doc_id, length(text)::BIGINT AS n_ids, sha256(array_to_string(list_transform(string_split(text, ''), lambda c: unicode(c)), ',')) AS ids_sha256, text FROM documents")
def text_decoded_ids(spark, sf_dir):
    """Whole texts to ids, padded, and back; a pad id (-1, no character's) is left out."""
    ids = tk.text_ids(t(spark, sf_dir, "documents"), "doc_id", "text")
    padded = ids.select(F.struct("doc_id", F.size("ids").cast("long").alias("n_ids"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256")).alias("k"), F.concat("ids", F.array(F.lit(-1))).alias("ids"))
    return tk.ids_text(padded, "k", skip=-1).select("k.*", "text")


#: Sequence length and batch size of the rows.
_LENGTH, _BATCH = 512, 4


@register("fixed_length_rows", f"""
WITH d AS (SELECT doc_id, text, length(text) AS n, sum(length(text)) OVER (ORDER BY doc_id) - length(text) AS lo FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, text, n, lo, unnest(range((lo // {_LENGTH})::BIGINT, ((lo + n - 1) // {_LENGTH})::BIGINT + 1)) AS row FROM d),
p AS (SELECT row, greatest(row * {_LENGTH}, lo) AS low, substring(text, (greatest(row * {_LENGTH}, lo) - lo + 1)::BIGINT, (least((row + 1) * {_LENGTH}, lo + n) - greatest(row * {_LENGTH}, lo))::BIGINT) AS piece FROM w)
SELECT row, sha256(string_agg(piece, '' ORDER BY low)) AS text_sha256 FROM p
WHERE row < (SELECT (sum(n) // {_LENGTH * _BATCH} * {_BATCH})::BIGINT FROM d) GROUP BY row""")
def fixed_length_rows(spark, sf_dir):
    """Whole texts, one after the other, in training rows that span documents, clipped to whole batches."""
    rows = ranking.fixed_length_rows(t(spark, sf_dir, "documents").select("doc_id", "text"), [F.col("doc_id")], "text", _LENGTH, _BATCH)
    return tk.ids_text(rows, "row").select("row", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@register("text_token_positions", """
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS token FROM documents)
SELECT doc_id, token, (sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY token) - length(word) - 1)::BIGINT AS first_char, word FROM w""")
def text_token_positions(spark, sf_dir):
    """Every word of whole texts, with its index and the character it starts at."""
    return tk.word_positions(t(spark, sf_dir, "documents"), "doc_id", "text")


@register("all_holes", f"""
WITH i AS (SELECT doc_id, {_IDS} AS a FROM documents WHERE doc_id % 10 = 0), h AS (SELECT doc_id, a, s.s AS start, l.l AS size FROM i CROSS JOIN range(0, 12) s(s) CROSS JOIN range(1, 4) l(l) WHERE s.s + l.l <= len(a))
SELECT doc_id, start, size, {_text("list_concat(a[1:start], [9], a[start + size + 1:])")} AS ids FROM h""")
def all_holes(spark, sf_dir):
    """Every start with every hole length up to 3 (of every tenth document: the query's stated set)."""
    i = _ids(spark, sf_dir).where("doc_id % 10 = 0")
    s = i.select("doc_id", "ids", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("start"))
    h = s.select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("size")).where(F.col("start") + F.col("size") <= F.size("ids"))
    return h.select("doc_id", F.col("start").cast("long").alias("start"), F.col("size").cast("long").alias("size"), _joined(tk.with_hole(F.col("ids"), F.col("start"), F.col("size"), 9)).alias("ids"))


@register("every_hole", f"""
WITH i AS (SELECT doc_id, {_IDS} AS a FROM documents), s AS (SELECT doc_id, a, unnest(range(0, len(a))) AS start FROM i), h AS (SELECT doc_id, a, start, unnest(range(1, len(a) - start + 1)) AS size FROM s)
SELECT doc_id, start, size, {_text("list_concat(a[1:start], [9], a[start + size + 1:])")} AS ids FROM h""")
def every_hole(spark, sf_dir):
    """Every start with every hole length, of every document."""
    h = tk.all_holes(_ids(spark, sf_dir), "ids", 9)
    return h.select("doc_id", F.col("start").cast("long").alias("start"), F.col("size").cast("long").alias("size"), _joined(F.col("ids")).alias("ids"))


@register("feature_value_tokens", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 16 THEN l_quantity::BIGINT ELSE least(16 + floor((l_quantity - 16) / 8)::BIGINT, 19) END AS token FROM lineitem")
def feature_value_tokens(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tk.value_token(F.col("l_quantity").cast("long"), 16, 8, 19).alias("token"))


@register("token_depth", r"SELECT doc_id, (length(text) - length(replace(text, 'a', ''))) - (length(text) - length(replace(text, 'e', ''))) AS depth FROM documents")
def token_depth(spark, sf_dir):
    """Left less right tokens ('a' and 'e' for braces)."""
    return t(spark, sf_dir, "documents").select("doc_id", tk.text_depth(F.col("text"), "a", "e").cast("long").alias("depth"))


@register("duplicated_instances", "SELECT doc_id, r.i AS copy FROM documents CROSS JOIN range(1, 4) r(i)")
def duplicated_instances(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("copy"))


@register("statement_windows", """
WITH s AS (SELECT doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars AS lo, source FROM documents)
SELECT source, floor((lo + n_chars - 1) / 4096)::BIGINT AS last_window, doc_id, floor(lo / 4096)::BIGINT AS first_window FROM s""")
def statement_windows(spark, sf_dir):
    """Which fixed-length windows of a source's concatenated text a document lies in."""
    rows = ranking.running_sums(t(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), [F.col("source"), F.col("doc_id")], "n_chars")
    first = rows.groupBy("source").agg(F.min("before").alias("first"))
    d = rows.join(F.broadcast(first), "source").withColumn("lo", F.col("before") - F.col("first"))  # a row for each source
    return d.select("source", F.floor((F.col("lo") + F.col("n_chars") - 1) / 4096).alias("last_window"), "doc_id", F.floor(F.col("lo") / 4096).alias("first_window"))


@register("masked_instances")
def masked_instances(spark, sf_dir):
    """Seeded masking of whole texts; every row's positions and labels."""
    return tk.masked_texts(t(spark, sf_dir, "documents"), "doc_id", "text", F.xxhash64("doc_id"))


@register("text_holes")
def text_holes(spark, sf_dir):
    """Holes of up to five characters anywhere in whole texts, with what they hide, by the document's seed."""
    ids = tk.text_ids(t(spark, sf_dir, "documents"), "doc_id", "text")
    return holes.pooled_holes(ids, "doc_id", "ids", F.xxhash64("doc_id"), {"pad": -1, "start": -2, "end": -3, "hole": -4, "endhole": -5})
