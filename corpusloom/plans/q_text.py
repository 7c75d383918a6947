"""Text preprocessors, codecs and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import codecs
from corpusloom.functions import text as tx
from corpusloom.plans.catalog import register
from corpusloom.plans.q_relational import t


def _docs(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", "text")


def _first(items):
    return items[0]["text"]


@register("min_lines", r"SELECT doc_id, len(string_split(trim(text, ' ' || chr(10) || chr(9) || chr(13)), chr(10))) >= 3 AS ok FROM documents")
def min_lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.min_lines(F.col("text"))[0]["ok"].alias("ok"))


@register("collapse_spaces", "SELECT doc_id, sha256(regexp_replace(text, ' {2,}', ' ', 'g')) AS sha FROM documents")
def collapse_spaces(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(_first(tx.collapse_spaces(F.col("text"))).cast("binary"), 256).alias("sha"))


@register("right_strip_lines", r"""
SELECT doc_id, sha256(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '[ \t\r\f\v]+$', '')), chr(10)), '[ \t\n\r\f\v]+$', '')) AS sha FROM documents""")
def right_strip_lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(_first(tx.right_strip_lines(F.col("text"))).cast("binary"), 256).alias("sha"))


@register("collapse_empty_lines", """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)
SELECT doc_id, sha256(array_to_string(list_filter(a, lambda x, i: NOT (trim(x, ' ' || chr(9) || chr(13)) = '' AND (i = 1 OR rtrim(a[i - 1], ' ' || chr(9) || chr(13)) = ''))), chr(10))) AS sha FROM l""")
def collapse_empty_lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(_first(tx.collapse_empty_lines(F.col("text"))).cast("binary"), 256).alias("sha"))


@register("drop_marked_lines", "SELECT page_id, len(list_filter(string_split(html, chr(10)), lambda x: NOT (contains(x, '<script') OR contains(x, '# include '))))::BIGINT AS n_lines FROM pages")
def drop_marked_lines(spark, sf_dir):
    """Lines that hold one of two marks are dropped (on pages, script tags)."""
    lines = F.filter(F.split("html", "\n"), lambda x: ~(x.contains("<script") | x.contains("# include ")))
    return t(spark, sf_dir, "pages").select("page_id", F.size(lines).cast("long").alias("n_lines"))


@register("preprocessor_chain", r"""
WITH s AS (SELECT doc_id, regexp_replace(text, ' {2,}', ' ', 'g') AS x FROM documents)
SELECT doc_id, len(string_split(trim(x, ' ' || chr(10) || chr(9) || chr(13)), chr(10))) >= 3 AS ok, CASE WHEN len(string_split(trim(x, ' ' || chr(10) || chr(9) || chr(13)), chr(10))) >= 3 THEN sha256(x) ELSE sha256('fewer than 3 lines') END AS sha FROM s""")
def preprocessor_chain(spark, sf_dir):
    """Stages by name; what a stage rejects passes the later ones."""
    out = _docs(spark, sf_dir).select("doc_id", F.inline(tx.chain(F.col("text"), ["collapse_spaces", "min_lines", "plain_keywords"])))
    return out.select("doc_id", "ok", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


@register("content_hashes", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def content_hashes(spark, sf_dir):
    b = F.col("text").cast("binary")
    return _docs(spark, sf_dir).select("doc_id", F.md5(b).alias("md5"), F.sha1(b).alias("sha1"), F.sha2(b, 256).alias("sha256"))


@register("body_hash", "SELECT doc_id, sha256(array_to_string(string_split(text, chr(10))[3:], chr(10))) AS sha FROM documents")
def body_hash(spark, sf_dir):
    """Hash without the first two lines."""
    lines = F.split("text", "\n")
    body = F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0)))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(F.array_join(body, "\n").cast("binary"), 256).alias("sha"))


@register("secret_rules", r"SELECT doc_id, regexp_matches(text, '\bAKIA[0-9A-Z]{16}\b') OR regexp_matches(text, '(?i)\b(api[_-]?key|secret|passw(or)?d|token)\b\s*[:=]\s*\S{8,}') OR regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') AS secret FROM documents")
def secret_rules(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", (~tx.no_secrets(F.col("text"))[0]["ok"]).alias("secret"))


@register("int_list_codec", """
SELECT l_orderkey, list_sum(list_transform(string_split(s, '.'), lambda x: x::INT))::BIGINT AS total, s AS encoded FROM (SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, '.' ORDER BY l_linenumber, l_partkey) AS s FROM lineitem GROUP BY 1)""")
def int_list_codec(spark, sf_dir):
    """Ints joined by points and read back."""
    s = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("a")).select("l_orderkey", codecs.joined(F.col("a"), ".").alias("encoded"))
    return s.select("l_orderkey", F.aggregate(codecs.ints(F.col("encoded"), "."), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), "encoded")


@register("map_codec", """
SELECT event_id, 'k:' || json_extract_string(props, '$.k') || chr(10) || 'F2:a/b:' || user_id AS lines, json_extract_string(props, '$.k')::DOUBLE + user_id AS total FROM events""")
def map_codec(spark, sf_dir):
    """Lines key:value, keys with colons too, as a map."""
    e = t(spark, sf_dir, "events").select("event_id", F.concat(F.lit("k:"), F.get_json_object("props", "$.k"), F.lit("\nF2:a/b:"), F.col("user_id").cast("string")).alias("lines"))
    m = codecs.key_values(F.col("lines"))
    return e.select("event_id", "lines", (m["k"] + m["F2:a/b"]).alias("total"))


@register("json_rows", "SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events")
def json_rows(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@register("comment_strip", r"""
SELECT doc_id, length(array_to_string(list_transform(regexp_extract_all(text, '(?s)//[^\n]*|/\*.*?\*/|''(?:[^\\'']|\\.)*''|"(?:[^\\"]|\\.)*"|[^/''"]+|.'), lambda x: CASE WHEN starts_with(x, '//') OR starts_with(x, '/*') THEN ' ' ELSE x END), ''))::INT AS n_chars FROM documents""")
def comment_strip(spark, sf_dir):
    """C comments out of texts; literals stay."""
    return _docs(spark, sf_dir).select("doc_id", F.length(tx.strip_comments("text")).alias("n_chars"))
