"""Lexer vocabularies, atoms and their round trip, and canonical content, with SQL over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import kernels as kn
from corpusloom.functions import lexer as lx
from corpusloom.operators import dedup, lexing, nearest
from corpusloom.plans.catalog import oracle_of, register
from corpusloom.plans.q_features import vectors
from corpusloom.plans.q_relational import t
from corpusloom.sources.shared import saver

_QUOTED = lx.lexeme_pattern(possessive=False).replace("'", "''")
_WORDS = ", ".join(f"'{k}'" for k in lx.KEYWORDS)
_CALLS = ", ".join(f"'{k}'" for k in lx.BEFORE_CALLS)
_META = ", ".join(f"'{m}'" for m in lx.META)
_SPACE = r"'^[ \t\n\x0B\f\r]'"


def _name(x: str) -> str:
    return rf"(regexp_matches({x}, '^[\p{{L}}_]') AND {x} NOT IN ({_WORDS}))"


#: w: the tokens of each text without white space.
_LEXED = rf"""lexed AS (
  SELECT doc_id, list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '{_QUOTED}'), lambda x: NOT regexp_matches(x, {_SPACE})),
    lambda x: CASE WHEN starts_with(x, '[') AND length(x) > 1 THEN regexp_replace(x, '[ \t]', '', 'g') ELSE x END) AS w
  FROM documents)"""
_BOUND = f"""({_name("x")} AND coalesce(w[i - 1], '') NOT IN ('.', '->') AND (coalesce(w[i + 1], '') <> '(' OR list_contains(f, x)))"""
_LITERAL = r"""regexp_matches(x, '^(?:["''].|\.?[0-9])')"""
_KEPT = f"(NOT {_LITERAL} AND x NOT IN ({_META}) AND NOT ({_name('x')} AND coalesce(w[i + 1], '') = '('))"


@register("renamed_content_dedup", rf"""
WITH {_LEXED},
called AS (SELECT *, list_filter(w, lambda x, i: {_name("x")} AND coalesce(w[i + 1], '') = '(' AND regexp_matches(coalesce(w[i - 1], ''), '^[\p{{L}}_]') AND coalesce(w[i - 1], '') NOT IN ({_CALLS})) AS f FROM lexed),
held AS (SELECT *, list_filter(w, lambda x, i: {_BOUND}) AS held FROM called),
named AS (SELECT *, list_filter(held, lambda x, i: list_position(held, x) = i) AS names FROM held),
canonical AS (SELECT doc_id, list_transform(w, lambda x, i: CASE WHEN {_BOUND} THEN chr(1) || list_position(names, x) ELSE chr(2) || x END) AS c FROM named)
SELECT sha256(replace(replace(array_to_string(c, ''), ' ', ''), chr(10), '')) AS key, min(doc_id) AS doc_id FROM canonical GROUP BY 1""")
def renamed_content_dedup(spark, sf_dir):
    """The first document of each content whose bound names are numbered by first appearance."""
    docs = t(spark, sf_dir, "documents").select(lx.canonical_key(F.coalesce("text", F.lit(""))).alias("key"), "doc_id")
    return dedup.first_per_key(docs, ["key"], ["doc_id"])


_VOCABULARY = rf"""{_LEXED},
seen AS (SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(w, lambda x, i: {_KEPT}))) AS token FROM lexed) GROUP BY token),
code AS (SELECT c, row_number() OVER (ORDER BY c) AS k FROM (SELECT unnest(range(9, 14) || range(32, 127)) AS c)),
vocabulary AS (
  SELECT token, ' ' AS delimiter, row_number() OVER (ORDER BY n DESC, encode(token)) + {lx.RESERVED - 1} AS "index", n FROM seen
  UNION ALL SELECT chr(c::INT) || '-char-based', '', k + {len(lx.META) - 1}, 0 FROM code
  UNION ALL SELECT unnest([{_META}]), '', unnest(range(0, {len(lx.META)})), 0)"""


@register("lexer_vocabulary", f"WITH {_VOCABULARY} SELECT * FROM vocabulary")
def lexer_vocabulary(spark, sf_dir):
    """All tokens of whole texts behind the meta tokens and the printable characters."""
    return lexing.lexer_vocabulary(t(spark, sf_dir, "documents"))


#: By text: the places and entries of its atoms; a token outside the vocabulary is its characters.
_ATOMS = rf"""{_VOCABULARY},
placed AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM lexed),
entry AS (SELECT p.*, v."index", v.delimiter FROM placed p LEFT JOIN vocabulary v ON v.token = p.token AND NOT (v.delimiter = '' AND ends_with(v.token, '-char-based'))),
atom AS (
  SELECT doc_id, pos, 0 AS k, "index", token || delimiter AS word, false AS chars FROM entry WHERE "index" IS NOT NULL
  UNION ALL
  SELECT e.doc_id, e.pos, e.k, c.k + {len(lx.META) - 1}, replace(e.ch, chr(92), chr(92) || chr(92)), true
  FROM (SELECT doc_id, pos, generate_subscripts(string_split(token, ''), 1) AS k, unnest(string_split(token, '')) AS ch FROM entry WHERE "index" IS NULL) e
  LEFT JOIN code c ON unicode(e.ch) = c.c),
text_of AS (
  SELECT doc_id, count(*) FILTER (WHERE chars) AS n_characters, count(*) AS n, count("index") = count(*) AS whole,
         string_agg("index"::VARCHAR, ',' ORDER BY pos, k) AS ids, string_agg(word, '' ORDER BY pos, k) AS text
  FROM atom GROUP BY doc_id)"""


def _vocabulary(spark, docs):
    return saver(spark, "vocabulary")(lexing.lexer_vocabulary(docs))


@register("lexer_atoms", f"""
WITH {_ATOMS}
SELECT d.doc_id, CASE WHEN coalesce(a.whole, true) THEN coalesce(a.n, 0) END AS n_atoms, coalesce(a.n_characters, 0) AS n_characters,
       CASE WHEN coalesce(a.whole, true) THEN sha256(coalesce(a.ids, '')) END AS ids_sha256
FROM documents d LEFT JOIN text_of a USING (doc_id)""")
def lexer_atoms(spark, sf_dir):
    """Whole texts as ids; unknown tokens character by character, none where a character has no entry."""
    docs = t(spark, sf_dir, "documents")
    atoms = lexing.atoms(docs, _vocabulary(spark, docs))
    return atoms.select("doc_id", lexing.digested(F.col("atoms")).alias("d")).select("doc_id", "d.n_atoms", "d.n_characters", "d.ids_sha256")


@register("lexer_round_trip", f"""
WITH {_ATOMS}
SELECT d.doc_id, CASE WHEN coalesce(a.whole, true) THEN sha256(coalesce(a.text, '')) END AS text_sha256 FROM documents d LEFT JOIN text_of a USING (doc_id)""")
def lexer_round_trip(spark, sf_dir):
    """Whole texts to ids and written out again with the vocabulary's delimiters."""
    docs = t(spark, sf_dir, "documents")
    vocabulary = _vocabulary(spark, docs)
    text = lexing.written_out(saver(spark, "atoms")(lexing.atomized(docs, vocabulary)), vocabulary)
    return text.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


#: Whole texts with braces for two letters and kernels for ends of lines.
_KERNELS = r"""
prepared AS (SELECT doc_id, string_split(replace(translate(coalesce(text, ''), 'qz', '{}'), chr(10), 'kernel void'), 'kernel void') AS chunks FROM documents),
chunk AS (SELECT doc_id, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) - 1 AS k FROM prepared),
piece AS (SELECT doc_id, k, unnest(regexp_extract_all(chunk, '[^{}]*[{}]')) AS p, generate_subscripts(regexp_extract_all(chunk, '[^{}]*[{}]'), 1) AS i FROM chunk WHERE k > 0),
depth AS (SELECT doc_id, k, sum(length(p)) OVER w AS n, sum(ends_with(p, '{')::INT) OVER w AS opened, sum(ends_with(p, '}')::INT) OVER w AS closed FROM piece WINDOW w AS (PARTITION BY doc_id, k ORDER BY i)),
ended AS (SELECT doc_id, k, min(n)::BIGINT AS n FROM depth WHERE opened > 0 AND opened = closed GROUP BY doc_id, k),
part AS (
  SELECT c.doc_id, c.k, CASE WHEN e.n IS NULL THEN chunk ELSE chunk[:e.n] || chunk[e.n + 1 : length(chunk) - length(regexp_replace(chunk[e.n + 1:], '^[ \n]+', ''))] END AS body,
         CASE WHEN e.n IS NULL THEN '' ELSE regexp_replace(chunk[e.n + 1:], '^[ \n]+', '') END AS behind
  FROM chunk c LEFT JOIN ended e USING (doc_id, k) WHERE c.k > 0)"""


@register("extracted_kernels", rf"""WITH {_KERNELS}
SELECT p.doc_id, p.k, sha256('kernel void' || p.body) AS kernel_sha256,
       sha256((SELECT h.chunk FROM chunk h WHERE h.doc_id = p.doc_id AND h.k = 0) || coalesce((SELECT string_agg(b.behind, '' ORDER BY b.k) FROM part b WHERE b.doc_id = p.doc_id AND b.k < p.k), '')) AS header_sha256 FROM part p""")
def extracted_kernels(spark, sf_dir):
    """Every kernel of whole texts and the global text in front of it."""
    text = F.replace(F.translate(F.coalesce("text", F.lit("")), "qz", "{}"), F.lit("\n"), F.lit(kn.SPECIFIER))
    found = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(kn.kernels_and_headers(text)).alias("k", "x"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return found.select("doc_id", (F.col("k") + 1).cast("long").alias("k"), digest("x.kernel").alias("kernel_sha256"), digest("x.header").alias("header_sha256"))


#: Each target's nearest sample of each group in three feature spaces (thirds of the vectors), by SQL.
_NEAREST = """
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS f, len(embedding) // 3 AS n FROM embeddings),
space AS (SELECT vec_id, label, unnest([1, 2, 3]) AS space, unnest([f[1:n], f[n + 1:2 * n], f[2 * n + 1:]]) AS f FROM v),
far AS (
  SELECT t.space, t.vec_id AS target_id, s.label, s.vec_id, round(sqrt(list_sum(list_transform(range(1, len(t.f) + 1), lambda i: abs(t.f[i] * t.f[i] - s.f[i] * s.f[i])))), 6) AS dist
  FROM space t JOIN space s ON t.space = s.space AND s.vec_id % 20 <> 0 WHERE t.vec_id % 20 = 0),
chosen AS (SELECT DISTINCT label, vec_id FROM (SELECT label, arg_min(vec_id, (dist, vec_id)) AS vec_id FROM far GROUP BY space, target_id, label))"""


@register("human_likeness_set", oracle_of("renamed_content_dedup").rsplit("SELECT sha256", 1)[0].rstrip() + f",{_NEAREST}" + """
SELECT label, sha256(replace(replace(array_to_string(c, ''), ' ', ''), chr(10), '')) AS key, min(doc_id) AS doc_id FROM chosen JOIN canonical ON doc_id = vec_id GROUP BY 1, 2""")
def human_likeness_set(spark, sf_dir):
    """Texts to show in a study: for each group the samples nearest to every twentieth vector in each of three feature
    spaces, each content once, whatever its bound names."""
    v = vectors(spark, sf_dir)
    third = F.floor(F.size("features") / 3).cast("int")
    chosen = None
    for space in range(3):
        part = F.slice("features", third * space + 1, third if space < 2 else F.size("features"))
        targets = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("target_id"), part.alias("target"))
        far = nearest.nearest(targets, v.where("vec_id % 20 <> 0").select("vec_id", "label", part.alias("features")), 1, key=F.col("label"), digits=6)
        near = far.groupBy(F.col("key").alias("label"), "target_id").agg(F.min(F.struct(F.round("dist", 6).alias("dist"), "vec_id")).alias("m")).select("label", "m.vec_id")
        chosen = near if chosen is None else chosen.unionByName(near)
    texts = t(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shown = chosen.distinct().join(texts, F.col("vec_id") == F.col("doc_id")).select("label", lx.canonical_key(F.col("text")).alias("key"), "doc_id")
    return shown.groupBy("label", "key").agg(F.min("doc_id").alias("doc_id"))
