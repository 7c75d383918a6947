"""Encoded corpora, row rewrites, samplers, candidate extracts, and text stages on whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import features as fx
from corpusloom.functions import text as tx
from corpusloom.functions import tokens as tk
from corpusloom.operators import dedup, nearest, ranking, search
from corpusloom.plans.catalog import register
from corpusloom.plans.q_candidates import _C, _percent, candidates
from corpusloom.plans.q_relational import t
from corpusloom.plans.q_tokens import _GREEDY, WORDS


def _sha(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


# deduplication and corpora


@register("token_sequence_dedup", f"SELECT sha256(array_to_string(regexp_extract_all(text, '{_GREEDY}'), ',')) AS key, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def token_sequence_dedup(spark, sf_dir):
    """The first document of each token sequence."""
    key = _sha(F.array_join(tk.greedy_tokens(F.col("text"), WORDS), ","))
    return t(spark, sf_dir, "documents").groupBy(key.alias("key")).agg(F.min("doc_id").alias("doc_id"))


@register("encoded_rows", r"""
SELECT doc_id, length(text)::BIGINT AS token_count, sha256(array_to_string(list_append(list_transform(regexp_extract_all(text, '(?s).'), lambda c: unicode(c)), 3), '.')) AS data FROM documents WHERE NOT regexp_matches(text, '[^\n -~]')""")
def encoded_rows(spark, sf_dir):
    """Character ids with an end-of-file id behind them, which the count leaves out; a text with a
    character outside the vocabulary (line ends and printable ASCII) is skipped."""
    ids = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.ascii(c))
    rows = t(spark, sf_dir, "documents").where(~F.col("text").rlike(r"[^\n -~]")).select("doc_id", ids.alias("ids"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("token_count"), _sha(F.array_join(F.transform(F.concat("ids", F.array(F.lit(3))), lambda i: i.cast("string")), ".")).alias("data"))


_VOCABULARY = "SELECT ch AS token, row_number() OVER (ORDER BY n DESC, encode(ch)) + 5 AS i FROM (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY 1)"


@register("vocabulary_validity", f"SELECT count(*) + 6 AS atoms, count(DISTINCT token) + 6 AS distinct_atoms, count(DISTINCT i) + 6 AS distinct_indices, count(*) = count(DISTINCT token) AND count(*) = count(DISTINCT i) AS valid FROM ({_VOCABULARY})")
def vocabulary_validity(spark, sf_dir):
    """A vocabulary is valid if atoms and indices are unique."""
    v = tk.character_vocabulary(t(spark, sf_dir, "documents"))
    n, a, i = F.count("*"), F.countDistinct("token"), F.countDistinct("index")
    return v.agg(n.alias("atoms"), a.alias("distinct_atoms"), i.alias("distinct_indices"), ((n == a) & (n == i)).alias("valid"))


@register("vocabulary_round_trip", f"SELECT token, i::INT AS \"index\" FROM ({_VOCABULARY})")
def vocabulary_round_trip(spark, sf_dir):
    """The vocabulary as JSON values of a key/value table, and read back."""
    v = tk.character_vocabulary(t(spark, sf_dir, "documents")).where("n > 0")
    held = v.select(F.concat(F.lit("vocab_"), F.col("index").cast("string")).alias("key"), F.to_json(F.struct("token", "index")).alias("value"))
    return held.select(F.from_json("value", "token string, index int").alias("v")).select("v.token", "v.index")


@register("corpus_statistics_row", """
WITH l AS (SELECT n_chars // 500 AS b, count(*) AS n FROM documents GROUP BY 1), c AS (SELECT b, sum(n) OVER (ORDER BY b)::BIGINT AS n FROM l), m AS (SELECT lang, round(avg(n_chars), 4) AS v FROM documents GROUP BY 1)
SELECT (SELECT count(*) FROM documents) AS file_count, (SELECT string_agg(b || ':' || n, ',' ORDER BY b) FROM c) AS corpus_lengths, (SELECT string_agg(lang || ':' || (v * 10000)::BIGINT, ',' ORDER BY lang) FROM m) AS corpus_features""")
def corpus_statistics_row(spark, sf_dir):
    """One row for a corpus: files, the cumulative histogram of lengths, means by key (in ten thousandths)."""
    d = t(spark, sf_dir, "documents")
    lengths = d.groupBy(F.floor(F.col("n_chars") / 500).alias("b")).agg(F.count("*").alias("n"))
    running = lengths.withColumn("n", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("b")))  # a row for each bin
    joined = lambda rows, key, value: rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: F.concat_ws(":", x[key].cast("string"), x[value].cast("string"))), ",").alias("s"))
    means = d.groupBy("lang").agg((F.round(F.avg("n_chars"), 4) * 10000).cast("long").alias("v"))
    one = d.agg(F.count("*").alias("file_count"))
    return one.crossJoin(joined(running, "b", "n").withColumnRenamed("s", "corpus_lengths")).crossJoin(joined(means, "lang", "v").withColumnRenamed("s", "corpus_features"))  # single rows


@register("rewritten_rows", "SELECT doc_id, lang, source, length(regexp_replace(text, ' {2,}', ' ', 'g'))::BIGINT AS n_chars, sha256(regexp_replace(text, ' {2,}', ' ', 'g')) AS sha FROM documents")
def rewritten_rows(spark, sf_dir):
    """Rows with the text collapsed and what follows from it derived again; the rest as it was."""
    rows = t(spark, sf_dir, "documents").withColumn("text", F.regexp_replace("text", " {2,}", " ")).withColumns({"n_chars": F.length("text").cast("long"), "sha": _sha(F.col("text"))})
    return rows.select("doc_id", "lang", "source", "n_chars", "sha")


@register("rewritten_labels", r"SELECT page_id, regexp_replace(regexp_replace(url, '^https?://([^/]+)/([a-z]*).*$', '\1.\2'), '[.]$', '') AS label FROM pages")
def rewritten_labels(spark, sf_dir):
    """Long names to suite.benchmark."""
    return t(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://([^/]+)/([a-z]*).*$", "$1.$2"), "[.]$", "").alias("label"))


@register("appended_contents", "SELECT 'documents' AS part, doc_id AS id, sha256(text) AS sha FROM documents UNION ALL SELECT 'pages', page_id, sha256(html) FROM pages")
def appended_contents(spark, sf_dir):
    """Another table's contents behind the corpus, none left out."""
    d = t(spark, sf_dir, "documents").select(F.lit("documents").alias("part"), F.col("doc_id").alias("id"), _sha(F.col("text")).alias("sha"))
    return d.unionByName(t(spark, sf_dir, "pages").select(F.lit("pages").alias("part"), F.col("page_id").alias("id"), _sha(F.col("html")).alias("sha")))


@register("samples_of_active_rows", """
SELECT sha, min(turn_id) AS first_turn FROM (SELECT sha256(text) AS sha, conv_id * 1000 + turn AS turn_id, role FROM conversations) WHERE role = 'user' AND sha NOT IN (SELECT sha256(text) FROM conversations WHERE role <> 'user') GROUP BY sha""")
def samples_of_active_rows(spark, sf_dir):
    """Rows of one kind as samples: those not held already, each once, with its first row."""
    c = t(spark, sf_dir, "conversations").select(_sha(F.col("text")).alias("sha"), (F.col("conv_id") * 1000 + F.col("turn")).alias("first_turn"), "role")
    return dedup.insert_absent(c.where("role <> 'user'"), c.where("role = 'user'").select("sha", "first_turn"), "sha", ["first_turn"])


@register("successful_texts_json", "SELECT doc_id, md5('{\"text\":' || to_json(text) || '}') AS line FROM documents WHERE n_chars >= 100")
def successful_texts_json(spark, sf_dir):
    """Texts of rows that passed, as JSON lines."""
    kept = t(spark, sf_dir, "documents").where("n_chars >= 100")
    return kept.select("doc_id", F.md5(F.to_json(F.struct("text")).cast("binary")).alias("line"))


@register("chunk_of_every_row", """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), s AS (SELECT source, n, sum(n) OVER (ORDER BY source) - n AS lo FROM c)
SELECT doc_id, source, (lo + row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::BIGINT AS idx, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS inside FROM documents JOIN s USING (source)""")
def chunk_of_every_row(spark, sf_dir):
    """The global index of every row, its chunk, and its place in the chunk."""
    rows = ranking.numbered_rows(t(spark, sf_dir, "documents").select("doc_id", "source"), [F.col("source"), F.col("doc_id")], "idx")
    first = rows.groupBy("source").agg(F.min("idx").alias("first"))  # a row for each chunk
    return rows.join(F.broadcast(first), "source").select("doc_id", "source", "idx", (F.col("idx") - F.col("first")).alias("inside"))


@register("done_in_every_result", """
WITH d AS (SELECT unnest(string_split(text, ' ')) AS name FROM conversations WHERE role = 'user') SELECT p_partkey, p_name FROM part WHERE string_split(p_name, ' ')[1] NOT IN (SELECT name FROM d)""")
def done_in_every_result(spark, sf_dir):
    """Targets that no results row names: all rows of results, split into names, against all targets."""
    done = t(spark, sf_dir, "conversations").where("role = 'user'").select(F.explode(F.split("text", " ")).alias("name")).distinct()
    p = t(spark, sf_dir, "part").select("p_partkey", "p_name", F.split("p_name", " ")[0].alias("name"))
    return p.join(done, "name", "left_anti").select("p_partkey", "p_name")


@register("whole_expected_error", """
SELECT vec_id, list_sum(list_transform(range(1, len(embedding) // 2 + 1), lambda i: abs(embedding[i]::DOUBLE) * abs(embedding[i + len(embedding) // 2]::DOUBLE)))::DECIMAL(18, 4)::VARCHAR AS expected_error FROM embeddings""")
def whole_expected_error(spark, sf_dir):
    """Sum over labels of posterior times loss; the first half of the components and the second stand for them."""
    half = F.floor(F.size("embedding") / 2).cast("int")
    part = lambda at: F.transform(F.slice("embedding", at, half), lambda x: F.abs(x.cast("double")))
    total = F.aggregate(F.zip_with(part(F.lit(1)), part(half + 1), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return t(spark, sf_dir, "embeddings").select("vec_id", total.cast("decimal(18,4)").cast("string").alias("expected_error"))


# candidate extracts


@register("score_direction_within_relative_hole", _C + """, g AS (SELECT floor(100 * hole / (hole + length))::BIGINT AS bucket, sign(score_delta)::INT AS score, count(*) AS n FROM c WHERE score_delta < 'inf'::DOUBLE GROUP BY 1, 2)
SELECT bucket, score, n, CASE WHEN bucket = max(bucket) OVER () THEN n ELSE round(100.0 * n / sum(n) OVER (PARTITION BY bucket), 6) END AS share FROM g""")
def score_direction_within_relative_hole(spark, sf_dir):
    """Within each relative hole length, the shares of the directions; the longest keeps its counts, as at the source."""
    c = candidates(spark, sf_dir).where(F.col("score_delta") < float("inf"))
    g = _percent(c, [F.floor(100 * F.col("hole") / (F.col("hole") + F.col("length"))).alias("bucket"), F.signum("score_delta").cast("int").alias("score")], ["bucket"])
    last = g.agg(F.max("bucket").alias("last"))
    return g.crossJoin(F.broadcast(last)).select("bucket", "score", "n", F.when(F.col("bucket") == F.col("last"), F.col("n").cast("double")).otherwise(F.col("percent")).alias("share"))


@register("compile_counts_by_index_length", _C + "SELECT length, compiles, count(*) AS n FROM c GROUP BY 1, 2")
def compile_counts_by_index_length(spark, sf_dir):
    return candidates(spark, sf_dir).groupBy("length", "compiles").agg(F.count("*").alias("n"))


@register("delta_scatter", _C + """
SELECT doc_id, token_delta, floor(100 * hole / (hole + length))::BIGINT AS relative_hole, length AS feed_length, CASE WHEN score_delta < 'inf'::DOUBLE THEN round(score_delta, 6) END AS score_delta FROM c""")
def delta_scatter(spark, sf_dir):
    """The points of the four scatter plots: token delta, relative hole and feed length, and the score delta where it is finite."""
    return candidates(spark, sf_dir).select("doc_id", "token_delta", F.floor(100 * F.col("hole") / (F.col("hole") + F.col("length"))).alias("relative_hole"), F.col("length").alias("feed_length"), F.when(F.col("score_delta") < float("inf"), F.round("score_delta", 6)).alias("score_delta"))


@register("delta_quartiles", _C + "SELECT gen, quantile_cont(token_delta, 0.25) AS q1, quantile_cont(token_delta, 0.5) AS q2, quantile_cont(token_delta, 0.75) AS q3 FROM c GROUP BY gen")
def delta_quartiles(spark, sf_dir):
    return candidates(spark, sf_dir).groupBy("gen").agg(*[F.percentile("token_delta", q).alias(f"q{k}") for k, q in enumerate((0.25, 0.5, 0.75), 1)])


# sampling, splits, instances


def _draw(seed: str, *keys: str | Column) -> Column:
    """A number below 2**32 from a seed and keys: the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]).cast("binary")), 1, 8), 16, 10).cast("long")


def _draw_sql(seed: str, *keys: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {' || chr(58) || '.join(keys)}), 1, 8))::BIGINT"


@register("random_k", f"SELECT doc_id FROM documents ORDER BY {_draw_sql('k7', 'doc_id')}, doc_id LIMIT 50")
def random_k(spark, sf_dir):
    """Fifty rows, all equally likely, by a seeded hash."""
    return t(spark, sf_dir, "documents").select("doc_id").orderBy(_draw("k7", "doc_id"), "doc_id").limit(50)


@register("uniform_sampler", f"SELECT doc_id, {_draw_sql('u', 'doc_id')} % (n_chars + 1) AS length FROM documents")
def uniform_sampler(spark, sf_dir):
    """A hole length for each text, uniform from 0 to the text's own length."""
    return t(spark, sf_dir, "documents").select("doc_id", (_draw("u", "doc_id") % (F.col("n_chars") + 1)).alias("length"))


@register("truncated_normal_sampler", f"""
WITH d AS (SELECT doc_id, k, round_even(6 + 4 * sqrt(-2 * ln(({_draw_sql('a', 'doc_id', 'k')} + 1) / 4294967297.0::DOUBLE)) * cos(2 * pi() * {_draw_sql('b', 'doc_id', 'k')} / 4294967296.0::DOUBLE), 0)::BIGINT AS v FROM documents CROSS JOIN range(0, 24) r(k))
SELECT doc_id, arg_min(v, k) AS length FROM d WHERE v BETWEEN 0 AND 16 GROUP BY doc_id""")
def truncated_normal_sampler(spark, sf_dir):
    """Normal lengths of mean 6 and scale 4, drawn again until they lie in 0 to 16 (24 draws, all of which miss once in 10**28;
    such a row gets the mean). All draws of a row are made in its row."""

    def drawn(k: Column) -> Column:
        u, w = (_draw("a", "doc_id", k) + 1) / F.lit(4294967297.0), _draw("b", "doc_id", k) / F.lit(4294967296.0)
        return F.rint(6 + 4 * F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * w)).cast("long")

    hits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(23)), drawn), lambda v: (v >= 0) & (v <= 16))
    return t(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.get(hits, F.lit(0)), F.lit(6)).cast("long").alias("length"))


@register("percent_split", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < floor(count(*) OVER () * (1 - 7 / 100.0::DOUBLE)) THEN 'train' ELSE 'validation' END AS part FROM documents")
def percent_split(spark, sf_dir):
    """The first int(n * (1 - 7 / 100)) rows train."""
    d = ranking.numbered_rows(t(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")])
    n = d.count()
    return d.select("doc_id", F.when(F.col("row_num") < int(n * (1 - 7 / 100)), "train").otherwise("validation").alias("part"))


_HOLE = "WITH h AS (SELECT doc_id, text, length(text) AS n, doc_id * 7 % length(text) AS s, 1 + doc_id % 9 AS k FROM documents WHERE length(text) > 0)\n"


def _holes(spark, sf_dir) -> DataFrame:
    n = F.length("text")
    return t(spark, sf_dir, "documents").where(n > 0).select("doc_id", "text", n.alias("n"), (F.col("doc_id") * 7 % n).cast("int").alias("s"), (1 + F.col("doc_id") % 9).cast("int").alias("k"))


@register("hole_position_masks", _HOLE + "SELECT doc_id, least(k, n - s)::INT AS hidden, sha256(array_to_string(list_transform(range(0, n), lambda i: CASE WHEN i >= s AND i < s + k THEN 1 ELSE 0 END), '')) AS mask FROM h")
def hole_position_masks(spark, sf_dir):
    """For each text one hole, as a mask of all its positions."""
    mask = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when((i >= F.col("s")) & (i < F.col("s") + F.col("k")), "1").otherwise("0"))
    return _holes(spark, sf_dir).select("doc_id", F.least("k", F.col("n") - F.col("s")).alias("hidden"), _sha(F.array_join(mask, "")).alias("mask"))


@register("rendered_holes", _HOLE + "SELECT doc_id, sha256(substr(text, 1, s::INT) || '[HOLE]' || substr(text, (s + k + 1)::INT)) AS rendered, substr(text, (s + 1)::INT, k::INT) AS hidden FROM h")
def rendered_holes(spark, sf_dir):
    """The masked row as text, and what the hole hides."""
    s, k = F.col("s"), F.col("k")
    return _holes(spark, sf_dir).select("doc_id", _sha(F.concat(F.substring("text", F.lit(1), s), F.lit("[HOLE]"), F.substring("text", s + k + 1, F.col("n")))).alias("rendered"), F.substring("text", s + 1, k).alias("hidden"))


@register("instances_per_space", """
SELECT vec_id, s.space AS space, round(s.v, 6) AS total FROM (SELECT vec_id, unnest([{'space': 'first', 'v': CASE WHEN vec_id % 3 > 0 THEN list_sum(embedding[1:8])::DOUBLE END}, {'space': 'last', 'v': CASE WHEN vec_id % 5 > 0 THEN list_sum(embedding[9:16])::DOUBLE END}]) AS s FROM embeddings) WHERE s.v IS NOT NULL""")
def instances_per_space(spark, sf_dir):
    """One row for each feature space that has a vector."""
    total = lambda a: F.aggregate(F.slice("embedding", a, 8), F.lit(0.0), lambda x, y: x + y)
    spaces = F.array(F.struct(F.lit("first").alias("space"), F.when(F.col("vec_id") % 3 > 0, total(1)).alias("v")), F.struct(F.lit("last").alias("space"), F.when(F.col("vec_id") % 5 > 0, total(9)).alias("v")))
    return t(spark, sf_dir, "embeddings").select("vec_id", F.inline(spaces)).where("v is not null").select("vec_id", "space", F.round("v", 6).alias("total"))


@register("whole_instances_per_space", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT vec_id, s.space AS space, round(s.v, 5) AS total FROM (SELECT vec_id, unnest([{'space': 'first', 'v': CASE WHEN vec_id % 3 > 0 THEN list_sum(e[1:len(e) // 2]) END}, {'space': 'last', 'v': CASE WHEN vec_id % 5 > 0 THEN list_sum(e[len(e) // 2 + 1:]) END}]) AS s FROM e) WHERE s.v IS NOT NULL""")
def whole_instances_per_space(spark, sf_dir):
    """instances_per_space with both halves of the whole vectors."""
    half = F.floor(F.size("embedding") / 2).cast("int")
    total = lambda a, n: F.aggregate(F.slice("embedding", a, n), F.lit(0.0), lambda x, y: x + y.cast("double"))
    space = lambda name, by, a, n: F.struct(F.lit(name).alias("space"), F.when(F.col("vec_id") % by > 0, total(a, n)).alias("v"))
    spaces = F.array(space("first", 3, F.lit(1), half), space("last", 5, half + 1, F.size("embedding")))
    return t(spark, sf_dir, "embeddings").select("vec_id", F.inline(spaces)).where("v is not null").select("vec_id", "space", F.round("v", 5).alias("total"))


#: Lines of a raw vector by feature space.
SPACE_LINES = {"GreweFeatures": 8, "InstCountFeatures": 70, "AutophaseFeatures": 56}


@register("space_by_line_count", """
SELECT o_orderkey, CASE n WHEN 8 THEN 'GreweFeatures' WHEN 70 THEN 'InstCountFeatures' WHEN 56 THEN 'AutophaseFeatures' END AS space, md5(array_to_string(list_transform(range(0, n), lambda i: 'f' || i || ':' || (o_orderkey + i)), chr(10))) AS blob
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 8 WHEN 1 THEN 70 WHEN 2 THEN 56 ELSE 9 END AS n FROM orders)""")
def space_by_line_count(spark, sf_dir):
    """A map of features as a raw blob; the number of its lines tells the space, none for other numbers."""
    i = F.col("o_orderkey")
    n = F.when(i % 4 == 0, 8).when(i % 4 == 1, 70).when(i % 4 == 2, 56).otherwise(9)
    blob = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(F.lit("f"), k.cast("string"), F.lit(":"), (i + k).cast("string"))), "\n")
    lines = F.size(F.split("blob", "\n"))
    space = F.lit(None).cast("string")
    for name, count in SPACE_LINES.items():
        space = F.when(lines == count, name).otherwise(space)
    return t(spark, sf_dir, "orders").select("o_orderkey", blob.alias("blob")).select("o_orderkey", space.alias("space"), F.md5(F.col("blob").cast("binary")).alias("blob"))


@register("vector_and_map", """
SELECT vec_id, len(embedding)::INT AS n, list_aggregate(list_transform(embedding, lambda x, i: x::DOUBLE * i), 'sum')::DECIMAL(18, 3)::VARCHAR AS weighted FROM embeddings""")
def vector_and_map(spark, sf_dir):
    """A vector as a map by name and back, in the order of the names' numbers."""
    names = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.concat(F.lit("f"), i.cast("string")))
    named = t(spark, sf_dir, "embeddings").select("vec_id", F.map_from_arrays(names, "embedding").alias("m"))
    placed = F.transform(F.map_entries("m"), lambda e: F.struct(F.substring(e["key"], 2, 10).cast("int").alias("place"), e["value"].alias("x")))
    back = named.select("vec_id", F.transform(F.sort_array(placed), lambda e: e["x"]).alias("v"))
    weighted = F.aggregate(F.transform("v", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return back.select("vec_id", F.size("v").alias("n"), weighted.cast("decimal(18,3)").cast("string").alias("weighted"))


@register("value_share_distribution", "SELECT n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM (SELECT json_extract(props, '$.k')::INT AS n FROM events) WHERE n IS NOT NULL GROUP BY n")
def value_share_distribution(spark, sf_dir):
    """One key out of each feature map, and the share of each of its values."""
    n = t(spark, sf_dir, "events").select(F.from_json("props", "k int")["k"].alias("n")).where("n is not null").groupBy("n").agg(F.count("*").alias("c"))
    return n.select("n", F.round(F.col("c") / F.sum("c").over(Window.partitionBy(F.lit(0))), 9).alias("share"))  # a row for each value


@register("pairwise_folds", "SELECT a.lang AS test, b.lang AS train, a.n AS test_rows, b.n AS train_rows FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1) a, (SELECT lang, count(*) AS n FROM documents GROUP BY 1) b WHERE a.lang <> b.lang")
def pairwise_folds(spark, sf_dir):
    """Each group tested on a model of each other group."""
    n = t(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))  # a row for each group
    a, b = (n.select(F.col("lang").alias(x), F.col("n").alias(f"{x}_rows")) for x in ("test", "train"))
    return a.join(F.broadcast(b), F.col("test") != F.col("train")).select("test", "train", "test_rows", "train_rows")


_WIDE = """WITH m AS (SELECT l_orderkey || '-' || l_linenumber AS benchmark, (2 ** (l_orderkey % 12))::BIGINT AS dataset, l_quantity AS comp, l_linenumber::DOUBLE AS rational, l_suppkey % 40 AS mem, l_partkey % 7 AS localmem, l_suppkey % 5 AS coalesced, l_orderkey % 3 AS atomic,
  l_extendedprice AS transfer, (2 ** (l_linenumber % 8))::BIGINT AS wgsize, o_totalprice AS cpu, l_extendedprice AS gpu, length(p_name) AS kernel_nlines, p_size AS kernel_size FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_totalprice > 0 AND l_extendedprice > 0),
w AS (SELECT benchmark, dataset, comp, rational, mem, localmem, coalesced, atomic, transfer, wgsize, CASE WHEN comp + mem > 0 THEN transfer / (comp + mem) ELSE 0 END AS f1, CASE WHEN mem > 0 THEN coalesced / mem::DOUBLE ELSE 0 END AS f2,
  CASE WHEN mem > 0 THEN localmem / mem::DOUBLE * wgsize ELSE 0 END AS f3, CASE WHEN mem > 0 THEN comp / mem::DOUBLE ELSE 0 END AS f4, CASE WHEN cpu > gpu THEN 'GPU' ELSE 'CPU' END AS oracle, least(cpu, gpu) AS runtime, greatest(cpu / gpu, gpu / cpu) AS speedup,
  least(cpu / gpu, gpu / cpu) AS penalty, cpu AS runtime_cpu, 0.0::DOUBLE AS ci_cpu, cpu AS ci_mean_cpu, gpu AS runtime_gpu, 0.0::DOUBLE AS ci_gpu, gpu AS ci_mean_gpu, kernel_nlines, kernel_size FROM m)
"""


def _wide_rows(spark, sf_dir) -> DataFrame:
    """The 26 columns of a measurement row, from order lines: features, label, run times (order and line prices)."""
    rows = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).where("o_totalprice > 0 and l_extendedprice > 0")
    c, zero = F.col, F.lit(0.0)
    m = rows.select(F.concat_ws("-", c("l_orderkey").cast("string"), c("l_linenumber").cast("string")).alias("benchmark"), F.pow(F.lit(2), c("l_orderkey") % 12).cast("long").alias("dataset"), c("l_quantity").alias("comp"), c("l_linenumber").cast("double").alias("rational"), (c("l_suppkey") % 40).alias("mem"), (c("l_partkey") % 7).alias("localmem"), (c("l_suppkey") % 5).alias("coalesced"), (c("l_orderkey") % 3).alias("atomic"), c("l_extendedprice").alias("transfer"), F.pow(F.lit(2), c("l_linenumber") % 8).cast("long").alias("wgsize"), c("o_totalprice").alias("cpu"), c("l_extendedprice").alias("gpu"), F.length("p_name").cast("long").alias("kernel_nlines"), c("p_size").alias("kernel_size"))
    by_mem = lambda x: F.when(c("mem") > 0, x / c("mem")).otherwise(0.0)
    cpu, gpu = c("cpu"), c("gpu")
    return m.select("benchmark", "dataset", "comp", "rational", "mem", "localmem", "coalesced", "atomic", "transfer", "wgsize", F.when(c("comp") + c("mem") > 0, c("transfer") / (c("comp") + c("mem"))).otherwise(0.0).alias("f1"), by_mem(c("coalesced")).alias("f2"), F.when(c("mem") > 0, c("localmem") / c("mem") * c("wgsize")).otherwise(0.0).alias("f3"), by_mem(c("comp")).alias("f4"), F.when(cpu > gpu, "GPU").otherwise("CPU").alias("oracle"), F.least(cpu, gpu).alias("runtime"), F.greatest(cpu / gpu, gpu / cpu).alias("speedup"), F.least(cpu / gpu, gpu / cpu).alias("penalty"), cpu.alias("runtime_cpu"), zero.alias("ci_cpu"), cpu.alias("ci_mean_cpu"), gpu.alias("runtime_gpu"), zero.alias("ci_gpu"), gpu.alias("ci_mean_gpu"), "kernel_nlines", "kernel_size")


@register("whole_measurement_row", _WIDE + "SELECT * FROM w")
def whole_measurement_row(spark, sf_dir):
    return _wide_rows(spark, sf_dir)


@register("measurement_csv", _WIDE + "SELECT benchmark, concat_ws(',', benchmark, dataset, mem, localmem, coalesced, atomic, wgsize, oracle, kernel_nlines, kernel_size) AS line FROM w")
def measurement_csv(spark, sf_dir):
    """CSV lines of the measurement rows' labels and whole numbers."""
    names = ["benchmark", "dataset", "mem", "localmem", "coalesced", "atomic", "wgsize", "oracle", "kernel_nlines", "kernel_size"]
    return _wide_rows(spark, sf_dir).select("benchmark", F.to_csv(F.struct(*names)).alias("line"))


#: Columns of a measurement row, in this order; those that are no whole numbers or words.
_COLUMNS = ("benchmark dataset comp rational mem localmem coalesced atomic transfer wgsize f1 f2 f3 f4 oracle runtime speedup penalty "
            "runtime_cpu ci_cpu ci_mean_cpu runtime_gpu ci_gpu ci_mean_gpu kernel_nlines kernel_size").split()
_REAL = set("comp rational transfer f1 f2 f3 f4 runtime speedup penalty runtime_cpu ci_cpu ci_mean_cpu runtime_gpu ci_gpu ci_mean_gpu".split())


@register("whole_measurement_csv", _WIDE + f"""SELECT benchmark, concat_ws(',', {", ".join(f"round({c}, 6)::DECIMAL(30, 6)::VARCHAR" if c in _REAL else f"{c}::VARCHAR" for c in _COLUMNS)}) AS line FROM w""")
def whole_measurement_csv(spark, sf_dir):
    """CSV lines of all columns of the measurement rows, with six decimals."""
    rounded = lambda c: (F.round(F.col(c) * 1e6) / 1e6).cast("decimal(30,6)").alias(c)  # noqa: E731  (halves of the product, not of the decimals that are shown)
    columns = [rounded(c) if c in _REAL else F.col(c) for c in _COLUMNS]
    return _wide_rows(spark, sf_dir).select("benchmark", F.to_csv(F.struct(*columns)).alias("line"))


#: The sets of feature columns that models are trained on.
FEATURE_SETS = {
    "ratios": ("f1", "f2", "f3", "f4"),
    "raw": ("comp", "rational", "mem", "localmem", "coalesced", "atomic", "transfer", "wgsize"),
    "static": ("comp", "mem", "localmem", "coalesced"),
    "extended": ("comp", "rational", "mem", "localmem", "coalesced"),
}


@register("feature_sets", _WIDE + " UNION ALL ".join(f"SELECT benchmark, '{k}' AS subset, " + ", ".join(f"{v[i]}::DOUBLE AS x{i + 1}" if i < len(v) else f"NULL::DOUBLE AS x{i + 1}" for i in range(8)) + " FROM w" for k, v in FEATURE_SETS.items()))
def feature_sets(spark, sf_dir):
    """Every set of feature columns of every measurement row, as an array, shown by its places."""
    sets = F.array(*[F.struct(F.lit(k).alias("subset"), F.array(*[F.col(c).cast("double") for c in v]).alias("x")) for k, v in FEATURE_SETS.items()])
    rows = _wide_rows(spark, sf_dir).select("benchmark", F.inline(sets))
    return rows.select("benchmark", "subset", *[F.get("x", F.lit(i)).alias(f"x{i + 1}") for i in range(8)])


@register("nested_counters", "SELECT user_id, coalesce(sum(1) FILTER (WHERE event_type = 'click'), 0)::BIGINT AS click, coalesce(sum(1) FILTER (WHERE event_type = 'view'), 0)::BIGINT AS view, count(*) AS total FROM events GROUP BY user_id")
def nested_counters(spark, sf_dir):
    """Counters of each kind inside each user, a column for each kind."""
    e = t(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(*[F.count(F.when(F.col("event_type") == k, 1)).alias(k) for k in ("click", "view")], F.count("*").alias("total"))


# text stages on whole documents


def _stage(spark, sf_dir, prepared: Column, stage) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", stage(prepared).alias("r")).select("doc_id", _sha(F.col("r")[0]["text"]).alias("sha"))


@register("statement_check", "SELECT doc_id, contains(text, ';') AS ok FROM documents")
def statement_check(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", tx.has_statement(F.col("text"))[0]["ok"].alias("ok"))


@register("includes_dropped", "SELECT doc_id, sha256(array_to_string(list_filter(string_split('#include <a.h>' || chr(10) || text || chr(10) || ' # include x', chr(10)), lambda l: NOT contains(l, '#include ') AND NOT contains(l, '# include ')), chr(10))) AS sha FROM documents")
def includes_dropped(spark, sf_dir):
    return _stage(spark, sf_dir, F.concat(F.lit("#include <a.h>\n"), "text", F.lit("\n # include x")), tx.drop_includes)


def _nested(column: str) -> str:
    for word in tx.UNDERSCORED:
        column = f"replace({column}, '{word}', '{word[2:]}')"
    return column


_SPELLED = "replace(replace(replace(text, 'a ', '__const '), 'e ', '__global '), 'n ', '__read_only ')"


@register("keywords_plain", f"SELECT doc_id, sha256({_nested(_SPELLED)}) AS sha FROM documents")
def keywords_plain(spark, sf_dir):
    spelled = F.col("text")
    for old, new in (("a ", "__const "), ("e ", "__global "), ("n ", "__read_only ")):
        spelled = F.replace(spelled, F.lit(old), F.lit(new))
    return _stage(spark, sf_dir, spelled, tx.plain_keywords)


@register("kernel_void_order", "SELECT doc_id, sha256(replace(replace(text, '. ', ' void kernel '), 'void kernel ', 'kernel void ')) AS sha FROM documents")
def kernel_void_order(spark, sf_dir):
    return _stage(spark, sf_dir, F.replace("text", F.lit(". "), F.lit(" void kernel ")), tx.kernel_void)


@register("typedefs_blanked", """
SELECT doc_id, sha256(array_to_string(list_transform(string_split(replace(text, '. ', chr(10) || 'typedef '), chr(10)), lambda l: CASE WHEN contains(l, 'typedef ') AND NOT (contains(l, 'typedef struct') OR contains(l, 'typedef enum') OR contains(l, 'typedef union')) THEN '' ELSE l END), chr(10))) AS sha FROM documents""")
def typedefs_blanked(spark, sf_dir):
    return _stage(spark, sf_dir, F.replace("text", F.lit(". "), F.lit("\ntypedef ")), tx.blank_typedefs)


@register("prototype_line", r"SELECT doc_id, sha256('kernel void a(int x, int y) {' || text) AS sha FROM documents")
def prototype_line(spark, sf_dir):
    return _stage(spark, sf_dir, F.concat(F.lit(" kernel\tvoid\n a(int x,\n\n int y)  {"), "text"), tx.prototype_on_one_line)


@register("finite_scores", _C + "SELECT doc_id, CASE WHEN isfinite(score_delta) THEN round(score_delta, 6) ELSE 0 END AS score FROM c")
def finite_scores(spark, sf_dir):
    return candidates(spark, sf_dir).select("doc_id", F.round(fx.finite_or_zero(F.col("score_delta")), 6).alias("score"))


# search


@register("feed_queue", """
WITH s AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), d AS (SELECT t.vec_id AS target, s.vec_id AS node, round(sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2), 9) AS score FROM s JOIN s t ON t.vec_id % 20 = 0)
SELECT target, node, score FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score, node) AS r FROM d) WHERE r <= 4""")
def feed_queue(spark, sf_dir):
    """Cached samples scored anew for each target (every twentieth vector), the first four of them."""
    e = F.col("embedding")
    s = t(spark, sf_dir, "embeddings").select("vec_id", F.get(e, F.lit(0)).cast("double").alias("x"), F.get(e, F.lit(1)).cast("double").alias("y"))
    s = s.select("vec_id", F.array("x", "y").alias("features"))
    targets = s.where("vec_id % 20 = 0").select(F.col("vec_id").alias("target_id"), F.col("features").alias("target"))
    far = nearest.nearest(targets, s, 4, "euclid", digits=9)
    return search.feed_queue(far.select(F.col("target_id").alias("target"), F.col("vec_id").alias("node"), F.round("dist", 9).alias("score")), targets.select(F.col("target_id").alias("target")), 4).select("target", "node", "score")


@register("whole_feed_queue", """
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), d AS (SELECT t.vec_id AS target, s.vec_id AS node, round(list_distance(s.e, t.e), 5) AS score FROM s JOIN s t ON t.vec_id % 20 = 0)
SELECT target, node, score FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score, node) AS r FROM d) WHERE r <= 4""")
def whole_feed_queue(spark, sf_dir):
    """feed_queue by all components of the vectors."""
    s = t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    targets = s.where("vec_id % 20 = 0").select(F.col("vec_id").alias("target_id"), F.col("features").alias("target"))
    far = nearest.nearest(targets, s, 4, "euclid", digits=5)
    return search.feed_queue(far.select(F.col("target_id").alias("target"), F.col("vec_id").alias("node"), F.round("dist", 5).alias("score")), targets.select(F.col("target_id").alias("target")), 4).select("target", "node", "score")


@register("whole_include_closure", """
WITH RECURSIVE e AS (SELECT page_id AS a, page_id // 2 AS b FROM pages UNION SELECT page_id, page_id // 3 FROM pages UNION SELECT 0, 1), c(root, node) AS (SELECT a, b FROM e UNION SELECT c.root, e.b FROM c JOIN e ON c.node = e.a)
SELECT root, count(*) AS reached FROM c GROUP BY root""")
def whole_include_closure(spark, sf_dir):
    """All pages that each page includes (page i its halves and thirds; 0 and 1 each other), from every root."""
    from corpusloom.sources.shared import saver

    p = t(spark, sf_dir, "pages").select(F.col("page_id").alias("a"))
    edges = p.select("a", F.explode(F.array(F.floor(F.col("a") / 2), F.floor(F.col("a") / 3))).alias("b")).unionByName(spark.createDataFrame([(0, 1)], "a long, b long"))
    return search.closure(edges, p.select(F.col("a").alias("root")), saver(spark, "closure")).groupBy("root").agg(F.count("*").alias("reached"))


@register("mutation_beam")
def mutation_beam(spark, sf_dir):
    """A beam of width 3 over mutants for every twentieth document (node i leads to 3 i + 1, 2 and 5), while it gets better."""
    from corpusloom.sources.shared import saver

    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"))
    n = d.count()
    feeds = d.where("node % 20 = 0").select(F.col("node").alias("target"), "node", F.lit(1000).cast("long").alias("score"))

    def mutate(beam: DataFrame) -> DataFrame:
        child = beam.select("target", F.explode(F.array(*[(F.col("node") * 3 + k) % n for k in (1, 2, 5)])).alias("node"))
        return child.withColumn("score", (F.col("node") * 31 + F.col("target") * 7) % 97)

    return search.mutation_beam(feeds, mutate, 3, 8, saver(spark, "mutants"))
