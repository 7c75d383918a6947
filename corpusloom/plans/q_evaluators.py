"""Evaluators composed of the operators, and the rest of the sampling and summary operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import codecs, features
from corpusloom.functions import tokens as tk
from corpusloom.operators import nearest, ranking
from corpusloom.plans.catalog import register
from corpusloom.plans.q_features import _PAIRS, growing, targets_and_samples, vectors
from corpusloom.plans.q_relational import t


@register("token_size_distribution", """
WITH n AS (SELECT source, len(string_split(text, ' '))::BIGINT AS tokens FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
SELECT source, tokens, n, round(n / sum(n) OVER (PARTITION BY source), 6) AS share FROM (SELECT source, tokens, count(*) AS n FROM n GROUP BY source, tokens)""")
def token_size_distribution(spark, sf_dir):
    """Shares of token counts among the good rows of each group."""
    d = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id")
    n = d.groupBy("source", F.size(F.split("text", " ")).cast("long").alias("tokens")).agg(F.count("*").alias("n"))
    return n.select("source", "tokens", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6).alias("share"))


@register("top_k_that_ran", _PAIRS + """, ran AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY dist, vec_id) AS r FROM pairs WHERE vec_id % 3 <> 0)
SELECT target_id, vec_id, round(dist, 6) AS dist FROM ran WHERE r <= 3""")
def top_k_that_ran(spark, sf_dir, split=targets_and_samples):
    """The three nearest samples that run (ids not divisible by 3), nearest first."""
    targets, samples = split(spark, sf_dir)
    return ranking.top_k(nearest.nearest(targets, samples.where("vec_id % 3 <> 0"), 3), ["target_id"], ["dist", "vec_id"], 3).select("target_id", "vec_id", F.round("dist", 6).alias("dist"))


@register("beam_report", _PAIRS + """, b AS (SELECT target_id, vec_id % 8 AS generation, arg_min(vec_id, (dist, vec_id)) AS vec_id, min(dist) AS dist FROM pairs GROUP BY 1, 2)
SELECT target_id, arg_min(generation, (dist, generation)) AS generation, arg_min(vec_id, (dist, generation)) AS vec_id, round(min(dist), 6) AS dist FROM b GROUP BY target_id""")
def beam_report(spark, sf_dir, split=targets_and_samples):
    """For each target the generation and sample that came nearest."""
    targets, samples = split(spark, sf_dir)
    d = nearest.nearest(targets, samples, 1, key=F.col("vec_id") % 8).withColumnRenamed("key", "generation")
    best = d.groupBy("target_id", "generation").agg(F.min(F.struct("dist", "vec_id")).alias("m")).select("target_id", F.struct(F.col("m.dist"), "generation", F.col("m.vec_id")).alias("g"))
    return best.groupBy("target_id").agg(F.min("g").alias("g")).select("target_id", "g.generation", "g.vec_id", F.round("g.dist", 6).alias("dist"))


@register("mutation_gain", _PAIRS + """, o AS (SELECT target_id, min(dist) AS d FROM pairs WHERE vec_id < 100 GROUP BY 1), m AS (SELECT target_id, min(dist) AS d FROM pairs WHERE vec_id >= 100 GROUP BY 1)
SELECT target_id, round(o.d, 6) AS before, round(m.d, 6) AS after FROM o JOIN m USING (target_id) WHERE m.d < o.d""")
def mutation_gain(spark, sf_dir, split=targets_and_samples):
    """Targets that the second set of samples comes nearer to than the first."""
    targets, samples = split(spark, sf_dir)
    d = nearest.nearest(targets, samples, 1, key=F.col("vec_id") < 100)
    best = d.groupBy("target_id").agg(F.min(F.when(F.col("vec_id") < 100, F.col("dist"))).alias("o"), F.min(F.when(F.col("vec_id") >= 100, F.col("dist"))).alias("m"))
    return best.where("m < o").select("target_id", F.round("o", 6).alias("before"), F.round("m", 6).alias("after"))


for _name, _query in (("top_k_that_ran", top_k_that_ran), ("beam_report", beam_report), ("mutation_gain", mutation_gain)):
    growing(_name, _query)


@register("group_coverage", """
WITH v AS (SELECT label, round(embedding[1]::DOUBLE, 1) + 0.0::DOUBLE AS a, round(embedding[2]::DOUBLE, 1) + 0.0::DOUBLE AS b FROM embeddings), u AS (SELECT DISTINCT label, a, b FROM v)
SELECT label, count(*) AS cells, round(count(*) / (SELECT count(*) FROM (SELECT DISTINCT a, b FROM v)), 6) AS coverage FROM u GROUP BY label""")
def group_coverage(spark, sf_dir):
    """Share of all cells of the feature space that a group covers."""
    cell = lambda k: F.round(F.get("features", F.lit(k)), 1) + 0.0
    v = vectors(spark, sf_dir).select("label", cell(0).alias("a"), cell(1).alias("b")).distinct()
    total = v.select("a", "b").distinct().agg(F.count("*").alias("total"))
    n = v.groupBy("label").agg(F.count("*").alias("cells"))
    return n.crossJoin(F.broadcast(total)).select("label", "cells", F.round(F.col("cells") / F.col("total"), 6).alias("coverage"))


@register("whole_group_coverage", """
WITH v AS (SELECT DISTINCT label, list_transform(embedding, lambda x: round(x::DOUBLE, 1) + 0.0::DOUBLE) AS f FROM embeddings)
SELECT label, count(*) AS cells, round(count(*) / (SELECT count(*) FROM (SELECT DISTINCT f FROM v)), 6) AS coverage FROM v GROUP BY label""")
def whole_group_coverage(spark, sf_dir):
    """group_coverage with cells of all components."""
    f = F.transform("features", lambda x: F.round(x, 1) + 0.0)
    v = vectors(spark, sf_dir).select("label", f.alias("f")).distinct()
    total = v.select("f").distinct().agg(F.count("*").alias("total"))
    n = v.groupBy("label").agg(F.count("*").alias("cells"))
    return n.crossJoin(F.broadcast(total)).select("label", "cells", F.round(F.col("cells") / F.col("total"), 6).alias("coverage"))


@register("study_by_attempts", """
WITH u AS (SELECT user_id, count(*) AS attempts, avg((coalesce(value, 0) > 20)::INT) AS acc FROM events GROUP BY 1)
SELECT s.m AS min_attempts, count(*) AS users, round(avg(acc), 6) AS accuracy, round(coalesce(stddev_pop(acc), 0), 6) AS spread FROM u JOIN (VALUES (1), (50), (100), (150)) s(m) ON attempts >= s.m GROUP BY 1""")
def study_by_attempts(spark, sf_dir):
    """Users' accuracy for each least number of attempts."""
    u = t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("attempts"), F.avg((F.coalesce("value", F.lit(0.0)) > 20).cast("int")).alias("acc"))
    steps = F.filter(F.array(*[F.lit(m) for m in (1, 50, 100, 150)]), lambda m: m <= F.col("attempts"))
    return u.select("acc", F.explode(steps).alias("min_attempts")).groupBy("min_attempts").agg(F.count("*").alias("users"), F.round(F.avg("acc"), 6).alias("accuracy"), F.round(F.stddev_pop("acc"), 6).alias("spread"))


@register("session_summary", """
SELECT count(*) AS samples, round(avg((quality = 1)::INT), 6) AS compile_rate, round(avg(n_chars) FILTER (WHERE quality = 1), 6) AS mean_chars FROM documents JOIN labels USING (doc_id)""")
def session_summary(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "n_chars").join(t(spark, sf_dir, "labels"), "doc_id")
    good = F.col("quality") == 1
    return d.agg(F.count("*").alias("samples"), F.round(F.avg(good.cast("int")), 6).alias("compile_rate"), F.round(F.avg(F.when(good, F.col("n_chars"))), 6).alias("mean_chars"))


@register("labelled_study_set", """
SELECT sha256(text) AS sha, min(doc_id) AS doc_id, CASE WHEN count(DISTINCT lang) > 1 THEN 'both' ELSE min(lang) END AS label FROM documents WHERE n_chars < 2000 GROUP BY 1""")
def labelled_study_set(spark, sf_dir):
    """Texts to show in a study, each once, with the group it comes from."""
    d = t(spark, sf_dir, "documents").where("n_chars < 2000").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return d.agg(F.min("doc_id").alias("doc_id"), F.when(F.min("lang") != F.max("lang"), "both").otherwise(F.min("lang")).alias("label"))


@register("whole_study_set", """
SELECT sha256(text) AS sha, min(doc_id) AS doc_id, CASE WHEN count(DISTINCT lang) > 1 THEN 'both' ELSE min(lang) END AS label FROM documents GROUP BY 1""")
def whole_study_set(spark, sf_dir):
    """Texts of every length for a study, each once, with the group it comes from."""
    d = t(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return d.agg(F.min("doc_id").alias("doc_id"), F.when(F.min("lang") != F.max("lang"), "both").otherwise(F.min("lang")).alias("label"))


@register("token_positions", """
WITH w AS (SELECT doc_id, string_split(source || ' ' || lang, ' ') AS a FROM documents)
SELECT doc_id, i - 1 AS token, CASE WHEN i = 1 THEN 0 ELSE length(a[1]) + 1 END AS first_char, a[i] AS word FROM w CROSS JOIN range(1, 3) r(i)""")
def token_positions(spark, sf_dir):
    """Token index and the character it starts at."""
    w = t(spark, sf_dir, "documents").select("doc_id", F.split(F.concat_ws(" ", "source", "lang"), " ").alias("a"))
    p = w.select("doc_id", "a", F.posexplode("a").alias("token", "word"))
    before = F.aggregate(F.slice("a", 1, F.col("token")), F.lit(0).cast("long"), lambda n, x: n + F.length(x) + 1)
    return p.select("doc_id", F.col("token").cast("long").alias("token"), before.alias("first_char"), "word")


@register("decoded_ids", "SELECT doc_id, source || '/' || lang AS text FROM documents")
def decoded_ids(spark, sf_dir):
    """Characters to ids and back; a pad id is left out."""
    names = F.array(*[F.lit(chr(c)) for c in range(128)])
    ids = F.transform(F.filter(F.split(F.concat_ws("/", "source", "lang"), ""), lambda c: c != ""), lambda c: F.ascii(c))
    return t(spark, sf_dir, "documents").select("doc_id", tk.decoded(F.concat(ids, F.array(F.lit(0))), names, F.array(F.lit(0))).alias("text"))


@register("encoded_feature_map", """
SELECT event_id, array_to_string([least(user_id, 99), coalesce(floor(value), 0)::BIGINT, 0, 0], ',') AS ids FROM events""")
def encoded_feature_map(spark, sf_dir):
    """A feature map as ids in key order, padded to four."""
    m = F.create_map(F.lit("b_value"), F.coalesce(F.floor("value"), F.lit(0)), F.lit("a_user"), F.least(F.col("user_id"), F.lit(99)))
    ids = F.transform(F.array_sort(F.map_keys(m)), lambda k: m[k])
    return t(spark, sf_dir, "events").select("event_id", codecs.joined(tk.padded(ids, 4, 0), ",").alias("ids"))


@register("zipped_folds", """
WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents WHERE lang = 'en'), m AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents WHERE lang = 'de')
SELECT n.r AS place, n.doc_id AS a, m.doc_id AS b FROM n JOIN m USING (r)""")
def zipped_folds(spark, sf_dir):
    """Two tables joined by place."""
    d = t(spark, sf_dir, "documents")
    n, m = (ranking.numbered_rows(d.where(F.col("lang") == lang).select(F.col("doc_id").alias(c)), [F.col(c)], "place") for lang, c in (("en", "a"), ("de", "b")))
    return n.join(m, "place").select("place", "a", "b")


@register("position_histogram", "SELECT 2 * round_even(100 * (doc_id % 97) / 97 / 2, 0)::BIGINT AS percent, count(*) AS n FROM documents GROUP BY 1")
def position_histogram(spark, sf_dir):
    """Positions as even percents, rounded half to even."""
    return t(spark, sf_dir, "documents").groupBy((2 * F.bround(100 * (F.col("doc_id") % 97) / 97 / 2, 0).cast("long")).alias("percent")).agg(F.count("*").alias("n"))


@register("random_points")
def random_points(spark, sf_dir):
    """A seeded point of a bounded feature space for every document, by its id; distinct ones."""
    r = lambda m, seed: F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(m)).alias
    return t(spark, sf_dir, "documents").select(r(50, 1)("comp"), r(20, 2)("mem"), r(8, 3)("localmem")).distinct()


@register("device_classifier")
def device_classifier(spark, sf_dir):
    """Held-out accuracy of a decision tree (entropy) on ratio features, label: the faster device."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    rows = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = F.array(F.col("l_quantity"), features.ratio(F.col("l_discount"), F.col("l_tax")), F.col("l_extendedprice"))
    data = rows.select("l_orderkey", array_to_vector(x).alias("features"), (F.col("l_extendedprice") < F.col("o_totalprice") / 4).cast("double").alias("label"))
    model = DecisionTreeClassifier(impurity="entropy", maxDepth=5, seed=1).fit(data.where("l_orderkey % 5 <> 0"))
    return model.transform(data.where("l_orderkey % 5 = 0")).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("int")), 6).alias("accuracy"))
