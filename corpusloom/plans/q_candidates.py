"""Analyses of search candidates and the generational search itself.

Candidates are derived from documents: generation, hole length, token and score deltas follow from
the id and the length of a text (the same expressions stand in the SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.plans.catalog import register
from corpusloom.plans.q_relational import t

_C = """WITH c AS (SELECT doc_id, sha256(text) AS sha, doc_id % 6 AS gen, 1 + doc_id % 3 AS freq, (doc_id * 5) % 11 - 5 AS token_delta, doc_id % 9 AS hole, 10 + n_chars % 50 AS length, doc_id % 4 <> 0 AS compiles,
  1 + doc_id % 17 AS in_score, CASE WHEN doc_id % 23 = 0 THEN 'inf'::DOUBLE ELSE ((doc_id * 7) % 19 - (1 + doc_id % 17)) / (1 + doc_id % 17)::DOUBLE END AS score_delta FROM documents)
"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = t(spark, sf_dir, "documents"), F.col("doc_id")
    in_score = 1 + i % 17
    delta = F.when(i % 23 == 0, F.lit(float("inf"))).otherwise(((i * 7) % 19 - in_score) / in_score.cast("double"))
    return d.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), (i % 6).alias("gen"), (1 + i % 3).alias("freq"), ((i * 5) % 11 - 5).alias("token_delta"), (i % 9).alias("hole"), (10 + F.col("n_chars") % 50).alias("length"), (i % 4 != 0).alias("compiles"), in_score.alias("in_score"), delta.alias("score_delta"))


def _percent(df: DataFrame, keys: list, within: list[str] | None = None) -> DataFrame:
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(w), 6))


@register("candidate_frequencies", _C + "SELECT gen, f, count(*) AS n FROM (SELECT gen, sha, sum(freq)::BIGINT AS f FROM c GROUP BY ALL) GROUP BY ALL")
def candidate_frequencies(spark, sf_dir):
    """How many candidates of a generation stand how often."""
    f = candidates(spark, sf_dir).groupBy("gen", "sha").agg(F.sum("freq").alias("f"))
    return f.groupBy("gen", "f").agg(F.count("*").alias("n"))


@register("ratio_histogram", _C + "SELECT floor(100 * hole / (hole + length))::BIGINT AS percent, count(*) AS n FROM c GROUP BY 1")
def ratio_histogram(spark, sf_dir):
    return candidates(spark, sf_dir).groupBy(F.floor(100 * F.col("hole") / (F.col("hole") + F.col("length"))).alias("percent")).agg(F.count("*").alias("n"))


@register("delta_quantiles", _C + "SELECT gen, min(token_delta) AS least, max(token_delta) AS most, round(avg(token_delta), 6) AS mean, round(avg(token_delta) FILTER (WHERE compiles), 6) AS mean_compiling FROM c GROUP BY gen")
def delta_quantiles(spark, sf_dir):
    d = F.col("token_delta")
    return candidates(spark, sf_dir).groupBy("gen").agg(F.min(d).alias("least"), F.max(d).alias("most"), F.round(F.avg(d), 6).alias("mean"), F.round(F.avg(F.when(F.col("compiles"), d)), 6).alias("mean_compiling"))


@register("sign_contingency", _C + "SELECT sign(token_delta)::INT AS tokens, sign(score_delta)::INT AS score, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM c WHERE score_delta < 'inf'::DOUBLE GROUP BY 1, 2")
def sign_contingency(spark, sf_dir):
    c = candidates(spark, sf_dir).where(F.col("score_delta") < float("inf"))
    return _percent(c, [F.signum("token_delta").cast("int").alias("tokens"), F.signum("score_delta").cast("int").alias("score")])


@register("compile_contingency", _C + "SELECT compiles, sign(token_delta)::INT AS tokens, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM c GROUP BY 1, 2")
def compile_contingency(spark, sf_dir):
    return _percent(candidates(spark, sf_dir), ["compiles", F.signum("token_delta").cast("int").alias("tokens")])


@register("score_direction_by_hole", _C + "SELECT hole, sign(score_delta)::INT AS score, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY hole), 6) AS percent FROM c WHERE score_delta < 'inf'::DOUBLE GROUP BY 1, 2")
def score_direction_by_hole(spark, sf_dir):
    c = candidates(spark, sf_dir).where(F.col("score_delta") < float("inf"))
    return _percent(c, ["hole", F.signum("score_delta").cast("int").alias("score")], ["hole"])


@register("score_direction_by_relative_hole", _C + "SELECT floor(10 * hole / (hole + length))::BIGINT AS bucket, sign(score_delta)::INT AS score, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY sign(score_delta)::INT), 6) AS percent FROM c WHERE score_delta < 'inf'::DOUBLE GROUP BY 1, 2")
def score_direction_by_relative_hole(spark, sf_dir):
    """Within each direction, the shares of relative hole lengths."""
    c = candidates(spark, sf_dir).where(F.col("score_delta") < float("inf"))
    return _percent(c, [F.floor(10 * F.col("hole") / (F.col("hole") + F.col("length"))).alias("bucket"), F.signum("score_delta").cast("int").alias("score")], ["score"])


@register("compile_counts_by_ratio", _C + "SELECT round_even(hole / (hole + length), 1) AS ratio, compiles, count(*) AS n FROM c GROUP BY 1, 2")
def compile_counts_by_ratio(spark, sf_dir):
    """Ratios rounded half to even."""
    return candidates(spark, sf_dir).groupBy(F.bround(F.col("hole") / (F.col("hole") + F.col("length")), 1).alias("ratio"), "compiles").agg(F.count("*").alias("n"))


@register("compile_percent_by_length", _C + "SELECT length, compiles, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY length), 6) AS percent FROM c GROUP BY 1, 2")
def compile_percent_by_length(spark, sf_dir):
    return _percent(candidates(spark, sf_dir), ["length", "compiles"], ["length"])


def beam_search(feeds: DataFrame, children: DataFrame, width: int, depth: int, save, score=None) -> DataFrame:
    """Generations of a search: (target, generation, node, score) of every kept candidate.

    feeds: (target, node, score); children: (target, node, child, child_score), or (node, child) with a function ``score`` of
    child and target, so that nothing is made for a pair that the search doesn't come to. Each
    generation expands what was kept, drops nodes seen before, keeps the best ``width`` for each
    target, and stops for a target at score 0. ``save`` writes a generation and reads it again, so
    lineage stays short and a lost executor costs one generation."""
    kept = save(feeds.withColumn("generation", F.lit(0)))
    found = kept
    for generation in range(1, depth + 1):
        solved = found.where("score = 0").select("target").distinct()
        open_ = kept.join(solved, "target", "left_anti")
        led = open_.select("target", "node").join(children, ["target", "node"] if score is None else ["node"])
        own = F.col("child_score") if score is None else score(F.col("child"), F.col("target"))
        fresh = led.select("target", F.col("child").alias("node"), own.alias("score")).distinct()
        fresh = fresh.join(found.select("target", "node"), ["target", "node"], "left_anti")
        w = Window.partitionBy("target").orderBy("score", "node")
        kept = save(fresh.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= width).drop("_r").withColumn("generation", F.lit(generation)))
        if kept.isEmpty():
            break
        found = found.unionByName(kept)
    return found


_BEAM = """WITH RECURSIVE n AS (SELECT doc_id AS node, n_chars FROM documents), g0 AS (SELECT tt.target, tt.target AS node, 1000::BIGINT AS score FROM (SELECT doc_id AS target FROM documents WHERE doc_id < 5) tt),
e AS (SELECT node, x.k, (node * 3 + x.k) % (SELECT count(*) FROM documents) AS child FROM n CROSS JOIN (VALUES (1), (2), (5)) x(k)),
g1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score, node) AS r FROM (SELECT DISTINCT g.target, e.child AS node, (e.child * 31 + g.target * 7) % 97 AS score FROM g0 g JOIN e USING (node) WHERE (g.target, e.child) NOT IN (SELECT (target, node) FROM g0))) WHERE r <= 2),
o1 AS (SELECT * FROM g1 WHERE target NOT IN (SELECT target FROM g1 WHERE score = 0)),
g2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score, node) AS r FROM (SELECT DISTINCT g.target, e.child AS node, (e.child * 31 + g.target * 7) % 97 AS score FROM o1 g JOIN e USING (node) WHERE (g.target, e.child) NOT IN (SELECT (target, node) FROM g0 UNION ALL SELECT (target, node) FROM g1))) WHERE r <= 2)
SELECT target, node, score, 0 AS generation FROM g0 UNION ALL SELECT target, node, score, 1 FROM g1 UNION ALL SELECT target, node, score, 2 FROM g2"""


@register("beam_search", _BEAM)
def beam(spark, sf_dir):
    """Two generations of width 2 over a fixed candidate table (node i leads to 3 i + 1, 2 and 5)."""
    from corpusloom.sources.shared import saver

    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"))
    n = d.count()
    targets = spark.range(5).withColumnRenamed("id", "target")
    edges = d.select("node", F.explode(F.array(*[F.lit(k) for k in (1, 2, 5)])).alias("k")).withColumn("child", (F.col("node") * 3 + F.col("k")) % n)
    children = edges.crossJoin(F.broadcast(targets)).select("target", "node", "child", ((F.col("child") * 31 + F.col("target") * 7) % 97).alias("child_score"))
    feeds = targets.select("target", F.col("target").alias("node"), F.lit(1000).cast("long").alias("score"))
    return beam_search(feeds, children, 2, 2, saver(spark, "beam")).select("target", "node", "score", "generation")


@register("whole_beam_search", _BEAM.replace("WHERE doc_id < 5", "WHERE doc_id % 20 = 0"))
def whole_beam(spark, sf_dir):
    """beam_search with every twentieth document as a target."""
    from corpusloom.sources.shared import saver

    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"))
    edges = d.select("node", F.explode(F.array(*[F.lit(k) for k in (1, 2, 5)])).alias("k")).withColumn("child", (F.col("node") * 3 + F.col("k")) % d.count())
    feeds = d.where("node % 20 = 0").select(F.col("node").alias("target"), "node", F.lit(1000).cast("long").alias("score"))
    return beam_search(feeds, edges.select("node", "child"), 2, 2, saver(spark, "beam"), lambda child, target: (child * 31 + target * 7) % 97).select("target", "node", "score", "generation")


@register("measurement_sweep", """
WITH g AS (SELECT p_partkey, (2 ** i)::BIGINT AS gsize FROM part CROSS JOIN range(1, 21) r(i))
SELECT p_partkey, arg_min(gsize, (abs(gsize * p_size - 100000), gsize)) AS gsize FROM g JOIN part USING (p_partkey) GROUP BY p_partkey""")
def measurement_sweep(spark, sf_dir):
    """Of global sizes 2, 4, ... 2**20, the one that moves closest to 100000 bytes."""
    far = lambda i: F.struct(F.abs(F.pow(F.lit(2), i).cast("long") * F.col("p_size") - 100000).alias("far"), F.pow(F.lit(2), i).cast("long").alias("gsize"))
    rows = t(spark, sf_dir, "part").where("p_size is not null").select("p_partkey", F.array_min(F.transform(F.sequence(F.lit(1), F.lit(20)), far)).alias("m"))
    return rows.select("p_partkey", "m.gsize")
