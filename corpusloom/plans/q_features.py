"""Feature-space queries on embeddings (label: group; vec_id < 10: targets)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import features as fx
from corpusloom.operators import nearest, ranking
from corpusloom.plans.catalog import oracle_of, register
from corpusloom.sources.shared import saver

TARGETS, K = 10, 5


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))


def targets_and_samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, sf_dir)
    return v.where(f"vec_id < {TARGETS}").select(F.col("vec_id").alias("target_id"), F.col("features").alias("target")), v.where(f"vec_id >= {TARGETS}")


def twentieths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Targets (ids divisible by 20) that grow with the table, and the other rows as samples."""
    v = vectors(spark, sf_dir)
    return v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("target_id"), F.col("features").alias("target")), v.where("vec_id % 20 <> 0")


_PAIRS = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings),
pairs AS (
  SELECT t.vec_id AS target_id, s.vec_id, s.label, t.f AS tf, s.f AS sf,
         sqrt(list_sum(list_transform(range(1, len(t.f) + 1), lambda i: abs(t.f[i] * t.f[i] - s.f[i] * s.f[i])))) AS dist,
         sqrt(list_sum(list_transform(range(1, len(t.f) + 1), lambda i: (t.f[i] - s.f[i]) * (t.f[i] - s.f[i])))) AS euclid,
         sqrt(list_sum(list_transform(t.f, lambda x: x * x))) AS target_norm
  FROM v t CROSS JOIN v s WHERE t.vec_id < 10 AND s.vec_id >= 10)
"""


@register("feature_distance", _PAIRS + "SELECT target_id, vec_id, round(dist, 6) AS dist, round(euclid, 6) AS euclid FROM pairs")
def feature_distance(spark, sf_dir, split=targets_and_samples):
    t, s = split(spark, sf_dir)
    return nearest.pair_distances(t, s).select("target_id", "vec_id", F.round("dist", 6).alias("dist"), F.round("euclid", 6).alias("euclid"))


@register("top_k_per_target", _PAIRS + "SELECT target_id, vec_id, rank, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY dist, vec_id) AS rank FROM pairs) WHERE rank <= 5")
def top_k_per_target(spark, sf_dir):
    t, s = targets_and_samples(spark, sf_dir)
    return ranking.top_k(nearest.nearest(t, s, K), ["target_id"], ["dist", "vec_id"], K).select("target_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("dist", 6).alias("dist"))


def scores(spark: SparkSession, sf_dir: str, k: int, split=targets_and_samples) -> DataFrame:
    """Mean distance of the k nearest samples of each group to each target, as relative proximity."""
    t, s = split(spark, sf_dir)
    near = ranking.top_k(nearest.nearest(t, s, k, key=F.col("label")).withColumnRenamed("key", "label"), ["label", "target_id"], ["dist", "vec_id"], k)
    mean = near.groupBy("label", "target_id").agg((F.sum("dist") / k).alias("average"), F.count_if(F.col("dist") == 0).alias("exact"))
    mean = mean.join(t.groupBy("target_id").agg(F.max(fx.norm(F.col("target"))).alias("norm")), "target_id")
    largest = F.max("average").over(Window.partitionBy("target_id"))
    origin = F.greatest("norm", largest)
    proximity = F.when(origin > 0, 100 * (origin - F.col("average")) / origin).otherwise(F.lit(100.0))
    return mean.select("label", "target_id", F.round("average", 6).alias("average"), F.round(proximity, 6).alias("proximity"), "exact")


def _score_sql(k: int) -> str:
    return _PAIRS + f""", near AS (SELECT *, row_number() OVER (PARTITION BY label, target_id ORDER BY dist, vec_id) AS rank FROM pairs),
mean AS (SELECT label, target_id, sum(dist) / {k} AS average, max(target_norm) AS norm, count(*) FILTER (WHERE dist = 0) AS exact FROM near WHERE rank <= {k} GROUP BY label, target_id),
org AS (SELECT *, greatest(norm, max(average) OVER (PARTITION BY target_id)) AS origin FROM mean)
SELECT label, target_id, round(average, 6) AS average, round(CASE WHEN origin > 0 THEN 100 * (origin - average) / origin ELSE 100 END, 6) AS proximity, exact FROM org"""


@register("k_average_score", _score_sql(K))
def k_average_score(spark, sf_dir):
    return scores(spark, sf_dir, K)


@register("min_score", _score_sql(1))
def min_score(spark, sf_dir):
    return scores(spark, sf_dir, 1)


_GROWING = lambda sql: sql.replace("t.vec_id < 10 AND s.vec_id >= 10", "t.vec_id % 20 = 0 AND s.vec_id % 20 <> 0")


def growing(name: str, query) -> None:
    """Registers a query of targets once more, with every twentieth vector as a target."""

    def whole(spark, sf_dir):
        return query(spark, sf_dir, twentieths)

    whole.__doc__ = f"{name} with every twentieth vector as a target."
    register(f"growing_{name}", _GROWING(oracle_of(name)))(whole)


@register("growing_k_average_score", _GROWING(_score_sql(K)))
def growing_k_average_score(spark, sf_dir):
    """k_average_score with every twentieth vector as a target."""
    return scores(spark, sf_dir, K, twentieths)


@register("growing_min_score", _GROWING(_score_sql(1)))
def growing_min_score(spark, sf_dir):
    """min_score with every twentieth vector as a target."""
    return scores(spark, sf_dir, 1, twentieths)


@register("growing_top_k_per_target", _GROWING(_PAIRS) + "SELECT target_id, vec_id, rank, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY dist, vec_id) AS rank FROM pairs) WHERE rank <= 5")
def growing_top_k_per_target(spark, sf_dir):
    """top_k_per_target with every twentieth vector as a target."""
    t, s = twentieths(spark, sf_dir)
    return ranking.top_k(nearest.nearest(t, s, K), ["target_id"], ["dist", "vec_id"], K).select("target_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("dist", 6).alias("dist"))


@register("far_targets", _PAIRS + "SELECT target_id, round(min(dist), 6) AS nearest FROM pairs GROUP BY target_id HAVING min(dist) > 0")
def far_targets(spark, sf_dir, split=targets_and_samples):
    """Targets that no sample meets exactly, with the distance of their nearest sample."""
    t, s = split(spark, sf_dir)
    d = nearest.nearest(t, s, 1).groupBy("target_id").agg(F.min("dist").alias("d"))
    return d.where("d > 0").select("target_id", F.round("d", 6).alias("nearest"))


@register("feature_max_normalized", """
WITH e AS (SELECT vec_id, label, unnest(range(0, 4)) AS k, unnest(list_transform(embedding[1:4], lambda x: abs(x::DOUBLE))) AS val FROM embeddings)
SELECT label, k, round(avg(CASE WHEN m = 0 THEN 1.0 ELSE val / m END), 6) AS mean_share FROM (SELECT *, max(val) OVER (PARTITION BY k) AS m FROM e) GROUP BY label, k""")
def feature_max_normalized(spark, sf_dir):
    e = vectors(spark, sf_dir).select("vec_id", "label", F.posexplode(F.transform(F.slice("features", 1, 4), F.abs)).alias("k", "val"))
    return fx.max_normalized(e, ["k"], "val", "share").groupBy("label", F.col("k").cast("long").alias("k")).agg(F.round(F.avg("share"), 6).alias("mean_share"))


@register("z_scored_features", """
WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x FROM embeddings)
SELECT vec_id, round(CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END, 6) AS z FROM (SELECT vec_id, x, avg(x) OVER (PARTITION BY label) AS m, stddev_pop(x) OVER (PARTITION BY label) AS s FROM e)""")
def z_scored_features(spark, sf_dir):
    e = vectors(spark, sf_dir).select("vec_id", "label", F.get("features", F.lit(0)).alias("x"))
    return fx.standardized(e, "x", ["label"]).select("vec_id", F.round("x", 6).alias("z"))


_COMPONENTS = "e AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS k, unnest(list_transform(embedding, lambda x: x::DOUBLE)) AS x FROM embeddings)"


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", "label", F.posexplode("features").alias("k", "x")).withColumn("k", F.col("k").cast("long"))


@register("whole_max_normalized", f"""
WITH {_COMPONENTS}, m AS (SELECT *, abs(x) AS val, max(abs(x)) OVER (PARTITION BY k) AS m FROM e)
SELECT label, k, round(avg(CASE WHEN m = 0 THEN 1.0 ELSE val / m END), 6) AS mean_share FROM m GROUP BY label, k""")
def whole_max_normalized(spark, sf_dir):
    """feature_max_normalized over all components."""
    e = components(spark, sf_dir).select("label", "k", F.abs("x").alias("val"))
    m = e.groupBy("k").agg(F.max("val").alias("m"))
    share = F.when(F.col("m") == 0, 1.0).otherwise(F.col("val") / F.when(F.col("m") != 0, F.col("m")))
    return e.join(F.broadcast(m), "k").groupBy("label", "k").agg(F.round(F.avg(share), 6).alias("mean_share"))


@register("whole_z_scores", f"""
WITH {_COMPONENTS}
SELECT vec_id, k, round(CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END, 6) AS z FROM (SELECT vec_id, k, x, avg(x) OVER (PARTITION BY label, k) AS m, stddev_pop(x) OVER (PARTITION BY label, k) AS s FROM e)""")
def whole_z_scores(spark, sf_dir):
    """z_scored_features over all components."""
    e = components(spark, sf_dir)
    m = e.groupBy("label", "k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = F.when(F.col("s") > 0, (F.col("x") - F.col("m")) / F.when(F.col("s") > 0, F.col("s"))).otherwise(0.0)
    return e.join(m, ["label", "k"]).select("vec_id", "k", F.round(z, 6).alias("z"))


@register("target_grid", """
WITH m AS (SELECT max(l_partkey) AS comp, max(l_suppkey) AS mem FROM lineitem)
SELECT i AS step, (i * m.comp) // 100 AS comp, (i * m.mem) // 100 AS mem, round(((i * m.comp) // 100) / greatest(1, (i * m.mem) // 100), 6) AS comp_per_mem FROM range(1, 101) r(i), m""")
def target_grid(spark, sf_dir):
    """Hundredths of the greatest features that the rows have (part and supplier keys)."""
    most = spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.max("l_partkey").alias("comp"), F.max("l_suppkey").alias("mem"))  # one row
    grid = most.select(F.posexplode(fx.target_grid({"comp": F.col("comp"), "mem": F.col("mem")})).alias("i", "m"))
    return grid.select((F.col("i") + 1).cast("long").alias("step"), F.col("m.comp").alias("comp"), F.col("m.mem").alias("mem"), F.round(F.col("m.comp") / F.greatest(F.lit(1), F.col("m.mem")), 6).alias("comp_per_mem"))


@register("improving_candidate", _PAIRS + """, best AS (SELECT target_id, min(dist) FILTER (WHERE vec_id % 7 = 0) AS input_score FROM pairs GROUP BY target_id)
SELECT p.target_id, arg_min(p.vec_id, (p.dist, p.vec_id)) AS vec_id, round(min(p.dist), 6) AS score FROM pairs p JOIN best b USING (target_id) WHERE p.dist > 0 AND p.dist < b.input_score GROUP BY p.target_id""")
def improving_candidate(spark, sf_dir, split=targets_and_samples):
    """The best sample strictly better than the input feed's score (samples with vec_id % 7 = 0 stand for feeds)."""
    t, s = split(spark, sf_dir)
    d = saver(spark, "near")(nearest.nearest(t, s, 1, key=F.col("vec_id") % 7 == 0, zero_apart=True))
    feeds = d.where("vec_id % 7 = 0").groupBy("target_id").agg(F.min("dist").alias("input_score"))
    better = d.join(feeds, "target_id").where("dist > 0 and dist < input_score")
    return better.groupBy("target_id").agg(F.min(F.struct("dist", "vec_id")).alias("m")).select("target_id", "m.vec_id", F.round("m.dist", 6).alias("score"))


@register("greedy_one_to_one")
def greedy_one_to_one(spark, sf_dir):
    t, s = targets_and_samples(spark, sf_dir)
    d = ranking.target_distances(t, s, fx.feature_distance).select(F.col("target_id").alias("a"), F.col("vec_id").alias("b"), "dist")
    return ranking.greedy_one_to_one(d)


@register("growing_one_to_one", _GROWING(_PAIRS).replace("WITH v", "WITH RECURSIVE v", 1) + """, q AS (SELECT target_id, vec_id, round(dist, 6) AS dist FROM pairs), t AS (SELECT target_id, row_number() OVER (ORDER BY target_id) AS n FROM (SELECT DISTINCT target_id FROM q)),
g AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS taken, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS dist
UNION ALL SELECT g.n + 1, list_append(any_value(g.taken), arg_min(q.vec_id, (q.dist, q.vec_id))), any_value(q.target_id), arg_min(q.vec_id, (q.dist, q.vec_id)), min(q.dist) FROM g JOIN t ON t.n = g.n + 1 JOIN q ON q.target_id = t.target_id WHERE NOT list_contains(g.taken, q.vec_id) GROUP BY g.n)
SELECT a, b, dist FROM g WHERE a IS NOT NULL""")
def growing_one_to_one(spark, sf_dir):
    """Each target (every twentieth vector) in turn takes its nearest sample that is still free."""
    t, s = twentieths(spark, sf_dir)
    return nearest.one_to_one(t, s, 6)


@register("best_so_far", _PAIRS + """, g AS (SELECT target_id, vec_id % 8 AS generation, min(dist) AS best FROM pairs GROUP BY ALL)
SELECT target_id, generation, round(best, 6) AS best, round(min(best) OVER (PARTITION BY target_id ORDER BY generation ROWS UNBOUNDED PRECEDING), 6) AS best_so_far FROM g""")
def best_so_far(spark, sf_dir, split=targets_and_samples):
    """Least distance per target and generation, and the least up to it."""
    t, s = split(spark, sf_dir)
    g = nearest.nearest(t, s, 1, key=F.col("vec_id") % 8).groupBy("target_id", F.col("key").alias("generation")).agg(F.min("dist").alias("best"))
    w = Window.partitionBy("target_id").orderBy("generation").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return g.select("target_id", "generation", F.round("best", 6).alias("best"), F.round(F.min("best").over(w), 6).alias("best_so_far"))


@register("vote_entropy", """
WITH n AS (SELECT vec_id % 20 AS sample, label, count(*) AS n FROM embeddings GROUP BY ALL), p AS (SELECT sample, n / sum(n) OVER (PARTITION BY sample) AS p FROM n)
SELECT sample, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY sample""")
def vote_entropy(spark, sf_dir):
    """Disagreement of committee votes (label) on each sample, highest first where it is ranked."""
    from corpusloom.functions import distributions as dist

    e = vectors(spark, sf_dir).select((F.col("vec_id") % 20).alias("sample"), "label")
    return dist.entropy(e, ["sample"], "label").select("sample", F.round("entropy", 6).alias("entropy"))


@register("expected_error", """
SELECT vec_id, round(list_sum(list_transform(range(1, 5), lambda i: abs(embedding[i]::DOUBLE) * abs(embedding[i + 4]::DOUBLE))), 6) AS expected_error FROM embeddings""")
def expected_error(spark, sf_dir):
    """Sum over labels of posterior times loss (components 1-4 and 5-8 stand for them)."""
    v = vectors(spark, sf_dir)
    p, loss = F.transform(F.slice("features", 1, 4), F.abs), F.transform(F.slice("features", 5, 4), F.abs)
    return v.select("vec_id", F.round(F.aggregate(F.zip_with(p, loss, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x), 6).alias("expected_error"))


@register("pca_two")
def pca_two(spark, sf_dir):
    """Two principal components (Spark's projection is not centred; signs are arbitrary)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors(spark, sf_dir).withColumn("x", array_to_vector("features"))
    return PCA(k=2, inputCol="x", outputCol="y").fit(v).transform(v).select("vec_id", "label", vector_to_array("y").alias("components"))


@register("layout_two")
def layout_two(spark, sf_dir):
    """Two-dimensional layout of all vectors, neighbours near each other."""
    from corpusloom.operators.layout import layout

    return layout(vectors(spark, sf_dir), "vec_id", "features", rounds=10)


@register("leave_one_group_out", """
SELECT f.label AS fold, count(*) FILTER (WHERE e.label <> f.label) AS n_train, count(*) FILTER (WHERE e.label = f.label) AS n_test FROM embeddings e CROSS JOIN (SELECT DISTINCT label FROM embeddings) f GROUP BY f.label""")
def leave_one_group_out(spark, sf_dir):
    """Sizes of the folds that leave one group out each."""
    n = vectors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select(F.col("label").alias("fold"), (F.col("total") - F.col("n")).alias("n_train"), F.col("n").alias("n_test"))


for _name, _query in (("feature_distance", feature_distance), ("far_targets", far_targets), ("improving_candidate", improving_candidate), ("best_so_far", best_so_far)):
    growing(_name, _query)
