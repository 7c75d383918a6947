"""Trained classifiers with SQL: naive Bayes by folds and training sets with their report, and the nearest labelled row."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import classify, counters
from corpusloom.plans.catalog import register
from corpusloom.plans.q_corpus import _WIDE, _wide_rows
from corpusloom.plans.q_relational import t
from corpusloom.sources.shared import saver

FEATURES = ["f1", "f2", "f3", "f4"]
_all = lambda f, sep=", ": sep.join(f(x) for x in FEATURES)

#: Rows of a suite (the line's number) are tested on models of other suites' rows, of synthetic rows (atomic = 0), and of both.
_TRAINED = f"""{_WIDE}, r AS MATERIALIZED (SELECT *, rational::BIGINT AS suite, row_number() OVER () AS rid FROM w), base AS (SELECT * FROM r WHERE atomic <> 0), suites AS (SELECT DISTINCT suite AS test FROM base),
train AS (
  SELECT 'own' AS training, g.test, b.* FROM base b JOIN suites g ON b.suite <> g.test UNION ALL SELECT 'synthetic', g.test, s.* FROM r s, suites g WHERE s.atomic = 0
  UNION ALL SELECT 'both', g.test, b.* FROM base b JOIN suites g ON b.suite <> g.test UNION ALL SELECT 'both', g.test, s.* FROM r s, suites g WHERE s.atomic = 0),
added AS (SELECT training, test, count(*) AS n_all, {classify.SMOOTHING} * greatest({_all(lambda f: f"var_pop({f})")}) AS more FROM train GROUP BY ALL),
class AS (SELECT training, test, oracle AS label, count(*) AS n, {_all(lambda f: f"avg({f}) AS m_{f}, var_pop({f}) AS v_{f}")} FROM train GROUP BY ALL),
scored AS (
  SELECT c.training, b.rid, b.benchmark, c.label, ln(c.n / a.n_all) - ({_all(lambda f: f"ln(2 * pi() * (c.v_{f} + a.more)) + (b.{f} - c.m_{f}) ** 2 / (c.v_{f} + a.more)", " + ")}) / 2 AS score
  FROM base b JOIN class c ON c.test = b.suite JOIN added a ON a.training = c.training AND a.test = c.test),
predicted AS (SELECT training, rid, any_value(benchmark) AS benchmark, arg_max(label, score) AS predicted FROM scored GROUP BY training, rid)"""


def _predicted(spark, sf_dir, *kept):
    """Real rows by training set, with the predicted device and the columns ``kept``, and the moments by suite and device."""
    wide = _wide_rows(spark, sf_dir).withColumn("suite", F.col("rational").cast("long"))
    rows = saver(spark, "measurements")(wide.select(*kept, "suite", "oracle", "atomic", *FEATURES))
    base, synthetic = rows.where("atomic <> 0"), rows.where("atomic = 0")
    cells = saver(spark, "moments")(classify.class_moments(base, ["suite", "oracle"], FEATURES))
    own = classify.leave_one_out(cells, "suite", "oracle")
    other = classify.class_moments(synthetic, ["oracle"], FEATURES).join(F.broadcast(cells.select("suite").distinct()))  # a row for each suite, label and feature
    other = other.select(own.columns)
    both = classify.merged(own.unionByName(other), ["suite", "oracle"]).select(own.columns)
    moments = own.withColumn("training", F.lit("own")).unionByName(other.withColumn("training", F.lit("synthetic"))).unionByName(both.withColumn("training", F.lit("both")))
    models = classify.naive_bayes(moments, ["training", "suite"], "oracle", FEATURES)
    tested = base.withColumn("training", F.explode(F.array(F.lit("own"), F.lit("synthetic"), F.lit("both"))))
    return classify.predicted(tested, saver(spark, "models")(models), ["training", "suite"], FEATURES), cells


@register("device_models", f"{_TRAINED} SELECT training, benchmark, predicted FROM predicted")
def device_models(spark, sf_dir):
    """The faster device of every row by naive Bayes models of other suites' rows, synthetic ones, and both."""
    return _predicted(spark, sf_dir, "benchmark")[0].select("training", "benchmark", "predicted")


@register("device_model_report", f"""{_TRAINED},
zero AS (SELECT arg_min(oracle, (-n, oracle)) AS device FROM (SELECT oracle, count(*) AS n FROM base GROUP BY oracle)),
timed AS (SELECT p.training, b.suite, p.predicted = 'GPU' AS p, b.oracle = 'GPU' AS y, ln((CASE WHEN z.device = 'GPU' THEN runtime_gpu ELSE runtime_cpu END) / (CASE WHEN p.predicted = 'GPU' THEN runtime_gpu ELSE runtime_cpu END)) AS gain
          FROM base b JOIN predicted p USING (rid), zero z)
SELECT training, suite, count(*) AS n, round(count(*) FILTER (WHERE p AND y) / nullif(count(*) FILTER (WHERE p), 0), 6) AS prec, round(count(*) FILTER (WHERE p AND y) / nullif(count(*) FILTER (WHERE y), 0), 6) AS recall,
       round(count(*) FILTER (WHERE NOT p AND NOT y) / nullif(count(*) FILTER (WHERE NOT y), 0), 6) AS tnr, round(avg((p = y)::INT), 6) AS accuracy, round(exp(avg(gain)), 6) AS speedup FROM timed GROUP BY training, suite""")
def device_model_report(spark, sf_dir):
    """For each training set and suite: precision, recall, true-negative rate, accuracy, and the geometric mean of the gain
    over always taking the commonest device. Predictions are counted as they are made, in one pass; none is written."""
    rows, cells = _predicted(spark, sf_dir, "runtime_cpu", "runtime_gpu")
    n = cells.where(F.col("feature") == FEATURES[0]).groupBy("oracle").agg(F.sum("n").alias("n"))
    zero = n.agg(F.min_by("oracle", F.struct(-F.col("n"), "oracle")).alias("device"))  # one row
    time = lambda device: F.when(F.col(device) == "GPU", F.col("runtime_gpu")).otherwise(F.col("runtime_cpu"))
    p, y = F.col("predicted") == "GPU", F.col("oracle") == "GPU"
    rate = lambda a, b: F.round(F.count_if(a) / F.nullif(F.count_if(b), F.lit(0)), 6)
    gain = F.ln(time("device") / time("predicted"))
    report = rows.join(F.broadcast(zero)).groupBy("training", "suite")
    return report.agg(F.count("*").alias("n"), rate(p & y, p).alias("prec"), rate(p & y, y).alias("recall"), rate(~p & ~y, ~y).alias("tnr"), F.round(F.avg((p == y).cast("int")), 6).alias("accuracy"), F.round(F.exp(F.avg(gain)), 6).alias("speedup"))


@register("nearest_label", """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
d AS (SELECT q.vec_id, r.vec_id AS nearest_vec_id, r.label, list_distance(q.e, r.e) AS dist FROM v q JOIN v r ON r.vec_id % 20 <> 0 WHERE q.vec_id % 20 = 0)
SELECT vec_id, arg_min(nearest_vec_id, (dist, nearest_vec_id)) AS nearest_vec_id, arg_min(label, (dist, nearest_vec_id)) AS label, round(min(dist), 5) AS dist FROM d GROUP BY vec_id""")
def nearest_label(spark, sf_dir):
    """The label of the nearest other row, for every row whose id is divisible by 20."""
    v = t(spark, sf_dir, "embeddings")
    query = F.col("vec_id") % 20 == 0
    return classify.nearest_rows(v.where(query), v.where(~query), "embedding", "label", "vec_id", "vec_id").withColumn("dist", F.round("dist", 5))


@register("merged_counters", """
WITH c AS (SELECT user_id, event_type AS o, (event_id % 7)::VARCHAR AS i, count(*) AS n FROM events GROUP BY ALL),
m AS (SELECT user_id, o, o || ':' || string_agg(i || '=' || n, ',' ORDER BY i) AS s FROM c GROUP BY user_id, o)
SELECT user_id, string_agg(s, ';' ORDER BY o) AS counters FROM m GROUP BY user_id""")
def merged_counters(spark, sf_dir):
    """Counters of each user's events by type and remainder, kept as JSON in two tables (even and odd events) and merged."""
    events = t(spark, sf_dir, "events").withColumn("rest", F.col("event_id") % 7)
    stored = [counters.counted(events.where(F.col("event_id") % 2 == k), ["user_id"], "event_type", "rest").withColumn("counters", F.to_json("counters")) for k in (0, 1)]
    both = counters.merged([s.withColumn("counters", counters.from_json(F.col("counters"))) for s in stored], ["user_id"])
    return both.select("user_id", counters.shown(F.col("counters")).alias("counters"))
