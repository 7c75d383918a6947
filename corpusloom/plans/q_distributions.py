"""Algebra of discrete distributions on line items (return flag: device, quantity: time)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import distributions as dist
from corpusloom.plans.catalog import register
from corpusloom.plans.q_relational import t

_PMF = """WITH c AS (SELECT l_returnflag AS g, l_quantity::BIGINT AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), pmf AS (SELECT g, v, n / sum(n) OVER (PARTITION BY g) AS p FROM c),
a AS (SELECT v, p FROM pmf WHERE g = 'A'), r AS (SELECT v, p FROM pmf WHERE g = 'R')
"""


def _pmf(spark, sf_dir):
    return dist.pmf(t(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "g"), ["g"], "l_quantity")


def _two(spark, sf_dir):
    p = _pmf(spark, sf_dir)
    return p.where("g = 'A'").select("v", "p"), p.where("g = 'R'").select("v", "p")


@register("pmf_and_cdf", _PMF + "SELECT g, v, round(p, 9) AS p, round(sum(p) OVER (PARTITION BY g ORDER BY v), 9) AS cdf FROM pmf")
def pmf_and_cdf(spark, sf_dir):
    return dist.cdf(_pmf(spark, sf_dir), ["g"]).select("g", "v", F.round("p", 9).alias("p"), F.round("cdf", 9).alias("cdf"))


@register("sum_of_variables", _PMF + "SELECT a.v + r.v AS v, round(sum(a.p * r.p), 9) AS p FROM a CROSS JOIN r GROUP BY 1")
def sum_of_variables(spark, sf_dir):
    return dist.add(*_two(spark, sf_dir), []).select("v", F.round("p", 9).alias("p"))


@register("difference_of_variables", _PMF + "SELECT a.v - r.v AS v, round(sum(a.p * r.p), 9) AS p FROM a CROSS JOIN r GROUP BY 1")
def difference_of_variables(spark, sf_dir):
    return dist.subtract(*_two(spark, sf_dir), []).select("v", F.round("p", 9).alias("p"))


@register("product_of_variables", _PMF + "SELECT a.v * r.v AS v, round(sum(a.p * r.p), 9) AS p FROM a CROSS JOIN r GROUP BY 1")
def product_of_variables(spark, sf_dir):
    return dist.multiply(*_two(spark, sf_dir), []).select("v", F.round("p", 9).alias("p"))


@register("tail_probabilities", _PMF + """
SELECT g, round(coalesce(sum(p) FILTER (WHERE v >= 25), 0), 9) AS ge, round(coalesce(sum(p) FILTER (WHERE v > 25), 0), 9) AS gt, round(coalesce(sum(p) FILTER (WHERE v <= 25), 0), 9) AS le,
       round(coalesce(sum(p) FILTER (WHERE v < 25), 0), 9) AS lt, round(coalesce(sum(p) FILTER (WHERE v = 25), 0), 9) AS eq FROM pmf GROUP BY g""")
def tail_probabilities(spark, sf_dir):
    p = dist.probability(_pmf(spark, sf_dir), ["g"], F.lit(25))
    return p.select("g", *[F.round(c, 9).alias(c) for c in ("ge", "gt", "le", "lt", "eq")])


@register("moments", """
SELECT l_returnflag AS g, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median, round(var_pop(l_quantity), 6) AS variance, round(stddev_pop(l_quantity), 6) AS std FROM lineitem GROUP BY 1""")
def moments(spark, sf_dir):
    """Mean and variance from the distribution; the median from the samples."""
    m = dist.moments(_pmf(spark, sf_dir), ["g"])
    med = t(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(F.median("l_quantity").alias("median"))
    return m.join(med, "g").select("g", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("variance", 6).alias("variance"), F.round(F.sqrt("variance"), 6).alias("std"))


@register("covariance", """
SELECT l_returnflag AS g, round(covar_pop(l_quantity, l_extendedprice), 4) AS cov, round(CASE WHEN stddev_pop(l_quantity) = 0 OR stddev_pop(l_extendedprice) = 0 THEN 'inf'::DOUBLE ELSE corr(l_quantity, l_extendedprice) END, 9) AS corr FROM lineitem GROUP BY 1""")
def covariance(spark, sf_dir):
    """Population covariance, and correlation (infinite where there is no spread)."""
    flat = (F.stddev_pop("l_quantity") == 0) | (F.stddev_pop("l_extendedprice") == 0)
    return t(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(F.round(F.covar_pop("l_quantity", "l_extendedprice"), 4).alias("cov"), F.round(F.when(flat, F.lit(float("inf"))).otherwise(F.corr("l_quantity", "l_extendedprice")), 9).alias("corr"))


@register("device_probability", _PMF + """, n AS (SELECT v, p FROM pmf WHERE g = 'N'), gpu AS (SELECT r.v + n.v AS v, sum(r.p * n.p) AS p FROM r CROSS JOIN n GROUP BY 1)
SELECT round(sum(a.p * gpu.p) FILTER (WHERE a.v - gpu.v < 0), 9) AS cpu_wins FROM a CROSS JOIN gpu""")
def device_probability(spark, sf_dir):
    """P(CPU time < GPU transfer + GPU time), each from its samples."""
    p = _pmf(spark, sf_dir)
    cpu, transfer, kernel = (p.where(F.col("g") == g).select("v", "p") for g in ("A", "R", "N"))
    return dist.probability(dist.subtract(cpu, dist.add(transfer, kernel, []), []), [], F.lit(0)).select(F.round("lt", 9).alias("cpu_wins"))


@register("head_to_head", _PMF + """, w AS (SELECT g, v, sum(n) AS n FROM c GROUP BY ALL), k AS (SELECT list_sort(list(l_quantity::BIGINT)) AS s FROM lineitem WHERE l_returnflag = 'R')
SELECT (SELECT round(sum(a.p * r.p), 9) FROM a CROSS JOIN r WHERE a.v < r.v) AS below, (SELECT round(sum(p), 9) FROM a WHERE v <= (SELECT min(v) FROM r)) AS to_min, (SELECT round(sum(p), 9) FROM a WHERE v <= (SELECT s[least(len(s), 101)] FROM k)) AS to_kth""")
def head_to_head(spark, sf_dir):
    """P(A < B), P(A <= min B), P(A <= the 101st of B)."""
    a, r = _two(spark, sf_dir)
    below = dist.probability(dist.subtract(a, r, []), [], F.lit(0)).select(F.round("lt", 9).alias("below"))
    rows = t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_quantity").cast("long").alias("v"))
    kth = rows.orderBy("v").limit(101).agg(F.max("v").alias("kth"), F.min("v").alias("least"))
    share = lambda c, name: F.round(F.sum(F.when(F.col("v") <= F.col(c), F.col("p"))), 9).alias(name)
    return below.crossJoin(a.crossJoin(F.broadcast(kth)).agg(share("least", "to_min"), share("kth", "to_kth")))
