"""Scans, filters, joins, aggregates and windows on stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import features as fx
from corpusloom.operators import ranking
from corpusloom.plans.catalog import register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("batched_scan", """
SELECT doc_id, floor(rn / 128)::BIGINT + 1 AS batch_num, (floor(rn / 128) * 128)::BIGINT AS "offset", (floor(rn / 128) * 128 + 128)::BIGINT AS "limit", n AS max_rows FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents)""")
def batched_scan(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id")
    return ranking.batches(d, [F.col("doc_id")], 128).select("doc_id", "batch_num", "offset", "limit", "max_rows")


@register("batch_minus_done", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def batch_minus_done(spark, sf_dir):
    """Documents without those already done (anti-join)."""
    done = t(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return t(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left_anti")


@register("length_filter", "SELECT doc_id, n_chars FROM documents WHERE n_chars <= 800")
def length_filter(spark, sf_dir):
    return t(spark, sf_dir, "documents").where("n_chars <= 800").select("doc_id", "n_chars")


@register("in_filter", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus = 'F'")
def in_filter(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R") & (F.col("l_linestatus") == "F")).select("l_orderkey", "l_linenumber", "l_partkey")


@register("extension_and_content", "SELECT page_id, url FROM pages WHERE (url LIKE '%.html' OR url LIKE '%ref=x' OR url LIKE '%.php') AND html LIKE '%<body%'")
def extension_and_content(spark, sf_dir):
    """Any of several endings, and a text inside."""
    ends = F.lit(False)
    for e in (".html", "ref=x", ".php"):
        ends = ends | F.col("url").endswith(e)
    return t(spark, sf_dir, "pages").where(ends & F.col("html").contains("<body")).select("page_id", "url")


@register("size_filter", "SELECT doc_id, TRY_CAST(CASE WHEN doc_id % 10 = 0 THEN 'n/a' ELSE n_chars::VARCHAR END AS BIGINT) AS size FROM documents WHERE TRY_CAST(CASE WHEN doc_id % 10 = 0 THEN 'n/a' ELSE n_chars::VARCHAR END AS BIGINT) < 5000")
def size_filter(spark, sf_dir):
    """Sizes kept as text; what is no number is dropped."""
    size = F.when(F.col("doc_id") % 10 == 0, F.lit("n/a")).otherwise(F.col("n_chars").cast("string"))
    return t(spark, sf_dir, "documents").select("doc_id", size.try_cast("bigint").alias("size")).where("size < 5000")


@register("name_parts", r"SELECT page_id, regexp_extract(url, '://([^/]+)/', 1) AS host, regexp_extract(url, '://[^/]+/([a-z]*)', 1) AS section, regexp_matches(url, '^http://') AS plain FROM pages")
def name_parts(spark, sf_dir):
    """Parts of a name by regular expressions, and a mask."""
    u = F.col("url")
    return t(spark, sf_dir, "pages").select("page_id", F.regexp_extract(u, "://([^/]+)/", 1).alias("host"), F.regexp_extract(u, "://[^/]+/([a-z]*)", 1).alias("section"), u.rlike("^http://").alias("plain"))


@register("safe_ratios", """
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax > 0 THEN l_discount / l_tax ELSE 0 END, 6) AS f1, round(CASE WHEN l_discount > 0 THEN l_quantity / l_discount ELSE 0 END, 6) AS f2 FROM lineitem""")
def safe_ratios(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(fx.ratio(F.col("l_discount"), F.col("l_tax")), 6).alias("f1"), F.round(fx.ratio(F.col("l_quantity"), F.col("l_discount")), 6).alias("f2"))


@register("scale_by_max", "SELECT s_suppkey, round(s_acctbal / max(s_acctbal) OVER (), 6) AS scaled FROM supplier")
def scale_by_max(spark, sf_dir):
    s = t(spark, sf_dir, "supplier")
    return s.crossJoin(F.broadcast(s.agg(F.max("s_acctbal").alias("top")))).select("s_suppkey", F.round(F.col("s_acctbal") / F.col("top"), 6).alias("scaled"))


@register("short_names", "SELECT p_partkey, replace(replace(replace(p_name, 'small ', 's-'), 'red ', 'r-'), 'widget', 'w') AS name FROM part")
def short_names(spark, sf_dir):
    """Literal replacements in a given order."""
    name = F.col("p_name")
    for old, new in (("small ", "s-"), ("red ", "r-"), ("widget", "w")):
        name = F.replace(name, F.lit(old), F.lit(new))
    return t(spark, sf_dir, "part").select("p_partkey", name.alias("name"))


@register("wide_measurement_row", """
SELECT l_orderkey, l_linenumber, o_totalprice AS cpu, l_extendedprice AS gpu, CASE WHEN o_totalprice < l_extendedprice THEN 'CPU' ELSE 'GPU' END AS oracle,
       round(greatest(o_totalprice / l_extendedprice, l_extendedprice / o_totalprice), 6) AS speedup, round(least(o_totalprice / l_extendedprice, l_extendedprice / o_totalprice), 6) AS penalty
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_extendedprice > 0 AND o_totalprice > 0""")
def wide_measurement_row(spark, sf_dir):
    """Measurement rows: label, speedup and penalty from two run times (order and line prices)."""
    rows = t(spark, sf_dir, "lineitem").where("l_extendedprice > 0").join(t(spark, sf_dir, "orders").where("o_totalprice > 0"), F.col("l_orderkey") == F.col("o_orderkey"))
    a, b = F.col("o_totalprice"), F.col("l_extendedprice")
    return rows.select("l_orderkey", "l_linenumber", a.alias("cpu"), b.alias("gpu"), F.when(a < b, "CPU").otherwise("GPU").alias("oracle"), F.round(F.greatest(a / b, b / a), 6).alias("speedup"), F.round(F.least(a / b, b / a), 6).alias("penalty"))


@register("files_join_contents", """
SELECT o_orderkey, min(l_partkey) AS partkey, min(l_suppkey) AS suppkey, min(l_shipdate) AS shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 25 GROUP BY o_orderkey""")
def files_join_contents(spark, sf_dir):
    """Equi-join with a further condition, then the least of every column for each id."""
    rows = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "lineitem").where("l_quantity > 25"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("o_orderkey").agg(F.min("l_partkey").alias("partkey"), F.min("l_suppkey").alias("suppkey"), F.min("l_shipdate").alias("shipdate"))


@register("exclude_two_keys", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_returnflag = 'R' AND d.l_partkey = l.l_partkey AND d.l_suppkey = l.l_suppkey)")
def exclude_two_keys(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem")
    done = rows.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct()
    return rows.join(done, ["l_partkey", "l_suppkey"], "left_anti").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@register("keep_scraped", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def keep_scraped(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id").join(t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@register("cached_status", """
WITH c AS (SELECT sha256(text) AS sha, min(quality) AS status FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT doc_id, coalesce(status, -1) AS status FROM documents LEFT JOIN c ON sha256(text) = c.sha""")
def cached_status(spark, sf_dir):
    """Status of each text by its hash, where a copy of it has been run."""
    d = t(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    cache = d.join(t(spark, sf_dir, "labels"), "doc_id").groupBy("sha").agg(F.min("quality").alias("status"))
    return d.join(cache, "sha", "left").select("doc_id", F.coalesce("status", F.lit(-1)).alias("status"))


@register("done_in_results", """
WITH r AS (SELECT string_agg(source, chr(10) ORDER BY source) AS results FROM (SELECT DISTINCT source FROM documents WHERE doc_id % 13 = 0 AND doc_id < 130)), d AS (SELECT unnest(string_split(results, chr(10))) AS source FROM r)
SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM d)""")
def done_in_results(spark, sf_dir):
    """Targets without those that a results row names, one on each line."""
    d = t(spark, sf_dir, "documents").select("doc_id", "source")
    results = d.where("doc_id % 13 = 0 and doc_id < 130").agg(F.array_join(F.array_sort(F.collect_set("source")), "\n").alias("results"))
    done = results.select(F.explode(F.split("results", "\n")).alias("source"))
    return d.select("source").distinct().join(F.broadcast(done), "source", "left_anti")


@register("parameter_grid", """
SELECT p_partkey, g AS gsize, l AS lsize FROM part CROSS JOIN (SELECT (2 ** i)::BIGINT AS g FROM range(1, 11) r(i)) CROSS JOIN (SELECT (2 ** i)::BIGINT AS l FROM range(1, 11) r(i)) WHERE l <= g AND p_partkey < 50""")
def parameter_grid(spark, sf_dir):
    sizes = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.pow(F.lit(2), i).cast("long"))
    rows = t(spark, sf_dir, "part").where("p_partkey < 50").select("p_partkey", F.explode(sizes).alias("gsize"))
    return rows.select("p_partkey", "gsize", F.explode(sizes).alias("lsize")).where("lsize <= gsize")


@register("whole_parameter_grid", """
SELECT p_partkey, g AS gsize, l AS lsize FROM part CROSS JOIN (SELECT (2 ** i)::BIGINT AS g FROM range(1, 11) r(i)) CROSS JOIN (SELECT (2 ** i)::BIGINT AS l FROM range(1, 11) r(i)) WHERE l <= g""")
def whole_parameter_grid(spark, sf_dir):
    """The grid of sizes for every part."""
    sizes = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.pow(F.lit(2), i).cast("long"))
    rows = t(spark, sf_dir, "part").select("p_partkey", F.explode(sizes).alias("gsize"))
    return rows.select("p_partkey", "gsize", F.explode(sizes).alias("lsize")).where("lsize <= gsize")


@register("cached_parameter_grid", """
WITH g AS (SELECT p_partkey, g AS gsize, l AS lsize FROM part CROSS JOIN (SELECT (2 ** i)::BIGINT AS g FROM range(1, 11) r(i)) CROSS JOIN (SELECT (2 ** i)::BIGINT AS l FROM range(1, 11) r(i)) WHERE l <= g),
c AS (SELECT l_partkey AS p_partkey, (2 ** (l_suppkey % 10 + 1))::BIGINT AS gsize, (2 ** (l_linenumber % 10 + 1))::BIGINT AS lsize, min(l_extendedprice) AS time FROM lineitem GROUP BY ALL)
SELECT g.*, c.time IS NOT NULL AS cached, c.time FROM g LEFT JOIN c USING (p_partkey, gsize, lsize)""")
def cached_parameter_grid(spark, sf_dir):
    """The grid of sizes for every part, with the time that the results so far have for it (the least, of order lines by part,
    supplier and line); what isn't cached is left to measure."""
    power = lambda c: F.pow(F.lit(2), F.col(c) % 10 + 1).cast("long")
    results = t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"), power("l_suppkey").alias("gsize"), power("l_linenumber").alias("lsize")).agg(F.min("l_extendedprice").alias("time"))
    found = whole_parameter_grid(spark, sf_dir).join(results, ["p_partkey", "gsize", "lsize"], "left")
    return found.select("p_partkey", "gsize", "lsize", F.col("time").isNotNull().alias("cached"), "time")


@register("lookup_in_order", "SELECT pos::BIGINT AS pos, doc_id, n_chars FROM (SELECT unnest([7, 3, 99, 5, 3]::BIGINT[]) AS doc_id, unnest([0, 1, 2, 3, 4]) AS pos) JOIN documents USING (doc_id)")
def lookup_in_order(spark, sf_dir):
    """Rows of a list of ids, with each id's place in the list."""
    ids = spark.range(1).select(F.posexplode(F.array(*[F.lit(i) for i in (7, 3, 99, 5, 3)])).alias("pos", "doc_id"))
    return t(spark, sf_dir, "documents").join(F.broadcast(ids), "doc_id").select(F.col("pos").cast("long").alias("pos"), "doc_id", "n_chars")


@register("include_closure", """
WITH RECURSIVE e AS (SELECT page_id AS a, (page_id * 7 + 3) % 250 AS b FROM pages), c(root, node) AS (SELECT a, b FROM e WHERE a < 10 UNION SELECT c.root, e.b FROM c JOIN e ON c.node = e.a)
SELECT root, count(*) AS reached FROM c GROUP BY root""")
def include_closure(spark, sf_dir):
    """All pages reached over includes (page i includes 7 i + 3 mod 250), breadth first with a visited set."""
    edges = t(spark, sf_dir, "pages").select(F.col("page_id").alias("a"), ((F.col("page_id") * 7 + 3) % 250).alias("b"))
    edges.createOrReplaceTempView("include_edges")
    return spark.sql("WITH RECURSIVE c(root, node) MAX RECURSION LEVEL 400 AS (SELECT a, b FROM include_edges WHERE a < 10 UNION ALL SELECT c.root, e.b FROM c JOIN include_edges e ON c.node = e.a WHERE NOT (c.node = c.root)) SELECT root, count(DISTINCT node) AS reached FROM c GROUP BY root")


# aggregates


@register("corpus_totals", "SELECT count(*) AS files, sum(n_chars)::BIGINT AS chars, count(DISTINCT (source, lang)) AS pairs, (sum(n_chars) FILTER (WHERE lang = 'en'))::BIGINT AS english FROM documents")
def corpus_totals(spark, sf_dir):
    return t(spark, sf_dir, "documents").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.countDistinct("source", "lang").alias("pairs"), F.sum(F.when(F.col("lang") == "en", F.col("n_chars"))).alias("english"))


@register("distinct_pairs", "SELECT DISTINCT source, lang FROM documents")
def distinct_pairs(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("source", "lang").distinct()


@register("next_epoch", "SELECT coalesce(max(l_linenumber) + 1, 0)::BIGINT AS epoch, coalesce((SELECT max(l_linenumber) + 1 FROM lineitem WHERE l_quantity < 0), 0)::BIGINT AS empty_epoch FROM lineitem")
def next_epoch(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem")
    return rows.agg(F.coalesce(F.max("l_linenumber") + 1, F.lit(0)).cast("long").alias("epoch"), F.coalesce(F.max(F.when(F.col("l_quantity") < 0, F.col("l_linenumber"))) + 1, F.lit(0)).cast("long").alias("empty_epoch"))


@register("normalized_frequency", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def normalized_frequency(spark, sf_dir):
    n = t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("event_type", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@register("cumulative_histogram", """
WITH h AS (SELECT floor(n_chars / 8)::BIGINT * 8 AS bin, count(*) AS n FROM documents GROUP BY 1)
SELECT bin, round(100.0 * sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6) AS percent FROM h""")
def cumulative_histogram(spark, sf_dir):
    """Percent of rows up to each bin of width 8."""
    h = t(spark, sf_dir, "documents").groupBy((F.floor(F.col("n_chars") / 8) * 8).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy("bin")
    return h.select("bin", F.round(100.0 * F.sum("n").over(w) / F.sum("n").over(Window.partitionBy(F.lit(0))), 6).alias("percent"))


@register("key_means", """
WITH m AS (SELECT event_id, user_id % 7 AS k, value AS v FROM events WHERE value IS NOT NULL)
SELECT k, round(avg(v), 6) AS mean, round(sum(v) / (SELECT count(DISTINCT event_id) FROM m), 6) AS instance_mean, arg_max(v, event_id) AS last FROM m GROUP BY k""")
def key_means(spark, sf_dir):
    """Mean of a key's values, their sum over all instances (a missing key counts 0), and the last value."""
    m = t(spark, sf_dir, "events").where("value is not null").select("event_id", (F.col("user_id") % 7).alias("k"), F.col("value").alias("v"))
    n = m.agg(F.countDistinct("event_id").alias("n"))
    per = m.groupBy("k").agg(F.avg("v").alias("mean"), F.sum("v").alias("total"), F.max_by("v", "event_id").alias("last"))
    return per.crossJoin(F.broadcast(n)).select("k", F.round("mean", 6).alias("mean"), F.round(F.col("total") / F.col("n"), 6).alias("instance_mean"), "last")


@register("geometric_mean", "SELECT l_returnflag, round(exp(avg(ln(l_quantity))), 6) AS gmean FROM lineitem WHERE l_quantity > 0 GROUP BY l_returnflag")
def geometric_mean(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").where("l_quantity > 0").groupBy("l_returnflag").agg(F.round(F.exp(F.avg(F.ln("l_quantity"))), 6).alias("gmean"))


@register("mean_of_means", "SELECT l_returnflag, round(avg(m), 6) AS mean FROM (SELECT l_returnflag, l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY ALL) GROUP BY l_returnflag")
def mean_of_means(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_quantity").alias("m")).groupBy("l_returnflag").agg(F.round(F.avg("m"), 6).alias("mean"))


@register("zero_rule", "SELECT source, arg_min(lang, (-n, lang)) AS lang FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def zero_rule(spark, sf_dir):
    """The most common label of each group, ties by name."""
    n = t(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.min_by("lang", F.struct(-F.col("n"), "lang")).alias("lang"))


@register("confusion", """
SELECT source, round(count(*) FILTER (WHERE p AND y) / nullif(count(*) FILTER (WHERE p), 0), 6) AS prec, round(count(*) FILTER (WHERE p AND y) / nullif(count(*) FILTER (WHERE y), 0), 6) AS recall,
       round(count(*) FILTER (WHERE NOT p AND NOT y) / nullif(count(*) FILTER (WHERE NOT y), 0), 6) AS tnr, round(avg((p = y)::INT), 6) AS accuracy
FROM (SELECT source, n_chars > 1000 AS p, quality = 1 AS y FROM documents JOIN labels USING (doc_id)) GROUP BY source""")
def confusion(spark, sf_dir):
    """Precision, recall, true-negative rate and accuracy of 'longer than 1000' for quality."""
    d = t(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") > 1000).alias("p")).join(t(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("y")), "doc_id")
    p, y = F.col("p"), F.col("y")
    rate = lambda a, b: F.round(F.count_if(a) / F.nullif(F.count_if(b), F.lit(0)), 6)
    return d.groupBy("source").agg(rate(p & y, p).alias("prec"), rate(p & y, y).alias("recall"), rate(~p & ~y, ~y).alias("tnr"), F.round(F.avg((p == y).cast("int")), 6).alias("accuracy"))


@register("oracle_speedup", """
SELECT o_orderpriority, round(exp(avg(ln(greatest(a, b) / least(a, b)))), 6) AS gmean_speedup, round(avg((a < b)::INT), 6) AS cpu_share FROM (SELECT o_orderpriority, o_totalprice AS a, l_extendedprice AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 0 AND l_extendedprice > 0) GROUP BY 1""")
def oracle_speedup(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("o_totalprice > 0 and l_extendedprice > 0")
    a, b = F.col("o_totalprice"), F.col("l_extendedprice")
    return rows.groupBy("o_orderpriority").agg(F.round(F.exp(F.avg(F.ln(F.greatest(a, b) / F.least(a, b)))), 6).alias("gmean_speedup"), F.round(F.avg((a < b).cast("int")), 6).alias("cpu_share"))


@register("device_label", """
SELECT l_partkey, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'A') = 0 THEN 'NO_CPU' WHEN count(*) FILTER (WHERE l_returnflag = 'R') = 0 THEN 'NO_GPU'
  WHEN avg(l_quantity) FILTER (WHERE l_returnflag = 'A') <= avg(l_quantity) FILTER (WHERE l_returnflag = 'R') THEN 'CPU' ELSE 'GPU' END AS label FROM lineitem GROUP BY l_partkey""")
def device_label(spark, sf_dir):
    """The device of lesser mean time (flags A and R as devices), or which is missing."""
    time = lambda d: F.avg(F.when(F.col("l_returnflag") == d, F.col("l_quantity")))
    per = t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(time("A").alias("c"), time("R").alias("g"))
    label = F.when(F.col("c").isNull(), "NO_CPU").when(F.col("g").isNull(), "NO_GPU").when(F.col("c") <= F.col("g"), "CPU").otherwise("GPU")
    return per.select("l_partkey", label.alias("label"))


@register("median_time", "SELECT l_suppkey, round(median(l_quantity), 6) AS median FROM lineitem GROUP BY l_suppkey")
def median_time(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.median("l_quantity"), 6).alias("median"))


@register("user_counters", """
SELECT user_id, event_type, count(*) AS n, count(*) FILTER (WHERE value > 20) AS correct FROM events GROUP BY ALL""")
def user_counters(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 20).alias("correct"))


@register("user_accuracy", "SELECT user_id, CASE WHEN count(*) >= 80 THEN round(avg((coalesce(value, 0) > 20)::INT), 6) END AS accuracy FROM events GROUP BY user_id")
def user_accuracy(spark, sf_dir):
    """Null below 80 attempts."""
    hit = F.avg((F.coalesce("value", F.lit(0.0)) > 20).cast("int"))
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.when(F.count("*") >= 80, F.round(hit, 6)).alias("accuracy"))


@register("text_sizes", r"""
SELECT doc_id, length(text)::BIGINT AS chars, len(string_split(text, chr(10)))::BIGINT AS lines, len(list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda x: x <> ''))::BIGINT AS words FROM documents""")
def text_sizes(spark, sf_dir):
    words = F.size(F.filter(F.split("text", "[ \n\t\r]+"), lambda x: x != ""))
    return t(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), F.size(F.split("text", "\n")).cast("long").alias("lines"), words.cast("long").alias("words"))


# windows, sorts, limits


@register("lag_of_steps", """
SELECT event_id, round(d, 6) AS seconds FROM (SELECT event_id, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) WHERE d IS NOT NULL""")
def lag_of_steps(spark, sf_dir):
    """Seconds since the step before; each user's first is dropped."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, sf_dir, "events").select("event_id", (at - F.lag(at).over(w)).alias("d")).where("d is not null").select("event_id", F.round("d", 6).alias("seconds"))


@register("renumbered", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 + 100 AS new_id FROM documents WHERE lang = 'en'")
def renumbered(spark, sf_dir):
    d = t(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return ranking.numbered_rows(d, [F.col("doc_id")]).select("doc_id", (F.col("row_num") + 100).alias("new_id"))


@register("index_to_chunk", """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), s AS (SELECT source, n, sum(n) OVER (ORDER BY source) AS hi FROM c)
SELECT i AS idx, source, (i - (hi - n))::BIGINT AS inside FROM range(0, 400, 37) r(i) JOIN s ON i >= hi - n AND i < hi""")
def index_to_chunk(spark, sf_dir):
    """Global indices to chunk and place in the chunk, by running sizes."""
    c = t(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    s = c.withColumn("hi", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("source")))
    i = spark.range(0, 400, 37).withColumnRenamed("id", "idx")
    return i.join(F.broadcast(s), (F.col("idx") >= F.col("hi") - F.col("n")) & (F.col("idx") < F.col("hi"))).select("idx", "source", (F.col("idx") - F.col("hi") + F.col("n")).alias("inside"))


@register("slice_of_rows", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25 OFFSET 50")
def slice_of_rows(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").offset(50).limit(25)


@register("random_order")
def random_order(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id").orderBy(F.rand(7), "doc_id")


@register("kth_smallest", "SELECT l_suppkey, list_sort(list(l_quantity))[least(count(*), 4)] AS v FROM lineitem GROUP BY l_suppkey")
def kth_smallest(spark, sf_dir):
    """The fourth smallest, or the largest of fewer."""
    w = Window.partitionBy("l_suppkey").orderBy("l_quantity", "l_orderkey", "l_linenumber")
    rows = t(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(w)).where("r <= 4")
    return rows.groupBy("l_suppkey").agg(F.max("l_quantity").alias("v"))


@register("top_codes_all_rows", """
WITH b AS (SELECT l_partkey, min(l_extendedprice) AS best FROM lineitem GROUP BY 1), r AS (SELECT l_partkey FROM b ORDER BY best, l_partkey LIMIT 20)
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM r)""")
def top_codes_all_rows(spark, sf_dir):
    """All rows of the 20 keys with the best scores."""
    rows = t(spark, sf_dir, "lineitem")
    best = rows.groupBy("l_partkey").agg(F.min("l_extendedprice").alias("best")).orderBy("best", "l_partkey").limit(20)
    return rows.join(F.broadcast(best.select("l_partkey")), "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@register("parsed_dates", "SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y, %H:%M:%S') AS stamp, strptime(strftime(o_orderdate, '%m/%d/%Y, %H:%M:%S'), '%m/%d/%Y, %H:%M:%S') AS parsed FROM orders")
def parsed_dates(spark, sf_dir):
    stamp = F.date_format("o_orderdate", "MM/dd/yyyy, HH:mm:ss")
    return t(spark, sf_dir, "orders").select("o_orderkey", stamp.alias("stamp"), F.to_timestamp(stamp, "MM/dd/yyyy, HH:mm:ss").cast("timestamp_ntz").alias("parsed"))


@register("nanoseconds", "SELECT event_id, value * 1000000 / 1000000 AS ms, floor(value * 1000000 / 1000)::BIGINT AS us FROM events WHERE value IS NOT NULL")
def nanoseconds(spark, sf_dir):
    ns = F.col("value") * 1000000
    return t(spark, sf_dir, "events").where("value is not null").select("event_id", (ns / 1000000).alias("ms"), F.floor(ns / 1000).alias("us"))
