"""Set operations, deduplication, upserts, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import dedup, ranking
from corpusloom.plans.catalog import register
from corpusloom.plans.q_relational import t


def _hashed(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


@register("union_first_wins", "SELECT sha256(text) AS sha, arg_min(doc_id, (CASE WHEN lang = 'en' THEN 0 ELSE 1 END, doc_id)) AS doc_id FROM documents GROUP BY 1")
def union_first_wins(spark, sf_dir):
    """Two databases (English, others) as one; the first text of each hash stays."""
    d = _hashed(spark, sf_dir).select("doc_id", "lang", "sha")
    both = dedup.union_first_wins([d.where("lang = 'en'"), d.where("lang <> 'en'")], "sha", ["doc_id"])
    return both.select("sha", "doc_id")


@register("union_minus_existing", "SELECT min(doc_id) AS doc_id, sha256(text) AS sha FROM documents WHERE doc_id >= 300 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id < 300) GROUP BY 2")
def union_minus_existing(spark, sf_dir):
    d = _hashed(spark, sf_dir).select("doc_id", "sha")
    return dedup.insert_absent(d.where("doc_id < 300"), d.where("doc_id >= 300"), "sha", ["doc_id"])


@register("shards_with_offset", """
SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, doc_id) - 1 AS new_id FROM documents""")
def shards_with_offset(spark, sf_dir):
    """Shards one after another, ids renumbered, nothing dropped."""
    d = t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", 0).otherwise(1).alias("shard"))
    return ranking.numbered_rows(d, [F.col("shard"), F.col("doc_id")], "new_id").select("doc_id", "new_id")


@register("content_dedup", r"SELECT sha256(regexp_replace(text, '[ \n]', '', 'g')) AS key, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def content_dedup(spark, sf_dir):
    """First document of each content, spaces and line ends apart."""
    return t(spark, sf_dir, "documents").groupBy(tx.content_key(F.col("text")).alias("key")).agg(F.min("doc_id").alias("doc_id"))


@register("vector_dedup", """
SELECT round(embedding[1]::DOUBLE, 1) + 0.0::DOUBLE AS a, round(embedding[2]::DOUBLE, 1) + 0.0::DOUBLE AS b, min(label) AS label, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS names FROM embeddings GROUP BY 1, 2""")
def vector_dedup(spark, sf_dir):
    """Equal vectors once, with the names of all of them."""
    v = t(spark, sf_dir, "embeddings").select("vec_id", "label", *[(F.round(F.get("embedding", F.lit(k)).cast("double"), 1) + 0.0).alias(n) for k, n in ((0, "a"), (1, "b"))])
    names = F.array_join(F.transform(F.array_sort(F.collect_list("vec_id")), lambda x: x.cast("string")), ",")
    return v.groupBy("a", "b").agg(F.min("label").alias("label"), names.alias("names"))


@register("whole_vector_dedup", """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: round(x::DOUBLE, 1) + 0.0::DOUBLE) AS f FROM embeddings)
SELECT vec_id, min(vec_id) OVER (PARTITION BY f) AS first_id, min(label) OVER (PARTITION BY f) AS label FROM v""")
def whole_vector_dedup(spark, sf_dir):
    """Vectors equal in all components (to 0.1): each with the first of them and its least label, a row for each name."""
    f = F.transform("embedding", lambda x: F.round(x.cast("double"), 1) + 0.0)
    v = t(spark, sf_dir, "embeddings").select("vec_id", "label", f.alias("f"))
    least = v.groupBy("f").agg(F.min("vec_id").alias("first_id"), F.min("label").alias("label"))
    return v.select("vec_id", "f").join(least, "f").select("vec_id", "first_id", "label")


@register("unique_pairs_first_group", "SELECT l_quantity, l_tax, arg_min(l_returnflag, (l_returnflag, l_orderkey, l_linenumber)) AS grp FROM lineitem GROUP BY 1, 2")
def unique_pairs_first_group(spark, sf_dir):
    """Each pair of values once over all groups; the first group has it."""
    rows = t(spark, sf_dir, "lineitem").select("l_quantity", "l_tax", "l_returnflag", "l_orderkey", "l_linenumber")
    return dedup.first_per_key(rows, ["l_quantity", "l_tax"], ["l_returnflag", "l_orderkey", "l_linenumber"]).select("l_quantity", "l_tax", F.col("l_returnflag").alias("grp"))


@register("upsert_frequency", "SELECT sha256(text) AS sha, count(*)::BIGINT AS frequency FROM documents GROUP BY 1")
def upsert_frequency(spark, sf_dir):
    """Two batches of texts counted by hash, the second merged into the first."""
    d = _hashed(spark, sf_dir)
    old = d.where("doc_id < 500").groupBy("sha").agg(F.count("*").alias("frequency"))
    return dedup.upsert_frequency(old, d.where("doc_id >= 500"), "sha")


@register("upsert_lists", """
WITH a AS (SELECT source, list_sort(list(doc_id)) AS ids FROM documents WHERE doc_id < 500 GROUP BY 1), b AS (SELECT source, list_sort(list(doc_id)) AS ids FROM documents WHERE doc_id >= 500 GROUP BY 1)
SELECT source, array_to_string(list_concat(coalesce(a.ids, []), coalesce(b.ids, [])), ',') AS ids FROM a FULL JOIN b USING (source)""")
def upsert_lists(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    lists = [d.where(c).groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("ids")) for c in ("doc_id < 500", "doc_id >= 500")]
    return dedup.upsert_lists(*lists, "source", ["ids"]).select("source", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@register("upsert_list_rows", "SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, doc_id FROM documents")
def upsert_list_rows(spark, sf_dir):
    """upsert_lists as rows: the ids of each source, old before new, numbered by range partitions."""
    d = ranking.numbered_rows(t(spark, sf_dir, "documents").select("source", "doc_id"), [F.col("source"), F.col("doc_id")])
    first = d.groupBy("source").agg(F.min("row_num").alias("first"))
    return d.join(first, "source").select("source", (F.col("row_num") - F.col("first")).cast("long").alias("place"), "doc_id")


@register("equal_chunks", "SELECT doc_id, least(floor((row_number() OVER (ORDER BY doc_id) - 1) / (count(*) OVER () // 7))::BIGINT, 6) AS chunk FROM documents")
def equal_chunks(spark, sf_dir):
    """Seven equal parts; the rest goes to the last."""
    d = t(spark, sf_dir, "documents").select("doc_id")
    n = d.count()
    return ranking.numbered_rows(d, [F.col("doc_id")]).select("doc_id", dedup.chunk_of(F.col("row_num"), F.lit(n), 7).alias("chunk"))


@register("suffixed_names", """
SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name, p_brand) > 1 THEN p_name || '-' || row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) ELSE p_name END AS name FROM part""")
def suffixed_names(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", F.concat_ws("\x00", "p_name", "p_brand").alias("key"))
    named = dedup.suffix_duplicates(p, "key", ["p_partkey"])
    name = F.concat(F.split("key", "\x00")[0], F.regexp_extract("key", "(-[0-9]+)$", 1))
    return named.select("p_partkey", name.alias("name"))


@register("split_bad_rows", "SELECT doc_id, CASE WHEN n_chars < 100 THEN 'quarantine' ELSE 'good' END AS part FROM documents")
def split_bad_rows(spark, sf_dir):
    """Rows that a bulk insert would refuse go to a quarantine, in one pass and in order."""
    return t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") < 100, "quarantine").otherwise("good").alias("part"))


@register("hash_folds", "SELECT doc_id % 5 AS fold, count(*) AS n FROM documents GROUP BY 1")
def hash_folds(spark, sf_dir):
    return t(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 5).alias("fold")).agg(F.count("*").alias("n"))


@register("train_validation_split", """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= (count(*) OVER () // 100) * 90 THEN 'train' ELSE 'validation' END AS part FROM documents""")
def train_validation_split(spark, sf_dir):
    """90 of every whole hundred rows; what is over the last hundred validates."""
    d = t(spark, sf_dir, "documents").select("doc_id")
    n = d.count()
    return ranking.numbered_rows(d, [F.col("doc_id")]).select("doc_id", F.when(F.col("row_num") < n // 100 * 90, "train").otherwise("validation").alias("part"))


@register("rank_slice", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) WHERE r % 4 = 1 AND r < (n // 4) * 4")
def rank_slice(spark, sf_dir):
    """Every fourth row for rank 1 of 4; rows that don't fill a round are dropped."""
    d = t(spark, sf_dir, "documents").select("doc_id")
    n = d.count()
    return ranking.numbered_rows(d, [F.col("doc_id")]).where((F.col("row_num") % 4 == 1) & (F.col("row_num") < n // 4 * 4)).select("doc_id")
