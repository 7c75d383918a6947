"""Starts and loops of searches towards targets; every generation is one written table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ranking import top_k


def feed_queue(scored: DataFrame, targets: DataFrame, width: int) -> DataFrame:
    """(target, node, score): the best ``width`` cached samples of each target; a target without any
    gets one row with a null node and the score infinity, for which the loader's first row stands."""
    best = top_k(scored.where(F.col("node").isNotNull()), ["target"], ["score", "node"], width).drop("rank")
    return targets.select("target").distinct().join(best, "target", "left").withColumn("score", F.coalesce("score", F.lit(float("inf"))))


def closure(edges: DataFrame, roots: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(root, node) for all nodes that edges (a, b) lead to from each root, on any graph: a round takes one
    step from what the last one found and drops what was reached before. Null ends lead nowhere."""
    step = edges.where("a is not null and b is not null").select("a", F.col("b").alias("next")).distinct()
    found = new = save(roots.select("root").distinct().join(step, F.col("root") == F.col("a")).select("root", F.col("next").alias("node")))
    while not new.isEmpty():
        fresh = new.join(step, F.col("node") == F.col("a")).select("root", F.col("next").alias("node")).distinct()
        new = save(fresh.join(found, ["root", "node"], "left_anti"))
        found = found.unionByName(new)
    return found


def mutation_beam(feeds: DataFrame, mutate: Callable[[DataFrame], DataFrame], width: int, depth: int, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(target, node, score, generation) of the last beam of each target.

    feeds: (target, node, score). A generation takes the beam and its mutants, each node once, and
    keeps the best ``width``. A target goes on while the sum of its beam's scores falls, for ``depth``
    generations at most; its parents stay in the beam where mutants are worse. ``save`` writes a
    generation and reads it again."""
    order = Window.partitionBy("target").orderBy("score", "node")
    best = lambda rows: rows.groupBy("target", "node").agg(F.min("score").alias("score")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= width).drop("_r")
    total = lambda rows, name: rows.groupBy("target").agg(F.sum("score").alias(name), F.count("*").alias(f"{name}_n"))
    beam = save(best(feeds.select("target", "node", "score")).withColumns({"generation": F.lit(0), "open": F.lit(True)}))
    for generation in range(1, depth + 1):
        going = beam.where("open")
        if going.isEmpty():
            break
        new = save(best(going.select("target", "node", "score").unionByName(mutate(going.select("target", "node", "score")).select("target", "node", "score"))))
        # a beam that has grown to its width has gained rows, not distance
        better = total(going, "old").join(total(new, "new"), "target").where("new < old or new_n > old_n").select("target")
        grown = new.join(better, "target", "left_semi").withColumns({"generation": F.lit(generation), "open": F.lit(True)})
        ended = going.join(better, "target", "left_anti").withColumn("open", F.lit(False))
        beam = save(beam.where("not open").unionByName(grown).unionByName(ended))
    return beam.drop("open")
