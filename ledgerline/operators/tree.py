"""Trees from edges: closures, paths in reading order, pruning."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def layout(edges: DataFrame) -> DataFrame:
    """id, parent, level, path of every node below the roots, by a recursive query; ``path`` sorts in reading order, and
    ``ids`` holds it as an array, whatever characters the ids have.

    ``edges`` are (parent, child); repeated edges count once, and a root is a parent that is no child. A node that stands
    on its own path is not gone into again, so cycles below a root end; nodes that no root reaches (cycles by themselves)
    come as roots of their own, the smallest id of each first. Depth is bounded only by the length of paths.
    """
    spark, name = edges.sparkSession, f"edges_{uuid.uuid4().hex}"
    pairs = edges.select(F.col("parent").cast("string").alias("parent"), F.col("child").cast("string").alias("child")).where("parent IS NOT NULL AND child IS NOT NULL").distinct()

    def walk(roots: DataFrame) -> DataFrame:
        pairs.createOrReplaceTempView(name)
        roots.createOrReplaceTempView(f"{name}_roots")
        return spark.sql(f"""
            WITH RECURSIVE tree(id, parent, level, path, ids) MAX RECURSION LEVEL 100000 AS (
              SELECT id, CAST(NULL AS STRING), 0, id, array(id) FROM {name}_roots
              UNION ALL
              SELECT e.child, e.parent, t.level + 1, concat(t.path, '/', e.child), array_append(t.ids, e.child)
              FROM tree t JOIN {name} e ON t.id = e.parent WHERE NOT array_contains(t.ids, e.child))
            SELECT id, parent, level, path, ids FROM tree""")

    nodes = pairs.select(F.col("parent").alias("id")).distinct()
    laid = walk(nodes.join(pairs.select(F.col("child").alias("id")), "id", "left_anti"))
    while True:
        # Cycles by themselves are rare: one more walk for each that is left.
        lost = nodes.join(laid.select("id"), "id", "left_anti").agg(F.min("id")).first()[0]
        if lost is None:
            return laid
        laid = laid.unionByName(walk(spark.createDataFrame([(lost,)], "id string")))


def closure(laid: DataFrame) -> DataFrame:
    """(ancestor, id) of every node with itself and all above it."""
    return laid.select(F.explode("ids").alias("ancestor"), "id").distinct()


def pruned(laid: DataFrame, valued: DataFrame) -> DataFrame:
    """Nodes that have a value (``valued``: id) or a descendant with one, with the depth counted from the highest kept."""
    keep = closure(laid).join(valued.select("id").distinct(), "id", "left_semi").select(F.col("ancestor").alias("id")).distinct()
    kept = laid.join(keep, "id", "left_semi")
    top = kept.agg(F.min("level").alias("_top"))
    return kept.crossJoin(F.broadcast(top)).withColumn("level", F.col("level") - F.col("_top")).drop("_top")  # one row
