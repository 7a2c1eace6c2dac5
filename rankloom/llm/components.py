"""Connected components by alternating large-star and small-star steps, each a join and an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import release, shared_table, tables_made


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): every node of a link with the smallest node it reaches; ids must be orderable.

    A link of a node with itself counts for nothing, nor does one with a null end; repeated links count once; without links there
    are no rows.  No node's links are gathered in one task: minima are pre-aggregated, and the joins can be split
    where one node has very many links.  Every round's links are written to the shared folder, and the round before deleted.
    """
    x, y = F.col(a), F.col(b)
    edges = links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    before = tables_made()
    edges = shared_table(edges, "links")
    for _ in range(most_rounds):
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("o")).unionAll(edges.select(F.col("v").alias("n"), F.col("u").alias("o")))
        least = both.groupBy("n").agg(F.min(F.least("n", "o")).alias("m"))
        large = both.where("o > n").join(least, "n").select(F.col("o").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        edges = shared_table(small, "links")
        release(before, edges)
        if _is_star(edges):
            break
    else:
        raise RuntimeError(f"components not found within {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _is_star(edges: DataFrame) -> bool:
    """Whether every node has one link down, to a node that has none."""
    roots = edges.select(F.col("v").alias("u")).distinct()
    marks = edges.groupBy("u").agg(F.count("*").alias("n")).unionAll(roots.withColumn("n", F.lit(1).cast("long")))
    return marks.groupBy("u").agg(F.sum("n").alias("n")).where("n > 1").isEmpty()
