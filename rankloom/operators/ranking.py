"""Ranks within a query; ties always end in an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _as(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rank_by_given(rows: DataFrame, given: str | Column, place: str | Column, key: str = "qid") -> DataFrame:
    """rank 1..n by a given rank; equal ones in the order of ``place``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(_as(given), _as(place))))


def rank_by_score(rows: DataFrame, score: str, place: str | Column, key: str = "qid") -> DataFrame:
    """rank 1..n by score: ascending if all scores of the query are negative, else descending; ties in the order of ``place``."""
    negative = F.coalesce(F.min(F.coalesce(F.col(score) < 0, F.lit(False))).over(Window.partitionBy(key)), F.lit(True))
    signed = rows.withColumn("_s", F.when(negative, F.col(score)).otherwise(-F.col(score)))
    return signed.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.asc_nulls_last("_s"), _as(place)))).drop("_s")


def all_negative(rows: DataFrame, queries: DataFrame, score: str = "score", key: str = "qid") -> DataFrame:
    """(qid, negative) for every query; true for one without rows."""
    own = rows.groupBy(key).agg(F.bool_and(F.col(score) < 0).alias("negative"))
    return queries.select(key).distinct().join(own, key, "left").select(key, F.coalesce("negative", F.lit(True)).alias("negative"))


def top_k(rows: DataFrame, k: int, *order: Column, key: str = "qid") -> DataFrame:
    """The first k rows of each key with their rank; Spark cuts each task's rows to k before it shuffles them."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def by_probability(rows: DataFrame, p: str = "p", key: str = "qid", doc: str = "docid") -> DataFrame:
    """Probability and id both descending."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(p), F.desc(doc))))


def by_score_stable(rows: DataFrame, score: str = "score", place: str = "rank", key: str = "qid") -> DataFrame:
    """Score descending; ties keep the order they had."""
    return rows.withColumn("_place", F.col(place)).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), "_place"))).drop("_place")


def ranked_hits(rows: DataFrame, k: int, index: str = "idx", score: str = "score", key: str = "qid") -> DataFrame:
    """Results of an index sorted again by score (ties by their place in it); places below 0 are missing hits: left out, though their rank counts."""
    return top_k(rows, k, F.desc(score), F.col(index), key=key).where(F.col(index) >= 0)


def by_verdict(rows: DataFrame, verdict: str = "verdict", key: str = "qid") -> DataFrame:
    """Documents that were found true first, each part in its former order."""
    order = Window.partitionBy(key).orderBy(F.desc(F.coalesce(F.col(verdict) == "True", F.lit(False))), "rank")
    return rows.withColumn("rank", F.row_number().over(order))


def first_queries(queries: DataFrame, n: int | None, key: str = "qid") -> DataFrame:
    """The first n ids in the order of text ("10" before "2")."""
    distinct = queries.select(F.col(key).cast("string").alias(key)).distinct()
    return distinct if n is None else distinct.orderBy(key).limit(n)
