"""Token and price totals of re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import percent_difference, token_estimate

#: Tokens of a call's instruction and answer.
INSTRUCTION_TOKENS, OUTPUT_TOKENS = 50, 5


def average_tokens(rows: DataFrame, text: str, first: int | None = None) -> DataFrame:
    """The mean estimate, over the first lines if their number is given."""
    own = rows if first is None else rows.where(F.col("line_no") <= first)
    return own.agg(F.coalesce(F.avg(token_estimate(F.col(text))), F.lit(0.0)).alias("avg_tokens"), F.count("*").alias("n"))


def totals(rows: DataFrame, instruction: int = INSTRUCTION_TOKENS, output: int = OUTPUT_TOKENS) -> DataFrame:
    """Calls, tokens and cost of rows (num_queries, calls_per_query, avg_query_tokens, avg_doc_tokens, input_price, output_price; prices for a million)."""
    calls = F.col("num_queries") * F.col("calls_per_query")
    tokens = calls * (instruction + F.col("avg_query_tokens") + F.col("avg_doc_tokens"))
    out = calls * output
    cost = (tokens * F.col("input_price") + out * F.col("output_price")) / 1e6
    return rows.withColumns({"calls": calls, "input_tokens": tokens, "output_tokens": out, "total_cost": cost})


def curated_calls(candidates: DataFrame) -> DataFrame:
    """Calls of curated candidate sets: one for each (qid, docid, kind)."""
    return candidates.agg(F.count("*").alias("calls"), F.count_distinct("qid").alias("num_queries"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("gold", "irrelevant", "noise")))


def usage(rows: DataFrame) -> DataFrame:
    """Means of the token lists (in_tokens, out_tokens); 0 where a list is empty."""
    mean = lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)).otherwise(0.0)
    return rows.withColumns({"avg_in": mean(F.col("in_tokens")), "avg_out": mean(F.col("out_tokens"))})


def compare_costs(rows: DataFrame, base: Column | None = None) -> DataFrame:
    """Costs with their percentage over a base column."""
    return rows.withColumn("difference", percent_difference(F.col("cost"), F.col("base_cost") if base is None else base))
