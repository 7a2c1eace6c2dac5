"""Grouped statistics behind the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order of templates in reports; others come last.
TEMPLATE_ORDER = ("_", "_ or _", "_ or _ or _", "_ that are also _", "_ that are also both _ and _", "_ that are also _ but not _", "_ that are not _")


def mean_by_key(rows: DataFrame, key: Column, values: list[str]) -> DataFrame:
    """Means and the number of rows by any expression."""
    return rows.groupBy(key.alias("key")).agg(*(F.avg(v).alias(v) for v in values), F.count("*").alias("n"))


def mean_stderr(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, standard error (0 for one row) and count by group."""
    error = F.coalesce(F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0))
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), error.alias("stderr"), F.count(value).alias("n"))


def invert(ea: DataFrame) -> DataFrame:
    return ea.groupBy("attr").agg(F.sort_array(F.collect_set("entity")).alias("entities"))


def template_place(template: Column) -> Column:
    """Its place in reports; 99 for others."""
    place = F.array_position(F.array(*(F.lit(t) for t in TEMPLATE_ORDER)), template)
    return F.when(place > 0, place - 1).otherwise(99).cast("int")


def template_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("template").agg(F.count("*").alias("n")).orderBy(template_place(F.col("template")), "template")


def template_stats(rows: DataFrame) -> DataFrame:
    """(place, template, queries, avg_docs) of all templates, zeros where there is none, and a total, whose mean is null where there is none at all."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(i, t, int(i == len(TEMPLATE_ORDER))) for i, t in enumerate((*TEMPLATE_ORDER, "TOTAL"))], "place int, template string, total int")
    rolled = rows.rollup("template").agg(F.count("*").alias("queries"), F.avg("num_docs").alias("avg_docs"), F.grouping("template").cast("int").alias("total"))
    # a rollup of no rows has no total: both kinds come from the list of places
    rolled = rolled.withColumn("template", F.when(F.col("total") == 1, "TOTAL").otherwise(F.col("template")))
    mean = F.when(F.col("total") == 1, F.col("avg_docs")).otherwise(F.coalesce("avg_docs", F.lit(0.0)))
    joined = every.join(rolled, ["template", "total"], "left")
    return joined.select("place", "template", F.coalesce("queries", F.lit(0).cast("long")).alias("queries"), mean.alias("avg_docs")).orderBy("place")


def pivot_metric(rows: DataFrame, keys: list[str], cutoffs: tuple[int, ...] = (1, 3, 5, 10), value: str = "score") -> DataFrame:
    """A row by keys, a column by cutoff."""
    named = rows.withColumn("_k", F.concat(F.lit("at_"), F.col("cutoff").cast("string")))
    return named.groupBy(*keys).pivot("_k", [f"at_{k}" for k in cutoffs]).agg(F.avg(value))


def detail_metrics(details: DataFrame, keys: list[str], cutoffs: list[int]) -> DataFrame:
    """Means by model, context and method of rows that carry is_gold: gold is what was retrieved and is gold."""
    from rankloom.operators.metrics import macro, over

    by = [*keys, "query_id"]
    parts = [F.count("*").alias("n_ranked"), F.sum("is_gold").alias("n_gold"), F.min(F.when(F.col("is_gold") == 1, F.col("rank"))).alias("first_hit")]
    for k in cutoffs:
        hit = (F.col("is_gold") == 1) & (F.col("rank") <= k)
        parts += [F.count_if(hit).alias(f"h{k}"), F.coalesce(F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias(f"d{k}")]
    from rankloom.operators.metrics import f1, idcg, ndcg, precision, recall

    long = details.groupBy(*by).agg(*parts).select(*by, "n_ranked", "n_gold", "first_hit", F.explode(F.array(*(F.struct(F.lit(k).alias("cutoff"), F.col(f"h{k}").alias("hits"), F.col(f"d{k}").alias("dcg")) for k in cutoffs))).alias("x")).select(*by, "n_ranked", "n_gold", "first_hit", "x.*")
    scored = long.withColumns({"recall": recall(), "precision": precision(), "f1": f1(precision(), recall()), "ndcg": ndcg(), "idcg": idcg(), "rr": F.coalesce(over(F.lit(1), F.col("first_hit")), F.lit(0.0))})
    return macro(scored, *keys, metrics=("recall", "precision", "f1", "ndcg", "rr"))


def confusion(rows: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Gold by prediction; labels other than True, False and Uncertain count as Error."""
    labels = ["True", "False", "Uncertain", "Error"]
    known = F.when(F.col(predicted).isin(*labels[:3]), F.col(predicted)).otherwise("Error")
    return rows.withColumn("_p", known).groupBy(gold).pivot("_p", labels).count().na.fill(0)


def mean_or_zero(rows: DataFrame, *values: str) -> DataFrame:
    return rows.agg(*(F.coalesce(F.avg(v), F.lit(0.0)).alias(v) for v in values))


def majority(rows: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """The most frequent answer; of equally frequent ones the smallest."""
    counted = rows.groupBy(*keys, answer).agg(F.count("*").alias("votes"))
    order = Window.partitionBy(*keys).orderBy(F.desc("votes"), answer)
    return counted.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def histogram(rows: DataFrame, value: str, bins: int = 50, keys: list[str] | None = None) -> DataFrame:
    """(bin, least, most, n): equal bins between the least and the largest value; empty bins are absent."""
    keys = keys or []
    ends = rows.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    joined = rows.join(ends, keys) if keys else rows.join(F.broadcast(ends))  # one row
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins).otherwise(1.0)
    b = F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    return joined.where(F.col(value).isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.count("*").alias("n"))


def size_summary(rows: DataFrame, docs: str = "docs") -> DataFrame:
    return rows.agg(F.min(F.size(docs)).alias("min_docs"), F.avg(F.size(docs)).alias("avg_docs"), F.max(F.size(docs)).alias("max_docs"))


def relative_shade(rows: DataFrame, value: str, key: str) -> DataFrame:
    """(value - least) / (largest - least or 1) within each group."""
    w = Window.partitionBy(key)
    spread = F.max(value).over(w) - F.min(value).over(w)
    return rows.withColumn("shade", (F.col(value) - F.min(value).over(w)) / F.when(spread == 0, 1.0).otherwise(spread))


def grid_limits(rows: DataFrame, value: str, step: float = 0.05) -> DataFrame:
    """Axis limits snapped outwards to a grid."""
    return rows.agg((F.floor(F.min(value) / step) * step).alias("low"), (F.ceil(F.max(value) / step) * step).alias("high"))


def sanity_counts(rows: DataFrame) -> DataFrame:
    """Predictions without ratings, without articles on either side, without a hit, and with both faults."""
    no_ratings = F.coalesce(F.size("relevance_ratings"), F.lit(0)) <= 0
    no_hit = ~F.coalesce(F.exists(F.map_values("pred_maps"), lambda x: x), F.lit(False))
    no_gold, no_pred = (F.exists(c, lambda d: d["wikipedia_text"].isNull()) for c in ("gold_doc_metadata", "pred_docs_metadata"))
    return rows.agg(F.count_if(no_ratings).alias("missing_ratings"), F.count_if(no_gold).alias("gold_without_text"), F.count_if(no_pred).alias("pred_without_text"), F.count_if(no_hit).alias("no_hit"), F.count_if(no_hit & no_ratings).alias("no_hit_no_ratings"), F.count("*").alias("n"))
