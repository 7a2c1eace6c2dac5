"""Re-ranking of candidates and the filters around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import metrics
from rankloom.operators.joins import Judgments, with_relevance
from rankloom.operators.ranking import by_probability, by_score_stable, by_verdict


def candidates(run: DataFrame, k: int = 100) -> DataFrame:
    """The first k results of each query."""
    return run.where(F.col("rank") <= k)


def rerank(run: DataFrame, scored: DataFrame, stable: bool = False) -> DataFrame:
    """Candidates by probability (id descending among equals) or, ``stable``, by score in their former order."""
    joined = run.select("qid", "docid", "rank").join(scored.select("qid", "docid", "p"), ["qid", "docid"], "left").na.fill({"p": 0.0})
    return by_score_stable(joined, "p", "rank") if stable else by_probability(joined, "p")


def gated_rerank(run: DataFrame, scored: DataFrame, qrels: Judgments) -> DataFrame:
    """Queries with a gold candidate and a probability for every candidate are re-ranked; the others keep their ranks.

    The gate reads gold labels: it measures what re-ranking can do, it is no retrieval method.
    """
    joined = with_relevance(run, qrels).join(scored.select("qid", "docid", "p"), ["qid", "docid"], "left")
    gate = joined.groupBy("qid").agg((F.max(F.col("rel").cast("int")) * F.min(F.col("p").isNotNull().cast("int")) == 1).alias("open"))
    marked = joined.join(gate, "qid")
    new = by_probability(marked.where("open").select("qid", "docid", "p", F.col("rank").alias("was")), "p").select("qid", "docid", "rank", "was")
    old = marked.where("not open").select("qid", "docid", "rank", F.col("rank").alias("was"))
    return new.unionByName(old)


def hit_gate(run: DataFrame, qrels: Judgments) -> DataFrame:
    """(qid, hits): queries with at least one gold result."""
    return with_relevance(run, qrels).where("rel").groupBy("qid").agg(F.count("*").alias("hits"))


def verdict_rerank(run: DataFrame, verdicts: DataFrame) -> DataFrame:
    """True verdicts first; a document without a verdict counts as not true."""
    return by_verdict(run.join(verdicts.select("qid", "docid", "verdict"), ["qid", "docid"], "left"))


def verdict_metrics(run: DataFrame, verdicts: DataFrame, qrels: Judgments, cutoffs: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(cutoff, num_queries, precision, mrr) of a run that was re-ranked by verdicts: means over the queries that have judgments."""
    scores = metrics.per_query(verdict_rerank(run, verdicts).select("qid", "docid", "rank"), qrels, list(cutoffs))
    return scores.groupBy("cutoff").agg(F.count("*").alias("num_queries"), F.avg("precision").alias("precision"), F.avg("rr").alias("mrr"))


def above_threshold(examples: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    """Examples whose documents are those of exp(score) above the threshold, in their order; scores are cleared."""
    kept = scored.where(F.exp("score") > threshold).select("query", F.col("title").alias("_doc")).distinct()
    items = examples.select("query", F.posexplode("docs").alias("_pos", "_doc")).join(kept, ["query", "_doc"], "left_semi")
    docs = items.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_pos", "_doc"))).alias("_d")).select("query", F.transform("_d", lambda x: x["_doc"]).alias("_docs"))
    empty = F.array().cast("array<string>")
    return examples.join(docs, "query", "left").withColumn("docs", F.coalesce("_docs", empty)).withColumn("scores", F.lit(None).cast("array<double>")).drop("_docs").select(*examples.columns, *([] if "scores" in examples.columns else ["scores"]))


def guard(rows: DataFrame, ok: str, message: str, column: str) -> DataFrame:
    """``rows``; reading a row that is not ``ok`` fails with the message."""
    kind = rows.schema[column].dataType
    return rows.withColumn(column, F.when(F.expr(f"not coalesce({ok}, false)"), F.raise_error(message).cast(kind)).otherwise(F.col(column)))


def only_relevant_labels(rows: DataFrame, label: str = "label") -> DataFrame:
    return guard(rows, f"{label} = 'relevant'", "a label is not 'relevant'", label)


def with_gold(rows: DataFrame, docs: str = "docs") -> DataFrame:
    return guard(rows, f"size({docs}) > 0", "an example has no gold documents", docs)
