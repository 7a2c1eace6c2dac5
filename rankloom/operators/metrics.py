"""Ranking metrics with binary relevance, from one pass over the run and one aggregate by query."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.joins import Judgments, common_queries, judged
from rankloom.operators.ranking import first_queries


def per_query(run: DataFrame, qrels: Judgments, cutoffs: list[int], missing: str = "drop", dedupe: bool = False) -> DataFrame:
    """(qid, cutoff, n_gold, hits, distinct_hits, n_ranked, recall, set_recall, precision, f1, dcg, idcg, ndcg, rr, mrecall).

    ``missing='drop'`` leaves out queries without gold or without results; ``'zero'`` keeps queries of
    either side with zeros.  A document that a run lists twice counts twice, unless ``dedupe``.
    A null docid in ``qrels`` marks a query without gold.  Judgments by label (:class:`~rankloom.operators.joins.ByLabel`) are not made into pairs.
    """
    if not cutoffs or min(cutoffs) < 1:
        raise ValueError("cutoffs must be positive")
    gold = judged(qrels)
    n_gold = gold.sizes()
    if dedupe:
        run = run.groupBy("qid", "docid").agg(F.min("rank").alias("rank"))
    marked = gold.marked(run.select("qid", "docid", "rank"))
    # one row for each document of a query, then one for each query: distinct hits need no copy of the rows
    inside = lambda k: F.col("rank") <= k
    own, parts = [F.count("*").alias("n"), F.min("rank").alias("best")], [F.sum("n").alias("n_ranked"), F.min(F.when(F.col("rel"), F.col("best"))).alias("first_hit")]
    for k in cutoffs:
        own += [F.count_if(inside(k)).alias(f"h{k}"), F.coalesce(F.sum(F.when(inside(k), 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias(f"d{k}")]
        hit = lambda c: F.when(F.col("rel"), c).otherwise(0)
        parts += [F.sum(hit(F.col(f"h{k}"))).alias(f"h{k}"), F.count_if(F.col("rel") & (F.col("best") <= k)).alias(f"s{k}"), F.sum(hit(F.col(f"d{k}"))).alias(f"d{k}")]
    counted = marked.groupBy("qid", "docid", "rel").agg(*own).groupBy("qid").agg(*parts)
    joined = counted.join(n_gold, "qid", "inner" if missing == "drop" else "full")
    if missing == "drop":
        joined = joined.where("n_gold > 0")
    zero = joined.na.fill(0)
    long = zero.select("qid", "n_gold", "n_ranked", "first_hit", F.explode(F.array(*(F.struct(F.lit(k).alias("cutoff"), F.col(f"h{k}").alias("hits"), F.col(f"s{k}").alias("distinct_hits"), F.col(f"d{k}").alias("dcg")) for k in cutoffs))).alias("x")).select("qid", "n_gold", "n_ranked", "first_hit", "x.*")
    return long.select(
        "qid", "cutoff", "n_gold", "hits", "distinct_hits", "n_ranked", recall().alias("recall"), over(F.col("distinct_hits"), F.col("n_gold")).alias("set_recall"), precision().alias("precision"), f1(precision(), recall()).alias("f1"),
        "dcg", idcg().alias("idcg"), ndcg().alias("ndcg"), reciprocal_rank().alias("rr"), mrecall().alias("mrecall"),
    )


def over(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def recall() -> Column:
    return over(F.col("hits"), F.col("n_gold"))


def precision() -> Column:
    """Hits over the cutoff, however few results there are; 0 without results."""
    return F.when(F.col("n_ranked") > 0, over(F.col("hits"), F.col("cutoff"))).otherwise(0.0)


def f1(p: Column, r: Column) -> Column:
    return over(2 * p * r, p + r)


def idcg(n: Column | None = None, k: Column | None = None) -> Column:
    """Of a ranking that starts with all gold documents."""
    places = F.least(F.col("n_gold") if n is None else n, F.col("cutoff") if k is None else k).cast("int")
    return F.when(places > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(places, F.lit(1))), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))).otherwise(0.0)


def ndcg() -> Column:
    return over(F.col("dcg"), idcg())


def reciprocal_rank() -> Column:
    return over(F.lit(1), F.col("first_hit"))


def mrecall() -> Column:
    """1 if all gold documents are within the cutoff."""
    return F.when((F.col("n_gold") > 0) & (F.col("distinct_hits") == F.col("n_gold")), 1.0).otherwise(0.0)


METRICS = ("recall", "set_recall", "precision", "f1", "ndcg", "rr", "mrecall")


def macro(scores: DataFrame, *keys: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Means over queries, by cutoff and further keys."""
    return scores.groupBy(*keys, "cutoff").agg(*(F.avg(m).alias(m) for m in metrics), F.count("*").alias("num_queries"))


def evaluate(run: DataFrame, qrels: Judgments, cutoffs: list[int] | None = None, most: int | None = None, missing: str = "drop", dedupe: bool = False, check: bool = True) -> DataFrame:
    """Macro means; over the first ``most`` ids in the order of text if given.  Fails if no query is on both sides.

    The check is an action of its own; without ``check`` there are just no rows then.
    """
    cutoffs = cutoffs or [5, 20, 100]
    gold = judged(qrels)
    queries = first_queries(common_queries(gold.queries(), run) if missing == "drop" else gold.sizes(), most)
    scores = per_query(run.join(queries, "qid", "left_semi"), gold.of(queries), cutoffs, missing, dedupe)
    return guarded(macro(scores), queries) if check else macro(scores)


def guarded(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """The rows; fails if there is no query at all."""
    if queries.isEmpty():
        raise ValueError("no query is in both the run and the judgments")
    return rows


def compare(one: DataFrame, two: DataFrame, qrels: Judgments, cutoffs: list[int] | None = None) -> DataFrame:
    """Two runs side by side over the queries that both answer."""
    gold = judged(qrels)
    shared = common_queries(gold.sizes(), one, two)
    gold = gold.of(shared)
    means = [macro(per_query(r.join(shared, "qid", "left_semi"), gold, cutoffs or [5, 20, 100])).select("cutoff", *(F.col(m).alias(f"{m}_{i}") for m in METRICS), *(["num_queries"] if i == 1 else [])) for i, r in enumerate((one, two), 1)]
    return means[0].join(means[1], "cutoff").withColumns({f"{m}_diff": F.col(f"{m}_2") - F.col(f"{m}_1") for m in METRICS}).orderBy("cutoff")


def case_mismatches(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, exact, lower) of queries that match nothing exactly, but something in lower case."""
    pairs = run.select("qid", "docid").distinct()
    exact = pairs.join(qrels, ["qid", "docid"], "left_semi").groupBy("qid").agg(F.count("*").alias("exact"))
    low = qrels.select("qid", F.lower("docid").alias("docid")).distinct()
    lower = pairs.select("qid", F.lower("docid").alias("docid")).distinct().join(low, ["qid", "docid"], "left_semi").groupBy("qid").agg(F.count("*").alias("lower"))
    return lower.join(exact, "qid", "left").select("qid", F.coalesce("exact", F.lit(0)).cast("long").alias("exact"), "lower").where("exact = 0 and lower > 0")


def by_spec(run: DataFrame, qrels: Judgments, spec: str) -> DataFrame:
    """(qid, score) for a text like ``ndcg@20`` or ``recall@100``."""
    found = re.fullmatch(r"(recall|ndcg|precision|f1|mrecall|set_recall)@(\d+)", spec.strip().lower())
    if not found:
        raise ValueError(f"unknown metric {spec}")
    return per_query(run, qrels, [int(found[2])]).select("qid", F.col(found[1]).alias("score"))


def set_scores(predicted: DataFrame, qrels: Judgments) -> DataFrame:
    """(qid, tp, precision, recall, f1) over distinct documents without a cutoff; zeros where nothing is hit."""
    gold, pred = judged(qrels), predicted.select("qid", "docid").where("docid is not null").distinct()
    found = gold.marked(pred).groupBy("qid").agg(F.count("*").alias("n_pred"), F.count_if("rel").alias("tp"))
    joined = gold.sizes().where("n_gold > 0").join(found, "qid", "left").na.fill(0)
    p, r = over(F.col("tp"), F.col("n_pred")), over(F.col("tp"), F.col("n_gold"))
    return joined.select("qid", "tp", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def threshold_sweep(scored: DataFrame, qrels: Judgments, step: float = 0.05, n: int = 20) -> DataFrame:
    """Mean set precision, recall and F1 at thresholds 0, step, ... over queries with gold; a prediction counts above the threshold.

    Each prediction counts at all thresholds below it: one cumulative pass over at most n buckets a query, no join with the thresholds.
    """
    gold = judged(qrels)
    n_gold = gold.sizes().where("n_gold > 0")
    best = scored.groupBy("qid", "docid").agg(F.max("p").alias("p"))
    marked = gold.marked(best).withColumn("rel", F.col("rel").cast("int"))
    thresholds = F.array(*(F.lit(round(i * step, 10)) for i in range(n)))
    passed = F.size(F.filter(thresholds, lambda t: F.col("p") > t))
    counts = marked.withColumn("passed", passed).where("passed > 0").groupBy("qid", "passed").agg(F.count("*").alias("n"), F.sum("rel").alias("tp"))
    per = counts.groupBy("qid").agg(F.collect_list(F.struct("passed", "n", "tp")).alias("c"))
    joined = n_gold.join(per, "qid", "left").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    total = lambda name: F.aggregate(F.filter(F.coalesce("c", F.array().cast("array<struct<passed:int,n:bigint,tp:bigint>>")), lambda x: x["passed"] > F.col("i")), F.lit(0).cast("long"), lambda acc, x: acc + x[name])
    rows = joined.select("i", "n_gold", total("n").alias("n_pred"), total("tp").alias("tp"))
    p, r = over(F.col("tp"), F.col("n_pred")), over(F.col("tp"), F.col("n_gold"))
    scores = rows.select(F.round(F.col("i") * step, 10).alias("threshold"), p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))
    return scores.groupBy("threshold").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.count("*").alias("num_queries"))


#: Cutoffs of the baseline table.
BASELINE_CUTOFFS = [1, 3, 5, 10, 20]


def baseline_table(run: DataFrame, qrels: Judgments, method: str) -> DataFrame:
    """One wide row of means at the baseline's cutoffs, and MRR."""
    scores = per_query(run, qrels, BASELINE_CUTOFFS)
    wide = [F.avg(F.when(F.col("cutoff") == k, F.col(m))).alias(f"{m}_at_{k}") for m in ("precision", "recall", "f1", "ndcg") for k in BASELINE_CUTOFFS]
    return scores.agg(*wide, F.avg("rr").alias("mrr")).select(F.lit(method).alias("method"), "*")


def latex_row(name: str, means: DataFrame, cutoffs: tuple[int, ...] = (5, 20, 100)) -> str:
    """A table row: recall at each cutoff, then nDCG; places without a value are dashes."""
    rows = {r["cutoff"]: r for r in means.where(F.col("cutoff").isin(*cutoffs)).collect()}
    cell = lambda k, m: f"{rows[k][m]:.4f}" if k in rows else "--"
    return " & ".join([name, *(cell(k, "recall") for k in cutoffs), *(cell(k, "ndcg") for k in cutoffs)]) + r" \\"
