"""Findings of round 3: empty results, and work and memory that must not grow faster than the tables."""

import pytest
from pyspark.sql import functions as F

from rankloom.operators import aggregates as A
from rankloom.operators import joins, metrics, rerank, sampling, setalg
from rankloom.plans import catalog, layouts, others  # noqa: F401 (registered by their import)


def test_statistics_of_no_combination_have_a_total(spark):
    rows = spark.createDataFrame([], "template string, num_docs long")
    got = [tuple(r) for r in A.template_stats(rows).collect()]
    assert got == [*((i, t, 0, 0.0) for i, t in enumerate(A.TEMPLATE_ORDER)), (7, "TOTAL", 0, None)]
    one = spark.createDataFrame([("TOTAL", 3), ("_", 4), (None, 8)], rows.schema)  # a template of that name is not the total
    assert [tuple(r) for r in A.template_stats(one).collect() if r["queries"]] == [(0, "_", 1, 4.0), (7, "TOTAL", 3, 5.0)]


def _labelled(spark):
    """Judgments by label and their pairs: ids of two labels, none, null ones, and queries that are no documents."""
    docs = [(i, i % 3) for i in range(40)] + [(4, 2), (10, 0), (10, 1), (41, None), (None, 1), (42, 9)]
    asked = [(i, i, i % 3) for i in range(0, 40, 5)] + [(10, 10, 0), (10, 10, 1), (42, 42, 9), (41, 41, None), (50, 50, 2), (51, 51, 7)]
    gold = joins.ByLabel(spark.createDataFrame(asked, "qid long, own long, label int"), spark.createDataFrame(docs, "docid long, label int"))
    return gold, gold.pairs()


def test_judgments_by_label_equal_their_pairs(spark):
    gold, pairs = _labelled(spark)

    def same(f):
        # means of the same numbers in another order differ in the last digits
        one, two = (sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in f(g).collect()) for g in (gold, pairs))
        assert one == two and one
        return True

    assert sorted(gold.sizes().collect()) == sorted(joins.Pairs(pairs).sizes().collect())
    run = spark.range(0, 60).crossJoin(spark.range(0, 60, 5).select(F.col("id").alias("qid"))).where("(id * 7 + qid) % 4 > 0")
    run = run.select("qid", F.col("id").alias("docid"), F.expr("row_number() over (partition by qid order by (id * 13 + qid) % 61)").alias("rank"))
    scored = run.withColumn("p", (F.col("docid") * 7 % 11) / 11)
    for missing in ("drop", "zero"):
        assert same(lambda g: metrics.per_query(run, g, [1, 5, 20], missing))  # noqa: B023
        assert same(lambda g: metrics.evaluate(run, g, [5], 3, missing))  # noqa: B023
    assert same(lambda g: metrics.set_scores(run, g)) and same(lambda g: metrics.threshold_sweep(scored, g))
    assert same(lambda g: metrics.compare(run, scored.withColumn("rank", F.lit(70) - F.col("rank")), g, [5]))
    assert same(lambda g: rerank.hit_gate(run, g)) and same(lambda g: rerank.gated_rerank(run, scored, g))
    assert same(lambda g: sampling.curated_candidates(g, scored.withColumnRenamed("p", "score")))


def test_search_metrics_make_no_pairs_of_judgments(spark, tmp_path):
    e = spark.range(0, 4000).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 7).cast("float"), F.lit(1).cast("float")).alias("embedding"), F.lit(1).alias("label"))
    e.write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = catalog.dense_ndcg20(spark, str(tmp_path))
        assert [tuple(r)[:1] for r in rows.collect()] == [(40,)]
        # 40 queries of 3,999 gold documents each: no operator gives as many rows
        nodes, most = [rows._jdf.queryExecution().executedPlan()], 0
        while nodes:
            node = nodes.pop()
            of = node.metrics().get("numOutputRows")
            most = max(most, of.get().value() if of.isDefined() else 0)
            nodes += [node.children().apply(i) for i in range(node.children().size())]
        assert 4000 <= most <= 10_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def _shuffled_rows(spark, f):
    """What ``f`` gives and the most rows that one stage of its jobs shuffled."""
    context = spark.sparkContext._jsc.sc()

    def stages():
        context.listenerBus().waitUntilEmpty()
        none, doubles = spark._jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        found = context.statusStore().stageList(none, False, False, doubles, none)
        return {x.stageId(): x.shuffleWriteRecords() for x in map(found.apply, range(found.size()))}

    old, got = stages(), f()
    return got, max(n for i, n in stages().items() if i not in old)


@pytest.mark.parametrize("name", ["metrics_set_recall", "latex_line", "metrics_as_json", "metrics_compare_runs", "metrics_macro", "baseline_row", "metrics_per_query"])
def test_search_metrics_shuffle_no_pairs_of_judgments(spark, tmp_path, name):
    """Each with all its actions: with one label, 40 queries have 3,999 gold documents each, and results are 100 a query and task."""
    e = spark.range(0, 4000, 1, 2).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 7).cast("float"), F.lit(1).cast("float")).alias("embedding"), F.lit(1).alias("label"))
    e.write.parquet(str(tmp_path / "embeddings.parquet"))
    rows, most = _shuffled_rows(spark, lambda: catalog.QUERIES[name](spark, str(tmp_path)).collect())
    assert rows and 4000 <= most <= 16_000  # 159,960 pairs otherwise


def test_counts_of_tries_equal_those_of_their_answers(spark):
    ea = spark.range(0, 400).select((F.col("id") % 41).alias("entity"), F.concat(F.lit("a"), (F.col("id") * F.col("id") % 13).cast("string")).alias("attr"))
    ea = ea.unionAll(spark.createDataFrame([(None, "a1"), (90, None), (91, "only"), (1, "a1")], ea.schema))
    names = [r["attr"] for r in ea.select("attr").distinct().collect()] + ["unknown"]
    asked = [(i * 100 + j, t, [names[(j * (k + 2) + k * k + i) % len(names)] for k in range(n + (j == 7))]) for i, (t, n) in enumerate(setalg.ARITY.items()) for j in range(25)]
    queries = spark.createDataFrame([*asked, (9000, "none such", ["a1"])], "id long, template string, attrs array<string>")
    sizes = ea.distinct().groupBy("attr").agg(F.count("*").alias("n"))
    every = setalg.answers(ea, queries).groupBy("id").agg(F.count("*").alias("num_docs"))
    for least, most in ((1, 1000), (5, 12), (0, 3)):
        want = sorted(map(tuple, every.where(F.col("num_docs").between(least, most)).collect()))
        assert sorted(map(tuple, setalg.answer_counts(setalg.attribute_sets(ea), sizes, queries, least, most).collect())) == want and want


def test_tries_that_sizes_rule_out_are_not_counted(spark):
    """The rows that meet a try grow with the range asked for, not with the relation."""
    ea = spark.range(0, 30_000).select((F.col("id") % 10_000).alias("entity"), F.concat(F.lit("a"), F.expr("cast(id / 10000 as int)").cast("string")).alias("attr"))
    sizes = ea.groupBy("attr").agg(F.count("*").alias("n"))
    queries = spark.createDataFrame([(i, setalg.OR2, ["a0", f"a{1 + i % 2}"]) for i in range(300)], "id long, template string, attrs array<string>")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = setalg.answer_counts(setalg.attribute_sets(ea), sizes, queries, 1, 200)
        assert rows.collect() == []
        nodes, joined = [rows._jdf.queryExecution().executedPlan()], 0
        while nodes:
            node = nodes.pop()
            if "Join" in node.nodeName():
                joined = max(joined, node.metrics().get("numOutputRows").get().value())
            nodes += [node.children().apply(i) for i in range(node.children().size())]
        assert joined <= 600  # 6,000,000 answers otherwise
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_statements_are_dealt_over_all_cores(spark):
    for name in ("statements_split", "logic_extracted"):
        rows = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert spark.read.parquet("/root/testdata/sf0.001/part.parquet").rdd.getNumPartitions() == 1
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_vocabulary_of_documents_is_counted_in_one_pass(spark, monkeypatch):
    from rankloom.operators import wordpieces
    from rankloom.plans import others

    calls, words = [], wordpieces.words
    monkeypatch.setattr(wordpieces, "words", lambda text: calls.append(1) or words(text))
    seen = {}
    monkeypatch.setattr(wordpieces, "cut", lambda d, vocabulary, *a: seen.update(v=vocabulary) or d.withColumn("pieces", F.array(F.lit("x"))))
    others.texts_cut_by_pieces(spark, "/root/testdata/sf0.001")
    plan = seen["v"]._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("Relation") == 4  # the four parts read the words that were kept
