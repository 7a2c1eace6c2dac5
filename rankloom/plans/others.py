"""Registered queries of filters, joins, aggregates, text functions, incremental work and plug-in points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import states
from rankloom.functions import text as T
from rankloom.operators import aggregates as A
from rankloom.operators import boolean, cost, dense, joins, metrics, plugins, ranking, rerank, sampling, setalg, wordpieces
from rankloom.plans.catalog import HABITS_SQL, PAIRS_SQL, RUN_SQL, SCORES_SQL, dense_run, entity_attributes, entity_habits, label_qrels, query, rounded, t
from rankloom.plans.spread import dealt, spread
from rankloom.sources import rankings, records
from rankloom.sources.scratch import kept, scratch
from rankloom.streaming import incremental

s = lambda c: F.col(c).cast("string")


def by_customer(spark, sf) -> DataFrame:
    """(id, docs): a customer's orders as text."""
    return t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list(s("o_orderkey"))).alias("docs"))


# --- filters -----------------------------------------------------------------------------------


@query(f"WITH {HABITS_SQL} SELECT entity FROM z WHERE list_contains(l, '1-URGENT') AND list_contains(l, '5-LOW') AND NOT list_contains(l, 'state F')")
def predicate_scan(spark, sf):
    """Entities that answer a template, by a scan of their attributes."""
    sets = entity_habits(spark, sf).groupBy("entity").agg(F.collect_set("attr").alias("l"))
    return sets.where(setalg.predicate(setalg.AND_NOT, F.col("l"), F.lit("1-URGENT"), F.lit("5-LOW"), F.lit("state F"))).select("entity")


@query("SELECT o_custkey AS query, count(*) FILTER (o_orderkey % 2 = 0) AS kept FROM orders GROUP BY o_custkey")
def examples_above_threshold(spark, sf):
    """Documents whose probability, given as a logarithm, is above a threshold."""
    examples = by_customer(spark, sf).withColumnRenamed("id", "query")
    scored = t(spark, sf, "orders").select(F.col("o_custkey").alias("query"), s("o_orderkey").alias("title"), F.when(F.col("o_orderkey") % 2 == 0, F.log(F.lit(0.6))).otherwise(F.log(F.lit(0.4))).alias("score"))
    return rerank.above_threshold(examples, scored, 0.5).select("query", F.size("docs").cast("long").alias("kept"))


@query("SELECT c_custkey, 'relevant' AS label, count(o_orderkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def guarded_examples(spark, sf):
    """Rows that must have gold documents, and whose label must be right; one that has not would fail the read."""
    rows = by_customer(spark, sf).select(F.col("id").alias("c_custkey"), F.lit("relevant").alias("label"), "docs")
    return rerank.with_gold(rerank.only_relevant_labels(rows)).select("c_custkey", "label", F.size("docs").cast("long").alias("n"))


@query("SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderkey % 9 = 0) > 0")
def predictions_with_hit(spark, sf):
    gold = t(spark, sf, "orders").where("o_orderkey % 9 = 0").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(s("o_orderkey")).alias("docs"))
    return joins.with_hit(joins.attach_gold(by_customer(spark, sf), gold)).select("id", F.size("docs").cast("long").alias("n"))


@query("""WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderkey % 9 = 0) hits, count(*) FILTER (o_orderkey % 5 = 0) bare FROM orders GROUP BY o_custkey)
SELECT count(*) FILTER (o_custkey % 4 = 0) missing_ratings, count(*) FILTER (bare > 0) pred_without_text, count(*) FILTER (hits = 0) no_hit, count(*) FILTER (hits = 0 AND o_custkey % 4 = 0) no_hit_no_ratings FROM c""")
def sanity_counts(spark, sf):
    gold = t(spark, sf, "orders").where("o_orderkey % 9 = 0").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(s("o_orderkey")).alias("docs"))
    rows = joins.attach_gold(by_customer(spark, sf), gold)
    texts = lambda c: F.transform(c, lambda d: F.struct(F.when(d.cast("long") % 5 > 0, F.lit("text")).alias("wikipedia_text")))
    ratings = F.when(F.col("id") % 4 > 0, F.create_map(F.lit("x"), F.lit("y")))
    rows = rows.withColumns({"relevance_ratings": ratings, "gold_doc_metadata": texts(F.col("gold_docs")), "pred_docs_metadata": texts(F.col("docs"))})
    return A.sanity_counts(rows).select("missing_ratings", "pred_without_text", "no_hit", "no_hit_no_ratings")


@query("SELECT c_custkey AS id FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def ids_not_covered(spark, sf):
    return joins.missing_ids(t(spark, sf, "customer").select(F.col("c_custkey").alias("id")), t(spark, sf, "orders").select(F.col("o_custkey").alias("id")))


@query(f"WITH {RUN_SQL} SELECT qid, count(*) AS hits FROM run JOIN qrels USING (qid, docid) WHERE rank <= 20 GROUP BY qid")
def queries_with_hit(spark, sf):
    return rerank.hit_gate(rerank.candidates(dense_run(spark, sf), 20), label_qrels(spark, sf))


# --- joins -------------------------------------------------------------------------------------


@query("SELECT 'title' AS space, o_orderkey AS id, n_name AS docid FROM orders JOIN nation ON n_nationkey = o_orderkey % 25 UNION ALL SELECT 'idx', o_orderkey, n_nationkey::VARCHAR FROM orders JOIN nation ON n_nationkey = o_orderkey % 25")
def ids_to_spaces(spark, sf):
    """Document ids to titles and back, as the other side's id space wants it."""
    names = t(spark, sf, "nation").select(F.col("n_name").alias("title"), s("n_nationkey").alias("idx"))
    rows = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 25).cast("string").alias("docid"))
    titles = joins.remap_to(rows, names, "title")
    return titles.select(F.lit("title").alias("space"), "id", "docid").unionAll(joins.remap_to(titles, names, "idx").select(F.lit("idx"), "id", "docid"))


@query("SELECT c_custkey AS query, max(o_orderkey) AS last FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def gold_with_predictions(spark, sf):
    """The last prediction of each gold query."""
    predictions = t(spark, sf, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("line_no"), F.col("o_orderkey").alias("doc"))
    gold = t(spark, sf, "orders").select(F.col("o_custkey").alias("query")).distinct()
    return joins.gold_with_predictions(gold, predictions).select("query", F.col("prediction.doc").alias("last"))


@query("SELECT o_orderkey AS qid, c_mktsegment AS template, round(o_totalprice, 2) AS score FROM orders JOIN customer ON o_orderkey = c_custkey")
def scores_with_metadata(spark, sf):
    scores = t(spark, sf, "orders").select(F.lit("d").alias("dataset"), F.col("o_orderkey").alias("qid"), F.round("o_totalprice", 2).alias("score"))
    metadata = t(spark, sf, "customer").select(F.lit("d").alias("dataset"), F.col("c_custkey").alias("qid"), F.col("c_mktsegment").alias("template"))
    return joins.scores_with_metadata(scores, metadata).select("qid", "template", "score")


@query("SELECT o_custkey AS id, o_orderkey::VARCHAR AS title, o_orderstatus AS status, (SELECT count(*) FROM orders WHERE o_orderkey % 4 = 3) AS missing FROM orders WHERE o_orderkey % 4 < 3")
def titles_of_examples(spark, sf):
    titles = t(spark, sf, "orders").where("o_orderkey % 4 < 3").select(s("o_orderkey").alias("title"), F.col("o_orderstatus").alias("status"))
    found, missing = joins.titles_of_examples(by_customer(spark, sf), titles)
    return found.join(F.broadcast(missing)).select("id", "title", "status", "missing")  # one row


@query("SELECT dense_rank() OVER (ORDER BY o_custkey) AS line_no, i AS pos, 'q' || o_custkey AS query, title, 'query: q' || o_custkey || ', doc: text ' || title AS input, 'relevant' AS label FROM (SELECT o_custkey, o_orderkey::VARCHAR title, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey::VARCHAR) - 1)::INT i FROM orders) WHERE i < 3")
def inference_pairs(spark, sf):
    """The first predictions of each query with their texts; a title that is not there would fail the read."""
    rows = by_customer(spark, sf).withColumn("line_no", F.expr("dense_rank() over (order by id)").cast("long")).withColumn("query", F.concat(F.lit("q"), s("id")))
    docs = t(spark, sf, "orders").select(s("o_orderkey").alias("title"), F.concat(F.lit("text "), s("o_orderkey")).alias("text"))
    return sampling.inference_pairs(rows.select("line_no", "query", "docs"), docs, 3)


@query("SELECT c_custkey, 'P' || c_nationkey AS pid, CASE WHEN c_nationkey % 2 = 0 THEN n_name ELSE 'Unknown Property (P' || c_nationkey || ')' END AS label FROM customer JOIN nation ON c_nationkey = n_nationkey")
def labelled_properties(spark, sf):
    values = t(spark, sf, "customer").select("c_custkey", F.concat(F.lit("P"), s("c_nationkey")).alias("pid"))
    labels = t(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("P"), s("n_nationkey")).alias("pid"), F.col("n_name").alias("label"))
    return joins.labelled_properties(values, labels)


# --- aggregates and ranks ----------------------------------------------------------------------


@query(f"WITH {PAIRS_SQL} SELECT template, count(*) AS n FROM v WHERE num_docs BETWEEN 1 AND 200 GROUP BY template")
def template_counts(spark, sf):
    return A.template_counts(setalg.valid_pairs(entity_attributes(spark, sf), 1, 200))


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) = 1")
def first_of_group(spark, sf):
    return joins.first_of_group(t(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey", "o_orderkey")


@query("SELECT round(avg(value), 6) AS value, 0.0::DOUBLE AS none FROM events")
def means_or_zero(spark, sf):
    return rounded(A.mean_or_zero(t(spark, sf, "events").select("value", F.lit(None).cast("double").alias("none")), "value", "none"), "value")


@query("SELECT o_custkey AS id, round(avg(o_orderkey), 6) AS avg_in, 0.0::DOUBLE AS avg_out FROM orders GROUP BY o_custkey")
def token_usage(spark, sf):
    rows = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list("o_orderkey").alias("in_tokens")).withColumn("out_tokens", F.array().cast("array<bigint>"))
    return rounded(cost.usage(rows).select("id", "avg_in", "avg_out"), "avg_in")


@query("SELECT c_custkey AS qid, coalesce(bool_and(o_totalprice - 200000 < 0), true) AS negative FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def queries_all_negative(spark, sf):
    rows = t(spark, sf, "orders").select(F.col("o_custkey").alias("qid"), (F.col("o_totalprice") - 200000).alias("score"))
    return ranking.all_negative(rows, t(spark, sf, "customer").select(F.col("c_custkey").alias("qid")))


@query("SELECT o_custkey AS id, substr(sha256(string_agg(o_orderkey || chr(10), '' ORDER BY o_orderkey::VARCHAR)), 1, 24) AS digest FROM orders GROUP BY o_custkey")
def content_hashes(spark, sf):
    return by_customer(spark, sf).select("id", T.content_hash(F.col("docs")).alias("digest"))


@query(f"WITH {SCORES_SQL} SELECT qid, cutoff, round(recall, 6) AS set_recall, hits AS distinct_hits FROM f")
def metrics_set_recall(spark, sf):
    scores = metrics.per_query(dense_run(spark, sf), label_qrels(spark, sf), [5, 20, 100])
    return rounded(scores.select("qid", "cutoff", "set_recall", "distinct_hits"), "set_recall")


@query(f"WITH {SCORES_SQL} SELECT 'ndcg@20' AS spec, qid, round(ndcg, 6) AS score FROM f WHERE cutoff = 20 UNION ALL SELECT 'recall@100', qid, round(recall, 6) FROM f WHERE cutoff = 100")
def metrics_by_spec(spark, sf):
    run, gold = dense_run(spark, sf), label_qrels(spark, sf)
    one, two = (rounded(metrics.by_spec(run, gold, spec).select(F.lit(spec).alias("spec"), "qid", "score"), "score") for spec in ("ndcg@20", "recall@100"))
    return one.unionAll(two)


@query(f"""WITH {SCORES_SQL.replace("[5, 20, 100]", "[1, 3, 5, 10, 20]")} SELECT 'dense' AS method, round(avg(prec) FILTER (cutoff = 1), 6) precision_at_1, round(avg(recall) FILTER (cutoff = 10), 6) recall_at_10, round(avg(f1) FILTER (cutoff = 3), 6) f1_at_3, round(avg(ndcg) FILTER (cutoff = 20), 6) ndcg_at_20, round(avg(rr), 6) mrr FROM f""")
def baseline_row(spark, sf):
    row = metrics.baseline_table(dense_run(spark, sf), label_qrels(spark, sf), "dense")
    return rounded(row.select("method", "precision_at_1", "recall_at_10", "f1_at_3", "ndcg_at_20", "mrr"), "precision_at_1", "recall_at_10", "f1_at_3", "ndcg_at_20", "mrr")


@query(f"""WITH {SCORES_SQL}, means AS (SELECT cutoff, avg(recall) r, avg(ndcg) d FROM f GROUP BY cutoff)
SELECT 'dense & ' || string_agg(printf('%.4f', r), ' & ' ORDER BY cutoff) || ' & ' || string_agg(printf('%.4f', d), ' & ' ORDER BY cutoff) || ' \\\\' AS line FROM means""")
def latex_line(spark, sf):
    line = metrics.latex_row("dense", metrics.evaluate(dense_run(spark, sf), label_qrels(spark, sf)))
    return spark.createDataFrame([(line,)], "line string")


@query(f"WITH {RUN_SQL}, x AS (SELECT qid, docid, rank, round(docid % 7 / 7, 6) p FROM run WHERE rank <= 20) SELECT 'prob' AS kind, qid, docid, row_number() OVER (PARTITION BY qid ORDER BY p DESC, docid DESC) AS rank FROM x UNION ALL SELECT 'stable', qid, docid, row_number() OVER (PARTITION BY qid ORDER BY p DESC, rank) FROM x")
def reranked(spark, sf):
    """Candidates by probability, and by score with their former order among equals."""
    run = rerank.candidates(dense_run(spark, sf), 20)
    scored = run.select("qid", "docid", F.round(F.col("docid") % 7 / 7, 6).alias("p"))
    one, two = (rerank.rerank(run, scored, stable).select(F.lit(kind).alias("kind"), "qid", "docid", F.col("rank").cast("long").alias("rank")) for kind, stable in (("prob", False), ("stable", True)))
    return one.unionAll(two)


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey % 3 = 0, CASE WHEN c_custkey % 3 > 0 THEN c_custkey END, 'x' || c_custkey) AS place FROM customer")
def query_id_order(spark, sf):
    """Numeric ids first, by number, then the others by text."""
    qid = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("x"), s("c_custkey"))).otherwise(s("c_custkey"))
    rows = t(spark, sf, "customer").select("c_custkey", qid.alias("qid"))
    from pyspark.sql import Window

    return rows.select("c_custkey", F.row_number().over(Window.orderBy(*rankings.qid_order(F.col("qid")))).cast("long").alias("place"))


# --- sets --------------------------------------------------------------------------------------


@query(f"""WITH {HABITS_SQL} SELECT 'union' AS kind, entity FROM z WHERE list_has_any(l, ['1-URGENT', 'state F']) UNION ALL SELECT 'intersection', entity FROM z WHERE list_has_all(l, ['1-URGENT', '5-LOW', '2-HIGH']) UNION ALL SELECT 'difference', entity FROM z WHERE list_has_all(l, ['1-URGENT', '5-LOW']) AND NOT list_contains(l, '2-HIGH')
UNION ALL SELECT 'template', entity FROM z WHERE list_contains(l, '1-URGENT') AND NOT list_contains(l, '2-HIGH')""")
def attribute_sets(spark, sf):
    ea = entity_habits(spark, sf)
    parts = {"union": setalg.union(ea, ["1-URGENT", "state F"]), "intersection": setalg.intersection(ea, ["1-URGENT", "5-LOW", "2-HIGH"]), "difference": setalg.difference(ea, ["1-URGENT", "5-LOW"], "2-HIGH"), "template": setalg.entities_for(ea, setalg.NOT, ["1-URGENT", "2-HIGH"])}
    out = None
    for kind, rows in parts.items():
        named = rows.select(F.lit(kind).alias("kind"), "entity")
        out = named if out is None else out.unionAll(named)
    return out


@query(f"""WITH {HABITS_SQL}, n AS (SELECT count(*) n FROM top) SELECT '_' AS template, n::BIGINT AS most FROM n UNION ALL SELECT '_ or _', (n * (n - 1)) // 2 FROM n UNION ALL SELECT '_ or _ or _', (n * (n - 1) * (n - 2)) // 6 FROM n UNION ALL SELECT '_ that are also _ but not _', n * (n - 1) * (n - 2) FROM n UNION ALL SELECT '_ that are not _', n * (n - 1) FROM n""")
def combination_bounds(spark, sf):
    n = entity_habits(spark, sf).select("attr").distinct().count()
    return spark.createDataFrame([(x, setalg.upper_bound(x, n)) for x in (setalg.SINGLE, setalg.OR2, setalg.OR3, setalg.AND_NOT, setalg.NOT)], "template string, most long")


@query(f"""WITH {HABITS_SQL}, p AS (SELECT x.attr a, y.attr b, count(*) FILTER (list_contains(l, x.attr) AND NOT list_contains(l, y.attr)) n FROM top x JOIN top y ON x.attr <> y.attr, z GROUP BY ALL) SELECT a, b, n AS num_docs FROM p WHERE n BETWEEN 1 AND 500""")
def combinations_enumerated(spark, sf):
    """Fewer combinations than the limit are enumerated, not drawn."""
    rows = sampling.combinations(entity_habits(spark, sf), setalg.NOT, 1, 500)
    return rows.select(F.col("attrs")[0].alias("a"), F.col("attrs")[1].alias("b"), "num_docs")


@query(f"""WITH {HABITS_SQL}, p AS (SELECT x.attr a, y.attr b, count(*) FILTER (list_contains(l, x.attr)) na, count(*) FILTER (list_contains(l, y.attr)) nb, count(*) FILTER (list_contains(l, x.attr) AND list_contains(l, y.attr)) nab FROM top x JOIN top y ON x.attr < y.attr, z GROUP BY ALL)
SELECT '_ or _' AS template, a, b FROM p WHERE na + nb > nab AND NOT (na = nab AND nb = nab) UNION ALL SELECT '_ that are also _', a, b FROM p WHERE nab > 0 UNION ALL SELECT '_ that are not _', a, b FROM p WHERE nab > 0 AND na > nab UNION ALL SELECT '_ that are not _', b, a FROM p WHERE nab > 0 AND nb > nab""")
def template_candidates(spark, sf):
    """Pairs of each template that its builder lets pass."""
    ea = entity_habits(spark, sf)
    return plugins.candidates(ea, setalg.valid_pairs(ea, 1, 1 << 40)).select("template", "a", "b")


@query("SELECT o_custkey AS id, count(*) FILTER (o_orderkey % 3 > 0) = 0 AS covers, count(*) FILTER (o_orderkey % 3 = 1) AS extra, count(*) FILTER (o_orderkey % 3 = 2) AS missing FROM orders GROUP BY o_custkey")
def set_differences(spark, sf):
    """Whether all gold documents are predicted, what is too much, and what is missing."""
    o = t(spark, sf, "orders")
    pick = lambda rest: F.coalesce(F.collect_list(F.when(F.col("o_orderkey") % 3 != rest, F.col("o_orderkey"))), F.array())
    rows = o.groupBy(F.col("o_custkey").alias("id")).agg(pick(1).alias("gold"), pick(2).alias("predicted"), F.collect_list("o_orderkey").alias("all"))
    extra, missing = setalg.differences(F.col("gold"), F.col("predicted"))
    both = F.filter("predicted", lambda x: x % 3 == 0)
    return rows.select("id", (setalg.covers(F.col("all"), both)).alias("covers"), F.size(extra).cast("long").alias("extra"), F.size(missing).cast("long").alias("missing"))


@query("SELECT n_name AS name FROM nation UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT n_name FROM nation")
def bag_union(spark, sf):
    n = t(spark, sf, "nation").select(F.col("n_name").alias("name"))
    return n.unionByName(t(spark, sf, "customer").select(F.col("c_mktsegment").alias("name"))).unionByName(n)


# --- vectors and probabilities -----------------------------------------------------------------


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) v FROM embeddings), p AS (SELECT vec_id, v[1:4] a, v[5:8] b, v[9:12] c FROM e)
SELECT vec_id, round(list_inner_product(a, b) / sqrt(list_inner_product(a, a) * list_inner_product(b, b)), 6) cosine, round((a[1] + b[1]) / 2, 6) mean_first, round(b[2], 6) last_second, round(c[2], 6) left_second FROM p""")
def vector_pooling(spark, sf):
    """Cosine, the mean over tokens that the mask keeps, and the last token with padding on either side."""
    part = lambda i: F.slice("embedding", i, 4)
    e = t(spark, sf, "embeddings").select("vec_id", part(1).alias("a"), part(5).alias("b"), part(9).alias("c"))
    vectors, mask = F.array("a", "b", "c"), F.array(F.lit(1), F.lit(1), F.lit(0))
    out = e.select("vec_id", dense.cosine(F.col("a"), F.col("b")).alias("cosine"), dense.mean_pooled(vectors, mask)[0].alias("mean_first"), dense.last_token_pooled(vectors, mask, False)[1].cast("double").alias("last_second"), dense.last_token_pooled(vectors, mask, True)[1].cast("double").alias("left_second"))
    return rounded(out, "cosine", "mean_first", "last_second", "left_second")



@query("WITH x AS (SELECT o_custkey % 40 qid, o_orderkey docid, round((o_orderkey % 97) / 97, 6) a, round((o_orderkey % 89) / 89, 6) b FROM orders) SELECT qid::VARCHAR AS qid, docid, round(CASE qid % 4 WHEN 0 THEN a * b WHEN 1 THEN 1 - (1 - a) * (1 - b) WHEN 2 THEN a * (1 - b) ELSE 1 - (1 - a) * b END, 5) AS p FROM x")
def boolean_scores_of_all_queries(spark, sf):
    """Forty queries of four forms over the facts of their customers, in one plan."""
    o = t(spark, sf, "orders")
    facts = o.select((F.col("o_custkey") % 40).cast("string").alias("qid"), F.col("o_orderkey").alias("docid"), F.explode(F.array(F.struct(F.lit("A one").alias("atom"), F.round(F.col("o_orderkey") % 97 / 97, 6).alias("p")), F.struct(F.lit("B two").alias("atom"), F.round(F.col("o_orderkey") % 89 / 89, 6).alias("p")))).alias("f")).select("qid", "docid", "f.*")
    forms = ["A one AND B two", "A one OR B two", "A one AND NOT B two", "A one OR NOT (B two)"]
    queries = [(str(q), forms[q % 4], ["A one", "B two"]) for q in range(40)]
    return boolean.score_long(facts, queries).select("qid", "docid", F.round("p", 5).alias("p"))


@query("SELECT vec_id, round(exp(-abs(embedding[1]::DOUBLE) * 3), 6) AS p FROM embeddings")
def log_probabilities(spark, sf):
    logs = t(spark, sf, "embeddings").select("vec_id", (-F.abs(F.col("embedding")[0].cast("double")) * 3).alias("log_p"))
    return rounded(logs.select("vec_id", F.exp("log_p").alias("p")), "p")


# --- text --------------------------------------------------------------------------------------


@query("""SELECT p_partkey, split_part(y, '-', 1) AS year, n_name || '_x' AS key, 'full ' || p_name || chr(10) || 'brand: ' || p_brand || '.' AS context, 'Is ' || p_name || ' of ' || p_brand || '? ' AS prompt, round((p_size - 25) / 25 * 100, 6) AS difference
FROM (SELECT *, (1950 + p_size) || '-01-02' AS y, 'part' AS n_name FROM part)""")
def text_of_properties(spark, sf):
    p = t(spark, sf, "part")
    props = F.create_map(F.lit("brand"), F.array("p_brand"))
    year = T.first_year(F.array(F.concat((F.col("p_size") + 1950).cast("string"), F.lit("-01-02")), F.lit("1-1-1")))
    key = F.map_keys(T.underscored_properties(F.create_map(F.lit("part x"), F.array(F.lit("v")))))[0]
    out = p.select("p_partkey", year.alias("year"), key.alias("key"), T.context("wd", F.concat(F.lit("full "), "p_name"), F.lit(""), props).alias("context"), T.prompt("Is {name} of {brand}? {none}", name=F.col("p_name"), brand=F.col("p_brand"), none=F.lit(None).cast("string")).alias("prompt"), T.percent_difference(F.col("p_size"), F.lit(25)).alias("difference"))
    return rounded(out, "difference")


@query("""SELECT p_partkey, 2 AS premises, 'publication_date' AS property, (1950 + p_size)::VARCHAR AS value FROM part""")
def premises(spark, sf):
    props = F.create_map(F.lit("brand name"), F.array("p_brand"), F.lit("publication date"), F.array(F.concat((F.col("p_size") + 1950).cast("string"), F.lit("-05-06"))))
    rows = t(spark, sf, "part").select("p_partkey", T.premises(props).alias("x"))
    return rows.select("p_partkey", F.size("x").alias("premises"), F.col("x")[1]["property"].alias("property"), F.col("x")[1]["values"][0].alias("value"))


@query("""SELECT c_custkey, [c_mktsegment, n_name]::VARCHAR AS marks, n_name AS kept, c_name AS attribute FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def marked_queries(spark, sf):
    """Marked spans of a query, the categories that it marks, and the attribute of a single query."""
    c = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    q = F.concat(F.lit("<mark>"), "c_mktsegment", F.lit("</mark> that are also <mark>"), "n_name", F.lit("</mark>"))
    kept = T.kept_categories(F.array(F.concat(F.lit("Category:"), "n_name"), F.lit("Category:none")), q)
    return c.select("c_custkey", F.concat(F.lit("["), F.array_join(T.marked(q), ", "), F.lit("]")).alias("marks"), kept[0].alias("kept"), T.single_attribute(F.concat(F.lit("Who likes "), "c_name", F.lit("?"))).alias("attribute"))


@query("""SELECT c_custkey, 'x = ' || c_custkey AS block, 'f(a, ' || c_name || ')' AS second, 3 AS parts, 'Facts' AS header, 2 AS lines FROM customer""")
def replies_taken_apart(spark, sf):
    """The last fenced block of a reply, parts between commas outside of brackets and quotes, and sections under headings."""
    name = F.col("c_name")
    reply = F.concat(F.lit("Sure\n```python\ny = 1\n```\nand\n```python\nx = "), s("c_custkey"), F.lit("\n```\n"))
    parts = T.balanced_split(F.concat(F.lit('"a, b", f(a, '), name, F.lit("), [1, 2]")))
    sections = T.sections(F.concat(F.lit("Facts:\n"), name, F.lit("\nsecond line\n\n# Rules\nall"), F.lit("")))
    out = t(spark, sf, "customer").select("c_custkey", T.fenced(reply, "python").alias("block"), parts.alias("p"), sections.alias("x"))
    return out.select("c_custkey", F.regexp_replace("block", r"\s+$", "").alias("block"), F.col("p")[1].alias("second"), F.size("p").alias("parts"), F.col("x")[0]["header"].alias("header"), F.size(F.col("x")[0]["lines"]).alias("lines"))


@query(r"""SELECT doc_id, array_to_string(list_slice(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'), 1, 12), ' ') AS pieces, sha1('["' || doc_id || '","' || lang || '"]') AS key FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL""")
def text_cut(spark, sf):
    """The first pieces of a text, and a key over several parts."""
    d = t(spark, sf, "documents").where("text is not null and lang is not null")
    return d.select("doc_id", T.first_pieces(F.col("text"), 12).alias("pieces"), T.cache_key(F.col("doc_id"), F.col("lang")).alias("key"))


# --- incremental work --------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, o_custkey AS v, o_orderkey % 2 = 0 AS first FROM orders")
def appended_in_two_runs(spark, sf):
    """A run over half of the work, and one over all of it that does what is missing."""
    out = scratch(spark, "appended")
    rows = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("v"))
    incremental.append_new(rows.where("id % 2 = 0"), out, lambda x: x.withColumn("first", F.lit(True)))
    incremental.append_new(rows, out, lambda x: x.withColumn("first", F.lit(False)))
    return spark.read.parquet(out)


@query("SELECT o_orderkey AS id, o_custkey AS v FROM orders")
def appended_from_stream(spark, sf):
    """Files that arrive twice, taken by a stream that goes on where it ended."""
    source, out, checkpoint = (scratch(spark, x) for x in ("arriving", "streamed", "progress"))
    rows = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("v"))
    for part in (rows.where("id % 3 > 0"), rows.where("id % 3 < 2")):
        part.write.mode("append").json(source)
        incremental.append_stream(spark, source, "id long, v long", out, checkpoint, lambda x: x).awaitTermination()
    return spark.read.parquet(out).drop("batch")


@query("SELECT CASE WHEN value > 50 THEN 'yes' ELSE 'no' END AS gold, event_type AS predicted, count(*) AS n FROM events GROUP BY ALL")
def confusion_streamed(spark, sf):
    """A running confusion matrix over files that arrive in three parts, with a restart before each; its state is in the checkpoint."""
    source, out, checkpoint = (scratch(spark, x) for x in ("judged", "matrix", "counted"))
    e = t(spark, sf, "events").select(F.when(F.col("value") > 50, "yes").otherwise("no").alias("gold"), F.col("event_type").alias("predicted"), F.pmod(F.xxhash64("event_id"), F.lit(3)).alias("part"))
    for part in range(3):
        e.where(F.col("part") == part).select("gold", "predicted").write.mode("append").json(source)
        incremental.confusion_stream(spark, source, "gold string, predicted string", out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query("SELECT i::INT AS chunk FROM range(40) r(i) WHERE i NOT IN (SELECT o_orderkey % 50 FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 50 < 30)")
def chunks_missing(spark, sf):
    done = t(spark, sf, "orders").where("o_orderkey % 7 = 0 and o_orderkey % 50 < 30").select((F.col("o_orderkey") % 50).cast("int").alias("chunk"))
    return incremental.missing_chunks(done, 40)


@query("SELECT o_orderkey AS key, md5(o_orderkey::VARCHAR) AS value FROM orders WHERE o_orderkey % 2 = 1")
def values_cached(spark, sf):
    """Values of a cache that had some of them already."""
    out = scratch(spark, "cache")
    keys = t(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    work = lambda x: x.withColumn("value", F.md5(s("key")))
    incremental.cached(keys.where("key % 3 = 0"), out, work)
    return incremental.cached(keys.where("key % 2 = 1"), out, work)


@query("SELECT value > 50 AS gold, event_type AS predicted, count(*) AS n FROM events GROUP BY ALL")
def confusion_running(spark, sf):
    e = t(spark, sf, "events").select((F.col("value") > 50).alias("gold"), F.col("event_type").alias("predicted"), "user_id")
    first = incremental.running_confusion(None, e.where("user_id % 2 = 0"))
    return incremental.running_confusion(first, e.where("not coalesce(user_id % 2 = 0, false)"))


# --- plug-in points ----------------------------------------------------------------------------


@query("""WITH x AS (SELECT o_custkey, o_orderkey, round(o_orderkey % 97 / 97, 6) a, round(o_orderkey % 89 / 89, 6) b FROM orders) SELECT 'c' || o_custkey % 40 AS qid, o_orderkey::VARCHAR AS docid, round(a * (1 - b), 5) AS p FROM x""")
def plugged_probabilities(spark, sf):
    """A parser, an estimator and the Boolean score: functions given from outside, fixed here."""
    customer = F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string")).alias("qid")
    queries = t(spark, sf, "orders").select(customer, F.lit("likes A but not B").alias("query")).distinct()
    parsed = plugins.parsed_queries(queries, lambda q: {"atoms": ["A", "B"], "expr": "A AND NOT B"})
    pairs = t(spark, sf, "orders").select(customer, s("o_orderkey").alias("docid")).join(parsed.select("qid", "atoms"), "qid")
    facts = plugins.estimated(pairs, lambda atoms, row: {a: round(int(row["docid"]) % m / m, 6) for a, m in zip(atoms, (97, 89), strict=True)})
    asked = [(r["qid"], r["expr"], r["atoms"]) for r in parsed.select("qid", "expr", "atoms").collect()]  # forty
    return boolean.score_long(facts, asked).select("qid", "docid", F.round("p", 5).alias("p"))


@query("SELECT o_custkey::VARCHAR AS qid, o_orderkey::VARCHAR AS docid, round(1.0 / (1 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)), 6)::DOUBLE AS p FROM orders")
def plugged_reasoner(spark, sf):
    """A reasoner that sees one query's candidates at a time."""
    rows = t(spark, sf, "orders").select(s("o_custkey").alias("qid"), "o_orderkey")
    return rounded(plugins.reasoned(rows, lambda x: [(str(k), 1 / (2 + i)) for i, k in enumerate(sorted(x["o_orderkey"]))]), "p")


@query("SELECT doc_id AS docid, length(text)::DOUBLE AS size, 1.0::DOUBLE AS one FROM documents WHERE text IS NOT NULL")
def plugged_encoder(spark, sf):
    texts = t(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("docid"), "text")
    out = plugins.encoded(texts, lambda batch: [[float(len(x)), 1.0] for x in batch])
    return out.select("docid", F.col("embedding")[0].cast("double").alias("size"), F.col("embedding")[1].cast("double").alias("one"))


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'True' END AS answer, CASE WHEN o_orderkey % 2 = 0 THEN 3 END AS in_tokens FROM orders")
def plugged_generator(spark, sf):
    """Prompts with answers computed elsewhere; some have none."""
    keys = t(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    answers = keys.where("key % 2 = 0").select("key", F.lit("True").alias("answer"), F.lit(3).alias("in_tokens"), F.lit(1).alias("out_tokens"))
    return plugins.generated(keys, answers).select("key", "answer", "in_tokens")


@query("SELECT o_orderpriority || '/' || o_orderkey % 2 AS key, round(avg(o_totalprice), 4) AS o_totalprice, count(*) AS n FROM orders GROUP BY ALL")
def means_by_function(spark, sf):
    """Means by a key that is any function of the row."""
    out = plugins.by_key(t(spark, sf, "orders"), lambda x: F.concat_ws("/", "o_orderpriority", (F.col("o_orderkey") % 2).cast("string")), ["o_totalprice"])
    return out.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("SELECT 'count orders' AS step, true AS timed, count(*) AS n FROM orders")
def steps_timed(spark, sf):
    """A table of steps with their wall times."""
    found = {}
    step = plugins.timed("count orders", lambda: found.update(n=t(spark, sf, "orders").count()))
    return spark.createDataFrame([(step["step"], step["seconds"] >= 0, found["n"])], "step string, timed boolean, n long")


@query("SELECT o_orderkey % 4 AS kind, count(*) AS calls, round(sum((60 * 1.5 + 5 * 2) / 1e6), 6) AS cost, round((sum((60 * 1.5 + 5 * 2) / 1e6) - 1) / 1 * 100, 4) AS difference FROM orders GROUP BY ALL")
def costs_compared(spark, sf):
    calls = t(spark, sf, "orders").groupBy((F.col("o_orderkey") % 4).alias("kind")).agg(F.count("*").alias("num_queries"))
    rows = calls.select("kind", "num_queries", *(F.lit(v).alias(c) for c, v in (("calls_per_query", 1), ("avg_query_tokens", 4.0), ("avg_doc_tokens", 6.0), ("input_price", 1.5), ("output_price", 2.0))))
    priced = cost.totals(rows).withColumn("cost", F.col("total_cost"))
    return cost.compare_costs(priced, F.lit(1.0)).select("kind", F.col("calls").cast("long").alias("calls"), F.round("cost", 6).alias("cost"), F.round("difference", 4).alias("difference"))


# --- state machines and word pieces --------------------------------------------------------------

#: A statement with nested brackets, quotes and escapes, by the row's numbers; SQL and Spark build the same text.
_STATEMENT_SQL = r"""repeat('(', p_size % 4) || p_name || ', "' || p_brand || ', \" x"' || repeat(')', p_size % 4) || ', it\'s, ' || p_type || CASE WHEN p_partkey % 3 = 0 THEN ', ''(' || p_size || ', ''' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN ',, [a, (b, c)], ' ELSE ' ' END""".replace("it\\'s", "it\\''s")


def _statement():
    def lit(x):
        return F.lit(x)

    deep = (F.col("p_size") % 4).cast("int")
    odd = F.when(F.col("p_partkey") % 3 == 0, F.concat(lit(", '("), s("p_size"), lit(", '"))).otherwise("")
    end = F.when(F.col("p_partkey") % 5 == 0, lit(",, [a, (b, c)], ")).otherwise(" ")
    return F.concat(F.repeat(lit("("), deep), "p_name", lit(', "'), "p_brand", lit(', \\" x"'), F.repeat(lit(")"), deep), lit(", it\\'s, "), "p_type", odd, end)


@query(f"""WITH RECURSIVE x AS (SELECT p_partkey, {_STATEMENT_SQL} AS t FROM part),
r(p_partkey, t, pos, quote, depth, esc, cur, parts) AS (SELECT p_partkey, t, 1, '', 0, FALSE, '', []::VARCHAR[] FROM x UNION ALL
SELECT p_partkey, t, pos + 1, CASE WHEN NOT esc AND c IN ('''', '"') AND quote = '' THEN c WHEN NOT esc AND c = quote THEN '' ELSE quote END,
CASE WHEN esc OR quote <> '' THEN depth WHEN c IN ('(', '[') THEN depth + 1 WHEN c IN (')', ']') THEN greatest(depth - 1, 0) ELSE depth END, NOT esc AND c = '\\',
CASE WHEN sep THEN '' ELSE cur || c END, CASE WHEN sep THEN list_append(parts, trim(cur)) ELSE parts END
FROM (SELECT *, substr(t, pos, 1) c, NOT esc AND quote = '' AND depth = 0 AND substr(t, pos, 1) = ',' sep FROM r WHERE pos <= length(t)))
SELECT p_partkey, array_to_string(CASE WHEN cur <> '' THEN list_append(parts, trim(cur)) ELSE parts END, '|') AS parts FROM r WHERE pos = length(t) + 1""")
def statements_split(spark, sf):
    """Statements split at commas outside of quotes and brackets of any depth."""
    return dealt(t(spark, sf, "part")).select("p_partkey", F.array_join(states.split_outside(_statement()), "|").alias("parts"))


@query("""SELECT p_partkey, 'Likes(' || p_brand || ', x)|' || p_type || '|And(A, Not(B, C))|p ' || p_size AS expressions FROM part""")
def logic_extracted(spark, sf):
    """The expressions of the logic blocks of a reply, over several lines and blocks."""
    reply = F.concat(F.lit("TEXT: none, of it\nFOL; \u201cLikes("), "p_brand", F.lit(", x)\u201d,\n  "), "p_type", F.lit(",\n<EVALUATE>\nno, text\nFOL; And(A, \\Not(B,\nC)), ''\n\nnone\nFOL;'p "), s("p_size"), F.lit("'\nTEXT; end"))
    return dealt(t(spark, sf, "part")).select("p_partkey", F.array_join(states.logic_expressions(reply), "|").alias("expressions"))


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]') w FROM documents), aw AS (SELECT doc_id, unnest(w) word FROM d),
f AS (SELECT word FROM aw GROUP BY word HAVING count(DISTINCT doc_id) >= 10), l AS (SELECT DISTINCT unnest(range(1, length(word) + 1)) i, word FROM (SELECT DISTINCT word FROM aw WHERE length(word) <= 100)),
v AS (SELECT DISTINCT piece FROM (SELECT word AS piece FROM f UNION ALL SELECT '##' || substr(word, 4) FROM f WHERE length(word) > 3 UNION ALL SELECT substr(word, i, 1) FROM l WHERE ascii(substr(word, i, 1)) < 128 UNION ALL SELECT '##' || substr(word, i, 1) FROM l WHERE ascii(substr(word, i, 1)) < 128)),
h AS (SELECT doc_id, list_slice(w, 1, 24) w FROM d), p AS (SELECT doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) i FROM h), dw AS (SELECT DISTINCT word FROM p WHERE length(word) <= 100),
c AS (SELECT word, j.pos, max(k.size) size FROM dw, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS pos) j, LATERAL (SELECT unnest(range(1, length(word) - j.pos + 2)) AS size) k JOIN v ON piece = CASE WHEN j.pos > 1 THEN '##' ELSE '' END || substr(word, j.pos, k.size) GROUP BY ALL),
r(word, pos, out) AS (SELECT word, 1::BIGINT, []::VARCHAR[] FROM dw UNION ALL SELECT r.word, r.pos + c.size, list_append(out, CASE WHEN r.pos > 1 THEN '##' ELSE '' END || substr(r.word, r.pos, c.size)) FROM r JOIN c ON c.word = r.word AND c.pos = r.pos),
e AS (SELECT word, out FROM r WHERE pos = length(word) + 1),
g AS (SELECT doc_id, flatten(list(coalesce(e.out, ['[UNK]']) ORDER BY i)) pieces FROM p LEFT JOIN e USING (word) GROUP BY doc_id)
SELECT doc_id, array_to_string(list_slice(coalesce(pieces, []), 1, 24), ' ') AS pieces FROM documents LEFT JOIN g USING (doc_id)""")
def texts_cut_by_pieces(spark, sf):
    """The first 24 word pieces of every document, by a vocabulary made of the documents: frequent words, their ends, and single letters."""
    d = spread(t(spark, sf, "documents").select("doc_id", "text"))
    # a row for each word, from one pass: its documents are counted once each, its letters taken once
    own = d.select("doc_id", F.explode(F.array_distinct(wordpieces.words(F.col("text")))).alias("word"))
    every = kept(own.groupBy("word").agg(F.count_distinct("doc_id").alias("n")), "words")
    frequent = every.where("n >= 10").select("word")
    letters = every.where(F.length("word") <= 100).select(F.explode(F.array_distinct(F.split("word", ""))).alias("x")).where("x <> ''").distinct().where(F.ascii("x") < 128)
    inside = lambda c: F.concat(F.lit(wordpieces.INSIDE), c)
    parts = [frequent.select(F.col("word").alias("piece")), frequent.where(F.length("word") > 3).select(inside(F.expr("substring(word, 4)"))), letters.select("x"), letters.select(inside(F.col("x")))]
    vocabulary = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).distinct()
    return wordpieces.cut(d, vocabulary, 24, "doc_id").select("doc_id", F.array_join("pieces", " ").alias("pieces"))


# --- results and examples ------------------------------------------------------------------------


@query(f"""WITH {RUN_SQL} SELECT qid, docid, rank FROM (SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, CASE WHEN docid % 7 = 0 THEN -1 ELSE docid END) AS rank FROM run) WHERE rank <= 20 AND docid % 7 <> 0""")
def hits_ranked(spark, sf):
    """Results with missing hits (place -1): these go, and the ranks of the others stay."""
    run = dense_run(spark, sf).withColumn("idx", F.when(F.col("docid") % 7 == 0, -1).otherwise(F.col("docid"))).drop("rank")
    return ranking.ranked_hits(run, 20).select("qid", "docid", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {RUN_SQL}, v AS (SELECT qid, docid, rank, CASE WHEN docid % 3 = 0 THEN 1 ELSE 0 END AS yes FROM run WHERE rank <= 20), w AS (SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY yes DESC, rank) AS rank FROM v),
j AS (SELECT w.*, q.docid IS NOT NULL AS rel FROM w LEFT JOIN qrels q USING (qid, docid) WHERE w.qid IN (SELECT qid FROM qrels)), k AS (SELECT unnest([1, 3, 5, 10]) AS cutoff),
per AS (SELECT cutoff, qid, count(*) FILTER (rel AND rank <= cutoff) / cutoff AS prec, coalesce(1 / min(rank) FILTER (rel), 0) rr FROM j, k GROUP BY cutoff, qid)
SELECT cutoff, count(*) AS num_queries, round(avg(prec), 6) AS precision, round(avg(rr), 6) AS mrr FROM per GROUP BY cutoff""")
def verdict_metrics(spark, sf):
    """Precision and MRR of a run that was re-ranked by binary verdicts."""
    run = dense_run(spark, sf, 20)
    verdicts = run.select("qid", "docid", F.when(F.col("docid") % 3 == 0, "True").otherwise("False").alias("verdict"))
    return rounded(rerank.verdict_metrics(run, verdicts, label_qrels(spark, sf)), "precision", "mrr")


@query("SELECT o_custkey::VARCHAR AS id, 'q ' || o_custkey AS query, count(*) AS docs, 't' AS template FROM orders GROUP BY o_custkey")
def examples_written(spark, sf):
    """Examples written by the library's writer, read back, written and read again."""
    rows = by_customer(spark, sf).select(s("id").alias("id"), F.concat(F.lit("q "), s("id")).alias("query"), "docs", F.lit(1).alias("unknown"))
    template = F.struct(*(F.lit("t").alias("template") if f.split(" ")[0] == "template" else F.lit(None).cast(f.split(" ")[1]).alias(f.split(" ")[0]) for f in records.METADATA.split(", ")))
    first, second = scratch(spark, "examples"), scratch(spark, "examples-again")
    records.write_examples(rows.withColumn("metadata", template), first)
    records.write_examples(records.read_examples(spark, first), second)
    return records.read_examples(spark, second).select("id", "query", F.size("docs").cast("long").alias("docs"), "metadata.template")
