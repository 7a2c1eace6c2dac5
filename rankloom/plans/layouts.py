"""Registered queries of readers and writers: tables are written in a layout, read back, and compared with SQL over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import aggregates as A
from rankloom.operators import dense, joins, metrics
from rankloom.plans.catalog import RUN_SQL, SCORES_SQL, dense_run, label_qrels, query, rounded, t
from rankloom.sources import judgments, rankings, records, stores
from rankloom.sources.scratch import laid, scratch
from rankloom.streaming import incremental

s = lambda c: F.col(c).cast("string")
price = lambda: F.round("o_totalprice", 2)


def orders(spark, sf) -> DataFrame:
    return t(spark, sf, "orders")


def by_customer(spark, sf) -> DataFrame:
    """(o_custkey, items): a customer's orders by key."""
    items = F.sort_array(F.collect_list(F.struct("o_orderkey", price().alias("price"))))
    return orders(spark, sf).groupBy("o_custkey").agg(items.alias("items"))


# --- judgments ---------------------------------------------------------------------------------


def _plain(spark, sf, second: str) -> str:
    line = F.concat_ws(" ", F.concat(F.lit("c"), s("o_custkey")), F.lit(second), F.lit("order "), s("o_orderkey"), (F.col("o_orderkey") % 3).cast("string"))
    return laid(orders(spark, sf), line, "o_orderkey", "qrels")


def _beir(spark, sf) -> str:
    row = F.to_json(F.struct(s("o_custkey").alias("query-id"), s("o_orderkey").alias("corpus-id"), (F.col("o_orderkey") % 3 * 0.7).alias("score")))
    return laid(orders(spark, sf), row, "o_orderkey", "beir")


def _inline(spark, sf) -> str:
    return laid(by_customer(spark, sf), F.to_json(F.struct(s("o_custkey").alias("_id"), F.transform("items", lambda x: x["o_orderkey"].cast("string")).alias("docs"))), "o_custkey", "inline")


@query("SELECT DISTINCT 'c' || o_custkey AS qid, 'order ' || o_orderkey AS docid FROM orders WHERE o_orderkey % 3 > 0")
def qrels_read(spark, sf):
    return judgments.read_qrels(spark, _plain(spark, sf, "0"))


@query("SELECT DISTINCT 'c' || o_custkey AS qid, 'order ' || o_orderkey AS docid FROM orders WHERE o_orderkey % 3 > 0")
def qrels_read_lenient(spark, sf):
    return judgments.read_qrels(spark, _plain(spark, sf, "Q7"), lenient=True)


@query("SELECT DISTINCT o_custkey::VARCHAR AS qid, o_orderkey::VARCHAR AS docid FROM orders WHERE o_orderkey % 3 = 2")
def qrels_read_beir(spark, sf):
    return judgments.read_beir_qrels(spark, _beir(spark, sf))


@query("SELECT DISTINCT o_custkey::VARCHAR AS qid, o_orderkey::VARCHAR AS docid FROM orders")
def qrels_read_inline(spark, sf):
    return judgments.read_inline_qrels(spark, _inline(spark, sf))


@query("""SELECT 'plain' AS kind, 'c' || o_custkey AS qid, 'order ' || o_orderkey AS docid FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT 'beir', o_custkey::VARCHAR, o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 3 = 2 UNION ALL SELECT 'inline', o_custkey::VARCHAR, o_orderkey::VARCHAR FROM orders""")
def qrels_sniffed(spark, sf):
    paths = {"plain": _plain(spark, sf, "0"), "beir": _beir(spark, sf), "inline": _inline(spark, sf)}
    parts = [judgments.read_any_qrels(spark, path).select(F.lit(kind).alias("kind"), "qid", "docid") for kind, path in paths.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("SELECT o_custkey::VARCHAR AS qid, unnest([k::VARCHAR, (k + 1)::VARCHAR]) AS docid FROM (SELECT o_custkey, max(o_orderkey) k FROM orders GROUP BY o_custkey) UNION ALL SELECT 'none', NULL")
def qrels_read_jsonl(spark, sf):
    """Of lines that repeat an id the last one counts; an id without documents stays."""
    rows = orders(spark, sf).select("o_orderkey", F.to_json(F.struct(s("o_custkey").alias("id"), F.array(s("o_orderkey"), (F.col("o_orderkey") + 1).cast("string")).alias("docs"))).alias("v"))
    rows = rows.unionAll(rows.sparkSession.createDataFrame([(-1, '{"id":"none","docs":[]}')], "o_orderkey long, v string"))
    return judgments.read_jsonl_qrels(spark, laid(rows, F.col("v"), "o_orderkey", "jsonl"))


@query("SELECT o_custkey::VARCHAR AS qid, 'order ' || o_orderkey AS docid, 1 + (o_orderkey % 2)::INT AS relevance FROM orders UNION ALL SELECT 'c' || c_custkey, c_name, 1 FROM customer")
def judgments_merged(spark, sf):
    """Judgments of two sources written to one folder and read as lines."""
    scored = orders(spark, sf).select(s("o_custkey").alias("qid"), F.concat(F.lit("order "), s("o_orderkey")).alias("docid"), (1 + F.col("o_orderkey") % 2).cast("double").alias("score"))
    inline = t(spark, sf, "customer").select(F.concat(F.lit("c"), s("c_custkey")).alias("qid"), F.col("c_name").alias("docid"))
    out = scratch(spark, "merged")
    judgments.write_qrels(judgments.both_sources(scored, inline), out, F.col("relevance"))
    back = judgments.judgment_rows(spark.read.text(out).select(F.col("value").alias("line")))
    return back.select("qid", "docid", F.col("relevance").cast("int").alias("relevance"))


@query("SELECT CASE WHEN c_custkey % 2 = 0 THEN 'Who is ' || c_name || '?' ELSE (row_number() OVER (ORDER BY c_custkey) - 1)::VARCHAR END AS id, c_nationkey::VARCHAR AS doc FROM customer")
def variant_judgments(spark, sf):
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("  Who is "), "c_name", F.lit("? "))).otherwise("")
    path = laid(t(spark, sf, "customer"), F.to_json(F.struct(text.alias("nl_query"), F.array(s("c_nationkey")).alias("documents"))), "c_custkey", "variants")
    rows = records.read_jsonl(spark, path, records.VARIANT)
    return judgments.variant_qrels(rows).select("id", F.explode("docs").alias("doc"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey DESC) AS id FROM customer")
def ids_assigned(spark, sf):
    rows = t(spark, sf, "customer").select("c_custkey", (-F.col("c_custkey")).alias("line_no"))
    return judgments.assign_ids(rows).select("c_custkey", F.col("id").cast("long").alias("id"))


@query("SELECT row_number() OVER (ORDER BY c_custkey) AS position, CASE WHEN c_custkey % 2 = 0 THEN 'a' || c_custkey ELSE 'b' || c_custkey END AS qid FROM customer")
def query_ids_read(spark, sf):
    k = F.col("c_custkey")
    row = F.when(k % 2 == 0, F.to_json(F.struct(F.concat(F.lit("a"), s("c_custkey")).alias("_id"), F.lit("x").alias("id")))).otherwise(F.to_json(F.struct(F.concat(F.lit("b"), s("c_custkey")).alias("id"))))
    return judgments.read_query_ids(spark, laid(t(spark, sf, "customer"), row, "c_custkey", "ids"))


@query("SELECT o_custkey::VARCHAR AS qid, 'Who likes ' || o_custkey || '?' AS text, count(DISTINCT o_orderkey)::INT AS num_docs FROM orders WHERE o_orderkey % 3 = 2 GROUP BY o_custkey HAVING num_docs BETWEEN 2 AND 9")
def queries_with_judgments(spark, sf):
    rows = t(spark, sf, "customer").select("c_custkey", F.to_json(F.struct(s("c_custkey").alias("_id"), F.concat(F.lit("Who likes "), s("c_custkey"), F.lit("?")).alias("text"))).alias("v"))
    return judgments.read_queries_with_judgments(spark, laid(rows, F.col("v"), "c_custkey", "queries"), _beir(spark, sf), 2, 9).select("qid", "text", "num_docs")


# --- rankings ----------------------------------------------------------------------------------


def _run_path(spark, sf) -> str:
    line = F.concat_ws(" ", F.concat(F.lit("c"), s("o_custkey")), F.lit("Q0 order"), s("o_orderkey"), (F.col("o_orderkey") % 7).cast("string"), price().cast("string"), F.lit("run"))
    return laid(orders(spark, sf), line, "o_orderkey", "run")


@query("SELECT 'c' || o_custkey AS qid, 'order ' || o_orderkey AS docid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 7, o_orderkey) AS rank, round(o_totalprice, 2) AS score, 'run' AS run_name FROM orders")
def run_read(spark, sf):
    return rankings.read_run(spark, _run_path(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


def _jsonl_run_path(spark, sf) -> str:
    sign = F.when(F.col("o_custkey") % 2 == 0, -1).otherwise(1)
    row = F.to_json(F.struct(s("o_custkey").alias("id"), F.transform("items", lambda x: x["o_orderkey"].cast("string")).alias("docs"), F.transform("items", lambda x: x["price"] * sign).alias("scores")))
    return laid(by_customer(spark, sf), row, "o_custkey", "jsonl-run")


@query("SELECT o_custkey::VARCHAR AS qid, o_orderkey::VARCHAR AS docid, CASE WHEN o_custkey % 2 = 0 THEN -round(o_totalprice, 2) ELSE round(o_totalprice, 2) END AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, 2) DESC, o_orderkey) AS rank FROM orders")
def run_read_jsonl(spark, sf):
    """Scores that are all negative are ordered upwards."""
    return rankings.read_jsonl_run(spark, _jsonl_run_path(spark, sf)).select("qid", "docid", "score", F.col("rank").cast("long").alias("rank"))


def _results_path(spark, sf) -> str:
    item = lambda x: F.struct((x["o_orderkey"] % 5).cast("int").alias("rank"), x["price"].alias("score"), F.concat(F.lit("order "), x["o_orderkey"].cast("string")).alias("title"))
    row = F.to_json(F.struct(F.concat(F.lit("query "), s("o_custkey")).alias("query"), F.array().cast("array<string>").alias("relevant"), F.transform("items", item).alias("retrieved")))
    return laid(by_customer(spark, sf), row, "o_custkey", "results")


RESULTS_SQL = "r AS (SELECT dense_rank() OVER (ORDER BY o_custkey) AS line, o_custkey, o_orderkey, round(o_totalprice, 2) score FROM orders)"


@query(f"""WITH {RESULTS_SQL} SELECT 'score' AS kind, line::VARCHAR AS qid, 'order ' || o_orderkey AS docid, row_number() OVER (PARTITION BY line ORDER BY score DESC, o_orderkey) AS rank FROM r
UNION ALL SELECT 'rank', line::VARCHAR, 'order ' || o_orderkey, row_number() OVER (PARTITION BY line ORDER BY o_orderkey % 5, o_orderkey) FROM r UNION ALL SELECT 'ids', 'q' || o_custkey, 'order ' || o_orderkey, row_number() OVER (PARTITION BY line ORDER BY score DESC, o_orderkey) FROM r""")
def results_read(spark, sf):
    """By score, by the items' own rank, and with ids from a file of queries."""
    path = _results_path(spark, sf)
    ids = judgments.read_query_ids(spark, laid(by_customer(spark, sf), F.to_json(F.struct(F.concat(F.lit("q"), s("o_custkey")).alias("_id"))), "o_custkey", "result-ids"))
    kinds = {"score": rankings.read_results(spark, path), "rank": rankings.read_results(spark, path, by_rank=True), "ids": rankings.read_results(spark, path, ids)}
    parts = [r.select(F.lit(k).alias("kind"), "qid", "docid", F.col("rank").cast("long").alias("rank")) for k, r in kinds.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def _text_results(spark, sf) -> str:
    docs = F.transform("items", lambda x: F.struct(x["o_orderkey"].cast("string").alias("doc_id"), x["price"].alias("score")))
    rows = by_customer(spark, sf).join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return laid(rows, F.to_json(F.struct(s("o_custkey").alias("query_id"), F.upper("c_name").alias("nl_query"), docs.alias("documents"))), "o_custkey", "text-results")


@query("SELECT 'q' || o_custkey AS qid, o_orderkey::VARCHAR AS docid, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, 2) DESC, o_orderkey) AS rank FROM orders JOIN customer ON o_custkey = c_custkey")
def text_results_read(spark, sf):
    ids = t(spark, sf, "customer").select(F.col("c_name").alias("text"), F.concat(F.lit("q"), s("c_custkey")).alias("qid"))
    return rankings.read_text_results(spark, _text_results(spark, sf), ids).select("qid", "docid", F.col("rank").cast("long").alias("rank"))


@query("""SELECT 'text' AS kind, upper(c_name) AS qid, o_orderkey::VARCHAR AS docid, round(o_totalprice, 2) AS score FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'hash', substr(md5(upper(c_name)), 1, 16), o_orderkey::VARCHAR, round(o_totalprice, 2) FROM orders JOIN customer ON o_custkey = c_custkey""")
def text_results_converted(spark, sf):
    rows = records.read_jsonl(spark, _text_results(spark, sf), rankings.TEXT_RESULT)
    lists = records.text_results_for_evaluation(rows).select(F.lit("text").alias("kind"), F.col("id").alias("qid"), F.explode(F.arrays_zip("docs", "scores")).alias("x")).select("kind", "qid", F.col("x.docs").alias("docid"), F.col("x.scores").alias("score"))
    return lists.unionAll(records.text_results_by_hash(rows).select(F.lit("hash").alias("kind"), "qid", "docid", "score"))


@query("""SELECT 'c' || o_custkey AS qid, CASE o_orderkey % 3 WHEN 0 THEN 'order ' || o_orderkey WHEN 1 THEN 'tab ' || o_orderkey || ' x' ELSE 'plain doc-' || o_orderkey END AS docid, round(o_totalprice, 2) AS score, CASE o_orderkey % 3 WHEN 2 THEN 'name' ELSE 'run' END AS run_name,
row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, 2) DESC, CASE o_orderkey % 3 WHEN 0 THEN 9 ELSE 0 END, o_orderkey) AS rank FROM orders""")
def run_read_flexible(spark, sf):
    """Six fields, tab-separated, or a document's words and a score."""
    k, c = F.col("o_orderkey"), F.concat(F.lit("c"), s("o_custkey"))
    line = F.when(k % 3 == 0, F.concat_ws(" ", c, F.lit("Q0 order"), s("o_orderkey"), F.lit("9"), price().cast("string"), F.lit("run"))).when(k % 3 == 1, F.concat_ws("\t", c, F.concat(F.lit("tab "), s("o_orderkey"), F.lit(" x")), price().cast("string")))
    line = line.otherwise(F.concat_ws(" ", c, F.lit("plain"), F.concat(F.lit("doc-"), s("o_orderkey")), price().cast("string"), F.lit("name")))
    return rankings.read_flexible_run(spark, laid(orders(spark, sf), line, "o_orderkey", "flexible")).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH r AS (SELECT 'trec' AS kind, 'c' || o_custkey AS qid FROM orders UNION ALL SELECT 'jsonl', o_custkey::VARCHAR FROM orders UNION ALL SELECT 'results', dense_rank() OVER (ORDER BY o_custkey)::VARCHAR FROM orders) SELECT kind, qid, count(*) AS n FROM r GROUP BY ALL""")
def runs_read_by_format(spark, sf):
    paths = {"trec": _run_path(spark, sf), "jsonl": _jsonl_run_path(spark, sf), "results": _results_path(spark, sf)}
    parts = [rankings.read_by_format(spark, path, kind).select(F.lit(kind).alias("kind"), "qid") for kind, path in paths.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("kind", "qid").agg(F.count("*").alias("n"))


@query(f"WITH {RUN_SQL} SELECT qid::VARCHAR AS qid, docid::VARCHAR AS docid, rank, round(score, 6) AS score FROM run")
def run_round_trip(spark, sf):
    run = dense_run(spark, sf)
    out = scratch(spark, "written-run")
    rankings.write_run(run.select(s("qid").alias("qid"), s("docid").alias("docid"), "rank", "score", F.lit("r").alias("run_name")), out)
    return rankings.read_run(spark, out).select("qid", "docid", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("SELECT dense_rank() OVER (ORDER BY o_custkey)::VARCHAR AS qid, 'title of ' || o_orderkey AS docid, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, 2) DESC, o_orderkey) AS rank FROM orders")
def results_written(spark, sf):
    """A JSON line for each query with titles looked up by id, read back."""
    run = orders(spark, sf).select(s("o_custkey").alias("qid"), s("o_orderkey").alias("docid"), price().alias("score"), "o_orderkey")
    run = run.withColumn("rank", F.expr("row_number() over (partition by qid order by score desc, o_orderkey)"))
    titles = orders(spark, sf).select(s("o_orderkey").alias("docid"), F.concat(F.lit("title of "), s("o_orderkey")).alias("title"))
    queries = by_customer(spark, sf).select(F.col("o_custkey").alias("position"), s("o_custkey").alias("qid"), F.concat(F.lit("q "), s("o_custkey")).alias("text"), F.array().cast("array<string>").alias("relevant"))
    rows = rankings.result_rows(run.select("qid", "docid", "rank", "score"), queries, titles)
    return rankings.read_results(spark, laid(rows, F.col("value"), "position", "written-results"), by_rank=True).select("qid", "docid", F.col("rank").cast("long").alias("rank"))


# --- records -----------------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY c_custkey) AS line_no, c_custkey, c_name, c_acctbal FROM customer")
def jsonl_round_trip(spark, sf):
    out = scratch(spark, "json")
    records.write_jsonl(t(spark, sf, "customer").repartitionByRange(3, "c_custkey").sortWithinPartitions("c_custkey"), out)
    return records.read_jsonl(spark, out, "c_custkey long, c_name string, c_acctbal double")


@query("SELECT o_custkey::VARCHAR AS id, 'q ' || o_custkey AS query, count(*) AS docs, '_' AS template, 'o' AS original_query FROM orders GROUP BY o_custkey")
def examples_round_trip(spark, sf):
    """Fields of metadata that are not known are ignored."""
    row = F.struct(F.concat(F.lit("q "), s("o_custkey")).alias("query"), F.transform("items", lambda x: x["o_orderkey"].cast("string")).alias("docs"), F.lit("o").alias("original_query"), F.struct(F.lit("_").alias("template"), F.lit(1).alias("more")).alias("metadata"), s("o_custkey").alias("id"))
    got = records.read_examples(spark, laid(by_customer(spark, sf), F.to_json(row), "o_custkey", "examples"))
    return got.select("id", "query", F.size("docs").cast("long").alias("docs"), "metadata.template", "original_query")


def _documents(spark, sf) -> str:
    idx = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("d"), s("doc_id")))
    row = F.struct(F.concat(F.lit("title "), (F.col("doc_id") % 50).cast("string")).alias("title"), "text", idx.alias("idx"), F.lit(1).alias("other"))
    return laid(t(spark, sf, "documents"), F.to_json(row), "doc_id", "documents")


DOCS_SQL = "d AS (SELECT row_number() OVER (ORDER BY doc_id) line, 'title ' || doc_id % 50 AS title, text, CASE WHEN doc_id % 2 = 0 THEN 'd' || doc_id END idx FROM documents)"


@query(f"WITH {DOCS_SQL} SELECT title, md5(arg_max(text, line)) AS digest, max(line) AS line_no FROM d GROUP BY title")
def documents_by_title(spark, sf):
    got = records.last_by_title(records.read_documents(spark, _documents(spark, sf)))
    return got.select("title", F.md5("text").alias("digest"), "line_no")


@query(f"WITH {DOCS_SQL} SELECT coalesce(idx, (line - 1)::VARCHAR) AS docid, title, md5(text) AS digest FROM d")
def corpus_read(spark, sf):
    return records.read_corpus(spark, _documents(spark, sf)).select("docid", "title", F.md5("text").alias("digest"))


@query(f"WITH {DOCS_SQL} SELECT coalesce(idx, (line - 1)::VARCHAR) AS docid, md5(regexp_replace(title || '. ' || text, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')) AS digest FROM d")
def corpus_indexed(spark, sf):
    return records.index_corpus(records.read_documents(spark, _documents(spark, sf))).select("docid", F.md5("doc_text").alias("digest"))


@query(f"WITH {DOCS_SQL} SELECT coalesce(idx, (line - 1)::VARCHAR) AS docid FROM d WHERE line <= 100")
def corpus_indexed_first(spark, sf):
    """The first documents only, as the limit of an index asks."""
    return records.index_corpus(records.read_documents(spark, _documents(spark, sf)), most=100).select("docid")


@query(f"WITH {DOCS_SQL} SELECT line - 1 AS idx, title, md5(title || ' ' || regexp_replace(text, '[\\r\\n]+', ' ', 'g')) AS digest FROM d")
def document_maps(spark, sf):
    titles, texts = records.document_maps(records.read_documents(spark, _documents(spark, sf)))
    return titles.join(texts, "idx").select("idx", "title", F.md5("text").alias("digest"))


@query("SELECT n_nationkey, n_name, n_regionkey::VARCHAR AS region, md5(n_nationkey || chr(9) || n_name || chr(9) || n_regionkey) AS line FROM nation")
def tsv_round_trip(spark, sf):
    out = scratch(spark, "tsv")
    records.write_tsv(t(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").repartitionByRange(3, "n_nationkey").sortWithinPartitions("n_nationkey"), out)
    cells, lines = records.read_tsv(spark, out), records.read_text_lines(spark, out)
    return joins.zip_by_line(cells, lines).select(F.col("cells")[0].cast("int").alias("n_nationkey"), F.col("cells")[1].alias("n_name"), F.col("cells")[2].alias("region"), F.md5("line").alias("line"))


@query("SELECT dense_rank() OVER (ORDER BY o_custkey) AS position, 'q ' || o_custkey AS text, count(*) AS n FROM orders GROUP BY o_custkey UNION ALL SELECT dense_rank() OVER (ORDER BY o_custkey), 'v ' || o_custkey, count(*) FROM orders GROUP BY o_custkey")
def retrieval_queries_read(spark, sf):
    docs = F.transform("items", lambda x: x["o_orderkey"].cast("string"))
    plain = laid(by_customer(spark, sf), F.to_json(F.struct(F.concat(F.lit("q "), s("o_custkey")).alias("query"), docs.alias("docs"))), "o_custkey", "queries")
    variants = laid(by_customer(spark, sf), F.to_json(F.struct(F.concat(F.lit("v "), s("o_custkey")).alias("nl_query"), docs.alias("documents"))), "o_custkey", "variant-queries")
    both = records.read_retrieval_queries(spark, plain).unionAll(records.read_retrieval_queries(spark, variants, variants=True))
    return both.select("position", "text", F.size("relevant").cast("long").alias("n"))


@query("SELECT c_name AS entity, c_mktsegment AS attr FROM customer UNION SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def liked_relation(spark, sf):
    c = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    row = F.to_json(F.struct(F.col("c_name").alias("_id"), F.concat("c_name", F.lit(" likes "), "c_mktsegment", F.lit(", and "), "n_name", F.lit(".")).alias("text")))
    return records.entity_attributes(records.read_jsonl(spark, laid(c, row, "c_custkey", "corpus"), "_id string, text string"))


@query("SELECT n_nationkey AS k, n_name AS v, n_regionkey AS r FROM nation WHERE n_nationkey % 3 > 0 AND n_regionkey <> 4 UNION ALL SELECT n_nationkey, 'new', NULL FROM nation WHERE n_nationkey % 3 = 0")
def rows_upserted(spark, sf):
    """CSV rows with new ones in place of those of equal key; rows of an older kind go."""
    out = scratch(spark, "csv")
    old = t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"), F.col("n_regionkey").alias("r"))
    old.write.option("header", True).csv(out)
    new = old.where("k % 3 = 0").select("k", F.lit("new").alias("v"))
    return records.upsert(spark.read.schema(old.schema).option("header", True).csv(out), new, ["k"], "r = 4")


@query(f"""WITH {SCORES_SQL} SELECT max(n) num_queries, max(r) FILTER (cutoff = 5) recall_5, max(r) FILTER (cutoff = 20) recall_20, max(d) FILTER (cutoff = 20) ndcg_20, '[5,20]' AS cutoffs FROM (SELECT cutoff, count(*) n, round(avg(recall), 6) r, round(avg(ndcg), 6) d FROM f GROUP BY cutoff)""")
def metrics_as_json(spark, sf):
    means = rounded(metrics.evaluate(dense_run(spark, sf), label_qrels(spark, sf), [5, 20], check=False), "recall", "ndcg")
    of = lambda path: F.get_json_object("value", path)
    return records.metrics_json([5, 20], means).select(of("$.num_queries").cast("long").alias("num_queries"), of("$.recall.5").cast("double").alias("recall_5"), of("$.recall.20").cast("double").alias("recall_20"), of("$.ndcg.20").cast("double").alias("ndcg_20"), of("$.cutoffs").alias("cutoffs"))


@query("SELECT 'pair' AS kind, dense_rank() OVER (ORDER BY o_custkey) - 1 AS qidx, o_orderkey + 7 AS docidx, NULL AS query, NULL AS text FROM orders UNION ALL SELECT 'query', dense_rank() OVER (ORDER BY o_custkey) - 1, NULL, 'q ' || o_custkey, NULL FROM (SELECT DISTINCT o_custkey FROM orders) UNION ALL SELECT 'text', NULL, NULL, 'q ' || o_custkey, 'text of ' || o_orderkey FROM orders")
def examples_indexed(spark, sf):
    docs = F.transform("items", lambda x: x["o_orderkey"].cast("string"))
    path = laid(by_customer(spark, sf), F.to_json(F.struct(F.concat(F.lit("q "), s("o_custkey")).alias("query"), docs.alias("docs"))), "o_custkey", "indexed")
    titles = orders(spark, sf).select(s("o_orderkey").alias("title"), (F.col("o_orderkey") + 7).alias("idx"), F.concat(F.lit("text of "), s("o_orderkey")).alias("text"))
    queries, pairs, texts = records.indexed_examples(records.read_examples(spark, path), titles)
    none = lambda kind: F.lit(None).cast(kind)
    rows = pairs.select(F.lit("pair").alias("kind"), "qidx", F.col("docidx").alias("docidx"), none("string").alias("query"), none("string").alias("text"))
    return rows.unionAll(queries.select(F.lit("query"), "qidx", none("long"), "query", none("string"))).unionAll(texts.select(F.lit("text"), none("long"), none("long"), "query", "text"))


@query(f"""WITH {RUN_SQL} SELECT 'q' || qid AS qid, 'doc ' || docid AS docid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, 'doc ' || docid) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 20""")
def embeddings_saved(spark, sf):
    """Vectors with text ids are written, opened again with a check of their number and length, and searched."""
    e = t(spark, sf, "embeddings")
    out = scratch(spark, "vectors")
    records.write_embeddings(e.select(F.concat(F.lit("doc "), s("vec_id")).alias("docid"), "embedding"), out)
    opened = records.checked_embeddings(spark.read.parquet(out), e.count(), 64)
    own = e.where("vec_id % 100 = 0").select(F.concat(F.lit("q"), s("vec_id")).alias("qid"), F.concat(F.lit("doc "), s("vec_id")).alias("own"), "embedding")
    found = dense.search(own, opened, 21).join(own.select("qid", "own"), "qid").where("docid <> own")
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by qid order by score desc, docid)")).where("rank <= 20")
    return rounded(ranked.select("qid", "docid", F.col("rank").cast("long").alias("rank"), "score"), "score")


@query("""WITH d AS (SELECT 'm' || o_custkey % 3 AS model, o_custkey query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) rank, (o_orderkey % 4 = 0)::INT is_gold FROM orders), k AS (SELECT unnest([1, 3, 10]) cutoff),
c AS (SELECT model, query_id, cutoff, sum(is_gold) n_gold, count(*) FILTER (is_gold = 1 AND rank <= cutoff) hits FROM d, k GROUP BY ALL) SELECT model, cutoff, round(avg(CASE WHEN n_gold > 0 THEN hits / n_gold ELSE 0 END), 6) recall, round(avg(hits / cutoff), 6) AS precision, count(*) num_queries FROM c GROUP BY ALL""")
def details_merged(spark, sf):
    """Details in three CSV chunks, read as one table without repeats, and their metrics."""
    d = orders(spark, sf).select(F.concat(F.lit("m"), (F.col("o_custkey") % 3).cast("string")).alias("model"), F.col("o_custkey").alias("query_id"), F.expr("row_number() over (partition by o_custkey order by o_orderkey)").alias("rank"), (F.col("o_orderkey") % 4 == 0).cast("int").alias("is_gold"))
    paths = []
    for chunk in range(3):
        paths.append(scratch(spark, f"details-{chunk}"))
        d.where(F.col("query_id") % 3 == chunk).write.option("header", True).csv(paths[-1])
    merged = records.read_details(spark, paths, "model string, query_id long, rank int, is_gold int")
    return rounded(A.detail_metrics(merged, ["model"], [1, 3, 10]).select("model", "cutoff", "recall", "precision", "num_queries"), "recall", "precision")


@query("SELECT c_custkey FROM customer QUALIFY row_number() OVER (ORDER BY c_custkey) BETWEEN 11 AND 40")
def predictions_sliced(spark, sf):
    """The slice of a file that one job of an array works on."""
    path = laid(t(spark, sf, "customer"), F.to_json(F.struct("c_custkey")), "c_custkey", "predictions")
    return records.sliced(records.read_jsonl(spark, path, "c_custkey long"), first=40, start=10, stop=60).select("c_custkey")


@query("SELECT o_custkey % 5 AS shard, count(*) AS expected, count(*) AS n, true AS valid FROM orders GROUP BY ALL UNION ALL SELECT 5, 3, 0, false")
def shards_checked(spark, sf):
    rows = orders(spark, sf).select((F.col("o_custkey") % 5).alias("shard"))
    expected = rows.groupBy("shard").agg(F.count("*").alias("expected")).unionAll(spark.createDataFrame([(5, 3)], "shard long, expected long"))
    return records.valid_shards(rows, expected)


# --- stores that another job opens --------------------------------------------------------------

#: Vectors of different lengths, so that an index ordered by length can skip shards.
LONG_SQL = """e AS (SELECT 'doc ' || vec_id AS docid, vec_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + (vec_id * 7) % 16)) v FROM embeddings),
s AS (SELECT 'q' || q.vec_id AS qid, d.docid, list_inner_product(q.v, d.v) score FROM e q JOIN e d ON TRUE WHERE q.vec_id % 100 = 0)"""


@query(f"WITH {LONG_SQL} SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 100")
def vector_index_opened(spark, sf):
    """An index is written in shards by falling length; it is opened from its path, checked against its manifest, and asked for the top 100."""
    e = t(spark, sf, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * (1 + (F.col("vec_id") * 7) % 16)))
    e = e.select("vec_id", F.concat(F.lit("doc "), s("vec_id")).alias("docid"), "embedding")
    at = scratch(spark, "vector-index")
    stores.write_index(e, at, shard_rows=64)
    asked = e.where("vec_id % 100 = 0").select(F.concat(F.lit("q"), s("vec_id")).alias("qid"), "embedding")
    found = stores.search_index(stores.open_index(spark, at), asked, 100)
    return rounded(found.rows.withColumn("rank", F.col("rank").cast("long")).select("qid", "docid", "rank", "score"), "score")


@query("""WITH a AS (SELECT doc_id, md5(text) AS digest, lang FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, md5(text || '!') AS digest, lang FROM documents WHERE doc_id % 3 <> 1),
st AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)) SELECT docid, lang, digest FROM (SELECT 'd' || doc_id AS docid, * FROM st) WHERE doc_id IN (SELECT doc_id FROM labels)""")
def documents_stored(spark, sf):
    """Documents are added in two batches that overlap (the first stays); those that have labels are fetched by id."""
    d = t(spark, sf, "documents").select("doc_id", F.concat(F.lit("d"), s("doc_id")).alias("docid"), "lang", "text")
    at = scratch(spark, "document-store")
    stores.DocumentStore.create(spark, at, "docid string, lang string, text string").add(d.where("doc_id % 3 <> 0"))
    store = stores.DocumentStore.open(spark, at)
    store.add(d.where("doc_id % 3 <> 1").withColumn("text", F.concat("text", F.lit("!"))))
    ids = t(spark, sf, "labels").select(F.concat(F.lit("d"), s("doc_id")).alias("docid"))
    return store.fetch_all(ids).select("docid", "lang", F.md5("text").alias("digest"))


@query("SELECT l_suppkey % 16 AS shard, count(*) AS n, sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY ALL")
def shards_repaired(spark, sf):
    """Of a table in shards one loses rows and one all of them; both, and no others, are computed again."""
    rows = t(spark, sf, "lineitem").select((F.col("l_suppkey") % 16).cast("int").alias("shard"), "l_orderkey", "l_linenumber")
    expected = rows.groupBy("shard").agg(F.count("*").alias("expected"))
    again = lambda wanted: rows.join(F.broadcast(wanted), "shard", "left_semi")  # noqa: E731  a name for each shard
    at = scratch(spark, "shards")
    again(expected.where("shard <> 5").select("shard")).where("shard <> 2 or l_linenumber > 1").write.partitionBy("shard").parquet(at)
    incremental.repaired(spark, at, expected, again)
    return spark.read.parquet(at).groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"), F.sum("l_linenumber").cast("long").alias("total"))
