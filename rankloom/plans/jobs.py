"""Registered queries of the jobs: each job runs twice over whole tables into one new folder, and what is there then is read back."""

from __future__ import annotations

from jobs import build_queries, index_corpus
from pyspark.sql import functions as F

from rankloom.plans.catalog import query
from rankloom.sources.scratch import kept_folder

KINDS_SQL = """ea AS (SELECT o_custkey entity, p_type || '/' || p_size AS attr FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey UNION SELECT o_custkey, o_orderpriority FROM orders UNION SELECT o_custkey, 'state ' || o_orderstatus FROM orders),
z AS (SELECT entity, list(attr) l FROM ea GROUP BY entity)"""


@query(r"""WITH d AS (SELECT doc_id docid, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM documents), p AS (SELECT docid, lang, len(w) n, unnest(w) term FROM d)
SELECT docid, term, count(*) AS tf, n AS len, lang AS language, ('0x' || substr(md5(term), 1, 4))::BIGINT % 16 AS bucket FROM p GROUP BY docid, term, n, lang""")
def job1_index_corpus(spark, sf):
    """The postings of all documents; the second run finds no new file and adds nothing."""
    at = kept_folder(spark, "job1")
    for _ in range(2):
        index_corpus.index_corpus(spark, f"{sf}/documents.parquet", f"{at}/output", f"{at}/checkpoint")
    return index_corpus.read_postings(spark, f"{at}/output").withColumns({c: F.col(c).cast("long") for c in ("len", "bucket")})


@query(f"""WITH {KINDS_SQL}, n AS (SELECT attr, count(*) n FROM ea GROUP BY attr), m AS (SELECT x.attr a, y.attr b, count(*) nab FROM ea x JOIN ea y ON x.entity = y.entity AND x.attr < y.attr GROUP BY ALL),
g AS (SELECT x.attr a, y.attr b, x.n na, y.n nb, coalesce(nab, 0) nab FROM n x JOIN n y ON x.attr < y.attr LEFT JOIN m ON m.a = x.attr AND m.b = y.attr),
v AS (SELECT '_' AS template, 0 AS place, attr AS k, attr AS a, NULL AS b, n AS num_docs FROM n UNION ALL SELECT '_ or _', 1, a || '|' || b, a, b, na + nb - nab FROM g UNION ALL SELECT '_ that are also _', 3, a || '|' || b, a, b, nab FROM g UNION ALL SELECT '_ that are not _', 6, a || '|' || b, a, b, na - nab FROM g UNION ALL SELECT '_ that are not _', 6, b || '|' || a, b, a, nb - nab FROM g),
w AS (SELECT *, md5('42|' || template || '|' || k) o, CASE WHEN num_docs <= 20 THEN 0 WHEN num_docs <= 50 THEN 1 WHEN num_docs <= 100 THEN 2 WHEN num_docs <= 150 THEN 3 ELSE 4 END bucket FROM v WHERE num_docs BETWEEN 1 AND 200),
f AS (SELECT *, row_number() OVER (PARTITION BY template, bucket ORDER BY o, k) i FROM w), s AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY (i > 20)::INT, o, k) j FROM f WHERE i <= 100 QUALIFY j <= 100),
q AS (SELECT *, place || '-' || row_number() OVER (PARTITION BY template ORDER BY k) AS id FROM s)
SELECT id, template, CASE template WHEN '_' THEN 'Who likes ' || a || '?' WHEN '_ or _' THEN 'Who likes ' || a || ' or ' || b || '?' WHEN '_ that are also _' THEN 'Who likes ' || a || ' and also likes ' || b || '?' ELSE 'Who likes ' || a || ' but not ' || b || '?' END AS query, num_docs, bucket, entity AS docid
FROM q JOIN z ON CASE template WHEN '_' THEN list_contains(l, a) WHEN '_ or _' THEN list_contains(l, a) OR list_contains(l, b) WHEN '_ that are also _' THEN list_contains(l, a) AND list_contains(l, b) ELSE list_contains(l, a) AND NOT list_contains(l, b) END""")
def job2_build_queries(spark, sf):
    """Queries with their judgments; the second run replaces the same folders with the same rows."""
    at = kept_folder(spark, "job2")
    for _ in range(2):
        build_queries.build_queries(spark, *(f"{sf}/{t}.parquet" for t in ("orders", "lineitem", "part")), at)
    queries, qrels = build_queries.read_queries(spark, at), build_queries.read_qrels(spark, at)
    return queries.join(qrels.withColumnRenamed("qid", "id"), ["id", "template"]).select("id", "template", "query", "num_docs", F.col("bucket").cast("long").alias("bucket"), "docid")
