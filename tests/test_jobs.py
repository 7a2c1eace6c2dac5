import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import build_queries, common, index_corpus
from rankloom.operators import sparse
from rankloom.sources.scratch import scratch

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def plain(rows):
    return sorted((tuple(map(str, r)) for r in rows.collect()))


# --- index_corpus ------------------------------------------------------------------------------


def add(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, more int").write.mode("append").parquet(folder)


def test_only_new_documents_are_indexed(spark):
    folder, out = scratch(spark, "docs"), scratch(spark, "index")
    check = f"{out}/checkpoint"
    first = [(1, "a b a", "en", 0), (2, None, "de", 0), (3, "", None, 0), (None, "x", "en", 0), (4, "É é c", "fr", 0), (1, "a b a", "en", 0)]
    add(spark, folder, first)
    told = index_corpus.index_corpus(spark, folder, out, check)
    assert (told["documents"], told["postings"], told["read"]) == (4, 4, 5)  # rows with an id
    files = set(spark.read.parquet(f"{out}/postings").inputFiles())
    add(spark, folder, [(5, "a c", "en", 0), (1, "other words", "en", 0)])
    told = index_corpus.index_corpus(spark, folder, out, check)
    assert (told["documents"], told["postings"], told["read"]) == (1, 2, 2)
    assert files < set(spark.read.parquet(f"{out}/postings").inputFiles())  # what was there is not touched
    assert index_corpus.index_corpus(spark, folder, out, check)["documents"] == 0
    got = {tuple(r)[:5] for r in index_corpus.read_postings(spark, out).collect()}
    assert got == {(1, "a", 2, 3, "en"), (1, "b", 1, 3, "en"), (4, "é", 2, 3, "fr"), (4, "c", 1, 3, "fr"), (5, "a", 1, 2, "en"), (5, "c", 1, 2, "en")}
    assert spark.read.parquet(f"{out}/documents").count() == 5


def test_growing_corpus_equals_index_of_all(spark):
    """The table's rows arrive in two runs, the first in several batches; the postings are those of the library's index over the whole table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder, out = scratch(spark, "docs"), scratch(spark, "index")
    docs.where("doc_id % 3 > 0").repartition(4).write.parquet(folder)
    assert index_corpus.index_corpus(spark, folder, out, f"{out}/checkpoint", files_per_batch=2)["batches"] == 2
    docs.where("doc_id % 3 = 0").union(docs.limit(20)).write.mode("append").parquet(folder)
    index_corpus.index_corpus(spark, folder, out, f"{out}/checkpoint", files_per_batch=2)
    want = sparse.index(docs.select(F.col("doc_id").alias("docid"), "text"))[0]
    assert plain(index_corpus.read_postings(spark, out).select("docid", "term", "tf", "len")) == plain(want.select("docid", "term", "tf", "len"))


def test_a_batch_that_fails_is_run_again(spark, monkeypatch):
    folder, out = scratch(spark, "docs"), scratch(spark, "index")
    add(spark, folder, [(i, f"w{i} w{i % 3}", "en", 0) for i in range(20)])
    real = index_corpus.index_batch

    def stops(*args):
        real(*args)
        raise RuntimeError("lost after writing")

    monkeypatch.setattr(index_corpus, "index_batch", stops)
    with pytest.raises(Exception, match="lost after writing"):
        index_corpus.index_corpus(spark, folder, out, f"{out}/checkpoint")
    monkeypatch.setattr(index_corpus, "index_batch", real)
    assert index_corpus.index_corpus(spark, folder, out, f"{out}/checkpoint")["documents"] == 20
    got = index_corpus.read_postings(spark, out)
    assert got.count() == got.distinct().count() == 37 and spark.read.parquet(f"{out}/documents").count() == 20


def test_output_is_partitioned(spark):
    folder, out = scratch(spark, "docs"), scratch(spark, "index")
    add(spark, folder, [(1, "a b c d e f g h", "en", 0)])
    index_corpus.index_corpus(spark, folder, out, f"{out}/checkpoint", buckets=4)
    plan = spark.read.parquet(f"{out}/postings").where("bucket = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert {r[0] for r in index_corpus.read_postings(spark, out).select("bucket").collect()} <= {0, 1, 2, 3}


def test_postings_are_counted_where_documents_are(spark):
    rows = [(1, "en", ["b", "a", "b"]), (2, None, []), (3, "de", ["É", "a", "é", "a", "a"]), (4, "fr", ["𝒳"]), (5, "fr", [])]
    own = spark.createDataFrame(rows, "docid long, `lan guage` string, w array<string>").repartition(2)
    got = sparse.row_postings(own, 16, "lan guage")
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    bucket = (F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 4), 16, 10).cast("int") % 16).alias("bucket")
    columns = ["docid", "lan guage", "len", "term", "tf"]
    want = sparse.postings(own, "lan guage").select(*(F.col(f"`{c}`") for c in columns), bucket)
    assert plain(got.select(*(F.col(f"`{c}`") for c in columns), "bucket")) == plain(want) and got.count() == 6
    assert sparse.row_postings(own.where("docid = 2"), 16).count() == 0


def test_shares_of_buckets_keep_their_size(spark, monkeypatch):
    assert [index_corpus.shares_of(n, 16) for n in (0, 10**6, 10**9, 2 * 10**9)] == [4, 4, 32, 63]
    folder, out = scratch(spark, "docs"), scratch(spark, "index")
    add(spark, folder, [(i, "a b c d", "en", 0) for i in range(200)])
    monkeypatch.setattr(index_corpus, "SHARE_WORDS", 8)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    index_corpus.index_corpus(spark, folder, out, f"{out}/checkpoint", buckets=1)
    assert len(spark.read.parquet(f"{out}/postings").inputFiles()) > 8  # one bucket of 800 words in 100 shares, by four a task
    assert index_corpus.read_postings(spark, out).count() == 800 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


# --- build_queries -----------------------------------------------------------------------------

TABLES = [f"{SF}/{t}.parquet" for t in ("orders", "lineitem", "part")]


def test_queries_have_their_answers_and_reruns_change_nothing(spark):
    out = scratch(spark, "queries")
    told = build_queries.build_queries(spark, *TABLES, out, queries=20)
    queries, qrels = build_queries.read_queries(spark, out).collect(), build_queries.read_qrels(spark, out)
    assert told["queries"] == len(queries) == 80 and len({q["id"] for q in queries}) == 80
    own = {}
    for r in build_queries.habits(*(spark.read.parquet(p) for p in TABLES)).collect():
        own.setdefault(r["entity"], set()).add(r["attr"])
    found = {}
    for r in qrels.collect():
        found.setdefault(r["qid"], set()).add(r["docid"])
    for q in queries:
        a, b = (*q["attrs"], None)[:2]
        has = {"_": lambda s: a in s, "_ or _": lambda s: a in s or b in s, "_ that are also _": lambda s: a in s and b in s, "_ that are not _": lambda s: a in s and b not in s}[q["template"]]
        assert found[q["id"]] == {e for e, s in own.items() if has(s)} and len(found[q["id"]]) == q["num_docs"]
        assert all(x in q["query"] for x in q["attrs"]) and q["depth"] == len(q["attrs"])
    before = plain(build_queries.read_queries(spark, out)), plain(qrels)
    build_queries.build_queries(spark, *TABLES, out, queries=20)
    assert (plain(build_queries.read_queries(spark, out)), plain(build_queries.read_qrels(spark, out))) == before


def test_one_template_is_built_anew_and_others_stay(spark):
    out = scratch(spark, "queries")
    build_queries.build_queries(spark, *TABLES, out, queries=6)
    others = plain(build_queries.read_queries(spark, out).where("template <> '_'"))
    told = build_queries.build_queries(spark, *TABLES, out, queries=9, templates=["_"])
    assert told["queries"] == 9 and plain(build_queries.read_queries(spark, out).where("template <> '_'")) == others
    assert build_queries.read_queries(spark, out).where("template = '_'").count() == 9


def test_settings_are_checked(spark):
    for wrong in ({"templates": ["x"]}, {"templates": []}, {"many": 3}):
        with pytest.raises(ValueError, match="unknown"):
            build_queries.build_queries(spark, *TABLES, "nowhere", **wrong)
    assert common.settings(index_corpus.__file__, buckets=3)["buckets"] == 3


# --- command line ------------------------------------------------------------------------------


def test_command_line(tmp_path):
    """A process of its own: reads the tables, writes, logs, and stops its session."""
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"buckets": 2}))
    run = [sys.executable, str(ROOT / "jobs/index_corpus.py"), "--documents", f"{SF}/documents.parquet", "--output", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "check"), "--config", str(config)]
    first, second = (subprocess.run(run, capture_output=True, text=True, timeout=300) for _ in range(2))
    assert first.returncode == second.returncode == 0, first.stderr[-2000:] + second.stderr[-2000:]
    assert "wrote 200 documents" in first.stderr and "wrote 0 documents" in second.stderr
    assert {p.name for p in (tmp_path / "out/postings/batch=0").iterdir() if p.is_dir()} == {"bucket=0", "bucket=1"}
