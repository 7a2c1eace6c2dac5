import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import dense, impacts, sparse
from rankloom.sources import records, stores
from rankloom.sources.scratch import scratch
from rankloom.streaming import incremental

SF = "/root/testdata/sf0.001"


# --- BM25 over impacts -------------------------------------------------------------------------


def all_pairs(queries, docs, k):
    """The k best from the scores of all pairs that share a term."""
    found = {}
    for r in sparse.scores(queries, docs).collect():
        found.setdefault(r["qid"], []).append((-round(r["score"], 9), r["docid"]))
    return {(q, d, -s) for q, rows in found.items() for s, d in sorted(rows)[:k]}


def zipf_documents(spark, n=1500, seed=1):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(3000)])
    p = 1 / np.arange(1, 3001)
    rows = [(f"d{i:05d}", " ".join(words[rng.choice(3000, size=rng.integers(0, 120), p=p / p.sum())])) for i in range(n)]
    rows += [(f"e{i}", rows[3][1]) for i in range(40)] + [("f", None), ("g", "")]
    return spark.createDataFrame(rows, "docid string, text string")


@pytest.mark.parametrize("k", [1, 7, 5000])
def test_impacts_equal_all_pairs(spark, monkeypatch, k):
    monkeypatch.setattr(impacts, "LEAST_DOCS", 400)
    monkeypatch.setattr(impacts, "BLOCK", 8)
    if k < 5000:
        monkeypatch.setattr(impacts, "PLAIN", 0)
    docs = zipf_documents(spark)
    queries = spark.createDataFrame([("q1", "w0 w1 w700"), ("q2", "w2 w2 w5 w44 w1999 w3"), ("q3", "none of these"), ("q4", ""), ("q5", None), ("q6", "w0")], "qid string, query string")
    got = {(r["qid"], r["docid"], round(r["score"], 9)) for r in impacts.search(queries, docs, k).collect()}
    want = all_pairs(queries, docs, k)
    assert {x[:2] for x in got} == {x[:2] for x in want}
    assert sorted(x[2] for x in got) == pytest.approx(sorted(x[2] for x in want), abs=1e-8)


def test_index_of_all_words_serves_any_query_and_more_words_than_are_broadcast(spark, monkeypatch):
    docs = zipf_documents(spark, 300)
    queries = spark.createDataFrame([("q1", "w0 w1 w7"), ("q2", "w5 w44")], "qid string, query string")
    monkeypatch.setattr(impacts, "BROADCAST_TERMS", 0)
    blocks, shards = impacts.build(docs)
    got = {(r["qid"], r["docid"], round(r["score"], 9)) for r in impacts.search_blocks(blocks, shards, queries, 5).collect()}
    assert {x[:2] for x in got} == {x[:2] for x in all_pairs(queries, docs, 5)}


def test_repeated_ids_are_one_document(spark):
    docs = spark.createDataFrame([(1, "x y z"), (1, "x"), (2, "x q"), (3, "q"), (4, "r"), (5, "s"), (None, "x")], "docid long, text string")
    queries = spark.createDataFrame([(9, "x")], "qid long, query string")
    rows = impacts.search(queries, docs, 5).collect()
    assert {r["docid"] for r in rows} == {1, 2}


def test_common_words_are_hardly_read(spark, monkeypatch):
    """Of the list of the commonest word few postings are read in order, and it is looked up for few documents."""
    monkeypatch.setattr(impacts, "PLAIN", 0)  # as in shards of full size
    docs = zipf_documents(spark, 6000, seed=3)
    queries = spark.createDataFrame([(f"q{i}", f"w0 w1 w{300 + i} w{500 + 2 * i} w{900 + i}") for i in range(20)], "qid string, query string")
    wanted = sparse.tokens(queries, "qid", "query").select("term").distinct()
    blocks, shards = impacts.build(docs, wanted=wanted)
    told = {r["term"]: r for r in impacts.postings_read(blocks, shards, queries, 10).collect()}
    common = told["w0"]
    assert common["queries"] == 20 and common["held"] > 20 * 4000
    assert common["read"] + common["looked"] < 0.1 * common["held"]


# --- dense search ------------------------------------------------------------------------------


def brute(rows, queries, k):
    out = []
    for q, v in queries:
        out += [(q, i, r + 1) for r, (s, i) in enumerate(sorted((-round(float(np.dot(v, w)), 9), i) for i, w in rows)[:k])]
    return set(out)


def test_dense_products_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(dense, "PRODUCT", 64)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(2)
    rows = [(i, np.round(rng.normal(size=3), 2).tolist()) for i in range(300)] + [(900 + i, [1.0, 1.0, 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    asked = [(i, v) for i, v in rows if i % 25 == 0]
    got = {(r["qid"], r["docid"], r["rank"]) for r in dense.search(spark.createDataFrame(asked, "qid long, v array<double>"), df, 12, key="id", vector="v").collect()}
    assert got == brute(rows, asked, 12)


# --- vector index ------------------------------------------------------------------------------


def vectors(spark, n=2000):
    rng = np.random.default_rng(4)
    rows = [(f"d{i:04d}", (rng.normal(size=8) * rng.pareto(2)).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "docid string, embedding array<double>")


def test_index_is_opened_checked_and_skips_shards(spark):
    rows, df = vectors(spark)
    path = scratch(spark, "index")
    stores.write_index(df.unionByName(spark.createDataFrame([("x", None), (None, [1.0] * 8)], df.schema)), path, shard_rows=100)
    index = stores.open_index(spark, path)
    assert index.rows == 2000 and index.dims == 8 and len(index.shards) == 20 and [s[2] for s in index.shards] == sorted((s[2] for s in index.shards), reverse=True)
    asked = [(i, v) for i, v in rows if i.endswith("00")]
    found = stores.search_index(index, spark.createDataFrame(asked, "qid string, embedding array<double>"), 10)
    assert {(r["qid"], r["docid"], r["rank"]) for r in found.rows.collect()} == brute(rows, asked, 10)
    assert found.shards == 20 and found.skipped >= 10


def test_spoiled_index_is_not_opened(spark):
    _, df = vectors(spark, 200)
    path = scratch(spark, "index")
    stores.write_index(df, path, shard_rows=50)
    one = spark.read.parquet(f"{path}/shards").where("shard = 2").withColumn("embedding", F.transform("embedding", lambda x: x + 1)).collect()
    spark.createDataFrame(one, "docid string, embedding array<double>, norm double, shard int").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{path}/shards")
    with pytest.raises(ValueError, match=r"\[2\]"):
        stores.open_index(spark, path)


def test_empty_index(spark):
    path = scratch(spark, "index")
    _, df = vectors(spark, 3)
    stores.write_index(df.limit(0), path)
    index = stores.open_index(spark, path)
    assert index.rows == 0 and stores.search_index(index, df.withColumnRenamed("docid", "qid"), 3).rows.collect() == []


# --- document store ----------------------------------------------------------------------------


def test_documents_are_added_in_batches_and_fetched_from_their_buckets(spark):
    path = scratch(spark, "store")
    store = stores.DocumentStore.create(spark, path, "docid string, title string, text string", buckets=16)
    assert store.fetch(["d1"]).collect() == [] and store.fetch([]).collect() == []
    row = lambda i, v: (f"d{i}", f"title {i}", v)
    schema = "docid string, title string, text string, other int"
    frame = lambda rows: spark.createDataFrame([(*r, 1) for r in rows], schema)
    first = [row(i, "one") for i in range(200)]
    store.add(frame([*first, row(3, "zzz"), (None, "a", "b")]))
    again = stores.DocumentStore.open(spark, path)
    again.add(frame([row(i, "two") for i in range(150, 300)]))
    again.add(frame([row(i, "two") for i in range(150, 300)]))
    assert again.read().count() == 300
    got = again.fetch(["d3", "d199", "d250", "nowhere"])
    assert sorted(tuple(r) for r in got.collect()) == sorted([row(3, "one"), row(199, "one"), row(250, "two")])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [In(docid" in plan or "PushedFilters: [Or(EqualTo(docid" in plan
    scan = got._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert 1 <= scan.metrics().apply("numPartitions").value() <= 4
    many = again.fetch_all(spark.createDataFrame([(f"d{i}",) for i in range(0, 400, 7)], "docid string"))
    assert many.count() == 43


# --- shards ------------------------------------------------------------------------------------


def test_spoiled_shards_alone_are_computed_again(spark):
    path = scratch(spark, "shards")
    all_rows = spark.range(1000).select((F.col("id") % 7).cast("int").alias("shard"), "id", (F.col("id") * 2).alias("value"))
    asked = []

    def compute(wanted):
        asked.append(sorted(r["shard"] for r in wanted.collect()))
        return all_rows.join(wanted, "shard", "left_semi")

    expected = all_rows.groupBy("shard").agg(F.count("*").alias("expected"))
    assert incremental.repaired(spark, path, expected, compute) == list(range(7))
    files = {f for f in spark.read.parquet(path).inputFiles() if "shard=3/" not in f}
    spark.createDataFrame(spark.read.parquet(path).where("shard = 3").limit(5).collect(), "id long, value long, shard int").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    assert incremental.repaired(spark, path, expected, compute) == [3]
    assert incremental.repaired(spark, path, expected, compute) == []
    assert asked == [list(range(7)), [3]]
    now = spark.read.parquet(path)
    assert files <= set(now.inputFiles()) and now.count() == 1000
    with pytest.raises(ValueError, match="still"):
        incremental.repaired(spark, path, expected.withColumn("expected", F.col("expected") + (F.col("shard") == 1).cast("int")), compute)


# --- lines over part files ---------------------------------------------------------------------


def test_lines_are_numbered_through_part_files_and_anew_in_others(spark, tmp_path):
    out = scratch(spark, "parts")
    spark.range(100).repartitionByRange(7, "id").sortWithinPartitions("id").select(F.concat(F.lit("line "), F.col("id").cast("string")).alias("value")).write.text(out)
    from rankloom.sources.lines import numbered_lines

    rows = numbered_lines(spark, out).collect()
    assert {(r["line_no"], r["line"]) for r in rows} == {(i + 1, f"line {i}") for i in range(100)} and len({r["file"] for r in rows}) == 1
    (tmp_path / "a.txt").write_text("x\n\ny\n")
    (tmp_path / "b.txt").write_text("z\n")
    assert sorted((r["line_no"], r["line"]) for r in numbered_lines(spark, str(tmp_path)).collect()) == [(1, "x"), (1, "z"), (2, ""), (3, "y")]
