import json

import pytest
from pyspark.sql import functions as F

from rankloom.sources import judgments as J
from rankloom.sources import lines, rankings, records


@pytest.fixture
def write(tmp_path):
    def put(text, name="f.txt"):
        (tmp_path / name).write_text(text if isinstance(text, str) else "".join(json.dumps(x) + "\n" for x in text), encoding="utf-8")
        return str(tmp_path / name)

    return put


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_line_numbers_over_many_splits(spark, write):
    path = write("".join(f"line {i}\n" if i % 7 else "\n" for i in range(1, 5001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = lines.numbered_lines(spark, path)
        assert got.select("line").rdd.getNumPartitions() > 3
        assert [r["line_no"] for r in got.orderBy("line_no").collect()] == list(range(1, 5001))
        assert got.where("line <> concat('line ', line_no) and line <> ''").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


QRELS = "1 0 American Psycho (film) 1\n73 0 13 Hours: The Secret Soldiers of Benghazi 1\n5 0 A  B 1\n5 0 doc 0\n5 1 doc 1\n5 0 doc x\n1 0 American Psycho (film) 1\n\n5 0 1\n"


def test_qrels(spark, write):
    path = write(QRELS)
    assert rows(J.read_qrels(spark, path), "qid", "docid") == [("1", "American Psycho (film)"), ("5", "A B"), ("73", "13 Hours: The Secret Soldiers of Benghazi")]
    with pytest.raises(Exception, match="no integer"):
        J.read_qrels(spark, path, lenient=True).collect()
    lenient = write("5 1 doc 1\n")
    assert rows(J.read_qrels(spark, lenient, lenient=True), "qid", "docid") == [("5", "doc")]
    assert rows(J.read_any_qrels(spark, write(QRELS)), "qid") == [("1",), ("5",), ("73",)]


def test_json_qrels(spark, write):
    beir = write([{"query-id": "q", "corpus-id": "a", "score": 1}, {"query-id": "q", "corpus-id": "b", "score": 0.7}, {"query-id": "q", "corpus-id": "c"}, {"query-id": "", "corpus-id": "d", "score": 1}])
    assert rows(J.read_beir_qrels(spark, beir), "qid", "docid") == [("q", "a")]
    assert rows(J.read_any_qrels(spark, beir), "qid", "docid") == [("q", "a")]
    inline = write([{"_id": 0, "id": "x", "docs": ["a", "b"]}, {"id": "y", "docs": ["c"]}])
    assert rows(J.read_inline_qrels(spark, inline), "qid", "docid") == [("0", "a"), ("0", "b"), ("y", "c")]
    last = write([{"id": "q", "docs": ["a"]}, {"id": "q", "docs": ["b", ""]}, {"id": "e", "docs": []}])
    assert {tuple(r) for r in J.read_jsonl_qrels(spark, last).collect()} == {("q", "b"), ("e", None)}


RUN = "7 Q0 13 Hours: The Secret 1 0.9 run\n7 Q0 B 3 0.5 run\n7 Q0 C 2 0.7 run\nbad line\n8 Q0 D 1 x run\n"


def test_runs(spark, write):
    got = rankings.read_run(spark, write(RUN)).orderBy("rank").collect()
    assert [(r["docid"], r["rank"], r["score"], r["run_name"]) for r in got] == [("13 Hours: The Secret", 1, 0.9, "run"), ("C", 2, 0.7, "run"), ("B", 3, 0.5, "run")]
    legacy = rankings.read_flexible_run(spark, write("7 Q0 13 Hours: The Secret 1 0.9 run\n"), forward=True).first()
    assert (legacy["docid"], legacy["score"], legacy["run_name"]) == ("", 1.0, "0.9 run")
    simple = rankings.read_flexible_run(spark, write("7 a doc 0.5 name\n7 b doc 0.9\n9\tdoc id\t0.3\n" + RUN.replace("8 Q0 D 1 x run\n", "")))
    assert [(r["qid"], r["docid"]) for r in simple.where("qid <> '7'").collect()] == [("9", "doc id")]
    assert [r["docid"] for r in simple.where("qid = '7' and run_name = 'name'").collect()] == ["a doc"]


def test_jsonl_runs(spark, write):
    path = write([{"id": "n", "docs": ["a", "b", "c"], "scores": [-1, -5, -3]}, {"id": "m", "docs": ["a", "b", "c"], "scores": [-1, 2, 2]}, {"id": "x", "docs": ["a", "b"], "scores": [1]}, {"id": "l", "docs": ["old"], "scores": [1]}, {"id": "l", "docs": ["new", ""], "scores": [1, 2]}])
    got = rankings.read_jsonl_run(spark, path).orderBy("qid", "rank").collect()
    order = {}
    for r in got:
        order.setdefault(r["qid"], []).append(r["docid"])
    assert order == {"n": ["b", "c", "a"], "m": ["b", "c", "a"], "l": ["new"]}


def test_results(spark, write):
    text = '{"query":"x","relevant":[],"retrieved":[{"rank":2,"score":0.5,"title":"b"},{"rank":1,"score":0.9,"title":"a"},{"rank":3,"score":0.1,"title":null}]}\n\n{"query":"y","relevant":[],"retrieved":[]}\n{"query":"z","relevant":["r"],"retrieved":[{"score":1,"title":"c"}]}\n'
    path = write(text)
    got = rankings.read_results(spark, path, by_rank=True)
    assert rows(got, "qid", "rank", "docid") == [("1", 1, "a"), ("1", 2, "b"), ("4", 1, "c")]
    ids = spark.createDataFrame([(1, "q1"), (4, "q4")], "position long, qid string")
    assert rows(rankings.read_results(spark, path, ids), "qid", "docid") == [("q1", "a"), ("q1", "b"), ("q4", "c")]
    assert rankings.read_by_format(spark, path, "results").count() == 3
    assert rankings.read_by_format(spark, path, "unknown") is None and rankings.read_by_format(spark, path + "x", "trec") is None


def test_text_results(spark, write):
    path = write([{"query_id": "1", "nl_query": "Who?", "documents": [{"doc_id": "a", "score": 0.1}, {"doc_id": "b", "score": 0.2}]}, {"query_id": "2", "nl_query": "none", "documents": []}])
    ids = spark.createDataFrame([("who?", "7")], "text string, qid string")
    assert rows(rankings.read_text_results(spark, path, ids), "qid", "rank", "docid") == [("7", 1, "b"), ("7", 2, "a")]
    raw = records.read_jsonl(spark, path, rankings.TEXT_RESULT)
    assert rows(records.text_results_for_evaluation(raw), "id") == [("Who?",), ("none",)]
    assert rows(records.text_results_by_hash(raw), "rank", "docid") == [(1, "a"), (2, "b")]


def test_writers_round_trip(spark, tmp_path):
    run = spark.createDataFrame([("10", "a b", 1, 0.5, "r"), ("9", "c", 2, 0.25, "r"), ("9", "d", 1, 1.0, "r"), ("x", "e", 1, 1e-7, "r")], "qid string, docid string, rank int, score double, run_name string")
    rankings.write_run(run, str(tmp_path / "run"))
    assert [r[0] for r in rankings.run_lines(run).collect()] == ["9 Q0 d 1 1.000000 r", "9 Q0 c 2 0.250000 r", "10 Q0 a b 1 0.500000 r", "x Q0 e 1 0.000000 r"]
    back = rankings.read_run(spark, str(tmp_path / "run"))
    assert rows(back, "qid", "docid", "rank") == [("10", "a b", 1), ("9", "c", 2), ("9", "d", 1), ("x", "e", 1)]
    gold = spark.createDataFrame([("1", "a b"), ("1", None), ("2", "")], "qid string, docid string")
    J.write_qrels(gold, str(tmp_path / "q"))
    J.write_qrels(gold, str(tmp_path / "q"), mode="append")
    assert rows(J.read_qrels(spark, str(tmp_path / "q")), "qid", "docid") == [("1", "a b")]
    beir = spark.createDataFrame([("1", "a", 2.0)], "qid string, docid string, score double")
    assert rows(J.both_sources(beir, gold.limit(1)), "docid", "relevance") == [("a", 2), ("a b", 1)]
    queries = spark.createDataFrame([(1, "9", "q nine", ["c"]), (2, "0", "none", [])], "position int, qid string, text string, relevant array<string>")
    titles = spark.createDataFrame([("c", "Title C")], "docid string, title string")
    got = [json.loads(r["value"]) for r in rankings.result_rows(run, queries, titles).collect()]
    assert got[0]["retrieved"] == [{"rank": 1, "score": 1.0, "title": "d"}, {"rank": 2, "score": 0.25, "title": "Title C"}] and got[1]["retrieved"] == []


def test_records(spark, write, tmp_path):
    path = write([{"query": "q", "docs": ["a"], "original_query": "o", "scores": None, "metadata": {"template": "_", "more": 1}, "id": "1"}])
    assert records.read_examples(spark, path).first()["metadata"]["template"] == "_"
    with pytest.raises(Exception, match="unknown fields"):
        records.read_examples(spark, write([{"query": "q", "other": 1}])).collect()
    with pytest.raises(Exception, match="malformed"):
        records.read_jsonl(spark, write("{bad\n"), "a string").collect()
    docs = records.read_documents(spark, write([{"title": "t", "text": "x\ny", "idx": "d1", "junk": 1}, {"title": "t", "text": "z"}]))
    assert rows(records.last_by_title(docs), "title", "text") == [("t", "z")]
    assert rows(records.index_corpus(docs), "docid", "doc_text") == [("1", "t. z"), ("d1", "t. x\ny")]
    assert rows(records.index_corpus(docs, most=1), "docid") == [("d1",)]
    assert rows(records.document_maps(docs)[1], "idx", "text") == [(0, "t x y"), (1, "t z")]
    tsv = records.read_tsv(spark, write("a\tb\tc  \n"), most_splits=1).first()
    assert tsv["cells"] == ["a", "b\tc"]
    records.write_tsv(spark.createDataFrame([("a", 1)], "x string, y int"), str(tmp_path / "tsv"))
    assert records.read_text_lines(spark, str(tmp_path / "tsv")).first()["line"] == "a\t1"
    variant = spark.createDataFrame([(1, ["x", "y"], ["and"], ["d"], "n", "f"), (2, ["x"], [], ["d"], "", "f")], "line_no long, queries array<string>, operators array<string>, documents array<string>, nl_query string, domain string")
    got = records.variants_to_examples(variant).orderBy("id").collect()
    assert [r["original_query"] for r in got] == ["<mark>x</mark> and <mark>y</mark>", "x"] and [r["metadata"]["template"] for r in got] == ["_ that are also _", "_"]
    assert rows(J.variant_qrels(variant), "id") == [("1",), ("n",)]


def test_ids_merges_and_checks(spark):
    plain = spark.createDataFrame([(i * 10, f"r{i}") for i in range(1, 101)], "line_no long, x string").repartition(7)
    assert rows(J.assign_ids(plain), "line_no", "id") == [(i * 10, i) for i in range(1, 101)]
    many = spark.range(20_000).select((-F.col("id")).alias("line_no"), F.expr("repeat('x', 200)").alias("x")).repartition(5)
    got = J.assign_ids(many)
    assert got.where("id <> line_no + 20000").count() == 0 and got.count() == 20_000 and J.assign_ids(many.limit(0)).count() == 0
    old = spark.createDataFrame([("m", 1, "a"), ("n", 1, "b"), ("TOTAL", 1, "c")], "model string, k int, v string")
    new = spark.createDataFrame([("m", 1, "new")], "model string, k int, v string")
    assert rows(records.upsert(old, new, ["model", "k"], "model = 'TOTAL'"), "model", "v") == [("m", "new"), ("n", "b")]
    with pytest.raises(Exception, match="repeated row"):
        records.without_repeats(old.unionAll(old)).collect()
    assert records.without_repeats(old).count() == 3
    vectors = spark.createDataFrame([(1, [1.0, 2.0])], "docid int, embedding array<double>")
    assert records.checked_embeddings(vectors, 1, 2).count() == 1
    with pytest.raises(ValueError):
        records.checked_embeddings(vectors, 1, 3)
    shards = spark.createDataFrame([(0,), (0,), (1,)], "shard int")
    expected = spark.createDataFrame([(0, 2), (1, 2), (2, 1)], "shard int, expected long")
    assert rows(records.valid_shards(shards, expected), "shard", "valid") == [(0, True), (1, False), (2, False)]
    assert rows(records.sliced(plain.withColumn("line_no", F.col("line_no") / 10), first=50, start=48, stop=99), "x") == [("r49",), ("r50",)]
