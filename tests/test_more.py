import json

from pyspark.sql import functions as F

from rankloom.operators import joins, rerank
from rankloom.sources import judgments, records


def test_metrics_as_json(spark):
    means = spark.createDataFrame([(5, 0.5, 0.25, 3), (20, 0.75, 0.5, 3)], "cutoff int, recall double, ndcg double, num_queries long")
    got = json.loads(records.metrics_json([5, 20], means, 10).first()["value"])
    assert got == {"cutoffs": [5, 20], "recall": {"5": 0.5, "20": 0.75}, "ndcg": {"5": 0.25, "20": 0.5}, "num_queries": 3, "max_queries": 10}


def test_queries_with_judgments(spark, tmp_path):
    (tmp_path / "q").write_text('{"_id":"1","text":"Who likes Tea?"}\n{"_id":"2","text":"Who likes Jazz?"}\n')
    (tmp_path / "r").write_text("".join(json.dumps({"query-id": q, "corpus-id": d, "score": 1}) + "\n" for q, d in (("1", "b"), ("1", "a"), ("2", "c"))))
    got = judgments.read_queries_with_judgments(spark, str(tmp_path / "q"), str(tmp_path / "r"), 2, 9).collect()
    assert [(r["qid"], r["docs"], r["num_docs"]) for r in got] == [("1", ["a", "b"], 2)]
    ids = judgments.read_query_ids(spark, str(tmp_path / "q")).orderBy("position").collect()
    assert [tuple(r) for r in ids] == [(1, "1"), (2, "2")]


def test_joins_by_place_and_metadata(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "line_no long, a string")
    b = spark.createDataFrame([(2, "z")], "line_no long, b string")
    assert [tuple(r) for r in joins.zip_by_line(a, b).collect()] == [(2, "y", "z")]
    scores = spark.createDataFrame([("d", "1", 0.5), ("d", "2", 0.5)], "dataset string, qid string, score double")
    meta = spark.createDataFrame([("d", "1", "_ or _", 2)], "dataset string, qid string, template string, depth int")
    assert [r["depth"] for r in joins.scores_with_metadata(scores, meta).collect()] == [2]
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "qid string, docid string, rank int")
    assert rerank.candidates(run, 1).count() == 1
    rows = spark.createDataFrame([("g", 2, "late"), ("g", 1, "early")], "g string, n int, v string")
    assert joins.first_of_group(rows, ["g"], "v", "n").first()["v"] == "early"
    assert joins.attribute_pairs(spark.createDataFrame([("e", "a"), ("e", "b")], "entity string, attr string"), ordered=True).count() == 2


def test_corpora_and_indexed_examples(spark, tmp_path):
    (tmp_path / "c").write_text('{"title":"t1","text":"x","idx":"7"}\n{"title":"t2","text":"y"}\n')
    corpus = records.read_corpus(spark, str(tmp_path / "c"))
    assert sorted(tuple(r) for r in corpus.collect()) == [("1", "t2", "y"), ("7", "t1", "x")]
    (tmp_path / "q").write_text('{"nl_query":"n","documents":["t1"]}\n')
    assert records.read_retrieval_queries(spark, str(tmp_path / "q"), variants=True).first()["relevant"] == ["t1"]
    ex = spark.createDataFrame([(1, "q1", ["t1", "none"]), (2, "q2", [])], "line_no long, query string, docs array<string>")
    first, pairs, texts = records.indexed_examples(ex, corpus.select("title", "text", F.col("docid").alias("idx")))
    assert [tuple(r) for r in first.collect()] == [(0, "q1")] and [tuple(r) for r in pairs.collect()] == [(0, "7")] and [tuple(r) for r in texts.collect()] == [("q1", "x")]
    details = tmp_path / "d"
    details.mkdir()
    (details / "a.csv").write_text("q,e\n1,x\n")
    (details / "b.csv").write_text("q,e\n2,y\n")
    assert records.read_details(spark, [str(details / "a.csv"), str(details / "b.csv")], "q int, e string").count() == 2


def _brute_combinations(own, least, most):
    """All two- and three-attribute combinations of a relation {entity: attributes} by sets."""
    of = {}
    for e, attrs in own.items():
        for a in attrs:
            of.setdefault(a, set()).add(e)
    out, names = set(), sorted(of)
    for a in names:
        for b in names:
            if a < b:
                out |= {("_ or _", a, b, len(of[a] | of[b])), ("_ that are also _", a, b, len(of[a] & of[b]))}
            if a != b:
                out.add(("_ that are not _", a, b, len(of[a] - of[b])))
            for c in names:
                if a < b < c:
                    out |= {("_ or _ or _", a, b, c, len(of[a] | of[b] | of[c])), ("_ that are also both _ and _", a, b, c, len(of[a] & of[b] & of[c]))}
                if a < b and c not in (a, b):
                    out.add(("_ that are also _ but not _", a, b, c, len((of[a] & of[b]) - of[c])))
    return {r for r in out if least <= r[-1] <= most}


def test_combinations_come_without_a_grid(spark, monkeypatch):
    import random

    from rankloom.operators import setalg

    monkeypatch.setattr(setalg, "CHUNK", 3)
    random.seed(5)
    own = {e: {a for i, a in enumerate("abcdefghijk") if random.random() < 0.7 / (1 + i)} for e in range(40)}
    own[99] = {"z"}
    ea = spark.createDataFrame([(e, a) for e, attrs in own.items() for a in attrs] + [(99, "z")], "entity long, attr string")
    for least, most in ((1, 40), (2, 5), (0, 0), (30, 100), (200, 300)):
        pairs, triples = setalg.valid_pairs(ea, least, most), setalg.valid_triples(ea, least, most)
        got = [tuple(r) for df in (pairs, triples) for r in df.collect()]
        assert len(got) == len(set(got)) and set(got) == _brute_combinations(own, least, most), (least, most)
    plan = setalg.valid_pairs(ea, 1, 40)._jdf.queryExecution().optimizedPlan().toString() + setalg.valid_triples(ea, 1, 40)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join Cross" not in plan
    assert setalg.valid_pairs(ea.limit(0), 1, 40).collect() == [] and setalg.valid_triples(ea.limit(0), 1, 40).collect() == []


def test_steps_are_measured_and_appended(spark):
    from rankloom.operators import plugins
    from rankloom.sources.scratch import scratch

    at = scratch(spark, "steps")
    for name in ("Embedding", "Similarity"):
        step = plugins.timed(name, lambda: sum(range(1000)))
        assert step["driver_mb"] > 10 and step["seconds"] >= 0
        plugins.append_steps(spark, [step], at)
    assert {r["step"] for r in spark.read.option("header", True).csv(at).collect()} == {"Embedding", "Similarity"}
