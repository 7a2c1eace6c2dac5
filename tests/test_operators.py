import itertools
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.operators import aggregates as A
from rankloom.operators import boolean as B
from rankloom.operators import cost, dense, joins, ranking, rerank, sampling, setalg, sparse
from rankloom.operators import metrics as M
from rankloom.operators import plugins as P


def run_of(spark, **ranked):
    rows = [(q, d, i + 1, 1.0 / (i + 1)) for q, docs in ranked.items() for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "qid string, docid string, rank int, score double")


def gold_of(spark, **gold):
    return spark.createDataFrame([(q, d) for q, docs in gold.items() for d in (docs or [None])], "qid string, docid string")


def one(df, **where):
    for c, v in where.items():
        df = df.where(F.col(c) == v)
    return df.first()


def test_metric_fixtures(spark):
    gold = gold_of(spark, m1=["d1", "d2", "d4"], m3=["d9"], m4=["d1"], m5=[], m6=["d7"], m7=["d1", "d2"])
    run = run_of(spark, m1=["d1", "d3", "d2", "d5"], m3=["d1", "d2"], m4=["d1", "d1"], m5=["d1"], m6=["d1", "d2", "d7"], m7=["d2", "d3", "d1"], other=["x"])
    s = M.per_query(run, gold, [2, 3, 5])
    r = one(s, qid="m1", cutoff=3)
    assert (round(r["recall"], 6), round(r["precision"], 6), round(r["f1"], 6)) == (0.666667,) * 3
    assert (r["dcg"], round(r["idcg"], 6), round(r["ndcg"], 6), r["rr"]) == (1.5, 2.13093, 0.703918, 1.0)
    r = one(s, qid="m1", cutoff=5)
    assert (r["precision"], round(r["recall"], 6), round(r["f1"], 6), round(r["ndcg"], 6)) == (0.4, 0.666667, 0.5, 0.703918)
    r = one(s, qid="m3", cutoff=3)
    assert (r["recall"], r["precision"], r["f1"], r["ndcg"], r["rr"]) == (0,) * 5
    r = one(s, qid="m4", cutoff=2)
    assert (r["recall"], r["set_recall"], round(r["ndcg"], 5)) == (2.0, 1.0, 1.63093)
    assert one(M.per_query(run, gold, [2], dedupe=True), qid="m4")["recall"] == 1.0
    r = one(s, qid="m6", cutoff=3)
    assert (round(r["rr"], 6), r["ndcg"]) == (0.333333, 0.5)
    assert [one(s, qid="m7", cutoff=k)["mrecall"] for k in (2, 3)] == [0.0, 1.0]
    assert {x["qid"] for x in s.select("qid").distinct().collect()} == {"m1", "m3", "m4", "m6", "m7"}
    zero = M.per_query(run, gold, [3], missing="zero")
    assert one(zero, qid="m5")["recall"] == 0 and one(zero, qid="other")["ndcg"] == 0


def test_evaluation_guards_and_specs(spark):
    run, gold = run_of(spark, q2=["a"], q10=["b"], q1=["a"]), gold_of(spark, q2=["a"], q10=["a"], q1=["a"])
    assert [r[0] for r in ranking.first_queries(gold.withColumn("qid", F.substring("qid", 2, 5)), 2).collect()] == ["1", "10"]
    assert M.evaluate(run, gold, [5], most=2).first()["num_queries"] == 2
    with pytest.raises(ValueError):
        M.evaluate(run, gold_of(spark, z=["a"]))
    assert one(M.by_spec(run, gold, "nDCG@20"), qid="q2")["score"] == 1.0
    with pytest.raises(ValueError):
        M.by_spec(run, gold, "map@5")
    assert M.latex_row("m", M.evaluate(run, gold, [5])).startswith("m & 0.6667 & -- & -- & 0.6667")
    assert M.baseline_table(run, gold, "x").first()["mrr"] == pytest.approx(2 / 3)


def test_threshold_is_strict(spark):
    scored = spark.createDataFrame([("q", "a", 0.5), ("q", "b", 0.6), ("q", "b", 0.1)], "qid string, docid string, p double")
    got = {r["threshold"]: (r["precision"], r["recall"]) for r in M.threshold_sweep(scored, gold_of(spark, q=["a"])).collect()}
    assert got[0.45] == (0.5, 1.0) and got[0.5] == (0.0, 0.0) and got[0.95] == (0.0, 0.0) and len(got) == 20


def test_sign_rule_and_verdicts(spark):
    rows = spark.createDataFrame([("n", d, s, i) for i, (d, s) in enumerate([("a", -1.0), ("b", -5.0), ("c", -3.0)])] + [("m", d, s, i) for i, (d, s) in enumerate([("a", -1.0), ("b", 2.0), ("c", 2.0)])], "qid string, docid string, score double, pos int")
    got = ranking.rank_by_score(rows, "score", "pos").orderBy("qid", "rank").collect()
    assert [r["docid"] for r in got] == ["b", "c", "a", "b", "c", "a"]
    neg = {r["qid"]: r["negative"] for r in ranking.all_negative(rows, spark.createDataFrame([("n",), ("m",), ("none",)], "qid string")).collect()}
    assert neg == {"n": True, "m": False, "none": True}
    v = spark.createDataFrame([("q", "a", "False"), ("q", "b", "True"), ("q", "c", "True")], "qid string, docid string, verdict string")
    got = rerank.verdict_rerank(run_of(spark, q=["a", "b", "c"]), v).orderBy("rank").collect()
    assert [r["docid"] for r in got] == ["b", "c", "a"]
    p = spark.createDataFrame([("q", "d1", 0.5), ("q", "d2", 0.5)], "qid string, docid string, p double")
    assert [r["docid"] for r in ranking.by_probability(p).orderBy("rank").collect()] == ["d2", "d1"]
    assert [r["docid"] for r in rerank.rerank(run_of(spark, q=["d1", "d2", "d3"]), p, stable=True).orderBy("rank").collect()] == ["d1", "d2", "d3"]


def ea(spark):
    return spark.createDataFrame([("e1", "A"), ("e1", "B"), ("e2", "A"), ("e3", "B"), ("e3", "C"), ("e4", "A"), ("e4", "B"), ("e4", "C")], "entity string, attr string")


@pytest.mark.parametrize(("template", "attrs", "want"), [
    (setalg.SINGLE, "A", "124"), (setalg.OR2, "AB", "1234"), (setalg.OR3, "ABC", "1234"), (setalg.AND2, "AB", "14"), (setalg.AND3, "ABC", "4"), (setalg.AND_NOT, "ABC", "1"), (setalg.NOT, "AB", "2"),
])
def test_templates(spark, template, attrs, want):
    want = {f"e{c}" for c in want}
    assert {r[0] for r in setalg.entities_for(ea(spark), template, list(attrs)).collect()} == want
    q = spark.createDataFrame([(1, template, list(attrs))], "id int, template string, attrs array<string>")
    assert {r["entity"] for r in setalg.answers(ea(spark), q).collect()} == want
    sets = ea(spark).groupBy("entity").agg(F.collect_set("attr").alias("s"))
    assert {r[0] for r in sets.where(setalg.predicate(template, F.col("s"), *(F.lit(a) for a in attrs))).select("entity").collect()} == want
    assert setalg.entities_for(ea(spark), template, ["Z"] * len(attrs)) is None


def test_combinations_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    sets = {f"e{i}": {a for a in "ABCDE" if rng.random() < 0.4} for i in range(30)}
    rel = spark.createDataFrame([(e, a) for e, s in sets.items() for a in s], "entity string, attr string")
    size = lambda f: sum(map(f, sets.values()))
    want = set()
    for a, b in itertools.combinations("ABCDE", 2):
        want |= {(setalg.OR2, a, b, size(lambda s: a in s or b in s)), (setalg.AND2, a, b, size(lambda s: a in s and b in s)), (setalg.NOT, a, b, size(lambda s: a in s and b not in s)), (setalg.NOT, b, a, size(lambda s: b in s and a not in s))}  # noqa: B023
    pairs = setalg.valid_pairs(rel, 2, 15)
    assert {tuple(r) for r in pairs.collect()} == {w for w in want if 2 <= w[3] <= 15}
    want = set()
    for a, b, c in itertools.combinations("ABCDE", 3):
        want |= {(setalg.OR3, a, b, c, size(lambda s: bool({a, b, c} & s))), (setalg.AND3, a, b, c, size(lambda s: {a, b, c} <= s))}  # noqa: B023
        for x, y, z in ((a, b, c), (a, c, b), (b, c, a)):
            want.add((setalg.AND_NOT, x, y, z, size(lambda s: x in s and y in s and z not in s)))  # noqa: B023
    assert {tuple(r) for r in setalg.valid_triples(rel, 1, 20).collect()} == {w for w in want if 1 <= w[4] <= 20}
    assert setalg.upper_bound(setalg.NOT, 5) == 20 and setalg.upper_bound(setalg.OR3, 5) == 10
    kept = P.candidates(rel, pairs)
    assert kept.where("template = '_ that are not _'").count() <= pairs.where("template = '_ that are not _'").count()


def test_buckets_and_samples(spark):
    n = spark.createDataFrame([(x,) for x in (1, 20, 21, 50, 100, 101, 200, 0, 201)], "n int")
    assert [r[0] for r in n.select(sampling.bucket(F.col("n"))).collect()] == [0, 0, 1, 1, 2, 3, 4, -1, -1]
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 300).alias("num_docs"), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("template"))
    got = sampling.stratified(rows, 50, ["id"])
    assert got.count() == 50 and {r["n"] for r in got.groupBy("bucket").agg(F.count("*").alias("n")).collect()} == {10}
    few = rows.where("num_docs between 1 and 60")
    assert sampling.stratified(few, 50, ["id"]).count() == 50
    assert sampling.stratified(rows, 50, ["id"]).collect() == got.collect()
    assert {r["n"] for r in sampling.equal_by_template(rows, 100).groupBy("template").agg(F.count("*").alias("n")).collect()} == {33}
    both = spark.createDataFrame([("t", ["a", "b"], 5), ("t", ["b", "a"], 5)], "template string, attrs array<string>, num_docs int")
    assert sampling.enumerated_queries(both, 10, once=True).count() == 1 and sampling.enumerated_queries(both, 10).count() == 2


def test_training_pairs(spark):
    gold = spark.createDataFrame([("q", "a")], "query string, title string")
    predicted = spark.createDataFrame([("q", t, i) for i, t in enumerate("abcd", 1)], "query string, title string, rank int")
    docs = spark.createDataFrame([(f"t{i}",) for i in range(40)] + [("a",)], "title string")
    got = sampling.training_pairs(gold, predicted, docs, positives=3, negatives=2)
    assert got.where("label = 'relevant'").count() == 3
    wrong = [r["title"] for r in got.where("label <> 'relevant'").collect()]
    assert "a" not in wrong and {"b", "c"} <= set(wrong) and 3 <= len(wrong) <= 4
    for n in (0, 1, 17, 41, 99):  # exactly as many random documents as wanted, less the gold one if it is among them
        random = [r["title"] for r in sampling.training_pairs(gold, predicted.limit(0), docs, 1, n).where("label <> 'relevant'").collect()]
        assert len(random) == len(set(random)) and min(n, 41) - 1 <= len(random) <= min(n, 41) and "a" not in random
    texts = docs.withColumn("text", F.concat(F.lit("text "), "title"))
    rows = sampling.training_inputs(got, texts).collect()
    assert len(rows) == got.count() and all(r["input"] == f"query: {r['query']}, doc: {r['title']}. text {r['title']}" for r in rows if r["title"][0] == "t" or r["title"] == "a")


def test_drawn_combinations(spark):
    import random

    rng = random.Random(6)
    sets = {f"e{i}": {f"a{j}" for j in range(12) if rng.random() < 0.3} for i in range(40)}
    rel = spark.createDataFrame([(e, a) for e, s in sets.items() for a in s], "entity string, attr string")
    for template in setalg.ARITY:
        holds = {setalg.SINGLE: lambda s, a: a in s, setalg.OR2: lambda s, a, b: a in s or b in s, setalg.OR3: lambda s, *x: bool({*x} & s), setalg.AND2: lambda s, *x: {*x} <= s, setalg.AND3: lambda s, *x: {*x} <= s, setalg.AND_NOT: lambda s, a, b, c: {a, b} <= s and c not in s, setalg.NOT: lambda s, a, b: a in s and b not in s}[template]
        got = sampling.drawn_combinations(rel, template, 60, 1, 30).collect()
        assert got and len({tuple(r["attrs"]) for r in got}) == len(got)
        assert all(1 <= r["num_docs"] <= 30 and r["num_docs"] == sum(holds(s, *r["attrs"]) for s in sets.values()) for r in got)
        whole = sampling.combinations(rel, template, 1, 30).collect()
        if template in setalg.UNORDERED + (setalg.NOT,):
            assert {tuple(r["attrs"]) for r in got} <= {tuple(r["attrs"]) for r in whole}
    assert setalg.upper_bound(setalg.NOT, 300) > sampling.ENUMERATED


def test_equal_sets_are_no_or_pair(spark):
    rel = spark.createDataFrame([("x", "A"), ("y", "A"), ("x", "B"), ("y", "B"), ("x", "C"), ("z", "C")], "entity string, attr string")
    pairs = spark.createDataFrame([("A", "B"), ("B", "A"), ("A", "C"), ("B", "C")], "a string, b string")
    assert {tuple(r) for r in sampling.distinct_sets(rel, pairs).collect()} == {("A", "C"), ("B", "C")}


def test_dense_search_of_any_id(spark):
    from rankloom.operators import dense

    rows = [(f"doc é{i}", [float(i % 4), 1.0]) for i in range(12)]
    docs = spark.createDataFrame(rows, "docid string, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([("Bob", [1.0, 0.0]), ("doc é3", [1.0, 1.0])], "qid string, embedding array<double>")
    got = {(r["qid"], r["rank"]): r["docid"] for r in dense.search(queries, docs, 4, skip_self=True).collect()}
    assert [got["Bob", i] for i in (1, 2, 3, 4)] == ["doc é11", "doc é3", "doc é7", "doc é10"]
    assert [got["doc é3", i] for i in (1, 2, 3)] == ["doc é11", "doc é7", "doc é10"]
    assert dense.search(queries.limit(0), docs, 3).collect() == [] and dense.search(queries, docs.limit(0), 3).collect() == []


def test_boolean_scores_of_many_queries_are_one_plan(spark):
    rng = __import__("random").Random(7)
    facts = [(str(q), d, a, rng.random()) for q in range(30) for d in range(4) for a in "ABC" if rng.random() < 0.8]
    df = spark.createDataFrame(facts, "qid string, docid long, atom string, p double")
    shapes = ["A AND B", "A OR (B AND NOT C)", "A AND NOT B", "B AND A"]
    queries = [(str(q), shapes[q % 4], ["A", "B", "C"]) for q in range(30)]
    out = B.score_long(df, queries)
    got = {(r["qid"], r["docid"]): r["p"] for r in out.collect()}
    value = {(q, d, a): round(p, 6) for q, d, a, p in facts}
    for q, d in {(q, d) for q, d, _, _ in facts}:
        a, b, c = (value.get((q, d, x), 0.0) for x in "ABC")
        want = [a * b, 1 - (1 - a) * (1 - b * (1 - c)), a * (1 - b), a * b][int(q) % 4]
        assert got[q, d] == pytest.approx(want, abs=1e-9)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan
    merged = B.score_long(spark.createDataFrame([("1", 1, "Red car", 0.5), ("1", 1, "red  car", 0.5)], "qid string, docid long, atom string, p double"), [("1", "Red car", ["Red car", "red  car"])])
    assert merged.first()["p"] == 0.75


def test_metrics_do_not_expand_rows(spark):
    from rankloom.operators import metrics

    run = spark.createDataFrame([("q", "a", 1), ("q", "a", 2), ("q", "b", 3)], "qid string, docid string, rank int")
    gold = spark.createDataFrame([("q", "a"), ("q", "b")], "qid string, docid string")
    out = metrics.per_query(run, gold, [2, 5])
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["cutoff"]: (r["hits"], r["distinct_hits"], r["n_ranked"]) for r in out.collect()} == {2: (2, 1, 3), 5: (3, 2, 3)}


def test_bm25_fixture(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", "x z z"), ("c", "y w")], "docid string, text string")
    q = spark.createDataFrame([("q", "z"), ("r", "x Z z")], "qid string, query string")
    got = {(r["qid"], r["docid"]): r["score"] for r in sparse.search(q, docs).collect()}
    assert set(got) == {("q", "b"), ("r", "b"), ("r", "a")} and got["q", "b"] == pytest.approx(0.668370, abs=1e-6) and got["r", "b"] == pytest.approx(2 * 0.668370, abs=1e-6)
    assert sparse.search(q, docs, negated=True).agg(F.max("score")).first()[0] <= 0
    assert sparse.search(q, docs.limit(0)).collect() == []


def test_dense(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 3.0]), (4, [0.0, 0.0])], "id int, embedding array<double>")
    got = dense.search(v.where("id = 0"), v, 3, "id", "id", normalise=True, skip_self=True).orderBy("rank").collect()
    assert [(r["docid"], round(r["score"], 6)) for r in got] == [(1, 1.0), (2, 0.707107), (3, 0.0)]
    c = v.where("id > 0").select("id", dense.cosine(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0))).alias("c")).orderBy("id").collect()
    assert [round(r["c"], 6) for r in c] == [1, 0.707107, 0, 0]
    t = spark.sql("select array(array(1D, 2D), array(3D, 4D), array(9D, 9D)) v, array(1, 1, 0) mask")
    r = t.select(dense.mean_pooled(F.col("v"), F.col("mask")).alias("m"), dense.last_token_pooled(F.col("v"), F.col("mask"), False).alias("l"), dense.last_token_pooled(F.col("v"), F.col("mask"), True).alias("e")).first()
    assert (r["m"], r["l"], r["e"]) == ([2.0, 3.0], [3.0, 4.0], [9.0, 9.0]) and not dense.is_left_padded(t)


def test_probability_fixtures(spark):
    df = spark.createDataFrame([(0.5, 0.4, 0.2)], "a double, b double, c double")
    atoms = {"A": "a", "B": "b", "C": "c"}
    p = lambda e: round(B.score(df, e, atoms).first()["p"], 9)
    assert (p("A AND B AND NOT C"), p("A OR B"), p("A AND NOT B")) == (0.16, 0.7, 0.3)
    assert p("(A AND B) OR (A AND C)") == 0.26
    assert p("(A AND B") == p("A AND B)") == p("a junk A and B.") == 0.2
    assert B.parse("A OR B AND NOT C", list("ABC")) == B.Or(B.Atom("A"), B.And(B.Atom("B"), B.Not(B.Atom("C"))))
    assert B.parse("Black and white films AND films", ["films", "Black and white films"]) == B.And(B.Atom("Black and white films"), B.Atom("films"))
    assert B.negated_atoms("NOT(set in X) AND y", ["not set in X", "y"]) in ("NOT(set in X) AND y", "not set in X AND y")
    assert B.negated_atoms("A AND NOT(films set in X)", ["films not set in X"]) == "A AND films not set in X"
    same = B.score(df, "A b OR a-B", {"A b": "a", "a-B": "b"}).first()["p"]
    assert same == pytest.approx(0.7)
    with pytest.raises(ValueError):
        B.parse("A AND", ["A"])
    assert df.select(B.true_probability(F.lit(2.0), F.lit(0.0))).first()[0] == pytest.approx(0.880797, abs=1e-6)


EXPRESSIONS = st.recursive(st.sampled_from("ABC").map(B.Atom), lambda x: st.one_of(x.map(B.Not), st.tuples(x, x).map(lambda t: B.And(*t)), st.tuples(x, x).map(lambda t: B.Or(*t))), max_leaves=6)


def holds(node, given):
    if isinstance(node, B.Atom):
        return given[node.name]
    if isinstance(node, B.Not):
        return not holds(node.of, given)
    f = all if isinstance(node, B.And) else any
    return f((holds(node.left, given), holds(node.right, given)))


@given(EXPRESSIONS)
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_probability_equals_truth_table(spark, node):
    p = {"A": 0.3, "B": 0.6, "C": 0.9}
    want = sum(math.prod(p[a] if v else 1 - p[a] for a, v in g.items()) for vs in itertools.product((True, False), repeat=3) if holds(node, g := dict(zip("ABC", vs, strict=True))))
    got = spark.range(1).select(B.probability(node, {a: F.lit(x) for a, x in p.items()}), B.probability(B.Not(node), {a: F.lit(x) for a, x in p.items()})).first()
    assert got[0] == pytest.approx(want) and got[0] + got[1] == pytest.approx(1)


def test_aggregates(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("a", 0.5), ("b", 2.0)], "g string, v double")
    got = {r["g"]: (r["mean"], round(r["stderr"], 6)) for r in A.mean_stderr(rows, ["g"], "v").collect()}
    assert got == {"a": (0.5, 0.288675), "b": (2.0, 0.0)}
    q = spark.createDataFrame([("_ or _", 4), ("_ or _", 6)], "template string, num_docs int")
    stats = A.template_stats(q).collect()
    assert [(r["template"], r["queries"], r["avg_docs"]) for r in stats if r["queries"]] == [("_ or _", 2, 5.0), ("TOTAL", 2, 5.0)] and len(stats) == 8
    assert q.select(A.template_place(F.lit("?"))).first()[0] == 99
    c = one(A.confusion(spark.createDataFrame([("True", "True"), ("True", "odd"), ("False", "False")], "gold string, predicted string")), gold="True")
    assert (c["True"], c["Error"], c["False"]) == (1, 1, 0)
    assert A.majority(spark.createDataFrame([(1, "b"), (1, "a")], "k int, answer string"), ["k"]).first()["answer"] == "a"
    assert A.mean_or_zero(rows.limit(0), "v").first()["v"] == 0.0
    assert A.grid_limits(rows.where("v > 0"), "v").first()["low"] == pytest.approx(0.5)
    assert A.histogram(rows, "v", 4).agg(F.sum("n")).first()[0] == 4
    meta = spark.sql("select map('r', array('x')) relevance_ratings, map('d', false) pred_maps, array(named_struct('doc', 'g', 'wikipedia_text', cast(null as string))) gold_doc_metadata, array(named_struct('doc', 'p', 'wikipedia_text', 't')) pred_docs_metadata")
    assert tuple(A.sanity_counts(meta).first()) == (0, 1, 0, 1, 0, 1)


def test_joins(spark):
    gold = spark.createDataFrame([("q", 1)], "query string, x int")
    pred = spark.createDataFrame([("q", "old", 1), ("q", "new", 2)], "query string, p string, line_no int")
    assert joins.gold_with_predictions(gold, pred).first()["prediction"]["p"] == "new"
    with pytest.raises(Exception, match="no prediction"):
        joins.gold_with_predictions(gold.withColumn("query", F.lit("z")), pred).collect()
    out = joins.attach_gold(spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"])], "id int, docs array<string>"), spark.createDataFrame([(1, ["a"])], "id int, docs array<string>"))
    assert {r["id"]: (r["gold_docs"], r["pred_maps"]) for r in out.collect()} == {1: (["a"], {"a": True, "b": False}), 2: ([], {"c": False})}
    assert joins.with_hit(out).count() == 1
    assert joins.labelled_properties(spark.createDataFrame([("P1",), ("P2",)], "pid string"), spark.createDataFrame([("P1", "one")], "pid string, label string")).orderBy("pid").collect()[1]["label"] == "Unknown Property (P2)"
    with pytest.raises(Exception, match="no document"):
        joins.texts_of_predictions(spark.createDataFrame([("t",)], "title string"), spark.createDataFrame([], "title string, text string")).collect()
    assert joins.missing_ids(gold.withColumn("id", F.lit(1)), gold.withColumn("id", F.lit(2))).count() == 1
    rows = spark.createDataFrame([("1", "a"), ("2", "z")], "qid string, docid string")
    maps = spark.createDataFrame([("a", "i1")], "title string, idx string")
    assert [r["docid"] for r in joins.remap_to(rows, maps, "idx").orderBy("qid").collect()] == ["i1", "z"]


def test_rerank_filters(spark):
    ex = spark.createDataFrame([("q", ["a", "b", "c"])], "query string, docs array<string>")
    scored = spark.createDataFrame([("q", "a", math.log(0.5)), ("q", "c", math.log(0.9)), ("q", "b", math.log(0.7))], "query string, title string, score double")
    assert rerank.above_threshold(ex, scored, 0.6).first()["docs"] == ["b", "c"]
    assert rerank.above_threshold(ex, scored.where("title <> 'a'"), math.exp(math.log(0.7))).first()["docs"] == ["c"]
    with pytest.raises(Exception, match="relevant"):
        rerank.only_relevant_labels(spark.createDataFrame([("other",)], "label string")).collect()
    with pytest.raises(Exception, match="no gold"):
        rerank.with_gold(spark.createDataFrame([([],)], "docs array<string>")).collect()
    run, gold = run_of(spark, q=["a", "b"], r=["c", "d"]), gold_of(spark, q=["b"], r=["z"])
    p = spark.createDataFrame([("q", "a", 0.1), ("q", "b", 0.9), ("r", "c", 0.1), ("r", "d", 0.9)], "qid string, docid string, p double")
    got = {(r["qid"], r["docid"]): r["rank"] for r in rerank.gated_rerank(run, p, gold).collect()}
    assert got == {("q", "b"): 1, ("q", "a"): 2, ("r", "c"): 1, ("r", "d"): 2}
    assert [r["qid"] for r in rerank.hit_gate(run, gold).collect()] == ["q"]


def test_cost_fixture(spark):
    rows = spark.createDataFrame([(2, 10, 5.0, 100.0, 1.0, 2.0)], "num_queries int, calls_per_query int, avg_query_tokens double, avg_doc_tokens double, input_price double, output_price double")
    r = cost.totals(rows).first()
    assert (r["calls"], r["input_tokens"], r["output_tokens"], r["total_cost"]) == (20, 3100.0, 100, pytest.approx((3100 + 200) / 1e6))
    used = cost.usage(spark.createDataFrame([([1, 3], [])], "in_tokens array<int>, out_tokens array<int>")).first()
    assert (used["avg_in"], used["avg_out"]) == (2.0, 0.0)


def test_plugins(spark):
    q = spark.createDataFrame([("1", "A and B")], "qid string, query string")
    assert P.parsed_queries(q, lambda t: {"atoms": ["A", "B"], "expr": t}).first()["atoms"] == ["A", "B"]
    pairs = spark.createDataFrame([("1", "d", ["A"])], "qid string, docid string, atoms array<string>")
    facts = P.estimated(pairs, lambda atoms, row: {a: 0.5 for a in atoms})
    assert tuple(facts.first()) == ("1", "d", "A", 0.5)
    assert B.score_long(facts, [("1", "A AND B", ["A", "B"])]).first()["p"] == 0.0
    assert P.reasoned(pairs, lambda rows: [(d, 1.0) for d in rows["docid"]]).first()["p"] == 1.0
    texts = spark.createDataFrame([(1, "ab"), (2, "c")], "docid int, text string")
    assert [r["embedding"] for r in P.encoded(texts, lambda x: [[len(t)] for t in x]).orderBy("docid").collect()] == [[2.0], [1.0]]
    assert P.timed("x", lambda: None)["seconds"] >= 0


def test_incremental(spark, tmp_path):
    from rankloom.streaming import incremental as I

    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(i, i * 2) for i in range(5)], "id long, v long")
    assert I.append_new(rows.where("id < 3"), out, lambda d: d) == 3
    assert I.append_new(rows, out, lambda d: d) == 2 and I.append_new(rows, out, lambda d: d) == 0
    rows.write.json(str(tmp_path / "in"))
    for _ in range(2):
        I.append_stream(spark, str(tmp_path / "in"), "id long, v long", str(tmp_path / "s"), str(tmp_path / "c"), lambda d: d).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "s")).count() == 5
    assert [r["chunk"] for r in I.missing_chunks(spark.createDataFrame([(1,)], "chunk int"), 3).orderBy("chunk").collect()] == [0, 2]
    batch = spark.createDataFrame([("True", "False")], "gold string, predicted string")
    assert I.running_confusion(I.running_confusion(None, batch), batch).first()["n"] == 2
