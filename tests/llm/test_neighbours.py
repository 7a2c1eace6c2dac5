import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.llm import neighbours as N


def brute(rows, queries, k=20):
    ok = [(i, v) for i, v in rows if v is not None and None not in v and all(math.isfinite(x) for x in v) and any(v)]
    size = max({len(v) for _, v in ok}, key=lambda n: (sum(len(v) == n for _, v in ok), -n), default=0)
    ok = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in ok if len(v) == size]
    out = []
    asked = {(i, tuple(v)): v for i, v in ok if queries(i)}
    for (i, _), v in asked.items():
        near = sorted(((-float((w * v).sum()), j) for j, w in ok if j != i))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return sorted(out)


def run(spark, rows, k=20, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score string")
    got = N.nearest(df.where(F.col("vec_id") % 20 == 0), df, k=k, **how)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


def same(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want]
    np.testing.assert_allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12, atol=1e-12)


def test_all_verified_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARD_ROWS", 40)
    monkeypatch.setattr(N, "SAMPLE", 64)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist(), 1, "x") for i in range(300)]
    rows += [(1000 + i, rows[0][1], 1, "x") for i in range(45)]  # one very common vector
    rows += [(2000, None, 0, ""), (2020, [0.0] * 6, 0, ""), (2040, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0, ""), (2060, [float("nan")] * 6, 0, ""), (2080, [float("inf")] * 6, 0, ""), (2100, [1.0], 0, ""), (40, rows[40][1], 2, "again")]
    same(run(spark, rows, miss=1e-12), brute([r[:2] for r in rows], lambda i: i % 20 == 0))


def test_few_and_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(20, None, 0, "")]) == []
    assert run(spark, [(20, [1.0, 0.0], 0, "")]) == []
    rows = [(20, [1.0, 0.0], 0, ""), (3, [0.5, 0.5], 0, ""), (2, [0.5, -0.5], 0, "")]
    assert run(spark, rows) == [(20, 1, 2, 0.5), (20, 2, 3, 0.5)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_on_test_tables(spark, sf):
    """The stop is a chance, so the query is held against brute force by recall; its scores are exact."""
    sf = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    brute_rows = brute(rows, lambda i: i % 20 == 0)
    want = {r[:1] + r[2:3] for r in brute_rows}
    got = N.op2_nearest_neighbours(spark, sf).collect()
    assert len(got) == len(want)
    assert len({(r["query_id"], r["vec_id"]) for r in got} & want) >= 0.93 * len(want)
    vectors = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for r in got:
        assert r["score"] == pytest.approx(float(vectors[r["query_id"]] @ vectors[r["vec_id"]]), abs=1e-12)


def test_share_verified_on_test_tables(spark):
    """Recall and the share of vectors verified, on 2,000 vectors of equal length that hardly lie in clusters."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [tuple(r) for r in df.collect()]
    asked = df.where(F.col("vec_id") % 20 == 0)
    found = N.search(N.build_index(df), asked).persist()
    want = {r[:1] + r[2:3] for r in brute(rows, lambda i: i % 20 == 0)}
    got = {(r["query_id"], r["vec_id"]) for r in N._best(found, 20).collect()}
    share = found.agg(F.sum("verified")).first()[0] / (len({q for q, _ in want}) * len(rows))
    recall = len(got & want) / len(want)
    print(f"recall {recall:.3f}, verified {share:.3f}")
    assert recall >= 0.93 and share < 0.85


def test_chi_square_quantile():
    assert N.chi_square_quantile(0.95, 2) == pytest.approx(-2 * math.log(0.05))
    assert N.chi_square_quantile(0.95, 8) == pytest.approx(15.50731, abs=1e-4)


def test_tree_holds_every_point_once():
    points = np.random.default_rng(2).normal(size=(500, 4))
    points[:200] = points[0]
    tree = N.Tree(points, leaf=16)
    assert sorted(tree.order) == list(range(500))
    for a, b, low, high in zip(tree.begin, tree.begin[1:], tree.low, tree.high, strict=False):
        assert (points[tree.order[a:b]] >= low).all() and (points[tree.order[a:b]] <= high).all()


def test_top_of_the_tree_divides_evenly():
    points = np.random.default_rng(4).normal(size=(4096, 4))
    top = N.Top(points[:1024], 4)
    counts = np.bincount(top.of(points), minlength=16)
    assert len(counts) == 16 and counts.min() > 100


def test_few_vectors_are_verified(spark, monkeypatch):
    """On 50,000 vectors that lie in clusters, recall is at least 0.9 and few are verified."""
    monkeypatch.setattr(N, "SHARD_ROWS", 1000)  # 64 shards
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(400, 64))
    v = centres[rng.integers(0, 400, 50_000)] + 0.25 * rng.normal(size=(50_000, 64))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(v)), "embedding": pa.FixedSizeListArray.from_arrays(v.ravel(), 64).cast(pa.list_(pa.float32()))}))
    queries = df.where(F.col("vec_id") % 500 == 0)
    index = N.build_index(df)
    assert index.top.depth == 6
    found = N.search(index, queries).persist()
    got = {(r["query_id"], r["vec_id"]) for r in N._best(found, 20).collect()}
    verified = found.agg(F.sum("verified")).first()[0]
    exact = v.astype(np.float64)
    want = set()
    for q in range(0, len(v), 500):
        s = exact @ exact[q]
        s[q] = -9
        want |= {(q, int(i)) for i in np.argsort(-s, kind="stable")[:20]}
    assert len(got & want) >= 0.9 * len(want)
    assert verified < 0.2 * 100 * len(v)
    # a query row reaches few shards
    reached = found.where("vec_id is null").groupBy("query_id").count().agg(F.avg("count")).first()[0]
    assert reached < 48
