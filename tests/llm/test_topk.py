import math

import numpy as np
from pyspark.sql import functions as F

from rankloom.llm import topk as T
from rankloom.llm.whitening import vectors_of

COLUMNS = "vec_id long, embedding array<float>, rank int, score string"


def brute(rows, k=10):
    ok = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v))]
    out = []
    for i, q in dict.fromkeys((i, tuple(v)) for i, v in ok if i % 100 == 0):
        near = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return sorted(out)


def run(spark, rows, k=10):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], COLUMNS).repartition(3)
    got = T.largest(df.where(F.col("vec_id") % 100 == 0), df, k=k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


def test_equals_brute_force_over_many_shards(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 64), ("BLOCK", 16), ("STEP", 32), ("PART", 2)):
        monkeypatch.setattr(T, name, value)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=7) * rng.exponential()).tolist()) for i in range(700)]
    rows += [(10_000 + i, rows[3][1]) for i in range(300)]  # one very common vector, also asked for
    rows += [(200, rows[200][1])] * 15 + [(300, rows[5][1]), (20_000, [0.0] * 7), (20_001, [0.0] * 7)]
    rows += [(None, rows[0][1]), (400, None), (500, []), (600, [1.0, None, *[1.0] * 5]), (1100, [float("nan")] * 7), (1200, [float("inf")] * 7)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, k=3) == brute(rows, k=3)


def test_ties_lengths_and_few_rows(spark):
    assert run(spark, []) == [] and run(spark, [(100, None)]) == [] and run(spark, [(100, [1.0, 0.0])]) == []
    rows = [(100, [1.0, 0.0]), (7, [0.5, 0.5]), (3, [0.5, -0.5]), (5, [0.5]), (200, [2.0]), (9, [-1.0, 4.0])]
    assert run(spark, rows) == brute(rows)
    same = [(i, [1.0, 1.0]) for i in range(250)]
    assert run(spark, same) == brute(same)
    negative = [(i, [-1.0 - i, 0.0] if i else [1.0, 0.0]) for i in range(40)]
    assert run(spark, negative) == brute(negative)


def test_large_components(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARD_ROWS", 8)
    rng = np.random.default_rng(4)
    rows = [(i * 10, (rng.normal(size=3) * 10.0 ** (i % 6)).tolist()) for i in range(60)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [*rows, (9900, [3e30, 0.0, 0.0])]) == brute(rows)  # its scores would not fit a long


def test_lengths_and_partial_sums_spare_work(spark, monkeypatch):
    """Where lengths and variances differ, few vectors are scored exactly, and most shards see few queries."""
    monkeypatch.setattr(T, "SHARD_ROWS", 500)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(10_000, 32)) * 0.7 ** np.arange(32) * rng.pareto(3, size=(10_000, 1))
    df = spark.createDataFrame([(i, x.tolist(), 1, "") for i, x in enumerate(v)], COLUMNS)
    rows = vectors_of(df, "vec_id", "embedding")
    index = T.build_index(rows, 32, 10_000)
    found = T.search(index, rows.where("id % 100 = 0")).where("vec_id is null").persist()
    assert len(index.tops) >= 4
    assert found.agg(F.sum("verified")).first()[0] < 0.05 * 100 * 10_000
    assert found.count() < 100 * len(index.tops)
    found.unpersist()


def test_rotation_keeps_products():
    x = np.random.default_rng(2).normal(size=(50, 6))
    for some in (x, x[:3]):
        turn = T.rotation(some)
        np.testing.assert_allclose(turn @ turn.T, np.eye(6), atol=1e-12)


def test_kept_of_equals():
    ids = np.array([1, 1, 1, 2, 3, 4, 5, 6])
    vectors = np.array([[1], [1], [1], [1], [1], [1], [2], [2]])
    assert T.kept_of_equals(vectors, ids, 2).tolist() == [0, 1, 3, 4, 6, 7]
