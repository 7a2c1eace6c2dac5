import math

import numpy as np
import pytest

from rankloom.llm import whitening as W

COLUMNS = "vec_id long, embedding array<float>, component string, n int"


def brute(rows, components=8):
    ok = [(i, v) for i, v in rows if v and None not in v and all(map(math.isfinite, v))]
    size = max({len(v) for _, v in ok}, key=lambda n: (sum(len(v) == n for _, v in ok), -n))
    ok = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v in ok if len(v) == size]
    n = len(ok)
    sums = [sum(x[j] for _, x in ok) for j in range(size)]
    centred = np.array([x for _, x in ok]) - np.array([s / n for s in sums])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    out = []
    for (i, x), c in zip(ok, centred, strict=True):
        d = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        for k, e in enumerate(order):
            out.append((i, k + 1, n, d, float(c @ vectors[:, e]) / math.sqrt(values[e]), values[e] / np.trace(cov)))
    return out


def agrees(got, want):
    """Equal but for the sign of each component."""
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for c in {r[1] for r in want}:
        a, b = (np.array([r[4] for r in rows if r[1] == c]) for rows in (got, want))
        np.testing.assert_allclose(a * np.sign(a @ b), b, atol=1e-7)
        assert [r[5] for r in got if r[1] == c] == pytest.approx([r[5] for r in want if r[1] == c], rel=1e-9)
    worst = {r[6] for r in got}
    assert len(worst) == 1 and worst.pop() <= 1e-6


def test_equals_brute_force_with_several_tiles_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=11) * np.arange(1, 12)).tolist()) for i in range(500)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [rows[1], (None, rows[2][1]), (7, [0.0] * 11)]
    odd = [(1, None), (2, []), (3, [1.0, None, *[1.0] * 9]), (4, [float("nan")] * 11), (5, [float("-inf")] * 11), (6, [1.0])]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows + odd], COLUMNS).repartition(5)
    got = W.whiten(df, tile=4, block_rows=50)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    agrees(got.collect(), brute(rows))


def test_doubles_and_groups_of_tiles(spark, monkeypatch):
    monkeypatch.setattr(W, "GROUP", 2)
    rng = np.random.default_rng(2)
    rows = [(i, np.float32(rng.normal(size=9)).astype(float).tolist()) for i in range(200)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], COLUMNS.replace("float", "double"))
    agrees(W.whiten(df, tile=2, block_rows=64).collect(), brute(rows))


def test_centred_before_multiplying(spark):
    """A small variance on a large mean keeps its digits."""
    rng = np.random.default_rng(3)
    rows = [(i, [1e6 + float(x) for x in rng.integers(0, 3, size=3)]) for i in range(400)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], COLUMNS)
    agrees(W.whiten(df).collect(), brute(rows))


def test_few_vectors(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert W.whiten(empty).collect() == []
    one = W.whiten(spark.createDataFrame([(5, [1.0, 2.0], "x", 1)], COLUMNS)).collect()
    assert [tuple(r) for r in one] == [(5, c, 1, 0, None, None, None) for c in (1, 2)]
    flat = W.whiten(spark.createDataFrame([(i, [float(i), 2.0], "x", 1) for i in range(4)], COLUMNS)).collect()
    assert {(r["component"], r["whitened"] is None, r["explained"]) for r in flat} == {(1, False, 1.0), (2, True, 0.0)}
    assert all(r["identity_error"] == pytest.approx(0, abs=1e-9) for r in flat)


def test_large_numbers(spark):
    rows = [(i, [3e30 * (-1) ** i, float(i)]) for i in range(4)]
    got = W.whiten(spark.createDataFrame([(*r, "x", 3) for r in rows], COLUMNS)).collect()
    assert len(got) == 8 and {r["deviation"] for r in got} == {None}


def test_query_on_test_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    agrees(W.op11_embedding_whitening(spark, sf).collect(), brute(rows))
