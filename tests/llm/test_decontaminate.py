import hashlib
import re

import pytest
from pyspark.sql import functions as F

from rankloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench, window=10):
    windows = {}
    for i, t in bench:
        w = words(t)
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(x) for x in windows}
    out = []
    for i, t in docs:
        w = words(t)
        hit, items = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= found
        out.append((i, len(w), len(hit), sorted(items)))
    return sorted(out, key=str)


def run(spark, docs, bench, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    rows = D.find_matches(d, b, **how).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], sorted(set(r["items"]))) for r in rows), key=str), rows


LONG = " ".join(f"w{i}" for i in range(40))
DOCS = [
    (1, f"before {LONG} after"), (2, LONG.upper()), (2, LONG.upper()), (3, None), (4, ""), (5, " ... "), (6, " ".join(f"w{i}" for i in range(9))),
    (7, "x short item y SHORT, item!"), (None, f"{LONG} {LONG}"), (8, " ".join(f"w{i}" for i in range(30, 40)) + " été Ünïcode w1"), (9, "w1 " * 5000),
]
BENCH = [(10, LONG), (11, LONG), (9, "Short item"), (12, None), (13, "?!"), (14, "w1 " * 12), (15, "été Ünïcode")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 150, 40])
def test_matches_equal_brute_force(spark, block_bytes):
    got, rows = run(spark, DOCS, BENCH, block_bytes=block_bytes)
    assert got == brute(DOCS, BENCH)
    by = {r["doc_id"]: r for r in rows}
    assert [tuple(s) for s in by[1]["spans"]] == [(1, 41)]
    assert by[1]["longest"] == 40 and by[9]["longest"] == 12 and by[3]["longest"] == 0


def test_empty_tables_and_clashing_names(spark):
    assert run(spark, [], BENCH)[0] == []
    assert run(spark, DOCS, [])[0] == brute(DOCS, [])
    d = spark.createDataFrame([(1, LONG, 5, "k")], "doc_id long, text string, n_hit int, items string")
    b = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    row = D.find_matches(d, b).first()
    assert (row["n_hit"], row["items"]) == (40, [1])
    clean = D.remove_contaminated(d, b)
    assert clean.columns == d.columns and clean.count() == 0


def test_query_on_test_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {i: (n, h, len(x), hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest(), h > 0) for i, n, h, x in brute(docs, bench)}
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in D.op3_benchmark_decontamination(spark, sf).collect()}
    assert got == want
    assert any(x[4] for x in want.values())


def test_suffix_array_order():
    import numpy as np

    words = np.array([1, 2, 1, 2, 3, 0, 1, 2, 0])
    array = D.suffix_array(words, np.flatnonzero(words))
    suffix = lambda p: words[p : p + int(np.argmax(words[p:] == 0))].tolist()
    assert [suffix(p) for p in array] == sorted(suffix(p) for p in np.flatnonzero(words))


def test_suffix_array_order_with_sparse_word_ids():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(1500):
        words = rng.integers(1, 61, rng.integers(40, 91))
        words[rng.random(len(words)) < 0.1] = 0
        words[-1] = 0
        array = D.suffix_array(words, np.flatnonzero(words))
        suffix = lambda p: words[p : p + int(np.argmax(words[p:] == 0))].tolist()
        got = [suffix(p) for p in array]
        assert got == sorted(got)


@pytest.mark.parametrize("block_bytes", [1 << 20, 150, 40])
def test_rows_that_repeat_an_item_count_once(spark, block_bytes):
    bench = [(10, LONG), (10, LONG), (10, " ".join(f"w{i}" for i in range(5, 30))), (11, LONG)]
    _, rows = run(spark, [(1, LONG)], bench, block_bytes=block_bytes)
    assert rows[0]["items"] == [10, 11]


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_items_of_null_id_are_one_item_beside_minus_one(spark, tmp_path, block_bytes):
    bench = [(None, LONG), (None, LONG), (-1, LONG), (7, LONG)]
    docs, items = spark.createDataFrame([(1, LONG), (2, "w1")], "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    rows = D.find_matches(docs, items, block_bytes=block_bytes).collect()
    assert [r["items"] for r in sorted(rows)] == [[-1, 7, None], []]
    spark.createDataFrame([(1, LONG)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    (row,) = D.op3_benchmark_decontamination(spark, str(tmp_path)).collect()
    assert (row["n_hit"], row["n_items"], row["items_sha256"]) == (40, 3, hashlib.sha256(b"-1,7").hexdigest())


def test_both_directions_of_search_agree(monkeypatch):
    import random

    import numpy as np

    rng = random.Random(4)
    for _ in range(30):
        text = lambda n: " ".join(rng.choice("abcde") for _ in range(n))
        bench = [(i, text(rng.randrange(0, 25))) for i in range(rng.randrange(1, 60))]
        docs = [(i, text(rng.randrange(0, 200))) for i in range(rng.randrange(1, 30))]
        windows = D.Windows([i for i, _ in bench], [t for _, t in bench], 4)
        data, off = D.K.text_buffer(D.pa.array([t for _, t in docs]))
        found = D.search(data, off, windows)
        want = brute(docs, bench, 4)
        assert sorted(zip([i for i, _ in docs], found["n_words"].tolist(), found["n_hit"].tolist(), found["items"], strict=True), key=str) == want
        monkeypatch.setattr(D, "occurrences", _other_way)
        other = D.search(data, off, windows)
        monkeypatch.undo()
        assert all(np.array_equal(found[k], other[k]) if k.startswith(("n_", "long")) else found[k] == other[k] for k in found)


def _other_way(words, array, windows, size, places):
    import numpy as np

    if len(places) > len(array):
        lo, hi = D.bounds(words, array, windows.words, places, size)
        times = hi - lo
        return array[np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)], np.repeat(np.arange(len(places)), times)
    lo, hi = D.bounds(windows.words, places, words, array, size)
    return array[hi > lo], lo[hi > lo]


def test_a_benchmark_of_a_whole_block_stays_small():
    import random
    import tracemalloc

    rng = random.Random(5)
    vocab = [f"word{i}" for i in range(20_000)]
    texts = [" ".join(rng.choices(vocab, k=200)) for _ in range(16_500)]
    column = D.pa.array(texts)
    assert sum(map(len, texts)) > 0.9 * D.BLOCK_BYTES
    del texts
    tracemalloc.start()
    windows = D.Windows(list(range(len(column))), column)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 500e6 and kept < 200e6, (peak, kept)
    assert len(windows.tests[0][1]) > 3_000_000
