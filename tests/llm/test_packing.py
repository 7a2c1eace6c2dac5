import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import packing as P


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=20))
@settings(max_examples=60, deadline=None)
def test_bins_use_every_piece_once(counts):
    bins = P.min_bin_slack(counts, 60)
    used = {}
    for times, combination in bins:
        assert times > 0 and sum(n * k for n, k in combination) <= 60
        for n, k in combination:
            used[n] = used.get(n, 0) + times * k
    assert used == counts


def test_first_bin_is_the_fullest():
    assert P.min_bin_slack({7: 1, 5: 1, 4: 1, 3: 1}, 14) == [(1, [(7, 1), (4, 1), (3, 1)]), (1, [(5, 1)])]
    assert P.min_bin_slack({}, 8) == []
    with pytest.raises(ValueError):
        P.min_bin_slack({9: 1}, 8)


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_both_libraries_give_the_same_ids(text):
    encode = _encoder()
    assert encode(text).tolist() == encode.reference.encode(text, add_special_tokens=False).ids


def _encoder(kept=[]):
    if not kept:
        encode = P.Encoder()
        encode.reference = encode.full()
        kept.append(encode)
    return kept[0]


def test_special_text():
    encode = _encoder()
    assert 50256 in encode("a <|endoftext|> b") and encode("").tolist() == []


def check(spark, rows, capacity=2048):
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string, lang string, length string"), capacity=capacity).collect()
    encode = _encoder()
    want = []
    for i, t, *_ in rows:
        ids = np.append(encode(t or ""), 0).astype("<u4")
        cut = list(range(len(ids) % capacity or min(capacity, len(ids)), len(ids) + 1, capacity))
        for k, stop in enumerate(cut):
            start = cut[k - 1] if k else 0
            want.append((i, k, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), sum(r["length"] for r in got)


def test_pack(spark):
    rows = [(1, None, "x", "y"), (2, "", None, None), (3, "hello world " * 3000, "x", "y"), (4, "hello " * 2047, "", ""), (4, "hello " * 2047, "", ""), (5, "été " * 100, "", "")]
    rows += [(10 + i, "word " * (i % 97), "", "") for i in range(400)]
    n, total = check(spark, rows)
    assert n <= -(-total // 2048) + 1
    check(spark, rows[:60], capacity=16)
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_on_test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = P.op10_best_fit_packing(spark, "/root/testdata/sf0.001")
    assert got.select("doc_id").distinct().count() == docs.count()
    rows = [(r["doc_id"], r["text"], "", "") for r in docs.collect()]
    n, total = check(spark, rows)
    assert n <= -(-total // 2048) + 1
