import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rankloom.llm import ppm as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def symbols(text):
    return [*" ".join(tokens(text)).encode(), 0xFF]


def reference_model(texts, order=P.ORDER):
    """Counts by context, without limits."""
    seen = defaultdict(Counter)
    for t in texts:
        s = [0xFE] * order + symbols(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen[tuple(s[i - k : i])][s[i]] += 1
    return seen


def reference_score(seen, text, order=P.ORDER):
    s = [0xFE] * order + symbols(text)
    total = 0.0
    for i in range(order, len(s)):
        gone = set()
        for k in range(order, -1, -1):
            left = {a: n for a, n in seen.get(tuple(s[i - k : i]), {}).items() if a not in gone}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if s[i] in left:
                total += math.log10(left[s[i]] / whole)
                break
            total += math.log10(len(left) / whole)
            gone |= set(left)
        else:
            total += math.log10(1 / (255 - len(gone)))
    return total


TEXTS = ["the cat sat on the mat", "The  dog\tsat on the log", "été à la mer", "", None, "aaa aaa aaa", "zebra ζ 漢字", "the the the cat", "x" * 300, "mat cat log dog " * 20]
ROWS = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(2, "été à la mer"), (None, "null id"), (77, "unseen qqq words"), (77, "unseen qqq words")]


def brute(rows):
    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    c = Counter(w for t in train for w in [*tokens(t), None])
    n, v = sum(c.values()), len(c)
    seen = reference_model(train)
    out = []
    for i, t in rows:
        w = [*tokens(t), None]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        out.append((i, len(w), sum(c[x] > 0 for x in w), n, base, reference_score(seen, t)))
    return sorted(out, key=str)


def run(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in P.op8_lm_scoring(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("most_words", [1 << 20, 3])
def test_scores_equal_brute_force(spark, tmp_path, monkeypatch, most_words):
    monkeypatch.setattr(P, "MOST_WORDS", most_words)
    key = lambda r: (str(r[0]), r[1], r[2], round(r[5], 6))
    got, want = sorted(run(spark, ROWS, tmp_path), key=key), sorted(brute(ROWS), key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    np.testing.assert_allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-9)


@pytest.mark.parametrize("most_entries", [150, 40, 0])
def test_scores_do_not_depend_on_the_size_of_the_trie(spark, tmp_path, monkeypatch, most_entries):
    monkeypatch.setattr(P, "MOST_ENTRIES", most_entries)
    key = lambda r: (str(r[0]), r[1], r[2], round(r[5], 6))
    got, want = sorted(run(spark, ROWS, tmp_path), key=key), sorted(brute(ROWS), key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    np.testing.assert_allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-9)


def test_empty_table_and_no_training_rows(spark, tmp_path):
    assert run(spark, [], tmp_path / "a") == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = run(spark, [(held, "ab")], tmp_path / "b")
    assert row[1:4] == (2, 0, 0) and row[4] == 0 and row[5] == pytest.approx(-3 * math.log10(255))


def test_probabilities_sum_to_one():
    texts = [t for t in TEXTS if t]
    seen = reference_model(texts)
    grams = []
    for k in range(P.ORDER + 1):
        rows = [(int.from_bytes(bytes([*c, a]), "big"), n) for c, own in seen.items() if len(c) == k for a, n in own.items()]
        grams.append((np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows])))
    trie = P.Trie(grams)
    for context in (b" the ", b"\xfe" * 5, b"zzzzz", b" aaa ", b"xxxxx"):
        keys = np.array([int.from_bytes(context + bytes([a]), "big") for a in range(256) if a != 0xFE], dtype=np.uint64)
        assert np.exp(trie.log_probability(keys)).sum() == pytest.approx(1)


def test_bounded_trie_still_sums_to_one(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_ENTRIES", 40)
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    trie = P.build_trie(P.count_corpus(docs, "text"))
    assert all(len(k) <= 40 for k in trie.keys[2:])
    for context in (b" the ", b"aaaaa", b"xxxxx"):
        keys = np.array([int.from_bytes(context + bytes([a]), "big") for a in range(256) if a != 0xFE], dtype=np.uint64)
        assert np.exp(trie.log_probability(keys)).sum() == pytest.approx(1)


def test_clashing_names_and_a_very_long_text(spark):
    long = " ".join(f"w{i % 997}" for i in range(200_000))
    rows = [(i, t, 1.0, "x", b"y", 7) for i, t in enumerate([*TEXTS, long, long])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, far string, grams binary, row long")
    got = P.score_texts(docs, docs)
    assert got.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == len(TEXTS) + 2 and list(rows[len(TEXTS)][1:]) == pytest.approx(list(rows[len(TEXTS) + 1][1:]), rel=1e-9) and rows[len(TEXTS)]["n_tokens"] == 200_001


def test_tables_of_the_trie_are_released(spark):
    from rankloom.llm.common import tables_made

    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    counts = P.count_corpus(docs, "text")
    before = tables_made()
    P.build_trie(counts)
    assert tables_made() == before


def test_a_pair_of_bytes_that_holds_most_contexts_is_divided(spark, tmp_path, monkeypatch):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh") + rng.choice("abcdefgh") + rng.choice("ab") + "th" for _ in range(60)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grams = P.count_corpus(docs, "text").where("kind = 0").select("key", "n")
    suffixes = P.divide(grams, 1 << 40, 32)
    pair = np.uint64(int.from_bytes(b"th", "big"))
    assert pair in suffixes.hot[2] and all(len(h) < 32 for h in suffixes.hot.values())
    keys, n = (np.array(x) for x in zip(*((r["key"], r["n"]) for r in grams.collect()), strict=True))
    keys = keys.astype(np.uint64)
    work = 1 + n
    alone = work[keys >> np.uint64(8) & np.uint64(0xFFFF) == pair].sum() / work.sum()
    leaf = suffixes.lengths(keys)
    parts = np.unique(np.stack([keys >> np.uint64(8) & ((np.uint64(1) << np.uint64(8) * leaf.astype(np.uint64)) - np.uint64(1)), leaf.astype(np.uint64)]), axis=1, return_inverse=True)[1]
    shares = np.bincount(parts.ravel(), work) / work.sum()
    assert alone > 0.15 and shares[leaf[np.unique(parts.ravel(), return_index=True)[1]] < P.ORDER].max() <= 1 / 32 + 1e-9
    buckets = suffixes.buckets(keys, 64)
    assert all(len(set(buckets[parts.ravel() == p].tolist())) == 1 for p in range(len(shares)))
    monkeypatch.setattr(P, "MOST_ENTRIES", 0)
    rows = [(i, t[:90]) for i, t in enumerate(texts)]
    key = lambda r: r[0]
    got, want = sorted(run(spark, rows, tmp_path), key=key), sorted(brute(rows), key=key)
    np.testing.assert_allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-9)
