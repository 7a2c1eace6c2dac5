import random
import re

import pytest

from rankloom.llm import jaccard as J
from rankloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text, k=4):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, threshold=85, k=4):
    sets = [sets_of(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    lists = {}
    for i, s in enumerate(sets):
        for x in s:
            lists.setdefault(x, []).append(i)
    seen = set()
    for i, s in enumerate(sets):
        for j in {j for x in s for j in lists[x] if j > i}:
            if 100 * len(s & sets[j]) >= threshold * len(s | sets[j]):
                seen.add((i, j))
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = []
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(key)
    for i, (key, _) in enumerate(rows):
        out.append((key, len(sets[i]), min(groups[find(i)])))
    return sorted(out)


def run(spark, rows):
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted(tuple(r) for r in got.collect())


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        p = rng.randrange(len(words))
        words[p] = f"e{rng.randrange(10**6)}"
    return words


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(2000)]
    rows, passage = [], [rng.choice(vocab) for _ in range(60)]
    for _ in range(60):  # groups of near copies, of all sizes
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 8, 9, 10, 12, 14, 16, 18, 22, 30, 60, 150, 300]))]
        if rng.random() < 0.3:
            base += passage
        for _ in range(rng.choice([1, 2, 3, 6])):
            near = edited(rng, base, rng.choice([0, 0, 1, 1, 2, 4]))
            if rng.random() < 0.4:
                near = near[rng.randrange(3) :] or near
            if rng.random() < 0.4:
                near = near + [rng.choice(vocab) for _ in range(rng.randrange(4))]
            rows.append(" ".join(near))
    long = [rng.choice(vocab) for _ in range(200)]
    rows += [" ".join(edited(rng, long, rng.randrange(4))) for _ in range(80)]  # a large group that drifts
    rows += [None, "", "  \t ", "a", "A", "a b", "a b c d", "A B\tC  D", "word " * 50, "word " * 90]
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_hot_shingles_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT_SHINGLES", 20)
    monkeypatch.setattr(J, "BROADCAST_SETS", 0)
    rows = corpus(3)
    assert run(spark, rows) == brute(rows)


def test_a_very_long_text(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:290_000])), (3, " ".join(words[150_000:])), (4, "w" * 2_000_000)]
    assert run(spark, rows) == brute(rows)


def test_small_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(5, None)]) == [(5, 0, 5)]
    assert run(spark, [(5, "x y"), (5, "x y"), (4, "X  y")]) == [(4, 1, 4), (5, 1, 4), (5, 1, 4)]
    docs = spark.createDataFrame([(7, "x y", "n"), (4, "x y", "m"), (9, None, None)], "doc_id long, text string, owner string")
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 9]


def test_query_on_test_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert sorted(tuple(r) for r in J.op7_ngram_jaccard_join(spark, sf).collect()) == want
    assert any(i != c for i, _, c in want)


@pytest.mark.parametrize("short", [2, 3])
def test_long_lists(spark, monkeypatch, short):
    monkeypatch.setattr(J, "SHORT", short)
    rows = corpus(4)
    assert run(spark, rows) == brute(rows)


def test_long_lists_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "SHORT", 2)
    monkeypatch.setattr(J, "BLOCK", 3)
    monkeypatch.setattr(J, "BROADCAST_PAIRS", 5)
    rows = corpus(5)
    assert run(spark, rows) == brute(rows)


def test_very_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(J, "SPLIT", 4)
    monkeypatch.setattr(J, "BLOCK", 8)
    rows = corpus(6)
    assert run(spark, rows) == brute(rows)


def test_groups_hold_every_pair_of_different_labels(spark):
    rng = random.Random(8)
    rows = [(k, 1000 * k + i, 10, 0, rng.choice([1, 1, 1, 1, 2, 2, *range(10, 30)])) for k in range(3) for i in range(60)] + [(9, i, 10, 0, 1) for i in range(50)]
    got = J.crossing_groups(spark.createDataFrame(rows, "key long, owner long, n long, pos long, label long"), 8).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["group"], ([], []))[r["side"]].append((r["owner"], r["label"]))
    pairs = [frozenset((a, b)) for left, right in groups.values() for i, (a, x) in enumerate(left) for b, y in (right or left[i + 1 :]) if x != y]
    want = {frozenset((r[1], s[1])) for r in rows for s in rows if r[0] == s[0] and r[4] != s[4]}
    assert set(pairs) == want and len(pairs) == len(want)
    assert max(len(a) + len(b) for a, b in groups.values()) < 60 and all(r["key"] != 9 for r in got)


def test_bitmaps_never_differ_more_than_the_sets():
    rng = random.Random(5)
    texts = [f"{' '.join(f'w{rng.randrange(40)}' for _ in range(rng.randrange(1, 300)))}" for _ in range(60)]
    import pyarrow as pa

    data, off = J.K.text_buffer(pa.array(texts))
    sets = J.Sets(data, off, 4)
    bits = J.bitmaps(sets)
    for i in range(60):
        for j in range(60):
            assert J.bits_differ(bits[i], bits[j]) <= len(sets_of(texts[i]) ^ sets_of(texts[j]))


def test_boundary_by_cost():
    assert J.boundary(0, 85) < J.boundary(20, 85) <= J.boundary(10_000, 85)
    for n in range(1, 40):
        for m in range(1, 40):
            c = J.needed(n, m, 85)
            assert 100 * c >= 85 * (n + m - c) and (c == 0 or 100 * (c - 1) < 85 * (n + m - c + 1))
            if c <= min(n, m):
                assert n - c <= J.spare(n, 85)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 105), (105, 103), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 103: 100, 105: 100}


def test_keep_one_of_rows_without_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, a), (None, a), (None, b), (None, b), (None, b + " end"), (None, c), (None, ""), (None, None), (7, "")]
    got = J.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] for r in got if r["doc_id"] is not None)) == [1, 7]
    texts = [r["text"] for r in got if r["doc_id"] is None]
    assert len(texts) == 4 and c in texts and "" in texts and None in texts and len({b, b + " end"} & set(texts)) == 1
