import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions import states as S
from rankloom.operators import wordpieces as W


def by_loop(text, brackets="()[]"):
    parts, now, quote, depth, escaped = [], "", "", 0, False
    for c in text:
        free = not escaped and not quote
        if not escaped and c in "'\"" and quote in ("", c):
            quote = "" if quote else c
        elif free and c in brackets[::2]:
            depth += 1
        elif free and c in brackets[1::2]:
            depth = max(depth - 1, 0)
        elif free and not depth and c == ",":
            parts.append(now.strip(" "))
            now = ""
            continue
        escaped = not escaped and c == "\\"
        now += c
    return parts + ([now.strip(" ")] if now else [])


def test_split_equals_a_loop_over_characters(spark):
    rng = random.Random(3)
    texts = ["", ",", "a", "a,", ",,", "a, b", "f(a, (b, (c, d))), e", "'a, b', \"c, 'd\"", r"it\'s, 'x\', y', z", "), a, (b", "é, 漢, 🎈", "\\", "\\\\, a"]
    texts += ["".join(rng.choice("ab ,,()[]'\"\\é") for _ in range(rng.randrange(40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "i int, t string")
    for brackets in ("()[]", "()"):
        got = {r["i"]: r["p"] for r in df.select("i", S.split_outside(F.col("t"), brackets).alias("p")).collect()}
        assert [got[i] for i in range(len(texts))] == [by_loop(x, brackets) for x in texts]
        assert got[len(texts)] is None


def test_logic_blocks_end_at_headings(spark):
    texts = ["no logic", "FOL; a, b", "x\nFOL; a(b,\nc), d\n\nnot this", "FOL;\n'q'\nFOL; “r, s”\n< / premises >\nz", "FOL; a\nTEXT; b\nTEXT: c\nFOL; \\d\\", "FOL;", "fol; a", "FOL; ', '"]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "i int, t string")
    got = [r["e"] for r in df.orderBy("i").select(S.logic_expressions(F.col("t")).alias("e")).collect()]
    assert got == [[], ["a", "b"], ["a(b, c)", "d"], ["q", "r, s"], ["a", "d"], [], [], [", "], None]


def greedy(word, vocabulary):
    out, at = [], 0
    if len(word) > W.LONGEST:
        return [W.UNKNOWN]
    while at < len(word):
        size = next((n for n in range(len(word) - at, 0, -1) if ("##" if at else "") + word[at : at + n] in vocabulary), None)
        if size is None:
            return [W.UNKNOWN]
        out.append(("##" if at else "") + word[at : at + size])
        at += size
    return out


@pytest.mark.parametrize("most", [1, 4, 1000])
def test_pieces_equal_a_greedy_loop(spark, most):
    rng = random.Random(7)
    vocabulary = {"a", "b", "##a", "##b", "ab", "##ab", "##ba", "aba", "c", "##cc", ".", "é"}
    texts = ["", "   ", None, "ab.ab", "aba abab c cc ccc z", "a" * 101, "é.é", "cab" * 3]
    texts += [" ".join("".join(rng.choice("aaabbcz.") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(12))) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (3, "ab.ab"), (None, "ab")], "docid int, text string")
    got = sorted(((r["docid"], r["pieces"]) for r in W.cut(docs, spark.createDataFrame([(v,) for v in vocabulary], "piece string"), most).collect()), key=str)
    import regex

    want = {(i, t): [p for w in regex.findall(W.WORD, t or "") for p in greedy(w, vocabulary)][:most] for i, t in [*enumerate(texts), (None, "ab")]}
    assert got == sorted(((i, p) for (i, _), p in want.items()), key=str)


def test_joined_text(spark):
    rows = spark.createDataFrame([(["ab", "##c", "d", "##e", "##f", "."],), ([],)], "p array<string>").select(W.joined_text(F.col("p")).alias("t")).collect()
    assert [r["t"] for r in rows] == ["abc def .", ""]
