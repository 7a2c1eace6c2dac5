import pytest
from pyspark.sql import functions as F

from rankloom.functions import lexing as L
from rankloom.functions import text as T


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_numbers_as_python_reads_them(spark):
    assert values(spark, ["1", "-2", "1_000", "1.0", "1d", "", None, "+3", "１"], L.safe_int) == [1, -2, 1000, None, None, None, None, 3, None]
    got = values(spark, ["0.5", "1e-3", ".5", "5.", "1f", "nan", "-inf", "x", None], L.safe_float)
    assert got[:5] == [0.5, 0.001, 0.5, 5.0, None] and got[5] != got[5] and got[6] == float("-inf") and got[7:] == [None, None]


def test_unicode_space(spark):
    assert values(spark, ["a b  c", "  ", None], L.fields) == [["a", "b", "c"], [], None]


@pytest.mark.parametrize(("text", "want"), [
    ("Bob likes Tea, Jazz, and Chess.", ["Tea", "Jazz", "Chess"]), ("Bob likes Tea, Jazz and Chess.", ["Tea", "Jazz", "Chess"]),
    ("Bob likes Tea and Jazz.", ["Tea and Jazz"]), ("Bob hates Tea.", []), ("Bob likes Tea, Tea.", ["Tea"]),
])
def test_likes(spark, text, want):
    assert values(spark, [text], T.likes) == [want]


def test_names_and_estimates(spark):
    assert values(spark, ["Films set in (New) York!", "__a__"], T.predicate_name) == ["films_set_in_new_york", "a"]
    assert values(spark, ["American Psycho (film)"], T.clean_title) == ["American_Psycho"]
    assert values(spark, ["abcdefgh", "abc", None], T.token_estimate) == [2, 0, 0]
    assert values(spark, ["Who likes Tea?", "who?"], T.single_attribute) == ["Tea", None]
    assert values(spark, ["a\tb\nc'''d"], T.tsv_clean) == ["a b cd"]


def test_answers(spark):
    replies = ['x {"Answer": "True"} y', "{'Answer': 'False'}", "so Answer: true", "Answer=False", '{"Answer": "maybe"}', "none"]
    assert values(spark, replies, T.answer) == ["True", "False", "True", "False", None, None]
    assert values(spark, replies[:2], T.verdict_score) == [1.0, 0.0]
    fenced = "```python\na\n``` text ```python\nb = 1\n``` ```JSON\n{}\n```"
    assert values(spark, [fenced], lambda x: T.fenced(x, "python")) == ["b = 1\n"]
    assert values(spark, [fenced], lambda x: T.fenced(x, "python", last=False)) == ["a\n"]


def test_chunks(spark):
    short, long = "a" * 6143, "b" * 8000
    got = values(spark, [short, long], T.chunks)
    assert [len(x) for x in got[0]] == [6143] and [len(x) for x in got[1]] == [8000, 608]


def test_properties_and_context(spark):
    df = spark.sql("select map('publication date', array('1999-05-01'), 'IMDb ID', array('x'), 'cast', array('y'), 'genre', array('film noir', 'statement/1')) p, 'q <mark>A</mark> not <mark>B</mark>' q, array('Category:A', 'Category:C') c")
    row = df.select(T.flat_properties(T.kept_properties(F.col("p"))).alias("flat"), T.premises(T.kept_properties(F.col("p"))).alias("premises"), T.kept_categories(F.col("c"), F.col("q")).alias("c"), T.marked(F.col("q")).alias("m"), T.context("wd", F.lit("e"), F.lit("w"), T.kept_properties(F.col("p"))).alias("ctx")).first()
    assert row["flat"] == "publication date: 1999-05-01. genre: film noir." and row["c"] == ["A"] and row["m"] == ["A", "B"]
    assert [(p["property"], p["values"]) for p in row["premises"]] == [("publication_date", ["1999"]), ("genre", ["film_noir"])]
    assert row["ctx"] == "e\npublication date: 1999-05-01. genre: film noir."


def test_splits_and_sections(spark):
    assert values(spark, ['a, f(b, c), "d, e", [g, h]'], T.balanced_split) == [["a", "f(b, c)", '"d, e"', "[g, h]"]]
    got = values(spark, ["x\nPremises:\na\nb\n# Goal\nc"], T.sections)[0]
    assert [(s["header"], s["lines"]) for s in got] == [("", ["x"]), ("Premises", ["a", "b"]), ("Goal", ["c"])]


def test_hashes_and_prompts(spark):
    row = spark.range(1).select(
        T.content_hash(F.array(F.lit("a"), F.lit("b"))).alias("h"), (T.cache_key(F.lit("a"), F.lit("bc")) == T.cache_key(F.lit("ab"), F.lit("c"))).alias("same"), T.prompt("Q: {q} C: {c}", q=F.lit("x"), c=F.lit(None)).alias("p"),
        T.encoder_input("embed", F.lit("t"), instruction="do").alias("e"), T.encoder_input("instruct", F.lit("t"), "passage").alias("d"), T.percent_difference(F.lit(3.0), F.lit(2.0)).alias("pd"), T.first_pieces(F.lit("a b. c"), 3).alias("fp"),
    ).first()
    import hashlib

    assert row["h"] == hashlib.sha256(b"a\nb\n").hexdigest()[:24] and not row["same"] and row["p"] == "Q: x C: "
    assert row["e"] == "<|user|>\ndo\n<|embed|>\nt" and row["d"] == "t" and row["pd"] == 50.0 and row["fp"] == "a b ."
