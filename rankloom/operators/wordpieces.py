"""Word pieces by the longest match over a vocabulary table, and texts cut to a number of pieces.

Pieces are found once for each different word: its substrings are joined with the vocabulary, and a fold takes the longest match from the
word's beginning on.  Documents are then joined with their words' pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words, and single marks of punctuation.
WORD = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
#: What a piece inside a word begins with, and what stands for a word that cannot be taken apart or is longer.
INSIDE, UNKNOWN, LONGEST = "##", "[UNK]", 100


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def pieces(given: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, pieces) of the different words of ``given`` (word) by ``vocabulary`` (piece): the longest match first, from left to right.

    A word of which some rest matches nothing is one unknown piece, as a whole.
    """
    given = given.select("word").where("word is not null and word <> ''").distinct()
    short = given.where(F.length("word") <= LONGEST)
    starts = short.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    parts = starts.select("word", "at", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("at") + 1)).alias("size"))
    parts = parts.withColumn("piece", F.concat(F.when(F.col("at") > 1, INSIDE).otherwise(""), F.substring("word", F.col("at"), F.col("size"))))
    longest = parts.join(vocabulary.select("piece").distinct(), "piece", "left_semi").groupBy("word", "at").agg(F.max("size").alias("size"))
    reach = longest.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("at", "size"))).alias("reach"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, at: Column) -> Column:
        size = F.try_element_at(F.col("reach"), at)
        piece = F.concat(F.when(at > 1, INSIDE).otherwise(""), F.substring(F.col("word"), at, size))
        here = (s["at"] == at) & size.isNotNull()
        return F.struct(F.when(here, at + size).otherwise(s["at"]).alias("at"), F.when(here, F.concat(s["out"], F.array(piece))).otherwise(s["out"]).alias("out"))

    folded = reach.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.length("word")), start, step)).where(F.col("s.at") > F.length("word"))
    found = folded.select("word", F.col("s.out").alias("pieces"))
    return given.join(found, "word", "left").withColumn("pieces", F.coalesce("pieces", F.array(F.lit(UNKNOWN))))


def cut(rows: DataFrame, vocabulary: DataFrame, most: int, key: str = "docid", text: str = "text") -> DataFrame:
    """(key, pieces): the first ``most`` pieces of each text; null and empty texts have none, rows that repeat a key and text count once.

    A word has at least one piece, so no more than the first ``most`` words are taken apart.
    """
    asked = rows.select(F.col(key).alias("key"), F.slice(F.coalesce(words(F.col(text)), F.array().cast("array<string>")), 1, most).alias("w")).withColumn("row", F.xxhash64("key", "w")).dropDuplicates(["key", "row"])
    placed = asked.select("key", "row", F.posexplode_outer("w").alias("at", "word"))
    own = pieces(placed.select("word"), vocabulary)
    joined = placed.join(own, "word", "left").withColumn("n", F.coalesce(F.size("pieces"), F.lit(0)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key", "row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = joined.withColumn("before", before).where(F.col("before") < most)
    lists = joined.groupBy("key", "row").agg(F.array_sort(F.collect_list(F.struct("at", "pieces"))).alias("p"))
    every = F.flatten(F.transform("p", lambda x: F.coalesce(x["pieces"], F.array().cast("array<string>"))))
    return lists.select(F.col("key").alias(key), F.slice(every, 1, most).alias("pieces"))


def joined_text(found: Column) -> Column:
    """The text of pieces: those inside a word follow the piece before without a space."""
    return F.replace(F.array_join(found, " "), F.lit(f" {INSIDE}"), F.lit(""))
