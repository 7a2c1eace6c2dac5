"""Text files with line numbers, read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.lexing import fields, trimmed


#: Files that Spark's writers leave in a folder are parts of one text.
PART = r"/part-[^/]*$"


def numbered_lines(spark: SparkSession, path: str | list[str], start: int = 1) -> DataFrame:
    """(file, line_no, line): numbers count blank lines and start anew in each file, or folder of part files.

    Part files (``part-*``) follow one another by name and are numbered through, so a text may be written by
    many tasks.  A split of a file is read in order by one task.  So a line's number is its place in its split
    plus the lines of the splits before; only one row for each split is aggregated and joined back,
    and no line is sorted or moved.
    """
    raw = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("split"))
    raw = raw.withColumn("place", F.monotonically_increasing_id())
    splits = raw.groupBy("part", "split").agg(F.count("*").alias("n"), F.min("place").alias("first")).withColumn("file", F.regexp_replace("part", PART, ""))
    before = Window.partitionBy("file").orderBy("part", "split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    joined = raw.join(splits, ["part", "split"])
    return joined.select("file", (F.col("before") + F.col("place") - F.col("first") + start).alias("line_no"), "line")


def parsed_json(lines: DataFrame, schema: str, strict: bool = False) -> DataFrame:
    """Lines with a struct ``row``; blank lines are dropped after they were counted, malformed ones too unless ``strict``."""
    given = lines.where(trimmed(F.col("line")) != "").withColumn("row", F.from_json("line", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    bad = F.col("row").isNull() | F.col("row._corrupt").isNotNull()
    if strict:
        return given.withColumn("row", F.when(bad, F.raise_error(F.concat(F.lit("malformed line: "), F.col("line")))).otherwise(F.col("row")))
    return given.where(~bad)


def is_json(spark: SparkSession, path: str) -> bool:
    """Whether the first line that is not blank is a JSON object."""
    first = spark.read.text(path).where(trimmed(F.col("value")) != "").limit(1)
    row = first.select((F.try_parse_json("value").isNotNull() & trimmed(F.col("value")).startswith("{")).alias("ok")).first()
    return bool(row and row["ok"])


def with_fields(lines: DataFrame) -> DataFrame:
    return lines.withColumn("f", fields(F.col("line")))
