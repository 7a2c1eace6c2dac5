"""Relevance judgments: readers give distinct (qid, docid), writers take them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.lexing import joined, safe_int, trimmed
from rankloom.sources.lines import is_json, numbered_lines, parsed_json, with_fields
from rankloom.sources.scratch import scratch


def judgment_rows(lines: DataFrame, lenient: bool = False) -> DataFrame:
    """(qid, docid, relevance) of ``qid 0 docid... relevance`` lines; ids may hold spaces.

    Strict readers want ``0`` as the second field and drop lines whose relevance is no integer;
    the lenient one does not look at the second field and fails on such a line.
    """
    f = F.col("f")
    rows = with_fields(lines).where(F.size("f") >= 4)
    relevance = safe_int(F.element_at(f, -1))
    if lenient:
        relevance = F.coalesce(relevance, F.raise_error(F.concat(F.lit("relevance is no integer: "), F.col("line"))).cast("long"))
    else:
        rows = rows.where(F.get(f, F.lit(1)) == "0")
    return rows.select(F.get(f, F.lit(0)).alias("qid"), joined(f, 3, -2).alias("docid"), relevance.alias("relevance"))


def read_qrels(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return judgment_rows(lines, lenient).where("relevance > 0").select("qid", "docid").distinct()


def read_beir_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``query-id``, ``corpus-id``, ``score`` objects; scores are cut to integers (0.7 is none), 0 where missing."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    rows = parsed_json(lines, "`query-id` string, `corpus-id` string, score double").select("row.*")
    return rows.where(F.coalesce(F.col("score"), F.lit(0.0)).cast("int") > 0).where("`query-id` <> '' and `corpus-id` <> ''").select(F.col("query-id").alias("qid"), F.col("corpus-id").alias("docid")).distinct()


def _id(*names: str) -> Column:
    """The first id that is not null (0 is one)."""
    return F.coalesce(*(F.col(f"row.{n}") for n in names))


def read_inline_qrels(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    rows = parsed_json(lines, "_id string, id string, docs array<string>").select(_id("_id", "id").alias("qid"), F.explode("row.docs").alias("docid"))
    return rows.where("qid is not null and docid is not null").distinct()


def read_any_qrels(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects if the first line is one (inline documents or one judgment a line), else plain lines."""
    if not is_json(spark, path):
        return read_qrels(spark, path)
    return read_beir_qrels(spark, path).unionByName(read_inline_qrels(spark, path)).distinct()


def read_jsonl_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``id``, ``docs`` objects: the last line of an id counts; an id without documents stays, with a null docid."""
    rows = parsed_json(numbered_lines(spark, path), "id string, docs array<string>").where("row.id is not null")
    last = rows.groupBy(F.col("row.id").alias("qid")).agg(F.max_by("row.docs", "line_no").alias("docs"))
    kept = F.filter(F.coalesce("docs", F.array().cast("array<string>")), lambda d: d.isNotNull() & (d != ""))
    return last.select("qid", F.explode_outer(F.array_distinct(kept)).alias("docid"))


def read_queries_with_judgments(spark: SparkSession, queries: str, qrels: str, least: int, most: int) -> DataFrame:
    """Single-attribute queries (_id, text) with their documents, if these number between ``least`` and ``most``."""
    rows = parsed_json(numbered_lines(spark, queries), "_id string, text string").select("line_no", F.col("row._id").alias("qid"), F.col("row.text").alias("text"))
    docs = read_beir_qrels(spark, qrels).groupBy("qid").agg(F.sort_array(F.collect_set("docid")).alias("docs"))
    return rows.join(docs, "qid").withColumn("num_docs", F.size("docs")).where(F.col("num_docs").between(least, most))


def read_query_ids(spark: SparkSession, path: str) -> DataFrame:
    """(position, qid) in the file's order."""
    return parsed_json(numbered_lines(spark, path), "_id string, id string").where(_id("_id", "id").isNotNull()).select(F.col("line_no").alias("position"), _id("_id", "id").alias("qid"))


def assign_ids(rows: DataFrame, order: str = "line_no", name: str = "id") -> DataFrame:
    """Ids 1..N in order for a table that has none; ids that are there stay.

    Ranges of the order are written as files; a row's number is its place in its file plus the rows of the files before, so no
    task sees all rows.  They are not computed twice: ranges come from a sample and would differ.
    """
    if name in rows.columns:
        return rows
    spark = rows.sparkSession
    out = scratch(spark, "numbered")
    rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order).write.parquet(out)
    placed = spark.read.schema(rows.schema).parquet(out).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    parts = placed.groupBy("_file").agg(F.count("*").alias("n"))
    parts = parts.select("_file", F.expr("coalesce(sum(n) over (order by _file rows between unbounded preceding and 1 preceding), 0)").alias("_before"))
    return placed.join(F.broadcast(parts), "_file").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_file", "_place", "_before")


def judgment_lines(qrels: DataFrame, relevance: Column | None = None) -> DataFrame:
    """``qid 0 docid relevance`` lines; rows without a document are left out."""
    rows = qrels.where("docid is not null and docid <> ''")
    return rows.select(F.concat_ws(" ", "qid", F.lit("0"), "docid", (F.lit(1) if relevance is None else relevance).cast("string")).alias("value"))


def write_qrels(qrels: DataFrame, path: str, relevance: Column | None = None, mode: str = "error") -> None:
    """``mode='append'`` puts several sources into one folder."""
    judgment_lines(qrels, relevance).write.mode(mode).text(path)


def both_sources(beir: DataFrame, inline: DataFrame) -> DataFrame:
    """Judgments of two sources one after the other: scored rows keep their score, inline ones count 1."""
    scored = beir.select("qid", "docid", F.col("score").cast("int").alias("relevance")) if "score" in beir.columns else beir.withColumn("relevance", F.lit(1))
    return scored.unionByName(inline.select("qid", "docid", F.lit(1).alias("relevance")))


def variant_qrels(rows: DataFrame) -> DataFrame:
    """(id, docs) for evaluation: documents else docs; the id is the query's text, else the line's number from 0."""
    docs = F.coalesce(*(F.col(c) for c in ("documents", "docs") if c in rows.columns))
    return rows.select(F.coalesce(F.nullif(trimmed(F.col("nl_query")), F.lit("")), (F.col("line_no") - 1).cast("string")).alias("id"), docs.alias("docs"))
