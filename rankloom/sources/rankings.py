"""Rankings: readers give (qid, docid, rank, score, run_name), duplicates included; writers take them."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.lexing import joined, safe_float, safe_int, trimmed
from rankloom.operators.ranking import rank_by_given, rank_by_score
from rankloom.sources.lines import numbered_lines, parsed_json, with_fields

RUN = ("qid", "docid", "rank", "score", "run_name")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """``qid Q0 docid... rank score name`` lines, read from their end, so ids may hold spaces and digits; by given rank."""
    f = F.col("f")
    rows = with_fields(numbered_lines(spark, path)).where((F.size("f") >= 6) & (F.get(f, F.lit(1)) == "Q0"))
    rows = rows.select("line_no", F.get(f, F.lit(0)).alias("qid"), joined(f, 3, -4).alias("docid"), safe_int(F.element_at(f, -3)).alias("given"), safe_float(F.element_at(f, -2)).alias("score"), F.element_at(f, -1).alias("run_name"))
    return rank_by_given(rows.where("given is not null and score is not null"), "given", "line_no").select(*RUN)


def _first_place(parts: Column, start: int, test) -> Column:
    """The first place (from 1) at or after ``start`` whose field passes; 0 without one."""
    flags = F.transform(parts, lambda x, i: (i >= start - 1) & F.coalesce(test(x), F.lit(False)))
    return F.array_position(flags, True).cast("int")


def read_flexible_run(spark: SparkSession, path: str, forward: bool = False) -> DataFrame:
    """Lines of several layouts, each tried in turn: six fields with ``Q0``; tab-separated; ``qid docid... score [name]``.

    ``forward`` takes the first integer after ``Q0`` as the rank, as older tools did, which cuts ids that hold numbers.
    """
    f = F.col("f")
    lines = with_fields(numbered_lines(spark, path)).where(F.size("f") >= 3)
    six = (F.size("f") >= 6) & (F.get(f, F.lit(1)) == "Q0")
    if forward:
        rank_at = _first_place(f, 3, lambda x: safe_int(x).isNotNull())
        score_at = F.when(rank_at > 0, F.array_position(F.transform(f, lambda x, i: (i >= rank_at) & safe_float(x).isNotNull()), True).cast("int"))
        docid = F.array_join(F.slice(f, F.lit(3), F.greatest(rank_at - 3, F.lit(0))), " ")
        name = F.array_join(F.slice(f, score_at + 1, F.greatest(F.size("f") - score_at, F.lit(0))), " ")
        whole = F.when(six & (rank_at > 0) & (score_at > 0), F.struct(F.get(f, F.lit(0)).alias("qid"), docid.alias("docid"), safe_int(F.get(f, rank_at - 1)).alias("given"), safe_float(F.get(f, score_at - 1)).alias("score"), name.alias("run_name")))
    else:
        rank, score = safe_int(F.element_at(f, -3)), safe_float(F.element_at(f, -2))
        whole = F.when(six & rank.isNotNull() & score.isNotNull(), F.struct(F.get(f, F.lit(0)).alias("qid"), joined(f, 3, -4).alias("docid"), rank.alias("given"), score.alias("score"), F.element_at(f, -1).alias("run_name")))
    tabs = F.transform(F.split("line", "\t"), trimmed)
    none = F.lit(None).cast("long")
    tabbed = F.when((F.size(tabs) >= 3) & safe_float(F.get(tabs, F.lit(2))).isNotNull(), F.struct(tabs[0].alias("qid"), F.get(tabs, F.lit(1)).alias("docid"), none.alias("given"), safe_float(F.get(tabs, F.lit(2))).alias("score"), F.coalesce(F.get(tabs, F.lit(3)), F.lit("run")).alias("run_name")))
    at = _first_place(f, 2, lambda x: safe_float(x).isNotNull())
    simple = F.when(at > 2, F.struct(F.get(f, F.lit(0)).alias("qid"), F.array_join(F.slice(f, F.lit(2), F.greatest(at - 2, F.lit(0))), " ").alias("docid"), none.alias("given"), safe_float(F.get(f, at - 1)).alias("score"), F.coalesce(F.get(f, at), F.lit("run")).alias("run_name")))
    rows = lines.select("line_no", F.coalesce(whole, tabbed, simple).alias("r")).where("r is not null").select("line_no", "r.*")
    return rank_by_score(rows, "score", F.struct(F.coalesce("given", F.lit(0)), F.col("line_no"))).select(*RUN)


def read_jsonl_run(spark: SparkSession, path: str, run_name: str = "run") -> DataFrame:
    """``id``, ``docs``, ``scores`` objects: lines of unequal lengths and pairs without a document are dropped, the last line of an id counts."""
    rows = parsed_json(numbered_lines(spark, path), "_id string, id string, docs array<string>, scores array<double>, retrieved string")
    rows = rows.select("line_no", F.coalesce("row._id", "row.id").alias("qid"), "row.docs", "row.scores", "row.retrieved")
    rows = rows.where("qid <> '' and retrieved is null and size(docs) = size(scores)")
    last = rows.groupBy("qid").agg(F.max_by(F.struct("docs", "scores"), "line_no").alias("r"))
    pairs = last.select("qid", F.posexplode(F.arrays_zip("r.docs", "r.scores"))).select("qid", "pos", F.col("col.docs").alias("docid"), F.col("col.scores").alias("score"), F.lit(run_name).alias("run_name"))
    return rank_by_score(pairs.where("docid is not null and docid <> ''"), "score", F.col("pos")).select(*RUN)


RESULT = "query string, relevant array<string>, retrieved array<struct<rank:int,score:double,title:string>>"


def read_results(spark: SparkSession, path: str, query_ids: DataFrame | None = None, by_rank: bool = False, run_name: str = "run") -> DataFrame:
    """``query``, ``relevant``, ``retrieved`` objects; the qid is the line's number (blank lines count) or that of ``query_ids`` (position, qid).

    A query that retrieved nothing is absent.  ``by_rank`` orders by the items' own rank.
    """
    rows = parsed_json(numbered_lines(spark, path), RESULT)
    if query_ids is not None:
        rows = rows.join(query_ids.withColumnRenamed("position", "line_no"), "line_no")
    else:
        rows = rows.withColumn("qid", F.col("line_no").cast("string"))
    items = rows.select("qid", F.posexplode("row.retrieved")).where("col.title is not null and col.title <> ''").select("qid", "pos", F.col("col.title").alias("docid"), F.coalesce("col.rank", F.lit(0)).alias("given"), F.col("col.score").alias("score"), F.lit(run_name).alias("run_name"))
    return (rank_by_given(items, "given", "pos") if by_rank else rank_by_score(items, "score", F.col("pos"))).select(*RUN)


TEXT_RESULT = "query_id string, nl_query string, documents array<struct<doc_id:string,score:double>>"


def read_text_results(spark: SparkSession, path: str, query_ids: DataFrame, run_name: str = "run") -> DataFrame:
    """Results by the query's text: (text, qid) of ``query_ids`` matched exactly, else in lower case; unmatched ones are dropped."""
    from rankloom.operators.joins import match_text

    rows = parsed_json(numbered_lines(spark, path), TEXT_RESULT).select("line_no", F.col("row.nl_query").alias("text"), "row.documents")
    items = match_text(rows, query_ids).select("qid", F.posexplode("documents")).select("qid", "pos", F.col("col.doc_id").alias("docid"), F.col("col.score").alias("score"), F.lit(run_name).alias("run_name"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "pos")
    return items.withColumn("rank", F.row_number().over(order)).select(*RUN)


def read_by_format(spark: SparkSession, path: str, kind: str, query_ids: DataFrame | None = None) -> DataFrame | None:
    """By the name of a layout; an unknown layout or a path that is not there gives None."""
    readers = {"trec": lambda: read_run(spark, path), "results": lambda: read_results(spark, path, query_ids), "jsonl": lambda: read_jsonl_run(spark, path), "text": lambda: read_text_results(spark, path, query_ids), "flexible": lambda: read_flexible_run(spark, path)}
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if kind not in readers or not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where):
        return None
    return readers[kind]()


def qid_order(qid: Column) -> list[Column]:
    """Numeric ids first, by number, then the others by text."""
    return [safe_int(qid).isNull(), safe_int(qid), qid]


def run_lines(run: DataFrame) -> DataFrame:
    """``qid Q0 docid rank score name`` lines with new ranks from 1 and six decimals, in order."""
    ranked = rank_by_given(run.withColumnRenamed("rank", "_given"), "_given", "docid")
    line = F.format_string("%s Q0 %s %d %.6f %s", "qid", "docid", "rank", "score", F.coalesce("run_name", F.lit("run")))
    return ranked.orderBy(*qid_order(F.col("qid")), "rank").select(line.alias("value"))


def write_run(run: DataFrame, path: str) -> None:
    """Part files in order: their names sort as their lines do."""
    run_lines(run).write.text(path)


def result_rows(run: DataFrame, queries: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(position, value): a JSON line for each query with what it retrieved, titles looked up by id."""
    rows = run
    if titles is not None:
        rows = rows.join(titles.select(F.col("docid"), F.col("title").alias("_title")), "docid", "left")
    title = F.coalesce("_title", "docid") if titles is not None else F.col("docid")
    items = rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "score", title.alias("title")))).alias("retrieved"))
    out = queries.join(items, "qid", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<struct<rank:int,score:double,title:string>>")))
    return out.select("position", F.to_json(F.struct(F.col("text").alias("query"), "relevant", "retrieved")).alias("value")).orderBy("position")


def run_name_of(path: str) -> str:
    return PurePosixPath(path).stem
