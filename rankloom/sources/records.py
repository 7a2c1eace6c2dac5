"""Examples, documents, queries and their conversions; generic JSONL and TSV; embedding tables; merged results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.lexing import trimmed
from rankloom.functions.text import likes, md5_prefix, titled
from rankloom.sources.lines import numbered_lines, parsed_json

METADATA = (
    "template string, domain string, fluency array<boolean>, meaning array<boolean>, naturalness array<boolean>, "
    "relevance_ratings map<string,array<string>>, evidence_ratings map<string,array<string>>, attributions map<string,array<map<string,string>>>"
)
EXAMPLE = f"query string, docs array<string>, original_query string, scores array<double>, metadata struct<{', '.join(f'{x.split()[0]}:{x.split()[1]}' for x in METADATA.split(', '))}>, id string"
DOCUMENT = "title string, text string, idx string"
VARIANT = "queries array<string>, operators array<string>, documents array<string>, nl_query string, output string, domain string"
GENERATED = "id long, query string, num_docs long, docs array<string>, original_query string, metadata struct<template:string,attrs:array<string>,source:string>"


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None, strict: bool = True) -> DataFrame:
    """line_no and the columns of ``schema``; a bad line fails (or is dropped), ``limit`` keeps the first lines."""
    rows = parsed_json(numbered_lines(spark, path), schema, strict)
    if limit is not None:
        rows = rows.where(F.col("line_no") <= limit)
    return rows.select("line_no", "row.*").drop("_corrupt")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.json(path, ignoreNullFields=False)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Examples; metadata fields not in the schema are ignored, unknown fields of an example fail."""
    known = [x.split(" ")[0] for x in ("query", "docs", "original_query", "scores", "metadata", "id")]
    lines = numbered_lines(spark, path).where(trimmed(F.col("line")) != "")
    extra = F.array_except(F.json_object_keys("line"), F.array(*(F.lit(k) for k in known)))
    checked = lines.withColumn("line", F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(extra, ", ")))).otherwise(F.col("line")))
    return parsed_json(checked, EXAMPLE, strict=True).select("line_no", "row.*").drop("_corrupt")


def write_examples(rows: DataFrame, path: str) -> None:
    """Examples as JSON lines: the known fields alone, those that a table lacks as null, so that :func:`read_examples` reads them back."""
    fields = rows.sparkSession.createDataFrame([], EXAMPLE).schema
    known = {f.name: f.dataType.simpleString() for f in fields}
    write_jsonl(rows.select(*((F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t)).alias(c) for c, t in known.items())), path)


def read_documents(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(line_no, title, text, idx); other fields are ignored."""
    return read_jsonl(spark, path, DOCUMENT, limit)


def last_by_title(docs: DataFrame) -> DataFrame:
    """The last document of each title."""
    return docs.groupBy("title").agg(F.max_by(F.struct("text", "idx", "line_no"), "line_no").alias("d")).select("title", "d.*")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(docid, title, text): the id is idx, or the line's number from 0 where idx is missing or empty."""
    docs = read_documents(spark, path)
    return docs.select(F.coalesce(F.nullif("idx", F.lit("")), (F.col("line_no") - 1).cast("string")).alias("docid"), "title", "text")


def index_corpus(docs: DataFrame, most: int | None = None) -> DataFrame:
    """(docid, doc_text) for an index, of the first ``most`` documents."""
    rows = docs if most is None else docs.where(F.col("line_no") <= most)
    return rows.select(F.coalesce("idx", (F.col("line_no") - 1).cast("string")).alias("docid"), titled(F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))).alias("doc_text"))


def read_retrieval_queries(spark: SparkSession, path: str, variants: bool = False) -> DataFrame:
    """(position, text, relevant) from query/docs objects or, with ``variants``, nl_query/documents."""
    names = ("nl_query", "documents") if variants else ("query", "docs")
    rows = read_jsonl(spark, path, f"{names[0]} string, {names[1]} array<string>")
    return rows.select(F.col("line_no").alias("position"), F.col(names[0]).alias("text"), F.col(names[1]).alias("relevant"))


def read_tsv(spark: SparkSession, path: str, most_splits: int | None = None) -> DataFrame:
    """(line_no, cells): white space at a line's end is cut first; ``most_splits`` leaves the rest in the last cell."""
    line = F.regexp_replace("line", r"(?U)\s+$", "")
    return numbered_lines(spark, path).select("line_no", F.split(line, "\t", -1 if most_splits is None else most_splits + 1).alias("cells"))


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    return numbered_lines(spark, path).select("line_no", F.regexp_replace("line", r"(?U)\s+$", "").alias("line"))


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)).alias("value")).write.text(path)


def text_results_for_evaluation(rows: DataFrame) -> DataFrame:
    """(id, docs, scores) from results by text; the id is the text, else query_id."""
    return rows.select(F.coalesce(F.nullif("nl_query", F.lit("")), "query_id").alias("id"), F.transform("documents", lambda d: d["doc_id"]).alias("docs"), F.transform("documents", lambda d: d["score"]).alias("scores"))


def text_results_by_hash(rows: DataFrame) -> DataFrame:
    """(qid, docid, rank, score) with the first 16 hex digits of the text's md5 as qid."""
    items = rows.select(md5_prefix(F.col("nl_query")).alias("qid"), F.posexplode("documents"))
    return items.select("qid", F.col("col.doc_id").alias("docid"), (F.col("pos") + 1).alias("rank"), F.col("col.score").alias("score"))


#: Templates by the operators of a variant, and how many attributes each combines.
TEMPLATES = {"OR": "_ or _", "OR_OR": "_ or _ or _", "AND": "_ that are also _", "AND_AND": "_ that are also both _ and _", "NOT": "_ that are not _", "AND_NOT": "_ that are also _ but not _"}


def operator_key(operators: Column) -> Column:
    return F.array_join(F.sort_array(F.transform(operators, lambda o: F.upper(o))), "_")


def variant_template(operators: Column) -> Column:
    """The template of a variant's operators; ``_`` without any, null for other combinations."""
    known = F.create_map(*(F.lit(x) for pair in TEMPLATES.items() for x in pair))
    return F.when(F.coalesce(F.size(operators), F.lit(0)) <= 0, "_").otherwise(F.try_element_at(known, operator_key(operators)))


def variants_to_examples(rows: DataFrame) -> DataFrame:
    """Examples from variants: sub-queries marked and joined by their operators, a single one unmarked; ids count lines."""
    marked = F.transform("queries", lambda q, i: F.concat(F.lit("<mark>"), q, F.lit("</mark>"), F.coalesce(F.concat(F.lit(" "), F.get(F.col("operators"), i)), F.lit(""))))
    original = F.when(F.size("queries") == 1, F.col("queries")[0]).otherwise(F.array_join(marked, " "))
    return rows.select(F.col("line_no").alias("id"), F.col("nl_query").alias("query"), F.col("documents").alias("docs"), original.alias("original_query"), F.lit(None).cast("array<double>").alias("scores"), F.struct(variant_template("operators").alias("template"), "domain").alias("metadata"))


def entity_attributes(corpus: DataFrame, entity: str = "_id", text: str = "text") -> DataFrame:
    """(entity, attr): what each entity's text says that it likes; entities that like nothing are dropped."""
    return corpus.select(F.col(entity).alias("entity"), F.explode(likes(F.col(text))).alias("attr")).distinct()


def attribute_counts(ea: DataFrame) -> DataFrame:
    return ea.groupBy("attr").agg(F.count("*").alias("n")).orderBy("attr")


def document_maps(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(idx, title) and (idx, text) with new lines as spaces, by line number from 0."""
    flat = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    idx = (F.col("line_no") - 1).alias("idx")
    return docs.select(idx, flat(F.col("title")).alias("title")), docs.select(idx, F.concat_ws(" ", flat(F.col("title")), flat(F.col("text"))).alias("text"))


def indexed_examples(examples: DataFrame, titles: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(qidx, query) of examples with documents, (qidx, docidx), and (query, text) in an order fixed by the seed."""
    some = examples.where(F.size("docs") > 0).withColumn("qidx", F.col("line_no") - 1)
    pairs = some.select("qidx", "query", F.explode("docs").alias("title")).join(titles.select("title", F.col("idx").alias("docidx"), *(["text"] if "text" in titles.columns else [])), "title")
    shuffled = pairs.orderBy(F.xxhash64(F.lit(seed), "qidx", "docidx")).select("query", F.col("text" if "text" in titles.columns else "title").alias("text"))
    return some.select("qidx", "query"), pairs.select("qidx", "docidx"), shuffled


def metrics_json(cutoffs: list[int], means: DataFrame, most: int | None = None) -> DataFrame:
    """One JSON row of (cutoff, recall, ndcg, num_queries) means."""
    grouped = means.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("cutoff").cast("string"), "recall")))).alias("recall"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("cutoff").cast("string"), "ndcg")))).alias("ndcg"), F.max("num_queries").alias("num_queries"))
    return grouped.select(F.to_json(F.struct(F.array(*(F.lit(c) for c in cutoffs)).alias("cutoffs"), "recall", "ndcg", "num_queries", F.lit(most).cast("int").alias("max_queries"))).alias("value"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], drop_where: str | None = None) -> DataFrame:
    """``old`` without the keys of ``new`` (and without legacy rows), then ``new``."""
    kept = old if drop_where is None else old.where(f"not coalesce({drop_where}, false)")
    return kept.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def read_details(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Chunked CSV results as one table; a missing chunk fails, and so does a row that occurs twice."""
    return without_repeats(spark.read.schema(schema).option("header", True).csv(paths))


def without_repeats(rows: DataFrame) -> DataFrame:
    """The rows; each of them fails the read if it occurs twice."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    first = rows.columns[0]
    return counted.withColumn(first, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated row: "), F.to_json(F.struct(*rows.columns)))).cast(rows.schema[first].dataType)).otherwise(F.col(first))).drop("_n")


def sliced(rows: DataFrame, first: int | None = None, start: int = 0, stop: int | None = None) -> DataFrame:
    """Lines of the first ``first``, of them those at places [start, stop) from 0."""
    at = F.col("line_no") - 1
    ends = [x for x in (first, stop) if x is not None]
    return rows.where((at >= start) & (at < min(ends) if ends else F.lit(True)))


def write_embeddings(rows: DataFrame, path: str) -> None:
    """(docid, embedding) as Parquet, split by hash of the id; the unit of recomputation is a part file."""
    rows.write.parquet(path)


def checked_embeddings(rows: DataFrame, expected_rows: int, dims: int) -> DataFrame:
    """The rows, after their number and every vector's length have been compared; fails if they differ."""
    found = rows.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
    if found["n"] != expected_rows or (expected_rows and (found["least"], found["most"]) != (dims, dims)):
        raise ValueError(f"{found['n']} rows of {found['least']} to {found['most']} numbers; expected {expected_rows} of {dims}")
    return rows


def valid_shards(shards: DataFrame, expected: DataFrame) -> DataFrame:
    """Shards whose rows number as expected; the others are to be computed again."""
    counted = shards.groupBy("shard").agg(F.count("*").alias("n"))
    return expected.join(counted, "shard", "left").withColumn("valid", F.coalesce(F.col("n") == F.col("expected"), F.lit(False))).select("shard", "expected", F.coalesce("n", F.lit(0)).alias("n"), "valid")
