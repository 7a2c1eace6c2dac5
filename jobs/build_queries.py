"""Build a set of Boolean queries with their relevant documents from the habits of customers.

    spark-submit jobs/build_queries.py --orders DIR --lineitem DIR --part DIR --output DIR

Tests of set-compositional retrieval need queries such as "Who likes A but not B?" whose answers are known.  Entities are customers;
a customer's attributes are the kinds (type and size) of the parts that they bought and the priorities and states of their orders.  For each
template all combinations whose number of answers is in the range are counted, and a sample is drawn that is balanced over
ranges of that number; draws are ordered by a hash of seed and combination, so they repeat.

Output, below ``output``:
  queries/template=T/  JSON lines: id, query, original_query, attrs, depth, num_docs, bucket
  qrels/template=T/    Parquet: qid, docid
Templates are written with dynamic overwrite: a run replaces the folders of its templates and leaves others, so one template can be built anew.
"""

from __future__ import annotations

import sys
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from jobs.common import LOG, command_line, settings  # noqa: E402
from rankloom.operators import sampling, setalg  # noqa: E402
from rankloom.operators.aggregates import template_place  # noqa: E402

QUERIES = "id string, query string, original_query string, attrs array<string>, depth int, num_docs long, bucket int, template string"


def habits(orders: DataFrame, lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """(entity, attr), each once."""
    bought = orders.select("o_orderkey", F.col("o_custkey").alias("entity")).join(lineitem.select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    types = bought.join(part.select("p_partkey", F.concat(F.col("p_type"), F.lit("/"), F.col("p_size").cast("string")).alias("attr")), F.col("l_partkey") == F.col("p_partkey")).select("entity", "attr")
    own = orders.select(F.col("o_custkey").alias("entity"), F.explode(F.array("o_orderpriority", F.concat(F.lit("state "), "o_orderstatus"))).alias("attr"))
    return types.unionAll(own).where("entity is not null and attr is not null").distinct()


def combinations_in_range(ea: DataFrame, templates: list[str], least: int, most: int) -> DataFrame:
    """(template, attrs, num_docs) of those of the templates that take one or two attributes, and of larger ones."""
    found = []
    if setalg.SINGLE in templates:
        found.append(setalg.singles(ea).select(F.lit(setalg.SINGLE).alias("template"), F.array("a").alias("attrs"), F.col("na").alias("num_docs")).where(F.col("num_docs").between(least, most)))
    for size, names, counted in ((2, ("a", "b"), setalg.valid_pairs), (3, ("a", "b", "c"), setalg.valid_triples)):
        if own := [t for t in templates if setalg.ARITY[t] == size]:
            found.append(counted(ea, least, most).where(F.col("template").isin(own)).select("template", F.array(*names).alias("attrs"), "num_docs"))
    return reduce(DataFrame.unionAll, found)


def texts(sample: DataFrame) -> DataFrame:
    """Queries with their texts and ids: the template's place in the fixed order, and a number within it."""
    args = [F.element_at("attrs", i + 1) for i in range(3)]
    of = lambda marked: F.coalesce(*(F.when(F.col("template") == t, setalg.render(t, *args[:n], marked=marked)) for t, n in setalg.ARITY.items()))
    order = Window.partitionBy("template").orderBy(F.array_join("attrs", "|"))
    number = F.concat_ws("-", template_place(F.col("template")).cast("string"), F.row_number().over(order).cast("string"))  # of a sample of bounded size
    return sample.select(number.alias("id"), of(False).alias("query"), of(True).alias("original_query"), "attrs", setalg.depth(F.col("template"), F.col("attrs")).alias("depth"), F.col("num_docs").cast("long").alias("num_docs"), "bucket", "template")


def build_queries(spark: SparkSession, orders: str, lineitem: str, part: str, output: str, **given) -> dict:
    """Write queries and judgments; returns what was read and written."""
    config = settings(__file__, **given)
    if not config["templates"] or (unknown := set(config["templates"]) - set(setalg.ARITY)):
        raise ValueError(f"unknown templates: {sorted(unknown) if config['templates'] else 'none given'}")
    tables = {name: spark.read.parquet(path) for name, path in (("orders", orders), ("lineitem", lineitem), ("part", part))}
    ea = habits(**tables).persist()  # counted by each template, and asked again for the answers
    try:
        relation = ea.agg(F.count("*").alias("rows"), F.count_distinct("entity").alias("entities"), F.count_distinct("attr").alias("attrs")).first().asDict()
        LOG.info("read %s: %s", {"orders": orders, "lineitem": lineitem, "part": part}, relation)
        sample = sampling.enumerated_queries(combinations_in_range(ea, config["templates"], config["least"], config["most"]), config["queries"], config["seed"])
        put = lambda rows, name: rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("template")
        put(texts(sample).repartition("template").sortWithinPartitions("template", "id"), "queries").json(f"{output}/queries")
        queries = read_queries(spark, output).where(F.col("template").isin(config["templates"]))
        answers = setalg.answers(ea, queries.select("id", "template", "attrs")).withColumnsRenamed({"id": "qid", "entity": "docid"})
        placed = answers.join(F.broadcast(queries.select(F.col("id").alias("qid"), "template")), "qid")  # queries are bounded by the settings
        put(placed.select("qid", "docid", "template").repartition("template", F.pmod(F.xxhash64("docid"), F.lit(8))).sortWithinPartitions("template", "qid", "docid"), "qrels").parquet(f"{output}/qrels")
        told = relation | {"queries": queries.count(), "qrels": read_qrels(spark, output).where(F.col("template").isin(config["templates"])).count()}
        LOG.info("wrote %s queries and %s judgments to %s", told["queries"], told["qrels"], output)
        return told
    finally:
        ea.unpersist()


def read_queries(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(QUERIES).json(f"{output}/queries")


def read_qrels(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema("qid string, docid long, template string").parquet(f"{output}/qrels")


def main() -> None:
    args, config, spark = command_line(__file__, build_queries.__doc__, "orders", "lineitem", "part", "output")
    try:
        build_queries(spark, args.orders, args.lineitem, args.part, args.output, **config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
