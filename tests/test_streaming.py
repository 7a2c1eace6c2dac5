import pytest
from pyspark.sql import functions as F

from rankloom.sources.scratch import scratch
from rankloom.streaming import incremental as I


def add(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("append").json(folder)


def test_stream_keeps_seen_ids_over_restarts_without_reading_its_output(spark):
    source, out, check = (scratch(spark, x) for x in ("in", "out", "check"))
    run = lambda work=lambda d: d: I.append_stream(spark, source, "id long, v long", out, check, work).awaitTermination()
    add(spark, source, [(1, 1), (2, 2), (2, 2)], "id long, v long")
    run()
    spark.read.parquet(out).where("id = 1").drop("batch").write.mode("overwrite").parquet(f"{out}-moved")  # the output may go elsewhere
    add(spark, source, [(2, 9), (3, 3)], "id long, v long")
    run()
    add(spark, source, [(1, 9), (3, 9), (4, 4)], "id long, v long")
    run()
    assert sorted((r["id"], r["v"], r["batch"]) for r in spark.read.parquet(out).collect()) == [(1, 1, 0), (2, 2, 0), (3, 3, 1), (4, 4, 2)]


def test_a_batch_that_failed_is_replaced(spark):
    source, out, check = (scratch(spark, x) for x in ("in", "out", "check"))
    add(spark, source, [(1, 1), (2, 2)], "id long, v long")

    def breaks(d):
        return d.withColumn("v", F.when(F.col("id") == 2, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("v")))

    with pytest.raises(Exception, match="lost"):
        I.append_stream(spark, source, "id long, v long", out, check, breaks).awaitTermination()
    I.append_stream(spark, source, "id long, v long", out, check, lambda d: d).awaitTermination()
    assert sorted((r["id"], r["v"]) for r in spark.read.parquet(out).collect()) == [(1, 1), (2, 2)]


def test_confusion_matrix_grows_over_restarts(spark):
    source, out, check = (scratch(spark, x) for x in ("in", "out", "check"))
    rows = [("True", "False"), ("True", "True"), (None, "True")]
    for n in (1, 2):
        add(spark, source, rows, "gold string, predicted string")
        I.confusion_stream(spark, source, "gold string, predicted string", out, check).awaitTermination()
        assert {tuple(r) for r in spark.read.parquet(out).collect()} == {("True", "False", n), ("True", "True", n), (None, "True", n)}


def test_appended_rows_are_counted_as_they_are_written(spark):
    out = scratch(spark, "out")
    rows = spark.range(10).withColumn("v", F.col("id") * 2)
    assert I.append_new(rows.where("id < 4"), out, lambda d: d) == 4
    assert I.append_new(rows, out, lambda d: d.where("id <> 7")) == 5
    assert I.append_new(rows, out, lambda d: d) == 1 and I.append_new(rows, out, lambda d: d) == 0
