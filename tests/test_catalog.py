import pytest
from oracle import same_rows

import __spark_entry__ as entry
from rankloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_rows_equal_those_of_sql(spark, name):
    same_rows(spark, catalog.QUERIES[name], catalog.SQL[name], SF)


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    row = entry.entry(spark).first()
    assert 0 < row["ndcg"] <= 1 and row["num_queries"] == 5


def test_top_k_is_cut_before_the_shuffle(spark):
    from rankloom.operators.ranking import top_k
    from pyspark.sql import functions as F

    df = spark.range(1000).select((F.col("id") % 7).alias("qid"), F.col("id").alias("docid"))
    plan = top_k(df, 3, F.desc("docid"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_scans_read_the_columns_that_queries_need(spark):
    plan = catalog.QUERIES["mean_stderr"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string,l_linestatus:string>" in plan
