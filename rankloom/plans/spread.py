"""Work on inputs of fewer pieces than cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its scan has fewer tasks than there are cores, else unchanged.

    A table of one small file is read by one task, whatever is computed on it.  Large tables have more
    pieces than cores, and their rows are never moved by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    pieces = df.rdd.getNumPartitions()
    return df if pieces >= cores else df.repartition(cores)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores, whatever its files are: for work on a row that costs far more than moving it.

    Pieces of a file without a group of rows of their own are empty tasks, so their number does not tell how rows are spread.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
