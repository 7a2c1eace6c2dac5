"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import held_out

#: Rows whose crc32 of the id as text leaves this remainder are never learned from.
MOD, REST = 4, 2


def labelled_ids(labels: DataFrame, label: str, key: str, max_rows: int, mod: int = MOD, rest: int = REST) -> DataFrame:
    """(key, y): at most ``max_rows`` labelled rows of each class outside the held-out fold, those of the smallest hashes.

    The bound is on what is fitted, never on what is scored.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key), mod, rest))
    rows = rows.groupBy(key).agg(F.max(label).cast("int").alias("y"))
    classes = [rows.where(F.col("y") == y).orderBy(F.xxhash64(F.col(key)), key).limit(max_rows) for y in (0, 1)]
    return classes[0].unionByName(classes[1])


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, max_rows: int, mod: int = MOD, rest: int = REST) -> DataFrame:
    """(key, text, y) of the sample, one row for an id: of rows that repeat an id the text of the smallest hash.

    The ids are broadcast, being at most 2 * ``max_rows`` short rows.
    """
    ids = labelled_ids(labels, label, key, max_rows, mod, rest)
    rows = docs.select(key, text).where(~held_out(F.col(key), mod, rest)).join(F.broadcast(ids), key)
    one = rows.groupBy(key, "y").agg(F.min(F.struct(F.xxhash64(text).alias("h"), F.col(text).alias("t"))).alias("one"))
    return one.select(key, F.col("one.t").alias(text), "y")
