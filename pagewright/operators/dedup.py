"""Exact duplicates: the first row by an order is the original of its key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written


def first_seen(rows: DataFrame, key: str, order: list[str], id: str) -> DataFrame:
    """``rows`` with ``duplicate_of``: the id of the key's first row by ``order``, null on that row itself.

    Rows are written once, so that what makes their key (a digest of long values) is computed once. The first row is found by
    aggregation, which reduces a key that many rows have before the shuffle, and only keys with several rows are joined
    back, from a written table, so that Spark can split a key that many rows have.
    """
    own = written(rows, "keyed")
    first = own.groupBy(key).agg(F.min(F.struct(*order, F.col(id).alias("_first_id"))).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    first = written(first.select(F.col(key).alias("_first_key"), F.col("_first._first_id").alias("_first_id")), "firsts")
    joined = own.join(first, own[key] == F.col("_first_key"), "left")
    return joined.withColumn("duplicate_of", F.when(F.col("_first_id") != F.col(id), F.col("_first_id"))).drop("_first_key", "_first_id")


def saved_by_duplicates(rows: DataFrame, size: str) -> DataFrame:
    """How many rows of ``first_seen`` are duplicates and the bytes that they hold."""
    again = F.col("duplicate_of").isNotNull()
    return rows.agg(F.count_if(again).alias("duplicates"), F.coalesce(F.sum(F.when(again, F.col(size))), F.lit(0)).alias("duplicate_bytes"))
