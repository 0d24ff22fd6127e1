"""Aggregations whose nulls mean "unknown" and must not be skipped, and other grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

#: Weighted median: a sample needs this coverage, weighs this at most, and the result is at most CAP.
LEAST_COVERAGE, MOST_WEIGHT, CAP = 0.15, 0.5, 300.0
#: Evidence is corroborated by two samples that cover this together.
CORROBORATED = 0.25


def strict_min(x: Column) -> Column:
    """The least value of a group; null if any is null."""
    return F.when(F.count(F.lit(1)) == F.count(x), F.min(x))


def strict_max(x: Column) -> Column:
    """The greatest value of a group; null if any is null."""
    return F.when(F.count(F.lit(1)) == F.count(x), F.max(x))


def kind_bytes(kind: str, size: str, kinds: list[str]) -> list[Column]:
    """Bytes of each kind in a group."""
    return [F.coalesce(F.sum(F.when(F.col(kind) == k, F.col(size))), F.lit(0)).alias(f"{k}_bytes") for k in kinds]


def unknown_bytes(kinds: list[str], total: str) -> Column:
    """What ``total`` has beyond the bytes of ``kinds``, 0 at least."""
    return F.greatest(F.col(total) - sum((F.col(f"{k}_bytes") for k in kinds), F.lit(0)), F.lit(0))


def attribution(objects: DataFrame, keys: list[str], kind: str, size: str, kinds: list[str], total: str) -> DataFrame:
    """Bytes of each kind for each key, and ``unknown_bytes``: what ``total`` has beyond them, 0 at least."""
    own = objects.groupBy(*keys).agg(*kind_bytes(kind, size, kinds), F.max(total).alias("_total"))
    return own.withColumn("unknown_bytes", unknown_bytes(kinds, "_total")).drop("_total")


def weighted_lower_median(samples: DataFrame, keys: list[str], value: str, weight: str, cap: float | None = None) -> DataFrame:
    """``median`` by key: the first value, in order, at which the running weight reaches half of the total.

    Weights that are integers or decimals make the comparison exact. Equal (key, value) rows are summed first. The rest is a
    selection by refinement: values are dealt by ranges of key and value, the ranges' weights tell which one of each key holds the
    half, and only its values are ordered and summed up. So no task holds a whole key, however many values it has.
    """
    own = samples.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    parts = written(own.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "weights")
    upto = Window.partitionBy(*keys).orderBy("_part")
    sums = parts.groupBy(*keys, "_part").agg(F.sum("_w").alias("_s"))  # a row for each key and range
    sums = sums.select(*keys, "_part", "_s", F.sum("_s").over(upto).alias("_c"), F.sum("_s").over(Window.partitionBy(*keys)).alias("_t"))
    half = sums.filter((2 * F.col("_c") >= F.col("_t")) & ((2 * (F.col("_c") - F.col("_s")) < F.col("_t")) | (F.col("_c") == F.col("_s"))))
    half = half.groupBy(*keys).agg(F.min(F.struct("_part", (F.col("_c") - F.col("_s")).alias("_before"), "_t")).alias("_x"))  # the first, where weights are 0
    named = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    same = F.col("_part") == F.col("_of")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    kept = parts.join(half.select(*named, F.col("_x._part").alias("_of"), "_x._before", "_x._t"), same)
    running = kept.withColumn("_c", F.col("_before") + F.sum("_w").over(Window.partitionBy(*keys).orderBy(value)))
    median = F.min(F.when(2 * F.col("_c") >= F.col("_t"), F.col(value)))
    return running.groupBy(*keys).agg((F.least(median, F.lit(cap)) if cap is not None else median).alias("median"))


def representative(rows: DataFrame, keys: list[str], size: Column, order: str, carried: list[str]) -> DataFrame:
    """For each key the row of greatest ``size``, the last by ``order`` on ties, as columns ``carried``."""
    best = rows.groupBy(*keys).agg(F.max(F.struct(size.alias("_s"), F.col(order), *(F.col(c).alias(f"_{c}") for c in carried))).alias("_best"))
    return best.select(*keys, F.col(f"_best.{order}").alias(order), *(F.col(f"_best._{c}").alias(c) for c in carried))


def references(objects: DataFrame, uses: DataFrame, on: str, place: str) -> DataFrame:
    """Each object with its reference_count, whether it is reused, and its places, distinct and sorted.

    Objects that are never used stay, with 0 and an empty list.
    """
    each = uses.groupBy(on, place).agg(F.count(F.lit(1)).alias("_n"))  # an object that is used everywhere is spread by place
    counted = each.groupBy(on).agg(F.sum("_n").alias("reference_count"), F.array_sort(F.collect_list(place)).alias("places"))
    joined = objects.join(counted, on, "left")
    count = F.coalesce("reference_count", F.lit(0))
    return joined.select(*objects.columns, count.alias("reference_count"), (count > 1).alias("reused"), F.coalesce("places", F.array().cast(joined.schema["places"].dataType)).alias("places"))


def union_box(rows: DataFrame, keys: list[str], box: str, order: str) -> DataFrame:
    """x0, y0, x1, y1 around all boxes of a key, and whether the first box by ``order`` covers it all."""
    edges = [F.min(F.col(box)[0]).alias("x0"), F.min(F.col(box)[1]).alias("y0"), F.max(F.col(box)[2]).alias("x1"), F.max(F.col(box)[3]).alias("y1")]
    out = rows.groupBy(*keys).agg(*edges, F.min_by(box, order).alias("_base"))
    return out.select(*keys, "x0", "y0", "x1", "y1", (F.col("_base") == F.array("x0", "y0", "x1", "y1")).alias("base_covers"))


def mean_absolute_error(left: Column, right: Column) -> Column:
    """The mean of |x - y| over two arrays of one length; null where lengths differ or are 0."""
    total = F.aggregate(F.zip_with(left, right, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(left) == F.size(right)) & (F.size(left) > 0), total / F.size(left))
