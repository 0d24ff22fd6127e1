"""Operators over ordered sequences: paint order, nesting, prefixes and the last writer.

A sequence is the rows of a key in an order. A key may hold a third of all rows: sums and products over a sequence run in two
levels, over ranges of it and then over the ranges' totals. ``scanned`` streams through a key with a small state where the state
is no sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import geometry as G
from ..tables import written

#: Content operators by role.
TEXT_SHOW = ["Tj", "TJ", "'", '"']
VECTOR_COUNTED = ["m", "l", "c", "v", "y", "re", "S", "s", "f", "F", "f*", "B", "B*"]
ARTWORK = ["S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "sh", "BI"]
MERGE_PAINT = [*TEXT_SHOW, "S", "s", "F", "f", "f*", "B", "B*", "b", "b*", "sh"]


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over each key's rows up to each row, in two levels.

    Rows are range-partitioned by key and order, so that a key with many rows is spread over several tasks; each part is
    summed alone, and what the parts before it hold is added. Rows of a key that are equal in ``order`` stay together.
    """
    parts = rows.withColumn("_value", value).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    parts = written(parts, "ordered")
    own = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*keys, "_part").agg(F.sum("_value").alias("_total")).withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    totals = totals.filter("_before <> 0").select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col("_part").alias("_of"), "_before")
    same = F.col("_part") == F.col("_of")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    summed = parts.withColumn("_own", F.sum("_value").over(own)).join(totals, same, "left")
    return summed.select(*rows.columns, (F.col("_own") + F.coalesce("_before", F.lit(0))).alias(name))


def last_before(rows: DataFrame, keys: list[str], at: str, values: dict[str, Column]) -> DataFrame:
    """``rows`` with the greatest value of each expression over the rows before in their key, null where there is none; in two levels."""
    parts = rows.withColumns({f"_v_{n}": v for n, v in values.items()}).repartitionByRange(*keys, at).withColumn("_part", F.spark_partition_id())
    parts = written(parts, "ordered")
    own = Window.partitionBy(*keys, "_part").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    lasts = parts.groupBy(*keys, "_part").agg(*(F.max(f"_v_{n}").alias(f"_l_{n}") for n in values))
    lasts = lasts.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col("_part").alias("_of"), *(F.max(f"_l_{n}").over(earlier).alias(f"_e_{n}") for n in values))
    both = parts.withColumns({n: F.max(f"_v_{n}").over(own) for n in values}).join(lasts, _same(keys) & (F.col("_part") == F.col("_of")))
    return both.select(*rows.columns, *(F.greatest(n, f"_e_{n}").alias(n) for n in values))


def depth(rows: DataFrame, keys: list[str], order: list[str], opens: Column, closes: Column) -> DataFrame:
    """``rows`` with ``depth`` after each row: opens so far less closes so far."""
    return running_sum(rows, keys, order, F.when(opens, 1).when(closes, -1).otherwise(0), "depth")


def unbalanced(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the least depth of ``depth``'s rows, and whether something was closed that wasn't open."""
    return rows.groupBy(*keys).agg(F.min("depth").alias("least_depth")).withColumn("underflow", F.col("least_depth") < 0)


def boundary(rows: DataFrame, keys: list[str], at: str, artwork: Column, free: Column) -> DataFrame:
    """Where a key's sequence may be cut: after the first free place at or past its last artwork row.

    ``last`` is null without artwork, ``boundary`` (the number of rows before the cut) without a free place.
    """
    last = rows.groupBy(*keys).agg(F.max(F.when(artwork, F.col(at))).alias("last"), F.count(F.lit(1)).alias("rows"))
    known = last.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), "last")
    places = rows.filter(free).join(known, _same(keys)).filter(F.col(at) >= F.col("last")).groupBy(*keys).agg((F.min(at) + 1).alias("boundary"))
    cut = places.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), "boundary")
    return last.join(cut, _same(keys), "left").select(*keys, "last", "boundary", "rows")


def _same(keys: list[str]) -> Column:
    """Keys that equal _key0, _key1 and so on, nulls too."""
    out = F.lit(True)
    for i, k in enumerate(keys):
        out &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return out


def split(rows: DataFrame, boundaries: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``rows`` with ``foreground``: whether they stand at or past their key's boundary; nothing does without one."""
    cut = boundaries.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col("boundary").alias("_cut"))
    return rows.join(cut, _same(keys), "left").select(*rows.columns, F.coalesce(F.col(at) >= F.col("_cut"), F.lit(False)).alias("foreground"))


def painted_before(rows: DataFrame, keys: list[str], order: list[str], paint: Column, image: Column) -> DataFrame:
    """The image rows before which something else was painted in their key: those after its first painted row."""
    first = rows.filter(paint).groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    first = first.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), "_first")
    return rows.filter(image).join(first, _same(keys)).filter(F.struct(*order) > F.col("_first")).select(*rows.columns)


def last_writer(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """For each key the values of its last row by ``order``, found by aggregation."""
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *(F.col(v).alias(f"_{v}") for v in values))).alias("_best"))
    return best.select(*keys, *(F.col(f"_best._{v}").alias(v) for v in values))


def composed(steps: Column) -> Column:
    """The affine matrix of an ordered array of matrices, each applied before those that came earlier."""
    return F.aggregate(steps, G.identity(), lambda total, step: G.compose(step, total))


def affine_totals(rows: DataFrame, keys: list[str], order: list[str], matrix: Column) -> DataFrame:
    """Each key's matrix of all its rows' matrices, in two levels, as composing is associative.

    Rows are range-partitioned by key and order; a part composes its own rows of a key, and the parts' matrices are
    composed in turn, so that no array holds more of a key than one part.
    """
    parts = rows.select(*keys, *order, matrix.alias("_m")).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    last = lambda steps: composed(F.transform(steps, lambda x: x["_m"]))
    each = parts.groupBy(*keys, "_part").agg(F.array_sort(F.collect_list(F.struct(*order, "_m"))).alias("_s")).select(*keys, "_part", last(F.col("_s")).alias("_m"))
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_part", "_m"))).alias("_s")).select(*keys, last(F.col("_s")).alias("matrix"))


def scanned(rows: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable[[], object], step: Callable[[object, dict], tuple[object, dict | None]]) -> DataFrame:
    """A stateful scan of each key's rows in order.

    ``step(state, row)`` gives the next state and an output row or none. Rows of a key are sorted in one partition and
    streamed in batches, so memory holds one batch and one state whatever a key's size.
    """

    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(lambda batches: _scan(keys, arrow, start, step, batches), schema)


def _scan(keys: list[str], arrow: pa.Schema, start: Callable, step: Callable, batches: Iterator[pa.RecordBatch], edges: bool = False) -> Iterator[pa.RecordBatch]:
    """What ``step`` makes of sorted rows; with ``edges`` also a row for the first and the last key, with the partition's number as _edge."""
    key, state, first = None, None, True
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            own = tuple(row[k] for k in keys)
            if first or own != key:
                key, state = own, start()
                if first and edges:
                    out.append(_edge(keys, key))
                first = False
            state, made = step(state, row)
            if made is not None:
                out.append(made)
        if out:
            yield from pa.Table.from_pylist(out, arrow).to_batches()
    if edges and not first:
        yield from pa.Table.from_pylist([_edge(keys, key)], arrow).to_batches()


def _edge(keys: list[str], key: tuple) -> dict:
    return {**dict(zip(keys, key, strict=True)), "_edge": TaskContext.get().partitionId()}


def of_keys(rows: DataFrame, known: DataFrame, keys: list[str], how: str) -> DataFrame:
    """The rows whose keys, nulls too, are among few ``known`` ones (left_semi) or aren't (left_anti)."""
    return rows.join(F.broadcast(known.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)))), _same(keys), how)


def scanned_ranges(rows: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable[[], object], step: Callable[[object, dict], tuple[object, dict | None]]) -> tuple[DataFrame, DataFrame]:
    """The scan of ``scanned`` over ranges of key and order, and the keys that it leaves out, as ranges cut them: fewer than there are ranges.

    ``schema`` has the keys. Rows are dealt and sorted once; a task has a range, whatever a key's size.
    """
    wide = f"{schema}, _edge int"
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], wide).schema)
    dealt_ = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    told = written(dealt_.mapInArrow(lambda batches: _scan(keys, arrow, start, step, batches, True), wide), "scanned-ranges")
    cut = told.filter("_edge is not null").groupBy(*keys).agg(F.countDistinct("_edge").alias("_n")).filter("_n > 1").select(*keys)
    cut = written(cut, "cut-keys")
    return of_keys(told.filter("_edge is null").drop("_edge"), cut, keys, "left_anti"), cut
