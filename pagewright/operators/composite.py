"""What stays visible of rectangles that are painted over each other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

def pixel_box(box: Column, union: Column, target: Column) -> Column:
    """[x0, y0, x1, y1] in pixels of a box on a canvas of ``target`` [w, h] pixels over the box ``union``: rounded outwards, on the canvas."""
    edge = lambda i, k, up: F.least(F.greatest((F.ceil if up else F.floor)((box[k] - union[i]) * (target[i] / (union[i + 2] - union[i]))), F.lit(0)), target[i]).cast("long")
    return F.array(edge(0, 0, False), edge(1, 1, False), edge(0, 2, True), edge(1, 3, True))


def _lengths(group: pa.Table) -> np.ndarray:
    """The visible length of each interval of one strip: from the top down, each takes what is free between its ends."""
    z, low, high = (group.column(c).to_numpy() for c in ("z", "y0", "y1"))
    ends = np.unique(np.concatenate([low, high]))
    sizes, first, last = np.diff(ends), np.searchsorted(ends, low), np.searchsorted(ends, high)
    free = list(range(len(ends)))  # the next free cell at or after a cell, followed and shortened
    lengths = np.zeros(len(z), np.int64)
    for k in np.argsort(-z, kind="stable").tolist():
        cell = int(first[k])
        while True:
            root = cell
            while free[root] != root:
                root = free[root]
            while free[cell] != root:
                free[cell], cell = root, free[cell]
            if root >= last[k]:
                break
            lengths[k] += sizes[root]
            free[root] = cell = root + 1
    return lengths


def visible_areas(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, z, and ``area`` that stays visible of each box (z, x0, y0, x1, y1, whole numbers) of a key; a larger z is painted later.

    Coordinates are compressed: the x edges of a key cut it into strips, and a box is an interval in each strip between its
    edges. A strip is swept from the top: an interval takes the cells between y edges that are still free. Pixels are never
    rows, boxes are never compared in pairs, and a key's strips are spread over tasks. Boxes without an area, or with a null,
    have 0; those with equal z are one box.
    """
    own = boxes.select(*keys, *(F.col(c).cast("long").alias(c) for c in ("z", "x0", "y0", "x1", "y1")))
    solid = own.filter((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")) & F.col("z").isNotNull())
    by_x = Window.partitionBy(*keys).orderBy("_x")  # a key's edges, as many as its canvas is wide at most
    edges = solid.select(*keys, F.explode(F.array("x0", "x1")).alias("_x")).distinct()
    edges = edges.withColumn("_k", F.row_number().over(by_x)).withColumn("width", F.lead("_x").over(by_x) - F.col("_x"))
    named = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    edges = written(edges.select(*named, "_x", "_k", "width"), "edges")

    def at(rows: DataFrame, column: str, on: str, more: str, name: str) -> DataFrame:
        same = F.col(column) == F.col(on)
        for i, k in enumerate(keys):
            same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
        return rows.join(edges, same).select(*rows.columns, F.col(more).alias(name))

    placed = at(at(solid, "x0", "_x", "_k", "_first"), "x1", "_x", "_k", "_last")
    cut = at(placed.withColumn("_strip", F.explode(F.sequence("_first", F.col("_last") - 1))), "_strip", "_k", "width", "width").select(*keys, "_strip", "z", "y0", "y1", "width")
    # of equal intervals of a strip only the topmost is seen, so a task has no more rows than a strip has pairs of edges
    cut = cut.groupBy(*keys, "_strip", "y0", "y1", "width").agg(F.max("z").alias("z"))

    def visible(table: pa.Table) -> pa.Table:
        return table.select(keys).append_column("z", table.column("z")).append_column("area", pa.array(_lengths(table) * table.column("width").to_numpy()))

    kinds = dict(own.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "z long, area long"])
    areas = cut.groupBy(*keys, "_strip").applyInArrow(visible, schema)
    return areas.unionByName(own.select(*keys, "z", F.lit(0).cast("long").alias("area"))).groupBy(*keys, "z").agg(F.sum("area").alias("area"))
