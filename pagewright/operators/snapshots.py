"""Comparing two snapshots of a collection: what was added, removed or changed, and whether that is allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from .ordered import running_sum


def diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys and ``change`` (added, removed, changed or same) of every row of either snapshot; nulls equal nulls.

    Rows that repeat a key within a snapshot must be equal.
    """
    side = lambda df, name: df.select(*keys, *(F.struct(*values).alias(n) if n == name else F.lit(None).alias(n) for n in ("_b", "_a")))
    both = side(before, "_b").unionByName(side(after, "_a")).groupBy(*keys).agg(F.max("_b").alias("_b"), F.max("_a").alias("_a"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_b").eqNullSafe(F.col("_a")), "same").otherwise("changed")
    return both.select(*keys, change.alias("change"))


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``left`` whose key ``right`` doesn't have."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def by_position(rows: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """``rows`` numbered from 1 within each key; a key's rows are numbered in ranges, side by side."""
    return running_sum(rows, keys, order, F.lit(1), name)


def positional(before: DataFrame, after: DataFrame, keys: list[str], order: list[str], checks: dict[str, Column]) -> DataFrame:
    """Rows at the same place of both snapshots compared: failed counts of each check, and whether all pass by key.

    ``checks`` are expressions over b.* and a.*; a place that only one snapshot has fails all of them.
    """
    pair = by_position(before, keys, order).alias("b").join(by_position(after, keys, order).alias("a"), [*keys, "position"], "full_outer")
    bad = {name: F.count_if(~F.coalesce(ok, F.lit(False))) for name, ok in checks.items()}
    out = pair.groupBy(*keys).agg(F.count(F.lit(1)).alias("places"), *(c.alias(name) for name, c in bad.items()))
    return out.withColumn("passed", sum((F.col(name) for name in checks), F.lit(0)) == 0)


def violations(b: Column, a: Column, may_change: tuple[str, ...] = ()) -> Column:
    """Which invariants a changed raster (struct a) breaks against the one before (b).

    Both have w, h, matrix, box, format, colour and bits. Sides must not grow or vanish; their ratio must hold up to the
    rounding of a side; matrix and box must agree up to 1e-7; format, colour and bits only change where allowed.
    """
    off = F.abs(b["w"] * a["h"] - b["h"] * a["w"])
    same = lambda x, y: F.forall(F.zip_with(x, y, lambda p, q: N.close_relative(p, q)), lambda ok: F.coalesce(ok, F.lit(False)))
    matrix = lambda r: F.array(*(r["matrix"][t] for t in "abcdef"))
    broken = [
        (a["w"] > b["w"]) | (a["h"] > b["h"]) | (a["w"] < 1) | (a["h"] < 1),
        off > F.greatest(b["w"], b["h"]),
        ~same(matrix(b), matrix(a)),
        ~same(b["box"], a["box"]),
        *(F.lit(name not in may_change) & ~b[name].eqNullSafe(a[name]) for name in ("format", "colour", "bits")),
    ]
    names = ["dimensions", "aspect_ratio", "matrix", "bounding_box", "format", "colour", "bits"]
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for c, n in zip(broken, names, strict=True))))


def verdict(checks: DataFrame, keys: list[str], ok: str) -> DataFrame:
    """Whether all rows of a key pass, and how many don't."""
    return checks.groupBy(*keys).agg(F.bool_and(ok).alias("passed"), F.count_if(~F.col(ok)).alias("failed"))
