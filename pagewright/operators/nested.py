"""What is in force along ordered operations with brackets that save and restore it, whatever a key's length: matrices and clips.

A state machine over a key's rows would be one task a key. Here each row finds its frame, the innermost bracket that is open
there: depths are running sums, and the frame is the last bracket that opened at the row's depth. Within a frame values (a
``Monoid``: matrices multiply, clips intersect) only compose, so those up to each row are a prefix scan over ranges of rows, summed
up over the ranges. A frame's own value is that of its parent at its bracket, composed with the parent's, which pointer doubling
resolves in as many rounds as the logarithm of the depth. All of that is dealt by ranges of key, frame and place, so that one long sequence is many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..tables import written

#: Frames up to this number are broadcast to their rows, 10 MB at most.
BROADCAST_FRAMES = 100_000



@dataclass(frozen=True)
class Monoid:
    """Values of some terms (doubles) that compose associatively: ``product`` of rows of two arrays, ``compose`` of two structs, the later one first."""

    terms: tuple[str, ...]
    none: tuple[float, ...]
    product: Callable[[np.ndarray, np.ndarray], np.ndarray]
    compose: Callable[[Column, Column], Column]

    def identity(self) -> Column:
        return F.struct(*(F.lit(x).alias(t) for t, x in zip(self.terms, self.none, strict=True)))

    def given(self) -> list[str]:
        return [f"_s{t}" for t in self.terms]


def _matrices(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows of affine matrices that apply m first and n afterwards."""
    a, b, c, d, e, f = m.T
    p, q, r, s, t, u = n.T
    return np.stack([a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u], 1)


def _clips(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.hstack([np.maximum(m[:, :2], n[:, :2]), np.minimum(m[:, 2:4], n[:, 2:4]), m[:, 4:] + n[:, 4:]])


def _common(m: Column, n: Column) -> Column:
    return F.struct(*(F.greatest(m[t], n[t]).alias(t) for t in ("x0", "y0")), *(F.least(m[t], n[t]).alias(t) for t in ("x1", "y1")), (m["n"] + n["n"]).alias("n"))


#: Affine matrices a to f; and boxes that intersect, with the number of them.
MATRIX = Monoid(tuple("abcdef"), (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), _matrices, G.compose)
CLIP = Monoid(("x0", "y0", "x1", "y1", "n"), (-np.inf, -np.inf, np.inf, np.inf, 0.0), _clips, _common)


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for i, k in enumerate(keys):
        out &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return out


def _named(keys: list[str]) -> list[Column]:
    return [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]


def depths(rows: DataFrame, keys: list[str], at: str, opens: Column, closes: Column) -> DataFrame:
    """``rows`` with _depth after each row; a close without its open changes nothing.

    That is the running sum of opens less closes, less its lowest value under 0 so far, in two levels.
    """
    parts = rows.withColumn("_delta", F.when(opens, 1).when(closes, -1).otherwise(0)).repartitionByRange(*keys, at).withColumn("_part", F.spark_partition_id())
    parts = written(parts, "nested-parts")
    own = Window.partitionBy(*keys, "_part").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = parts.withColumn("_sum", F.sum("_delta").over(own))
    totals = summed.groupBy(*keys, "_part").agg(F.sum("_delta").alias("_total"), F.min("_sum").alias("_low"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    totals = totals.withColumn("_lowest", F.coalesce(F.min(F.col("_before") + F.col("_low")).over(earlier), F.lit(0)))
    known = totals.select(*_named(keys), F.col("_part").alias("_of"), "_before", "_lowest")
    both = summed.join(known, _same(keys) & (F.col("_part") == F.col("_of")))
    low = F.least(F.lit(0), "_lowest", F.col("_before") + F.min("_sum").over(own))
    return both.withColumn("_depth", (F.col("_before") + F.col("_sum") - low).cast("int")).select(*rows.columns, "_depth")


def _frames(rows: DataFrame, keys: list[str], at: str, opens: Column) -> DataFrame:
    """``rows`` (with _depth) with _frame: the place of the innermost bracket around each row, -1 for none; a bracket stands in its parent."""
    held = [c for c in rows.columns if c not in (*keys, at, "_depth")]
    payload = F.struct(*held)
    member = rows.select(*keys, at, (F.col("_depth") - F.when(opens, 1).otherwise(0)).alias("_depth"), F.lit(None).cast("long").alias("_mark"), payload.alias("_row"))
    marks = rows.filter(opens).select(*keys, at, "_depth", F.col(at).cast("long").alias("_mark"), F.lit(None).cast(dict(member.dtypes)["_row"]).alias("_row"))
    parts = member.unionByName(marks).repartitionByRange(*keys, "_depth", at).withColumn("_part", F.spark_partition_id())
    parts = written(parts, "nested-frames")
    own = Window.partitionBy(*keys, "_depth", "_part").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys, "_depth").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    last = parts.groupBy(*keys, "_depth", "_part").agg(F.max("_mark").alias("_last")).withColumn("_earlier", F.max("_last").over(earlier)).filter("_earlier is not null")
    last = last.select(*_named(keys), F.col("_depth").alias("_level"), F.col("_part").alias("_of"), "_earlier")
    found = parts.withColumn("_mark", F.max("_mark").over(own)).filter("_row is not null")
    found = found.join(last, _same(keys) & (F.col("_depth") == F.col("_level")) & (F.col("_part") == F.col("_of")), "left")
    frame = F.when(F.col("_depth") <= 0, F.lit(-1)).otherwise(F.coalesce("_mark", "_earlier", F.lit(-1)))
    return found.select(*keys, at, frame.cast("long").alias("_frame"), *(F.col("_row")[c].alias(c) for c in held))


def prefixes(steps: np.ndarray, starts: np.ndarray, product: Callable[[np.ndarray, np.ndarray], np.ndarray] = _matrices) -> np.ndarray:
    """The product of each row's value with those before it since the last row that starts a segment: doubling strides over whole arrays."""
    out, begin = steps.copy(), np.maximum.accumulate(np.where(starts, np.arange(len(steps)), 0))
    stride = 1
    place = np.arange(len(steps))
    longest = int((place - begin).max(initial=0))
    while stride <= longest:
        reach = place[place - stride >= begin]
        out[reach] = product(out[reach], out[reach - stride])
        stride *= 2
    return out


def _scanned(names: list[str], kind: Monoid, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows in order of key, frame and place, with the product of the frame's values so far in this part as columns."""
    last, carried = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))
        starts = np.array([True, *(x != y for x, y in zip(ids[1:], ids, strict=False))])
        steps = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in kind.given()], 1)
        done = prefixes(steps, starts, kind.product)
        if ids[0] == last:  # goes on from the batch before
            upto = int(np.flatnonzero(starts)[1]) if starts.sum() > 1 else len(ids)
            done[:upto] = kind.product(done[:upto], np.broadcast_to(carried, (upto, len(kind.terms))))
        last, carried = ids[-1], done[-1].copy()
        keep = [i for i, n in enumerate(batch.schema.names) if n not in kind.given()]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *(pa.array(done[:, i]) for i in range(len(kind.terms)))], [*(batch.schema.names[i] for i in keep), *(f"_{t}" for t in kind.terms)])


def _within(rows: DataFrame, keys: list[str], at: str, step: Column, kind: Monoid) -> DataFrame:
    """``rows`` (with _frame) with _own: the product of their frame's values up to each row."""
    terms = F.coalesce(step, kind.identity())
    parts = rows.repartitionByRange(*keys, "_frame", at).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*keys, "_frame", at)
    given = parts.select("*", *(terms[t].cast("double").alias(c) for t, c in zip(kind.terms, kind.given(), strict=True)))
    kept = [c for c in given.columns if c not in kind.given()]
    schema = given.select(*kept, *(F.lit(0.0).alias(f"_{t}") for t in kind.terms)).schema
    names = [*keys, "_frame"]
    done = written(given.mapInArrow(lambda batches: _scanned(names, kind, batches), schema), "nested-products")
    own = F.struct(*(F.col(f"_{t}").alias(t) for t in kind.terms))
    lasts = done.groupBy(*names, "_part").agg(F.max_by(own, at).alias("_m"))
    # a row for each frame and part; the list of a frame's parts is as long as the parts it is spread over
    lists = lasts.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("_part", "_m"))).alias("_l")).filter(F.size("_l") > 1)
    each = lists.select(*names, "_l", F.posexplode(F.transform("_l", lambda x: x["_part"])).alias("_i", "_of")).filter("_i > 0")
    before = F.aggregate(F.slice("_l", F.lit(1), F.col("_i")), kind.identity(), lambda total, x: kind.compose(x["_m"], total))
    carried = each.select(*_named(keys), F.col("_frame").alias("_in"), "_of", before.alias("_carried"))
    both = done.join(carried, _same(keys) & (F.col("_frame") == F.col("_in")) & (F.col("_part") == F.col("_of")), "left")
    return both.select(*(c for c in rows.columns), F.when(F.col("_carried").isNull(), own).otherwise(kind.compose(own, F.col("_carried"))).alias("_own"))


def _openings(found: DataFrame, keys: list[str], at: str, opens: Column, kind: Monoid) -> DataFrame:
    """keys, _bracket and _start: what is in force where each bracket opens."""
    frames = written(found.filter(opens).select(*keys, F.col(at).cast("long").alias("_bracket"), F.col("_frame").alias("_up"), F.col("_own").alias("_start")), "nested-brackets")
    while not frames.filter("_up >= 0").isEmpty():
        above = frames.select(*_named(keys), F.col("_bracket").alias("_of"), F.col("_up").alias("_next"), F.col("_start").alias("_more"))
        both = frames.join(above, _same(keys) & (F.col("_up") == F.col("_of")), "left")
        more = F.col("_more").isNotNull()
        frames = written(both.select(*keys, "_bracket", F.when(more, F.col("_next")).otherwise(-1).alias("_up"), F.when(more, kind.compose(F.col("_start"), F.col("_more"))).otherwise(F.col("_start")).alias("_start")), "nested-brackets")
    return frames.select(*keys, "_bracket", "_start")


def in_force(rows: DataFrame, keys: list[str], at: str, opens: Column, closes: Column, step: Column, kind: Monoid = MATRIX, name: str = "matrix") -> DataFrame:
    """``rows`` with ``name`` (a struct of the kind's terms) in force after each row: that of its brackets and all ``step``s (or null) before it in them.

    ``at`` is a row's place, a whole number that is unique in its key. A row that opens a bracket has what is saved there; a
    close without its open changes nothing. Columns that begin with an underscore are the function's own.
    """
    marked = rows.withColumns({"_opens": F.coalesce(opens, F.lit(False)), "_closes": F.coalesce(closes, F.lit(False)), "_step": step})
    deep = depths(marked, keys, at, F.col("_opens"), F.col("_closes"))
    found = written(_within(_frames(deep, keys, at, F.col("_opens")), keys, at, F.col("_step"), kind), "nested-rows")
    frames = _openings(found, keys, at, F.col("_opens"), kind)
    frames = F.broadcast(frames) if frames.count() <= BROADCAST_FRAMES else frames
    frames = frames.select(*_named(keys), "_bracket", "_start")
    inside = found.filter("_frame >= 0").join(frames, _same(keys) & (F.col("_frame") == F.col("_bracket")), "left")
    value = F.when(F.col("_start").isNull(), F.col("_own")).otherwise(kind.compose(F.col("_own"), F.col("_start")))
    outside = found.filter("_frame < 0").select(*rows.columns, F.col("_own").alias(name))
    return inside.select(*rows.columns, value.alias(name)).unionByName(outside)
