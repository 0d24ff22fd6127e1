"""Page geometry as Spark columns. Lengths are points, 72 an inch; null means "could not be measured"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS_PER_INCH, MM_PER_INCH = 72.0, 25.4
#: A matrix with a smaller determinant has no inverse.
SINGULAR = 1e-12


def is_finite(x: Column) -> Column:
    """True for numbers that are neither NaN nor infinite; false for null."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def measurable(points: Column) -> Column:
    """True for a finite length over 0."""
    return is_finite(points) & (points > 0)


def points_to_mm(points: Column) -> Column:
    return points * MM_PER_INCH / POINTS_PER_INCH


def effective_dpi(pixels: Column, points: Column) -> Column:
    """Pixels for each inch, null where the length can't be measured."""
    return F.when(measurable(points), pixels * POINTS_PER_INCH / points)


def target_pixels(points: Column, dpi: Column) -> Column:
    """Pixels that a length needs at a resolution: rounded half away from zero, 1 at least."""
    return F.when(measurable(points), F.greatest(F.round(points / POINTS_PER_INCH * dpi), F.lit(1.0)).cast("long"))


def axis_lengths(m: Column) -> tuple[Column, Column]:
    """Displayed width and height of the unit square under an affine matrix (struct a, b, c, d, e, f)."""
    return F.hypot(m["a"], m["b"]), F.hypot(m["c"], m["d"])


def _matrix(*terms: Column) -> Column:
    return F.struct(*(t.alias(name) for t, name in zip(terms, "abcdef", strict=True)))


def compose(m: Column, n: Column) -> Column:
    """The matrix that applies m first and n afterwards."""
    return _matrix(
        m["a"] * n["a"] + m["b"] * n["c"],
        m["a"] * n["b"] + m["b"] * n["d"],
        m["c"] * n["a"] + m["d"] * n["c"],
        m["c"] * n["b"] + m["d"] * n["d"],
        m["e"] * n["a"] + m["f"] * n["c"] + n["e"],
        m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    )


def identity() -> Column:
    return _matrix(*(F.lit(x) for x in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)))


def transform_point(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m["a"] * x + m["c"] * y + m["e"], m["b"] * x + m["d"] * y + m["f"]


def invert(m: Column) -> Column:
    """The inverse matrix; null where there is none."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    safe = F.when(F.abs(det) >= SINGULAR, det)
    return F.when(
        safe.isNotNull(),
        _matrix(m["d"] / safe, -m["b"] / safe, -m["c"] / safe, m["a"] / safe, (m["c"] * m["f"] - m["d"] * m["e"]) / safe, (m["b"] * m["e"] - m["a"] * m["f"]) / safe),
    )


def unit_square_box(m: Column) -> Column:
    """[x0, y0, x1, y1] around the unit square under a matrix."""
    xs, ys = zip(*(transform_point(m, F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0))), strict=True)
    return F.array(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def intersect_boxes(p: Column, q: Column) -> Column:
    """The common part of two boxes; null where it is empty."""
    both = F.array(F.greatest(p[0], q[0]), F.greatest(p[1], q[1]), F.least(p[2], q[2]), F.least(p[3], q[3]))
    return F.when((both[2] > both[0]) & (both[3] > both[1]), both)


def quarter_turned(rotation: Column) -> Column:
    """True for rotations by an odd number of quarter turns, negative ones too."""
    return F.pmod(rotation, F.lit(180)) == 90


def swap_if(condition: Column, dims: Column) -> Column:
    """[h, w] of [w, h] where ``condition`` holds."""
    return F.when(condition, F.array(dims[1], dims[0])).otherwise(dims)


def fit_long_side(w: Column, h: Column, long_px: Column) -> Column:
    """[w, h] in pixels of a page whose longer side gets ``long_px``; the width on a tie."""
    other = lambda short, long: F.greatest(F.round(short / long * long_px), F.lit(1.0)).cast("long")
    fit = F.when(w >= h, F.array(long_px.cast("long"), other(h, w))).otherwise(F.array(other(w, h), long_px.cast("long")))
    return F.when(measurable(w) & measurable(h), fit)


def scaled_image(w: Column, h: Column, scale: Column) -> Column:
    """[w, h] of an image at a scale: the longer side rounded up, the other by the source's ratio, 1 at least."""
    long = lambda side: F.ceil(side * scale).cast("long")
    other = lambda short, side: F.greatest(F.round(long(side) * short / side), F.lit(1.0)).cast("long")
    made = F.when(w >= h, F.array(F.greatest(long(w), F.lit(1)), other(h, w))).otherwise(F.array(other(w, h), F.greatest(long(h), F.lit(1))))
    return F.when(measurable(scale) & (w > 0) & (h > 0), made)
