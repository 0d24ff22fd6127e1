"""Which pages' images can be merged into one: a scan in paint order, then an aggregation over its events.

The scan emits an event for each drawn image (its visible box) and one for the first operation that forbids merging
(its reason). The page's verdict is an aggregation over events.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import numeric as N
from ..tables import written
from . import nested
from .aggregates import union_box
from .ordered import MERGE_PAINT, last_before, of_keys, running_sum, scanned, scanned_ranges

Box = tuple[float, float, float, float]
#: The merged page's long side in pixels, and when a matrix counts as turned.
LONG_SIDE, TURNED = 1920, 1e-8


class State(NamedTuple):
    """The graphics state of a scan: matrix, clip, those saved by q (the last with those before it), and the path and marks so far."""

    matrix: tuple = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    clip: Box | None = None
    saved: tuple | None = None
    path: Box | None = None
    clipping: bool = False
    painted: bool = False
    stopped: bool = False


def _numbers(operands: list[str], n: int) -> tuple[float, ...] | None:
    try:
        return tuple(map(float, operands)) if len(operands) == n else None
    except ValueError:
        return None


def _around(m: tuple, x: float, y: float, w: float, h: float) -> Box:
    """The box around a rectangle under a matrix."""
    xs, ys = zip(*((m[0] * p + m[2] * q + m[4], m[1] * p + m[3] * q + m[5]) for p in (x, x + w) for q in (y, y + h)), strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def _common(p: Box, q: Box) -> Box | None:
    out = max(p[0], q[0]), max(p[1], q[1]), min(p[2], q[2]), min(p[3], q[3])
    return out if out[2] > out[0] and out[3] > out[1] else None


def _same(p: Box, q: Box) -> bool:
    return all(abs(a - b) <= 1e-6 for a, b in zip(p, q, strict=True))


def _step(s: State, row: dict) -> tuple[State, str | None, Box | None]:
    """The state after an operation, and the reason to stop or the box of an image."""
    op, operands = row["operator"], row["operands"] or []
    if op == "q":
        return s._replace(saved=(s.matrix, s.clip, s.saved)), None, None
    if op == "Q":
        if not s.saved:
            return s, "unbalanced_graphics_state", None
        return s._replace(matrix=s.saved[0], clip=s.saved[1], saved=s.saved[2]), None, None
    if op == "cm":
        m, n = _numbers(operands, 6), s.matrix
        if m is None:
            return s, "invalid_matrix", None
        rows = [(m[i] * n[0] + m[i + 1] * n[2], m[i] * n[1] + m[i + 1] * n[3]) for i in (0, 2, 4)]
        return s._replace(matrix=(*rows[0], *rows[1], rows[2][0] + n[4], rows[2][1] + n[5])), None, None
    if op == "re":
        r = _numbers(operands, 4)
        if r is None:
            return s, "invalid_rectangle" if len(operands) == 4 else "complex_clipping_not_supported", None
        return s._replace(path=_around(s.matrix, *r)), None, None
    if op == "W*" or (op == "W" and s.path is None):
        return s, "complex_clipping_not_supported", None
    if op == "W":
        return s._replace(clipping=True), None, None
    if op == "n" and s.clipping:
        clip = s.path if s.clip is None or s.path is None else _common(s.clip, s.path)
        return s._replace(clip=clip, path=None, clipping=False), None if clip else "empty_clip", None
    if op == "gs" and not row["opaque"]:
        return s, "transparency_or_extgstate_not_supported" if _named(operands) else "invalid_extgstate", None
    if op == "Do":
        return s, *_image(s, row)
    return (s._replace(painted=True) if op in MERGE_PAINT else s), None, None


def _named(operands: list[str]) -> bool:
    return bool(operands) and operands[0].startswith("/")


#: Why what a Do draws can't be merged, by its kind.
KINDS = {None: "missing_xobject", "direct": "direct_xobject_unsupported", "invalid": "invalid_xobject", "other": "form_xobject_not_supported"}


def _image(s: State, row: dict) -> tuple[str | None, Box | None]:
    if not _named(row["operands"]):
        return "invalid_xobject_invocation", None
    if row["kind"] != "image":
        return KINDS[row["kind"]], None
    if s.painted:
        return "unsafe_content_order", None
    if row.get("undecoded"):
        return row["undecoded"], None
    box = _around(s.matrix, 0, 0, 1, 1)
    if s.clip is not None:
        if max(abs(s.matrix[1]), abs(s.matrix[2])) > TURNED and not _same(s.clip, box):
            return "rotated_clipping_not_supported", None
        box = _common(box, s.clip)
    return None if box else "image_fully_clipped", box


_EVENTS = "file string, scope string, idx long, reason string, box array<double>"


def _event(s: State, row: dict) -> tuple[State, dict | None]:
    if s.stopped:
        return s, None
    after, reason, box = _step(s, row)
    if reason is None and box is None:
        return after, None
    return after._replace(stopped=reason is not None), {"file": row["file"], "scope": row["scope"], "idx": row["idx"], "reason": reason, "box": box and list(box)}


def merge_events(ops: DataFrame) -> DataFrame:
    """file, scope, idx, reason and box of each image and of the first operation that forbids merging.

    ``ops`` has file, scope, idx, operator, operands, kind (of the XObject of a Do: image, other, direct or invalid; null if
    there is none) and opaque (of the state of a gs); and, where it has that column, undecoded: why an image's pixels can't be had.
    """
    return scanned(ops, ["file", "scope"], ["idx"], _EVENTS, State, _event)


def ranged_events(ops: DataFrame) -> DataFrame:
    """The events of ``merge_events``, by ranges of page and place: no task has more than a range, however long a page is.

    A page that lies in one range is scanned there. Those that ranges cut, fewer than there are ranges, go to ``spread_events``.
    """
    keys = ["file", "scope"]
    whole, cut = scanned_ranges(ops, keys, ["idx"], _EVENTS, State, _event)
    return whole if cut.isEmpty() else whole.unionByName(spread_events(of_keys(ops, cut, keys, "left_semi")))


def _doubles(n: int) -> tuple[Column, list[Column]]:
    """Whether the operands are n numbers, and those numbers."""
    each = [F.get("operands", F.lit(i)).try_cast("double") for i in range(n)]
    fine = F.size("operands") == n
    for x in each:
        fine &= x.isNotNull()
    return F.coalesce(fine, F.lit(False)), each


def _boxed(m: Column, x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    xs, ys = zip(*(G.transform_point(m, p, q) for p in (x, x + w) for q in (y, y + h)), strict=True)
    return [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)]


def spread_events(ops: DataFrame) -> DataFrame:
    """The events of ``merge_events`` without a scan of a page in one task: for pages of many millions of operations.

    Matrices and clips in force are prefix scans over ranges (``nested``); the last rectangle, clip mark and paint before an
    operation are running maxima in two levels. Each operation's reason follows from those alone, and what stands after a
    page's first reason doesn't count.
    """
    keys, at, op = ["file", "scope"], "idx", F.col("operator")
    own = ops if "undecoded" in ops.columns else ops.withColumn("undecoded", F.lit(None).cast("string"))
    six, (a, b, c, d, e, f) = _doubles(6)
    four, (x, y, w, h) = _doubles(4)
    step = F.when((op == "cm") & six, F.struct(*(v.alias(t) for v, t in zip((a, b, c, d, e, f), "abcdef", strict=True))))
    own = nested.in_force(own, keys, at, op == "q", op == "Q", step)
    mark = lambda *names: F.when(op.isin(*names), F.col(at))
    own = last_before(own, keys, at, {"last_w": mark("W"), "last_re": F.when((op == "re") & four, F.col(at)), "last_n": mark("n"), "last_paint": mark(*MERGE_PAINT)})
    clips = (op == "n") & F.col("last_w").isNotNull() & (F.col("last_w") > F.coalesce("last_n", F.lit(-1)))
    own = last_before(own.withColumn("clips", F.coalesce(clips, F.lit(False))), keys, at, {"last_clip": F.when(F.col("clips"), F.col(at))})
    path = own.filter((op == "re") & four).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(at).alias("_re"), F.struct(*(v.alias(t) for v, t in zip(_boxed(F.col("matrix"), x, y, w, h), ("x0", "y0", "x1", "y1"), strict=True)), F.lit(1.0).alias("n")).alias("path"))
    same = (F.col("last_re") == F.col("_re")) & F.col("clips")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    own = own.join(path, same, "left").drop("_re", *(f"_k{i}" for i in range(len(keys))))
    own = nested.in_force(own, keys, at, op == "q", op == "Q", F.col("path"), nested.CLIP, "clip")
    own = running_sum(own, keys, [at], F.when(op == "q", 1).when(op == "Q", -1).otherwise(0), "open")
    clip, m = F.col("clip"), F.col("matrix")
    empty = (clip["x1"] <= clip["x0"]) | (clip["y1"] <= clip["y0"])
    named = F.coalesce(F.get("operands", F.lit(0)).startswith("/"), F.lit(False))
    box = _boxed(m, *map(F.lit, (0.0, 0.0, 1.0, 1.0)))
    edges = [clip[t] for t in ("x0", "y0", "x1", "y1")]
    equal = F.lit(True)
    for p, q in zip(box, edges, strict=True):
        equal &= F.abs(p - q) <= 1e-6
    clipped = clip["n"] > 0
    left = [F.greatest(box[0], edges[0]), F.greatest(box[1], edges[1]), F.least(box[2], edges[2]), F.least(box[3], edges[3])]
    gone = clipped & ((left[2] <= left[0]) | (left[3] <= left[1]))
    unlike = F.lit(None).cast("string")
    for kind, reason in KINDS.items():
        unlike = F.when(F.col("kind").isNull() if kind is None else F.col("kind") == kind, reason).otherwise(unlike)
    image = (
        F.when(~named, "invalid_xobject_invocation")
        .when(F.col("kind").isNull() | (F.col("kind") != "image"), unlike)
        .when(F.col("last_paint").isNotNull(), "unsafe_content_order")
        .when(F.col("undecoded").isNotNull(), F.col("undecoded"))
        .when(clipped & (F.greatest(F.abs(m["b"]), F.abs(m["c"])) > TURNED) & ~equal, "rotated_clipping_not_supported")
        .when(gone, "image_fully_clipped")
    )
    no_path = F.col("last_re").isNull() | (F.col("last_re") < F.coalesce("last_clip", F.lit(-1)))
    reason = (
        F.when((op == "Q") & (F.col("open") < 0), "unbalanced_graphics_state")
        .when((op == "cm") & ~six, "invalid_matrix")
        .when((op == "re") & ~four, F.when(F.size("operands") == 4, "invalid_rectangle").otherwise("complex_clipping_not_supported"))
        .when((op == "W*") | ((op == "W") & no_path), "complex_clipping_not_supported")
        .when(F.col("clips") & (clip["n"] > 1) & empty, "empty_clip")
        .when((op == "gs") & ~F.coalesce("opaque", F.lit(False)), F.when(named, "transparency_or_extgstate_not_supported").otherwise("invalid_extgstate"))
        .when(op == "Do", image)
    )
    told = own.select(*keys, at, reason.alias("reason"), F.when((op == "Do") & reason.isNull(), F.when(clipped, F.array(*left)).otherwise(F.array(*box))).alias("box"))
    told = written(told.filter("reason is not null or box is not null"), "merge-operations")
    stops = told.filter("reason is not null").groupBy(*keys).agg(F.min(at).alias("_stop"))
    return told.join(stops, keys, "left").filter(F.col("_stop").isNull() | (F.col(at) <= F.col("_stop"))).select(*keys, at, "reason", "box")


def merge_plan(pages: DataFrame, ops: DataFrame, setup: DataFrame | None = None, spread: bool = False) -> DataFrame:
    """file, scope, raster_objects, status (would_merge or skipped), skipped_reason, merged box and pixels of each page.

    ``setup`` (file, scope, reason) has the pages that are skipped before their operations are looked at. With ``spread`` a long
    page's operations are worked on by many tasks (``ranged_events``), else a page is scanned by one.
    """
    keys = ["file", "scope"]
    events = written(ranged_events(ops) if spread else merge_events(ops), "merge-events")
    stops = events.filter("reason is not null").select(*keys, "reason")
    boxes = union_box(events.filter("box is not null"), keys, "box", "idx")
    first = events.filter("box is not null").groupBy(*keys).agg(F.min_by("box", "idx").alias("base"), F.count(F.lit(1)).alias("raster_objects"))
    own = pages.select(*keys, "width_pt", "height_pt").join(stops, keys, "left").join(boxes.drop("base_covers"), keys, "left").join(first, keys, "left")
    early = setup.select(*keys, F.col("reason").alias("setup_reason")) if setup is not None else pages.select(*keys, F.lit(None).cast("string").alias("setup_reason"))
    own = own.join(early, keys, "left")
    union = F.array("x0", "y0", "x1", "y1")
    covers = F.forall(F.zip_with("base", union, lambda p, q: N.close_absolute(p, q)), lambda ok: ok)
    scale = LONG_SIDE / F.greatest("width_pt", "height_pt")
    pixels = F.array(F.ceil((F.col("x1") - F.col("x0")) * scale), F.ceil((F.col("y1") - F.col("y0")) * scale))
    reason = (
        F.when(F.col("setup_reason").isNotNull(), F.col("setup_reason"))
        .when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.coalesce("raster_objects", F.lit(0)) < 2, "fewer_than_two_direct_rasters")
        .when(~covers, "transparent_or_uncovered_union_area")
        .when((pixels[0] < 1) | (pixels[1] < 1), "invalid_merged_dimensions")
    )
    out = own.withColumns({"skipped_reason": reason, "raster_objects": F.coalesce("raster_objects", F.lit(0))})
    fine = F.col("skipped_reason").isNull()
    return out.select(*keys, "raster_objects", F.when(fine, "would_merge").otherwise("skipped").alias("status"), "skipped_reason", F.when(fine, union).alias("merged_box"), F.when(fine, pixels).alias("merged_pixels"))
