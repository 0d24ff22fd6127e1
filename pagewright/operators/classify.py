"""Ordered classifications and tolerance matches against small fixed catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G

#: Pixel canvases of digital pages.
CANVASES = [
    (640, 360), (800, 600), (1024, 768), (1280, 720), (1280, 800), (1366, 768), (1440, 900), (1600, 900), (1920, 1080),
    (1920, 1200), (2048, 1080), (2048, 1536), (2560, 1440), (2560, 1600), (3840, 2160), (4096, 2160), (5120, 2880), (7680, 4320),
]
#: Paper formats in millimetres.
FORMATS = [
    (841.0, 1189.0), (594.0, 841.0), (420.0, 594.0), (297.0, 420.0), (210.0, 297.0), (148.0, 210.0), (105.0, 148.0),
    (74.0, 105.0), (215.9, 279.4), (215.9, 355.6), (279.4, 431.8),
]
CANVAS_SLACK, WHOLE_SLACK, FORMAT_SLACK = 2.0, 0.5, 1.5

#: Long side in pixels by profile name.
PROFILES = {"720p": 1280, "1080p": 1920, "1440p": 2560, "4k": 3840}

#: Encodings in the order in which they decide.
ENCODINGS = [("DCTDecode", "jpeg"), ("JPXDecode", "jpeg2000"), ("CCITTFaxDecode", "ccitt"), ("JBIG2Decode", "jbig2"), ("FlateDecode", "lossless"), ("LZWDecode", "lossless")]

DEFAULT_DPI, OVERSAMPLED = 300, 1.25


def catalogue(spark: SparkSession, sizes: list[tuple]) -> DataFrame:
    """cat_w, cat_h in both orientations; a few dozen rows."""
    both = sorted({(float(w), float(h)) for w, h in sizes} | {(float(h), float(w)) for w, h in sizes})
    return spark.createDataFrame(both, "cat_w double, cat_h double")


def matches(rows: DataFrame, w: str, h: str, sizes: list[tuple], slack: float) -> DataFrame:
    """The rows whose size is within ``slack`` of an entry of a fixed catalogue, either way round."""
    known = F.broadcast(catalogue(rows.sparkSession, sizes))
    near = (F.abs(F.col(w) - F.col("cat_w")) <= slack) & (F.abs(F.col(h) - F.col("cat_h")) <= slack)
    return rows.join(known, near, "left_semi")


def near_any(w: Column, h: Column, sizes: list[tuple], slack: float) -> Column:
    """The same test as one expression, for use in a chain of conditions."""
    entries = F.array(*(F.array(F.lit(float(a)), F.lit(float(b))) for x, y in sizes for a, b in sorted({(x, y), (y, x)})))
    return F.coalesce(F.exists(entries, lambda c: (F.abs(w - c[0]) <= slack) & (F.abs(h - c[1]) <= slack)), F.lit(False))


def is_physical(w_mm: Column, h_mm: Column) -> Column:
    return near_any(w_mm, h_mm, FORMATS, FORMAT_SLACK)


def is_digital(w_pt: Column, h_pt: Column) -> Column:
    """Near-whole sides close to a canvas, on a page that is no paper format."""
    whole = (F.abs(w_pt - F.round(w_pt)) <= WHOLE_SLACK) & (F.abs(h_pt - F.round(h_pt)) <= WHOLE_SLACK)
    return whole & ~is_physical(G.points_to_mm(w_pt), G.points_to_mm(h_pt)) & near_any(w_pt, h_pt, CANVASES, CANVAS_SLACK)


def page_class(n_placements: Column, w_pt: Column, h_pt: Column) -> Column:
    digital, physical = is_digital(w_pt, h_pt), is_physical(G.points_to_mm(w_pt), G.points_to_mm(h_pt))
    return F.when(F.coalesce(n_placements, F.lit(0)) == 0, "vector_only").when(digital, "digital").when(physical, "physical").otherwise("ambiguous")


def density_class(x: Column, y: Column, target: Column, threshold: float = OVERSAMPLED) -> Column:
    """unknown, undersampled, oversampled or optimal, by the two axes' values against a target."""
    return (
        F.when(x.isNull() | y.isNull() | target.isNull(), "unknown")
        .when((x < target) | (y < target), "undersampled")
        .when((x >= target * threshold) & (y >= target * threshold), "oversampled")
        .otherwise("optimal")
    )


def severity(ratio_x: Column, ratio_y: Column) -> Column:
    least = F.least(ratio_x, ratio_y)  # of those present
    return F.when(least >= 2, "high").when(ratio_x.isNotNull() & ratio_y.isNotNull(), "medium").otherwise("low")


def encoding_kind(filters: Column) -> Column:
    """The kind that a list of filters makes, the strongest one first; raw for none."""
    out = F.when(F.size(filters) == 0, "raw").otherwise("other")
    for name, kind in reversed(ENCODINGS):
        out = F.when(F.array_contains(filters, name), kind).otherwise(out)
    return out


#: What to do about each kind of encoding.
ADVICE = {
    "jpeg": "Retain JPEG; optionally evaluate JPEG-to-JPEG recompression with visual comparison.",
    "jpeg2000": "Retain JPEG2000; no automatic encoding change.",
    "lossless": "Retain lossless encoding; no automatic format conversion.",
    "ccitt": "Retain CCITT monochrome encoding.",
    "jbig2": "Retain JBIG2; no automatic encoding change.",
    "raw": "Raw image detected; investigate lossless same-semantic encoding manually.",
    "other": "Unknown/other encoding; do not modify.",
}


def advice(kind: Column) -> Column:
    """What to do about an encoding kind; unknown kinds are left alone."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in ADVICE.items() for x in pair)), kind), F.lit(ADVICE["other"]))


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check that fails (is not true), null if all hold."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for ok, reason in checks))


def profile_pixels(name: Column) -> Column:
    """The long side of a profile; null for source, original and unknown names."""
    table = F.create_map(*(F.lit(x) for pair in PROFILES.items() for x in pair))
    return F.try_element_at(table, F.lower(name))
