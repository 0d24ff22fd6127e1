"""Whether an export left everything but its images' pixels as it was: one report for each file.

``before`` and ``after`` are inspections of the files as they were and as they were written. Each check is an aggregation or a
join keyed by file, so a file with many pages or images is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators.planning import sized_placements
from . import pdf

#: What an image's dictionary may change with its pixels.
CHANGED = ["Width", "Height", "Length"]
#: The report's flags, in order, but for the last three, which say the same about all other objects.
FLAGS = [
    "output_has_pages", "page_count_preserved", "page_geometry_preserved", "page_rotation_preserved", "image_placement_preserved", "image_aspect_ratios_preserved", "image_formats_preserved", "no_images_upsampled",
    "text_content_preserved", "vector_content_preserved", "non_targeted_objects_preserved",
]
OTHERS = ["annotations_and_links_preserved", "transparency_and_other_content_preserved"]
COUNTERS = ["aspect_ratio_violations", "placement_changes", "page_geometry_changes", "format_changes"]


def _pairs(before: DataFrame, after: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Rows of both sides by ``keys`` as structs b and a, either null where a side has none."""
    side = lambda df, name: df.select(*keys, F.struct(*names).alias(name))
    return side(before, "b").join(side(after, "a"), keys, "full_outer")


def _not(ok: Column) -> Column:
    return ~F.coalesce(ok, F.lit(False))


def _pages(before: pdf.Inspection, after: pdf.Inspection) -> DataFrame:
    names = ["width_pt", "height_pt", "rotation", "text_operations", "vector_operations"]
    joined = [x.pages.join(x.operation_counts(), ["file", "page_number"]) for x in (before, after)]
    b, a = F.col("b"), F.col("a")
    both = b.isNotNull() & a.isNotNull()
    moved = both & _not(N.close_relative(b["width_pt"], a["width_pt"]) & N.close_relative(b["height_pt"], a["height_pt"]))
    differs = lambda name: F.count_if(both & _not(b[name] == a[name]))
    return (
        _pairs(*joined, ["file", "page_number"], names)
        .groupBy("file")
        .agg(F.count("b").alias("pages_before"), F.count("a").alias("pages_after"), F.count_if(moved).alias("page_geometry_changes"), *(differs(x).alias(f"{x}_changes") for x in names[2:]))
    )


def _images(before: pdf.Inspection, after: pdf.Inspection, modified: DataFrame) -> DataFrame:
    sides = []
    for x in (before, after):
        images, placed = pdf.image_rows(x.objects), sized_placements(pdf.placements(x.drawn))
        use = F.struct("page_number", "matrix", "box", "width_pt", "height_pt")
        uses = placed.groupBy("file", "id").agg(F.array_sort(F.collect_list(use)).alias("uses"))
        none = F.array().cast(dict(uses.dtypes)["uses"])
        sides.append(images.join(uses, ["file", "id"], "left").withColumn("uses", F.coalesce("uses", none)))
    names = ["pixel_width", "pixel_height", "filters", "colour_space", "bits_per_component", "uses"]
    b, a = F.col("b"), F.col("a")
    known = b.isNotNull() & a.isNotNull()
    near = lambda p, q: N.close_relative(p, q)
    numbers = lambda u: F.concat(F.array(*(u["matrix"][t] for t in "abcdef"), u["width_pt"], u["height_pt"]), u["box"])
    same = F.zip_with(b["uses"], a["uses"], lambda p, q: F.coalesce(F.forall(F.zip_with(numbers(p), numbers(q), near), lambda ok: F.coalesce(ok, F.lit(False))), F.lit(False)))
    moved = F.size(F.filter(F.slice(same, F.lit(1), F.least(F.size(b["uses"]), F.size(a["uses"]))), lambda ok: ~ok))
    pages = lambda u: F.array_distinct(F.transform(u, lambda x: x["page_number"]))
    counted = (F.size(b["uses"]) != F.size(a["uses"])) | (pages(b["uses"]) != pages(a["uses"]))
    off = F.abs(b["pixel_width"] * a["pixel_height"] - b["pixel_height"] * a["pixel_width"]) > F.greatest(b["pixel_width"], b["pixel_height"])
    other = ~(b["filters"].eqNullSafe(a["filters"]) & b["colour_space"].eqNullSafe(a["colour_space"]) & b["bits_per_component"].eqNullSafe(a["bits_per_component"]))
    grown = (a["pixel_width"] > b["pixel_width"]) | (a["pixel_height"] > b["pixel_height"])
    asked = modified.select("file", "id").distinct().join(_pairs(*sides, ["file", "id"], names), ["file", "id"], "left")
    error = F.when(b.isNull(), F.concat(F.lit("original image "), "id", F.lit(" missing"))).when(a.isNull(), F.concat(F.lit("exported image "), "id", F.lit(" missing")))
    return asked.groupBy("file").agg(
        F.sum(F.when(known, moved + counted.cast("int")).otherwise(0)).alias("placement_changes"), F.count_if(known & off).alias("aspect_ratio_violations"), F.count_if(known & other).alias("format_changes"),
        F.count_if(known & grown).alias("grown"), F.array_sort(F.collect_list(error)).alias("image_errors"),
    )


def _others(before: pdf.Inspection, after: pdf.Inspection, modified: DataFrame) -> DataFrame:
    """file and object_error: the first object, by id, that is missing, new or changed though it isn't among ``modified``."""
    marked = modified.select("file", "id", F.lit(True).alias("m")).distinct()
    rest = lambda c: F.map_filter(F.from_json(c["value"], "map<string,string>"), lambda k, _: ~k.isin(CHANGED))
    both = _pairs(pdf.comparable(before.objects), pdf.comparable(after.objects), ["file", "id"], ["value", "sha256"]).join(marked, ["file", "id"], "left")
    b, a = F.col("b"), F.col("a")
    equal = lambda x, y: F.array_sort(F.map_entries(x)).eqNullSafe(F.array_sort(F.map_entries(y)))
    stored = b["value"].eqNullSafe(a["value"]) | (b["sha256"].isNotNull() & a["sha256"].isNotNull() & equal(F.map_filter(rest(b), lambda k, _: k != "Length"), F.map_filter(rest(a), lambda k, _: k != "Length")))
    kept = F.when(F.col("m"), equal(rest(b), rest(a))).otherwise(stored & b["sha256"].eqNullSafe(a["sha256"]))
    word = F.when(a.isNull(), "missing").when(b.isNull(), "new").when(~kept, "changed")
    wrong = both.withColumn("word", word).filter("word is not null")
    return wrong.groupBy("file").agg(F.min(F.concat(F.lit("object "), "id", F.lit(" is "), "word")).alias("object_error"))


def export_validation(before: pdf.Inspection, after: pdf.Inspection, modified: DataFrame) -> DataFrame:
    """A report for each file of ``before``: passed, the flags, the counters, and errors (an array, empty if there are none).

    ``modified`` (file, id) are the images that were written anew. Sizes and boxes may differ by 1e-7 of themselves, ratios by
    the rounding of a side. A dictionary's stored Length goes with its data and isn't compared.
    """
    files = before.objects.filter("number is not null").select("file").distinct()
    own = files
    for part in (_pages(before, after), _images(before, after, modified), _others(before, after, modified)):
        own = own.join(part, "file", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    flags = dict(zip(FLAGS, [
        n("pages_after") > 0, n("pages_before") == n("pages_after"), n("page_geometry_changes") == 0, n("rotation_changes") == 0, n("placement_changes") == 0, n("aspect_ratio_violations") == 0, n("format_changes") == 0, n("grown") == 0,
        n("text_operations_changes") == 0, n("vector_operations_changes") == 0, F.col("object_error").isNull(),
    ], strict=True))
    said = F.array(F.when(~flags["output_has_pages"], F.lit("exported file has no pages")), F.when(~flags["page_count_preserved"], F.lit("page count changed")), F.col("object_error"))
    errors = F.concat(F.array_compact(said), F.coalesce("image_errors", F.array().cast("array<string>")))
    passed = F.size(errors) == 0
    for ok in flags.values():
        passed &= ok
    counters = [n(c).cast("long").alias(c) for c in COUNTERS]
    return own.select("file", passed.alias("passed"), *(ok.alias(name) for name, ok in flags.items()), *(flags[FLAGS[-1]].alias(name) for name in OTHERS), *counters, errors.alias("errors"))
