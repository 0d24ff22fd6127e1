"""From a plan to an export: which images are approved, what became of them, and the checks of a written result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from .classify import first_reason
from .planning import saving

#: Colour spaces whose pixels can be resampled, and the greatest mean render error of 255.
COLOURS, MOST_ERROR = ["DeviceRGB", "DeviceGray", "DeviceCMYK"], 12.0


def approval(target: Column) -> Column:
    """Why an image (columns of ``pdf.images``) can't be resampled to ``target`` (width, height); null if it can."""
    return first_reason(
        ((target[0] < F.col("pixel_width")) & (target[1] < F.col("pixel_height")), "target isn't smaller on both sides"),
        (F.col("filters") == F.array(F.lit("DCTDecode")), "encoding isn't a single JPEG filter"),
        (F.col("bits_per_component") == 8, "bit depth isn't 8"),
        (F.col("colour_space").isNotNull(), "colour space is unknown"),
        (F.col("colour_space").isin(COLOURS), "colour space isn't supported"),
        (~F.col("masked"), "transparency masks aren't supported"),
    )


def export_results(planned: DataFrame, by_class: bool = True, dry_run: bool = False) -> DataFrame:
    """Plan rows (with ``class`` and ``target``) with status, skipped_reason and estimated_saving.

    With ``by_class`` images that aren't oversampled stay unchanged, as in an export by profile; an export by scale takes all.
    """
    reason = F.when(F.col("target").isNull(), "target size is unavailable").otherwise(approval(F.col("target")))
    calm = F.lit(by_class) & (F.col("class") != "oversampled")
    status = F.when(calm, "unchanged").when(reason.isNotNull(), "skipped").otherwise("would_modify" if dry_run else "approved")
    _, saved = saving(F.col("encoded_bytes"), F.col("target"), F.col("pixel_width"), F.col("pixel_height"))
    fine = ~calm & reason.isNull()
    return planned.withColumns({"status": status, "skipped_reason": F.when(~calm, reason), "estimated_saving": F.when(fine, saved).otherwise(F.lit(0))})


def exported(results: DataFrame, sizes: DataFrame) -> DataFrame:
    """Results after writing: approved images in ``sizes`` (file, id, output_bytes) are modified, the other approved ones unchanged."""
    both = results.join(sizes.select("file", "id", "output_bytes"), ["file", "id"], "left")
    done, waiting = F.col("output_bytes").isNotNull(), F.col("status") == "approved"
    status = F.when(waiting & done, "modified").when(waiting, "unchanged").otherwise(F.col("status"))
    reason = F.when(waiting & ~done, "re-encoding isn't smaller").otherwise(F.col("skipped_reason"))
    return both.withColumns({"status": status, "skipped_reason": reason, "output_bytes": F.when(waiting, F.col("output_bytes"))})


def export_summary(results: DataFrame) -> DataFrame:
    """Counts of each file's images: analysed, candidates, modified, skipped, and unchanged (the rest)."""
    count = lambda *kinds: F.count_if(F.col("status").isin(*kinds))
    own = results.groupBy("file").agg(
        F.count(F.lit(1)).alias("analysed"), count("approved", "would_modify", "modified").alias("candidates"), count("modified", "would_modify").alias("modified"), count("skipped").alias("skipped"),
        F.sum("estimated_saving").alias("estimated_saving"),
    )
    return own.withColumn("unchanged", F.col("analysed") - F.col("modified") - F.col("skipped"))


def strategy(pages: DataFrame, tagged: DataFrame) -> DataFrame:
    """file, strategy (hybrid, or native where that is unavailable) and reason for each file of ``pages`` (file, page_number, rotation, full_pixels).

    Hybrid flattening needs a file without a structure tree (those in ``tagged`` have one), unturned pages, and full-size pixels
    for each page; the first page that lacks something is named.
    """
    first = lambda bad: F.min(F.when(bad, F.col("page_number")))
    turned, bare = first(F.pmod(F.col("rotation"), F.lit(360)) != 0), first(F.col("full_pixels").isNull())
    own = pages.groupBy("file").agg(turned.alias("turned"), bare.alias("bare")).join(tagged.select("file", F.lit(True).alias("tagged")).distinct(), "file", "left")
    reason = (
        F.when(F.col("tagged"), "tagged structure")
        .when(F.col("turned").isNotNull(), F.format_string("page %d is rotated", F.col("turned")))
        .when(F.col("bare").isNotNull(), F.format_string("page %d has no raster artwork to size it by", F.col("bare")))
    )
    return own.select("file", F.when(reason.isNull(), "hybrid").otherwise("native").alias("strategy"), reason.alias("reason"))


def merge_checks(before: DataFrame, after: DataFrame, planned: DataFrame) -> DataFrame:
    """file, page_number and problem of every page that a merge must not have left so.

    ``before`` and ``after`` are pages with their counts (width_pt, height_pt, rotation, text_operations,
    vector_operations, image_placements); ``planned`` has the pages that were merged, each with one image afterwards.
    """
    names = ["width_pt", "height_pt", "rotation", "text_operations", "vector_operations", "image_placements"]
    side = lambda df, name: df.select("file", "page_number", F.struct(*names).alias(name))
    both = side(before, "b").join(side(after, "a"), ["file", "page_number"], "full_outer").join(planned.select("file", "page_number", F.lit(True).alias("merged")).distinct(), ["file", "page_number"], "left")
    b, a = F.col("b"), F.col("a")
    geometry = N.close_absolute(b["width_pt"], a["width_pt"]) & N.close_absolute(b["height_pt"], a["height_pt"]) & (b["rotation"] == a["rotation"])
    painted = (b["text_operations"] == a["text_operations"]) & (b["vector_operations"] == a["vector_operations"])
    problem = F.when(b.isNull() | a.isNull(), "page count changed").when(~geometry, "geometry changed").when(~painted, "other paint operations changed").when(F.col("merged") & (a["image_placements"] != 1), "not exactly one merged image")
    return both.select("file", "page_number", problem.alias("problem")).filter("problem is not null")


def flatten_checks(pages: DataFrame) -> DataFrame:
    """Whether each flattened page passes, and which checks it fails.

    ``pages`` has structs b and a (boxes array<array<double>>, rotation, annotations, text) and images, render_error of
    the result; text is compared without regard to white space.
    """
    b, a = F.col("b"), F.col("a")
    squeezed = lambda t: F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"\s+", " "))
    checks = {
        "boxes": b["boxes"].eqNullSafe(a["boxes"]), "rotation": b["rotation"].eqNullSafe(a["rotation"]), "annotations": b["annotations"].eqNullSafe(a["annotations"]),
        "one image": F.col("images") == 1, "render error": F.col("render_error") <= MOST_ERROR, "text": squeezed(b["text"]) == squeezed(a["text"]),
    }
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))
    return pages.withColumn("failed", failed).withColumn("passed", F.size("failed") == 0)


def benchmark_verdict(sizes: DataFrame, pages: DataFrame, structural: Column) -> DataFrame:
    """Whether each file's result passes: it is smaller but not empty, text stays selectable, and no page's sides change their ratio.

    ``sizes`` has file, input_bytes, output_bytes and the columns of ``structural``; ``pages`` has structs b and a with
    width_pt, height_pt, text_operations, and foreground_text of the plan.
    """
    left, right = F.col("b.width_pt") * F.col("a.height_pt"), F.col("b.height_pt") * F.col("a.width_pt")
    own = pages.groupBy("file").agg(F.sum("a.text_operations").alias("text"), F.sum("foreground_text").alias("expected"), F.bool_and(F.coalesce(N.close_relative(left, right), F.lit(False))).alias("ratios"))
    checks = {
        "structural": structural, "output_non_zero": F.col("output_bytes") > 0, "output_smaller": F.col("output_bytes") < F.col("input_bytes"), "text_present": F.col("text") > 0,
        "text_expected": F.col("text") == F.col("expected"), "aspect_ratios": F.col("ratios"),
    }
    both = sizes.join(own, "file", "left").withColumns({name: F.coalesce(ok, F.lit(False)) for name, ok in checks.items()})
    passed = F.lit(True)
    for name in checks:
        passed &= F.col(name)
    return both.withColumns({"passed": passed, "reduction_percent": N.reduction_percent(F.col("input_bytes"), F.col("output_bytes"))}).drop("ratios")


def raster_pixels(images: DataFrame) -> DataFrame:
    """Pixels of all images of each file, at most the greatest long."""
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    total = F.sum(F.col("pixel_width").cast("decimal(19,0)") * F.col("pixel_height"))
    return images.groupBy("file").agg(F.least(total.cast("decimal(38,0)"), most).cast("long").alias("pixels"))


def source_long_side(pages: DataFrame) -> DataFrame:
    """The long side in whole points of each file's largest page; null if it is none."""
    side = F.max(F.round(F.greatest("width_pt", "height_pt"))).cast("long")
    return pages.groupBy("file").agg(F.when(side > 0, side).alias("long_side"))


def totals(pages: DataFrame) -> DataFrame:
    """Sums of text, vector and image operations over each file's pages."""
    return pages.groupBy("file").agg(*(F.sum(c).alias(c) for c in ("text_operations", "vector_operations", "image_placements")))
