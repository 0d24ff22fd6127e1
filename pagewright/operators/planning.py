"""The downsampling plan: from images, placements and pages to targets, savings and candidates.

Relations have a ``file`` column; every join and group includes it, so a plan covers any number of files at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import numeric as N
from . import classify as C
from .aggregates import CAP, CORROBORATED, LEAST_COVERAGE, MOST_WEIGHT, strict_max, strict_min, weighted_lower_median

TARGET_DPIS = [96, 150, 200, 300, 600]


def sized_placements(placements: DataFrame) -> DataFrame:
    """Placements (with a matrix) with displayed size and box."""
    w, h = G.axis_lengths(F.col("matrix"))
    return placements.withColumns({"width_pt": w, "height_pt": h, "box": G.unit_square_box(F.col("matrix"))})


def measured_placements(placements: DataFrame, images: DataFrame) -> DataFrame:
    """Placements (file, id, page_number, matrix) with displayed size, box and effective resolution."""
    sizes = images.select("file", "id", "pixel_width", "pixel_height")
    own = sized_placements(placements.join(sizes, ["file", "id"]))
    own = own.withColumns({"dpi_x": G.effective_dpi(F.col("pixel_width"), F.col("width_pt")), "dpi_y": G.effective_dpi(F.col("pixel_height"), F.col("height_pt"))})
    both = F.col("dpi_x").isNotNull() & F.col("dpi_y").isNotNull()
    return own.withColumns({
        "dpi": F.when(both, F.least("dpi_x", "dpi_y")),
        "status": F.when(both, "measured").otherwise("unknown"),
        "width_mm": G.points_to_mm(F.col("width_pt")),
        "height_mm": G.points_to_mm(F.col("height_pt")),
    })


def target_fanout(rows: DataFrame, width_pt: str, height_pt: str, dpis: list[int] = TARGET_DPIS) -> DataFrame:
    """A row for each target resolution with the pixels it requires."""
    each = rows.withColumn("target_dpi", F.explode(F.array(*(F.lit(d) for d in dpis))))
    return each.withColumns({"required_width": G.target_pixels(F.col(width_pt), F.col("target_dpi")), "required_height": G.target_pixels(F.col(height_pt), F.col("target_dpi"))})


def page_scales(pages: DataFrame, long_px: int | None) -> DataFrame:
    """file, page_number, and pixels for each point: a page's budget (turned with it), else a profile's long side."""
    budget = G.swap_if(G.quarter_turned(F.col("rotation")), F.col("budget"))
    profile = F.lit(long_px).cast("double") / F.when(G.measurable(F.greatest("width_pt", "height_pt")), F.greatest("width_pt", "height_pt"))
    return pages.select("file", "page_number", F.coalesce(budget[0] / F.col("width_pt"), profile).alias("scale_x"), F.coalesce(budget[1] / F.col("height_pt"), profile).alias("scale_y"))


def image_scales(placed: DataFrame, scales: DataFrame) -> DataFrame:
    """file, id and the scale that an image's largest use needs; null if any use has no scale or no size."""
    used = placed.join(scales, ["file", "page_number"], "left")
    need = F.greatest(F.col("width_pt") * F.col("scale_x") / F.col("pixel_width"), F.col("height_pt") * F.col("scale_y") / F.col("pixel_height"))
    whole = F.col("scale_x").isNotNull() & F.col("scale_y").isNotNull() & (F.col("pixel_width") > 0) & (F.col("pixel_height") > 0)
    return used.groupBy("file", "id").agg(strict_max(F.when(whole, need)).alias("scale"))


def saving(size: Column, target: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Bytes after and saved if size goes with pixels; an image without pixels keeps its bytes."""
    after = F.coalesce(N.mul_div(size, target[0] * target[1], w * h), size)
    return after, N.saturating_sub(size, after)


def plan(images: DataFrame, placements: DataFrame, pages: DataFrame, long_px: int | None = None, dpi: int = C.DEFAULT_DPI, threshold: float = C.OVERSAMPLED) -> DataFrame:
    """One row for each image: limiting resolution, class, target, estimated bytes, saving, severity and reason.

    With ``long_px`` the target is what a screen page of that long side shows, else what ``dpi`` needs in print.
    Images without placements are unknown.
    """
    placed = measured_placements(placements, images)
    limits = placed.groupBy("file", "id").agg(strict_min(F.col("dpi_x")).alias("dpi_x"), strict_min(F.col("dpi_y")).alias("dpi_y"), F.count(F.lit(1)).alias("reference_count"))
    own = images.join(limits, ["file", "id"], "left")
    w, h, size = F.col("pixel_width"), F.col("pixel_height"), F.col("encoded_bytes")
    if long_px is None:
        scale = F.lit(float(dpi)) / F.least("dpi_x", "dpi_y")
        kind = C.density_class(F.col("dpi_x"), F.col("dpi_y"), F.lit(float(dpi)), threshold)
    else:
        own = own.join(image_scales(placed, page_scales(pages, long_px)), ["file", "id"], "left")
        scale = F.col("scale")
        need = G.scaled_image(w, h, scale)
        fits = lambda c: (need[0].isNull()) | c
        kind = (
            F.when(need.isNull(), "unknown")
            .when(fits((w < need[0]) | (h < need[1])), "undersampled")
            .when((w >= need[0] * threshold) & (h >= need[1] * threshold), "oversampled")
            .otherwise("optimal")
        )
    target = G.scaled_image(w, h, scale)
    own = own.withColumns({"class": kind, "target": target})
    over = F.col("class") == "oversampled"
    after, saved = saving(size, F.col("target"), w, h)
    text = (
        F.when(F.col("class") == "unknown", "resolution can't be measured")
        .when(F.col("class") == "undersampled", "below the target on an axis")
        .when(F.col("class") == "optimal", "close to the target")
        .otherwise(F.format_string("%d x %d can become %d x %d", w, h, F.col("target")[0], F.col("target")[1]))
    )
    return own.withColumns({
        "after_bytes": F.when(over, after).otherwise(size),
        "saved_bytes": F.when(over, saved).otherwise(F.lit(0)),
        "severity": F.when(over, C.severity(F.col("dpi_x") / dpi, F.col("dpi_y") / dpi)),
        "reason": text,
    })


def point_targets(placed: DataFrame) -> DataFrame:
    """file, id and the pixels of one pixel a point at an image's largest use, width first; null if that is no smaller."""
    need = strict_max(F.greatest(F.col("width_pt") / F.col("pixel_width"), F.col("height_pt") / F.col("pixel_height")))
    sizes = placed.groupBy("file", "id").agg(need.alias("scale"), F.max("pixel_width").alias("w"), F.max("pixel_height").alias("h"))
    side = lambda c: F.greatest(F.round(F.col(c) * F.col("scale")), F.lit(1.0)).cast("long")
    return sizes.select("file", "id", F.when(F.col("scale") < 1, F.array(side("w"), side("h"))).alias("target"))


def screen_dpi(placed: DataFrame, targets: DataFrame) -> DataFrame:
    """file, id and the resolution that a target (array of two) has at the largest displayed size of each axis."""
    size = placed.groupBy("file", "id").agg(F.max("width_pt").alias("w"), F.max("height_pt").alias("h"))
    return targets.join(size, ["file", "id"]).select("file", "id", G.effective_dpi(F.col("target")[0], F.col("w")).alias("screen_dpi_x"), G.effective_dpi(F.col("target")[1], F.col("h")).alias("screen_dpi_y"))


def plan_summary(planned: DataFrame) -> DataFrame:
    """Counts of the classes and total savings of each file."""
    kinds = [F.count_if(F.col("class") == k).alias(k) for k in ("oversampled", "optimal", "undersampled", "unknown")]
    return planned.groupBy("file").agg(F.count(F.lit(1)).alias("images"), *kinds, F.count_if(F.col("class") != "oversampled").alias("do_not_modify"), F.sum("saved_bytes").alias("saved_bytes"))


def hybrid_estimate(pixels: Column, file_size: Column) -> Column:
    """Bytes of flattened pages: 0.38 a pixel and 65,536 more, at most the file's size."""
    return F.least(F.floor(pixels * 38 / 100).cast("long") + 65_536, file_size)


def page_budgets(pages: DataFrame, placed: DataFrame) -> DataFrame:
    """Each page's class and full-size pixels: a digital page's own, a physical or corroborated page's by sampling.

    Sampling is the weighted lower median of the resolutions of the images that cover enough of the page.
    """
    keys = ["file", "page_number"]
    area = F.abs((F.col("box")[2] - F.col("box")[0]) * (F.col("box")[3] - F.col("box")[1]))
    evidence = placed.join(pages.select(*keys, F.col("width_pt").alias("pw"), F.col("height_pt").alias("ph")), keys)
    share = F.least(F.greatest(area / F.when(F.col("pw") * F.col("ph") > 0, F.col("pw") * F.col("ph")), F.lit(0.0)), F.lit(1.0))
    evidence = evidence.select(*keys, F.col("dpi").alias("sampling"), share.alias("coverage"))
    strong = evidence.filter((F.col("coverage") >= LEAST_COVERAGE) & G.measurable(F.col("sampling"))).withColumn("weight", F.least(F.col("coverage"), F.lit(MOST_WEIGHT)).cast("decimal(20,12)"))
    median = weighted_lower_median(strong, keys, "sampling", "weight", CAP)
    known = strong.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.sum("coverage").alias("covered"))
    uses = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("uses"))
    own = pages.join(uses, keys, "left").join(median, keys, "left").join(known, keys, "left")
    w, h = F.col("width_pt"), F.col("height_pt")
    kind = C.page_class(F.col("uses"), w, h)
    sampled = F.array(G.target_pixels(w, F.coalesce("median", F.lit(CAP))), G.target_pixels(h, F.coalesce("median", F.lit(CAP))))
    budget = F.when(F.col("class") == "digital", F.array(F.round(w).cast("long"), F.round(h).cast("long"))).when(F.col("class") != "vector_only", sampled)
    shown = F.col("class").isin("digital", "physical") | ((F.col("class") == "ambiguous") & (F.coalesce("samples", F.lit(0)) >= 2) & (F.coalesce("covered", F.lit(0.0)) >= CORROBORATED))
    return own.withColumn("class", kind).select(*pages.columns, "class", budget.alias("full_pixels"), shown.alias("shown"))
