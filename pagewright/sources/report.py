"""The inspection report: one nested document for each file, put together from the relations.

A report holds all of its file, so its arrays have as many entries as the file has pages, images, placements and warnings.
What couldn't be measured is null and stays null in JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.aggregates import kind_bytes, unknown_bytes
from ..operators.planning import TARGET_DPIS, measured_placements
from . import pdf

#: The version of the report, and what its sizes say.
VERSION = "0.1.0"
ATTRIBUTION = "Encoded stream payload sizes are exact; PDF container overhead and unclassified objects remain unknown."

#: Kinds of streams whose bytes a report has.
KINDS = ["image", "font", "embedded_file", "metadata"]

#: What a report must have, as JSON Schema.
_PAGE = ["page_number", "width_pt", "height_pt", "width_mm", "height_mm", "rotation_degrees", "object_counts"]
_IMAGE = ["id", "object_number", "generation", "pages", "placements", "pixel_width", "pixel_height", "encoded_bytes", "sha256", "same_object_reused", "identical_data_duplicate", "reference_count"]
_INTEGER, _BOOLEAN, _ARRAY = {"type": "integer"}, {"type": "boolean"}, {"type": "array"}
SCHEMA = {
    "type": "object",
    "required": ["schema_version", "file", "summary", "pages", "images", "fonts", "embedded_files", "metadata", "warnings"],
    "properties": {
        "schema_version": {"const": VERSION},
        "file": {"type": "object", "required": ["path", "size_bytes", "page_count"]},
        "summary": {"type": "object", "required": ["image_bytes", "font_bytes", "embedded_file_bytes", "metadata_bytes", "other_bytes", "unknown_bytes", "attribution"]},
        "pages": {"type": "array", "items": {"$ref": "#/$defs/page"}},
        "images": {"type": "array", "items": {"$ref": "#/$defs/image"}},
        "fonts": _ARRAY, "embedded_files": _ARRAY, "metadata": _ARRAY, "warnings": _ARRAY,
    },
    "$defs": {
        "page": {"type": "object", "required": _PAGE},
        "image": {
            "type": "object",
            "required": _IMAGE,
            "properties": {
                "id": {"type": "string"}, "object_number": _INTEGER, "generation": _INTEGER, "pages": {"type": "array", "items": _INTEGER}, "placements": _ARRAY, "pixel_width": _INTEGER, "pixel_height": _INTEGER,
                "encoded_bytes": _INTEGER, "sha256": {"type": "string", "pattern": "^[0-9a-f]{64}$"}, "same_object_reused": _BOOLEAN, "identical_data_duplicate": _BOOLEAN, "reference_count": _INTEGER,
            },
        },
    },
}


def _listed(rows: DataFrame, name: str, order: list[str], **fields: Column) -> DataFrame:
    """file and an array ``name`` of structs of ``fields``, in ``order``."""
    kept = rows.select("file", F.struct(*order).alias("_order"), F.struct(*(c.alias(n) for n, c in fields.items())).alias("_row"))
    return kept.groupBy("file").agg(_in_order("_order", "_row").alias(name))


def _in_order(order: str, row: str, kept: Column | None = None) -> Column:
    """The values of ``row`` of a group by ``order``, of rows that are ``kept``; rows have maps, which have no order of their own."""
    before = lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)
    own = F.struct(order, row)
    return F.transform(F.array_sort(F.collect_list(own if kept is None else F.when(kept, own)), before), lambda x: x[row])


def _streams(found: DataFrame) -> DataFrame:
    """For each readable file the bytes of its streams by kind, and lists of fonts, embedded_files and metadata, in one pass over its objects."""
    own = pdf.entries(found.filter("number is not null").select("file", "id", "number", "generation", "size_bytes", F.when(F.col("size_bytes").isNotNull(), F.col("value")).alias("value")), "Subtype", "Type")
    own = own.select(
        "file", F.struct("number", "generation").alias("_order"), F.when(F.col("size_bytes").isNotNull(), pdf.kind()).alias("kind"), F.col("size_bytes").alias("encoded_bytes"),
        F.struct("id", F.lit(None).cast("string").alias("base_font"), F.ltrim("_Subtype", F.lit("/")).alias("subtype"), F.col("size_bytes").alias("encoded_bytes")).alias("_font"),
        F.struct("id", F.col("size_bytes").alias("encoded_bytes")).alias("_other"),
    )
    lists = [("fonts", "font", "_font"), ("embedded_files", "embedded_file", "_other"), ("metadata", "metadata", "_other")]
    return own.groupBy("file").agg(*kind_bytes("kind", "encoded_bytes", KINDS), *(_in_order("_order", row, F.col("kind") == kind).alias(name) for name, kind, row in lists))


def _targets() -> Column:
    """By target resolution, keys in the order of texts, what a placement's resolution is beside it."""
    dpis = sorted(map(str, TARGET_DPIS))
    each = lambda d: F.struct(
        F.lit(int(d)).alias("target_dpi"),
        (F.col("dpi_x") / int(d)).alias("oversampling_ratio_x"),
        (F.col("dpi_y") / int(d)).alias("oversampling_ratio_y"),
        G.target_pixels(F.col("width_pt"), F.lit(int(d))).alias("required_pixel_width"),
        G.target_pixels(F.col("height_pt"), F.lit(int(d))).alias("required_pixel_height"),
    )
    return F.map_from_arrays(F.array(*map(F.lit, dpis)), F.array(*map(each, dpis)))


def reports(pdfs: DataFrame, seen: pdf.Inspection) -> DataFrame:
    """file and its report (a struct) for each file (columns file, size_bytes) that could be read.

    Placements of an image are in the order of pages and, on a page, of their matrices.
    """
    c = F.col
    images = pdf.images(seen.objects)
    placed = measured_placements(pdf.placements(seen.drawn), pdf.image_rows(seen.objects))
    uses = placed.select(
        "file", "id", "page_number", F.struct(
            "page_number", "matrix", c("box").alias("bounding_box_pt"), c("width_pt").alias("displayed_width_pt"), c("height_pt").alias("displayed_height_pt"), c("width_mm").alias("displayed_width_mm"), c("height_mm").alias("displayed_height_mm"),
            c("dpi_x").alias("effective_dpi_x"), c("dpi_y").alias("effective_dpi_y"), c("dpi").alias("effective_dpi"), _targets().alias("target_analysis"), "status",
        ).alias("use"), F.struct("page_number", "matrix").alias("at"),
    )
    used = uses.groupBy("file", "id").agg(_in_order("at", "use").alias("placements"), F.array_sort(F.collect_set("page_number")).alias("pages"))
    none = F.array().cast(dict(used.dtypes)["placements"])
    own = images.join(used, ["file", "id"], "left").withColumn("placements", F.coalesce("placements", none)).withColumn("pages", F.coalesce("pages", F.array().cast("array<int>")))
    image_list = _listed(
        own, "images", ["number", "generation"], id=c("id"), object_number=c("number"), generation=c("generation"), pages=c("pages"), placements=c("placements"), pixel_width=c("pixel_width"), pixel_height=c("pixel_height"),
        colour_space=c("colour_space"), bits_per_component=c("bits_per_component"), filters=c("filters"), encoded_bytes=c("encoded_bytes"), estimated_raw_pixel_bytes=c("raw_bytes"), sha256=c("sha256"),
        same_object_reused=F.size("placements") > 1, identical_data_duplicate=c("duplicate_of").isNotNull(), duplicate_of=c("duplicate_of"), reference_count=F.size("placements"),
    )
    counts = F.struct("image_placements", "text_operations", "vector_operations")
    page_list = _listed(
        seen.pages.join(seen.operation_counts(), ["file", "page_number"]), "pages", ["page_number"], page_number=c("page_number"), width_pt=c("width_pt"), height_pt=c("height_pt"), width_mm=c("width_mm"), height_mm=c("height_mm"),
        rotation_degrees=c("rotation"), object_counts=counts,
    )
    warning_list = _listed(seen.warnings(), "warnings", ["page_number", "object_id", "message"], page_number=c("page_number"), object_id=c("object_id"), message=c("message"))
    whole = _streams(seen.objects).join(pdfs.select("file", "size_bytes"), "file")
    names = ["pages", "images", "fonts", "embedded_files", "metadata", "warnings"]
    for part in (page_list, image_list, warning_list):
        name = part.columns[1]
        whole = whole.join(part, "file", "left").withColumn(name, F.coalesce(name, F.array().cast(dict(part.dtypes)[name])))
    sizes = F.struct("image_bytes", "font_bytes", "embedded_file_bytes", "metadata_bytes", F.lit(0).alias("other_bytes"), unknown_bytes(KINDS, "size_bytes").alias("unknown_bytes"), F.lit(ATTRIBUTION).alias("attribution"))
    file = F.struct(c("file").alias("path"), "size_bytes", F.size("pages").alias("page_count"))
    return whole.select("file", F.struct(F.lit(VERSION).alias("schema_version"), file.alias("file"), sizes.alias("summary"), *names).alias("report"))


def as_json(report: Column) -> Column:
    """A report as JSON, with what couldn't be measured as null."""
    return F.to_json(report, {"ignoreNullFields": "false"})
