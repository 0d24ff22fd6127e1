"""Queries over document files that are built from ``documents``, a file for each row, with DuckDB statements for the same rows.

Each file has a nested page tree, inherited sizes, rotation and resources, images (some with the same bytes), a form
without resources of its own, contents in two streams and in another filter, inline images, and, by doc_id, what must not
stop a job: encrypted files, files without objects, broken object streams, filters that aren't read, sizes that are references.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import violations
from ..operators import snapshots as S
from ..sources import formats, pdf, report, rewrite
from ..tables import shared_dir, written
from .registry import query as _query
from .registry import read as _read

#: SQL that is true for the files that can be read.
_GOOD = "doc_id % 13 <> 5 and doc_id % 17 <> 3"


def _object(number: int, body: Column | str) -> Column:
    return F.concat(F.lit(f"{number} 0 obj\n"), F.lit(body) if isinstance(body, str) else body, F.lit("\nendobj\n"))


def _stream(head: Column | str, data: Column | str) -> Column:
    data, head = (F.lit(x) if isinstance(x, str) else x for x in (data, head))
    return F.concat(F.lit("<< "), head, F.lit(" /Length "), F.octet_length(data).cast("string"), F.lit(" >>\nstream\n"), data, F.lit("\nendstream"))


def _text(template: str, *numbers: Column) -> Column:
    return F.format_string(template, *(n.cast("long") for n in numbers))


def document_files(docs: DataFrame) -> DataFrame:
    """file, content and size_bytes of a file for each document."""
    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    hexed = F.concat(F.hex(F.concat(F.lit("/Im2 Do 1 0 0 1 0 0 cm /Im2 Do"), F.when(d % 7 == 0, " BI /W 1 /H 1 ID ab EI Q").otherwise(""))), F.lit(">"))
    second = F.when(d % 11 == 0, _stream("/Filter /JBIG2Decode", "xx")).otherwise(_stream("/Filter /ASCIIHexDecode", hexed))
    own_box = F.when(d % 3 == 0, _text("/MediaBox [10 20 110 %d]", 220 + d % 7)).otherwise("")
    parts = [
        _object(1, "<< /Type /Catalog /Pages 2 0 R >>"),
        _object(2, _text("<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /MediaBox [0 0 %d %d] /Resources 6 0 R >>", 200 + d % 400, 300 + d % 500)),
        _object(3, "<< /Type /Page /Parent 2 0 R /Contents [7 0 R 8 0 R] >>"),
        _object(4, _text("<< /Type /Pages /Parent 2 0 R /Kids [5 0 R] /Rotate %d >>", 90 * (d % 4))),
        _object(5, F.concat(F.lit("<< /Type /Page /Parent 4 0 R /Contents 9 0 R "), own_box, F.lit(" >>"))),
        _object(6, F.concat(F.lit("<< /XObject << /Im1 10 0 R /Im2 11 0 R /Fm 12 0 R >> /ExtGState << /G1 << /ca "), F.when(d % 2 == 0, "1").otherwise(".5"), F.lit(" /BM [/Normal] >> >> >>"))),
        _object(7, _stream("", F.concat(_text("q %d 0 0 %d 10 20 cm /Im1 Do Q ", 50 + d % 100, 40 + d % 60), F.repeat(F.lit("BT (x\\)) Tj ET "), (d % 5).cast("int"))))),
        _object(8, _stream("", "/a cm 2 0 0 2 5 5 cm /Fm Do Q /None Do 0 0 5 5 re f")),
        _object(9, second),
        _object(10, _stream(_text("/Type /XObject /Subtype /Image /Width %d /Height %d /BitsPerComponent 8 /ColorSpace /DeviceRGB /Filter /DCTDecode", d % 5000 + 1, d % 700 + 1), text)),
        _object(11, _stream(F.concat(F.lit("/Type /XObject /Subtype /Image /Height 32 /Filter [/FlateDecode] /Width "), F.when(d % 6 == 0, "7 0 R").otherwise("64")), F.concat(text, F.when(d % 2 == 0, "").otherwise("x")))),
        _object(12, _stream("/Type /XObject /Subtype /Form /Matrix [2 0 0 2 1 1]", "/Im1 Do (y) Tj 0 0 m /Fm Do")),
        _object(13, _stream("/Type /EmbeddedFile", F.coalesce("lang", F.lit("")))),
        F.when(d % 19 == 4, _object(14, _stream("/Type /ObjStm /N 1 /First 7 0 R", "20 0 /x"))).otherwise(""),
        F.when(d % 13 == 5, "trailer << /Root 1 0 R /Encrypt 5 0 R >>").otherwise("trailer << /Root 1 0 R >>"),
    ]
    whole = F.when(d % 17 == 3, F.lit("%PDF-1.4\n")).otherwise(F.concat(F.lit("%PDF-1.7\n"), *parts))
    out = docs.select(F.concat(F.lit("doc-"), d.cast("string"), F.lit(".pdf")).alias("file"), whole.cast("binary").alias("content"))
    return out.withColumn("size_bytes", F.lit(10_000_000).cast("long"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(pdf.spread(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang")))


_DOCS = f"""d as (select doc_id, 'doc-' || doc_id || '.pdf' as file, coalesce(text, '') as text, coalesce(lang, '') as lang, {_GOOD} as good from documents),
     i as (select file, doc_id, '10 0 R' as id, doc_id % 5000 + 1 as w, doc_id % 700 + 1 as h, 8 as bits, 'DeviceRGB' as colour, 'DCTDecode' as filter, text as t from d where good
           union all select file, doc_id, '11 0 R', case when doc_id % 6 = 0 then 0 else 64 end, 32, null, null, 'FlateDecode', text || case when doc_id % 2 = 0 then '' else 'x' end from d where good)"""


@_query(f"""
with {_DOCS}
select file, case when good then 13 + (doc_id % 19 = 4)::int else 0 end::bigint as objects, case when good then 7 + (doc_id % 19 = 4)::int else 0 end::bigint as streams,
       case when good then 2 else 0 end::bigint as pages, case when doc_id % 17 = 3 then 'no objects' when not good then 'encrypted' end as warning from d
""")
def pdf_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pdf.objects(_files(spark, sf_dir), parts=set())
    counts = {"objects": F.count("number"), "streams": F.count("size_bytes"), "pages": F.count("page_numbers")}
    return found.groupBy("file").agg(*(c.alias(n) for n, c in counts.items()), F.max(F.when(F.col("number").isNull(), F.col("warning"))).alias("warning"))


@_query(f"""
with {_DOCS}
select file, 1 as page_number, '3 0 R' as id, 200.0 + doc_id % 400 as width_pt, 300.0 + doc_id % 500 as height_pt, 0 as rotation from d where good
union all select file, 2, '5 0 R', case when doc_id % 3 = 0 then 100.0 else 200.0 + doc_id % 400 end, case when doc_id % 3 = 0 then 200.0 + doc_id % 7 else 300.0 + doc_id % 500 end, 90 * (doc_id % 4) from d where good
""")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.pages(pdf.objects(_files(spark, sf_dir), parts={"resources"})).select("file", "page_number", "id", "width_pt", "height_pt", "rotation")


@_query(f"""
with {_DOCS}
select file, id, w as pixel_width, h as pixel_height, bits as bits_per_component, colour as colour_space, filter as filters, octet_length(encode(t))::bigint as encoded_bytes,
       (w * h * bits * 3 // 8)::bigint as raw_bytes, sha256(t) as sha256, case when id = '11 0 R' and doc_id % 2 = 0 then '10 0 R' end as duplicate_of from i
""")
def pdf_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pdf.images(pdf.objects(_files(spark, sf_dir), parts={"value", "sha256"}))
    return found.select("file", "id", "pixel_width", "pixel_height", "bits_per_component", "colour_space", F.array_join("filters", ",").alias("filters"), "encoded_bytes", "raw_bytes", "sha256", "duplicate_of")


@_query(f"""
with {_DOCS}
select file, 1 as page_number, '10 0 R' as id, 50.0 + doc_id % 100 as a, 40.0 + doc_id % 60 as d, 10.0 as e, 20.0 as f from d where good
union all select file, 1, '10 0 R', 4, 4, 7, 7 from d where good
union all select file, 2, '11 0 R', 1, 1, 0, 0 from d, range(2) where good and doc_id % 11 <> 0
""")
def pdf_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = pdf.inspected(_files(spark, sf_dir))
    return pdf.placements(seen.drawn).select("file", "page_number", "id", "matrix.a", "matrix.d", "matrix.e", "matrix.f")


@_query(f"""
with {_DOCS}
select file, 1 as page_number, doc_id % 5 + 1 as text_operations, 3::bigint as vector_operations, 2::bigint as image_placements from d where good
union all select file, 2, 0, 0, case when doc_id % 11 = 0 then 0 else 2 end from d where good
""")
def pdf_operation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.inspected(_files(spark, sf_dir)).operation_counts()


@_query(f"""
with {_DOCS}
select file, null::int as page_number, case when doc_id % 17 = 3 then 'no objects' else 'encrypted' end as message from d where not good
union all select file, 2, 'page content unavailable: filter JBIG2Decode' from d where good and doc_id % 11 = 0
union all select file, 2, 'inline image is not catalogued' from d where good and doc_id % 11 <> 0 and doc_id % 7 = 0
""")
def pdf_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.inspected(_files(spark, sf_dir)).warnings().select("file", "page_number", "message")


@_query(f"""
with {_DOCS}, b as (select file, sum(octet_length(encode(t)))::bigint as n from i group by file)
select file, n as image_bytes, 0::bigint as font_bytes, octet_length(encode(lang))::bigint as embedded_file_bytes, 0::bigint as metadata_bytes,
       10000000 - n - octet_length(encode(lang))::bigint as unknown_bytes from d join b using (file)
""")
def pdf_size_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return pdf.size_summary(files, pdf.objects(files, parts={"value"}))


@_query(f"""
with {_DOCS}
select file, '10 0 R' as id, 'changed' as change from d where good and length(text) > 1
union all select file, '13 0 R', 'removed' from d where good
""")
def pdf_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects that differ once the first image has half its characters and the files are written and read again."""
    parts = {"value", "sha256"}
    before = written(pdf.objects(_files(spark, sf_dir), raw=True, parts=parts), "before")
    half = F.decode("stream", "UTF-8")
    new = before.filter("id = '10 0 R'").select("file", "id", F.encode(F.left(half, F.ceil(F.length(half) / 2).cast("int")), "UTF-8").alias("stream"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    after = pdf.objects(rewrite.assembled(rewrite.replaced(before, new), pruned=True), parts=parts)
    return S.diff(pdf.comparable(before), pdf.comparable(after), ["file", "id"], ["value", "sha256"]).filter("change <> 'same'")


@_query(f"""
with {_DOCS}
select file, 1 as page_number, 13 + doc_id % 5 * 3 as operations, 1::bigint as image_placements, doc_id % 5 as text_operations from d where good
union all select file, 2, 0, 0, 0 from d where good and doc_id % 11 = 0
union all select file, 2, case when doc_id % 7 = 0 then 7 else 3 end, 2, 0 from d where good and doc_id % 11 <> 0
""")
def pdf_edited_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages after the first image's own draws on page 3 0 R are replaced by one at the front, in files written and read again."""
    parts = pdf.PARTS - {"sha256"}
    found = written(pdf.objects(_files(spark, sf_dir), raw=True, parts=parts), "objects")
    edited = found.filter("id = '3 0 R'")
    names = pdf.names(edited)
    gone = rewrite.removed_names(names, names.filter("id in ('10 0 R', '12 0 R')"))
    page = written(pdf.operations(edited, pdf.pages(edited)), "operations")
    kept = rewrite.without_draws(page, gone)
    front = [("q", []), ("cm", ["7", "0", "0", "7", "0", "0"]), ("Do", ["/Im1"]), ("Q", [])]
    lines = F.array(*(F.struct(F.lit(i).cast("long").alias("idx"), F.lit(op).alias("operator"), F.array(*map(F.lit, args)).cast("array<string>").alias("operands")) for i, (op, args) in enumerate(front)))
    prefix = page.select("file", "scope").distinct().select("file", "scope", F.inline(lines)).withColumn("matrix", F.lit(None).cast("array<double>"))
    contents = rewrite.encoded_content(rewrite.prepended(kept, prefix))
    after = pdf.inspected(rewrite.assembled(found, contents=contents), parts=parts)
    size = after.operations.groupBy("file", F.col("scope").alias("id")).agg(F.count(F.lit(1)).alias("operations"))
    own = after.pages.join(size, ["file", "id"], "left").join(after.operation_counts(), ["file", "page_number"])
    return own.select("file", "page_number", F.coalesce("operations", F.lit(0)).cast("long").alias("operations"), "image_placements", "text_operations")


@_query(f"""
with {_DOCS}
select file, '3 0 R' as holder, n as name from d, (values ('Fm')) t(n) where good union all select file, '5 0 R', 'Im2' from d where good and doc_id % 11 <> 0
""")
def pdf_foreground_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that a page draws past its first image."""
    seen = pdf.inspected(_files(spark, sf_dir))
    cut = seen.drawn.filter("kind = '/Image'").join(seen.pages.select("file", "page_number", F.col("id").alias("scope")), ["file", "page_number"]).select("file", "scope").distinct()
    own = seen.operations.join(cut, ["file", "scope"]).filter("operator = 'Do'").groupBy("file", "scope").agg((F.min("idx") + 1).alias("boundary"))
    return rewrite.foreground_names(pdf.names(seen.objects), seen.operations, own).select("file", "holder", "name")


@_query(f"""
with {_DOCS}
select file, id from d, (values ('10 0 R'), ('11 0 R')) t(id) where good
""")
def pdf_artwork(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images, and forms that paint or draw something that does; a form without resources of its own doesn't count."""
    found, _, ops = pdf.read(_files(spark, sf_dir))
    return pdf.artwork(found, ops)


@_query(f"""
with {_DOCS}
select file, '3 0 R' as scope, 'missing_media_box' as reason from d where good
union all select file, '5 0 R', case when doc_id % 3 = 0 then 'missing_resources' else 'missing_media_box' end from d where good
""")
def pdf_merge_setup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a page's own entries forbid a merge before its content is looked at: here nothing is on the page itself."""
    return pdf.merge_setup(pdf.objects(_files(spark, sf_dir), parts={"value"}))


@_query(f"""
with {_DOCS}
select file, 1 as page_number, repeat('x\\) ', (doc_id % 5)::int) as text from d where good union all select file, 2, '' from d where good
""")
def pdf_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strings that a page's own contents show, without fonts' encodings."""
    _, pages, ops = pdf.read(_files(spark, sf_dir))
    return pdf.page_text(pages, ops)


@_query(f"""
with {_DOCS}
select file, '3 0 R' as holder, 'G1' as name, doc_id % 2 = 0 as opaque from d where good union all select file, '5 0 R', 'G1', doc_id % 2 = 0 from d where good
""")
def pdf_graphics_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.states(pdf.objects(_files(spark, sf_dir), parts={"resources"}))


@_query(f"""
with {_DOCS}, r as (select file, d.doc_id, doc_id % 11 = 0 as cut, doc_id % 2 = 0 as twin, octet_length(encode(text)) + octet_length(encode(text || case when doc_id % 2 = 0 then '' else 'x' end)) as n, octet_length(encode(lang)) as a from d where good)
select file, 0::bigint as violations, 2::bigint as page_count, n::bigint as image_bytes, (10000000 - n - a)::bigint as unknown_bytes, '10 0 R,11 0 R' as images, '150,200,300,600,96' as target_keys, true as null_kept,
       case when twin then '10 0 R' end as duplicate_of, case when cut then '2,0' else '2,2' end as counts, 2.0 * (doc_id % 5000 + 1) * 72.0 / (50.0 + doc_id % 100) as twice_dpi_x, '13 0 R' as embedded,
       case when cut then 1 when doc_id % 7 = 0 then 1 else 0 end::bigint as warnings
from r
""")
def inspection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document for each file that can be read, valid under the report's schema; columns are read from the JSON."""
    files = _files(spark, sf_dir)
    text = written(report.reports(files, pdf.inspected(files)).select("file", report.as_json(F.col("report")).alias("j")), "reports")
    text = text.withColumn("v", F.parse_json("j"))  # used often, so it is a step of its own
    get = lambda path, kind, of="v": F.variant_get(of, path, kind)
    large = F.transform(get("$.images[0].placements", "array<variant>"), lambda x: get("$.effective_dpi_x", "double", x))
    return text.select(
        "file", F.size(violations(F.col("v"), report.SCHEMA)).cast("long").alias("violations"), get("$.file.page_count", "long").alias("page_count"), get("$.summary.image_bytes", "long").alias("image_bytes"), get("$.summary.unknown_bytes", "long").alias("unknown_bytes"),
        F.array_join(F.transform(get("$.images", "array<variant>"), lambda x: get("$.id", "string", x)), ",").alias("images"),
        F.array_join(F.json_object_keys(F.get_json_object("j", "$.images[0].placements[0].target_analysis")), ",").alias("target_keys"), F.col("j").contains('"colour_space":null').alias("null_kept"),
        get("$.images[1].duplicate_of", "string").alias("duplicate_of"), F.concat(get("$.images[0].reference_count", "string"), F.lit(","), get("$.images[1].reference_count", "string")).alias("counts"),
        (2 * F.element_at(F.array_sort(large), 1)).alias("twice_dpi_x"), get("$.embedded_files[0].id", "string").alias("embedded"), F.size(get("$.warnings", "array<variant>")).cast("long").alias("warnings"),
    )


@_query(f"""
with {_DOCS}
select file, 13 + (doc_id % 19 = 4)::int as objects, 2::bigint as pages, octet_length(encode(text))::bigint as image_bytes, sha256(text) as image_sha256 from d where good
""")
def document_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that can be read, written by the format ``document_files`` and read by ``document_objects``."""
    formats.register(spark)
    files = written(_files(spark, sf_dir), "files")
    good = pdf.objects(files, parts=set()).filter("id = 'trailer'").select("file")
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    files.select("file", "content").join(good, "file").write.format("document_files").mode("append").save(folder)
    found = spark.read.format("document_objects").option("parts", "sha256").load(folder.removeprefix("file://"))
    image = F.col("id") == "10 0 R"
    own = found.groupBy(F.element_at(F.split("file", "/"), -1).alias("file")).agg(F.count("number").alias("objects"), F.count("page_numbers").alias("pages"), F.max(F.when(image, F.col("size_bytes"))).alias("image_bytes"), F.max(F.when(image, F.col("sha256"))).alias("image_sha256"))
    return own
