"""Queries about exports and merges: validation as one report, export by scale, the choice of a strategy, reasons against a merge, and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels
from ..functions import summaries as T
from ..operators import classify as C
from ..operators import exporting as X
from ..operators import merging, service
from ..sources import pdf, rewrite, validation
from ..tables import written
from .documents import _DOCS, _files
from .registry import query as _query
from .registry import read as _read
from .reports import _SCREEN, _screen


@_query(f"""
with {_DOCS}, n as (select *, length(text) > 1 as m, doc_id % 5000 + 1 as w, doc_id % 700 + 1 as h, doc_id % 5 = 0 as turned from d where good),
     s as (select *, greatest(w // 2, 1) as w2, case when doc_id % 3 = 0 then h else greatest(h // 2, 1) end as h2 from n),
     v as (select *, m and abs(w * h2 - h * w2) > greatest(w, h) as off from s)
select file, not off and not turned as passed, not off as ratios, not turned as rotation, not turned as others, true as formats, off::bigint as aspect_ratio_violations, 0::bigint as placement_changes, case when turned then 'object 4 0 R is changed' else '' end as errors from v
""")
def pdf_export_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose first image has half its bytes and other sides, some with a page turned, written, read again and validated."""
    before = pdf.inspected(_files(spark, sf_dir), raw=True)
    number = F.regexp_extract("file", r"(\d+)", 1).cast("long")
    half = F.decode("stream", "UTF-8")
    w, h = number % 5000 + 1, number % 700 + 1
    smaller = lambda x: F.greatest(F.floor(x / 2).cast("long"), F.lit(1))
    new = before.objects.filter("id = '10 0 R'").select("file", "id", F.encode(F.left(half, F.ceil(F.length(half) / 2).cast("int")), "UTF-8").alias("stream"), smaller(w).alias("width"), F.when(number % 3 == 0, h).otherwise(smaller(h)).alias("height"))
    changed = rewrite.replaced(before.objects, new)
    modified = changed.filter("id = '10 0 R' and edits is not null").select("file", "id")
    turned = F.when((F.col("id") == "4 0 R") & (number % 5 == 0), F.create_map(F.lit("Rotate"), F.lit("45"))).otherwise(F.col("edits"))
    after = pdf.inspected(rewrite.assembled(changed.withColumn("edits", turned)))
    found = validation.export_validation(before, after, written(modified, "modified"))
    return found.select(
        "file", "passed", F.col("image_aspect_ratios_preserved").alias("ratios"), F.col("page_rotation_preserved").alias("rotation"), F.col("annotations_and_links_preserved").alias("others"), F.col("image_formats_preserved").alias("formats"),
        "aspect_ratio_violations", "placement_changes", F.array_join("errors", "; ").alias("errors"),
    )


@_query(f"""
with {_SCREEN}
select id, case when tw is null or not (tw < w and th < h) or id % 5 = 0 or id % 7 = 0 or id % 11 = 0 or id % 13 = 0 or id % 17 = 0 or id % 19 = 0 then 'skipped' else 'would_modify' end as status,
       case when tw is null then 'target size is unavailable' when not (tw < w and th < h) then 'target isn''t smaller on both sides' when id % 5 = 0 then 'encoding isn''t a single JPEG filter' when id % 7 = 0 or id % 11 = 0 then 'bit depth isn''t 8'
            when id % 13 = 0 then 'colour space is unknown' when id % 17 = 0 then 'colour space isn''t supported' when id % 19 = 0 then 'transparency masks aren''t supported' end as skipped_reason from c
""")
def export_by_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dry run by scale: every image whose target is smaller is taken, whatever its class."""
    return X.export_results(_screen(spark, sf_dir), by_class=False, dry_run=True).select("id", "status", "skipped_reason")


@_query("""
with p as (select o_custkey as file, o_orderkey as page, case when o_orderkey % 31 = 0 then -90 when o_orderkey % 3 = 0 then 360 else 0 end as rotation, o_orderkey % 17 <> 0 as sized from orders),
     f as (select file, min(page) filter (((rotation % 360) + 360) % 360 <> 0) as turned, min(page) filter (not sized) as bare from p group by file),
     r as (select file, case when file % 9 = 0 then 'tagged structure' when turned is not null then 'page ' || turned || ' is rotated' when bare is not null then 'page ' || bare || ' has no raster artwork to size it by' end as reason from f)
select file, case when reason is null then 'hybrid' else 'native' end as strategy, reason from r
""")
def strategy_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether files can be flattened page by page with their text kept, or what forbids it."""
    key = F.col("o_orderkey")
    rotation = F.when(key % 31 == 0, -90).when(key % 3 == 0, 360).otherwise(0)
    pages = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), key.alias("page_number"), rotation.alias("rotation"), F.when(key % 17 != 0, F.array(F.lit(1), F.lit(1))).alias("full_pixels"))
    tagged = _read(spark, sf_dir, "customer").filter("c_custkey % 9 = 0").select(F.col("c_custkey").alias("file"))
    return X.strategy(pages, tagged)


def merge_files(docs: DataFrame) -> DataFrame:
    """file and content of a page with two images for each document: where the second stands, and what is wrong with it, goes by doc_id."""
    d = F.col("doc_id")
    obj = lambda number, *parts: F.concat(F.lit(f"{number} 0 obj\n"), *(F.lit(x) if isinstance(x, str) else x for x in parts), F.lit("\nendobj\n"))
    kind = d % 11
    entry = F.when(kind == 1, "<< /Direct true >>").when(kind == 2, "99 0 R").when(kind == 3, "1 0 R").otherwise("6 0 R")
    image = "/Type /XObject /Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8"
    more = F.when(kind == 4, "/ColorSpace /DeviceRGB /Filter /DCTDecode /SMask 5 0 R").when(kind == 5, "/ColorSpace /DeviceRGB /Filter /FlateDecode").when(kind == 6, "/Filter /DCTDecode").when(kind == 7, "/ColorSpace /DeviceCMYK /Filter /DCTDecode").otherwise("/ColorSpace /DeviceGray /Filter /DCTDecode")
    head = F.when(kind == 8, "/Type /XObject /Subtype /Form").otherwise(F.concat(F.lit(image + " "), more))
    between = F.when(kind == 9, " 0 0 5 5 re f").otherwise("")
    draw = F.when(kind == 10, "(B) Do").otherwise("/B Do")
    x, y, w, h = (100 + d % 650, 100 + d % 430, 20 + d % 90, 20 + d % 70)
    content = F.concat(F.lit("q 600 0 0 400 100 100 cm /A Do Q"), between, F.format_string(" q %d 0 0 %d %d %d cm ", *(v.cast("long") for v in (w, h, x, y))), draw, F.lit(" Q"))
    parts = [
        obj(1, "<< /Type /Catalog /Pages 2 0 R >>"),
        obj(2, "<< /Type /Pages /Kids [3 0 R] /Count 1 >>"),
        obj(3, "<< /Type /Page /Parent 2 0 R /MediaBox [0 0 1920 1080] /Contents 4 0 R /Resources << /XObject << /A 5 0 R /B ", entry, " >> >> >>"),
        obj(4, "<< /Length ", F.octet_length(content).cast("string"), " >>\nstream\n", content, "\nendstream"),
        obj(5, f"<< {image} /ColorSpace /DeviceRGB /Filter /DCTDecode /Length 1 >>\nstream\nx\nendstream"),
        obj(6, "<< ", head, " /Length 1 >>\nstream\ny\nendstream"),
    ]
    return docs.select(F.concat(F.lit("merge-"), d.cast("string"), F.lit(".pdf")).alias("file"), F.concat(F.lit("%PDF-1.7\n"), *parts).cast("binary").alias("content"))


@_query("""
with k as (select 'merge-' || doc_id || '.pdf' as file, doc_id % 11 as kind, 100 + doc_id % 650 as x, 100 + doc_id % 430 as y, 20 + doc_id % 90 as w, 20 + doc_id % 70 as h from documents),
     r as (select file, case kind when 1 then 'direct_xobject_unsupported' when 2 then 'invalid_xobject' when 3 then 'invalid_xobject' when 4 then 'transparency_not_supported' when 5 then 'unsupported_raster_encoding' when 6 then 'unknown_colour_space'
                  when 7 then 'unsupported_colour_space' when 8 then 'form_xobject_not_supported' when 9 then 'unsafe_content_order' when 10 then 'invalid_xobject_invocation'
                  else case when x + w > 700 or y + h > 500 then 'transparent_or_uncovered_union_area' end end as skipped_reason from k)
select file, case when skipped_reason is null then 'would_merge' else 'skipped' end as status, skipped_reason, case when skipped_reason is null then '100,100,700,500' end as box, case when skipped_reason is null then '600,400' end as pixels from r
""")
def pdf_merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages' images can be merged, read from files: by where images stand, what they are, and what is painted between them."""
    objects, own, read = pdf.read(merge_files(pdf.spread(_read(spark, sf_dir, "documents").select("doc_id"))))
    ops = pdf.merge_operations(objects, read, rewrite.states(objects))
    pages = own.select("file", F.col("id").alias("scope"), "width_pt", "height_pt")
    found = merging.merge_plan(pages, ops, pdf.merge_setup(objects))
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ",")
    return found.select("file", "status", "skipped_reason", listed(F.col("merged_box")).alias("box"), listed(F.col("merged_pixels")).alias("pixels"))


@_query("""
with p as (select p_partkey, p_partkey % 8 as k from part)
select p_partkey, case k when 0 then 'Retain JPEG; optionally evaluate JPEG-to-JPEG recompression with visual comparison.' when 1 then 'Retain JPEG2000; no automatic encoding change.' when 2 then 'Retain CCITT monochrome encoding.'
       when 3 then 'Retain JBIG2; no automatic encoding change.' when 4 then 'Retain lossless encoding; no automatic format conversion.' when 5 then 'Raw image detected; investigate lossless same-semantic encoding manually.' else 'Unknown/other encoding; do not modify.' end as advice from p
""")
def encoding_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = [["FlateDecode", "DCTDecode"], ["JPXDecode"], ["CCITTFaxDecode"], ["ASCIIHexDecode", "JBIG2Decode"], ["LZWDecode"], [], ["RunLengthDecode"], ["Crypt"]]
    filters = F.array(*(F.array(*map(F.lit, x)).cast("array<string>") for x in lists))[(F.col("p_partkey") % 8).cast("int")]
    return _read(spark, sf_dir, "part").select("p_partkey", C.advice(C.encoding_kind(filters)).alias("advice"))


@_query("""
with p as (select p_partkey, unnest(range(6)) as i from part), v as (select p_partkey, i, (p_partkey * (i * i * i + 7)) % 251 as v from p), t as (select unnest(range(4)) as j),
     x as (select p_partkey, j, v, pi() * (i + 0.5 - (j + 0.5) * 1.5) / 1.5 as a from v cross join t), w as (select p_partkey, j, v, case when abs(a) < 3 * pi() then sin(a) / a * sin(a / 3) / (a / 3) else 0 end as w from x),
     s as (select p_partkey, j, least(greatest(floor(sum(v * w) / sum(w) + 0.5), 0), 255)::bigint as v from w group by all)
select p_partkey, string_agg(v, ',' order by j) as pixels from s group by p_partkey
""")
def lanczos_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of six pixels for each part as four."""
    key = F.col("p_partkey")
    row = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (key * (i * i * i + 7)) % 251)
    images = _read(spark, sf_dir, "part").select(key.alias("id"), row.cast("array<int>").alias("pixels"), F.lit(6).alias("pixel_width"), F.lit(1).alias("pixel_height"), F.lit(1).alias("channels"), F.lit(4).alias("w"), F.lit(1).alias("h"))
    made = pixels.resized(images, "w", "h")
    return made.select(F.col("id").alias("p_partkey"), F.array_join(F.col("pixels").cast("array<string>"), ",").alias("pixels"))


@_query("with e as (select o_custkey as id, count(*) as n from orders group by o_custkey) select c_custkey as id, coalesce(n, 0) as events from customer left join e on id = c_custkey")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each id was recorded."""
    asked = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return service.event_counts(asked, _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), "id")


@_query("""
with p as (select p_partkey as k, (p_size + 3) * 1000000 as n, p_size * 300000 as s, p_size * 700000 as o from part)
select k, printf('Original: %.1f MB|Pages: %d|Images: %d|Oversampled images: %d|Estimated saving: %.1f MB|Duplicate assets: %d|Potential saving by them: %.1f MB|Images left alone: %d|Estimated final size: %.1f MB|', n / 1e6, k % 7, k % 11, k % 5, s / 1e6, k % 3, s / 1e6, k % 4, (n - s) / 1e6) as plan,
       printf('Images: %d|Would optimise: %d|Unchanged: %d|Skipped: %d|Estimated saving: ~%.1f MB|Nothing was written.|', k % 11, k % 5, k % 4, k % 2, s / 1e6) as dry,
       printf('Original: %.1f MB|Images: %d|Optimised: %d|Unchanged: %d|Skipped: %d|Output: %.1f MB|Saved: %.1f MB (%.1f%%)|Validation: %s|', n / 1e6, k % 11, k % 5, k % 4, k % 2, o / 1e6, n / 1e6, 100.0, case when k % 2 = 0 then 'PASSED' else 'FAILED' end) as export,
       printf('Pages merged: %d|Pages skipped: %d|Original: %.1f MB|Output: %.1f MB|', k % 7, k % 3, n / 1e6, o / 1e6) as merge,
       printf('Pages flattened: %d|Original: %.1f MB|Output: %.1f MB|Saved: %.1f MB|Text and vectors become pixels.|', k % 7, n / 1e6, o / 1e6, (n - o) / 1e6) as flatten,
       printf('Input: %.1f MB|Pages: %d|Raster objects: %d|Output: %.1f MB|Reduction: %.1f%%|Selectable text: %s|Native vectors: %s|Aspect ratios: %s|Validation: %s|', n / 1e6, k % 7, k % 11, o / 1e6, 50.0, case when k % 2 = 0 then 'YES' else 'NO' end, 'NO', 'PASS', case when k % 2 = 0 then 'PASS' else 'FAIL' end) as benchmark from p
""")
def summary_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five reports in words, with bars in place of line ends."""
    k, n, s, o = F.col("p_partkey"), (F.col("p_size") + 3) * 1_000_000, F.col("p_size") * 300_000, F.col("p_size") * 700_000
    even = k % 2 == 0
    texts = {
        "plan": T.plan_text(n, k % 7, k % 11, k % 5, s, k % 3, s, k % 4),
        "dry": T.export_text(True, n, k % 11, k % 5, k % 4, k % 2, s),
        "export": T.export_text(False, n, k % 11, k % 5, k % 4, k % 2, n, o, even),
        "merge": T.merge_text(False, k % 7, k % 3, n, o),
        "flatten": T.flatten_text(False, k % 7, n, o),
        "benchmark": T.benchmark_text(n, k % 7, k % 11, o, F.lit(50.0), even, F.lit(None).cast("boolean"), F.lit(True), even),
    }
    return _read(spark, sf_dir, "part").select(k.alias("k"), *(F.translate(text, "\n", "|").alias(name) for name, text in texts.items()))
