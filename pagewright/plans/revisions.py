"""Queries over files as programs save them, built from ``documents``: cross-references, streams with indirect lengths, and changes that were appended.

By doc_id, a file is saved once, or again with a table, a cross-reference stream over an object stream, or both at once
(hybrid), or its last cross-reference is lost. The second save replaces the page and the title, frees an attachment and has a
new catalogue. Image data contain the word that ends a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import pdf, rewrite
from ..tables import written
from .registry import query as _query
from .registry import read as _read

_HEADER = "%PDF-1.7\n"


def _length(*parts: Column | str) -> Column:
    """Bytes of ``parts``: what is known is one number."""
    known = F.lit(sum(len(x) for x in parts if isinstance(x, str)))
    return sum((F.octet_length(x) for x in parts if not isinstance(x, str)), known)


def _joined(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))


def _body(start: Column, objects: list[tuple[int, tuple[Column | str, ...]]]) -> tuple[Column, dict[int, Column], Column]:
    """Objects (number and parts) one after the other from place ``start``: text, place of each number, and the place after them."""
    places, parts = {}, []
    for number, own in objects:
        places[number] = start + _length(*parts)
        parts += own
    return _joined(*parts), places, start + _length(*parts)


def _entry(place: Column) -> Column:
    return F.format_string("%010d 00000 n \n", place.cast("long"))


def _fields(kind: int, a: Column | int, b: int) -> Column:
    """An entry of a cross-reference stream as hex digits, with widths of 1, 4 and 2 bytes."""
    a = F.lit(a) if isinstance(a, int) else a
    return F.concat(F.lit(f"{kind:02x}"), F.lpad(F.hex(a.cast("long")), 8, "0"), F.lit(f"{b:04x}"))


def saved_files(docs: DataFrame) -> DataFrame:
    """file and content of a file for each document."""
    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    # texts whose lengths are asked often are columns of a step of their own; so is the first save, which the others follow
    docs = docs.select("doc_id", F.concat(text, F.lit("\nendstream x")).alias("image"), F.format_string("%d", (200 + d % 50).cast("long")).alias("tall"))
    obj = lambda number, *parts: (number, (f"{number} 0 obj\n", *parts, "\nendobj\n"))
    tall = F.col("tall")
    page = lambda width, parent: ("<< /Type /Page /Parent ", f"{parent} 0 R /MediaBox [0 0 {width} ", tall, "] /Contents 5 0 R /Resources << /XObject << /Im 6 0 R >> >> >>")
    content, image = "q 50 0 0 40 0 0 cm /Im Do Q", F.col("image")
    first, at, end = _body(
        F.lit(len(_HEADER)),
        [
            obj(1, "<< /Type /Catalog /Pages 2 0 R >>"),
            obj(2, "<< /Type /Pages /Kids [3 0 R] /Count 1 >>"),
            obj(3, *page(100, 2)),
            obj(4, "<< /Title (first) >>"),
            obj(5, f"<< /Length 7 0 R >>\nstream\n{content}\nendstream"),
            obj(6, "<< /Type /XObject /Subtype /Image /Width 10 /Height 10 /BitsPerComponent 8 /ColorSpace /DeviceRGB /Length 8 0 R >>\nstream\r\n", image, "\r\nendstream"),
            obj(7, str(len(content))),
            obj(8, F.octet_length(image).cast("string")),
            obj(9, "<< /Type /EmbeddedFile /Length 3 >>\nstream\nabc\nendstream"),
            obj(10, "<< /Orphan true >>"),
        ],
    )
    table = _joined("xref\n0 11\n0000000000 65535 f \n", *(_entry(at[n]) for n in range(1, 11)))
    once = F.concat(first, table, _joined("trailer\n<< /Size 11 /Root 1 0 R /Info 4 0 R /ID [<6161> <6262>] >>\nstartxref\n", end.cast("string"), "\n%%EOF\n"))
    docs = docs.select("*", end.alias("end"), once.alias("once")).select("*", _length(_HEADER, F.col("once")).alias("whole"))
    end, once, whole = F.col("end"), F.col("once"), F.col("whole")
    new = {4: ("<< /Title (second) >>",), 12: ("<< /Type /Pages /Kids [3 0 R 13 0 R] /Count 2 >>",), 3: page(300, 12), 13: ("<< /Type /Page /Parent 12 0 R /MediaBox [0 0 77 88] >>",), 11: ("<< /Type /Catalog /Pages 12 0 R >>",)}
    ends = "/Root 11 0 R /Info 4 0 R /ID [<6161> <6363>] /Prev "
    tail = lambda place: _joined("\nstartxref\n", place.cast("string"), "\n%%EOF\n")
    # a table
    body, at, stop = _body(whole, [obj(n, *parts) for n, parts in new.items()])
    rows = _joined("xref\n3 2\n", _entry(at[3]), _entry(at[4]), "9 1\n0000000000 00001 f \n11 3\n", *(_entry(at[n]) for n in (11, 12, 13)))
    trailer = _joined("trailer\n<< /Size 14 ", ends, end.cast("string"), " >>")
    by_table, lost = F.concat(body, rows, trailer, tail(stop)), F.concat(body, rows, trailer, tail(F.lit(7)))
    # objects in a stream
    values = {n: _joined(*parts) for n, parts in new.items()}
    place, heads = F.lit(0), []
    for n, value in values.items():
        heads += [f"{n} ", place.cast("string"), " "]
        place = place + F.octet_length(value) + 1
    head = _joined(*heads)
    inner = F.concat(head, F.concat_ws(" ", *values.values()))
    packed = obj(14, "<< /Type /ObjStm /N 5 /First ", F.octet_length(head).cast("string"), " /Length ", F.octet_length(inner).cast("string"), " >>\nstream\n", inner, "\nendstream")
    held = {n: _fields(2, 14, k) for k, n in enumerate(new)}
    second = whole + _length(*packed[1])
    hexed = _joined(held[3], held[4], _fields(0, 0, 1), *(held[n] for n in (11, 12, 13)), _fields(1, whole, 0), _fields(1, second, 0), ">")
    own = lambda *more: obj(15, "<< /Type /XRef /Size 16 /W [1 4 2] /Index [3 2 9 1 11 5] /Filter /ASCIIHexDecode /Length ", F.octet_length(hexed).cast("string"), " ", *more, " >>\nstream\n", hexed, "\nendstream")[1]
    by_stream = _joined(*packed[1], *own(ends, end.cast("string")), tail(second))
    hidden = own("/Root 11 0 R")
    rows = _joined("xref\n9 1\n0000000000 00001 f \n11 5\n", *["0000000000 00000 f \n"] * 3, _entry(whole), _entry(second))
    trailer = _joined("trailer\n<< /Size 16 /XRefStm ", second.cast("string"), " ", ends, end.cast("string"), " >>")
    hybrid = _joined(*packed[1], *hidden, rows, trailer, tail(second + _length(*hidden)))
    kind = d % 5
    again = F.when(kind == 1, by_table).when(kind == 2, by_stream).when(kind == 3, hybrid).when(kind == 4, lost).otherwise("")
    return docs.select(F.concat(F.lit("saved-"), d.cast("string"), F.lit(".pdf")).alias("file"), F.concat(F.lit(_HEADER), once, again).cast("binary").alias("content"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved_files(pdf.spread(_read(spark, sf_dir, "documents").select("doc_id", "text")))


_DOCS = "d as (select 'saved-' || doc_id || '.pdf' as file, doc_id, doc_id % 5 as kind, coalesce(text, '') || chr(10) || 'endstream x' as image from documents)"


@_query(f"""
with {_DOCS}
select file, 1 as revision, 'table' as kind, '1,2,3,4,5,6,7,8,9,10' as used, '' as freed from d where kind <> 4
union all select file, 2, case kind when 1 then 'table' when 2 then 'stream' else 'hybrid' end, case kind when 1 then '3,4,11,12,13' else '3,4,11,12,13,14,15' end, '9' from d where kind in (1, 2, 3)
""")
def pdf_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each save of a file used and freed; a file whose last cross-reference is lost has no chain."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return pdf.revisions(_files(spark, sf_dir)).select("file", "revision", "kind", joined("used"), joined("freed"))


@_query(f"""
with {_DOCS}
select file, case kind when 0 then 10 when 1 then 12 when 4 then 13 else 14 end::bigint as objects, case kind when 0 then 1 else 2 end::bigint as pages, case kind when 0 then 100.0 else 300.0 end as width_pt,
       200.0 + doc_id % 50 as height_pt, case kind when 0 then '(first)' else '(second)' end as title, (kind in (0, 4))::bigint as attachments from d
""")
def pdf_saved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file as its newest save has it: objects, pages, the first page's size, title and attachments."""
    found = written(pdf.objects(_files(spark, sf_dir), parts={"value"}), "objects")
    sizes = found.groupBy("file").agg(F.count("number").alias("objects"))
    own = pdf.pages(found).groupBy("file").agg(F.count(F.lit(1)).alias("pages"), *(F.max(F.when(F.col("page_number") == 1, F.col(c))).alias(c) for c in ("width_pt", "height_pt")))
    titles = pdf.info(found).filter("key = 'Title'").select("file", F.col("value").alias("title"))
    attached = pdf.catalogue(found).groupBy("file").agg(F.count_if(F.col("kind") == "embedded_file").alias("attachments"))
    return sizes.join(own, "file").join(titles, "file").join(attached, "file")


@_query(f"""
with {_DOCS} select file, '6 0 R' as id, octet_length(encode(image))::bigint as encoded_bytes, sha256(image) as sha256 from d
""")
def pdf_saved_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose length is another object's value, byte by byte."""
    return pdf.images(pdf.objects(_files(spark, sf_dir), parts={"value", "sha256"})).select("file", "id", "encoded_bytes", "sha256")


@_query(f"""
with {_DOCS}
select file, case kind when 0 then 10 when 4 then 13 else 12 end::bigint as objects, case kind when 0 then 8 else 9 end::bigint as reached, case kind when 0 then 1 else 2 end::bigint as pages,
       case kind when 0 then '(first)' else '(second)' end as title, case kind when 0 then '<6262>' else '<6363>' end as id, sha256(image) as image_sha256 from d
""")
def pdf_saved_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written anew, whole and pruned, and read again: the newest catalogue, Info and ID stay."""
    before = written(pdf.objects(_files(spark, sf_dir), raw=True, parts={"value"}), "objects")
    whole = pdf.objects(rewrite.assembled(before), parts=set()).groupBy("file").agg(F.count("number").alias("objects"))
    after = written(pdf.objects(rewrite.assembled(before, pruned=True), parts={"value", "sha256"}), "pruned")
    sizes = after.groupBy("file").agg(
        F.count("number").alias("reached"), F.count("page_numbers").alias("pages"), F.max(F.when(F.col("id") == "6 0 R", F.col("sha256"))).alias("image_sha256"),
        F.max(F.when(F.col("id") == pdf.TRAILER, F.get_json_object("value", "$.ID[1]['(']"))).alias("id"),
    )
    titles = pdf.info(after).filter("key = 'Title'").select("file", F.col("value").alias("title"))
    return whole.join(sizes, "file").join(titles, "file")
