"""Reports as documents, their schema, and files as a data source."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from pagewright.functions.documents import violations
from pagewright.sources import formats, pdf, report

PAGE = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 300 200] /Contents 4 0 R /Resources << /XObject << /Im 5 0 R >> >> >>"
IMAGE = b"/Type /XObject /Subtype /Image /Width 1000 /Height 500 /BitsPerComponent 8 /ColorSpace /DeviceRGB"


def build(objects):
    out = b"%PDF-1.7\n"
    for number, body in objects.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    return out + b"trailer << /Root 1 0 R >>\n%%EOF\n"


def stream(head, data):
    return b"<< %s /Length %d >>\nstream\n%s\nendstream" % (head, len(data), data)


BODY = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: PAGE, 4: stream(b"", b"q 0 0 0 0 0 0 cm /Im Do Q q 72 0 0 72 9 9 cm /Im Do Q BT (x) Tj ET 0 0 5 5 re f"), 5: stream(IMAGE, b"pixels"), 6: stream(IMAGE, b"pixels"), 7: stream(b"/Subtype /Image", b""), 8: stream(b"/Subtype /FontFile2", b"font"), 9: stream(b"/Type /Metadata /Subtype /XML", b"<x/>")}
GOOD = build(BODY)


@pytest.fixture(scope="module")
def made(spark):
    files = spark.createDataFrame([("a.pdf", bytearray(GOOD), len(GOOD)), ("bare.pdf", bytearray(build({1: b"(x)"})), 99), ("bad.pdf", bytearray(b"%PDF-"), 5)], "file string, content binary, size_bytes long")
    return report.reports(files, pdf.inspected(files)).select("file", report.as_json(F.col("report")).alias("j")).persist()


def test_report(made):
    got = {r["file"]: json.loads(r["j"]) for r in made.collect()}
    assert set(got) == {"a.pdf", "bare.pdf"}
    whole = got["a.pdf"]
    assert whole["file"] == {"path": "a.pdf", "size_bytes": len(GOOD), "page_count": 1}
    assert whole["pages"][0]["object_counts"] == {"image_placements": 2, "text_operations": 1, "vector_operations": 2}
    first, second, third = whole["images"]
    assert [p["status"] for p in first["placements"]] == ["unknown", "measured"] and first["placements"][0]["effective_dpi"] is None and first["pages"] == [1]
    assert list(first["placements"][1]["target_analysis"]) == ["150", "200", "300", "600", "96"] and first["placements"][1]["effective_dpi"] == 500.0
    assert first["placements"][0]["target_analysis"]["96"] == {"target_dpi": 96, "oversampling_ratio_x": None, "oversampling_ratio_y": None, "required_pixel_width": None, "required_pixel_height": None}
    assert first["same_object_reused"] and second["duplicate_of"] == "5 0 R" and second["placements"] == [] and third["colour_space"] is None and third["estimated_raw_pixel_bytes"] is None
    assert whole["summary"]["image_bytes"] == 12 and whole["fonts"] == [{"id": "8 0 R", "base_font": None, "subtype": "FontFile2", "encoded_bytes": 4}] and whole["metadata"][0]["encoded_bytes"] == 4
    assert got["bare.pdf"]["pages"] == [] and got["bare.pdf"]["images"] == []


def test_schema(spark, made):
    def wrong(text):
        return spark.createDataFrame([(text,)], "j string").select(violations(F.parse_json("j"), report.SCHEMA).alias("v")).first()["v"]

    texts = {r["file"]: r["j"] for r in made.collect()}
    assert wrong(texts["a.pdf"]) == [] and wrong(texts["bare.pdf"]) == []
    whole = json.loads(texts["a.pdf"])
    whole["schema_version"], whole["images"][1]["sha256"], whole["images"][0]["pixel_width"] = "9", "short", "12"
    del whole["pages"][0]["rotation_degrees"], whole["images"][0]["sha256"], whole["warnings"]
    whole["images"][0]["pages"] = [1, 1.5]
    whole["fonts"] = None
    want = ["/warnings: required", "/schema_version: const", "/pages/0/rotation_degrees: required", "/images/0/sha256: required", "/images/0/pages/1: type", "/images/0/pixel_width: type", "/images/1/sha256: pattern", "/fonts: type"]
    assert sorted(wrong(json.dumps(whole))) == sorted(want)
    assert wrong("[1]") == [": type"] and wrong(None) == [": type"]


def rows(spark, *files, **more):
    names = list(more)
    return spark.createDataFrame([(n, bytearray(c), *more.values()) for n, c in files], "file string, content binary" + "".join(f", {k} {'long' if k == 'source_bytes' else 'string'}" for k in names)).coalesce(1)


def write(df, path):
    df.write.format("document_files").mode("append").save(str(path))


def test_formats_round_trip(spark, tmp_path):
    formats.register(spark)
    write(rows(spark, *((f"f{i}.pdf", build(BODY | {20: b"%d" % i})) for i in range(30))).repartition(4), tmp_path / "out")
    assert len(os.listdir(tmp_path / "out")) == 30
    (tmp_path / "out" / "note.txt").write_text("no")
    (tmp_path / "out" / "text.pdf").write_text("not one")
    found = spark.read.format("document_objects").option("partitionBytes", 10 * len(GOOD)).load(str(tmp_path / "out"))
    assert found.rdd.getNumPartitions() >= 3 and found.filter("number = 20").select("file", "value").distinct().count() == 30
    same = pdf.objects(pdf.files(spark, str(tmp_path / "out")))
    assert found.filter("number is not null").count() == same.filter("number is not null").count() == 300
    assert found.schema.names == same.schema.names
    one = spark.read.format("document_objects").load(str(tmp_path / "out" / "f3.pdf"))
    assert one.filter("number = 20").first()["value"] == "3"
    (tmp_path / "none").mkdir()
    assert spark.read.format("document_objects").load(str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize(
    ("files", "more"),
    [
        ([("a.pdf", GOOD), ("b.pdf", b"%PDF-1.7 nothing")], {}),
        ([("a.pdf", GOOD), ("taken.pdf", GOOD)], {}),
        ([("a.pdf", GOOD), ("a.pdf", GOOD)], {}),
        ([("a.pdf", GOOD), ("../b.pdf", GOOD)], {}),
        ([("a.pdf", GOOD), ("b.pdf", b"")], {}),
        ([("a.pdf", GOOD)], {"source_bytes": len(GOOD)}),
        ([("a.pdf", GOOD)], {"source": "SOURCE", "source_sha256": "0" * 64}),
        ([("source.pdf", GOOD)], {"source": "SOURCE"}),
    ],
)
def test_a_failed_write_leaves_nothing(spark, tmp_path, files, more):
    formats.register(spark)
    out = tmp_path / "out"
    out.mkdir()
    (out / "taken.pdf").write_bytes(b"old")
    (out / "source.pdf").write_bytes(GOOD)
    more = {k: str(out / "source.pdf") if v == "SOURCE" else v for k, v in more.items()}
    with pytest.raises(Exception, match="pdf|isn't|comes|bytes|changed|source|exists"):
        write(rows(spark, *files, **more), out)
    assert sorted(os.listdir(out)) == ["source.pdf", "taken.pdf"] and (out / "taken.pdf").read_bytes() == b"old"


def test_sources_are_checked(spark, tmp_path):
    formats.register(spark)
    source = tmp_path / "in.pdf"
    source.write_bytes(GOOD + b"\n" * 50)
    digest = hashlib.sha256(source.read_bytes()).hexdigest()
    write(rows(spark, ("small.pdf", GOOD), source=str(source), source_sha256=digest, source_bytes=len(GOOD) + 50), tmp_path / "out")
    assert os.listdir(tmp_path / "out") == ["small.pdf"]
    with pytest.raises(Exception, match="overwritten"):
        rows(spark, ("x.pdf", GOOD)).write.format("document_files").mode("overwrite").save(str(tmp_path / "out"))
