"""Reports read each object once, and a document's values are worked out once for each place of its schema."""

import json

from pyspark.sql import functions as F

from pagewright.functions.documents import violations
from pagewright.sources import pdf, report
from test_formats import BODY, build, stream


def test_values_are_worked_out_once_for_each_place_of_a_schema(spark):
    texts = spark.createDataFrame([("[1]",)], "j string")
    plan = texts.select(violations(F.parse_json("j"), report.SCHEMA).alias("v"))._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("parse_json") == 1 and 10 < plan.count("variant_get") < 40


def test_violations_of_absent_null_and_mixed_values(spark):
    schema = {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": ["integer", "array"]}, "b": {"type": "array", "items": {"type": ["object", "string"]}}, "c": {"required": ["x"]}, "d": {"items": {"const": "k"}}}}
    cases = {
        '{"a": 1, "b": []}': [], '{"a": [], "b": [{}, "s", null, 1, [1]]}': ["/b/2: type", "/b/3: type", "/b/4: type"], '{"a": {"x": [1]}, "b": {}}': ["/a: type", "/b: type"], '{"a": null, "b": null, "c": null, "d": null}': ["/a: type", "/b: type"],
        '{"c": {}, "d": ["k", "l", null]}': ["/a: required", "/b: required", "/c/x: required", "/d/1: const", "/d/2: const"], '{"a": [[1]], "b": [{"y": null}], "c": [1], "d": {"e": 1}}': [], "null": [": type"], '"{}"': [": type"], "[]": [": type"],
    }
    rows = spark.createDataFrame([(x,) for x in cases], "j string").select("j", violations(F.parse_json("j"), schema).alias("v")).collect()
    assert {r["j"]: sorted(r["v"]) for r in rows} == cases


def test_streams_are_listed_in_one_pass(spark):
    more = {20: stream(b"/Subtype /FontFile3", b"12345"), 10: stream(b"/Type /EmbeddedFile", b"file"), 11: stream(b"/Subtype /EmbeddedFile", b""), 12: stream(b"/Type /Metadata /Subtype (XML)", b"<y/>"), 13: stream(b"/Subtype 5", b"z"), 14: b"[/Subtype /Image]"}
    files = spark.createDataFrame([("f", bytearray(build(BODY | more)), 1000), ("bare", bytearray(build({1: b"(x)"})), 5), ("bad", bytearray(b"%PDF-"), 5)], "file string, content binary, size_bytes long")
    seen = pdf.inspected(files)
    streams = report._streams(seen.objects)
    assert streams._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    got = {r["file"]: json.loads(r["j"]) for r in report.reports(files, seen).select("file", report.as_json(F.col("report")).alias("j")).collect()}
    font = lambda id_, kind, n: {"id": id_, "base_font": None, "subtype": kind, "encoded_bytes": n}
    assert got["f"]["fonts"] == [font("8 0 R", "FontFile2", 4), font("20 0 R", "FontFile3", 5)] and [x["id"] for x in got["f"]["embedded_files"]] == ["10 0 R", "11 0 R"] and [x["id"] for x in got["f"]["metadata"]] == ["9 0 R"]
    sizes = {k: v for k, v in got["f"]["summary"].items() if k != "attribution"}
    assert sizes == {"image_bytes": 12, "font_bytes": 9, "embedded_file_bytes": 4, "metadata_bytes": 4, "other_bytes": 0, "unknown_bytes": 971}
    assert set(got) == {"f", "bare"} and got["bare"]["fonts"] == [] and got["bare"]["summary"]["unknown_bytes"] == 5
    same = pdf.size_summary(files, seen.objects).collect()
    assert {r["file"]: r["unknown_bytes"] for r in same} == {"f": 971, "bare": 5}


def test_entries_of_images_are_read_at_once(spark):
    head = b"/Subtype /Image /Width 3.9 /Height -2 /BitsPerComponent (8) /ColorSpace [/ICCBased 5 0 R] /Filter [/FlateDecode 7 /DCTDecode] /SMask null"
    found = pdf.objects(spark.createDataFrame([("f", bytearray(build({1: stream(head, b"x"), 2: stream(b"/Subtype /Image /Filter 5 /Mask [1 2] /Width (4)", b"")})))], "file string, content binary"))
    rows = pdf.image_rows(found)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 1
    names = ("pixel_width", "pixel_height", "colour_space", "bits_per_component", "filters", "masked", "raw_bytes")
    got = {r["id"]: tuple(r[n] for n in names) for r in rows.collect()}
    assert got["1 0 R"] == (3, 0, None, None, ["FlateDecode", "DCTDecode"], True, None) and got["2 0 R"] == (0, 0, None, None, [], True, None)
