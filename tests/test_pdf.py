import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.operators import planning
from pagewright.sources import pdf


def build(objects):
    """A file of numbered objects, without a cross-reference table."""
    out = b"%PDF-1.7\n"
    for number, body in objects.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    return out + b"trailer << /Root 1 0 R >>\n%%EOF\n"


def stream(head, data):
    return b"<< %s /Length %d >>\nstream\n%s\nendstream" % (head, len(data), data)


IMAGE = b"/Type /XObject /Subtype /Image /Width 10000 /Height 10000 /BitsPerComponent 8 /ColorSpace /DeviceRGB"
CONTENT = b"q 141.732 0 0 141.732 20 20 cm /Im1 Do Q Q q 100 0 0 50 0 0 cm /Im1 Do Q /Fm1 Do BT (a \\) b) Tj ET 0 0 10 10 re f /Missing Do"


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pdfs")
    payload = bytes(range(64))
    good = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R 9 0 R] /Count 2 /MediaBox [0 0 595.276 841.89] /Rotate 90 /Resources 8 0 R >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R] >>",
        4: stream(b"/Filter /FlateDecode", zlib.compress(CONTENT)),
        5: stream(IMAGE, payload),
        6: stream(IMAGE, payload),
        7: stream(b"/Type /XObject /Subtype /Form /Matrix [2 0 0 2 0 0] /Resources << /XObject << /Im2 6 0 R /Me 7 0 R >> >>", b"q 10 0 0 10 5 5 cm /Im2 Do Q /Me Do (x) Tj"),
        8: b"<< /XObject << /Im1 5 0 R /Fm1 7 0 R >> >>",
        9: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 100 200] /Rotate 0 >>",
        10: stream(b"/Type /EmbeddedFile", b"abc"),
    }
    (folder / "good.PDF").write_bytes(build(good))
    (folder / "locked.pdf").write_bytes(build({1: b"<< /Type /Catalog >>"}).replace(b"/Root", b"/Encrypt 5 0 R /Root"))
    (folder / "bare.pdf").write_bytes(b"%PDF-1.4\n")
    (folder / "text.pdf").write_bytes(b"no header")
    (folder / "other.txt").write_bytes(b"%PDF-1.4\n")
    (folder / "deep.pdf").write_bytes(build({1: b"[" * 5000 + b"]" * 5000, 2: b"<< /Type /Pages /Kids [2 0 R] >>", 3: b"<< /Length 9 >> stream\nshort"}))
    files = pdf.files(spark, str(folder))
    assert files.count() == 4
    return pdf.objects(files).persist()


def test_relations(spark, found):
    own = pdf.pages(found)
    ops = pdf.operations(found, own)
    messages = {(r["file"].rsplit("/", 1)[1], r["message"]) for r in pdf.warnings(found, own, ops, pdf.drawn(found, own, ops)).collect()}
    assert ("locked.pdf", "encrypted") in messages and ("bare.pdf", "no objects") in messages
    pages = pdf.pages(found).filter(F.col("file").endswith("good.PDF"))
    rows = sorted(map(tuple, pages.select("page_number", "id", "width_pt", "height_pt", "rotation").collect()))
    assert rows == [(1, "3 0 R", 595.276, 841.89, 90), (2, "9 0 R", 100.0, 200.0, 0)]
    images = {r["id"]: r for r in pdf.images(found).collect()}
    assert images["5 0 R"]["duplicate_of"] is None and images["6 0 R"]["duplicate_of"] == "5 0 R"
    assert (images["5 0 R"]["colour_space"], images["5 0 R"]["filters"], images["5 0 R"]["encoded_bytes"]) == ("DeviceRGB", [], 64)
    kinds = {r["id"]: r["kind"] for r in pdf.catalogue(found).filter(F.col("file").endswith("good.PDF")).collect()}
    assert kinds["5 0 R"] == "image" and kinds["10 0 R"] == "embedded_file" and kinds["4 0 R"] == "other"


def test_placements_and_counts(spark, found):
    own = found.filter(F.col("file").endswith("good.PDF"))
    pages = pdf.pages(own)
    ops = pdf.operations(own, pages)
    shown = pdf.drawn(own, pages, ops)
    placed = pdf.placements(shown)
    measured = planning.measured_placements(placed, pdf.images(own))
    got = sorted((r["id"], round(r["width_pt"], 3), round(r["height_pt"], 3), [round(x, 3) for x in r["box"]]) for r in measured.collect())
    assert got == [("5 0 R", 100.0, 50.0, [0, 0, 100, 50]), ("5 0 R", 141.732, 141.732, [20, 20, 161.732, 161.732]), ("6 0 R", 20.0, 20.0, [10, 10, 30, 30])]
    dpi = measured.filter("round(width_pt) = 142").first()["dpi"]
    assert dpi == pytest.approx(5080, abs=0.1)
    counts = {r["page_number"]: (r["text_operations"], r["vector_operations"]) for r in pdf.operation_counts(pages, ops, shown).collect()}
    assert counts == {1: (2, 2), 2: (0, 0)}
    assert planning.plan(pdf.images(own), placed, pages).filter("class = 'oversampled'").count() == 2
    targets = {r["id"]: r["target"] for r in planning.point_targets(measured).collect()}
    assert targets == {"5 0 R": [142, 142], "6 0 R": [20, 20]}
    dpis = planning.screen_dpi(measured, planning.point_targets(measured)).filter("id = '6 0 R'").first()
    assert dpis["screen_dpi_x"] == pytest.approx(72)


def test_nothing_is_lost_in_silence(spark, tmp_path, monkeypatch):
    """Long page contents, streams that can't be decoded, forms without resources, deep nesting."""
    monkeypatch.setattr(pdf, "FORM_BYTES", 120)
    form = b"/Type /XObject /Subtype /Form"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R 4 0 R 5 0 R] /Resources << /XObject << /Im 10 0 R /Bare 11 0 R /Long 12 0 R /F0 20 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 6 0 R >>",
        4: b"<< /Type /Page /Parent 2 0 R /Contents 7 0 R >>",
        5: b"<< /Type /Page /Parent 2 0 R /Contents [8 0 R 9 0 R] >>",
        6: stream(b"", b"(x) Tj " * 100 + b"/Bare Do /Long Do /F0 Do"),
        7: stream(b"/Filter /Crypt", b"abc"),
        8: stream(b"/Filter /FlateDecode", b"broken"),
        9: stream(b"/Filter /FlateDecode", zlib.compress(b"(x) Tj " * 3, 0)[:20]),
        10: stream(IMAGE, b"x"),
        11: stream(form + b" /Matrix [2 0 0 2 0 0]", b"q 5 0 0 5 0 0 cm /Im Do Q"),
        12: stream(form, b"(x) Tj " * 100),
    }
    for k in range(17):
        objects[20 + k] = stream(form + b" /Resources << /XObject << /F%d %d 0 R >> >>" % (k + 1, 21 + k), b"/F%d Do" % (k + 1))
    objects[37] = stream(form + b" /Resources << /XObject << /Im 10 0 R >> >>", b"/Im Do")
    (tmp_path / "a.pdf").write_bytes(build(objects))
    pdfs = pdf.files(spark, str(tmp_path))
    rows = pa.Table.from_pylist([r.asDict() for r in pdfs.select("file", "content").collect()])
    made = [x for batch in pdf._parse(iter(rows.to_batches())) for x in batch.to_pylist()]  # here, where the lower limit holds
    own = spark.createDataFrame(made, pdf._OBJECTS).persist()
    pages = pdf.pages(own).persist()
    numbers = {r["id"]: r["page_number"] for r in pages.collect()}
    ops = pdf.operations(own, pages).persist()
    shown = pdf.drawn(own, pages, ops)
    said = sorted((r["page_number"], r["object_id"] or "", r["message"]) for r in pdf.warnings(own, pages, ops, shown).collect())
    assert [(n, i) for n, i, _ in said] == [(1, "12 0 R"), (2, ""), (3, ""), (3, "")] and "Crypt" in said[1][2] and said[0][2].endswith("form is too long to be read")
    placed = sorted((r["page_number"], r["matrix"]["a"]) for r in pdf.placements(shown).collect())
    assert placed == [(numbers["3 0 R"], 1.0), (numbers["3 0 R"], 10.0)]
    assert ops.filter("scope = '3 0 R' and operator = 'Tj'").count() == 100


def test_deep_page_tree(spark, tmp_path):
    objects = {1: b"<< /Type /Catalog /Pages 49 0 R >>"}
    for k in range(50, 3000):  # a page below 2,952 nodes, the last of which also names the first
        objects[k] = b"<< /Type /Pages /Parent %d 0 R /Kids [%d 0 R%s] >>" % (k - 1, k + 1, b" 50 0 R" if k == 2999 else b"")
    objects[3000] = b"<< /Type /Page /Parent 2999 0 R >>"
    objects[49] = b"<< /Type /Pages /Kids [50 0 R] /MediaBox [0 0 7 8] >>"
    (tmp_path / "a.pdf").write_bytes(build(objects))
    assert [(r["id"], r["page_number"], r["width_pt"]) for r in pdf.pages(pdf.objects(pdf.files(spark, str(tmp_path)))).collect()] == [("3000 0 R", 1, 7.0)]


def test_malformed_files_stop_nothing(spark, tmp_path):
    image = b"/Type /XObject /Subtype /Image"
    page = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R (x) 99 0 R 5] >>"}
    bad = {
        "sizes": {**page, 3: b"<< /Type /Page /Parent 2 0 R /Rotate 7 0 R /MediaBox [/a 0 7 0 R] /Contents 4 0 R >>", 4: stream(b"", b"/a 0 0 1 0 0 cm 1 0 0 1 0 cm /Im 5 Do (x) Do Do ]] >> << Q"), 5: stream(image + b" /Width 7 0 R /Height /x /BitsPerComponent 7 0 R /ColorSpace [/ICCBased 7 0 R] /Filter [7 0 R]", b"x"), 7: b"5"},
        "objstm": {1: stream(b"/Type /ObjStm /First 9 0 R /N 1", b"1 0 << >>"), 2: stream(b"/Type /ObjStm /First 99999999 /N 1", b"1 0"), 3: stream(b"/Type /ObjStm /First 4 /Filter [/FlateDecode] /DecodeParms 5 0 R", b"xx")},
        "loop": {1: b"<< /Type /Catalog /Pages 1 0 R /Kids [1 0 R] >>", 2: b"<< /Type /Pages /Parent 2 0 R /Kids 2 0 R >>"},
        "numbers": {1: b"<< /A " + b"9" * 9000 + b" /B [1. -.5 +3 --2 1e5 . - +] >>", 2: b"<< /A 3 0 obj << /B >> >>", 4: b"[ [ << >"},
        "length": {1: b"<< /Type /Catalog /Length -5 >>\nstream\nabc", 2: b"<< /Length 99999999999 >>\nstream\nabc\nendstream"},
        "bomb": {**page, 3: b"<< /Type /Page /Contents 4 0 R >>", 4: stream(b"/Filter [/FlateDecode /FlateDecode]", zlib.compress(zlib.compress(bytes(1 << 24))))},
    }
    for name, objects in bad.items():
        (tmp_path / f"{name}.pdf").write_bytes(build(objects))
    (tmp_path / "cut.pdf").write_bytes(build(bad["sizes"])[:150])
    (tmp_path / "noise.pdf").write_bytes(b"%PDF-1.7\n" + bytes(range(256)) * 40 + b"1 0 obj << /A (" + b"\\" * 999)
    seen = pdf.inspected(pdf.files(spark, str(tmp_path)))
    files = {r["file"].rsplit("/", 1)[1] for r in seen.objects.select("file").distinct().collect()}
    assert files == {f"{n}.pdf" for n in (*bad, "cut", "noise")}
    seen.warnings().collect()
    seen.operation_counts().collect()
    sizes = seen.objects.filter(F.col("file").endswith("sizes.pdf"))
    assert [(r["width_pt"], r["rotation"]) for r in pdf.pages(sizes).collect()] == [(0.0, 0)]
    assert [(r["pixel_width"], r["pixel_height"], r["bits_per_component"], r["colour_space"], r["filters"]) for r in pdf.images(sizes).collect()] == [(0, 0, None, None, [])]
    assert seen.operations.filter("operator = 'Do'").count() == 3


def test_filters():
    from pagewright.sources import filters

    data = bytes(range(256)) * 9
    png = b"".join(bytes([2]) + bytes((row[i] - (above[i])) & 255 for i in range(4)) for above, row in [(bytes(4), b"abcd"), (b"abcd", b"bbce")])
    cases = [
        ("FlateDecode", zlib.compress(data), {}, data), ("ASCIIHexDecode", b"61 62\n6>", {}, b"ab`"), ("ASCII85Decode", b"<~87cURD]~>", {}, b"Hello"),
        ("RunLengthDecode", b"\x02abc\xfed\x80zz", {}, b"abcddd"), ("LZWDecode", bytes.fromhex("800b6050220c0c8501"), {}, bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])),
        ("FlateDecode", zlib.compress(png), {"Predictor": 12, "Columns": 4}, b"abcdbbce"), ("FlateDecode", zlib.compress(b"\x01\x01\x01"), {"Predictor": 2, "Columns": 3}, b"\x01\x02\x03"),
    ]
    for name, coded, parms, want in cases:
        assert filters.decoded(coded, ["/" + name], [parms]) == (want, None)
    assert filters.decoded(zlib.compress(data)[:50], ["/FlateDecode"], [{}])[1] == "cut short"
    for name, coded in [("FlateDecode", b"xx"), ("ASCIIHexDecode", b"zz"), ("LZWDecode", b"\x00\xff\xff\xff"), ("Other", b"")]:
        assert filters.decoded(coded, ["/" + name], [{}])[0] is None


def test_rewriting(spark, found):
    """Files written from their objects read as before; edited contents keep what was not edited."""
    from pagewright.operators import snapshots
    from pagewright.sources import rewrite

    own = pdf.files(spark, found.filter(F.col("file").endswith("good.PDF")).first()["file"].removeprefix("file:"))
    before = pdf.objects(own, raw=True).persist()
    after = pdf.objects(rewrite.assembled(before, pruned=False), raw=True)
    same = snapshots.diff(pdf.comparable(before), pdf.comparable(after), ["file", "id"], ["value", "sha256"])
    assert {r["change"] for r in same.collect()} == {"same"}
    content = rewrite.assembled(before, pruned=True).first()["content"]
    at = int(bytes(content).rsplit(b"startxref\n", 1)[1].split()[0])
    assert bytes(content)[at:].startswith(b"xref") and b"\n10 0 obj" not in bytes(content)
    seen = pdf.inspected(own, raw=True)
    again = pdf.inspected(rewrite.assembled(rewrite.with_content(seen.objects, rewrite.encoded_content(seen.operations))))
    rows = lambda x: sorted(map(str, x.operations.select("scope", "idx", "operator", "operands", "matrix").collect()))
    assert rows(again) == rows(seen)


def test_foreground_and_states(spark, found):
    from pagewright.sources import rewrite

    own = found.filter(F.col("file").endswith("good.PDF"))
    pages = pdf.pages(own)
    ops = pdf.operations(own, pages)
    cut = pages.select("file", F.col("id").alias("scope"), F.lit(5).alias("boundary"))
    assert [r["name"] for r in rewrite.foreground_names(pdf.names(own), ops, cut).filter("holder = '3 0 R'").orderBy("name").collect()] == ["Fm1", "Im1"]
    table = '{"ExtGState": {"A": {}, "B": {"ca": 1.0, "BM": "/Normal"}, "C": {"CA": 0.5}, "D": {"SMask": {"S": 1}}, "E": {"SMask": "/None", "BM": ["/Multiply"]}, "F": null}}'
    rows = spark.createDataFrame([("f", "p", table)], "file string, id string, resources string")
    assert {r["name"]: r["opaque"] for r in rewrite.states(rows).collect()} == {"A": True, "B": True, "C": False, "D": False, "E": False, "F": False}


def test_snapshots_of_one_file(spark, found):
    from pagewright.operators import snapshots

    before = pdf.comparable(found.filter(F.col("file").endswith("good.PDF")))
    after = before.filter("id <> '10 0 R'").withColumn("sha256", F.when(F.col("id") == "5 0 R", "other").otherwise(F.col("sha256")))
    changes = snapshots.diff(before, after, ["file", "id"], ["value", "sha256"]).filter("change <> 'same'")
    assert {(r["id"], r["change"]) for r in changes.collect()} == {("10 0 R", "removed"), ("5 0 R", "changed")}


def test_publish(spark, tmp_path):
    from pagewright.sources.publish import output_name, publish, smaller

    rows = spark.createDataFrame([("a.PDF", 10, 5)], "file string, before long, after long")
    ok = {"size": smaller(F.col("before"), F.col("after"), F.lit(True))}
    path = str(tmp_path / "out")
    publish(rows, path, ["in"], ok, dry_run=True)
    publish(rows, path, ["in"], ok)
    assert spark.read.parquet(path).count() == 1 and rows.select(output_name(F.col("file"), "1080p")).first()[0] == "a_1080p.pdf"
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        publish(rows, path, ["in"], ok)
    with pytest.raises(ValueError, match="checks failed"):
        publish(rows.withColumn("after", F.lit(10)), path, [], ok)
    with pytest.raises(ValueError, match="source"):
        publish(rows, path, [path + "/"], ok)
