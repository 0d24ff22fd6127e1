"""Cross-references, indirect lengths, trailers and reachability on small files in bytes."""

import zlib

import pytest
from pyspark.sql import functions as F

from pagewright.sources import pdf, rewrite
from pagewright.sources.table import ObjectTable, sections


def saved(objects, trailer=b"/Root 1 0 R", start=b"%PDF-1.7\n", prev=None, freed=()):
    """``start`` and numbered objects with a table after them."""
    out, places = start, {}
    for number, body in objects.items():
        places[number] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    at = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n"
    for number in sorted([*places, *freed]):
        out += b"%d 1\n" % number + (b"%010d 00000 n \n" % places[number] if number in places else b"0000000000 00001 f \n")
    more = b"" if prev is None else b" /Prev %d" % prev
    return out + b"trailer\n<< /Size 99 %s%s >>\nstartxref\n%d\n%%%%EOF\n" % (trailer, more, at)


def start_of(data):
    return int(data.rsplit(b"startxref\n", 1)[1].split()[0])


BASE = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [] /Count 0 >>"}
TRICKY = b"abc endstream def\n"


def indirect(data, size=b"9 0 R"):
    return BASE | {8: b"<< /Length %s >>\nstream\n%s\nendstream" % (size, data), 9: b"%d" % len(data)}


@pytest.mark.parametrize("whole", [True, False])
def test_lengths_of_other_objects(whole):
    data = saved(indirect(TRICKY))
    data = data if whole else data.replace(b"startxref", b"lost")
    assert ObjectTable(data).objects[8, 0][1] == TRICKY


@pytest.mark.parametrize("end", [b"\n", b"\r\n", b"\r"])
@pytest.mark.parametrize("size", [b"77 0 R", b"5000", b"/x", b"-1", b"1 0 R", b"2"])
def test_unusable_lengths_drop_one_line_end(end, size):
    body = BASE | {8: b"<< /Length %s >>\nstream\nabc\n%sendstream" % (size, end)}
    for data in (saved(body), saved(body).replace(b"startxref", b"lost")):
        assert ObjectTable(data).objects[8, 0][1] == b"abc\n"


def test_newest_entries_stand():
    first = saved(BASE | {5: b"(old)", 6: b"(gone)"}, b"/Root 1 0 R /Info 5 0 R")
    second = saved({5: b"(new)", 7: b"<< /Type /Catalog /Pages 2 0 R >>"}, b"/Root 7 0 R /Info 5 0 R", first, start_of(first), freed=[6])
    third = saved({6: b"(again)"}, b"/Root 7 0 R", second, start_of(second))
    table = ObjectTable(second)
    assert table.objects[5, 0][0] == {"(": "(new)"} and (6, 0) not in table.objects and table.trailer == {"Root": "7 0 R", "Info": "5 0 R"}
    assert [x.kind for x in sections(third)] == ["table"] * 3
    assert ObjectTable(third).objects[6, 0][0] == {"(": "(again)"} and "Info" not in ObjectTable(third).trailer
    shifted = b"junk before\n" + second
    assert ObjectTable(shifted).objects == table.objects


def test_streams_of_references_and_objects():
    inner = b"2 0 5 %d " % (len(b"<< /Type /Pages /Kids [] /Count 0 >> ")) + b"<< /Type /Pages /Kids [] /Count 0 >> (packed)"
    head = inner.index(b"<<")
    out, at = b"%PDF-1.7\n", {}
    for number, body in {1: BASE[1], 3: b"<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length 4 0 R >>\nstream\n%s\nendstream" % (head, zlib.compress(inner)), 4: b"%d" % len(zlib.compress(inner))}.items():
        at[number] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    at[6] = len(out)
    rows = [(0, 0, 255), (1, at[1], 0), (2, 3, 0), (1, at[3], 0), (1, at[4], 0), (2, 3, 1), (1, at[6], 0)]
    raw = b"".join(bytes([k]) + a.to_bytes(2, "big") + bytes([b]) for k, a, b in rows)
    up = b"".join(b"\x02" + bytes((x - y) % 256 for x, y in zip(raw[i : i + 4], raw[i - 4 : i] if i else bytes(4), strict=True)) for i in range(0, len(raw), 4))
    packed = zlib.compress(up)
    out += b"6 0 obj\n<< /Type /XRef /Size 7 /W [1 2 1] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >> /Length %d >>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n" % (len(packed), packed, at[6])
    table = ObjectTable(out)
    assert sorted(n for n, _ in table.objects) == [1, 2, 3, 4, 5, 6] and table.objects[5, 0] == ({"(": "(packed)"}, None) and table.trailer == {"Root": "1 0 R"}
    cut = out.replace(packed, packed[: len(packed) // 2] + b"\x00" * (len(packed) - len(packed) // 2))
    assert {n for n, _ in ObjectTable(cut).objects} == {1, 2, 3, 4, 5, 6}  # by a scan


@pytest.mark.parametrize(
    "spoil",
    [
        lambda d: d.replace(b"startxref\n", b"startxref\n9"),
        lambda d: d.replace(b"0000000009", b"0000000010"),
        lambda d: d.replace(b"/Size 99", b"/Size 99 /Prev %d" % start_of(d)),
        lambda d: d.replace(b"/Size 99", b"/Size 99 /Prev 3"),
        lambda d: d.replace(b"/Size 99", b"/Size 99 /XRefStm 12"),
        lambda d: d.replace(b"trailer\n<<", b"trailer\n[["),
        lambda d: d.replace(b"/Root 1 0 R", b"/Root 2 0 R"),
        lambda d: d[: d.index(b"trailer")],
    ],
)
def test_broken_chains_are_scanned(spoil):
    data = saved(BASE | {5: b"(x)"})
    table = ObjectTable(spoil(data))
    assert set(table.objects) == {(1, 0), (2, 0), (5, 0)} and table.trailer.get("Root") == "1 0 R"


def test_encryption_is_the_trailers():
    with pytest.raises(ValueError, match="encrypted"):
        ObjectTable(saved(BASE, b"/Root 1 0 R /Encrypt 2 0 R"))
    assert ObjectTable(saved(BASE | {3: b"<< /Note (/Encrypt 5 0 R) >>"})).objects


def frame(spark, *files):
    return spark.createDataFrame([(f"f{i}", bytearray(x)) for i, x in enumerate(files)], "file string, content binary")


def test_rewriting_keeps_the_newest_document(spark):
    page = lambda parent, width: b"<< /Type /Page /Parent %d 0 R /MediaBox [0 0 %d 10] >>" % (parent, width)
    first = saved({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: page(2, 11), 4: b"<< /Title (old) >>"}, b"/Root 1 0 R /Info 4 0 R /ID [<aa> <bb>]")
    more = {7: b"<< /Type /Catalog /Pages 8 0 R >>", 8: b"<< /Type /Pages /Kids [9 0 R 10 0 R] /Count 2 >>", 9: page(8, 12), 10: page(8, 13), 4: b"<< /Title (new) /By 11 0 R >>", 11: b"(someone)"}
    second = saved(more, b"/Root 7 0 R /Info 4 0 R /ID [<aa> <cc>]", first, start_of(first))
    before = pdf.objects(frame(spark, first, second), raw=True).persist()
    for pruned, kept in ((False, 9), (True, 6)):
        after = pdf.objects(rewrite.assembled(before, pruned)).filter("file = 'f1'").persist()
        assert after.filter("number is not null").count() == kept
        assert [r["width_pt"] for r in pdf.pages(after).orderBy("page_number").collect()] == [12.0, 13.0]
        assert {(r["key"], r["value"]) for r in pdf.info(after).collect()} == {("Title", "(new)"), ("By", "11 0 R")}
        assert '"<cc>"' in after.filter("id = 'trailer'").first()["value"]


def test_reachability(spark):
    """Cycles, a long chain, edits, values that aren't dictionaries, and files without a catalogue."""
    chain = {i: b"<< /Next %d 0 R /Prev %d 0 R >>" % (i + 1, i - 1) for i in range(10, 300)}
    body = BASE | {1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 10 0 R >>", 300: b"[301 0 R [302 0 R]]", 301: b"303 0 R", 302: b"(304 0 R)", 303: b"<< /A << /B [305 0 R 999 0 R] >> >>", 304: b"1", 305: b"2", 306: b"<< /Lost 1 0 R >>"}
    found = pdf.objects(frame(spark, saved(body | chain), b"%PDF-1.4\n5 0 obj\n<< /A 6 0 R >>\nendobj\n6 0 obj 1 endobj"), raw=True).persist()
    got = {(r["file"], int(r["id"].split()[0])) for r in rewrite.reachable(found).collect()}
    assert got == {("f0", n) for n in [1, 2, *range(10, 304), 305]}
    edited = found.withColumn("edits", F.when((F.col("number") == 11), F.create_map(F.lit("Next"), F.lit(None).cast("string"), F.lit("New"), F.lit('["306 0 R"]'))))
    assert {int(r["id"].split()[0]) for r in rewrite.reachable(edited).collect()} == {1, 2, 10, 11, 306}
    assert "Recurs" not in rewrite.reachable(found)._jdf.queryExecution().toString()


def test_revisions_of_bad_files(spark):
    rows = pdf.revisions(frame(spark, b"", b"%PDF-1.7", saved(BASE))).collect()
    assert [(r["file"], r["revision"], r["kind"], r["used"], r["freed"]) for r in rows] == [("f2", 1, "table", [1, 2], [])]
