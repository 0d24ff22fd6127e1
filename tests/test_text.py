"""Code maps of fonts and strings' bytes, on small maps with every odd case."""

import pytest
from pyspark.sql import functions as F

from pagewright.sources import pdf, text
from pagewright.sources.syntax import string_bytes


@pytest.mark.parametrize(("written", "data"), [("(a\\)b)", b"a)b"), ("(\\n\\r\\t\\b\\f\\q)", b"\n\r\t\b\x0cq"), ("(\\0531\\53\\1234)", b"+1+S4"), ("(a\\\nb\\\r\nc)", b"abc"), ("(x\\)", b"x\\"), ("<4 1 4>", b"A@"), ("<>", b""), ("()", b"")])
def test_string_bytes(written, data):
    assert string_bytes(written) == data


def test_ranges_of_a_map():
    data = b"1 begincodespacerange <00> <FFFF> endcodespacerange 3 beginbfchar <01> <0041> <0002> <D83DDE00> (x) <0043> endbfchar 4 beginbfrange <03> <05> <0061> <06> <08> [<0078> (y) <00790079>] <09> <07> <0041> <0a> endbfrange beginbfrange <0b> <0c> [<0031>"
    assert list(text.code_ranges(data)) == [(1, 1, 1, "A"), (2, 2, 2, "\U0001f600"), (1, 0x78, 0x78, "C"), (1, 3, 5, "a"), (1, 6, 6, "x"), (1, 7, 7, "�"), (1, 8, 8, "yy"), (1, 9, 7, "A")]
    assert list(text.code_ranges(b"")) == list(text.code_ranges(b"endbfchar ] [ beginbfrange")) == []


def test_glyphs():
    assert [text.glyph(x) for x in ("A", "space", "uni20AC", "u1F600", "at", "bracketleft", "asciitilde", "nine", "f_i", "u110000")] == ["A", " ", "€", "\U0001f600", "@", "[", "~", "9", None, None]


def build(objects):
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer << /Root 1 0 R >>"


def stream(data):
    return b"<< /Length %d >>\nstream\n%s\nendstream" % (len(data), data)


def test_text_of_pages(spark):
    content = b"BT /A 1 Tf <000100020003> Tj (odd) Tj /B 1 Tf (AB\\303C) Tj [(A) 5 (B)] TJ /C 1 Tf (\\351) Tj /Gone 1 Tf (g) Tj () Tj ET"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 9 0 R] >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /A 5 0 R /B 6 0 R /C 7 0 R /D << /Type /Font >> >> >> >>",
        4: stream(content), 5: b"<< /Type /Font /Subtype /Type0 /ToUnicode 8 0 R >>", 6: b"<< /Type /Font /Encoding 10 0 R >>", 7: b"<< /Type /Font /ToUnicode /Identity-H >>",
        8: stream(b"beginbfrange <0001> <0002> <D83DDE00> endbfrange"), 9: b"<< /Type /Page /Parent 2 0 R >>", 10: b"<< /Type /Encoding /Differences [/none 65 /a /uni00DF 195 /Euro /x] >>",
    }
    seen = pdf.inspected(spark.createDataFrame([("f", bytearray(build(objects))), ("g", bytearray(b""))], "file string, content binary"))
    got = {r["page_number"]: r["text"] for r in text.page_text(seen.objects, seen.pages, seen.operations).collect()}
    assert got == {1: "\U0001f600\U0001f601� � aß\xc3C aß é g  ", 2: ""}
    assert seen.operations.filter(F.col("font").isNotNull()).count() == 7
