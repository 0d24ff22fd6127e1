"""Text of files in one pass is that of their relations, and writes and shuffles nothing."""

import random

import pytest

from pagewright.plans import QUERIES
from pagewright.sources import pdf, text
from test_text import build, stream

FONTS = {
    20: b"<< /Type /Font /Subtype /Type0 /ToUnicode 40 0 R /Encoding << /Differences [65 /B] >> >>", 21: b"<< /Type /Font /Encoding 50 0 R >>", 22: b"<< /Type /Font /ToUnicode /Identity-H /Encoding 50 0 R >>", 23: b"<< /Type /Font /Encoding /WinAnsiEncoding >>",
    24: b"<< /Type /NoFont /ToUnicode 40 0 R >>", 25: b"<< /Type /Font /Encoding << /Differences [/x 65 /B 1.5 /uni0043 [/D] (E) /F 99999999999 /G 7 70 /uniD800 /u110000 /xuni0041 /u10FFFF /u1F600 //H / -1 /a 200 /comma A] >> >>",
    26: b"<< /Type /Font /Encoding << /Differences 50 0 R >> >>", 27: b"<< /Type /Font /ToUnicode 41 0 R >>", 28: b"<< /Type /Font /ToUnicode 42 0 R /Subtype /Type0 >>", 29: b"<< /Type /Font /Encoding 99 0 R >>", 30: b"<< /Type /Font /ToUnicode 43 0 R >>", 31: b"[/Type /Font]",
    40: stream(b"beginbfrange <0041> <0050> <D83DDE00> <0045> <0047> [<0078> (y)] endbfrange beginbfchar <00> <0041> <01020304> <0041> endbfchar"), 41: stream(b"no map"), 42: b"<< /Filter /JBIG2Decode /Length 9 >>\nstream\nbeginbfch\nendstream",
    43: stream(b"beginbfrange <41> <5A> <0061> <30> <10> <0061> endbfrange beginbfchar <42> <D800> <43> <> endbfchar"), 50: b"<< /Type /Encoding /Differences [/none 65 /a /uni00DF 195 /Euro /x] >>",
}


def odd(seed):
    r = random.Random(seed)
    names = [f"F{k}" for k in range(20, 33)]
    shown = lambda: r.choice([b"(A\\303BCDEFGHI\\310) Tj", b"<0041004200450046D8> Tj", b"[(AB) 5 <4143>] TJ", b"() Tj", b"1 2 (x) \"", b"(y) '", b"Tj", b"q", b"Q", b"0 0 m", b"BI /W 1 ID a(b EI"])
    part = lambda: b" ".join(b"/%s 1 Tf " % r.choice([*names, "Gone"]).encode() * (r.random() < 0.7) + shown() for _ in range(r.randint(0, 12)))
    table = b"<< " + b" ".join(b"/%s %s" % (n.encode(), r.choice([b"%d 0 R" % r.randint(19, 33), b"<< /Type /Font >>", b"/Name"])) for n in names if r.random() < 0.9) + b" >>"
    page = b"<< /Type /Page /Parent 2 0 R /Contents %s %s >>"
    own = [b"", b"/Resources << /Font << /F20 23 0 R >> >>", b"/Resources 60 0 R", b"/Resources << /Font 61 0 R >>", b"/Resources << /Font 7 >>"]
    contents = [b"10 0 R", b"[10 0 R 11 0 R]", b"[11 0 R 12 0 R]", b"62 0 R", b"99 0 R", b"[]"]
    pages = {k: page % (r.choice(contents), r.choice(own)) for k in range(3, 8)}
    form = b"<< /Type /Page /Subtype /Form /Parent 2 0 R /Contents 10 0 R /Length 40 >>\nstream\n/F21 1 Tf (AB) Tj /F20 1 Tf (C) Tj (D) Tj \nendstream"
    return build({
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R 3 0 R 5 0 R 6 0 R 7 0 R 8 0 R] /Resources << /Font %s >> >>" % table, **pages, 8: form,
        10: stream(part()), 11: stream(part()), 12: b"<< /Filter /JBIG2Decode /Length 1 >>\nstream\nx\nendstream", 60: b"<< /Font 61 0 R >>", 61: table, 62: b"[11 0 R 10 0 R]", **FONTS,
    })


def test_text_in_one_pass_is_that_of_the_relations(spark):
    made = [(f"f{i}", bytearray(odd(i))) for i in range(60)] + [("empty", bytearray(b"")), ("null", None), ("bare", bytearray(build({1: b"(x)"}))), ("locked", bytearray(odd(1).replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 5 0 R")))]
    files = spark.createDataFrame(made, "file string, content binary").repartition(3)
    rows = lambda df: sorted((r["file"], r["page_number"], r["text"]) for r in df.collect())
    got, want = rows(text.file_text(files)), rows(text.page_text(*pdf.read(files)))
    assert got == want and len(got) == 420 and len({x[2] for x in got}) > 150


def test_names_that_are_no_character(spark):
    files = spark.createDataFrame([("f", bytearray(odd(0)))], "file string, content binary")
    found = pdf.objects(files)
    own = {r["lo"]: r["text"] for r in text.code_maps(found).filter("id = '25 0 R'").collect()}
    assert own == {65: "B", 67: "C", 70: "F", 72: "G", 73: "\U0010ffff", 74: "\U0001f600", 76: "H", -1: "a", 200: ",", 201: "A"}
    assert dict(text._differences([65, "/uniD800", "/uni00DFFF", "/u110000", "/u0D800", "/xuni0041", "/uniD7FF"])) == {70: "퟿"}


def test_contents_are_neither_written_nor_shuffled(spark, sf_dir, monkeypatch):
    def never(df, name):
        pytest.fail(f"{name} is written")

    monkeypatch.setattr(pdf, "written", never)
    monkeypatch.setattr(pdf, "spread", lambda docs: docs)
    plan = QUERIES["pdf_font_text"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
