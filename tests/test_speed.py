"""What files repeat is read and written once, and gives what reading word by word gives."""

import random

from pagewright.sources import formats, pdf, rewrite, syntax, validation


def _file(n):
    parts = ["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F << /Type /Font >> >> >> >>", f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {n} 9.5] >>"]
    return ("%PDF-1.4\n" + "".join(f"{i} 0 obj\n{x}\nendobj\n" for i, x in enumerate(parts, 1)) + "trailer\n<< /Root 1 0 R >>\n").encode()


def test_repeated_dictionaries_are_read_and_written_once(spark):
    import pyarrow as pa

    syntax._repeated.cache_clear()
    files = pa.RecordBatch.from_pydict({"file": [f"f{i}" for i in range(50)], "content": [_file(i) for i in range(50)]})
    found = [x for batch in pdf._parse(iter([files]), raw=True) for x in batch.to_pylist()]
    assert syntax._repeated.cache_info().misses == 53 and syntax._repeated.cache_info().hits == 147
    rewrite._repeated.cache_clear()
    for i in range(50):
        rows = [(x["file"], x["id"], x["number"], x["generation"], x["value"], None, x["stream"], False) for x in found if x["file"] == f"f{i}"]
        assert b"/MediaBox [0 0 %d 9.5]" % i in rewrite._file(rows, True)
    assert rewrite._repeated.cache_info().hits == 147


def test_dictionaries_are_what_their_words_are(monkeypatch):
    r, words = random.Random(1), [b"<<", b">>", b"[", b"]", b"/A", b"1", b"-2.5", b"R", b"03 00 R", b"(a)", b"(a\\)b)", b"(a(b)c)", b"<6 1>", b"%x\n", b"true", b"obj", b"12a", b"{", b"<< /X [1 (s)] >>"]
    texts = [r.choice([b" ", b""]).join([b"<<", *(r.choice(words) for _ in range(r.randint(0, 8))), b">> 7 0 R"]) for _ in range(4000)]
    own = [repr(syntax.value_at(x, 0)) for x in texts]
    monkeypatch.setattr(syntax, "_plain", lambda data: None)
    monkeypatch.setattr(syntax, "_repeated", lambda data: None)
    assert own == [repr(syntax.value_at(x, 0)) for x in texts]


def test_data_of_inline_images_is_no_syntax():
    found = list(pdf.content_operations(b"q BI /W 1 ID a(b%c EI Q (d\\)) Tj"))
    assert [x[0] for x in found] == ["q", "BI", "ID", "EI", "Q", "Tj"] and found[3][1] == ["a(b%c"] and found[5][4] == [b"d)".hex()]


def test_files_of_a_partition_share_a_batch_of_the_parts_asked_for(tmp_path):
    import pytest

    for i in range(20):
        (tmp_path / f"f{i:02}.pdf").write_bytes(_file(i))
    read = lambda **options: [x for own in [formats.ObjectReader({"path": str(tmp_path), **options})] for p in own.partitions() for x in own.read(p)]
    (whole,), (few,) = read(), read(parts="sha256")
    assert whole.num_rows == few.num_rows == 80 and whole.column("value").null_count == 0
    assert few.column("value").null_count == 60 and few.column("number").equals(whole.column("number"))
    with pytest.raises(ValueError, match="unknown"):
        read(parts="sha1")


def test_validation_writes_no_duplicates_of_images(spark, monkeypatch):
    seen = pdf.inspected(spark.createDataFrame([("f", bytearray(_file(1)))], "file string, content binary"), raw=True)
    monkeypatch.setattr(pdf, "first_seen", None)
    report = validation.export_validation(seen, seen, spark.createDataFrame([], "file string, id string")).collect()
    assert [(r["file"], r["passed"], r["errors"]) for r in report] == [("f", True, [])]


def test_files_are_brought_to_disk_together(tmp_path, monkeypatch):
    import os

    import pytest

    events = []
    monkeypatch.setattr(formats, "TOGETHER", 3)
    monkeypatch.setattr(formats.os, "fsync", lambda fd: events.append(os.readlink(f"/proc/self/fd/{fd}")))
    writer = formats.FileWriter(str(tmp_path), ["file", "content"])
    staged = writer.write(iter([{"file": f"f{i}.pdf", "content": _file(i)} for i in range(7)]))
    assert events == [path for path, _ in staged.moves] and len(set(events)) == 7
    writer.commit([staged])
    assert sorted(os.listdir(tmp_path)) == [f"f{i}.pdf" for i in range(7)] and (tmp_path / "f6.pdf").read_bytes() == _file(6)
    with pytest.raises(ValueError, match="bad.pdf has no objects"):
        writer.write(iter([{"file": "good.pdf", "content": _file(1)}, {"file": "bad.pdf", "content": b"%PDF-1.4"}]))


def test_json_of_repeated_dictionaries_is_made_once(monkeypatch):
    made, encoded = [], pdf._encoded
    monkeypatch.setattr(pdf, "_encoded", lambda value: made.append(value) or encoded(value))
    syntax._repeated.cache_clear()
    values = [list(pdf._File(_file(1)).values("f", False, frozenset({"value"})))[1:] for _ in range(3)]
    assert values[0] == values[2] and values[0][0][4] == '{"Type": "/Catalog", "Pages": "2 0 R"}'
    assert sum(isinstance(x, syntax.Repeated) for x in made) == 3


def _shared(n):
    parts = ["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R 6 0 R] /Count 2 >>", "<< /Type /Page /Parent 2 0 R /Contents [4 0 R 5 0 R] >>"]
    parts += [f"<< /Length {len(x)} {more}>>\nstream\n{x}\nendstream" for x, more in ((f"{n} 0 0 1 0 0 cm q Q", ""), ("51205120512051>", "/Filter /ASCIIHexDecode "))]
    parts += ["<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", "<< /Type /XObject /Subtype /Form /Length 3 >>\nstream\nq Q\nendstream"]
    return ("%PDF-1.4\n" + "".join(f"{i} 0 obj\n{x}\nendobj\n" for i, x in enumerate(parts, 1)) + "trailer\n<< /Root 1 0 R >>\n").encode()


def test_new_contents_go_to_their_files_without_a_join_of_streams(spark):
    from pyspark.sql import functions as F

    files = spark.createDataFrame([(f"f{i}", bytearray(_shared(i))) for i in range(5)] + [("bad", bytearray(b"%PDF-1.4"))], "file string, content binary")
    found = pdf.objects(files, raw=True).persist()
    rows = [("f1", "3 0 R", b"n"), ("f1", "6 0 R", b"n"), ("f2", "7 0 R", b"B"), ("f3", "3 0 R", b""), ("f4", "9 0 R", b"x"), ("none", "3 0 R", b"x"), ("bad", "3 0 R", b"x")]
    contents = spark.createDataFrame([(f, s, bytearray(c)) for f, s, c in rows], "file string, scope string, content binary")
    told = lambda df: {r["file"]: bytes(r["content"]) for r in df.collect()}
    own = rewrite.assembled(found, contents=contents)
    assert told(own) == told(rewrite.assembled(rewrite.with_content(found, contents)))
    again = {(r["file"], r["id"]): (bytes(r["stream"]), r["value"]) for r in pdf.objects(own, raw=True).filter("stream is not null").collect()}
    assert again["f1", "4 0 R"][0] == b"n" and again["f1", "5 0 R"] == (b"", '{"Length": 0}') and again["f2", "7 0 R"][0] == b"B" and again["f4", "4 0 R"][0] == b"4 0 0 1 0 0 cm q Q"
    assert again["f3", "4 0 R"][0] == b"" and len(told(own)) == 5
    edited = found.withColumn("edits", F.when(F.col("id") == "5 0 R", F.create_map(F.lit("X"), F.lit("1"))))
    assert told(rewrite.assembled(edited, contents=contents)) == told(rewrite.assembled(rewrite.with_content(edited, contents)))
    assert own.rdd.getNumPartitions() == rewrite.SORTED * int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join" in x]
    assert len(joins) == 2 and all("Inner" in x for x in joins)
