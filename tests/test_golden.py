"""Known values of page geometry, budgets, plans and tables."""

import time

import pytest
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import numeric as N
from pagewright.functions import text as T
from pagewright.operators import classify as C
from pagewright.operators import ordered, planning, service
from pagewright.operators import snapshots as S


def one(spark, *columns):
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()
    return row[0] if len(columns) == 1 else tuple(row)


def matrix(*terms):
    return F.struct(*(F.lit(float(t)).alias(n) for t, n in zip(terms, "abcdef", strict=True)))


MM = 72 / 25.4


def test_units_and_resolution(spark):
    w, h, dpi, px, other = one(
        spark,
        G.points_to_mm(F.lit(595.2756)),
        G.points_to_mm(F.lit(841.8898)),
        G.effective_dpi(F.lit(10000), F.lit(50 * MM)),
        G.target_pixels(F.lit(50 * MM), F.lit(300)),
        G.effective_dpi(F.lit(1000), F.lit(250 * MM)),
    )
    assert w == pytest.approx(210, abs=1e-3) and h == pytest.approx(297, abs=1e-3)
    assert dpi == pytest.approx(5080, abs=0.01) and px == 591 and other == pytest.approx(101.6)


def test_turned_and_zero_matrices(spark):
    m = matrix(0, 100, -50, 0, 10, 20)
    w, h, box, back, none, nan = one(
        spark, *G.axis_lengths(m), G.unit_square_box(m), G.compose(m, G.invert(m)), G.invert(matrix(0, 0, 0, 0, 0, 0)), G.effective_dpi(F.lit(10), F.lit(float("nan")))
    )
    assert (w, h) == (100, 50) and box == [-40, 20, 10, 120] and none is None and nan is None
    assert [back[n] for n in "abcdef"] == pytest.approx([1, 0, 0, 1, 0, 0])


def test_budgets_and_targets(spark):
    half = lambda a, b, p: F.array(N.percent_scaled(F.lit(a), F.lit(p)), N.percent_scaled(F.lit(b), F.lit(p)))
    assert one(spark, half(3840, 2160, 50), half(2480, 3508, 75), half(2480, 3508, 10)) == ([1920, 1080], [1860, 2631], [248, 351])
    assert one(spark, G.fit_long_side(F.lit(595.276), F.lit(841.89), F.lit(1920))) == [1358, 1920]
    scale = lambda w, h: F.greatest(F.lit(w) * 2.0 / 6000, F.lit(h) * 2.0 / 4000)
    images = [G.scaled_image(F.lit(6000), F.lit(4000), scale(w, h)) for w, h in ((1000, 666), (500, 333), (50, 33))]
    assert one(spark, *images) == ([2000, 1333], [1000, 667], [100, 67])
    assert one(spark, N.mul_div(F.lit(2**62), F.lit(2**31), F.lit(2**32)), N.mul_div(F.lit(7), F.lit(1), F.lit(0))) == (2**61, None)


def pages_and_images(spark, pages, placed):
    p = spark.createDataFrame([("f", *x) for x in pages], "file string, page_number int, width_pt double, height_pt double")
    images, uses = [], []
    for i, (page, w, h, pw, ph) in enumerate(placed):
        images.append(("f", str(i), w, h, 1000))
        uses.append(("f", str(i), page, (pw, 0.0, 0.0, ph, 0.0, 0.0)))
    im = spark.createDataFrame(images, "file string, id string, pixel_width long, pixel_height long, encoded_bytes long")
    us = spark.createDataFrame(uses, "file string, id string, page_number int, matrix struct<a:double,b:double,c:double,d:double,e:double,f:double>")
    return p, im, us


def test_page_budgets(spark):
    a4 = (595.2756, 841.8898)
    pages = [(1, 1920.0, 1080.0), (2, *a4), (3, *a4), (4, *a4), (5, 1000.0, 700.0), (6, 1000.0, 700.0), (7, 100.0, 100.0)]
    placed = [
        (1, 6000, 3375, 1920.0, 1080.0),
        (2, 6000, 8485, *a4),
        (3, 1240, 1754, *a4),
        (3, 620, 877, a4[0] / 2, a4[1] / 2),
        (4, 1200, 1200, 72.0, 72.0),
        (5, 6000, 4200, 1000.0, 700.0),
        (6, 2400, 1680, 1000.0, 700.0),
        (6, 1200, 840, 500.0, 350.0),
    ]
    p, im, us = pages_and_images(spark, pages, placed)
    found = {r["page_number"]: (r["class"], r["full_pixels"], r["shown"]) for r in planning.page_budgets(p, planning.measured_placements(us, im)).collect()}
    assert found == {
        1: ("digital", [1920, 1080], True),
        2: ("physical", [2480, 3508], True),
        3: ("physical", [1240, 1754], True),
        4: ("physical", [2480, 3508], True),
        5: ("ambiguous", [4167, 2917], False),
        6: ("ambiguous", [2400, 1680], True),
        7: ("vector_only", None, False),
    }


def test_plan_classes(spark):
    p, im, us = pages_and_images(spark, [(1, 720.0, 720.0)], [(1, 610, 1320, 720.0, 720.0), (1, 7000, 7000, 720.0, 720.0)])
    lone = spark.createDataFrame([("f", "lone", 10, 10, 5)], im.schema)
    found = {r["id"]: r for r in planning.plan(im.unionByName(lone), us, p, dpi=96).collect()}
    assert found["0"]["class"] == "undersampled" and found["lone"]["class"] == "unknown" and found["lone"]["saved_bytes"] == 0
    assert found["1"]["class"] == "oversampled" and found["1"]["target"] == [960, 960] and found["1"]["severity"] == "high"
    assert found["1"]["after_bytes"] == 1000 * 960 * 960 // (7000 * 7000)
    p = p.withColumns({"rotation": F.lit(0), "budget": F.lit(None).cast("array<long>")})
    screen = {r["id"]: r["class"] for r in planning.plan(im, us, p, long_px=720).collect()}
    assert screen == {"0": "undersampled", "1": "oversampled"}
    assert planning.plan_summary(planning.plan(im, us, p)).first()["images"] == 2


def test_raster_invariants(spark):
    def raster(w, h, fmt="jpeg", colour="rgb", bits=8):
        return F.struct(
            F.lit(w).alias("w"), F.lit(h).alias("h"), matrix(1, 0, 0, 1, 0, 0).alias("matrix"), F.array(*(F.lit(x) for x in (0.0, 0.0, 1.0, 1.0))).alias("box"),
            F.lit(fmt).alias("format"), F.lit(colour).alias("colour"), F.lit(bits).alias("bits"),
        )

    b = raster(6000, 4000)
    good, bad, three, allowed = one(
        spark, S.violations(b, raster(496, 331)), S.violations(b, raster(496, 300)), S.violations(b, raster(496, 331, "png", "gray", 1)), S.violations(b, raster(496, 331, "png"), ("format",))
    )
    assert good == [] and bad == ["aspect_ratio"] and three == ["format", "colour", "bits"] and allowed == []


def test_reasons_and_encodings(spark):
    lists = [["FlateDecode", "DCTDecode"], [], ["LZWDecode"], ["ASCII85Decode"]]
    kinds = [C.encoding_kind(F.array(*(F.lit(x) for x in names)).cast("array<string>")) for names in lists]
    assert one(spark, *kinds) == ("jpeg", "raw", "lossless", "other")
    assert one(spark, C.first_reason((F.lit(True), "a"), (F.lit(None).cast("boolean"), "b"), (F.lit(False), "c"))) == "b"
    assert one(spark, C.profile_pixels(F.lit("4K")), C.profile_pixels(F.lit("source"))) == (3840, None)


def test_text_helpers(spark):
    assert one(spark, T.grouped_key(F.lit(" app-abcd efgh-1234 5678"), "app"), T.grouped_key(F.lit("short"))) == ("ABCD-EFGH-1234-5678", None)
    assert one(spark, T.object_id(F.lit(4), F.lit(0)), T.normalise_whitespace(F.lit(" a\t\n b "))) == ("4 0 R", "a b")
    value = 0
    for byte in "activation-é".encode():
        value = (value * 31 + byte) % 2**64
    assert int(one(spark, T.polynomial_hash(F.lit("activation-é")))) == value


def test_boundary_and_depth(spark):
    ops = ["q", "Do", "BT", "Tj", "ET", "Q", "BT", "Tj", "ET"]
    rows = spark.createDataFrame([("p", i, op) for i, op in enumerate(ops)], "page string, idx int, op string")
    marked = ordered.depth(rows, ["page"], ["idx"], F.col("op").isin("q", "BT"), F.col("op").isin("Q", "ET"))
    found = ordered.boundary(marked, ["page"], "idx", F.col("op") == "Do", F.col("depth") == 0).first()
    assert (found["last"], found["boundary"], found["rows"]) == (1, 6, 9)
    assert not ordered.unbalanced(marked, ["page"]).first()["underflow"]


def test_activations(spark):
    purchases = spark.createDataFrame([("k", "1.2.0", "paid", None), ("r", "1.0.0", "paid", "2024-01-01")], "key string, version string, status string, revoked_at string")
    active = spark.createDataFrame([("k", "d1", None), ("k", "d2", None), ("k", "d0", "2024-01-01")], "key string, device string, deactivated_at string")
    asked = spark.createDataFrame([("k", "d1", "1.9.9"), ("k", "d3", "1.0.0"), ("k", "d1", "2.0.0"), ("r", "x", "1.0.0"), ("none", "x", "1.0.0")], "key string, device string, version string")
    found = sorted((r["key"], r["device"], r["state"]) for r in service.activate(purchases, active, asked).collect())
    assert found == sorted([("k", "d1", "ACTIVE"), ("k", "d3", "ACTIVATION_LIMIT_REACHED"), ("k", "d1", "ENTITLEMENT_MISMATCH"), ("r", "x", "REVOKED"), ("none", "x", "INVALID")])


def test_rate_limit_stream(spark, tmp_path):
    from pagewright.streaming.events import limited, once

    rows = [("a", f"2024-01-01 00:00:{i:02d}") for i in range(12)] + [("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:00:05")]
    df = spark.createDataFrame(rows, "key string, at string").selectExpr("key", "timestamp(at) as at", "md5(concat(key, at)) as id")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = limited(once(stream, "id", "at"), "key", "at").writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).start()
    try:  # state with a processing-time timeout always has another batch to run, so the stream is never idle
        until = time.time() + 90
        while time.time() < until and spark.sql("select * from limited").count() < 14:
            time.sleep(0.3)
    finally:
        query.stop()
    found = {(r["key"], str(r["at"])): r["allowed"] for r in spark.sql("select * from limited").collect()}
    assert len(found) == 14 and sum(not x for x in found.values()) == 2
    assert not found["a", "2024-01-01 00:00:10"] and found["a", "2024-01-01 00:01:00"]


def test_ingest_can_be_replayed(spark, tmp_path):
    from pagewright.streaming.events import ingest

    batch = spark.createDataFrame([("e1", 1), ("e1", 1), ("e2", 2)], "id string, n int")
    sink = ingest(str(tmp_path / "t"), "id")
    sink(batch, 0)
    sink(batch, 0)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
