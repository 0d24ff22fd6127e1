"""Equal boxes that cover each other."""

from pagewright.operators import composite


def test_equal_boxes_are_one_interval_of_a_strip(spark, monkeypatch):
    rows = [(1, z, 0, 0, 4, 4) for z in range(500)] + [(1, 700, 2, 0, 6, 4), (2, 1, 0, 0, 4, 4)]
    boxes = spark.createDataFrame(rows, "page int, z long, x0 long, y0 long, x1 long, y1 long")
    areas = composite.visible_areas(boxes, ["page"])
    got = {(r["page"], r["z"]): r["area"] for r in areas.collect()}
    assert got == {(1, z): 8 if z == 499 else 0 for z in range(500)} | {(1, 700): 16, (2, 1): 16}
    plan = areas._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "max(z" in plan[plan.index("FlatMapGroupsInArrow") :]
