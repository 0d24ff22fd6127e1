"""Matrices in force, visible areas and the weighted median against plain loops, with keys over many ranges."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import aggregates, composite, nested
from pagewright.sources.pdf import _times, content_operations

TURNS = [(0, 1, -1, 0), (1, 0, 0, 1), (-1, 0, 0, 1), (0, -1, 1, 0)]
SCHEMA = "key string, at long, op string, m struct<a:double,b:double,c:double,d:double,e:double,f:double>"


def sequences(rng, sizes):
    """Rows and what is in force after each, by a stack."""
    rows, want = [], {}
    for key, (n, ops) in sizes.items():
        now, saved = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), []
        for at in range(n):
            op, m = rng.choice(ops), None
            if op == "q":
                saved.append(now)
            elif op == "Q":
                now = saved.pop() if saved else now
            elif op == "cm":
                m = tuple(map(float, (*rng.choice(TURNS), rng.randrange(-5, 6), rng.randrange(-5, 6))))
                now = _times(m, now)
            want[key, at] = now
            rows.append((key, at, op, m))
    return rows, want


def found(df):
    return {(r["key"], r["at"]): tuple(r["matrix"]) for r in nested.in_force(df, ["key"], "at", F.col("op") == "q", F.col("op") == "Q", F.col("m")).collect()}


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_matrices_in_force(spark, many_parts):
    rng = random.Random(9)
    sizes = {"deep": (400, ["q", "q", "q", "Q", "cm", "x"]), "shut": (200, ["q", "Q", "Q", "cm"]), None: (50, ["q", "Q", "cm", "x"]), "flat": (900, ["cm", "x"]), "one": (1, ["cm"])}
    rows, want = sequences(rng, sizes)
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == want
    assert found(spark.createDataFrame([], SCHEMA)) == {}


def test_one_bracket_around_all(spark, many_parts):
    rows = [("k", 0, "q", None)] + [("k", i, "cm", (1.0, 0.0, 0.0, 1.0, 1.0, 2.0)) for i in range(1, 3000)] + [("k", 3000, "Q", None), ("k", 3001, "x", None)]
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert all(got["k", i] == (1, 0, 0, 1, i, 2 * i) for i in range(3000)) and got["k", 3001] == (1, 0, 0, 1, 0, 0)


def test_contents_of_a_page(spark):
    """The same matrices as the reader of contents gives for Do."""
    rng = random.Random(2)
    words = []
    for _ in range(400):
        op = rng.choice(["q", "Q", "cm", "Do"])
        words.append({"cm": f"{' '.join(map(str, rng.choice(TURNS)))} {rng.randrange(9)} {rng.randrange(9)} cm", "Do": "/X Do"}.get(op, op))
    ops = list(content_operations(" ".join(words).encode()))
    rows = [("p", i, op, tuple(map(float, operands)) if op == "cm" else None) for i, (op, operands, *_) in enumerate(ops)]
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert all(got["p", i] == matrix for i, (op, _, matrix, *_) in enumerate(ops) if op == "Do")


def test_prefixes():
    rng = np.random.default_rng(1)
    steps = rng.integers(-1, 2, (300, 6)).astype(float)
    starts = rng.random(300) < 0.05
    starts[0] = True
    now, want = None, []
    for step, start in zip(steps, starts, strict=True):
        now = tuple(step) if start else _times(tuple(step), now)
        want.append(now)
    assert np.array_equal(nested.prefixes(steps[:40], starts[:40]), np.array(want[:40]))


def test_visible_areas(spark):
    rng = random.Random(6)
    rows = []
    for page in ("a", None, "b"):
        for z in range(60):
            x, y = rng.randrange(-20, 20), rng.randrange(30)
            rows.append((page, z, x, y, x + rng.randrange(-1, 15), y + rng.randrange(0, 15)))
    rows += [("c", 1, 0, 0, 5, 5), ("c", 2, 0, 0, 5, 5), ("d", 1, None, 0, 5, 5), ("e", 3, 0, 0, 10**9, 10**9), ("e", 4, 1, 1, 10**9 - 1, 10**9 - 1)]
    want = {}
    for page, own in itertools.groupby(rows[:180], key=lambda r: r[0]):
        top = {}
        for _, z, x0, y0, x1, y1 in own:
            want[page, z] = 0
            top.update({(x, y): z for x in range(x0, x1) for y in range(y0, y1)})
        for z in top.values():
            want[page, z] += 1
    want |= {("c", 1): 0, ("c", 2): 25, ("d", 1): 0, ("e", 3): 4 * 10**9 - 4, ("e", 4): (10**9 - 2) ** 2}
    df = spark.createDataFrame(rows, "page string, z long, x0 long, y0 long, x1 long, y1 long").repartition(4)
    got = {(r["page"], r["z"]): r["area"] for r in composite.visible_areas(df, ["page"]).collect()}
    assert got == want


def test_pixel_boxes(spark):
    df = spark.createDataFrame([([10.0, 20.0, 30.0, 50.0], [0.0, 0.0, 100.0, 100.0], [200, 50]), ([-5.0, 0.0, 500.0, 33.3], [0.0, 0.0, 100.0, 100.0], [10, 10])], "box array<double>, u array<double>, t array<int>")
    assert [r["p"] for r in df.select(composite.pixel_box(F.col("box"), F.col("u"), F.col("t")).alias("p")).collect()] == [[20, 10, 60, 25], [0, 0, 10, 4]]


def test_weighted_median_of_spread_keys(spark, many_parts):
    rng = random.Random(8)
    rows = [("hot", rng.randrange(500), rng.randrange(4)) for _ in range(4000)] + [(f"k{i}", v, w) for i in range(20) for v, w in [(3, 1), (i, 2), (9, 0)]] + [(None, 5, 1), ("zero", 7, 0), ("zero", 8, 0)]
    got = {r["key"]: r["median"] for r in aggregates.weighted_lower_median(spark.createDataFrame(rows, "key string, v int, w long"), ["key"], "v", "w").collect()}
    for key in {r[0] for r in rows}:
        own = sorted((v, w) for k, v, w in rows if k == key)
        total, run = sum(w for _, w in own), 0
        for v, w in own:
            run += w
            if 2 * run >= total:
                assert got[key] == v, key
                break
