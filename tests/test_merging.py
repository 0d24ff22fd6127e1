import random

import pytest

from pagewright.operators.merging import merge_plan

A = [("q", []), ("cm", "600 0 0 400 100 100".split()), ("Do", ["/A"]), ("Q", [])]
B = [("q", []), ("cm", "150 0 0 100 250 200".split()), ("Do", ["/B"]), ("Q", [])]
PATH = [("re", "0 0 5 5".split()), ("f", [])]
TEXT = [("BT", []), ("Tj", ["x"]), ("ET", [])]
CLIP = [("re", "100 100 600 400".split()), ("W", []), ("n", [])]

CASES = {
    "plain": ([*A, *B, *PATH, *TEXT], None),
    "interleaved": ([*A, *PATH, *B], "unsafe_content_order"),
    "one": (A, "fewer_than_two_direct_rasters"),
    "none": ([], "fewer_than_two_direct_rasters"),
    "uncovered": ([*B, *A], "transparent_or_uncovered_union_area"),
    "extra Q": ([*A, *B, ("Q", [])], "unbalanced_graphics_state"),
    "short matrix": ([("cm", ["1"])], "invalid_matrix"),
    "words in a rectangle": ([("re", ["a", "0", "1", "1"])], "invalid_rectangle"),
    "clip without a path": ([("W", [])], "complex_clipping_not_supported"),
    "even-odd": ([*PATH[:1], ("W*", [])], "complex_clipping_not_supported"),
    "clipped": ([*CLIP, *A, *B], None),
    "empty clip": ([*CLIP, ("re", "0 0 5 5".split()), ("W", []), ("n", [])], "empty_clip"),
    "hidden": ([("re", "0 0 5 5".split()), ("W", []), ("n", []), *A], "image_fully_clipped"),
    "turned": ([*CLIP, ("cm", "0 100 -50 0 300 200".split()), ("Do", ["/A"])], "rotated_clipping_not_supported"),
    "missing": ([("Do", ["/C"])], "missing_xobject"),
    "form": ([("Do", ["/F"])], "form_xobject_not_supported"),
    "nameless": ([("Do", [])], "invalid_xobject_invocation"),
    "transparent": ([("gs", ["/G"])], "transparency_or_extgstate_not_supported"),
    "opaque": ([("gs", ["/O"]), *A, *B], None),
}


def operations(spark, cases):
    kinds = {"/A": "image", "/B": "image", "/F": "other", "/D": "direct", "/I": "invalid", "/U": "image"}
    schema = "file string, scope string, idx long, operator string, operands array<string>, kind string, opaque boolean, undecoded string"
    rows = [("f", name, i, op, args, kinds.get(args[0]) if op == "Do" and args else None, args == ["/O"] if op == "gs" else None, "unknown_colour_space" if args == ["/U"] else None) for name, ops in cases.items() for i, (op, args) in enumerate(ops)]
    return spark.createDataFrame(rows, schema)


def random_operations(rng):
    """Mostly harmless operations, so that long runs of them pass before something forbids a merge."""
    number = lambda: str(rng.choice([0, 1, 5, 40, 100, -3]))
    pool = [("q", []), ("q", []), ("Q", []), ("Q", []), ("n", []), ("n", []), ("W", []), ("Do", ["/A"]), ("gs", ["/O"]), ("x", [])]
    rare = [("W*", []), ("Do", ["/F"]), ("Do", ["/D"]), ("Do", ["/I"]), ("Do", ["/U"]), ("Do", ["/Z"]), ("Do", ["(A)"]), ("Do", []), ("gs", ["/G"]), ("gs", []), ("f", []), ("cm", ["1", "z", "0", "1", "0", "0"]), ("re", ["1"]), ("re", ["a", "0", "1", "1"])]
    out = []
    for _ in range(rng.randrange(4, 40)):
        pick = rng.random()
        if pick < 0.25:
            out.append(("cm", [*map(str, rng.choice([(1, 0, 0, 1), (2, 0, 0, 3), (0, 1, -1, 0)])), number(), number()]))
        elif pick < 0.45:
            out.append(("re", [number(), number(), "300", rng.choice(["300", "0"])]))
        else:
            out.append(rng.choice(rare) if pick > 0.97 else rng.choice(pool))
    return out


def test_spread_events_are_those_of_the_scan(spark):
    from pagewright.operators.merging import merge_events, spread_events

    rng = random.Random(12)
    cases = {name: ops for name, (ops, _) in CASES.items()} | {f"r{i}": random_operations(rng) for i in range(300)}
    ops = operations(spark, cases).repartition(4).persist()
    told = lambda df: {(r["scope"], r["idx"]): (r["reason"], r["box"] and [x + 0.0 for x in r["box"]]) for r in df.collect()}
    want = told(merge_events(ops))
    assert len({x[0] for x in want.values()}) > 14
    assert told(spread_events(ops)) == want


@pytest.fixture(scope="module")
def plans(spark):
    kinds = {"/A": "image", "/B": "image", "/F": "other"}
    rows = [("f", name, i, op, args, kinds.get(args[0]) if op == "Do" and args else None, args == ["/O"] if op == "gs" else None) for name, (ops, _) in CASES.items() for i, (op, args) in enumerate(ops)]
    ops = spark.createDataFrame(rows, "file string, scope string, idx long, operator string, operands array<string>, kind string, opaque boolean")
    pages = spark.createDataFrame([("f", name, 1920.0, 1080.0) for name in CASES], "file string, scope string, width_pt double, height_pt double")
    return {r["scope"]: r for r in merge_plan(pages, ops).collect()}


@pytest.mark.parametrize("name", CASES)
def test_reasons(plans, name):
    found = plans[name]
    assert found["skipped_reason"] == CASES[name][1]
    if CASES[name][1] is None:
        assert (found["status"], found["raster_objects"], found["merged_box"], found["merged_pixels"]) == ("would_merge", 2, [100, 100, 700, 500], [600, 400])


def test_pages_in_one_range_are_scanned_there_and_cut_ones_are_spread(spark, monkeypatch):
    from pagewright.operators import merging

    rng = random.Random(7)
    cases = {name: ops for name, (ops, _) in CASES.items()} | {f"r{i}": random_operations(rng) for i in range(100)} | {"long": [x for _ in range(40) for x in random_operations(rng) if x in (("q", []), ("Q", []), ("n", []), ("x", []))]}
    ops = operations(spark, cases).repartition(4).persist()
    seen, spread = [], merging.spread_events
    monkeypatch.setattr(merging, "spread_events", lambda rows: seen.append(rows.select("scope").distinct().count()) or spread(rows))
    told = lambda df: {(r["scope"], r["idx"]): (r["reason"], r["box"] and [x + 0.0 for x in r["box"]]) for r in df.collect()}
    want = told(merging.merge_events(ops))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert told(merging.ranged_events(ops)) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert 0 < seen.pop() < 4 and not seen
    assert told(merging.ranged_events(ops.coalesce(1).limit(0))) == {}


def test_deep_nesting_is_scanned_in_proportion():
    from pagewright.operators import merging

    state = merging.State()
    for op in ["q"] * 200_000 + ["Q"] * 200_000:
        state, event = merging._event(state, {"operator": op, "operands": [], "file": "f", "scope": "s", "idx": 0})
        assert event is None
    assert state == merging.State()
