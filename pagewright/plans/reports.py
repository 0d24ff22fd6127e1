"""Queries of budgets, plans, exports, checks and service tables, each with a DuckDB statement for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import pixels
from ..functions import text as T
from ..operators import classify as C
from ..operators import exporting as X
from ..operators import composite, merging, nested, ordered, planning, service
from ..operators import snapshots as S
from ..sources import publish
from ..streaming import events as E
from ..streaming import purchases as P
from ..tables import shared_dir
from .registry import query as _query
from .registry import read as _read



def _matrix(w, h):  # noqa: ANN001, ANN202
    return F.struct(w.alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), h.alias("d"), F.lit(0.0).alias("e"), F.lit(0.0).alias("f"))


# --- budgets and plans -------------------------------------------------------------------------------------------------

_PAGES = """p as (select p_partkey as page_number, case p_partkey % 3 when 0 then 1920.0 when 1 then 210 * 72.0 / 25.4 else 500.5 end as w,
             case p_partkey % 3 when 0 then 1080.0 when 1 then 297 * 72.0 / 25.4 else 700.25 end as h,
             case p_partkey % 3 when 0 then 'digital' when 1 then 'physical' else 'ambiguous' end as kind from part)"""


@_query(f"""
with {_PAGES}, u as (select l_partkey as page_number, 72 + l_quantity * 6 as dpi, l_discount * 5 as s from lineitem where l_suppkey % 3 <> 0),
     e as (select page_number, dpi, least(greatest(w * (h * s) / (w * h), 0), 1) as c from u join p using (page_number)),
     k as (select page_number, dpi, c, least(c, 0.5)::decimal(20, 12) as weight from e where c >= 0.15 and dpi > 0),
     g as (select page_number, dpi, sum(weight) as weight from k group by all),
     r as (select page_number, dpi, sum(weight) over (partition by page_number order by dpi) as upto, sum(weight) over (partition by page_number) as total from g),
     m as (select page_number, least(min(dpi) filter (2 * upto >= total), 300) as median from r group by page_number),
     n as (select page_number, count(*) as samples, sum(c) as covered from k group by page_number),
     v as (select page_number, count(*) as uses from u group by page_number),
     o as (select *, case when uses is null then 'vector_only' else kind end as class from p left join v using (page_number) left join m using (page_number) left join n using (page_number))
select page_number, class, case class when 'digital' then round(w)::bigint when 'vector_only' then null else greatest(round(w / 72 * coalesce(median, 300)), 1)::bigint end as full_width,
       case class when 'digital' then round(h)::bigint when 'vector_only' then null else greatest(round(h / 72 * coalesce(median, 300)), 1)::bigint end as full_height,
       class in ('digital', 'physical') or (class = 'ambiguous' and coalesce(samples, 0) >= 2 and coalesce(covered, 0) >= 0.25) as shown from o
""")
def page_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % 3
    w = F.when(kind == 0, 1920.0).when(kind == 1, 210 * 72.0 / 25.4).otherwise(500.5)
    h = F.when(kind == 0, 1080.0).when(kind == 1, 297 * 72.0 / 25.4).otherwise(700.25)
    pages = _read(spark, sf_dir, "part").select(F.lit("f").alias("file"), F.col("p_partkey").alias("page_number"), w.alias("width_pt"), h.alias("height_pt"))
    uses = _read(spark, sf_dir, "lineitem").filter("l_suppkey % 3 <> 0").select(F.lit("f").alias("file"), F.col("l_partkey").alias("page_number"), (72 + F.col("l_quantity") * 6).alias("dpi"), (F.col("l_discount") * 5).alias("s"))
    sized = uses.join(pages, ["file", "page_number"])
    placed = sized.select("file", "page_number", "dpi", F.array(F.lit(0.0), F.lit(0.0), F.col("width_pt"), F.col("height_pt") * F.col("s")).alias("box"))
    found = planning.page_budgets(pages, placed)
    return found.select("page_number", "class", F.col("full_pixels")[0].alias("full_width"), F.col("full_pixels")[1].alias("full_height"), "shown")


_USES = """i as (select p_partkey as id, p_partkey % 4000 + 200 as w, p_size * 60 + 100 as h, (p_retailprice * 100)::bigint as n from part),
     u as (select l_partkey as id, 20 + l_quantity * 4 as a, 20.0 + l_linenumber * 50 as d, l_suppkey % 50 as page from lineitem)"""


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return _read(spark, sf_dir, "part").select(
        F.lit("f").alias("file"), key.alias("id"), (key % 4000 + 200).alias("pixel_width"), (F.col("p_size") * 60 + 100).cast("long").alias("pixel_height"), F.round(F.col("p_retailprice") * 100).cast("long").alias("encoded_bytes"),
        F.when(key % 5 == 0, F.array(F.lit("FlateDecode"))).otherwise(F.array(F.lit("DCTDecode"))).alias("filters"), F.when(key % 7 != 0, F.when(key % 11 == 0, 1).otherwise(8)).alias("bits_per_component"),
        F.when(key % 13 != 0, F.when(key % 17 == 0, "Indexed").otherwise("DeviceRGB")).alias("colour_space"), (key % 19 == 0).alias("masked"),
    )


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(
        F.lit("f").alias("file"), F.col("l_partkey").alias("id"), (F.col("l_suppkey") % 50).alias("page_number"), _matrix(20 + F.col("l_quantity") * 4, 20.0 + F.col("l_linenumber") * 50).alias("matrix")
    )


_SCREEN = f"""{_USES},
     s as (select page, case when page = 7 then null when page % 10 = 3 then (case when page % 20 = 3 then 900.0 else 600.0 end) / 960.0 else 1920.0 / 960 end as sx,
                  case when page = 7 then null when page % 10 = 3 then (case when page % 20 = 3 then 600.0 else 900.0 end) / 540.0 else 1920.0 / 960 end as sy from range(50) t(page)),
     x as (select id, case when count(*) = count(sx) then max(greatest(a * sx / w, d * sy / h)) end as k from u join i using (id) left join s using (page) group by id),
     t as (select i.*, k, case when k is null then null when w >= h then greatest(ceil(w * k), 1)::bigint else greatest(round(ceil(h * k)::bigint * w / h), 1)::bigint end as tw,
                  case when k is null then null when w >= h then greatest(round(ceil(w * k)::bigint * h / w), 1)::bigint else greatest(ceil(h * k), 1)::bigint end as th from i left join x using (id)),
     c as (select *, case when tw is null then 'unknown' when w < tw or h < th then 'undersampled' when w >= tw * 1.25 and h >= th * 1.25 then 'oversampled' else 'optimal' end as class from t)"""


def _screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_number")
    budget = F.when(page % 10 == 3, F.array(F.lit(900.0), F.lit(600.0)))
    pages = spark.range(50).select(F.lit("f").alias("file"), F.col("id").alias("page_number"), F.when(F.col("id") != 7, 960.0).alias("width_pt"), F.lit(540.0).alias("height_pt"), F.when(F.col("id") % 20 == 3, 180).otherwise(-90).alias("rotation"))
    pages = pages.withColumn("height_pt", F.when(page != 7, F.col("height_pt"))).withColumn("budget", budget)
    return planning.plan(_images(spark, sf_dir), _uses(spark, sf_dir), pages, long_px=1920)


@_query(f"""
with {_SCREEN}
select id, class, tw as target_width, th as target_height, case class when 'unknown' then 'resolution can''t be measured' when 'undersampled' then 'below the target on an axis' when 'optimal' then 'close to the target'
       else w || ' x ' || h || ' can become ' || tw || ' x ' || th end as reason from c
""")
def screen_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan for a long side in pixels; some pages have budgets of their own, turned with the page, and one has no size."""
    return _screen(spark, sf_dir).select("id", "class", F.col("target")[0].alias("target_width"), F.col("target")[1].alias("target_height"), "reason")


@_query(f"""
with {_SCREEN}
select count(*) as images, count(*) filter (class = 'oversampled') as oversampled, count(*) filter (class = 'optimal') as optimal, count(*) filter (class = 'undersampled') as undersampled,
       count(*) filter (class = 'unknown') as unknown, count(*) filter (class <> 'oversampled') as do_not_modify,
       sum(case when class = 'oversampled' then greatest(n - (n::hugeint * (tw * th) // (w * h))::bigint, 0) else 0 end)::bigint as saved_bytes from c
""")
def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.plan_summary(_screen(spark, sf_dir)).drop("file")


@_query(f"""
with {_USES}, x as (select id, max(greatest(a / w, d / h)) as k, max(w) as w, max(h) as h, max(a) as a, max(d) as d from u join i using (id) group by id),
     t as (select *, case when k < 1 then greatest(round(w * k), 1)::bigint end as tw, case when k < 1 then greatest(round(h * k), 1)::bigint end as th from x)
select id, tw as target_width, th as target_height, tw * 72.0 / a as screen_dpi_x, th * 72.0 / d as screen_dpi_y from t
""")
def point_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = planning.measured_placements(_uses(spark, sf_dir), _images(spark, sf_dir))
    targets = planning.point_targets(placed)
    both = targets.join(planning.screen_dpi(placed, targets), ["file", "id"])
    return both.select("id", F.col("target")[0].alias("target_width"), F.col("target")[1].alias("target_height"), "screen_dpi_x", "screen_dpi_y")


@_query("""
with x as (select p_brand as file, p_partkey % 4000 + 200 as w, p_size * 60 + 100 as h, p_retailprice as a, p_size * 20.0 as b from part),
     g as (select file, sum(w::bigint * h)::bigint as pixels, max(round(greatest(a, b)))::bigint as long_side from x group by file)
select file, pixels, long_side, least(pixels * 38 // 100 + 65536, 500000000)::bigint as estimate from g
""")
def hybrid_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("file"), (F.col("p_partkey") % 4000 + 200).alias("pixel_width"), (F.col("p_size") * 60 + 100).cast("long").alias("pixel_height"), F.col("p_retailprice").alias("width_pt"), (F.col("p_size") * 20.0).alias("height_pt")
    )
    both = X.raster_pixels(parts).join(X.source_long_side(parts), "file")
    return both.withColumn("estimate", planning.hybrid_estimate(F.col("pixels"), F.lit(500_000_000)))


# --- exports and checks --------------------------------------------------------------------------------------------------

_EXPORT = f"""{_SCREEN},
     e as (select *, case when class <> 'oversampled' then 'unchanged' when not (tw < w and th < h) or id % 5 = 0 or id % 7 = 0 or id % 11 = 0 or id % 13 = 0 or id % 17 = 0 or id % 19 = 0 then 'skipped' else 'approved' end as s from c),
     f as (select *, case when s = 'approved' then case when id % 2 = 0 then 'modified' else 'unchanged' end else s end as status from e)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = X.export_results(_screen(spark, sf_dir))
    sizes = results.filter("id % 2 = 0").select("file", "id", F.floor(F.col("encoded_bytes") / 2).alias("output_bytes"))
    return X.exported(results, sizes)


@_query(f"""
with {_EXPORT}
select id, status, case when status = 'modified' then n // 2 end as output_bytes, case when s = 'approved' and status = 'unchanged' then 're-encoding isn''t smaller' when s <> 'skipped' then null
       when not (tw < w and th < h) then 'target isn''t smaller on both sides' when id % 5 = 0 then 'encoding isn''t a single JPEG filter' when id % 7 = 0 or id % 11 = 0 then 'bit depth isn''t 8'
       when id % 13 = 0 then 'colour space is unknown' when id % 17 = 0 then 'colour space isn''t supported' else 'transparency masks aren''t supported' end as skipped_reason from f
""")
def export_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image's way through an export: by class, by the first check that fails, by whether its new bytes are fewer."""
    return _results(spark, sf_dir).select("id", "status", "output_bytes", "skipped_reason")


@_query(f"""
with {_EXPORT}
select count(*) as analysed, count(*) filter (status = 'modified') as candidates, count(*) filter (status = 'modified') as modified, count(*) filter (status = 'skipped') as skipped,
       count(*) filter (status = 'unchanged') as unchanged, coalesce(sum(greatest(n - (n::hugeint * (tw * th) // (w * h))::bigint, 0)) filter (s = 'approved'), 0)::bigint as estimated_saving from f
""")
def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.export_summary(_results(spark, sf_dir)).drop("file")


@_query("""
with p as (select p_partkey as page_number, case when p_partkey % 23 <> 5 then p_size * 10.0 end as bw, case when p_partkey % 29 <> 5 then p_size * 10.0 + case when p_partkey % 7 = 0 then 1 else 1e-9 end end as aw,
                  p_partkey % 6 as text, p_partkey % 6 + (p_partkey % 11 = 0)::int as after, p_partkey % 2 = 0 as merged, p_partkey % 4 as images from part)
select page_number, case when bw is null or aw is null then 'page count changed' when abs(bw - aw) > 1e-6 then 'geometry changed' when text <> after then 'other paint operations changed' else 'not exactly one merged image' end as problem
from p where (bw is not null or aw is not null) and (bw is null or aw is null or abs(bw - aw) > 1e-6 or text <> after or (merged and images <> 1))
""")
def merge_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size") * 10.0
    own = _read(spark, sf_dir, "part").select(F.lit("f").alias("file"), key.alias("page_number"), size.alias("width_pt"), F.lit(9.0).alias("height_pt"), F.lit(0).alias("rotation"), (key % 6).alias("text_operations"), F.lit(1).alias("vector_operations"), (key % 4).alias("image_placements"))
    n = F.col("page_number")
    after = own.withColumns({"width_pt": F.col("width_pt") + F.when(n % 7 == 0, 1.0).otherwise(1e-9), "text_operations": F.col("text_operations") + F.when(n % 11 == 0, 1).otherwise(0)})
    return X.merge_checks(own.filter("page_number % 23 <> 5"), after.filter("page_number % 29 <> 5"), own.filter("page_number % 2 = 0")).drop("file")


@_query("""
select p_partkey, array_to_string(list_filter([case when p_partkey % 5 = 0 then 'boxes' end, case when p_partkey % 7 = 0 then 'rotation' end, case when p_partkey % 3 <> 1 then 'one image' end,
       case when p_size * 0.5 > 12 then 'render error' end, case when p_partkey % 11 = 0 then 'text' end], lambda x: x is not null), ',') as failed,
       p_partkey % 5 <> 0 and p_partkey % 7 <> 0 and p_partkey % 3 = 1 and p_size * 0.5 <= 12 and p_partkey % 11 <> 0 as passed from part
""")
def flatten_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    side = lambda box, turned, text: F.struct(F.array(F.array(box)).alias("boxes"), turned.alias("rotation"), F.lit(None).cast("int").alias("annotations"), text.alias("text"))
    pages = _read(spark, sf_dir, "part").select(
        "p_partkey", side(F.lit(0.0), F.lit(0), F.concat(F.lit(" a\n b "), "p_name")).alias("b"), side(F.when(key % 5 == 0, 1.0).otherwise(0.0), F.when(key % 7 == 0, 90).otherwise(0), F.concat(F.lit("a b\t"), F.when(key % 11 == 0, "x ").otherwise(""), "p_name")).alias("a"),
        (key % 3).alias("images"), (F.col("p_size") * 0.5).alias("render_error"),
    )
    return X.flatten_checks(pages).select("p_partkey", F.array_join("failed", ",").alias("failed"), "passed")


@_query("""
with p as (select o_orderkey as file, sum(l_linenumber % 3)::bigint as text, sum(l_linenumber % 3 + (l_partkey % 40 = 0)::int)::bigint as expected, bool_and(l_partkey % 30 <> 0) as ratios from orders left join lineitem on l_orderkey = o_orderkey group by 1),
     s as (select o_orderkey as file, 300000 as input_bytes, floor(o_totalprice)::bigint as output_bytes, o_orderstatus <> 'P' as structural from orders),
     c as (select s.*, output_bytes > 0 as output_non_zero, output_bytes < input_bytes as output_smaller, coalesce(text > 0, false) as text_present, coalesce(text = expected, false) as text_expected, coalesce(ratios, false) as aspect_ratios from s join p using (file))
select file, structural, output_non_zero, output_smaller, text_present, text_expected, aspect_ratios, structural and output_non_zero and output_smaller and text_present and text_expected and aspect_ratios as passed,
       (300000 - output_bytes) * 100.0 / 300000 as reduction_percent from c
""")
def benchmark_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.lit(300_000).alias("input_bytes"), F.floor("o_totalprice").alias("output_bytes"), F.col("o_orderstatus").alias("status"))
    side = lambda w: F.struct(w.alias("width_pt"), F.lit(20.0).alias("height_pt"), (F.col("l_linenumber") % 3).alias("text_operations"))
    text = F.col("l_linenumber") % 3 + (F.col("l_partkey") % 40 == 0).cast("int")
    pages = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), side(F.lit(10.0)).alias("b"), side(F.when(F.col("l_partkey") % 30 == 0, 11.0).otherwise(10.0)).alias("a"), text.alias("foreground_text"))
    found = X.benchmark_verdict(sizes, pages, F.col("status") != "P")
    return found.drop("input_bytes", "output_bytes", "status", "text", "expected")


# --- paint order ---------------------------------------------------------------------------------------------------------

_A = [("q", []), ("cm", "600 0 0 400 100 100".split()), ("Do", ["/A"]), ("Q", [])]
_B = [("q", []), ("cm", "150 0 0 100 250 200".split()), ("Do", ["/B"]), ("Q", [])]
_CLIP = [("re", "100 100 600 400".split()), ("W", []), ("n", [])]
#: Contents by kind of page, and why their images can't become one.
_MERGES = [
    ([*_A, *_B, ("re", "0 0 5 5".split()), ("f", [])], None), ([*_A, ("S", []), *_B], "unsafe_content_order"), (_A, "fewer_than_two_direct_rasters"), ([*_B, *_A], "transparent_or_uncovered_union_area"),
    ([*_A, *_B, ("Q", [])], "unbalanced_graphics_state"), ([("cm", ["1"])], "invalid_matrix"), ([*_CLIP, *_A, *_B], None), ([*_CLIP, ("re", "0 0 5 5".split()), ("W", []), ("n", [])], "empty_clip"),
    ([("Do", ["/C"])], "missing_xobject"), ([("Do", ["/F"])], "form_xobject_not_supported"), ([("gs", ["/G"])], "transparency_or_extgstate_not_supported"), ([*_CLIP, ("cm", "0 100 -50 0 300 200".split()), ("Do", ["/A"])], "rotated_clipping_not_supported"),
]


_MERGE_SQL = f"""
with k as (select p_partkey, p_partkey % {len(_MERGES)} as kind from part)
select p_partkey::varchar as scope, case kind {" ".join(f"when {i} then '{reason}'" for i, (_, reason) in enumerate(_MERGES) if reason)} end as skipped_reason,
       case when kind in (0, 6) then 'would_merge' else 'skipped' end as status, case when kind in (0, 6) then '100,100,700,500' end as box, case when kind in (0, 6) then '600,400' end as pixels from k
"""


def _merged(spark: SparkSession, sf_dir: str, spread: bool) -> DataFrame:
    rows = [(kind, i, op, args, "image" if op == "Do" and args[0] in ("/A", "/B") else "other" if args == ["/F"] else None, False) for kind, (ops, _) in enumerate(_MERGES) for i, (op, args) in enumerate(ops)]
    known = F.broadcast(spark.createDataFrame(rows, "kind long, idx long, operator string, operands array<string>, drawn string, opaque boolean"))
    parts = _read(spark, sf_dir, "part").select(F.lit("f").alias("file"), F.col("p_partkey").cast("string").alias("scope"), (F.col("p_partkey") % len(_MERGES)).alias("kind"))
    ops = parts.join(known, "kind").select("file", "scope", "idx", "operator", "operands", F.col("drawn").alias("kind"), "opaque")
    found = merging.merge_plan(parts.select("file", "scope", F.lit(1920.0).alias("width_pt"), F.lit(1080.0).alias("height_pt")), ops, spread=spread)
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ",")
    return found.select("scope", "status", "skipped_reason", listed(F.col("merged_box")).alias("box"), listed(F.col("merged_pixels")).alias("pixels"))


@_query(_MERGE_SQL)
def merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, False)


@_query(_MERGE_SQL)
def merge_plan_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same plan without a scan of a page in one task."""
    return _merged(spark, sf_dir, True)


@_query("""
with l as (select conv_id, turn, role from conversations), b as (select conv_id, max(turn) filter (role = 'user') as last from l group by conv_id),
     c as (select conv_id, min(turn) + 1 as boundary from l join b using (conv_id) where role <> 'user' and turn >= last group by conv_id)
select conv_id, count(*) filter (coalesce(turn >= boundary, false)) as foreground, count(*) filter (not coalesce(turn >= boundary, false)) as background from l left join c using (conv_id) group by conv_id
""")
def boundary_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    cut = ordered.boundary(turns, ["conv_id"], "turn", F.col("role") == "user", F.col("role") != "user")
    both = ordered.split(turns, cut, ["conv_id"], "turn")
    return both.groupBy("conv_id").agg(F.count_if("foreground").alias("foreground"), F.count_if(~F.col("foreground")).alias("background"))


_OPS = ["Tj", "re", "b", "sh", "BI", "S", "Do", "h"]


@_query(f"""
with e as (select user_id, ({_OPS})[event_id % 8 + 1] as op from events)
select user_id, count(*) filter (op = 'Tj') as text, count(*) filter (op in ('re', 'S')) as vector, count(*) filter (op in ('b', 'sh', 'BI', 'S')) as artwork, count(*) filter (op in ('Tj', 'b', 'sh', 'S')) as paint from e group by user_id
""")
def operator_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.array(*(F.lit(x) for x in _OPS))[(F.col("event_id") % 8).cast("int")]
    roles = {"text": ordered.TEXT_SHOW, "vector": ordered.VECTOR_COUNTED, "artwork": ordered.ARTWORK, "paint": ordered.MERGE_PAINT}
    return _read(spark, sf_dir, "events").select("user_id", op.alias("op")).groupBy("user_id").agg(*(F.count_if(F.col("op").isin(names)).alias(role) for role, names in roles.items()))


# --- scalars -------------------------------------------------------------------------------------------------------------


@_query("""
select p_partkey, substr(repeat(p_name || ' ', 60), 1, 500) as cut, case when p_partkey % 4 = 0 then p_name || chr(65533) else p_name end as text, p_partkey || ' 0 R' as id, regexp_replace(p_name, '(?i)\\.pdf$', '') || '_1080p.pdf' as file,
       printf('%.2f MB', p_partkey * 12345 / 1e6) as size, case p_partkey % 6 when 0 then 1280 when 1 then 1920 when 2 then 2560 when 3 then 3840 end as long_px,
       (p_size > 0) and (p_partkey % 2 = 0 or p_size < 25) as publishable, epoch_ms(p_partkey * 86400000) as at, '{"a":' || p_partkey || ',"b":"x"}' as json, coalesce(case when p_partkey % 3 = 0 then 1 end, 2) as kept from part
""")
def scalar_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.col("p_partkey"), F.col("p_name")
    broken = F.when(key % 4 == 0, F.concat(name.cast("binary"), F.unhex(F.lit("FF")))).otherwise(name.cast("binary"))
    profiles = F.array(*(F.lit(x) for x in ("720P", "1080p", "1440p", "4K", "source", "other")))[(key % 6).cast("int")]
    first = F.when(key % 3 == 0, F.create_map(F.lit("k"), F.lit(1))).otherwise(F.create_map(F.lit("j"), F.lit(1)))
    return _read(spark, sf_dir, "part").select(
        "p_partkey", T.truncated(F.repeat(F.concat(name, F.lit(" ")), F.lit(60))).alias("cut"), T.lossy_utf8(broken).alias("text"), T.object_id(key, F.lit(0)).alias("id"), publish.output_name(name, "1080p").alias("file"),
        T.megabytes(key * 12_345).alias("size"), C.profile_pixels(profiles).alias("long_px"), publish.smaller(F.lit(25), F.col("p_size"), key % 2 == 1).alias("publishable"), F.timestamp_seconds(key * 86_400).cast("timestamp_ntz").alias("at"),
        F.to_json(F.struct(key.alias("a"), F.lit("x").alias("b"))).alias("json"), F.coalesce(F.try_element_at(first, F.lit("k")), F.lit(2)).alias("kept"),
    )


@_query("""
with recursive t as (select c_custkey as key, c_custkey || '-' || c_nationkey as s from customer),
     h as (select key, s, 0 as i, 0::hugeint as v from t union all select key, s, i + 1, (v * 31 + ascii(s[i + 1])) % 18446744073709551616::hugeint from h where i < length(s))
select key, (v % 172801)::bigint - 86400 as jitter, v::varchar as hash from h where i = length(s)
""")
def verification_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("c_custkey").cast("string"), F.lit("-"), F.col("c_nationkey").cast("string"))
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), T.jitter(text).alias("jitter"), T.polynomial_hash(text).cast("string").alias("hash"))


@_query("""
with p as (select p_partkey as id, p_partkey % 3 + 1 as a, p_size % 7 as b from part)
select id, case when a * 2.0 - b * b = 0 then null else round(2.0 / (a * 2.0 - b * b), 9) end as ia, case when b = 0 then null else 72.0 * a / b end as dpi,
       array_to_string([greatest(least(0, b), 1), greatest(1, 0), least(a + 2, 3), 2], ',') as clip from p
""")
def inverse_and_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.col("p_partkey") % 3 + 1).cast("double"), (F.col("p_size") % 7).cast("double")
    m = F.struct(a.alias("a"), b.alias("b"), b.alias("c"), F.lit(2.0).alias("d"), F.lit(0.0).alias("e"), F.lit(0.0).alias("f"))
    clip = G.intersect_boxes(F.array(F.lit(1.0), F.lit(0.0), a + 2, F.lit(5.0)), F.array(F.lit(0.0), F.lit(1.0), F.lit(3.0), F.lit(2.0)))
    return _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.round(G.invert(m)["a"], 9).alias("ia"), G.effective_dpi(a, b).alias("dpi"), F.array_join(F.transform(clip, lambda x: x.cast("long").cast("string")), ",").alias("clip")
    )


@_query("""
with e as (select vec_id, list_transform(range(1, 17), lambda i: (abs(embedding[i]) * 1000)::bigint % 256) as p from embeddings),
     s as (select vec_id, p, unnest(range(2)) as x, unnest([0, 0]) as z from e), t as (select vec_id, p, x, y from s, range(2) r(y))
select vec_id, x::bigint as x, y::bigint as y, floor((p[y * 8 + x * 2 + 1] + p[y * 8 + x * 2 + 2] + p[y * 8 + x * 2 + 5] + p[y * 8 + x * 2 + 6]) / 4.0 + 0.5)::bigint as value from t
""")
def bilinear_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of four by four at half the size: each pixel lies between four."""
    # products of floats are floats, and halves go to the even neighbour
    values = F.transform(F.slice("embedding", 1, 16), lambda x: (F.rint(F.abs(x) * F.lit(1000).cast("float")).cast("long") % 256).cast("int"))
    own = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), values.alias("pixels"), *(F.lit(n).alias(c) for c, n in (("pixel_width", 4), ("pixel_height", 4), ("channels", 1), ("tw", 2), ("th", 2))))
    small = pixels.resized(own, "tw", "th", "bilinear").select("id", F.posexplode("pixels").alias("i", "value"))
    return small.select(F.col("id").alias("vec_id"), (F.col("i") % 2).cast("long").alias("x"), F.floor(F.col("i") / 2).alias("y"), F.col("value").cast("long").alias("value"))


# --- service tables and streams --------------------------------------------------------------------------------------------

_SERVICE = """a as (select o_orderkey as activation_id, o_custkey as key, sha256('t' || o_orderkey) as token_hash, case when o_orderstatus = 'P' then 5 end as deactivated_at from orders),
     p as (select c_custkey as key, case when c_custkey % 10 <> 0 then 'paid' else 'open' end as status, case when c_custkey % 7 = 0 then 1 end as revoked_at from customer),
     r as (select o_orderkey + (case when o_orderkey % 9 = 0 then 100000000 else 0 end) as activation_id, 't' || (o_orderkey + (o_orderkey % 4 = 1)::int) as token, o_orderkey % 13 + 9 as m from orders)"""


def _service(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders, key = _read(spark, sf_dir, "orders"), F.col("o_orderkey")
    activations = orders.select(key.alias("activation_id"), F.col("o_custkey").alias("key"), F.sha2(F.concat(F.lit("t"), key.cast("string")), 256).alias("token_hash"), F.when(F.col("o_orderstatus") == "P", 5).alias("deactivated_at"))
    customer = F.col("c_custkey")
    purchases = _read(spark, sf_dir, "customer").select(customer.alias("key"), F.when(customer % 10 != 0, "paid").otherwise("open").alias("status"), F.when(customer % 7 == 0, 1).alias("revoked_at"), F.lit("1.0").alias("version"))
    token = F.concat(F.lit("t"), (key + F.when(key % 4 == 1, 1).otherwise(0)).cast("string"))
    requests = orders.select((key + F.when(key % 9 == 0, 100_000_000).otherwise(0)).alias("activation_id"), token.alias("token"), (key % 13 + 9).alias("at"))
    return activations, purchases, requests


@_query(f"""
with {_SERVICE}
select r.activation_id, case when a.activation_id is null or sha256(token) <> token_hash or deactivated_at is not null then 'INVALID' when p.key is null then 'INVALID' when revoked_at is not null then 'REVOKED' when status = 'paid' then 'ACTIVE' else 'INVALID' end as state
from r left join a using (activation_id) left join p using (key)
""")
def activation_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.verified(*_service(spark, sf_dir))


@_query(f"""
with {_SERVICE}
select a.activation_id, case when deactivated_at is null and sha256(token) = token_hash then m else deactivated_at end as deactivated_at from a left join r using (activation_id)
""")
def activation_deactivate(spark: SparkSession, sf_dir: str) -> DataFrame:
    activations, _, requests = _service(spark, sf_dir)
    return service.deactivated(activations, requests)[0].select("activation_id", "deactivated_at")


@_query(f"""
with {_SERVICE}, n as (select key, count(*) as n from a where deactivated_at is null group by key),
     q as (select o_custkey as key, o_orderkey + (case when o_orderkey % 3 = 0 then 0 else 100000000 end) as device, case when o_orderkey % 8 = 0 then '2.1' else '1.9' end as version from orders),
     k as (select key, activation_id as device from a where deactivated_at is null)
select q.key, q.device, case when p.key is null then 'INVALID' when revoked_at is not null then 'REVOKED' when status <> 'paid' then 'INVALID' when version = '2.1' then 'ENTITLEMENT_MISMATCH'
       when k.device is not null or coalesce(n, 0) < 4 then 'ACTIVE' else 'ACTIVATION_LIMIT_REACHED' end as state from q left join p using (key) left join n using (key) left join k on k.key = q.key and k.device = q.device
""")
def activation_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    activations, purchases, _ = _service(spark, sf_dir)
    key = F.col("o_orderkey")
    asked = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), (key + F.when(key % 3 == 0, 0).otherwise(100_000_000)).alias("device"), F.when(key % 8 == 0, "2.1").otherwise("1.9").alias("version"))
    return service.activate(purchases, activations.withColumnRenamed("activation_id", "device"), asked, limit=4)


@_query(f"""
with {_SERVICE}, h as (select distinct o_custkey % 50 as key, o_orderkey % 17 as device from orders where o_orderkey % 29 = 0),
     b as (select key, count(*) as n from h group by key),
     q as (select o_orderkey as request_id, o_custkey % 50 as key, o_orderkey % 31 as device, case when o_orderkey % 8 = 0 then '2.1' else '1.9' end as version, o_orderdate as t from orders),
     j as (select q.*, coalesce(b.n, 0) as n, h.key is not null as held, case when p.key is null then 'INVALID' when revoked_at is not null then 'REVOKED' when status <> 'paid' then 'INVALID' when version = '2.1' then 'ENTITLEMENT_MISMATCH' end as refused
           from q left join p using (key) left join b using (key) left join h on h.key = q.key and h.device = q.device),
     f as (select key, device, any_value(n) as n, min((t, request_id)) as o from j where refused is null and not held group by all),
     s as (select *, n + row_number() over (partition by key order by o) as slot from f qualify slot <= 9)
select request_id, j.key, j.device, coalesce(refused, case when held or slot is not null then 'ACTIVE' else 'ACTIVATION_LIMIT_REACHED' end) as state,
       (j.n + (select count(*) from s as x where x.key = j.key and x.o <= (j.t, j.request_id)))::bigint as active
from j left join s on s.key = j.key and s.device = j.device
""")
def activation_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with many requests for each purchase, from devices that ask again, for nine slots."""
    _, purchases, _ = _service(spark, sf_dir)
    orders, key = _read(spark, sf_dir, "orders"), F.col("o_orderkey")
    held = orders.filter(key % 29 == 0).select((F.col("o_custkey") % 50).alias("key"), (key % 17).alias("device"), F.lit(None).cast("int").alias("deactivated_at"))
    requests = orders.select(key.alias("request_id"), (F.col("o_custkey") % 50).alias("key"), (key % 31).alias("device"), F.when(key % 8 == 0, "2.1").otherwise("1.9").alias("version"), F.col("o_orderdate").alias("at"))
    return service.allocated(purchases, held, requests, limit=9)


@_query("""
with l as (select user_id, (ts, event_id) as o, case event_id % 97 when 0 then 'INVALID' when 1 then 'REVOKED' else case when event_id % 3 = 0 then 'fine' else 'failed' end end as k from events),
     e as (select user_id, arg_min(k, o) as state, min(o) as o from l where k in ('INVALID', 'REVOKED') group by user_id),
     b as (select l.* from l left join e using (user_id) where e.o is null or l.o < e.o),
     s as (select user_id, max(o) as o from b where k = 'fine' group by user_id),
     f as (select user_id, count(*) as failures from b left join s using (user_id) where k = 'failed' and (s.o is null or b.o > s.o) group by user_id)
select user_id, coalesce(state, 'ACTIVE') as state, coalesce(failures, 0) as failures from (select distinct user_id from events) left join e using (user_id) left join f using (user_id)
""")
def revalidation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    code = F.when(n % 97 == 0, 401).when(n % 97 == 1, 403).when(n % 3 == 0, 200).otherwise(F.when(n % 2 == 0, 200).otherwise(500))
    answer = F.when(n % 97 == 0, "INVALID").when(n % 97 == 1, "REVOKED").when(n % 3 == 0, "ACTIVE").otherwise("INVALID")
    looks = _read(spark, sf_dir, "events").select("user_id", "ts", "event_id", code.alias("code"), (n % 97 > 1).alias("valid"), answer.alias("answer"))
    return service.revalidations(looks, ["user_id"], ["ts", "event_id"])


def _streamed(rows: DataFrame, name: str, parts: int) -> tuple[DataFrame, str]:
    """``rows`` as a stream of files, and a folder for its output; the files are written to the shared folder first."""
    folder = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.repartition(parts).write.parquet(f"{folder}/in")
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), folder


@_query("select event_id, user_id, event_type from events where event_type in ('purchase', 'signup')")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted events of a stream that delivers some of them twice, in several batches, once each."""
    events = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    stream, folder = _streamed(events.unionByName(events.filter("event_id % 3 = 0")), "events", 4)
    run = E.ingested(E.accepted(stream, "event_type", ["purchase", "signup"]), "event_id", f"{folder}/out", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "user_id", "event_type")


_EVENTS = """p as (select o_orderkey::varchar as id, (o_custkey % 40)::varchar as key, case when o_orderkey % 4 = 0 then 'purchase' else 'refund' end as kind, o_orderkey % 4 <> 3 as whole, o_orderdate::timestamp as t,
                  case when o_orderkey % 5 < 2 then 1 else 2 end as part from orders)"""


@_query(f"""
with {_EVENTS}, e as (select * from p union all select id, key, kind, whole, t, 2 from p where part = 1 and id::bigint % 3 = 0),
     n as (select *, row_number() over (partition by key, id order by part) as seen, row_number() over (partition by key order by part, t, id) as i from e),
     b as (select key, min(i) as bought from n where seen = 1 and kind = 'purchase' group by key),
     o as (select n.*, case when seen > 1 then 'duplicate' when kind = 'purchase' then case when i = bought then 'recorded' else 'known' end when not whole then 'noted'
                            when bought is null or i < bought then 'waiting' else 'revoked' end as outcome from n left join b using (key))
select key, outcome, count(*) as events, min(id) as first_id, max(id) as last_id from o group by all
""")
def stream_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of purchases and refunds that come in two runs, the second from the first one's checkpoint with some events again."""
    key = F.col("o_orderkey")
    kind = F.when(key % 4 == 0, "purchase").otherwise("refund")
    events = _read(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 40).cast("string").alias("key"), key.cast("string").alias("event_id"), kind.alias("kind"), (key % 4 != 3).alias("full"), F.col("o_orderdate").cast("timestamp").alias("at"), F.when(key % 5 < 2, 1).otherwise(2).alias("part"),
    )
    first, second = (events.filter(F.col("part") == i).drop("part") for i in (1, 2))
    P.keep_state(spark)
    folder = f"{shared_dir(spark)}/purchases-{uuid.uuid4().hex}"
    for rows in (first, second.unionByName(first.filter("event_id % 3 = 0"))):
        rows.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        run = P.purchases(stream, late="9000 days", remember_days=30_000).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("key", "outcome").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@_query("""
with recursive e as materialized (select user_id::varchar as key, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as i from events),
     w as (select key, i, t, t as opened, 1 as n from e where i = 1
           union all select e.key, e.i, e.t, case when e.t >= w.opened + 7200000000 then e.t else w.opened end, case when e.t >= w.opened + 7200000000 then 1 else w.n + 1 end from w join e on e.key = w.key and e.i = w.i + 1)
select key, count(*) as attempts, count(*) filter (n <= 2) as allowed from w group by key
""")
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of a stream with two for each anchored window of two hours, by state."""
    events = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    stream, folder = _streamed(events, "attempts", 1)
    run = E.limited(stream, "key", "at", allowed=2, window_s=7200).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("key").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("allowed").alias("allowed"))


@_query("""
with b as (select o_custkey % 150 as page, o_orderkey as z, o_orderkey % 37 as x0, floor(o_totalprice)::bigint % 23 as y0, o_orderkey % 37 + o_custkey % 12 as x1, floor(o_totalprice)::bigint % 23 + o_orderkey % 9 as y1 from orders),
     p as (select page, z, x, unnest(range(y0, y1)) as y from (select *, unnest(range(x0, x1)) as x from b)),
     v as (select page, max(z) as z, x, y from p group by page, x, y), a as (select page, z, count(*) as area from v group by all)
select page, z, coalesce(area, 0)::bigint as area from b left join a using (page, z)
""")
def visible_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to see of each box of a page when later ones are painted over it."""
    key, price = F.col("o_orderkey"), F.floor("o_totalprice")
    x, y = key % 37, price % 23
    boxes = _read(spark, sf_dir, "orders").select((F.col("o_custkey") % 150).alias("page"), key.alias("z"), x.alias("x0"), y.alias("y0"), (x + F.col("o_custkey") % 12).alias("x1"), (y + key % 9).alias("y1"))
    return composite.visible_areas(boxes, ["page"])


@_query("""
with o as (select o_orderkey, o_custkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as i from orders)
select o_custkey, o_orderkey, o_totalprice from o where i = 1
""")
def first_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("down"))
    first = orders.groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "o_totalprice"), F.struct("down", "o_orderkey")).alias("first"))
    return first.select("o_custkey", "first.*")


@_query("select event_id, user_id, value from events order by value desc, event_id limit 10")
def newest_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of ten rows by an order without ties."""
    return _read(spark, sf_dir, "events").select("event_id", "user_id", "value").orderBy(F.desc("value"), "event_id").limit(10)


@_query("""
with b as (select doc_id, md5(coalesce(text, '')) as h from documents where doc_id % 5 <> 1), a as (select doc_id, md5(coalesce(text, '')) as h from documents where doc_id % 7 <> 1)
select b.doc_id from b where not exists (select 1 from a where a.doc_id = b.doc_id)
""")
def removed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id")
    return S.missing(docs.filter("doc_id % 5 <> 1"), docs.filter("doc_id % 7 <> 1"), ["doc_id"])


@_query("""
select p_partkey, bool_and(l_extendedprice * 100 <= p_retailprice * 100 * l_quantity * 1.0000001 and l_quantity >= 1) as passed, count(*) filter (not (l_extendedprice * 100 <= p_retailprice * 100 * l_quantity * 1.0000001 and l_quantity >= 1)) as failed
from part join lineitem on l_partkey = p_partkey group by p_partkey
""")
def target_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    ok = (F.col("l_extendedprice") * 100 <= F.col("p_retailprice") * 100 * F.col("l_quantity") * 1.0000001) & (F.col("l_quantity") >= 1)
    return S.verdict(both.withColumn("ok", ok), ["p_partkey"], "ok")


@_query("""
with p as (select o_custkey as file, floor(o_totalprice)::bigint % 7 as t, o_orderkey % 13 + 1 as v, o_orderkey % 3 as i from orders)
select file, sum(t)::bigint as text_operations, sum(v)::bigint as vector_operations, sum(i)::bigint as image_placements from p group by file
""")
def document_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), (F.floor("o_totalprice") % 7).alias("text_operations"), (F.col("o_orderkey") % 13 + 1).alias("vector_operations"), (F.col("o_orderkey") % 3).alias("image_placements"))
    return X.totals(own)




@_query("""
with recursive e as materialized (select user_id as k, event_id, row_number() over (partition by user_id order by ts, event_id) as i, event_id % 6 as op, (event_id % 11 - 5)::double as x, (event_id % 7 - 3)::double as y from events),
     w as (select distinct k, 0::bigint as i, [1, 0, 0, 1, 0, 0]::double[] as m, []::double[][] as s, null::bigint as event_id, null::bigint as op from e
           union all select e.k, e.i, case e.op when 1 then case when len(s) > 0 then s[-1] else m end when 2 then [m[3], m[4], -m[1], -m[2], x * m[1] + y * m[3] + m[5], x * m[2] + y * m[4] + m[6]]
                                          when 3 then [-m[1], -m[2], m[3], m[4], x * m[1] + y * m[3] + m[5], x * m[2] + y * m[4] + m[6]] else m end,
                            case e.op when 0 then list_append(s, m) when 1 then s[:-2] else s end, e.event_id, e.op from w join e on e.k = w.k and e.i = w.i + 1)
select event_id, m[1]::bigint as a, m[2]::bigint as b, m[3]::bigint as c, m[4]::bigint as d, m[5]::bigint as e, m[6]::bigint as f from w where op > 3
""")
def nested_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrices in force along each user's events, of which some save and restore them."""
    events = _read(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    placed = ordered.running_sum(events, ["user_id"], ["ts", "event_id"], F.lit(1).cast("long"), "at")
    n = F.col("event_id")
    x, y, zero, one = (n % 11 - 5).cast("double"), (n % 7 - 3).cast("double"), F.lit(0.0), F.lit(1.0)
    matrix = lambda *terms: F.struct(*(t.alias(name) for t, name in zip(terms, "abcdef", strict=True)))
    step = F.when(n % 6 == 2, matrix(zero, one, -one, zero, x, y)).when(n % 6 == 3, matrix(-one, zero, zero, one, x, y))
    found = nested.in_force(placed.select("user_id", "at", "event_id"), ["user_id"], "at", n % 6 == 0, n % 6 == 1, step)
    return found.filter("event_id % 6 > 3").select("event_id", *(F.col(f"matrix.{t}").cast("long").alias(t) for t in "abcdef"))
