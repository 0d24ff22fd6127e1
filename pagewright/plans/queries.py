"""Queries over the driver's tables, each applying an operator, with a DuckDB statement for the same rows.

The tables hold no document files, so these are analogues: the same operators on other data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import numeric as N
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import classify as C
from ..operators import dedup, ordered, planning, service
from ..operators import snapshots as S
from .registry import query as _query
from .registry import read as _read

# --- duplicates, attribution, references -----------------------------------------------------------------------------


@_query("""
with h as (select doc_id, sha256(text) as sha256, octet_length(encode(text))::bigint as encoded_bytes from documents where text is not null),
     f as (select sha256, min(doc_id) as first from h group by sha256)
select doc_id, sha256, encoded_bytes, case when doc_id <> first then first end as duplicate_of from h join f using (sha256)
""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").filter("text is not null")
    hashed = docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("encoded_bytes"))
    return dedup.first_seen(hashed, "sha256", ["doc_id"], "doc_id")


@_query("""
with h as (select sha256(text) as s, doc_id, octet_length(encode(text))::bigint as n from documents where text is not null),
     d as (select *, row_number() over (partition by s order by doc_id) > 1 as again from h)
select count(*) filter (again)::bigint as duplicates, coalesce(sum(n) filter (again), 0)::bigint as duplicate_bytes from d
""")
def duplicate_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.saved_by_duplicates(exact_duplicates(spark, sf_dir), "encoded_bytes")


@_query("""
select source, coalesce(sum(n_chars) filter (lang = 'en'), 0)::bigint as en_bytes, coalesce(sum(n_chars) filter (lang = 'fr'), 0)::bigint as fr_bytes,
       greatest(200000 - coalesce(sum(n_chars) filter (lang in ('en', 'fr')), 0), 0)::bigint as unknown_bytes
from documents group by source
""")
def byte_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("source", "lang", "n_chars").withColumn("size", F.lit(200_000))
    return A.attribution(docs, ["source"], "lang", "n_chars", ["en", "fr"], "size")


@_query("""
with u as (select l_partkey, count(*) as n, list_sort(list(distinct l_suppkey)) as s from lineitem group by l_partkey)
select p_partkey, coalesce(n, 0)::bigint as reference_count, coalesce(n, 0) > 1 as reused, coalesce(array_to_string(s, ','), '') as places
from part left join u on l_partkey = p_partkey
""")
def asset_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part").select("p_partkey")
    uses = _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").cast("string").alias("key"), "l_suppkey")
    found = A.references(parts, uses, "p_partkey", "l_suppkey")
    return found.withColumn("places", F.array_join(F.col("places").cast("array<string>"), ","))


# --- strict aggregates ---------------------------------------------------------------------------------------------


@_query("""
with x as (select l_orderkey, case when l_partkey % 7 <> 0 then l_quantity end as q, l_extendedprice as p from lineitem)
select l_orderkey, case when count(*) = count(q) then min(q) end as least_quantity, case when count(*) = count(p) then min(p) end as least_price from x group by l_orderkey
""")
def limiting_min_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity")).alias("q"), "l_extendedprice")
    return lines.groupBy("l_orderkey").agg(A.strict_min(F.col("q")).alias("least_quantity"), A.strict_min(F.col("l_extendedprice")).alias("least_price"))


@_query("""
with x as (select l_partkey, l_extendedprice / o_totalprice as s from lineitem left join (select * from orders where o_orderstatus <> 'P') on o_orderkey = l_orderkey)
select l_partkey, case when count(*) = count(s) then max(s) end as scale from x group by l_partkey
""")
def max_scale_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    used = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice").join(orders, "l_orderkey", "left")
    return used.groupBy("l_partkey").agg(A.strict_max(F.col("l_extendedprice") / F.col("o_totalprice")).alias("scale"))


@_query("""
with x as (select l_orderkey, (l_quantity * 10)::bigint as v, least(round(l_discount * 100)::bigint, 5) as w from lineitem where l_discount >= 0.01),
     g as (select l_orderkey, v, sum(w) as w from x group by all),
     c as (select l_orderkey, v, sum(w) over (partition by l_orderkey order by v) as c, sum(w) over (partition by l_orderkey) as t from g)
select l_orderkey, least(min(v) filter (2 * c >= t), 300)::bigint as median from c group by l_orderkey
""")
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").filter("l_discount >= 0.01")
    samples = lines.select("l_orderkey", (F.col("l_quantity") * 10).cast("long").alias("v"), F.least(F.round(F.col("l_discount") * 100).cast("long"), F.lit(5)).alias("w"))
    return A.weighted_lower_median(samples, ["l_orderkey"], "v", "w", 300)


@_query("""
select o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) as o_orderkey, max(o_totalprice) as o_totalprice,
       arg_max(o_orderpriority, (o_totalprice, o_orderkey)) as o_orderpriority from orders group by o_custkey
""")
def representative_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    return A.representative(orders, ["o_custkey"], F.col("o_totalprice"), "o_orderkey", ["o_totalprice", "o_orderpriority"])


@_query("""
select o_custkey, count(distinct o_orderstatus) > 1 as mixed, bool_or(o_orderstatus = 'F') as any_final, bool_and(o_totalprice > 1000) as all_large from orders group by o_custkey
""")
def mixed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    return orders.groupBy("o_custkey").agg(
        (F.count_distinct("o_orderstatus") > 1).alias("mixed"), F.bool_or(F.col("o_orderstatus") == "F").alias("any_final"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_large")
    )


@_query("""
with b as (select label, vec_id, [least(embedding[1], embedding[3])::double, least(embedding[2], embedding[4])::double,
           greatest(embedding[1], embedding[3])::double, greatest(embedding[2], embedding[4])::double] as b from embeddings)
select label, min(b[1]) as x0, min(b[2]) as y0, max(b[3]) as x1, max(b[4]) as y1,
       arg_min(b, vec_id) = [min(b[1]), min(b[2]), max(b[3]), max(b[4])] as base_covers from b group by label
""")
def bbox_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.col("embedding")[i].cast("double") for i in range(4)]
    boxes = _read(spark, sf_dir, "embeddings").select("label", "vec_id", F.array(F.least(e[0], e[2]), F.least(e[1], e[3]), F.greatest(e[0], e[2]), F.greatest(e[1], e[3])).alias("box"))
    return A.union_box(boxes, ["label"], "box", "vec_id")


@_query("""
select a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::double - b.embedding[i]::double))) / 64, 9) as error
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1
""")
def mean_abs_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    right = left.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return left.join(right, "vec_id").select("vec_id", F.round(A.mean_absolute_error(F.col("embedding"), F.col("other")), 9).alias("error"))


# --- geometry and planning -------------------------------------------------------------------------------------------


@_query("""
with t as (select p_partkey, p_retailprice as w, p_size * 20.0 as h, unnest([96, 150, 200, 300, 600]) as target_dpi from part)
select p_partkey, target_dpi, greatest(round(w / 72.0 * target_dpi), 1)::bigint as required_width, greatest(round(h / 72.0 * target_dpi), 1)::bigint as required_height from t
""")
def target_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("w"), (F.col("p_size") * 20.0).alias("h"))
    return planning.target_fanout(parts, "w", "h").drop("w", "h")


@_query("""
with p as (select p_partkey, p_retailprice as w, p_size * 60.0 as h from part),
     f as (select p_partkey, w, h, case when w >= h then 1920 else greatest(round(w / h * 1920), 1)::bigint end as fit_w,
                  case when w >= h then greatest(round(h / w * 1920), 1)::bigint else 1920 end as fit_h from p),
     s as (select *, p_partkey % 5000 + 10 as iw, p_partkey % 700 + 10 as ih, 1920.0 / greatest(w, h) / 4 as k from f)
select p_partkey, fit_w::bigint as fit_w, fit_h::bigint as fit_h,
       case when iw >= ih then ceil(iw * k)::bigint else greatest(round(ceil(ih * k)::bigint * iw / ih), 1)::bigint end as image_w,
       case when iw >= ih then greatest(round(ceil(iw * k)::bigint * ih / iw), 1)::bigint else ceil(ih * k)::bigint end as image_h from s
""")
def aspect_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("p_retailprice"), F.col("p_size") * 60.0
    iw, ih = F.col("p_partkey") % 5000 + 10, F.col("p_partkey") % 700 + 10
    page = G.fit_long_side(w, h, F.lit(1920))
    image = G.scaled_image(iw, ih, F.lit(1920.0) / F.greatest(w, h) / 4)
    return _read(spark, sf_dir, "part").select("p_partkey", page[0].alias("fit_w"), page[1].alias("fit_h"), image[0].alias("image_w"), image[1].alias("image_h"))


@_query("""
with x as (select l_returnflag, (l_extendedprice * 1000000)::bigint as n, (l_quantity * 37)::bigint as t, 50 * 37 as s from lineitem)
select l_returnflag, sum((n::hugeint * t // s)::bigint)::bigint as after_bytes, sum(greatest(n - (n::hugeint * t // s)::bigint, 0))::bigint as saved_bytes from x group by l_returnflag
""")
def saving_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").select("l_returnflag", F.round(F.col("l_extendedprice") * 1_000_000).cast("long").alias("n"), F.round(F.col("l_quantity") * 37).cast("long").alias("t"))
    after = N.mul_div(F.col("n"), F.col("t"), F.lit(50 * 37).cast("long"))
    each = lines.select("l_returnflag", after.alias("after"), N.saturating_sub(F.col("n"), after).alias("saved"))
    return each.groupBy("l_returnflag").agg(F.sum("after").alias("after_bytes"), F.sum("saved").alias("saved_bytes"))


@_query("""
with x as (select o_orderkey, round(o_totalprice)::bigint as d, unnest([5, 10, 33, 50, 75, 100, 120]) as percent from orders)
select o_orderkey, percent, greatest((d * least(greatest(percent, 10), 100) + 50) // 100, 1)::bigint as side from x
""")
def scale_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice").cast("long").alias("d"), F.explode(F.array(*(F.lit(p) for p in (5, 10, 33, 50, 75, 100, 120)))).alias("percent"))
    return orders.select("o_orderkey", "percent", N.percent_scaled(F.col("d"), F.col("percent")).alias("side"))


_PAIRS = lambda sizes: ", ".join(f"({float(a)}, {float(b)})" for x, y in sizes for a, b in sorted({(x, y), (y, x)}))


@_query(f"""
with c(a, b) as (values {_PAIRS(C.CANVASES)}), f(a, b) as (values {_PAIRS(C.FORMATS)}),
     k as (select row_number() over (order by a, b) - 1 as i, a, b from c), m as (select row_number() over (order by a, b) - 1 as i, a, b from f),
     p as (select p_partkey, case when p_partkey % 2 = 0 then k.a + p_partkey % 5 - 1 + (p_partkey % 3) * 0.3 else (m.a + p_partkey % 4 - 1) * 72.0 / 25.4 end as w,
                  case when p_partkey % 2 = 0 then k.b else m.b * 72.0 / 25.4 end as h
           from part join k on k.i = p_partkey % (select count(*) from k) join m on m.i = p_partkey % (select count(*) from m)),
     q as (select *, exists (select 1 from f where abs(w * 25.4 / 72.0 - a) <= 1.5 and abs(h * 25.4 / 72.0 - b) <= 1.5) as physical,
                  abs(w - round(w)) <= 0.5 and abs(h - round(h)) <= 0.5 and exists (select 1 from c where abs(w - a) <= 2 and abs(h - b) <= 2) as near from p)
select p_partkey, case when p_partkey % 10 = 0 then 'vector_only' when near and not physical then 'digital' when physical then 'physical' else 'ambiguous' end as page_class from q
""")
def catalogue_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    def listed(sizes: list[tuple], names: tuple[str, str, str]) -> DataFrame:
        both = [(float(a), float(b)) for x, y in sizes for a, b in sorted({(x, y), (y, x)})]
        return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(sorted(both))], f"{names[0]} long, {names[1]} double, {names[2]} double"), len(both)

    (k, nk), (m, nm) = listed(C.CANVASES, ("ki", "ka", "kb")), listed(C.FORMATS, ("mi", "ma", "mb"))
    key = F.col("p_partkey")
    parts = _read(spark, sf_dir, "part").select("p_partkey").join(F.broadcast(k), F.col("ki") == key % nk).join(F.broadcast(m), F.col("mi") == key % nm)
    even = key % 2 == 0
    w = F.when(even, F.col("ka") + key % 5 - 1 + (key % 3) * 0.3).otherwise((F.col("ma") + key % 4 - 1) * 72.0 / 25.4)
    h = F.when(even, F.col("kb")).otherwise(F.col("mb") * 72.0 / 25.4)
    return parts.select("p_partkey", C.page_class(F.when(key % 10 == 0, 0).otherwise(1), w, h).alias("page_class"))


@_query("""
with g as (select l_partkey, case when l_partkey % 11 <> 0 then min(l_quantity) * 30 end as x, min(l_extendedprice) / 40 as y from lineitem group by l_partkey)
select case when x is null or y is null then 'unknown' when x < 300 or y < 300 then 'undersampled' when x >= 375 and y >= 375 then 'oversampled' else 'optimal' end as class, count(*) as parts
from g group by 1
""")
def classify_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = _read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg((F.min("l_quantity") * 30).alias("x"), (F.min("l_extendedprice") / 40).alias("y"))
    x = F.when(F.col("l_partkey") % 11 != 0, F.col("x"))
    return uses.groupBy(C.density_class(x, F.col("y"), F.lit(300.0)).alias("class")).agg(F.count(F.lit(1)).alias("parts"))


@_query("""
with f as (select p_partkey, case p_type when 'ECONOMY' then ['FlateDecode', 'DCTDecode'] when 'SMALL' then ['LZWDecode'] when 'MEDIUM' then ['JBIG2Decode'] when 'PROMO' then ['RunLengthDecode']
           when 'STANDARD' then []::varchar[] else ['JPXDecode', 'CCITTFaxDecode'] end as f from part)
select p_partkey, case when list_contains(f, 'DCTDecode') then 'jpeg' when list_contains(f, 'JPXDecode') then 'jpeg2000' when list_contains(f, 'CCITTFaxDecode') then 'ccitt'
       when list_contains(f, 'JBIG2Decode') then 'jbig2' when list_contains(f, 'FlateDecode') or list_contains(f, 'LZWDecode') then 'lossless' when len(f) = 0 then 'raw' else 'other' end as encoding from f
""")
def encoding_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = {"ECONOMY": ["FlateDecode", "DCTDecode"], "SMALL": ["LZWDecode"], "MEDIUM": ["JBIG2Decode"], "PROMO": ["RunLengthDecode"]}
    filters = F.when(F.col("p_type") == "STANDARD", F.array().cast("array<string>"))
    for kind, names in lists.items():
        filters = filters.when(F.col("p_type") == kind, F.array(*(F.lit(n) for n in names)))
    filters = filters.otherwise(F.array(F.lit("JPXDecode"), F.lit("CCITTFaxDecode")))
    return _read(spark, sf_dir, "part").select("p_partkey", C.encoding_kind(filters).alias("encoding"))


@_query("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
       case when not l_quantity < 40 then 'too_many' when not l_discount <= 0.08 then 'discount' when not l_returnflag in ('A', 'N') then 'returned' when not l_linestatus = 'F' then 'open' end as reason from lineitem
""")
def first_failure_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [
        (F.col("l_quantity") < 40, "too_many"),
        (F.col("l_discount") <= 0.08, "discount"),
        (F.col("l_returnflag").isin("A", "N"), "returned"),
        (F.col("l_linestatus") == "F", "open"),
    ]
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.first_reason(*checks).alias("reason"))


@_query("""
with i as (select p_partkey as id, p_partkey % 4000 + 200 as w, p_size * 60 + 100 as h, (p_retailprice * 100)::bigint as n from part),
     u as (select l_partkey as id, 20 + l_quantity * 4 as a, 20 + l_linenumber * 50 as d from lineitem),
     g as (select id, min(w * 72.0 / a) as x, min(h * 72.0 / d) as y, count(*) as reference_count from u join i using (id) group by id),
     c as (select i.*, x, y, reference_count, case when x is null then 'unknown' when x < 150 or y < 150 then 'undersampled' when x >= 150 * 1.25 and y >= 150 * 1.25 then 'oversampled' else 'optimal' end as class,
                  150.0 / least(x, y) as k from i left join g using (id)),
     t as (select *, case when w >= h then greatest(ceil(w * k), 1)::bigint else greatest(round(ceil(h * k)::bigint * w / h), 1)::bigint end as tw,
                  case when w >= h then greatest(round(ceil(w * k)::bigint * h / w), 1)::bigint else greatest(ceil(h * k), 1)::bigint end as th from c)
select id, class, reference_count, case when class = 'oversampled' then (n::hugeint * (tw * th) // (w * h))::bigint else n end as after_bytes,
       case when class = 'oversampled' then greatest(n - (n::hugeint * (tw * th) // (w * h))::bigint, 0) else 0 end as saved_bytes,
       case when class = 'oversampled' then case when least(x, y) / 150 >= 2 then 'high' else 'medium' end end as severity from t
""")
def downsampling_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part").select(
        F.lit("f").alias("file"), F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4000 + 200).alias("pixel_width"), (F.col("p_size") * 60 + 100).cast("long").alias("pixel_height"),
        F.round(F.col("p_retailprice") * 100).cast("long").alias("encoded_bytes"),
    )
    zero = F.lit(0.0)
    m = F.struct((20 + F.col("l_quantity") * 4).alias("a"), zero.alias("b"), zero.alias("c"), (20.0 + F.col("l_linenumber") * 50).alias("d"), zero.alias("e"), zero.alias("f"))
    uses = _read(spark, sf_dir, "lineitem").select(F.lit("f").alias("file"), F.col("l_partkey").alias("id"), F.lit(1).alias("page_number"), m.alias("matrix"))
    return planning.plan(parts, uses, uses.limit(0), dpi=150).select("id", "class", "reference_count", "after_bytes", "saved_bytes", "severity")


@_query("""
select event_id, (round(value)::bigint % 720 - 360)::int * 30 as rotation,
       case when (((round(value)::bigint % 720 - 360) * 30) % 180 + 180) % 180 = 90 then event_id % 77 else event_id % 55 end as w,
       case when (((round(value)::bigint % 720 - 360) * 30) % 180 + 180) % 180 = 90 then event_id % 55 else event_id % 77 end as h from events
""")
def rotation_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rotation = ((F.round("value").cast("long") % 720 - 360) * 30).cast("int")
    dims = G.swap_if(G.quarter_turned(rotation), F.array(F.col("event_id") % 55, F.col("event_id") % 77))
    return _read(spark, sf_dir, "events").select("event_id", rotation.alias("rotation"), dims[0].alias("w"), dims[1].alias("h"))


# --- ordered sequences -----------------------------------------------------------------------------------------------


@_query("""
with m as (select l_orderkey, list(struct_pack(s := 1 + round(l_discount * 100) / 64, t := l_quantity / 64) order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as steps from lineitem group by l_orderkey),
     r as (select l_orderkey, list_reduce(list_prepend(struct_pack(s := 1.0::double, t := 0.0::double), steps), lambda p, q: struct_pack(s := q.s * p.s, t := q.t * p.s + p.t)) as r from m)
select l_orderkey, r.s as scale, r.t as shift from r
""")
def affine_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero, s, t = F.lit(0.0), 1 + F.round(F.col("l_discount") * 100) / 64, F.col("l_quantity") / 64
    m = F.struct(s.alias("a"), zero.alias("b"), zero.alias("c"), s.alias("d"), t.alias("e"), zero.alias("f"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    total = ordered.affine_totals(_read(spark, sf_dir, "lineitem"), ["l_orderkey"], order, m)
    return total.select("l_orderkey", F.col("matrix.a").alias("scale"), F.col("matrix.e").alias("shift"))


@_query("""
with d as (select user_id, sum(case event_type when 'signup' then 1 when 'purchase' then -1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as depth from events)
select user_id, min(depth)::bigint as least_depth, min(depth) < 0 as underflow from d group by user_id
""")
def depth_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    kind = F.col("event_type")
    return ordered.unbalanced(ordered.depth(events, ["user_id"], ["ts", "event_id"], kind == "signup", kind == "purchase"), ["user_id"])


@_query("""
with l as (select *, max(case when role = 'user' then turn end) over (partition by conv_id) as last from conversations)
select conv_id, max(last) as last, min(case when turn >= last and role <> 'user' then turn end) + 1 as boundary, count(*) as rows from l group by conv_id
""")
def last_artwork_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return ordered.boundary(turns, ["conv_id"], "turn", F.col("role") == "user", F.col("role") != "user")


@_query("""
with p as (select *, coalesce(bool_or(event_type = 'error') over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), false) as painted from events)
select event_id, user_id from p where painted and event_type = 'purchase'
""")
def paint_order_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    kind = F.col("event_type")
    return ordered.painted_before(events, ["user_id"], ["ts", "event_id"], kind == "error", kind == "purchase").select("event_id", "user_id")


@_query("select user_id, event_type, arg_max(value, (ts, event_id)) as value from events group by user_id, event_type")
def last_writer_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.last_writer(_read(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value"])


# --- snapshots -------------------------------------------------------------------------------------------------------


@_query("""
with b as (select o_orderkey, o_orderstatus as s, o_totalprice as p from orders where o_orderkey % 10 <> 3),
     a as (select o_orderkey, case when o_orderkey % 7 = 0 then null else o_orderstatus end as s, o_totalprice as p from orders where o_orderkey % 10 <> 4)
select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when b.o_orderkey is null then 'added' when a.o_orderkey is null then 'removed'
       when a.s is not distinct from b.s and a.p is not distinct from b.p then 'same' else 'changed' end as change from b full join a on a.o_orderkey = b.o_orderkey
""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    before = orders.filter("o_orderkey % 10 <> 3")
    after = orders.filter("o_orderkey % 10 <> 4").withColumn("s", F.when(F.col("o_orderkey") % 7 != 0, F.col("s")))
    return S.diff(before, after, ["o_orderkey"], ["s", "p"])


@_query("""
with n as (select *, row_number() over (partition by source, doc_id % 2 order by doc_id) as i from documents),
     j as (select coalesce(b.source, a.source) as source, b.lang = a.lang as lang_ok, abs(b.n_chars - a.n_chars) <= 2000 as size_ok
           from (select * from n where doc_id % 2 = 0) b full join (select * from n where doc_id % 2 = 1) a on a.source = b.source and a.i = b.i)
select source, count(*) as places, count(*) filter (not coalesce(lang_ok, false)) as lang, count(*) filter (not coalesce(size_ok, false)) as size,
       bool_and(coalesce(lang_ok, false) and coalesce(size_ok, false)) as passed from j group by source
""")
def positional_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("source", "doc_id", "lang", "n_chars")
    checks = {"lang": F.col("b.lang") == F.col("a.lang"), "size": F.abs(F.col("b.n_chars") - F.col("a.n_chars")) <= 2000}
    return S.positional(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), ["source"], ["doc_id"], checks)


@_query("""
with p as (select p_partkey, p_partkey % 900 + 100 as w, p_size * 10 + 50 as h, case when p_partkey % 13 = 0 then 5 else 2 end as k from part),
     q as (select *, (w // k)::bigint as aw, (h // 2)::bigint as ah from p)
select p_partkey, array_to_string(list_filter([case when aw > w or ah > h or aw < 1 or ah < 1 then 'dimensions' end, case when abs(w * ah - h * aw) > greatest(w, h) then 'aspect_ratio' end,
       case when p_partkey % 17 = 0 then 'matrix' end, case when p_partkey % 19 = 0 then 'colour' end], lambda x: x is not null), ',') as violations from q
""")
def invariant_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    w, h = key % 900 + 100, (F.col("p_size") * 10 + 50).cast("long")
    aw, ah = F.floor(w / F.when(key % 13 == 0, 5).otherwise(2)).cast("long"), F.floor(h / 2).cast("long")
    one, zero = F.lit(1.0), F.lit(0.0)

    def raster(w, h, a, colour):  # noqa: ANN001, ANN202
        m = F.struct(a.alias("a"), zero.alias("b"), zero.alias("c"), one.alias("d"), zero.alias("e"), zero.alias("f"))
        return F.struct(w.alias("w"), h.alias("h"), m.alias("matrix"), F.array(zero, zero, one, one).alias("box"), F.lit("jpeg").alias("format"), colour.alias("colour"), F.lit(8).alias("bits"))

    pair = _read(spark, sf_dir, "part").select(
        "p_partkey",
        raster(w, h, one, F.lit("DeviceRGB")).alias("b"),
        raster(aw, ah, F.when(key % 17 == 0, 1.1).otherwise(1 + 1e-9), F.when(key % 19 == 0, "DeviceGray").otherwise("DeviceRGB")).alias("a"),
    )
    return pair.select("p_partkey", F.array_join(S.violations(F.col("b"), F.col("a")), ",").alias("violations"))


# --- tables of the service -------------------------------------------------------------------------------------------


@_query("select event_id, user_id, event_type from events where event_id % 5 <> 0")
def idempotent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    twice = events.unionByName(events.filter("event_id % 3 = 0"))
    return service.unseen(twice, events.filter("event_id % 5 = 0"), "event_id")


@_query("""
with recursive e as materialized (select user_id, event_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as i from events),
     w as (select user_id, event_id, i, t as opened, 1::bigint as n from e where i = 1
           union all select e.user_id, e.event_id, e.i, case when e.t >= w.opened + 21600000000 then e.t else w.opened end, case when e.t >= w.opened + 21600000000 then 1 else w.n + 1 end
           from w join e on e.user_id = w.user_id and e.i = w.i + 1)
select user_id, event_id, n as attempt, n <= 3 as allowed from w
""")
def anchored_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return service.rate_limited(events, ["user_id"], "at", "event_id", allowed=3, window_us=6 * 3600 * 1_000_000)


@_query("""
with a as (select o_custkey as k, count(*) filter (o_orderstatus <> 'F') as n from orders group by o_custkey)
select c_custkey as key, coalesce(n, 0)::bigint as active, coalesce(n, 0) < 5 as fits from customer left join a on k = c_custkey
""")
def active_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    purchases = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    activations = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deactivated_at"))
    return service.active_counts(purchases, activations, "key", limit=5)


@_query("""
select s_suppkey, coalesce(a.n_name, b.n_name, c.n_name) as n_name from supplier
left join nation a on a.n_nationkey = s_suppkey left join nation b on b.n_nationkey = s_nationkey + 5 left join nation c on c.n_nationkey = s_nationkey - 5
""")
def fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") + 5).alias("second"), (F.col("s_nationkey") - 5).alias("third"))
    found = service.looked_up(rows, ["s_suppkey", "second", "third"], _read(spark, sf_dir, "nation"), ["n_nationkey"] * 3, "n_name")
    return found.select("s_suppkey", "n_name")


@_query("""
with k as (select c_custkey, upper(regexp_replace(c_name || case when c_custkey % 3 = 0 then '' else '-x' end, '[^A-Za-z0-9]', '', 'g')) as k from customer),
     b as (select c_custkey, case when length(k) > 16 then regexp_replace(k, '^CU', '') else k end as k from k)
select c_custkey, case when length(k) = 16 then substr(k, 1, 4) || '-' || substr(k, 5, 4) || '-' || substr(k, 9, 4) || '-' || substr(k, 13, 4) end as licence from b
""")
def key_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, "").otherwise("-x"))
    return _read(spark, sf_dir, "customer").select("c_custkey", T.grouped_key(name, "cu").alias("licence"))


@_query(r"select page_id, md5(trim(regexp_replace(html, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) as normal_md5 from pages")
def whitespace_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", F.md5(T.normalise_whitespace(F.col("html"))).alias("normal_md5"))


@_query("""
with e as (select event_id, event_id % 5 as f, 1704067200 + event_id * 1000 as checked, 1704067200 + 10 * 86400 + event_id as now from events)
select event_id, case f when 0 then 30 when 1 then 1 when 2 then 3 else 7 end as days,
       now >= checked + case f when 0 then 30 when 1 then 1 when 2 then 3 else 7 end * 86400 + case when f = 0 then event_id % 100 else 0 end as due from e
""")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    id = F.col("event_id")
    days, due = service.retry_days(id % 5), service.is_due(F.lit(1704067200 + 10 * 86400) + id, F.lit(1704067200) + id * 1000, id % 5, id % 100)
    return _read(spark, sf_dir, "events").select("event_id", days.alias("days"), due.alias("due"))


@_query("""
with v as (select p_partkey, p_size % 3 as a, p_size % 5 as b, p_partkey % 12 as c from part)
select p_partkey, (a, b, c) > (1, 2, 9) as newer, case when p_partkey % 9 = 0 then null else a end as major from v
""")
def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    version = F.concat_ws(".", (size % 3).cast("string"), (size % 5).cast("string"), (key % 12).cast("string"))
    broken = F.when(key % 9 == 0, F.concat(version, F.lit("-beta"))).otherwise(version)
    newer = T.version_triple(version) > T.version_triple(F.lit("1.2.9"))
    return _read(spark, sf_dir, "part").select("p_partkey", newer.alias("newer"), T.version_triple(broken)["major"].cast("int").alias("major"))


@_query("""
select o_orderkey, case when o_orderstatus is null then 'INVALID' when o_orderkey % 4 = 0 then 'REVOKED' when o_orderstatus = 'F' then 'ACTIVE' else 'INVALID' end as state from orders
""")
def entitlement_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "paid").otherwise("open")
    return _read(spark, sf_dir, "orders").select("o_orderkey", service.entitlement(status, F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate"))).alias("state"))


@_query("""
with a as (select event_id, '10.' || event_id % 4 || '.' || event_id % 256 || '.' || event_id % 250 as address from events)
select event_id, address from a where address like '10.1.%' or (address like '10.2.%' and split_part(address, '.', 3)::int between 64 and 127)
""")
def subnet_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    id = F.col("event_id")
    address = F.concat_ws(".", F.lit("10"), (id % 4).cast("string"), (id % 256).cast("string"), (id % 250).cast("string"))
    return service.in_subnets(_read(spark, sf_dir, "events").select("event_id", address.alias("address")), "address", ["10.1.0.0/16", "10.2.64.0/18"])


@_query("""
with f as (select o_custkey, min(o_orderdate) as first_at from orders where o_totalprice > 400000 group by o_custkey)
select c_custkey as key, case when c_custkey % 10 = 0 then timestamp '1990-01-01' else first_at end as revoked_at from customer left join f on o_custkey = c_custkey
""")
def refund_revokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    purchases = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 10 == 0, F.lit("1990-01-01").cast("timestamp_ntz")).alias("revoked_at"))
    refunds = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), (F.col("o_totalprice") > 400000).alias("full"), F.col("o_orderdate").alias("at"))
    return service.refunded(purchases, refunds)
