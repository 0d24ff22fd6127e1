"""Line dedup by distinct-site spread: boilerplate is a line that many sites share.

Lines are hashed (128 bits) in one pass; each line hash gets a HyperLogLog sketch of its sites, and sketches
merge in the aggregation, so a line that a third of all documents have costs one sketch a task. Lines whose
estimate lies clearly over SITES are boilerplate; those near it get an exact distinct count; both come out as if all
had been counted. Boilerplate stays where it stands first (smallest doc_id, then place) and goes elsewhere.

All of it runs as DataFrame expressions. The table of line hashes is written once; texts are not shuffled as long
as the changed documents are few enough to broadcast their lines' places (``store.BROADCAST_ROWS``), and by one join otherwise.

Defined cases: only lines with a character that isn't white space count. A null text stays null and an empty
one empty. A null site is no site. Null doc_ids come first in the order. Rows that are equal in doc_id and text are treated
alike, as one document. Extra columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import fresh, small, written

#: Boilerplate stands at so many sites or more.
SITES = 10
#: Sketches have 2^PRECISION registers; estimates within MARGIN of SITES, five standard errors, are counted exactly.
PRECISION, MARGIN = 11, 0.12


def _key(*columns: Column) -> list[Column]:
    """128 bits as two columns, key1 and key2."""
    return [F.xxhash64(*columns).alias("key1"), F.xxhash64(F.lit("second"), *columns).alias("key2")]


def _lines(docs: DataFrame, text: str, site: str) -> DataFrame:
    """doc_id, key1, key2 (of the document), site, place, line1, line2 for each line with a word."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(site).cast("string").alias("site"))
    own = own.select("doc_id", "site", *_key(F.col("doc_id"), F.col("text")), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    lines = own.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return lines.select("doc_id", "key1", "key2", "site", "place", F.xxhash64("line").alias("line1"), F.xxhash64(F.lit("second"), "line").alias("line2"))


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """line1, line2, and first (doc_id, place) of the lines that stand at ``sites`` sites or more."""
    spread = lines.groupBy("line1", "line2").agg(F.hll_sketch_agg("site", F.lit(PRECISION)).alias("sketch"), F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "place")).alias("first"))
    spread = spread.filter(F.col("n") >= sites).select("line1", "line2", "first", F.hll_sketch_estimate("sketch").alias("estimate"))
    spread = written(spread.filter(F.col("estimate") >= sites * (1 - MARGIN)), "line-spread")
    near = small(spread.filter(F.col("estimate") <= sites * (1 + MARGIN)).select("line1", "line2"))
    exact = lines.filter("site is not null").join(near, ["line1", "line2"], "left_semi").groupBy("line1", "line2", "site").agg(F.count(F.lit(1)).alias("n"))
    exact = exact.groupBy("line1", "line2").agg(F.count(F.lit(1)).alias("exact"))
    found = spread.join(exact, ["line1", "line2"], "left")
    return found.filter((F.col("exact") >= sites) | (F.col("estimate") > sites * (1 + MARGIN))).select("line1", "line2", "first")


def remove_boilerplate(docs: DataFrame, text: str = "text", site: str = "source", sites: int = SITES) -> DataFrame:
    """``docs`` with boilerplate lines removed from column ``text``, and a struct column added, the last one.

    The struct has n_lines (lines with a word) and n_removed; it is called ``line_dedup``, with underscores before it if
    ``docs`` has that column.
    """
    lines = written(_lines(docs, text, site), "lines")
    found = small(written(boilerplate(lines, sites), "boilerplate"))
    drops = lines.join(found, ["line1", "line2"]).filter(~F.struct("doc_id", "place").eqNullSafe(F.col("first")))
    places = written(drops.groupBy("key1", "key2").agg(F.collect_set("place").alias("places")), "dropped-lines")
    own = docs.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"), *_key(F.col("doc_id").cast("long"), F.col(text).cast("string")))
    # lines are a column of their own, used more than once, so that looking one up by its place doesn't split the text again
    own = own.join(small(places), ["key1", "key2"], "left").withColumn("parts", F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("places").cast("array<int>"))
    kept = F.array_join(F.transform(left, lambda i: F.get("parts", i)), "\n")
    filled = F.size(F.filter("parts", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    counts = F.struct(F.greatest(filled, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_removed"))
    out = F.when(F.col("places").isNull(), F.col("text")).otherwise(kept)
    return own.select(*(out.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns), counts.alias(fresh("line_dedup", docs)))


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars_left and the SHA-256 of the text left, for each row of ``docs``."""
    cleaned = remove_boilerplate(docs.select("doc_id", "text", "source"))  # adds line_dedup
    return cleaned.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "line_dedup.n_lines",
        "line_dedup.n_removed",
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_left"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


ORACLE_SQL = rf"""
with l as materialized (
         select doc_id, source, line, place, regexp_matches(line, '[^\x20\x09-\x0D]') as filled
         from (select doc_id, source, unnest(parts) as line, unnest(range(len(parts))) as place
               from (select doc_id, source, string_split(coalesce(text, ''), chr(10)) as parts from documents))),
     b as (select line, min(struct_pack(d := doc_id, p := place)) as first from l where filled group by line having count(distinct source) >= {SITES}),
     m as (select l.*, b.line is not null and filled and not (l.doc_id = b.first.d and l.place = b.first.p) as gone from l left join b using (line)),
     t as (select doc_id, count(*) filter (filled) as n_lines, count(*) filter (gone) as n_removed,
                  coalesce(string_agg(line, chr(10) order by place) filter (not gone), '') as text from m group by doc_id)
select doc_id, n_lines, n_removed, length(text)::bigint as n_chars_left, sha256(text) as text_sha256 from t
"""
