"""What the operators share: intermediate tables, broadcasts behind a count, rows by wanted ids, and names that clash with no column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import shared_dir, written

__all__ = ["BITMAP_BITS", "BROADCAST_ROWS", "bitmap", "fresh", "only", "shared_dir", "small", "written"]

#: Tables of a few narrow columns are broadcast up to this number of rows, at most 40 MB.
BROADCAST_ROWS = 500_000
#: Bits of a broadcast bitmap, at most: 16 MB.
BITMAP_BITS = 1 << 27


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table of a few narrow columns, to be broadcast if it has at most ``rows`` rows.

    A larger one is joined by shuffle, as Spark sees fit.
    """
    return F.broadcast(df) if df.count() <= rows else df


def fresh(name: str, df: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bitmap(df: DataFrame, value: Column) -> tuple[DataFrame, int]:
    """Which ``value``s modulo the number of bits are in ``df``, a written table: marks of 32,768 bits by part, and that number.

    There are 16 bits a row or more, but BITMAP_BITS at most.
    """
    bits = max(1 << 20, min(BITMAP_BITS, 1 << (16 * df.count()).bit_length()))
    at = F.pmod(value, F.lit(bits))
    return df.select(F.shiftright(at, 15).alias("part"), at.bitwiseAND(32767).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("marks")), bits


def only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` with a doc_id in ``ids``.

    A bitmap of hashed ids, of BITMAP_BITS bits at most, is broadcast and drops most other rows where they are
    read, so that whole texts aren't shuffled for the exact semi-join that follows.
    """
    ids = written(ids.distinct(), "ids")
    marks, bits = bitmap(ids, F.xxhash64("doc_id"))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    bit = at.bitwiseAND(32767).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("marks"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    seen = F.expr("shiftright(byte, bit % 8) & 1 = 1")
    some = texts.withColumn("part", F.shiftright(at, 15)).join(F.broadcast(marks), "part").withColumn("bit", bit).withColumn("byte", byte).filter(seen)
    return some.select(*texts.columns).join(ids, "doc_id", "left_semi")
