"""Fill-in-middle transformation by bit-parallel arithmetic on big integers.

A text is cut into units: runs of ASCII letters, and single other characters. ``bytes.translate`` turns the UTF-8 bytes into
two masks with one bit for each byte (letters, and first bytes of characters), which Python reads as big integers. A unit starts
where a character starts, but not at a letter after a letter: one shift and two boolean operations. ``bit_count`` gives the number
of units, and the k-th start is found by halving the mask again and again, so a text of any length costs a few passes over
its bits and no list of units.

The form and both places come from hash values, so any run gives the same result. ``restored`` rebuilds the text from output
and form alone.

Defined cases: a null text is empty; empty texts, those that contain a sentinel, and a tenth of the others stay plain. A null
doc_id is hashed as the empty string. Repeated rows give repeated rows. Extra columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, those that stay plain, and those of the rest that have the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20

_LETTER = bytes(49 if chr(b).isalpha() and b < 128 else 48 for b in range(256))
_FIRST = bytes(48 if b & 0xC0 == 0x80 else 49 for b in range(256))
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def masks(data: bytes) -> tuple[int, int]:
    """Two integers whose bit i says that byte i of ``data`` begins a character, and that it begins a unit."""
    if not data:
        return 0, 0
    back = data[::-1]
    letters, first = int(back.translate(_LETTER), 2), int(back.translate(_FIRST), 2)
    return first, first ^ (letters & letters << 1)


def select(mask: int, k: int, size: int) -> int:
    """The place of the k-th set bit, from 0, of a mask of ``size`` bits, or ``size`` where there is none."""
    if k >= mask.bit_count():
        return size
    place = 0
    while size > 1:
        half = size >> 1
        part = mask & ((1 << half) - 1)
        n = part.bit_count()
        if k < n:
            mask, size = part, half
        else:
            mask, size, k, place = mask >> half, size - half, k - n, place + half
    return place


def _plain(data: bytes) -> bool:
    return not data or any(x.encode() in data for x in (PREFIX, SUFFIX, MIDDLE))


def cut(data: bytes, h1: int, h2: int, h3: int, h4: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Number of units, form, characters of prefix and middle, and output for a text's UTF-8 bytes and four hash values."""
    first, starts = masks(data)
    n = starts.bit_count()
    if _plain(data) or h3 % 100 >= 100 - PLAIN_PERCENT:
        return n, "plain", None, None, data
    a, b = (select(starts, k, len(data)) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    chars = (first & ((1 << a) - 1)).bit_count(), (first >> a & ((1 << (b - a)) - 1)).bit_count()
    prefix, middle, suffix = PREFIX.encode() + data[:a], MIDDLE.encode() + data[a:b], SUFFIX.encode() + data[b:]
    if h4 % 100 < SPM_PERCENT:
        return n, "spm", *chars, suffix + prefix + middle
    return n, "psm", *chars, prefix + suffix + middle


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        for i in range(0, batch.num_rows, 256):  # the outputs of a few texts at a time
            rows = [(k, *cut(text, *h)) for k, text, *h in zip(*(c.slice(i, 256).to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output for each row of ``docs`` (doc_id, text)."""
    key = F.col("doc_id").cast("long")
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    own = docs.select(key.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), *hashes)
    done = own.mapInArrow(_cut, _SCHEMA)
    return done.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that gave ``output`` in ``form``: no part can hold a sentinel, so they are split where sentinels are."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """``fill_in_middle`` with SHA-256 digests of the output and of the text restored from it, in place of the output."""
    done = fill_in_middle(docs)
    back = restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('1:' || doc_id) as h from documents),
     u as (select doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as w, ('0x' || h[1:8])::ubigint::bigint as h1,
                  ('0x' || h[9:16])::ubigint::bigint as h2, ('0x' || h[17:24])::ubigint::bigint as h3, ('0x' || h[25:32])::ubigint::bigint as h4 from d),
     c as (select *, len(w)::bigint as n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) as a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) as b from u),
     f as (select doc_id, text, n, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
                  when h4 % 100 < 20 then 'spm' else 'psm' end as form,
                  array_to_string(w[1:a], '') as p, array_to_string(w[a + 1:b], '') as m, array_to_string(w[b + 1:], '') as s from c)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(text) as restored_sha256
from f
"""
