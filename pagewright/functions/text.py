"""Text helpers of reports and licence keys as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_LENGTH = 16


def normalise_whitespace(text: Column) -> Column:
    """Runs of white space (space, 0x09 to 0x0D) as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def grouped_key(text: Column, prefix: str = "") -> Column:
    """A licence key in upper case as four groups of four; null unless 16 letters and digits remain.

    ``prefix`` is dropped from the front once everything else is gone.
    """
    bare = F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))
    if prefix:
        bare = F.when(F.length(bare) > KEY_LENGTH, F.regexp_replace(bare, f"^{prefix.upper()}", "")).otherwise(bare)
    groups = F.concat_ws("-", *(F.substring(bare, 4 * i + 1, 4) for i in range(4)))
    return F.when(F.length(bare) == KEY_LENGTH, groups)


def version_triple(version: Column) -> Column:
    """(major, minor, patch) of "a.b.c" as a comparable struct; null where a part isn't a number."""
    parts = F.split(version, r"\.")
    part = lambda i: F.get(parts, F.lit(i))
    numbers = [F.when(part(i).rlike("^[0-9]{1,9}$"), part(i)).cast("long") for i in range(3)]
    fine = numbers[0].isNotNull() & numbers[1].isNotNull() & numbers[2].isNotNull() & (F.size(parts) == 3)
    return F.when(fine, F.struct(*(n.alias(name) for n, name in zip(numbers, ("major", "minor", "patch"), strict=True))))


def major(version: Column) -> Column:
    """The text before the first dot."""
    return F.split(version, r"\.")[0]


def reference(text: Column, n: int = 12) -> Column:
    """The first ``n`` hex digits of a text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, n)


def object_id(number: Column, generation: Column) -> Column:
    return F.format_string("%d %d R", number, generation)


def fixed(number: Column, places: int) -> Column:
    """A double with ``places`` decimals, rounded by its exact value, and halves to the even digit, as C does.

    ``format_string`` rounds the shortest decimal that stands for the double, which may be a half where the double is none.
    """
    return F.call_function("format_number", number.cast("double"), F.lit("0." + "0" * places))


def megabytes(size: Column) -> Column:
    return F.concat(fixed(size / 1e6, 2), F.lit(" MB"))


def polynomial_hash(text: Column) -> Column:
    """h = 31 * h + byte over a text's UTF-8 bytes, modulo 2^64, as a decimal."""
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(text), F.lit(1))), lambda i: F.conv(F.hex(F.substring(text.cast("binary"), i, F.lit(1))), 16, 10).cast("decimal(38,0)"))
    start = F.lit(0).cast("decimal(38,0)")
    step = lambda h, b: F.pmod(h * F.lit(31).cast("decimal(2,0)") + b, F.lit(str(2**64)).cast("decimal(20,0)")).cast("decimal(38,0)")
    return F.when(F.octet_length(text) > 0, F.aggregate(codes, start, step)).otherwise(start)


def truncated(text: Column, n: int = 500) -> Column:
    """The first ``n`` characters."""
    return F.substring(text, 1, n)


def lossy_utf8(data: Column) -> Column:
    """Bytes as text, with the replacement character where they aren't UTF-8."""
    return F.make_valid_utf8(data.cast("string"))


def jitter(text: Column, spread: int = 86_400) -> Column:
    """Seconds from -``spread`` to ``spread`` that depend on the text only."""
    return F.pmod(polynomial_hash(text), F.lit(2 * spread + 1).cast("decimal(20,0)")).cast("long") - spread
