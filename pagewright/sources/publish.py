"""Publishing results: checks first, nothing overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def output_name(path: Column, label: str) -> Column:
    """A file's name beside it with a label: a/b.pdf as a/b_label.pdf."""
    return F.concat(F.regexp_replace(path, r"(?i)\.pdf$", ""), F.lit(f"_{label}.pdf"))


def smaller(before: Column, after: Column, changed: Column) -> Column:
    """True where an output may be published: it isn't empty, and if it changed it is smaller than before."""
    return (after > 0) & (~changed | (after < before))


def publish(result: DataFrame, path: str, sources: list[str], checks: dict[str, Column] | None = None, dry_run: bool = False) -> DataFrame:
    """Write ``result`` as Parquet to a new ``path`` once every row passes every check; gives the failed counts.

    A path that holds a source, or exists, is refused; a dry run checks and writes nothing. Spark commits the files of
    a write at its end, so a failed one leaves no rows to read.
    """
    if any(path.rstrip("/") == s.rstrip("/") for s in sources):
        raise ValueError(f"{path} is a source")
    checks = checks or {}
    failed = result.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()))
    row = failed.first().asDict()
    if bad := [name for name in checks if row[name]]:
        raise ValueError(f"checks failed: {bad}")
    if not dry_run:
        result.write.mode("errorifexists").parquet(path)
    return failed
