"""Reports in words: a few lines for people about a plan, an export, a merge, flattened pages and a benchmark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fixed


def _mb(size: Column) -> Column:
    return fixed(F.coalesce(size, F.lit(0)).cast("double") / 1e6, 1)


def _lines(*lines: tuple) -> Column:
    """Lines of a format and its values, one after the other."""
    return F.format_string("\n".join(x[0] for x in lines) + "\n", *(v for x in lines for v in x[1:]))


def plan_text(size: Column, pages: Column, images: Column, oversampled: Column, saving: Column, duplicates: Column, duplicate_saving: Column, kept: Column) -> Column:
    """A plan: sizes, images that could be smaller, duplicates, and images that stay. Savings of duplicates aren't added to the others."""
    return _lines(
        ("Original: %s MB", _mb(size)), ("Pages: %d", pages), ("Images: %d", images), ("Oversampled images: %d", oversampled), ("Estimated saving: %s MB", _mb(saving)), ("Duplicate assets: %d", duplicates),
        ("Potential saving by them: %s MB", _mb(duplicate_saving)), ("Images left alone: %d", kept), ("Estimated final size: %s MB", _mb(F.greatest(size - saving, F.lit(0)))),
    )


def export_text(dry_run: bool, size: Column, images: Column, modified: Column, unchanged: Column, skipped: Column, saved: Column, output: Column | None = None, passed: Column | None = None) -> Column:
    """An export, or with ``dry_run`` what it would do."""
    counts = [("Images: %d", images), ("Would optimise: %d" if dry_run else "Optimised: %d", modified), ("Unchanged: %d", unchanged), ("Skipped: %d", skipped)]
    if dry_run:
        return _lines(*counts, ("Estimated saving: ~%s MB", _mb(saved)), ("Nothing was written.",))
    share = F.when(size > 0, saved.cast("double") * 100 / size).otherwise(0.0)
    return _lines(("Original: %s MB", _mb(size)), *counts, ("Output: %s MB", _mb(output)), ("Saved: %s MB (%s%%)", _mb(saved), fixed(share, 1)), ("Validation: %s", F.when(passed, "PASSED").otherwise("FAILED")))


def merge_text(dry_run: bool, merged: Column, skipped: Column, size: Column | None = None, output: Column | None = None) -> Column:
    """Pages whose images were merged, or with ``dry_run`` could be."""
    counts = [("Pages mergeable: %d" if dry_run else "Pages merged: %d", merged), ("Pages skipped: %d", skipped)]
    return _lines(*counts, ("Nothing was written.",)) if dry_run else _lines(*counts, ("Original: %s MB", _mb(size)), ("Output: %s MB", _mb(output)))


def flatten_text(dry_run: bool, pages: Column, size: Column | None = None, output: Column | None = None) -> Column:
    """Pages that became pictures, or with ``dry_run`` would."""
    warning = ("Text and vectors become pixels.",)
    if dry_run:
        return _lines(("Pages: %d", pages), warning, ("Nothing was written.",))
    return _lines(("Pages flattened: %d", pages), ("Original: %s MB", _mb(size)), ("Output: %s MB", _mb(output)), ("Saved: %s MB", _mb(F.greatest(size - output, F.lit(0)))), warning)


def benchmark_text(size: Column, pages: Column, images: Column, output: Column, reduction: Column, text: Column, vectors: Column, ratios: Column, passed: Column) -> Column:
    """A benchmark's verdict."""
    word = lambda ok, yes, no: F.when(F.coalesce(ok, F.lit(False)), yes).otherwise(no)
    return _lines(
        ("Input: %s MB", _mb(size)), ("Pages: %d", pages), ("Raster objects: %d", images), ("Output: %s MB", _mb(output)), ("Reduction: %s%%", fixed(reduction, 1)), ("Selectable text: %s", word(text, "YES", "NO")),
        ("Native vectors: %s", word(vectors, "YES", "NO")), ("Aspect ratios: %s", word(ratios, "PASS", "FAIL")), ("Validation: %s", word(passed, "PASS", "FAIL")),
    )
