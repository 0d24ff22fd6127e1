"""Token counts from an exact histogram of encoded lengths.

Documents are encoded once, in Arrow batches, and only their lengths stay: an aggregation counts documents by
length. Suffix sums over the histogram answer, for every context limit that is a length in it, how many
documents and tokens lie at or above it, how many tokens remain when every document is cut at the limit, and
which share of the documents fits. The suffix sums run in two levels (within blocks of lengths, then over block
totals), so no task reads the whole histogram.

Defined cases: null and empty texts have length 0 and count. Repeated rows count each time. An empty table
gives an empty histogram. Extra columns are not read. Special tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: How byte-level vocabularies of this kind split a text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths in one block of the suffix sums.
BLOCK = 256


@functools.lru_cache(2)
def encoding(path: str) -> tiktoken.Encoding:
    """The encoding of a rank file (a base64 token and its rank on each line), once for each worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def _lengths(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = encoding(path).encode_ordinary
    for batch in batches:
        n = [len(encode(x)) if x else 0 for x in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])


def token_lengths(docs: DataFrame, path: str) -> DataFrame:
    """n_tokens of the text of each row of ``docs``, with its doc_id where there is one."""
    ids = [F.col("doc_id").cast("long").alias("doc_id")] if "doc_id" in docs.columns else []
    own = docs.select(*ids, F.col("text").cast("string").alias("text"))
    return own.mapInArrow(functools.partial(_lengths, path), "doc_id long, n_tokens long" if ids else "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens and docs: how many rows of ``lengths`` have each length."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """For each length L of a histogram (n_tokens, docs), as a context limit:

    docs, tokens: of exactly that length; docs_at_least, tokens_at_least: suffix sums;
    truncated_total: tokens left when documents are cut at L; share_fitting: the share of documents of at
    most L tokens, so the q-quantile is the least L with share_fitting >= q.
    """
    own = histogram.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.expr(f"n_tokens div {BLOCK}").alias("block"))
    blocks = own.groupBy("block").agg(F.sum("docs").alias("bd"), F.sum("tokens").alias("bt")).withColumn("group", F.expr(f"block div {BLOCK}"))
    # one row for each 65,536 lengths: few enough for one task, whatever the number of documents
    later, whole = Window.orderBy(F.desc("group")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    groups = (
        blocks.groupBy("group")
        .agg(F.sum("bd").alias("d"), F.sum("bt").alias("t"))
        .select(
            "group",
            F.coalesce(F.sum("d").over(later), F.lit(0)).alias("gd"),
            F.coalesce(F.sum("t").over(later), F.lit(0)).alias("gt"),
            F.sum("d").over(whole).alias("all_docs"),
            F.sum("t").over(whole).alias("all_tokens"),
        )
    )
    later = Window.partitionBy("group").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", "group", F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("bd"), F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("bt")).join(groups, "group")
    later = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    sums = own.select("block", "n_tokens", "docs", "tokens", F.sum("docs").over(later).alias("d"), F.sum("tokens").over(later).alias("t")).join(blocks, "block")
    at_least = F.col("d") + F.col("bd") + F.col("gd")
    tokens_at_least = F.col("t") + F.col("bt") + F.col("gt")
    return sums.select(
        "n_tokens",
        "docs",
        "tokens",
        at_least.alias("docs_at_least"),
        tokens_at_least.alias("tokens_at_least"),
        (F.col("all_tokens") - tokens_at_least + F.col("n_tokens") * at_least).alias("truncated_total"),
        ((F.col("all_docs") - at_least + F.col("docs")) / F.col("all_docs")).alias("share_fitting"),
    )


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_fitting, docs_longer, tokens_longer and truncated_total for any limits.

    Each is answered by the first row of ``table`` (a limit table) at or above the next length, and by the totals.
    """
    asked = table.select("n_tokens", "docs_at_least", "tokens_at_least", F.explode(F.array(*(F.lit(x).cast("long") for x in sorted(set(limits))))).alias("context_limit"))
    longer = F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_tokens"))
    above = asked.groupBy("context_limit").agg(F.min_by(F.struct("docs_at_least", "tokens_at_least"), longer).alias("x"), F.max("docs_at_least").alias("all_docs"), F.max("tokens_at_least").alias("all_tokens"))
    docs, tokens = F.coalesce("x.docs_at_least", F.lit(0)), F.coalesce("x.tokens_at_least", F.lit(0))
    return above.select(
        "context_limit", (F.col("all_docs") - docs).alias("docs_fitting"), docs.alias("docs_longer"), tokens.alias("tokens_longer"), (F.col("all_tokens") - tokens + F.col("context_limit") * docs).alias("truncated_total")
    )


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """share and n_tokens: the least length that so large a share of documents doesn't pass."""
    asked = table.select("n_tokens", "share_fitting", F.explode(F.array(*(F.lit(float(x)) for x in sorted(set(shares))))).alias("share"))
    return asked.filter(F.col("share_fitting") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """The limit table of ``docs`` (column text) under the vocabulary at ``path``."""
    histogram = length_histogram(token_lengths(docs.select("text"), path))
    return limit_table(written(histogram, "length-histogram"))
