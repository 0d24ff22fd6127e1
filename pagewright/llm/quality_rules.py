"""Quality rules: decision lists learned by sequential covering over text statistics.

A pass over the texts gives each document's statistics. From a bounded sample of labelled documents (SAMPLE rows,
the first by hash of doc_id, none held out) the driver learns an ordered list of rules for bad documents. A
rule is a conjunction of thresholds: it is grown on two thirds of the sample by the gain of each condition,
pruned on the last third from its end, and kept if it is precise there; the documents that it covers leave and
the next rule is learned. The list becomes one Spark conditional expression over the statistics.

Defined cases: a null or empty text has zeros everywhere and fails the base rules. Labels that are null or
name no document aren't used; a doc_id with several labels is good if one says so. Without bad examples the
list is empty and keeps all that passes the base rules. Repeated rows give a row each. ``judged`` returns
doc_id and statistics only; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta

#: Labelled documents that the driver learns from, at most.
SAMPLE = 20_000
#: SQL that is true for the rows that no label is learned from.
HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0"
#: Least share of bad documents among those that a rule covers, and of the bad ones that it must find, and the most
#: rules and conditions.
PRECISION, COVER, RULES, CONDITIONS = 0.9, 0.01, 12, 4

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_upper", "n_digits", "n_marks", "n_distinct_words"]

_IN_LINE = np.zeros(256, bool)
_IN_LINE[10] = True


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(x) for x in chars]] = 1
    return out


_SYMBOL = _flags("#*$%&|<>")
_UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _flags("0123456789")
_MARK = _flags("!?;:.,")


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]


def counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The COUNTS of each text, as columns."""
    n = len(off) - 1
    words = ta.Words(data, off)
    hashes = words.hashes(False)
    lines = ta.Words(data, off, _IN_LINE)
    line_hash = ta.span_hashes(data, lines.start, lines.end)
    filled = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    sh, of = ta.shingles(hashes, words.of)
    out = np.zeros((n, len(COUNTS)), np.int64)
    out[:, 0] = np.diff(words.of)
    begins = (data & 0xC0) != 0x80
    out[:, 1] = _sums(begins & ~ta.SPACE[data], off)
    for column, table in ((2, _SYMBOL), (7, _UPPER), (8, _DIGIT), (9, _MARK)):
        out[:, column] = _sums(table[data], off)
    out[:, 6] = _sums(begins, off)
    for d in range(n):
        own = line_hash[lines.of[d] : lines.of[d + 1]][filled[lines.of[d] : lines.of[d + 1]]]
        out[d, 5], out[d, 3] = len(own), len(own) - len(np.unique(own))
        out[d, 10] = len(np.unique(hashes[words.of[d] : words.of[d + 1]]))
        if out[d, 0] > 5:
            _, which, times = np.unique(sh[of[d] : of[d + 1]], return_inverse=True, return_counts=True)
            again = times[which] > 1
            if again.any():
                edge = np.zeros(out[d, 0] + 1, np.int64)
                edge[: len(again)] += again
                edge[5 : len(again) + 5] -= again
                out[d, 4] = np.count_nonzero(np.cumsum(edge[:-1]))
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = ta.utf8(batch.column(1))
        found = [counts(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in ta.chunks(off)]
        table = np.concatenate(found) if found else np.zeros((0, len(COUNTS)), np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(x)) for x in table.T)], ["doc_id", *COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS for each row of ``docs`` (columns doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_counted, "doc_id long, " + ", ".join(f"{x} long" for x in COUNTS))


#: What rules may test: counts, and shares of them as SQL over COUNTS.
FEATURES = {
    "n_words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(n_chars, 1)",
    "digit_share": "n_digits / greatest(n_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
}


@dataclass
class Rule:
    """Conditions (feature, '<=' or '>', threshold), all of which a bad document meets."""

    conditions: list[tuple[str, str, float]] = field(default_factory=list)

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, sign, at in self.conditions:
            out &= x[name] <= at if sign == "<=" else x[name] > at
        return out

    def sql(self) -> str:
        return " and ".join(f"({FEATURES[name]}) {sign} {at!r}D" for name, sign, at in self.conditions)

    def __str__(self) -> str:
        return " and ".join(f"{name} {sign} {at:.4g}" for name, sign, at in self.conditions)


def _grown(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule = Rule()
    inside = np.ones(len(bad), bool)
    while len(rule.conditions) < CONDITIONS:
        p, n = np.count_nonzero(bad & inside), np.count_nonzero(~bad & inside)
        if not p or not n:
            break
        best, gain = None, 1e-9
        for name, values in x.items():
            own = values[inside]
            for at in np.unique(np.quantile(own, np.linspace(0.01, 0.99, 50))):
                low = inside & (values <= at)
                pl, nl = np.count_nonzero(low & bad), np.count_nonzero(low & ~bad)
                for sign, pc, nc in (("<=", pl, nl), (">", p - pl, n - nl)):
                    if pc:
                        g = pc * (np.log2(pc / (pc + nc)) - np.log2(p / (p + n)))
                        if g > gain:
                            best, gain = (name, sign, float(at)), g
        if best is None:
            break
        rule.conditions.append(best)
        inside = rule.covers(x)
    return rule


def _pruned(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(n: int) -> float:
        c = Rule(rule.conditions[:n]).covers(x)
        p = np.count_nonzero(c & bad)
        return (2 * p - np.count_nonzero(c)) / max(1, np.count_nonzero(c))

    sizes = range(1, len(rule.conditions) + 1)
    return Rule(rule.conditions[: max(sizes, key=lambda n: (worth(n), -n))]) if rule.conditions else rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """The ordered rules for bad documents."""
    part = np.arange(len(bad)) % 3 == 2
    total, rules, left = np.count_nonzero(bad), [], np.ones(len(bad), bool)
    while total and len(rules) < RULES:
        grow, prune = left & ~part, left & part
        rule = _pruned(_grown({k: v[grow] for k, v in x.items()}, bad[grow]), {k: v[prune] for k, v in x.items()}, bad[prune])
        covered = rule.covers(x) & left if rule.conditions else np.zeros(len(bad), bool)
        found = np.count_nonzero(covered & bad)
        tested = covered & part
        precise = lambda c: np.count_nonzero(c & bad) >= PRECISION * max(1, np.count_nonzero(c))
        if found < max(2, COVER * total) or not precise(covered) or not precise(tested):
            break
        rules.append(rule)
        left &= ~covered
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null where none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(F.expr(rule.sql()), i).otherwise(out)
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from labelled documents that aren't held out."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    own = own.filter(f"doc_id is not null and quality is not null and not ({HELD_OUT})").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = own.orderBy(F.xxhash64("doc_id", F.lit("sample"))).limit(sample)
    # two numbers a row, SAMPLE rows at most: small enough to broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi")
    rows = statistics(texts).join(F.broadcast(some), "doc_id").selectExpr("doc_id", "quality", *(f"{e} as {name}" for name, e in FEATURES.items()))
    table = rows.toPandas().sort_values(["doc_id", *FEATURES])
    return learn({name: table[name].to_numpy(float) for name in FEATURES}, (table["quality"] <= 0).to_numpy())


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, rule (the first that holds) and kept for each row of ``docs``."""
    rules = train(docs, labels)
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    return (
        statistics(docs)
        .withColumn("base_failed", failed)
        .withColumn("rule", verdict(rules))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))
    )
