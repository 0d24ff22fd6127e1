r"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Base spans are the matches of three patterns (assigned keys, access keys, long hexadecimal runs), found
leftmost and without overlaps for each kind. The method adds spans of kind ``random``: every run of LEAST or more
letters, digits and ``+/_-`` is a candidate. The alphabet it uses decides its encoding (hexadecimal, base 32, base
62, base 64). Three tests ask if the characters could be drawn at random from that alphabet: chi-squared
for uniformity, the number of runs above and below the alphabet's middle, and the serial correlation of neighbours.
Their squared deviations add up to one statistic.

Long words of prose are no secrets, and a short candidate passes any test easily. Runs of letters only, which nearly all are
prose, show for each encoding and class of lengths how the statistic is spread for prose; a candidate's p-value is
the chance of so small a statistic there. Within each class of lengths the Benjamini-Hochberg step on a histogram of p-values
sets the threshold that holds the share of false discoveries at RATE. A span is reported if it passes the battery and the
threshold, and if no base span overlaps it.

All of it runs as DataFrame expressions in one pass over the texts; what follows works on candidates. The tables of
classes have a fixed number of rows. Positions are code points, ends exclusive. Defined cases: null and empty texts
have no spans; repeated rows give a row each; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

#: Base patterns by kind, in the order that breaks ties, and the least length of what must be long.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 or more: a shorter run hides no longer one
HEX = "[0-9a-f]{24,}"
#: Least length of a candidate, the false-discovery rate, and the greatest statistic of the battery (p of 0.001 at 3 degrees).
LEAST, RATE, PASS = 20, 0.01, 16.27
CANDIDATE = f"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"
#: Prose runs that weigh as much as what letters of a language would give, where a class's own spread is estimated.
PROSE = 30
#: Spans that are compared at once.
BLOCK = 256

_ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
}
#: Bins of p-values, ten for each power of ten.
_BINS = 300


def _running(sizes: Column) -> Column:
    """Running sums of an array of integers, in blocks of BLOCK and then over the blocks, as an array grows by copying."""
    none = F.array().cast("array<int>")
    grown = lambda out, x: F.concat(out, F.array(F.coalesce(F.element_at(out, -1), F.lit(0)) + x))
    sums = lambda xs: F.aggregate(xs, none, lambda out, x: F.when(F.size(out) == 0, F.array(x)).otherwise(grown(out, x)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: sums(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))))
    before = lambda whole: sums(F.transform(whole, lambda x: F.element_at(x, -1)))
    moved = lambda whole: F.zip_with(whole, F.concat(F.array(F.lit(0)), before(whole)), lambda x, at: F.transform(x, lambda y: y + at))
    # bound to a name once, so that the blocks aren't summed twice
    return F.when(F.size(sizes) <= 0, none).otherwise(F.flatten(F.filter(F.transform(F.array(blocks), moved)[0], lambda x: x.isNotNull())))


def spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, found) of a pattern's matches, leftmost and without overlaps, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    sizes = lambda f, b: _running(F.zip_with(F.slice(b, 1, F.size(f)), f, lambda x, y: F.length(x) + F.length(y)))
    made = lambda pair: F.zip_with(pair["found"], sizes(pair["found"], pair["between"]), lambda f, end: F.struct((end - F.length(f)).alias("start"), end.alias("end"), f.alias("found")))
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return F.when(text.rlike(pattern), F.transform(F.array(F.struct(found.alias("found"), between.alias("between"))), made)[0]).otherwise(none)


def _named(found: Column, order: int, kind: str) -> Column:
    """The spans with their kind, in a struct that sorts by start, then kind."""
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _battery(token: Column) -> Column:
    """(encoding, n, prose, statistic) of a candidate."""
    body = F.regexp_replace(token, "=+$", "")
    kinds = F.when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(body.rlike("^[A-Z2-7]+$"), "base32").when(body.rlike("^[A-Za-z0-9]+$"), "base62").otherwise("base64")
    return F.struct(kinds.alias("encoding"), F.length(body).alias("n"), body.rlike("^[A-Za-z]+$").alias("prose"), F.when(kinds == "hex", F.lower(body)).otherwise(body).alias("body"))


#: The three tests over a struct t (encoding, n, prose, body), as Spark SQL.
_CODES = "transform(split(t.body, ''), c -> instr({alphabet}, c) - 1)"
_ALPHABET = "case t.encoding " + " ".join(f"when '{k}' then '{v}'" for k, v in _ALPHABETS.items()) + " end"
_SIZE = "case t.encoding " + " ".join(f"when '{k}' then {len(v)}D" for k, v in _ALPHABETS.items()) + " end"
_CHI = "aggregate(transform(array_distinct(x), c -> size(filter(x, y -> y = c))), 0D, (s, c) -> s + c * c) * k / n - n"
_HIGH = "size(filter(x, c -> c >= k / 2))"
_RUNS = "1 + aggregate(sequence(1, size(x) - 1), 0, (s, i) -> s + if((x[i] >= k / 2) <> (x[i - 1] >= k / 2), 1, 0))"
_MEAN = "aggregate(x, 0D, (s, c) -> s + c) / n"


def _tested(df: DataFrame) -> DataFrame:
    """One row for each candidate (key columns, start, end, t) with its statistic."""
    df = df.withColumn("k", F.expr(_SIZE)).withColumn("n", F.col("t.n").cast("double"))
    df = df.withColumn("x", F.expr(_CODES.format(alphabet=f"({_ALPHABET})")))
    df = df.selectExpr("*", f"{_CHI} as chi", f"double({_HIGH}) as high", f"double({_RUNS}) as runs", f"{_MEAN} as mean")
    df = df.selectExpr(
        "*",
        "(chi - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n) as z_chi",
        "2 * high * (n - high) as hh",
        "aggregate(x, 0D, (s, c) -> s + (c - mean) * (c - mean)) as var",
        "aggregate(sequence(1, size(x) - 1), 0D, (s, i) -> s + (x[i] - mean) * (x[i - 1] - mean)) as cov",
    )
    z_runs = "if(hh * (hh - n) > 0, (runs - hh / n - 1) / sqrt(hh * (hh - n) / (n * n * (n - 1))), if(high = 0 or high = n, 6D, 0D))"
    z_serial = "if(var > 0, (cov / var + 1 / (n - 1)) * sqrt(n), 6D)"
    statistic = f"pow(greatest(z_chi, 0D), 2) + pow({z_runs}, 2) + pow({z_serial}, 2)"
    return df.selectExpr("key1", "key2", "start", "end", "t.encoding as encoding", "t.prose as prose", "int(least(log2(n / 20) * 2, 9D)) as class", f"{statistic} as statistic")


def _p_bins(tested: DataFrame) -> DataFrame:
    """``tested`` with bin: ten times minus the decimal logarithm of the p-value among prose of its class."""
    root = F.sqrt("statistic")
    prose = tested.filter("prose").groupBy("encoding", "class").agg(F.count(F.lit(1)).alias("m"), F.avg(root).alias("mu"), F.stddev_samp(root).alias("sd"))
    # at most 40 rows; where prose is rare, mostly what letters of a language would give: 1 for each character
    every = tested.join(F.broadcast(prose), ["encoding", "class"], "left")
    length = LEAST * F.pow(F.lit(2.0), F.col("class") / 2)
    m, prior = F.coalesce("m", F.lit(0)), F.sqrt(length)
    own = F.coalesce("mu", prior)
    mu = (m * own + PROSE * prior) / (m + PROSE)
    variance = (m * F.coalesce(F.col("sd") * F.col("sd"), F.lit(1.0)) + PROSE) / (m + PROSE)
    sd = F.greatest(F.sqrt(variance), F.lit(0.3))
    z = (mu - root) / sd
    # the normal tail by a logistic curve of an odd cubic, right to a few parts in ten thousand, exact in sign
    bits = F.log1p(F.exp(F.least(1.5976 * z + 0.070566 * z * z * z, F.lit(600.0)))) / math.log(10)
    return every.withColumn("bin", F.least(F.floor(bits * 10), F.lit(_BINS)).cast("int")).select("key1", "key2", "start", "end", "class", "statistic", "bin")


def _thresholds(binned: DataFrame) -> dict[int, int]:
    """The least bin by class at which the Benjamini-Hochberg step holds the rate; at most 10 * _BINS counts."""
    table: dict[int, dict[int, int]] = {}
    for r in binned.groupBy("class", "bin").count().collect():
        table.setdefault(r["class"], {})[r["bin"]] = r["count"]
    out = {}
    for c, counts in table.items():
        total, above = sum(counts.values()), 0
        for b in sorted(counts, reverse=True):
            above += counts[b]
            if total * 10 ** (-b / 10) <= RATE * above:
                out[c] = b
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random for each row of ``docs``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    long_enough = F.filter(spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["found"], "^" + ASSIGN, 2)) >= 6)
    kinds = {"assign": long_enough, "access": spans(text, ACCESS), "hex": spans(text, HEX)}
    named = [_named(c, i, kind) for i, (kind, c) in enumerate(kinds.items())]
    seen = own.select("doc_id", F.array_sort(F.concat(*named)).alias("base"), spans(text, CANDIDATE).alias("candidates"), F.xxhash64("doc_id", "text").alias("key1"), F.xxhash64(F.lit("second"), "doc_id", "text").alias("key2"))
    seen = written(seen, "secret-spans")
    # equal rows have equal candidates: one row for each is tested
    # base spans in blocks with their first start and last end, so that a candidate looks into few blocks
    parts = f"transform(sequence(0, cast(floor(greatest(size(base) - 1, 0) / {BLOCK}) as int)), k -> slice(base, k * {BLOCK} + 1, {BLOCK}))"
    blocks = f"transform({parts}, p -> struct(array_min(transform(p, b -> b.start)) as lo, array_max(transform(p, b -> b.end)) as hi, p as p))"
    free = "filter(candidates, c -> not exists(blocks, k -> k.lo < c.end and c.start < k.hi and exists(k.p, b -> b.start < c.end and c.start < b.end)))"
    some = seen.filter("size(candidates) > 0").withColumn("blocks", F.expr(blocks))
    rows = some.select("key1", "key2", F.explode(F.expr(free)).alias("c")).select("key1", "key2", "c.start", "c.end", _battery(F.col("c.found")).alias("t")).filter("t.n >= 2")
    binned = written(_p_bins(written(_tested(rows), "tested")), "binned")
    limits = _thresholds(binned)
    if limits:
        fits = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))[F.col("class")]
        random = binned.filter((F.col("statistic") <= PASS) & (F.col("bin") >= fits)).groupBy("key1", "key2").agg(F.collect_set(F.struct("start", F.lit(3).alias("order"), "end", F.lit("random").alias("kind"))).alias("random"))
        seen = seen.join(written(random, "random-spans"), ["key1", "key2"], "left")
    else:
        seen = seen.withColumn("random", F.lit(None).cast("array<struct<start:int,order:int,end:int,kind:string>>"))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.array_sort(F.concat("base", F.coalesce("random", F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>"))))
    return seen.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(every).alias("spans"), F.coalesce(F.size("random"), F.lit(0)).cast("long").alias("n_random"))
