"""Phrase collocations from weighted distinct pieces, counted in duckdb bucket by bucket.

Texts are cut into pieces, and equal pieces of a language become one row with a multiplicity, so copies and repeated
lines cost one row each. N-grams are counted in two passes over the distinct pieces: words, and pairs by their hash alone; then
the phrases of two to four words whose pairs all have a frequent hash (a phrase can't be more frequent than its pairs, and a hash
not less than its pairs, so nothing is lost). Which hashes are frequent is a bitmap of at most 16 MB; what it lets through
wrongly is counted and dropped by its count. A task numbers the words of its bucket of pieces and counts the n-grams in a
duckdb database on disk with a memory limit; its counts are dealt by n-gram and summed in duckdb again, one row for each
task and n-gram, so a word pair that is everywhere weighs no more than another.

A candidate needs the counts of its parts for each cut: it sends a request for each part, and requests and counts meet by a
shuffled join. Candidates of each language are ranked within shares first, then what is left.

duckdb's database and spill files are scratch of one task in the worker's temporary folder, as Spark's own spills are;
they go when the task ends, and nothing else reads them.

Defined cases: a null text is empty; a null language is ``und``. Empty pieces and texts have no words. Repeated rows count each
time. Extra columns are not read. An empty table gives no rows. A phrase has one row in its language, so ranks are never tied.
"""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import bitmap, written

#: Words of a phrase, and occurrences that it needs.
LONGEST, LEAST = 4, 30
#: A phrase goes if a longer one around it has so many of its occurrences, in percent.
ABSORBED_PERCENT = 80
#: Phrases of a language.
TOP = 2000
#: Where texts are cut into pieces, and what is between words.
CUTS, BLANKS = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"

#: Pieces whose words a task looks at together, and hashes of pairs that it sends together.
CHUNK, SENT = 50_000, 1_000_000
#: duckdb's memory in a task; it spills beyond it.
MEMORY = "128MB"
#: Buckets of pairs' hashes for each shuffle partition.
BUCKETS = 8
#: Shares that a language's candidates are ranked in first.
SHARES = 64

_STEP = 0x9E3779B97F4A7C15  # a phrase's hash is its words' hashes as digits to this base, modulo 2 ** 64
_COUNTS = "lang string, phrase string, words int, h long, f long, pairs binary"
_NAMES = ["lang", "phrase", "words", "h", "f", "pairs"]


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece (lower-cased words with one space between) and k, how often it occurs, for the distinct pieces of ``docs``."""
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(lower, CUTS)).alias("piece"))
    plain = cut.withColumn("piece", F.btrim(F.regexp_replace("piece", BLANKS, " "), F.lit(" "))).filter("piece <> ''")
    return plain.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("k"))


def _database(folder: str) -> duckdb.DuckDBPyConnection:
    return duckdb.connect(f"{folder}/counts", config={"memory_limit": MEMORY, "threads": 1, "temp_directory": f"{folder}/spill", "preserve_insertion_order": False})


class _Words:
    """The words of a bucket by number, a language's words apart from another's, with their hashes."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.hashes = np.zeros(1024, np.uint64)

    def numbers(self, keys: pa.Array) -> np.ndarray:
        """The numbers of keys (language, tab, word)."""
        coded = keys.dictionary_encode()
        own = np.empty(len(coded.dictionary), np.int32)
        for i, key in enumerate(coded.dictionary.to_pylist()):
            k = self.number.get(key)
            if k is None:
                k = self.number[key] = len(self.number)
                if k == len(self.hashes):
                    self.hashes = np.concatenate([self.hashes, np.zeros(k, np.uint64)])
                self.hashes[k] = xxhash.xxh64_intdigest(key)
            own[i] = k
        return own[coded.indices.to_numpy(zero_copy_only=False)]


def _marked(marks: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(8 * len(marks) - 1)
    return (marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of ``batches``, CHUNK or a little more at a time, so that a chunk's words are looked up once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _sent(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of hashes (h, f) as one row for each bucket of hashes, h its number: both columns' bytes, one after the other."""
    held: list[pa.RecordBatch] = []

    def packed() -> Iterator[pa.RecordBatch]:
        h, f = (np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in (0, 1))
        held.clear()
        bucket = (h.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        own, at = np.unique(bucket[order], return_index=True)
        rows = [h[x].tobytes() + f[x].tobytes() for x in np.split(order, at[1:])]
        none = pa.nulls(len(own), pa.string())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(np.full(len(own), 2, np.int32)), pa.array(own), pa.nulls(len(own), pa.int64()), pa.array(rows, pa.binary())], _NAMES)

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= SENT:
            yield from packed()
    if sum(x.num_rows for x in held):
        yield from packed()


def _counted(frequent: Broadcast | None, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of a bucket of pieces with their weighted counts.

    Without ``frequent`` these are words, and pairs by hash only; with that bitmap, phrases whose pairs are all in it.
    """
    marks = np.frombuffer(frequent.value, np.uint8) if frequent else None
    step = np.uint64(_STEP)
    with tempfile.TemporaryDirectory() as folder, _database(folder) as db:
        words = _Words()
        db.execute("create table grams (a int, b int, c int, d int, k bigint)")
        db.execute("create table pairs (h bigint, k bigint)")
        for chunk in _chunks(batches):
            lists = pc.split_pattern(_one(chunk.column("piece")), " ")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(chunk.num_rows), sizes)
            weight = chunk.column("k").to_numpy()[owner]
            number = words.numbers(pc.binary_join_element_wise(_one(chunk.column("lang")).take(pa.array(owner)), lists.flatten(), "\t"))
            pair = np.zeros(len(owner), bool)
            pair[:-1] = owner[1:] == owner[:-1]
            h = words.hashes[number]
            both = h[:-1] * step + h[1:]
            if marks is None:
                here = np.nonzero(pair)[0]
                db.register("new", pa.table([both[here].view(np.int64), weight[here]], ["h", "k"])).execute("insert into pairs select * from new")
                found = [(1, np.ones(len(owner), bool))]
            else:
                pair[:-1] &= _marked(marks, both)
                three, four = np.zeros(len(owner), bool), np.zeros(len(owner), bool)
                three[:-1] = pair[:-1] & pair[1:]
                four[:-2] = three[:-2] & pair[2:]
                found = [(2, pair), (3, three), (4, four)]
            for n, here in found:
                at = np.nonzero(here)[0]
                columns = [number[at + i] if i < n else np.full(len(at), -1, np.int32) for i in range(LONGEST)]
                db.register("new", pa.table([*columns, weight[at]], ["a", "b", "c", "d", "k"])).execute("insert into grams select * from new")
        yield from _sent(db.sql("select h, sum(k)::bigint as f from pairs group by h").to_arrow_reader(20_000), buckets)
        keys = pa.array(list(words.number), pa.string())
        split = pc.split_pattern(keys, "\t", max_splits=1, reverse=True) if len(keys) else pa.array([], pa.list_(pa.string()))
        langs, texts = pc.list_element(split, 0), pc.list_element(split, 1)
        for batch in db.sql("select a, b, c, d, sum(k)::bigint as f from grams group by a, b, c, d").to_arrow_reader(20_000):
            codes = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(LONGEST)]
            length = sum((c >= 0).astype(np.int32) for c in codes)
            for n in np.unique(length):
                rows = np.nonzero(length == n)[0]
                own = [c[rows] for c in codes[:n]]
                h = words.hashes[own[0]]
                for c in own[1:]:
                    h = h * step + words.hashes[c]
                phrase = pc.binary_join_element_wise(*(texts.take(pa.array(c)) for c in own), " ") if n > 1 else texts.take(pa.array(own[0]))
                f = batch.column(LONGEST).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(own[0])), phrase, pa.array(np.full(len(rows), n, np.int32)), pa.array(h.view(np.int64)), f, pa.nulls(len(rows), pa.binary())], _NAMES)
    pa.default_memory_pool().release_unused()


def _summed(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of a bucket of partial counts with ``least`` occurrences or more, and all words; pairs without a phrase are those of a hash."""
    with tempfile.TemporaryDirectory() as folder, _database(folder) as db:
        db.execute("create table parts (lang varchar, phrase varchar, words int, h bigint, f bigint)")
        db.execute("create table pairs (h bigint, f bigint)")
        for batch in batches:
            packed = [x for x in batch.column("pairs").to_pylist() if x]
            if packed:
                both = [np.frombuffer(x, np.int64).reshape(2, -1) for x in packed]
                db.register("new", pa.table([np.concatenate([x[i] for x in both]) for i in (0, 1)], ["h", "f"])).execute("insert into pairs select * from new")
            if len(packed) < batch.num_rows:
                db.register("new", pa.table(batch)).execute("insert into parts select lang, phrase, words, h, f from new where phrase is not null")
        yield from db.sql(f"select null::varchar as lang, null::varchar as phrase, 2::int as words, h, sum(f)::bigint as f, null::blob as pairs from pairs group by h having sum(f) >= {least:d}").to_arrow_reader(20_000)
        sums = f"select lang, phrase, words, any_value(h) as h, sum(f)::bigint as f, null::blob as pairs from parts group by lang, phrase, words having words = 1 or sum(f) >= {least:d}"
        yield from db.sql(sums).to_arrow_reader(20_000)
    pa.default_memory_pool().release_unused()


def _pass(distinct: DataFrame, least: int, frequent: Broadcast | None, name: str) -> DataFrame:
    """What ``_counted`` finds, summed over all buckets, as a written table. Equal n-grams have equal hashes, and equal hashes a bucket."""
    buckets = BUCKETS * int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = distinct.mapInArrow(functools.partial(_counted, frequent, buckets), _COUNTS)
    return written(parts.repartition("h").mapInArrow(functools.partial(_summed, least), _COUNTS).drop("pairs"), name)


def _marks(frequent: DataFrame) -> Broadcast:
    """A bitmap of the hashes of ``frequent``, 16 MB at most, for all tasks."""
    marks, bits = bitmap(frequent, F.col("h"))
    whole = bytearray(bits // 8)
    for part, some in marks.collect():
        whole[part * 4096 : part * 4096 + len(some)] = some
    return frequent.sparkSession.sparkContext.broadcast(bytes(whole))


def ngrams(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words and f of the phrases of one to four words with ``least`` occurrences or more, and lang and n, its words."""
    distinct = written(pieces(docs), "pieces")
    first = _pass(distinct, least, None, "words-and-pairs")
    words = first.filter("phrase is not null")
    longer = _pass(distinct, least, _marks(first.filter("phrase is null")), "phrases")
    counts = words.filter(F.col("f") >= least).unionByName(longer).select("lang", "phrase", "words", "f")
    return written(counts, "ngrams"), written(words.groupBy("lang").agg(F.sum("f").alias("n")), "words-by-language")


def _part(first: str, size: str) -> Column:
    return F.expr(f"array_join(slice(w, {first}, {size}), ' ')")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r and score of each phrase of two or more words of ``counts``, at its lowest-scoring cut."""
    candidates = counts.filter("words > 1").withColumn("w", F.split("phrase", " ")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    requests = candidates.select("lang", "phrase", "words", F.col("f").alias("a"), "cut", F.explode(F.array(F.struct(F.lit(0).alias("side"), _part("1", "cut").alias("part")), F.struct(F.lit(1).alias("side"), _part("cut + 1", "words - cut").alias("part")))).alias("x"))
    requests = requests.select("lang", F.col("x.part").alias("part"), F.col("x.side").alias("side"), "phrase", "words", "a", "cut")
    answers = written(requests, "part-requests").join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    sides = answers.groupBy("lang", "phrase", "words", "a", "cut").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr("cast(cast(a as decimal(19, 0)) * 2000000 div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0))) as long)")
    lowest = sides.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    return lowest.select("lang", "phrase", "words", "a", "x.l", "x.r", "x.score")


def absorbed(counts: DataFrame, percent: int = ABSORBED_PERCENT) -> DataFrame:
    """lang and phrase of the phrases of ``counts`` with ``percent`` of their occurrences in a longer one."""
    longer = counts.filter("words > 2").withColumn("w", F.split("phrase", " "))
    sizes = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("at", F.explode(F.expr("sequence(1, words - size + 1)")))
    inside = sizes.select("lang", _part("at", "size").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    both = inside.join(counts.filter("words > 1").select("lang", "phrase", "f"), ["lang", "phrase"])
    return both.filter(F.expr(f"100 * cast(most as decimal(19, 0)) >= {percent} * cast(f as decimal(19, 0))")).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, percent: int = ABSORBED_PERCENT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` collocations of each language of ``docs`` (lang, text)."""
    counts, totals = ngrams(docs, least)
    kept = scored(counts).join(absorbed(counts, percent), ["lang", "phrase"], "left_anti").withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
with p as (select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from documents),
     g as materialized (select lang, z as words, phrase, count(*) as f from (
         select lang, z, array_to_string(w[i:i + z - 1], ' ') as phrase from (select lang, w, z, unnest(range(1, len(w) + 2 - z)) as i from p cross join (select unnest([1, 2, 3, 4]) as z) where len(w) >= z)) group by all),
     t as (select lang, sum(f)::bigint as n from g where words = 1 group by lang),
     c as materialized (select lang, words, phrase, f as a, string_split(phrase, ' ') as w from g where words > 1 and f >= 30),
     s as (select lang, phrase, words, a, k, array_to_string(w[1:k], ' ') as x, array_to_string(w[k + 1:], ' ') as y from (select *, unnest(range(1, words)) as k from c)),
     q as (select s.lang, s.phrase, a, k, gx.f as l, gy.f as r, (2000000::hugeint * a) // (gx.f::hugeint + gy.f) as score
           from s join g gx on gx.lang = s.lang and gx.phrase = s.x join g gy on gy.lang = s.lang and gy.phrase = s.y),
     b as (select * from q qualify row_number() over (partition by lang, phrase order by score, k) = 1),
     i as (select lang, array_to_string(w[j:j + z - 1], ' ') as phrase, max(a) as most from (select *, unnest(range(1, words + 2 - z)) as j from (select *, unnest(range(2, words)) as z from c)) group by all),
     d as (select b.* from b left join i using (lang, phrase) where most is null or 100::hugeint * most < 80::hugeint * a),
     o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from d)
select o.lang, rank, phrase, a, l, r, t.n, score::bigint as score from o join t using (lang) where rank <= 2000
"""
