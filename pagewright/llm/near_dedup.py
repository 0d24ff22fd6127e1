"""MinHash near-dedup with circulant signatures, banding and exact Jaccard verification.

Links documents whose sets of five-word shingles have 100 * intersection >= percent * union, and labels each
document with the smallest doc_id that it reaches over links. The query op10 links at 85, the pipeline's stage at
80; bands, rows and the cut of signatures follow from the percentage (``fitted``).

How it runs:

1. Sketch (one pass over the texts): a 128-bit digest of the shingle set, band keys, and a signature with one
   byte a coordinate. The signature is circulant: one permutation mixes the shingles, a second one is shifted
   circularly for each coordinate, so two permutations give all coordinates.
2. Documents with equal sets are one class, represented by its smallest doc_id (an aggregation of digests).
   Only representatives go on, so a group of copies costs a row each.
3. Stars: in each band bucket every member is compared with the bucket's smallest member only. Signatures
   drop hopeless pairs; the others are verified on their full sets. Verified links give components.
4. Buckets that still hold several components are compared across components, so that no link is lost where
   a bucket's centre is no near copy of two members that are near copies of each other. Buckets are cut into
   blocks of bounded size; a task gets the signatures of one pair of blocks and names the members that may link.
   Only their full sets are sent to a second task for that pair, which gives back a spanning forest, never all pairs.

Defined cases: null or blank text, and text without words, has an empty set and links with nothing
(n_shingles 0, component_id its own doc_id). Fewer than five words are one shingle. Rows with a null doc_id
take no part in linking and come back with null component_id and kept true. A doc_id given with several texts
links with what any of them links with, and its rows share their component; n_shingles is each row's own. Extra columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .store import fresh, only, small, written

#: Links have 100 * intersection >= percent * union: in op10 PERCENT, in a stage without a contract STAGE_PERCENT.
PERCENT, STAGE_PERCENT = 85, 80
#: The share of pairs at the percentage itself that meet in no band, at most: that of 24 bands of 6 rows at 0.85.
LOSS = (1 - 0.85**6) ** 24
#: Coordinates of a signature, at most.
MOST_COORDS = 150
#: Buckets of up to so many members are compared pair by pair, larger ones by blocks of BLOCK members.
SMALL, BLOCK = 16, 256


class Rule(NamedTuple):
    """What a link is, and how candidates for it are found.

    Pairs whose signatures agree in less than ``least_agreed`` of the coordinates are not verified: five standard
    deviations under the percentage.
    """

    percent: int
    bands: int
    rows: int
    least_agreed: float

    @property
    def coords(self) -> int:
        return self.bands * self.rows


def fitted(percent: int) -> Rule:
    """The rule for a percentage: the longest bands that lose LOSS at most with MOST_COORDS coordinates at most."""
    if not 1 <= percent <= 99:
        raise ValueError("percent must be from 1 to 99")
    share = percent / 100
    need = {rows: math.ceil(math.log(LOSS) / math.log1p(-(share**rows)) - 1e-9) for rows in range(1, 17)}
    rows = max(r for r, bands in need.items() if r == 1 or bands * r <= MOST_COORDS)
    coords = need[rows] * rows
    least = share - 5 * math.sqrt(share * (1 - share) / coords)
    return Rule(percent, need[rows], rows, max(0, math.floor(100 * least)) / 100)


_SHIFT = np.uint32(0x9E3779B1)
_SEEN = "doc_id long, n_shingles long, digest binary, bands array<long>, signature binary"


def circulant(x: np.ndarray, of: np.ndarray, coords: int) -> np.ndarray:
    """Circulant MinHash: for each set (rows of(i) to of(i+1) of ``x``, none empty) ``coords`` minima.

    ``x`` has the shingles after the first permutation, as 32-bit values. Coordinate k is the least value of
    a second, fixed permutation of 0 .. 2^32 - 1 that is shifted circularly by k * _SHIFT.
    """
    out = np.empty((len(of) - 1, coords), np.uint32)
    y = x * np.uint32(0x85EBCA6B)
    t, u = np.empty_like(y), np.empty_like(y)
    shift = np.arange(coords, dtype=np.uint32) * _SHIFT
    for k in range(coords):
        np.add(y, shift[k], out=t)
        np.right_shift(t, np.uint32(16), out=u)
        np.bitwise_xor(t, u, out=t)
        np.multiply(t, np.uint32(0xC2B2AE35), out=t)
        np.right_shift(t, np.uint32(15), out=u)
        np.bitwise_xor(t, u, out=t)
        np.multiply(t, np.uint32(0x27D4EB2F), out=t)
        np.minimum.reduceat(t, of[:-1], out=out[:, k])
    return out


def _sketch(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    seed = np.arange(1, rule.bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for batch in batches:
        data, off = ta.utf8(batch.column(1))
        for i, j in ta.chunks(off):
            part = ta.Words(data[off[i] : off[j]], off[i : j + 1] - off[i])
            sh, of = ta.shingles(part.hashes(True), part.of)
            n = j - i
            count, digest = np.zeros(n, np.int64), [b""] * n
            for d in range(n):
                if of[d + 1] > of[d]:
                    own = np.unique(sh[of[d] : of[d + 1]])
                    count[d] = len(own)
                    both = np.array([own.sum(), ta.mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()], np.uint64)
                    digest[d] = both.tobytes()
            full = np.flatnonzero(count)
            bands, signature = [[]] * n, [b""] * n
            if len(full):
                low = (sh >> np.uint64(32)).astype(np.uint32)
                edges = np.concatenate([of[full], of[-1:]])
                sig = circulant(low, edges, rule.coords)
                key = np.repeat(seed[None], len(full), 0)
                for r in range(rule.rows):
                    key = ta.mix(key + sig[:, r :: rule.rows].astype(np.uint64))
                key = key.view(np.int64)
                small = (sig >> np.uint32(7)).astype(np.uint8)
                for at, d in enumerate(full):
                    bands[d], signature[d] = key[at], small[at].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, n), pa.array(count), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signature, pa.binary())],
                ["doc_id", "n_shingles", "digest", "bands", "signature"],
            )


def sketches(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys and signature of each document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(lambda batches: _sketch(batches, rule), _SEEN)


def _agree(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Keep the pairs (a, b, sa, sb) whose signatures agree often enough."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, rule.coords) for c in (2, 3))
        kept = pa.array((sa == sb).sum(1) >= rule.least_agreed * rule.coords)
        yield batch.select([0, 1]).filter(kept)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The exact test on two sorted sets of shingles."""
    least, most = sorted((len(a), len(b)))
    if not least or 100 * least < percent * most:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Keep the pairs (a, b, ta, tb) whose full sets are near."""
    for batch in batches:
        sets = zip(ta.shingle_sets(batch.column(2)), ta.shingle_sets(batch.column(3)), strict=True)
        yield batch.select([0, 1]).filter(pa.array([linked(x, y, rule.percent) for x, y in sets], pa.bool_()))


def _links(pairs: DataFrame, reps: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of representatives that are linked."""
    sig = reps.select("rep", "signature")
    near = (
        pairs.join(sig.select(F.col("rep").alias("a"), F.col("signature").alias("sa")), "a")
        .join(sig.select(F.col("rep").alias("b"), F.col("signature").alias("sb")), "b")
        .select("a", "b", "sa", "sb")
        .mapInArrow(lambda batches: _agree(batches, rule), "a long, b long")
    )
    near = written(near, "near-pairs")
    own = only(texts, near.select(F.explode(F.array("a", "b")).alias("doc_id")))
    return (
        near.join(own.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
        .join(own.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
        .mapInArrow(lambda batches: _verify(batches, rule), "a long, b long")
    )


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node``, ``label``: the smallest node that each node of ``nodes`` reaches over ``links`` (a, b).

    Each round a node takes the least label among its neighbours' labels, then the label of that label, so
    the rounds grow with the logarithm of a component's width.
    """
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        step = labels.join(heard, "node").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        step = written(step, "labels")
        # a label is a node itself: where that node has a smaller label by now, take it at once
        hop = step.select(F.col("node").alias("label"), F.col("label").alias("hop"))
        after = written(step.join(hop, "label", "left").select("node", "was", F.coalesce("hop", "label").alias("label")), "labels")
        if after.filter("label <> was").isEmpty():
            break
        labels = after.select("node", "label")
    return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _forest(table: pa.Table, rule: Rule) -> pa.Table:
    """Links across components between the members of one pair of blocks, one for each two components that meet."""
    t = table.to_pydict()
    sets = [np.frombuffer(x, np.uint64) for x in t["shingles"]]
    sig = np.frombuffer(b"".join(t["signature"]), np.uint8).reshape(-1, rule.coords)
    label, side = np.array(t["label"]), np.array(t["side"])
    root = {int(x): int(x) for x in label}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    a_out, b_out = [], []
    left = np.flatnonzero(side == 0)
    right = left if len(left) == len(side) else np.flatnonzero(side == 1)
    size = np.array([len(x) for x in sets])
    for i in left:
        near = (sig[right] == sig[i]).sum(1) >= rule.least_agreed * rule.coords
        near &= (label[right] != label[i]) & (100 * np.minimum(size[right], size[i]) >= rule.percent * np.maximum(size[right], size[i]))
        for j in right[near]:
            x, y = top(int(label[i])), top(int(label[j]))
            if x != y and linked(sets[i], sets[j], rule.percent):
                root[max(x, y)] = min(x, y)
                a_out.append(t["rep"][i])
                b_out.append(t["rep"][j])
    return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})


def _busy(table: pa.Table, rule: Rule) -> pa.Table:
    """Of one pair of blocks the members whose signature is near that of a member of another component."""
    sig = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(-1, rule.coords)
    label, side, size = (table[c].to_numpy() for c in ("label", "side", "n_shingles"))
    left = np.flatnonzero(side == 0)
    right = left if len(left) == len(side) else np.flatnonzero(side == 1)
    busy = np.zeros(len(side), bool)
    for i in left:
        near = (sig[right] == sig[i]).sum(1) >= rule.least_agreed * rule.coords
        near &= (label[right] != label[i]) & (100 * np.minimum(size[right], size[i]) >= rule.percent * np.maximum(size[right], size[i]))
        if near.any():
            busy[i] = True
            busy[right[near]] = True
    return table.select(["bucket", "bi", "bj", "rep", "label", "side", "signature"]).filter(pa.array(busy))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [x.tobytes() for x in ta.shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["rep", "shingles"])


def _across(members: DataFrame, reps: DataFrame, texts: DataFrame, labels: DataFrame, rule: Rule) -> DataFrame | None:
    """Links between different components within the buckets that hold several ones; None if none does."""
    known = members.join(labels.select(F.col("node").alias("rep"), "label"), "rep")
    mixed = known.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket", "n")
    known = written(known.join(mixed, "bucket"), "mixed-buckets")
    if known.isEmpty():
        return None
    few = known.filter(F.col("n") <= SMALL)
    pairs = (
        few.select("bucket", F.col("rep").alias("a"), F.col("label").alias("la"))
        .join(few.select("bucket", F.col("rep").alias("b"), F.col("label").alias("lb")), "bucket")
        .filter("a < b and la <> lb")
        .select("a", "b")
        .distinct()
    )
    links = _links(pairs, reps, texts, rule)
    many = known.filter(F.col("n") > SMALL)
    if many.isEmpty():
        return links
    # blocks of about BLOCK members; each task gets two blocks of one bucket
    many = many.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks")).cast("int"))
    spread = many.select("bucket", "rep", "label", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "bucket", "rep", "label", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), (F.col("own") > F.col("other")).cast("int").alias("side")
    )
    pairs_of_blocks = spread.join(reps.select("rep", "signature", "n_shingles"), "rep").select("bucket", "bi", "bj", "rep", "label", "side", "signature", "n_shingles")
    busy = pairs_of_blocks.groupBy("bucket", "bi", "bj").applyInArrow(lambda table: _busy(table, rule), "bucket long, bi int, bj int, rep long, label long, side int, signature binary")
    busy = written(busy, "busy-members")
    sets = only(texts, busy.select(F.col("rep").alias("doc_id"))).select(F.col("doc_id").alias("rep"), "text").mapInArrow(_sets, "rep long, shingles binary")
    block_links = busy.join(sets, "rep").select("bucket", "bi", "bj", "rep", "label", "side", "signature", "shingles").groupBy("bucket", "bi", "bj").applyInArrow(lambda table: _forest(table, rule), "a long, b long")
    return links.unionByName(block_links)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, two hashes of the text, and the text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.select("doc_id", F.xxhash64("text").alias("key1"), F.xxhash64(F.lit("second"), "text").alias("key2"), "text")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (columns doc_id, text)."""
    rule = fitted(percent)
    seen = written(sketches(docs, rule), "sketches")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    if _unique_ids(seen):
        return _labelled(seen, texts, rule, None)
    # ids that come with several texts: a node for each (doc_id, text), numbered in order of doc_id
    keyed = _keyed(docs)
    order = ["doc_id", "key1", "key2"]
    nodes = keyed.filter("doc_id is not null").select(*order).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    texts = written(keyed.join(nodes, order).groupBy("node").agg(F.min("text").alias("text")).withColumnRenamed("node", "doc_id"), "node-texts")
    firsts = nodes.groupBy("doc_id").agg(F.min("node").alias("a"))
    same = nodes.join(firsts, "doc_id").filter("node <> a").select("a", F.col("node").alias("b"))
    by_node = _labelled(written(sketches(texts, rule), "node-sketches"), texts, rule, written(same, "same-ids"))
    ids = nodes.select(F.col("node").alias("component_id"), F.col("doc_id").alias("component"))
    by_node = written(by_node.select(F.col("doc_id").alias("node"), "n_shingles", "component_id").join(ids, "component_id").select("node", "n_shingles", F.col("component").alias("component_id")), "node-labels")
    rows = keyed.drop("text").join(nodes, order, "left").join(by_node, "node", "left")
    # rows without an id have no node: their sets are counted alone
    loose = seen.filter("doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = rows.filter("doc_id is not null").select("doc_id", "n_shingles", "component_id").unionByName(loose)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _labelled(seen: DataFrame, texts: DataFrame, rule: Rule, same: DataFrame | None) -> DataFrame:
    """The result for unique doc_ids, whose sketches are ``seen``; ``same`` has pairs (a, b) that are linked whatever their texts."""
    full = seen.filter("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = written(full.join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"]).select(F.col("doc_id").alias("rep"), "bands", "signature", "n_shingles"), "representatives")
    rows = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("centre")).filter("n > 1")
    members = written(rows.join(shared, "bucket").select("bucket", "rep", "centre"), "buckets")
    star = members.filter("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    nodes = members.select(F.col("rep").alias("node")).distinct()
    links = written(_links(star, reps, texts, rule), "star-links")
    labels = written(components(links, nodes), "components")
    more = _across(members.select("bucket", "rep"), reps, texts, labels, rule)
    if more is not None:
        more = written(more, "cross-links")
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = written(components(links, nodes), "components")
    if same is not None:
        # nodes without a set stand for themselves, others for their class
        of = seen.filter("doc_id is not null").select("doc_id", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(classes, "digest", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("node"))
        of = written(of, "node-classes")
        joined = same.join(of.select(F.col("doc_id").alias("a"), F.col("node").alias("ra")), "a").join(of.select(F.col("doc_id").alias("b"), F.col("node").alias("rb")), "b")
        links = written(links.unionByName(joined.filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "all-links")
        labels = written(components(links, of.select("node").distinct()), "components")
        return _of_nodes(seen, of, labels)
    by_digest = classes.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("component_id"))
    by_digest = written(by_digest, "classes")  # read anew, so that a join splits the rows of a digest that many documents have
    # an empty set has no class: the row keeps its own id
    return (
        seen.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
        .join(by_digest, "digest", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _of_nodes(seen: DataFrame, of: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id by the label of each row's node."""
    named = of.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("component_id"))
    return seen.select("doc_id", "n_shingles").join(named, "doc_id")


def without_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each group, and all others.

    Of rows that share a doc_id one stays, the least by hashes of its text and then of the whole row, so that every run keeps
    the same one; rows with a null doc_id stay.
    """
    found = written(near_duplicates(docs.select("doc_id", "text"), percent), "near-duplicates")
    name = fresh("gone", docs)
    gone = small(written(found.filter("not kept").select(F.col("doc_id").alias(name)).distinct(), "gone"))
    kept = docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
    if _unique_ids(found):
        return kept
    mine, least = fresh("row_key", docs), fresh("least", docs)
    whole = F.to_json(F.struct(*docs.columns))
    keyed = kept.filter("doc_id is not null").withColumn(mine, F.struct(F.xxhash64("text"), F.xxhash64(F.lit("second"), "text"), F.xxhash64(whole), F.xxhash64(F.lit("second"), whole)))
    first = keyed.groupBy(F.col("doc_id").alias(name)).agg(F.min(mine).alias(least))
    one = keyed.join(first, (F.col("doc_id") == F.col(name)) & (F.col(mine) == F.col(least)), "left_semi").drop(mine)
    return kept.filter("doc_id is null").unionByName(one.dropDuplicates(["doc_id"]))


def _unique_ids(seen: DataFrame) -> bool:
    return seen.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty()
