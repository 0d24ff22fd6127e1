"""Benchmark decontamination by size-partitioned MinHash containment search.

Finds the benchmark items whose five-word shingles stand in a document to 80 percent or more. A document is
long and an item is short, so the MinHash of a whole document says nothing about an item. Items are therefore
partitioned by the size of their set, and the documents' side is partitioned alike: for items of up to S and over
S / 2 shingles, each document is cut into windows of 2 * S shingles that overlap by half, so that a passage
lies whole within one window and makes up a fifth of it or more. One pass of circulant MinHash over blocks of
the least S serves all sizes, as the minima of larger blocks are minima of smaller ones. A window and an item
that agree in any coordinate are a candidate; a passage is missed with a chance under 2 in a million. Each
candidate is verified on the document's whole shingle set and the item's, where the window was found. Items
under TINY shingles are looked up shingle by shingle.

Items are a stated query set. Up to BLOCK_ITEMS items of BLOCK_CHARS characters are sent to the executors as one index, and
one pass over the documents without any shuffle finds all, whatever copies or hot sources these have. Larger sets stay tables
(``_joined``): a bitmap of the items' MinHash values, of bounded size, drops windows' values where documents are read; values that
are left are joined with the items', and candidates are verified by joins on document and shingle, so that no text is sent
twice and neither a frequent item nor a long document is one task. Both ways give the same rows, but for passages missed by chance.

Defined cases: null, empty and wordless texts, items as well as documents, match nothing. Fewer than five
words are one shingle. Repeated document rows give a row each; an item_id given in several rows gives a row for
each. Null ids stay null. Extra columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .near_dedup import circulant
from .store import bitmap, fresh, only, small, written

#: Matches have 100 * shared >= PERCENT * the item's shingles.
PERCENT = 80
COORDS = 64
#: Items with fewer shingles are looked up shingle by shingle; the smallest windows' stride.
TINY, STRIDE = 8, 16
#: Items and their characters that are sent as one index, at most.
BLOCK_ITEMS, BLOCK_CHARS = 5_000, 4_000_000

_FOUND = "item_id long, doc_id long, n_item long, n_shared long"
_ITEM_SIDE = "item long, n_item long, stride int, values array<long>, shingles array<long>"


class ItemIndex:
    """Some items: their sets, and by size class the items' MinHash values."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        sets = list(ta.shingle_sets(pa.array(texts, pa.string())))
        some = [i for i, own in enumerate(sets) if len(own)]
        self.ids, self.sets = [ids[i] for i in some], [sets[i] for i in some]
        tiny = [i for i, own in enumerate(self.sets) if len(own) < TINY]
        self.tiny = self._table(np.concatenate([self.sets[i] for i in tiny]), np.repeat(tiny, [len(self.sets[i]) for i in tiny])) if tiny else None
        self.classes: dict[int, list] = {}
        strides = np.array([_stride(len(own)) for own in self.sets], np.int64)
        for stride in sorted({int(s) for s in strides if s}):
            own = np.flatnonzero(strides == stride)
            of = np.concatenate([[0], np.cumsum([len(self.sets[i]) for i in own])])
            sig = circulant(np.concatenate([_low(self.sets[i]) for i in own]), of, COORDS)
            self.classes[stride] = [self._table(sig[:, k].astype(np.uint64), own) for k in range(COORDS)]

    @staticmethod
    def _table(values: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(values, kind="stable")
        maybe = np.zeros(1 << 16, bool)
        maybe[values & np.uint64(0xFFFF)] = True
        return values[order], np.asarray(items)[order], maybe


def _stride(size: int) -> int:
    """The stride of the windows that find items of so many shingles; 0 for items that are looked up shingle by shingle."""
    return max(STRIDE, 1 << (size - 1).bit_length()) if size >= TINY else 0


def _low(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(32)).astype(np.uint32)


def _hits(table: tuple, values: np.ndarray) -> Iterator[tuple[int, int]]:
    """(place in ``values``, item) for all equal values."""
    keys, items, maybe = table
    for at in np.flatnonzero(maybe[(values & np.uint64(0xFFFF) if values.dtype == np.uint64 else values & np.uint32(0xFFFF))]):
        value = np.uint64(values[at])
        for j in range(np.searchsorted(keys, value, "left"), np.searchsorted(keys, value, "right")):
            yield int(at), int(items[j])


def _windows(sh: np.ndarray, of: np.ndarray, strides: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each stride, the text of every window and its MinHash values."""
    docs = np.flatnonzero(np.diff(of))
    if not len(docs) or not strides:
        return
    count = -(-np.diff(of)[docs] // STRIDE)
    doc = np.repeat(docs, count)
    first = np.concatenate([[0], np.cumsum(count)])
    start = of[doc] + STRIDE * (np.arange(len(doc)) - np.repeat(first[:-1], count))
    least = circulant(_low(sh), np.append(start, len(sh)), COORDS)
    stride = STRIDE
    for wanted in sorted(strides):
        while stride < wanted:  # pairs of blocks of a text become one
            place = np.arange(len(doc)) - np.searchsorted(doc, doc)
            even = np.flatnonzero(place % 2 == 0)
            least, doc, stride = np.minimum.reduceat(least, even), doc[even], stride * 2
        window = least.copy()
        same = doc[:-1] == doc[1:]
        window[:-1][same] = np.minimum(least[:-1][same], least[1:][same])
        yield wanted, doc, window


def _candidates(index: ItemIndex, sh: np.ndarray, of: np.ndarray) -> set[tuple[int, int]]:
    """(text, item) pairs that share a MinHash value of a window, or a shingle of a tiny item."""
    found: set[tuple[int, int]] = set()
    if index.tiny and len(sh):
        found.update((int(np.searchsorted(of, at, "right")) - 1, item) for at, item in _hits(index.tiny, sh))
    for stride, doc, window in _windows(sh, of, list(index.classes)):
        for k, table in enumerate(index.classes[stride]):
            found.update((int(doc[at]), item) for at, item in _hits(table, np.ascontiguousarray(window[:, k])))
    return found


def _search(index: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    items: ItemIndex = index.value
    for batch in batches:
        data, off = ta.utf8(batch.column(1))
        rows: list[tuple[int | None, int, int, int]] = []
        for i, j in ta.chunks(off):
            part = ta.Words(data[off[i] : off[j]], off[i : j + 1] - off[i])
            sh, of = ta.shingles(part.hashes(True), part.of)
            own, last = np.zeros(0, np.uint64), -1
            for doc, item in sorted(_candidates(items, sh, of)):
                if doc != last:
                    own, last = np.unique(sh[of[doc] : of[doc + 1]]), doc
                wanted = items.sets[item]
                shared = len(np.intersect1d(wanted, own, assume_unique=True))
                if 100 * shared >= PERCENT * len(wanted):
                    rows.append((items.ids[item], i + doc, len(wanted), shared))
        ids, docs, n, shared = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), batch.column(0).take(pa.array(docs, pa.int64())), pa.array(n, pa.int64()), pa.array(shared, pa.int64())], ["item_id", "doc_id", "n_item", "n_shared"]
        )


def _tagged(values: np.ndarray, stride: int) -> np.ndarray:
    """64-bit keys of MinHash values by stride and coordinate, a column each; of shingles at stride 0."""
    if not stride:
        return ta.mix(values)
    tags = np.arange(COORDS, dtype=np.uint64) + np.uint64(COORDS * stride.bit_length())
    return ta.mix(values.astype(np.uint64) | tags << np.uint64(32))


def _item_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) to size, stride, keys and shingles of each item that has any."""
    for batch in batches:
        sets = list(ta.shingle_sets(batch.column(1)))
        some = [i for i, own in enumerate(sets) if len(own)]
        strides = [_stride(len(sets[i])) for i in some]
        large = [i for i, stride in zip(some, strides, strict=True) if stride]
        of = np.concatenate([[0], np.cumsum([len(sets[i]) for i in large])]).astype(np.int64)
        least = dict(zip(large, circulant(np.concatenate([_low(sets[i]) for i in large]), of, COORDS), strict=True)) if large else {}
        values = [_tagged(least.get(i, sets[i]), stride).view(np.int64) for i, stride in zip(some, strides, strict=True)]
        sizes = [len(sets[i]) for i in some]
        lists = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(some, pa.int64())), pa.array(sizes, pa.int64()), pa.array(strides, pa.int32()), pa.array(values, lists), pa.array([sets[i].view(np.int64) for i in some], lists)],
            ["item", "n_item", "stride", "values", "shingles"],
        )


def _window_values(marks: Broadcast, strides: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key1, key2, text) to the keys (key1, key2, value) of each text's windows that may be an item's."""
    for batch in batches:
        data, off = ta.utf8(batch.column(2))
        rows, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for i, j in ta.chunks(off):
            part = ta.Words(data[off[i] : off[j]], off[i : j + 1] - off[i])
            sh, of = ta.shingles(part.hashes(True), part.of)
            found = [(np.repeat(doc, COORDS), _tagged(window, stride).ravel()) for stride, doc, window in _windows(sh, of, [s for s in strides if s])]
            if 0 in strides:
                found.append((np.repeat(np.arange(j - i), np.diff(of)), _tagged(sh, 0)))
            for doc, value in found:
                bit = (value & np.uint64(8 * len(marks.value) - 1)).astype(np.int64)
                hit = np.flatnonzero(marks.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                rows.append(i + doc[hit])
                values.append(value[hit])
        at = pa.array(np.concatenate(rows))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(values).view(np.int64))], ["key1", "key2", "value"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key1, key2, text) to (key1, key2, shingle), each shingle of a text once; one long text is a batch of its own."""
    for batch in batches:
        for i, own in enumerate(ta.shingle_sets(batch.column(2))):
            at = pa.array(np.full(len(own), i))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(own.view(np.int64))], ["key1", "key2", "shingle"])


def _joined(own: DataFrame, queries: DataFrame) -> DataFrame:
    """The matches of any number of items: three scans of the documents, whatever that number is."""
    spark = own.sparkSession
    items = written(queries.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("item", F.monotonically_increasing_id()), "items")
    known = written(items.select("item", "text").mapInArrow(_item_values, _ITEM_SIDE), "item-sets")
    strides = [r["stride"] for r in known.select("stride").distinct().collect()]  # powers of two: 32 rows at most
    values = written(known.select("item", F.explode("values").alias("value")), "item-values")
    parts, bits = bitmap(values, F.col("value"))
    whole = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():  # 16 MB in all at most
        whole[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["marks"], np.uint8)
    marks = spark.sparkContext.broadcast(whole)
    keyed = own.select("doc_id", F.xxhash64("doc_id", "text").alias("key1"), F.xxhash64(F.lit("second"), "doc_id", "text").alias("key2"), "text").filter("text is not null")
    near = keyed.select("key1", "key2", "text").mapInArrow(partial(_window_values, marks, strides), "key1 long, key2 long, value long").distinct()
    pairs = written(written(near, "window-values").join(values, "value").select("key1", "key2", "item").distinct(), "candidates")
    texts = only(keyed.select(F.col("key1").alias("doc_id"), "key2", "text"), pairs.select(F.col("key1").alias("doc_id")))
    stand = written(texts.mapInArrow(_shingles, "key1 long, key2 long, shingle long").distinct(), "candidate-shingles")
    wanted = pairs.join(known.select("item", "n_item", F.explode("shingles").alias("shingle")), "item")
    shared = wanted.join(stand, ["key1", "key2", "shingle"]).groupBy("key1", "key2", "item", "n_item").agg(F.count(F.lit(1)).alias("n_shared"))
    shared = shared.filter(100 * F.col("n_shared") >= PERCENT * F.col("n_item")).join(items.select("item", "item_id", "copies"), "item")
    found = small(written(shared.select("key1", "key2", "item_id", "copies", "n_item", "n_shared"), "contained"))
    each = keyed.select("doc_id", "key1", "key2").join(found, ["key1", "key2"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("item_id", "doc_id", "n_item", "n_shared")


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, doc_id, n_item, n_shared and containment of each item found in a document.

    ``docs`` has doc_id and text, ``items`` has item_id and text.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    queries = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    n, chars = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if n > BLOCK_ITEMS or chars > BLOCK_CHARS:
        found = _joined(own, queries)
    else:
        rows = queries.collect()
        index = spark.sparkContext.broadcast(ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows]))
        found = own.mapInArrow(lambda batches: _search(index, batches), _FOUND)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns; rows with a null doc_id stay."""
    name = fresh("leaked", docs)
    found = contained_items(docs.select("doc_id", "text"), items).select(F.col("doc_id").alias(name)).filter(F.col(name).isNotNull())
    leaked = small(written(found.distinct(), "leaked"))
    return docs.join(leaked, F.col("doc_id").cast("long") == F.col(name), "left_anti")
