"""Token ids in binary files: documents in ascending doc_id order, coded block by block.

``write_files`` encodes texts with the tokenizers library, appends the end id to each document and writes the stream of ids in
blocks of BLOCK ids. A file is a Parquet file whose rows are blocks in order; Spark commits files, so a task that is lost or
runs twice leaves nothing behind. A block says on its own what it holds: a header (magic, version, number of ids, CRC-32 of
the ids), the coded ids (``range_coder``), and which documents its ids belong to. ``read_files`` decodes, checks each block,
and fails on one that doesn't match. ``documents`` puts together what blocks split.

Documents are dealt by ranges of doc_id and, for equal ones, of a hash of the text and a row number, so neither a hot doc_id
nor copies meet in one task; a file is one range. Where a document starts among all ids follows from the files'
totals, one row for each file. A task holds LANES blocks at a time.

Defined cases: a null text is empty, and an empty text is the end id only. A null doc_id comes before all others and is
returned as null. Rows with equal doc_ids stand next to each other, in the order of their texts' hash, and each is a document.
The strings of special tokens in a text are those tokens, as the library has it. An empty table gives no blocks and no rows.
Extra columns are not read. Vocabularies have up to 65,536 ids.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import range_coder
from .range_coder import BLOCK
from .store import shared_dir, small, written

#: The id appended to each document, unless another is given.
END_ID = 0
#: Blocks coded side by side, and held by a task.
LANES = 1024
#: Stretches of text whose ids a worker keeps, from task to task: about 80 MB. The first ones met are kept, so the frequent ones are.
KEPT = 600_000
#: Longer stretches are encoded each time.
LONGEST_KEPT = 48

_HEADER = struct.Struct("<4sHHIII")  # magic, version, spare, number of ids, their CRC-32, bytes that follow
_MAGIC, _VERSION = b"TIDB", 1
_BLOCKS = "file int, block long, first_document long, doc_ids array<bigint>, counts array<int>, coded binary"
_PIECES = "file int, document long, doc_id long, at long, n long, crc long, ids binary"


class Encoder:
    """The ids that the library gives a text, with a memory of stretches.

    The vocabulary's pattern never joins two of these stretches (a run without white space and one space before
    it, or white space), so a text's ids are its stretches' ids one after the other. New stretches go to the library as
    lines of one text; a line feed is a word of its own there, and none is in them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.line_feed = self.library.encode("\n", add_special_tokens=False).ids
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.stretches = re.compile(f" ?[^{space}]+|[{space}]+(?![^{space}])|[{space}]+").findall
        self.blank = re.compile(f"[{space}]").match
        self.known: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u2").tobytes() for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def _new(self, stretches: list[str]) -> dict[str, bytes]:
        """The ids of new stretches, a few hundred in one call."""
        words = [s for s in stretches if not self.blank(s[1:] if s[0] == " " else s)] if len(self.line_feed) == 1 else []
        found: dict[str, bytes] = {}
        for i in range(0, len(words), 512):
            own = words[i : i + 512]
            ids = np.frombuffer(self._ids(["\n".join(own)])[0], "<u2")
            at = np.nonzero(ids == self.line_feed[0])[0].tolist()
            if len(at) == len(own) - 1:
                data = ids.tobytes()
                found.update(zip(own, (data[2 * a : 2 * z] for a, z in zip([0, *(x + 1 for x in at)], [*at, len(ids)], strict=True)), strict=True))
        rest = [s for s in stretches if s not in found]
        return found | dict(zip(rest, self._ids(rest), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 16-bit integers."""
        cut: list = [[] if not x else x if any(s in x for s in self.special) else self.stretches(x) for x in texts]
        known, get = self.known, self.known.get
        new = self._new(list(set().union(*(x for x in cut if type(x) is list)).difference(known)))
        known.update(new)
        out = [self._ids([x])[0] if type(x) is str else b"".join(map(get, x)) for x in cut]
        room = KEPT - len(known) + len(new)
        for i, s in enumerate(new):
            if i >= room or len(s) > LONGEST_KEPT:
                del known[s]
        return out


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and worker."""
    return Encoder(path)


def _packed(ids: np.ndarray, coded: bytes) -> bytes:
    return _HEADER.pack(_MAGIC, _VERSION, 0, len(ids), zlib.crc32(ids.astype("<u2").tobytes()), len(coded)) + coded


def _blocks(path: str, end: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one range of documents, which come in order."""
    encode, file = encoder(path).encode, TaskContext.get().partitionId()
    last = np.array([end], "<u2").tobytes()
    waiting: list[tuple[int | None, bytes]] = []  # documents, or what is left of the first one
    size, block, document = 0, 0, 0

    def coded(whole: bool) -> Iterator[pa.RecordBatch]:
        nonlocal size, block, document
        ids = np.frombuffer(b"".join(x for _, x in waiting), "<u2")
        n = len(ids) if whole else len(ids) // BLOCK * BLOCK
        parts = [ids[i : i + BLOCK] for i in range(0, n, BLOCK)]
        ends, owners = np.cumsum([len(x) // 2 for _, x in waiting]), [k for k, _ in waiting]
        rows = []
        for k, code in enumerate(range_coder.encode(parts) if parts else []):
            a, z = k * BLOCK, k * BLOCK + len(parts[k])
            i, j = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(ends, z, side="left")) + 1
            bounds = np.clip(np.concatenate([[a], ends[i:j]]), a, z)
            rows.append((file, block + k, document + i, owners[i:j], np.diff(bounds).tolist(), _packed(parts[k], code)))
        done = int(np.searchsorted(ends, n, side="right"))
        document, block = document + done, block + len(parts)
        left = waiting[done:]
        if left and n > (before := int(ends[done - 1]) if done else 0):
            left[0] = (left[0][0], left[0][1][2 * (n - before) :])
        waiting[:] = left
        size = sum(len(x) for _, x in left) // 2
        if rows:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["file", "block", "first_document", "doc_ids", "counts", "coded"])

    for batch in batches:
        for i in range(0, batch.num_rows, 256):  # a few texts at a time
            doc_ids, texts = (batch.column(k).slice(i, 256).to_pylist() for k in (0, 1))
            for k, ids in zip(doc_ids, encode(texts), strict=True):
                waiting.append((k, ids + last))
                size += len(ids) // 2 + 1
            if size >= LANES * BLOCK:
                yield from coded(False)
    yield from coded(True)
    pa.default_memory_pool().release_unused()


def write_files(docs: DataFrame, vocabulary: str, path: str, end: int = END_ID) -> None:
    """Write the documents of ``docs`` (doc_id, text) under ``path``, which must be new.

    Row numbers differ only between rows that are equal, so a task that runs again gives the same file.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "tie", "row"]
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(functools.partial(_blocks, vocabulary, end), _BLOCKS).write.parquet(path)


def _decoded(with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents' pieces in the blocks of ``batches``; pieces of blocks next to each other are put together."""
    rows: list[tuple] = []

    def pieces() -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda x: x[:2])
        heads = [_HEADER.unpack_from(x[5]) for x in rows]
        bodies = [x[5][_HEADER.size :] for x in rows]
        for h, body in zip(heads, bodies, strict=True):
            if h[0] != _MAGIC or h[1] != _VERSION or h[5] != len(body):
                raise ValueError("this is not a whole block of token ids")
        ids = range_coder.decode(bodies, [h[3] for h in heads])
        if any(zlib.crc32(x.astype("<u2").tobytes()) != h[4] for x, h in zip(ids, heads, strict=True)):
            raise ValueError("a block's token ids don't match its checksum")
        out: list[list] = []
        for (file, block, first, owners, counts, _), block_ids in zip(rows, ids, strict=True):
            data, at = block_ids.astype("<u4").tobytes(), 0
            for k, (owner, n) in enumerate(zip(owners, counts, strict=True)):
                own = data[4 * at : 4 * (at + n)]
                if k == 0 and out and out[-1][:2] == [file, first] and out[-1][3] + out[-1][4] == block * BLOCK:
                    out[-1][4] += n
                    out[-1][5] = zlib.crc32(own, out[-1][5])
                    if with_ids:
                        out[-1][6] += own
                else:
                    out.append([file, first + k, owner, block * BLOCK + at, n, zlib.crc32(own), own if with_ids else None])
                at += n
        rows.clear()
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["file", "document", "doc_id", "at", "n", "crc", "ids"])

    for batch in batches:
        for i in range(0, batch.num_rows, LANES):
            rows += zip(*(c.to_pylist() for c in batch.slice(i, LANES).columns), strict=True)
            if len(rows) >= LANES:
                yield from pieces()
    if rows:
        yield from pieces()


def read_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Pieces of documents: file, document (its number in the file), doc_id, at (place in the file), n, crc, ids (32 bits each)."""
    return spark.read.schema(_BLOCKS).parquet(path).mapInArrow(functools.partial(_decoded, with_ids), _PIECES)


def _times(matrix: list[int], vector: int) -> int:
    total, k = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[k]
        vector, k = vector >> 1, k + 1
    return total


@functools.lru_cache(64)
def _zeros(power: int) -> list[int]:
    """What 2 ** power zero bits after some bytes do to their CRC-32, a 32 by 32 matrix over bits."""
    if power == 0:
        return [0xEDB88320, *(1 << k for k in range(31))]
    half = _zeros(power - 1)
    return [_times(half, x) for x in half]


def joined_crc(first: int, second: int, size: int) -> int:
    """The CRC-32 of two byte strings one after the other, from theirs and the size of the second."""
    bits, power = 8 * size, 0
    while bits:
        if bits & 1:
            first = _times(_zeros(power), first)
        bits, power = bits >> 1, power + 1
    return first ^ second


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for parts in batch.column(2).to_pylist():
            crc = parts[0]["crc"]
            for x in parts[1:]:
                crc = joined_crc(crc, x["crc"], 4 * x["n"])
            out.append(crc)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["file", "document", "ids_crc32"])


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """file and before: the ids of all files before it. One row for each file."""
    sizes = spark.read.schema(_BLOCKS).parquet(path).groupBy("file").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return small(written(sizes.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "file-starts"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files under ``path``, from its decoded ids.

    Documents are put together from few pieces: one for each LANES blocks that they reach into.
    """
    pieces = written(read_files(spark, path, with_ids=False).drop("ids"), "token-pieces")
    whole = pieces.groupBy("file", "document").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("parts"), F.min("crc").alias("crc"))
    whole = written(whole, "token-documents")
    split = whole.filter("parts > 1").select("file", "document")
    parts = pieces.join(small(split), ["file", "document"]).groupBy("file", "document").agg(F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("parts"))
    crcs = written(parts.mapInArrow(_joined, "file int, document long, ids_crc32 long"), "token-crcs")
    both = whole.join(small(crcs), ["file", "document"], "left").join(_starts(spark, path), "file")
    return both.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", F.coalesce("ids_crc32", "crc").alias("ids_crc32"))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.frombuffer(b"".join(x["ids"] for x in parts), "<u4").astype(np.int32) for parts in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (array of int, the end id with them) of each document in the files under ``path``."""
    whole = read_files(spark, path).groupBy("file", "document").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    placed = whole.join(_starts(spark, path), "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "parts")
    return placed.mapInArrow(_whole, "doc_id long, start long, ids array<int>")


def token_files(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write ``docs`` as files in the shared folder and read them back: ``digests`` of what was read."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_files(docs, vocabulary, path)
    return digests(spark, path)
