"""Files from relations of objects: replaced streams, edited dictionaries, pruning, and edited page contents.

Objects come from ``pdf.objects`` with ``raw``. A file is one row again at the end, as it was at the start; all files are
written side by side.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pdf import TRAILER, _batches, cells
from .syntax import KEPT, REFERENCE, SHORT, syntax
from .table import STORAGE

_EDITS = "map<string,string>"
#: Tasks that files are put together in, for each partition of a shuffle.
SORTED = 4


def replaced(found: DataFrame, replacements: DataFrame) -> DataFrame:
    """Objects with the streams of ``replacements`` (file, id, stream, width, height) where those are strictly smaller.

    Column ``edits`` has what changes in the dictionaries, as JSON by key.
    """
    new = replacements.select("file", "id", F.col("stream").alias("_stream"), F.create_map(F.lit("Width"), F.col("width").cast("string"), F.lit("Height"), F.col("height").cast("string")).alias("_edits"))
    both = found.join(new, ["file", "id"], "left")
    smaller = F.octet_length("_stream") < F.octet_length("stream")
    out = {"stream": F.when(smaller, F.col("_stream")).otherwise(F.col("stream")), "edits": F.when(smaller, F.col("_edits"))}
    return both.withColumns(out).withColumns({"size_bytes": F.octet_length("stream").cast("long"), "sha256": F.sha2("stream", 256)}).drop("_stream", "_edits")


def encoded_content(ops: DataFrame) -> DataFrame:
    """file, scope and the content stream (binary) of operations: what ``pdf.operations`` reads gives the same rows again."""
    word = F.concat_ws(" ", F.array_join("operands", " "), "operator")
    parts = ops.groupBy("file", "scope").agg(F.array_sort(F.collect_list(F.struct("idx", word.alias("w")))).alias("parts"))
    return parts.select("file", "scope", F.encode(F.array_join(F.transform("parts", lambda x: x["w"]), "\n"), "ISO-8859-1").alias("content"))


#: What new content changes in a dictionary: it is written as it is.
_PLAIN = {"Filter": None, "DecodeParms": None}


def _targets(found: DataFrame, contents: DataFrame) -> DataFrame:
    """file, id and _new of the streams that ``contents`` (file, scope, content) are for: a page's is its own first content stream, the others end empty."""
    listed = F.when(F.col("contents").startswith("["), F.from_json("contents", "array<string>")).otherwise(F.from_json(F.concat(F.lit("["), "contents", F.lit("]")), "array<string>"))
    of_pages = found.filter("page_numbers is not null").select("file", F.col("id").alias("scope"), F.posexplode(listed).alias("place", "id"))
    targets = of_pages.join(contents, ["file", "scope"]).select("file", "id", F.when(F.col("place") == 0, F.col("content")).otherwise(F.lit(b"")).alias("_new"))
    forms = found.filter(F.get_json_object("value", "$.Subtype") == "/Form").select("file", "id")
    return targets.unionByName(forms.join(contents.withColumnRenamed("scope", "id"), ["file", "id"]).select("file", "id", F.col("content").alias("_new")))


def with_content(found: DataFrame, contents: DataFrame) -> DataFrame:
    """Objects whose pages or forms (``scope``) have new content: a page's goes to its own first content stream, the others end empty.

    Streams that several pages share must have the same new content. Where files are all that is made of these objects, ``assembled``
    takes the contents, without a join of all streams.
    """
    targets = _targets(found, contents).groupBy("file", "id").agg(F.max("_new").alias("_new"))
    both = found.join(targets, ["file", "id"], "left")
    fresh = F.col("_new").isNotNull()
    plain = F.create_map(*(x for k in _PLAIN for x in (F.lit(k), F.lit(None).cast("string"))))
    edits = F.when(fresh, plain)
    edits = F.coalesce(F.map_concat("edits", edits), edits, "edits") if "edits" in found.columns else edits
    out = both.withColumns({"stream": F.coalesce("_new", "stream"), "edits": edits, "content": F.coalesce("_new", "content")})
    return out.withColumns({"size_bytes": F.octet_length("stream").cast("long"), "sha256": F.sha2("stream", 256)}).drop("_new", "page_content")


def prepended(ops: DataFrame, prefix: DataFrame) -> DataFrame:
    """Operations with those of ``prefix`` (same columns, idx from 0) before them in each scope, numbered anew."""
    sizes = prefix.groupBy("file", "scope").agg(F.count(F.lit(1)).alias("_n"))
    moved = ops.join(sizes, ["file", "scope"], "left").withColumn("idx", F.col("idx") + F.coalesce("_n", F.lit(0))).drop("_n")
    return moved.unionByName(prefix, allowMissingColumns=True)


def _named(ops: DataFrame) -> DataFrame:
    """Do operations with the name that they draw."""
    name = F.get("operands", F.lit(0))
    return ops.filter((F.col("operator") == "Do") & name.startswith("/")).withColumn("name", F.substring(name, 2, 1 << 30))


def removed_names(names: DataFrame, merged: DataFrame) -> DataFrame:
    """file, holder and name of the resources whose object is among ``merged`` (file, holder, id)."""
    return names.join(merged.select("file", "holder", "id").distinct(), ["file", "holder", "id"], "left_semi").select("file", "holder", "name")


def without_draws(ops: DataFrame, removed: DataFrame) -> DataFrame:
    """Operations without the Do of names in ``removed`` (file, holder, name)."""
    name = F.when(F.col("operator") == "Do", F.get("operands", F.lit(0)))
    gone = removed.select("file", F.col("holder").alias("scope"), F.concat(F.lit("/"), "name").alias("_name")).distinct()
    return ops.withColumn("_name", name).join(gone, ["file", "scope", "_name"], "left_anti").select(*ops.columns)


def foreground_names(names: DataFrame, ops: DataFrame, boundaries: DataFrame) -> DataFrame:
    """The rows of ``names`` that operations at or past a scope's ``boundary`` draw."""
    after = _named(ops.join(boundaries.select("file", "scope", "boundary"), ["file", "scope"]).filter("idx >= boundary"))
    return names.join(after.select("file", F.col("scope").alias("holder"), "name").distinct(), ["file", "holder", "name"], "left_semi")


def _edits(found: DataFrame) -> Column:
    return F.col("edits") if "edits" in found.columns else F.lit(None).cast(_EDITS)


def edges(found: DataFrame) -> DataFrame:
    """file, id and to: what each object and the trailer (id ``trailer``) refer to, after edits."""
    inside = F.lit(f'(?:^|")({REFERENCE.pattern.removesuffix("$")})(?:"|$)')
    own = F.map_filter(F.from_json("value", _EDITS), lambda k, _: ~F.coalesce(F.map_contains_key("_edits", k), F.lit(False)))
    texts = F.when(F.col("value").startswith("{"), F.concat(F.map_values(own), F.coalesce(F.array_compact(F.map_values("_edits")), F.array().cast("array<string>")))).otherwise(F.array("value"))
    refs = F.array_distinct(F.flatten(F.transform(F.array_compact(texts), lambda x: F.regexp_extract_all(x, inside, F.lit(1)))))
    return found.filter("value is not null").withColumn("_edits", F.coalesce(_edits(found), F.create_map().cast(_EDITS))).select("file", "id", F.explode(refs).alias("to"))


def _references(value: object) -> Iterator[str]:
    """What a value refers to."""
    if isinstance(value, str):
        if REFERENCE.match(value):
            yield value
    elif isinstance(value, dict | list):
        for x in value.values() if isinstance(value, dict) else value:
            yield from _references(x)


class _Value(NamedTuple):
    """The value of an object, which isn't to be changed, how it is written, and what it refers to."""

    own: object
    text: str
    references: tuple[str, ...]


def _value(value: str | None) -> _Value:
    own = None if value is None else json.loads(value)
    return _Value(own, syntax(own), tuple(_references(own)))


#: Short values that a task met last are kept, as files repeat each other's.
_repeated = lru_cache(KEPT)(_value)


def _edited(value: str | None, edits: list | None) -> _Value:
    """The value of an object (JSON) after its edits."""
    if not edits:
        return _repeated(value) if value is None or len(value) <= SHORT else _value(value)
    own = None if value is None else json.loads(value)
    for key, text in edits:
        own.pop(key, None)
        if text is not None:
            own[key] = json.loads(text)
    return _Value(own, syntax(own), tuple(_references(own)))


def _led_to(values: dict[str, _Value]) -> set[str]:
    """The ids among ``values`` that the trailer leads to; each is entered once, as the graph has cycles (a page knows its parent)."""
    seen, asked = set(), [TRAILER]
    while asked:
        for ref in values[asked.pop()].references:
            if ref in values and ref not in seen:
                seen.add(ref)
                asked.append(ref)
    return seen


def _by_file(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with those of a file one after the other in one partition, for a task that takes a file at a time.

    Partitions are more than a shuffle has, and aren't put together by their packed size: a task sorts its rows with their streams.
    """
    tasks = SORTED * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("file", *names).repartition(tasks, "file").sortWithinPartitions("file")


def reachable(found: DataFrame) -> DataFrame:
    """file and id of the objects that a file's trailer leads to, after edits.

    The graph has cycles, so a recursive query, which has no UNION without ALL here, would not end on it. A file's objects meet in one
    task and are walked there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for file, group in groupby(cells(batches), lambda row: row[0]):
                values = {id_: _edited(value, edits) for _, id_, value, edits in group}
                if TRAILER in values:
                    yield from ((file, x) for x in _led_to(values))

        yield from _batches(rows(), pa.schema([("file", pa.string()), ("id", pa.string())]))

    own = found.filter(F.col("number").isNotNull() | (F.col("id") == TRAILER)).withColumn("edits", _edits(found))
    return _by_file(own, ["id", "value", "edits"]).mapInArrow(run, "file string, id string")


def _file(rows: list[tuple], pruned: bool) -> bytes:
    """One file of its objects and what its trailer says."""
    edited = {row[1]: _edited(*row[4:6]) for row in rows}
    if pruned:
        led = _led_to(edited) if TRAILER in edited else set()
        rows = [row for row in rows if row[1] in led or row[1] == TRAILER]
    texts, streams, trailer = {}, {}, {}
    for _, id_, number, generation, _, _, stream, storage in rows:
        own, text, _ = edited[id_]
        if number is None:
            trailer = {k: v for k, v in own.items() if k not in STORAGE}
            continue
        if storage:
            continue
        if stream is not None and (type(own.get("Length")) is not int or own["Length"] != len(stream)):
            text = syntax(own | {"Length": len(stream)})
        texts[number, generation], streams[number, generation] = text, stream
    out, offsets = bytearray(b"%PDF-1.7\n"), {}
    for key in sorted(texts):
        offsets[key[0]] = len(out), key[1]
        out += f"{key[0]} {key[1]} obj\n{texts[key]}".encode("latin-1")
        if streams[key] is not None:
            out += b"\nstream\n" + streams[key] + b"\nendstream"
        out += b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n"
    for number, (at, generation) in offsets.items():
        out += f"{number} 1\n{at:010d} {generation:05d} n \n".encode("ascii")
    ends = syntax({"Size": max(offsets, default=0) + 1} | trailer)
    out += f"trailer\n{ends}\nstartxref\n{start}\n%%EOF\n".encode("latin-1")
    return bytes(out)


def _renewed(rows: list[tuple]) -> list[tuple]:
    """A file's rows with what those of new contents (the last value) say in place of the streams with their ids."""
    new: dict[str, bytes] = {}
    for row in rows:
        if row[-1] is not None:
            new[row[1]] = max(row[-1], new.get(row[1], b""))
    own = [row[:-1] for row in rows if row[-1] is None]
    if not new:
        return own
    return [(*row[:5], list((dict(row[5] or ()) | _PLAIN).items()), new[row[1]], row[7]) if row[1] in new else row for row in own]


def assembled(found: DataFrame, pruned: bool = False, contents: DataFrame | None = None) -> DataFrame:
    """file, content and size_bytes of the files that objects (with their raw streams, and ``edits`` if there are any) and trailers make.

    ``pruned`` leaves out what the trailer doesn't lead to. The trailer keeps its entries: the same catalogue, Info and ID.
    Cross-reference and object streams aren't carried over: their objects stand alone and the table is written anew. A
    file that couldn't be read has no objects and gives no row. A task has one file at a time. ``contents`` are new ones as
    ``with_content`` takes them; they go to their file's task beside its objects.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for file, group in groupby(cells(batches), lambda row: row[0]):
                if own := _renewed(list(group)) if renewed else list(group):
                    content = _file(own, pruned)
                    yield file, content, len(content)

        yield from _batches(rows(), pa.schema([("file", pa.string()), ("content", pa.binary()), ("size_bytes", pa.int64())]))

    storage = F.coalesce(F.get_json_object("value", "$.Type").isin("/ObjStm", "/XRef"), F.lit(False)) & F.col("number").isNotNull()
    own = found.filter(F.col("number").isNotNull() | (F.col("id") == TRAILER)).withColumns({"edits": _edits(found), "storage": storage})
    own = own.withColumn("stream", F.when(~F.col("storage"), F.col("stream")))
    if not pruned:
        own = own.filter(~F.col("storage"))
    names = ["id", "number", "generation", "value", "edits", "stream", "storage"]
    renewed = contents is not None
    if renewed:
        own = own.select("file", *names, F.lit(None).cast("binary").alias("_new")).unionByName(_targets(found, contents), allowMissingColumns=True)
        names.append("_new")
    return _by_file(own, names).mapInArrow(run, "file string, content binary, size_bytes long")


def opaque_state(state: Column) -> Column:
    """Whether a graphics state (JSON) changes nothing but opaque painting: no soft mask, alphas of 1, blending Normal; false for null."""
    get = lambda key: F.get_json_object(state, f"$.{key}")
    mask, blend = get("SMask"), get("BM")
    normal = blend.isNull() | (blend == "/Normal") | (blend.startswith("[") & (F.get(F.from_json(blend, "array<string>"), F.lit(0)) == "/Normal"))
    alpha = [F.coalesce(F.abs(get(key).try_cast("double") - 1) < 1e-6, F.lit(True)) for key in ("ca", "CA")]
    return F.coalesce((mask.isNull() | (mask == "/None")) & normal & alpha[0] & alpha[1], F.lit(False)) & state.isNotNull()


def states(found: DataFrame) -> DataFrame:
    """file, holder, name and ``opaque`` of each named graphics state."""
    held = F.from_json(F.get_json_object("resources", "$.ExtGState"), "map<string,string>")
    own = found.filter("resources is not null").select("file", F.col("id").alias("holder"), F.explode(held).alias("name", "state"))
    return own.select("file", "holder", "name", opaque_state(F.col("state")).alias("opaque"))
