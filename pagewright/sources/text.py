"""Text of pages by the code maps of their fonts.

A font's codes are one or two bytes; which characters they stand for is a relation of code ranges, from the font's ToUnicode map
or from its encoding's differences. A page's strings and the ranges of its fonts meet in one row for each page, where each different
code of a font is looked up once. Python reads single maps, contents and pages' strings only.

``page_text`` does this for relations, edited ones too. Where files are only read (``file_text``), all that a page's text needs is in its own
file, as with references and what pages inherit: it is looked up where the file is parsed, and neither contents nor strings are written or shuffled.
"""

from __future__ import annotations

import re
import sys
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import dealt
from .pdf import _ARROW, PARTS, _batches, _File, _get, cells, content_operations
from .syntax import REFERENCE, Text, string_bytes, tokens

#: Names of glyphs that aren't letters, in the order of ASCII from the space on; then after Z, and after z.
_PUNCTUATION = "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater question at".split()
_BRACKETS, _BRACES = "bracketleft backslash bracketright asciicircum underscore grave".split(), "braceleft bar braceright asciitilde".split()
_NAMED = {name: chr(start + i) for start, names in ((0x20, _PUNCTUATION), (0x5B, _BRACKETS), (0x7B, _BRACES)) for i, name in enumerate(names)}
#: Stands for a code of a font that its map doesn't have.
UNKNOWN = "�"

_RANGES = "file string, id string, size int, lo int, hi int, text string"
_UNI = re.compile(r"^(?:uni|u)([0-9A-Fa-f]{4,6})$")

#: Hex digits that are no character: half a pair, or beyond the last one.
_NO_CHARACTER = r"^(0{0,2}[Dd][89A-Fa-f]..|(?!0|10).{6})$"


def glyph(name: str) -> str | None:
    """The character of a glyph's name, or None: a letter, uniXXXX, or a name of ASCII."""
    if len(name) == 1:
        return name
    if m := _UNI.match(name):
        code = int(m[1], 16)
        return chr(code) if code < 0xD800 or 0xDFFF < code < 0x110000 else None
    return _NAMED.get(name)


def _decoded(data: bytes) -> str:
    return data.decode("utf-16-be", "replace")


def code_ranges(data: bytes) -> Iterator[tuple[int, int, int, str]]:
    """Bytes of a code, first and last code and the first one's text for each range of a ToUnicode map."""
    kind, held = None, []
    for token, _ in tokens(data):
        if isinstance(token, str) and not isinstance(token, Text) and token.startswith(("begin", "end")):
            if token in ("endbfchar", "endbfrange") and kind:
                step, at = (2 if kind == "bfchar" else 3), 0
                while at + step <= len(held):
                    low, high = held[at], held[at + step - 2]
                    at += step
                    target = held[at - 1]
                    if target == "[":  # a text for each code
                        end = held.index("]", at) if "]" in held[at:] else len(held)
                        texts, at = held[at:end], end + 1
                    else:
                        texts = None
                    if not isinstance(low, Text) or not isinstance(high, Text):
                        continue
                    size, first, last = len(string_bytes(low)), int.from_bytes(string_bytes(low), "big"), int.from_bytes(string_bytes(high), "big")
                    if texts is None and isinstance(target, Text):
                        yield size, first, last, _decoded(string_bytes(target))
                    elif texts:
                        yield from ((size, first + i, first + i, _decoded(string_bytes(x))) for i, x in enumerate(texts[: last - first + 1]) if isinstance(x, Text))
            kind, held = token.removeprefix("begin") if token.startswith("beginbf") else None, []
        elif kind:
            held.append(token)


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file, id_, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows += [(file, id_, size, lo, hi, text) for size, lo, hi, text in code_ranges(content or b"") if 0 < size < 4 and lo <= hi]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "id", "size", "lo", "hi", "text"])


def fonts(found: DataFrame) -> DataFrame:
    """file, holder (a page or form with resources), name and id of every font that can be named there."""
    own = found.filter("resources is not null").select("file", F.col("id").alias("holder"), F.explode(F.from_json(_get("Font", "resources"), "map<string,string>")).alias("name", "id"))
    return own.filter(F.col("id").rlike(REFERENCE.pattern))


def code_maps(found: DataFrame) -> DataFrame:
    """file, id (of a font), lo, hi and text: codes lo to hi stand for text, whose last character goes up with the code.

    A map to Unicode counts before an encoding's differences.
    """
    is_font = _get("Type") == "/Font"
    # a map without these words says nothing; page contents, which are most of the bytes, aren't shuffled
    streams = found.filter(F.contains("content", F.lit(b"beginbf"))).select("file", F.col("id").alias("to"), "content")
    asked = found.filter(is_font & _get("ToUnicode").isNotNull()).select("file", "id", _get("ToUnicode").alias("to"))
    mapped = asked.join(dealt(streams), ["file", "to"]).select("file", "id", "content").mapInArrow(_maps, _RANGES).select("file", "id", "lo", "hi", "text")
    encodings = found.filter("value is not null").select("file", F.col("id").alias("to"), _get("Differences").alias("listed"))
    plain = found.filter(is_font & _get("ToUnicode").isNull()).select("file", "id", _get("Encoding").alias("to"), _get("Encoding.Differences").alias("own"))
    listed = plain.join(dealt(encodings), ["file", "to"], "left").select("file", "id", F.from_json(F.coalesce("own", "listed"), "array<string>").alias("d")).filter("d is not null")
    # a number starts a run of names; the code of a name is the last number before it and the names between
    places = listed.select("file", "id", F.posexplode("d").alias("at", "x")).withColumn("n", F.expr("try_cast(x as int)"))
    runs = places.filter("n is not null").groupBy("file", "id").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("runs"))
    last = F.try_element_at(F.filter("runs", lambda r: r["at"] < F.col("at")), F.lit(-1))
    names = places.filter("n is null").join(dealt(runs), ["file", "id"]).withColumn("run", last).filter("run is not null")
    code = F.col("run.n") + F.col("at") - F.col("run.at") - 1
    named = F.create_map(*(x for k, v in _NAMED.items() for x in (F.lit(k), F.lit(v))))
    name = F.ltrim("x", F.lit("/"))
    uni = F.regexp_extract(name, _UNI.pattern, 1)
    text = F.when(F.length(name) == 1, name).when(uni != "", F.when(~uni.rlike(_NO_CHARACTER), F.decode(F.unhex(F.lpad(uni, 8, "0")), "UTF-32"))).otherwise(F.try_element_at(named, name))
    different = names.select("file", "id", code.cast("int").alias("lo"), code.cast("int").alias("hi"), text.alias("text")).filter("text is not null")
    return mapped.unionByName(different)


class _Font(dict):
    """The text of each code of a font that was asked for, by its ranges in order of lo; the first that has a code counts."""

    def __init__(self, width: int = 1, ranges: list[dict] | None = None):
        super().__init__()
        self.width, self.ranges = width, ranges or []
        self.reach = list(accumulate((r["hi"] for r in self.ranges), max))

    def __missing__(self, code: int) -> str:
        at = bisect_left(self.reach, code)  # the first range that ends at the code or after it
        if at < len(self.ranges) and self.ranges[at]["lo"] <= code:
            text, plus = self.ranges[at]["text"], code - self.ranges[at]["lo"]
            last = ord(text[-1:] or "\0") + plus
            found = text if not plus else text[:-1] + (chr(last) if last < 0xD800 or 0xDFFF < last < 0x110000 else UNKNOWN)
        else:
            found = chr(code) if self.width == 1 else UNKNOWN
        self[code] = found
        return found

    def text(self, data: bytes) -> str:
        codes = data
        if self.width == 2:
            codes = array("H", data[: len(data) // 2 * 2])
            if sys.byteorder == "little":
                codes.byteswap()
        return "".join(map(self.__getitem__, codes))


_TEXTS = pa.schema([("file", pa.string()), ("id", pa.string()), ("text", pa.string())])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for file, holder, shown, known in cells(batches):
            own, other = {x["name"]: _Font(x["width"], x["ranges"]) for x in known or ()}, _Font()
            yield file, holder, "".join(own.get(x["name"], other).text(x["data"]) + " " for x in shown)

    yield from _batches(rows(), _TEXTS)


def page_text(found: DataFrame, own_pages: DataFrame, ops: DataFrame) -> DataFrame:
    """file, page_number and the text that each page's own contents show, by its fonts' maps, with a space after each operation.

    A composite font has codes of two bytes. A code that a font's map doesn't have is its Latin-1 character in fonts of one byte,
    and UNKNOWN in others; so is one of a font that isn't in the page's resources.
    """
    shown = ops.filter(F.col("shown").isNotNull()).select("file", F.col("scope").alias("holder"), F.struct("idx", F.col("font").alias("name"), F.unhex(F.array_join("shown", "")).alias("data")).alias("s"))
    lists = shown.groupBy("file", "holder").agg(F.array_sort(F.collect_list("s")).alias("shown"))
    ranges = code_maps(found).groupBy("file", "id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "text"))).alias("ranges"))
    kinds = found.filter(_get("Type") == "/Font").select("file", "id", F.when(_get("Subtype") == "/Type0", 2).otherwise(1).alias("width"))
    known = fonts(found).join(dealt(kinds), ["file", "id"]).join(dealt(ranges), ["file", "id"], "left")
    held = known.groupBy("file", "holder").agg(F.collect_list(F.struct("name", "width", "ranges")).alias("fonts"))
    texts = lists.join(dealt(held), ["file", "holder"], "left").select("file", "holder", "shown", "fonts").mapInArrow(_texts, "file string, id string, text string")
    whole = own_pages.select("file", "page_number", "id").join(dealt(texts), ["file", "id"], "left")
    return whole.select("file", "page_number", F.coalesce("text", F.lit("")).alias("text"))


def _differences(listed: object) -> Iterator[tuple[int, str]]:
    """Codes and characters of an encoding's differences: a number starts a run of names."""
    code = None
    for x in listed if isinstance(listed, list) else ():
        if type(x) is int and -(1 << 31) <= x < 1 << 31:
            code = x
            continue
        if code is not None:
            if isinstance(x, str) and (character := glyph(x.lstrip("/"))) is not None:
                yield code, character
            code += 1


def _font(own: _File, ref: object) -> _Font | None:
    """The font of a file that ``ref`` refers to, with the ranges of ``code_maps``; None where it is no font."""
    font = own.by_id.get(ref) if isinstance(ref, str) else None
    if not isinstance(font, dict) or font.get("Type") != "/Font":
        return None
    found, to, encoding = [], font.get("ToUnicode"), font.get("Encoding")
    if to is not None:
        data = own.content(to)[0] if isinstance(to, str) and to in own.streams else None
        if data and b"beginbf" in data:
            found = [(lo, hi, text) for size, lo, hi, text in code_ranges(data) if 0 < size < 4 and lo <= hi]
    elif isinstance(encoding := own.by_id.get(encoding) if isinstance(encoding, str) else encoding, dict):
        found = [(code, code, text) for code, text in _differences(encoding.get("Differences"))]
    return _Font(2 if font.get("Subtype") == "/Type0" else 1, [{"lo": lo, "hi": hi, "text": text} for lo, hi, text in sorted(found)])


def _pages(own: _File, file: str, rows: list[dict]) -> Iterator[tuple]:
    """file, page_number and text of the pages among a file's rows; each font is read once."""
    fonts: dict[str, _Font | None] = {}
    other = _Font()
    for row in rows:
        page = own.by_id[row["id"]]
        table = (own.resources(own.inherited(page, "Resources")) or {}).get("Font")
        named = {name: ref for name, ref in table.items() if isinstance(ref, str)} if isinstance(table, dict) else {}
        contents = [b"".join(x + b"\n" for x in row["page_content"])] if row["page_content"] else []
        if row["content"] is not None and page.get("Subtype") == "/Form":  # a page that is a form, too, shows both
            contents.append(row["content"])
        shown = [(idx, font, strings) for data in contents for idx, (_, _, _, font, strings) in enumerate(content_operations(data)) if strings is not None]
        if len(contents) > 1:
            shown.sort(key=lambda x: (x[0], x[1] is not None, x[1] or "", "".join(x[2])))
        text = []
        for _, name, strings in shown:
            ref = named.get(name)
            if ref is not None and ref not in fonts:
                fonts[ref] = _font(own, ref)
            font = fonts.get(ref)
            text.append((other if font is None else font).text(bytes.fromhex("".join(strings))))
        whole = "".join(x + " " for x in text)
        for number in row["page_numbers"]:
            yield file, number, whole


_PAGE_TEXTS = pa.schema([("file", pa.string()), ("page_number", pa.int32()), ("text", pa.string())])


def _file_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = _ARROW.names.index("page_numbers")

    def rows() -> Iterator[tuple]:
        for file, data in cells(batches):
            try:
                own = _File(data or b"")
                pages = [dict(zip(_ARROW.names, x, strict=True)) for x in own.values(file, False, PARTS - {"sha256"}) if x[numbers]]
            except Exception:  # a file that can't be read has no pages; ``objects`` has a warning for it
                continue
            yield from _pages(own, file, pages)

    yield from _batches(rows(), _PAGE_TEXTS)


def file_text(pdfs: DataFrame) -> DataFrame:
    """``page_text`` of files (columns file, content) as they are, in one pass over their bytes."""
    return pdfs.select("file", "content").mapInArrow(_file_texts, "file string, page_number int, text string")
