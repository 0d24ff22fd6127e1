"""The object table of one file, from its cross-references.

Newer sections come first: the chain of /Prev is followed from the file's end through tables, cross-reference streams and hybrid
files, and the first entry for a number stands, be it a place, a place in an object stream, or none (a freed object). A
chain that doesn't hold (a place without its object, a loop, no catalogue) says nothing, and the file is scanned for objects
instead: there the last definition stands, and freed objects can't be told.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .filters import decoded
from .syntax import OBJECT, REFERENCE, filters, tokens, value_at

#: Entries of a trailer that tell how it was stored, not what the document is.
STORAGE = {"Size", "Prev", "XRefStm", "Type", "W", "Index", "Filter", "DecodeParms", "Length", "DL"}

_START = re.compile(rb"startxref\s+(\d{1,15})")
_ENTRY = re.compile(rb"\s*(\d{1,10})\s+(\d{1,10})(?:\s*([nf])(?![a-z]))?")
_LENGTH = re.compile(rb"(?<![0-9])(\d{1,10})\s+(\d{1,5})\s+obj\s+(\d{1,15})\s+endobj")
_STREAM = re.compile(rb"\s*stream(\r\n|\n|\r)")
_PLACED = re.compile(rb"\s*" + OBJECT.pattern)
_TRAILER = re.compile(rb"\s*trailer")
#: A word that begins with its letters is found much faster than one that begins with a boundary.
_WORD, _LETTER = re.compile(rb"trailer\b"), re.compile(rb"\w")
_ROOT = re.compile(rb"/Root\s+(\d{1,10})\s+(\d{1,5})\s+R")


@dataclass
class Section:
    """What one save of a file added: kind, place, trailer, and by number (0, ..) freed, (1, place, generation) or (2, object stream, index)."""

    kind: str
    at: int
    trailer: dict
    entries: dict[int, tuple[int, int, int]]


def stream_at(data: bytes, at: int, value: object, length: object) -> tuple[bytes | None, int]:
    """The raw stream after a dictionary that ends at ``at``, and the place after it; ``length`` is its size where that is known.

    A size that doesn't lead to the end of a stream counts for nothing: then the next end is taken, without the line end before it.
    """
    if not isinstance(value, dict) or not (s := _STREAM.match(data[at : at + 64])):
        return None, at
    begin = at + s.end()
    if isinstance(length, int) and 0 <= length <= len(data) - begin and data[begin + length : begin + length + 16].lstrip()[:9] == b"endstream":
        return data[begin : begin + length], begin + length
    end = data.find(b"endstream", begin)
    end = len(data) if end < 0 else end
    own = data[begin:end]
    return own[: len(own) - (own[-2:] == b"\r\n" or own[-1:] in (b"\n", b"\r")) - (own[-2:] == b"\r\n")], end


def _table(data: bytes, at: int) -> tuple[dict[int, tuple[int, int, int]], dict]:
    entries: dict[int, tuple[int, int, int]] = {}
    number = 0
    while m := _ENTRY.match(data, at):
        at = m.end()
        if m[3]:
            entries.setdefault(number, (1, int(m[1]), int(m[2])) if m[3] == b"n" else (0, 0, 0))
            number += 1
        else:
            number = int(m[1])
    if not (word := _TRAILER.match(data, at)):
        raise ValueError("a table without a trailer")
    trailer, _ = value_at(data, word.end())
    if not isinstance(trailer, dict):
        raise ValueError("a trailer that is none")
    return entries, trailer


def _stream(data: bytes, at: int) -> tuple[dict[int, tuple[int, int, int]], dict]:
    m = _PLACED.match(data, at)
    value, after = value_at(data, m.end()) if m else (None, at)
    raw, _ = stream_at(data, after, value, value.get("Length") if isinstance(value, dict) else None)
    if raw is None or value.get("Type") != "/XRef":
        raise ValueError("no cross-reference stream")
    inner, widths = decoded(raw, *filters(value))[0], value.get("W")
    if inner is None or not isinstance(widths, list) or len(widths) < 3 or not all(isinstance(w, int) and 0 <= w < 9 for w in widths):
        raise ValueError("a cross-reference stream that can't be read")
    index, size = value.get("Index") or [0, value.get("Size")], sum(widths)
    entries: dict[int, tuple[int, int, int]] = {}
    place = 0
    for first, count in zip(index[::2], index[1::2], strict=True):
        for number in range(first, first + min(count, len(inner) // max(size, 1))):
            fields = []
            for w in widths[:3]:
                fields.append(int.from_bytes(inner[place : place + w], "big") if w else None)
                place += w
            place += size - sum(widths[:3])
            kind = 1 if fields[0] is None else fields[0]
            entries.setdefault(number, (kind, fields[1] or 0, fields[2] or 0) if kind in (1, 2) else (0, 0, 0))
    return entries, value


def sections(data: bytes) -> list[Section]:
    """The sections of a file's chain, the newest first; an error where it has none or it doesn't hold."""
    starts = _START.findall(data)
    base = max(data.find(b"%PDF-", 0, 1024), 0)  # places count from here
    at, out, seen = int(starts[-1]) if starts else None, [], set()
    while at is not None:
        if at in seen or at > len(data):
            raise ValueError("a chain that doesn't end")
        seen.add(at)
        if re.compile(rb"\s*xref\b").match(data, base + at):
            entries, trailer = _table(data, data.index(b"xref", base + at) + 4)
            kind = "table"
            if isinstance(hidden := trailer.get("XRefStm"), int):
                kind = "hybrid"
                for number, entry in _stream(data, base + hidden)[0].items():
                    if entries.get(number, (0,))[0] == 0 and entry[0]:
                        entries[number] = entry
        else:
            entries, trailer = _stream(data, base + at)
            kind = "stream"
        out.append(Section(kind, at, trailer, {n: (k, a + base if k == 1 else a, b) for n, (k, a, b) in entries.items()}))
        at = trailer.get("Prev")
        at = int(at) if isinstance(at, int | float) else None
    if not out:
        raise ValueError("no cross-references")
    return out


def _inside(raw: bytes, value: dict) -> list[tuple[int, object]]:
    """Numbers and values of the objects in an object stream."""
    inner, first = decoded(raw, *filters(value))[0], value.get("First")
    if inner is None or not isinstance(first, int):
        return []
    head = [t for t, _ in tokens(inner[:first]) if isinstance(t, int)]
    return [(number, value_at(inner, first + place)[0]) for number, place in zip(head[::2], head[1::2], strict=False)]


class ObjectTable:
    """objects: value and raw stream by number and generation; trailer: what the document is, with a Root that is a catalogue if there is one.

    An encrypted file is an error.
    """

    def __init__(self, data: bytes):
        self.data = data
        self.objects: dict[tuple[int, int], tuple[object, bytes | None]] = {}
        try:
            found = sections(data)
            self.trailer = {k: v for k, v in found[0].trailer.items() if k not in STORAGE}
            held = not self._encrypted() and self._by_places(found)
        except Exception:  # whatever is wrong with the chain, the file is scanned
            held, self.trailer = False, {}
        if self._encrypted() or (not held and re.search(rb"/Encrypt\s+(\d+\s+\d+\s+R|<<)", data)):
            raise ValueError("encrypted")
        if not held:
            self._by_scan()

    def _encrypted(self) -> bool:
        return self.trailer.get("Encrypt") is not None

    def _catalogue(self, ref: object) -> bool:
        own = self._of(ref)
        return isinstance(own, dict) and own.get("Type") == "/Catalog"

    def _of(self, ref: object) -> object:
        if not isinstance(ref, str) or not REFERENCE.match(ref):
            return None
        number, generation, _ = ref.split()
        return self.objects.get((int(number), int(generation)), (None, None))[0]

    def _by_places(self, found: list[Section]) -> bool:
        """Read the objects at the chain's places; False if one isn't there or no catalogue is."""
        entries: dict[int, tuple[int, int, int]] = {}
        for section in found:
            for number, entry in section.entries.items():
                entries.setdefault(number, entry)
        values: dict[int, tuple[object, int, int]] = {}  # value, place after it, generation
        for number, (kind, at, generation) in entries.items():
            if kind == 1 and at:
                m = _PLACED.match(self.data, at)
                if not m or int(m[1]) != number:
                    return False
                values[number] = *value_at(self.data, m.end()), generation
        inside: dict[int, dict[int, object]] = {}

        def number_of(ref: object) -> int | None:
            return int(ref.split()[0]) if isinstance(ref, str) and REFERENCE.match(ref) else None

        def length(value: object) -> object:
            size = value.get("Length") if isinstance(value, dict) else None
            own = number_of(size)
            if own is None:
                return size
            kind, a, _ = entries.get(own, (0, 0, 0))
            return values[own][0] if own in values else held(a).get(own) if kind == 2 else None

        def held(stream: int) -> dict[int, object]:
            if stream not in inside:
                inside[stream] = {}  # an object stream that needs itself has nothing
                if stream in values:
                    value, after, _ = values[stream]
                    raw, _ = stream_at(self.data, after, value, length(value))
                    inside[stream] = dict(_inside(raw, value)) if raw is not None else {}
            return inside[stream]

        for number in sorted(entries):
            kind, at, _ = entries[number]
            if number in values:
                value, after, generation = values[number]
                self.objects[number, generation] = value, stream_at(self.data, after, value, length(value))[0]
            elif kind == 2 and number in held(at):
                self.objects[number, 0] = held(at)[number], None
        return self._catalogue(self.trailer.get("Root"))

    def _by_scan(self) -> None:
        """Read whatever looks like an object; the last definition stands."""
        self.objects, at, data = {}, 0, self.data
        sizes: dict[tuple[int, int], int] | None = None
        ends = []
        while m := OBJECT.search(data, at):
            value, at = value_at(data, m.end())
            size = value.get("Length") if isinstance(value, dict) else None
            if isinstance(size, str) and REFERENCE.match(size):
                if sizes is None:
                    sizes = {(int(x[1]), int(x[2])): int(x[3]) for x in _LENGTH.finditer(data)}
                number, generation, _ = size.split()
                size = sizes.get((int(number), int(generation)))
            raw, at = stream_at(data, at, value, size)
            self.objects[int(m[1]), int(m[2])] = value, raw
            if raw is not None and value.get("Type") == "/ObjStm":
                self.objects.update(((number, 0), (own, None)) for number, own in _inside(raw, value))
            if isinstance(value, dict) and value.get("Type") == "/XRef":
                ends.append((m.start(), value))
        ends += [(m.start(), own) for m in _WORD.finditer(data) if not (m.start() and _LETTER.match(data, m.start() - 1)) and isinstance(own := value_at(data, m.end())[0], dict)]
        ends = [own for _, own in sorted(ends, key=lambda x: x[0]) if "Root" in own]
        self.trailer = {k: v for k, v in ends[-1].items() if k not in STORAGE} if ends else {}
        roots = [f"{int(m[1])} {int(m[2])} R" for m in _ROOT.finditer(data)]
        found = next((x for x in [self.trailer.get("Root"), *reversed(roots), *(f"{n} {g} R" for n, g in self.objects)] if self._catalogue(x)), None)
        self.trailer.pop("Root", None)
        if found:
            self.trailer["Root"] = found
