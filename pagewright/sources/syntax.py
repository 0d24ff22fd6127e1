"""The syntax of document files: values, streams and what refers to what, read from bytes and written again."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

_REGULAR = rb"[^\x00\t\n\f\r ()<>\[\]{}/%]"
#: A string without brackets in it but after backslashes; one in hex digits.
_LITERAL, _HEX = rb"\([^()\\]*+(?:\\[\s\S][^()\\]*+)*+\)", rb"<[0-9A-Fa-f\s]*+>"
#: The usual tokens as groups (1 whole number, 2 name, 3 string), then comments and all others.
_USUAL, _OTHER = rb"([+-]?\d{1,40})(?!" + _REGULAR + rb")|(/" + _REGULAR + rb"*)|(" + _LITERAL + rb")|%[^\r\n]*|", rb"<<|>>|[\[\]]|" + _HEX + rb"|\(|" + _REGULAR + rb"+|[{}]"
_WORDS = _USUAL + _OTHER
TOKEN = re.compile(_WORDS)
#: References before them (groups 1 and 2).
_REFERENCE = rb"(\d{1,10})\s+(\d{1,5})\s+R(?!" + _REGULAR + rb")|"
_VALUE = re.compile(_REFERENCE + _WORDS)
#: The same with all others as group 6, to be found all at once.
_ALL = re.compile(_REFERENCE + _USUAL + rb"(" + _OTHER + rb")")


def _dictionary(levels: int) -> bytes:
    """The pattern of a dictionary with others in it to so many levels, without comments and strings with brackets."""
    inside = rb"[^<>()%]++|" + _LITERAL + rb"|" + _HEX + (rb"|" + _dictionary(levels - 1) if levels else b"")
    return rb"<<(?:" + inside + rb")*+>>"


_PLAIN = re.compile(rb"[\x00\t\n\f\r ]*(" + _dictionary(4) + rb")")
OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})\s+(\d{1,5})\s+obj\b")
_NUMBER = re.compile(rb"[+-]?(\d{1,40}\.?\d{0,40}|\.\d{1,40})$")
REFERENCE = re.compile(r"\d{1,10} \d{1,5} R$")


class Text(str):
    """A string operand as it is written: (a) or <61>."""


def _string(data: bytes, at: int) -> tuple[Text, int]:
    """The literal string that starts after the bracket before ``at``, and the place after it."""
    depth, begin = 1, at
    while at < len(data) and depth:
        c = data[at]
        at += 2 if c == 0x5C else 1
        depth += (c == 0x28) - (c == 0x29)
    return Text("(" + data[begin : at - (depth == 0)].decode("latin-1") + ")"), at


_OCTAL, _LINE_END = re.compile(rb"[0-7]{1,3}"), re.compile(rb"\r\n?|\n")
#: What a letter after a backslash stands for.
_ESCAPES = {0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}


def string_bytes(text: str) -> bytes:
    """The bytes of a string operand, literal or in hex digits; a digit that is missing at the end is 0."""
    if text.startswith("<"):
        try:
            return bytes.fromhex(text[1:-1])
        except ValueError:  # a digit is missing, or apart from its pair
            digits = re.sub(r"[^0-9A-Fa-f]", "", text)
        return bytes.fromhex(digits + "0" * (len(digits) % 2))
    data, out, at = text[1:-1].encode("latin-1"), bytearray(), 0
    if b"\\" not in data:
        return data
    while at < len(data):
        c = data[at]
        at += 1
        if c != 0x5C or at == len(data):
            out.append(c)
        elif m := _OCTAL.match(data, at):
            out.append(int(m[0], 8) & 255)
            at = m.end()
        elif m := _LINE_END.match(data, at):  # a line goes on
            at = m.end()
        else:
            out.append(_ESCAPES.get(data[at], data[at]))
            at += 1
    return bytes(out)


_BRACKETS = {x.encode(): x for x in ("<<", ">>", "[", "]")}


def mark(data: bytes, m: re.Match) -> tuple[object, int]:
    """What a match of _WORDS stands for that is none of its groups, and the place after it."""
    word = m[0]
    if word in _BRACKETS:
        return _BRACKETS[word], m.end()
    if word == b"(":
        return _string(data, m.end())
    if word[:1] == b"<":
        return Text(word.decode("latin-1")), m.end()
    if _NUMBER.match(word):
        return (float(word) if b"." in word else int(word)), m.end()
    return word.decode("latin-1"), m.end()


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Values and operators of PDF syntax with the place after each: numbers, names as "/x", strings as ``Text``, marks."""
    search = TOKEN.search
    while m := search(data, at):
        kind, at = m.lastindex, m.end()
        if kind == 1:
            yield int(m[1]), at
        elif kind == 2:
            yield m[2].decode("latin-1"), at
        elif kind == 3:
            yield Text(m[3].decode("latin-1")), at
        elif data[m.start()] != 0x25:
            token, at = mark(data, m)
            yield token, at


_CLOSES = {b">>": b"<<", b"]": b"["}


def _plain(data: bytes) -> dict | None:
    """The dictionary of _PLAIN; None where ``value_at`` must look at it word by word."""
    stack, top = [], []
    for number, generation, whole, name, text, word in _ALL.findall(data):
        if name:
            top.append(name.decode("latin-1"))
        elif number:
            top.append(f"{int(number)} {int(generation)} R")
        elif whole:
            top.append(int(whole))
        elif text:
            top.append({"(": Text(text.decode("latin-1"))})
        elif word == b"<<" or word == b"[":
            stack.append((word, top))
            top = []
        elif word in _CLOSES:
            if not stack or stack[-1][0] != _CLOSES[word]:
                return None
            own, (_, top) = top, stack.pop()
            top.append({str(k)[1:]: v for k, v in zip(own[::2], own[1::2], strict=False)} if word == b">>" else own)
        elif word[:1] == b"<":
            top.append({"(": Text(word.decode("latin-1"))})
        elif _NUMBER.match(word):
            top.append(float(word) if b"." in word else int(word))
        elif word in (b"endobj", b"obj", b"stream", b"endstream", b"R"):
            return None
        else:
            top.append(word.decode("latin-1"))
    return top[0] if len(top) == 1 and not stack else None


#: Short dictionaries that a task met last, as files repeat each other's; how long those are at most, and how many.
SHORT, KEPT = 512, 4096


class Repeated(dict):
    """A dictionary that files repeat, which isn't to be changed, with its JSON once that was asked for."""

    __slots__ = ("text",)


@lru_cache(KEPT)
def _repeated(data: bytes) -> Repeated | None:
    return None if (own := _plain(data)) is None else Repeated(own)


def value_at(data: bytes, at: int) -> tuple[object, int]:
    """One value and the place after it: dicts, lists, numbers, "/name", {"(": text}, references as "n g R"; None if it is broken.

    Equal dictionaries may be the same one: what is found isn't to be changed.
    """
    if (m := _PLAIN.match(data, at)) and (own := (_repeated if len(m[1]) <= SHORT else _plain)(m[1])) is not None:
        return own, m.end()
    stack: list[list] = [[]]
    top, search, begin = stack[0], _VALUE.search, at
    while m := search(data, at):
        kind, after = m.lastindex, m.end()
        token: object = None
        if kind == 4:
            top.append(m[4].decode("latin-1"))
        elif kind == 2:
            top.append(f"{int(m[1])} {int(m[2])} R")
        elif kind == 3:
            token = int(m[3])
            top.append(token)
        elif kind == 5:
            top.append({"(": Text(m[5].decode("latin-1"))})
        elif data[m.start()] == 0x25:
            at = after
            continue
        else:
            token, after = mark(data, m)
            if isinstance(token, Text):
                top.append({"(": token})
            elif token in ("<<", "["):
                stack.append(top := [token])
            elif token in (">>", "]") and len(stack) > 1:
                items = stack.pop()[1:]
                top = stack[-1]
                top.append({str(k)[1:]: v for k, v in zip(items[::2], items[1::2], strict=False)} if token == ">>" else items)
            elif token in ("endobj", "obj", "stream", "endstream"):
                return None, begin
            elif token == "R" and len(top) > 1:
                generation, number = top.pop(), top.pop()
                top.append(f"{number} {generation} R")
            else:
                top.append(token)
        at = after
        if len(stack) == 1 and not (isinstance(token, int) and re.match(rb"\s+\d+\s+R\b", data[after : after + 20])) and not (token != "R" and isinstance(top[-1], int) and re.match(rb"\s+R\b", data[after : after + 4])):
            return top[-1], after
    return None, begin


def syntax(value: object) -> str:
    """A value of ``value_at`` as it is written in a file."""
    if isinstance(value, dict):
        return str(value["("]) if "(" in value else "<< " + " ".join(f"/{k} {syntax(v)}" for k, v in value.items()) + " >>"
    if isinstance(value, list):
        return "[" + " ".join(map(syntax, value)) + "]"
    if isinstance(value, float):
        return f"{value:.15f}".rstrip("0") if "e" in repr(value) else repr(value)
    return str(value)


def filters(found: dict) -> tuple[list[str], list[dict]]:
    """Names of a stream's filters and their parameters."""
    names, parms = found.get("Filter", []), found.get("DecodeParms", found.get("DP", []))
    names = [x for x in (names if isinstance(names, list) else [names]) if isinstance(x, str)]
    parms = [x if isinstance(x, dict) else {} for x in (parms if isinstance(parms, list) else [parms])]
    return names, (parms + [{}] * len(names))[: len(names)]
