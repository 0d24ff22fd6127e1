"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

A word's encoding by merges in rank order is its only sequence of tokens in which every neighbouring pair is
compatible, that is, in which merging the pair's spelling alone gives the pair. So the encoder never merges:
an Aho-Corasick automaton gives the longest token that starts at each place in one scan; the encoder takes
it if it is compatible with the token before, else the longest token that is a prefix of it, and steps back
where none fits. Places once found hopeless are never tried again, so time is linear in the word.

Words are independent, so each task keeps a bounded memory of words that it has encoded.

Letters are those of the installed Unicode tables; characters newer than the vocabulary's library may differ.

Defined cases: null and empty texts have no tokens (n_tokens 0, the digest of no bytes). Special tokens in a
text are the tokens they name. Whitespace is dropped, letters are lower-cased after NFC, as the vocabulary's
normaliser says, so the decoded text is the sequence of token strings with one space between them.
Extra columns pass through ``encode`` untouched and are not read by ``encoded_digests``.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fresh

#: Words, stretches between white space, and pairs kept while a task runs. The first ones met are kept, so the
#: frequent ones are; others are encoded each time. A task gives its memory back at its end, as workers live on.
WORDS_KEPT = 300_000
#: Longer ones are encoded each time.
LONGEST_KEPT = 48

_END = 0x400  # added to a word's last character, so that an ending is a letter of its own
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")  # white space for str.split, but not for the vocabulary


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    named = dict(zip(plain, plain, strict=True)) | {b: 256 + i for i, b in enumerate(rest)}
    return [chr(named[b]) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a byte-level BPE file with word ends (``tokenizers`` JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.at_special = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.letters = {b: x for b, x in enumerate(_byte_letters())}
        self.spelling: dict[int, str] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for token, i in vocab.items():
            if len(token) == 1:
                self.spelling[i] = token
            elif token.endswith(end) and len(token) == 1 + len(end):
                self.spelling[i] = chr(ord(token[0]) + _END)
        for a, b in spec["model"]["merges"]:
            i = vocab[a + b]
            self.halves[i] = vocab[a], vocab[b]
            self.spelling[i] = self.spelling[vocab[a]] + self.spelling[vocab[b]]
        self.ids = {s: i for i, s in self.spelling.items()}
        self.merged = {pair: i for i, pair in self.halves.items()}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}
        self.known: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}
        # decoding: each token's bytes and one space, one after the other, with the offset of each
        texts = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        each = [(texts.get(i, "") + " ").encode() for i in range(max(texts) + 1)]
        self.blob = np.frombuffer(b"".join(each), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(x) for x in each])])

    def compatible(self, a: int, b: int) -> bool:
        """True if merging the spelling of a and b leaves the two as they are.

        While the two are built, the tokens that touch the border are a's last parts and b's first parts.
        A merge across it wins if its rank comes before the merge that would use up either; at the same rank
        the left place goes first.
        """
        ok = self.fits.get((a, b))
        if ok is None:
            ok, x, x_used = True, a, len(self.offset)
            while ok:
                y, y_used = b, len(self.offset)
                while True:
                    m = self.merged.get((x, y))
                    if m is not None and m < x_used and m <= y_used:
                        ok = False
                        break
                    if y not in self.halves:
                        break
                    y_used, y = y, self.halves[y][0]
                if x not in self.halves:
                    break
                x_used, x = x, self.halves[x][1]
            if len(self.fits) < WORDS_KEPT:
                self.fits[a, b] = ok
        return ok

    def prefix(self, token: int) -> int | None:
        """The longest other token that starts the token's spelling."""
        if token not in self.shorter:
            s = self.spelling[token]
            self.shorter[token] = next((self.ids[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.ids), None)
        return self.shorter[token]

    def forget(self) -> None:
        """Drop what was kept for speed."""
        self.fits, self.known, self.stretches = {}, {}, {}

    def word_ids(self, word: str) -> list[int]:
        """The tokens of one word of the pattern, not empty."""
        s = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        s = s[:-1] + chr(ord(s[-1]) + _END)
        whole = self.ids.get(s)
        if whole is not None and not self.halves.get(whole):
            return [whole]
        longest: list = [None] * len(s)
        for last, (size, token) in self.automaton.iter(s):
            longest[last + 1 - size] = token  # ends come in order, so the longest is last
        out: list[int] = []
        starts: list[int] = []
        hopeless = bytearray(len(s) + 1)
        at, token = 0, longest[0]
        while at < len(s):
            while token is not None:
                end = at + len(self.spelling[token])
                if not hopeless[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.prefix(token)
            if token is None:
                hopeless[at] = 1
                at, token = starts.pop(), out.pop()
            else:
                starts.append(at)
                out.append(token)
                at = end
                token = longest[at] if at < len(s) else None
        return out

    def word_bytes(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            found = np.array(self.word_ids(word), "<u4").tobytes()
            if len(word) <= LONGEST_KEPT and len(self.known) < WORDS_KEPT:
                self.known[word] = found
        return found

    def normal(self, text: str) -> str:
        """NFC, then each letter in lower case whatever stands beside it."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out, at = [], 0
        if "<" in text:
            for m in self.at_special.finditer(text):
                out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
                at = m.end()
        out.append(self._plain(text[at:] if at else text))
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        text = self.normal(text)
        if _SEPARATORS.search(text):
            return self._words(text)
        known, new = self.stretches.get, self._stretch
        return b"".join([known(x) or new(x) for x in text.split()])

    def _words(self, text: str) -> bytes:
        return b"".join(map(self.word_bytes, self.pattern.findall(text)))

    def _stretch(self, text: str) -> bytes:
        found = self._words(text)
        if len(text) <= LONGEST_KEPT and len(self.stretches) < WORDS_KEPT:
            self.stretches[text] = found
        return found

    def decode(self, ids: bytes) -> bytes:
        """The tokens' strings, one space between two, in UTF-8."""
        token = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(token):
            return b""
        start, size = self.offset[token], self.offset[token + 1] - self.offset[token]
        step = np.ones(int(size.sum()), np.int64)
        step[0] = start[0]
        step[np.cumsum(size)[:-1]] = start[1:] - start[:-1] - size[:-1] + 1
        return self.blob[np.cumsum(step)[:-1]].tobytes()


@functools.lru_cache(2)
def load(path: str) -> WordBpe:
    """One encoder for each vocabulary file and worker."""
    return WordBpe(path)


def _forgetting(rows: Callable) -> Callable:
    """``rows`` (path, ..., batches) with the encoder's memory dropped when its task ends.

    Arrow's pool keeps the batches of earlier tasks of a worker, so it gives them back before and after.
    """

    @functools.wraps(rows)
    def run(path: str, *more: object) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        pool.release_unused()
        try:
            yield from rows(path, *more)
        finally:
            load(path).forget()
            pool.release_unused()

    return run


@_forgetting
def _digests(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    for batch in batches:
        n, sha, back = [], [], []
        for text in batch.column(1):
            ids = bpe.encode(text.as_py())
            n.append(len(ids) // 4)
            sha.append(hashlib.sha256(ids).hexdigest())
            back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the decoded text, for each row of ``docs``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(functools.partial(_digests, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@_forgetting
def _with_ids(path: str, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    for batch in batches:
        ids = [np.frombuffer(bpe.encode(x.as_py()), "<u4").astype(np.int32) for x in batch.column(at)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, "ids"])


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of column ``text`` added as array column ``ids``, which must be a new name."""
    if ids in docs.columns:
        raise ValueError(f"there is a column {ids} already")
    schema = docs.select("*", F.array().cast("array<int>").alias(ids)).schema
    return docs.mapInArrow(functools.partial(_with_ids, path, docs.columns.index(text)), schema)


def _decoded(path: str, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    for batch in batches:
        texts = [None if x.as_py() is None else bpe.decode(np.array(x.as_py(), "<u4").tobytes()).decode() for x in batch.column(at)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the decoded text of the token ids in column ``ids`` added as column ``text``."""
    if text in docs.columns:
        raise ValueError(f"there is a column {text} already")
    schema = docs.select("*", F.lit(None).cast("string").alias(text)).schema
    return docs.mapInArrow(functools.partial(_decoded, path, docs.columns.index(ids)), schema)


@_forgetting
def _tokenised(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    for batch in batches:
        for i in range(0, max(1, batch.num_rows), 256):  # the ids of a few documents at a time
            part = batch.slice(i, 256)
            ids = [bpe.encode(x.as_py()) for x in part.column(1)]
            back = [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]
            lists = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(back, pa.string())], ["row", "ids", "n_tokens", "decoded_sha256"])


def tokenised(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with column ``text`` replaced by ids, n_tokens and decoded_sha256, the last three columns.

    Where ``docs`` has another column of such a name, the new one has underscores before it.
    """
    others = [c for c in docs.columns if c != text]
    own = docs.select(F.struct(*others).alias("row"), F.col(text).cast("string").alias("text"))
    schema = own.select("row", F.array().cast("array<int>").alias("ids"), F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("decoded_sha256")).schema
    return own.mapInArrow(functools.partial(_tokenised, path), schema).select(*(F.col("row")[c].alias(c) for c in others), *(F.col(c).alias(fresh(c, docs)) for c in ("ids", "n_tokens", "decoded_sha256")))
