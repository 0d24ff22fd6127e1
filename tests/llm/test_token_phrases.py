"""Token files, fill-in-middle and collocations against plain Python over small tables with every odd case."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagewright.llm import collocations, fill_middle, range_coder, token_files
from pagewright.llm.vocabularies import vocabulary

BYTES = vocabulary("byte_bpe_50k.json")


# -- range coder


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65535) | st.sampled_from([0, 5, 65535]), min_size=1, max_size=300), min_size=1, max_size=5))
def test_blocks_come_back(blocks):
    blocks = [np.array(x, np.uint16) for x in blocks]
    assert all((a == b).all() for a, b in zip(blocks, range_coder.decode(range_coder.encode(blocks), [len(x) for x in blocks]), strict=True))


def test_blocks_stand_alone_and_repetition_is_cheap():
    some = np.random.default_rng(3).integers(0, 65536, range_coder.BLOCK).astype(np.uint16)
    text = np.tile(np.arange(100, 140, dtype=np.uint16), 100)
    together = range_coder.encode([some, text, some[:7], np.zeros(range_coder.BLOCK, np.uint16)])
    assert together[1] == range_coder.encode([text])[0] and together[2] == range_coder.encode([some[:7]])[0]
    assert len(together[1]) < len(text) // 8 and len(together[3]) < 100 and len(together[0]) < 2.3 * len(some)


def test_carries():
    """Intervals at the top of the range make carries run through words that are already out."""
    wide, top = np.uint64(1 << 36), np.uint64((1 << 36) - 1)
    start = np.array([[top], [top], [0], [top]] * 40, np.uint64)
    width = wide - start
    width[2::4] = 1
    coder = range_coder._Coder(1, len(start))
    coder.put(start, width, np.ones(len(start), int))
    coded = np.frombuffer(coder.words()[0], "<u2")
    low, span = 0, (1 << 64) - 1  # exact: the number that the words spell lies in every interval
    number = sum(int(w) << 16 * (len(coded) - 1 - i) for i, w in enumerate(coded))
    size = 16 * len(coded)
    low, shift = 0, size - 64
    for a, n in zip(start[:, 0].tolist(), width[:, 0].tolist(), strict=True):
        part = span >> 36
        low += (a * part) << shift
        span = n * part
        assert low <= number < low + (span << shift)
        while span < 1 << 48:
            span, shift = span << 16, shift - 16


# -- token files

DOCS = [
    (7, "a b  c\n\n d"), (None, "no id"), (3, None), (3, ""), (3, "twice"), (3, "twice"), (2, "q<|endoftext|>\x1c　  z  \t\n w's don't 12 ٣ é日本"), (9, "long words " * 9000), (8, "!"), (-5, "   "), (10, " lead and trail "),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in DOCS], "doc_id long, text string, ids string, file int").repartition(3)


def expected_ids(end=0):
    library = Tokenizer.from_file(BYTES)
    rows = [(k, library.encode(t or "", add_special_tokens=False).ids + [end]) for k, t in DOCS]
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def test_token_files_against_the_library(spark, docs, tmp_path):
    token_files.write_files(docs, BYTES, f"{tmp_path}/t", end=11)
    got = token_files.documents(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=lambda x: (x[0] is not None, x[0] or 0, x[1])) == expected_ids(11)
    assert [r["doc_id"] for r in got] == [k for k, _ in expected_ids()]
    at = 0
    for r in got:
        assert r["start"] == at
        at += len(r["ids"])


def test_digests_against_the_library(spark, docs):
    got = token_files.token_files(docs, BYTES).orderBy("start").collect()
    want = Counter((k, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))) for k, ids in expected_ids())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()


def test_pieces_of_a_document_over_many_groups(spark, docs, monkeypatch, tmp_path):
    """With two blocks at a time, a document is put together from many pieces."""
    whole = token_files.token_files(docs, BYTES).orderBy("start").collect()
    token_files.write_files(docs, BYTES, f"{tmp_path}/t")
    monkeypatch.setattr(token_files, "LANES", 2)
    pieces = [p for x in spark.read.schema(token_files._BLOCKS).parquet(f"{tmp_path}/t").toArrow().to_batches() for p in token_files._decoded(False, iter([x]))]
    assert sum(p.num_rows for p in pieces) > len(DOCS)
    crc, sizes = {}, Counter()
    for r in sorted((r for p in pieces for r in p.to_pylist()), key=lambda r: (r["file"], r["document"], r["at"])):
        key = r["file"], r["document"]
        crc[key] = token_files.joined_crc(crc[key], r["crc"], 4 * r["n"]) if key in crc else r["crc"]
        sizes[key] += r["n"]
    assert Counter((sizes[k], crc[k]) for k in crc) == Counter((r["n_tokens"], r["ids_crc32"]) for r in whole)


def test_a_changed_block_is_found(spark, docs, tmp_path):
    token_files.write_files(docs, BYTES, f"{tmp_path}/t")
    blocks = spark.read.parquet(f"{tmp_path}/t").toArrow()
    coded = blocks.column("coded").to_pylist()
    bad = bytearray(coded[0])
    bad[token_files._HEADER.size + 2] ^= 1
    for rows in ([bytes(bad)], [coded[0][:-2]], [b"XXXX" + coded[0][4:]]):
        table = blocks.slice(0, 1).set_column(blocks.column_names.index("coded"), "coded", [rows])
        with pytest.raises((ValueError, IndexError)):
            list(token_files._decoded(False, iter(table.to_batches())))


def test_no_documents(spark, docs):
    assert token_files.token_files(docs.limit(0), BYTES).collect() == []


# -- fill in middle


def plain_fim(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


TEXTS = [None, "", "a", "one two", "<P", "x<M>y", "日本 é x1y2", "\n\n", "ab" * 500, "<S", "é" * 99, "word, " * 4000, "a\x00b\U0001f600c"]


def test_fill_in_middle_against_lists(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS * 9)] + [(5, "same"), (5, "same"), (None, "no id at all")]
    docs = spark.createDataFrame([(k, t, "z", 0) for k, t in rows], "doc_id long, text string, output string, h1 int").repartition(3)
    got = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in fill_middle.fill_in_middle(docs).collect())
    assert got == Counter((k, *plain_fim(k, t)) for k, t in rows)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    back = fill_middle.digests(docs).select("doc_id", "restored_sha256").collect()
    assert Counter(map(tuple, back)) == Counter((k, hashlib.sha256((t or "").encode()).hexdigest()) for k, t in rows)
    assert fill_middle.digests(docs.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("abZ <>PSM,\n日é\U0001f600"), max_size=60))
def test_masks_and_selection(text):
    data = text.encode()
    first, starts = fill_middle.masks(data)
    places, at = [], 0
    for unit in re.findall(r"[A-Za-z]+|[^A-Za-z]", text):
        places.append(at)
        at += len(unit.encode())
    assert first.bit_count() == len(text) and starts.bit_count() == len(places)
    assert [fill_middle.select(starts, k, len(data)) for k in range(len(places) + 1)] == [*places, len(data)]


# -- collocations


def plain_collocations(rows, least, percent, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + z]) for z in range(1, 5) for i in range(len(words) - z + 1))
    found = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    out = []
    for (lang, *w), a in found.items():
        cuts = []
        for k in range(1, len(w)):
            left, right = f[(lang, *w[:k])], f[(lang, *w[k:])]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        around = [b for (other, *v), b in found.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if not any(100 * b >= percent * a for b in around):
            out.append((lang, score, a, " ".join(w), left, right, n[lang]))
    ranked = sorted(out, key=lambda x: (x[0], -x[1], -x[2], x[3].encode()))
    places, rows = Counter(), []
    for lang, score, a, phrase, left, right, total in ranked:
        places[lang] += 1
        if places[lang] <= top:
            rows.append((lang, places[lang], phrase, a, left, right, total, score))
    return rows


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_against_counting(spark):
    rng = np.random.default_rng(5)
    words = ["The", "of", "new", "york", "city", "é", "x.y", "日本", "tab\tbed", "a\x00b", "is"]
    rows = [(("en", "de", None, "a\tb")[i % 4], " ".join(rng.choice(words, rng.integers(0, 25)))) for i in range(300)]
    rows += [("en", "New  York\tcity hall. new york city hall"), ("en", None), (None, ""), ("de", ",,,; \n")] * 10 + [("en", "w " * 5000)] + [("fr", "le chat noir dort")] * 40
    docs = spark.createDataFrame([(i, lang, t, "q") for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string").repartition(4)
    for least, percent, top in ((30, 80, 2000), (5, 60, 7)):
        got = sorted(map(tuple, collocations.collocations(docs, least, percent, top).select(*COLUMNS).collect()))
        assert got == sorted(plain_collocations(rows, least, percent, top))
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_counts_spill(spark, monkeypatch):
    """A task counts more than its memory holds and gives the same counts."""
    monkeypatch.setattr(collocations, "MEMORY", "20MB")
    rng = np.random.default_rng(7)
    pieces = [" ".join(f"w{x}" for x in rng.integers(0, 30_000, 40)) for _ in range(12_000)]
    table = spark.createDataFrame([("en", x, 3) for x in pieces], "lang string, piece string, k long").toArrow()
    want = Counter(w for x in pieces for w in x.split())
    got = Counter()
    pairs = 0
    for batch in collocations._counted(None, 50, iter(table.to_batches())):
        for r in batch.to_pylist():
            if r["pairs"]:
                h, f = np.frombuffer(r["pairs"], np.int64).reshape(2, -1)
                pairs += f.sum()
                assert (h.view(np.uint64) % np.uint64(50) == r["h"]).all() and len(set(h)) == len(h)
            else:
                got[r["phrase"]] += r["f"]
    assert pairs == 3 * 39 * len(pieces)
    assert got == Counter({w: 3 * n for w, n in want.items()})
    assert sum(1 for _ in collocations._summed(1, iter([]))) == 0


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits."""
    a, big = 9_000_000_000_000_000, 9_000_000_000_000_001
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big + 2), ("en", "a b", 2, a), ("en", "c", 1, big), ("en", "a b c", 3, a - 1)], "lang string, phrase string, words int, f long").persist()
    got = {r["phrase"]: r["score"] for r in collocations.scored(counts.unionByName(counts.filter("phrase = 'a b'").withColumn("phrase", F.lit("b c")))).collect()}
    assert got["a b"] == 2_000_000 * a // (2 * big + 2) and got["a b c"] == 2_000_000 * (a - 1) // (a + big)
    assert [r["phrase"] for r in collocations.absorbed(counts).collect()] == ["a b"]
