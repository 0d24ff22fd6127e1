"""Toxicity scores from a subsequence string kernel SVM with Nyström landmarks, trained on labelled sentences.

The kernel of two words adds, over all common subsequences of three letters within SPAN places, a decay for
each place spanned, so an insult with a gap or with an inserted character stays close to the insult. Words
are scaled by what their length alone would give, punctuation inside a word is skipped and digits count as
the letters they resemble. The kernel of two sentences is the sum over their words' kernels. Nyström features are a
sentence's kernels with the landmarks times the inverse square root of the landmarks' own kernel matrix; on them the
support vector machine is linear, so its decision is one weight for each subsequence and a document costs one pass over
its letters. A document has four features: its highest word (a sentence of one word) and sentence, and the sum of
its words' positive values, as a logarithm and by the root of its length. A logistic fit on labelled documents turns
them into a score from 0 to 1.

Training uses a bounded sample of labelled documents that aren't held out: the first SAMPLE of each label by
hash of doc_id, one row for each doc_id and one for each value of a MinHash of its shingles, so that groups of copies don't
outvote the rest. A label is a document's, not a sentence's, so the sentence that bears it is found: Spark counts in how many
toxic and other sample documents each five-letter fragment stands (hashed to BUCKETS), and fragments that stand in toxic
documents more often than chance allows are witnesses. A toxic document's example is its sentence with most witnesses, and
the words that have them are sentences of one word; a calm document's are a sentence and some words by hash. A second fit
takes each document's highest sentence under the first, for calm documents besides the first ones: the hardest.

Labels, lang, source and doc_id are never inputs of a score. Defined cases: null, empty and wordless texts
have the features of a document without evidence. Labels that are null or name no document aren't used; a
doc_id with several labels is toxic if one says so. Where the sample has no witnesses, every score
is the share of toxic labels. Ties are broken by hash of the text, so a fit depends on the rows only. Extra columns are not
read.
"""

from __future__ import annotations

import collections
import functools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .store import fresh, written

#: Labelled documents of each label in the sample, at most.
SAMPLE = 4000
#: Hashed fragments that are counted, and letters of one.
BUCKETS, FRAGMENT = 1 << 20, 5
#: A witness stands in calm documents at most at this share of its rate in toxic ones, and so often by chance at most, over
#: all fragments that are counted.
RATE, CHANCE = 0.5, 0.001
#: Words that witnesses mark, and calm ones, among the examples, and landmarks of either kind, at most.
WORDS, CALM_WORDS, LANDMARKS, CALM_LANDMARKS = 3000, 6000, 256, 96
#: Words of a training example, bytes of one of its words, and words that a document gives as examples, at most: the examples of the whole
#: sample, which the driver fits on, stay under a few ten MB whatever the texts are. Scores look at whole texts.
EXAMPLE_WORDS, EXAMPLE_BYTES, EXAMPLES = 200, 64, 100
#: Places that a subsequence may span, and the decay for each.
SPAN, DECAY = 5, 0.7
#: SQL that is true for the rows that no label is learned from.
HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0"

_EDGE, _SKIP, _SIDE = 31, 255, 32
_CODE = np.full(256, _SKIP, np.uint8)
_CODE[ord("a") : ord("z") + 1] = _CODE[ord("A") : ord("Z") + 1] = np.arange(26)
for _digit, _letter in zip("0134578@$", "oieastbas", strict=True):
    _CODE[ord(_digit)] = ord(_letter) - ord("a")
for _digit in "269":
    _CODE[ord(_digit)] = 26
_CODE[0x80:0xC0] = 27 + np.arange(64) % 4  # the varying bytes of other letters; the leading ones are skipped
_LETTER = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz#1234^", np.uint8)
_STOP = np.zeros(256, bool)
_STOP[[ord(x) for x in ".!?\n"]] = True


class Letters:
    """The words of some texts as letter codes with an edge before and after each; words without letters go."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        words = ta.Words(data, off)
        code = _CODE[data]
        kept = np.flatnonzero(code != _SKIP)
        in_word = np.searchsorted(words.start, kept, "right") - 1
        size = np.bincount(in_word, minlength=len(words.start))
        some = np.flatnonzero(size)
        self.size = size[some]
        self.of = np.searchsorted(some, words.of)  # words by text
        self.at = np.concatenate([[0], np.cumsum(self.size + 2)])
        self.code = np.full(int(self.at[-1]), _EDGE, np.uint8)
        rank = np.cumsum(size > 0) - 1
        self.code[np.arange(len(kept)) + 1 + 2 * rank[in_word]] = code[kept]
        stops = np.flatnonzero(_STOP[data])
        self.sentence = np.searchsorted(stops, words.start[some])  # equal for words with no stop between them

    def subsequences(self) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Decay, starts and index of every subsequence of three codes of one word, by the places between them."""
        code = self.code.astype(np.int32)
        left = np.repeat(self.at[1:], self.size + 2) - np.arange(len(code))  # codes from here to the word's end
        for last in range(2, SPAN):
            start = np.flatnonzero(left > last)
            ends = code[start] * (_SIDE * _SIDE) + code[start + last]
            for mid in range(1, last):
                yield DECAY ** (last + 1), start, ends + code[start + mid] * _SIDE

    def scale(self) -> np.ndarray:
        """What each word's kernel with itself would give if none of its subsequences came twice, as a root."""
        n = self.size + 2
        return np.sqrt(sum((last - 1) * np.maximum(n - last, 0) * DECAY ** (2 * last + 2) for last in range(2, SPAN)))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """For each word the sum of decayed ``weights`` (one for each subsequence) over its subsequences, scaled."""
        if not len(self.size):
            return np.zeros(0)
        total = np.zeros(len(self.code), np.float32)
        for decay, start, index in self.subsequences():
            total[start] += np.float32(decay) * weights[index]
        return np.add.reduceat(total, self.at[:-1]) / self.scale()

    def features(self, word: int) -> np.ndarray:
        """A word's scaled counts of all subsequences."""
        out = np.zeros(_SIDE**3, np.float32)
        code = self.code[self.at[word] : self.at[word + 1]].astype(np.int32)
        for last in range(2, min(SPAN, len(code))):
            for mid in range(1, last):
                start = np.arange(len(code) - last)
                np.add.at(out, code[start] * _SIDE * _SIDE + code[start + mid] * _SIDE + code[start + last], DECAY ** (last + 1))
        return out / self.scale()[word]

    def counts(self) -> np.ndarray:
        """A text's scaled counts of all subsequences, a row for each text."""
        n = len(self.of) - 1
        text, scale = np.repeat(np.arange(n), np.diff(self.of)), self.scale()
        out = np.zeros(n * _SIDE**3)
        word = np.repeat(np.arange(len(self.size)), self.size + 2)
        for decay, start, index in self.subsequences():
            own = word[start]
            out += np.bincount(text[own] * _SIDE**3 + index, decay / scale[own], n * _SIDE**3)
        return out.reshape(n, -1)

    def fragments(self) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of every run of FRAGMENT codes of one word, edges included, and its word."""
        left = np.repeat(self.at[1:], self.size + 2) - np.arange(len(self.code))
        start = np.flatnonzero(left >= FRAGMENT)
        key = np.zeros(len(start), np.uint64)
        for k in range(FRAGMENT):
            key = key * np.uint64(_SIDE) + self.code[start + k].astype(np.uint64)
        word = np.repeat(np.arange(len(self.size)), self.size + 2)[start]
        return (ta.mix(key) & np.uint64(BUCKETS - 1)).astype(np.int64), word

    def marked(self, witnesses: np.ndarray) -> np.ndarray:
        """Whether each word has a witness."""
        bucket, word = self.fragments()
        out = np.zeros(len(self.size), bool)
        out[word[np.isin(bucket, witnesses)]] = True
        return out

    def sentences(self) -> np.ndarray:
        """The first word of each sentence; a text starts one."""
        doc = np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))
        return np.flatnonzero(np.diff(self.sentence, prepend=-1) | np.diff(doc, prepend=-1))

    def spellings(self) -> list[bytes]:
        text = _LETTER[self.code].tobytes()
        return [text[a + 1 : b - 1] for a, b in zip(self.at[:-1], self.at[1:], strict=True)]


def _examples_of(own: Letters) -> tuple[list[bytes], np.ndarray]:
    """The words of some texts, cut to EXAMPLE_BYTES, and the first word of each sentence, or of each EXAMPLE_WORDS of a longer one."""
    words, new = own.spellings(), own.sentences()
    ends = np.append(new[1:], len(words))
    starts = [np.arange(a, z, EXAMPLE_WORDS) for a, z in zip(new.tolist(), ends.tolist(), strict=True)]
    return [w[:EXAMPLE_BYTES] for w in words], np.concatenate(starts) if starts else new


def letters(words: list[str]) -> Letters:
    data, off = ta.utf8(pa.array(words, pa.string()))
    return Letters(data, off)


@dataclass
class Model:
    """A weight for each subsequence, the bias, and the logistic weights of the four features and 1."""

    weights: np.ndarray
    bias: float
    logistic: np.ndarray

    def features(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The four features of each text."""
        out = np.tile(np.array([-2.0, -2.0, 0.0, 0.0]), (len(off) - 1, 1))
        own = Letters(data, off)
        count = np.diff(own.of)
        full = np.flatnonzero(count)
        if len(full):
            value, new = own.dot(self.weights), own.sentences()
            out[full, 0] = np.maximum.reduceat(value, own.of[full]) + self.bias
            doc = np.repeat(np.arange(len(count)), count)
            sums = np.add.reduceat(value, new) + self.bias
            out[full, 1] = np.maximum.reduceat(sums, np.searchsorted(doc[new], full))
            total = np.add.reduceat(np.maximum(value, 0), own.of[full])
            out[full, 2], out[full, 3] = 2 * np.log1p(total), 8 * total / np.sqrt(count[full] + 10)
        return np.clip(out, -4, 8)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.logistic[:-1] + self.logistic[-1], -40, 40)))


def _features(model: Model, texts: pa.Array) -> np.ndarray:
    data, off = ta.utf8(texts)
    found = [model.features(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in ta.chunks(off)]
    return np.concatenate(found) if found else np.zeros((0, 4))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) with near, a MinHash of the shingles."""
    for batch in batches:
        near = [int(ta.mix(own).min().view(np.int64)) if len(own) else 0 for own in ta.shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int64())], ["toxic", "text", "near"])


def _fragment_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to (bucket, pos, neg): in how many toxic and other texts of a batch a fragment stands."""
    for batch in batches:
        counts = np.zeros((2, BUCKETS), np.int64)
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts[0 if toxic else 1, np.unique(letters([text.as_py() or ""]).fragments()[0])] += 1
        some = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])], ["bucket", "pos", "neg"])


def _tails(k: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """The chance of at least k of n at rate p, for each pair."""
    out = np.empty(len(k))
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, int(n.max(initial=0)) + 1)))])
    for at, (least, most) in enumerate(zip(k.tolist(), n.tolist(), strict=True)):
        i = np.arange(least, most + 1)
        out[at] = np.exp(logs[most] - logs[i] - logs[most - i] + i * math.log(p) + (most - i) * math.log1p(-p)).sum()
    return np.minimum(out, 1.0)


def _key(text: bytes) -> int:
    return zlib.crc32(text)


def _examples(witnesses: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to (toxic, sentence, words): the first examples of each document."""
    for batch in batches:
        rows = []
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = letters([text.as_py() or ""])
            words, new = _examples_of(own)
            if not words:
                continue
            whole = [b" ".join(words[i:j]) for i, j in zip(new, [*new[1:], len(words)], strict=True)]
            if toxic:
                marked = own.marked(witnesses)
                best = max(range(len(new)), key=lambda i, n=np.add.reduceat(marked, new, dtype=np.int64): (n[i], -_key(whole[i])))
                chosen = sorted({w for w, m in zip(words, marked, strict=True) if m}, key=lambda w: (_key(w), w))[:EXAMPLES]
            else:
                best = min(range(len(new)), key=lambda i: (_key(whole[i]), whole[i]))
                chosen = sorted(set(words), key=lambda w: (_key(w), w))[:3]
            rows.append({"toxic": toxic, "sentence": whole[best].decode(), "words": [w.decode() for w in chosen]})
        yield from pa.Table.from_pylist(rows, pa.schema([("toxic", pa.int32()), ("sentence", pa.string()), ("words", pa.list_(pa.string()))])).to_batches()


def _highest(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to (toxic, sentence): each document's highest sentence."""
    for batch in batches:
        rows = []
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = letters([text.as_py() or ""])
            if len(own.size):
                words, new = _examples_of(own)
                best = int(np.argmax(np.add.reduceat(own.dot(model.weights), new)))
                rows.append({"toxic": toxic, "sentence": b" ".join(words[new[best] : new[best + 1] if best + 1 < len(new) else len(words)]).decode()})
        yield from pa.Table.from_pylist(rows, pa.schema([("toxic", pa.int32()), ("sentence", pa.string())])).to_batches()


def landmarks(words: list[str], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Subsequences and scaled counts of up to n words, each in turn the farthest from those before."""
    own, found = letters(words), []
    near, at = np.full(len(own.size), -np.inf), 0
    while len(found) < min(n, len(own.size)):
        dense = own.features(at)
        some = np.flatnonzero(dense)
        found.append((some, dense[some]))
        near = np.maximum(near, own.dot(dense))
        at = int(np.argmin(near))
    return found


def fit_sentences(positive: list[str], negative: list[str], marks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """The SVM's weight for each subsequence and its bias, from sentences of both kinds and landmarks.

    Only subsequences that a landmark has matter; sentences pass in small groups, so memory stays at a few ten MB.
    """
    used = np.unique(np.concatenate([i for i, _ in marks]))
    of = np.zeros((len(marks), len(used)), np.float32)
    for row, (i, counts) in zip(of, marks, strict=True):
        row[np.searchsorted(used, i)] = counts
    values, vectors = np.linalg.eigh((of @ of.T).astype(float))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    by_subsequence = of.T @ root.astype(np.float32)

    sentences = positive + negative
    x = np.ones((len(sentences), by_subsequence.shape[1] + 1), np.float32)
    for i in range(0, len(sentences), 64):
        x[i : i + 64, :-1] = letters(sentences[i : i + 64]).counts()[:, used].astype(np.float32) @ by_subsequence
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    cost = np.where(y > 0, 0.5 / len(positive), 0.5 / len(negative)) * 2000
    w, ridge = np.zeros(x.shape[1]), np.ones(x.shape[1])
    ridge[-1] = 1e-3
    for _ in range(30):  # Newton steps on the squared hinge loss
        grad, hess = ridge * w, np.diag(ridge)
        for i in range(0, len(x), 1024):
            part, sign, weight = x[i : i + 1024].astype(float), y[i : i + 1024], cost[i : i + 1024]
            short = np.maximum(1 - sign * (part @ w), 0)
            active = short > 0
            grad -= part.T @ (weight * sign * short)
            hess += (part[active] * weight[active, None]).T @ part[active]
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    weights = np.zeros(_SIDE**3, np.float32)
    weights[used] = of.T @ (root @ w[:-1])
    return weights, float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-2)
    ridge[-1] = 1e-4
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = ridge * w + x.T @ (cost * (p - y))
        hess = np.diag(ridge) + (x * (cost * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labelled documents that aren't held out."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.filter(f"doc_id is not null and toxic is not null and not ({HELD_OUT})").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"] > 0: r["count"] for r in own.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    order = F.xxhash64("doc_id", F.lit("sample"))
    some = own.filter("toxic > 0").orderBy(order).limit(sample).unionByName(own.filter("toxic <= 0").orderBy(order).limit(sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # two numbers a row, 8,000 rows at most: small enough to broadcast
    known = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    known = known.select((F.col("toxic") > 0).cast("int").alias("toxic"), F.coalesce("text", F.lit("")).alias("text"))
    near = known.mapInArrow(_near, "toxic int, text string, near long").groupBy("near").agg(F.max_by(F.struct("toxic", "text"), F.struct("toxic", F.xxhash64("text"))).alias("one"))
    known = written(near.select("one.toxic", "one.text"), "toxicity-sample")
    docs_by = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    n_pos, n_neg = docs_by.get(1, 0), docs_by.get(0, 0)
    share = counts.get(True, 0) / max(1, sum(counts.values()))
    flat = Model(np.zeros(_SIDE**3, np.float32), -2.0, np.array([0.0] * 4 + [math.log((share + 1e-6) / (1 - share + 1e-6))]))
    if not n_pos or not n_neg:
        return flat
    # BUCKETS rows at most
    seen = known.mapInArrow(_fragment_counts, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter("pos + neg > 1").toPandas()
    maybe = seen[(seen["pos"] > 1) & (seen["neg"] * n_pos < RATE * seen["pos"] * n_neg)]
    chance = _tails(maybe["pos"].to_numpy(), (maybe["pos"] + maybe["neg"]).to_numpy(), n_pos / (n_pos + n_neg))
    witnesses = np.sort(maybe["bucket"].to_numpy()[chance * max(1, len(seen)) < CHANCE])
    if not len(witnesses):
        return flat
    first = known.mapInArrow(functools.partial(_examples, witnesses), "toxic int, sentence string, words array<string>").collect()  # a sentence of each sample document
    marked, calm = (collections.Counter(w for r in first if r["toxic"] == k for w in r["words"]) for k in (1, 0))
    best = sorted(marked, key=lambda w: (-marked[w], w))[:WORDS]
    rest = sorted(set(calm) - set(best), key=lambda w: (_key(w.encode()), w))[:CALM_WORDS]
    positive, negative = (sorted({r["sentence"] for r in first if r["toxic"] == k}) for k in (1, 0))
    if not best or not rest:
        return flat
    marks = landmarks(best, LANDMARKS) + landmarks(rest, CALM_LANDMARKS)
    model = Model(*fit_sentences(positive + best, negative + rest, marks), np.zeros(5))
    second = known.mapInArrow(functools.partial(_highest, model), "toxic int, sentence string").collect()
    positive = sorted({r["sentence"] for r in second if r["toxic"]})
    hard = sorted({r["sentence"] for r in second if not r["toxic"]})
    model = Model(*fit_sentences(positive + best, hard + negative + rest, marks), np.zeros(5))
    rows = known.mapInArrow(functools.partial(_known_features, model), "toxic int, x array<double>").toPandas()
    x, y = np.stack(rows["x"].to_numpy()), rows["toxic"].to_numpy()
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    each = {k: counts.get(bool(k), 0) / max(1, (y == k).sum()) for k in (0, 1)}  # the sample back to the labels' shares
    cost = np.where(y == 1, each[1], each[0])
    model.logistic = _logistic(x, y, cost / cost.mean())
    return model


def _known_features(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _features(model, batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "x"])


def _scored(model: Model, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = model.scores(_features(model, batch.column(at)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, "_score"])


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score of column ``text`` (a string) as column ``into``, which must be a new name."""
    if into in docs.columns:
        raise ValueError(f"there is a column {into} already")
    schema = docs.select("*", F.lit(0.0).alias(into)).schema
    return docs.mapInArrow(functools.partial(_scored, model, docs.columns.index(text)), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs`` (columns doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(own, train(docs, labels))
    return scored.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score under 0.5, with all their columns."""
    into = fresh("score", docs)
    own = docs.withColumn("text", F.col("text").cast("string"))
    return score(own, train(docs, labels), into=into).filter(F.col(into) < 0.5).select(*docs.columns)
