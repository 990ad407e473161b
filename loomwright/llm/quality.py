"""Operator 2: a quality classifier, hashed word n-grams under logistic regression by follow-the-regularised-leader.

A text's features are its words, its pairs of neighbouring words, and pairs of neighbouring words' shapes with whether
the two words are the same, each hashed to one of 2**BITS weights. Every occurrence weighs 1 / sqrt(number of
occurrences), so a score is one sparse dot product. Words are cut at white space.

Null and empty texts have the bias alone. Labels of documents that aren't there, null labels and null keys teach
nothing; several labels of one document count as the lowest. Of rows that share a labelled key, one text teaches: the first by its
hash. Ties in the order of learning are broken by the texts. Without labels every score is 0.5. Repeated rows are
scored each; very long texts are scored whole; an empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 18
#: Defaults of the parameters that bound what is learnt from: labelled documents, about (a share of the hash range of their keys), and the
#: longest of them in code points. Rounds over them.
SAMPLE, LONGEST, ROUNDS = 6000, 40_000, 3
#: Of the learner: rate, smoothing, and the weights of the absolute and the squared penalty.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
REMEMBERED = 300_000

_KINDS = str.maketrans({**{c: "a" for c in map(chr, range(97, 123))}, **{c: "A" for c in map(chr, range(65, 91))}, **{c: "0" for c in "0123456789"}})


def shape(word: str) -> str:
    """Runs of letters, capitals and digits by one sign each; marks stay, runs of one mark shortened to two."""
    out = []
    for c in word.translate(_KINDS):
        c = ("A" if c.isupper() else "a") if c.isalpha() else c
        if not (out and out[-1] == c and (c in "aA0" or len(out) > 1 and out[-2] == c)):
            out.append(c)
    return "".join(out)


class _Words(dict):
    """Two 32-bit hashes of a word, its own and its shape's, in one integer."""

    def __missing__(self, word: str) -> int:
        value = zlib.crc32(word.encode()) << 31 | zlib.crc32(shape(word).encode()) >> 1
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


class Features:
    def __init__(self):
        self.words = _Words()

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Features of all the texts, one after another, and how many each has."""
        codes, sizes = [], np.zeros(len(texts), dtype=np.int64)
        for k, t in enumerate(texts):
            parts = t.split()
            sizes[k] = len(parts)
            codes += map(self.words.__getitem__, parts)
        both = np.array(codes, dtype=np.uint64)
        word, form = both >> np.uint64(31), both & np.uint64((1 << 31) - 1)
        owner = np.repeat(np.arange(len(texts)), sizes)
        near = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, dtype=bool)
        pair = _mixed(word[:-1] * np.uint64(0x100000001B3) + word[1:] + np.uint64(1 << 40))
        same = (word[:-1] == word[1:]).astype(np.uint64)
        forms = _mixed((form[:-1] * np.uint64(0x1000193) + form[1:]) * np.uint64(2) + same + np.uint64(1 << 62))
        ids = np.concatenate([_mixed(word), pair[near], forms[near]])
        by = np.concatenate([owner, owner[1:][near], owner[1:][near]])
        order = np.argsort(by, kind="stable")
        return ids[order], np.bincount(by, minlength=len(texts))


class Leader:
    """Follow the regularised leader, per coordinate; the last coordinate is the bias."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, ids: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(ids)
        g = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
        self.z[ids] += g - (np.sqrt(self.n[ids] + g * g) - np.sqrt(self.n[ids])) / ALPHA * w
        self.n[ids] += g * g


def train(texts: list[str], labels: list[int]) -> np.ndarray:
    features, leader = Features(), Leader()
    rows = []
    for at in range(0, len(texts), 256):
        ids, sizes = features.of(texts[at : at + 256])
        for own in np.split(ids, np.cumsum(sizes)[:-1]):
            u, c = np.unique(own, return_counts=True)
            rows.append((np.append(u, 1 << BITS), np.append(c / max(1.0, np.sqrt(len(own))), 1.0)))
    for _ in range(ROUNDS):
        for (ids, values), y in zip(rows, labels, strict=True):
            leader.learn(ids, values, y)
    return leader.weights().astype(np.float32)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, longest: int = LONGEST) -> np.ndarray:
    """Weights from about `sample` labelled documents of at most `longest` code points; they meet in one task, which returns the weights."""
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).alias("y"))
    n = marks.count()
    place = F.pmod(F.xxhash64("k"), F.lit(1 << 30))
    some = marks.where(place < int(min(1.0, sample / max(n, 1)) * (1 << 30))).withColumn("p", place)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(F.broadcast(some), "k")  # some: about `sample` rows, by the share
    rows = rows.where(F.length(F.coalesce("t", F.lit(""))) <= longest)
    first = F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("first")
    rows = rows.groupBy("k", "p", "y").agg(first).select("p", "y", F.col("first.t").alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sorted((p, t or "", y) for b in batches for p, t, y in zip(*(b.column(c).to_pylist() for c in ("p", "t", "y")), strict=True))
        w = train([t for _, t, _ in known], [y for _, _, y in known]) if known else np.zeros((1 << BITS) + 1, dtype=np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["w"])

    got = rows.select("p", "t", F.col("y").cast("int").alias("y")).repartition(1).mapInArrow(work, "w binary").collect()
    return np.frombuffer(bytes(got[0]["w"]), dtype=np.float32) if got else np.zeros((1 << BITS) + 1, dtype=np.float32)


def score_texts(features: Features, w: np.ndarray, texts: list[str]) -> np.ndarray:
    ids, sizes = features.of(texts)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    sums = np.zeros(len(texts))
    some = np.flatnonzero(sizes)
    if len(some):
        sums[some] = np.add.reduceat(w[ids].astype(np.float64), starts[some]) / np.sqrt(sizes[some])
    return 1 / (1 + np.exp(-np.clip(sums + w[-1], -35, 35)))


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, longest: int = LONGEST) -> DataFrame:
    """Per row: key and score, the probability of label 1. labels: those to learn from."""
    weights = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, key, text, label, sample, longest))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = Features(), weights.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = score_texts(features, w, [t or "" for t in part.column("t").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(scores)], ["k", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(work, f"k {kind}, score double").withColumnRenamed("k", key)
