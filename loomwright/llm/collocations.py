"""Operator 12: phrase collocations by Apriori's level-wise passes.

A-Z become a-z, texts are cut into pieces at PIECES and pieces into words at blanks and tabs. One pass over all texts per level k
counts the k-word phrases of each language: a phrase is emitted only where both the phrase of its first k - 1 words and that of
its last k - 1 words are frequent (LEAST times or more). What is broadcast for that test is a bitmap of the frequent
phrases' hashes, put together by Spark, of twice as many bits as 16 times the phrases at most and of no more than 2 ** MOST_BITS bits
whatever the corpus. A phrase that slips through it by chance does so wherever it stands, so it is counted in full and then
falls to LEAST as any other; a full bitmap costs work, never results. Counts are summed per batch, per task, and
then over the corpus, so a word that makes up a third of it is no hot key.

Each level's frequent phrases are a table. A candidate's cuts are scored from these tables by two joins, as all parts of a
frequent phrase are frequent themselves: floor(1000 a n / (l r)), in decimals of 38 digits, exact.

A null text has no pieces, a null language is `und`. Very long texts are worked on whole, in turn with others. Repeated rows count each. Score ties go to the
smaller cut, then frequency, then the phrase's bytes. An empty table, or one without frequent phrases, gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import saved

#: What ends a piece.
PIECES = b".,;:!?\n\x0b\x0c\r"
LEAST, LONGEST, FIRST = 100, 5, 2000
#: The largest bitmap that is sent to tasks, as a power of two bits (16 MB).
MOST_BITS = 27
#: Bytes of text whose phrases are summed at once.
BLOCK = 4 << 20
#: Ranks are worked out in so many parts of a language first.
PARTS = 32

_CUT = bytes.maketrans(PIECES, b"." * len(PIECES))
_FACTOR = 0x9E3779B97F4A7C15
_OTHER = 0xC2B2AE3D27D4EB4F


def prepared(text: str) -> bytes:
    """A text whose words stand between blanks, with b"." between pieces."""
    return text.encode().lower().translate(_CUT).replace(b"\t", b" ").replace(b".", b" . ")


def phrase_hash(words: list[bytes], lang: str, factor: int = _FACTOR) -> int:
    """64 bits of a phrase of a language."""
    h = xxhash.xxh3_64_intdigest(lang.encode())
    return (reduce(lambda s, w: (s * factor + xxhash.xxh3_64_intdigest(w)) % 2**64, words, 0) ^ h) % 2**64


def _rolled(h: np.ndarray, k: int, factor: int) -> np.ndarray:
    """The hash of the k words that begin at each place."""
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(factor) + h[j : n + j]
    return out


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - bits)


class Frequent:
    """A bitmap of the frequent phrases of one length, as 64-bit words."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = _slots(h, self.bits)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def count_block(texts: list[bytes], lang: str, k: int, known: Frequent | None) -> tuple[list[str], list[int], int]:
    """Phrases of k words of some texts of a language, their counts, and the words of these texts."""
    words = b" . ".join(texts).split()  # of the bytes that it splits at, only blanks are left
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    mark = own == np.uint64(xxhash.xxh3_64_intdigest(b"."))
    total = len(words) - int(mark.sum())
    n = len(words) - k + 1
    if n <= 0:
        return [], [], total
    salt = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
    ends = np.concatenate([[0], np.cumsum(mark)])
    good = ends[k:] == ends[:n]  # no mark among the k words
    if known is not None:
        part = known.holds(_rolled(own, k - 1, _FACTOR) ^ salt)
        good &= part[:n] & part[1 : n + 1]
    at = np.flatnonzero(good)
    keys, check = _rolled(own, k, _FACTOR)[at], _rolled(own, k, _OTHER)[at]
    _, first, inverse, times = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    odd = check != check[first][inverse]  # other words with the same first hash: each is told apart and emitted alone
    if odd.any():
        times = times - np.bincount(inverse[odd], minlength=len(times))
    places = np.concatenate([at[first], at[odd]]).tolist()
    return [b" ".join(words[p : p + k]).decode() for p in places], [*times.tolist(), *[1] * int(odd.sum())], total


def _counted(texts: DataFrame, k: int, known: Frequent | None) -> DataFrame:
    """texts: lang, text. Per language the phrases of k words with their counts; on level 1 also the words in all, under a null phrase."""
    sent = texts.sparkSession.sparkContext.broadcast(known)  # of 2 ** MOST_BITS bits at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, some in held.items():
                phrases, times, total = count_block(some, lang, k, sent.value)
                if k == 1:
                    phrases, times = [*phrases, None], [*times, total]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(times), pa.string()), pa.array(phrases, pa.string()), pa.array(times, pa.int64())], ["lang", "phrase", "f"])

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                raw = prepared(text.as_py())
                held.setdefault(lang.as_py(), []).append(raw)
                size += len(raw)
                if size >= BLOCK:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return texts.mapInArrow(work, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _bitmap(level: DataFrame, most_bits: int) -> Frequent | None:
    """The bitmap of a level's phrases, None if there are none. Only its words reach the driver, no phrase."""
    n = level.count()
    if not n:
        return None
    bits = min(most_bits, max(10, (16 * n).bit_length()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [phrase_hash(p.encode().split(b" "), lang) for lang, p in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True)]
            at = _slots(np.array(h, np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bit"])

    found = level.select("lang", "phrase").mapInArrow(work, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << max(bits - 6, 0), np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Frequent(bits, words)


def levels(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, most_bits: int = MOST_BITS) -> tuple[DataFrame, list[DataFrame]]:
    """Words in all by language (lang, n), and per length a table lang, phrase, f of the frequent phrases."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    first = saved(_counted(texts, 1, None).where(F.col("phrase").isNull() | (F.col("f") >= least)), "phrases-1")
    totals = first.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    out = [first.where("phrase IS NOT NULL")]
    for k in range(2, longest + 1):
        known = _bitmap(out[-1], most_bits)
        if known is None:
            break
        out.append(saved(_counted(texts, k, known).where(F.col("f") >= least), f"phrases-{k}"))
    return totals, out


def _cut(phrase: Column, k: Column) -> tuple[Column, Column]:
    ws = F.split(phrase, " ")
    return F.array_join(F.slice(ws, F.lit(1), k), " "), F.array_join(F.slice(ws, k + 1, F.size(ws)), " ")


def scored(totals: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """Per candidate that no longer one holds as often: lang, phrase, a, l, r, n, score of its lowest cut."""
    every = reduce(DataFrame.unionByName, tables)
    spark = every.sparkSession
    if len(tables) < 2:
        return spark.createDataFrame([], "lang string, phrase string, a long, l long, r long, n long, score long")
    phrases = reduce(DataFrame.unionByName, tables[1:])
    ws = F.split("phrase", " ")
    # a phrase that a longer one holds as often is held as often by one of a single word more, since counts only fall on the way
    inner = lambda start: F.array_join(F.slice(ws, start, F.size(ws) - 1), " ")
    held = phrases.select("lang", "f", F.explode(F.array(inner(1), inner(2))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    free = phrases.join(held, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < 100 * F.col("f"))).select("lang", "phrase", F.col("f").alias("a"))

    cuts = free.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(ws) - 1)).alias("k"))
    left, right = _cut(F.col("phrase"), F.col("k"))
    cuts = cuts.withColumns({"left": left, "right": right})
    part = lambda name, f: every.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    met = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))"), big("l") * big("r")
    met = met.withColumn("above", score[0]).withColumn("below", score[1]).withColumn("score", F.expr("above div below"))
    best = met.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    return best.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, first: int = FIRST, most_bits: int = MOST_BITS) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score."""
    found = saved(scored(*levels(docs, text, lang, least, longest, most_bits)), "scored")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = found.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
