"""Operator 7: language identification by prediction by partial matching.

Every language has a tree of byte contexts of order 0 to ORDER with the counts of the bytes that followed. A byte's
probability in a context is count / (total + distinct) if it was seen there, else the escape probability distinct /
(total + distinct) times its probability in the next shorter context; below order 0 all symbols are alike. The counts
are frozen after learning, so a byte's exact code length depends only on the ORDER bytes before it: all of them are
worked out once into a table (context seen, symbol) for all languages together, where a context that a language never
saw stands for its longest suffix that was seen. Scoring a text is one pass of table reads over all its bytes.

A-Z count as a-z and line feeds as blanks, and bytes that were never learnt from are one symbol. The language of the
shortest code wins, ties going to the first in code point order. The score is the posterior of that language, all languages being
alike before, from code lengths tempered to at most CERTAIN bytes: exp(-bits) of whole texts would be 0 or 1.
A null text and one without a letter get und and score 0. Learning skips null texts and languages; without a learned
language everything is und. Rows alike are learnt from once, however often they are there. Extra columns and very long texts need no care; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import thrifty

ORDER = 3
#: Defaults of the parameters that bound what is learnt from: documents of each language (the first by a hash of their keys and
#: texts), and the code points of one.
SAMPLE, LONGEST = 600, 20_000
CERTAIN = 40
PAD = 32  # a blank stands before each text


class Trees:
    """Frozen code lengths: follow maps the last ORDER symbols to a row of bits, and bits[row, symbol] holds a length per language."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        joined = {k: [fold_bytes(t) for t in v] for k, v in samples.items()}
        seen = np.zeros(256, dtype=bool)
        for texts in joined.values():
            for t in texts:
                seen[t] = True
        seen[PAD] = True
        known = np.flatnonzero(seen)
        self.symbols = len(known) + 1  # the last stands for bytes never seen
        self.symbol_of = np.full(256, len(known), dtype=np.int32)
        self.symbol_of[known] = np.arange(len(known))
        n = self.symbols
        counts = {k: self._count([self.symbol_of[t] for t in v]) for k, v in joined.items()}
        contexts = [np.unique(np.concatenate([c[o][0] // n for c in counts.values()])) if counts else np.empty(0, np.int64) for o in range(ORDER + 1)]
        # rows of bits: all contexts of order 0, then of order 1, and so on; a context's row follows that of its suffix
        first = np.cumsum([0, *[len(c) for c in contexts]])
        self.bits = np.empty((max(int(first[-1]), 1), n, len(self.languages)), dtype=np.float32)
        for j, k in enumerate(self.languages):
            shorter = np.full((1, n), 1.0 / n)
            for o in range(ORDER + 1):
                own = self._order(counts[k][o], contexts[o], contexts[o - 1] if o else None, shorter, o)
                self.bits[first[o] : first[o + 1], :, j] = -np.log2(own)
                shorter = own
        self.follow = np.zeros(n**ORDER, dtype=np.int32)
        for o in range(1, ORDER + 1):
            rows = np.arange(first[o], first[o + 1], dtype=np.int32)
            block = n ** o
            view = self.follow.reshape(-1, block)
            view[:, contexts[o]] = rows[None, :]

    def _count(self, texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each order o: the codes of o symbols and the one after them, and how often each occurs."""
        out = []
        pad = np.full(ORDER, self.symbol_of[PAD])
        for o in range(ORDER + 1):
            codes = [self._codes(np.concatenate([pad, t]), o)[ORDER - o :] for t in texts]
            out.append(np.unique(np.concatenate(codes) if codes else np.empty(0, np.int64), return_counts=True))
        return out

    def _codes(self, symbols: np.ndarray, o: int) -> np.ndarray:
        code = symbols[: len(symbols) - o].astype(np.int64)
        for j in range(1, o + 1):
            code = code * self.symbols + symbols[j : len(symbols) - o + j]
        return code

    def _order(self, counted: tuple[np.ndarray, np.ndarray], contexts: np.ndarray, suffixes: np.ndarray | None, shorter: np.ndarray, o: int) -> np.ndarray:
        """Probabilities of every symbol in each context of one order, for one language."""
        n = self.symbols
        codes, times = counted
        table = np.zeros((len(contexts), n))
        table[np.searchsorted(contexts, codes // n), codes % n] = times
        total, kinds = table.sum(axis=1, keepdims=True), (table > 0).sum(axis=1, keepdims=True)
        at = np.zeros(len(contexts), dtype=np.int64) if o == 0 else np.searchsorted(suffixes, contexts % n ** (o - 1)) if o > 1 else np.zeros(len(contexts), dtype=np.int64)
        below = shorter[at]
        with np.errstate(invalid="ignore", divide="ignore"):
            escape = np.where(total > 0, kinds / (total + kinds), 1.0)  # unseen in this language: straight to the suffix
            return np.where(table > 0, table / (total + kinds), escape * below)

    def lengths(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text in each language, and bytes of each text."""
        pad = bytes([PAD] * ORDER)
        raw = self.symbol_of[fold_bytes(b"".join([pad + t for t in texts]))]
        sizes = np.array([len(t) + ORDER for t in texts])
        n = self.symbols
        code = raw[:-ORDER].astype(np.int64)
        for j in range(1, ORDER):
            code *= n
            code += raw[j : len(raw) - ORDER + j]
        ends = np.cumsum(sizes)
        begins = np.concatenate([[0], ends[:-1]])
        rows = self.follow[code]
        costs = self.bits[rows, raw[ORDER:]]  # of the byte ORDER places later
        # places whose byte is padding of the next text count nothing
        for k in range(1, ORDER + 1):
            at = ends[:-1] - k
            costs[at] = 0
        total = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(sizes > ORDER)
        if len(some):
            sums = np.add.reduceat(costs, np.minimum(begins[some], len(costs) - 1), axis=0, dtype=np.float64)
            total[some] = sums
        return total, sizes - ORDER


def fold_bytes(t: bytes) -> np.ndarray:
    return np.frombuffer(t.lower().replace(b"\n", b" "), dtype=np.uint8)


def learn(docs: DataFrame, learnt_from: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, longest: int = LONGEST) -> Trees:
    """Trees of every language, from at most `sample` documents of each, of the rows where learnt_from holds.

    Counts give each language's share of the hash range, so that no language's rows meet in one task. Rows that share a key are
    drawn one by one, by their texts, and rows alike count once, so what is collected of a language is bounded by sample and longest.
    Texts over `longest` code points are learnt from only where a language has no others, and then from their beginnings.
    """
    rows = docs.where(learnt_from & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    rows = rows.where(F.col("text").isNotNull()).withColumn("h", F.xxhash64("k", "text"))
    short = F.length("text") <= longest
    each = rows.select("lang", "h", short.alias("is_short")).distinct()  # rows alike count once here too, else their language's share would be too small
    counts = each.groupBy("lang").agg(F.count_if("is_short").alias("short"), F.count(F.lit(1)).alias("n"))
    n = F.when(F.col("short") > 0, F.col("short")).otherwise(F.col("n"))
    place = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    met = rows.join(F.broadcast(counts.select("lang", "short", (F.lit(1.2 * sample + 20) / n).alias("share"))), "lang")  # one row a language
    cut = met.where((place < F.col("share")) & (short | (F.col("short") == 0))).select("lang", place.alias("p"), F.substring("text", 1, longest).alias("text"))
    samples: dict[str, list[bytes]] = {}
    for r in sorted(cut.distinct().collect(), key=lambda r: (r["p"], r["text"])):
        if len(mine := samples.setdefault(r["lang"], [])) < sample:
            mine.append(r["text"].encode())
    return Trees(samples)


def identify(docs: DataFrame, learnt_from: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, keep: list[str] | None = None) -> DataFrame:
    """The columns of docs named in keep (all of them if None) in a struct named row, beside lang_pred, score and bits_per_byte."""
    trees = docs.sparkSession.sparkContext.broadcast(learn(docs, learnt_from, key, text, lang, sample))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trees.value
        for batch in batches:
            at = 0
            texts = batch.column("t")
            while at < batch.num_rows:
                some, size = [], 0
                while at + len(some) < batch.num_rows and size < 1 << 20:
                    some.append(texts[at + len(some)].as_py() or "")
                    size += len(some[-1])
                yield judge(t, batch.slice(at, len(some)), some)
                at += len(some)

    row = F.struct(*(docs.columns if keep is None else keep)).alias("row")
    schema = docs.select(row).schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    return docs.select(row, F.col(text).cast("string").alias("t")).mapInArrow(thrifty(work), schema)


def judge(t: Trees, part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    preds, scores, rates = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    judged = [k for k, x in enumerate(texts) if any(map(str.isalpha, x))] if t.languages else []
    if judged:
        bits, sizes = t.lengths([texts[k].encode() for k in judged])
        best = bits.argmin(axis=1)
        tempered = (bits.min(axis=1, keepdims=True) - bits) * np.minimum(1.0, CERTAIN / sizes)[:, None]
        sure = 1 / np.exp2(tempered).sum(axis=1)
        for j, k in enumerate(judged):
            preds[k] = t.languages[best[j]]
        scores[judged] = sure
        rates[judged] = bits.min(axis=1) / sizes
    return pa.RecordBatch.from_arrays([part.column("row"), pa.array(preds), pa.array(scores), pa.array(rates)], ["row", "lang_pred", "score", "bits_per_byte"])
