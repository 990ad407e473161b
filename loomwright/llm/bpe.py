"""Operator 1: byte-level BPE encoding and decoding of whole texts.

Null texts count as empty. Rows are independent: ties, repeated rows and extra columns don't matter, an empty table
gives an empty result, and very long texts or words only take longer. Texts that hold a special token's string get
that token's id there, as the tokenizers library gives by default.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.bpe_core import Merges
from loomwright.llm.common import thrifty

#: Fixed value: the pattern by which byte-level vocabularies cut a text before merging.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of text that one Python worker remembers at most; the memory is emptied when it is full.
REMEMBERED = 200_000


_WARM: Codec | None = None


class Codec:
    """Encodes and decodes; remembers the ids of pieces between blanks, since most pieces come again.

    A boundary before every blank that stands between two non-blanks is certain under CUT, and so is one on either
    side of a lone line feed; so texts are split there and the pieces looked up. Pieces that hold any other white
    space send their text the long way, through the pattern.
    """

    @classmethod
    def warm(cls, spec: str) -> Codec:
        """The one that this worker process has already, from one task to the next, if it has one for the same file."""
        global _WARM
        if _WARM is None or _WARM.spec != spec:
            _WARM = cls(spec)
        return _WARM

    def __init__(self, spec: str):
        self.spec = spec
        self.merges = Merges(spec)
        self.cut = regex.compile(CUT)
        self.blank = regex.compile(r"\s")
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.merges.added, key=len, reverse=True)) + ")")
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.feed = self.merges.encode([b"\n"])[0]

    def forget(self) -> None:
        """Empties the memory of pieces; the merges stay."""
        self.words, self.pieces = {}, {}

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.words]
        self.words.update(zip(new, self.merges.encode([w.encode() for w in new]), strict=True))

    def _cut(self, piece: str) -> list[str] | None:
        """Of a piece with the blank before it; None if it holds white space. Most are letters and perhaps a mark."""
        if piece.isalpha():
            return [" " + piece]
        if piece[:-1].isalpha() and piece[-1] in ",.;:!?":
            return [" " + piece[:-1], piece[-1]]
        if piece[:1] == "\n":  # a line's first piece has no blank before it
            rest = piece[1:]
            return None if not rest or self.blank.search(rest) else ["\n", *self.cut.findall(rest)]
        return None if not piece or self.blank.search(piece) else self.cut.findall(" " + piece)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        if len(self.pieces) + len(self.words) > REMEMBERED:
            self.forget()
        # A line feed before all counts as the first line's; its id goes again below
        split = [("\n" + t).replace("\n", " \n")[1:].split(" ") for t in texts]
        flat = [p for x in split for p in x]
        found = list(map(self.pieces.get, flat))
        new = {p for p, f in zip(flat, found, strict=True) if f is None}
        cuts = {p: self._cut(p) for p in new}
        self._learn({w for c in cuts.values() if c for w in c})
        words = self.words
        made = {p: None if c is None else words[c[0]] if len(c) == 1 else b"".join([words[w] for w in c]) for p, c in cuts.items()}
        self.pieces.update((p, m) for p, m in made.items() if m is not None)
        found = [made[p] if f is None else f for p, f in zip(flat, found, strict=True)]
        out, at = [], 0
        for t, x in zip(texts, split, strict=True):
            of, at = found[at : at + len(x)], at + len(x)
            if not t:
                out.append(b"")
            elif None in of or any(a in t for a in self.merges.added):
                out.append(self._the_long_way(t))
            else:
                out.append(b"".join(of)[len(self.feed) :])
        return out

    def _the_long_way(self, text: str) -> bytes:
        out = []
        for part in self.special.split(text):
            if part in self.merges.added:
                out.append(np.array([self.merges.added[part]], dtype="<u4").tobytes())
            elif part:
                words = self.cut.findall(part)
                self._learn(set(words))
                out += [self.words[w] for w in words]
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        of = self.merges.bytes_of
        return b"".join([of[k] for k in np.frombuffer(packed, dtype="<u4").tolist()]).decode("utf-8", errors="replace")


def slices(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256, and with with_ids the ids and the decoded text as well.

    vocabulary: a local path on the driver; its content goes to the executors, so they need no such file.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.warm(spec.value)
        for batch in batches:
            for part in slices(batch):
                packed = codec.encode([t or "" for t in part.column(1).to_pylist()])
                decoded = [codec.decode(x) for x in packed]
                columns = [
                    part.column(0),
                    pa.array([len(x) // 4 for x in packed], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                ]
                if with_ids:
                    columns += [pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in packed], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])])
        codec.forget()

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(thrifty(work), schema).withColumnRenamed("key", key)
