"""Operator 6: token ids of whole documents in Parquet files that can be read selectively.

The format: one row per document in ascending key order over files and within each, columns key, source, n_tokens and
tokens (list of int32). Row groups and pages are of a set size; keys and counts are delta-encoded, tokens and sources
dictionary-encoded; the writer adds column and offset indexes, so a reader that wants some keys, or only metadata,
skips other pages and columns.

Null texts count as empty and hold the end id alone. Repeated keys stay apart, ordered by their texts; null keys come
first. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.llm.bpe_core import Merges
from loomwright.llm.common import LOWER, UPPER, scratch_path, thrifty, tidy

#: Words that one Python worker remembers, and a portion's more at most; of a full memory those stay that the last portion held again.
#: Of pieces that the library coded, half as many; that memory is emptied when it is full.
REMEMBERED = 500_000
#: Bytes of text that are split into pieces at once.
PORTION = 8 << 20
#: Row groups of 16 MB and pages of 256 kB or 5 000 rows.
FORMAT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "5000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#key": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}


_WARM: Pieces | None = None


def _flags(some: bytes) -> np.ndarray:
    """By byte: whether it is one of these."""
    out = np.zeros(256, dtype=bool)
    out[list(some)] = True
    return out


def _strings(raw: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings that lie one behind the other in raw."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw)))


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same the other way round: the bytes of strings (of which none is null), and their lengths."""
    n = len(strings)
    if not n:
        return np.empty(0, dtype=np.uint8), np.empty(0, dtype=np.int64)
    _, ends, raw = strings.cast(pa.large_string()).buffers()
    ends = np.frombuffer(ends, dtype=np.int64, count=strings.offset + n + 1)[strings.offset :]
    raw = np.frombuffer(raw, dtype=np.uint8)[ends[0] : ends[-1]] if raw is not None else np.empty(0, dtype=np.uint8)
    return raw, np.diff(ends)


def _runs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at starts, one behind the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 2**31 else np.int64
    at = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return flat[at]


class Pieces:
    """Ids as the tokenizers library gives them; pieces between blanks are independent under a tokenizer that drops white space, so each
    distinct piece of some documents is worked out once, and its ids are laid where it stands.

    Most pieces are a word of Latin letters below U+0130, perhaps with one mark after it. Composition leaves such letters alone
    and lower case maps each to one letter, so those words go to the batched merges of bpe_core, and so do other printable ASCII pieces, cut
    as the tokenizer's pattern cuts them; all others go to the library. Words, and pieces that the library coded, are remembered.
    """

    #: Those most often found behind a word.
    MARKS = b",.;:!?"
    #: How the tokenizer's pattern cuts printable ASCII.
    CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
    #: By byte: ASCII letters and the first bytes of U+00C0 to U+013F; marks; printable ASCII.
    LETTER, MARK, PRINTABLE = _flags((UPPER + LOWER).encode() + b"\xc3\xc4"), _flags(MARKS), _flags(bytes(range(33, 127)))

    def __init__(self, spec: str, end: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = Merges(spec)
        self.known: dict[str, bytes] = {}  # by the library
        self.words = pa.array([], pa.large_string())
        self.ids, self.starts, self.sizes = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.spec, self.end = spec, np.array([end], dtype="<u4").tobytes()

    @classmethod
    def warm(cls, spec: str, end: int) -> Pieces:
        """The one that this worker process has already, from one task to the next, if it has one for the same file."""
        global _WARM
        if _WARM is None or _WARM.spec != spec:
            _WARM = cls(spec, end)
        _WARM.end = np.array([end], dtype="<u4").tobytes()
        return _WARM

    @classmethod
    def lowered(cls, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of UTF-8: which bytes are of letters below U+0130 (but for three letter-like signs), and the bytes with these in lower case."""
        before = np.concatenate([np.zeros(1, dtype=np.uint8), raw])[: len(raw)]
        c3, c4 = before == 0xC3, before == 0xC4
        letter = cls.LETTER[raw] | (c3 & (raw != 0x97) & (raw != 0xB7)) | (c4 & (raw < 0xB0))
        large = ((raw >= 65) & (raw <= 90)) | (c3 & (raw <= 0x9E) & (raw != 0x97))
        return letter, raw + np.uint8(32) * large + (c4 & (raw < 0xB0) & (raw % 2 == 0))

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids known, and where those of each word (none twice) begin and how many they are."""
        at = pc.index_in(words, value_set=self.words)
        new = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy().astype(np.int64)
        if new.any():
            fresh = words.filter(pa.array(new))
            ids, starts, sizes = self.merges.encode_flat(*_bytes(fresh))
            at[new] = np.arange(len(self.words), len(self.words) + len(fresh))
            self.words = pa.concat_arrays([self.words, fresh])
            self.starts, self.sizes = np.concatenate([self.starts, starts + len(self.ids)]), np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, ids])
        out = self.ids, self.starts[at], self.sizes[at]
        if len(self.words) > REMEMBERED:  # what was known before and came again stays
            old = np.flatnonzero(~new)
            self.words = words.take(pa.array(old))
            self.ids, self.sizes = _runs(out[0], out[1][old], out[2][old]), out[2][old]
            self.starts = np.cumsum(self.sizes) - self.sizes
        return out

    def _by_library(self, pieces: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED // 2:
            self.known = {}
        new = [p for p in pieces if p not in self.known]
        for at in range(0, len(new), 2048):
            some = new[at : at + 2048]
            self.known.update((p, np.array(e.ids, dtype="<i4").tobytes()) for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True))
        return [self.known[p] for p in pieces]

    def _of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each piece (none twice) begin in them and how many they are."""
        raw, lengths = _bytes(pieces)
        ends = np.cumsum(lengths)
        letter, lower = self.lowered(raw)

        def count(flags: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(flags) + 1, dtype=np.int32)
            np.cumsum(flags, out=sums[1:])
            return sums[ends] - sums[ends - lengths]

        strange = count(~letter)
        last = raw[np.maximum(ends - 1, 0)] if len(raw) else np.zeros(len(lengths), dtype=np.uint8)
        marked = (strange == 1) & (lengths > 1) & self.MARK[last]
        plain = (strange == 0) | marked
        rest = np.flatnonzero(~plain)
        texts = pieces.take(pa.array(rest)).to_pylist()
        cut = (count(~self.PRINTABLE[raw]) == 0)[rest] & np.array(["<|" not in t for t in texts], dtype=bool)  # special tokens begin so
        mixed, others = rest[cut], rest[~cut]
        cuts = [self.CUT.findall(t.lower()) for t, c in zip(texts, cut.tolist(), strict=True) if c]

        # Runs of ids, piece by piece: of a plain one its word and its mark (or nothing), of a mixed one its words, of the others all at once
        bare = np.repeat(plain, lengths)
        bare[ends[marked] - 1] = False
        words = pa.concat_arrays([_strings(lower[bare], (lengths - marked)[plain]), pa.array([w for c in cuts for w in c], pa.large_string())]).dictionary_encode()
        del letter, lower, bare
        known, starts, sizes = self._of_words(words.dictionary)
        found = words.indices.to_numpy()
        starts, sizes, n = starts[found], sizes[found], int(plain.sum())
        by_library = self._by_library([t for t, c in zip(texts, cut.tolist(), strict=True) if not c])
        of_others = np.array([len(x) // 4 for x in by_library], dtype=np.int64)
        flat = np.concatenate([known, self.merges.last, np.frombuffer(b"".join(by_library), dtype="<i4")])
        runs = [
            np.stack([starts[:n], len(known) + last[plain].astype(np.int64)], axis=1).ravel(),
            starts[n:],
            len(known) + len(self.merges.last) + np.cumsum(of_others) - of_others,
        ]
        each = np.concatenate([np.stack([sizes[:n], marked[plain]], axis=1).ravel(), sizes[n:], of_others])
        parts = np.cumsum([0, *map(len, cuts)])
        sums = np.concatenate([[0], np.cumsum(sizes[n:])])
        totals = np.concatenate([sizes[:n] + marked[plain], np.diff(sums[parts]), of_others])
        begin, size = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
        place = np.concatenate([np.flatnonzero(plain), mixed, others])
        begin[place], size[place] = np.cumsum(totals) - totals, totals
        return _runs(flat, np.concatenate(runs), each), begin, size

    def coded(self, texts: pa.Array, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of so many texts at a time, the end id behind each; and their counts."""
        texts.validate(full=True)
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        pieces, offsets = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        del split
        flat, begin, size = self._of_pieces(pieces.dictionary)
        flat = np.concatenate([flat, np.frombuffer(self.end, dtype="<i4")])
        begin, size = np.append(begin, len(flat) - 1), np.append(size, 1)  # the end is a piece of its own
        found = pieces.indices.to_numpy()
        for at in range(0, len(texts), rows):
            ends = offsets[at : at + rows + 1].astype(np.int64) - offsets[at]
            here = np.insert(found[offsets[at] : offsets[at] + ends[-1]], ends[1:], len(size) - 1)
            sizes = size[here]
            yield _runs(flat, begin[here], sizes), np.add.reduceat(sizes, ends[:-1] + np.arange(len(ends) - 1))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        out = []
        for ids, counts in self.coded(pa.array(texts, pa.string())):
            packed, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
            out += [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out


def portions(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, of about PORTION bytes in that column at a time, or one row that has more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, side="right")))
        yield batch.slice(at, end - at)
        at = end


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end: int, key: str = "doc_id", text: str = "text", source: str | None = "source") -> None:
    """Encodes every text, appends end, and writes the files at path in ascending key order."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pieces = Pieces.warm(spec.value, end)
        for batch in batches:
            for part in portions(batch, "text"):
                at = 0
                for ids, counts in pieces.coded(part.column("text")):
                    some, at = part.slice(at, len(counts)), at + len(counts)
                    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                    tokens = pa.ListArray.from_arrays(offsets, pa.array(ids))
                    yield pa.RecordBatch.from_arrays([some.column("key"), some.column("source"), pa.array(counts), tokens], ["key", "source", "n_tokens", "tokens"])

    kind = docs.schema[key].dataType.simpleString()
    where = F.col(source).cast("string") if source and source in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(key).alias("key"), where.alias("source"), F.col(text).cast("string").alias("text"))
    # Texts are dealt and sorted before they are encoded: they are smaller than their ids, and sampling the ranges then encodes nothing
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    coded = ordered.mapInArrow(thrifty(work), f"key {kind}, source string, n_tokens long, tokens array<int>")
    with tidy(spark):
        coded.write.mode("overwrite").options(**FORMAT).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """key, source, n_tokens, tokens; select columns and filter by key to read only those pages."""
    return spark.read.parquet(path)


def summarize_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: key, start (ids of all documents before it), n_tokens, ids_crc32.

    Counts are summed per file first; files hold ascending key ranges, so a document's start is the sum of the files
    before its own plus a running sum within it. One row per file is all that meets in one place.
    """
    kind = spark.read.parquet(path).schema["key"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            counts = np.diff(offsets).astype(np.int64)
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("at"), batch.column("key"), pa.array(counts), pa.array(crc, pa.int64())], ["file", "at", "key", "n_tokens", "ids_crc32"])

    read = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"), "key", "tokens")
    rows = read.mapInArrow(work, f"file string, at long, key {kind}, n_tokens long, ids_crc32 long")
    sizes = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), "n_tokens").groupBy("file").agg(F.sum("n_tokens").alias("tokens"))
    # names hold the partition's number, of five digits or more
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    before = sizes.select("file", (F.sum("tokens").over(Window.orderBy(number, "file")) - F.col("tokens")).alias("before"))
    within = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.join(before, "file")
        .withColumn("start", F.col("before") + F.sum("n_tokens").over(within) - F.col("n_tokens"))
        .select("key", "start", "n_tokens", "ids_crc32")
    )


def token_files(docs: DataFrame, vocabulary: str, end: int, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files (in the shared folder unless path names another place), reads them back and summarizes them."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    write_token_files(docs, vocabulary, path, end, key, text)
    return summarize_token_files(spark, path).withColumnRenamed("key", key)
