"""Operator 3: repeated lines, by levelled sorted runs of line hashes.

Lines are split at line feeds (a null or empty text is one empty line). A line's key is the line without ASCII white
space at its ends and with A-Z lower-cased; it is held as two 64-bit hashes.

Runs are Parquet tables bucketed and sorted by hash, with the number of documents and the largest document of each key. A key
lies in one run only: a new batch of documents is anti-joined with every run, bucket by bucket and without a shuffle, and what is
left becomes a run of its own. Keys that a run has already go to a log of updates instead. A level that has FANOUT runs is merged into one
run of the next level, and FANOUT logs into one. A manifest in the runs' folder names them all, so a later session can
open the folder and add its batches; a batch that the manifest names is not added again.

Null keys of documents: such rows are left whole and aren't counted. Repeated keys of documents count once within a batch and lose
the same lines. Ties can't occur: the largest key wins. Very long texts are split like others, within their row. An empty table gives
an empty result; extra columns, whatever their names, are kept by drop_lines and ignored by line_report.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import BLANKS, LOWER, UPPER, drop_scratch, read_text, saved, scratch_path, tidy, write_text

FANOUT = 2


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


class LineRuns:
    """Levels of sorted runs and a log of updates in the folder home: (a, b) the hash, docs the documents counted, top the largest of them."""

    def __init__(self, spark: SparkSession, home: str, kind: str = "bigint", fanout: int = FANOUT):
        """kind: the type of document keys. What the folder holds already, by its manifest, is opened."""
        self.spark, self.home, self.fanout = spark, home, fanout
        held = json.loads(read_text(spark, f"{home}/manifest.json") or "{}")
        self.kind = held.get("kind", kind)
        # as many buckets as a shuffle has partitions: what a batch's shuffle deals out lies as the runs do, one file a bucket
        self.buckets: int = held.get("buckets") or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = held.get("levels", [])
        self.updates: list[str] = held.get("updates", [])
        self.batches: list[str] = held.get("batches", [])
        for name in [*sum(self.levels, []), *self.updates]:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (a BIGINT, b BIGINT, docs BIGINT, top {self.kind}) USING parquet CLUSTERED BY (a, b) SORTED BY (a, b) INTO {self.buckets} BUCKETS LOCATION '{home}/{name}'")

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = df.select("a", "b", "docs", "top").repartition(self.buckets, "a", "b")  # no shuffle of its own if df lies so already
        # hashes don't get smaller by compression, and its buffers outside the heap would pile up over many small files
        with tidy(self.spark):
            dealt.write.format("parquet").option("compression", "uncompressed").bucketBy(self.buckets, "a", "b").sortBy("a", "b").option("path", f"{self.home}/{name}").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_scratch(self.spark, f"{self.home}/{name}")

    def _union(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for name in names[1:]:
            out = out.unionByName(self.spark.table(name))
        return out

    @staticmethod
    def _summed(df: DataFrame) -> DataFrame:
        return df.groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))

    def _record(self) -> None:
        write_text(self.spark, f"{self.home}/manifest.json", json.dumps({"kind": self.kind, "buckets": self.buckets, "levels": self.levels, "updates": self.updates, "batches": self.batches}))

    def add(self, rows: DataFrame, label: str | None = None) -> None:
        """rows: one (a, b, doc) per key and document of a new batch, whose documents no earlier batch had. label names the batch."""
        label = label or uuid.uuid4().hex
        if label in self.batches:
            return
        batch = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("top"))
        runs, gone = sum(self.levels, []), []
        if not self.levels:
            self.levels.append([])
        new = batch
        for run in runs:
            new = new.join(self.spark.table(run).select("a", "b"), ["a", "b"], "left_anti")
        own = self._write(new)
        if runs:  # what of the batch is not in its own run, some run has already
            self.updates.append(self._write(batch.join(self.spark.table(own).select("a", "b"), ["a", "b"], "left_anti")))
        self.levels[0].append(own)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if len(self.levels) == level + 1:
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._union(self.levels[level])))  # no key is in two runs
            gone += self.levels[level]
            self.levels[level] = []
            level += 1
        if len(self.updates) >= self.fanout:
            merged = self._write(self._summed(self._union(self.updates)))
            gone += self.updates
            self.updates = [merged]
        self.batches.append(label)
        self._record()
        self._drop(gone)

    def frequent(self, least_docs: int) -> DataFrame:
        """(a, b, top) of the keys found in at least so many documents."""
        held = self._union(sum(self.levels, []))
        if self.updates:
            more = self._summed(self._union(self.updates)).withColumnsRenamed({"docs": "more", "top": "later"})
            held = held.join(more, ["a", "b"], "left").select("a", "b", (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs"), F.greatest("top", "later").alias("top"))
        return held.where(F.col("docs") >= least_docs).select("a", "b", "top")


def key_rows(docs: DataFrame, key: str, text: str, least_chars: int, batches: int) -> DataFrame:
    """One row per document and key of enough code points, with the document's batch."""
    lines = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.explode(lines_of(F.col(text))).alias("line"))
    keys = lines.where(F.length("line") >= least_chars).select("doc", line_key(F.col("line")).alias("k")).where(F.length("k") >= least_chars)
    return keys.select("doc", key_hash(F.col("k")).alias("h")).groupBy("doc", "h.a", "h.b").agg(F.min(F.pmod(F.xxhash64("doc"), F.lit(batches))).alias("batch"))


def drops(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 40, least_docs: int = 5, batches: int = 3) -> DataFrame:
    """(doc, hashes): the line keys that each document loses."""
    spark = docs.sparkSession
    rows = saved(key_rows(docs, key, text, least_chars, batches), "line-keys")
    runs = LineRuns(spark, scratch_path(spark, "line-runs"), rows.schema["doc"].dataType.simpleString())
    for k in range(batches):
        runs.add(rows.where(F.col("batch") == k).select("a", "b", "doc"))
    # as a table of its own it has a known size, and a line that very many documents hold can be split as it is joined
    often = saved(runs.frequent(least_docs), "line-often")
    lost = rows.join(often, ["a", "b"]).where(F.col("doc") != F.col("top"))
    return lost.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("hashes"))


def _kept(docs: DataFrame, key: str, text: str, **how: int) -> DataFrame:
    """The columns of docs in a struct named row, beside lines and kept."""
    least = how.get("least_chars", 40)
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("doc"), lines_of(F.col(text)).alias("lines"))
    # rows without a key find nothing, and are dealt by their texts lest they meet in one task
    rows = rows.withColumns({"keyless": F.col("doc").isNull(), "at": F.coalesce(F.col("doc").cast("string"), F.xxhash64("lines").cast("string"))})
    gone = drops(docs, key, text, **how).select(F.col("doc").cast("string").alias("at"), F.lit(False).alias("keyless"), "hashes")
    met = rows.join(gone, ["at", "keyless"], "left")
    lost = lambda x: (F.length(x) >= least) & F.array_contains("hashes", key_hash(line_key(x)))
    return met.select("row", "doc", "lines", F.when(F.col("hashes").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~lost(x))).alias("kept"))


def line_report(docs: DataFrame, key: str = "doc_id", text: str = "text", **how: int) -> DataFrame:
    """Per document: key, n_lines, n_dropped, kept_sha256."""
    kept = _kept(docs.select(key, text), key, text, **how)
    return kept.select(
        F.col("doc").alias(key),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **how: int) -> DataFrame:
    """The same rows and columns, the repeated lines gone from text; a null text with nothing to lose stays null."""
    kept = _kept(docs, key, text, **how)
    joined = F.when(F.col(f"row.{text}").isNotNull(), F.array_join("kept", "\n"))
    return kept.select(*[joined.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
