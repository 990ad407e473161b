"""Links from a stream and from a batch, replays, log lines cut in two, and progress read back."""

from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="module")
def searches():
    rng = random.Random(6)
    return [(k, f"s{rng.randrange(3)}", f"i{rng.randrange(6)}", 1_700_000_000 + k * 97 + rng.randrange(90)) for k in range(120)]


def as_events(df):
    from pyspark.sql import functions as F

    return df.select("event_id", "session", "item", F.timestamp_seconds("s").alias("ts"))


def weights(searches) -> dict:
    n: dict = {}
    for k, s, i, t in searches:
        for k2, s2, i2, t2 in searches:
            if s == s2 and i != i2 and t - 600 <= t2 <= t and (t2 < t or k2 < k):
                n[min(i, i2), max(i, i2)] = n.get((min(i, i2), max(i, i2)), 0) + 1
    return {p: (c, min(0.85, round(0.15 + 0.1 * (c - 1), 6))) for p, c in n.items()}


def read(table):
    return {(r["a"], r["b"]): (r["n"], r["weight"]) for r in table.read().collect()}


def test_stream_and_batch_agree_and_a_replay_changes_nothing(spark, tmp_path, searches):
    from loomwright.sources.versions import VersionedTable
    from loomwright.streaming.links import merge, pairs, run

    schema = "event_id long, session string, item string, s long"
    batch = VersionedTable(spark, f"file://{tmp_path}/batch", "link")
    found = pairs(as_events(spark.createDataFrame(searches, schema)))
    merge(batch, found, "all")
    merge(batch, found, "all")
    assert read(batch) == weights(searches) and batch.version() == 1

    table = VersionedTable(spark, f"file://{tmp_path}/stream", "link")
    folder = f"{tmp_path}/in"
    for half in (searches[:70], searches[70:]):
        spark.createDataFrame(half, schema).coalesce(1).write.mode("append").parquet(folder)
        q = run(as_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)), table, f"{tmp_path}/checkpoint")
        q.awaitTermination(60)
        assert q.exception() is None
    assert read(table) == weights(searches)
    before = table.version()
    name = table.manifest()["batches"][-1]
    merge(table, found, name)  # the batch comes once more, as after a lost driver
    assert table.version() == before and read(table) == weights(searches)


def test_lines_cut_across_files_come_out_whole(spark, tmp_path):
    from loomwright.streaming.progress import Progress, whole_lines

    text = "[2024-01-02 03:04:05] [INFO] one\n  more of it\n[2024-01-02 03:04:06] [ERROR] two ü\nlast"
    cuts = [text[:20], text[20:50], text[50:]]
    seen = Progress()
    spark.streams.addListener(seen)
    out = f"{tmp_path}/out"
    try:
        for k, part in enumerate(cuts):
            spark.createDataFrame([("a.log", k, part)], "file string, part long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            rows = whole_lines(spark.readStream.schema("file string, part long, text string").parquet(f"{tmp_path}/in"))
            q = rows.writeStream.queryName("tail").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).start()
            q.awaitTermination(60)
            assert q.exception() is None
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(seen)
    got = sorted((r["n"], r["line"], str(r["at"]), r["level"]) for r in spark.read.parquet(out).collect())
    first, second = "2024-01-02 03:04:05", "2024-01-02 03:04:06"
    assert got == [(1, "[2024-01-02 03:04:05] [INFO] one", first, "INFO"), (2, "  more of it", first, "INFO"), (3, "[2024-01-02 03:04:06] [ERROR] two ü", second, "ERROR")]
    assert seen.write(spark, f"{tmp_path}/progress") > 0 and seen.write(spark, f"{tmp_path}/progress") == 0
    rows = spark.read.parquet(f"{tmp_path}/progress").where("name = 'tail' AND state = 'progress'")
    assert rows.agg({"rows": "sum"}).first()[0] == 3
