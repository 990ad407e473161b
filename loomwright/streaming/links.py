"""Searches that follow one another, as links with weights: a stream joined with itself, merged into a versioned table so that a batch counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwright.sources.versions import Conflict, VersionedTable

#: A link's first weight, what each time more adds, and the most; and how far apart two searches may lie, in seconds.
FIRST, MORE, MOST, WITHIN_S = 0.15, 0.1, 0.85, 600


def pairs(events: DataFrame, within_s: int = WITHIN_S, late: str | None = None) -> DataFrame:
    """events: event_id, session, item, ts (a timestamp). Per pair of searches of a session for different items, at most within_s apart: a < b, the items.

    late: of a stream, how late events may come; both sides of the join then forget what no later event can meet.
    """
    side = lambda p: events.select(F.col("session").alias(f"{p}_session"), F.col("event_id").alias(f"{p}_id"), F.col("item").alias(f"{p}_item"), F.col("ts").alias(f"{p}_ts"))
    x, y = side("x"), side("y")
    if late:
        x, y = x.withWatermark("x_ts", late), y.withWatermark("y_ts", late)
    # of slots as long as the gap, a search meets the earlier ones of its own slot and of the one before, so a session of any length is no one group
    slot = lambda p: F.floor(F.unix_seconds(f"{p}_ts") / max(int(within_s), 1))
    x = x.withColumn("x_slot", slot("x"))
    y = y.withColumn("y_slot", F.explode(F.array(slot("y"), slot("y") + 1)))
    gap = F.expr(f"INTERVAL {int(within_s)} SECONDS")
    met = (F.col("x_session") == F.col("y_session")) & (F.col("x_slot") == F.col("y_slot")) & (F.col("y_ts") >= F.col("x_ts") - gap) & (F.col("y_ts") <= F.col("x_ts")) & ((F.col("y_ts") < F.col("x_ts")) | (F.col("y_id") < F.col("x_id"))) & (F.col("x_item") != F.col("y_item"))
    return x.join(y, met).select(F.least("x_item", "y_item").alias("a"), F.greatest("x_item", "y_item").alias("b"))


def weight(n: F.Column) -> F.Column:
    return F.least(F.lit(MOST), F.round(FIRST + MORE * (n - 1), 6))


def merge(table: VersionedTable, found: DataFrame, batch: str, tries: int = 10) -> int:
    """Adds found pairs (a, b, or a, b, n if counted) to the table of links (link, a, b, n, weight). A batch that the table records already changes nothing.

    The sums build on one generation; if another writer was first, they are worked out again from the next one.
    """
    times = F.sum("n") if "n" in found.columns else F.count(F.lit(1))
    fresh = found.groupBy("a", "b").agg(times.alias("n")).withColumn("link", F.concat_ws("|", "a", "b"))
    for _ in range(tries):
        held = table.manifest()
        if batch in held["batches"]:
            return held["number"]
        new = fresh
        if held["number"]:
            old = table.read(held["number"]).select("link", F.col("n").alias("was"))
            new = fresh.join(old, "link", "left").withColumn("n", F.col("n") + F.coalesce("was", F.lit(0)))
        part = table.stage(new.select("link", "a", "b", "n", weight(F.col("n")).alias("weight")))
        try:
            return table.activate(part, held["number"], batch=batch)
        except Conflict:
            continue
    raise Conflict(f"{tries} other generations came first")


def run(events: DataFrame, table: VersionedTable, checkpoint: str, name: str = "links", late: str = "1 hour", within_s: int = WITHIN_S) -> StreamingQuery:
    """Starts the stream on all that is there now; begun again with the same checkpoint it goes on where it ended."""
    writer = pairs(events, within_s, late).writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    return writer.foreachBatch(lambda found, k: merge(table, found, f"{name}-{k}") and None).start()
