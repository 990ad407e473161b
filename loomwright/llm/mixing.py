"""Operator 10: mixing sources to target weights by capped water-filling.

Sources in code point order, null last, take the given weights in turn and share a budget of words. No target exceeds
EPOCHS times its source's size; what is above goes to the others by weight until none is above, which is one water
level: target = min(cap, weight * level). Documents are then taken in a seeded order: all of them as often as the
target holds the source whole, and once more from the front of the order as far as the rest goes. What is missing then is less than
one document. Of the documents behind that cut, the first OFFERS of each size class (powers of two) of their source are offered, larger
classes first, and taken where they still fit; last the smallest of those left over is taken if that brings the sum nearer.

The order is the seeded hash of the key, then the hash of the text; a row's lot depends on these two and on one small row of
its source, so no text is shuffled and no window sees more of a source than one of its 4096 parts.

A null text has size 0 and is taken as often as its place says, with 0 words; very long texts only have large sizes. Null
sources are one source, null keys one key. Rows with a repeated key but different texts stay apart; rows alike in key, source
and text are taken together, equally often. No row is taken more than EPOCHS times. A seed and a table give the same result on
every run. An empty table gives an empty result; extra columns, whatever their names, are kept by mix and ignored by mix_report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import saved

WEIGHTS, SHARE, EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix-1"
#: Documents of each size class of a source that are offered to fill what its cut leaves missing.
OFFERS = 64


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """sizes: source, source_size. Adds target. One row per source is all that meets in one task."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.array(*[F.lit(float(w)) for w in weights])[(F.row_number().over(order) - 1) % len(weights)]
    s = sizes.withColumn("weight", turn).withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    # the level if the sources before this one, in order of cap / weight, are full: the true level is the highest
    s = s.withColumn("level", (budget - (F.sum("cap").over(before) - F.col("cap"))) / F.sum("weight").over(after))
    return s.select("source", "source_size", F.least("cap", F.col("weight") * F.max("level").over(everything)).alias("target"))


def _order(key: Column, text: Column, seed: str) -> tuple[Column, Column]:
    """A row's place in the order of its source: u, then h."""
    return F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")).cast("binary")), F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _cuts(plain: DataFrame) -> DataFrame:
    """Per source (of): source_size, target, whole, rest, gap, and the last row (cut_u, cut_h) of those taken once more, null if there is none."""
    part = F.substring("u", 1, 3)
    sums = saved(plain.groupBy("source", part.alias("part")).agg(F.sum("size").alias("words")), "mix-parts")
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "of")
    # the part in which the rest ends: sums of whole parts come before it
    at = sums.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("part")) - F.col("words"))
    at = at.join(goal.select("of", "rest"), F.col("source").eqNullSafe(F.col("of"))).where((F.col("rest") > 0) & (F.col("before") <= F.col("rest")))
    at = at.groupBy("of").agg(F.max_by(F.struct("part", "before"), "part").alias("edge")).select(F.col("of").alias("e"), "edge.*")
    goal = saved(goal.join(at, F.col("of").eqNullSafe(F.col("e")), "left").drop("e"), "mix-targets")  # one row a source

    met = plain.join(goal.where("part IS NOT NULL"), F.col("source").eqNullSafe(F.col("of")) & (F.substring("u", 1, 3) == F.col("part")))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("of").orderBy("u", "h"))  # rows alike are peers
    last = met.withColumn("upto", upto).where(F.col("upto") <= F.col("rest")).groupBy("of").agg(F.max(F.struct("u", "h", "upto")).alias("last"))
    goal = goal.join(last.withColumnRenamed("of", "e"), F.col("of").eqNullSafe(F.col("e")), "left").drop("e")
    # a part none of whose rows fits is cut before its first row
    cut_u = F.when(F.col("last").isNotNull(), F.col("last.u")).otherwise(F.when(F.col("part") > "000", F.col("part")))
    cut_h = F.when(F.col("last").isNotNull(), F.col("last.h")).otherwise(F.when(F.col("part") > "000", F.lit(-(2**63))))
    gap = F.when(F.col("part").isNull(), F.lit(0.0)).otherwise(F.col("rest") - F.coalesce("last.upto", "before"))
    return goal.select("of", "source_size", "target", "whole", cut_u.alias("cut_u"), cut_h.alias("cut_h"), gap.alias("gap"))


def _behind() -> Column:
    """Whether a row comes behind its source's cut."""
    return F.col("cut_u").isNull() | (F.col("u") > F.col("cut_u")) | ((F.col("u") == F.col("cut_u")) & (F.col("h") > F.col("cut_h")))


def _fills(plain: DataFrame, cuts: DataFrame) -> DataFrame:
    """Per source (f): the rows (u, h) that fill its gap, at most OFFERS for each size class."""
    free = plain.where("size > 0").join(cuts.where("gap > 0"), F.col("source").eqNullSafe(F.col("of"))).where(_behind() & (F.col("size") < 2 * F.col("gap")))
    alike = free.groupBy("of", "gap", "u", "h").agg(F.sum("size").alias("size")).where(F.col("size") < 2 * F.col("gap"))
    kind = F.length(F.bin("size"))
    place = F.row_number().over(Window.partitionBy("of", "kind").orderBy("u", "h"))
    some = alike.withColumn("kind", kind).withColumn("place", place).where(F.col("place") <= OFFERS)
    offer = F.struct((-F.col("kind")).alias("kind"), "u", "h", "size")
    lists = some.groupBy("of").agg(F.max("gap").alias("gap"), F.array_sort(F.collect_list(offer)).alias("offers"))  # a few for each size class
    start = F.struct(F.col("gap").alias("gap"), F.array().cast("array<struct<kind:int,u:string,h:bigint,size:bigint>>").alias("got"))
    step = lambda s, x: F.when(x["size"] <= s["gap"], F.struct((s["gap"] - x["size"]).alias("gap"), F.array_append(s["got"], x).alias("got"))).otherwise(s)
    filled = lists.withColumn("s", F.aggregate("offers", start, step))
    by_size = lambda x: F.struct(x["size"].alias("size"), x["u"].alias("u"), x["h"].alias("h"))
    over = F.array_min(F.transform(F.filter(F.array_except("offers", "s.got"), lambda x: x["size"] < 2 * F.col("s.gap")), by_size))
    place_of = lambda x: F.struct(x["u"].alias("u"), x["h"].alias("h"))
    got = F.transform("s.got", place_of)
    return filled.select(F.col("of").alias("f"), F.when(over.isNull(), got).otherwise(F.array_append(got, place_of(over))).alias("extra"))


def mix_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """The rows' key, source, size and place in the order (doc, source, size, u, h); and per source (of) what decides on its rows."""
    u, h = _order(F.col(key), F.col(text), seed)
    plain = saved(docs.select(F.col(key).alias("doc"), F.col(source).alias("source"), words(F.col(text)).alias("size"), u.alias("u"), h.alias("h")), "mix-sizes")
    cuts = saved(_cuts(plain), "mix-cuts")
    fills = _fills(plain, cuts)
    return plain, saved(cuts.join(fills, F.col("of").eqNullSafe(F.col("f")), "left").drop("f", "gap"), "mix-lots")


def _times() -> Column:
    extra = F.exists(F.coalesce("extra", F.array().cast("array<struct<u:string,h:bigint>>")), lambda x: (x["u"] == F.col("u")) & (x["h"] == F.col("h")))
    once_more = (F.col("cut_u").isNotNull() & ~_behind()) | extra
    return F.least(F.col("whole") + once_more.cast("long"), F.lit(EPOCHS).cast("long"))


def mix_report(docs: DataFrame, **how: str) -> DataFrame:
    """Per document: key, size, source_size, target, taken."""
    plain, lots = mix_plan(docs, **how)
    met = plain.join(lots, F.col("source").eqNullSafe(F.col("of")))
    return met.select(F.col("doc").alias(how.get("key", "doc_id")), "size", "source_size", "target", (F.col("size") * _times()).alias("taken"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    _, lots = mix_plan(docs, key, text, source, seed)
    u, h = _order(F.col(key), F.col(text), seed)
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), u.alias("u"), h.alias("h"))
    met = rows.join(lots, F.col("source").eqNullSafe(F.col("of"))).select("row", _times().alias("t"))
    again = met.where(F.col("t") > 0).withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "t")))
    return again.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
