"""Operator 9: document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A text's terms are its words (cut at ASCII white space, case kept) and a term's weight is its count; a text without
words has the empty word as its one term. For each of SAMPLES samples, a term's hash gives r and c, gamma distributed
with shape 2 and scale 1, and beta, uniform in [0, 1). With t = floor(ln(weight) / r + beta), the sample is the
term, with its t, of the smallest a = c / exp(r * (t - beta + 1)). Two texts agree on a sample with a chance that equals the generalised
Jaccard similarity of their weights, sum of minima over sum of maxima, so the share of equal samples is an unbiased estimate.

A gamma of shape 2 is minus the logarithm of a product of two uniforms, and a gamma r with an independent uniform beta is
the same as two exponentials, r = x + y with beta = y / r, x = -ln(u), y = -ln(v). So exp(r * (1 - beta)) is 1 / u, a = c * u * (u * v) ** t,
and a term of weight 1, whose t is 0, needs one logarithm, that of c.

Null texts count as empty. Documents are in order of descending key, null keys last, equal keys by their texts' hashes; the
next of the last is the first, and the next of a single document itself. Repeated rows stay apart; what ties in the order is alike.
Very long texts are terms like others, worked on row by row. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import BLANKS

SAMPLES = 64
#: Documents aimed at in a range of keys, and the most cuts between ranges that a plan holds; beyond that ranges hold more.
RANGE_ROWS, CUTS = 1000, 20_000
#: Of a sample's identity in a fingerprint.
ID_BITS = 16
#: Samples drawn in one operator.
GROUP = 8


def _uniform(h: Column, at: int, bits: int) -> Column:
    return (F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(0.5)) * F.lit(0.5**bits)


def _sample(term: Column, times: Column, k: Column) -> Column:
    """A term's draw: its value in the high bits, what identifies it in the low ones; the least of all terms is the sample."""
    h = F.xxhash64(term, k)
    u, v = _uniform(h, 0, 20), _uniform(h, 20, 16)
    c = -F.ln(_uniform(h, 36, 14) * _uniform(h, 50, 14))
    t = F.floor((F.ln(times) - F.ln(v)) / -F.ln(u * v))
    more = times > 1
    value = F.floor(c * u * F.when(more, F.pow(u * v, t)).otherwise(1.0) * F.lit(float(1 << 42)))  # c is under 32
    # where t is 0, v has no part in the value, and its bits tell terms apart
    mark = F.when(more & (t > 0), F.xxhash64(h, t)).otherwise(F.shiftrightunsigned(h, 20)).bitwiseAND(F.lit((1 << ID_BITS) - 1).cast("long"))
    return F.shiftleft(value, ID_BITS).bitwiseOR(mark)


def fingerprints(texts: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """texts: rows identified by keys. Per row: keys and print, an array of `samples` small integers.

    Rows that lie together by (some of) the keys are worked on where they are, without a shuffle.
    """
    terms = texts.select(*keys, F.explode(F.split(F.btrim(F.col(text), F.lit(BLANKS)), r"[\x20\x09-\x0D]+")).alias("word"))
    counted = terms.groupBy(*keys, F.xxhash64("word").alias("term")).agg(F.count(F.lit(1)).alias("times"))
    # a term is worked on once for each group of samples: more samples in one operator would outgrow what the JVM compiles
    spread = counted.select(*keys, "term", F.col("times").cast("double").alias("times"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1), F.lit(GROUP))).alias("at"))
    drawn = spread.groupBy(*keys, "at").agg(*[F.min(_sample(F.col("term"), F.col("times"), F.col("at") + j)).alias(f"s{j}") for j in range(GROUP)])
    low = F.lit((1 << ID_BITS) - 1).cast("long")
    part = F.struct("at", F.array(*[F.col(f"s{j}").bitwiseAND(low).cast("int") for j in range(GROUP)]).alias("ids"))
    gathered = drawn.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return gathered.select(*keys, F.slice(F.flatten("parts.ids"), 1, samples).alias("print"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two prints."""
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda v: v)
    return F.size(same) / F.lit(float(samples))


def as_text(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda x: F.lpad(F.hex(x), ID_BITS // 4, "0")), "")


def _below(cuts: str, fits: Callable[[Column], Column]) -> Column:
    """How many of the ascending cuts fit, which the first do and the others don't: found by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(CUTS.bit_length()))])
    take = lambda at, step: F.when((at + step <= F.size(cuts)) & F.coalesce(fits(F.get(cuts, at + step - 1)), F.lit(False)), at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0), take)


def edited_prints(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Ranges of the order, cut at approximate quantiles of the keys, are the unit of work: texts are shuffled once, by range. A key that
    several quantiles name, or null, holds many rows and is cut further by the texts' hashes. The first
    document of each range goes to the range before it as well, so each range can see every next document.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc").isNull()).alias("nulls")).first()
    cuts = max(0, min(CUTS, (n["n"] - n["nulls"]) // RANGE_ROWS))
    found = rows.agg(F.percentile_approx("doc", [k / (cuts + 1) for k in range(1, cuts + 1)], 10 * (cuts + 1)).alias("cuts")).first()["cuts"] if cuts else []
    known = spark.createDataFrame([(list(found or []),)], "cuts array<bigint>")  # one row of CUTS keys at most
    rows = rows.join(F.broadcast(known)).select("doc", "text", "h", _below("cuts", lambda x: x < F.col("doc")).alias("low"), _below("cuts", lambda x: x <= F.col("doc")).alias("high"))
    # a range's number is that of the cuts above a row; a key equal to m cuts is spread over m ranges, null keys over ranges of their own
    part = lambda m: F.floor((F.shiftright("h", 11) + F.lit(1 << 52)).cast("double") * F.lit(0.5**53) * m).cast("int")
    above, equal = F.lit(len(found or [])) - F.col("high"), F.col("high") - F.col("low")
    of_null = F.lit(cuts + 1) + part(F.lit(float(max(1, min(CUTS, n["nulls"] // RANGE_ROWS)))))
    bucket = F.when(F.col("doc").isNull(), of_null).when(equal == 0, above).otherwise(above + 1 + part(equal.cast("double")))
    placed = rows.select("doc", "text", "h", bucket.cast("int").alias("bucket")).withColumn("order", F.struct(F.col("doc").isNull().alias("none"), F.bitwise_not("doc").alias("doc"), "h"))
    tops = sorted((r["bucket"], tuple(r["top"])) for r in placed.groupBy("bucket").agg(F.min("order").alias("top")).collect())  # one small row a range
    # a range's first document is also at the end of the range before it, the very first at the end of all
    sent = [(*top, tops[k - 1][0]) for k, (_, top) in enumerate(tops)]
    also = spark.createDataFrame(sent, "none boolean, not long, hash long, also int")
    first = (F.col("order.none") == F.col("none")) & F.col("order.doc").eqNullSafe(F.col("not")) & (F.col("h") == F.col("hash"))
    met = placed.join(F.broadcast(also), first, "left")  # at most CUTS rows for keys and as many for null
    own, guest = F.struct(F.col("bucket").alias("range"), F.lit(0).alias("guest")), F.struct(F.col("also").alias("range"), F.lit(1).alias("guest"))
    spread = met.select("doc", "h", "text", F.explode(F.when(F.col("also").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("at"))
    dealt = spread.select("at.range", "at.guest", "doc", "h", "text").repartition("range")

    order = Window.partitionBy("range").orderBy("guest", F.col("doc").desc_nulls_last(), "h", "text")
    placed = dealt.select("range", "guest", "doc", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    placed = placed.select("range", "guest", "doc", "place", "text", edited.alias("edited"))

    kind = lambda k, c: F.struct(F.lit(k).alias("kind"), F.col(c).alias("text"))
    both = placed.select("range", "guest", "place", F.explode(F.when(F.col("guest") == 1, F.array(kind(0, "text"))).otherwise(F.array(kind(0, "text"), kind(1, "edited")))).alias("v"))
    both = both.select("range", "place", "v.kind", "v.text")
    prints = fingerprints(both, ["range", "place", "kind"], "text", samples)
    one = lambda k: F.max(F.when(F.col("kind") == k, F.col("print")))
    prints = prints.groupBy("range", "place").agg(one(0).alias("own"), one(1).alias("edited"))
    prints = prints.withColumn("next", F.lead("own").over(Window.partitionBy("range").orderBy("place"))).where(F.col("edited").isNotNull())

    facts = placed.where(F.col("guest") == 0).select("range", "place", "doc", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    found = facts.join(prints, ["range", "place"])
    return found.select(
        F.col("doc").cast(docs.schema[key].dataType).alias(key),
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited"), samples).alias("near_edited"),
        likeness(F.col("own"), F.col("next"), samples).alias("near_next"),
    )
