"""Operator 5: documents whose sets of word shingles are alike, by prefix filtering under several global token orders.

Words are cut at ASCII white space after A-Z are lower-cased; a document's set holds its distinct shingles of WIDTH words, or
its whole word sequence if it is shorter. Two documents link if 100 * |x & y| >= 90 * |x | y|. Documents of one set are one
class from the start, and a class is compared once.

In any global order of tokens, two linked sets share a token among the first |x| - ceil(.9 |x|) + 1 of each. All orders
put common tokens last, by a count sketch of the corpus, and differ in how they break ties. Classes that share a prefix
token of the first order are candidates if so few tokens stand before it in both that the sets can still link: for the first token
that two sets share, i + j tokens before it are in one set alone, and linked sets have at most (|x| + |y|) * 10 / 190 such. So one of the two
sets holds that token in the first half of its prefix, and only such postings are joined with all others. Candidates
must also differ in few bits of a parity bitmap (whose Hamming distance never exceeds the sets'), have sizes
that allow a link, and share prefix tokens under the second and the third order. What passes all filters is verified on the whole sets.

A token of many classes isn't expanded into all pairs. A few of its sets, likely originals among them, are compared with the others first; then
links make components, and only pairs of different components are compared, which loses no component; large groups are compared in blocks.

Null and empty texts, or those of white space, have an empty set and link with nothing. Rows are known by their sets, not by their
keys: rows with a repeated or null key stay apart, and a component's id is its smallest key that isn't null. Very long texts only have large
sets. Ties at the threshold link. An empty table gives an empty result; extra columns, whatever their names, are ignored here.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import discard, saved, thrifty
from loomwright.llm.components import components

WIDTH, PERCENT = 3, 90
#: Counters of the corpus sketch: a power of two near COUNTERS for each row, within the bounds.
COUNTERS, LEAST_BITS, MOST_BITS = 8, 14, 24
SKETCH_BLOCK = 1 << 12
#: Up to so many documents with a prefix token, all pairs of them are candidates at once.
FEW = 16
#: Of a larger group, the sets that are compared with all others first: so many that share most of their prefixes, and as many others.
LEADS = 4
#: Postings of a block of a token's group.
BLOCK = 1000
REMEMBERED = 150_000
#: Numbers that are broadcast at most.
BROADCAST = 500_000
#: Bits of the filter by which documents to verify are picked out before their sets are built.
PICK_BITS = 1 << 23

_U = np.uint64
_SEEDS = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = value
        return value


def _mix(h: np.ndarray, seed: np.uint64) -> np.ndarray:
    h = (h ^ seed) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ h >> _U(29)) * _U(0x94D049BB133111EB)
    return h ^ h >> _U(32)


class Shingles:
    def __init__(self, width: int = WIDTH):
        self.width, self.hashes = width, _Hashes()

    def of(self, text: str) -> np.ndarray:
        """The sorted 64-bit hashes of the text's set."""
        words = np.fromiter(map(self.hashes.__getitem__, text.encode().lower().split()), dtype=_U)
        if not len(words):
            return words
        if len(words) < self.width:
            return np.array([xxhash.xxh3_64_intdigest(words.tobytes())], dtype=_U)
        n = len(words) - self.width + 1
        h = np.full(n, self.width, dtype=_U)
        for k in range(self.width):
            h = _mix(h * _U(0x9FB21C651E98DF25) + words[k : k + n], _SEEDS[0])
        return np.unique(h)


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    texts = batch.column("t")
    for k in range(batch.num_rows):
        yield k, texts[k].as_py() or ""


def _sets(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """Per row: doc, n, sid (of the set; null if empty); and rows with a block of the counts of shingles by hash."""

    def count(counts: np.ndarray, held: list[np.ndarray]) -> None:
        places, times = np.unique((np.concatenate(held) >> _U(64 - bits)).astype(np.uint32), return_counts=True)
        counts[places] += times.astype(np.uint32)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = Shingles(width), np.zeros(1 << bits, dtype=np.uint32)
        names = ["doc", "n", "sid", "block", "counts"]
        for batch in batches:
            ns, sids, held = [], [], []
            for _, t in _texts(batch):
                s = shingles.of(t)
                ns.append(len(s))
                sids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                held.append(s)
                if len(held) == 512:
                    count(counts, held)
                    held = []
            if held:
                count(counts, held)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(ns, pa.int64()), pa.array(sids, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        blocks = [k for k in range(0, 1 << bits, SKETCH_BLOCK) if counts[k : k + SKETCH_BLOCK].any()]
        # a task's counts are small numbers, which pack into a few bits each
        cut = [zlib.compress(counts[k : k + SKETCH_BLOCK].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for k in blocks]
        m = len(blocks)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array([k // SKETCH_BLOCK for k in blocks], pa.int32()), pa.array(cut, pa.binary())], names)

    return docs.mapInArrow(thrifty(work), "doc long, n long, sid binary, block int, counts binary")


def _levels(rows: DataFrame, bits: int) -> np.ndarray:
    """The sketch, summed: 0 for hashes whose count may be chance (the mean and four deviations), one more by each doubling of what is above the mean."""

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_BLOCK, dtype=np.uint64)
        for c in t.column("counts"):
            planes = np.frombuffer(zlib.decompress(c.as_py()), dtype=np.uint8).reshape(4, -1)
            total += np.ascontiguousarray(planes.T).view("<u4").ravel()
        return pa.table({"block": t.column("block").slice(0, 1), "total": pa.array([total.astype("<u8").tobytes()], pa.binary())})

    total = np.zeros(1 << bits, dtype=np.uint64)
    sums = rows.where(F.col("block").isNotNull()).select("block", "counts").groupBy("block").applyInArrow(add, "block int, total binary")
    for r in sums.toLocalIterator():
        total[r["block"] * SKETCH_BLOCK : (r["block"] + 1) * SKETCH_BLOCK] = np.frombuffer(bytes(r["total"]), dtype="<u8")
    mean = total.mean()
    excess = (total - mean) / max(4 * np.sqrt(mean), 1.0)
    return np.where(excess < 1, 0, np.floor(np.log2(np.maximum(excess, 1))) + 1).astype(np.uint8)


def _prefixes(docs: DataFrame, width: int, percent: int, bits: int, levels: np.ndarray) -> DataFrame:
    """Per set of a task's rows: rid (unique), p (the text's place in the pick filter), sid, n, parity bitmap, prefixes under three orders, the first in order."""
    known = docs.sparkSession.sparkContext.broadcast(levels)  # 2 ** bits bytes, at most 16 MB

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingles(width), set()
        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            out: list[tuple] = []
            places = batch.column("p")
            for k, t in _texts(batch):
                s = shingles.of(t)
                if not len(s) or (sid := xxhash.xxh3_128_digest(s.tobytes())) in seen:
                    continue
                seen.add(sid)
                size = prefix_size(len(s), percent)
                late = known.value[(s >> _U(64 - bits)).astype(np.int64)].astype(_U) << _U(56)
                firsts = []
                for seed in _SEEDS:
                    place = late | _mix(s, seed) >> _U(8)
                    some = np.argpartition(place, size - 1)[:size]
                    firsts.append(s[some[np.argsort(place[some])]] if not firsts else s[some])
                parity = np.bincount((_mix(s, _SEEDS[1]) & _U(511)).astype(np.int64), minlength=512) & 1
                bitmap = np.packbits(parity.astype(np.uint8)).view("<i8")
                out.append((at + len(seen), places[k].as_py(), sid, len(s), bitmap, firsts[0].view(np.int64), *((x & _U(0x7FFFFFFF)).astype(np.int32) for x in firsts[1:])))
                if len(out) == 2000:
                    yield pack(out)
                    out = []
            if out:
                yield pack(out)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], ["rid", "p", "sid", "n", "bits", "p1", "p2", "p3"])

    return docs.mapInArrow(thrifty(work), "rid long, p int, sid binary, n long, bits array<long>, p1 array<long>, p2 array<int>, p3 array<int>")


def _alike(a: str, b: str, percent: int) -> Column:
    """By bitmaps: a distance over (|x| + |y|) * (100 - percent) / (100 + percent) rules a link out."""
    apart = F.lit(0)
    for k in range(8):
        apart = apart + F.bit_count(F.col(f"{a}.bits")[k].bitwiseXOR(F.col(f"{b}.bits")[k]))
    return (100 + percent) * apart <= (100 - percent) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _small(numbers: DataFrame, most: int) -> DataFrame:
    """Numbers, at most so many as was counted, to be broadcast if that is within BROADCAST."""
    return F.broadcast(numbers) if most <= BROADCAST else numbers


def _candidates(left: DataFrame, right: DataFrame, on: list[str], percent: int, also: Column | None = None) -> DataFrame:
    """(x, y) of rids that share a posting, by sizes and what stands before it. Postings hold f: rid, n, pos, half, and perhaps bits."""
    n, m = F.col("x.n"), F.col("y.n")
    near = ((100 + percent) * (F.col("x.pos") + F.col("y.pos")) <= (100 - percent) * (n + m)) & (100 * F.least(n, m) >= percent * F.greatest(n, m))
    once = F.when(F.col("y.half"), F.col("x.rid") < F.col("y.rid")).otherwise(F.col("x.rid") != F.col("y.rid"))
    met = left.where("f.half").withColumnsRenamed({"f": "x", "root": "rx"}).join(right.withColumnsRenamed({"f": "y", "root": "ry"}), on)
    met = met.where(near & once if also is None else near & once & also)
    return met.select(F.least("x.rid", "y.rid").alias("x"), F.greatest("x.rid", "y.rid").alias("y"))


class _Join:
    def __init__(self, docs: DataFrame, prefixes: DataFrame, width: int, percent: int):
        self.docs, self.prefixes, self.width, self.percent = docs, prefixes, width, percent

    def _met(self, pairs: DataFrame, *facts: str) -> DataFrame:
        """pairs with structs x_ and y_ of these facts of their sets; prefixes that no pair names aren't shuffled if those named are few."""
        rids = pairs.select(F.col("x").alias("rid")).unionByName(pairs.select(F.col("y").alias("rid"))).distinct()
        own = self.prefixes.select("rid", F.struct(*facts).alias("f")).join(_small(rids, 2 * pairs.count()), "rid", "left_semi")
        side = lambda c: own.withColumnsRenamed({"rid": c, "f": f"{c}_"})
        return pairs.join(side("x"), "x").join(side("y"), "y")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """pairs: (x, y) of rids. Those that may link by the bitmaps and the other orders, as (x, y) of sids with px and py."""
        percent = self.percent
        pairs = saved(pairs.distinct(), "pairs")
        near = self._met(pairs, "n", "bits").where(_alike("x_", "y_", percent))
        near = saved(near.select("x", "y"), "pairs-alike")
        both = self._met(near, "sid", "p", "p2", "p3").where(F.arrays_overlap("x_.p2", "y_.p2") & F.arrays_overlap("x_.p3", "y_.p3"))
        left = saved(both.select(F.col("x_.sid").alias("x"), F.col("y_.sid").alias("y"), F.col("x_.p").alias("px"), F.col("y_.p").alias("py")), "pairs-left")
        discard(pairs, near)
        return left

    def links(self, left: DataFrame) -> DataFrame:
        """Of likely pairs, which go, those that link by their whole sets: (x, y) of sids."""
        spark, percent = self.docs.sparkSession, self.percent
        # the documents of these pairs, picked by a bitmap of fixed size over a hash of their texts
        wanted = left.select(F.col("px").alias("p")).unionByName(left.select(F.col("py").alias("p")))
        maps = wanted.groupBy(F.expr("bitmap_bucket_number(p + 1)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p + 1))").alias("m")).collect()
        if not maps:
            return left.select("x", "y")
        picked = np.zeros(PICK_BITS + 32768, dtype=np.uint8)
        for r in maps:
            got = np.unpackbits(np.frombuffer(bytes(r["m"]), dtype=np.uint8), bitorder="little")
            at = (r["k"] - 1) * len(got)
            picked[at : at + len(got)] = got
        # Spark numbers the buckets of values from 1 on by 1 and up
        chosen, width = spark.sparkContext.broadcast(np.packbits(picked)), self.width

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingles, which, seen = Shingles(width), np.unpackbits(chosen.value), set()
            for batch in batches:
                part = batch.take(pa.array(np.flatnonzero(which[batch.column("p").to_numpy()])))
                sids, held = [], []
                for _, t in _texts(part):
                    s = shingles.of(t)
                    if len(s) and (sid := xxhash.xxh3_128_digest(s.tobytes())) not in seen:
                        seen.add(sid)
                        sids.append(sid)
                        held.append(s.view(np.int64))
                if sids:
                    yield pa.RecordBatch.from_arrays([pa.array(sids, pa.binary()), pa.array(held, pa.list_(pa.int64()))], ["sid", "s"])

        need = left.select(F.col("x").alias("sid")).unionByName(left.select(F.col("y").alias("sid"))).distinct()
        whole_ = self.docs.select("t", "p").mapInArrow(thrifty(sets), "sid binary, s array<long>")
        whole = saved(whole_.join(need, "sid", "left_semi").dropDuplicates(["sid"]), "pair-sets")
        met = left.join(whole.select(F.col("sid").alias("x"), F.col("s").alias("sx")), "x").join(whole.select(F.col("sid").alias("y"), F.col("s").alias("sy")), "y")
        shared = F.size(F.array_intersect("sx", "sy"))
        links = saved(met.where(100 * shared >= percent * (F.size("sx") + F.size("sy") - shared)).select("x", "y"), "pair-links")
        del met, whole_, need
        discard(left, whole)
        return links


def near_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row: key, n_shingles, component_id (the smallest key reachable by links)."""
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("t"))
    rows = rows.withColumn("p", F.pmod(F.xxhash64("t"), F.lit(PICK_BITS)).cast("int"))
    bits = max(LEAST_BITS, min(MOST_BITS, int(np.ceil(np.log2(max(1, docs.count()) * COUNTERS)))))
    own = saved(_sets(rows, width, bits), "sets")
    levels = _levels(own, bits)
    sets = own.where(F.col("n").isNotNull())
    prefixes = saved(_prefixes(rows, width, percent, bits, levels), "prefixes")

    # one row of prefixes for each set: tasks that met the same set wrote one each
    first = prefixes.groupBy("sid").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("times")).where(F.col("times") > 1)
    again = saved(prefixes.select("sid", "rid").join(first, "sid").where(F.col("rid") != F.col("first")).select("rid"), "sets-again")

    # postings of the first order, of tokens that several sets have, one of them in the first half of its prefix, and of which two can link by size
    posts = prefixes.select("rid", F.col("n").cast("int").alias("n"), "p1").join(_small(again, again.count()), "rid", "left_anti").select("rid", "n", F.posexplode("p1").alias("pos", "token"))
    half = 2 * percent * F.col("pos") <= (100 - percent) * F.col("n")
    tokens = posts.groupBy("token").agg(F.count(F.lit(1)).alias("sets"), F.max(half).alias("half"), F.min("n").alias("least"), F.max("n").alias("most"))
    some = (F.col("sets") > 1) & F.col("half") & ((F.col("sets") > 2) | (100 * F.col("least") >= percent * F.col("most")))
    posts = saved(posts.join(tokens.where(some).select("token", "sets"), "token"), "postings")
    # the first order's prefixes, half of that table, have done their work
    facts = saved(prefixes.select("rid", "p", "sid", "n", "bits", "p2", "p3"), "prefix-facts")
    discard(prefixes, again)
    join = _Join(rows, facts, width, percent)
    fact = F.struct("rid", "n", "pos", half.alias("half")).alias("f")
    few = posts.where(F.col("sets") <= FEW).select("token", F.lit(0).alias("band"), fact)

    # tokens of many sets are cut by size: linked sets lie in one band or in neighbouring ones, and go to their own and the next.
    # a set's weight: how many of its prefix tokens others have; an original has more than copies with edits of their own
    often = posts.where(F.col("sets") > FEW)
    weights = posts.groupBy("rid").agg(F.count(F.lit(1)).alias("weight"))
    weights = weights.join(facts.select("rid", "bits"), "rid")
    band = F.floor(F.ln("n") / float(np.log(100 / percent) * (1 + 1e-9))).cast("int")
    on = ["token", "band"]
    cut = often.select("token", F.explode(F.array(band, band + 1)).alias("band"), "rid", "n", "pos", half.alias("half")).join(weights, "rid")
    cut = saved(cut.select(*on, "weight", F.struct("rid", "n", "pos", "half", "bits").alias("f")), "postings-cut")
    lot = lambda k: F.xxhash64(F.lit(k), "f.rid")
    heavy = [F.max_by("f.rid", F.struct("weight", lot(k))).alias(f"l{k}") for k in range(LEADS)]
    any_ = [F.max_by("f.rid", lot(k)).alias(f"l{k}") for k in range(LEADS, 2 * LEADS)]
    sizes = cut.groupBy(*on).agg(F.count(F.lit(1)).alias("sets"), *heavy, *any_).where(F.col("sets") > 1)
    sizes = saved(sizes.select(*on, "sets", F.array(*[f"l{k}" for k in range(2 * LEADS)]).alias("leads")), "cut-sizes")
    cuts = cut.join(sizes, on)
    few = few.unionByName(cuts.where(F.col("sets") <= FEW).select(*on, F.col("f").dropFields("bits").alias("f")))
    many = cuts.where(F.col("sets") > FEW)
    # a lead stands in for the first half of its own prefix, wherever it holds the token
    leads = many.where(F.array_contains("leads", F.col("f.rid"))).select(*on, F.col("f").withField("half", F.lit(True)).alias("f"))
    others = many.select(*on, F.col("f").withField("half", F.array_contains("leads", F.col("f.rid"))).alias("f"))
    alike = _alike("x", "y", percent)
    likely = join.likely(_candidates(few, few, on, percent).unionByName(_candidates(leads, others, on, percent, alike)))
    # from here on, only sets of large groups are asked for
    join.prefixes = saved(facts.join(cut.select("f.rid").distinct(), "rid", "left_semi"), "large-facts")
    discard(facts)
    links = join.links(likely)
    roots = saved(components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))), "roots")

    # cuts of many sets that still hold different components
    names = join.prefixes.select("rid", "sid").join(roots.withColumnRenamed("node", "sid"), "sid").select("rid", "root")
    placed = many.withColumn("rid", F.col("f.rid")).join(saved(names, "rid-roots"), "rid", "left").withColumn("root", F.coalesce("root", F.col("rid").cast("string").cast("binary")))
    placed = saved(placed.select(*on, "sets", "root", "f"), "placed")
    mark = F.xxhash64("root")
    mixed = placed.groupBy(*on).agg(F.min(mark).alias("a"), F.max(mark).alias("b")).where(F.col("a") != F.col("b")).select(*on)
    rest = placed.join(saved(mixed, "cuts-mixed"), on, "left_semi")
    discard(posts, cut)
    blocks = F.ceil(F.col("sets") / BLOCK).cast("int")
    right = rest.withColumn("block", F.pmod(F.xxhash64("f.rid"), blocks).cast("int")).drop("sets")
    left = rest.where("f.half").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("sets")
    more = join.links(join.likely(_candidates(left, right, [*on, "block"], percent, (F.col("rx") != F.col("ry")) & alike)))
    if not more.isEmpty():
        roots = saved(components(links.unionByName(more).select(F.col("x").alias("a"), F.col("y").alias("b"))), "roots")
    discard(placed, join.prefixes)

    classes = sets.where(F.col("sid").isNotNull()).groupBy("sid").agg(F.min("doc").alias("low"))
    named = saved(classes.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid")), "classes")
    lows = saved(named.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    named = saved(named.join(lows, "root").select("sid", "component_id"), "named")
    found = sets.where(F.col("sid").isNotNull()).join(named, "sid").select("doc", "n", "component_id")
    found = found.unionByName(sets.where(F.col("sid").isNull()).select("doc", "n", F.col("doc").alias("component_id")))
    kind = docs.schema[key].dataType
    return found.select(F.col("doc").cast(kind).alias(key), F.col("n").alias("n_shingles"), F.col("component_id").cast(kind).alias("component_id"))
