"""Operator 4: near-duplicate vectors within a label, by spherical k-means cells and blocked cosine products.

Equal vectors of a label become one class with a count. Labels with many classes are cut into cells by spherical
k-means, fitted on a bounded sample; each class has a home cell and is a guest in every other cell that can hold a
vector within the angle: if x lies in cell c and y, in cell d, is at most r away, then x.(c - d) <= r |c - d|. So no link is lost: every
home meets all its links in its own cell. Cells are dealt in blocks by hash, and pairs of blocks are compared as one
matrix product in double precision. A pair of blocks returns each home's number of links and a spanning forest of its links,
never the pairs; forests are joined by connected components, and one vector of each component is kept, the smallest.

Null labels, and vectors that are null, empty, zero or hold nulls or non-finite numbers, link with nothing. Vectors of
different lengths don't link. Rows are told apart by themselves, not by their keys: repeated rows, and rows with a repeated or null
key, are vectors of their own, linked with their copies; a component's id is the smallest key in it, null if all are null. Very long
vectors only take longer. Links need a cosine of at least the threshold; ties at it link. An empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.common import saved
from loomwright.llm.components import components

#: Classes aimed at in a cell, and the most cells of all labels together, which bounds the broadcast; labels with most classes are
#: cut first. What isn't cut further is compared in more blocks, and no link is lost.
CELL, CELLS = 1000, 4096
#: Classes to fit a cell's centre on.
FIT = 40
#: Classes of a block, about, and rows that are compared with all centres at once.
BLOCK, ROWS = 2048, 1024


def centres(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Spherical k-means: unit centres, started from rows far from each other."""
    rng = np.random.default_rng(seed)
    c = x[[int(rng.integers(len(x)))]]
    far = 1 - x @ c[0]
    while len(c) < k:
        p = np.maximum(far, 0)
        pick = rng.choice(len(x), p=p / p.sum()) if p.sum() > 0 else int(rng.integers(len(x)))
        c = np.vstack([c, x[pick]])
        far = np.minimum(far, 1 - x @ c[-1])
    for _ in range(rounds):
        own = np.concatenate([(x[at : at + ROWS] @ c.T).argmax(axis=1) for at in range(0, len(x), ROWS)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 0, sums / np.maximum(norms, 1e-300), c)
    return c


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of unit vectors in double precision; all are of one length."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of very small or large components would be 0 or infinite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index of each of n nodes under links a-b."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def placed_in(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit rows and unit centres: (row, cell, whether it is the row's home) for each cell that can hold a vector within reach."""
    out = []
    for at in range(0, len(x), ROWS):
        sims = x[at : at + ROWS] @ c.T
        rows, own = np.arange(len(sims)), sims.argmax(axis=1)
        gaps = np.sqrt(np.maximum(0.0, 2 - 2 * (c[own] @ c.T)))
        can = sims[rows, own][:, None] - sims <= reach * gaps + 1e-6
        can[rows, own] = True
        pick, cell = np.nonzero(can)
        out.append((pick + at, cell, own[pick] == cell))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def classes_of(vectors: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, c) with the class, null if nothing can link; and classes (c, low, copies, label, dims, x), low the smallest key."""
    x = F.col("x")
    fine = F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    # 128 bits of hash as hexadecimal text, equal for equal labels and vectors
    c = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), "label", "x")), 16, "0") for k in (0, 1)])
    rows = rows.withColumn("c", F.when(F.col("fine"), c))
    classes = rows.where("fine").groupBy("c").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("x").alias("x"))
    return rows.select("id", "c"), classes.withColumn("dims", F.size("x"))


def near_vectors(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per vector: key, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows, classes = classes_of(vectors, key, vector, label)
    classes = saved(classes, "vector-classes")
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    # cells of the labels that are large; at most CELLS labels have more than CELL classes of which a cell can be theirs
    large = classes.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL).orderBy(F.desc("n"), "label", "dims").limit(CELLS // 2).collect()
    total = sum(r["n"] for r in large)
    counts = {(r["label"], r["dims"]): max(2, min(-(-r["n"] // CELL), CELLS * r["n"] // total)) for r in large}
    cells: dict[tuple, np.ndarray] = {}
    if large:
        share = spark.createDataFrame([(*of, min(1.0, FIT * counts[of] / n)) for of, n in (((r["label"], r["dims"]), r["n"]) for r in large)], T.StructType([T.StructField("l", classes.schema["label"].dataType), T.StructField("d", T.IntegerType()), T.StructField("share", T.DoubleType())]))
        place = F.pmod(F.xxhash64("c"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        some = classes.join(F.broadcast(share), (F.col("label") == F.col("l")) & (F.col("dims") == F.col("d"))).where(place < F.col("share"))  # share: at most CELLS / 2 rows
        sample: dict[tuple, list] = {}
        for r in some.orderBy("c").select("label", "dims", "x").collect():  # about FIT * CELLS vectors at most
            sample.setdefault((r["label"], r["dims"]), []).append(r["x"])
        for of, xs in sample.items():
            cells[of] = centres(matrix(pa.array(xs)), min(counts[of], len(xs)))
    known = spark.sparkContext.broadcast(cells)  # about CELLS centres at most

    def place_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = list(zip(batch.column("label").to_pylist(), batch.column("dims").to_pylist(), strict=True))
            rows_of: dict[tuple, list[int]] = {}
            for k, which in enumerate(of):
                rows_of.setdefault(which, []).append(k)
            for which, at in rows_of.items():
                part = batch.take(pa.array(at))
                c = known.value.get(which)
                if c is None:
                    pick, cell, home = np.arange(len(at)), np.zeros(len(at), dtype=np.int64), np.ones(len(at), dtype=bool)
                else:
                    pick, cell, home = placed_in(matrix(part.column("x")), c, reach)
                out = part.take(pa.array(pick))
                yield pa.RecordBatch.from_arrays([out.column("label"), out.column("dims"), pa.array(cell, pa.int32()), pa.array(home), out.column("c"), out.column("copies"), out.column("x")], ["label", "dims", "cell", "home", "c", "copies", "x"])

    placed = classes.select("label", "dims", "c", "copies", "x").mapInArrow(place_all, f"label {classes.schema['label'].dataType.simpleString()}, dims int, cell int, home boolean, c string, copies long, x array<double>")
    placed = saved(placed, "vector-cells")
    sizes = placed.groupBy("label", "dims", "cell").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias("blocks"))
    dealt = placed.join(sizes, ["label", "dims", "cell"]).withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        cs = t.column("c").combine_chunks()
        empty = pa.table({"c": cs.slice(0, 0), "links": pa.array([], pa.int64()), "root": cs.slice(0, 0)})
        x = matrix(t.column("x").combine_chunks())
        home, copies, block = (t.column(c).to_numpy() for c in ("home", "copies", "block"))
        within = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        links, lefts, rights = np.zeros(len(x), dtype=np.int64), [], []
        if not home.any():
            return empty
        for at in range(0, len(x), 512):
            some = np.arange(at, min(at + 512, len(x)))
            some = some[home[some]]
            near = x[some] @ x.T >= threshold
            near[np.arange(len(some)), some] = False
            if not within:
                near &= block[some][:, None] != block[None]
            links[some] = near @ copies
            a, b = np.nonzero(near)
            lefts.append(some[a])
            rights.append(b)
        a, b = np.concatenate(lefts), np.concatenate(rights)
        if not len(a):
            return empty
        root = forest(a, b, len(x))
        out = np.flatnonzero((links > 0) | (root != np.arange(len(x))))
        return pa.table({"c": cs.take(pa.array(out)), "links": pa.array(links[out]), "root": cs.take(pa.array(root[out]))})

    keys = ["label", "dims", "cell", "i", "j"]
    found = units.select(*keys, "block", "home", "c", "copies", "x").groupBy(*keys).applyInArrow(compare, "c string, links long, root string")
    found = saved(found, "vector-links")
    counted = found.groupBy("c").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    named = classes.select("c", "low", "copies").join(counted, "c", "left").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    named = saved(named, "vector-named")
    lows = named.groupBy("root").agg(F.min("low").alias("component"))
    met = rows.join(named.join(lows, "root").select("c", "copies", "links", "component"), "c", "left")
    component = F.when(F.col("copies").isNull(), F.col("id")).otherwise(F.col("component"))
    return met.select(
        F.col("id").alias(key),
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
