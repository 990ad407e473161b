"""Operator 13: embedding whitening by hierarchical merging of singular value decompositions.

An entry c becomes the integer x = floor(64 c) + 1000000. The fit list holds each distinct x vector once. Each partition
of it keeps a summary per vector length: rows n, sums, mean, and a factor, the singular values times the right singular vectors of its
centred rows, of full rank, so that factor' factor is the rows' centred scatter. Two summaries merge by stacking their
factors and one row more, sqrt(n1 n2 / (n1 + n2)) (mean1 - mean2), which says how the means differ, and decomposing
again; nothing is cut off, so a merge loses nothing but rounding. Blocks of rows merge so within a task, FAN
partitions' summaries within a group, round after round, each written to the shared folder, until one is left. What reaches the driver is the
model alone: sums and COMPONENTS vectors per vector length. Since 1000000 takes no part in any difference, it is left out until the end.

The covariance of the whitened fit list, which identity_error compares with the identity, is summed up and merged in the same way.

Rows with a null vector, or with null or non-finite entries, are dropped; so are those with an entry whose x no long can hold (2 ** 55
and more), which counts as non-finite. Vectors of different lengths are whitened apart, each length by its own model. Repeated rows are
in the fit list once and are returned each; null and repeated keys are keys like others. Where a component has no variance (fewer distinct
vectors than components, constant entries), whitened is null and explained 0, or null if there is no variance at all; identity_error is of the others,
null if there are none. Components with equal eigenvalues are some orthonormal basis, the same for all rows. A deviation over 64 bits
is null. Vectors shorter than COMPONENTS have as many components as entries, empty ones no row. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import saved

COMPONENTS = 16
#: Of the contract's integers: entries a unit, and what is added.
SCALE, SHIFT = 64, 1_000_000
#: Rows decomposed at once, and summaries merged in a group.
ROWS, FAN = 4096, 8
#: A component whose singular value is under this share of the first has no variance.
NO_VARIANCE = 1e-10
LARGEST = float(2**55)

SUMMARY = "dims int, n long, sums array<decimal(38,0)>, mean array<double>, factor binary"


@dataclass
class Summary:
    n: int
    sums: list[int] | None  # exact, of integers alone
    mean: np.ndarray
    factor: np.ndarray


def factor_of(rows: np.ndarray) -> np.ndarray:
    """Singular values times right singular vectors of centred rows; as many rows as the rank can have."""
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def of_block(x: np.ndarray) -> Summary:
    """The summary of some rows of integers or doubles."""
    sums = None
    if x.dtype.kind in "iO":
        safe = x.dtype.kind == "i" and np.abs(x).max(initial=0) < 2**62 // max(len(x), 1)
        sums = [int(v) for v in (x if safe else x.astype(object)).sum(axis=0)]
        mean = np.array([s / len(x) for s in sums])
    else:
        mean = x.mean(axis=0)
    return Summary(len(x), sums, mean, factor_of(x.astype(np.float64) - mean))


def merged(a: Summary, b: Summary) -> Summary:
    n = a.n + b.n
    sums = None if a.sums is None else [p + q for p, q in zip(a.sums, b.sums, strict=True)]
    mean = a.mean + (b.mean - a.mean) * (b.n / n) if sums is None else np.array([s / n for s in sums])
    correction = np.sqrt(a.n * (b.n / n)) * (a.mean - b.mean)
    return Summary(n, sums, mean, factor_of(np.vstack([a.factor, b.factor, correction[None]])))


def _batch(found: dict[int, Summary]) -> pa.RecordBatch:
    sums = [None if s.sums is None else [Decimal(v) for v in s.sums] for s in found.values()]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(found), pa.int32()), pa.array([s.n for s in found.values()], pa.int64()), pa.array(sums, pa.list_(pa.decimal128(38, 0))),
            pa.array([s.mean.tolist() for s in found.values()], pa.list_(pa.float64())), pa.array([s.factor.tobytes() for s in found.values()], pa.binary()),
        ],
        ["dims", "n", "sums", "mean", "factor"],
    )


def _read(t: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, Summary]]:
    for r in t.to_pylist():
        yield r["dims"], Summary(r["n"], None if r["sums"] is None else [int(v) for v in r["sums"]], np.array(r["mean"]), np.frombuffer(r["factor"]).reshape(-1, len(r["mean"])))


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each vector length (dims) over 0: it, the places of its rows, and their x as a matrix."""
    dims = batch.column("dims").to_numpy(zero_copy_only=False)
    for d in np.unique(dims[dims > 0]):
        at = np.flatnonzero(dims == d)
        yield int(d), at, batch.column("x").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)


def summed(vectors: DataFrame, label: str) -> DataFrame:
    """vectors: dims, x. One summary per dims, over all its rows; x are arrays of one kind of number, alike long where dims is alike."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Summary] = {}
        for batch in batches:
            for d, _, x in by_length(batch):
                for at in range(0, len(x), ROWS):
                    own = of_block(x[at : at + ROWS])
                    found[d] = merged(found[d], own) if d in found else own
        yield _batch(found)

    def join(t: pa.Table) -> pa.Table:
        part, found = t.column("part")[0].as_py(), None
        for d, s in _read(t.drop_columns(["part"])):
            found = s if found is None else merged(found, s)
        out = pa.Table.from_batches([_batch({d: found})])
        return out.append_column("part", pa.array([part], pa.int32()))

    # the number of a partition is known only once it is worked on
    now = saved(vectors.select("dims", "x").mapInArrow(work, SUMMARY).withColumn("part", F.spark_partition_id()), label)
    last = now.agg(F.max("part")).first()[0] or 0
    while last > 0:
        now = saved(now.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("dims", "part").applyInArrow(join, SUMMARY + ", part int"), label)
        last //= FAN
    return now.drop("part")


@dataclass
class Model:
    """Of one vector length: vectors are rows, values their eigenvalues, `live` of which are over 0."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    live: int
    identity_error: float | None = None

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - sums, exact: as int64 where that holds it, else as Python's integers."""
        most = max(map(abs, self.sums), default=0) + self.n * int(np.abs(x).max(initial=0))
        if most * most * x.shape[1] < 2**63:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        centred = (deviations / self.n).astype(np.float64)
        return centred @ self.vectors[: self.live].T / np.sqrt(self.values[: self.live])


MODEL = "dims int, n long, sums array<decimal(38,0)>, value array<double>, vectors binary, trace double, live int"


def models(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """The model of each vector length of the fit list."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, s in _read(batch):
                _, sizes, v = np.linalg.svd(s.factor, full_matrices=True)
                k = min(components, d)
                sizes = np.concatenate([sizes, np.zeros(d)])[:d]
                signs = np.sign(v[np.arange(k), np.abs(v[:k]).argmax(axis=1)])
                live = int((sizes[:k] > NO_VARIANCE * sizes[0]).sum()) if sizes[0] > 0 else 0
                values = np.where(np.arange(k) < live, sizes[:k] ** 2 / s.n, 0.0)
                out.append({"dims": d, "n": s.n, "sums": [Decimal(x) for x in s.sums], "value": values.tolist(), "vectors": (v[:k] * signs[:, None]).tobytes(), "trace": float((sizes**2).sum() / s.n), "live": live})
            if out:
                kinds = pa.schema([("dims", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("value", pa.list_(pa.float64())), ("vectors", pa.binary()), ("trace", pa.float64()), ("live", pa.int32())])
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    solved = summed(fit, "scatter").mapInArrow(solve, MODEL).collect()  # the model: a few vectors per vector length
    return {r["dims"]: Model(r["n"], [int(v) for v in r["sums"]], np.array(r["value"]), np.frombuffer(r["vectors"]).reshape(-1, r["dims"]), r["trace"], r["live"]) for r in solved}


def _identity_errors(fit: DataFrame, found: dict[int, Model]) -> None:
    """Sets each model's identity_error, from a pass over the whole fit list."""
    sent = fit.sparkSession.sparkContext.broadcast(found)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, _, x in by_length(batch):
                m = sent.value[d]
                if m.live:
                    white = list(m.whitened(m.deviations(x)))
                    yield pa.RecordBatch.from_arrays([pa.array([d] * len(x), pa.int32()), pa.array(white, pa.list_(pa.float64()))], ["dims", "x"])

    white = fit.select("dims", "x").mapInArrow(work, "dims int, x array<double>")
    for r in summed(white, "identity").select("dims", "n", "factor").collect():  # of COMPONENTS columns, per vector length
        factor = np.frombuffer(r["factor"]).reshape(-1, found[r["dims"]].live)
        found[r["dims"]].identity_error = float(np.abs(factor.T @ factor / r["n"] - np.eye(factor.shape[1])).max())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per row and component: key, component, n, deviation, whitened, explained, identity_error."""
    c = F.col("x")
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.where(c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST)))
    rows = rows.select("id", F.size(c).alias("dims"), F.transform(c, lambda v: F.floor(v * SCALE)).alias("x"))
    fit = saved(rows.select("dims", "x").distinct(), "fit-list")
    found = models(fit, components)
    _identity_errors(fit, found)
    sent = vectors.sparkSession.sparkContext.broadcast(found)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in by_length(batch):
                m = sent.value[d]
                k = len(m.values)
                off = m.deviations(x)
                squares = (off * off).sum(axis=1)
                squares = pa.array(squares) if squares.dtype.kind == "i" else pa.array([v if v < 2**63 else None for v in map(int, squares)], pa.int64())
                white = np.full((len(x), k), np.nan)
                white[:, : m.live] = m.whitened(off)
                each = pa.array(np.repeat(np.arange(len(x)), k))
                explained = np.tile(m.values / m.trace if m.trace > 0 else np.full(k, np.nan), len(x))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * k, m.n, np.int64)), squares.take(each), pa.array(white.ravel(), from_pandas=True), pa.array(explained, from_pandas=True),
                        pa.array([m.identity_error] * (len(x) * k), pa.float64()),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double").withColumnRenamed("id", key)
