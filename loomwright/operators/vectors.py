"""Each of many vectors against each of many queries, as products of packs of vectors in double precision.

Rows are packed where they lie, a few thousand vectors to a row, and packs meet the packs of a bounded block of queries, so no pair is a row before
it is scored, and of a search only each pack's best go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from loomwright.operators.ranking import in_blocks

#: Vectors of a pack, queries of a block (which is broadcast), and pairs that are scored at once.
PACK, QUERIES, AT_ONCE = 16384, 8192, 2**21
#: Beyond all cosines in whole 1e-9.
FAR = np.int64(2**62)


def packed(rows: DataFrame, size: int = PACK) -> DataFrame:
    """One row per up to `size` rows of a partition: each column as an array."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def full(n: int) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            for at in range(0, n, size):
                part = table.slice(at, min(size, n - at)).combine_chunks()
                lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.concat_arrays(c.chunks)) for c in part.columns]
                yield pa.RecordBatch.from_arrays(lists, names=part.column_names)
            held[:] = table.slice(n).to_batches()

        for batch in batches:
            held.append(batch)
            n = sum(len(b) for b in held)
            if n >= size:
                yield from full(n - n % size)
        n = sum(len(b) for b in held)
        if n:
            yield from full(n)

    return rows.mapInArrow(work, StructType([StructField(f.name, ArrayType(f.dataType)) for f in rows.schema]))


def unit_rows(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as doubles, padded to one width, their norms (NaN for null vectors and those with nulls), and their widths."""
    vectors = pa.concat_arrays([vectors])
    widths = np.asarray(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = vectors.flatten()
    lacks = np.asarray(flat.is_null().to_numpy(zero_copy_only=False), dtype=bool)
    values = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(widths)
    x = np.zeros((len(widths), int(widths.max(initial=0))))
    row, column = np.repeat(np.arange(len(widths)), widths), np.arange(len(values)) - np.repeat(ends - widths, widths)
    x[row, column] = values
    null = vectors.is_null().to_numpy(zero_copy_only=False).astype(bool)
    null[row[lacks]] = True
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
    norms[null] = np.nan
    return x, norms, np.where(null, -1, widths)


def cosines(q: tuple, m: tuple) -> np.ndarray:
    """Of all rows of q with all of m, as of `unit_rows`: 0 where either is zero or null, below all others where their widths differ, NaN where components aren't finite."""
    (a, na, wa), (b, nb, wb) = q, m
    width = min(a.shape[1], b.shape[1])
    with np.errstate(all="ignore"):
        s = (a[:, :width] @ b[:, :width].T) / (na[:, None] * nb[None])
        s[(na == 0) | (wa < 0)] = 0.0
        s[:, (nb == 0) | (wb < 0)] = 0.0
    if len(set(wa[wa > 0]) | set(wb[wb > 0])) > 1:
        s[(wa[:, None] != wb[None]) & (wa[:, None] > 0) & (wb[None] > 0)] = -np.inf
    return s


def best(keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k least whole numbers, ties to the first column."""
    n = keys.shape[1]
    if n <= k:
        return np.repeat(np.arange(len(keys)), n), np.tile(np.arange(n), len(keys))
    at = np.argpartition(keys * n + np.arange(n), k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(len(keys)), k), at.ravel()


def met(rows: DataFrame, queries: DataFrame, begin: Callable[[], Callable[[dict, dict], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """rows: columns as scores take them; queries: q, v. begin: for one task, a score: of a pack of rows and one of queries, columns as Arrow arrays, to rows of the result."""
    spark = rows.sparkSession
    spread = rows.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))
    packs = packed(spread)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = begin()
        for b in batches:
            for i in range(len(b)):
                part = {name: b.column(n)[i].values for n, name in enumerate(b.schema.names)}
                yield from score({c: part[c] for c in part if c not in ("q", "v")}, {c: part[c] for c in ("q", "v")})

    # one pack of queries, as a block is bounded
    search = lambda block: packs.crossJoin(F.broadcast(packed(block.repartition(1), 2 * QUERIES))).mapInArrow(work, schema)
    return in_blocks(queries, search, QUERIES)


def _ordered(m: dict) -> tuple[pa.Array, pa.Array]:
    """A pack's ids in order, a null first, and its vectors in that order."""
    order = pc.array_sort_indices(m["id"], null_placement="at_start")
    return m["id"].take(order), m["embedding"].take(order)


def _tenths(s: np.ndarray) -> np.ndarray:
    """Cosines in whole 1e-9, least for the best; NaN is the best, as in an ORDER BY."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isnan(s), -(2 * 10**9), -np.rint(np.maximum(s, -1.0) * 1e9)).astype(np.int64)


def _slim(x: np.ndarray, norms: np.ndarray, widths: np.ndarray) -> np.ndarray | None:
    """Unit vectors of `unit_rows` in single precision, zero for null and zero vectors; None where widths differ or values are out of its range."""
    known = widths >= 0
    big = known & (norms != 0)
    if len(set(widths[widths > 0])) > 1 or not np.isfinite(x).all() or not ((norms[big] > 1e-100) & (norms[big] < 1e100)).all():
        return None
    return np.where(big[:, None], x / np.where(big, norms, 1.0)[:, None], 0.0).astype(np.float32)


def _likely(a: np.ndarray, b: np.ndarray, floor: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows and columns of all pairs that can be among a row's k best, from single precision with a bound on its error; None where that leaves too many or `least` decides.

    floor: of each row's k-th best so far, its whole 1e-9, or FAR.
    """
    error = (a.shape[1] + 8) * 6e-8 + 2e-9
    limit = -floor / 1e9 - error
    first = floor == FAR
    if first.any():
        some = b[: max(4096, 4 * k)]
        if len(some) <= k:
            return None
        limit[first] = np.partition(a[first] @ some.T, len(some) - k, axis=1)[:, len(some) - k].astype(np.float64) - 2 * error
    if (limit <= least + error).any():
        return None
    limit, found, n = limit.astype(np.float32)[:, None], [], 0
    for at in range(0, len(b), 2048):
        part = b[at : at + 2048]
        hit = np.flatnonzero(a @ part.T >= limit)
        found.append((hit // len(part), at + hit % len(part)))
        n += len(hit)
        if n > len(a) * len(b) // 16 + 1024:
            return None
    r, c = (np.concatenate(x) for x in zip(*found, strict=True))
    return r, c


def nearest(rows: DataFrame, queries: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """rows: id, embedding; queries: q, v. Per query the k rows of the largest cosine to nine digits, at least `least`, ties to the smaller id: q, id, s.

    A task keeps each query's k best cosines so far. Pairs that single precision, with its error, puts below them go no further; the others are scored in double precision.
    """
    most = -int(round(least * 1e9))

    def begin() -> Callable[[dict, dict], Iterator[pa.RecordBatch]]:
        held: dict[bytes, tuple] = {}

        def score(m: dict, q: dict) -> Iterator[pa.RecordBatch]:
            ids, own = _ordered(m)
            them, names = unit_rows(own), q["q"].to_numpy(zero_copy_only=False)
            if names.tobytes() not in held:
                asked = unit_rows(q["v"])
                held[names.tobytes()] = asked, _slim(*asked), np.full((len(names), k), FAR)
            asked, a, top = held[names.tobytes()]
            b = _slim(*them)
            if a is not None and b is not None and a.shape[1] != b.shape[1]:
                b = None
            step = max(1, AT_ONCE // len(ids))
            for at in range(0, len(names), 4 * step):
                to = min(at + 4 * step, len(names))
                found = _likely(a[at:to], b, top[at:to, -1], k, least) if a is not None and b is not None else None
                if found:
                    r, c = found
                    near = [_pairwise(asked, them, at + r[n : n + 65536], c[n : n + 65536]) for n in range(0, len(r), 65536)]
                    keys = np.minimum(_tenths(np.concatenate(near) if near else np.zeros(0)), most)
                else:
                    parts = []
                    for one in range(at, to, step):
                        all_keys = np.minimum(_tenths(cosines(tuple(x[one : min(one + step, to)] for x in asked), them)), most)
                        r, c = best(all_keys, k)
                        parts.append((one - at + r, c, all_keys[r, c]))
                    r, c, keys = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((c, keys, r))
                r, c, keys = r[order], c[order], keys[order]
                nth = np.arange(len(r)) - np.searchsorted(r, r)
                go = (nth < k) & (keys <= top[at + r, -1])
                r, c, keys, nth = r[go], c[go], keys[go], nth[go]
                new = np.full((to - at, k), FAR)
                new[r, nth] = keys
                top[at:to] = np.sort(np.concatenate([top[at:to], new], axis=1), axis=1)[:, :k]
                s = np.where(keys == -(2 * 10**9), np.nan, -keys / 1e9)
                yield pa.RecordBatch.from_arrays([pa.array(names[at + r]), ids.take(pa.array(c)), pa.array(s)], names=["q", "id", "s"])

        return score

    found = met(rows.select("id", "embedding"), queries.select("q", "v"), begin, "q long, id long, s double")
    return _first(found, [F.desc("s"), "id"], k)


def nearest_by_signs(rows: DataFrame, queries: DataFrame, pool: int, k: int, dims: int = 64) -> DataFrame:
    """Per query the `pool` rows with the fewest differing signs, and of them the k of the largest cosine, ties to the smaller id: q, id, s."""

    def score(m: dict, q: dict) -> Iterator[pa.RecordBatch]:
        ids, own = _ordered(m)
        them, asked, names = unit_rows(own), unit_rows(q["v"]), q["q"].to_numpy(zero_copy_only=False)
        signs = lambda x: (x[:, :dims] > 0).astype(np.float32)
        a, b = signs(asked[0]), signs(them[0])
        step = max(1, AT_ONCE // len(ids))
        for at in range(0, len(names), step):
            part = a[at : at + step]
            h = (part.sum(1)[:, None] + b.sum(1)[None] - 2 * (part @ b.T)).astype(np.int64)
            r, c = best(h, pool)
            near = np.empty(len(r))
            for one in range(0, len(part), 64):  # the cosines of a few queries' pools
                mine = slice(*np.searchsorted(r, [one, min(one + 64, len(part))]))
                near[mine] = _pairwise(asked, them, at + r[mine], c[mine])
            yield pa.RecordBatch.from_arrays([pa.array(names[at + r]), ids.take(pa.array(c)), pa.array(h[r, c].astype(np.int16)), pa.array(near)], names=["q", "id", "h", "s"])

    found = met(rows.select("id", "embedding"), queries.select("q", "v"), lambda: score, "q long, id long, h short, s double")
    return _first(_first(found, ["h", "id"], pool), [F.desc("s"), "id"], k).select("q", "id", "s")


def _pairwise(q: tuple, m: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    (a, na, wa), (b, nb, wb) = q, m
    width = min(a.shape[1], b.shape[1])
    with np.errstate(all="ignore"):
        s = np.einsum("ij,ij->i", a[i, :width], b[j, :width]) / (na[i] * nb[j])
    s[(na[i] == 0) | (nb[j] == 0) | (wa[i] < 0) | (wb[j] < 0)] = 0.0
    return s


def _first(found: DataFrame, order: list, k: int) -> DataFrame:
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def weighed(rows: DataFrame, queries: DataFrame, weight: float, own: list[str], digits: int = 6) -> DataFrame:
    """rows: id, embedding and the columns `own`; every row for each query with weight times the cosine, at least 0, plus its own columns in their order: q, id, score to so many digits."""

    def score(m: dict, q: dict) -> Iterator[pa.RecordBatch]:
        them, asked, names = unit_rows(m["embedding"]), unit_rows(q["v"]), q["q"].to_numpy(zero_copy_only=False)
        ids, terms = m["id"], [m[c].to_numpy(zero_copy_only=False) for c in own]
        step = max(1, AT_ONCE // 8 // len(ids))
        for at in range(0, len(names), step):
            s = weight * np.maximum(cosines(tuple(c[at : at + step] for c in asked), them), 0.0)
            for term in terms:
                s += term
            s = np.floor(s * 10**digits + 0.5) / 10**digits
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[at : at + step], len(ids))), ids.take(pa.array(np.tile(np.arange(len(ids)), len(s)))), pa.array(s.ravel())], names=["q", "id", "score"])

    return met(rows.select("id", "embedding", *own), queries.select("q", "v"), lambda: score, "q long, id long, score double")
