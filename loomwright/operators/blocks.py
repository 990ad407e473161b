"""All pairs of near vectors within a part, as products of blocks of vectors in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block, about: a product of two blocks is what a task holds.
BLOCK = 2048


def near_pairs(rows: DataFrame, least: float) -> DataFrame:
    """rows: id, part, embedding. Pairs a < b of one part with a cosine of at least `least`: part, a, b, sim.

    A part's vectors are dealt into blocks by hash, and each pair of blocks is one group; a part of any size is spread over tasks.
    """
    sizes = rows.groupBy("part").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "part").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, block = t.column("id").to_numpy(), t.column("block").to_numpy()
        x = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        within = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        out = []
        for at in range(0, len(x), 512):
            sims = x[at : at + 512] @ x.T
            near = (sims >= least) & (ids[at : at + 512, None] < ids[None])
            if not within:
                near &= block[at : at + 512, None] != block[None]
            a, b = np.nonzero(near)
            out.append((ids[at + a], ids[b], sims[a, b]))
        a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
        part = pa.array([t.column("part")[0].as_py()] * len(a), t.schema.field("part").type)
        return pa.table({"part": part, "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sim": pa.array(s, pa.float64())})

    kind = rows.schema["part"].dataType.simpleString()
    return units.select("id", "part", "embedding", "block", "i", "j").groupBy("part", "i", "j").applyInArrow(compare, f"part {kind}, a long, b long, sim double")
