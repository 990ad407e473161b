"""Iterative operators over edge DataFrames. Each step's result is a table in the folder that the cluster shares, so lineage stays short and lost executors cost a step, not the job."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names, or one of our own where it names none and all runs on one machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomwright-"))
    return sc.getCheckpointDir().rstrip("/")


_TABLES: list[tuple[SparkSession, str]] = []


@atexit.register
def _sweep() -> None:
    for spark, path in _TABLES:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone by now; the folder is scratch
            continue


def _cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back. Lineage ends there, and so do the constraints that a checkpoint would carry on, which grow from round to round."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/cut-{uuid.uuid4().hex}"
    tidy = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # the shuffle files go when the table is written
    before = spark.conf.get(tidy, None)
    spark.conf.set(tidy, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(tidy, before) if before is not None else spark.conf.unset(tidy)
    _TABLES.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20, least: float = 1e-6) -> DataFrame:
    """nodes: id. edges: src, dst, repeated edges counted, loops not. Ranks over the greatest; dangling mass is lost.

    Edges are summed to weights first, and ranks are checkpointed each fifth round and when they settle.
    """
    n = nodes.count()
    links = edges.where(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times"))
    out = links.groupBy("src").agg(F.sum("times").alias("out"))
    links = _cut(links.join(out, "src").select("src", "dst", (F.col("times") / F.col("out")).alias("share")))
    ranks = nodes.select("id", F.lit(1.0 / n if n else 0.0).alias("rank"))
    for k in range(rounds):
        sums = links.join(ranks, links["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = nodes.join(sums, nodes["id"] == sums["dst"], "left").select("id", ((1 - damping) / max(n, 1) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if k % 5 == 4:
            new = _cut(new)
            moved = new.alias("a").join(ranks.alias("b"), "id").agg(F.sum(F.abs(F.col("a.rank") - F.col("b.rank")))).first()[0] or 0.0
            if moved < least:
                ranks = new
                break
        ranks = new
    ranks = _cut(ranks)
    top = ranks.agg(F.max("rank").alias("top"))
    return ranks.join(F.broadcast(top)).select("id", F.when(F.col("top") > 0, F.col("rank") / F.col("top")).otherwise(0.0).alias("score"))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, per_node: int | None = None) -> DataFrame:
    """edges: src, dst. Every node within depth of a seed with its least depth (seeds: id, at 0)."""
    seen = frontier = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = _cut(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """edges: src, dst, any direction. (id, root): the least id that can be reached; hops double by pointer jumping."""
    both = _cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = _cut(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.least("id", "m").alias("root")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("root").alias("near"))
        low = labels.join(near, "id").select("id", F.least("root", "near").alias("root"))
        jump = low.join(low.select(F.col("id").alias("root"), F.col("root").alias("far")), "root", "left").select("id", F.least("root", F.coalesce("far", "root")).alias("root"))
        jump = _cut(jump)
        if jump.join(labels.withColumnRenamed("root", "was"), "id").where("root <> was").isEmpty():
            return jump
        labels = jump
    raise RuntimeError("components did not settle")


def scc(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """edges: src, dst. (id, root) of strongly connected components, root the least id in each.

    Nodes without an edge in or out among what is left are components of their own and are trimmed. Then each node takes the
    least id that reaches it; those that also reach that id backwards within its colour are its component.
    """
    left = _cut(edges.where("src <> dst").select("src", "dst").distinct())
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    done = None
    for _ in range(rounds):
        while not left.isEmpty():  # trim
            n = left.count()
            left = _cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
            if left.count() == n:
                break
        if left.isEmpty():
            break
        colour = _spread(left, left.select(F.col("src").alias("id")).distinct().withColumn("colour", F.col("id")))
        inside = left.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b")
        back = _cut(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = bfs(back, colour.where("id = colour").select("id"), rounds).select("id").join(colour, "id").select("id", F.col("colour").alias("root"))
        done = found if done is None else done.unionByName(found)
        gone = _cut(found.select("id"))
        left = _cut(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    if done is None:
        return nodes.select("id", F.col("id").alias("root"))
    return nodes.join(done, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def _spread(edges: DataFrame, colour: DataFrame, rounds: int = 500) -> DataFrame:
    """Each node takes the least colour of all nodes that reach it."""
    for _ in range(rounds):
        got = edges.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("got"))
        new = _cut(colour.join(got, "id", "left").select("id", F.least("colour", F.coalesce("got", "colour")).alias("colour")))
        if new.join(colour.withColumnRenamed("colour", "was"), "id").where("colour <> was").isEmpty():
            return new
        colour = new
    raise RuntimeError("colours did not settle")


def label_communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """edges: src, dst, weight. (id, community) by synchronous label propagation, ties to the least label; labels only go down after half the rounds, so that it settles."""
    both = edges.where("src <> dst").select("src", "dst", "weight").unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    both = _cut(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    labels = both.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id"))
    for k in range(rounds):
        votes = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy(F.col("src").alias("id")).agg(F.max(F.struct("w", (-F.col("community")).alias("c"))).alias("b")).select("id", (-F.col("b.c")).alias("best"))
        new = labels.join(best, "id").select("id", (F.least("community", "best") if k >= rounds // 2 else F.col("best")).alias("community"))
        labels = _cut(new)
    return labels


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: sum over communities of internal share minus the square of the degree share."""
    e = edges.where("src <> dst")
    a = communities.select(F.col("id").alias("src"), F.col("community").alias("ca"))
    b = communities.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    met = e.join(a, "src").join(b, "dst")
    inside = met.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("weight").alias("inside"))
    ends = met.select(F.col("ca").alias("c"), "weight").unionByName(met.select(F.col("cb").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("ends"))
    total = met.agg(F.sum("weight").alias("m"))
    parts = ends.join(inside, "c", "left").join(F.broadcast(total))
    return parts.agg(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("ends") / (2 * F.col("m")), 2)).alias("modularity"))
