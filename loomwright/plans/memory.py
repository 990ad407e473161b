"""The memory store: scores, sweeps, duplicates, clusters and relations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.text import access_boost, clamp01, cosine, decay_score
from loomwright.operators import blocks, vectors
from loomwright.registry import query, statement
from loomwright.sources.tables import Tables

_DECAY = "least(1.0, greatest(0.0, CASE WHEN pinned THEN importance ELSE importance * exp(-0.02 * age_days) + 0.6 * ln(1 + access_count) * exp(-0.04 * age_days) END))"
_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def _decay() -> F.Column:
    return decay_score(F.col("importance").cast("double"), F.col("access_count"), F.col("age_days"), F.col("pinned"))


@query(f"SELECT id, round({_DECAY}, 6) AS score FROM memories")
def decay_score_all(t: Tables) -> DataFrame:
    return t.memories.select("id", F.round(_decay(), 6).alias("score"))


@query(f"SELECT id, round({_DECAY}, 6) AS score FROM memories WHERE NOT deleted AND NOT pinned AND {_DECAY} < 0.2")
def decay_sweep(t: Tables) -> DataFrame:
    return t.memories.where("NOT deleted AND NOT pinned").select("id", _decay().alias("s")).where("s < 0.2").select("id", F.round("s", 6).alias("score"))


@query(f"SELECT id FROM memories WHERE NOT deleted AND NOT pinned AND age_days > 45 AND access_count < 2 AND {_DECAY} < 0.2")
def cold_prune(t: Tables) -> DataFrame:
    return t.memories.where("NOT deleted AND NOT pinned AND age_days > 45 AND access_count < 2").where(_decay() < 0.2).select("id")


statement("promote_session", "SELECT id, round(least(1.0, importance + 0.08), 6) AS importance FROM (SELECT id, importance FROM memories WHERE level = 'SESSION' AND type IN ('t1', 't2', 't5') AND age_days > 1 AND importance >= 0.7 AND access_count >= 3 ORDER BY importance DESC, id LIMIT 120) x")
statement("memory_level", "SELECT id, CASE WHEN user_id = 4 THEN 'AGENT' WHEN project_id = 1 THEN 'PROJECT' WHEN type IN ('t0', 't1') THEN 'USER' ELSE 'SESSION' END AS level FROM memories")
statement("recency", "SELECT id, round(power(0.5, age_days / 14.0), 9) AS recency FROM memories")


@query("SELECT id, CASE WHEN x IS NULL OR isnan(x) THEN 0 ELSE least(greatest(x, 0), 1) END AS score FROM (SELECT id, CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN 'nan'::DOUBLE ELSE (id % 30 - 5) / 10.0 END::DOUBLE AS x FROM memories) y")
def clamp_01(t: Tables) -> DataFrame:
    x = F.when(F.col("id") % 11 == 0, F.lit(None)).when(F.col("id") % 13 == 0, F.lit(float("nan"))).otherwise((F.col("id") % 30 - 5) / 10.0).cast("double")
    return t.memories.select("id", clamp01(x).alias("score"))


_RANK = f"0.65 * greatest({_COS}, 0) + 0.2 * {_DECAY.replace('pinned', 'b.pinned').replace('importance', 'b.importance').replace('age_days', 'b.age_days').replace('access_count', 'b.access_count')} + 0.1 * greatest(0.1, least(1.0, ln(1 + b.access_count) / ln(20))) + 0.05 * CASE b.type WHEN 't0' THEN 1.0 WHEN 't1' THEN 0.9 ELSE 0.5 END"


#: Memories that a recall ranks.
FIRST = 60


def _rank_score() -> F.Column:
    """Similarity, decay, access and type, weighted."""
    decay, access, kind = _own_scores()
    return 0.65 * F.greatest(cosine(F.col("embedding"), F.col("v")), F.lit(0.0)) + decay + access + kind


def _own_scores() -> tuple[F.Column, F.Column, F.Column]:
    """What a memory's rank has from itself alone: decay, access and type, weighted."""
    kind = F.when(F.col("type") == "t0", 1.0).when(F.col("type") == "t1", 0.9).otherwise(0.5)
    return 0.2 * _decay(), 0.1 * access_boost(F.col("access_count")), 0.05 * kind


def _queries(t: Tables, n: int) -> DataFrame:
    return t.memories.where(F.col("id") < n).select(F.col("id").alias("q"), F.col("embedding").alias("v"))


def _every_50th(t: Tables) -> DataFrame:
    return t.memories.where("id % 50 = 0").select(F.col("id").alias("q"), F.col("embedding").alias("v"))


@query(f"SELECT a.id AS q, b.id, round({_RANK}, 6) AS score FROM memories a, memories b WHERE a.id % 50 = 0")
def semantic_rank(t: Tables) -> DataFrame:
    """All memories for each id that 50 divides: the rows are a fiftieth of the table's square."""
    decay, access, kind = _own_scores()
    rows = t.memories.select("id", "embedding", decay.alias("decay"), access.alias("access"), kind.alias("kind"))
    return vectors.weighed(rows, _every_50th(t), 0.65, ["decay", "access", "kind"])


@query(f"""WITH first AS (SELECT * FROM memories WHERE NOT deleted ORDER BY importance DESC, id LIMIT 60)
  SELECT q, id, round(score, 6) AS score FROM (SELECT a.id AS q, b.id, {_RANK} AS score, row_number() OVER (PARTITION BY a.id ORDER BY {_RANK} DESC, b.id) AS n FROM memories a, first b WHERE a.id % 50 = 0) x WHERE n <= 20""")
def recall(t: Tables) -> DataFrame:
    """The 60 first memories, which are the small side, ranked for each id that 50 divides."""
    first = t.memories.where("NOT deleted").orderBy(F.desc("importance"), "id").limit(FIRST)
    scored = _every_50th(t).crossJoin(F.broadcast(first)).withColumn("score", _rank_score())
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return scored.withColumn("n", F.row_number().over(w)).where("n <= 20").select("q", "id", F.round("score", 6).alias("score"))


_PAIRS = f"SELECT a.id AS a, b.id AS b, a.type, {_COS} AS sim FROM memories a JOIN memories b ON a.type = b.type AND a.id < b.id WHERE {_COS} >= 0.95"


def pairs_within(t: Tables, least: float) -> DataFrame:
    """Pairs of one type with a cosine of at least `least`: part (the type), a, b, sim."""
    return blocks.near_pairs(t.memories.select("id", F.col("type").alias("part"), "embedding"), least)


@query(f"SELECT a, b, round(sim, 6) AS sim FROM ({_PAIRS}) p")
def near_dup_pairs(t: Tables) -> DataFrame:
    return pairs_within(t, 0.95).select("a", "b", F.round("sim", 6).alias("sim"))


@query()
def near_dup_removed(t: Tables) -> DataFrame:
    """Of each pair the less important goes (then the less used, then the later), and a removed row removes none; greedy in id order within a type."""
    worth = t.memories.select("id", F.struct("importance", "access_count").alias("worth"))
    side = lambda c: worth.select(F.col("id").alias(c), F.col("worth").alias(f"of_{c}"))
    pairs = pairs_within(t, 0.95).join(side("a"), "a").join(side("b"), "b").select(F.col("part").alias("type"), "a", "b", (F.col("of_a") >= F.col("of_b")).alias("first"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        gone: dict[int, int] = {}
        for r in pdf.sort_values(["a", "b"]).itertuples():
            if r.a not in gone and r.b not in gone:
                keep, drop = (r.a, r.b) if r.first else (r.b, r.a)
                gone[drop] = keep
        return pd.DataFrame({"id": list(gone), "kept": list(gone.values())}, dtype="int64")

    return pairs.groupBy("type").applyInPandas(one, "id long, kept long")


statement("merge_duplicates", """
  WITH keep AS (SELECT from_id, min(to_id) AS kept FROM memory_edges WHERE edge_type = 'O' GROUP BY from_id)
  SELECT e.from_id, CASE WHEN e.to_id < 'p2' THEN k.kept ELSE e.to_id END AS to_id, e.edge_type, max(e.weight) AS weight FROM memory_edges e JOIN keep k ON k.from_id = e.from_id GROUP BY 1, 2, 3""")


@query("""WITH c AS (SELECT id AS cell, CAST(embedding AS DOUBLE[]) AS v FROM memories WHERE id < 8)
  SELECT id, arg_min(cell, d * 1000000 + cell / 1000.0) AS cell FROM (SELECT m.id, c.cell, list_sum(list_transform(generate_series(1, 64), lambda i: (m.embedding[i] - c.v[i]) * (m.embedding[i] - c.v[i]))) AS d FROM memories m, c) x GROUP BY id""")
def nearest_centroid(t: Tables) -> DataFrame:
    """Given a few centroids, which are broadcast: the one at the least squared distance."""
    c = t.memories.where("id < 8").select(F.col("id").alias("cell"), F.col("embedding").alias("v"))
    d = F.aggregate(F.zip_with("embedding", "v", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    met = t.memories.crossJoin(F.broadcast(c)).select("id", F.struct(d.alias("d"), "cell").alias("k"))
    return met.groupBy("id").agg(F.min("k").getField("cell").alias("cell"))


@query()
def memory_clusters(t: Tables) -> DataFrame:
    """Seeded k-means, k = round(sqrt(n / 2)) between 2 and 20; clusters of one are dropped."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    m = t.memories.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    k = max(2, min(20, round((m.count() / 2) ** 0.5)))
    found = KMeans(k=k, seed=7, maxIter=20).fit(m).transform(m).select("id", F.col("prediction").alias("cluster"))
    return found.join(found.groupBy("cluster").count().where("count > 1").select("cluster"), "cluster", "left_semi").select("id", "cluster")


@query()
def consolidation_window(t: Tables) -> DataFrame:
    """Per project, from each seed, newest first, a clique of cosine .65 and more of up to 8 is grown greedily; the largest wins.

    A project's candidates are at most the 200 newest, as many as a window looks at.
    """
    w = Window.partitionBy("project_id").orderBy("age_days", F.desc("id"))
    recent = t.memories.where("NOT deleted AND NOT pinned").withColumn("n", F.row_number().over(w)).where("n <= 200").select("project_id", "id", "n", "embedding")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        x = np.array(pdf["embedding"].tolist(), dtype=float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        near, best = x @ x.T >= 0.65, []
        for seed in range(len(x)):
            clique = [seed]
            for k in range(len(x)):
                if k != seed and len(clique) < 8 and near[k, clique].all():
                    clique.append(k)
            if len(clique) > len(best):
                best = clique
        return pd.DataFrame({"project_id": pdf["project_id"].iloc[0], "id": pdf["id"].iloc[best]}) if len(best) > 1 else pd.DataFrame({"project_id": [], "id": []}).astype("int64")

    return recent.groupBy("project_id").applyInPandas(one, "project_id long, id long")


@query(f"""SELECT a, b, CASE WHEN type_a = type_b AND sim >= 0.92 AND age_a < age_b THEN 'SUPERSEDES' WHEN type_a = 't3' AND sim >= 0.7 THEN 'DERIVED_FROM' WHEN type_a = type_b AND sim >= 0.8 THEN 'SUPPORTS' WHEN sim >= 0.75 THEN 'RELATES_TO' ELSE 'NONE' END AS relation
  FROM (SELECT a.id AS a, b.id AS b, a.type AS type_a, b.type AS type_b, a.age_days AS age_a, b.age_days AS age_b, {_COS} AS sim FROM memories a JOIN memories b ON b.id BETWEEN a.id + 1 AND a.id + 3) x""")
def relation_classify(t: Tables) -> DataFrame:
    a = t.memories.select(F.col("id").alias("a"), F.col("type").alias("type_a"), F.col("age_days").alias("age_a"), F.col("embedding").alias("va")).withColumn("b", F.explode(F.array(F.col("a") + 1, F.col("a") + 2, F.col("a") + 3)))
    b = t.memories.select(F.col("id").alias("b"), F.col("type").alias("type_b"), F.col("age_days").alias("age_b"), F.col("embedding").alias("vb"))
    sim, same = cosine(F.col("va"), F.col("vb")), F.col("type_a") == F.col("type_b")
    rule = F.when(same & (F.col("sim") >= 0.92) & (F.col("age_a") < F.col("age_b")), "SUPERSEDES").when((F.col("type_a") == "t3") & (F.col("sim") >= 0.7), "DERIVED_FROM")
    rule = rule.when(same & (F.col("sim") >= 0.8), "SUPPORTS").when(F.col("sim") >= 0.75, "RELATES_TO").otherwise("NONE")
    return a.join(b, "b").withColumn("sim", sim).select("a", "b", rule.alias("relation"))


@query(f"SELECT a, b, round(sim, 6) AS sim FROM (SELECT a.id AS a, b.id AS b, {_COS} AS sim, row_number() OVER (PARTITION BY a.id ORDER BY {_COS} DESC, b.id) AS n FROM memories a JOIN memories b ON a.type = b.type AND a.id <> b.id WHERE {_COS} >= 0.65) x WHERE n <= 5")
def similar_topk(t: Tables) -> DataFrame:
    p = pairs_within(t, 0.65).select("a", "b", "sim")
    both = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return both.withColumn("n", F.row_number().over(w)).where("n <= 5").select("a", "b", F.round("sim", 6).alias("sim"))


statement("edge_increment", "SELECT from_id, to_id, edge_type, round(least(1.0, sum(w)), 6) AS weight FROM (SELECT l_suppkey AS from_id, l_partkey AS to_id, l_linestatus AS edge_type, 0.1 + l_discount AS w FROM lineitem) x GROUP BY from_id, to_id, edge_type")
statement("contradictions", "SELECT e.from_id, e.to_id, p.p_name, s.s_name FROM memory_edges e JOIN supplier s ON concat('s', CAST(s.s_suppkey AS STRING)) = e.from_id JOIN part p ON concat('p', CAST(p.p_partkey AS STRING)) = e.to_id WHERE e.edge_type = 'F' AND e.weight >= 0.9")
statement("neighborhood_text", "SELECT from_id, count(*) AS n, min(concat('-> ', edge_type, ' ', to_id)) AS first_line, max(concat('-> ', edge_type, ' ', to_id)) AS last_line FROM memory_edges WHERE weight >= 0.8 GROUP BY from_id")



@query("""SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(list(tag), list(CASE WHEN pinned THEN 'pinned' ELSE tag END)))), ',') AS tags FROM memories GROUP BY user_id""")
def tag_merge(t: Tables) -> DataFrame:
    """New tags are added to those held, each once."""
    held = t.memories.groupBy("user_id").agg(F.collect_set("tag").alias("held"), F.collect_set(F.when(F.col("pinned"), "pinned")).alias("new"))
    return held.select("user_id", F.array_join(F.array_sort(F.array_union("held", "new")), ",").alias("tags"))


#: Samples that a memory's embedding needs to move, the least cosine to their centroid, and the share that it keeps.
SAMPLES, LEAST, KEPT = 5, 0.5, 0.7


@query("""WITH s AS (SELECT 't' || (label + 0)::VARCHAR AS type, embedding, vec_id FROM embeddings WHERE vec_id % 7 >= 3), own AS (SELECT type, arg_min(embedding, vec_id) AS v FROM s GROUP BY type HAVING count(*) >= 5),
  c AS (SELECT type, i, avg(embedding[i]::DOUBLE) AS m FROM s, generate_series(1, 64) g(i) GROUP BY type, i), p AS (SELECT own.type, c.i, own.v[c.i]::DOUBLE AS x, m FROM own JOIN c ON c.type = own.type)
  SELECT type, round(sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 6) AS cosine, round(sum(CASE WHEN i = 1 THEN 0.7 * x + 0.3 * m END), 6) AS first_value FROM p GROUP BY type HAVING sum(x * m) / sqrt(sum(x * x) * sum(m * m)) >= 0.5""")
def embedding_evolve(t: Tables) -> DataFrame:
    """Per type: the first memory's embedding moves towards the centroid of those that were used often, if it lies near enough."""
    used = t.memories.where("access_count >= 3").select("type", "id", "embedding")
    values = used.select("type", "id", F.posexplode("embedding").alias("at", "x"))
    mean = values.groupBy("type", "at").agg(F.avg(F.col("x").cast("double")).alias("m"), F.min_by(F.col("x").cast("double"), "id").alias("x"), F.count(F.lit(1)).alias("n"))
    dots = mean.where(F.col("n") >= SAMPLES).groupBy("type").agg(F.sum(F.col("x") * F.col("m")).alias("xm"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.max(F.when(F.col("at") == 0, KEPT * F.col("x") + (1 - KEPT) * F.col("m"))).alias("first_value"))
    near = F.col("xm") / F.sqrt(F.col("xx") * F.col("mm"))
    return dots.where(near >= LEAST).select("type", F.round(near, 6).alias("cosine"), F.round("first_value", 6).alias("first_value"))
