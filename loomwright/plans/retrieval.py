"""Retrieval streams, fusion, gates, session-aware re-scoring and evaluation over the domain tables."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.text import edit_limit, tokens
from loomwright.operators import cells, graph, overlap, ranking, vectors, words
from loomwright.registry import query, statement
from loomwright.sources.tables import Tables

#: Words that queries ignore, as the data's languages have them.
STOPWORDS = ["the", "and", "of", "to", "in", "is", "de", "la", "que", "le", "die", "der", "und", "el", "en", "a"]
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)

# --- a query is a benchmark item: its text gives terms, the embedding of its id gives its vector; POOL rows of each stream are fused
POOL = 50
_QTERMS = f"""
  qwords AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, EXPLODE(SPLIT(lower(text), ' ')) AS term FROM benchmark) x WHERE REGEXP_LIKE(term, '^[a-z]{{3,}}$')),
  qterms AS (SELECT query_id, term FROM qwords WHERE term NOT IN ({_STOP})),
  words AS (SELECT id, term, count(*) AS tf FROM (SELECT id, EXPLODE(SPLIT(lower(content), ' ')) AS term FROM chunks) x WHERE REGEXP_LIKE(term, '^[a-z]{{3,}}$') GROUP BY id, term)"""
_KEYWORD = f"""{_QTERMS},
  hits AS (SELECT q.query_id, w.id, least(1.0, 2.0 * CAST(sum(w.tf) AS DOUBLE) / (10.0 + sum(w.tf))) AS score FROM qterms q JOIN words w ON w.term = q.term GROUP BY q.query_id, w.id)"""
# the oracle compares every long term with every text, and every vector with every query's; the plan below meets both through words and blocks
_ALL_STREAMS = f"""{_KEYWORD},
  long_terms AS (SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS terms FROM qterms WHERE length(term) >= 5),
  parts AS (SELECT l.query_id, c.id, count(*) * 1.0 / max(l.terms) AS score FROM long_terms l JOIN chunks c ON contains(lower(c.content), l.term) GROUP BY l.query_id, c.id),
  near AS (SELECT b.item_id AS query_id, m.id, least(greatest(round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[])), 9), 0), 1) AS score
    FROM benchmark b JOIN memories q ON q.id = b.item_id, memories m),
  pools AS (SELECT role, query_id, id, score, place FROM (
    SELECT role, query_id, id, score, row_number() OVER (PARTITION BY role, query_id ORDER BY score DESC, id) AS place FROM (
      SELECT 'vector' AS role, query_id, id, score FROM near UNION ALL SELECT 'keyword', query_id, id, score FROM hits UNION ALL SELECT 'trigram', query_id, id, score FROM parts WHERE score >= 0.25) u) v WHERE place <= {POOL}),
  seeds AS (SELECT query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, id) AS n FROM pools WHERE role <> 'trigram' GROUP BY query_id, id) x WHERE n <= 20),
  step1 AS (SELECT DISTINCT s.query_id, i.to_id AS id FROM seeds s JOIN imports i ON i.from_id = s.id),
  step2 AS (SELECT DISTINCT s.query_id, i.to_id AS id FROM step1 s JOIN imports i ON i.from_id = s.id),
  fresh AS (SELECT query_id, id, min(depth) AS depth FROM (SELECT query_id, id, 1 AS depth FROM step1 UNION ALL SELECT query_id, id, 2 FROM step2) x
    WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = x.query_id AND s.id = x.id) GROUP BY query_id, id),
  streams AS (SELECT role, query_id, id, score, place FROM pools
    UNION ALL SELECT 'graph', query_id, id, 0.45, row_number() OVER (PARTITION BY query_id ORDER BY depth, id) FROM fresh QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY depth, id) <= {POOL}),
  summed AS (SELECT query_id, id, coalesce(sum(1.0 / (60 + place)) FILTER (WHERE role = 'vector'), 0) + coalesce(max(1.0 / (60 + place)) FILTER (WHERE role IN ('keyword', 'trigram')), 0)
      + coalesce(sum(1.0 / (60 + place)) FILTER (WHERE role = 'graph'), 0) AS rrf,
      max(score) FILTER (WHERE role = 'vector') AS similarity, bool_and(role = 'graph') AS by_graph FROM streams GROUP BY query_id, id),
  central AS (SELECT to_id AS id, count(*) * 1.0 / max(count(*)) OVER () AS centrality FROM imports GROUP BY to_id),
  fused AS (SELECT s.query_id, s.id, least(1.0, (0.7 * rrf / max(rrf) OVER (PARTITION BY s.query_id) + 0.3 * coalesce(similarity, 0)) * (1 + 0.2 * coalesce(centrality, 0))) AS score,
      coalesce(similarity, CASE WHEN by_graph THEN 0.0 END) AS raw FROM summed s LEFT JOIN central c ON c.id = s.id)"""


def _terms(t: Tables) -> DataFrame:
    words = t.benchmark.select(F.col("item_id").alias("query_id"), F.explode(F.split(F.lower("text"), " ")).alias("term"))
    return words.where(F.col("term").rlike("^[a-z]{3,}$") & ~F.col("term").isin(STOPWORDS)).distinct()


def keyword_stream(t: Tables, terms: DataFrame) -> DataFrame:
    """Saturated term frequency; words of texts that no query asks for go before anything is shuffled, as the queries' terms are the small side."""
    words = t.chunks.select("id", F.explode(F.split(F.lower("content"), " ")).alias("term"))
    asked = words.join(terms.select("term").distinct(), "term", "left_semi").groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    hits = asked.join(terms, "term").groupBy("query_id", "id").agg(F.sum("tf").alias("tf"))
    return hits.select("query_id", "id", F.least(F.lit(1.0), 2.0 * F.col("tf") / (10.0 + F.col("tf"))).alias("score"))


def trigram_stream(t: Tables, terms: DataFrame, least: float = 0.25) -> DataFrame:
    """The share of a query's longer terms that stand somewhere in a text, words' parts included.

    A term has letters alone, so it stands within one run of letters: terms meet the distinct runs of the corpus first, by an index of their
    pieces, and those that hold one meet their texts by an equi-join.
    """
    own = terms.where(F.length("term") >= 5)
    counted = own.groupBy("query_id").agg(F.count(F.lit(1)).alias("terms"))
    runs = t.chunks.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("([a-z]{5,})"), F.lit(1)))).alias("run"))
    known = runs.select("run").distinct()
    held = words.holding(own, runs.select(F.col("run").alias("word"))).withColumnRenamed("word", "run")
    met = runs.join(held, "run").select("id", "term").distinct().join(own, "term").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("met"))
    return met.join(counted, "query_id").select("query_id", "id", (F.col("met") / F.col("terms")).alias("score")).where(F.col("score") >= least)


def vector_stream(t: Tables) -> DataFrame:
    q = t.benchmark.select(F.col("item_id").alias("id")).join(t.memories.select("id", F.col("embedding").alias("v")), "id").withColumnRenamed("id", "q")
    near = vectors.nearest(t.memories, q, POOL, 0.0)
    return near.select(F.col("q").alias("query_id"), "id", F.least("s", F.lit(1.0)).alias("score"))


def neighbour_stream(t: Tables, seeds: DataFrame, score: float = 0.45) -> DataFrame:
    """What the seeds (query_id, id) import within two steps and isn't a seed itself, nearer first."""
    edges = t.imports.distinct()
    step = lambda at: at.join(edges, at["id"] == edges["from_id"]).select("query_id", F.col("to_id").alias("id")).distinct()
    one = step(seeds)
    two = step(one)
    met = one.withColumn("depth", F.lit(1)).unionByName(two.withColumn("depth", F.lit(2))).groupBy("query_id", "id").agg(F.min("depth").alias("depth"))
    fresh = met.join(seeds, ["query_id", "id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("depth", "id"))
    return fresh.withColumn("n", place).where(F.col("n") <= POOL).select("query_id", "id", F.lit(score).alias("score"), "n")


def _pool(stream: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return stream.withColumn("n", place).where(F.col("n") <= POOL).drop("n")


def _all_fused(t: Tables) -> tuple[DataFrame, DataFrame]:
    """All streams fused, and the keyword stream's pool."""
    terms = _terms(t)
    vector, keyword, parts = (graph._cut(_pool(s)) for s in (vector_stream(t), keyword_stream(t, terms), trigram_stream(t, terms)))  # each serves twice
    best = vector.unionByName(keyword).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    seeds = best.withColumn("n", place).where("n <= 20").select("query_id", "id")
    near = neighbour_stream(t, seeds)
    ins = t.imports.groupBy(F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("ins"))
    central = ins.join(F.broadcast(ins.agg(F.max("ins").alias("top")))).select("id", (F.col("ins") / F.col("top")).alias("centrality"))  # one row
    return ranking.rrf_fuse(vector, [keyword, parts], near.select("query_id", "id", "score", F.col("n").alias("place")), centrality=central), keyword


@query(f"""WITH {_ALL_STREAMS}, gated AS (SELECT f.query_id, f.id, f.score, c.project FROM fused f JOIN chunks c ON c.id = f.id WHERE coalesce(f.raw, f.score) >= 0.2),
  capped AS (SELECT query_id, id, score FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id, project ORDER BY round(score, 12) DESC, id) AS nth FROM gated) x WHERE nth <= 2)
  SELECT query_id, id, round(score, 9) AS score, place FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) - 1 AS place FROM capped) y WHERE place < 10""")
def hybrid_search(t: Tables) -> DataFrame:
    """Vector, keyword, trigram and graph streams, fusion, gate, cap by project, top 10; a batch of queries is one plan."""
    fused = ranking.min_score(_all_fused(t)[0], 0.2).withColumn("exact", F.col("score")).withColumn("score", F.round("score", 12))
    capped = ranking.per_file_cap(fused.join(t.chunks.select("id", "project"), "id"), 2, "project")
    return ranking.top(capped, 10).select("query_id", "id", F.round("exact", 9).alias("score"), F.col("place").cast("long").alias("place"))


@query(f"WITH {_ALL_STREAMS} SELECT query_id, id, round(score, 9) AS score FROM fused")
def rrf_fuse(t: Tables) -> DataFrame:
    return _all_fused(t)[0].select("query_id", "id", F.round("score", 9).alias("score"))


@query(f"""WITH {_ALL_STREAMS}
  SELECT f.query_id, f.id, concat('vector ', CASE WHEN f.raw IS NULL THEN 'none' ELSE CAST(CAST(floor(f.raw * 100) AS BIGINT) AS STRING) || '%' END, ', keyword ', CASE WHEN k.id IS NULL THEN 'no' ELSE 'yes' END) AS explanation
  FROM fused f LEFT JOIN (SELECT * FROM pools WHERE role = 'keyword') k ON k.query_id = f.query_id AND k.id = f.id""")
def rrf_explain(t: Tables) -> DataFrame:
    fused, keyword = _all_fused(t)
    met = fused.join(keyword.select("query_id", "id", F.lit("yes").alias("k")), ["query_id", "id"], "left")
    share = F.coalesce(F.concat(F.floor(F.col("raw") * 100).cast("string"), F.lit("%")), F.lit("none"))
    return met.select("query_id", "id", F.concat(F.lit("vector "), share, F.lit(", keyword "), F.coalesce("k", F.lit("no"))).alias("explanation"))


@query(f"WITH {_KEYWORD} SELECT query_id, id, round(score, 9) AS score FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM hits) x WHERE place <= 20")
def keyword_search(t: Tables) -> DataFrame:
    return ranking.top(keyword_stream(t, _terms(t)), 20).select("query_id", "id", F.round("score", 9).alias("score"))


statement("query_terms", f"WITH {_QTERMS} SELECT query_id, term FROM qterms")
statement("fts_terms", "SELECT DISTINCT item_id AS query_id, REPLACE_ALL(w, '[^a-z0-9_]', '') AS term FROM (SELECT item_id, EXPLODE(SPLIT(lower(text), ' ')) AS w FROM benchmark) x WHERE length(REPLACE_ALL(w, '[^a-z0-9_]', '')) > 2")
statement("trigram_search", """
  WITH q AS (SELECT EXPLODE(SPLIT('tion erth chque ciono', ' ')) AS term)
  SELECT id, score FROM (SELECT c.id, count(*) / 4.0 AS score FROM chunks c JOIN q ON contains(lower(c.content), q.term) GROUP BY c.id) x WHERE score >= 0.25""")
_LIMIT = "CASE WHEN length(term) <= 4 THEN 1 WHEN length(term) <= 12 THEN 2 ELSE 3 END"
_TYPED = r"""vocabulary AS (SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(lower(content), ' ')) AS w FROM chunks) x WHERE regexp_matches(w, '^[a-z0-9]{3,}$')),
  typed AS (SELECT DISTINCT substr(w, 1, length(w) // 2) || substr(w, length(w) // 2 + 2) AS term FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM benchmark) x)"""


def _vocabulary(t: Tables) -> DataFrame:
    found = t.chunks.select(F.explode(F.split(F.lower("content"), " ", -1)).alias("word")).where(F.col("word").rlike("^[a-z0-9]{3,}$"))
    return found.distinct()


def _mistyped(t: Tables) -> DataFrame:
    """The benchmark's words of four letters and more, each without the letter in its middle."""
    w = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1))).alias("w"))
    half = F.floor(F.length("w") / 2).cast("int")
    return w.select(F.concat(F.substring("w", F.lit(1), half), F.substring("w", half + 2, F.length("w"))).alias("term")).distinct()


def nearest_words(t: Tables, terms: DataFrame) -> DataFrame:
    """Per term the nearest word of the vocabulary within its limit of edits, ties to the first by name: term, word, distance."""
    near = words.within_edits(terms, _vocabulary(t), edit_limit)
    return near.groupBy("term").agg(F.min(F.struct("distance", "word")).alias("b")).select("term", "b.word", "b.distance")


@query(f"""WITH {_TYPED}, near AS (SELECT term, word, levenshtein(term, word) AS d FROM typed JOIN vocabulary ON abs(length(term) - length(word)) <= {_LIMIT} AND levenshtein(term, word) <= {_LIMIT})
  SELECT term, arg_min(word, (d, word)) AS word, CAST(min(d) AS BIGINT) AS distance FROM near GROUP BY term""")
def fuzzy_correct(t: Tables) -> DataFrame:
    return nearest_words(t, _mistyped(t))


@query(f"""WITH {_TYPED}, asked AS (SELECT term AS asked FROM typed UNION SELECT term || ' two' FROM typed),
  near AS (SELECT term, word, levenshtein(term, word) AS d FROM typed JOIN vocabulary ON abs(length(term) - length(word)) <= {_LIMIT} AND levenshtein(term, word) <= {_LIMIT} WHERE length(term) >= 3),
  best AS (SELECT term, arg_min(word, (d, word)) AS word FROM near GROUP BY term)
  SELECT asked, coalesce(word, asked) AS used FROM asked LEFT JOIN best ON term = asked""")
def query_correction(t: Tables) -> DataFrame:
    """Queries of one term of three letters and more take the nearest known word within the limit; others stay."""
    typed = _mistyped(t)
    asked = typed.select(F.col("term").alias("asked")).union(typed.select(F.concat("term", F.lit(" two")))).distinct()
    one = asked.where(~F.col("asked").contains(" ") & (F.length("asked") >= 3)).select(F.col("asked").alias("term"))
    return asked.join(nearest_words(t, one), F.col("asked") == F.col("term"), "left").select("asked", F.coalesce("word", "asked").alias("used"))


statement("boost_files", "SELECT id, round(CASE WHEN type IN ('t1', 't4') THEN least(1.0, importance * 1.3) ELSE importance END, 6) AS score FROM memories")
# ids that a verdict names come first, in its order; the rest of a project's pool keeps its own
statement("apply_verdict", """
  SELECT project_id, id, place FROM (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY CASE id WHEN 7 THEN 1 WHEN 3 THEN 2 WHEN 11 THEN 3 ELSE 4 END, importance DESC, id) - 1 AS place FROM memories) x WHERE place < 50""")
statement("cache_invalidate", "SELECT query, count(*) AS n FROM search_events WHERE NOT contains(query, '7') AND project_id <> 3 GROUP BY query")
statement("memory_pack", """
  SELECT id, used FROM (SELECT id, CAST(sum(n) OVER (ORDER BY importance DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM (
    SELECT id, importance, CAST(ceil(length(content) / 5.0) AS BIGINT) AS n FROM memory_texts WHERE length(content) > 0 ORDER BY importance DESC, id LIMIT 20000) a) b WHERE used <= 20000""")


@query("""
  WITH t AS (SELECT DISTINCT id, tok FROM (SELECT id, EXPLODE(SPLIT(lower(content), ' ')) AS tok FROM chunks) x), n AS (SELECT id, count(*) AS n FROM t GROUP BY id),
  q AS (SELECT t.id, tok, n FROM t JOIN n ON n.id = t.id WHERE t.id % 50 = 0)
  SELECT a, b, round(met * 1.0 / (na + n.n - met), 9) AS sim FROM (SELECT q.id AS a, t.id AS b, max(q.n) AS na, count(*) AS met FROM q JOIN t ON q.tok = t.tok AND q.id <> t.id GROUP BY q.id, t.id) x JOIN n ON n.id = x.b""")
def jaccard(t: Tables) -> DataFrame:
    """Each text whose id 50 divides against all texts that share a word with it."""
    return overlap.overlaps(t.chunks.select("id", "content"), "id % 50 = 0").select("a", "b", F.round(F.col("shared") / F.col("total"), 9).alias("sim"))


statement("confidence_gate", """
  WITH q AS (SELECT item_id AS query_id, CASE WHEN length(text) < 250 THEN 'specific' WHEN length(text) < 330 THEN 'focused' ELSE 'broad' END AS class FROM benchmark),
  gates AS (SELECT 'specific' AS class, 0.55 AS least UNION ALL SELECT 'focused', 0.40 UNION ALL SELECT 'broad', 0.25)
  SELECT q.query_id, m.id FROM q JOIN gates g ON g.class = q.class JOIN memories m ON m.id % 10 = q.query_id % 10 AND m.importance >= g.least""")
statement("classify_query", "SELECT query, CASE WHEN contains(query, 'error') THEN 'debug' WHEN contains(query, 'purchase') THEN 'decision' WHEN contains(query, 'view') THEN 'pattern' ELSE 'general' END AS intent, count(*) AS n FROM search_events GROUP BY 1, 2")
statement("detect_intent", "SELECT item_id, CASE WHEN REGEXP_LIKE(lower(text), 'why|decid') THEN 'decision' WHEN REGEXP_LIKE(lower(text), 'error|fail') THEN 'debug' ELSE 'general' END AS intent FROM benchmark")
statement("attention_score", """
  WITH h AS (SELECT id, project_id, importance, access_count, age_days, row_number() OVER (PARTITION BY project_id ORDER BY importance DESC, id) AS place FROM memories),
  w AS (SELECT *, ln(max(access_count) OVER (PARTITION BY project_id) + 1) AS top FROM h WHERE place <= 50)
  SELECT id, round((0.40 * importance + 0.15 * power(0.5, age_days / 7.0) + CASE WHEN top > 0 THEN 0.15 * ln(access_count + 1) / top ELSE 0 END) / (0.55 + CASE WHEN top > 0 THEN 0.15 ELSE 0 END), 6) AS score FROM w""")
statement("task_alignment", """
  WITH task AS (SELECT DISTINCT EXPLODE(SPLIT('the of and tion to with that', ' ')) AS tok), t AS (SELECT DISTINCT id, tok FROM (SELECT id, EXPLODE(SPLIT(lower(content), ' ')) AS tok FROM chunks) x)
  SELECT t.id, round(count(task.tok) * 1.0 / (count(*) + 7 - count(task.tok)), 9) AS score FROM t LEFT JOIN task ON task.tok = t.tok GROUP BY t.id""")
statement("agent_affinity", "SELECT id, round(CASE WHEN user_id = 2 THEN 0.6 ELSE 0.0 END + 0.4 * least(access_count / 10.0, 1.0), 6) AS affinity FROM memories")
statement("chain_boost", """
  WITH boosts AS (SELECT 't0' AS type, 1.3 AS factor UNION ALL SELECT 't1', 1.15 UNION ALL SELECT 't2', 0.85)
  SELECT m.id, round(least(1.0, m.importance * coalesce(b.factor, 1.0)), 6) AS score FROM memories m LEFT JOIN boosts b ON b.type = m.type""")
statement("temporal_inhibition", "SELECT id, round(CASE WHEN age_days < 3 THEN greatest(0.0, importance - 0.15) ELSE importance END, 6) AS score FROM memories")
statement("strengthen", """
  SELECT id, round(least(0.1, CASE WHEN r < 0.5 THEN 0.0 WHEN r <= 1 THEN 0.05 * (r - 0.5) * 2 ELSE 0.05 * (1 + 0.5 * least(r - 1, 1.0)) END), 6) AS delta FROM (SELECT id, access_count / 4.0 AS r FROM memories) x""")
statement("compress_candidates", "SELECT id FROM memory_texts WHERE importance > 0.3 AND importance < 0.5 AND age_days >= 14 AND length(content) >= 200 ORDER BY importance, id LIMIT 50")
statement("prefetch_topics", "SELECT DISTINCT id, topic FROM (SELECT id, EXPLODE(SPLIT(lower(REPLACE_ALL(path, '[^A-Za-z0-9]+', ' ')), ' ')) AS topic FROM definitions) x WHERE length(topic) >= 3 AND topic NOT IN ('brand')")
statement("group_hits_by_rank", "SELECT id, CASE WHEN place <= 5 THEN 'head' ELSE 'tail' END AS part FROM (SELECT id, row_number() OVER (PARTITION BY type ORDER BY importance DESC, id) AS place FROM memories) x")

# --- evaluation
_RUN = "SELECT id % 20 AS query_id, id, row_number() OVER (PARTITION BY id % 20 ORDER BY importance DESC, id) AS place, CASE WHEN label_rel > 0 THEN label_rel ELSE 0 END AS rel FROM (SELECT id, importance, CASE WHEN access_count >= 5 THEN access_count - 4 ELSE 0 END AS label_rel FROM memories) m"
statement("eval_hit_mrr", f"""WITH run AS ({_RUN}), first AS (SELECT query_id, min(CASE WHEN rel > 0 THEN place END) AS f FROM run GROUP BY query_id)
  SELECT round(avg(CASE WHEN f <= 1 THEN 1.0 ELSE 0 END), 6) AS hit1, round(avg(CASE WHEN f <= 3 THEN 1.0 ELSE 0 END), 6) AS hit3, round(avg(CASE WHEN f <= 10 THEN 1.0 ELSE 0 END), 6) AS hit10, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr FROM first""")
statement("eval_ndcg", f"""WITH run AS ({_RUN}), best AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS place FROM run),
  d AS (SELECT query_id, sum((power(2, rel) - 1) / log2(place + 1)) AS dcg FROM run WHERE place <= 10 GROUP BY query_id), i AS (SELECT query_id, sum((power(2, rel) - 1) / log2(place + 1)) AS ideal FROM best WHERE place <= 10 GROUP BY query_id)
  SELECT d.query_id, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg FROM d JOIN i ON i.query_id = d.query_id""")
statement("eval_precision", f"""WITH run AS ({_RUN}) SELECT query_id, round(sum(CASE WHEN rel > 0 AND place <= 5 THEN 1.0 ELSE 0 END) / 5, 6) AS p5, round(sum(CASE WHEN rel > 0 AND place <= 5 THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN rel > 0 THEN 1.0 ELSE 0 END), 0), 6) AS r5 FROM run GROUP BY query_id""")
statement("eval_f1", """
  SELECT round(tp / nullif(tp + fp, 0), 6) AS p, round(tp / nullif(tp + fn, 0), 6) AS r, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM (
    SELECT sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1.0 ELSE 0 END) AS tp, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 ELSE 0 END) AS fp, sum(CASE WHEN quality = 0 AND toxic = 1 THEN 1.0 ELSE 0 END) AS fn, sum(CASE WHEN quality = 0 AND toxic = 0 THEN 1.0 ELSE 0 END) AS tn FROM labels) x""")
statement("eval_consistency", """
  SELECT session_id AS grp, round(max(importance) - min(importance), 6) AS spread, bool_and(abs(importance - mean) <= 0.45) AS consistent FROM (SELECT session_id, importance, avg(importance) OVER (PARTITION BY session_id) AS mean FROM memories) x GROUP BY session_id""")
statement("bench_stability", "SELECT event_type, round(mid, 6) AS mid, round(max(abs(duration - mid)), 6) AS deviation, max(abs(duration - mid)) <= 0.15 * mid AS stable FROM (SELECT e.event_type, e.duration, m.mid FROM search_events e JOIN (SELECT event_type, median(duration) AS mid FROM search_events GROUP BY event_type) m ON m.event_type = e.event_type) x GROUP BY event_type, mid")

# --- vectors
_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"SELECT q, id, round(score, 6) AS score FROM (SELECT a.id AS q, b.id, least(greatest({_COS}, 0), 1) AS score, row_number() OVER (PARTITION BY a.id ORDER BY {_COS} DESC, b.id) AS place FROM memories a, memories b WHERE a.id % 50 = 0) x WHERE place <= 10")
def cosine_topk(t: Tables) -> DataFrame:
    """Each id that 50 divides is a query, so queries grow with the table and are broadcast block by block."""
    near = vectors.nearest(t.memories, _asked(t), 10)
    return near.select("q", "id", F.round(F.least(F.greatest("s", F.lit(0.0)), F.lit(1.0)), 6).alias("score"))


@query(f"""WITH b1 AS (SELECT a.id AS q, b.id, list_sum(list_transform(generate_series(1, 64), lambda i: CASE WHEN (a.embedding[i] > 0) <> (b.embedding[i] > 0) THEN 1 ELSE 0 END)) AS h, {_COS} AS s FROM memories a, memories b WHERE a.id % 50 = 0),
  c AS (SELECT q, id, s FROM (SELECT q, id, s, row_number() OVER (PARTITION BY q ORDER BY h, id) AS n FROM b1) x WHERE n <= 100)
  SELECT q, id, round(s, 6) AS score FROM (SELECT q, id, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS n FROM c) y WHERE n <= 5""")
def bq_two_phase(t: Tables) -> DataFrame:
    """The 100 rows with the fewest differing signs, then the 5 of them with the largest cosine."""
    return vectors.nearest_by_signs(t.memories, _asked(t), 100, 5).select("q", "id", F.round("s", 6).alias("score"))


@query()
def lsh_topk(t: Tables) -> DataFrame:
    """Approximate kNN of each id that 50 divides, by cells; tests hold its recall against brute force."""
    q = t.memories.where("id % 50 = 0").select(F.col("id").alias("q"), "embedding")
    return cells.nearest(t.memories.select("id", "embedding"), q).select("q", "id", F.round("score", 6).alias("score"))


def _asked(t: Tables) -> DataFrame:
    return t.memories.where("id % 50 = 0").select(F.col("id").alias("q"), F.col("embedding").alias("v"))


#: What re-scoring works on: the first 60 of each query.
_POOL = """SELECT query_id, id, score, file, content FROM (SELECT id % 9 AS query_id, id, importance AS score, concat('f', CAST(id % 12 AS STRING)) AS file, content,
  row_number() OVER (PARTITION BY id % 9 ORDER BY importance DESC, id) AS nth FROM memory_texts) p WHERE nth <= 60"""


@query(f"""WITH pool AS ({_POOL}), t AS (SELECT *, list_distinct(regexp_extract_all(lower(content), '[a-z0-9_]{{2,}}')) AS toks, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM pool),
  p AS (SELECT a.query_id, a.id, a.score, b.id AS other, len(list_intersect(a.toks, b.toks)) * 1.0 / nullif(len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks)), 0) AS sim, a.file = b.file AS same FROM t a LEFT JOIN t b ON a.query_id = b.query_id AND b.place < a.place)
  SELECT query_id, id, round(score * product(CASE WHEN other IS NULL THEN 1.0 ELSE CASE WHEN coalesce(sim, 0) > 0.85 THEN 1 - 0.4 * sim ELSE 1.0 END * CASE WHEN same THEN 0.85 ELSE 1.0 END END), 6) AS score FROM p GROUP BY query_id, id, score""")
def diversity_penalty(t: Tables) -> DataFrame:
    pool = t.sql(_POOL).withColumn("tokens", tokens(F.col("content")))
    return ranking.diversity_penalty(pool).select("query_id", "id", F.round("score", 6).alias("score"))


@query()
def proximity_rerank(t: Tables) -> DataFrame:
    """Rows within a point of a run's first score are re-ordered by how near the query's terms stand."""
    boost = proximity(t.sql(_POOL), ["the", "of"])
    return ranking.tie_rerank(boost)


def proximity(pool: DataFrame, terms: list[str]) -> DataFrame:
    """Adds boost: 1 / (1 + narrowest span over length) plus half the share of up to four adjacent pairs, if every term occurs."""

    @F.pandas_udf("double")
    def measure(text: pd.Series) -> pd.Series:
        return text.map(lambda s: near_terms(s.lower(), terms))

    return pool.withColumn("boost", measure("content"))


def near_terms(text: str, terms: list[str]) -> float:
    spots = [[m.start() for m in re.finditer(f"(?={re.escape(w)})", text)] for w in terms]
    if len(terms) < 2 or not all(spots):
        return 0.0
    events = sorted((p, k) for k, own in enumerate(spots) for p in own)
    last: dict[int, int] = {}
    span = float("inf")
    for p, k in events:
        last[k] = p
        if len(last) == len(terms):
            span = min(span, p - min(last.values()))
    pairs = 0
    for left, right, w in zip(spots, spots[1:], terms):
        free = iter(right)
        nxt = next(free, None)
        for p in left:
            while nxt is not None and nxt < p + len(w):
                nxt = next(free, None)
            if nxt is not None and nxt <= p + len(w) + 30:
                pairs += 1
                nxt = next(free, None)
    return 1 / (1 + span / max(len(text), 1)) + 0.5 * min(1, pairs / 4)


@query()
def proximity_boost(t: Tables) -> DataFrame:
    return proximity(t.sql(_POOL), ["the", "of"]).select("query_id", "id", F.round("boost", 9).alias("boost"))


@query()
def context_pack(t: Tables) -> DataFrame:
    pool = t.sql(_POOL).withColumn("tokens", F.ceil(F.length("content") / 4))
    return ranking.context_pack(pool, 3000)
