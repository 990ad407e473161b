"""One query per training-data operator, with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end=2)


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"), least_chars=40, least_docs=5)


ORACLES["op3_line_dedup"] = """
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM texts),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
often AS (SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keyed.*, coalesce(often.top <> keyed.doc_id, false) AS lost FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


ORACLES["op8_url_filter"] = """
WITH rests AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0) AS path
  FROM rests),
marks AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
bare AS (SELECT page_id, host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM split),
named AS (
  SELECT page_id, host, CASE WHEN twice THEN regexp_extract(bare, '[^.]*[.][^.]*$', 0) ELSE regexp_extract(bare, '[^.]*$', 0) END AS suffix,
         CASE WHEN twice THEN regexp_extract(bare, '([^.]*[.])?[^.]*[.][^.]*$', 0) ELSE regexp_extract(bare, '([^.]*[.])?[^.]*$', 0) END AS domain
  FROM (SELECT *, regexp_matches(bare, '(^|[.])(ac|co|com|edu|go|gov|ne|net|or|org)[.][a-z]{2}$') AS twice FROM bare) x),
hosts AS (SELECT host, suffix, domain, count(*) AS trials, sum(bad) AS bad FROM named JOIN marks ON page_id = doc_id GROUP BY host, suffix, domain),
domains AS (SELECT suffix, domain, sum(trials) AS trials, sum(bad) AS bad FROM hosts GROUP BY suffix, domain),
suffixes AS (SELECT suffix, sum(trials) AS trials, sum(bad) AS bad FROM domains GROUP BY suffix),
moments AS (
  SELECT 'h' AS level, sum(trials) AS n, sum(bad) AS b, count(*) AS g, sum(bad * bad / trials) AS sq FROM hosts
  UNION ALL SELECT 'd', sum(trials), sum(bad), count(*), sum(bad * bad / trials) FROM domains
  UNION ALL SELECT 's', sum(trials), sum(bad), count(*), sum(bad * bad / trials) FROM suffixes),
strengths AS (
  SELECT level, coalesce(b / n, 0) AS rate,
         least(greatest(coalesce((b / n) * (1 - b / n) / greatest((sq - n * (b / n) * (b / n) - (g - 1) * (b / n) * (1 - b / n)) / nullif(n - n / g, 0), 1e-9) - 1, 1000), 1), 1000) AS strength
  FROM moments),
s AS (SELECT suffix, (bad + strength * rate) / (trials + strength) AS m FROM suffixes, strengths WHERE level = 's'),
d AS (SELECT domain, (bad + strength * s.m) / (trials + strength) AS m FROM domains JOIN s USING (suffix), strengths WHERE level = 'd'),
priors AS (
  SELECT asked.host, coalesce(trials, 0) AS trials, coalesce(bad, 0) AS bad, coalesce(d.m, s.m, corpus) AS prior,
         CASE WHEN d.m IS NOT NULL THEN of_h WHEN s.m IS NOT NULL THEN least(of_h, of_d) ELSE least(of_h, of_d, of_s) END AS strength
  FROM (SELECT DISTINCT host, suffix, domain FROM named) asked LEFT JOIN hosts USING (host) LEFT JOIN d ON d.domain = asked.domain LEFT JOIN s ON s.suffix = asked.suffix,
       (SELECT max(strength) FILTER (level = 'h') AS of_h, max(strength) FILTER (level = 'd') AS of_d, max(strength) FILTER (level = 's') AS of_s,
               max(rate) FILTER (level = 's') AS corpus FROM strengths) t),
h AS (SELECT host, (bad + strength * prior) / (trials + strength) AS m, trials + strength AS total FROM priors),
blocked AS (SELECT host FROM h WHERE m - 1.645 * sqrt(m * (1 - m) / (total + 1)) > 0.5),
rules(says, of, start) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fits AS (
  SELECT page_id, arg_max(of || start, length(of || start)) AS rule, arg_max(says, length(of || start)) AS says
  FROM split JOIN rules ON (host = of OR ends_with(host, '.' || of)) AND starts_with(path, start) GROUP BY page_id)
SELECT split.page_id, split.host, path, rule, coalesce(says, CASE WHEN blocked.host IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM split LEFT JOIN fits USING (page_id) LEFT JOIN blocked ON blocked.host = split.host
"""


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


ORACLES["op10_mixing"] = """
WITH RECURSIVE plain AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size, md5('mix-1|' || doc_id) AS u
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM plain GROUP BY source),
weighed AS (
  SELECT source, source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1)::BIGINT % 3 + 1]::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM sizes),
levels AS (
  SELECT *, (budget - (sum(cap) OVER b - cap)) / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW b AS (ORDER BY cap / weight, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
goals AS (
  SELECT source, source_size, target, whole, target - whole * source_size AS rest FROM (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM (
      SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM levels))),
summed AS (
  SELECT plain.*, source_size, target, whole, rest, sum(size) OVER (PARTITION BY plain.source ORDER BY u ROWS UNBOUNDED PRECEDING) AS upto
  FROM plain JOIN goals ON plain.source IS NOT DISTINCT FROM goals.source),
cut AS (SELECT *, CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS more FROM summed),
gaps AS (SELECT *, rest - sum(size * more) OVER (PARTITION BY source) AS gap FROM cut),
offers AS (
  SELECT doc_id, coalesce(source, '<none>') AS s, size, gap, u, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)) DESC, u) AS nth
  FROM (SELECT * FROM gaps WHERE more = 0 AND rest > 0 AND size > 0 AND size < 2 * gap
        QUALIFY row_number() OVER (PARTITION BY source, length(bin(size)) ORDER BY u) <= 64) x),
filled(s, nth, gap, hit, doc_id, size, u) AS (
  SELECT s, nth, CASE WHEN size <= gap THEN gap - size ELSE gap END, size <= gap, doc_id, size, u FROM offers WHERE nth = 1
  UNION ALL
  SELECT o.s, o.nth, CASE WHEN o.size <= f.gap THEN f.gap - o.size ELSE f.gap END, o.size <= f.gap, o.doc_id, o.size, o.u
  FROM filled f JOIN offers o ON o.s = f.s AND o.nth = f.nth + 1),
closing AS (
  SELECT f.doc_id FROM filled f JOIN (SELECT s, min(gap) AS left_over FROM filled GROUP BY s) g USING (s) WHERE NOT f.hit AND f.size < 2 * left_over
  QUALIFY row_number() OVER (PARTITION BY f.s ORDER BY f.size, f.u) = 1),
extra AS (SELECT doc_id FROM filled WHERE hit UNION SELECT doc_id FROM closing)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * least(whole + more + CASE WHEN doc_id IN (SELECT doc_id FROM extra) THEN 1 ELSE 0 END, 2))::BIGINT AS taken
FROM gaps
"""


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.ppm import identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(docs["doc_id"], 3) == 1
    judged = identify(docs, ~held_out, keep=["doc_id"])
    return judged.select("row.doc_id", (fold(F.col("row.doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.quality import score_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    scored = score_documents(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.near_vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op4_near_vectors"] = """
WITH RECURSIVE fine AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
    AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN roots USING (vec_id) LEFT JOIN counts USING (vec_id)
"""


@query
def op5_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.shingle_join import near_documents

    return near_documents(table(spark, sf_dir, "documents"), width=3, percent=90)


@query
def op9_sampling_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.sampling_prints import edited_prints

    return edited_prints(table(spark, sf_dir, "documents"))


@query
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.divergence import quality_report

    return quality_report(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


_CLASSES = [r"[a-z]", r"[A-Z]", r"[0-9]", r"[\x20\x09-\x0D]", r"[#*$%&|<>]", r"[!\x22'()+,\-./:;=?@\[\\\]^_`{}~]"]
_OF_CLASS = ", ".join("length(t) - length(regexp_replace(t, '" + c.replace("'", "''") + "+', '', 'g'))" for c in _CLASSES)

ORACLES["op11_divergence"] = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
listed AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, [{_OF_CLASS}] AS cs FROM texts),
docs AS (SELECT *, len(ws)::BIGINT AS n, list_append(cs, length(t) - list_sum(cs)::BIGINT) AS chars FROM listed),
words AS (SELECT r, lang, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM docs),
windows AS (
  SELECT r, i, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY r ORDER BY i)),
found AS (SELECT r, i FROM windows WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, w, w2, w3) > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS c FROM found, (VALUES (0), (1), (2)) x(k) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM docs),
dups AS (SELECT r, count(*) - count(DISTINCT l) AS c FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
totals AS (SELECT lang, sum(n) AS n FROM docs GROUP BY lang),
common AS (
  SELECT words.lang, w, count(*) AS c, any_value(totals.n) AS n FROM words JOIN totals ON words.lang IS NOT DISTINCT FROM totals.lang GROUP BY words.lang, totals.lang, w
  HAVING count(*) >= 0.005 * any_value(totals.n)),
ref_words AS (SELECT lang, w, c / n AS q FROM common UNION ALL SELECT t.lang, NULL, 1 - coalesce(sum(c), 0) / any_value(t.n) FROM totals t LEFT JOIN common c ON t.lang IS NOT DISTINCT FROM c.lang WHERE t.n > 0 GROUP BY t.lang),
own AS (
  SELECT words.r, common.w, count(*) AS c FROM words LEFT JOIN common ON words.lang IS NOT DISTINCT FROM common.lang AND words.w = common.w GROUP BY words.r, common.w),
word_terms AS (
  SELECT docs.r, docs.n, ref_words.q, coalesce(own.c, 0) / docs.n AS p FROM docs JOIN ref_words ON docs.lang IS NOT DISTINCT FROM ref_words.lang
  LEFT JOIN own ON own.r = docs.r AND own.w IS NOT DISTINCT FROM ref_words.w WHERE docs.n >= 50),
of_class AS (SELECT r, n, lang, unnest(chars) AS c, unnest(range(7)) AS k, length(t) AS size FROM docs),
ref_classes AS (SELECT lang, k, sum(c) / sum(sum(c)) OVER (PARTITION BY lang) AS q FROM of_class GROUP BY lang, k),
class_terms AS (SELECT o.r, o.n, q, c / size AS p FROM of_class o JOIN ref_classes f ON o.lang IS NOT DISTINCT FROM f.lang AND o.k = f.k WHERE size >= 200),
distances AS (
  SELECT r, which, any_value(n) AS n, count(*) AS bins,
         sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS d
  FROM (SELECT *, 'w' AS which FROM word_terms UNION ALL SELECT *, 'c' FROM class_terms) x WHERE n > 0 GROUP BY r, which),
farthest AS (SELECT r, max(d - CASE WHEN which = 'c' THEN 0.16 + 1.2 / sqrt(n) ELSE 0.16 + 0.32 * sqrt(bins / n) END) AS over FROM distances GROUP BY r),
based AS (
  SELECT docs.*, coalesce(repeats.c, 0)::BIGINT AS n_repeat_words, coalesce(dups.c, 0)::BIGINT AS n_dup_lines, farthest.over,
         n < 50 OR 100 * coalesce(repeats.c, 0) > 50 * n AS base_failed
  FROM docs LEFT JOIN repeats USING (r) LEFT JOIN dups USING (r) LEFT JOIN farthest USING (r))
SELECT doc_id, n AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
       n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(over > 0, false) AS kept
FROM based
"""


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


ORACLES["op12_collocations"] = r"""
WITH texts AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT d, lang, unnest(p) AS piece, unnest(range(len(p))) AS pos FROM (SELECT d, lang, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') AS p FROM texts) x),
words AS (SELECT d, lang, pos, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT d, lang, pos, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces) x),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
runs AS (SELECT lang, w, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4, lead(w, 4) OVER p AS w5 FROM words WINDOW p AS (PARTITION BY d, pos ORDER BY i)),
grams AS (
  SELECT lang, 1 AS k, w AS phrase FROM runs UNION ALL SELECT lang, 2, w || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM runs WHERE w4 IS NOT NULL
  UNION ALL SELECT lang, 5, w || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 FROM runs WHERE w5 IS NOT NULL),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
free AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a FROM counts c WHERE c.k > 1 AND NOT EXISTS (
    SELECT 1 FROM counts o WHERE o.lang = c.lang AND o.k > c.k AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * o.f >= 100 * c.f)),
cuts AS (SELECT lang, phrase, a, unnest(range(1, k)) AS k, string_split(phrase, ' ') AS ws FROM free),
met AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, n, 1000::HUGEINT * c.a * n // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:c.k], ' ') JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(ws[c.k + 1:], ' ')
  JOIN totals ON totals.lang = c.lang),
best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000
"""


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))
