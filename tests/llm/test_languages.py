from __future__ import annotations

from pyspark.sql import functions as F


def test_every_language_is_learnt(spark):
    """More languages than were once allowed, and one whose texts are all long."""
    from loomwright.llm import ppm

    rows = [(k, f"text {k}", f"l{k:03}") for k in range(70)] + [(100 + k, "long " * (ppm.LONGEST // 4), "long") for k in range(3)] + [(200, None, "none"), (201, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert ppm.learn(docs, F.lit(True)).languages == [f"l{k:03}" for k in range(70)] + ["long"]


def test_what_is_collected_is_bounded_for_rows_of_one_key(spark, monkeypatch):
    from loomwright.llm import ppm

    seen = []
    monkeypatch.setattr(ppm, "Trees", lambda samples: seen.append({k: len(v) for k, v in samples.items()}))
    rows = [(None, f"text {k % 2000} of many", "en") for k in range(4000)] + [(7, "one text again and again", "de")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    collected = []
    frame = type(docs)
    kept = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: collected.append(kept(self)) or collected[-1])
    ppm.learn(docs, F.lit(True), sample=50)
    assert len(collected[-1]) < 200 and seen[0]["en"] <= 50 and seen[0].get("de", 0) <= 1


def test_languages_of_few_texts_with_many_copies(spark):
    """Twelve languages of three documents each, 4000 times: each is learnt."""
    from loomwright.llm import ppm

    rows = [(3 * g + k, f"words of {'abcdefghijkl'[g] * 5} number {k}", f"l{g:02}") for g in range(12) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(4000)))).drop("_")
    trees = ppm.learn(docs, F.lit(True))
    assert trees.languages == [f"l{g:02}" for g in range(12)]
