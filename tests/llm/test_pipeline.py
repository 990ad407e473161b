"""The last two stages of the pipeline and its language stage, each on its own input, against plain Python and the tokenizers library."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np

from tests.llm.test_operators import prose


def rows():
    rng = random.Random(12)
    out = [(k, prose(rng, "de" if k % 3 == 0 else "en", rng.randint(3, 60)), "de" if k % 3 == 0 else "en", f"s{k % 3}") for k in range(240)]
    return [*out, (900, None, "en", "s0"), (901, "", "en", None), (902, "12 34", None, "s1"), (903, prose(rng, "en", 4000), "en", "s2")]


def test_stages_on_their_own_inputs(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from loomwright.llm.mixing import mix_report
    from loomwright.llm.queries import vocabulary

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_duplicates", "source_mix", "token_ids"]
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in stages["language_id"](spark, docs, "").collect()}
    assert {r[0] for r in rows()} - kept == {900, 901, 902}  # those without a letter; prose of either language stays

    mixed = Counter(r["doc_id"] for r in stages["source_mix"](spark, docs, "").collect())
    size = lambda t: len((t or "").split())
    sizes = {r[0]: size(r[1]) for r in rows()}
    for r in mix_report(docs).collect():
        assert mixed[r["doc_id"]] * sizes[r["doc_id"]] == r["taken"]
    assert max(mixed.values()) <= 2

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = stages["token_ids"](spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(sizes)
    texts = {r[0]: r[1] or "" for r in rows()}
    for r in got:
        ids = t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
