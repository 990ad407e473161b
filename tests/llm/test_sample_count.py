from __future__ import annotations


def test_prints_hold_64_samples(spark):
    from loomwright.llm.sampling_prints import ID_BITS, edited_prints

    docs = spark.createDataFrame([(1, "one two three"), (2, "two three four")], "doc_id long, text string")
    assert {len(r[c]) for r in edited_prints(docs).collect() for c in ("fingerprint", "edited_fingerprint")} == {64 * ID_BITS // 4}
