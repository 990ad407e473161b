"""What a Python worker frees goes back to the system, as the worker lives on into the pipeline's next stages."""

import os

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from loomwright.llm import bpe
from loomwright.llm.common import thrifty


def resident() -> float:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


@pytest.mark.skipif(not os.path.exists("/proc/self/statm"), reason="no /proc")
def test_freed_memory_leaves_the_worker():
    kept = []

    def work(batches):
        for b in batches:
            held = [np.ones(2500) for _ in range(10_000)]  # 200 MB in pieces of 20 kB, beneath one that stays
            kept.append(np.ones(2500))
            assert len(held)
            yield b

    before = resident()
    assert len(list(thrifty(work)(iter([pa.RecordBatch.from_pydict({"a": [1]})])))) == 1
    assert resident() < before + 60


def test_a_codec_forgets_its_pieces():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    once = codec.encode(["some words, and more"])
    assert codec.pieces and codec.words
    codec.forget()
    assert not codec.pieces and not codec.words
    assert codec.encode(["some words, and more"]) == once
