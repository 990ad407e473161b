"""Operator 6: printable ASCII pieces without a call of the library, and with its ids."""

import random

import numpy as np
import public_tokenizers

from loomwright.llm.token_files import Pieces


def test_ascii_pieces_agree_with_the_library_and_do_without_it():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        pieces = Pieces(f.read(), 2)
    pick = random.Random(5)
    letters = [chr(k) for k in range(33, 127)] + list("'''sdmrevl19<|>")
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(1, 12))) for _ in range(5000)]
    texts += ["it's we'LL don't'd", "$1,000.50(foo)[x]", "--'ll'", "a,.b"]
    special = ["a<|endoftext|>b", "<|startoftext|>", "x\x1fy\tz"]
    want = [np.array(e.ids, dtype="<u4").tobytes() + pieces.end for e in pieces.tokenizer.encode_batch_fast(texts + special, add_special_tokens=False)]
    asked = []

    class Told:
        def encode_batch_fast(self, some, **more):
            asked.extend(some)
            return library.encode_batch_fast(some, **more)

    library, pieces.tokenizer = pieces.tokenizer, Told()
    assert pieces.encode(texts + special) == want
    assert {p for p in asked if "<|" not in p} == {"x\x1fy\tz"}


def _library(pieces, texts):
    return [np.array(e.ids, dtype="<u4").tobytes() + pieces.end for e in pieces.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def _pieces():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return Pieces(f.read(), 2)


def test_a_word_is_merged_once_whatever_its_case_and_mark_and_common_ones_outlast_a_full_memory(monkeypatch):
    from loomwright.llm import token_files
    from loomwright.llm.bpe_core import Merges

    merged, plain = [], Merges._by_scan

    def counted(self, *given):
        out = plain(self, *given)
        merged.append(len(out[1]))
        return out

    pieces = _pieces()
    monkeypatch.setattr(Merges, "_by_scan", counted)
    monkeypatch.setattr(token_files, "REMEMBERED", 300)
    pick = random.Random(6)
    words = list({"".join(pick.choice("aeiouklmnprstüñğ") for _ in range(8)) for _ in range(200)})
    text = " ".join(f"{w} {w.capitalize()} {w}, {w.upper()}." for w in words)
    assert pieces.encode([text]) == _library(pieces, [text])
    assert sum(merged) == len(words)
    for k in range(5):  # each fills the memory anew
        more = " ".join(["".join(pick.choice("bcdfghjvwxz") for _ in range(9)) for _ in range(200)])
        del merged[:]
        assert pieces.encode([f"{text} {more}"]) == _library(pieces, [f"{text} {more}"])
        assert sum(merged) <= 200, k


def test_odd_pieces_and_null_texts_agree_with_the_library_in_portions_of_any_size(monkeypatch):
    import pyarrow as pa

    from loomwright.llm import token_files

    pieces, pick = _pieces(), random.Random(7)
    letters = [chr(k) for k in range(1, 0x140)] + list("éÉßÇñİıªµº×÷,.;:!?'sd<|> \n") * 3 + ["́", "中", "\U0001f600", " ", " ", "<|endoftext|>", "Ж"]
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 40))) for _ in range(4000)]
    texts += [chr(k) for k in range(1, 0x250)] + [f"a{chr(k)}b" for k in range(1, 0x250)] + [f"{chr(k)}." for k in range(1, 0x250)]
    texts += [None, "", "\n", "  ", "x" * 3000, "y" * 95 + "é " + "é" * 60 + ", z", "é,, ,", "< |", None]
    want = _library(pieces, texts)
    assert pieces.encode(texts) == want
    monkeypatch.setattr(token_files, "PORTION", 700)
    batch, got = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), []
    for part in token_files.portions(batch, "text"):
        got += pieces.encode(part.column("text").to_pylist())
    assert got == want
    assert token_files.Pieces.lowered(np.frombuffer("ÀßÞ×Ćğ÷Z".encode(), dtype=np.uint8))[1].tobytes().decode() == "àßþ×ćğ÷z"
