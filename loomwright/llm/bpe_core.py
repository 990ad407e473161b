"""Byte-pair merging on contiguous rank arrays, many short words at a time.

A word is a row of part ids (one per byte at first) beside a row of the merge ranks of its adjacent parts. Each
step finds every row's smallest rank (leftmost among equals), overwrites the left part with the merged id, deletes
the boundary between the two, and looks up the two ranks next to it anew. Rows of one length are worked on
together, so that a step is a few NumPy operations. Words over LONG bytes go one by one through a heap instead,
since scanning is quadratic in the length.
"""

from __future__ import annotations

import heapq
import json

import numpy as np

NONE = np.int32(2**31 - 1)
LONG = 96
#: Of slots in a table of pairs.
BITS = 19


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable character: printable ones as themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Merges:
    """Merge rules of a tokenizer file: ranks and results by pair of ids."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        model = parsed["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.first = np.array([vocab.get(letters[b], -1) for b in range(256)], dtype=np.int32)
        self.last = np.array([vocab.get(letters[b] + self.suffix, -1) for b in range(256)], dtype=np.int32)
        if self.first.min() < 0 or self.last.min() < 0:
            raise ValueError("the vocabulary lacks single bytes")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.keys, self.made = keys, made
        # Two tables by hash: a pair sits in the first unless another took its slot, else in the second or later ones
        self.tables = []
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            slots = self._slots(keys[left], len(self.tables))
            held, ranks = np.full(1 << BITS, -1, dtype=np.int64), np.full(1 << BITS, NONE, dtype=np.int32)
            held[slots], ranks[slots] = keys[left], left
            self.tables.append((held, ranks))
            left = left[held[slots] != keys[left]]
        self.added = {x["content"]: x["id"] for x in parsed["added_tokens"]}
        back = {c: b for b, c in letters.items()}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes_of = [b""] * size
        for word, k in vocab.items():
            self.bytes_of[k] = bytes(back[c] for c in word) if all(c in back for c in word) else word.encode()
        for word, k in self.added.items():
            self.bytes_of[k] = word.encode()

    @staticmethod
    def _slots(keys: np.ndarray, k: int) -> np.ndarray:
        return ((keys * np.int64(0x1E3779B97F4A7C15 + 2 * k) >> np.int64(23)) ^ (keys >> np.int64(29 + k))) & ((1 << BITS) - 1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left.astype(np.int64) << 32 | right
        held, ranks = self.tables[0]
        slots = self._slots(want, 0)
        out = np.where(held[slots] == want, ranks[slots], NONE)
        for k, (held, ranks) in enumerate(self.tables[1:], 1):
            slots = self._slots(want, k)
            hit = held[slots] == want
            if hit.any():
                out[hit] = ranks[slots[hit]]
        return out

    def parts(self, word: bytes) -> np.ndarray:
        ids = self.first[np.frombuffer(word, dtype=np.uint8)]
        ids[-1] = self.last[word[-1]]
        return ids

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each (non-empty) word, packed as little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ids, counts, order = self._sorted(np.frombuffer(b"".join(words), dtype=np.uint8), lengths)
        packed, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        out: list[bytes] = [b""] * len(words)
        for k, a, b in zip(order.tolist(), [0, *ends[:-1]], ends, strict=False):
            out[k] = packed[a:b]
        return out

    def encode_flat(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words that lie one behind the other in raw: all their ids, where each word's ids begin in them, and how many they are."""
        ids, counts, order = self._sorted(raw, lengths)
        starts, sizes = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
        starts[order], sizes[order] = np.cumsum(counts) - counts, counts
        return ids, starts, sizes

    def _sorted(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and their counts by word, words in the order of their lengths; and that order."""
        order = np.argsort(lengths, kind="stable")
        begins, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
        ids, counts = [np.empty(0, dtype=np.int32)], [np.zeros(int(np.searchsorted(lengths, 0, side="right")), dtype=np.int64)]
        short = int(np.searchsorted(lengths, LONG, side="right"))
        at = len(counts[0])
        while at < short:  # a few thousand words of one length at a time
            n = int(lengths[at])
            end = min(int(np.searchsorted(lengths, n, side="right")), at + 4096)
            some, sizes = self._by_scan(raw[begins[at:end, None] + np.arange(n)])
            ids.append(some)
            counts.append(sizes)
            at = end
        for a, n in zip(begins[short:].tolist(), lengths[short:].tolist(), strict=True):
            ids.append(self._by_heap(raw[a : a + n].tobytes()))
            counts.append(np.array([len(ids[-1])], dtype=np.int64))
        return np.concatenate(ids), np.concatenate(counts), order

    def _by_scan(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, n = raw.shape
        parts = self.first[raw]
        parts[:, -1] = self.last[raw[:, -1]]
        starts = np.ones((m, n), dtype=bool)  # where a part begins
        if n > 1:
            ranks = np.full((m, n), NONE, dtype=np.int32)  # of the part that begins here and the next one
            ranks[:, :-1] = self.rank(parts[:, :-1], parts[:, 1:])
            following = np.repeat(np.arange(1, n + 1, dtype=np.int32)[None], m, axis=0)
            previous = following - 2
            live = np.arange(m)
            while len(live):
                at = (ranks if len(live) == m else ranks[live]).argmin(axis=1)
                best = ranks[live, at]
                go = best != NONE
                if not go.all():
                    live, at, best = live[go], at[go], best[go]
                    if not len(live):
                        break
                gone = following[live, at]
                after = following[live, gone]
                parts[live, at] = left = self.made[best]
                starts[live, gone] = False
                ranks[live, gone] = NONE
                following[live, at] = after
                more = after < n
                ranks[live, at] = NONE
                rows, here, then = live[more], at[more], after[more]
                previous[rows, then] = here
                ranks[rows, here] = self.rank(left[more], parts[rows, then])
                before = previous[live, at]
                more = before >= 0
                rows, then = live[more], before[more]
                ranks[rows, then] = self.rank(parts[rows, then], left[more])
        counts = starts.sum(axis=1)
        return parts[starts], counts

    def _by_heap(self, word: bytes) -> np.ndarray:
        ids = self.parts(word).tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        table = self.__dict__.setdefault("_table", {pair: r for r, pair in enumerate(self.keys.tolist())})
        heap = []

        def offer(j: int) -> None:
            k = after[j]
            if k < n and (r := table.get(ids[j] << 32 | ids[k])) is not None:
                heapq.heappush(heap, (r, j, ids[j], ids[k]))

        for j in range(n - 1):
            offer(j)
        while heap:
            r, j, a, b = heapq.heappop(heap)
            k = after[j]
            if ids[j] != a or k >= n or ids[k] != b:
                continue
            ids[j], ids[k], after[j] = int(self.made[r]), -1, after[k]
            if after[j] < n:
                before[after[j]] = j
            if before[j] >= 0:
                offer(before[j])
            offer(j)
        return np.array([x for x in ids if x >= 0], dtype=np.int32)
