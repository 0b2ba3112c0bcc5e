"""Elias-Fano sequences and the two-level n-gram trie built of them, as flat memory-mapped bytes."""

from __future__ import annotations

import os
import tempfile

import numpy as np

STEPS = 65535
LOWEST = -24.0  #: log10 of the smallest probability a code stands for


def quantised(log10_p: np.ndarray) -> np.ndarray:
    """Sixteen-bit codes of log10 probabilities between ``LOWEST`` and 0."""
    return np.rint(np.clip(log10_p / LOWEST, 0, 1) * STEPS).astype(np.uint16)


def dequantised(code: np.ndarray) -> np.ndarray:
    return code.astype(np.float64) * (LOWEST / STEPS)


class Monotone:
    """A sorted sequence: high parts in unary, low parts in whole bytes."""

    def __init__(self, n: int, low_bytes: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bytes, self.low, self.high = n, low_bytes, low, high

    @classmethod
    def of(cls, values: np.ndarray) -> "Monotone":
        n = len(values)
        values = values.astype(np.uint64)
        top = int(values[-1]) if n else 0
        low_bytes = 0
        while n and (top >> (8 * low_bytes)) > 8 * n:
            low_bytes += 1
        low = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :low_bytes].ravel()
        at = (values >> np.uint64(8 * low_bytes)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[at] = 1
        return cls(n, low_bytes, low, np.packbits(bits))

    def values(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.high))[: self.n] - np.arange(self.n)
        low = np.zeros((self.n, 8), dtype=np.uint8)
        low[:, : self.low_bytes] = np.asarray(self.low).reshape(self.n, self.low_bytes)
        return (high.astype(np.uint64) << np.uint64(8 * self.low_bytes)) + low.view("<u8").ravel()


class Trie:
    """Contexts, pointers to their ranges of successors, successors, and a quantised number each.

    A successor is stored as its place in the list of all successors plus what the range before
    ended with, so the whole level rises and a range is searched relative to its context.
    """

    LEVELS = ("contexts", "words", "pointers", "successors")

    def __init__(self, levels: dict[str, Monotone], probability: np.ndarray, backoff: np.ndarray):
        self.levels, self.probability, self.backoff = levels, probability, backoff

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, log10_p: np.ndarray, backoff: np.ndarray) -> "Trie":
        """Of distinct pairs sorted by context and word; ``backoff`` of each distinct context."""
        contexts, first = np.unique(context, return_index=True)
        words = np.unique(word)
        place = np.searchsorted(words, word).astype(np.int64) + 1
        bounds = np.append(first, len(context))
        last = place[bounds[1:] - 1] if len(first) else np.zeros(0, np.int64)
        base = np.concatenate([[0], np.cumsum(last)[:-1]]) if len(first) else np.zeros(0, np.int64)
        stored = place + np.repeat(base, np.diff(bounds))
        levels = {
            "contexts": Monotone.of(contexts),
            "words": Monotone.of(words),
            "pointers": Monotone.of(bounds),
            "successors": Monotone.of(stored),
        }
        return cls(levels, quantised(log10_p), quantised(backoff))

    def save(self, path: str) -> None:
        parts = [self.probability, self.backoff]
        head = [len(self.probability), len(self.backoff)]
        for name in self.LEVELS:
            level = self.levels[name]
            head += [level.n, level.low_bytes, len(level.low), len(level.high)]
            parts += [level.low, level.high]
        with open(path, "wb") as f:
            f.write(np.array(head, dtype="<i8").tobytes())
            for part in parts:
                f.write(np.ascontiguousarray(part).tobytes())

    @classmethod
    def open(cls, path: str) -> "Trie":
        """Map a saved trie; nothing is read before it is asked for."""
        held = np.memmap(path, dtype=np.uint8, mode="r")
        head = held[: 8 * 18].view("<i8").tolist()
        at = 8 * 18

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return held[at - size : at]

        probability, backoff = take(2 * head[0]).view("<u2"), take(2 * head[1]).view("<u2")
        levels = {}
        for i, name in enumerate(cls.LEVELS):
            n, low_bytes, low, high = head[2 + 4 * i : 6 + 4 * i]
            levels[name] = Monotone(n, low_bytes, take(low), take(high))
        return cls(levels, probability, backoff)

    def mapped(self) -> "Trie":
        """The same trie from a file that goes with the mapping."""
        handle, path = tempfile.mkstemp(suffix=".trie")
        os.close(handle)
        self.save(path)
        out = Trie.open(path)
        os.unlink(path)
        return out

    def lookup(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every pair: whether it is stored, its log10 probability, the backoff of its context (0 if unknown)."""
        n = len(context)
        found, p, back = np.zeros(n, dtype=bool), np.zeros(n), np.zeros(n)
        contexts, words = self.levels["contexts"].values(), self.levels["words"].values()
        if not len(contexts) or not n:
            return found, p, back
        pointers, stored = self.levels["pointers"].values().astype(np.int64), self.levels["successors"].values().astype(np.int64)
        row = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
        known = contexts[row] == context
        back[known] = dequantised(self.backoff[row[known]])
        place = np.minimum(np.searchsorted(words, word), len(words) - 1)
        at = np.flatnonzero(known & (words[place] == word))
        start, stop = pointers[row[at]], pointers[row[at] + 1]
        base = np.where(start > 0, stored[start - 1], 0)
        target = base + place[at] + 1
        next_ = np.searchsorted(stored, target)  # the successor of the target in its range
        hit = (next_ < stop) & (stored[np.minimum(next_, len(stored) - 1)] == target)
        found[at[hit]] = True
        p[at[hit]] = dequantised(self.probability[next_[hit]])
        return found, p, back
