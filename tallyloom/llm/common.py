"""Helpers shared by the operators of this package: registry, worker set-up, words of a batch."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def query(key: str, sql: str | None = None):
    """Register ``f(spark, folder)`` under ``key``, with the SQL it is checked against."""

    def register(f):
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def workers_find_us(spark: SparkSession) -> None:
    """Let Python workers import this package where the repository lies at the same place as here.

    On a cluster that installs the package some other way the extra path is simply empty.
    """
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))


def crc_mod(key: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; 0 for a null id."""
    c = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(0))


#: what separates words: space and the ASCII controls 9 to 13
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[32, 9, 10, 11, 12, 13]] = True


class Words:
    """The words of a batch of texts as codes into a dictionary of distinct words.

    ``codes`` holds the words of all texts one after the other; those of text ``i`` stand at
    ``offsets[i]:offsets[i + 1]``. A null text has no words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        n = len(texts)
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        data = texts.buffers()[2] if n else None
        raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        if lower and len(raw):
            raw = raw.copy()
            upper = (raw >= 65) & (raw <= 90)
            raw[upper] += 32
        inside = ~_BREAK[raw]
        starting = inside.copy()
        starting[1:] &= ~inside[:-1]
        ending = inside.copy()
        ending[:-1] &= ~inside[1:]
        # a text also ends the word it ends with
        edge = bounds[1:-1]
        edge = edge[(edge > 0) & (edge < len(raw))]
        starting[edge] = inside[edge]
        ending[edge - 1] = inside[edge - 1]
        starts, ends = np.flatnonzero(starting), np.flatnonzero(ending) + 1
        self.offsets = np.searchsorted(starts, bounds)
        self.starts, self.ends, self.raw = starts, ends, raw
        # words back to back, without the breaks between them
        packed = raw[inside]
        at = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(ends - starts, out=at[1:])
        flat = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(packed)])
        coded = flat.dictionary_encode()
        self.codes = np.asarray(coded.indices).astype(np.int32, copy=False)
        self.dictionary = coded.dictionary

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of every distinct word."""
        words = self.dictionary.to_pylist()
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def sliced(f, limit: int = 4 << 20):
    """Apply ``f`` to runs of rows of about ``limit`` bytes, so that its working arrays stay small.

    Only a single text above the limit is larger. Columns are cut at the same rows.
    """

    def apply(*columns: pa.Array) -> pa.Array:
        n = len(columns[0])
        size = sum(np.asarray(pc.fill_null(pc.binary_length(c), 0)).astype(np.int64) for c in columns)
        upto = np.cumsum(size)
        out, start = [], 0
        while start < n:
            before = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, before + limit, side="right")))
            out.append(f(*[c.slice(start, stop - start) for c in columns]))
            start = stop
        return pa.concat_arrays(out) if out else f(*columns)

    return apply


def give_back(result):
    """``result``, after the worker has returned the memory it holds but does not use."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass
    return result


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values evenly (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of ``k`` word hashes; a shorter text is one window."""
    if len(words) == 0:
        return np.zeros(0, dtype=np.uint64)
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = mix(out ^ words[i : i + n])
    return out


def expand(df: DataFrame, struct: str, fields: list[str]) -> DataFrame:
    """The fields of one struct column as columns; columns of these names give way."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != struct and c not in fields]
    return df.select(*rest, *[F.col(f"`{struct}`.`{f}`").alias(f) for f in fields])


@lru_cache(maxsize=4)
def load_encoding(path: str, pattern: str):
    """A tiktoken encoding over a local rank file, without special tokens."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
