"""Byte-level BPE encoding and decoding by a local rank file (operator 7).

The tiktoken library does the merges. A long text is first cut where the pattern must end a match
anyway, so that no call sees more than about ``piece`` characters; cutting changes no id.
Ids are packed as little-endian unsigned 32-bit integers or given as an array.

Defined results: a null text encodes like an empty one (no ids); null ids decode to no bytes;
special-token strings are ordinary text; a column of the output's name is replaced.
"""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import give_back, load_encoding, query, table, workers_find_us

RANKS = "byte_bpe_multi_50k.tiktoken"

#: Between these characters every match of the pattern ends: a letter or digit never continues
#: into a blank, and letters never into digits. Contractions start with an apostrophe, which is
#: in none of the classes.
SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def pieces(text: str, size: int) -> list[str]:
    """``text`` in parts of at least ``size`` characters that end at safe boundaries."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        found = SAFE.search(text, start + size)
        if found is None or found.start() >= len(text):
            break
        out.append(text[start : found.start()])
        start = found.start()
    out.append(text[start:])
    return out


def _encode(texts: pa.Array, path: str, pattern: str, piece: int) -> list[bytes]:
    encoding = load_encoding(path, pattern)
    out = []
    for scalar in texts:
        text = scalar.as_py() or ""
        ids = [np.array(encoding.encode_ordinary(p), dtype="<u4") for p in pieces(text, piece)]
        out.append(np.concatenate(ids).tobytes() if len(ids) > 1 else ids[0].tobytes())
    return out


def encode(
    df: DataFrame,
    text: str = "text",
    out: str = "ids",
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    piece: int = 1 << 16,
    packed: bool = False,
) -> DataFrame:
    """Add the token ids of ``text`` as ``array<int>``, or packed into a binary."""
    workers_find_us(df.sparkSession)
    path = path or public_tokenizers.path(RANKS)

    @F.arrow_udf("binary" if packed else "array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        found = _encode(texts, path, pattern, piece)
        if packed:
            return give_back(pa.array(found, type=pa.binary()))
        at = np.zeros(len(found) + 1, dtype=np.int32)
        np.cumsum([len(b) // 4 for b in found], out=at[1:])
        return give_back(pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(found), dtype="<i4"))))

    return df.withColumn(out, ids(F.col(text)))


def decode(
    df: DataFrame,
    ids: str = "ids",
    out: str = "decoded",
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """Add the raw bytes of packed or listed token ids; an id outside the vocabulary is an error."""
    workers_find_us(df.sparkSession)
    path = path or public_tokenizers.path(RANKS)

    @F.arrow_udf("binary")
    def raw(column: pa.Array) -> pa.Array:
        encoding = load_encoding(path, pattern)
        listed = []
        for scalar in column:
            value = scalar.as_py()
            if isinstance(value, bytes):
                value = np.frombuffer(value, dtype="<u4").tolist()
            listed.append(encoding.decode_bytes(value or []))
        return give_back(pa.array(listed, type=pa.binary()))

    return df.withColumn(out, raw(F.col(ids)))


def digests(documents: DataFrame) -> DataFrame:
    """Encode, decode and digest every whole text."""
    done = decode(encode(documents.select("doc_id", "text"), packed=True))
    return done.select(
        "doc_id",
        F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op7_byte_bpe")
def _(spark, folder):
    return digests(table(spark, folder, "documents"))
