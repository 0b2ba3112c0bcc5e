"""Byte-level BPE against plain merging, and exact round trips."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import regex

from tallyloom.llm import bpe

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}


def plain(text):
    """Merge the pair of lowest rank until none is left, match by match."""
    out = []
    for match in regex.findall(P.PATTERN, text):
        parts = [bytes([b]) for b in match.encode()]
        while len(parts) > 1:
            ranked = [(RANKS.get(a + b, 10**9), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank == 10**9:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [RANKS[p] for p in parts]
    return out


TEXTS = [
    None, "", " ", "a", "It's 12 o'clock,  isn't it?\n\n\tYes!", "<|endoftext|> ñandú über çà 東京 🎉", "x" * 300,
    "word " * 40 + "12abc34 don't  stop", "\x00\x1c 　\xa0 end", "A1b2 C3" * 30,
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_same_ids_as_plain_merging_and_bytes_come_back(spark):
    rows = bpe.decode(bpe.encode(frame(spark, TEXTS), piece=16)).orderBy("doc_id").collect()
    for row, text in zip(rows, TEXTS):
        assert row["ids"] == plain(text or "")
        assert bytes(row["decoded"]) == (text or "").encode()


def test_pieces_join_to_the_text_and_change_no_id():
    import random

    random.seed(3)
    encoding = bpe.load_encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for _ in range(300):
        text = "".join(random.choice(["ab", "C", " ", "  ", "\n", "1", "'s", "é", "!", "\t", "　"]) for _ in range(80))
        parts = bpe.pieces(text, 7)
        assert "".join(parts) == text
        assert [i for p in parts for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)


def test_digests_of_repeated_rows_nulls_and_an_empty_table(spark):
    docs = frame(spark, TEXTS)
    twice = docs.union(docs)
    rows = bpe.digests(twice).collect()
    assert len(rows) == 2 * len(TEXTS)
    for row in rows:
        ids = plain(TEXTS[row["doc_id"]] or "")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((TEXTS[row["doc_id"]] or "").encode()).hexdigest()
    assert bpe.digests(docs.where("false")).count() == 0


def test_a_column_of_the_outputs_name_gives_way(spark):
    docs = frame(spark, ["one two"]).selectExpr("*", "'x' AS ids", "'y' AS decoded")
    row = bpe.decode(bpe.encode(docs)).first()
    assert row["ids"] == plain("one two") and bytes(row["decoded"]) == b"one two"


def test_a_very_long_text(spark):
    text = "lorem ipsum dolor 123 " * 40_000
    row = bpe.digests(frame(spark, [text])).first()
    assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
