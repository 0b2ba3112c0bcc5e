"""Language-model scoring with an Elias-Fano n-gram trie (operator 5).

Words are counted over all training texts; every pair of a word and the one before it is stored in
a two-level trie of Elias-Fano sequences (contexts, pointers, successors) with quantised smoothed
probabilities, and every text is scored by searching its words among the successors of their
contexts. A text ends with one end token and begins in a context of its own.

``P(w | v) = (c(v w) + T(c(v)) * P(w)) / (c(v) + T(c(v)))`` with ``P(w) = (c(w) + 1) / (N + V + 1)``:
the weight of the lower order is the number of different words that ``c(v)`` draws from the
vocabulary are expected to show. It depends on the count alone, so probabilities sum to one and a
pair can be judged wherever its counts meet; no context, however frequent, is gathered anywhere.

How it runs. Texts are cut into chunks of some megabytes, written once as word codes. The distinct
words of each chunk meet those of all others in shards by word, which answer with counts. With
them every chunk sends its distinct pairs, and for each the documents it stands in, to shards by
pair; a shard builds its part of the trie, maps it into memory, searches all pairs sent to it and
returns sums per document. A frequent word or pair arrives once per chunk, not once per occurrence;
chunks and shards have a fixed size, and their number follows the input.

Defined results: a null text is empty and scores its end token; rows without an id are scored under
a null id; repeated rows are texts of their own; an unseen context leaves the single word's
probability; without training texts every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.taskcontext import TaskContext

from ..session import checkpointed
from .common import Words, crc_mod, mix, query, table, workers_find_us
from .elias_fano import Trie

CHUNK_BYTES = 16 << 20  #: of text in a chunk
SHARD_TOKENS = 3_000_000  #: of all tokens, for each shard
END = np.uint64(0x9D5C_F04C_19E3_A6B1)  #: stands for the end token among the hashes of words
MOVED = "key long, kind int, part int, payload binary"
WORDS, COUNTS, STATS, BLOCK, TEXTS, SUMS, HASHES = range(7)


def pack(**arrays) -> bytes:
    """Arrays as one compressed string, equal places of all their numbers side by side."""
    split = {
        name: (a.dtype.str, a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) if isinstance(a, np.ndarray) and len(a) else a
        for name, a in arrays.items()
    }
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(split, protocol=5))


def unpack(payload: bytes) -> dict[str, np.ndarray]:
    split = pickle.loads(zstandard.ZstdDecompressor().decompress(payload))
    out = {}
    for name, a in split.items():
        if isinstance(a, tuple):
            kind = np.dtype(a[0])
            a = np.frombuffer(a[1], np.uint8).reshape(kind.itemsize, -1).T.copy().reshape(-1).view(kind)
        out[name] = a
    return out


def moved(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), (), (), ()]
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=["key", "kind", "part", "payload"])


def as_rows(group: pa.Table) -> list[tuple[int, int, int, bytes]]:
    return list(zip(*[group.column(c).to_pylist() for c in ("key", "kind", "part", "payload")]))


def steps(a: np.ndarray) -> np.ndarray:
    """Differences of a sorted array; ``np.cumsum`` undoes it. Small numbers compress well."""
    return np.diff(a, prepend=a.dtype.type(0))


def cut(docs: DataFrame, key: str, text: str, held_out: Column) -> DataFrame:
    """The texts as chunks of word codes, keyed by chunk: their codes (kind TEXTS) and what the codes
    stand for (kind HASHES, in order)."""

    def chunks(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            out: list[tuple[int, int, int, bytes]] = []

            def one(ids: pa.Array, held: pa.Array, texts: pa.Array) -> pa.Array:
                nonlocal number
                words = Words(texts, lower=True)
                n = len(words)
                hashes = np.append(words.hashes(), END)
                order = np.argsort(hashes)
                place = np.empty(len(order), dtype=np.int32)
                place[order] = np.arange(len(order))
                codes = np.insert(place[words.codes], words.offsets[1:], place[-1])
                counts = np.diff(words.offsets) + 1
                trained = np.repeat(~np.asarray(held.to_numpy(zero_copy_only=False), dtype=bool), counts)
                seen = np.bincount(codes[trained], minlength=len(order))
                missing = np.asarray(ids.is_null())
                payload = pack(
                    ids=np.asarray(pc.fill_null(ids, 0)), missing=missing, held=np.asarray(held.to_numpy(zero_copy_only=False), dtype=bool),
                    counts=counts.astype(np.int64), codes=narrowest(codes), distinct=len(order),
                )
                out.append((number, TEXTS, len(codes), payload))
                out.append((number, HASHES, 0, pack(hashes=hashes[order], seen=narrowest(seen))))
                number += 1
                return pa.nulls(0)

            columns = [batch.column(0), batch.column(1), batch.column(2)]
            by_bytes(one, columns)
            yield moved(out)

    narrow = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("text"))
    return narrow.mapInArrow(chunks, MOVED)


def by_bytes(f, columns: list[pa.Array]) -> None:
    """Call ``f`` on runs of rows whose texts (the last column) make up about a chunk."""
    at = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(columns[-1]), 0)).astype(np.int64))
    start = 0
    while start < len(at):
        stop = max(start + 1, int(np.searchsorted(at, (at[start - 1] if start else 0) + CHUNK_BYTES, side="right")))
        f(*[c.slice(start, stop - start) for c in columns])
        start = stop


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges, so that sorted hashes come in order of shard."""
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def ask_words(shards: int):
    """From chunks: the distinct words of each, with training counts, to the shards of the words."""

    def ask(batches):
        for batch in batches:
            for chunk, kind, _, payload in as_rows(pa.Table.from_batches([batch])):
                if kind != HASHES:
                    continue
                held = unpack(payload)
                shard = shard_of(held["hashes"], shards)
                yield moved(
                    [
                        (int(s), WORDS, chunk_part(chunk), pack(chunk=chunk, hashes=held["hashes"][shard == s], seen=held["seen"][shard == s]))
                        for s in np.unique(shard)
                    ]
                )

    return ask


def chunk_part(chunk: int) -> int:
    return int(chunk & 0x7FFFFFFF)


def count_words(shards: int):
    """In a shard: counts of all its words, answers to every chunk, and a row of statistics."""

    def count(group: pa.Table) -> pa.Table:
        shard = group.column("key")[0].as_py()
        asked = [unpack(p) for _, _, _, p in as_rows(group)]
        words, place = np.unique(np.concatenate([a["hashes"] for a in asked]), return_inverse=True)
        # ids fall with the count, so that frequent words have small ones
        total = np.bincount(place, weights=np.concatenate([a["seen"] for a in asked]).astype(np.float64)).astype(np.int64)
        ids = np.empty(len(total), dtype=np.int64)
        ids[np.argsort(-total, kind="stable")] = np.arange(len(total))
        rows, at = [], 0
        for a in asked:
            mine = place[at : at + len(a["hashes"])]
            at += len(mine)
            # ids are dense over all shards and words: place in the shard, then shard
            rows.append((a["chunk"], COUNTS, shard, pack(total=narrowest(total[mine]), ids=narrowest(ids[mine] * shards + shard))))
        bins, words_in = np.unique(np.rint(np.log(total[total > 0]) * 64).astype(np.int64), return_counts=True)
        end = np.searchsorted(words, END)
        ends = int(total[end]) if end < len(words) and words[end] == END else 0
        rows.append((-1, STATS, shard, pack(tokens=int(total.sum()), words=int((total > 0).sum()), ends=ends, bins=bins, words_in=words_in)))
        return pa.Table.from_batches([moved(rows)])

    return count


class Lower:
    """Size of the training text and the weight of the lower order by the count of a context."""

    def __init__(self, stats: list[dict]):
        self.tokens = sum(s["tokens"] for s in stats)
        self.words = sum(s["words"] for s in stats)
        self.ends = sum(s["ends"] for s in stats)
        size: dict[int, int] = {}
        for s in stats:
            for b, n in zip(s["bins"].tolist(), s["words_in"].tolist()):
                size[b] = size.get(b, 0) + n
        share = np.exp(np.array(sorted(size)) / 64) / max(self.tokens, 1)
        number = np.array([size[b] for b in sorted(size)], dtype=float)
        self.grid = np.linspace(0, np.log(max(self.tokens, 2)), 400)
        self.expected = np.log([max((number * -np.expm1(-c * share)).sum(), 1e-9) for c in np.exp(self.grid)])

    def single(self, count: np.ndarray) -> np.ndarray:
        """log10 P(w)."""
        return np.log10((count + 1) / (self.tokens + self.words + 1))

    def weight(self, count: np.ndarray) -> np.ndarray:
        return np.exp(np.interp(np.log(np.maximum(count, 1)), self.grid, self.expected))

    def backoff(self, count: np.ndarray) -> np.ndarray:
        """log10 of what a context leaves to the single words; 0 for an unseen one."""
        t = self.weight(count)
        return np.where(count > 0, np.log10(t / (count + t)), 0.0)


def ask_pairs(lower: Lower, shards: int):
    """In a chunk, with the counts of its words: its own sums, and its pairs to the shards of pairs."""

    def ask(group: pa.Table) -> pa.Table:
        rows = as_rows(group)
        chunk = rows[0][0]
        held = next(unpack(p) for _, kind, _, p in rows if kind == TEXTS)
        n_words = held["distinct"]
        parts = sorted((part, p) for _, kind, part, p in rows if kind == COUNTS)
        answers = [unpack(p) for _, p in parts]
        total = np.concatenate([*[a["total"].astype(np.int64) for a in answers], [0]])
        ids = np.concatenate([*[a["ids"].astype(np.int64) for a in answers], [0]])
        total[n_words], ids[n_words] = lower.ends, -1  # the context at the beginning of a text
        codes, counts = held["codes"].astype(np.int64), held["counts"]
        n_docs = len(counts)
        doc = np.repeat(np.arange(n_docs), counts)
        before = np.concatenate([[n_words], codes[:-1]]) if len(codes) else codes
        before[np.cumsum(counts)[:-1]] = n_words
        single = lower.single(total[:n_words].astype(float))
        base = np.bincount(doc, weights=single[codes], minlength=n_docs).astype(float)
        n_known = np.bincount(doc, weights=total[codes] > 0, minlength=n_docs).astype(np.int64)
        # what has an unseen part is in no trie
        back = lower.backoff(total.astype(float))
        outside = (total[before] == 0) | (total[codes] == 0)
        local = np.bincount(doc[outside], weights=(back[before] + single[codes])[outside], minlength=n_docs)
        out = [
            (chunk, SUMS, -1, pack(ids=held["ids"], missing=held["missing"], held=held["held"], n_tokens=counts, n_known=n_known, base=base, score=local))
        ]
        inside = ~outside
        # distinct (document, context, word), in that order within each shard of pairs
        wide = n_words + 1
        v, w = before[inside].astype(np.int64), codes[inside]
        to = shard_of(pair_hash(ids[v], ids[w]), shards)
        to, in_doc, v, w, times = distinct_rows([to, doc[inside], v, w], [shards, n_docs, wide, wide])
        ends = np.searchsorted(to, np.arange(shards + 1))
        for s in range(shards):
            mine = slice(ends[s], ends[s + 1])
            if ends[s] == ends[s + 1]:
                continue
            documents, runs = np.unique(in_doc[mine], return_counts=True)
            out.append(
                (
                    s, BLOCK, chunk_part(chunk),
                    pack(
                        chunk=chunk, doc=narrowest(steps(documents)), runs=narrowest(runs), held=held["held"][documents], times=narrowest(times[mine]),
                        **listed("v", ids[v[mine]], total[v[mine]]), **listed("w", ids[w[mine]], total[w[mine]]),
                    ),
                )
            )
        return pa.Table.from_batches([moved(out)])

    return ask


def distinct_rows(columns: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
    """Distinct rows of whole numbers below ``sizes``, sorted, and how often each occurs."""
    product = 1
    for size in sizes:
        product *= size
    if product < 2**63:
        key = columns[0]
        for column, size in zip(columns[1:], sizes[1:]):
            key = key * size + column
        key, times = np.unique(key, return_counts=True)
        out = []
        for size in sizes[:0:-1]:
            out.append(key % size)
            key = key // size
        return [key, *out[::-1], times]
    order = np.lexsort(columns[::-1])
    ordered = np.stack([c[order] for c in columns])
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (ordered[:, 1:] != ordered[:, :-1]).any(axis=0)
    first = np.flatnonzero(fresh)
    return [*ordered[:, first], np.diff(np.append(first, len(order)))]


def narrowest(a: np.ndarray) -> np.ndarray:
    most = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if most < 2**8 else np.uint16 if most < 2**16 else np.uint32 if most < 2**32 else np.uint64)


def listed(name: str, ids: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Ids and their counts once each, in order of id, and where in that list every row points."""
    known, first, place = np.unique(ids, return_index=True, return_inverse=True)
    return {f"{name}_id": narrowest(steps(known + 1)), f"{name}_count": narrowest(counts[first]), f"{name}_at": narrowest(place)}


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(v.astype(np.int64).view(np.uint64)) ^ w.astype(np.uint64))


def trie_of(v: np.ndarray, w: np.ndarray, c: np.ndarray, c_v: np.ndarray, single: np.ndarray, lower: Lower) -> Trie:
    """The trie of the pairs with a training count, from rows that may name a pair more than once."""
    order = np.lexsort((w, v))
    v, w, c, c_v, single = v[order], w[order], c[order], c_v[order], single[order]
    fresh = np.ones(len(v), dtype=bool)
    fresh[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    first = np.flatnonzero(fresh)
    count = np.add.reduceat(c, first) if len(first) else c
    v, w, c_v, single = v[first], w[first], c_v[first].astype(float), single[first]
    stored = count > 0
    v, w, count, c_v, single = v[stored], w[stored], count[stored], c_v[stored], single[stored]
    t = lower.weight(c_v)
    p = np.log10((count + t * 10.0**single) / (c_v + t))
    contexts = np.unique(v, return_index=True)[1]
    return Trie.build(v.astype(np.uint64), w.astype(np.uint64), p, lower.backoff(c_v[contexts]))


def score_pairs(lower: Lower):
    """In a shard: build the trie of its pairs, search them all, and sum per document."""

    def score(group: pa.Table) -> pa.Table:
        rows = as_rows(group)
        if rows[0][1] == SUMS:
            return group
        blocks = [unpack(p) for _, _, _, p in rows]

        def joined(name: str) -> tuple[np.ndarray, np.ndarray]:
            return (
                np.concatenate([np.cumsum(b[f"{name}_id"].astype(np.int64))[b[f"{name}_at"]] for b in blocks]),
                np.concatenate([b[f"{name}_count"].astype(np.int64)[b[f"{name}_at"]] for b in blocks]),
            )

        (v, c_v), (w, c_w) = joined("v"), joined("w")
        trained = np.concatenate([np.repeat(~b["held"], b["runs"].astype(np.int64)) * b["times"].astype(np.int64) for b in blocks])
        single = lower.single(c_w.astype(float))
        trie = trie_of(v, w, trained, c_v, single, lower).mapped()
        found, p, back = trie.lookup(v.astype(np.uint64), w.astype(np.uint64))
        back = np.where(back < 0, back, lower.backoff(c_v.astype(float)))
        p = np.where(found, p, back + single)
        out, at = [], 0
        for b in blocks:
            runs = b["runs"].astype(np.int64)
            each = p[at : at + runs.sum()] * b["times"]
            at += runs.sum()
            start = np.concatenate([[0], np.cumsum(runs)[:-1]])
            out.append((b["chunk"], SUMS, int(rows[0][0]), pack(doc=np.cumsum(b["doc"].astype(np.int64)), score=np.add.reduceat(each, start))))
        return pa.Table.from_batches([moved(out)])

    return score


RESULT = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def add_up(group: pa.Table) -> pa.Table:
    """In a chunk: its documents with the sums of all shards, in order of shard."""
    rows = sorted(as_rows(group), key=lambda r: r[2])
    own = unpack(rows[0][3])
    score = own["score"].astype(float)
    for _, _, _, payload in rows[1:]:
        part = unpack(payload)
        score[part["doc"]] += part["score"]
    return pa.table(
        {
            "id": pa.array(own["ids"], mask=own["missing"], type=pa.int64()),
            "held_out": pa.array(own["held"]),
            "n_tokens": pa.array(own["n_tokens"].astype(np.int64)),
            "n_known": pa.array(own["n_known"]),
            "base_score": pa.array(own["base"]),
            "score": pa.array(score),
        }
    )


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, base and model score of every row; rows with ``held_out`` teach nothing."""
    spark = docs.sparkSession
    workers_find_us(spark)
    chunks = checkpointed(cut(docs, key, text, held_out))
    tokens = chunks.where(F.col("kind") == TEXTS).agg(F.sum(F.col("part").cast("long"))).first()[0] or 0
    shards = max(1, -(-tokens // SHARD_TOKENS))
    counted = checkpointed(chunks.mapInArrow(ask_words(shards), MOVED).groupBy("key").applyInArrow(count_words(shards), MOVED))
    stats = [unpack(bytes(r["payload"])) for r in counted.where(F.col("kind") == STATS).select("payload").toLocalIterator()]
    lower = Lower(stats)
    with_counts = chunks.where(F.col("kind") == TEXTS).unionByName(counted.where(F.col("kind") == COUNTS))
    asked = with_counts.groupBy("key").applyInArrow(ask_pairs(lower, shards), MOVED)
    # sums a chunk made itself keep their own key, beside the shards
    asked = asked.withColumn("to", F.when(F.col("kind") == SUMS, -1 - F.col("key")).otherwise(F.col("key")))
    summed = asked.groupBy("to").applyInArrow(lambda g: score_pairs(lower)(g.drop(["to"])), MOVED)
    done = summed.groupBy("key").applyInArrow(add_up, RESULT)
    return done.select(
        F.col("id").alias(key), "held_out", "n_tokens", "n_known", F.lit(lower.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


@query("op5_elias_fano")
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return score(docs, crc_mod("doc_id", 7) == 2)
