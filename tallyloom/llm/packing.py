"""Packing of documents into sequences by swap-based local search (operator 11).

A document is the ids of its whole text and an end id. One longer than a sequence is cut into
pieces of exactly the sequence's width, of which the first may be shorter; nothing else is cut.

Pieces of equal length can stand in for each other, so bins that hold the same lengths are one
entry with a count, and a table of any size becomes at most ``width`` lengths with counts. Best
fit by falling length gives the first bins. The local search then goes on between underfull bins:
the emptiest bins give a piece away, exchange one for one, one for two or two for one with fuller
bins, for as many bins of the same kind at once as there are, always so that the sum of squared
fills rises, until bins run empty or no exchange helps. Where none does, a piece may first go against
two of a full bin that are as long together and move on in parts. What results is a list of bins per kind.
Every piece then takes the place that its rank among the pieces of its length stands for: ranks
are counted per partition and added up, so no length is gathered in one task.

Only the counts per length travel to the driver. The plan that goes back holds an entry per kind
of bin and length; best fit makes at most a few kinds per length and an exchange at most two more,
so its size is bounded by ``width`` and ``steps`` and does not grow with the table.

Defined results: a null text is empty, so its document is the end id alone; null and repeated ids
are rows like any other; equal lengths take places in order of the partitions read; a special token's
string in a text is read as the tokenizer reads it; a text of any length is encoded whole; an
empty table gives an empty result; other columns of the table, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..operators.rank import exact_rank
from ..session import checkpointed
from .common import give_back, query, sliced, table, workers_find_us

VOCABULARY = "byte_bpe_50k.json"

#: Before an ASCII blank that is followed by a byte which surely begins no blank, every match of a
#: byte-level splitting pattern ends, so what lies between such places is encoded part by part.
BLANK, SURE = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
SURE[0x21:0x7F] = SURE[0xC3:0xE1] = True


@dataclass
class Settings:
    width: int = 1024
    end: int = 2  #: id that closes a document
    steps: int = 6000  #: most exchanges of the local search; one moves all bins of a kind
    slice_bytes: int = 12 << 20  #: text whose distinct parts are encoded together
    remembered: int = 1 << 20  #: distinct parts a worker keeps the ids of


# --- ids ------------------------------------------------------------------------------------------


def ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count[i]`` numbers from ``begin[i]`` on, for every ``i``."""
    upto = np.cumsum(count)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin - upto + count, count)


class Encoder:
    """Ids of whole texts; distinct parts are encoded once, as long as they are remembered."""

    def __init__(self, path: str, remembered: int = Settings.remembered):
        self.remembered = remembered
        self.forget()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)  #: a byte-level token has a letter per byte
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)

    def forget(self) -> None:
        #: parts, their ids, and where each part's ids begin
        self.known, self.ids, self.at = pa.array([], pa.large_binary()), np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    def _ids(self, texts: list[str], some: int = 16) -> Iterator[np.ndarray]:
        for i in range(0, len(texts), some):  # what the tokenizer returns is much larger than the ids
            for e in self.tokenizer.encode_batch_fast(texts[i : i + some], add_special_tokens=False):
                yield np.array(e.ids, dtype="<u4")

    def learn(self, words: pa.Array, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of ``words`` and where they begin, and which of these beginnings each word has.

        Unknown words are encoded; those met ``often`` are remembered.
        """
        if len(self.known) > self.remembered:
            self.forget()
        place = pc.index_in(words, value_set=self.known)
        unknown = np.asarray(pc.is_null(place))
        place = np.array(pc.fill_null(place, -1))
        if not unknown.any():
            return self.ids, self.at, place
        new, often = words.filter(pa.array(unknown)), often[unknown]
        bounds = np.frombuffer(new.buffers()[1], dtype=np.int64)[new.offset : new.offset + len(new) + 1]
        ids, at = self.parts(np.frombuffer(new.buffers()[2], dtype=np.uint8), bounds)
        place[unknown] = len(self.known) + np.arange(len(new))
        all_ids, all_at = np.concatenate([self.ids, ids]), np.concatenate([self.at, self.at[-1] + at[1:]])
        self.known = pa.concat_arrays([self.known, new.filter(pa.array(often))])
        self.ids = np.concatenate([self.ids, ids[ragged(at[:-1][often], np.diff(at)[often])]])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.diff(at)[often])])
        return all_ids, all_at, place

    def parts(self, data: np.ndarray, bounds: np.ndarray, together: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts ``data[bounds[i]:bounds[i + 1]]``, and where each part's begin."""
        n = len(bounds) - 1
        size = np.diff(bounds)
        first, second = data[bounds[:-1]], data[np.minimum(bounds[:-1] + 1, len(data) - 1)]
        apart = ~(BLANK[first] & SURE[second] & (size > 1))  # may not follow another part
        # parts in a row go into one text: up to ``together``, and those apart alone
        cuts = np.unique(np.concatenate([np.arange(0, n, together), np.flatnonzero(apart), np.flatnonzero(apart) + 1, [n]]))
        cuts = cuts[cuts <= n]
        whole = data.tobytes()
        texts = [whole[bounds[a] : bounds[b]].decode() for a, b in zip(cuts[:-1], cuts[1:])]
        ids = np.concatenate([*self._ids(texts), np.zeros(0, dtype="<u4")])
        ends = np.cumsum(self.bytes[ids])
        at = np.concatenate([[0], np.searchsorted(ends, bounds[1:] - bounds[0]) + 1])
        if n and (ends[at[1:] - 1] != bounds[1:] - bounds[0]).any():
            raise ValueError("the tokenizer joined parts: its splitting pattern isn't byte-level")
        return ids, at

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; a null is an empty one."""
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        n = len(texts)
        edges = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        if edges[-1] == edges[0]:
            yield from [np.zeros(0, dtype="<u4")] * n
            return
        raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        begins = np.zeros(len(raw), dtype=bool)
        begins[:-1] = BLANK[raw[:-1]] & SURE[raw[1:]]
        inner = edges[(edges > 0) & (edges < len(raw))]
        begins[inner - 1] = False  # what follows there is another text
        begins[edges[edges < len(raw)]] = True
        bounds = np.append(np.flatnonzero(begins), len(raw))
        flat = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)])
        coded = flat.dictionary_encode()
        codes = np.asarray(coded.indices)
        ids, at, place = self.learn(coded.dictionary, np.bincount(codes, minlength=len(coded.dictionary)) > 1)
        begin, count = at[place], at[place + 1] - at[place]
        first = np.searchsorted(bounds[:-1], edges)
        for a, b in zip(first[:-1], first[1:]):
            mine = codes[a:b]
            yield ids[ragged(begin[mine], count[mine])]


@lru_cache(maxsize=1)
def encoder(path: str, remembered: int) -> Encoder:
    """A worker keeps its tokenizer from task to task."""
    return Encoder(path, remembered)


def cut(n: int, width: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of ``n`` ids."""
    first = n if n <= width else n % width or width
    return [(0, first)] + [(at, width) for at in range(first, n, width)]


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, s: Settings | None = None) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``."""
    s = s or Settings()
    workers_find_us(df.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)
    end = np.array([s.end], dtype="<u4").tobytes()

    def measure(texts: pa.Array) -> pa.Array:
        at, start, length, crc = [0], [], [], []
        for ids in encoder(path, s.remembered)(texts):
            packed = memoryview(ids.tobytes() + end)
            for a, n in cut(len(ids) + 1, s.width):
                start.append(a)
                length.append(n)
                crc.append(zlib.crc32(packed[4 * a : 4 * (a + n)]))
            at.append(len(start))
        values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, crc)], names=["start", "length", "ids_crc32"])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)

    @F.arrow_udf("array<struct<start:bigint,length:bigint,ids_crc32:bigint>>")
    def measured(texts: pa.Array) -> pa.Array:
        return give_back(sliced(measure, s.slice_bytes)(texts))

    found = df.select(F.col(key).alias("doc_id"), measured(F.col(text)).alias("found"))
    return found.select("doc_id", F.posexplode("found").alias("piece", "p")).select("doc_id", "piece", "p.start", "p.length", "p.ids_crc32")


# --- bins -----------------------------------------------------------------------------------------

#: a kind of bin: lengths in it, falling, each with the number of pieces of that length
Kind = tuple[tuple[int, int], ...]


def fill(kind: Kind) -> int:
    return sum(size * copies for size, copies in kind)


def changed(kind: Kind, out: tuple[int, ...], into: tuple[int, ...]) -> Kind:
    """The kind after pieces of the lengths ``out`` have left and ``into`` have come."""
    held = dict(kind)
    for x in out:
        held[x] -= 1
    for x in into:
        held[x] = held.get(x, 0) + 1
    return tuple(sorted(((x, n) for x, n in held.items() if n), reverse=True))


def best_fit(counts: Mapping[int, int], width: int) -> dict[Kind, int]:
    """Bins by best fit of falling lengths; equal bins are filled together."""
    room: list[dict[Kind, int]] = [{} for _ in range(width + 1)]

    def put(kind: Kind, rest: int, n: int) -> None:
        if n:
            room[rest][kind] = room[rest].get(kind, 0) + n

    for size in sorted(counts, reverse=True):
        left = counts[size]
        at = size
        while left:
            while at <= width and not room[at]:
                at += 1
            if at > width:  # no bin has room for one more
                copies = width // size
                put(((size, copies),), width - copies * size, left // copies)
                if left % copies:
                    put(((size, left % copies),), width - left % copies * size, 1)
                break
            kind, n = room[at].popitem()
            copies = at // size
            k = min(n, left // copies)
            put(kind + ((size, copies),), at - copies * size, k)
            left -= k * copies
            if k < n and left:  # fewer are left than this bin takes
                put(kind + ((size, left),), at - left * size, 1)
                k, left = k + 1, 0
            put(kind, at, n - k)
    return {kind: n for kinds in room for kind, n in kinds.items()}


class Search:
    """Local search between underfull bins."""

    def __init__(self, kinds: Mapping[Kind, int], width: int):
        self.width = width
        self.full: dict[Kind, int] = {}
        self.splits: dict[int, list[tuple[int, int, Kind]]] | None = None  #: pairs in bins that were full at first
        self.count: dict[Kind, int] = {}
        self.offers: dict[Kind, np.ndarray] = {}
        self.order: list[tuple[int, Kind]] = []
        for kind, n in kinds.items():
            self.add(kind, n)

    def add(self, kind: Kind, n: int) -> None:
        if not n or not kind:
            return
        if fill(kind) == self.width:
            self.full[kind] = self.full.get(kind, 0) + n
            return
        if kind not in self.count:
            self.count[kind] = 0
            self.offers[kind] = self.returns(kind)
            heapq.heappush(self.order, (fill(kind), kind))
        self.count[kind] += n

    def take(self, kind: Kind, n: int) -> None:
        if kind in self.full:
            self.full[kind] -= n
            return
        self.count[kind] -= n
        if not self.count[kind]:
            del self.count[kind], self.offers[kind]

    @staticmethod
    def pairs(kind: Kind) -> list[tuple[int, int]]:
        sizes = [x for x, _ in kind]
        return [(x, y) for i, x in enumerate(sizes) for y in sizes[i + 1 :]] + [(x, x) for x, n in kind if n > 1]

    def returns(self, kind: Kind) -> np.ndarray:
        """What a bin of this kind can give back: columns of how many, first and second length, room and fill."""
        rows = [(0, 0, 0)] + [(1, x, 0) for x, _ in kind] + [(2, x, y) for x, y in self.pairs(kind)]
        out = np.zeros((len(rows), 5), dtype=np.int64)
        out[:, :3] = rows
        out[:, 3], out[:, 4] = self.width - fill(kind), fill(kind)
        return out

    def exchange(self, giver: Kind):
        """The exchange from ``giver`` into a bin at least as full that raises the squared fill most."""
        own = fill(giver)
        takers = [k for k in self.count if fill(k) >= own and (k != giver or self.count[k] > 1)]
        if not takers:
            return None
        rows = np.concatenate([self.offers[k] for k in takers])
        which = np.repeat(np.arange(len(takers)), [len(self.offers[k]) for k in takers])
        back = rows[:, 1] + rows[:, 2]
        best, found = 0, None
        for out in [(x,) for x, _ in giver] + self.pairs(giver):
            net = sum(out) - back
            gain = 2 * net * (rows[:, 4] - own + net)
            # two pieces go against one, a single one against none, one or two
            gain[(net <= 0) | (net > rows[:, 3]) | (rows[:, 0] != 1 if len(out) == 2 else False)] = 0
            i = int(gain.argmax())
            if gain[i] > best:
                best, found = int(gain[i]), (takers[which[i]], out, tuple(int(x) for x in rows[i, 1 : 1 + rows[i, 0]]))
        return found

    def detour(self, giver: Kind):
        """A piece of ``giver`` against two of a full bin that are as long together, one of which fits
        into a bin at least as full: the first exchange keeps the squared fill, the move raises it."""
        own = fill(giver)
        takers = sorted(((self.width - fill(k), k) for k in self.count if fill(k) >= own and k != giver))
        if not takers:
            return None
        most = takers[-1][0]
        if self.splits is None:
            self.splits = {}
            for kind in self.full:
                for x, y in self.pairs(kind):
                    self.splits.setdefault(x + y, []).append((y, x, kind))
            for found in self.splits.values():
                found.sort(reverse=True)
        best, found = 0, None
        for whole, _ in giver:
            for y, x, kind in self.splits.get(whole, []):
                if self.full.get(kind, 0) and best < y <= most:
                    best, found = y, (kind, whole, x, y, next(k for room, k in takers if room >= y))
                    break
        return found

    def apply(self, *changes: tuple[Kind, tuple[int, ...], tuple[int, ...]]) -> None:
        """What leaves and comes, for as many bins of these kinds at once as there are."""
        asked: dict[Kind, int] = {}
        for kind, _, _ in changes:
            asked[kind] = asked.get(kind, 0) + 1
        n = min((self.count.get(k) or self.full[k]) // times for k, times in asked.items())
        for kind, _, _ in changes:
            self.take(kind, n)
        for kind, out, into in changes:
            self.add(changed(kind, out, into), n)

    def run(self, steps: int) -> dict[Kind, int]:
        pieces = {**self.full, **{k: self.full.get(k, 0) + n for k, n in self.count.items()}}
        least = -(-sum(fill(k) * n for k, n in pieces.items()) // self.width)
        stuck: list[tuple[int, Kind]] = []
        while steps and self.order and sum(self.full.values()) + sum(self.count.values()) > least:
            own, giver = self.order[0]
            if giver not in self.count:
                heapq.heappop(self.order)
                continue
            if found := self.exchange(giver):
                taker, out, into = found
                self.apply((giver, out, into), (taker, into, out))
            elif found := self.detour(giver):
                kind, whole, x, y, taker = found
                self.apply((giver, (whole,), (x,)), (kind, (x, y), (whole,)), (taker, (), (y,)))
            else:  # another exchange may make one possible here
                stuck.append(heapq.heappop(self.order))
                continue
            for entry in stuck:
                heapq.heappush(self.order, entry)
            stuck.clear()
            steps -= 1
        result = {k: n for k, n in self.full.items() if n}
        for kind, n in self.count.items():
            result[kind] = result.get(kind, 0) + n
        return result


def bins(counts: Mapping[int, int], s: Settings) -> dict[Kind, int]:
    """Kinds of bins and how many of each hold all pieces of the given lengths."""
    return Search(best_fit(counts, s.width), s.width).run(s.steps)


@dataclass
class Places:
    """Where the pieces of each length go: the ``i``-th of them stands at ``first[length] + i`` on a
    line that is cut into runs, one per kind of bin and length."""

    first: np.ndarray  #: by length
    begin: np.ndarray  #: of the runs, rising
    size: np.ndarray
    copies: np.ndarray  #: per bin
    sequence: np.ndarray  #: number of the kind's first bin
    offset: np.ndarray  #: of the first copy

    def at(self, length: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        line = self.first[length] + i
        run = np.searchsorted(self.begin, line, side="right") - 1
        k = line - self.begin[run]
        return self.sequence[run] + k // self.copies[run], self.offset[run] + k % self.copies[run] * self.size[run]


def places(kinds: Mapping[Kind, int], width: int) -> Places:
    runs, sequence = [], 0
    for kind in sorted(kinds):
        offset = 0
        for size, copies in kind:
            runs.append((size, copies, sequence, offset, copies * kinds[kind]))
            offset += size * copies
        sequence += kinds[kind]
    runs.sort()
    size, copies, first_bin, offset, n = (np.array(x, dtype=np.int64) for x in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 5
    begin = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if len(n) else n
    first = np.zeros(width + 1, dtype=np.int64)
    for length, b in zip(size[::-1], begin[::-1]):
        first[length] = b
    return Places(first, begin, size, copies, first_bin, offset)


def pack(cut_pieces: DataFrame, s: Settings | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``width``."""
    s = s or Settings()
    spark = cut_pieces.sparkSession
    workers_find_us(spark)
    rows = checkpointed(cut_pieces.withColumn("__row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    held = spark.sparkContext.broadcast(places(bins(counts, s), s.width))
    ranked = exact_rank(rows, [F.col("__row")], [F.shiftright("__row", 33)], by=["length"], name="__rank")

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def placed(length: pa.Array, rank: pa.Array) -> pa.Array:
        sequence, offset = held.value.at(np.asarray(length), np.asarray(rank) - 1)
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    done = ranked.withColumn("__place", placed("length", "__rank"))
    return done.select(*cut_pieces.columns, "__place.sequence_id", "__place.offset")


@query("op11_swap_packing")
def _(spark, folder):
    return pack(pieces(table(spark, folder, "documents")))
