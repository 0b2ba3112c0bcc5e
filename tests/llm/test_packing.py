"""Packing against the tokenizer, the rules of a packing and plain searches."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tallyloom.llm import packing as P
from tallyloom.llm.common import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
ENCODE = P.Encoder(PATH, remembered=300)  # forgets now and then


def encoded(*texts):
    return [ids.tolist() for ids in ENCODE(pa.array(texts, pa.string()))]


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def check_packing(rows, texts, width=1024, tokens=ids_of):
    """Every piece as the rules say, and sequences without gaps."""
    want = Counter()
    for key, text in texts:
        ids = tokens(text) + [2]
        first = len(ids) if len(ids) <= width else len(ids) % width or width
        cuts = [0, *range(first, len(ids), width), len(ids)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[key, i, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= width
    return len(sequences)


ODD = list("ab'sé ß\t\n\r\x0b\x0c\x1c\x7f\x85\xa0\u2003\u3000\u1680\u180e1½!<|中̈")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(ODD), max_size=40)), max_size=6))
def test_parts_encode_like_the_whole_texts(texts):
    assert encoded(*texts) == [ids_of(t) for t in texts]


def test_long_and_special_texts_encode_like_the_tokenizer():
    rng = random.Random(1)
    words = ["der", "l'été", "don't", "x" * 300, "<|endoftext|>", "中文", "12,5", "=" * 60]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\n\n ", "\t", "\u2003 ", ""]) for _ in range(800)) for _ in range(30)]
    assert encoded(*texts) == [ids_of(t) for t in texts]
    array = pa.array(["left out", *texts, None, "", "last"])
    assert [x.tolist() for x in ENCODE(array.slice(1))] == [ids_of(t) for t in (*texts, "", "", "last")]


def plain_best_fit(sizes, width):
    rooms = []
    for size in sorted(sizes, reverse=True):
        fitting = [i for i, r in enumerate(rooms) if r >= size]
        if fitting:
            rooms[min(fitting, key=lambda i: rooms[i])] -= size
        else:
            rooms.append(width - size)
    return sorted(rooms)


def contents(kinds):
    out = Counter()
    for kind, n in kinds.items():
        assert n > 0
        for size, copies in kind:
            out[size] += copies * n
    return out


def test_counted_best_fit_fills_like_the_plain_one():
    rng = random.Random(2)
    for _ in range(200):
        width = rng.choice([10, 37, 100])
        sizes = [rng.randint(1, width) for _ in range(rng.randint(0, 120))]
        kinds = P.best_fit(Counter(sizes), width)
        assert contents(kinds) == Counter(sizes)
        assert sorted(width - P.fill(k) for k, n in kinds.items() for _ in range(n)) == plain_best_fit(sizes, width)


def test_local_search_loses_nothing_and_raises_the_squared_fill():
    rng = random.Random(3)
    saved = 0
    for _ in range(150):
        width = rng.choice([20, 60, 1024])
        counts = Counter({rng.randint(1, width): rng.randint(1, 9) for _ in range(rng.randint(1, 40))})
        before = P.best_fit(counts, width)
        after = P.Search(before, width).run(2000)
        assert contents(after) == counts and all(P.fill(k) <= width for k in after)
        squares = [sum(P.fill(k) ** 2 * n for k, n in x.items()) for x in (before, after)]
        assert squares[1] >= squares[0]
        saved += sum(before.values()) - sum(after.values())
        assert sum(after.values()) <= sum(before.values())
    assert saved > 0


def test_search_empties_a_bin_by_every_kind_of_exchange():
    for bins in (
        {((6, 1), (2, 1)): 1, ((3, 1), (2, 2)): 1, ((2, 2),): 1},  # moves
        {((7, 1),): 1, ((5, 1), (3, 1)): 1, ((4, 1),): 1, ((1, 1),): 1},
    ):
        kinds = P.Search(bins, 10).run(100)
        assert contents(kinds) == contents(bins) and sum(kinds.values()) == 2
    # one for one: 4 of the emptier bin against 3
    assert P.Search({((5, 1), (3, 1)): 1, ((4, 1),): 1}, 9).exchange(((4, 1),)) == (((5, 1), (3, 1)), (4,), (3,))
    # two for one, either way
    assert P.Search({((4, 2),): 1, ((3, 2),): 1}, 10).exchange(((3, 2),))[1:] == ((3, 3), (4,))
    assert P.Search({((6, 1), (2, 1), (1, 1)): 1, ((4, 1),): 1}, 10).exchange(((4, 1),))[1:] == ((4,), (2, 1))


def test_few_bins_are_as_few_as_can_be():
    rng = random.Random(4)

    def least(sizes, width):
        best = [len(sizes)]

        def go(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(rooms)
                return
            for j in {r: j for j, r in enumerate(rooms) if r >= sizes[i]}.values():
                go(i + 1, rooms[:j] + [rooms[j] - sizes[i]] + rooms[j + 1 :])
            go(i + 1, rooms + [width - sizes[i]])

        go(0, [])
        return best[0]

    over = 0
    for _ in range(60):
        sizes = sorted((rng.randint(1, 30) for _ in range(10)), reverse=True)
        over += sum(P.bins(Counter(sizes), P.Settings(width=30)).values()) - least(sizes, 30)
    assert over <= 2


def test_counts_of_any_size_take_no_longer():
    counts = Counter({x: 10**9 + 7 * x for x in range(1, 1025)})
    kinds = P.bins(counts, P.Settings(steps=200))
    assert contents(kinds) == counts and len(kinds) < 1024 * 4
    total = sum(x * n for x, n in counts.items())
    assert sum(kinds.values()) * 1024 <= total * 1.001


SCHEMA = "doc_id long, text string, piece string, length string, sequence_id int, found string, p int"


def test_nulls_repeats_long_texts_and_clashing_names(spark):
    rng = random.Random(5)
    texts = [(None, "no id"), (1, None), (2, ""), (3, "again"), (3, "again"), (3, "other")]
    texts += [(10 + i, " ".join(rng.choice(["the", "été", "q8", "ng-ram"]) for _ in range(rng.randint(1, 1500)))) for i in range(60)]
    texts += [(99, "letters " * 50_000), (98, "a" * 20_000)] + [(200, "same " * 600)] * 40
    df = spark.createDataFrame([(k, t, "x", "y", 1, "z", 2) for k, t in texts], SCHEMA).repartition(5)
    rows = P.pack(P.pieces(df)).collect()
    assert check_packing(rows, texts) <= len(plain_best_fit([r["length"] for r in rows], 1024))
    assert P.pack(P.pieces(df.limit(0))).collect() == []


def test_query_on_the_table(spark, folder):
    texts = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op11_swap_packing"](spark, folder).collect()
    assert check_packing(rows, texts) <= 1.01 * sum(r["length"] for r in rows) / 1024 + 1
