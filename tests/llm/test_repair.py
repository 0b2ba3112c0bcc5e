"""Conversation repair against a search over all edits, turn by turn."""

import hashlib
import heapq
import random
import zlib

from tallyloom.llm import repair as R
from tallyloom.llm.common import QUERIES

BLANK = " \t\n\v\f\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def harm(rows):
    """Damaged rows per conversation id, by the rules read literally."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def first_faults(turns):
    out, seen = [], set()
    for _, role, text in turns:
        end = text.rstrip(BLANK)[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(turns, found):
    """Dijkstra over (turns done, last initial), ties by the audit; what stands is carried along."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, last, stands = heapq.heappop(queue)
        if i == len(turns) and last in ("", "a"):
            return cost, audit, stands
        if (i, last) in done:
            continue
        done.add((i, last))
        for x in "ua":
            if (last, x) in NEXT:
                heapq.heappush(queue, (cost + 5, audit + "I", i, x, stands + (f"{NAMES[x]}:",)))
        if i < len(turns):
            _, role, text = turns[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, last, stands))
            if found[i] not in ("blank", "duplicate"):
                extra = 5 if found[i] else 0
                if (last, role[:1]) in NEXT:
                    heapq.heappush(queue, (cost + extra, audit + "K", i + 1, role[0], stands + (f"{role}:{text}",)))
                for x in "ua":
                    if (last, x) in NEXT:
                        heapq.heappush(queue, (cost + 1 + extra, audit + "R", i + 1, x, stands + (f"{NAMES[x]}:{text}",)))


def expected(rows, harmed=True):
    out = []
    for conv, turns in harm(rows).items():
        found = first_faults(turns)
        cost, audit, stands = cheapest(turns, found)
        known = [t for t, _, _ in turns if t is not None]
        initials = [r[:1] for _, r, _ in turns]
        out.append((
            conv,
            max(known) - min(known) + 1 - len(set(known)) if known else 0,
            *(found.count(x) for x in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(stands).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string, key string, part int, cost string, audit string"


def answer(spark, rows, width):
    df = spark.createDataFrame([(*r, "k", 1, "c", "a") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in R.mended(df, R.damaged(df), "conv_id", width)[0].collect()), key=str)


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "user two", None])
            text = rng.choice(["Yes.", "No!", "Why? ", "open", " \t\n", "", f"Turn {turn}.", f"cut {turn}", None, "é.", "x" * 30000 + "."])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None, 0]), role, text))
    return rows


def test_every_damage_fault_and_edit_against_a_search_over_all_edits(spark):
    rows = conversations(1, 250, 9)
    want = expected(rows)
    assert {e for w in want for e in w[7]} >= {"D", "K", "R"} and any(w[1] for w in want)
    assert answer(spark, rows, 128) == want


def test_parts_of_any_width_give_the_same(spark):
    rows = conversations(2, 25, 60) + [(99, t, "user" if t % 2 else "assistant", f"Said {t % 70}.") for t in range(700)]
    want = expected(rows)
    assert answer(spark, rows, 7) == want


def test_nodes_agree_with_the_search_for_short_signatures_and_insertions():
    rng = random.Random(3)
    node_of = R.Suffixes()
    for _ in range(400):
        signature = "".join(rng.choice("dsuaoSUAO") for _ in range(rng.randint(0, 7)))
        turns = [(0, x.lower(), "") for x in signature]
        faults = ["blank" if x == "d" else "truncated" if x.isupper() else None for x in signature]
        cost, audit, _ = cheapest(turns, faults)
        node = node_of(signature)
        assert min(node[0][z] for z in R.ENDS) == (cost, audit)
    # the whole matrix: what is left out by the parts' ends shows in a lone user turn
    assert node_of("u")[0][3] == (5, "KI") and node_of("u")[0][0] == (2, "D")


def test_common_suffixes_are_worked_out_once():
    node_of = R.Suffixes()
    names = sorted(("su" + "ua" * 20, "ua" * 20, "oua" + "ua" * 20, "a"), key=lambda x: x[::-1])
    for name in names:
        node_of(name)
    assert node_of.made < len("".join(names)) / 2


def test_ropes_compare_like_their_strings():
    rng = random.Random(4)
    shared = R.Rope("KD", None)
    for _ in range(500):
        def rope():
            r = rng.choice([None, shared])
            for _ in range(rng.randint(0, 3)):
                r = R.Rope("".join(rng.choice("DK") for _ in range(rng.randint(0, 3))), r)
            return r
        a, b = rope(), rope()
        x, y = ("".join(r.parts()) if r else "" for r in (a, b))
        assert R.compare(a, b) == (x > y) - (x < y)


def test_nulls_no_rows_after_damage_and_no_rows_at_all(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Gone."), (None, None, None, None), (None, 3, "user", "A."), (None, 4, "assistant", "B.")]
    want = expected(rows)
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in want
    assert answer(spark, rows, 128) == want
    assert answer(spark, [], 128) == []


def test_undamaged_table_and_its_repaired_texts(spark):
    df = spark.createDataFrame([(1, 1, "user", "A.", "", 0, "", ""), (1, 2, "user", "B.", "", 0, "", ""), (1, 3, "user", "B.", "", 0, "", "")], SCHEMA)
    report, texts = R.repair(df)
    row = report.first()
    assert (row["duplicate"], row["illegal"], row["cost"], row["audit"]) == (1, 2, 3, "KRD")
    assert [r["text"] for r in texts.collect()] == ["user:A.\nassistant:B."]


def test_query_on_the_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op12_suffix_dawg"](spark, folder).collect()), key=str)
    assert got == expected(rows)
