"""Conversation structure repair over a suffix-shared automaton (operator 12).

A conversation is a row of symbols: per turn the initial of its role (system, user, assistant,
other) and whether it is truncated, or that it must go (blank, or said before). Repairs keep,
re-role, delete or insert turns until the initials read ``(s?(ua)+)?``; the cheapest repair is
sought, of equally cheap ones the one whose initials come first in ASCII.

What the rest of a conversation costs depends on its symbols from there on and on the grammar
state alone. So the signatures of all conversations are read from the end: sorted by their reversed
symbols, each shares the longest known suffix with the one before, and an automaton node, which is
one suffix, is worked out once: for each grammar state before it and after it the cost-to-go and the
best audit suffix. Only the nodes of the current suffix are held.

Long conversations are cut into parts of at most ``width`` turns; parts are signatures like any
others, and a conversation's parts are then joined from its last to its first in one streamed
pass: for equal state before and after, the cheaper (then ASCII-less) part is right whatever
follows, as no audit of equal cost starts with another one. The digest reads the repaired turns in
order as a stream too, so a conversation is never held whole except for its own audit, which is
one value of the result.

Defined results: conversations are those of equal id, null being one; null turns come first; rows
that share a turn stand in order of role and text, a repeat after its original; a null role or text
is one space; roles are known by their first letter in lower case; an insertion is an empty
turn; an empty table gives an empty result; other columns of the table are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.rank import exact_rank
from ..session import checkpointed
from .common import query, table, workers_find_us

#: what separates words
BLANKS = " \t\n\v\f\r"

#: grammar states: at the start, after s, after u, after a; what each may be followed by
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS = (0, 3)
ROLE = {"u": "user", "a": "assistant"}

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5


# --- damage and faults ----------------------------------------------------------------------------


def _spaced(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def _key(c: Column) -> Column:
    """Tells a null id from any other."""
    return F.coalesce(F.concat(F.lit("c"), c.cast("string")), F.lit(""))


def damaged(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Columns ``key turn role text copy``: rows dropped, emptied, cut short, repeated or re-roled by their id and turn."""
    kind = F.crc32(F.concat(_spaced(F.col(conversation)), F.lit(":"), _spaced(F.col(turn))).cast("binary")) % 20
    words = _spaced(F.col(text))
    rows = df.select(
        _key(F.col(conversation)).alias("key"),
        F.col(turn).cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(_spaced(F.col(role))).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(words, ".!?", "")).otherwise(words).alias("text"),
        kind.alias("kind"),
    ).where("kind <> 0")
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("key", "turn", "role", "text", F.explode(copies).alias("copy"))


def faults(rows: DataFrame) -> DataFrame:
    """Add the place ``pos`` in the conversation, ``initial`` and the first ``fault`` of every row.

    Takes the columns of :func:`damaged`.
    """
    said = F.rtrim(F.col("text"), F.lit(BLANKS))
    place = F.coalesce(F.col("turn"), F.lit(-(2**62)))
    tie = F.sha1(F.concat_ws("|", "role", "text"))
    rows = checkpointed(rows.withColumn("place", place).withColumn("digest", tie))  # read three times below
    ranked = exact_rank(
        rows,
        [F.col("place"), F.col("role"), F.col("text"), F.col("copy")],
        [F.shiftright("place", 16), F.col("place")],
        by=["key"],
        name="pos",
    )
    ranked = checkpointed(ranked)
    # the first of equal rows of a conversation; its place is unique, so no hot text meets in a join
    first = ranked.groupBy("key", "role", "digest").agg(F.min("pos").alias("pos")).select("key", "pos", F.lit(True).alias("first"))
    marked = ranked.join(first, ["key", "pos"], "left")
    letter = F.substring("role", 1, 1)
    return marked.select(
        "key",
        "pos",
        "turn",
        "role",
        "text",
        F.when(letter.isin("s", "u", "a"), letter).otherwise("o").alias("initial"),
        F.when(said == "", "blank")
        .when(F.col("first").isNull(), "duplicate")
        .when(~F.substring(said, -1, 1).isin(".", "!", "?"), "truncated")
        .alias("fault"),
    )


# --- the automaton --------------------------------------------------------------------------------

#: of each state before and after: cost and audit, or nothing
Node = tuple[tuple[tuple[int, str] | None, ...], ...]


def _better(a: tuple[int, str] | None, b: tuple[int, str] | None) -> tuple[int, str] | None:
    return min((x for x in (a, b) if x is not None), default=None)


def _insertions(rows: list[list]) -> Node:
    """The states with turns inserted before what follows; three reach every state there is."""
    for _ in range(3):
        rows = [
            [
                _better(rows[q][z], min(((rows[t][z][0] + INSERT, "I" + rows[t][z][1]) for x, t in NEXT[q].items() if x in ROLE and rows[t][z] is not None), default=None))
                for z in range(4)
            ]
            for q in range(4)
        ]
    return tuple(tuple(r) for r in rows)


def empty_node() -> Node:
    """The node of the empty suffix: nothing is left but insertions."""
    return _insertions([[(0, "") if q == z else None for z in range(4)] for q in range(4)])


def node_before(symbol: str, node: Node) -> Node:
    """The node of ``symbol`` and the suffix that ``node`` stands for.

    ``d`` is a turn that must go; ``s u a o`` the initials, in capitals where truncated.
    """
    letter, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    rows = []
    for q in range(4):
        row = []
        for z in range(4):
            found = [(node[q][z][0] + DELETE, "D" + node[q][z][1])] if node[q][z] else []
            if symbol != "d":
                for x, t in NEXT[q].items():
                    if (rest := node[t][z]) is None:
                        continue
                    if x == letter:
                        found.append((rest[0] + KEEP + extra, "K" + rest[1]))
                    if x in ROLE:
                        found.append((rest[0] + REROLE + extra, "R" + rest[1]))
            row.append(min(found, default=None))
        rows.append(row)
    return _insertions(rows)


class Suffixes:
    """Nodes of the suffixes of the signature last asked for; common suffixes are not worked out again."""

    def __init__(self):
        self.symbols: list[str] = []  #: from the end
        self.nodes: list[Node] = [empty_node()]
        self.made = 0

    def __call__(self, signature: str) -> Node:
        wanted = signature[::-1]
        shared = 0
        while shared < min(len(wanted), len(self.symbols)) and wanted[shared] == self.symbols[shared]:
            shared += 1
        del self.symbols[shared:], self.nodes[shared + 1 :]
        for symbol in wanted[shared:]:
            self.symbols.append(symbol)
            self.nodes.append(node_before(symbol, self.nodes[-1]))
            self.made += 1
        return self.nodes[-1]


COST, AUDIT = "array<int>", "array<string>"


def automaton(signatures: DataFrame) -> DataFrame:
    """Per distinct ``signature`` the ``costs`` and ``audits`` of its node, sixteen each (state before x state after)."""

    def worked_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node_of = Suffixes()
        for b in batches:
            names = b.column(0).to_pylist()
            flat = [[x for row in node_of(name) for x in row] for name in names]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([[x and x[0] for x in f] for f in flat], pa.list_(pa.int32())), pa.array([[x and x[1] for x in f] for f in flat], pa.list_(pa.string()))],
                names=["signature", "costs", "audits"],
            )

    distinct = signatures.select("signature").distinct().withColumn("back", F.reverse("signature"))
    ordered = distinct.repartitionByRange("back").sortWithinPartitions("back").select("signature")
    return ordered.mapInArrow(worked_out, f"signature string, costs {COST}, audits {AUDIT}")


# --- from parts to conversations --------------------------------------------------------------------


class Rope:
    """An audit as its first part and the rest, which other audits may share."""

    __slots__ = ("head", "rest")

    def __init__(self, head: str, rest: Rope | None):
        self.head, self.rest = head, rest

    def parts(self) -> Iterator[str]:
        at: Rope | None = self
        while at is not None:
            yield at.head
            at = at.rest


def compare(a: Rope | None, b: Rope | None) -> int:
    """Order of the joined strings; equal rests are not read."""
    x = y = ""
    while x or y or a is not b:
        while not x and a is not None:
            x, a = a.head, a.rest
        while not y and b is not None:
            y, b = b.head, b.rest
        n = min(len(x), len(y))
        if not n or x[:n] != y[:n]:
            return (x[:n] > y[:n]) - (x[:n] < y[:n]) if n else (x > y) - (x < y)
        x, y = x[n:], y[n:]
    return 0


def illegal_pairs(initials: str) -> int:
    return max(0, len(initials) - 1) - sum(initials.count(pair) for pair in ("su", "ua", "au"))


class Joined:
    """A conversation put together from its last part to its first."""

    def __init__(self):
        #: by state: cost-to-go, audit and the states between the parts
        self.best: list[tuple[int, Rope | None, tuple | None] | None] = [(0, None, None) if q in ENDS else None for q in range(4)]
        self.illegal, self.opening = 0, ""

    def add(self, part: int, initials: str, costs: list[int | None], audits: list[str | None]) -> None:
        now = []
        for q in range(4):
            found = [
                (costs[4 * q + z] + rest[0], Rope(audits[4 * q + z], rest[1]), (part, q, audits[4 * q + z], rest[2]))
                for z, rest in enumerate(self.best)
                if rest is not None and costs[4 * q + z] is not None
            ]
            now.append(min(found, key=cmp_to_key(lambda a, b: (a[0] > b[0]) - (a[0] < b[0]) or compare(a[1], b[1])), default=None))
        self.best = now
        self.illegal += illegal_pairs(initials) + illegal_pairs(initials[-1:] + self.opening) * bool(self.opening)
        self.opening = initials[:1]

    def result(self) -> tuple[int, str, list[tuple[int, int, str]]]:
        """Cost, audit, and per part its number, the state before it and its audit."""
        cost, rope, chain = self.best[0]
        plan = []
        while chain is not None:
            part, q, audit, chain = chain
            plan.append((part, q, audit))
        return cost, "".join(rope.parts()) if rope else "", plan


PLAN = "key string, part long, state int, edits string, cost long, illegal long, audit string"


def plans(parts: DataFrame) -> DataFrame:
    """Per part its edits and the state before it; the first part (0) carries cost, illegal pairs and audit."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, one, out = None, Joined(), []

        def close() -> None:
            cost, audit, plan = one.result()
            for i, (part, q, edits) in enumerate(plan):
                out.append((key, part, q, edits, *((cost, one.illegal, audit) if not i else (None, None, None))))

        def batch() -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            names = ["key", "part", "state", "edits", "cost", "illegal", "audit"]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out.clear()
            return made

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != key:
                    if key is not None:
                        close()
                    key, one = row[0], Joined()
                one.add(*row[1:])
            if out:
                yield batch()
        if key is not None:
            close()
        if out:
            yield batch()

    ordered = parts.repartition("key").sortWithinPartitions("key", F.desc("part"))
    return ordered.select("key", "part", "initials", "costs", "audits").mapInArrow(joined, PLAN)


def repaired(state: int, edits: str, turns: list[tuple[str, str]]) -> Iterator[str]:
    """``role:text`` of the turns that ``edits`` leaves or adds."""
    rest = iter(turns)
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(rest)
        if edit == "D":
            continue
        if edit == "K":
            state = NEXT[state][role[0]]
        else:
            letter = next(x for x in NEXT[state] if x in ROLE)
            role, state = ROLE[letter], NEXT[state][letter]
        yield f"{role}:{text}"


def digests(texts: DataFrame) -> DataFrame:
    """sha256 per ``key`` of the texts of its parts in order, newline between; parts are streamed."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, some, out = None, None, False, []
        schema = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1)):
                if k != key:
                    if key is not None:
                        out.append((key, digest.hexdigest()))
                    key, digest, some = k, hashlib.sha256(), False
                if text.is_valid:  # a part may have lost all its turns
                    digest.update((b"\n" if some else b"") + text.as_buffer())
                    some = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=schema)
                out = []
        if key is not None:
            out.append((key, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=schema)

    ordered = texts.repartition("key").sortWithinPartitions("key", "part")
    return ordered.select("key", "text").mapInArrow(hashed, "key string, repaired_sha256 string")


def repair(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", width: int = 128) -> tuple[DataFrame, DataFrame]:
    """The report per conversation, and the repaired text per conversation ``key`` and ``part`` (null where a
    part lost all its turns). The table is taken as it is; :func:`damaged` harms it for trials."""
    rows = df.select(
        _key(F.col(conversation)).alias("key"), F.col(turn).cast("long").alias("turn"),
        _spaced(F.col(role)).alias("role"), _spaced(F.col(text)).alias("text"), F.lit(0).alias("copy"),
    )
    return mended(df, rows, conversation, width)


def mended(original: DataFrame, rows: DataFrame, conversation: str, width: int) -> tuple[DataFrame, DataFrame]:
    """Report on ``rows`` for every conversation of ``original``, and the repaired texts."""
    spark = original.sparkSession
    workers_find_us(spark)
    turns = checkpointed(faults(rows).withColumn("part", F.floor((F.col("pos") - 1) / width).cast("long")))
    gone = F.col("fault").isin("blank", "duplicate")
    symbol = F.when(F.coalesce(gone, F.lit(False)), "d").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    line = F.array_sort(F.collect_list(F.struct("pos", symbol.alias("symbol"), "initial")))
    parts = turns.groupBy("key", "part").agg(line.alias("line"))
    parts = checkpointed(parts.select("key", "part", F.array_join("line.symbol", "").alias("signature"), F.array_join("line.initial", "").alias("initials")))
    planned = checkpointed(plans(parts.join(automaton(parts), "signature")))

    @F.arrow_udf("string")
    def written(state: pa.Array, edits: pa.Array, lines: pa.Array) -> pa.Array:
        out = []
        for q, e, line in zip(state.to_pylist(), edits.to_pylist(), lines):
            found = list(repaired(q, e, [(t["role"], t["text"]) for t in line.as_py()]))
            out.append("\n".join(found) if found else None)
        return pa.array(out, pa.string())

    spoken = turns.groupBy("key", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    texts = spoken.join(planned.select("key", "part", "state", "edits"), ["key", "part"])
    texts = texts.select("key", "part", written("state", "edits", "turns").alias("text"))

    def faulty(name: str) -> Column:
        return F.count(F.when(F.col("fault") == name, 1)).alias(name)

    # distinct turns first: the exact count of a conversation is then a sum like the others
    by_turn = turns.groupBy("key", "turn").agg(*[faulty(x) for x in ("blank", "duplicate", "truncated")])
    sums = by_turn.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")],
    )
    whole = planned.where(F.col("cost").isNotNull()).select("key", "cost", "illegal", "audit")
    every = original.groupBy(F.col(conversation).alias("conv_id")).agg(F.lit(1).alias("one")).withColumn("key", _key(F.col("conv_id")))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    report = every.join(sums, "key", "left").join(whole, "key", "left").join(digests(texts), "key", "left")
    return report.select(
        "conv_id",
        *[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"),
    ), texts


@query("op12_suffix_dawg")
def _(spark, folder):
    conversations = table(spark, folder, "conversations")
    return mended(conversations, damaged(conversations), "conv_id", 128)[0]
