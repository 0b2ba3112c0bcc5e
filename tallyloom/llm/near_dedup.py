"""Near duplicates by Order MinHash and banded alignment (operator 1).

A text is its sequence of five-word shingles. Every one of ``sketches`` hash functions picks the
``length`` smallest shingles, each labelled with its number of occurrence, and keeps them in the
order of the text; the hash of such a tuple is a bucket. Texts meet in a bucket when they hold the
same shingles in the same order, so the chance follows edit similarity and not only shared words.
Candidates are verified exactly: the longest common subsequence of both shingle sequences, within
the band outside of which no alignment can reach the threshold, over the longer length, must be
``similarity`` or more. Verified links are closed to classes.

Groups. Exact copies become one node before anything else, by an aggregate. In every bucket, of any
size, the members are first compared with the most connected of them: a group of copies is settled
in as many comparisons as it has members. Members that a bucket still holds in different classes
are then compared across classes. Before a pair is verified, its lengths must allow the threshold,
and one bit of each of 512 minima of both texts must agree in ``agree`` places (a pair just at the
threshold agrees in 427 on average, with a standard deviation of 8.4; 385 is five of them below, so less than
one such pair in a million is lost); what only shares a passage is sorted
out there and never reaches the texts. Comparisons across classes happen inside tasks, each pair in
one bucket only, and only links leave them. Buckets of more than ``large`` members are first cut into
finer ones, under pairs of large buckets a member is in, and pairs that share no other bucket meet
under the large one itself; what is still larger is compared block by block.

With 24 tuples of three, a pair at the threshold meets in a bucket with probability above 0.999.

Defined results: words are what stands between blanks, in lower case (A to Z); a null text is
empty; equal texts are copies, also empty ones; a text without words is similar to nothing else;
a text of fewer than five words is one shingle; the class of a document is the smallest id among
its members (null where none has an id); repeated rows stay, with the same class.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpointed
from .common import Words, mix, query, shingle_hashes, sliced, table, workers_find_us


@dataclass
class Settings:
    words: int = 5
    similarity: float = 0.8
    sketches: int = 24
    length: int = 3
    agree: int = 385  #: of 512 minima
    large: int = 8192
    seed: int = 11


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Shingles made distinct by the number of times each has occurred before."""
    order = np.argsort(shingles, kind="stable")
    ordered = shingles[order]
    fresh = np.ones(len(ordered), dtype=bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    if fresh.all():
        return shingles
    at = np.arange(len(ordered))
    earlier = np.empty(len(ordered), dtype=np.uint64)
    earlier[order] = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
    return np.where(earlier > 0, mix(shingles ^ mix(earlier)), shingles)


def order_sketch(shingles: np.ndarray, s: Settings) -> np.ndarray:
    """One hash per tuple of the ``length`` smallest labelled shingles in text order."""
    if not len(shingles):
        return np.zeros(0, dtype=np.int64)
    flip = mix(np.arange(s.sketches, dtype=np.uint64) + np.uint64(s.seed << 20))
    scale = mix(flip) | np.uint64(1)
    base = labelled(shingles)
    k = min(s.length, len(base))
    out = mix(flip)
    step = max(1, (1 << 20) // len(base))  # bounds the working matrix for very long texts
    for j in range(0, s.sketches, step):
        values = (base[None, :] ^ flip[j : j + step, None]) * scale[j : j + step, None]
        chosen = np.argpartition(values, k - 1, axis=1)[:, :k] if k < len(base) else np.tile(np.arange(k), (len(values), 1))
        chosen.sort(axis=1)
        for i in range(k):
            out[j : j + step] = mix(out[j : j + step] ^ base[chosen[:, i]])
    return out.view(np.int64)


def _held(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of ``x`` occur in the sorted ``ordered``."""
    if not len(ordered):
        return np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return ordered[at] == x


def aligned(a: np.ndarray, b: np.ndarray, similarity: float, sorted_a: np.ndarray | None = None, sorted_b: np.ndarray | None = None) -> int:
    """Length of the longest common subsequence within the band of the threshold.

    Matches further off the diagonal than the number of shingles that may stay unmatched are in
    no alignment that reaches the threshold, so below it the result may be too small.
    """
    longer = max(len(a), len(b))
    need = int(np.ceil(similarity * longer - 1e-9))
    if min(len(a), len(b)) < need:
        return 0
    band = longer - need
    in_b = _held(a, np.sort(b) if sorted_b is None else sorted_b)
    if np.count_nonzero(in_b) < need:
        return 0
    in_a = _held(b, np.sort(a) if sorted_a is None else sorted_a)
    if np.count_nonzero(in_a) < need:
        return 0
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    rest = n - head
    tail = 0
    if rest:
        same = a[len(a) - rest :][::-1] == b[len(b) - rest :][::-1]
        tail = rest if same.all() else int(same.argmin())
    a_at = head + np.flatnonzero(in_b[head : len(a) - tail])
    b_at = head + np.flatnonzero(in_a[head : len(b) - tail])
    got = head + tail
    x, y = a[a_at], b[b_at]
    if len(x) == len(y) and (x == y).all() and (len(x) == 0 or np.abs(a_at - b_at).max() <= band):
        return got + len(x)
    # bit-parallel: a set bit of `open_` is a position of y no alignment has used to extend itself
    where: dict[int, int] = {}
    for j, v in enumerate(y.tolist()):
        where[v] = where.get(v, 0) | 1 << j
    low, high = np.searchsorted(b_at, a_at - band), np.searchsorted(b_at, a_at + band, side="right")
    full = (1 << len(y)) - 1
    open_ = full
    for v, lo, hi in zip(x.tolist(), low.tolist(), high.tolist()):
        if hi > lo:
            match = open_ & where.get(v, 0) & (((1 << (hi - lo)) - 1) << lo)
            open_ = ((open_ + match) | (open_ - match)) & full
    return got + len(y) - open_.bit_count()


def node_of(text: str) -> Column:
    """Equal texts are one node."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def sketched(df: DataFrame, text: str, s: Settings) -> DataFrame:
    """``node`` and its ``buckets``, once per row."""
    workers_find_us(df.sparkSession)

    @sliced
    def sketches(texts: pa.Array) -> pa.Array:
        words = Words(texts, lower=True)
        hashes = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
        found = [order_sketch(shingle_hashes(hashes[a:b], s.words), s) for a, b in zip(words.offsets[:-1], words.offsets[1:])]
        at = np.zeros(len(found) + 1, dtype=np.int32)
        np.cumsum([len(x) for x in found], out=at[1:])
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))

    @F.arrow_udf("array<long>")
    def buckets(texts: pa.Array) -> pa.Array:
        return sketches(texts)

    return df.select(node_of(text).alias("node"), buckets(F.col(text)).alias("buckets"))


MINIMA = 512


def minima(shingles: np.ndarray) -> np.ndarray:
    """Minima under as many hash functions, one bit of each, packed into integers."""
    flip = mix(np.arange(MINIMA, dtype=np.uint64) + np.uint64(1 << 40))
    scale = mix(flip) | np.uint64(1)
    base = labelled(shingles)
    least = np.zeros(MINIMA, dtype=np.uint64)
    if len(base):
        step = max(1, (1 << 18) // len(base))
        for j in range(0, MINIMA, step):
            least[j : j + step] = ((base[None, :] ^ flip[j : j + step, None]) * scale[j : j + step, None]).min(axis=1)
    return np.packbits((mix(least) >> np.uint64(63)).astype(np.uint8)).view(np.int64)


def shared_texts(texts: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """Text, number of shingles and minima of the nodes that share a bucket, each once."""

    @sliced
    def describe(column: pa.Array) -> pa.Array:
        words = Words(column, lower=True)
        hashes = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
        each = [shingle_hashes(hashes[a:b], s.words) for a, b in zip(words.offsets[:-1], words.offsets[1:])]
        at = np.arange(len(each) + 1, dtype=np.int32) * (MINIMA // 64)
        flat = np.concatenate([minima(x) for x in each]) if each else np.zeros(0, np.int64)
        n = pa.array(np.array([len(x) for x in each], dtype=np.int32))
        return pa.StructArray.from_arrays([n, pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["n", "minima"])

    @F.arrow_udf("struct<n:int,minima:array<long>>")
    def described(column: pa.Array) -> pa.Array:
        return describe(column)

    one = texts.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    return one.select("node", "text", described("text").alias("d")).select("node", "text", "d.*")


def verified(pairs: DataFrame, some: DataFrame, similarity: float, k: int) -> DataFrame:
    """Add to (a, b) the lengths ``n_a``, ``n_b`` in shingles and how many are ``aligned``.

    The band is that of ``similarity``.
    """

    def compare(left: pa.Array, right: pa.Array) -> pa.Array:
        # a text in many pairs is cut into shingles once
        texts = pa.concat_arrays([left, right]).dictionary_encode()
        words = Words(texts.dictionary, lower=True)
        hashes = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
        each = [shingle_hashes(hashes[a:b], k) for a, b in zip(words.offsets[:-1], words.offsets[1:])]
        ordered = [np.sort(x) for x in each]
        place = np.asarray(texts.indices)
        n = len(left)
        rows = np.zeros((3, n), dtype=np.int32)
        for i, (x, y) in enumerate(zip(place[:n].tolist(), place[n:].tolist())):
            rows[:, i] = len(each[x]), len(each[y]), aligned(each[x], each[y], similarity, ordered[x], ordered[y])
        return pa.StructArray.from_arrays([pa.array(r) for r in rows], names=["n_a", "n_b", "aligned"])

    cut = sliced(compare, 16 << 20)

    @F.arrow_udf("struct<n_a:int,n_b:int,aligned:int>")
    def align(left: pa.Array, right: pa.Array) -> pa.Array:
        return cut(left, right)

    joined = pairs.join(some.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        some.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"
    )
    return joined.select("a", "b", align("text_a", "text_b").alias("v")).select("a", "b", "v.*")


def linked(scored: DataFrame, s: Settings) -> DataFrame:
    longer = F.greatest("n_a", "n_b")
    return scored.where((F.col("aligned") > 0) & (F.col("aligned") >= F.ceil(s.similarity * longer - 1e-9))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node; the label is the smallest node of its component.

    Labels travel along the links and then along themselves, so long chains halve every round.
    """
    both = checkpointed(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        far = moved.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = checkpointed(moved.join(far, "label").select("node", F.least("label", "far").alias("label"), "was"))
        changed = moved.where("label <> was").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels


def _may_link(x: str, y: str, s: Settings) -> Column:
    """Lengths and minima of two rows (columns prefixed ``x`` and ``y``) allow the threshold."""
    n = [F.col(f"{p}_n") for p in (x, y)]
    differing = F.lit(0)
    for i in range(MINIMA // 64):
        differing = differing + F.bit_count(F.col(f"{x}_minima")[i].bitwiseXOR(F.col(f"{y}_minima")[i]))
    return (F.least(*n) >= s.similarity * F.greatest(*n) - 1e-9) & (differing <= MINIMA - s.agree)


def _side(rows: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return rows.select("bucket", *[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


WIDE = ["node", "n", "minima"]


def _with_leader(rows: DataFrame, s: Settings) -> DataFrame:
    """Pairs of a bucket's most connected member and every other that may link to it."""
    lead = rows.groupBy("bucket").agg(F.max_by(F.struct(*WIDE), F.struct("weight", "node")).alias("l"))
    lead = lead.select("bucket", *[F.col("l")[c].alias(f"y_{c}") for c in WIDE])
    return _pairs(_side(rows, "x", WIDE).join(lead, "bucket").where((F.col("x_node") != F.col("y_node")) & _may_link("x", "y", s)))


def _met(group: pa.Table, s: Settings, similarity: float | None) -> list[tuple[int, int]]:
    """Pairs of rows of a bucket in different classes whose lengths and minima allow the threshold.

    A pair that shares several buckets is taken in the first of them only, and under a large bucket
    alone (``only``) where it shares no other. With ``similarity`` the pairs are verified as well, by
    their texts.
    """
    size = len(group)
    label = np.asarray(group.column("label").combine_chunks().dictionary_encode().indices)
    outside = np.asarray(group.column("outside").combine_chunks().to_numpy(zero_copy_only=False), dtype=bool)
    n = group.column("n").to_numpy()
    minima_of = np.asarray(group.column("minima").combine_chunks().flatten()).reshape(size, -1)
    held = group.column("all").to_pylist()
    first, second = group.column("bucket")[0].as_py(), group.column("second")[0].as_py()
    here, only = ([first] if first == second else [first, second]), group.column("only")[0].as_py()
    shingles: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if similarity is not None:
        words = Words(group.column("text"), lower=True)
        hashes = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)

    def cut(i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in shingles:
            x = shingle_hashes(hashes[words.offsets[i] : words.offsets[i + 1]], s.words)
            shingles[i] = x, np.sort(x)
        return shingles[i]

    at = np.arange(size)
    out = []
    for i in np.flatnonzero(outside):
        may = (label != label[i]) & (~outside | (at > i)) & (np.minimum(n, n[i]) >= s.similarity * np.maximum(n, n[i]) - 1e-9)
        others = np.flatnonzero(may)
        others = others[np.bitwise_count(minima_of[others] ^ minima_of[i]).sum(axis=1) <= MINIMA - s.agree]
        own = set(held[i])
        for j in others.tolist():
            if sorted(own.intersection(held[j]))[: None if only else len(here)] != here:
                continue
            if similarity is not None:
                (x, x_sorted), (y, y_sorted) = cut(i), cut(j)
                if aligned(x, y, similarity, x_sorted, y_sorted) < np.ceil(similarity * max(len(x), len(y)) - 1e-9):
                    continue
            out.append((int(i), j))
    return out


def _across(rows: DataFrame, some: DataFrame, s: Settings) -> DataFrame:
    """Links between different classes of a bucket: all members outside of its leader's class with all members.

    ``rows`` have (bucket, second, only) as their bucket and ``all`` as the list of a node's buckets. Pairs
    meet inside a task and only links leave it: first without texts, to find the members that have
    a possible partner at all, then those with their texts. A bucket of more than ``large``
    members is dealt into blocks of that size, and every pair of blocks is a task.
    """
    key = ["bucket", "second"]
    lead = rows.groupBy(*key).agg(
        F.max_by("label", F.struct("weight", "node")).alias("first"), F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")
    )
    several = rows.join(lead.where("low <> high").drop("low", "high"), key).withColumn("outside", F.col("label") != F.col("first"))
    blocks = F.ceil(F.col("size") / s.large).cast("int")
    block = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = several.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = checkpointed(
        dealt.select(*key, "node", "label", "outside", "n", "minima", "all", "only", F.least(block, "other").alias("x"), F.greatest(block, "other").alias("y"))
    )
    key = [*key, "x", "y"]

    def possible(group: pa.Table) -> pa.Table:
        pairs = _met(group, s, None)
        return group.select([*key, "node"]).take(pa.array(sorted({i for p in pairs for i in p}), type=pa.int64()))

    def links(group: pa.Table) -> pa.Table:
        pairs = _met(group, s, s.similarity)
        node = group.column("node").to_pylist()
        ends = [sorted((node[i], node[j])) for i, j in pairs]
        return pa.table({"a": pa.array([e[0] for e in ends], pa.binary()), "b": pa.array([e[1] for e in ends], pa.binary())})

    found = dealt.groupBy(*key).applyInArrow(possible, "bucket long, second long, x int, y int, node binary")
    whole = dealt.join(checkpointed(found), [*key, "node"], "left_semi").join(some.select("node", "text"), "node")
    return whole.groupBy(*key).applyInArrow(links, "a binary, b binary").distinct()


def _buckets(rows: DataFrame, s: Settings) -> DataFrame:
    """Rows with their bucket as (bucket, second): as they are, or pairs of buckets where those are large.

    Large ones come also as they are (``only``), for pairs that share no other bucket, small or large.
    """
    plain = rows.where(F.col("size") <= s.large)
    carried = ["node", "n", "minima", "weight", "label", "all"]
    listed = plain.groupBy("node").agg(F.array_sort(F.collect_list("bucket")).alias("all"))
    small = plain.join(listed, "node").select("bucket", F.col("bucket").alias("second"), *carried, F.lit(False).alias("only"))
    held = rows.where(F.col("size") > s.large).groupBy("node").agg(
        F.array_sort(F.collect_list("bucket")).alias("all"), *[F.first(c).alias(c) for c in ("n", "minima", "weight", "label")]
    )
    pairs = F.transform(
        "all", lambda x, i: F.transform(F.slice(F.col("all"), i + 2, F.size("all")), lambda y: F.struct(x.alias("bucket"), y.alias("second")))
    )
    fine = held.select(F.explode(F.flatten(pairs)).alias("p"), *carried).select("p.bucket", "p.second", *carried, F.lit(False).alias("only"))
    every = held.withColumnRenamed("all", "big").join(listed.withColumnRenamed("all", "rest"), "node", "left")
    every = every.withColumn("all", F.array_sort(F.concat("big", F.coalesce("rest", F.array().cast("array<long>")))))
    alone = every.select(F.explode("big").alias("bucket"), *carried).select("bucket", F.col("bucket").alias("second"), *carried, F.lit(True).alias("only"))
    return small.union(fine).union(alone)


def links_of(texts: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """All verified links (a, b) between nodes, and the components (node, label) they form.

    ``texts`` has ``node`` and ``text``, in any number of copies.
    """
    nodes = sketched(texts, "text", s).groupBy("node").agg(F.first("buckets").alias("buckets"))
    spread = checkpointed(nodes.select("node", F.explode("buckets").alias("bucket")))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = checkpointed(spread.join(sizes, "bucket"))
    weights = shared.groupBy("node").agg(F.sum(F.log2("size")).alias("weight"))
    some = checkpointed(shared_texts(texts, weights.select("node"), s))
    rows = checkpointed(shared.join(some.drop("text"), "node").join(weights, "node"))

    links = checkpointed(linked(verified(_with_leader(rows, s), some, s.similarity, s.words), s))
    labels = components(links)

    rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    rows = checkpointed(rows.join(several, "bucket"))
    links = checkpointed(links.union(_across(_buckets(rows, s), some, s)))
    return links, components(links)


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", s: Settings | None = None) -> DataFrame:
    """``doc_id``, ``node``, ``class_node``, ``class_id`` and ``class_size`` of every row of ``df``."""
    s = s or Settings()
    rows = df.select(F.col(key).alias("doc_id"), node_of(text).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    _, labels = links_of(rows.select("node", "text"), s)
    named = rows.select("doc_id", "node").join(labels, "node", "left").withColumn("class", F.coalesce("label", "node"))
    first = named.groupBy("class").agg(
        F.min("doc_id").alias("class_id"),
        F.min_by("node", F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("class_node"),
        F.count("*").alias("class_size"),
    )
    return named.join(first, "class").select("doc_id", "node", "class_node", "class_id", "class_size")


@query("op1_order_minhash")
def _(spark, folder):
    return classes(table(spark, folder, "documents")).select("doc_id", "class_id", "class_size")
