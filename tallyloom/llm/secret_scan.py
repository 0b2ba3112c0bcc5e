"""Secret scan by token efficiency (operator 9).

Ordinary words are frequent in a tokenizer's training text and take few tokens; random strings
take about one token for every one or two characters. The scan looks at long runs of the
characters keys are made of, leaves out digests and identifiers, and reports runs with few
characters per token. Rules for assignments, access keys and hexadecimal runs come with it; what
they find always stays.

A key next to ordinary words (in a path, say) has too many characters per token as a whole run, so
the parts of a run are judged as well: the run without the words at its ends, and every piece
between separators. In a run that touches a span of the rules, what is judged random and not wholly
covered is reported with its whole extent, overlapping the span.

Defined results: a null text is empty and has no spans; offsets are code points, end exclusive;
spans come in order of start, then of ``KINDS``. Whole texts are read, whatever their length.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import load_encoding, query, table, workers_find_us

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

#: Runs that are long and random but no secrets: digests by their usual lengths, UUIDs, plain
#: numbers (also with separators), dates and times, and words joined by separators.
DIGEST = re.compile(r"(?:md5|sha1|sha256|sha512)?[=-]?(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|[0-9a-fA-F]{128})=?")
IDENTIFIER = re.compile(
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|[0-9+/_=-]+"
    r"|\d{4}-\d\d-\d\dT?[0-9-]*Z?"
    r"|(?:[a-z]+|[A-Z]+|[A-Z][a-z]+)[0-9]{0,4}(?:[+/_=-]++(?:[a-z]*|[A-Z]+|[A-Z][a-z]+)[0-9]{0,4})*"  # a row of separators is taken whole
)
PIECE = re.compile(r"[A-Za-z0-9]+")
WORD = re.compile(r"(?:[a-z]+|[A-Z]+|[A-Z][a-z]+)[0-9]{0,4}")
CLASSES = (re.compile(r"[a-z]"), re.compile(r"[A-Z]"), re.compile(r"[0-9]"))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the three rules."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def random_spans(text: str, taken: list[tuple[int, int, int]], encoding, most: float) -> list[tuple[int, int, int]]:
    """Runs, or else parts of runs, with fewer than ``most`` characters per token that ``taken`` does not cover."""

    def random(part: str) -> bool:
        return not ordinary(part) and len(part) < most * len(encoding.encode_ordinary(part))

    def parts(at: int, end: int, touched: bool) -> list[tuple[int, int]]:
        run = text[at:end]
        if ordinary(run):
            return []
        if not touched and random(run):
            return [(at, end)]
        pieces = [(at + p.start(), at + p.end()) for p in PIECE.finditer(run)]
        first, last = 0, len(pieces)
        while first < last and WORD.fullmatch(text, *pieces[first]):
            first += 1
        while first < last and WORD.fullmatch(text, *pieces[last - 1]):
            last -= 1
        if first < last and random(text[pieces[first][0] : pieces[last - 1][1]]):
            return [(pieces[first][0], pieces[last - 1][1])]
        return [(s, e) for s, e in pieces if random(text[s:e])]

    out = []
    known = Cover(taken)
    assigned = sorted((s, e) for s, k, e in taken if k == 0)
    upcoming = 0
    for m in RUN.finditer(text):
        while upcoming < len(assigned) and assigned[upcoming][1] <= m.start():
            upcoming += 1
        if ordinary(m[0]):
            continue
        # an assignment has its own extent: what stands before or after it is judged by itself
        at, segments, i = m.start(), [], upcoming
        while i < len(assigned) and assigned[i][0] < m.end():
            segments.append((at, assigned[i][0]))
            at, i = max(at, assigned[i][1]), i + 1
        for s, e in [*segments, (at, m.end())]:
            for lo, hi in parts(s, e, known.touches(s, e)) if e > s else ():
                if not known.holds(lo, hi):
                    out.append((lo, 3, hi))
    return out


class Cover:
    """What a set of spans covers, as separate stretches in order."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, _, e in sorted(spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def touches(self, lo: int, hi: int) -> bool:
        i = bisect_right(self.ends, lo)
        return i < len(self.starts) and self.starts[i] < hi

    def holds(self, lo: int, hi: int) -> bool:
        i = bisect_right(self.starts, lo) - 1
        return i >= 0 and hi <= self.ends[i]


def ordinary(run: str) -> bool:
    """Too short or of one class only, a digest or an identifier."""
    return len(run) < 16 or sum(c.search(run) is not None for c in CLASSES) < 2 or bool(DIGEST.fullmatch(run) or IDENTIFIER.fullmatch(run))


def scan(
    df: DataFrame,
    text: str = "text",
    out: str = "spans",
    path: str | None = None,
    chars_per_token: float = 2.0,
) -> DataFrame:
    """Add ``out``: array of (kind, start, end) of every secret in ``text``."""
    workers_find_us(df.sparkSession)
    path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN

    @F.arrow_udf("array<struct<kind:string,start:int,end:int>>")
    def spans(texts: pa.Array) -> pa.Array:
        encoding = load_encoding(path, pattern)
        rows = []
        for scalar in texts:
            value = scalar.as_py() or ""
            base = base_spans(value)
            found = sorted(base + random_spans(value, base, encoding, chars_per_token))
            rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found])
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        return pa.array(rows, type=pa.list_(kind))

    return df.withColumn(out, spans(F.col(text)))


def redact(df: DataFrame, text: str = "text", spans: str = "spans", mark: str = "[SECRET]") -> DataFrame:
    """Replace what the spans cover by ``mark``; overlapping spans give one mark.

    A null text stays null.
    """
    # reach: where the cover of all spans so far ends; a span that starts before it adds no mark
    state = "struct<done:string,reach:int>"
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("reach")).cast(state)

    def step(a, s):
        fresh = s["start"] >= a["reach"]
        between = F.substr(F.col(text), a["reach"] + 1, s["start"] - a["reach"])
        return F.struct(
            F.when(fresh, F.concat(a["done"], between, F.lit(mark))).otherwise(a["done"]).alias("done"),
            F.greatest(a["reach"], s["end"]).alias("reach"),
        ).cast(state)

    def finish(a):
        return F.concat(a["done"], F.substr(F.col(text), a["reach"] + 1))

    masked = F.when(F.size(spans) > 0, F.aggregate(F.col(spans), start, step, finish)).otherwise(F.col(text))
    return df.withColumn(text, masked)


def listed(spans, kinds=KINDS):
    """kind:start:end of the spans of ``kinds``, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op9_token_efficiency")
def _(spark, folder):
    found = scan(table(spark, folder, "documents").select("doc_id", "text"))
    spans = F.col("spans")

    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(spans, KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
    )
