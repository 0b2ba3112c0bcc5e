"""Text normalisation as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from .. import fixed

BLOCK = r"(?is)(@startuml.*?@enduml)"


WHITESPACE = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    """Remove outer whitespace of every kind; looks at the ends only, unlike a pattern."""
    return F.btrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE))


def trimmed(s: Column) -> Column:
    """:func:`strip` of a whole text: one without whitespace at its ends is told by them and not gone through."""
    return F.when(_any(s.startswith(w) | s.endswith(w) for w in WHITESPACE), strip(s)).otherwise(s)


def _any(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a costly value that is computed once per row, however often ``body`` names it.

    The lambda of a one-element array binds it; written out, every branch would compute it anew.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def code_hash(c: Column) -> Column:
    return F.sha1(strip(F.coalesce(c, F.lit(""))))


def short_id(c: Column) -> Column:
    return F.substring(code_hash(c), 1, 12)


def parts_id(*parts: Column) -> Column:
    """Twelve-character id over several parts."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)


def line_fingerprint(c: Column) -> Column:
    stripped = F.filter(F.transform(lines(c), strip), lambda x: x != "")
    return F.sha1(F.array_join(stripped, "\n"))


def has_open_tag(c: Column) -> Column:
    return F.contains(c, F.lit("@startuml")) | F.contains(F.lower(c), F.lit("@startuml"))


def has_close_tag(c: Column) -> Column:
    return F.contains(c, F.lit("@enduml")) | F.contains(F.lower(c), F.lit("@enduml"))


def one_block(s: Column) -> Column:
    """The text is one plain diagram block: the tags are its ends, and no other ``@`` could begin a tag in any case."""
    return s.startswith("@startuml") & s.endswith("@enduml") & (F.size(F.split(s, "@")) == 3)


def without_tags(s: Column) -> Column:
    """The text without opening and closing tags of any case."""
    plain = F.replace(F.replace(s, F.lit("@startuml"), F.lit("")), F.lit("@enduml"), F.lit(""))
    return F.when(one_block(s), plain).otherwise(F.regexp_replace(s, r"(?i)@startuml|@enduml", ""))


def extract_block(c: Column, wrap: bool = False) -> Column:
    """First tagged block; untagged text becomes empty, or is wrapped in tags."""
    s = strip(F.coalesce(c, F.lit("")))
    found = F.regexp_extract(s, BLOCK, 1)
    bare = F.concat(F.lit("@startuml\n"), s, F.lit("\n@enduml")) if wrap else F.lit("")
    return F.when(found != "", found).when(s == "", F.lit("")).when(has_open_tag(s), s).otherwise(bare)


def strip_fences(c: Column) -> Column:
    def opened(s: Column) -> Column:
        return F.when(F.startswith(s, F.lit("```")), F.regexp_replace(s, r"(?i)^```(?:plantuml)?\s*", "")).otherwise(s)

    def closed(s: Column) -> Column:
        return F.when(F.contains(s, F.lit("```")), F.regexp_replace(s, r"\s*```$", "")).otherwise(s)

    return once(once(once(F.coalesce(c, F.lit("")), trimmed), opened), closed)


def tagged(s: Column) -> Column:
    """Both tags supplied where they are missing."""
    opened = F.when(has_open_tag(s), s).otherwise(F.concat(F.lit("@startuml\n"), s))
    return strip(F.when(has_close_tag(s), opened).otherwise(F.concat(rstrip(opened), F.lit("\n@enduml"))))


def clean_code(c: Column) -> Column:
    """No code fence, both tags present."""
    return tagged(strip_fences(c))


def _first_block(s: Column) -> Column:
    """From the first opening tag to the next closing one, in any case; all of ``s`` where one is missing.

    The tags are found by plain searches. Their places in the lower-case text are those in ``s``
    unless lower case has more characters; then a pattern looks for them.
    """
    def between(s: Column, low: Column) -> Column:
        start = F.instr(low, "@startuml")
        ends = once(start, lambda a: F.struct(a.alias("a"), F.when(a > 0, F.position(F.lit("@enduml"), low, a)).otherwise(0).alias("b")))
        return once(ends, lambda e: F.when(e["b"] > 0, F.substr(s, e["a"], e["b"] - e["a"] + len("@enduml"))).otherwise(s))

    searched = once(F.regexp_extract(s, BLOCK, 1), lambda found: F.when(found != "", found).otherwise(s))
    found = once(F.lower(s), lambda low: F.when(F.length(low) == F.length(s), between(s, low)).otherwise(searched))
    return F.when(one_block(s), s).otherwise(found)


def bounded_block(c: Column) -> Column:
    """The first diagram block with fences gone and tags supplied."""
    def supplied(s: Column) -> Column:
        return (
            F.when(~has_open_tag(s), F.concat(F.lit("@startuml\n"), s, F.lit("\n@enduml")))
            .when(~has_close_tag(s), F.concat(s, F.lit("\n@enduml")))
            .otherwise(s)
        )

    return once(once(strip_fences(c), supplied), _first_block)


def truncated(s: Column, limit: int) -> Column:
    """Stripped text cut at the limit, with a mark."""
    cut = F.concat(rstrip(F.substring(s, 1, limit - 20)), F.lit(fixed.TRUNCATED_MARK))
    return F.when(F.length(s) > limit, cut).otherwise(s)


def truncate(c: Column, limit: int) -> Column:
    return truncated(strip(F.coalesce(c, F.lit(""))), limit)


def clipped(s: Column, limit: int) -> Column:
    """Stripped text with its head (72 percent) and its tail; short limits keep the head only."""
    head = int(limit * 0.72)
    tail = limit - head - 80
    if tail < 200:
        cut = F.concat(rstrip(F.substring(s, 1, limit - 40)), F.lit(fixed.LONG_TRUNCATED_MARK))
    else:
        cut = F.concat(
            rstrip(F.substring(s, 1, head)),
            F.lit(fixed.MIDDLE_TRUNCATED_MARK),
            lstrip(F.right(s, F.lit(tail))),
        )
    return F.when(F.length(s) > limit, cut).otherwise(s)


def clip(c: Column, limit: int) -> Column:
    return clipped(strip(F.coalesce(c, F.lit(""))), limit)


def strip_reasoning(c: Column) -> Column:
    s = F.regexp_replace(c, r"(?is)<think>.*?</think>", "")
    s = F.regexp_replace(s, r"(?is)<reasoning>.*?</reasoning>", "")
    s = F.regexp_replace(s, r"```(?:plantuml)?\s*", "")
    return strip(F.regexp_replace(s, "```", ""))


def has_reasoning(c: Column) -> Column:
    return F.rlike(c, F.lit(r"(?is)<think>.*?</think>"))


def json_text(c: Column) -> Column:
    """The JSON object inside fenced or chatty text."""
    s = F.regexp_replace(strip(c), r"(?i)^```(?:json)?\s*", "")
    s = F.regexp_replace(s, r"\s*```$", "")
    return F.regexp_extract(s, r"(?s)(\{.*\})", 1)


def singular(c: Column) -> Column:
    return (
        F.when((F.length(c) > 4) & F.lower(c).endswith("ies"), F.regexp_replace(c, r"(?i)ies$", "y"))
        .when((F.length(c) > 3) & c.endswith("s") & ~c.endswith("ss"), F.regexp_replace(c, "s$", ""))
        .otherwise(c)
    )


#: how a role word ends, or a line break after it
ROLE_ENDS = [*"eiyms", "\n", "\r", "\u0085", "\u2028", "\u2029"]


def stem(c: Column) -> Column:
    """Lower-case name without a trailing role word, unless too little is left."""
    def cut(low: Column) -> Column:
        bare = F.regexp_replace(low, r"(service|api|store|repository|module|package|item)s?$", "")
        return once(bare, lambda b: F.when(F.length(b) >= 5, b).otherwise(low))

    return once(F.lower(c), lambda low: F.when(F.substring(low, -1, 1).isin(*ROLE_ENDS), cut(low)).otherwise(low))


def snippet(c: Column, limit: int = 120) -> Column:
    s = strip(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("…"))).otherwise(s)


def iso_time(c: Column, default: Column) -> Column:
    """ISO time with or without zone; anything else gives ``default``."""
    s = F.regexp_replace(strip(c), r"Z$", "+00:00")
    return F.coalesce(F.try_to_timestamp(s), default)


def count_char(c: Column, char: str) -> Column:
    """How often one ASCII character occurs; the bytes that go with it need no count of characters."""
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(char), F.lit("")))
