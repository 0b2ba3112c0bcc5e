"""Scores and explanations out of free-text model replies (H7)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import text as X

# --- fixed values: labels a reply may carry ------------------------------------------------
SCORE_LABEL = r"(?:SCORE|OVERALL(?:\s+SCORE)?|FINAL(?:\s+SCORE)?|RATING)"
CRITERION = r"(?:SEMANTIC|STRUCTURAL|SYNTACTIC|COHERENCE)"
ANY_CRITERION = r"(?:SEMANTIC|STRUCTURAL|SYNTACTIC|COHERENCE|OVERALL|RATING|FINAL)"
PLACEHOLDER = r"[<\[]\s*0\s*[-–—]\s*6\s*[>\]]"
ANY_LABEL = r"(?:SCORE|SEMANTIC|STRUCTURAL|SYNTACTIC|COHERENCE|OVERALL|RATING|FINAL)"
FRACTION = r"(?im)\b(?:score|rated|rating)\s*(?:is\s*|of\s*|:\s*)?([0-6])\s*(?:/\s*6|out\s+of\s+6)\b"


def scrubbed(reply: Column) -> Column:
    return F.regexp_replace(F.coalesce(reply, F.lit("")), r"\*+", "")


def without_placeholders(clean: Column) -> Column:
    return F.regexp_replace(clean, rf"(?im)\b{ANY_LABEL}\s*[:\-]\s*{PLACEHOLDER}", "")


def score(clean: Column) -> Column:
    """Last overall label, else the mean of criteria, else ``n/6``, else the first bare 0-6.

    ``clean`` is :func:`without_placeholders` of the scrubbed reply; 0 when nothing is found.
    """
    overall = F.regexp_extract_all(clean, F.lit(rf"(?im)\b{SCORE_LABEL}\s*[:\-]\s*([0-6])(?:\s*/\s*6)?\b"), F.lit(1))
    criteria = F.transform(
        F.regexp_extract_all(clean, F.lit(rf"(?im)\b{CRITERION}\s*[:\-]\s*([0-6])\b"), F.lit(1)), lambda x: x.cast("int")
    )
    total = F.aggregate(criteria, F.lit(0), lambda a, x: a + x)
    mean = F.bround(F.try_divide(total.cast("double"), F.size(criteria))).cast("int")
    fraction = F.nullif(F.regexp_extract(clean, FRACTION, 1), F.lit("")).cast("int")
    digits = F.transform(
        F.regexp_extract_all(F.regexp_replace(clean, PLACEHOLDER, " "), F.lit(r"(\d+)"), F.lit(1)),
        lambda x: x.try_cast("int"),
    )
    bare = F.try_element_at(F.filter(digits, lambda x: x.between(0, 6)), F.lit(1))
    return F.coalesce(F.try_element_at(overall, F.lit(-1)).cast("int"), mean, fraction, bare, F.lit(0))


def is_parsed(clean: Column) -> Column:
    """Does the scrubbed reply carry an explicit score?"""
    return (
        F.rlike(clean, F.lit(rf"(?im)\b{SCORE_LABEL}\s*[:\-]\s*[0-6]\b"))
        | F.rlike(clean, F.lit(rf"(?im)\b{CRITERION}\s*[:\-]\s*[0-6]\b"))
        | F.rlike(clean, F.lit(FRACTION))
    )


def explanation(scrub: Column, clean: Column, value: Column, most: int | None = None) -> Column:
    """A leading EXPLANATION part, else what is left of the reply, of that at most ``most`` characters."""
    opened = r"(?is)^\s*EXPLANATION\s*[:\-]\s*"
    rest = F.regexp_replace(scrub, opened, "")
    part = F.regexp_replace(rest, rf"(?is)\n\s*(?:{SCORE_LABEL}|{ANY_CRITERION}|EXPLANATION)\s*[:\-].*$", "")
    led = F.when(F.rlike(scrub, F.lit(opened)), F.nullif(X.strip(F.regexp_replace(part, r"\s+", " ")), F.lit("")))
    left = F.regexp_replace(clean, rf"(?imd)^\s*(?:{SCORE_LABEL}|{ANY_CRITERION})\s*[:\-]\s*[0-6](?:\s*/\s*6)?\s*$", "")
    left = F.regexp_replace(X.strip(left), r"(?imd)^\s*EXPLANATION\s*[:\-]\s*", "")
    left = X.strip(F.regexp_replace(left, r"\s+", " "))
    other = F.when((left != "") & (left != value.cast("string")), left if most is None else F.substring(left, 1, most))
    return F.coalesce(led, other)
