"""Chat records and intent labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..operators.hold import hold
from . import code as CD, text as X

# --- fixed values: words that tell what a message wants ---------------------------------------
GENERATE = (
    r"(?i)\b(generate|create|draw|make|build)\b.*\b(diagram|uml|plantuml)\b|\b(class|component|package|object)\s+diagram\b|"
    r"\b(uml|plantuml)\b"
)
CORRECT = (
    r"(?i)\b(fix|correct|repair|change|update|add|remove|rename|edit|adjust|modify|instead|should|missing|wrong)\b"
)
QUESTION = (
    r"(?i)^\s*(what|why|how|who|when|where|which|can you|do you|could you|should we|help me|explain)\b|\?\s*$"
)
GO = (
    r"(?i)\b(generate|create|draw|make|build)\b.{0,40}\b(diagram|uml|plantuml|class|component|package|object)\b|"
    r"\b(please\s+)?(generate|create|draw)\b|\bgo\s+ahead\b|\bready\s+to\s+(generate|create)\b"
)


def intent(message: Column, has_artifact: Column) -> Column:
    """Chat, correct or generate."""
    s = X.strip(F.coalesce(message, F.lit("")))

    def says(p: str) -> Column:
        return F.rlike(s, F.lit(p))

    go = says(GO)
    return (
        F.when(s == "", "chat")
        .when(says(QUESTION) & ~go, "chat")
        .when(has_artifact & says(CORRECT), "correct")
        .when(go | (says(GENERATE) & (F.length(s) >= 24)), "generate")
        .when(has_artifact & (F.length(s) >= 12) & ~s.endswith("?"), "correct")
        .otherwise("chat")
    )


def user_prompt(kind: Column, spec: Column, mode: Column, source: Column, language: Column) -> Column:
    """The two request templates over clipped texts; source context only for source-code rows."""
    label = F.coalesce(F.nullif(X.strip(F.coalesce(language, F.lit(""))), F.lit("")), F.lit("source"))
    head = F.concat(F.lit("Target diagram type: "), kind, F.lit("\n\n"))
    body = F.concat(F.lit("Technical specification:\n"), spec, F.lit("\n\n"))
    from_code = F.concat(
        head, F.lit("Source code context ("), label, F.lit("):\n"), source, F.lit("\n\n"), body,
        F.lit("Generate black-and-white PlantUML for a "), kind, F.lit(" diagram " + fixed.SOURCE_PROMPT_TAIL),
    )
    from_text = F.concat(head, body, F.lit("Generate PlantUML for a "), kind, F.lit(" " + fixed.REQUIREMENT_PROMPT_TAIL))
    return F.when((mode == "source_code") & (F.length(source) >= 20), from_code).otherwise(from_text)


def with_chat_records(df: DataFrame, system: str, max_spec: int = 1800, max_code: int = 2500) -> DataFrame:
    """Usable corpus rows with their system, user and assistant message.

    Stripped, cleaned and clipped texts are held step by step, so each is made once.
    """
    spec = F.coalesce(F.nullif("technical_spec", F.lit("")), F.col("source_requirement"), F.lit(""))
    rows = hold(
        df,
        {
            "__kind": F.lower(X.strip(F.coalesce("diagram_type", F.lit("class")))),
            "__spec": X.strip(spec),
            "__source": X.strip(F.coalesce("source_requirement", F.lit(""))),
            "__fences": X.strip_fences(F.col("uml_code")),
        },
    )
    rows = hold(rows, {"__code": X.tagged(F.col("__fences"))}).drop("__fences")
    rows = rows.where((F.length("__spec") >= 40) & (F.length("__code") >= 20))
    rows = hold(
        rows,
        {
            "__mode": F.when(CD.looks_like_code(F.col("__source")), F.lit("source_code")).otherwise(F.lit("requirement")),
            "__spec": X.truncated(F.col("__spec"), max_spec),
            "__code": X.truncated(F.col("__code"), max_code),
            "__source": X.clipped(F.col("__source"), max(400, max_spec // 2)),
        },
    )
    rows = hold(rows, {"__spec": X.clipped(F.col("__spec"), max_spec)})
    user = user_prompt(F.col("__kind"), F.col("__spec"), F.col("__mode"), F.col("__source"), F.col("source_language"))

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    record = F.array(message("system", F.lit(system)), message("user", user), message("assistant", F.col("__code")))
    return hold(rows, {"messages": record}).drop("__kind", "__spec", "__source", "__code", "__mode")
