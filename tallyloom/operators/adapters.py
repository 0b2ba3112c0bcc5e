"""Adapters: one raw source shape each to the common adapted shape."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions import code as CD, text as X
from . import scores as S, structure as ST
from .hold import hold

Adapter = Callable[[DataFrame], DataFrame]
ADAPTERS: dict[str, Adapter] = {}

ADAPTED = {
    "input": "string", "source_requirement": "string", "reasoning": "string", "uml_code": "string",
    "qwen25vl3b": "string", "llama32vl11b": "string", "aya_vision_8b": "string", "scores": "double",
    "inferred_type": "string", "input_mode": "string", "source_language": "string",
}


def register_adapter(name: str) -> Callable[[Adapter], Adapter]:
    """Adapters are functions from DataFrame to DataFrame, so a new source needs no row code."""

    def add(f: Adapter) -> Adapter:
        ADAPTERS[name] = f
        return f

    return add


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def _adapted(df: DataFrame, keep: Sequence[str], **columns: Column) -> DataFrame:
    """The common columns; what an adapter does not give is null. ``row_id`` passes through."""
    passed = [F.col("row_id")] if "row_id" in df.columns else []
    out = [columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in ADAPTED.items()]
    return df.select(*passed, *keep, *out)


def _with_block(df: DataFrame, raw: Column, least: int = 20) -> DataFrame:
    """The diagram block of ``raw`` as ``__code``; rows without enough of one are dropped."""
    return hold(df, {"__code": X.extract_block(raw)}).where(F.length("__code") >= least)


def _is_uml(df: DataFrame) -> DataFrame:
    return df.where(F.col("uml").isNull() | F.col("uml")) if "uml" in df.columns else df


def _mapped_type(df: DataFrame, code: Column) -> Column:
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in fixed.SUBTYPE_MAP.items()))
    subtype = F.lower(X.strip(_text(df, "uml_subtype")))
    return F.coalesce(F.try_element_at(table, subtype), ST.inferred_type(code))


@register_adapter("umlcode")
def adapt_umlcode(df: DataFrame) -> DataFrame:
    """Code and scores as they are."""
    rows = df.where(F.length(X.strip(F.coalesce("uml_code", F.lit("")))) >= 20)
    scores = {k: F.col(k) for k in [*fixed.MODEL_KEYS, "scores"] if k in df.columns}
    return _adapted(
        rows, [], input=_text(df, "input"), reasoning=_text(df, "reasoning"), uml_code=F.col("uml_code"),
        inferred_type=ST.inferred_type(F.col("uml_code")), **scores,
    )


@register_adapter("stack_plantuml")
def adapt_stack(df: DataFrame) -> DataFrame:
    """Repository files; the spec is written from repository and path."""
    rows = _is_uml(_with_block(df, _text(df, "code")))
    rows = hold(rows, {"__kind": _mapped_type(df, F.col("__code"))})
    kind = F.col("__kind")
    repo = F.coalesce(F.nullif(_text(df, "repo_name"), F.lit("")), F.lit("unknown"))
    # --- fixed value: specification text of a repository file --------------------------------
    spec = F.concat(
        F.lit("## Technical Specification\n### Source\nOpen-source PlantUML file from The Stack v2 ("), repo,
        F.lit(").\n### Path\n"), _text(df, "path"), F.lit("\n### Target diagram type\n"), kind,
        F.lit("\n### Task\nRegenerate equivalent PlantUML for a "), kind,
        F.lit(" diagram matching this file's structure.\n"),
    )
    return _adapted(rows, [], input=spec, reasoning=F.lit(""), uml_code=F.col("__code"), inferred_type=kind)


@register_adapter("stack_source")
def adapt_stack_source(df: DataFrame) -> DataFrame:
    """Repository files with branch, extension and normalised language."""
    rows = _is_uml(_with_block(df, _text(df, "code")))
    raw = F.coalesce(F.nullif(_text(df, "gha_language"), F.lit("")), _text(df, "language"))
    rows = hold(rows, {"__kind": _mapped_type(df, F.col("__code")), "__lang": CD.normal_language(raw)})
    kind, lang = F.col("__kind"), F.col("__lang")

    def named(column: str, default: str) -> Column:
        return F.coalesce(F.nullif(_text(df, column), F.lit("")), F.lit(default))

    repo, branch, path = named("repo_name", "unknown"), named("branch_name", "main"), _text(df, "path")
    ext = F.coalesce(F.nullif(F.lower(X.strip(_text(df, "extension"))), F.lit("")), F.lit("puml"))
    # --- fixed values: specification and source context of a repository file ------------------
    spec = F.concat(
        F.lit("## Technical Specification\n### Source\nOpen-source repository on the web (The Stack v2).\n### Repository\n"), repo,
        F.lit("\n### Branch\n"), branch, F.lit("\n### Path\n"), path, F.lit("\n### Repository language\n"),
        F.coalesce(lang, F.lit("unknown")), F.lit("\n### File extension\n"), ext, F.lit("\n### Target diagram type\n"), kind,
        F.lit("\n### Task\nRegenerate equivalent black-and-white PlantUML for a "), kind, F.lit(" diagram from this "),
        F.coalesce(lang, F.lit("multi-language")), F.lit(" codebase artifact.\n"),
    )
    context = F.concat(
        F.lit("// Repository: "), repo, F.lit("\n// Branch: "), branch, F.lit("\n// Path: "), path,
        F.lit("\n// Language: "), F.coalesce(lang, F.lit("unknown")), F.lit("\n"),
    )
    return _adapted(
        rows, [], input=spec, source_requirement=context, reasoning=F.lit(""), uml_code=F.col("__code"),
        inferred_type=kind, input_mode=F.lit("source_code"), source_language=lang,
    )


@register_adapter("messages_chat")
def adapt_chat(df: DataFrame) -> DataFrame:
    """Last user and last assistant message of an array of messages."""
    def last(role: str) -> Column:
        said = F.filter("messages", lambda m: m["role"] == role)
        return F.coalesce(F.try_element_at(said, F.lit(-1))["content"], F.lit(""))

    pairs = hold(df, {"__user": last("user"), "__assistant": last("assistant")})
    return _pairs(pairs)


def adapt_turns(turns: DataFrame, conversation: str, turn: str, role: str, content: str) -> DataFrame:
    """B7 on a table with one row per turn: the last turn of each role, by aggregate."""
    def last(name: str) -> Column:
        mine = F.col(role) == name
        return F.coalesce(F.max_by(F.when(mine, F.col(content)), F.when(mine, F.col(turn))), F.lit(""))

    pairs = turns.groupBy(F.col(conversation).alias("row_id")).agg(
        last("user").alias("__user"), last("assistant").alias("__assistant")
    )
    return _pairs(pairs)


def _pairs(pairs: DataFrame) -> DataFrame:
    rows = _with_block(pairs, F.col("__assistant")).where(F.length("__user") >= 40)
    return _adapted(
        rows, [], input=F.col("__user"), reasoning=F.lit(""), uml_code=F.col("__code"),
        inferred_type=ST.inferred_type(F.col("__code")),
    )


def _before_tag(c: Column) -> Column:
    return F.split_part(c, F.lit("@startuml"), F.lit(1))


@register_adapter("inst_text")
def adapt_inst(df: DataFrame) -> DataFrame:
    """Prompt text in front of the block, instruction tags gone; the whole of it."""
    rows = _with_block(df, _text(df, "text"))
    before = X.strip(F.regexp_replace(F.regexp_replace(_before_tag(F.col("text")), r"</?s>", ""), r"\[/?INST\]", ""))
    rows = hold(rows, {"__before": before})
    fallback = F.concat(
        F.lit("Generate PlantUML for the following diagram:\n"),
        F.coalesce(F.nullif("__before", F.lit("")), F.lit("diagram from corpus")),
    )
    prompt = F.when(F.length("__before") < 40, fallback).otherwise(F.col("__before"))
    return _adapted(
        rows, [], input=prompt, reasoning=F.lit(""), uml_code=F.col("__code"),
        inferred_type=ST.inferred_type(F.col("__code")),
    )


@register_adapter("instruction_text")
def adapt_instruction(df: DataFrame) -> DataFrame:
    """The part between an instruction label and the answer."""
    rows = _with_block(df, _text(df, "text"))
    pattern = r"(?is)Instruction:\s*(.*?)(?:Response:|Output:|@startuml)"
    found = F.rlike("text", F.lit(pattern))
    part = X.strip(F.when(found, F.regexp_extract("text", pattern, 1)).otherwise(_before_tag(F.col("text"))))
    rows = hold(rows, {"__part": part})
    prompt = F.when(F.length("__part") < 40, F.lit("Generate a PlantUML diagram for the described system.")).otherwise(F.col("__part"))
    return _adapted(
        rows, [], input=prompt, reasoning=F.lit(""), uml_code=F.col("__code"),
        inferred_type=ST.inferred_type(F.col("__code")),
    )


@register_adapter("input_output")
def adapt_io(df: DataFrame) -> DataFrame:
    """Two text columns under either of their names."""
    def first(*names: str) -> Column:
        return F.coalesce(*[F.nullif(_text(df, n), F.lit("")) for n in names], F.lit(""))

    rows = _with_block(df, first("output", "uml_code"))
    rows = hold(rows, {"__in": X.strip(first("input", "prompt"))}).where(F.length("__in") >= 20)
    return _adapted(
        rows, [], input=F.col("__in"), reasoning=F.lit(""), uml_code=F.col("__code"),
        inferred_type=ST.inferred_type(F.col("__code")),
    )


@register_adapter("cas2uml")
def adapt_typed(df: DataFrame) -> DataFrame:
    """Drawings with a free-text type."""
    rows = _with_block(df, _text(df, "code"))
    t = F.lower(_text(df, "type"))
    kind = (
        F.when(F.contains(t, F.lit("class")), "class").when(F.contains(t, F.lit("seq")), "sequence")
        .when(F.contains(t, F.lit("use")), "usecase")
        .when(F.contains(t, F.lit("act")) | F.contains(t, F.lit("flow")), "flowchart")
        .when(F.contains(t, F.lit("state")), "state").otherwise(ST.inferred_type(F.col("__code")))
    )
    rows = hold(rows, {"__kind": kind, "__t": t})
    # --- fixed value: specification text of a drawing ------------------------------------------
    spec = F.concat(
        F.lit("## Technical Specification\n### Source\nHand-drawn UML → PlantUML (cas2uml).\n### Type\n"),
        F.coalesce(F.nullif("__t", F.lit("")), F.col("__kind")), F.lit("\n### Task\nProduce clean PlantUML for a "),
        F.col("__kind"), F.lit(" diagram.\n"),
    )
    return _adapted(rows, [], input=spec, reasoning=F.lit(""), uml_code=F.col("__code"), inferred_type=F.col("__kind"))


def flatten_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Array-valued text fields become lines."""
    types = dict(df.dtypes)
    arrays = [c for c in columns if types[c].startswith("array")]
    lines = {c: F.array_join(F.filter(F.transform(c, lambda x: x.cast("string")), lambda x: x.isNotNull()), "\n") for c in arrays}
    return df.withColumns(lines) if lines else df


def normalize(df: DataFrame, source: str) -> DataFrame:
    """B2: adapted rows with a resolved ``diagram_type`` to corpus rows."""
    ints = {k: S.to_int_score(F.nullif(F.col(k), F.lit(""))) for k in fixed.MODEL_KEYS}
    rows = df.withColumns(ints)
    scored = F.coalesce(*[F.col(k) for k in fixed.MODEL_KEYS]).isNotNull()
    composite = F.when(scored, S.wide_composite()).otherwise(F.coalesce("scores", F.lit(0.0)))
    votes = F.when(scored, S.wide_votes()).otherwise(F.lit(0))
    rows = rows.withColumn("composite_score", composite).withColumn("affirmative_votes", votes)
    spec = F.coalesce("input", F.lit(""))
    passed = ["row_id"] if "row_id" in df.columns else []
    return rows.select(
        *passed,
        X.short_id(F.col("uml_code")).alias("id"), "diagram_type",
        F.coalesce(F.nullif("source_requirement", F.lit("")), spec).alias("source_requirement"),
        spec.alias("technical_spec"), "uml_code", F.coalesce("reasoning", F.lit("")).alias("reasoning_private"),
        *fixed.MODEL_KEYS, "composite_score",
        (F.col("affirmative_votes") >= fixed.MIN_VOTES).alias("majority_accepted"),
        F.col("affirmative_votes").cast("int").alias("affirmative_votes"),
        ((F.col("affirmative_votes") >= fixed.MIN_VOTES) & (F.col("composite_score") >= fixed.MIN_COMPOSITE)).alias("dataset_accepted"),
        F.lit(source).alias("source_dataset"),
        F.coalesce("input_mode", F.lit("requirement")).alias("input_mode"), "source_language",
    )
