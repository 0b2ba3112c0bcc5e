"""Chat formatting by perspective rotation (operator 8); DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered once more, with that
speaker in the assistant's seat, the others as named users, and a loss mask over what the
assistant says. A rendering comes in parts of at most ``width`` turns, in order, so that a
conversation of any length never has to fit into one row; the texts of the parts, joined, are the
rendering, and masks and spans count from the start of their part.

Defined results: speakers are the distinct roles but ``system``, which takes no seat and is
rendered as itself; a null or blank role is the user ``unknown`` and takes no seat; a null text is
empty; repeated rows (same conversation, turn, role and text) are one turn; turns that share a
number stand in order of the md5 of role and text; a null turn stands first; rows without a
conversation id form one conversation of their own; a conversation without speakers gives no rows.
The opening mark inside a text or name is broken up, so that it can't be taken for a turn's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.rank import exact_rank
from ..session import checkpointed
from .common import query, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
UNKNOWN = "unknown"


def _plain(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    width: int = 64,
    system: str = "system",
) -> DataFrame:
    """One row per conversation, perspective and part: text, mask per turn, spans of the assistant."""
    name = F.trim(F.regexp_replace(F.coalesce(F.col(role), F.lit("")), r"\s+", " "))
    turns = (
        df.select(
            F.col(conversation).alias("conv"),
            F.coalesce(F.concat(F.lit("c"), F.col(conversation).cast("string")), F.lit("")).alias("key"),
            F.col(turn).cast("long").alias("turn"),
            F.when(name == "", F.lit(UNKNOWN)).otherwise(_plain(name)).alias("speaker"),
            (name != "").alias("named"),
            _plain(F.col(text)).alias("text"),
        )
        .withColumn("tie", F.md5(F.concat_ws("|", "speaker", "text")))
        .dropDuplicates(["key", "turn", "speaker", "text"])
    )
    turns = checkpointed(turns)  # read three times below
    place = F.coalesce(F.col("turn"), F.lit(-(2**62)))
    ranked = exact_rank(
        turns,
        [place, F.col("tie"), F.col("speaker"), F.col("text")],
        [F.shiftright(place, 16), place, F.substring("tie", 1, 4)],
        by=["key"],
    )
    parts = (
        ranked.withColumn("part", F.floor((F.col("rank") - 1) / width).cast("long"))
        .groupBy("key", "part")
        .agg(
            F.first("conv").alias("conv"),
            F.array_sort(F.collect_list(F.struct("rank", "speaker", "named", "text"))).alias("turns"),
        )
    )
    seats = ranked.where(F.col("named") & (F.col("speaker") != system)).groupBy("key", "speaker").agg(F.lit(1).alias("one"))
    each = parts.join(seats.select("key", F.col("speaker").alias("perspective")), "key")

    def trained(t: Column) -> Column:
        return t["named"] & (t["speaker"] == F.col("perspective"))

    def head(t: Column) -> Column:
        seat = (
            F.when(trained(t), F.lit("assistant"))
            .when(t["named"] & (t["speaker"] == system), F.lit("system"))
            .otherwise(F.concat(F.lit("user name="), t["speaker"]))
        )
        return F.concat(F.lit(OPEN), seat, F.lit("\n"))

    piece = F.transform(
        "turns",
        lambda t: F.struct(head(t).alias("head"), t["text"].alias("text"), trained(t).alias("on")),
    )
    made = each.select("conv", "perspective", "part", F.explode(F.array(piece)).alias("pieces"))
    lengths = F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["text"]) + len(CLOSE))
    before = F.transform(
        "pieces",
        lambda p, i: F.struct(
            p["on"].alias("on"),
            (F.aggregate(F.slice(F.col("lengths"), F.lit(1), i), F.lit(0), lambda a, x: a + x) + F.length(p["head"])).alias("start"),
            F.length(p["text"]).alias("size"),
        ),
    )
    spans = F.transform(F.filter("placed", lambda p: p["on"]), lambda p: F.struct(p["start"].alias("start"), (p["start"] + p["size"]).alias("end")))
    return (
        made.withColumn("lengths", lengths)
        .withColumn("placed", before)
        .select(
            F.col("conv").alias("conv_id"),
            "perspective",
            "part",
            F.size("pieces").cast("long").alias("n_turns"),
            F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], F.lit(CLOSE))), "").alias("text"),
            F.array_join(F.transform("pieces", lambda p: p["on"].cast("int").cast("string")), "").alias("mask"),
            spans.alias("spans"),
        )
    )


SQL = r"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn,
    CASE WHEN trim(regexp_replace(coalesce(role, ''), '\s+', ' ', 'g')) = '' THEN 'unknown' ELSE replace(trim(regexp_replace(coalesce(role, ''), '\s+', ' ', 'g')), '<|', '< |') END AS speaker,
    trim(regexp_replace(coalesce(role, ''), '\s+', ' ', 'g')) <> '' AS named,
    replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat_ws('|', speaker, text)), speaker, text) AS rank FROM turns),
seats AS (SELECT DISTINCT conv_id, speaker AS perspective FROM ranked WHERE named AND speaker <> 'system'),
pieces AS (
  SELECT r.conv_id, perspective, (rank - 1) // 64 AS part, rank, text, named AND speaker = perspective AS on_,
    '<|im_start|>' || CASE WHEN named AND speaker = perspective THEN 'assistant' WHEN named AND speaker = 'system' THEN 'system'
      ELSE 'user name=' || speaker END || chr(10) AS head
  FROM ranked r JOIN seats s ON r.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS whole,
    coalesce(sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, perspective, part ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
  FROM pieces)
SELECT conv_id, perspective, cast(part AS bigint) AS part, count(*) AS n_turns, string_agg(whole, '' ORDER BY rank) AS text,
  string_agg(CASE WHEN on_ THEN '1' ELSE '0' END, '' ORDER BY rank) AS mask,
  coalesce(string_agg(CASE WHEN on_ THEN concat(cast(start AS bigint), ':', cast(start + length(text) AS bigint)) END, ',' ORDER BY rank), '') AS spans
FROM placed GROUP BY conv_id, perspective, part
"""


@query("op8_perspectives", SQL)
def _(spark, folder):
    rows = rotate(table(spark, folder, "conversations"))
    return rows.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ","))
