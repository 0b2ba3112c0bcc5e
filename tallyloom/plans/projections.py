"""Projections, alignment and adapters."""

from pyspark.sql import functions as F

from .. import fixed, schema
from ..operators import adapters as AD, align as A, joins as J, scores as S
from . import sqltext as Q
from .catalog import query
from .reporting import rounded

NL = "chr(10)"
BLOCK = f"""CASE WHEN regexp_extract(s, '(?is)@startuml.*?@enduml') <> '' THEN regexp_extract(s, '(?is)@startuml.*?@enduml') WHEN contains(lower(s), '@startuml') THEN s ELSE '' END"""


def adapted_sql(raw: str, body: str, extra: str = "") -> str:
    """Rows with the block of ``raw`` as ``code`` and the lower-case ``c`` the type rules read."""
    return f"""WITH a AS (SELECT *, {Q.stripped(raw)} AS s FROM diagrams JOIN (SELECT doc_id AS artifact_id, text, lang, source FROM documents) d USING (artifact_id)),
    b AS (SELECT *, {BLOCK} AS code FROM a), e AS (SELECT *, lower(code) AS c FROM b WHERE length(code) >= 20) {extra} {body}"""


def raw_rows(t):
    return t.diagrams.join(t.documents.select(F.col("doc_id").alias("artifact_id"), "text", "lang", "source"), "artifact_id")


@query(
    "b01_align",
    """SELECT diagram_type, input_mode, coalesce(source_language, '(null)') AS source_language, dataset_accepted, source_dataset, merge_source, count(*) AS n, sum(length(technical_spec)) AS chars
    FROM (SELECT diagram_type, input_mode, source_language, source_requirement AS technical_spec, dataset_accepted, source_dataset, 's' AS merge_source FROM scored
      UNION ALL SELECT 'class', 'requirement', '', url, false, 'p', 'p' FROM pages) GROUP BY ALL""",
    "scored",
)
def _(t):
    first = A.align(t.scored.drop("technical_spec"), schema.MERGE, A.MERGE_DEFAULTS, "s")
    pages = t.pages.select(F.col("url").alias("source_requirement"), F.col("html").alias("uml_code"))
    both = first.unionByName(A.align(pages, schema.MERGE, A.MERGE_DEFAULTS, "p"))
    return both.groupBy(
        "diagram_type", "input_mode", F.coalesce("source_language", F.lit("(null)")).alias("source_language"),
        "dataset_accepted", "source_dataset", "merge_source",
    ).agg(F.count("*").alias("n"), F.sum(F.length("technical_spec")).alias("chars"))


RAW_SCORES = "CASE WHEN artifact_id % 6 = 0 THEN NULL WHEN artifact_id % 6 = 1 AND {i} = 1 THEN 'junk' ELSE concat(cast((artifact_id * {i}) % 7 AS string), CASE WHEN artifact_id % 2 = 0 THEN '.0' ELSE '' END) END"


@query(
    "b02_normalize",
    f"""WITH r AS (SELECT artifact_id, diagram_type, plantuml_code AS code, {', '.join(f"try_cast(try_cast({RAW_SCORES.format(i=i)} AS DOUBLE) AS INT) AS s{i}" for i in (1, 2, 3))} FROM diagrams WHERE length({Q.stripped('plantuml_code')}) >= 20),
    v AS (SELECT *, coalesce(s1, s2, s3) IS NOT NULL AS has, (coalesce(s1 >= 4, false)::INT + coalesce(s2 >= 4, false)::INT + coalesce(s3 >= 4, false)::INT) AS v,
      (coalesce(s1 * 53.1e0, 0) + coalesce(s2 * 50.7e0, 0) + coalesce(s3 * 39.9e0, 0)) / nullif((CASE WHEN s1 IS NULL THEN 0 ELSE 53.1e0 END + CASE WHEN s2 IS NULL THEN 0 ELSE 50.7e0 END + CASE WHEN s3 IS NULL THEN 0 ELSE 39.9e0 END), 0) AS s FROM r)
    SELECT artifact_id AS row_id, substr(sha1({Q.stripped('code')}), 1, 12) AS id, s1 AS qwen25vl3b, s2 AS llama32vl11b, s3 AS aya_vision_8b, round(CASE WHEN has THEN s ELSE 2.5 END, 6) AS composite_score,
      has AND v >= 2 AS majority_accepted, CASE WHEN has THEN v ELSE 0 END AS affirmative_votes, has AND v >= 2 AND s >= 3 AS dataset_accepted FROM v""",
    "diagrams",
)
def _(t):
    raw = t.diagrams.select(
        F.col("artifact_id").alias("row_id"), F.col("plantuml_code").alias("uml_code"), F.lit(2.5).alias("scores"),
        *[F.expr(RAW_SCORES.format(i=i)).alias(k) for i, k in enumerate(fixed.MODEL_KEYS, 1)],
    )
    rows = AD.normalize(AD.adapt_umlcode(raw).withColumn("diagram_type", F.col("inferred_type")), "s")
    return rounded(
        rows.select("row_id", "id", *fixed.MODEL_KEYS, "composite_score", "majority_accepted", "affirmative_votes", "dataset_accepted"),
        "composite_score",
    )


@query(
    "b03_soft_scores",
    f"SELECT artifact_id, try_cast(try_cast({RAW_SCORES.format(i=1)} AS DOUBLE) AS INT) AS score FROM artifacts",
    "artifacts",
)
def _(t):
    return t.artifacts.select("artifact_id", S.to_int_score(F.expr(RAW_SCORES.format(i=1))).alias("score"))


@query(
    "b04_adapt_umlcode",
    f"SELECT artifact_id AS row_id, inferred AS inferred_type, length(plantuml_code) AS chars FROM (SELECT *, {Q.INFERRED} AS inferred FROM (SELECT *, lower(plantuml_code) AS c FROM diagrams)) WHERE length({Q.stripped('plantuml_code')}) >= 20",
    "diagrams",
)
def _(t):
    rows = t.diagrams.select(F.col("artifact_id").alias("row_id"), F.col("plantuml_code").alias("uml_code"))
    return AD.adapt_umlcode(rows).select("row_id", "inferred_type", F.length("uml_code").alias("chars"))


SUBTYPE = "CASE artifact_id % 5 WHEN 0 THEN 'Use_Case' WHEN 1 THEN 'activity' WHEN 2 THEN 'odd' END"
MAPPED = f"CASE artifact_id % 5 WHEN 0 THEN 'usecase' WHEN 1 THEN 'flowchart' ELSE {Q.INFERRED} END"


@query(
    "b05_adapt_stack",
    adapted_sql(
        "plantuml_code",
        f"""SELECT artifact_id AS row_id, k AS inferred_type, md5(concat('## Technical Specification', {NL}, '### Source', {NL}, 'Open-source PlantUML file from The Stack v2 (', source, ').', {NL}, '### Path', {NL}, lang, {NL}, '### Target diagram type', {NL}, k, {NL},
      '### Task', {NL}, 'Regenerate equivalent PlantUML for a ', k, ' diagram matching this file''s structure.', {NL})) AS digest, length(code) AS chars FROM (SELECT *, {MAPPED} AS k FROM e) WHERE artifact_id % 4 <> 0""",
    ),
    "diagrams",
)
def _(t):
    raw = raw_rows(t).select(
        F.col("artifact_id").alias("row_id"), F.col("plantuml_code").alias("code"), F.col("source").alias("repo_name"),
        F.col("lang").alias("path"), F.expr(SUBTYPE).alias("uml_subtype"),
        F.expr("CASE artifact_id % 4 WHEN 0 THEN false WHEN 1 THEN true END").alias("uml"),
    )
    return AD.adapt_stack(raw).select("row_id", "inferred_type", F.md5("input").alias("digest"), F.length("uml_code").alias("chars"))


@query(
    "b06_adapt_stack_source",
    adapted_sql(
        "plantuml_code",
        f"""SELECT artifact_id AS row_id, k AS inferred_type, l AS source_language, md5(concat('// Repository: ', source, {NL}, '// Branch: ', CASE WHEN artifact_id % 3 = 0 THEN 'dev' ELSE 'main' END, {NL}, '// Path: ', lang, {NL}, '// Language: ', coalesce(l, 'unknown'), {NL})) AS context,
      md5(concat('## Technical Specification', {NL}, '### Source', {NL}, 'Open-source repository on the web (The Stack v2).', {NL}, '### Repository', {NL}, source, {NL}, '### Branch', {NL}, CASE WHEN artifact_id % 3 = 0 THEN 'dev' ELSE 'main' END, {NL}, '### Path', {NL}, lang, {NL},
       '### Repository language', {NL}, coalesce(l, 'unknown'), {NL}, '### File extension', {NL}, 'puml', {NL}, '### Target diagram type', {NL}, k, {NL}, '### Task', {NL}, 'Regenerate equivalent black-and-white PlantUML for a ', k, ' diagram from this ', coalesce(l, 'multi-language'), ' codebase artifact.', {NL})) AS digest
      FROM (SELECT *, {MAPPED} AS k, CASE artifact_id % 3 WHEN 0 THEN 'cpp' WHEN 1 THEN 'visual_basic' END AS l FROM e)""",
    ),
    "diagrams",
)
def _(t):
    raw = raw_rows(t).select(
        F.col("artifact_id").alias("row_id"), F.col("plantuml_code").alias("code"), F.col("source").alias("repo_name"),
        F.col("lang").alias("path"), F.expr(SUBTYPE).alias("uml_subtype"),
        F.expr("CASE WHEN artifact_id % 3 = 0 THEN 'dev' END").alias("branch_name"),
        F.expr("CASE artifact_id % 3 WHEN 0 THEN 'C++' WHEN 1 THEN 'Visual Basic' END").alias("gha_language"),
    )
    return AD.adapt_stack_source(raw).select(
        "row_id", "inferred_type", "source_language", F.md5("source_requirement").alias("context"), F.md5("input").alias("digest")
    )


TURN = "concat(text, chr(10), '@startuml', chr(10), 'class C', turn, chr(10), 'class D', conv_id, chr(10), '@enduml')"


@query(
    "b07_adapt_chat_turns",
    f"""SELECT conv_id AS row_id, md5(u) AS user_digest, md5(regexp_extract(a, '(?is)@startuml.*?@enduml')) AS code_digest FROM (
      SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS u, arg_max({TURN}, turn) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY conv_id)
    WHERE length(u) >= 40 AND a IS NOT NULL""",
)
def _(t):
    turns = t.conversations.withColumn(
        "text",
        F.when(F.col("role") == "assistant", F.expr("concat(text, '\n@startuml\nclass C', turn, '\nclass D', conv_id, '\n@enduml')")).otherwise(F.col("text")),
    )
    return AD.adapt_turns(turns, "conv_id", "turn", "role", "text").select(
        "row_id", F.md5("input").alias("user_digest"), F.md5("uml_code").alias("code_digest")
    )


@query(
    "b07_adapt_chat_messages",
    adapted_sql("plantuml_code", f"SELECT artifact_id AS row_id, {Q.INFERRED} AS inferred_type, length(text) AS chars FROM e WHERE length(text) >= 40"),
    "diagrams",
)
def _(t):
    def message(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    raw = raw_rows(t).select(
        F.col("artifact_id").alias("row_id"),
        F.array(
            message("user", F.lit("hello")), message("user", F.col("text")), message("assistant", F.col("plantuml_code")),
        ).alias("messages"),
    )
    return AD.adapt_chat(raw).select("row_id", "inferred_type", F.length("input").alias("chars"))


@query(
    "b08_adapt_inst",
    adapted_sql(
        f"concat('<s>[INST] ', text, ' [/INST]', {NL}, plantuml_code, '</s>')",
        f"""SELECT artifact_id AS row_id, md5(CASE WHEN length(p) < 40 THEN concat('Generate PlantUML for the following diagram:', {NL}, CASE WHEN p = '' THEN 'diagram from corpus' ELSE p END) ELSE p END) AS digest, length(code) AS chars FROM (
        SELECT *, {Q.stripped(f"regexp_replace(regexp_replace(string_split(concat('<s>[INST] ', text, ' [/INST]', {NL}, plantuml_code, '</s>'), '@startuml')[1], '</?s>', '', 'g'), '\\[/?INST\\]', '', 'g')")} AS p FROM e)""",
    ),
    "diagrams",
)
def _(t):
    raw = raw_rows(t).select(
        F.col("artifact_id").alias("row_id"),
        F.concat(F.lit("<s>[INST] "), "text", F.lit(" [/INST]\n"), "plantuml_code", F.lit("</s>")).alias("text"),
    )
    return AD.adapt_inst(raw).select("row_id", F.md5("input").alias("digest"), F.length("uml_code").alias("chars"))


_INSTR = f"CASE WHEN artifact_id % 3 = 0 THEN concat(text, {NL}, plantuml_code) ELSE concat('Instruction: ', text, {NL}, 'Response: ', plantuml_code) END"


@query(
    "b09_adapt_instruction",
    adapted_sql(
        _INSTR,
        f"""SELECT artifact_id AS row_id, md5(CASE WHEN length(p) < 40 THEN 'Generate a PlantUML diagram for the described system.' ELSE p END) AS digest FROM (
        SELECT *, {Q.stripped(f"CASE WHEN regexp_matches({_INSTR}, '(?is)Instruction:\\s*(.*?)(?:Response:|Output:|@startuml)') THEN regexp_extract({_INSTR}, '(?is)Instruction:\\s*(.*?)(?:Response:|Output:|@startuml)', 1) ELSE string_split({_INSTR}, '@startuml')[1] END")} AS p FROM e)""",
    ),
    "diagrams",
)
def _(t):
    plain = F.concat("text", F.lit("\n"), "plantuml_code")
    labelled = F.concat(F.lit("Instruction: "), "text", F.lit("\nResponse: "), "plantuml_code")
    raw = raw_rows(t).select(
        F.col("artifact_id").alias("row_id"), F.when(F.col("artifact_id") % 3 == 0, plain).otherwise(labelled).alias("text")
    )
    return AD.adapt_instruction(raw).select("row_id", F.md5("input").alias("digest"))


@query(
    "b10_adapt_io",
    adapted_sql("plantuml_code", f"SELECT artifact_id AS row_id, md5({Q.stripped('text')}) AS digest FROM e WHERE length({Q.stripped('text')}) >= 20"),
    "diagrams",
)
def _(t):
    raw = raw_rows(t).select(
        F.col("artifact_id").alias("row_id"), F.col("plantuml_code").alias("output"), F.col("text").alias("prompt")
    )
    return AD.adapt_io(raw).select("row_id", F.md5("input").alias("digest"))


@query(
    "b11_adapt_typed",
    adapted_sql(
        "plantuml_code",
        f"""SELECT artifact_id AS row_id, CASE artifact_id % 6 WHEN 0 THEN 'class' WHEN 1 THEN 'sequence' WHEN 2 THEN 'usecase' WHEN 3 THEN 'flowchart' WHEN 4 THEN 'state' ELSE {Q.INFERRED} END AS inferred_type FROM e""",
    ),
    "diagrams",
)
def _(t):
    kind = "CASE artifact_id % 6 WHEN 0 THEN 'Class drawing' WHEN 1 THEN 'SEQ' WHEN 2 THEN 'use case' WHEN 3 THEN 'Activity' WHEN 4 THEN 'states' ELSE 'sketch' END"
    raw = t.diagrams.select(F.col("artifact_id").alias("row_id"), F.col("plantuml_code").alias("code"), F.expr(kind).alias("type"))
    return AD.adapt_typed(raw).select("row_id", "inferred_type")


_TRIMMED = Q.stripped("plantuml_code")
_TAGGED = f"""CASE WHEN regexp_extract({_TRIMMED}, '(?is)@startuml.*?@enduml') <> '' THEN regexp_extract({_TRIMMED}, '(?is)@startuml.*?@enduml')
  WHEN contains(lower({_TRIMMED}), '@startuml') THEN {_TRIMMED} ELSE '' END"""


@query(
    "b12_adapter_registry",
    f"""WITH a AS (SELECT 'umlcode' AS adapter, plantuml_code AS code FROM diagrams WHERE length({_TRIMMED}) >= 20
      UNION ALL SELECT name, {_TAGGED} FROM diagrams, (VALUES ('stack_plantuml'), ('stack_source'), ('cas2uml')) v(name) WHERE length({_TAGGED}) >= 20)
    SELECT adapter, {Q.INFERRED} AS inferred_type, count(*) AS n FROM (SELECT adapter, lower(code) AS c FROM a) GROUP BY ALL""",
    "diagrams",
)
def _(t):
    rows = t.diagrams.select(F.col("artifact_id").alias("row_id"), F.col("plantuml_code").alias("uml_code"), F.col("plantuml_code").alias("code"))
    out = None
    for name in ("umlcode", "stack_plantuml", "stack_source", "cas2uml"):
        n = AD.ADAPTERS[name](rows).groupBy("inferred_type").agg(F.count("*").alias("n")).withColumn("adapter", F.lit(name))
        out = n if out is None else out.unionByName(n)
    return out


@query(
    "b13_flatten_text",
    f"SELECT doc_id, md5(array_to_string(n, {NL})) AS digest FROM named",
    "named",
)
def _(t):
    return AD.flatten_text(t.named.select("doc_id", "n"), ["n"]).select("doc_id", F.md5("n").alias("digest"))


@query(
    "b14_resolve_type",
    f"""SELECT mode, diagram_type, count(*) AS n FROM (
      SELECT 'allow' AS mode, CASE WHEN i IN ('class', 'object') THEN i WHEN i = 'unknown' THEN 'class' END AS diagram_type FROM (SELECT {Q.INFERRED} AS i FROM (SELECT lower(plantuml_code) AS c FROM diagrams))
      UNION ALL SELECT 'forced', 'class' FROM (SELECT {Q.INFERRED} AS i FROM (SELECT lower(plantuml_code) AS c FROM diagrams)) WHERE i NOT IN ('usecase', 'sequence', 'state', 'deployment')
      UNION ALL SELECT 'free', i FROM (SELECT {Q.INFERRED} AS i FROM (SELECT lower(plantuml_code) AS c FROM diagrams)) WHERE i <> 'unknown')
    WHERE diagram_type IS NOT NULL GROUP BY ALL""",
    "diagrams",
)
def _(t):
    from ..operators.structure import inferred_type
    from ..session import checkpointed

    # every text is read once: the modes resolve the few inferred types, counted
    rows = t.diagrams.select(inferred_type(F.col("plantuml_code")).alias("inferred_type"))
    rows = checkpointed(rows.groupBy("inferred_type").agg(F.count("*").alias("rows")))
    out = None
    for mode, df in [
        ("allow", A.resolve_type(rows, None, ["class", "object", "unknown"])),
        ("forced", A.resolve_type(rows, "class", None, strict=True)),
        ("free", A.resolve_type(rows, None, None)),
    ]:
        n = df.groupBy("diagram_type").agg(F.sum("rows").alias("n")).withColumn("mode", F.lit(mode))
        out = n if out is None else out.unionByName(n)
    return out


@query(
    "b15_scores_wide",
    """SELECT artifact_id, max(score) FILTER (WHERE model_key = 'qwen25vl3b') AS qwen25vl3b, max(score) FILTER (WHERE model_key = 'llama32vl11b') AS llama32vl11b,
      max(score) FILTER (WHERE model_key = 'aya_vision_8b') AS aya_vision_8b FROM model_scores GROUP BY artifact_id""",
    "model_scores",
)
def _(t):
    return S.scores_wide(t.model_scores, ["artifact_id"])


@query("b15_scores_long", "SELECT artifact_id, model_key, score FROM model_scores", "model_scores")
def _(t):
    return S.scores_long(S.scores_wide(t.model_scores, ["artifact_id"]), ["artifact_id"])


@query(
    "b15_stored_scores",
    "SELECT artifact_id, model_key, score FROM model_scores",
    "model_scores",
)
def _(t):
    stored = t.model_scores.withColumn("score", F.coalesce("score", F.lit(0)))
    return stored.select("artifact_id", "model_key", S.available_score(F.col("score"), F.col("available")).alias("score"))


@query(
    "b16_artifact_frame",
    """SELECT artifact_id AS id, diagram_type, input_mode, source_language, md5(plantuml_code) AS code_digest, render_status, image_path, round(composite_score, 6) AS scores,
      majority_accepted, affirmative_votes, dataset_accepted, strftime(make_timestamp(created_s * 1000000), '%Y-%m-%dT%H:%M:%S') AS created_at FROM scored""",
    "scored",
)
def _(t):
    frame = A.artifact_frame(t.scored).withColumn("code_digest", F.md5("uml_code"))
    return rounded(frame.drop("uml_code", "source_requirement", "technical_spec"), "scores")


@query(
    "b17_artifact_summary",
    "SELECT artifact_id AS id, diagram_type, input_mode, render_status, round(composite_score, 6) AS composite_score, majority_accepted, dataset_accepted, image_path IS NOT NULL AND render_status = 'success' AS has_image FROM scored",
    "scored",
)
def _(t):
    return rounded(A.artifact_summary(t.scored), "composite_score")


@query(
    "b18_detail_rows",
    """SELECT section, count(*) AS n, count(DISTINCT artifact_id) AS artifacts, min(info) AS low, max(info) AS high FROM (
      SELECT artifact_id, 'artifact' AS section, concat_ws('|', diagram_type, render_status) AS info FROM big_artifacts
      UNION ALL SELECT artifact_id, 'score', concat_ws('|', weight, coalesce(score::VARCHAR, 'na')) FROM model_scores
      UNION ALL SELECT artifact_id, 'render', concat_ws('|', success, coalesce(error_output, '')) FROM render_attempts
      UNION ALL SELECT artifact_id, 'repair', concat_ws('|', success, coalesce(reason, '')) FROM repair_attempts
      UNION ALL SELECT artifact_id, 'review', concat_ws('|', CASE reviewer_id WHEN 1 THEN 'ann' WHEN 2 THEN 'bo' ELSE 'unknown' END, score_scale) FROM human_reviews) GROUP BY section""",
    "big_artifacts model_scores render_attempts repair_attempts human_reviews",
)
def _(t):
    reviewers = t.spark.createDataFrame([(1, "ann"), (2, "bo")], "reviewer_id long, name string")
    details = J.detail_rows(
        t.big_artifacts, t.model_scores, t.render_attempts, t.repair_attempts, J.with_reviewer_names(t.human_reviews, reviewers)
    )
    return details.groupBy("section").agg(
        F.count("*").alias("n"), F.count_distinct("artifact_id").alias("artifacts"), F.min("info").alias("low"), F.max("info").alias("high")
    )


@query(
    "b19_tag_source",
    "SELECT coalesce(CASE WHEN ordinal % 3 <> 0 THEN source_dataset END, 'topup') AS source_dataset, count(*) AS n FROM corpus GROUP BY 1",
    "corpus",
)
def _(t):
    holes = t.corpus.withColumn("source_dataset", F.when(F.col("ordinal") % 3 != 0, F.col("source_dataset")))
    return A.tag_source(holes, "topup").groupBy("source_dataset").agg(F.count("*").alias("n"))


@query(
    "b22_assign_language",
    """SELECT artifact_id, CASE WHEN lower(coalesce(source_language, '')) IN ('java', 'python', 'c') THEN lower(source_language)
      ELSE ['java', 'python', 'c'][(concat('0x', substr(md5(artifact_id::VARCHAR), 1, 8))::BIGINT % 3 + 1)::INT] END AS lang FROM artifacts""",
    "artifacts",
)
def _(t):
    return t.artifacts.select("artifact_id", A.assign_language(F.col("source_language"), F.col("artifact_id")).alias("lang"))


@query(
    "b23_fill_composite",
    """SELECT artifact_id, round(CASE WHEN artifact_id % 2 = 0 THEN 1.5 ELSE s END, 6) AS scores FROM (
      SELECT artifact_id, sum(weight * score) / nullif(sum(CASE WHEN score IS NOT NULL THEN weight END), 0) AS s FROM model_scores GROUP BY artifact_id)""",
    "model_scores",
)
def _(t):
    wide = S.scores_wide(t.model_scores, ["artifact_id"]).withColumn("scores", F.when(F.col("artifact_id") % 2 == 0, F.lit(1.5)))
    return rounded(S.fill_composite(wide).select("artifact_id", "scores"), "scores")
