"""Scalar functions over whole columns."""

from pyspark.sql import functions as F

from ..functions import code as CD, messages as M, replies as RP, text as X
from ..operators.hold import hold
from .catalog import query
from .gating import code_like
from .sqltext import stripped, unfenced

NL = "chr(10)"


@query(
    "h01_hashes",
    f"SELECT doc_id, sha1({stripped('text')}) AS hash, substr(sha1({stripped('text')}), 1, 12) AS id, substr(sha1(concat_ws('|', 'sc', doc_id, lang, source)), 1, 12) AS parts FROM documents",
)
def _(t):
    return t.texts.select(
        "doc_id", X.code_hash(F.col("text")).alias("hash"), X.short_id(F.col("text")).alias("id"),
        X.parts_id(F.lit("sc"), F.col("doc_id").cast("string"), F.col("lang"), F.col("source")).alias("parts"),
    )


@query(
    "h02_extract_block",
    f"""SELECT artifact_id, md5(CASE WHEN b <> '' THEN b WHEN s = '' THEN '' WHEN contains(lower(s), '@startuml') THEN s ELSE '' END) AS block,
      md5(CASE WHEN b <> '' THEN b WHEN s = '' THEN '' WHEN contains(lower(s), '@startuml') THEN s ELSE concat('@startuml', {NL}, s, {NL}, '@enduml') END) AS wrapped
    FROM (SELECT artifact_id, s, regexp_extract(s, '(?is)@startuml.*?@enduml') AS b FROM (
      SELECT artifact_id, {stripped('c')} AS s FROM (SELECT artifact_id, CASE artifact_id % 7 WHEN 1 THEN replace(plantuml_code, '@enduml', '') WHEN 2 THEN replace(plantuml_code, '@startuml', '') ELSE plantuml_code END AS c FROM diagrams)))""",
    "diagrams",
)
def _(t):
    c = F.expr("CASE artifact_id % 7 WHEN 1 THEN replace(plantuml_code, '@enduml', '') WHEN 2 THEN replace(plantuml_code, '@startuml', '') ELSE plantuml_code END")
    rows = hold(t.diagrams, {"c": c}, ["artifact_id"])
    return rows.select(
        "artifact_id", F.md5(X.extract_block(F.col("c"))).alias("block"), F.md5(X.extract_block(F.col("c"), wrap=True)).alias("wrapped")
    )


@query(
    "h03_clean_code",
    f"""SELECT artifact_id, md5({stripped('c')}) AS digest FROM (SELECT artifact_id, CASE WHEN contains(lower(o), '@enduml') THEN o ELSE concat(regexp_replace(o, '\\s+$', ''), {NL}, '@enduml') END AS c FROM (
      SELECT artifact_id, CASE WHEN contains(lower(u), '@startuml') THEN u ELSE concat('@startuml', {NL}, u) END AS o FROM (SELECT artifact_id, {unfenced('c')} AS u FROM (
        SELECT artifact_id, CASE artifact_id % 7 WHEN 1 THEN replace(plantuml_code, '@enduml', '') WHEN 2 THEN replace(plantuml_code, '@startuml', '') WHEN 3 THEN concat('```PlantUML', {NL}, plantuml_code, {NL}, '```') ELSE plantuml_code END AS c FROM diagrams))))""",
    "diagrams",
)
def _(t):
    c = F.expr(
        "CASE artifact_id % 7 WHEN 1 THEN replace(plantuml_code, '@enduml', '') WHEN 2 THEN replace(plantuml_code, '@startuml', '') "
        "WHEN 3 THEN concat('```PlantUML\n', plantuml_code, '\n```') ELSE plantuml_code END"
    )
    rows = hold(t.diagrams, {"c": c}, ["artifact_id"])
    return rows.select("artifact_id", F.md5(X.clean_code(F.col("c"))).alias("digest"))


@query(
    "h04_truncate",
    f"""SELECT doc_id, md5(CASE WHEN length(s) > 900 THEN concat(regexp_replace(substr(s, 1, 880), '\\s+$', ''), {NL}, '...[truncated]') ELSE s END) AS digest
    FROM (SELECT doc_id, {stripped('text')} AS s FROM documents)""",
)
def _(t):
    return t.texts.select("doc_id", F.md5(X.truncate(F.col("text"), 900)).alias("digest"))


@query(
    "h05_clip",
    f"""SELECT doc_id, md5(CASE WHEN length(s) > 1800 THEN concat(regexp_replace(substr(s, 1, 1296), '\\s+$', ''), {NL}, {NL}, '...[middle truncated for model length; full text still used for grounding]...', {NL}, {NL}, regexp_replace(right(s, 424), '^\\s+', '')) ELSE s END) AS long,
      md5(CASE WHEN length(s) > 600 THEN concat(regexp_replace(substr(s, 1, 560), '\\s+$', ''), {NL}, '...[truncated for model length]...') ELSE s END) AS short
    FROM (SELECT doc_id, {stripped('text')} AS s FROM documents)""",
)
def _(t):
    return t.texts.select(
        "doc_id", F.md5(X.clip(F.col("text"), 1800)).alias("long"), F.md5(X.clip(F.col("text"), 600)).alias("short")
    )


@query(
    "h06_strip_reasoning",
    f"""SELECT artifact_id, regexp_matches(plantuml_code, '(?is)<think>.*?</think>') AS had, md5({stripped("regexp_replace(regexp_replace(regexp_replace(regexp_replace(plantuml_code, '(?is)<think>.*?</think>', '', 'g'), '(?is)<reasoning>.*?</reasoning>', '', 'g'), '```(?:plantuml)?\\s*', '', 'g'), '```', '', 'g')")}) AS digest FROM diagrams""",
    "diagrams",
)
def _(t):
    return t.diagrams.select(
        "artifact_id", X.has_reasoning(F.col("plantuml_code")).alias("had"),
        F.md5(X.strip_reasoning(F.col("plantuml_code"))).alias("digest"),
    )


_L = "(?:SCORE|OVERALL(?:\\s+SCORE)?|FINAL(?:\\s+SCORE)?|RATING)"
_C = "(?:SEMANTIC|STRUCTURAL|SYNTACTIC|COHERENCE)"
_AC = "(?:SEMANTIC|STRUCTURAL|SYNTACTIC|COHERENCE|OVERALL|RATING|FINAL)"
_P = "[<\\[]\\s*0\\s*[-–—]\\s*6\\s*[>\\]]"
_FR = "(?im)\\b(?:score|rated|rating)\\s*(?:is\\s*|of\\s*|:\\s*)?([0-6])\\s*(?:/\\s*6|out\\s+of\\s+6)\\b"


@query(
    "h07_score_replies",
    f"""WITH a AS (SELECT artifact_id, regexp_replace(reply, '\\*+', '', 'g') AS k FROM replies),
    b AS (SELECT *, regexp_replace(k, '(?im)\\b(?:SCORE|SEMANTIC|STRUCTURAL|SYNTACTIC|COHERENCE|OVERALL|RATING|FINAL)\\s*[:\\-]\\s*{_P}', '', 'g') AS s FROM a),
    c AS (SELECT *, regexp_extract_all(s, '(?im)\\b{_L}\\s*[:\\-]\\s*([0-6])(?:\\s*/\\s*6)?\\b', 1) AS o, list_transform(regexp_extract_all(s, '(?im)\\b{_C}\\s*[:\\-]\\s*([0-6])\\b', 1), lambda x: x::INT) AS m,
      nullif(regexp_extract(s, '{_FR}', 1), '') AS f,
      list_filter(list_transform(regexp_extract_all(regexp_replace(s, '{_P}', ' ', 'g'), '\\d+'), lambda x: try_cast(x AS INT)), lambda x: x BETWEEN 0 AND 6) AS d FROM b),
    e AS (SELECT *, coalesce(o[len(o)]::INT, round_even(list_avg(m), 0)::INT, f::INT, d[1], 0) AS score FROM c)
    SELECT artifact_id, score, regexp_matches(k, '(?im)\\b{_L}\\s*[:\\-]\\s*[0-6]\\b') OR regexp_matches(k, '(?im)\\b{_C}\\s*[:\\-]\\s*[0-6]\\b') OR regexp_matches(k, '{_FR}') AS parsed,
      md5(coalesce(CASE WHEN regexp_matches(k, '(?is)^\\s*EXPLANATION\\s*[:\\-]\\s*') THEN nullif({stripped(f"regexp_replace(regexp_replace(regexp_replace(k, '(?is)^\\s*EXPLANATION\\s*[:\\-]\\s*', ''), '(?is)\\n\\s*(?:{_L}|{_AC}|EXPLANATION)\\s*[:\\-].*$', ''), '\\s+', ' ', 'g')")}, '') END,
       CASE WHEN x <> '' AND x <> score::VARCHAR THEN x END)) AS explanation
    FROM (SELECT *, {stripped(f"regexp_replace(regexp_replace({stripped(f"regexp_replace(s, '(?im)^\\s*(?:{_L}|{_AC})\\s*[:\\-]\\s*[0-6](?:\\s*/\\s*6)?\\s*$', '', 'g')")}, '(?im)^\\s*EXPLANATION\\s*[:\\-]\\s*', '', 'g'), '\\s+', ' ', 'g')")} AS x FROM e)""",
    "replies",
)
def _(t):
    rows = hold(t.replies, {"k": RP.scrubbed(F.col("reply"))}, ["artifact_id"])
    rows = hold(rows, {"s": RP.without_placeholders(F.col("k"))})
    rows = hold(rows, {"score": RP.score(F.col("s"))})
    return rows.select(
        "artifact_id", "score", RP.is_parsed(F.col("k")).alias("parsed"),
        F.md5(RP.explanation(F.col("k"), F.col("s"), F.col("score"))).alias("explanation"),
    )


@query(
    "h08_json_text",
    """SELECT artifact_id, md5(regexp_extract(regexp_replace(regexp_replace(regexp_replace(spec_text, '^\\s+|\\s+$', '', 'g'), '(?i)^```(?:json)?\\s*', ''), '\\s*```$', ''), '(?s)(\\{.*\\})', 1)) AS digest FROM specs""",
    "specs",
)
def _(t):
    return t.specs.select("artifact_id", F.md5(X.json_text(F.col("spec_text"))).alias("digest"))


@query(
    "h09_names",
    """SELECT word, CASE WHEN length(word) > 4 AND lower(word) LIKE '%ies' THEN concat(substr(word, 1, length(word) - 3), 'y')
      WHEN length(word) > 3 AND word LIKE '%s' AND word NOT LIKE '%ss' THEN substr(word, 1, length(word) - 1) ELSE word END AS one,
      CASE WHEN length(regexp_replace(lower(word), '(service|api|store|repository|module|package|item)s?$', '')) >= 5 THEN regexp_replace(lower(word), '(service|api|store|repository|module|package|item)s?$', '') ELSE lower(word) END AS stem
    FROM (SELECT DISTINCT CASE w.i % 4 WHEN 0 THEN concat(x, 'Services') WHEN 1 THEN concat(x, 'ies') WHEN 2 THEN concat(x, 'ss') ELSE x END AS word
      FROM (SELECT unnest(n) AS x, generate_subscripts(n, 1) AS i FROM named) w)""",
    "named",
)
def _(t):
    words = t.named.select(F.posexplode("n").alias("i", "x")).select(
        F.expr("CASE (i + 1) % 4 WHEN 0 THEN concat(x, 'Services') WHEN 1 THEN concat(x, 'ies') WHEN 2 THEN concat(x, 'ss') ELSE x END AS word")
    ).distinct()
    return words.select("word", X.singular(F.col("word")).alias("one"), X.stem(F.col("word")).alias("stem"))


def _clip_sql(c, limit):
    head, = (int(limit * 0.72),)
    tail = limit - head - 80
    if tail < 200:
        cut = f"concat(regexp_replace(substr({c}, 1, {limit - 40}), '\\s+$', ''), {NL}, '...[truncated for model length]...')"
    else:
        cut = (
            f"concat(regexp_replace(substr({c}, 1, {head}), '\\s+$', ''), {NL}, {NL}, '...[middle truncated for model length; full text still used for grounding]...', "
            f"{NL}, {NL}, regexp_replace(right({c}, {tail}), '^\\s+', ''))"
        )
    return f"CASE WHEN length({c}) > {limit} THEN {cut} ELSE {c} END"


def _trunc_sql(c, limit):
    return f"CASE WHEN length({c}) > {limit} THEN concat(regexp_replace(substr({c}, 1, {limit - 20}), '\\s+$', ''), {NL}, '...[truncated]') ELSE {c} END"


@query(
    "h10_chat_records",
    f"""WITH r AS (SELECT a.artifact_id, a.diagram_type, {stripped('technical_spec')} AS spec, {stripped('code')} AS src, source_language, {stripped('plantuml_code')} AS u0 FROM (
        SELECT artifact_id, diagram_type, technical_spec, source_language FROM artifacts) a JOIN code_sources USING (artifact_id) JOIN (SELECT artifact_id, plantuml_code FROM diagrams) USING (artifact_id)),
    q AS (SELECT *, {unfenced('u0')} AS u FROM r),
    c AS (SELECT *, {stripped(f"CASE WHEN contains(lower(o), '@enduml') THEN o ELSE concat(regexp_replace(o, '\\s+$', ''), {NL}, '@enduml') END")} AS uml FROM (SELECT *, CASE WHEN contains(lower(u), '@startuml') THEN u ELSE concat('@startuml', {NL}, u) END AS o FROM q)),
    d AS (SELECT *, {_trunc_sql('spec', 1800)} AS sp FROM c)
    SELECT artifact_id, md5(CASE WHEN {code_like('src')} AND length(src) >= 20 THEN
      concat('Target diagram type: ', diagram_type, {NL}, {NL}, 'Source code context (', coalesce(source_language, 'source'), '):', {NL}, {_clip_sql('src', 900)}, {NL}, {NL}, 'Technical specification:', {NL}, {_clip_sql('sp', 1800)}, {NL}, {NL},
        'Generate black-and-white PlantUML for a ', diagram_type, ' diagram from this codebase. Use a title, a DiagramGuide note in plain English, labeled relationships, and a legend so anyone on the team can track the software design.')
      ELSE concat('Target diagram type: ', diagram_type, {NL}, {NL}, 'Technical specification:', {NL}, {_clip_sql('sp', 1800)}, {NL}, {NL}, 'Generate PlantUML for a ', diagram_type,
        ' diagram. Include a title, a short note (note as DiagramGuide) explaining the picture in everyday language, English labels on every arrow, and a legend of symbols. The diagram is used to keep track of software design through the development lifecycle.') END) AS user_digest,
      md5({_trunc_sql('uml', 2500)}) AS answer_digest FROM d WHERE length(spec) >= 40 AND length(uml) >= 20""",
    "artifacts code_sources diagrams",
)
def _(t):
    rows = (
        t.artifacts.select("artifact_id", "diagram_type", "technical_spec", "source_language")
        .join(t.code_sources.select("artifact_id", F.col("code").alias("source_requirement")), "artifact_id")
        .join(t.diagrams.select("artifact_id", F.col("plantuml_code").alias("uml_code")), "artifact_id")
    )
    records = M.with_chat_records(rows, "You write PlantUML.")
    return records.select(
        "artifact_id", F.md5(F.col("messages")[1]["content"]).alias("user_digest"), F.md5(F.col("messages")[2]["content"]).alias("answer_digest")
    )


@query(
    "h11_language_names",
    """SELECT raw, CASE lower(trim(raw)) WHEN 'c#' THEN 'csharp' WHEN 'c++' THEN 'cpp' ELSE nullif(replace(lower(trim(raw)), ' ', '_'), '') END AS lang, n FROM (
      SELECT CASE doc_id % 7 WHEN 0 THEN 'C#' WHEN 1 THEN ' C++ ' WHEN 2 THEN 'Objective C' WHEN 3 THEN 'TypeScript' WHEN 4 THEN source ELSE lang END AS raw, count(*) AS n FROM documents GROUP BY 1)""",
)
def _(t):
    raw = F.expr("CASE doc_id % 7 WHEN 0 THEN 'C#' WHEN 1 THEN ' C++ ' WHEN 2 THEN 'Objective C' WHEN 3 THEN 'TypeScript' WHEN 4 THEN source ELSE lang END")
    counts = t.documents.groupBy(raw.alias("raw")).agg(F.count("*").alias("n"))
    return counts.select("raw", CD.normal_language(F.col("raw")).alias("lang"), "n")


@query(
    "h12_snippets",
    f"""SELECT doc_id, CASE WHEN length(s) > 120 THEN concat(substr(s, 1, 120), '…') ELSE s END AS snippet FROM (SELECT doc_id, {stripped("regexp_replace(text, '\\s+', ' ', 'g')")} AS s FROM documents)""",
)
def _(t):
    return t.texts.select("doc_id", X.snippet(F.col("text"), 120).alias("snippet"))


@query(
    "h13_iso_times",
    """SELECT event_id, strftime(CASE WHEN event_id % 5 = 4 THEN TIMESTAMP '2000-01-01 00:00:00' ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS at FROM events""",
)
def _(t):
    raw = F.when(F.col("event_id") % 5 == 4, F.lit("soon")).otherwise(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, F.lit("Z")).otherwise(F.lit("")))
    )
    at = X.iso_time(raw, F.lit("2000-01-01 00:00:00").cast("timestamp"))
    return t.events.select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


_GO = "(?i)\\b(generate|create|draw|make|build)\\b.{0,40}\\b(diagram|uml|plantuml|class|component|package|object)\\b|\\b(please\\s+)?(generate|create|draw)\\b|\\bgo\\s+ahead\\b|\\bready\\s+to\\s+(generate|create)\\b"
_GEN = "(?i)\\b(generate|create|draw|make|build)\\b.*\\b(diagram|uml|plantuml)\\b|\\b(class|component|package|object)\\s+diagram\\b|\\b(uml|plantuml)\\b"
_COR = "(?i)\\b(fix|correct|repair|change|update|add|remove|rename|edit|adjust|modify|instead|should|missing|wrong)\\b"
_QUE = "(?i)^\\s*(what|why|how|who|when|where|which|can you|do you|could you|should we|help me|explain)\\b|\\?\\s*$"
_MSG = "concat(CASE conv_id % 6 WHEN 0 THEN 'Please generate a class diagram. ' WHEN 1 THEN 'What is missing? ' WHEN 2 THEN 'Fix the wrong arrow. ' WHEN 3 THEN 'A uml of ' ELSE '' END, text)"


@query(
    "h14_intents",
    f"""SELECT conv_id, turn, CASE WHEN s = '' THEN 'chat' WHEN regexp_matches(s, '{_QUE}') AND NOT regexp_matches(s, '{_GO}') THEN 'chat' WHEN turn > 1 AND regexp_matches(s, '{_COR}') THEN 'correct'
      WHEN regexp_matches(s, '{_GO}') OR (regexp_matches(s, '{_GEN}') AND length(s) >= 24) THEN 'generate' WHEN turn > 1 AND length(s) >= 12 AND s NOT LIKE '%?' THEN 'correct' ELSE 'chat' END AS intent
    FROM (SELECT conv_id, turn, {stripped(_MSG)} AS s FROM conversations WHERE role = 'user')""",
)
def _(t):
    rows = t.conversations.where("role = 'user'")
    return rows.select("conv_id", "turn", M.intent(F.expr(_MSG), F.col("turn") > 1).alias("intent"))
