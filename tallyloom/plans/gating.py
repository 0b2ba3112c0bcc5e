"""Filters and gates."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedupe as D, gates as G
from .catalog import query
from .reporting import rounded

CLEAN = """CASE WHEN contains(lower({t}), '@enduml') THEN {t} ELSE concat(regexp_replace({t}, '\\s+$', ''), chr(10), '@enduml') END"""


def stripped(c):
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def unfenced(c):
    return f"regexp_replace(regexp_replace({stripped(c)}, '(?i)^```(?:plantuml)?\\s*', ''), '\\s*```$', '')"


def clean_sql(c):
    opened = f"CASE WHEN contains(lower({unfenced(c)}), '@startuml') THEN {unfenced(c)} ELSE concat('@startuml', chr(10), {unfenced(c)}) END"
    closed = f"CASE WHEN contains(lower(o), '@enduml') THEN o ELSE concat(regexp_replace(o, '\\s+$', ''), chr(10), '@enduml') END"
    return opened, closed


@query(
    "c01_library",
    """SELECT artifact_id, diagram_type, round(composite_score, 6) AS composite_score FROM scored
    WHERE render_status = 'success' AND majority_accepted AND composite_score >= 2.5 AND lower(source_requirement) LIKE '%the%'""",
    "scored",
)
def _(t):
    hits = G.library(t.scored, render_status="success", majority_accepted=True, min_score=2.5, q="The%")
    return rounded(hits.select("artifact_id", "diagram_type", "composite_score"), "composite_score")


@query(
    "c02_page",
    "SELECT artifact_id, diagram_type FROM scored WHERE diagram_type = 'class' ORDER BY artifact_id DESC LIMIT 25 OFFSET 50",
    "scored",
)
def _(t):
    return G.page(G.library(t.scored, diagram_type="class"), 25, 50).select("artifact_id", "diagram_type")


@query(
    "c03_min_gate",
    f"""SELECT artifact_id, length(plantuml_code) AS chars FROM diagrams JOIN specs USING (artifact_id)
    WHERE length(spec_text) >= 40 AND contains(lower(plantuml_code), '@startuml') AND length({stripped('plantuml_code')}) >= 80""",
    "diagrams specs",
)
def _(t):
    both = t.diagrams.join(t.specs.select("artifact_id", "spec_text"), "artifact_id")
    return G.min_gate(both, "spec_text", "plantuml_code", 80).select("artifact_id", F.length("plantuml_code").alias("chars"))


_opened, _closed = clean_sql("plantuml_code")
ENTITIES = "list_distinct(list_filter(regexp_extract_all(c, '(?im)^\\s*(?:abstract\\s+)?(?:class|interface|enum|object|component|package|node|database|queue|cloud)\\s+[\"''\\[\\{]?(\\w+)', 1), lambda n: lower(n) NOT IN ('as','note','title','legend','left','right','top','bottom')))"
RELS = """len(list_filter(string_split(c, chr(10)), lambda l: regexp_matches(l, '<\\|--|--\\|>|\\*--|o--|<\\|\\.\\.|\\.\\.\\|>|\\.\\.>|-->|->')
   AND NOT regexp_matches(l, '^\\s*(''|/''|(?i)note )')))"""


@query(
    "c04_complete_gate",
    f"""SELECT diagram_type, complete, count(*) AS n FROM (SELECT diagram_type, contains(lower(c), '@startuml') AND contains(lower(c), '@enduml')
      AND length(c) >= 280 AND NOT regexp_matches(c, '\\bType[23]\\b') AND len({ENTITIES}) >= 3 AND {RELS} >= 2 AS complete
      FROM (SELECT diagram_type, {stripped('c')} AS c FROM (SELECT diagram_type, {_closed} AS c FROM (SELECT diagram_type, {_opened} AS o FROM diagrams)))) GROUP BY ALL""",
    "diagrams",
)
def _(t):
    return G.with_complete(t.diagrams, "plantuml_code").groupBy("diagram_type", "complete").agg(F.count("*").alias("n"))


SIGNALS = [
    "\\b(class|def|function|interface|struct|enum|public|private|package|import|typedef)\\b", "[{};]\\s*$", "^\\s{2,}\\w+",
    "->|=>|::", "\\(\\s*self\\s*[,)]", "\\bprint\\s*\\(", "\\binput\\s*\\(", "^\\s*#", "^\\s*#\\s*include\\b",
]


def code_like(c):
    s = stripped(c)
    return f"(length({s}) >= 8 AND " + " + ".join(f"regexp_matches({s}, '(?m){p}')::INT" for p in SIGNALS) + " >= 2)"


@query(
    "c05_code_gate",
    f"""SELECT artifact_id % 6 AS kind, count(*) AS n FROM code_sources WHERE length(code) BETWEEN 80 AND 6000 AND {code_like('code')}
      AND len(list_filter(regexp_extract_all(code, '\\b(?:class|interface|enum|struct)\\s+(\\w+)', 1), lambda n: NOT regexp_matches(n, '(?i)^Module\\d+$'))) > 0
      AND NOT (length(code) - length(replace(code, chr(10), '')) < 2 AND length(code) > 400) GROUP BY 1""",
    "code_sources",
)
def _(t):
    kept = t.code_sources.where(G.code_gate(F.col("code")))
    return kept.groupBy((F.col("artifact_id") % 6).alias("kind")).agg(F.count("*").alias("n"))


@query(
    "c06_stub_sources",
    """SELECT artifact_id FROM (SELECT artifact_id, CASE WHEN artifact_id % 7 = 0 THEN concat('// Repository: x', chr(10), code) ELSE code END AS code FROM code_sources)
    WHERE regexp_matches(code, '(?m)^\\s*//\\s*Repository:') OR length(code) < 350 OR length(code) - length(replace(code, chr(10), '')) < 8""",
    "code_sources",
)
def _(t):
    rows = t.code_sources.withColumn(
        "code", F.when(F.col("artifact_id") % 7 == 0, F.concat(F.lit("// Repository: x\n"), "code")).otherwise(F.col("code"))
    )
    return rows.where(G.is_stub(F.col("code"))).select("artifact_id")


@query(
    "c07_clamp",
    """SELECT artifact_id, md5(CASE WHEN length(plantuml_code) > 3000 THEN concat(regexp_replace(substr(plantuml_code, 1, 2980), '\\s+$', ''), chr(10), '@enduml') ELSE plantuml_code END) AS digest
    FROM diagrams WHERE length(plantuml_code) >= 120""",
    "diagrams",
)
def _(t):
    return G.clamp(t.diagrams, "plantuml_code", 120, 3000).select("artifact_id", F.md5("plantuml_code").alias("digest"))


@query(
    "c08_drop_reasons",
    """WITH m AS (SELECT artifact_id, plantuml_code, CASE WHEN artifact_id % 31 = 0 THEN 'extraction_error' WHEN diagram_type IS NULL OR artifact_id % 29 = 0 THEN 'unknown_type'
      WHEN artifact_id % 23 = 0 THEN 'missing_puml' WHEN length(plantuml_code) < 150 THEN 'uml_too_short' END AS reason FROM diagrams),
    k AS (SELECT count(*) AS rows_left, count(DISTINCT sha1(regexp_replace(plantuml_code, '^\\s+|\\s+$', '', 'g'))) AS texts FROM m WHERE reason IS NULL)
    SELECT reason, count(*) AS n FROM m WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'kept', texts FROM k UNION ALL SELECT 'dedupe', rows_left - texts FROM k""",
    "diagrams",
)
def _(t):
    a = F.col("artifact_id")
    marked = t.diagrams.withColumn(
        "reason",
        G.first_reason(
            [
                ("extraction_error", a % 31 == 0),
                ("unknown_type", F.col("diagram_type").isNull() | (a % 29 == 0)),
                ("missing_puml", a % 23 == 0),
                ("uml_too_short", F.length("plantuml_code") < 150),
            ]
        ),
    )
    left = marked.where("reason IS NULL")
    kept = D.keep_first(left, [X.code_hash(F.col("plantuml_code"))], [a], copies="copies")
    return G.reason_counts(marked, kept, "copies")


@query(
    "c09_subset",
    "SELECT artifact_id, diagram_type, source_language FROM artifacts WHERE lower(diagram_type) IN ('class', 'package') AND lower(source_language) IN ('java', 'c')",
    "artifacts",
)
def _(t):
    return G.subset(t.artifacts, ["Class", "PACKAGE"], ["java", "c"]).select("artifact_id", "diagram_type", "source_language")


@query(
    "c10_needs_rescore",
    """SELECT artifact_id FROM scored WHERE render_status = 'success' AND NOT (composite_score > 0 AND affirmative_votes > 0
      AND NOT EXISTS (SELECT 1 FROM model_scores s WHERE s.artifact_id = scored.artifact_id AND lower(explanation) LIKE '%mock vlm%'))""",
    "scored model_scores",
)
def _(t):
    return G.needs_rescore(t.scored, t.model_scores).select("artifact_id")


@query(
    "c11_reap_stale",
    """SELECT job_id, CASE WHEN stale THEN 'failed' ELSE status END AS status,
      CASE WHEN stale THEN coalesce(nullif(error, ''), concat('Reaped stale ', status, ' job after 45m without completion (likely API restart mid-run).')) ELSE error END AS error, stale AS reaped
    FROM (SELECT *, status IN ('running', 'pending') AND (coalesce(updated_at, created_at) IS NULL
      OR coalesce(updated_at, created_at) <= TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 45 MINUTE) AS stale FROM jobs)""",
    "jobs",
)
def _(t):
    now = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    return G.reap_stale(t.jobs, now, 45).select("job_id", "status", "error", "reaped")


@query(
    "c11_reap_all",
    """SELECT status, error, count(*) AS n FROM (SELECT CASE WHEN s THEN 'failed' ELSE status END AS status,
      CASE WHEN s THEN coalesce(nullif(error, ''), concat('Reaped orphaned ', status, ' job on API startup (in-process worker did not survive restart).')) ELSE error END AS error
      FROM (SELECT *, status IN ('running', 'pending') AS s FROM jobs)) GROUP BY ALL""",
    "jobs",
)
def _(t):
    now = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    return G.reap_stale(t.jobs, now, None).groupBy("status", "error").agg(F.count("*").alias("n"))
