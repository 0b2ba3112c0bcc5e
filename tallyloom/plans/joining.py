"""Joins between entities."""

from pyspark.sql import functions as F

from ..functions import code as CD
from ..operators import codefacts as CF, joins as J
from .catalog import query
from .structures import BRACED, LANGUAGE, OWNER


@query(
    "d05_insert_missing",
    "SELECT ordinal, inserted FROM (SELECT ordinal, false AS inserted FROM corpus_a UNION ALL SELECT ordinal, true FROM corpus_b WHERE ordinal NOT IN (SELECT ordinal FROM corpus_a))",
    "corpus_a corpus_b",
)
def _(t):
    return J.insert_missing(t.corpus_a, t.corpus_b, "ordinal").select("ordinal", "inserted")


@query(
    "d05_insert_counts",
    "SELECT count(*) FILTER (WHERE ordinal NOT IN (SELECT ordinal FROM corpus_a)) AS inserted, count(*) FILTER (WHERE ordinal IN (SELECT ordinal FROM corpus_a)) AS skipped FROM corpus_b",
    "corpus_a corpus_b",
)
def _(t):
    return J.insert_counts(t.corpus_a, t.corpus_b, "ordinal")


@query(
    "d06_meta_files",
    "SELECT concat(artifact_id, '.puml') AS name, CASE WHEN artifact_id % 11 = 0 THEN 'missing_puml' END AS reason, CASE WHEN artifact_id % 11 <> 0 THEN length(plantuml_code) END AS chars FROM diagrams",
    "diagrams",
)
def _(t):
    name = F.concat(F.col("artifact_id").cast("string"), F.lit(".puml"))
    files = t.diagrams.where("artifact_id % 11 <> 0").select(name.alias("name"), F.col("plantuml_code").alias("text"))
    meta = t.artifacts.select(name.alias("name"))
    return J.with_files(meta, files, "name").select("name", "reason", F.length("text").alias("chars"))


@query(
    "d07_expand_types",
    "SELECT conv_id, turn, d AS diagram_type FROM conversations CROSS JOIN (VALUES ('class'), ('object'), ('component'), ('package')) v(d) WHERE role = 'user'",
)
def _(t):
    return J.expand_types(t.conversations.where("role = 'user'").select("conv_id", "turn"))


@query(
    "d10_reviewer_names",
    "SELECT artifact_id, reviewer_id, coalesce(s_name, 'unknown') AS reviewer_name FROM human_reviews LEFT JOIN supplier ON s_suppkey = reviewer_id",
    "human_reviews",
)
def _(t):
    reviewers = t.supplier.select(F.col("s_suppkey").alias("reviewer_id"), F.col("s_name").alias("name"))
    return J.with_reviewer_names(t.human_reviews, reviewers).select("artifact_id", "reviewer_id", "reviewer_name")


@query(
    "d11_upsert_reviewers",
    """WITH e AS (SELECT s_suppkey AS id, concat('user', s_suppkey) AS name, 'rater' AS role FROM supplier),
    l AS (SELECT concat('user', user_id) AS name, arg_max(event_type, ts) AS role FROM events GROUP BY 1)
    SELECT e.id, e.name, coalesce(l.role, e.role) AS role, false AS created FROM e LEFT JOIN l USING (name)
    UNION ALL SELECT (SELECT max(id) FROM e) + row_number() OVER (ORDER BY md5(name), name), name, role, true FROM l WHERE name NOT IN (SELECT name FROM e)""",
)
def _(t):
    existing = t.supplier.selectExpr("s_suppkey AS id", "concat('user', s_suppkey) AS name", "'rater' AS role")
    seen = t.events.selectExpr("concat('user', user_id) AS name", "event_type AS role", "ts AS at")
    return J.upsert_reviewers(existing, seen)


@query(
    "d13_golden_compare",
    f"""WITH s AS (SELECT artifact_id, code, {LANGUAGE} AS language FROM code_sources),
    k AS (SELECT artifact_id, language, list_transform(CASE WHEN language = 'python' THEN regexp_extract_all(code, '{OWNER}', 1) WHEN language IN ('c', 'cpp') THEN
        list_concat(regexp_extract_all(code, '{BRACED}', 1), regexp_extract_all(code, 'typedef\\s+struct\\s+(\\w+)?\\s*\\{{[^}}]*\\}}\\s*(\\w+)\\s*;', 2)) ELSE regexp_extract_all(code, '{BRACED}', 1) END, lambda x: lower(x)) AS types FROM s),
    m AS (SELECT k.artifact_id, language, list_filter(n, lambda x: NOT list_contains(types, lower(x))) AS missing FROM k JOIN named ON doc_id = k.artifact_id)
    SELECT artifact_id, language = ['java','python','c','javascript','go','unknown'][(artifact_id % 6 + 1)::INT] AS language_ok, array_to_string(list_sort(missing), ',') AS missing, len(missing) = 0 AS classes_ok FROM m""",
    "code_sources named",
)
def _(t):
    facts = CF.with_facts(t.code_sources)
    actual = facts.select(
        "artifact_id", F.col("language").alias("actual_language"),
        F.transform(F.filter("facts", lambda f: f["kind"] == "type"), lambda f: f["name"]).alias("actual_classes"),
    )
    langs = F.array(*[F.lit(x) for x in ("java", "python", "c", "javascript", "go", "unknown")])
    expected = t.named.select(
        F.col("doc_id").alias("artifact_id"), F.element_at(langs, (F.col("doc_id") % 6 + 1).cast("int")).alias("expected_language"),
        F.col("n").alias("expected_classes"),
    )
    out = J.golden_compare(expected, actual, "artifact_id")
    return out.withColumn("missing", F.array_join("missing", ","))
