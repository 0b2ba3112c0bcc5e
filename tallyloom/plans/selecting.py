"""Harvest, quotas, samples, splits and mixes."""

from pyspark.sql import functions as F

from .. import fixed
from ..operators import codefacts as CF, rank as R, select as SE, split as SP, structure as ST, synth as SY
from ..operators.hold import hold
from . import sqltext as Q
from .catalog import query
from .reporting import rounded
from .structures import CODE_READ, EDGES, PROGRAM

FP = "array_to_string(list_filter(list_transform(string_split(regexp_replace(plantuml_code, '^\\s+|\\s+$', '', 'g'), chr(10)), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: l <> ''), chr(10))"
MARKED = """SELECT s.* EXCLUDE (plantuml_code), d.plantuml_code, h.artifact_id IS NOT NULL AS human,
  CASE WHEN NOT (dataset_accepted OR majority_accepted OR h.artifact_id IS NOT NULL) THEN 'ineligible'
    WHEN round(composite_score, 9) < 3 AND h.artifact_id IS NULL THEN 'low_score'
    WHEN length(regexp_replace(technical_spec, '^\\s+|\\s+$', '', 'g')) < 40 OR NOT contains(lower(d.plantuml_code), '@startuml')
      OR length(regexp_replace(d.plantuml_code, '^\\s+|\\s+$', '', 'g')) < 20 THEN 'invalid' END AS reason
  FROM scored s JOIN diagrams d USING (artifact_id) LEFT JOIN (SELECT DISTINCT artifact_id FROM human_reviews) h ON h.artifact_id = s.artifact_id WHERE render_status = 'success'"""
KEPT = f"""SELECT *, row_number() OVER (PARTITION BY {FP} ORDER BY NOT human, NOT dataset_accepted, NOT majority_accepted, -round(composite_score, 9), -artifact_id) AS rn,
  count(*) OVER (PARTITION BY {FP}) AS copies FROM ({MARKED}) WHERE reason IS NULL"""
HARVEST_VIEWS = "scored diagrams human_reviews"


def marked(t):
    rows = t.scored.drop("plantuml_code").join(t.diagrams.select("artifact_id", "plantuml_code"), "artifact_id")
    return SE.harvest_marks(rounded(rows, "composite_score", digits=9), t.human_reviews)


@query("d04_human_reviewed", "SELECT artifact_id, artifact_id IN (SELECT artifact_id FROM human_reviews) AS human_reviewed FROM artifacts WHERE render_status = 'success'", "artifacts human_reviews")
def _(t):
    return SE.harvest_marks(t.scored, t.human_reviews).select("artifact_id", "human_reviewed")


@query("f06_harvest", f"SELECT artifact_id, human AS human_reviewed, copies FROM ({KEPT}) WHERE rn = 1", HARVEST_VIEWS)
def _(t):
    return SE.harvest(marked(t), carry=["artifact_id", "human_reviewed"])


@query(
    "f06_harvest_stats",
    f"""WITH m AS ({MARKED}), k AS (SELECT * FROM ({KEPT}) WHERE rn = 1)
    SELECT 'scanned' AS stat, count(*) AS n FROM m UNION ALL SELECT 'skipped_ineligible', count(*) FROM m WHERE reason = 'ineligible'
    UNION ALL SELECT 'skipped_low_score', count(*) FROM m WHERE reason = 'low_score' UNION ALL SELECT 'skipped_invalid', count(*) FROM m WHERE reason = 'invalid'
    UNION ALL SELECT 'kept', count(*) FROM k UNION ALL SELECT 'deduped', sum(copies - 1)::BIGINT FROM k UNION ALL SELECT 'dataset_accepted', count(*) FROM k WHERE dataset_accepted
    UNION ALL SELECT 'majority_only', count(*) FROM k WHERE majority_accepted AND NOT dataset_accepted UNION ALL SELECT 'human_reviewed', count(*) FROM k WHERE human""",
    HARVEST_VIEWS,
)
def _(t):
    m = marked(t)
    return SE.harvest_stats(m, SE.harvest(m, carry=["dataset_accepted", "majority_accepted", "human_reviewed"]))


def md5_order(seed, key):
    return f"md5(concat_ws('|', '{seed}', {key})), {key}"


QUOTA_TYPES = ["object", "component", "class"]


@query(
    "f07_quota_select",
    f"""WITH s AS (SELECT ordinal, CASE WHEN diagram_type IN ('object', 'component', 'class') THEN diagram_type ELSE 'other' END AS st FROM corpus),
    c AS (SELECT st, count(*) AS n FROM s GROUP BY st), tot AS (SELECT count(*) AS n FROM s),
    k AS (SELECT o.i, o.st, coalesce(c.n, 0) AS n FROM (VALUES (0, 'object'), (1, 'component'), (2, 'class'), (3, 'other')) o(i, st) LEFT JOIN c USING (st)),
    p AS (SELECT *, CASE WHEN st = 'other' THEN 0 ELSE least(n, (SELECT n // 10 FROM tot)) END AS want, (SELECT n * 4 // 5 FROM tot) AS target FROM k),
    a AS (SELECT *, greatest(0, least(want, target - coalesce(sum(want) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM p),
    b AS (SELECT *, n - take AS rest, target - sum(take) OVER () AS open FROM a),
    q AS (SELECT st, take + greatest(0, least(rest, open - coalesce(sum(rest) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS quota FROM b)
    SELECT ordinal FROM (SELECT ordinal, st, row_number() OVER (PARTITION BY st ORDER BY {md5_order(42, 'ordinal')}) AS rn FROM s) JOIN q USING (st) WHERE rn <= quota""",
    "corpus",
)
def _(t):
    n = t.corpus.count()
    return SE.quota_select(t.corpus.select("ordinal", "diagram_type"), QUOTA_TYPES, n * 4 // 5, n // 10, "ordinal", 42)[["ordinal"]]


@query(
    "f08_stratified_snapshot",
    f"""SELECT artifact_id, diagram_type FROM (SELECT artifact_id, diagram_type, row_number() OVER (PARTITION BY diagram_type ORDER BY {md5_order(42, 'artifact_id')}) AS rn FROM big_artifacts) WHERE rn <= 10""",
    "big_artifacts",
)
def _(t):
    return SE.stratified(t.big_artifacts, 10, "artifact_id", 42).select("artifact_id", "diagram_type")


@query(
    "f08_shortfall",
    """SELECT d AS diagram_type, (SELECT max(k) FROM (SELECT count(*) AS k FROM artifacts GROUP BY diagram_type)) - count(artifact_id) AS shortfall
    FROM (VALUES ('class'), ('object'), ('component'), ('package')) v(d) LEFT JOIN artifacts ON diagram_type = d GROUP BY d HAVING shortfall > 0""",
    "artifacts",
)
def _(t):
    most = t.artifacts.groupBy("diagram_type").count().agg(F.max("count")).first()[0]
    return SE.shortfall(t.artifacts, most)


@query(
    "f09_sample",
    f"SELECT artifact_id FROM (SELECT artifact_id, row_number() OVER (ORDER BY {md5_order(7, 'artifact_id')}) AS rn FROM big_artifacts) WHERE rn <= 1200",
    "big_artifacts",
)
def _(t):
    return R.seeded_sample(t.big_artifacts.select("artifact_id"), "artifact_id", 7, 1200)


@query(
    "f10_language_select",
    f"""WITH s AS (SELECT ordinal, coalesce(source_language, 'unknown') AS lang, ordinal % 5 < 3 AS pref FROM corpus), tgt AS (SELECT count(*) * 7 // 10 AS target FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY pref, CASE WHEN pref THEN lang END ORDER BY {md5_order(42, 'ordinal')}) AS rn FROM s),
    t AS (SELECT *, CASE WHEN NOT pref THEN 2 WHEN rn <= greatest(1, (SELECT target FROM tgt) // (SELECT count(DISTINCT lang) FROM s WHERE pref)) THEN 0 ELSE 1 END AS tier FROM r)
    SELECT ordinal, tier FROM (SELECT *, row_number() OVER (ORDER BY tier, {md5_order(42, 'ordinal')}) AS place FROM t) WHERE place <= (SELECT target FROM tgt)""",
    "corpus",
)
def _(t):
    n = t.corpus.count()
    rows = t.corpus.select("ordinal", "source_language")
    return SE.language_select(rows, F.col("ordinal") % 5 < 3, n * 7 // 10, "ordinal", 42).select("ordinal", "tier")


def _balanced_sql(per_type, per_lang):
    steps, left = [], f"SELECT DISTINCT source_language AS l, {per_lang} AS r FROM b"
    for i, kind in enumerate(fixed.APP_TYPES):
        steps.append(
            f"""l{i} AS ({left}),
    p{i} AS (SELECT b.*, row_number() OVER (PARTITION BY l ORDER BY a, s, m) AS lr, r FROM b JOIN l{i} ON l = source_language WHERE diagram_type = '{kind}'),
    c{i} AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN lr <= r THEN 0 ELSE 1 END, a, s, m) AS place FROM p{i}) WHERE place <= {per_type})"""
        )
        left = f"SELECT l, r - (SELECT count(*) FROM c{i} WHERE source_language = l) AS r FROM l{i}"
    return ",\n".join(steps)


@query(
    "f11_balanced",
    f"""WITH b AS (SELECT ordinal, diagram_type, CASE WHEN source_language IS NULL THEN 'java' ELSE source_language END AS source_language, -length(uml_code) AS a, -length(technical_spec) AS s, md5(ordinal::VARCHAR) AS m, uml_code FROM corpus),
    {_balanced_sql(60, 70)}, u AS (SELECT ordinal, uml_code FROM c0 UNION ALL SELECT ordinal, uml_code FROM c1 UNION ALL SELECT ordinal, uml_code FROM c2 UNION ALL SELECT ordinal, uml_code FROM c3)
    SELECT min(ordinal) AS ordinal FROM u GROUP BY uml_code""",
    "corpus",
)
def _(t):
    rows = t.corpus.withColumn("source_requirement", F.col("technical_spec"))
    return SE.balanced(rows, 60, 70, "ordinal").select("ordinal")


@query(
    "f12_even_topup",
    f"""WITH r AS (SELECT ordinal, diagram_type, row_number() OVER (PARTITION BY diagram_type ORDER BY {md5_order(42, 'ordinal')}) AS rn FROM corpus),
    t AS (SELECT *, CASE WHEN rn <= 80 THEN 0 ELSE 1 END AS tier FROM r)
    SELECT ordinal FROM (SELECT *, row_number() OVER (ORDER BY tier, {md5_order(42, 'ordinal')}) AS place FROM t) WHERE tier = 0 OR place <= 320""",
    "corpus",
)
def _(t):
    return SE.topup_even(t.corpus.select("ordinal", "diagram_type"), 320, "ordinal", 42, least=50).select("ordinal")


@query(
    "f13_exact_split",
    f"""WITH r AS (SELECT artifact_id, row_number() OVER (ORDER BY {md5_order(42, 'artifact_id')}) AS rn, count(*) OVER () AS n FROM big_artifacts)
    SELECT artifact_id, CASE WHEN rn <= greatest(1, floor(n * 0.05e0)) THEN 'test' WHEN rn <= greatest(1, floor(n * 0.05e0)) + greatest(1, floor(n * 0.05e0)) THEN 'valid' ELSE 'train' END AS split FROM r""",
    "big_artifacts",
)
def _(t):
    return SP.exact_split(t.big_artifacts.select("artifact_id"), ["artifact_id"], 42)


@query(
    "f13_leakfree_split",
    """WITH h AS (SELECT DISTINCT sha1(uml_code) AS h FROM corpus), r AS (SELECT h, row_number() OVER (ORDER BY md5(concat_ws('|', '42', h)), h) AS rn, count(*) OVER () AS n FROM h)
    SELECT ordinal, CASE WHEN rn <= greatest(1, floor(n * 0.1e0)) THEN 'test' WHEN rn <= 2 * greatest(1, floor(n * 0.1e0)) THEN 'valid' ELSE 'train' END AS split FROM corpus JOIN r ON h = sha1(uml_code)""",
    "corpus",
)
def _(t):
    return SP.leakfree_split(t.corpus, F.sha1("uml_code"), 42, 0.1, 0.1).select("ordinal", "split")


@query(
    "f14_upsample",
    "SELECT ordinal, c AS copy FROM corpus, (VALUES (0), (1)) v(c) WHERE c = 0 OR dataset_accepted",
    "corpus",
)
def _(t):
    return SP.upsample_accepted(t.corpus).select("ordinal", "copy")


@query(
    "f14_compat_split",
    """WITH u AS (SELECT ordinal, c AS copy FROM corpus, (VALUES (0), (1)) v(c) WHERE c = 0 OR dataset_accepted),
    r AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', ordinal, copy)), ordinal, copy) AS rn, count(*) OVER () AS n FROM u)
    SELECT ordinal, copy, CASE WHEN rn <= greatest(1, floor(n * 0.05e0)) THEN 'test' WHEN rn <= 2 * greatest(1, floor(n * 0.05e0)) THEN 'valid' ELSE 'train' END AS split FROM r""",
    "corpus",
)
def _(t):
    copies = SP.upsample_accepted(t.corpus.select("ordinal", "dataset_accepted"))
    return SP.exact_split(copies, ["ordinal", "copy"], 42).select("ordinal", "copy", "split")


@query(
    "f15_boosted_mix",
    f"""WITH h AS (SELECT artifact_id AS ordinal, human, round(composite_score, 9) AS scores FROM ({KEPT}) WHERE rn = 1),
    s AS (SELECT ordinal FROM (SELECT ordinal, row_number() OVER (ORDER BY {md5_order(42, 'ordinal')}) AS rn FROM (SELECT artifact_id AS ordinal FROM diagrams)) WHERE rn <= 300)
    SELECT ordinal, mix_source, n FROM (
      SELECT ordinal, 'live_accepted' AS mix_source, 1 + human::INT + (scores >= 4)::INT AS n FROM h
      UNION ALL SELECT ordinal, 'diagrams', 1 FROM s)
    WHERE ordinal IN (SELECT artifact_id FROM diagrams WHERE contains(lower(plantuml_code), '@startuml')) AND ordinal IN (SELECT doc_id FROM documents WHERE length(text) >= 40)""",
    HARVEST_VIEWS,
)
def _(t):
    mix = SP.boosted_mix(*mix_parts(t), "ordinal", 42)
    return mix.groupBy("ordinal", "mix_source").agg(F.count("*").alias("n"))


@query(
    "f15_mix_counts",
    f"""WITH h AS (SELECT artifact_id AS ordinal, 1 + human::INT + (round(composite_score, 9) >= 4)::INT AS n FROM ({KEPT}) WHERE rn = 1),
    s AS (SELECT ordinal FROM (SELECT ordinal, row_number() OVER (ORDER BY {md5_order(42, 'ordinal')}) AS rn FROM (SELECT artifact_id AS ordinal FROM diagrams)) WHERE rn <= 300),
    ok AS (SELECT artifact_id AS ordinal FROM diagrams JOIN documents ON doc_id = artifact_id WHERE contains(lower(plantuml_code), '@startuml') AND length(text) >= 40)
    SELECT 'live_accepted' AS mix_source, count(*) AS rows FROM h UNION ALL SELECT 'live_after_boost', sum(n)::BIGINT FROM h UNION ALL SELECT 'diagrams_sample', count(*) FROM s
    UNION ALL SELECT 'row_count', ((SELECT sum(n) FROM h SEMI JOIN ok USING (ordinal)) + (SELECT count(*) FROM s SEMI JOIN ok USING (ordinal)))::BIGINT""",
    HARVEST_VIEWS,
)
def _(t):
    h, others = mix_parts(t)
    return SP.mix_counts(h, others, SP.boosted_mix(h, others, "ordinal", 42))


def mix_parts(t):
    h = SE.harvest(marked(t)).select(
        F.col("artifact_id").alias("ordinal"), "diagram_type", "technical_spec", F.col("plantuml_code").alias("uml_code"),
        "human_reviewed", F.col("composite_score").alias("scores"),
    )
    drawn = t.artifacts.select("artifact_id", "diagram_type", "technical_spec").join(t.diagrams.select("artifact_id", "plantuml_code"), "artifact_id")
    others = drawn.select(F.col("artifact_id").alias("ordinal"), "diagram_type", "technical_spec", F.col("plantuml_code").alias("uml_code"))
    return h, [("diagrams", others, 300)]


@query(
    "f16_work_list",
    """SELECT artifact_id, diagram_type, place FROM (SELECT artifact_id, diagram_type, row_number() OVER (PARTITION BY diagram_type ORDER BY artifact_id) AS place
      FROM (SELECT *, row_number() OVER (ORDER BY artifact_id) AS seen FROM artifacts WHERE length(regexp_replace(source_requirement, '^\\s+|\\s+$', '', 'g')) >= 3) WHERE seen > 40) WHERE place <= 5""",
    "artifacts",
)
def _(t):
    chosen = SE.work_list(t.artifacts, 5, 40, "artifact_id")
    return chosen.select("artifact_id", "diagram_type", "place")


def _template_sql(templates, by):
    def text(template):
        parts = []
        for i, piece in enumerate(template.split("%")):
            if i:
                parts.append({"A": "a", "B": "b", "C": "c", "a": "lower(a)"}[piece[0]])
                piece = piece[1:]
            parts.append("'" + piece.replace("'", "''") + "'")
        return f"concat({', '.join(parts)})"

    return f"CASE {by} " + " ".join(f"WHEN '{k}' THEN {text(v)}" for k, v in templates.items()) + " END"


_DOMAINS = "[" + ", ".join(f"'{d}'" for d in fixed.DOMAIN_ENTITIES) + "]"
_POOLS = "[" + ", ".join("[" + ", ".join(f"'{e}'" for e in v) + "]" for v in fixed.DOMAIN_ENTITIES.values()) + "]"
SYNTH = f"""SELECT n AS number, d AS domain, t AS diagram_type, l AS source_language, substr(sha1(concat_ws('|', 'cd', n, l, t)), 1, 12) AS id,
  {_template_sql(SY.SOURCE_TEMPLATES, 'l')} AS source_requirement, {_template_sql(SY.DIAGRAM_TEMPLATES, 't')} AS uml_code
  FROM (SELECT *, concat(p[(k % 6 + 1)::INT], n) AS a, concat(p[((k + 2) % 6 + 1)::INT], n) AS b, concat(p[((k + 5) % 6 + 1)::INT], n) AS c FROM (
    SELECT n, {_DOMAINS}[(n % 20 + 1)::INT] AS d, {_POOLS}[(n % 20 + 1)::INT] AS p, ['class','object','component','package','flowchart'][(n % 5 + 1)::INT] AS t,
      ['java','python','c'][(n % 3 + 1)::INT] AS l, n // 20 AS k FROM numbers))"""


@query(
    "l15_synthetic_rows",
    f"WITH numbers AS (SELECT doc_id AS n FROM documents) SELECT number, domain, diagram_type, source_language, id, md5(source_requirement) AS source_digest, md5(uml_code) AS code_digest FROM ({SYNTH})",
)
def _(t):
    made = SY.sample_rows(t.documents.select("doc_id"), "doc_id")
    return made.select(
        "number", "domain", "diagram_type", "source_language", "id",
        F.md5("source_requirement").alias("source_digest"), F.md5("uml_code").alias("code_digest"),
    )


def _filled(template, **values):
    """SQL text of a template by replacing its places one after the other."""
    out = "'" + template.replace("'", "' || chr(39) || '") + "'"
    for key, value in values.items():
        out = f"replace({out}, '%{key}', {value})"
    return out


_PICKED = f"""SELECT *, concat(p[i + 1], n % 10000) AS a, concat(p[j + 1], n % 10000) AS b, concat(list_filter(p, lambda x, q: q <> i + 1 AND q <> j + 1)[k + 1], n % 10000) AS c FROM (
  SELECT n, d, p, t, i, CASE WHEN h >= i THEN h + 1 ELSE h END AS j, k FROM (
    SELECT doc_id AS n, {_DOMAINS}[(doc_id % 20 + 1)::INT] AS d, {_POOLS}[(doc_id % 20 + 1)::INT] AS p, ['class','object','component','package','flowchart'][(doc_id % 5 + 1)::INT] AS t,
      (doc_id // 20 % 6)::INT AS i, (doc_id // 120 % 5)::INT AS h, (doc_id // 600 % 4)::INT AS k FROM documents))"""
_ENTS = {"A": "a", "B": "b", "C": "c"}
_UML = "CASE t " + " ".join(f"WHEN '{k}' THEN {_filled(v, **_ENTS, a='lower(a)')}" for k, v in SY.DIAGRAM_TEMPLATES.items()) + " END"
_SCENARIO = "CASE n % 20 " + " ".join(f"WHEN {i} THEN {_filled(v, **_ENTS, D='d')}" for i, (_, v) in enumerate(fixed.SCENARIO_TEMPLATES)) + " END"
_HUMAN = "['en','en','es','fr','de','hi','zh','pt','it','ja','ko','ar','ru','nl','tr','pl','sv','vi','th','id'][(n % 20 + 1)::INT]"
_DIGESTS = ["source_requirement", "technical_spec", "uml_code"]


@query(
    "l15_scenario_rows",
    f"""SELECT n AS number, d AS domain, t AS diagram_type, l AS human_language, substr(sha1(concat('sc|', n, '|', t, '|', l)), 1, 12) AS id, md5(r) AS source_requirement, md5({_UML}) AS uml_code,
      md5(concat('## Technical Specification\n### Domain\n', d, '\n### Language\n', l, '\n### Entities\n- ', a, '\n- ', b, '\n- ', c, '\n### Relationships\n- ', b, ' specializes or depends on ', a, '\n- ', a, ' associates with ', c, '\n### Source intent\n', r, '\n')) AS technical_spec
    FROM (SELECT *, {_HUMAN} AS l, {_SCENARIO} AS r FROM ({_PICKED}))""",
)
def _(t):
    made = SY.scenario_rows(t.documents.select("doc_id"), "doc_id")
    return made.select("number", "domain", "diagram_type", "human_language", "id", *[F.md5(x).alias(x) for x in _DIGESTS])


_CODE = "CASE n % 22 " + " ".join(
    f"WHEN {i} THEN {_filled(v, **_ENTS, m=repr('process'), n=repr('validate'), M=repr('Process'), N=repr('Validate'))}" for i, (_, v) in enumerate(fixed.CODE_TEMPLATES)
) + " END"
_CODE_LANGS = "['python','java','c','javascript','typescript','rust','go','csharp','kotlin','swift','cpp','c','ruby','php','scala','dart','perl','lua','r','matlab','haskell','elixir'][(n % 22 + 1)::INT]"


@query(
    "l15_code_rows",
    f"""SELECT n AS number, d AS domain, t AS diagram_type, l AS source_language, substr(sha1(concat('cd|', n, '|', l, '|', t)), 1, 12) AS id, md5({_CODE}) AS source_requirement, md5({_UML}) AS uml_code,
      md5(concat('## Technical Specification\n### Detected language\n- ', l, '\n### Source intent\nReverse-engineer UML from ', l, ' source for ', d, '.\n### Entities\n- ', a, '\n- ', b, '\n- ', c, '\n### Methods\n- ', a, '.process\n- ', b, '.validate\n')) AS technical_spec
    FROM (SELECT * REPLACE (CASE WHEN t = 'object' AND l IN ('haskell', 'r', 'matlab') THEN 'class' ELSE t END AS t) FROM (SELECT *, {_CODE_LANGS} AS l FROM ({_PICKED})))""",
)
def _(t):
    made = SY.code_rows(t.documents.select("doc_id"), "doc_id")
    return made.select("number", "domain", "diagram_type", "source_language", "id", *[F.md5(x).alias(x) for x in _DIGESTS])


_FOCUS_SPEC = """concat('## Technical Specification (from source code)\n### Detected language\n- ', CASE WHEN l = 'c' THEN 'c' ELSE l END, '\n### Source intent\nReverse-engineered structural model from provided source code.\n### Entities\n',
  CASE n % 4 WHEN 0 THEN '- ' || a || ': process\n- ' || b || ': validate\n  - inherits: ' || a || '\n- ' || c || ': link\n### Relationships\n- ' || b || ' inherits ' || a
    WHEN 1 THEN '- ' || a || ': (no methods extracted)\n- ' || b || ': (no methods extracted)\n  - inherits: ' || a || '\n- ' || c || ': (no methods extracted)\n### Relationships\n- ' || b || ' inherits ' || a
    ELSE '- ' || a || ': (no methods extracted)\n- ' || b || ': (no methods extracted)\n- ' || c || ': (no methods extracted)\n### Relationships\n- ' || a || ' associates with ' || b END,
  CASE WHEN t = 'flowchart' THEN '\n### Process steps\n1. ' || 'Initialize\n2. Run script logic\n3. Finish' ELSE '' END, '\n### Modules\n- domain: primary types from source')"""


@query(
    "l15_focus_rows",
    f"""SELECT n AS number, l AS source_language, t AS diagram_type, substr(sha1(concat('cd|', n, '|', l, '|', t)), 1, 12) AS id, technical_spec
    FROM (SELECT n, l, t, CASE WHEN t = 'flowchart' AND l = 'c' THEN replace({_FOCUS_SPEC}, '1. Initialize\n2. Run script logic\n3. Finish', '1. include <stdio.h>\n2. include <stdlib.h>') ELSE {_FOCUS_SPEC} END AS technical_spec
      FROM (SELECT *, ['python','java','c','c'][(n % 4 + 1)::INT] AS l FROM ({_PICKED})))""",
)
def _(t):
    made = SY.code_rows(t.documents.select("doc_id"), "doc_id", fixed.FOCUS_LANGS)
    return made.select("number", "source_language", "diagram_type", "id", "technical_spec")


_STAMPED = "replace(uml_code, '@startuml', concat('@startuml', chr(10), chr(39), ' training-id:', id))"


@query(
    "f19_topup_to_target",
    f"""WITH own AS (SELECT DISTINCT uml_code FROM corpus), numbers AS (SELECT unnest(range((SELECT count(*) // 2 + 100 FROM own))) AS n), s AS ({SYNTH}),
    base AS (SELECT uml_code FROM own UNION SELECT {_STAMPED} FROM s WHERE number < 30 OR number BETWEEN 40 AND 44), k AS (SELECT count(*) // 4 AS need FROM base),
    made AS (SELECT number, {_STAMPED} AS uml_code FROM s WHERE number BETWEEN 30 AND 39 OR number >= 45),
    u AS (SELECT uml_code, NULL AS number, false AS synthetic FROM base
      UNION ALL SELECT uml_code, number, true FROM (SELECT *, row_number() OVER (ORDER BY number) AS place FROM made) WHERE place <= (SELECT need FROM k))
    SELECT count(*) AS rows, count(*) FILTER (WHERE synthetic) AS synthetic, count(DISTINCT uml_code) AS texts, max(number) AS last_number, round(count(*) FILTER (WHERE synthetic) / count(*), 6) AS synthetic_share FROM u""",
    "corpus",
)
def _(t):
    # some template rows are in the corpus already: their numbers collide, and further ones take their places
    there = SY.stamped_rows(t.spark.range(45)).where("number < 30 OR number >= 40").select(F.col("number").alias("ordinal"), "uml_code")
    corpus = t.corpus.select("ordinal", "uml_code").unionByName(there)
    have = corpus.select(F.sha1("uml_code")).distinct().count()
    out = SY.top_up(corpus, have + have // 4, "ordinal", spare=10).agg(
        F.count("*").alias("rows"), F.count_if("synthetic").alias("synthetic"), F.count_distinct(F.sha1("uml_code")).alias("texts"),
        F.max("number").alias("last_number"), (F.count_if("synthetic") / F.count("*")).alias("synthetic_share"),
    )
    return rounded(out, "synthetic_share")


@query(
    "a08_cycle_rows",
    """SELECT doc_id AS number, md5(CASE WHEN doc_id < k THEN text ELSE concat(text, ' (variant ', doc_id + 1, ')') END) AS digest
    FROM (SELECT doc_id, (SELECT count(*) FROM benchmark) AS k FROM documents) JOIN benchmark ON item_id = doc_id % k""",
)
def _(t):
    k = t.benchmark.count()
    out = SY.cycle_rows(t.benchmark, "text", "item_id", t.documents.select("doc_id"), k, "doc_id")
    return out.select("number", F.md5("text").alias("digest"))


@query(
    "b20_stamp_id",
    "SELECT artifact_id, md5(regexp_replace(plantuml_code, '@startuml', concat('@startuml', chr(10), ''' training-id:', artifact_id))) AS digest FROM diagrams",
    "diagrams",
)
def _(t):
    from ..operators.align import stamp_id

    return t.diagrams.select("artifact_id", F.md5(stamp_id(F.col("plantuml_code"), F.col("artifact_id"))).alias("digest"))


_E = f"list_distinct({Q.every('plantuml_code', Q.ENTITY_RE)})"


@query(
    "l16_sketch_source",
    f"""SELECT artifact_id, md5(CASE WHEN len(n) < 2 THEN '' ELSE {_template_sql(SY.SOURCE_TEMPLATES, 'l')} END) AS digest
    FROM (SELECT artifact_id, n, ['java','python','c'][(artifact_id % 3 + 1)::INT] AS l, n[1] AS a, n[2] AS b, coalesce(n[3], concat(n[1], 'Link')) AS c FROM spec_names)""",
    "spec_names",
)
def _(t):
    lang = F.element_at(F.array(*[F.lit(x) for x in fixed.FOCUS_LANGS]), (F.col("doc_id") % 3 + 1).cast("int"))
    return t.spec_names.select(F.col("doc_id").alias("artifact_id"), F.md5(SY.sketch_source(F.col("n"), lang)).alias("digest"))


def _complete_sql():
    arms = []
    shapes = {
        "object": ('object "%A1" as %A1 {\n  id = 1\n}', "%A1 --> %B1 : link", "%A1 --> %B1 : tracks"),
        "component": ("component [%AService]\ninterface I%A\n[%AService] - I%A", "[%AService] --> [%BService] : calls", "[%AService] ..> [%BService] : orchestrates"),
        "package": ("package %A {\n  class %ACore\n  class %AApi\n}", "%A ..> %B : depends", "%A --> %B : integrates"),
        "class": ("class %A {\n  +id: int\n  +process()\n}", '%A "1" --> "*" %B : uses', "%A ..> %B : depends"),
    }

    def text(template, a, b="''"):
        return f"replace(replace('{template}', '%A', {a}), '%B', {b})"

    for kind, (decl, link, last) in shapes.items():
        arms.append(
            f"WHEN '{kind}' THEN concat_ws(chr(10), array_to_string(list_transform(e, lambda x: {text(decl, 'x')}), chr(10)), "
            f"array_to_string(list_transform(e[1:len(e) - 1], lambda x, i: {text(link, 'x', 'e[i + 1]')}), chr(10)), {text(last, 'e[1]', 'e[len(e)]')})"
        )
    return f"CASE diagram_type {' '.join(arms)} END"


@query(
    "l16_complete_diagram",
    f"""SELECT artifact_id, md5(concat_ws(chr(10), '@startuml', concat('title Industrial ', diagram_type, ' model'), {_complete_sql()}, '@enduml')) AS digest
    FROM (SELECT s.artifact_id, diagram_type, list_concat(n, ['Entity1', 'Entity2', 'Entity3'][least(len(n), 3) + 1:3]) AS e FROM spec_names s JOIN artifacts USING (artifact_id))""",
    "spec_names artifacts",
)
def _(t):
    rows = t.spec_names.select(F.col("doc_id").alias("artifact_id"), "n").join(
        t.artifacts.select("artifact_id", "diagram_type"), "artifact_id"
    )
    return rows.select("artifact_id", F.md5(SY.complete_diagram(F.col("n"), F.col("diagram_type"))).alias("digest"))


def _entity_sql(kind):
    """One file of the source, as concat_ws over its parts; ``x`` is the entity."""
    base = "list_filter(heirs, lambda h: h.dst = x)[-1].src"
    other = "list_filter(links, lambda h: h.src = x)[1].dst"
    body = "regexp_extract(plantuml_code, concat('(?is)(?:class|interface|object)\\s+', x, '\\b[^{]*\\{([^}]*)\\}'), 1)"
    found = f"list_filter(regexp_extract_all({body}, '(?m)^\\s*[+\\-#~]?\\s*(?:[\\w<>\\[\\]]+\\s+)?(\\w+)\\s*\\(', 1), lambda m: m NOT IN ('if', 'for', 'while', 'switch', 'new', 'class') AND m <> x)"
    once = f"list_filter({found}, lambda m, i: list_position({found}, m) = i)"

    def acts(line, usual):
        return f"array_to_string(list_transform(CASE WHEN len({found}) > 0 THEN {once} ELSE {usual} END, lambda m: {line}), chr(10))"

    if kind == "python":
        return (f"concat_ws(chr(10), '# file: src/' || lower(x) || '.py', 'class ' || x || coalesce('(' || {base} || ')', '') || ':', "
                f"{acts('concat(chr(32), chr(32), chr(32), chr(32), ' + repr('def ') + ', m, ' + repr('(self):') + ', chr(10), ' + repr('        return True') + ')', str(['process', 'validate']))}, "
                f"'    def link_' || lower({other}) || '(self, other: ' || chr(39) || {other} || chr(39) || '):' || chr(10) || '        self.ref = other')")
    if kind == "c":
        return (f"concat_ws(chr(10), '/* file: src/' || lower(x) || '.h */', 'typedef struct ' || x || ' {{', '    int id;', '    char name[64];', "
                f"'    struct ' || {other} || '* ' || lower({other}) || '_ref;', '}} ' || x || ';', {acts('concat(' + repr('void ') + ', x, chr(95), m, chr(40), x, ' + repr('* self);') + ')', str(['init', 'process']))})")
    return (f"concat_ws(chr(10), '// file: src/main/java/com/industrial/' || x || '.java', 'package com.industrial;', 'public class ' || x || coalesce(' extends ' || {base}, '') || ' {{', '  private int id;', "
            f"'  private ' || {other} || ' ' || lower({other}[1]) || {other}[2:] || ';', {acts('concat(' + repr('  public void ') + ', m, ' + repr('() {{}}') + ')', str(['process', 'validate']))}, '}}')")


_SOURCES = " ".join(f"WHEN '{k}' THEN array_to_string(list_transform(ents, lambda x: {_entity_sql(k)}), chr(10) || chr(10))" for k in ("python", "c", "java")).replace("{{", "{").replace("}}", "}")


@query(
    "l16_source_from_diagram",
    f"""WITH e0 AS (SELECT artifact_id, plantuml_code, names FROM (SELECT artifact_id, plantuml_code, {Q.every('plantuml_code', Q.ENTITY_RE)} AS every FROM diagrams), LATERAL (SELECT list_filter(every, lambda x, i: list_position(every, x) = i AND lower(x) NOT IN ({', '.join(repr(w) for w in ST.ENTITY_SKIP)})) AS names)),
    e1 AS (SELECT artifact_id, plantuml_code, list_concat(names, ['Module1', 'Module2', 'Module3'][least(len(names), 3) + 1:3]) AS ents FROM e0),
    known AS (SELECT artifact_id, unnest(ents) AS name FROM e1), edges AS ({EDGES}),
    g AS (SELECT artifact_id, list({{'src': src, 'dst': dst}} ORDER BY line_no) FILTER (WHERE kind = 'inherit') AS heirs, list({{'src': src, 'dst': dst}} ORDER BY line_no) FILTER (WHERE kind = 'assoc') AS links FROM edges GROUP BY artifact_id),
    r AS (SELECT artifact_id, plantuml_code, ents, coalesce(heirs, []) AS heirs, coalesce(links, []) AS links, ['java','python','c'][(artifact_id % 3 + 1)::INT] AS l FROM e1 LEFT JOIN g USING (artifact_id))
    SELECT artifact_id, md5(CASE l {_SOURCES} END) AS digest FROM r""",
    "diagrams",
)
def _(t):
    lang = F.get(F.array(*[F.lit(x) for x in fixed.FOCUS_LANGS]), (F.col("artifact_id") % 3).cast("int"))
    rows = t.diagrams.select("artifact_id", "plantuml_code", ST.entity_names(F.col("plantuml_code")).alias("names"), lang.alias("lang"))
    return SY.with_source(rows, "names", "lang").select("artifact_id", F.md5("source").alias("digest"))


@query(
    "l16_diagram_from_source",
    f"""WITH {CODE_READ},
    mm AS (SELECT artifact_id, owner, string_agg('  +' || name || '()', chr(10) ORDER BY part, i) AS acts FROM m WHERE owner IS NOT NULL GROUP BY ALL),
    en AS (SELECT artifact_id, list_concat(types, ['Entity1', 'Entity2', 'Entity3'][least(len(types), 3) + 1:3]) AS e FROM q),
    ex AS (SELECT artifact_id, unnest(e) AS x, generate_subscripts(e, 1) AS k, e FROM en),
    de AS (SELECT ex.artifact_id, string_agg(concat_ws(chr(10), 'class ' || x || ' {{', '  +id: int', coalesce(acts, '  +process()'), '}}'), chr(10) ORDER BY k) AS decl FROM ex LEFT JOIN mm ON mm.artifact_id = ex.artifact_id AND mm.owner = x GROUP BY ALL),
    ih AS (SELECT artifact_id, string_agg(p || ' <|-- ' || owner, chr(10) ORDER BY i, j) AS inh FROM (SELECT b.artifact_id, owner, i, e, unnest(parents) AS p, generate_subscripts(parents, 1) AS j FROM bases b JOIN en USING (artifact_id)) WHERE list_contains(e, owner) AND list_contains(e, p) GROUP BY artifact_id)
    SELECT artifact_id, md5(concat_ws(chr(10), '@startuml', 'title Industrial class model', decl, inh, array_to_string(list_transform(e[1:len(e) - 1], lambda x, i: x || ' "1" --> "*" ' || e[i + 1] || ' : uses'), chr(10)),
      e[1] || ' ..> ' || e[len(e)] || ' : depends', '@enduml')) AS digest FROM en JOIN de USING (artifact_id) LEFT JOIN ih USING (artifact_id)""",
    "code_sources",
)
def _(t):
    rows = CF.with_structure(t.code_sources.selectExpr("artifact_id", f"{PROGRAM} AS code"))
    code = SY.complete_diagram(F.col("types"), F.lit("class"), bases=F.col("bases"), methods=F.col("methods"))
    return rows.select("artifact_id", F.md5(code).alias("digest"))
