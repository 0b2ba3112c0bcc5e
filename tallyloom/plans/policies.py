"""Failure taxonomy, repair statistics and policy."""

from pyspark.sql import functions as F

from ..operators import failures as FA, policy as P, reports as R
from . import agreement, reporting  # noqa: F401  the briefing repeats their reports
from .catalog import ORACLES, query
from .reporting import rounded


def label_sql(code, messages, error):
    """The taxonomy in the oracle's dialect as a list expression."""
    body = f"regexp_replace(regexp_replace({code}, '(?i)@startuml|@enduml', '', 'g'), '^\\s+|\\s+$', '', 'g')"
    said = f"lower(coalesce({messages}, ''))"
    pack = f"regexp_matches({code}, '(?im)^\\s*package\\s+')"
    self_line = (
        f"len(list_filter(string_split({code}, chr(10)), lambda l: "
        "regexp_extract(l, '^\\s*([A-Za-z_][\\w.]*)\\s+(\\.\\.>|->|-->)\\s*([A-Za-z_][\\w.]*)', 1) <> '' AND "
        "regexp_extract(l, '^\\s*([A-Za-z_][\\w.]*)\\s+(\\.\\.>|->|-->)\\s*([A-Za-z_][\\w.]*)', 1) = "
        "regexp_extract(l, '^\\s*([A-Za-z_][\\w.]*)\\s+(\\.\\.>|->|-->)\\s*([A-Za-z_][\\w.]*)', 3))) > 0"
    )
    rules = f"""list_filter([CASE WHEN length({body}) < 12 OR contains({said}, 'empty') OR contains({said}, 'incomplete') THEN 'empty_or_incomplete' END,
      CASE WHEN NOT {pack} THEN 'missing_package_block' END,
      CASE WHEN length(replace({code}, '{{', '')) <> length(replace({code}, '}}', '')) THEN 'unbalanced_braces' END,
      CASE WHEN contains({said}, 'self-referential') OR {self_line} THEN 'self_dependency' END,
      CASE WHEN regexp_matches({code}, '(?m)^\\s*class\\s+\\w+') AND NOT {pack} THEN 'wrong_diagram_type' END,
      CASE WHEN {error} THEN 'render_engine_error' END], lambda x: x IS NOT NULL)"""
    return f"CASE WHEN len({rules}) > 0 THEN {rules} WHEN {said} <> '' THEN ['invalid_syntax_other'] ELSE ['unknown'] END"


JOINED = """SELECT a.*, coalesce(attempts, 0) AS attempts, coalesce(successes, 0) AS successes, coalesce(renders, 0) AS renders,
   coalesce(e1, false) OR coalesce(e2, false) AS render_error FROM big_artifacts a
   LEFT JOIN (SELECT artifact_id, count(*) AS attempts, count(*) FILTER (WHERE success) AS successes,
     bool_or(regexp_matches(lower(coalesce(reason, '')), 'error|syntax|http 400')) AS e1 FROM repair_attempts GROUP BY artifact_id) r USING (artifact_id)
   LEFT JOIN (SELECT artifact_id, count(*) AS renders, bool_or(regexp_matches(lower(coalesce(error_output, '')), 'error|syntax|http 400')) AS e2
     FROM render_attempts GROUP BY artifact_id) d USING (artifact_id)"""
JOINED_VIEWS = "big_artifacts repair_attempts render_attempts"
LABELLED = f"SELECT *, {label_sql('plantuml_code', 'validation_messages', 'render_error')} AS labels FROM ({JOINED}) WHERE diagram_type = 'package' AND render_status <> 'success'"


def joined(t):
    return FA.with_attempts(t.big_artifacts, t.repair_attempts, t.render_attempts)


@query("d03_artifact_attempts", f"SELECT artifact_id, attempts, successes, renders, render_error FROM ({JOINED})", JOINED_VIEWS)
def _(t):
    return joined(t).select("artifact_id", "attempts", "successes", "renders", "render_error")


@query(
    "e14_failure_labels",
    f"""SELECT artifact_id, array_to_string({label_sql('plantuml_code', 'm', 'artifact_id % 9 = 0')}, ',') AS labels
    FROM (SELECT artifact_id, plantuml_code, CASE artifact_id % 5 WHEN 0 THEN 'Diagram is EMPTY' WHEN 1 THEN 'odd arrow' END AS m FROM diagrams)""",
    "diagrams",
)
def _(t):
    rows = t.diagrams.withColumn(
        "m", F.expr("CASE artifact_id % 5 WHEN 0 THEN 'Diagram is EMPTY' WHEN 1 THEN 'odd arrow' END")
    )
    labels = FA.failure_labels(F.col("plantuml_code"), F.col("m"), F.col("artifact_id") % 9 == 0)
    return rows.select("artifact_id", F.array_join(labels, ",").alias("labels"))


@query(
    "e15_failure_totals",
    """SELECT total, successes, failures, round(mean_s_success, 6) AS mean_s_success, round(mean_s_failure, 6) AS mean_s_failure,
      round(100.0 * majority / nullif(successes, 0), 6) AS majority_accept_success_pct,
      round(failures / total, 6) AS failure_rate, round(successes / total, 6) AS success_rate,
      round(greatest(0, ((p + z2 / (2 * total)) - m) / (1 + z2 / total)), 9) AS ci_low,
      round(least(1, ((p + z2 / (2 * total)) + m) / (1 + z2 / total)), 9) AS ci_high
    FROM (SELECT *, failures / total AS p, 3.8416e0 AS z2, 1.96e0 * sqrt(((failures / total) * (1 - failures / total) + 3.8416e0 / (4 * total)) / total) AS m FROM (
      SELECT count(*) AS total, count(*) FILTER (WHERE render_status = 'success') AS successes, count(*) FILTER (WHERE render_status <> 'success') AS failures,
      avg(composite_score) FILTER (WHERE render_status = 'success') AS mean_s_success, avg(composite_score) FILTER (WHERE render_status <> 'success') AS mean_s_failure,
      count(*) FILTER (WHERE render_status = 'success' AND majority_accepted) AS majority FROM big_artifacts WHERE diagram_type = 'package'))""",
    "big_artifacts",
)
def _(t):
    out = FA.failure_totals(t.big_artifacts, "package")
    out = rounded(out, "mean_s_success", "mean_s_failure", "majority_accept_success_pct", "failure_rate", "success_rate")
    return rounded(out, "ci_low", "ci_high", digits=9)


@query(
    "e15_label_counts",
    f"""SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM l), 6) AS share_of_failures,
      round(count(*) / (SELECT count(*) FROM big_artifacts WHERE diagram_type = 'package'), 6) AS share_of_total
    FROM (SELECT unnest(labels) AS label FROM l) GROUP BY label""".replace("SELECT label", f"WITH l AS ({LABELLED}) SELECT label", 1),
    JOINED_VIEWS,
)
def _(t):
    return rounded(FA.label_counts(joined(t), "package"), "share_of_failures", "share_of_total")


@query(
    "e16_label_examples",
    f"""SELECT label, artifact_id, round(composite_score, 6) AS composite_score, labels, preview, place FROM (
      SELECT label, artifact_id, composite_score, array_to_string(labels, ',') AS labels, substr(plantuml_code, 1, 240) AS preview,
      row_number() OVER (PARTITION BY label ORDER BY artifact_id) AS place FROM (SELECT *, unnest(labels) AS label FROM ({LABELLED}))) WHERE place <= 3""",
    JOINED_VIEWS,
)
def _(t):
    return rounded(FA.label_examples(FA.failed_with_labels(joined(t), "package")), "composite_score")


@query(
    "e17_repair_stats",
    """SELECT diagram_type, count(*) AS artifacts_with_repair, sum(k)::BIGINT AS repair_attempts, sum(w)::BIGINT AS repair_successes,
      count(*) FILTER (WHERE render_status = 'success') AS rescued_artifacts, round(sum(w) / sum(k), 6) AS attempt_win_rate,
      round(count(*) FILTER (WHERE render_status = 'success') / count(*), 6) AS rescue_rate
    FROM big_artifacts JOIN (SELECT artifact_id, count(*) AS k, count(*) FILTER (WHERE success) AS w FROM repair_attempts GROUP BY artifact_id) USING (artifact_id)
    GROUP BY diagram_type""",
    "big_artifacts repair_attempts",
)
def _(t):
    return rounded(FA.repair_stats(t.big_artifacts, t.repair_attempts, "diagram_type"), "attempt_win_rate", "rescue_rate")


RATES = """SELECT kind, key, name, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS fail, count(*) AS n,
  (count(*) FILTER (WHERE ok) + 1) / (count(*) + 2) AS rate FROM {} GROUP BY ALL"""


@query("e18_win_rates", f"SELECT kind, key, name, ok, fail, n, round(rate, 6) AS rate FROM ({RATES.format('outcomes')})", "outcomes")
def _(t):
    return rounded(P.win_rates(t.outcomes), "rate")


@query(
    "e19_choose_generator",
    f"""WITH r AS ({RATES.format('generator_outcomes')}),
    w AS (SELECT d, coalesce(sum(n) FILTER (WHERE name = 'lora'), 0) AS ln, coalesce(sum(n) FILTER (WHERE name <> 'lora'), 0) AS sn,
      (coalesce(sum(ok) FILTER (WHERE name = 'lora'), 0) + 1) / (coalesce(sum(n) FILTER (WHERE name = 'lora'), 0) + 2) AS lr,
      (coalesce(sum(ok) FILTER (WHERE name <> 'lora'), 0) + 1) / (coalesce(sum(n) FILTER (WHERE name <> 'lora'), 0) + 2) AS sr
      FROM (VALUES ('class'), ('object'), ('component'), ('package'), ('state')) v(d) LEFT JOIN r ON key = d GROUP BY d),
    f AS (SELECT *, d IN ('component', 'package') AND ln < 8 AS grounded, ln >= 3 AND sn >= 2 AND sr > lr + 0.08 AS better, ln >= 5 AND lr < 0.4 AS weak FROM w)
    SELECT d AS diagram_type,
      CASE WHEN grounded THEN 'spec-builder' WHEN (better OR weak) AND (ln + sn) % 4 = 0 THEN 'lora' WHEN better OR weak THEN 'spec-builder' ELSE 'lora' END AS generator,
      CASE WHEN grounded THEN concat('default: grounded ', d, ' builder (LoRA n=', ln, ' < 8 proven samples)')
       WHEN (better OR weak) AND (ln + sn) % 4 = 0 THEN concat('explore: retry LoRA on ', d, ' despite lower rate ', printf('%.2f', lr))
       WHEN better THEN concat('adapted: spec-builder ', printf('%.2f', sr), ' (n=', sn, ') > LoRA ', printf('%.2f', lr), ' (n=', ln, ')')
       WHEN weak THEN concat('adapted: LoRA weak on ', d, ' (', printf('%.2f', lr), ', n=', ln, ')')
       ELSE concat('default: LoRA-first for ', d, ' (rate ', printf('%.2f', lr), ', n=', ln, ')') END AS reason FROM f""",
    "generator_outcomes",
)
def _(t):
    return P.choose_generator(P.win_rates(t.generator_outcomes), ["class", "object", "component", "package", "state"])


def _defaults_sql():
    from .. import fixed

    rows = [
        f"('{t}|{c}', {i}, '{n}')"
        for t in fixed.APP_TYPES
        for c, names in fixed.DEFAULT_STRATEGIES.items()
        for i, n in enumerate(names)
    ]
    return f"(VALUES {', '.join(rows)}) d(key, i, name)"


@query(
    "e20_rank_strategies",
    f"""WITH r AS ({RATES.format('strategy_outcomes')}),
    tried AS (SELECT key, name FROM r WHERE fail > 2 * ok)
    SELECT d.key, d.name, row_number() OVER (PARTITION BY d.key ORDER BY CASE WHEN n >= 3 THEN -rate ELSE 0 END, i) AS place
    FROM (SELECT key, name, i FROM {_defaults_sql()} UNION ALL SELECT k.key, f.name, f.i FROM (SELECT DISTINCT key FROM r WHERE key NOT IN (SELECT key FROM {_defaults_sql()})) k,
      (VALUES ('spec_rebuild', 0), ('sanitize_syntax', 1)) f(name, i)) d LEFT JOIN r ON r.key = d.key AND r.name = d.name
    WHERE NOT EXISTS (SELECT 1 FROM tried x WHERE x.key = d.key AND x.name = d.name)""",
    "strategy_outcomes",
)
def _(t):
    rates = P.win_rates(t.strategy_outcomes)
    tried = rates.where("fail > 2 * ok").select("key", "name")
    return P.rank_strategies(rates, tried)


@query(
    "f17_latest_outcomes",
    'SELECT event_id, key, name, ok FROM outcomes ORDER BY "at" DESC, event_id DESC LIMIT 80',
    "outcomes",
)
def _(t):
    return P.latest(t.outcomes, 80).select("event_id", "key", "name", "ok")


def _facts_sql(section, key, label):
    """A registered report, turned to (section, key, metric, value)."""
    rest = f"COLUMNS(* EXCLUDE ({label}))" if label else "COLUMNS(*)"
    name = label or "'all'"
    return (
        f"SELECT '{section}' AS section, key, metric, round(value, 4) AS value FROM (UNPIVOT (SELECT {name} AS key, {rest}::DOUBLE FROM ({ORACLES[key]})) "
        "ON COLUMNS(* EXCLUDE (key)) INTO NAME metric VALUE value)"
    )


BRIEFING = [
    ("summary", "e06_summary", None), ("by_type", "e07_type_stats", "diagram_type"), ("alignment", "e24_alignment", "scope"),
    ("published", "d12_published_vs_live", "diagram_type"), ("failures", "e15_failure_totals", None), ("failure_labels", "e15_label_counts", "label"),
]


@query("e33_briefing", " UNION ALL ".join(_facts_sql(*x) for x in BRIEFING))
def _(t):
    labels, totals = FA.label_counts(joined(t), "package"), FA.failure_totals(t.big_artifacts, "package")
    scored = t.scored.withColumn("composite_score", F.round("composite_score", 9))
    facts = R.briefing(scored, t.repair_attempts, t.human_reviews, labels, totals).where("value IS NOT NULL")
    return rounded(rounded(facts, "value"), "value", digits=4)  # the reports themselves are rounded to six


@query(
    "e34_report_lines",
    f"""WITH l AS ({LABELLED}), n AS (SELECT count(*) AS total, count(*) FILTER (WHERE render_status <> 'success') AS failures FROM big_artifacts WHERE diagram_type = 'package'),
    c AS (SELECT *, failures / total AS p, 3.8416e0 AS z2, 1.96e0 * sqrt(((failures / total) * (1 - failures / total) + 3.8416e0 / (4 * total)) / total) AS m FROM n)
    SELECT 0 AS part, 0 AS weight, '' AS tie, '# Failure report' AS line
    UNION ALL SELECT 1, 0, 'a', printf('- Total: %d, failures: %d', total, failures) FROM c
    UNION ALL SELECT 1, 0, 'b', printf('- Failure rate: %.4f (95%% CI %.4f to %.4f)', p, greatest(0, ((p + z2 / (2 * total)) - m) / (1 + z2 / total)), least(1, ((p + z2 / (2 * total)) + m) / (1 + z2 / total))) FROM c
    UNION ALL SELECT 2, -count(*), label, printf('| %s | %d | %.4f |', label, count(*), count(*) / (SELECT count(*) FROM l)) FROM (SELECT unnest(labels) AS label FROM l) GROUP BY label""",
    JOINED_VIEWS,
)
def _(t):
    return R.report_lines(FA.label_counts(joined(t), "package"), FA.failure_totals(t.big_artifacts, "package"))
