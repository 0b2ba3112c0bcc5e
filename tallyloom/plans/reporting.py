"""Scores, gates and reports."""

from pyspark.sql import functions as F

from ..operators import scores as S, stats as ST
from .catalog import query


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("e01_composite", "SELECT artifact_id, round(composite_score, 6) AS composite_score FROM verdicts", "verdicts")
def _(t):
    return rounded(t.scored.select("artifact_id", "composite_score"), "composite_score")


@query(
    "e02_majority",
    "SELECT artifact_id, affirmative_votes, majority_accepted FROM verdicts",
    "verdicts",
)
def _(t):
    return t.scored.select("artifact_id", "affirmative_votes", "majority_accepted")


@query(
    "e03_dataset_gate",
    """SELECT diagram_type, dataset_accepted, count(*) AS n,
       count(*) FILTER (WHERE render_ok AND votes_ok AND s >= 4.5) AS strict FROM (
       SELECT diagram_type, dataset_accepted, render_ok, affirmative_votes >= 2 AS votes_ok, composite_score AS s
       FROM scored) GROUP BY ALL""",
    "scored",
)
def _(t):
    strict = S.with_verdicts(t.artifacts, t.model_scores, min_composite=4.5).select(
        "artifact_id", F.col("dataset_accepted").alias("strict")
    )
    return t.scored.join(strict, "artifact_id").groupBy("diagram_type", "dataset_accepted").agg(
        F.count("*").alias("n"), F.count_if("strict").alias("strict")
    )


@query(
    "e04_formula_snapshot",
    """SELECT v.artifact_id,
      CASE WHEN v.artifact_id % 10 <> 0 THEN coalesce(voters, '') ELSE '' END AS accepting_models,
      concat('final=', printf('%.4f', composite_score), ' | majority=', CASE WHEN majority_accepted THEN 'True' ELSE 'False' END,
      ' votes=', affirmative_votes, ' tau=4.0 | dataset_accepted=', CASE WHEN dataset_accepted THEN 'True' ELSE 'False' END,
      ' | ', parts) AS formula_snapshot
    FROM verdicts v JOIN (
      SELECT artifact_id,
        string_agg(CASE WHEN score IS NULL THEN concat(model_key, '=na') ELSE concat(model_key, '=', score, '(w=', weight,
          ',vote=', CASE WHEN score >= 4 THEN 'Y' ELSE 'N' END, ')') END, ', ' ORDER BY weight DESC) AS parts,
        string_agg(model_key, ',' ORDER BY model_key) FILTER (WHERE score >= 4) AS voters
      FROM model_scores GROUP BY artifact_id) p ON p.artifact_id = v.artifact_id""",
    "verdicts model_scores",
)
def _(t):
    return S.formula_snapshots(t.artifacts, t.model_scores)


@query(
    "e05_ablations",
    """SELECT 'full' AS mode, count(*) FILTER (WHERE majority_accepted) AS majority, count(*) FILTER (WHERE dataset_accepted) AS dataset FROM scored
    UNION ALL SELECT 'no_models', 0, 0
    UNION ALL SELECT 'no_majority', count(*) FILTER (WHERE majority_accepted), count(*) FILTER (WHERE render_ok AND composite_score >= 3) FROM scored
    UNION ALL SELECT 'acceptance', count(*) FILTER (WHERE majority_accepted), count(*) FILTER (WHERE dataset_accepted AND artifact_id % 4 <> 0) FROM scored""",
    "scored",
)
def _(t):
    base = t.scored.select(
        "render_ok", "composite_score", "majority_accepted", "dataset_accepted",
        (F.col("artifact_id") % 4 != 0).alias("accepted"),
    )
    out = []
    for mode in ("full", "no_models", "no_majority", "acceptance"):
        changed = base if mode == "full" else S.ablated(base, mode)
        out.append(
            changed.agg(F.count_if("majority_accepted").alias("majority"), F.count_if("dataset_accepted").alias("dataset"))
            .withColumn("mode", F.lit(mode))
        )
    first, *rest = out
    for o in rest:
        first = first.unionByName(o)
    return first


@query(
    "e06_summary",
    """SELECT count(*) AS total_artifacts, round(avg(composite_score), 6) AS mean_composite,
      count(*) FILTER (WHERE render_status <> 'success') AS render_failures,
      count(*) FILTER (WHERE render_status <> 'success' AND diagram_type = 'package') AS package_failure_count,
      count(*) FILTER (WHERE majority_accepted) AS majority_accepted_count,
      count(*) FILTER (WHERE dataset_accepted) AS dataset_accepted_count,
      round(count(*) FILTER (WHERE majority_accepted) / count(*), 6) AS majority_acceptance_rate,
      (SELECT count(*) FROM repair_attempts) AS repair_attempts,
      (SELECT count(*) FROM repair_attempts WHERE success) AS repair_successes,
      (SELECT count(*) FROM human_reviews) AS human_review_count FROM scored""",
    "scored repair_attempts human_reviews",
)
def _(t):
    return rounded(
        ST.summary(t.scored, t.repair_attempts, t.human_reviews), "mean_composite", "majority_acceptance_rate"
    )


@query(
    "e07_type_stats",
    """SELECT d AS diagram_type, count(artifact_id) AS n, count(artifact_id) FILTER (WHERE render_status <> 'success') AS failures,
      round(100.0 * count(*) FILTER (WHERE render_status = 'success') / nullif(count(artifact_id), 0), 6) AS success_pct,
      round(avg(composite_score), 6) AS mean_s,
      round(100.0 * count(*) FILTER (WHERE majority_accepted) / nullif(count(artifact_id), 0), 6) AS majority_accept_pct,
      round(100.0 * count(*) FILTER (WHERE dataset_accepted) / nullif(count(artifact_id), 0), 6) AS dataset_accept_pct
    FROM (VALUES ('class'), ('object'), ('component'), ('package')) v(d) LEFT JOIN scored ON diagram_type = d GROUP BY d""",
    "scored",
)
def _(t):
    return rounded(
        ST.type_stats(t.scored), "mean_s", "success_pct", "majority_accept_pct", "dataset_accept_pct"
    )


HIST = """SELECT {label}, b AS bucket, count(*) FILTER (WHERE {score} IS NOT NULL AND least(6, greatest(0, round_even({score}, 0))) = b) AS n
    FROM {source} CROSS JOIN (SELECT unnest(range(7))::INT AS b) GROUP BY {label}, b"""


@query(
    "e08_score_hist",
    HIST.format(label="diagram_type", score="composite_score", source="scored")
    + " UNION ALL SELECT 'all', b, count(*) FILTER (WHERE least(6, greatest(0, round_even(composite_score, 0))) = b)"
    " FROM scored CROSS JOIN (SELECT unnest(range(7))::INT AS b) GROUP BY b",
    "scored",
)
def _(t):
    return ST.score_hist(t.scored)


@query("e09_model_hist", HIST.format(label="model_key", score="score", source="model_scores"), "model_scores")
def _(t):
    return ST.model_hist(t.model_scores)


@query(
    "e10_corpus_summary",
    """SELECT diagram_type, count(*) AS n, round(avg(s), 6) AS mean_score, count(*) FILTER (WHERE coalesce(s, 0) = 0) AS render_failures
    FROM (SELECT CASE WHEN artifact_id % 8 <> 0 THEN diagram_type END AS diagram_type,
      CASE WHEN artifact_id % 6 <> 0 THEN composite_score END AS s FROM scored) WHERE diagram_type IS NOT NULL GROUP BY diagram_type""",
    "scored",
)
def _(t):
    holes = t.scored.selectExpr(
        "CASE WHEN artifact_id % 8 <> 0 THEN diagram_type END AS diagram_type",
        "CASE WHEN artifact_id % 6 <> 0 THEN composite_score END AS s",
    )
    return rounded(ST.corpus_summary(holes, "s"), "mean_score")


@query(
    "e11_counter_top",
    """SELECT coalesce(source_language, 'null') AS key, count(*) AS n FROM corpus GROUP BY 1
    ORDER BY n DESC, key LIMIT 3""",
    "corpus",
)
def _(t):
    return ST.counter(t.corpus, "source_language", 3, null_label="null")


@query(
    "e12_length_profile",
    """SELECT 'text' AS "column", quantile_cont(length(text), 0.5) AS p50, round(quantile_cont(length(text), 0.9), 6) AS p90, round(avg(length(text)), 6) AS mean FROM documents
    UNION ALL SELECT 'source', quantile_cont(length(source), 0.5), round(quantile_cont(length(source), 0.9), 6), round(avg(length(source)), 6) FROM documents""",
)
def _(t):
    return rounded(ST.length_profile(t.documents, ["text", "source"]), "p90", "mean")


@query(
    "e13_wilson",
    """SELECT diagram_type, n, k, round(greatest(0, (p + z2 / (2 * n) - m) / (1 + z2 / n)), 9) AS low,
      round(least(1, (p + z2 / (2 * n) + m) / (1 + z2 / n)), 9) AS high
    FROM (SELECT diagram_type, n, k, k / n AS p, 3.8416e0 AS z2, 1.96e0 * sqrt(((k / n) * (1 - k / n) + 3.8416e0 / (4 * n)) / n) AS m
      FROM (SELECT diagram_type, count(*) AS n, count(*) FILTER (WHERE render_status = 'failed') AS k FROM big_artifacts GROUP BY diagram_type))""",
    "big_artifacts",
)
def _(t):
    counts = t.big_artifacts.groupBy("diagram_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("render_status") == "failed").alias("k")
    )
    low, high = ST.wilson(F.col("k"), F.col("n"))
    return rounded(counts.withColumn("low", low).withColumn("high", high), "low", "high", digits=9)


CASES = """SELECT diagram_type, artifact_id % 19 <> 0 AS generated, artifact_id % 7 <> 0 AS syntax_ok,
  CASE WHEN artifact_id % 5 <> 0 THEN artifact_id % 11 <> 0 END AS compile_ok, render_status = 'success' AS render_ok,
  artifact_id % 3 <> 0 AS uml_rules_ok, majority_accepted AS semantic_ok,
  artifact_id % 19 <> 0 AND artifact_id % 7 <> 0 AND dataset_accepted AS accepted, artifact_id % 4 AS retry_count,
  CASE WHEN artifact_id % 7 = 0 THEN 'syntax' WHEN render_status <> 'success' THEN 'render' WHEN artifact_id % 3 = 0 THEN 'uml_structure' END AS failure_category
  FROM big_artifacts"""
CASE_EXPRS = [e.strip() for e in """diagram_type; artifact_id % 19 <> 0 AS generated; artifact_id % 7 <> 0 AS syntax_ok;
  CASE WHEN artifact_id % 5 <> 0 THEN artifact_id % 11 <> 0 END AS compile_ok; render_status = 'success' AS render_ok;
  artifact_id % 3 <> 0 AS uml_rules_ok; majority_accepted AS semantic_ok;
  artifact_id % 19 <> 0 AND artifact_id % 7 <> 0 AND dataset_accepted AS accepted; artifact_id % 4 AS retry_count;
  CASE WHEN artifact_id % 7 = 0 THEN 'syntax' WHEN render_status <> 'success' THEN 'render' WHEN artifact_id % 3 = 0 THEN 'uml_structure' END AS failure_category""".split(";")]


@query(
    "e21_scoreboard",
    f"SELECT diagram_type, count(*) AS total, "
    + ", ".join(
        f"count(*) FILTER (WHERE {c}) AS {k}, round(count(*) FILTER (WHERE {c}) / count(*), 4) AS {k}_rate"
        for k, c in {
            "generated": "generated", "compiled": "compile_ok IS NOT FALSE", "syntax_valid": "syntax_ok",
            "rendered": "render_ok", "uml_rule_pass": "uml_rules_ok", "semantic_aligned": "semantic_ok",
            "accepted": "accepted",
        }.items()
    )
    + f", round(avg(retry_count), 3) AS average_repair_iterations, count(*) FILTER (WHERE NOT accepted) AS remaining_failures FROM ({CASES}) GROUP BY diagram_type",
    "big_artifacts",
)
def _(t):
    return ST.scoreboard(t.big_artifacts.selectExpr(*CASE_EXPRS), "diagram_type")


@query(
    "e21_failure_distribution",
    f"SELECT diagram_type, failure_category, count(*) AS n FROM ({CASES}) WHERE NOT accepted AND failure_category IS NOT NULL GROUP BY ALL",
    "big_artifacts",
)
def _(t):
    return ST.failure_distribution(t.big_artifacts.selectExpr(*CASE_EXPRS), "diagram_type")


@query(
    "e26_type_table",
    """SELECT diagram_type, count(*) AS n, round(avg(composite_score), 6) AS mean_s, round(stddev_samp(composite_score), 6) AS sd,
      count(*) FILTER (WHERE render_status <> 'success') AS failures,
      round(100.0 * count(*) FILTER (WHERE render_status = 'success') / count(*), 6) AS success_pct FROM scored GROUP BY diagram_type""",
    "scored",
)
def _(t):
    return rounded(ST.type_table(t.scored), "mean_s", "sd", "success_pct")


@query(
    "e27_negative_controls",
    """SELECT count(*) AS total, count(*) FILTER (WHERE NOT dataset_accepted) AS correctly_rejected,
      count(*) FILTER (WHERE dataset_accepted) AS false_accepts,
      round(count(*) FILTER (WHERE NOT dataset_accepted) / count(*), 4) AS true_negative_rate
    FROM scored WHERE artifact_id % 5 = 0 OR length(plantuml_code) < 200""",
    "scored",
)
def _(t):
    must_fail = t.scored.where((F.col("artifact_id") % 5 == 0) | (F.length("plantuml_code") < 200))
    return ST.negative_controls(must_fail.withColumn("accepted", F.col("dataset_accepted")))


BATCH = """SELECT diagram_type, source_language, CASE WHEN artifact_id % 8 <> 0 THEN diagram_type END AS human_language,
  dataset_accepted AS ok, composite_score,
  CASE WHEN artifact_id % 4 <> 0 THEN validation_messages END AS fail_reason FROM scored"""


def batch_rows(t):
    return t.scored.selectExpr(
        "diagram_type", "source_language", "CASE WHEN artifact_id % 8 <> 0 THEN diagram_type END AS human_language",
        "dataset_accepted AS ok", "composite_score",
        "CASE WHEN artifact_id % 4 <> 0 THEN validation_messages END AS fail_reason",
    )


@query(
    "e28_batch_summary",
    f"""WITH b AS ({BATCH}), k AS (
      SELECT 'diagram_type' AS facet, diagram_type AS key, ok, composite_score FROM b
      UNION ALL SELECT 'language', coalesce(source_language, human_language, 'n/a'), ok, composite_score FROM b
      UNION ALL SELECT 'total', 'all', ok, composite_score FROM b)
    SELECT facet, key, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS fail, round(avg(composite_score), 6) AS mean_composite
    FROM k GROUP BY facet, key""",
    "scored",
)
def _(t):
    return rounded(ST.batch_summary(batch_rows(t)), "mean_composite")


@query(
    "e28_fail_reasons",
    f"""SELECT coalesce(fail_reason, 'unknown') AS key, count(*) AS n FROM ({BATCH}) WHERE NOT ok GROUP BY 1 ORDER BY n DESC, key LIMIT 20""",
    "scored",
)
def _(t):
    return ST.counter(batch_rows(t).where("NOT ok"), "fail_reason", 20, null_label="unknown")


@query(
    "e29_scorer_histogram",
    """SELECT count(*) AS runs, """
    + ", ".join(f"count(*) FILTER (WHERE k = {i}) AS with_{i}" for i in range(4))
    + ", "
    + ", ".join(f"round(100.0 * count(*) FILTER (WHERE k >= {i}) / count(*), 1) AS pct_at_least_{i}" for i in (1, 2, 3))
    + " FROM (SELECT artifact_id, count(*) FILTER (WHERE available) AS k FROM model_scores GROUP BY artifact_id)",
    "model_scores",
)
def _(t):
    return ST.scorer_histogram(t.model_scores)


@query(
    "e29_scorer_rates",
    """SELECT model_key, round(count(*) FILTER (WHERE available) / count(*), 3) AS available_rate,
      round(count(*) FILTER (WHERE NOT available) / count(*), 3) AS failure_rate FROM model_scores GROUP BY model_key""",
    "model_scores",
)
def _(t):
    return ST.scorer_rates(t.model_scores)


@query(
    "e29_top_errors",
    """SELECT model_key, error, n, place FROM (SELECT *, row_number() OVER (PARTITION BY model_key ORDER BY n DESC, error) AS place
      FROM (SELECT model_key, error, count(*) AS n FROM model_scores WHERE error IS NOT NULL GROUP BY ALL)) WHERE place <= 3""",
    "model_scores",
)
def _(t):
    return ST.top_errors(t.model_scores)


@query(
    "e30_rescore_rollup",
    """SELECT coalesce(diagram_type, 'all') AS diagram_type, count(*) AS n, round(avg(composite_score), 6) AS mean_s,
      count(*) FILTER (WHERE majority_accepted) AS majority, count(*) FILTER (WHERE dataset_accepted) AS dataset,
      round(count(*) FILTER (WHERE majority_accepted) / count(*), 6) AS majority_rate,
      round(count(*) FILTER (WHERE dataset_accepted) / count(*), 6) AS dataset_rate FROM scored GROUP BY ROLLUP (diagram_type)""",
    "scored",
)
def _(t):
    return rounded(ST.rescore_rollup(t.scored), "mean_s", "majority_rate", "dataset_rate")


@query(
    "e29_run_quality",
    """SELECT count(*) AS runs, count(*) FILTER (WHERE render_status = 'success') AS render_success, count(*) FILTER (WHERE length(plantuml_code) > 0) AS generation_ok,
      round(coalesce(avg(coalesce(composite_score, 0)) FILTER (WHERE render_status = 'success'), 0), 6) AS mean_composite_when_render_ok FROM scored""",
    "scored",
)
def _(t):
    return rounded(ST.run_quality(t.scored), "mean_composite_when_render_ok")


@query(
    "e30_rescore_reused",
    """WITH fresh AS (SELECT artifact_id, diagram_type, 6.0e0 AS composite_score, true AS majority_accepted, dataset_accepted, false AS reused FROM scored WHERE NOT coalesce(majority_accepted, false) AND render_ok),
    u AS (SELECT * FROM fresh UNION ALL SELECT artifact_id, diagram_type, composite_score, majority_accepted, dataset_accepted, true FROM scored WHERE artifact_id NOT IN (SELECT artifact_id FROM fresh))
    SELECT coalesce(diagram_type, 'all') AS diagram_type, count(*) AS n, count(*) FILTER (WHERE reused) AS reused, count(*) FILTER (WHERE NOT reused) AS new, round(avg(composite_score), 6) AS mean_s,
      count(*) FILTER (WHERE majority_accepted) AS majority, count(*) FILTER (WHERE dataset_accepted) AS dataset, round(count(*) FILTER (WHERE majority_accepted) / count(*), 6) AS majority_rate,
      round(count(*) FILTER (WHERE dataset_accepted) / count(*), 6) AS dataset_rate FROM u GROUP BY ROLLUP (diagram_type)""",
    "scored",
)
def _(t):
    # what the vote rejected is scored again
    before = t.scored.select("artifact_id", "diagram_type", "composite_score", "majority_accepted", "dataset_accepted", "render_ok")
    fresh = before.where(~F.coalesce("majority_accepted", F.lit(False)) & F.col("render_ok")).withColumns({"composite_score": F.lit(6.0), "majority_accepted": F.lit(True)})
    out = ST.rescore_rollup(ST.rescored(before, fresh, "artifact_id"))
    return rounded(out, "mean_s", "majority_rate", "dataset_rate")


@query(
    "e32_job_progress",
    """SELECT j.job_id, status, coalesce(k, 0) AS artifacts, round(r / k, 6) AS completion FROM jobs j LEFT JOIN (
      SELECT job_id, count(*) AS k, count(*) FILTER (WHERE render_status = 'success') AS r FROM artifacts GROUP BY job_id) a ON a.job_id = j.job_id""",
    "jobs artifacts",
)
def _(t):
    return rounded(ST.job_progress(t.jobs, t.artifacts), "completion")


@query(
    "e35_funnel",
    """SELECT count(*) AS total, count(*) FILTER (WHERE composite_score > 0) AS scored, count(*) FILTER (WHERE majority_accepted) AS majority,
      count(*) FILTER (WHERE dataset_accepted) AS accepted FROM scored""",
    "scored",
)
def _(t):
    return ST.funnel(t.scored)
