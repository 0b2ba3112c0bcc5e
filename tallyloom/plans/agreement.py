"""Human and ensemble agreement."""

from pyspark.sql import functions as F

from .. import fixed
from ..operators import scores as S, stats as ST
from .catalog import query
from .reporting import rounded

HUMAN = """CASE WHEN score_scale = 5 THEN ((semantic + structural + syntactic + coherence) / 4.0e0 - 1) * 1.5e0
  ELSE (semantic + structural + syntactic + coherence) / 4.0e0 END"""
PAIRS = f"SELECT r.artifact_id, reviewer_id, diagram_type, composite_score AS s, {HUMAN} AS human FROM human_reviews r JOIN scored a ON a.artifact_id = r.artifact_id"
RANKED = """SELECT *, rank() OVER (PARTITION BY scope ORDER BY s) + (count(*) OVER (PARTITION BY scope, s) - 1) / 2.0e0 AS rs,
  rank() OVER (PARTITION BY scope ORDER BY human) + (count(*) OVER (PARTITION BY scope, human) - 1) / 2.0e0 AS rh FROM scoped"""


@query(
    "b21_human_six",
    f"SELECT artifact_id, reviewer_id, round({HUMAN}, 6) AS human FROM human_reviews",
    "human_reviews",
)
def _(t):
    return t.human_reviews.select("artifact_id", "reviewer_id", F.round(S.human_six(), 6).alias("human"))


@query(
    "d01_review_pairs",
    f"SELECT artifact_id, reviewer_id, diagram_type, round(s, 6) AS composite_score, round(human, 6) AS human, count(*) AS n FROM ({PAIRS}) GROUP BY ALL",
    "human_reviews scored",
)
def _(t):
    pairs = ST.review_counts(t.human_reviews, t.scored)
    return rounded(pairs, "composite_score", "human")


@query(
    "d12_published_vs_live",
    """SELECT p.d AS diagram_type, p.success AS published_success_pct, p.mean AS published_mean_s,
      round(100.0 * count(*) FILTER (WHERE render_status = 'success') / nullif(count(artifact_id), 0), 6) AS live_success_pct,
      round(avg(composite_score), 6) AS live_mean_s
    FROM (VALUES ('class', 95.7e0, 4.31e0), ('object', 94.4e0, 4.09e0), ('component', 91.6e0, 3.87e0), ('package', 81.1e0, 3.12e0)) p(d, success, mean)
    LEFT JOIN scored ON diagram_type = p.d GROUP BY ALL""",
    "scored",
)
def _(t):
    from ..operators.reports import published_vs_live

    return rounded(published_vs_live(t.scored), "live_success_pct", "live_mean_s")


@query(
    "e22_pearson",
    f"""SELECT diagram_type, count(*) AS n, CASE WHEN min(s) < max(s) AND min(human) < max(human) THEN round(corr(s, human), 6) END AS pearson_r
    FROM ({PAIRS}) GROUP BY diagram_type""",
    "human_reviews scored",
)
def _(t):
    joined = t.human_reviews.select("artifact_id", S.human_six().alias("human")).join(
        t.scored.select("artifact_id", "diagram_type", "composite_score"), "artifact_id"
    )
    return rounded(ST.pearson(joined, "composite_score", "human", ["diagram_type"]), "pearson_r")


@query(
    "e23_spearman",
    f"""WITH scoped AS (SELECT diagram_type AS scope, round(s, 9) AS s, human FROM ({PAIRS})), ranked AS ({RANKED})
    SELECT scope AS diagram_type, count(*) AS n, CASE WHEN min(s) < max(s) AND min(human) < max(human) THEN round(corr(rs, rh), 6) END AS spearman_rho FROM ranked GROUP BY scope""",
    "human_reviews scored",
)
def _(t):
    joined = t.human_reviews.select("artifact_id", S.human_six().alias("human")).join(
        t.scored.select("artifact_id", "diagram_type", F.round("composite_score", 9).alias("s")), "artifact_id"
    )
    return rounded(ST.spearman(joined, "s", "human", ["diagram_type"]), "spearman_rho")


@query(
    "e24_alignment",
    f"""WITH p AS (SELECT * FROM ({PAIRS})),
    scoped AS (SELECT 'all' AS scope, reviewer_id, round(s, 9) AS s, human FROM p UNION ALL SELECT diagram_type, reviewer_id, round(s, 9), human FROM p),
    ranked AS ({RANKED})
    SELECT v.scope, CASE WHEN v.scope = 'all' THEN (SELECT count(*) FROM human_reviews) END AS n_reviews, count(r.scope) AS n_pairs, count(DISTINCT reviewer_id) AS n_raters, CASE WHEN min(s) < max(s) AND min(human) < max(human) THEN round(corr(s, human), 6) END AS pearson_r, CASE WHEN min(s) < max(s) AND min(human) < max(human) THEN round(corr(rs, rh), 6) END AS spearman_rho
    FROM (VALUES ('all'), ('class'), ('object'), ('component'), ('package')) v(scope) LEFT JOIN ranked r ON r.scope = v.scope GROUP BY v.scope""",
    "human_reviews scored",
)
def _(t):
    scored = t.scored.withColumn("composite_score", F.round("composite_score", 9))
    return rounded(ST.alignment(t.human_reviews, scored), "pearson_r", "spearman_rho")


@query(
    "e25_fleiss",
    f"""WITH r AS (SELECT diagram_type, artifact_id, least(6, greatest(0, round_even(human, 0)))::INT AS c FROM ({PAIRS})),
    cells AS (SELECT diagram_type, artifact_id, c, count(*) AS k FROM r GROUP BY ALL),
    items AS (SELECT diagram_type, artifact_id, (sum(k * k) - 3) / 6.0e0 AS p FROM cells GROUP BY ALL HAVING sum(k) = 3),
    shares AS (SELECT c.diagram_type, c.c, sum(k) AS k FROM cells c JOIN items i USING (diagram_type, artifact_id) GROUP BY ALL),
    pe AS (SELECT diagram_type, sum((k / t) * (k / t)) AS chance FROM (SELECT *, sum(k) OVER (PARTITION BY diagram_type) AS t FROM shares) GROUP BY diagram_type),
    po AS (SELECT diagram_type, count(*) AS items, avg(p) AS observed FROM items GROUP BY diagram_type)
    SELECT diagram_type, items, round(observed, 6) AS observed, round(chance, 6) AS chance, round((observed - chance) / nullif(1 - chance, 0), 6) AS kappa
    FROM po JOIN pe USING (diagram_type)""",
    "human_reviews scored",
)
def _(t):
    rated = t.human_reviews.select("artifact_id", S.human_six().alias("human")).join(
        t.artifacts.select("artifact_id", "diagram_type"), "artifact_id"
    )
    kappa = ST.fleiss(rated, "diagram_type", "artifact_id", ST.score_bucket(F.col("human")), raters=3)
    return rounded(kappa, "observed", "chance", "kappa")


@query(
    "e36_review_delta",
    f"""SELECT diagram_type, count(*) AS n, round(avg(human - s), 6) AS mean_delta, round(stddev_samp(human - s), 6) AS sd_delta FROM ({PAIRS}) GROUP BY diagram_type""",
    "human_reviews scored",
)
def _(t):
    return rounded(ST.review_delta(t.human_reviews, t.scored), "mean_delta", "sd_delta")
