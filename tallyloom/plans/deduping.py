"""Ranks, dedupe, merge, exclusion and overlap."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import align as A, dedupe as D, rank as R
from .catalog import query
from .reporting import rounded
from .sqltext import stripped


@query(
    "f00_global_rank",
    "SELECT artifact_id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', artifact_id)), artifact_id) AS rank FROM big_artifacts",
    "big_artifacts",
)
def _(t):
    return R.seeded_rank(t.big_artifacts.select("artifact_id"), "artifact_id", 42)


@query(
    "f00_group_rank",
    "SELECT artifact_id, row_number() OVER (PARTITION BY diagram_type ORDER BY md5(concat_ws('|', '7', artifact_id)), artifact_id) AS rank FROM big_artifacts",
    "big_artifacts",
)
def _(t):
    return R.seeded_rank(t.big_artifacts.select("artifact_id", "diagram_type"), "artifact_id", 7, by=["diagram_type"]).drop("diagram_type")


def tagged(t):
    """Three overlapping corpora with priorities."""
    return (
        t.corpus_a.withColumn("priority", F.lit(3)).withColumn("slug", F.lit("a"))
        .unionByName(t.corpus_b.withColumn("priority", F.lit(2)).withColumn("slug", F.lit("b")))
        .unionByName(t.corpus_c.withColumn("priority", F.lit(1)).withColumn("slug", F.lit("c")))
    )


TAGGED = """SELECT *, 3 AS priority, 'a' AS slug, 0 AS place FROM corpus_a UNION ALL SELECT *, 2, 'b', 1 FROM corpus_b UNION ALL SELECT *, 1, 'c', 2 FROM corpus_c"""
VIEWS = "corpus_a corpus_b corpus_c"


@query(
    "f01_keep_first",
    f"""SELECT slug, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY uml_code ORDER BY priority DESC, slug, ordinal) AS rn FROM ({TAGGED})) WHERE rn = 1""",
    VIEWS,
)
def _(t):
    return D.dedupe_code(tagged(t), "uml_code", F.col("priority"), "slug", "ordinal", carry=["slug", "ordinal"])


def merged(t):
    return A.merge_sources([("a", t.corpus_a), ("b", t.corpus_b), ("c", t.corpus_c)], keep=["ordinal"])


@query(
    "f02_merge_stripped",
    f"""SELECT slug AS merge_source, ordinal, copies FROM (SELECT *, row_number() OVER (PARTITION BY {stripped('uml_code')} ORDER BY place, ordinal) AS rn,
      count(*) OVER (PARTITION BY {stripped('uml_code')}) AS copies FROM ({TAGGED}) WHERE length({stripped('uml_code')}) >= 20) WHERE rn = 1""",
    VIEWS,
)
def _(t):
    long = merged(t).where(F.length(X.strip(F.col("uml_code"))) >= 20)
    return D.dedupe_stripped(long, "uml_code", "merge_rank", "ordinal", copies="copies", carry=["merge_source", "ordinal"])


@query(
    "f02_merge_report",
    f"""WITH k AS (SELECT slug FROM (SELECT *, row_number() OVER (PARTITION BY {stripped('uml_code')} ORDER BY place, ordinal) AS rn FROM ({TAGGED})) WHERE rn = 1),
    r AS (SELECT slug, count(*) AS rows_in, (SELECT count(*) FROM k WHERE k.slug = x.slug) AS rows_kept FROM ({TAGGED}) x GROUP BY slug)
    SELECT slug AS merge_source, rows_in, rows_kept, rows_in - rows_kept AS rows_dropped FROM r
    UNION ALL SELECT 'total', sum(rows_in)::BIGINT, sum(rows_kept)::BIGINT, sum(rows_in - rows_kept)::BIGINT FROM r""",
    VIEWS,
)
def _(t):
    rows = merged(t)
    return D.merge_report(rows, D.dedupe_stripped(rows, "uml_code", "merge_rank", "ordinal", carry=["merge_source"]))


@query(
    "f03_fingerprint",
    """SELECT ordinal FROM (SELECT ordinal, row_number() OVER (PARTITION BY array_to_string(list_filter(list_transform(string_split(uml_code, chr(10)), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: l <> ''), chr(10))
      ORDER BY ordinal) AS rn FROM corpus) WHERE rn = 1""",
    "corpus",
)
def _(t):
    return D.dedupe_fingerprint(t.corpus, "uml_code", [F.col("ordinal")], carry=["ordinal"])


@query(
    "f04_pair_key",
    "SELECT min(ordinal) AS ordinal, count(*) AS copies FROM (SELECT * FROM corpus) GROUP BY uml_code, technical_spec",
    "corpus",
)
def _(t):
    return D.keep_first(t.corpus, [F.sha1("uml_code"), F.sha1("technical_spec")], [F.col("ordinal")], copies="copies", carry=["ordinal"])


@query(
    "f05_source_text",
    f"SELECT min(ordinal) AS ordinal FROM corpus GROUP BY {stripped('technical_spec')}",
    "corpus",
)
def _(t):
    return D.keep_first(t.corpus, [X.code_hash(F.col("technical_spec"))], [F.col("ordinal")], carry=["ordinal"])


@query(
    "f18_base_wins",
    """WITH b AS (SELECT *, 0 AS side FROM corpus_a UNION ALL SELECT *, 1 AS side FROM corpus_b)
    SELECT ordinal, side FROM (SELECT *, row_number() OVER (PARTITION BY uml_code ORDER BY side, ordinal) AS rn FROM b) WHERE rn = 1""",
    VIEWS,
)
def _(t):
    sides = t.corpus_a.withColumn("side", F.lit(0)), t.corpus_b.withColumn("side", F.lit(1))
    return D.merge_into(*sides, "uml_code", "ordinal", carry=["ordinal", "side"])


@query(
    "f18_new_wins",
    """WITH b AS (SELECT *, 1 AS side FROM corpus_a UNION ALL SELECT *, 0 AS side FROM corpus_b)
    SELECT ordinal, side FROM (SELECT *, row_number() OVER (PARTITION BY uml_code ORDER BY side, ordinal) AS rn FROM b) WHERE rn = 1""",
    VIEWS,
)
def _(t):
    sides = t.corpus_a.withColumn("side", F.lit(1)), t.corpus_b.withColumn("side", F.lit(0))
    return D.merge_into(*sides, "uml_code", "ordinal", base_wins=False, carry=["ordinal", "side"])


@query(
    "d02_exclude_known",
    f"""SELECT ordinal FROM corpus_a WHERE {stripped('uml_code')} NOT IN (SELECT {stripped('uml_code')} FROM corpus_b UNION SELECT {stripped('text')} FROM benchmark)""",
    VIEWS,
)
def _(t):
    return D.exclude_known(t.corpus_a, "uml_code", [(t.corpus_b, "uml_code"), (t.benchmark, "text")]).select("ordinal")


@query(
    "g01_preference_sort",
    "SELECT artifact_id, row_number() OVER (ORDER BY majority_accepted DESC, round(composite_score, 6) DESC NULLS LAST, artifact_id DESC) AS place FROM scored",
    "scored",
)
def _(t):
    rows = rounded(t.scored, "composite_score").select("artifact_id", "majority_accepted", "composite_score")
    # a place for every row: ranks inside narrow bands of the score, offsets before them
    down = (~F.col("majority_accepted")).cast("int")
    band = F.coalesce(F.floor(-F.col("composite_score") * 1000), F.lit(10**6))
    ranked = R.exact_rank(rows, [down, F.desc_nulls_last("composite_score"), F.desc("artifact_id")], [down, band], name="place")
    return ranked.select("artifact_id", "place")


@query(
    "g02_newest",
    "SELECT artifact_id, job_id FROM artifacts ORDER BY created_s DESC, artifact_id DESC LIMIT 40",
    "artifacts",
)
def _(t):
    return t.artifacts.orderBy(F.desc("created_s"), F.desc("artifact_id")).limit(40).select("artifact_id", "job_id")


@query(
    "g03_seeded_shuffle",
    "SELECT ordinal, md5(concat_ws('|', '42', ordinal)) AS key FROM corpus",
    "corpus",
)
def _(t):
    return t.corpus.select("ordinal", R.order_key(42, "ordinal").alias("key")).orderBy("key")


@query(
    "g04_union_schemas",
    """SELECT merge_source, diagram_type, input_mode, count(*) AS n, count(technical_spec) AS specs, count(source_requirement) AS reqs FROM (
      SELECT 'a' AS merge_source, diagram_type, input_mode, technical_spec, technical_spec AS source_requirement FROM corpus_a
      UNION ALL SELECT 'bench', 'class', 'requirement', NULL, NULL FROM benchmark
      UNION ALL SELECT 'pages', 'class', 'requirement', url, url FROM pages) GROUP BY ALL""",
    VIEWS,
)
def _(t):
    union = A.merge_sources(
        [
            ("a", t.corpus_a),
            ("bench", t.benchmark.select(F.col("text").alias("uml_code"))),
            ("pages", t.pages.select(F.col("html").alias("uml_code"), F.col("url").alias("technical_spec"))),
        ]
    )
    return union.groupBy("merge_source", "diagram_type", "input_mode").agg(
        F.count("*").alias("n"), F.count("technical_spec").alias("specs"), F.count("source_requirement").alias("reqs")
    )


@query(
    "g05_except_by_hash",
    f"SELECT count(*) AS rows, count(DISTINCT {stripped('uml_code')}) AS texts FROM corpus WHERE {stripped('uml_code')} NOT IN (SELECT {stripped('uml_code')} FROM corpus_c)",
    VIEWS + " corpus",
)
def _(t):
    rest = D.exclude_known(t.corpus, "uml_code", [(t.corpus_c, "uml_code")])
    return rest.agg(F.count("*").alias("rows"), F.count_distinct(X.code_hash(F.col("uml_code"))).alias("texts"))


@query(
    "g06_overlap",
    f"""WITH h AS (SELECT DISTINCT slug, {stripped('uml_code')} AS c FROM ({TAGGED}))
    SELECT x.slug AS corpus, y.slug AS other, (SELECT count(*) FROM h WHERE h.slug = x.slug) AS texts,
      (SELECT count(*) FROM h a JOIN h b ON a.c = b.c WHERE a.slug = x.slug AND b.slug = y.slug) AS shared,
      round((SELECT count(*) FROM h a JOIN h b ON a.c = b.c WHERE a.slug = x.slug AND b.slug = y.slug) / (SELECT count(*) FROM h WHERE h.slug = x.slug), 6) AS share
    FROM (VALUES ('a'), ('b'), ('c')) x(slug), (VALUES ('a'), ('b'), ('c')) y(slug) WHERE x.slug <> y.slug""",
    VIEWS,
)
def _(t):
    return rounded(D.overlap({"a": t.corpus_a, "b": t.corpus_b, "c": t.corpus_c}, "uml_code"), "share")


@query(
    "g07_dedupe_counts",
    f"""SELECT count(*) AS before, count(DISTINCT {stripped('uml_code')}) AS after, count(*) - count(DISTINCT {stripped('uml_code')}) AS dropped,
      count(*) FILTER (WHERE length({stripped('uml_code')}) < 20) AS short FROM ({TAGGED})""",
    VIEWS,
)
def _(t):
    hashes = tagged(t).groupBy(X.code_hash(F.col("uml_code")).alias("h"), (F.length(X.strip(F.col("uml_code"))) < 20).alias("s")).agg(
        F.count("*").alias("n")
    )
    return hashes.agg(
        F.sum("n").alias("before"), F.count("*").alias("after"), (F.sum("n") - F.count("*")).alias("dropped"),
        F.coalesce(F.sum(F.when(F.col("s"), F.col("n"))), F.lit(0)).alias("short"),
    )
