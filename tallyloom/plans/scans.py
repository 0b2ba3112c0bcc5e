"""Sources and sinks."""

from pyspark.sql import functions as F, types as T

from .. import schema
from ..operators import dedupe as D
from ..operators.rank import id_levels
from ..session import scratch_dir
from ..sources import readers as R, registry as G, sinks as K
from . import sqltext as Q
from .catalog import query
from .reporting import rounded


@query(
    "a01_load_sources",
    """SELECT 'documents' AS merge_source, 'loaded' AS status, count(*) AS rows FROM documents UNION ALL SELECT 'benchmark', 'loaded', count(*) FROM benchmark
    UNION ALL SELECT 'absent', 'missing', 0""",
)
def _(t):
    specs = [(n, f"{t.folder}/{n}.parquet") for n in ("documents", "benchmark")] + [("absent", f"{t.folder}/absent.parquet")]
    _, stats = R.load_sources(t.spark, specs)
    return stats


CHAT = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
)


@query(
    "a02_jsonl_tolerant",
    "SELECT role, count(*) AS n, sum(length(text)) AS chars FROM conversations WHERE conv_id % 10 <> 3 GROUP BY role",
)
def _(t):
    path = scratch_dir(t.spark, "jsonl")
    line = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    broken = F.when(F.col("conv_id") % 10 == 3, F.concat(F.lit("{oops "), line)).otherwise(line)
    t.conversations.select(broken.alias("value")).write.text(path)
    rows = R.read_jsonl(t.spark, path, CHAT)
    return rows.groupBy("role").agg(F.count("turn").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("a03_jsonl_strict", "SELECT role, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY role")
def _(t):
    path = scratch_dir(t.spark, "jsonl")
    t.conversations.select("conv_id", "turn", "role", "text").write.json(path)
    rows = R.read_jsonl(t.spark, path, CHAT, tolerant=False)
    return rows.groupBy("role").agg(F.count("turn").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    "a04_flatten_catalog",
    """SELECT 'jobs' AS part, count(DISTINCT job_id) AS n, count(DISTINCT job_id) AS ids FROM artifacts UNION ALL SELECT 'artifacts', count(*), count(DISTINCT artifact_id) FROM artifacts
    UNION ALL SELECT 'scores', count(*), count(DISTINCT artifact_id) FROM model_scores""",
    "artifacts model_scores",
)
def _(t):
    path = scratch_dir(t.spark, "catalog")
    scores = t.model_scores.groupBy("artifact_id").agg(F.collect_list(F.struct("model_key", "score", "weight", "available")).alias("scores"))
    row = F.struct(
        F.col("artifact_id").alias("id"), "job_id", "diagram_type", "input_mode", "source_language", "source_requirement",
        "technical_spec", "plantuml_code", "render_status", "scores",
    )
    # five artifacts make a job, so the nested record is small
    catalog = t.artifacts.join(scores, "artifact_id").groupBy("job_id").agg(F.collect_list(row).alias("artifacts")).select(
        F.array(F.struct(F.col("job_id").alias("id"), F.lit("batch").alias("mode"))).alias("jobs"), "artifacts"
    )
    catalog.write.json(path)
    jobs, artifacts, marks = R.flatten_catalog(t.spark.read.schema(schema.CATALOG).json(path))
    out = None
    for part, df, key in (("jobs", jobs, "job_id"), ("artifacts", artifacts, "artifact_id"), ("scores", marks, "artifact_id")):
        n = df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("ids")).withColumn("part", F.lit(part))
        out = n if out is None else out.unionByName(n)
    return out


_KIND = "CASE artifact_id % 6 WHEN 0 THEN 'Use_Case' WHEN 1 THEN 'class' WHEN 2 THEN 'timing' WHEN 3 THEN 'mindmap' WHEN 4 THEN '' ELSE 'package' END"
_META = (
    "concat('{\"f', artifact_id, '.puml\": {\"primary_type\": \"', " + _KIND + ", '\", \"repository\": \"r', artifact_id % 9, '\", \"elements\": {\"note\": ', artifact_id % 3, "
    "', \"class\": ', artifact_id % 5, '}, \"connections\": {}', CASE WHEN artifact_id % 13 = 0 THEN ', \"extraction_error\": \"x\"' ELSE '' END, '}}')"
)


def wild_rows(t):
    meta = R.classified(t.diagrams.selectExpr(f"{_META} AS m"), "m")
    files = t.diagrams.where("artifact_id % 11 <> 0").select(
        F.concat(F.lit("f"), F.col("artifact_id").cast("string"), F.lit(".puml")).alias("name"), F.col("plantuml_code").alias("text")
    )
    joined = meta.join(files, "name", "left")
    return joined.withColumn("kind", R.wild_type(F.col("meta.primary_type"), F.coalesce("text", F.lit(""))))


@query(
    "a05_import_classified",
    f"""SELECT concat('f', artifact_id, '.puml') AS name, artifact_id % 13 = 0 AS failed, artifact_id % 11 <> 0 AS has_file,
      CASE WHEN k NOT IN ('class', 'object', 'component', 'package') AND len(string_split(lower(code), 'package ')) - 1 >= 2 AND NOT contains(lower(code), 'class ') AND NOT contains(lower(code), 'component ') THEN 'package' ELSE k END AS kind
    FROM (SELECT artifact_id, CASE WHEN artifact_id % 11 <> 0 THEN plantuml_code ELSE '' END AS code, CASE artifact_id % 6 WHEN 0 THEN 'usecase' WHEN 1 THEN 'class' WHEN 2 THEN 'sequence' WHEN 3 THEN 'mindmap' WHEN 4 THEN 'unknown' ELSE 'package' END AS k FROM diagrams)""",
    "diagrams",
)
def _(t):
    return wild_rows(t).select(
        "name", F.col("meta.extraction_error").isNotNull().alias("failed"), F.col("text").isNotNull().alias("has_file"), "kind"
    )


@query(
    "l17_metadata_spec",
    f"""SELECT concat('f', artifact_id, '.puml') AS name, md5(concat_ws(chr(10), '## Technical Specification', concat('### Target diagram type', chr(10), 'k'),
      concat('### Source', chr(10), 'UML-in-the-Wild open-source PlantUML diagram (Zenodo DOI 10.5281/zenodo.18952372).'), concat('### Repository', chr(10), 'r', artifact_id % 9), concat('### Path', chr(10), 'f', artifact_id, '.puml'),
      concat('### Structure summary', chr(10), 'Elements: ', coalesce(nullif(concat_ws(', ', CASE WHEN artifact_id % 5 > 0 THEN concat('class=', artifact_id % 5) END, CASE WHEN artifact_id % 3 > 0 THEN concat('note=', artifact_id % 3) END), ''), 'n/a'), '. Connections: n/a.'),
      concat('### Task', chr(10), 'Produce valid black-and-white PlantUML for this diagram type matching the structural intent above.'))) AS digest FROM diagrams""",
    "diagrams",
)
def _(t):
    meta = R.classified(t.diagrams.selectExpr(f"{_META} AS m"), "m")
    return meta.select("name", F.md5(R.wild_spec(F.col("meta"), F.lit("k"), F.col("name"))).alias("digest"))


@query(
    "a06_text_files",
    """SELECT concat('part=', doc_id % 40) AS folder, count(*) AS lines, sum(length(l))::BIGINT AS chars, md5(string_agg(l, chr(10) ORDER BY l)) AS digest
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE l <> '' GROUP BY 1""",
)
def _(t):
    path = scratch_dir(t.spark, "texts")
    part = (F.col("doc_id") % 40).alias("part")
    t.texts.select("text", part).repartition("part").write.partitionBy("part").text(path)
    lines = R.scan_text_dir(t.spark, path, "*.txt").select("folder", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    sorted_lines = F.array_join(F.array_sort(F.collect_list("line")), "\n")
    return lines.groupBy("folder").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"), F.md5(sorted_lines).alias("digest"))


@query(
    "a07_numbered_lines",
    f"""SELECT printf('REQ-%03d', row_number() OVER (ORDER BY doc_id, pos)) AS req_id, line FROM (
      SELECT doc_id, pos, {Q.stripped('line')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents))
    WHERE line <> '' AND line NOT LIKE '#%'""",
)
def _(t):
    lines = t.texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    out = R.number_lines(lines, "line", [F.col("doc_id"), F.col("pos")], id_levels("doc_id"))
    return out.select("req_id", "line")


def registry(t):
    def rows(where=None):
        diagrams = t.diagrams if where is None else t.diagrams.where(where)
        return lambda: diagrams.select(
            F.col("artifact_id").alias("row_id"), F.col("plantuml_code").alias("uml_code"), F.col("plantuml_code").alias("code")
        )

    return G.Registry(
        [
            G.Source("low", 5, "umlcode", rows(), allow_types=["class", "object", "package"]),
            G.Source("high", 20, "umlcode", rows("artifact_id % 3 = 0"), forced_type="class"),
            G.Source("low", 1, "cas2uml", rows()),  # a slug that is taken
            G.Source("gone", 9, "umlcode", lambda: None),
        ]
    )


@query(
    "a09_registry",
    f"""WITH i AS (SELECT artifact_id, plantuml_code, {Q.INFERRED} AS k FROM (SELECT *, lower(plantuml_code) AS c FROM diagrams) WHERE length({Q.stripped('plantuml_code')}) >= 20),
    u AS (SELECT artifact_id, plantuml_code, 'high' AS slug, 20 AS p, 'class' AS t FROM i WHERE artifact_id % 3 = 0 AND k NOT IN ('usecase', 'sequence', 'state', 'deployment')
      UNION ALL SELECT artifact_id, plantuml_code, 'low', 5, k FROM i WHERE k IN ('class', 'object', 'package'))
    SELECT artifact_id AS row_id, slug AS source_dataset, t AS diagram_type FROM (SELECT *, row_number() OVER (PARTITION BY plantuml_code ORDER BY p DESC, slug, artifact_id) AS rn FROM u) WHERE rn = 1""",
    "diagrams",
)
def _(t):
    rows = registry(t).load()
    return D.dedupe_code(rows, "uml_code", F.col("priority"), "source_dataset", "row_id", carry=["row_id", "source_dataset", "diagram_type"])


@query(
    "a10_source_yield",
    """SELECT source AS source_dataset, count(*) AS raw_rows, count(*) FILTER (WHERE length(text) >= 800)::BIGINT AS kept_rows FROM documents GROUP BY 1""",
)
def _(t):
    raw = t.documents.select(F.col("source").alias("source_dataset"), F.length("text").alias("chars"))
    return G.source_yield(raw, raw.where("chars >= 800"), "source_dataset")


def _exported(t, fmt: str, rows):
    """The path ``rows`` are exported to, and the format they have there."""
    path = scratch_dir(t.spark, fmt)
    return path, K.export_dataset(rows, path, fmt)


def _read_back(t, fmt, path, done, schema):
    if done == "parquet":
        back = t.spark.read.parquet(path)
    elif done == "csv":
        back = t.spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    else:
        back = t.spark.read.schema(schema).json(path)
    return back.agg(
        F.count("*").alias("n"), F.count_if("majority_accepted").alias("majority"), F.count_distinct(F.md5("plantuml_code")).alias("texts")
    ).withColumn("format", F.lit(fmt))


_EXPORT = "SELECT '{f}' AS format, count(*) AS n, count(*) FILTER (WHERE majority_accepted) AS majority, count(DISTINCT plantuml_code) AS texts FROM scored"


@query("a11_export", " UNION ALL ".join(_EXPORT.format(f=f) for f in ("jsonl", "csv", "parquet", "xml")), "scored")
def _(t):
    rows = t.scored.select("artifact_id", "diagram_type", "plantuml_code", "majority_accepted")
    # the join of whole texts with their scores runs once; the other formats are written from its rows
    table, done = _exported(t, "parquet", rows)
    stored, out = t.spark.read.parquet(table), None
    for fmt in ("jsonl", "csv", "parquet", "xml"):
        path, kind = (table, done) if fmt == "parquet" else _exported(t, fmt, stored)
        n = _read_back(t, fmt, path, kind, rows.schema)
        out = n if out is None else out.unionByName(n)
    return out


@query(
    "a12_write_twin",
    "SELECT f AS form, diagram_type, count(*) AS n FROM artifacts CROSS JOIN (VALUES ('parquet'), ('jsonl')) v(f) GROUP BY ALL",
    "artifacts",
)
def _(t):
    rows = t.artifacts.select("artifact_id", "diagram_type", "plantuml_code")
    table, lines = K.write_twin(rows, scratch_dir(t.spark, "twin"))
    both = t.spark.read.parquet(table).withColumn("form", F.lit("parquet")).unionByName(
        t.spark.read.schema(rows.schema).json(lines).withColumn("form", F.lit("jsonl"))
    )
    return both.groupBy("form", "diagram_type").agg(F.count("*").alias("n"))


@query(
    "a13_manifest",
    """WITH c AS (SELECT diagram_type, source_dataset, input_mode, source_language, composite_score > 0 AS s, dataset_accepted AS a FROM scored WHERE render_ok),
    k AS (SELECT 'total' AS facet, 'all' AS key, s, a FROM c UNION ALL SELECT 'by_type', diagram_type, s, a FROM c UNION ALL SELECT 'by_source', source_dataset, s, a FROM c
      UNION ALL SELECT 'by_mode', input_mode, s, a FROM c UNION ALL SELECT 'by_language', coalesce(source_language, 'null'), s, a FROM c)
    SELECT facet, key, count(*) AS rows, count(*) FILTER (WHERE s) AS scored, count(*) FILTER (WHERE a) AS accepted, CASE WHEN facet = 'total' THEN (SELECT count(*) FROM scored WHERE NOT coalesce(render_ok, false)) END AS dropped FROM k GROUP BY facet, key""",
    "scored",
)
def _(t):
    return K.manifest(t.scored, F.col("render_ok"))


@query(
    "a14_release_counts",
    """SELECT 'diagram_type' AS "column", coalesce(diagram_type, 'null') AS key, count(*) AS n FROM corpus GROUP BY 2
    UNION ALL SELECT 'input_mode', coalesce(input_mode, 'null'), count(*) FROM corpus GROUP BY 2 UNION ALL SELECT 'source_language', coalesce(source_language, 'null'), count(*) FROM corpus GROUP BY 2""",
    "corpus",
)
def _(t):
    return K.release_counts(t.corpus, ["diagram_type", "input_mode", "source_language"])


@query(
    "a14_release_sample",
    "SELECT ordinal, md5(uml_code) AS digest FROM corpus ORDER BY md5(concat_ws('|', '42', ordinal)), ordinal LIMIT 20",
    "corpus",
)
def _(t):
    return K.release_sample(t.corpus, "ordinal").select("ordinal", F.md5("uml_code").alias("digest"))


_COLUMNS = [
    ("ordinal", "bigint"), ("diagram_type", "string"), ("input_mode", "string"), ("source_language", "string"), ("uml_code", "string"),
    ("technical_spec", "string"), ("source_dataset", "string"), ("dataset_accepted", "boolean"), ("majority_accepted", "boolean"),
]


@query(
    "a14_release_schema",
    " UNION ALL ".join(f"""SELECT {i} AS place, '{n}' AS "column", '{k}' AS type, count({n}) AS filled FROM corpus""" for i, (n, k) in enumerate(_COLUMNS)),
    "corpus",
)
def _(t):
    return K.schema_rows(t.corpus)


@query(
    "a15_resume",
    "SELECT coalesce(source_language, 'unknown') AS source_language, count(*) AS n, coalesce(source_language, 'unknown') <> 'java' AS rebuilt FROM corpus GROUP BY 1, 3",
    "corpus",
)
def _(t):
    path = scratch_dir(t.spark, "partitions")

    corpus = t.corpus.withColumn("source_language", F.coalesce("source_language", F.lit("unknown")))
    every = [r["source_language"] for r in corpus.select("source_language").distinct().collect()]

    def build(langs):
        return corpus.where(F.col("source_language").isin(langs))

    K.resume_partitions(t.spark, path, "source_language", ["java"], 1, build)
    built = K.resume_partitions(t.spark, path, "source_language", sorted(every), 1, build)
    done = t.spark.read.parquet(path).groupBy("source_language").agg(F.count("*").alias("n"))
    return done.withColumn("rebuilt", F.col("source_language").isin(*built))


@query("a16_drop_heavy", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(t):
    return K.drop_heavy(t.documents, ["text"])
