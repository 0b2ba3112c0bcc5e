"""Readers (A1-A7)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import fixed, schema
from ..functions import text as X
from ..operators.align import merge_sources
from ..operators.rank import exact_rank


def read_parquet(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def load_sources(spark: SparkSession, specs: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """A1: all present sources in one schema, and a status row per source."""
    found = [(label, read_parquet(spark, path)) for label, path in specs]
    rows = merge_sources([(label, df) for label, df in found if df is not None])
    listed = spark.createDataFrame(
        [(label, "missing" if df is None else "loaded") for label, df in found], "merge_source string, status string"
    )
    counts = rows.groupBy("merge_source").agg(F.count("*").alias("rows"))
    return rows, listed.join(counts, "merge_source", "left").fillna(0, ["rows"])


def read_jsonl(
    spark: SparkSession, path: str, fields: T.StructType, tolerant: bool = True, limit: int | None = None
) -> DataFrame:
    """A2/A3: JSON lines; malformed lines are skipped, or fail the job when not tolerant."""
    mode = "DROPMALFORMED" if tolerant else "FAILFAST"
    df = spark.read.schema(fields).option("mode", mode).json(path)
    return df if limit is None else df.limit(limit)


def flatten_catalog(catalog: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A4: nested catalogue records to jobs, artifacts and scores."""
    default = F.lit("1970-01-01 00:00:00").cast("timestamp")
    jobs = catalog.select(F.inline("jobs")).select(
        F.col("id").alias("job_id"), F.coalesce("mode", F.lit("single")).alias("mode"),
        F.coalesce("status", F.lit("completed")).alias("status"), F.coalesce("total", F.lit(1)).alias("total"),
        F.coalesce("completed", F.lit(0)).alias("completed"), X.iso_time(F.col("created_at"), default).alias("created_at"),
    )
    nested = catalog.select(F.inline("artifacts"))
    artifacts = nested.select(
        F.col("id").alias("artifact_id"), "job_id", F.coalesce("diagram_type", F.lit("class")).alias("diagram_type"),
        F.coalesce("input_mode", F.lit("requirement")).alias("input_mode"), "source_language",
        F.coalesce("source_requirement", F.lit("")).alias("source_requirement"),
        F.coalesce("technical_spec", F.lit("")).alias("technical_spec"), F.coalesce("plantuml_code", F.lit("")).alias("plantuml_code"),
        F.coalesce("render_status", F.lit("success")).alias("render_status"),
        F.coalesce("composite_score", F.lit(0.0)).alias("composite_score"),
        F.coalesce("majority_accepted", F.lit(False)).alias("majority_accepted"),
        F.coalesce("affirmative_votes", F.lit(0)).alias("affirmative_votes"),
        F.coalesce("dataset_accepted", F.lit(False)).alias("dataset_accepted"),
        F.coalesce("acceptance_tau", F.lit(fixed.TAU)).alias("acceptance_tau"),
        X.iso_time(F.col("created_at"), default).alias("created_at"),
    )
    scores = nested.select(F.col("id").alias("artifact_id"), F.inline("scores")).select(
        "artifact_id", F.coalesce("model_key", F.lit("")).alias("model_key"), F.coalesce("model_name", F.lit("")).alias("model_name"),
        F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.coalesce("available", F.lit(True)).alias("available"),
    )
    return jobs, artifacts, scores


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.CATALOG).option("multiLine", True).json(path)


def classified(meta: DataFrame, column: str) -> DataFrame:
    """A5: JSON maps from file name to classification, one row per file."""
    parsed = meta.select(F.from_json(column, schema.WILD_META).alias("m"))
    return parsed.select(F.explode("m").alias("name", "meta"))


def wild_spec(meta: Column, kind: Column, name: Column) -> Column:
    """Specification text from classification metadata, non-zero counts in name order."""
    def counts(c: Column) -> Column:
        entries = F.array_sort(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,int>"))))
        shown = F.transform(F.filter(entries, lambda e: e["value"] != 0), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
        return F.coalesce(F.nullif(F.array_join(shown, ", "), F.lit("")), F.lit("n/a"))

    # --- fixed value: specification text of a classified file -------------------------------------
    note = F.nullif(X.strip(F.coalesce(meta["reasoning"], F.lit(""))), F.lit(""))
    return F.concat_ws(
        "\n",
        F.lit("## Technical Specification"), F.concat(F.lit("### Target diagram type\n"), kind),
        F.lit("### Source\nUML-in-the-Wild open-source PlantUML diagram (Zenodo DOI 10.5281/zenodo.18952372)."),
        F.concat(F.lit("### Repository\n"), F.coalesce(meta["repository"], F.lit("unknown"))),
        F.concat(F.lit("### Path\n"), F.coalesce(meta["original_path"], name)),
        F.concat(F.lit("### Structure summary\nElements: "), counts(meta["elements"]), F.lit(". Connections: "), counts(meta["connections"]), F.lit(".")),
        F.concat(F.lit("### Classification note\n"), note),
        F.lit("### Task\nProduce valid black-and-white PlantUML for this diagram type matching the structural intent above."),
    )


def wild_type(primary: Column, code: Column) -> Column:
    """A5: the mapped type; package-heavy texts outside the main types become packages."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in fixed.SUBTYPE_MAP.items()))
    low = F.lower(X.strip(F.coalesce(primary, F.lit(""))))
    mapped = F.coalesce(F.try_element_at(table, low), F.nullif(low, F.lit("")), F.lit("unknown"))
    c = F.lower(code)
    packages = F.size(F.split(c, "package ")) - 1
    heavy = (packages >= 2) & ~F.contains(c, F.lit("class ")) & ~F.contains(c, F.lit("component "))
    return F.when(~mapped.isin(*fixed.APP_TYPES) & heavy, F.lit("package")).otherwise(mapped)


def scan_text_dir(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per file of a folder and those below it: folder, name and leniently decoded text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    text = F.col("content").cast("string")  # a cast keeps going where ``decode`` would fail on bad bytes
    steps = F.split("path", "/")
    return files.select(F.element_at(steps, -2).alias("folder"), F.element_at(steps, -1).alias("name"), text.alias("text"))


def number_lines(lines: DataFrame, line: str, order: Sequence[Column], coarse: Sequence[Column]) -> DataFrame:
    """Non-blank, non-comment lines numbered from 1 in order."""
    kept = lines.withColumn(line, X.strip(F.col(line))).where((F.col(line) != "") & ~F.col(line).startswith("#"))
    ranked = exact_rank(kept, order, coarse, name="number")
    return ranked.withColumn("req_id", F.format_string("REQ-%03d", "number"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A text file's lines in file order; rows of one split keep their order in the split."""
    rows = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("seq"),
    )
    return number_lines(rows, "line", [F.col("seq")], [F.col("file"), F.col("start")]).select("req_id", "line")
