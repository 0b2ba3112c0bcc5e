"""Readers, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F, types as T

from tallyloom.operators import gates as G
from tallyloom.session import checkpointed
from tallyloom.sources import readers as R, sinks as K
from tallyloom.streaming import jobs as J

ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])


def test_jsonl_skips_or_fails(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"id": 1, "text": "a"}\n{oops\n{"id": 2, "text": "b"}\n')
    assert sorted(r.id for r in R.read_jsonl(spark, str(path), ROW).collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed"):
        R.read_jsonl(spark, str(path), ROW, tolerant=False).collect()


def test_catalog(spark, tmp_path):
    record = {
        "jobs": [{"id": 7, "status": "completed", "total": 2}],
        "artifacts": [
            {"id": 1, "job_id": 7, "diagram_type": "class", "created_at": "2024-05-01T10:00:00Z", "scores": [{"model_key": "m", "score": 5, "weight": 2.0}]},
            {"id": 2, "job_id": 7, "created_at": "soon"},
        ],
    }
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps(record, indent=1))
    jobs, artifacts, scores = R.flatten_catalog(R.read_catalog(spark, str(path)))
    assert jobs.first().mode == "single"
    rows = {r.artifact_id: r for r in artifacts.collect()}
    assert rows[2].diagram_type == "class" and str(rows[1].created_at) == "2024-05-01 10:00:00"
    assert [(r.artifact_id, r.score, r.available) for r in scores.collect()] == [(1, 5, True)]


def test_text_folder_survives_bad_bytes(spark, tmp_path):
    (tmp_path / "a.puml").write_bytes(b"class A\xff")
    (tmp_path / "b.txt").write_text("no")
    rows = R.scan_text_dir(spark, str(tmp_path), "*.puml").collect()
    assert [r.name for r in rows] == ["a.puml"] and rows[0].text.startswith("class A")


def test_numbered_lines(spark, tmp_path):
    path = tmp_path / "reqs.txt"
    path.write_text("# head\n first \n\nsecond\n#x\nthird\n")
    rows = sorted((r.req_id, r.line) for r in R.read_lines(spark, str(path)).collect())
    assert rows == [("REQ-001", "first"), ("REQ-002", "second"), ("REQ-003", "third")]


def test_missing_source_is_a_status(spark, tmp_path, folder):
    _, stats = R.load_sources(spark, [("docs", f"{folder}/documents.parquet"), ("gone", str(tmp_path / "x"))])
    assert {r.merge_source: r.status for r in stats.collect()} == {"docs": "loaded", "gone": "missing"}


def test_unknown_export_format_is_jsonl(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb")], ROW)
    assert K.export_dataset(df, str(tmp_path / "o"), "xml") == "jsonl"
    assert spark.read.schema(ROW).json(str(tmp_path / "o")).first().text == "a\nb"


def test_resume_builds_only_what_is_short(spark, tmp_path):
    path, built = str(tmp_path / "p"), []

    def build(langs):
        built.extend(langs)
        return spark.range(5).crossJoin(spark.createDataFrame([(x,) for x in langs], "lang string"))

    K.resume_partitions(spark, path, "lang", ["a"], 5, build)
    K.resume_partitions(spark, path, "lang", ["a", "b"], 5, build)
    assert built == ["a", "b"] and spark.read.parquet(path).count() == 10


def test_library_search_is_literal(spark):
    df = spark.createDataFrame([(1, "a 100% b"), (2, "a 100x b")], "artifact_id long, source_requirement string")
    assert [r.artifact_id for r in G.library(df, q="100 ").collect()] == [1, 2]
    assert G.library(df, q="%").count() == 2  # nothing is left of the needle


def test_reap_keeps_young_jobs(spark):
    df = spark.sql(
        "SELECT 1 AS job_id, 'running' AS status, timestamp_ntz'2024-01-01 11:50:00' AS updated_at, cast(null AS timestamp_ntz) AS created_at, '' AS error "
        "UNION ALL SELECT 2, 'running', cast(null AS timestamp_ntz), timestamp_ntz'2024-01-01 09:00:00', 'old' UNION ALL SELECT 3, 'completed', null, null, null"
    )
    rows = {r.job_id: r for r in G.reap_stale(df, F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"), 45).collect()}
    assert [rows[i].status for i in (1, 2, 3)] == ["running", "failed", "completed"] and rows[2].error == "old"


def test_checkpoint_reads_the_session_folder(spark):
    df = checkpointed(spark.range(3))
    assert df.count() == 3 and not spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty()
