"""Streams: publishing by version, snapshots of scores, two tiers of first-seen rows."""

import re

import pytest
from pyspark.sql import functions as F

from tallyloom.streaming import jobs as J

SCORES = "artifact_id long, model_key string, weight double, available boolean, score int, created_s long"


def score(spark, *rows):
    return spark.createDataFrame([(i, "m", 1.0, True, s, at) for i, s, at in rows], SCORES)


def test_a_reader_sees_the_marked_version_while_the_next_is_written(spark, tmp_path):
    path = str(tmp_path / "rates")
    with pytest.raises(ValueError):
        J.published(spark, path)
    sink = J.publish(path)
    sink(spark.range(3), 0)
    held = J.published(spark, path)
    spark.range(9).write.parquet(f"{path}/version=1")  # written, not marked: the writer was lost here
    assert J.published(spark, path).count() == 3
    sink(spark.range(5), 1)  # the batch again
    assert J.published(spark, path).count() == 5 and held.count() == 3


def test_restarted_win_rates_go_on_from_the_last_version(spark, tmp_path):
    path, table, progress = (str(tmp_path / x) for x in ("in", "rates", "c"))
    fields = "kind string, key string, name string, ok boolean"
    for ok in (True, False):
        spark.createDataFrame([("generators", "class", "a", ok)], fields).write.mode("append").parquet(path)
        stream = J.read_stream(spark, path, spark.createDataFrame([], fields).schema)
        J.run_available(J.running_win_rates(stream), J.publish(table), progress, "complete")
    row = J.published(spark, table).first()
    assert (row["ok"], row["fail"], row["n"]) == (1, 1, 2) and J.marked(spark, table) >= 1


def test_summaries_read_the_snapshot_and_newer_batches_only(spark, tmp_path):
    log = str(tmp_path / "log")
    sink = J.score_log(log, every=3)
    for b in range(8):
        sink(score(spark, (b % 4, b, b), (100 + b, 1, b)).coalesce(1), b)
    read = J.open_scores(spark, log)
    # batches 0 to 5 lie in the snapshot, 6 and 7 after it
    files = {r["f"].split("/")[-2] for r in read.select(F.input_file_name().alias("f")).distinct().collect()}
    assert files == {"version=5", "batch=6", "batch=7"}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(batch#\d+\), \(batch#\d+ > 5\)", plan)  # earlier folders are not opened
    latest = {r["artifact_id"]: r["score"] for r in J.latest_scores(spark, log).collect()}
    assert latest == {0: 4, 1: 5, 2: 6, 3: 7, **{100 + b: 1 for b in range(8)}}


def test_late_rescoring_wins_across_a_compaction_and_reruns_change_nothing(spark, tmp_path):
    path, log, progress = (str(tmp_path / x) for x in ("in", "log", "c"))
    schema = score(spark).schema
    for when, value in ((1, 2), (9, 6), (5, 3)):  # the last arrives late
        score(spark, (1, value, when)).write.mode("append").parquet(path)
        J.run_available(J.read_stream(spark, path, schema), J.score_log(log, every=2), progress, "append")
    want = [(1, 6)]
    assert [(r["artifact_id"], r["score"]) for r in J.latest_scores(spark, log).collect()] == want
    sink = J.score_log(log, every=2)
    sink(score(spark, (1, 6, 9)), 1)  # the compacting batch again
    assert [(r["artifact_id"], r["score"]) for r in J.latest_scores(spark, log).collect()] == want


ROWS = "doc_id long, code string, at timestamp"


def arrivals(spark, *rows):
    return spark.createDataFrame(rows, "doc_id long, code string, s long").select("doc_id", "code", F.timestamp_seconds("s").alias("at"))


def test_copies_near_and_far_are_dropped_and_a_restart_remembers(spark, tmp_path):
    path, table, progress = (str(tmp_path / x) for x in ("in", "first", "c"))
    schema = spark.createDataFrame([], ROWS).schema

    def run():
        stream = J.first_seen(J.read_stream(spark, path, schema), "code", "at", "1 hour")
        J.run_available(stream, J.unseen(table, "first_seen_test", 4), progress, "append")

    hour = 3600
    for rows in (
        [(1, "a", 0), (2, " a ", 60), (3, "b", 120)],  # 2: within the hour
        [(4, "c", 100 * hour)],
        [(5, "a", 100 * hour + 5), (6, "d", 100 * hour + 6), (7, "c", 100 * hour + 7)],  # 5: by the table, 7: by the state
    ):
        arrivals(spark, *rows).coalesce(1).write.mode("append").parquet(path)
        run()
        spark.sql("DROP TABLE first_seen_test")  # another session knows the folder only
    kept = {r["doc_id"] for r in J.accepted(spark, table).collect()}
    assert kept in ({1, 3, 4, 6}, {2, 3, 4, 6})


def test_a_repeated_batch_is_not_its_own_copy(spark, tmp_path):
    table = str(tmp_path / "first")
    sink = J.unseen(table, "first_seen_again", 4)
    batch = arrivals(spark, (1, "a", 0), (2, "b", 0)).withColumn("hash", F.sha1("code"))
    for b in (0, 1, 1):
        sink(batch if b == 0 else batch.unionByName(arrivals(spark, (3, "c", 0)).withColumn("hash", F.sha1("code"))), b)
    assert sorted(r["doc_id"] for r in J.accepted(spark, table).collect()) == [1, 2, 3]
    assert spark.table("first_seen_again").count() == 3
    spark.sql("SET spark.sql.autoBroadcastJoinThreshold=-1")
    try:
        known = spark.table("first_seen_again").where("batch < 5").select("hash")
        plan = batch.join(known, "hash", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sql("RESET spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE first_seen_again")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
