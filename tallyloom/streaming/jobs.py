"""The incremental operators as streams.

Each builds on the function its batch form uses, so both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import text as X
from ..operators import policy as P, scores as S


def read_stream(spark: SparkSession, path: str, fields: T.StructType, files_per_batch: int | None = 1) -> DataFrame:
    """New parquet files of a folder as a stream."""
    reader = spark.readStream.schema(fields)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(stream: DataFrame, sink, checkpoint: str, mode: str) -> None:
    """Process what is there in micro-batches, then stop; progress survives in ``checkpoint``."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(sink).start().awaitTermination()


def running_win_rates(outcomes: DataFrame) -> DataFrame:
    """The win-rate table; state is one row per (kind, key, name)."""
    return P.win_rates(outcomes)


Sink = Callable[[DataFrame, int], None]


def mark(spark: SparkSession, path: str, version: int) -> None:
    """Say that ``version`` below ``path`` is complete; the last act of whoever wrote it."""
    done = spark.range(1).select(F.lit(version).cast("long").alias("version")).coalesce(1)
    done.write.mode("overwrite").parquet(f"{path}/marks/{version}")


def marked(spark: SparkSession, path: str) -> int | None:
    """The newest complete version below ``path``."""
    if not exists(spark, f"{path}/marks"):
        return None
    fields = T.StructType([T.StructField("version", T.LongType())])
    return spark.read.schema(fields).option("recursiveFileLookup", "true").parquet(f"{path}/marks").agg(F.max("version")).first()[0]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in whatever store its name points to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def publish(path: str) -> Sink:
    """Sink for complete-mode tables. Every batch writes a version of its own, then marks it.

    Nothing that a reader may hold open is overwritten: :func:`published` reads the newest marked
    version, and a batch that failed half-way left no mark. A repeated batch replaces its version.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        mark(batch.sparkSession, path, batch_id)

    return sink


def published(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version written by :func:`publish`."""
    version = marked(spark, path)
    if version is None:
        raise ValueError(f"nothing is published below {path} yet")
    return spark.read.parquet(f"{path}/version={version}")


def score_log(path: str, every: int = 8) -> Sink:
    """Sink that keeps the newest score per (artifact, model) as a snapshot and what came after.

    A batch writes its own folder of newest scores; each ``every``-th batch then merges the last
    snapshot and the batches since into the next snapshot and marks it. So a reader never goes
    through more than one snapshot and ``every`` batches, however long the stream has run, and a
    batch costs what it holds but for the merges. A repeated batch replaces what it wrote.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        newest_scores(batch).write.mode("overwrite").parquet(f"{path}/batches/batch={batch_id}")
        if (batch_id + 1) % every == 0:
            spark = batch.sparkSession
            merged = newest_scores(open_scores(spark, path, batch_id))
            merged.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
            mark(spark, path, batch_id)

    return sink


def open_scores(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The last snapshot before batch ``upto`` and the batches after it, up to and with that one."""
    version = marked(spark, path)
    if version is not None and upto is not None and version >= upto:  # a repeated batch: the mark is its own
        version = None
    batches = spark.read.parquet(f"{path}/batches")
    if version is not None:
        batches = batches.where(F.col("batch") > version)
    if upto is not None:
        batches = batches.where(F.col("batch") <= upto)
    batches = batches.drop("batch")
    return batches if version is None else spark.read.parquet(f"{path}/version={version}").unionByName(batches)


def newest_scores(scores: DataFrame) -> DataFrame:
    """The newest score of every (artifact, model); a later rescoring replaces earlier ones.

    The stored form keeps a missing score as 0 with ``available`` false; here it becomes null.
    """
    row = F.struct(S.available_score(F.col("score"), F.col("available")).alias("score"), "weight", "available", "created_s")
    newest = scores.groupBy("artifact_id", "model_key").agg(F.max_by(row, "created_s").alias("r"))
    return newest.select("artifact_id", "model_key", "r.*")


def latest_scores(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`score_log` has kept, each score once."""
    return newest_scores(open_scores(spark, path))


def running_type_summary(artifacts: DataFrame, scores: DataFrame) -> DataFrame:
    """Composite and majority per type over the newest scores."""
    return S.with_verdicts(artifacts, scores).groupBy("diagram_type").agg(
        F.count("*").alias("n"), F.avg("composite_score").alias("mean_s"), F.count_if("majority_accepted").alias("majority")
    )


def first_seen(stream: DataFrame, code: str, at: str, delay: str) -> DataFrame:
    """T3, first tier: rows whose content was not seen within ``delay``; adds ``hash``.

    State is bounded by the watermark. Copies further apart pass here and are stopped by the
    second tier, :func:`unseen`. ``at`` is the time of arrival, or one whose disorder ``delay`` covers:
    a row that is later than that is dropped, as in any watermarked stream.
    """
    hashed = stream.withColumn("hash", X.code_hash(F.col(code))).withWatermark(at, delay)
    return hashed.dropDuplicatesWithinWatermark(["hash"])


def hash_table(spark: SparkSession, name: str, path: str, buckets: int) -> None:
    """The table of all accepted hashes, bucketed by hash; a session that starts anew finds it by its path."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (hash STRING, batch BIGINT) USING parquet "
        f"CLUSTERED BY (hash) SORTED BY (hash) INTO {buckets} BUCKETS LOCATION '{path}'"
    )


def unseen(path: str, name: str, buckets: int = 64) -> Sink:
    """T3, second tier: sink that keeps the rows whose hash no earlier batch has accepted.

    Each batch is held against a table of all accepted hashes. That table is bucketed by hash, so
    it is read where it lies and only the batch is shuffled. Accepted rows go to a folder of the
    batch's own. A repeated batch sees the hashes of earlier batches only, replaces its rows and adds its
    hashes once.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hash_table(spark, name, f"{path}/hashes", buckets)
        known = spark.table(name)
        before = known.where(F.col("batch") < batch_id).select("hash")
        batch.join(before, "hash", "left_anti").write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        if known.where(F.col("batch") == batch_id).isEmpty():
            accepted = spark.read.parquet(f"{path}/rows/batch={batch_id}").select("hash", F.lit(batch_id).cast("long").alias("batch"))
            accepted.repartition(buckets, "hash").write.insertInto(name)

    return sink


def accepted(spark: SparkSession, path: str) -> DataFrame:
    """All rows :func:`unseen` has let through, with their batch."""
    return spark.read.parquet(f"{path}/rows")


def hourly_status(events: DataFrame, at: str, status: str) -> DataFrame:
    """T4: events per hour and status; on a stream call it on a watermarked frame."""
    counts = events.groupBy(F.window(at, "1 hour"), status).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("hour"), status, "n")
