"""A stream of file changes applied to a store of versions.

Each micro-batch reads the store's snapshot and the batches since, only for the files that it
names, and adds a batch of its own; a batch that is run again after a failure is added once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.sync import latest, logged
from .versions import MOST, Versions


def current(spark: SparkSession, store: str, schema: StructType) -> DataFrame:
    """The newest state of each file, deleted ones left out: a whole version, whatever is written meanwhile."""
    return Versions(spark, store, schema).rows()


def apply_changes(changes: DataFrame, store: str, checkpoint: str, *, available_now: bool = True, most: int = MOST) -> StreamingQuery:
    """Apply ``path, action, content_hash, seq, ...`` rows (action upsert or delete) to ``store``.

    In a batch the last change of a file by ``seq`` counts. An upsert whose hash equals the
    stored one is skipped; another raises the file's version by one. A delete of a file that
    the store lacks is skipped. After ``most`` batches the store is compacted.
    """
    schema = changes.schema

    def one_batch(batch: DataFrame, number: int) -> None:
        held = Versions(batch.sparkSession, store, schema, most)
        manifest = held.manifest()
        if number <= manifest["last"]:
            return
        newest = latest(batch, ["path"], F.col("seq"))
        known = held.rows(manifest, newest).select("path", F.col("content_hash").alias("_hash"), F.col("version").alias("_version"))
        joined = newest.join(known, "path", "left")
        goes = (F.col("action") == "delete") & F.col("_version").isNotNull()
        comes = (F.col("action") == "upsert") & ~F.col("content_hash").eqNullSafe(F.col("_hash"))
        out = joined.where(goes | comes).withColumn("version", F.coalesce(F.col("_version"), F.lit(0)).cast("long") + F.when(F.col("action") == "upsert", 1).otherwise(0))
        held.add(out.drop("_hash", "_version"), number)

    writer = changes.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def reloading(changes: DataFrame, settings: str, apply: Callable[[DataFrame, int, dict], None], checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Apply each micro-batch with the settings as they then are: the JSON file at ``settings`` is read again for each, so a change holds from the next batch on. Without a file the settings are empty."""

    def one_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(settings)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        said = "".join(r[0] for r in spark.read.text(settings, wholetext=True).collect()) if there else ""  # one small file
        apply(batch, number, json.loads(said) if said.strip() else {})

    writer = changes.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def event_log(events: DataFrame, path: Column, supported: tuple[str, ...], out: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Append every raw event to a log, with whether and why it is ignored."""
    writer = logged(events, path, supported).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
