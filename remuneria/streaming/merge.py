"""Z1 as Structured Streaming: merge daily call observations into the
history table incrementally.

Plan: file source (parquet) -> observation projection -> ``foreachBatch``:
each micro-batch is aggregated to one row per url (first and last date seen,
fields of the newest observation under a total order) and appended to a
change log under the shared checkpoint folder. That aggregate is associative
and commutative, so the history is the same aggregate over the log: late
observations and urls that return after any time need no state in the stream
and no watermark, and equal the batch result. Every ``compact_every`` batches
the log is merged into one history table (one row per url) and the folders
that it covers are deleted.

Restarts are exactly-once: a replayed batch overwrites its own
``batch_id=`` folder, and a compaction its own ``upto=`` folder; readers use
the newest history and the batches behind it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import FIELDS
from ..session import Scratch
from ..sources import bindings as B

COMPACT_EVERY = 50


def observation_stream(spark: SparkSession, source: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Observations from ``source``: a parquet file, a folder of part files or a glob."""
    reader = spark.readStream.schema(spark.read.parquet(source).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not (fs.exists(path) and fs.getFileStatus(path).isDirectory()):  # a file or a glob: streams read folders
        reader = reader.option("pathGlobFilter", path.getName())
        source = path.getParent().toString()
    return B.observations_from_events(reader.parquet(source))


def merged(rows: DataFrame) -> DataFrame:
    """One row per url of rows with (url, primera_vez_visto, ultima_vez_visto, newest)."""
    return rows.groupBy("url").agg(F.min("primera_vez_visto").alias("primera_vez_visto"),
                                   F.max("ultima_vez_visto").alias("ultima_vez_visto"), F.max("newest").alias("newest"))


def as_rows(obs: DataFrame, fields=FIELDS) -> DataFrame:
    """Observations in the shape that ``merged`` takes; ``newest`` orders by
    time, then by all fields."""
    return obs.select("url", F.col("seen_date").alias("primera_vez_visto"), F.col("seen_date").alias("ultima_vez_visto"),
                      F.struct("seen_ts", *fields).alias("newest"))


class ChangeLog:
    """The folders ``changes/batch_id=N`` and ``history/upto=N``."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _ids(self, kind: str, name: str) -> list[int]:
        fs, p = self._fs(f"{self.base}/{kind}")
        if not fs.exists(p):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n.split("=")[1]) for n in found if n.startswith(f"{name}="))

    def _drop(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def append(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.base}/changes/batch_id={batch_id}")

    def rows(self, upto: int | None = None) -> DataFrame | None:
        """Everything merged so far, one or more rows per url."""
        done = [i for i in self._ids("history", "upto") if upto is None or i < upto]
        paths = [f"{self.base}/history/upto={done[-1]}"] if done else []
        paths += [f"{self.base}/changes/batch_id={i}" for i in self._ids("changes", "batch_id")
                  if i > (done[-1] if done else -1) and (upto is None or i <= upto)]
        return self.spark.read.parquet(*paths) if paths else None

    def compact(self, batch_id: int) -> None:
        """Merge the history and all batches up to ``batch_id`` into a new history."""
        merged(self.rows(batch_id)).write.mode("overwrite").parquet(f"{self.base}/history/upto={batch_id}")
        for i in self._ids("history", "upto"):
            if i < batch_id:
                self._drop(f"{self.base}/history/upto={i}")
        for i in self._ids("changes", "batch_id"):
            if i <= batch_id:
                self._drop(f"{self.base}/changes/batch_id={i}")


def start_merge(obs: DataFrame, log: ChangeLog, checkpoint_dir: str, available_now: bool = True,
                compact_every: int = COMPACT_EVERY):
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        log.append(merged(as_rows(batch)), batch_id)
        if (batch_id + 1) % compact_every == 0:
            log.compact(batch_id)

    w = obs.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(write_batch)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_merged(log: ChangeLog, fields=FIELDS) -> DataFrame | None:
    """The history: one row per url, with its state (vigente when last seen on
    the newest snapshot date). None before the first batch."""
    rows = log.rows()
    if rows is None:
        return None
    flat = merged(rows)
    newest = flat.agg(F.max("ultima_vez_visto")).scalar()
    return flat.select(
        "url", *[F.col("newest")[c].alias(c) for c in fields], "primera_vez_visto", "ultima_vez_visto",
        F.when(F.col("ultima_vez_visto") == newest, F.lit("vigente")).otherwise(F.lit("expirada")).alias("estado"))


def run_merge_stream(spark: SparkSession, source: str, max_files_per_trigger: int | None = 1,
                     work_dir: str | None = None, compact_every: int = COMPACT_EVERY) -> DataFrame | None:
    """Run the stream to completion over what is in ``source`` now
    (availableNow) and return the merged history read back from its log."""
    base = work_dir or Scratch(spark, "z1").root  # the caller's folder, or one for this run
    log = ChangeLog(spark, os.path.join(base, "log"))
    q = start_merge(observation_stream(spark, source, max_files_per_trigger), log, os.path.join(base, "state"),
                    compact_every=compact_every)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return read_merged(log)
