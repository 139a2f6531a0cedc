"""Session helpers: one place for the settings every job relies on.

Nothing here overrides what a cluster already configured: the builder only
fills in values that are unset, and the checkpoint folder is read from
``spark.checkpoint.dir`` when the cluster names one.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators assume. AQE re-plans joins (broadcast only when the
# runtime size is under the threshold), coalesces small shuffle partitions
# and splits skewed join partitions.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "remuneria",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Local/test session. On a cluster, pass ``master=None`` and let
    spark-submit decide; explicit ``extra`` settings win over DEFAULTS."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("REMUNERIA_DRIVER_MEM", "8g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder. A cluster names it in
    ``spark.checkpoint.dir``; only a local session may leave it unset and
    then gets a fresh scratch folder. Anywhere else a machine-local folder
    would silently lose data, so it is an error."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        master = sc.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir is not set and the master is {master!r}: "
                               "name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="remuneria-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


class Scratch:
    """Intermediate tables of one query, written as Parquet below the shared
    checkpoint folder (they survive lost executors). ``drop`` removes a table
    that nothing reads any more; the rest goes when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        path, fs = self._on(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return it as a table without lineage."""
        self.count += 1
        path = f"{self.root}/t{self.count}"
        df.write.parquet(path, compression="zstd")
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables returned by ``save``."""
        for t in tables:
            for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
                self._delete(path)

    def close(self) -> None:
        """Delete all tables."""
        self._delete(self.root)

    def _on(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        p, fs = self._on(path)
        fs.delete(p, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss;
    never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
