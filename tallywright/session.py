"""Session builder and the shared-folder helper that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the library assumes; ``conf`` overrides (dots as double underscores)."""
    builder = (
        SparkSession.builder.master(master or os.environ.get("SPARK_MASTER", "local[8]"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master without one gets a temporary folder (tests); a cluster without one is an error, for its executors share no local disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tallywright-"))
        current = spark.sparkContext.getCheckpointDir()
    return str(current).rstrip("/")


#: Most rows of a list that ``small`` lets through.
SMALL_ROWS = 20_000


def small(rows: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A short list (rulebook, titles, one-row aggregate) marked for broadcast, once its size is checked: more than ``most`` rows are an error."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows where a short list is expected")
    return F.broadcast(rows)


#: Folders of the workspaces of each application, until they are released.
_FOLDERS: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Delete all tables that workspaces of this application wrote; frames that read them are of no use afterwards. Returns the number of folders."""
    folders = _FOLDERS.pop(spark.sparkContext.applicationId, [])
    for folder in folders:
        files, target = _files(spark, folder)
        files.delete(target, True)
    return len(folders)


class Workspace:
    """Tables written to the shared folder, so that iterative operators survive a lost executor.

    ``save`` writes a frame as Parquet and reads it back (lineage ends there);
    ``drop`` deletes a table that later steps do not read any more. What a result still reads stays until ``release``;
    ``lasting`` tables (fixed look-up tables of an application) stay beyond it.
    """

    def __init__(self, spark: SparkSession, label: str, lasting: bool = False):
        self.spark = spark
        self.base = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        if not lasting:
            _FOLDERS.setdefault(spark.sparkContext.applicationId, []).append(self.base)

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.base}/{self._n:04d}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tallywright_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_tallywright_path", None)
        if path:
            files, target = _files(self.spark, path)
            files.delete(target, True)

    @staticmethod
    def holds(df: DataFrame) -> bool:
        """Whether the table of a frame that ``save`` returned is still there."""
        files, target = _files(df.sparkSession, df._tallywright_path)
        return files.exists(target)


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target
