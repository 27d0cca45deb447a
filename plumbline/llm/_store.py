"""Where the operators keep tables between jobs: a folder that driver and executors share.

The folder is the one that the session names in ``spark.checkpoint.dir``. Only where that is unset, as in
tests on one machine, a temporary folder is made and removed at exit.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            made = tempfile.mkdtemp(prefix="plumbline-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            _own[app] = f"file://{made}"
        named = _own[app]
    return named.rstrip("/")


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Tables that are written inside leave no shuffle files: Spark removes them when the job has ended, not whenever the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Workspace:
    """One query's own subfolder of the shared folder; it goes when the JVM ends, or earlier by drop()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as a table and reads it back: cuts the lineage, and what is lost with an executor is reread."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads."""
        for name in names:
            self._fs.delete(self._path(self.path(name)), True)
