"""Session builder and the shared scratch folder.

``Workspace`` replaces local checkpoints: an intermediate result that is read more than once, or that ends the
lineage of a loop, is written as a parquet table into the folder that all executors share, so that a lost executor
costs a re-read and nothing else.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def build_session(app: str = "tasselworks", cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """Local session with the settings that the engine's results rely on (UTC, ANSI, adaptive execution)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only where that is unset, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = getattr(spark, "_tasselworks_dir", None)
        if named is None:
            named = tempfile.mkdtemp(prefix="tasselworks-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
            spark._tasselworks_dir = named
    return named.rstrip("/")


_ROOTS: dict[str, SparkSession] = {}


@atexit.register
def _remove_workspaces() -> None:
    """Deletes this driver's intermediate tables when it ends; what it cannot reach is left to the folder's owner."""
    for root, spark in _ROOTS.items():
        local = root.removeprefix("file://") if root.startswith(("file:///", "/")) else None
        try:
            if local:
                shutil.rmtree(local, ignore_errors=True)
            else:
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:
            pass


class Workspace:
    """Written intermediate tables of one operator run.

    ``keep(df)`` writes a frame and returns the frame read back; ``drop(df)`` deletes one that is no longer needed.
    Tables that the returned (lazy) result still reads stay until the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _ROOTS[self.root] = spark

    def keep(self, df: DataFrame, **metrics: Column) -> DataFrame:
        """Writes a frame and returns it read back; aggregates given by name are taken while it is written, without
        another job, and stand in the result's ``observed``."""
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        schema, watch = df.schema, Observation()
        if metrics:
            df = df.observe(watch, *[c.alias(name) for name, c in metrics.items()])
        df.write.parquet(path)
        back = self.spark.read.schema(schema).parquet(path)
        back._workspace_path = path
        back.observed = watch.get if metrics else {}
        return back

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = getattr(df, "_workspace_path", None)
            if path:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)
                df._workspace_path = None
