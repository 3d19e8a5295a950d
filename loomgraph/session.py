"""Session helpers: table access and cutting lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: list[str] = []
_WRITTEN: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir`` as the cluster sets it.

    Only a local session, whose executors are the driver, gets a temporary
    folder where it is unset; it is removed when the process ends.  A cluster
    without the setting raises an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set spark.checkpoint.dir to a folder all executors share (master {master})")
    if not _LOCAL_DIRS:
        _LOCAL_DIRS.append(tempfile.mkdtemp(prefix="loomgraph-"))
        atexit.register(shutil.rmtree, _LOCAL_DIRS[0], ignore_errors=True)
    return _LOCAL_DIRS[0]


def clear_steps(spark: SparkSession) -> int:
    """Delete the tables that ``cut_lineage`` wrote; to be called when no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    n = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cheaper than ``checkpoint()``, which computes its input twice, and safe
    against lost executors, which ``localCheckpoint`` is not.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)
