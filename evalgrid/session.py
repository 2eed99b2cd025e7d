"""Where intermediate tables live.

Lineage is cut by writing a table to the shared folder the session names in
``spark.checkpoint.dir``; the files outlive any executor, unlike cached blocks.
"""

import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


@cache
def _single_machine_folder() -> str:
    return tempfile.mkdtemp(prefix="evalgrid-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``, or its context as checkpoint folder.

    Where neither is set, a temporary folder serves if all runs in one process; on a cluster
    it would not be shared, so that is an error.
    """
    named = spark.conf.get(_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{_CONF} has to name a folder that driver and executors share, on {master}")
        named = _single_machine_folder()
    return named.rstrip("/")


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/evalgrid/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; never reused, so readers stay valid.

    All paths of an application share one folder; ``remove_scratch`` removes it.
    """
    return f"{_application_folder(spark)}/{uuid.uuid4().hex}/{name}"


def remove_scratch(spark: SparkSession) -> None:
    """Remove what this application has kept; tables that were read from it are void then."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_application_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once, keep it as a Parquet table and return a scan of it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _kept(spark: SparkSession, name: str) -> tuple[str, JavaObject, JavaObject]:
    """The path of the table kept under ``name``, as text and for the file system, and that."""
    kept = f"{shared_folder(spark)}/evalgrid/kept/{name}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept)
    return kept, path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_kept(spark: SparkSession, name: str) -> bool:
    """Whether ``keep_once`` has a table under this name."""
    _, path, files = _kept(spark, name)
    return files.exists(path)


def keep_once(spark: SparkSession, name: str, table: Callable[[], DataFrame]) -> DataFrame:
    """A scan of the table kept under ``name`` in the shared folder, computed if it is not there yet.

    It outlives the application. The table is written elsewhere and then renamed, so it is there
    whole or not at all; of two that write at once, one is taken. ``name`` has to say all that the
    table depends on.
    """
    kept, path, files = _kept(spark, name)
    if not files.exists(path):
        new = scratch_path(spark, "kept")
        table().write.parquet(new)
        files.mkdirs(path.getParent())
        if not files.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new), path) and not files.exists(path):
            raise OSError(f"cannot move {new} to {kept}")
    return spark.read.parquet(kept)
