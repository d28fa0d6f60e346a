"""Session settings, table access and the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_TEST_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once a session; Spark's file server distributes the archive."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    made = Path(tempfile.mkdtemp(prefix="quillmill-code-"))
    atexit.register(shutil.rmtree, made, True)
    package = Path(__file__).parent
    context.addPyFile(shutil.make_archive(str(made / "quillmill"), "zip", package.parent, package.name))


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that results depend on; sizes and executors stay as the cluster has them."""
    ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # of a repeated member the last counts, as in every JSON reader here
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: spark.checkpoint.dir of the session.

    Only where that is unset (a local master, as in tests) is a temporary folder made; on a cluster an
    unset folder is an error, as a machine-local one would lose data.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _TEST_DIRS:
        made = tempfile.mkdtemp(prefix="quillmill-")
        atexit.register(shutil.rmtree, made, True)
        _TEST_DIRS[context.applicationId] = f"file://{made}"
    return _TEST_DIRS[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def temporary(spark: SparkSession, path: str) -> str:
    """Have what is at a path deleted when the session's JVM ends."""
    system, where = _file_system(spark, path)
    system.deleteOnExit(where)
    return path


def persisted(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder, which survives the loss of executors and goes with the session."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.parquet(temporary(df.sparkSession, path))
    table.stored_at = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a persisted table that nothing needs any more."""
    system, where = _file_system(table.sparkSession, table.stored_at)
    system.delete(where, True)
