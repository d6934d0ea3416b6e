"""Tables in the folder that driver and executors share, to cut long lineages; and the
package itself, where workers cannot find it."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset, a temporary folder if
    driver and workers are one machine, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    known = context.getCheckpointDir()
    if folder is None:
        if known.isEmpty() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="spark-")
    if known.isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Write the rows to the shared folder and go on from there. Lost executors can be
    replaced without running what came before. ``replaces``: a table of an earlier call
    that nothing needs from now on; it is deleted."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if replaces is not None:
        _delete(spark, replaces._chronoloom_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._chronoloom_path = path
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return out


def bucketed(df: DataFrame, buckets: int, by: list[str], *order: str) -> DataFrame:
    """As ``materialise``, in buckets by these columns, each in this order: sums by them
    read the table as it lies, without a shuffle. It is in the session's catalog until it
    is discarded."""
    spark = df.sparkSession
    name = f"buckets_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*order).option("path", path).saveAsTable(name, format="parquet")
    out = spark.table(name)
    out._chronoloom_path, out._chronoloom_name = path, name
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return out


#: Tables written so far, by application.
_written: dict[str, list[str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` and ``bucketed`` that nothing needs from now on."""
    for t in tables:
        if getattr(t, "_chronoloom_name", None):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {t._chronoloom_name}")
        _delete(t.sparkSession, t._chronoloom_path)


def discard_tables(spark: SparkSession) -> int:
    """Delete all tables that ``materialise`` has written for this application, when their
    results have been saved elsewhere; how many there were."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, unless they find it by PYTHONPATH or the working
    folder as the driver does."""
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(here)
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    sc = spark.sparkContext
    if any(p and os.path.realpath(p) == os.path.realpath(root) for p in known) or getattr(sc, "_chronoloom_shipped", False):
        return
    sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), "chronoloom"), "zip", root, os.path.basename(here)))
    sc._chronoloom_shipped = True
