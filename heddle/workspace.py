"""Where intermediate tables live, and small helpers every operator may use."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO_DIR = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Folders of local sessions without the setting, one a process; and the scopes that are open.
_OWN: list[str] = []
_SCOPES: list[str] = []
#: Applications whose executors have this package.
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A local session without that setting (tests) gets one temporary folder, made once a process.
    On a cluster a machine-local folder would lose data, so there the setting must be there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="heddle-"))
    return _OWN[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    base = _SCOPES[-1] if _SCOPES else f"{shared_dir(spark)}/heddle"
    return f"{base}/{uuid.uuid4().hex}/{name}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made inside are removed at the end of the block.

    Results are lazy and read those tables, so they must be written out inside::

        with scratch(spark):
            operator(docs).write.parquet(target)
    """
    path = scratch_path(spark, "scope")
    _SCOPES.append(path)
    try:
        yield path
    finally:
        _SCOPES.remove(path)
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The written table replaces the lineage: what follows survives lost executors without
    recomputing ``df``, and several readers share one computation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed: once an application, a zip
    of its modules goes to every executor, as files of ``addPyFile`` do."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.join(REPO_DIR, "heddle")
    name = os.path.join(tempfile.mkdtemp(prefix="heddle-"), "heddle_package.zip")
    with zipfile.ZipFile(name, "w") as packed:
        for folder, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    packed.write(path, os.path.relpath(path, REPO_DIR))
    context.addPyFile(name)
    _SHIPPED.add(context.applicationId)


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``: a let-binding inside one expression."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
