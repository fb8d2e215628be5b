"""Shared helpers: table access, shipping the code, checkpoints, clash-free names."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 256
_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give executors this package, so Python operators import instead of unpickle it.

    Importing keeps per-process caches (vocabularies, word memos) alive between
    the tasks of a reused worker.
    """
    # Documents can be long, so few rows go to a Python worker at once. The session keeps this limit, or a lower one of its own.
    limit = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < limit <= ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    folder = os.path.realpath(tempfile.mkdtemp(prefix="pkg-"))
    target = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def shipped(spark: SparkSession, path: str) -> str:
    """Send a file of the driver to all executors; ``local`` finds it there by the name that this gives."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def local(name: str) -> str:
    return SparkFiles.get(name)


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors see: ``spark.checkpoint.dir``. Only a local session may do without and has a temporary one."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir", None):
        return folder
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="shared-")


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in ``spark.checkpoint.dir``.

    Its files go when the session cleans what it no longer refers to (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as a Parquet table in the shared folder, for as long as the block runs.

    A table's size is known when joins are planned, so a small one is broadcast, by the
    session's own threshold, and a large one is not.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(spark, path)


def strict(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns: callers' further columns cannot clash with ours."""
    return df.select(*[F.col(c) for c in columns])


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has a column of that name, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, dropped: DataFrame, doc_id: str) -> DataFrame:
    """``df`` without the ids in ``dropped`` (a column ``doc_id``). Texts move only if the dropped ids are too many to broadcast."""
    gone = unused(df, "gone_id")
    return df.join(dropped.select(F.col("doc_id").alias(gone)), F.col(doc_id) == F.col(gone), "left_anti")


def repeated(df: DataFrame, doc_id: str) -> DataFrame:
    """The ids (as ``doc_id``) of more than one row."""
    return df.groupBy(F.col(doc_id).alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
