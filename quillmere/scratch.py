"""Tables in the cluster's shared folder, which cut lineage and are read more than once."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset and Spark runs in one process (tests), a temporary one
    that is set here. On a cluster an unset folder is an error: executors would not see the driver's."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="quillmere-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _delete_all() -> None:
    for spark, path in _MADE:
        delete(spark, path)
    _MADE.clear()


atexit.register(_delete_all)


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: what it took is done once, and a lost executor
    costs nothing of it. The table goes when the driver ends, or by drop()."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes a table that written() made and nothing reads any more."""
    for spark, path in [x for x in _MADE if any(x[1] in f for f in df.inputFiles()[:1])]:
        delete(spark, path)
        _MADE.remove((spark, path))


#: Spark's setting by which the shuffle files of a query go when it ends; else they stay until the driver collects its garbage.
SHORT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files of a query go as soon as it ends. What is written and read again needs them no longer."""
    before = spark.conf.get(SHORT, None)
    spark.conf.set(SHORT, "true")
    try:
        yield
    finally:
        spark.conf.set(SHORT, before) if before is not None else spark.conf.unset(SHORT)
