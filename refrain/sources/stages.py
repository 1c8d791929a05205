"""Stages: results written once to the folder that the cluster shares, and read again."""

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local one is made if the session runs on this machine
    alone; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        path = tempfile.mkdtemp(prefix="refrain-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for path, spark in _made.items():
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session may have ended; its folder then goes with the cluster
            continue


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/refrain-{uuid.uuid4().hex}/{tag}"
    _made[path] = spark
    return path


@contextmanager
def _without_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is run inside has its shuffle files removed at its end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage is cut, lost executors lose nothing, and the
    shuffle files it took are removed."""
    path = fresh_path(df.sparkSession, tag)
    with _without_shuffles(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def done(*stages: DataFrame) -> None:
    """Deletes what stored() wrote for these, which nothing may read any more. Other DataFrames are left alone."""
    for df in stages:
        path = _paths.pop(df, None)
        if path is not None:
            _delete(df.sparkSession, path.rsplit("/", 1)[0])
            _made.pop(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan that has fewer tasks than the cluster has cores, as of one small file, is dealt over all of them; any other stays
    as it is. For what costs far more than a shuffle, given straight after the scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
