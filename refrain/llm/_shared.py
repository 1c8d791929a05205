"""Session helpers."""

from pyspark.sql import DataFrame, SparkSession

from ..operators.ranges import range_bucket
from ..sources.stages import done, fresh_path, shared_dir, stored

__all__ = ["checkpointed", "done", "fresh_path", "partitions", "range_bucket", "stored"]


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
