"""Ranges of a column, and numbers in its order, without a task that sees all rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_bucket(df: DataFrame, column: str, pieces: int) -> Column:
    """A bucket number 0..pieces-1 that rises with `column`, from approximate quantiles: only `pieces` numbers reach
    the driver. Equal values share a bucket; null goes to bucket 0."""
    cuts: list = []
    if pieces > 1:
        found = df.agg(F.percentile_approx(column, [i / pieces for i in range(1, pieces)], 50 * pieces).alias("q")).first()
        cuts = sorted(set(found.q or []))
    if not cuts:
        return F.lit(0)
    # a balanced tree of comparisons, so each row needs only log2(pieces) of them
    at = F.col(column)

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(at <= F.lit(cuts[mid]), pick(lo, mid)).otherwise(pick(mid + 1, hi))

    return F.when(at.isNull(), F.lit(0)).otherwise(pick(0, len(cuts)))


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """With the place of each row in the order of a numeric column, from 1, nulls first: ranges are ranked each by itself and
    shifted by the sizes of those before. Rows of one value are numbered in any order."""
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("__part", range_bucket(df, order, pieces))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row for each range
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(F.col(order).asc_nulls_first()))
    return placed.withColumn(name, rank).join(F.broadcast(before), "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")
