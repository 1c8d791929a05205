"""CSV, TSV, text and Parquet sources and sinks."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from ..functions.resources import MISSING
from ..functions.text import strip
from . import schemas


def missing_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null for the texts that stand for a missing value, in string columns; null for NaN in floating ones."""
    out = {}
    for f in df.schema.fields:
        if columns is not None and f.name not in columns:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, StringType):
            out[f.name] = F.when(~c.isin(MISSING), c)
        elif f.dataType.simpleString() in ("double", "float"):
            out[f.name] = F.when(~F.isnan(c), c)
    return df.withColumns(out)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Different numbers that rise within each file in the order of its rows; several files, and parts of one, follow each other as
    Spark deals them to tasks, the larger first. Take a key of the source instead where it has one. Given straight after the
    scan, before any shuffle."""
    return df.withColumn(name, F.monotonically_increasing_id())


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV with a header; quoted fields may hold line ends and doubled quotes. Columns are found by name: those that the
    schema lacks are ignored, those that the file lacks are null. Spark's parser drops NUL characters inside quoted fields."""
    header = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False).columns
    full = StructType()
    for n in header:
        full.add(n, StringType())
    raw = missing_to_null(spark.read.schema(full).csv(path, header=True, multiLine=True, escape='"'))
    picked = [(F.col(f"`{f.name}`") if f.name in header else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in schema.fields]
    return raw.select(*picked)


def read_songs_a(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.RAW_A)


def read_songs_b(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.RAW_B)


def read_lexicon(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(word, emotion, association) of a TSV without a header. The word `null` is a word; blank lines are skipped; strict
    makes a line of another form an error."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("line")).where("line <> ''")
    parts = F.split("line", "\t", -1)
    fields = lines.select(F.get(parts, 0).alias("word"), F.get(parts, 1).alias("emotion"), F.get(parts, 2).try_cast("int").alias("association"), F.size(parts).alias("n"), "line")
    ok = (F.col("n") == 3) & F.col("association").isNotNull()
    if strict:
        fields = fields.withColumn("word", F.when(ok, F.col("word")).otherwise(F.raise_error(F.concat(F.lit("not word, emotion, number: "), F.col("line")))))
    else:
        fields = fields.where(ok)
    return fields.select("word", "emotion", "association")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """The different words of a file with one on each line."""
    return spark.read.text(path).select(strip(F.col("value")).alias("word")).where("word <> ''").distinct()


def word_set(*frames: DataFrame) -> list[str]:
    """The union of word lists, for use as stopwords."""
    out = frames[0].select("word")
    for f in frames[1:]:
        out = out.union(f.select("word"))
    return sorted(r.word for r in out.distinct().collect())


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header; arrays and maps become JSON texts. White space around a text is kept, which Spark's writer would cut off."""
    nested = {f.name: F.to_json(F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, ArrayType | MapType | StructType)}
    df.withColumns(nested).write.mode(mode).csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def parse_list(df: DataFrame, column: str) -> DataFrame:
    """The arrays of a column of JSON texts; a column of arrays stays as it is."""
    if isinstance(df.schema[column].dataType, ArrayType):
        return df
    return df.withColumn(column, F.from_json(F.col(column), "array<string>"))


def write_stage(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def replace_stage(df: DataFrame, path: str) -> None:
    """Replaces a stage that df itself may read: written beside it, then swapped; if the second of the two renames fails, the
    old stage is put back."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    new, old = (f"{path.rstrip('/')}.{k}-{uuid.uuid4().hex}" for k in ("new", "old"))
    df.write.parquet(new)
    make = jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = fs.exists(make(path))
    if there and not fs.rename(make(path), make(old)):
        raise OSError(f"{path} can't be renamed")
    if not fs.rename(make(new), make(path)):
        if there:
            fs.rename(make(old), make(path))
        raise OSError(f"{new} can't be renamed")
    fs.delete(make(old), True)
    spark.catalog.refreshByPath(path)
