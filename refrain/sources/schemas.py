"""Explicit schemas of the inputs: nothing is inferred from the data."""

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType


def _struct(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


RAW_A = _struct(("title", StringType()), ("tag", StringType()), ("artist", StringType()), ("year", StringType()), ("views", LongType()), ("lyrics", StringType()), ("language", StringType()))
RAW_B = _struct(("Song Title", StringType()), ("Artist", StringType()), ("Release Date", StringType()), ("Year", StringType()), ("Rank", IntegerType()), ("Lyrics", StringType()))
LEXICON = _struct(("word", StringType()), ("emotion", StringType()), ("association", IntegerType()))
