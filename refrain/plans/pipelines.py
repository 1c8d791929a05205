"""The two cleaning pipelines."""

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import language, songs


def clean_a(df: DataFrame, load: Callable[[], language.Detector] | None = language.CommonWords, stopwords: Iterable[str] | None = None, lemmas: dict[str, str] | None = None) -> DataFrame:
    """Cleaned songs with tokens: rows with lyrics, year and language; years 1980 to 2024; declared, then detected English
    (load=None: declared only); translated titles repaired; lyrics cleaned; songs without tokens dropped, and only then
    later songs of the same title and artist. df needs row_id."""
    out = songs.drop_missing(songs.rename(df, songs.RENAME_A), ["lyrics", "year", "language"])
    out = songs.language_is(songs.year_range(songs.project(out, songs.COLUMNS_A)))
    if load is not None:
        out = language.english_only(out, load=load)
    return _finish(songs.fix_translations(out.drop("language")), stopwords, lemmas)


def clean_b(df: DataFrame, stopwords: Iterable[str] | None = None, lemmas: dict[str, str] | None = None) -> DataFrame:
    """As clean_a(), of the chart's songs: no language filter, columns that are missing are left out."""
    out = songs.project(songs.rename(df, songs.RENAME_B), songs.COLUMNS_B, strict=False)
    return _finish(songs.year_range(songs.drop_missing(out, ["lyrics", "year"])), stopwords, lemmas)


def _finish(df: DataFrame, stopwords: Iterable[str] | None, lemmas: dict[str, str] | None) -> DataFrame:
    df = df.withColumn("lyrics", text.preprocess(F.col("lyrics")))
    # a filter on what a generator makes isn't pushed below it, where the whole chain would run a second time
    df = df.select("*", F.explode(F.array(text.tokenize(F.col("lyrics"), stopwords, lemmas, text.ONE_SPACE))).alias("lyrics_tokens"))
    return songs.keep_first(songs.non_empty(df))
