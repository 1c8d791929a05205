"""Scores of songs as they arrive, and their deduplication."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.resources import WEIGHTS
from ..functions.text import strip


def score_stream(songs: DataFrame, lexicon: dict[str, list[str]], weights: dict[str, float] | None = None) -> DataFrame:
    """Adds lyrics_tokens, emotion_word_count, count_ of each weighted group and emotion_score, without state: expressions
    inside the row only. lexicon has the groups of each word; it becomes part of the plan, so it should be small."""
    weights = WEIGHTS if weights is None else weights
    df = songs.withColumn("lyrics_tokens", text.tokenize(text.preprocess(F.col("lyrics"))))
    matches = lambda words: F.size(F.filter("lyrics_tokens", lambda t: strip(t).isin(sorted(words)))) if words else F.lit(0)
    df = df.withColumn("emotion_word_count", matches(lexicon))
    df = df.withColumns({f"count_{g}": matches([w for w, own in lexicon.items() if g in own]) for g in weights})
    return df.withColumn("emotion_score", sum((F.col(f"count_{g}") * F.lit(float(x)) for g, x in weights.items()), F.lit(0.0)))


def first_within(songs: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first song to arrive of each title and artist; state is dropped after the watermark."""
    return songs.withWatermark(time, delay).dropDuplicatesWithinWatermark(["title", "artist"])
