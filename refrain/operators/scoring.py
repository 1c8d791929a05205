"""Counts, ratios and scores of each song's tokens against a lexicon, in one pass."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.resources import GROUPS, WEIGHTS
from ..functions.text import join_words, strip


def song_stats(songs: DataFrame, words: DataFrame, groups: list[str] = GROUPS, tokens: str = "lyrics_tokens", keys: tuple[str, ...] = ("row_id", "title", "artist"), digits: int | None = 2) -> DataFrame:
    """keys, total_tokens, emotion_word_count, emotion_word_ratio, emotion_words and, for each group, count_ and ratio_.

    words has (word, groups). A token counts for each of its groups, and once as an emotion word; ratios are per cent of all
    tokens, rounded half to even to `digits` (None: not rounded). Tokens are matched without outer spaces.

    A lexicon of fewer bytes than spark.sql.autoBroadcastJoinThreshold, by Spark's own statistics, goes to every executor. Then
    only matched tokens leave the scan's stage: rows of a song lie in one task, so the partial aggregate makes one row of
    each song before anything is shuffled. A larger lexicon is joined by a shuffle.
    """
    rows = songs.select(*keys, F.coalesce(F.size(tokens), F.lit(0)).cast("long").alias("total_tokens"), F.posexplode_outer(tokens).alias("pos", "token"))
    lexicon = words.select(F.col("word").alias("__word"), "groups")
    met = rows.join(lexicon, strip(F.col("token")) == F.col("__word"), "left")
    matched = F.col("groups").isNotNull()
    per = met.groupBy(*keys, "total_tokens").agg(
        F.count_if(matched).alias("emotion_word_count"),
        F.array_sort(F.collect_list(F.when(matched, F.struct("pos", "token")))).alias("__words"),
        *(F.count_if(matched & F.array_contains("groups", g)).alias(f"count_{g}") for g in groups),
    )
    total = F.greatest("total_tokens", F.lit(0))

    def ratio(count: Column) -> Column:
        share = F.when(total > 0, count / total * 100).otherwise(F.lit(0.0))
        return share if digits is None else F.bround(share, digits)

    total_tokens = total.alias("total_tokens")
    wide = [c for g in groups for c in (F.col(f"count_{g}"), ratio(F.col(f"count_{g}")).alias(f"ratio_{g}"))]
    return per.select(*keys, total_tokens, "emotion_word_count", ratio(F.col("emotion_word_count")).alias("emotion_word_ratio"), join_words(F.transform("__words", lambda x: x["token"])).alias("emotion_words"), *wide)


def with_scores(stats: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds emotion_score (the weighted counts), normalized_emotion_score (per emotion word; 0 without one) and
    emotion_score_detail (the counts above 0 of groups that have a weight)."""
    weights = WEIGHTS if weights is None else weights
    used = [g for g in sorted(weights) if f"count_{g}" in stats.columns]
    total = sum((F.col(f"count_{g}") * F.lit(float(weights[g])) for g in used), F.lit(0.0))
    detail = F.map_filter(F.create_map(*(x for g in used for x in (F.lit(g), F.col(f"count_{g}")))), lambda k, v: v > 0) if used else F.create_map().cast("map<string,bigint>")
    return stats.withColumn("emotion_score", total).withColumns(
        {"normalized_emotion_score": F.when(F.col("emotion_word_count") > 0, F.col("emotion_score") / F.col("emotion_word_count")).otherwise(F.lit(0.0)), "emotion_score_detail": detail}
    )


def score(songs: DataFrame, words: DataFrame, groups: list[str] = GROUPS, weights: dict[str, float] | None = None, **more) -> DataFrame:
    return with_scores(song_stats(songs, words, groups, **more), weights)


def matched_words(tokens: Column, lexicon: list[str]) -> Column:
    """The tokens that a small lexicon has, in order, repeats included: an expression without a join, for streams too."""
    return F.filter(tokens, lambda t: strip(t).isin(lexicon))


def sentiment(score_column: str = "emotion_score") -> Column:
    """positive, negative or neutral by the score's sign."""
    c = F.col(score_column)
    return F.when(c > 0, "positive").when(c < 0, "negative").when(c == 0, "neutral")
