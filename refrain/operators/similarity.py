"""Songs as TF-IDF vectors of their tokens: similarity to one song, and clusters."""

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vectors(songs: DataFrame, tokens: str = "lyrics_tokens", features: int = 1 << 16) -> DataFrame:
    """Adds `vector`: hashed token counts times inverse document frequencies, of length 1. The hash needs no vocabulary.
    songs is read for the frequencies and again with the result: give a stored stage."""
    counted = HashingTF(numFeatures=features, inputCol=tokens, outputCol="__tf").transform(songs)
    weighted = IDF(inputCol="__tf", outputCol="__idf").fit(counted).transform(counted)
    return Normalizer(inputCol="__idf", outputCol="vector").transform(weighted).drop("__tf", "__idf")


def weights(songs: DataFrame, tokens: str = "lyrics_tokens") -> DataFrame:
    """(row_id, token, weight): each song's token counts times log((songs + 1) / (songs with the token + 1))."""
    counts = songs.select("row_id", F.explode(tokens).alias("token")).groupBy("row_id", "token").agg(F.count("*").alias("tf"))
    spread = counts.groupBy("token").agg(F.count("*").alias("df"))
    total = F.broadcast(songs.agg(F.count("*").alias("songs")))  # one row
    weight = F.col("tf") * F.log((F.col("songs") + 1) / (F.col("df") + 1))
    return counts.join(spread, "token").crossJoin(total).select("row_id", "token", weight.alias("weight"))


def similar(songs: DataFrame, row_id: int, n: int = 10, tokens: str = "lyrics_tokens") -> DataFrame:
    """(row_id, title, cosine) of the n songs closest to one song by the cosine of their TF-IDF weights; 0 with a song that
    has none. No rows if there is no such song. Ties by row_id. songs is read several times: give a stored stage."""
    w = weights(songs, tokens)
    one = w.where(F.col("row_id") == row_id).select("token", F.col("weight").alias("own"))
    length = F.broadcast(one.agg(F.sqrt(F.sum(F.col("own") * F.col("own"))).alias("length")))  # one row
    met = w.where(F.col("row_id") != row_id).join(one, "token", "left")  # one song's tokens: Spark's statistics broadcast them
    sums = met.groupBy("row_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), F.coalesce(F.sum(F.col("weight") * F.col("own")), F.lit(0.0)).alias("dot"))
    cosine = F.coalesce(F.try_divide(F.col("dot"), F.col("norm") * F.col("length")), F.lit(0.0))
    found = songs.where(F.col("row_id") != row_id).select("row_id", "title").join(sums, "row_id", "left").crossJoin(length)
    there = songs.where(F.col("row_id") == row_id).limit(1).select(F.lit(1).alias("__one"))
    return found.crossJoin(F.broadcast(there)).select("row_id", "title", cosine.alias("cosine")).orderBy(F.desc("cosine"), "row_id").limit(n)


def clusters(songs: DataFrame, k: int = 4, seed: int = 42, features: int = 1 << 10, **more) -> DataFrame:
    """Adds `cluster`, of k-means over the vectors. songs is read several times: give a stored stage. The first centres are drawn
    from each partition, so clusters depend on how the rows are dealt."""
    v = vectors(songs, features=features, **more)
    return KMeans(k=k, seed=seed, featuresCol="vector", predictionCol="cluster").fit(v).transform(v).drop("vector")
