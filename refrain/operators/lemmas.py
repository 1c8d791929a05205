"""Lemmas of nouns by suffix rules and a caller's dictionary."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Suffixes of plural nouns and what stands in their place, as published for the WordNet lexicon.
NOUN_SUFFIXES = {"s": "", "ses": "s", "ves": "f", "xes": "x", "zes": "z", "ches": "ch", "shes": "sh", "men": "man", "ies": "y"}


def lemma_table(words: DataFrame, dictionary: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(word, lemma) of those words(word) whose lemma is another word. Candidates are the word itself and, if exceptions(word,
    lemma) has it, its lemmas there, else the word with each suffix replaced; of those in dictionary(word) the shortest
    wins, then the first in the alphabet. A word without such candidates is its own lemma. Nulls are left out."""
    words = words.select("word").where("word is not null").distinct()
    known = dictionary.select(F.col("word").alias("lemma")).where("lemma is not null").distinct()
    exceptions = exceptions.select("word", "lemma") if exceptions is not None else words.limit(0).select("word", F.col("word").alias("lemma"))
    irregular = words.join(exceptions, "word")
    forms = F.array(*(F.when(F.endswith("word", F.lit(s)), F.concat(F.expr(f"left(word, length(word) - {len(s)})"), F.lit(to))) for s, to in NOUN_SUFFIXES.items()))
    regular = words.join(exceptions.select("word"), "word", "left_anti").select("word", F.explode(forms).alias("lemma")).where("lemma is not null")
    candidates = words.select("word", F.col("word").alias("lemma")).union(irregular.select("word", "lemma")).union(regular)
    best = candidates.join(known, "lemma").groupBy("word").agg(F.min(F.struct(F.length("lemma").alias("n"), "lemma")).alias("best"))
    return best.select("word", F.col("best.lemma").alias("lemma")).where("word <> lemma")


def lemmatize(songs: DataFrame, dictionary: DataFrame, exceptions: DataFrame | None = None, tokens: str = "lyrics_tokens", key: str = "row_id") -> DataFrame:
    """songs with each token's lemma. Only words whose lemma differs are looked up, so at most as many as the dictionary has;
    key must be unique. songs is read twice: give a stored stage."""
    each = songs.select(key, F.posexplode(tokens).alias("pos", "word"))
    table = lemma_table(each.select("word"), dictionary, exceptions)
    named = each.join(table, "word", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("lemma", "word").alias("w")))).alias("__words"))
    out = songs.join(named, key, "left")
    return out.withColumn(tokens, F.when(F.col(tokens).isNotNull(), F.coalesce(F.transform("__words", lambda x: x["w"]), F.array().cast("array<string>")))).drop("__words")
