"""The emotion lexicon: words, their emotions, and the groups of these."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.resources import GROUP_OF


def associated(lexicon: DataFrame) -> DataFrame:
    return lexicon.where("association = 1")


def with_group(lexicon: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """The group of each row's emotion; null for an emotion that no group has."""
    mapping = GROUP_OF if mapping is None else mapping
    group = F.lit(None).cast("string")
    for emotion, name in mapping.items():
        group = F.when(F.col("emotion") == emotion, F.lit(name)).otherwise(group)
    return lexicon.withColumn("group", group)


def word_groups(lexicon: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """(word, groups): the different groups of each associated word, sorted; words without a group are left out."""
    rows = with_group(associated(lexicon), mapping).where("word is not null and group is not null")
    return rows.groupBy("word").agg(F.array_sort(F.collect_set("group")).alias("groups"))


def emotion_counts(lexicon: DataFrame) -> DataFrame:
    """(emotion, n) of associated rows, the most frequent first."""
    return associated(lexicon).groupBy("emotion").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "emotion")


def group_counts(lexicon: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """(group, n) of associated rows: pairs of word and emotion, not different words."""
    rows = with_group(associated(lexicon), mapping).where("group is not null")
    return rows.groupBy("group").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group")


def group_names(words: DataFrame) -> list[str]:
    """All groups of word_groups(), sorted: they name the columns of a score, so the driver needs them."""
    return [r.group for r in words.select(F.explode("groups").alias("group")).distinct().orderBy("group").collect()]
