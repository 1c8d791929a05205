"""Exact document fingerprints: a canonical form, a wide hash, and a comparison of bytes inside equal buckets.

DataFrame and SQL functions only. The canonical form is NFKC, full case folding, white space runs as one space and none
at the ends; normalisation and folding are ICU's, called by Spark's built-in `reflect` function. Two xxhash64 of
different seeds make a 128-bit bucket. Documents of one bucket whose canonical bytes differ get different ordinals, so
fingerprints are equal exactly where canonical texts are.
"""

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import checkpointed, partitions, range_bucket, stored

#: Buckets, of 32 bytes each, up to which they are sent to all tasks.
BROADCAST_BUCKETS = 1 << 18
#: Parts of a bucket beyond that.
_SEATS = 16


def canonical(text: Column) -> Column:
    """Null counts as empty. ASCII texts skip the calls to ICU, which would not change them."""
    text = F.coalesce(text, F.lit(""))
    folded = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True)), F.lit(True))
    # folding may leave a form that composes once more
    again = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    plain = F.octet_length(text) == F.length(text)
    return F.trim(F.regexp_replace(F.when(plain, F.lower(text)).otherwise(again), r"[\s\x0B\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+", " "))


def wide_hash(canon: Column) -> Column:
    """32 hexadecimal digits. The second hash takes another seed by a leading number."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(0x5851F42D), canon)), 16, "0")))


def _keyed(docs: DataFrame, hashed=wide_hash) -> DataFrame:
    """docs with canon and bucket. Spark never copies an expression with `reflect` into two places, so as a column of its own
    the canonical form is computed once."""
    return docs.withColumn("canon", canonical(F.col("text"))).withColumn("bucket", hashed(F.col("canon")))


def _ordinals(base: DataFrame) -> DataFrame:
    """(bucket, canon, ordinal) of the buckets of base(text, bucket) in which canonical texts differ. With 128 bits there are
    none to be expected. Only the texts of buckets with several documents are looked at, where they lie, or in _SEATS
    parts of a bucket if there are many such buckets; of those only their least and greatest bytes leave a task."""
    several = stored(base.groupBy("bucket").count().where("count > 1").select("bucket"), "buckets")
    if several.count() <= BROADCAST_BUCKETS:
        met = base.join(F.broadcast(several), "bucket", "left_semi")
    else:
        seats = several.withColumn("seat", F.explode(F.sequence(F.lit(0), F.lit(_SEATS - 1))))
        met = base.withColumn("seat", F.pmod(F.monotonically_increasing_id(), F.lit(_SEATS)).cast("int")).join(seats, ["bucket", "seat"], "left_semi")
    met = met.select("bucket", canonical(F.col("text")).alias("canon"))
    differing = checkpointed(met.groupBy("bucket").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).where("a <> b").select("bucket"))
    texts = met.join(differing, "bucket", "left_semi").distinct()
    return checkpointed(texts.withColumn("ordinal", F.row_number().over(Window.partitionBy("bucket").orderBy("canon")) - 1))


def _told_apart(rows: DataFrame, split: DataFrame, bucket: str, canon: str) -> DataFrame:
    """Adds `-ordinal` to the column `bucket` of rows in the buckets of split, by the column `canon`."""
    split = split.select(F.col("bucket").alias(bucket), F.col("canon").alias(canon), F.concat(F.lit("-"), F.col("ordinal").cast("string")).alias("__more"))
    return rows.join(split, [bucket, canon], "left").withColumn(bucket, F.concat(bucket, F.coalesce("__more", F.lit("")))).drop("__more")


def fingerprints(docs: DataFrame, hashed=wide_hash) -> DataFrame:
    """All rows and columns of docs(text, ...) with `fingerprint`: the bucket's digits, and `-ordinal` in a bucket with
    several canonical texts.

    Null counts as empty; empty texts and texts of white space have one fingerprint. Texts of any length are hashed
    whole. A column fingerprint of docs is replaced; an empty table gives no rows.
    """
    docs = docs.drop("fingerprint")
    split = _ordinals(stored(_keyed(docs.select("text"), hashed).drop("canon"), "fingerprinted"))
    named = docs.withColumn("__canon", canonical(F.col("text"))).withColumn("fingerprint", hashed(F.col("__canon")))
    return (named if split.isEmpty() else _told_apart(named, split, "fingerprint", "__canon")).drop("__canon")


def _labels(spark: SparkSession, n: int) -> list[int]:
    """n different numbers that a shuffle deals evenly over the session's partitions."""
    pieces = partitions(spark)
    ids = spark.range(0, (16 + n // pieces) * 2 * pieces).select(F.col("id").cast("int").alias("i"))
    rows = ids.groupBy(F.pmod(F.hash("i"), F.lit(pieces)).alias("p")).agg(F.slice(F.sort_array(F.collect_list("i")), 1, 1 + n // pieces).alias("own")).collect()
    first = [r.own[k] for k in range(1 + n // pieces) for r in sorted(rows, key=lambda r: r.p) if k < len(r.own)][:n]
    spare = iter(range(-1, -n - 1, -1))  # where none of the numbers tried fell to a partition
    return first + [next(spare) for _ in range(n - len(first))]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of docs(doc_id, text, ...) with next_ and the name of each column but doc_id: those of the next document by descending
    doc_id; after the last row: the first. Null texts count as empty. Rows of one doc_id follow each other by ascending text;
    null doc_ids stand at the end, by a hash of the text, then the text. An empty table gives no rows.

    Texts are shuffled once: ranges, as many as the session's shuffle partitions, each with as many partitions to itself,
    are ordered each by itself; the first rows of each range also go to the end of the range before. Null doc_ids are
    dealt by ranges of the hash. The rows of one other doc_id lie in one range.
    """
    spark, more = docs.sparkSession, [c for c in docs.columns if c != "doc_id"]
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    pieces = partitions(spark)
    sizes = docs.agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    slices = max(1, min(pieces, -(-sizes.nulls * pieces // max(1, sizes.n))))
    null = F.col("doc_id").isNull()
    place = F.least(F.floor((F.col("__h").cast("double") / 2.0**64 + 0.5) * slices), F.lit(slices - 1))
    placed = docs.withColumn("__h", F.when(null, F.xxhash64("text")))
    placed = placed.withColumn("__part", F.when(null, -1 - place).otherwise(range_bucket(docs, "doc_id", pieces)).cast("int"))
    tops = sorted(placed.groupBy("__part").agg(F.max("doc_id").alias("__top"), F.min("__h").alias("__top_h")).collect(), key=lambda r: -r["__part"])
    labels = _labels(spark, len(tops))
    ring = json.dumps([{"__part": r["__part"], "__top": r["__top"], "__top_h": r["__top_h"], "__label": labels[k], "__before": labels[k - 1]} for k, r in enumerate(tops)])
    kind = "array<struct<__part int, __top bigint, __top_h bigint, __label int, __before int>>"
    ring = F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(ring), kind))))  # a row for each range
    first = F.when(null, F.col("__h") == F.col("__top_h")).otherwise(F.col("doc_id") == F.col("__top"))
    own, again = F.struct(F.lit(False).alias("__again"), F.col("__label").alias("__in")), F.struct(F.lit(True).alias("__again"), F.col("__before").alias("__in"))
    dealt = placed.join(ring, "__part").select("doc_id", *more, "__h", F.explode(F.when(first, F.array(own, again)).otherwise(F.array(own))).alias("__seat")).select("doc_id", *more, "__h", "__seat.*")
    order = Window.partitionBy("__in").orderBy("__again", F.col("doc_id").desc_nulls_last(), "__h", "text")
    out = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in more}).where("not __again")
    return out.select("doc_id", *more, *(f"next_{c}" for c in more))


def compared(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of docs(doc_id, text,
    ...): fingerprints of its text and of its edited text, whose last half is replaced by as much of the next document's
    start (with_next() has the order), with likenesses of 1 or 0.

    Buckets are settled by bytes: for the documents as in fingerprints(), and for each pair that is compared here. Null
    counts as empty; a single row is its own next. Rows that repeat keep their rows; other columns are ignored; an empty
    table gives no rows.
    """
    base = stored(_keyed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).drop("canon"), "fingerprinted")
    split = _ordinals(base)
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("left(next_text, cast(floor(length(text) / 2) as int))"))
    rows = with_next(base).withColumn("edited", edited).withColumn("edited_canon", canonical(F.col("edited"))).withColumn("edited_bucket", wide_hash(F.col("edited_canon")))
    same = lambda bucket, canon: F.when(F.col("bucket") == F.col(bucket), (canonical(F.col("text")) == canon).cast("double")).otherwise(F.lit(0.0))
    out = rows.withColumns({"near_edited": same("edited_bucket", F.col("edited_canon")), "near_next": same("next_bucket", canonical(F.col("next_text"))), "n_chars": F.length("text").cast("bigint"), "edited_sha256": F.sha2("edited", 256)})
    if not split.isEmpty():
        out = _told_apart(out.withColumn("canon", canonical(F.col("text"))), split, "bucket", "canon")
        out = _told_apart(out, split, "edited_bucket", "edited_canon")
    return out.select("doc_id", "n_chars", "edited_sha256", F.col("bucket").alias("fingerprint"), F.col("edited_bucket").alias("edited_fingerprint"), "near_edited", "near_next")
