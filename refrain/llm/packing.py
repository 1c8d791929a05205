"""Packing into optimal length buckets.

The global histogram of piece lengths (at most max_tokens numbers) goes to the driver; dynamic programming over it
chooses the bucket boundaries with the least padding. The queries count tokens exactly, with token_counts. Inside each bucket, in order of (doc_id, piece), batches of as
many pieces as the token budget holds are formed. Ranks are exact without one task for a bucket: documents are cut into
ranges of doc_id, ranked inside (bucket, range), and shifted by the counts of the ranges before.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import partitions, range_bucket, stored


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """At most `buckets` rising boundaries, the last the greatest length, with the least sum of (boundary - length)
    over all pieces. Of equal sums, the one whose last cuts come earliest."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n), np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(k)] for k in lengths], np.int64)
    n = np.append(0, np.cumsum(counts))  # pieces
    t = np.append(0, np.cumsum(counts * lengths))  # tokens
    m = len(lengths)
    cost = np.append(0, lengths * n[1:] - t[1:])  # one bucket for the first j lengths
    cuts = []
    for _ in range(1, min(buckets, m)):
        new, cut = cost.copy(), np.zeros(m + 1, np.int64)
        for j in range(1, m + 1):
            # lengths i..j-1 form the last bucket
            total = cost[:j] + lengths[j - 1] * (n[j] - n[:j]) - (t[j] - t[:j])
            cut[j] = i = int(np.argmin(total))
            new[j] = total[i]
        cost = new
        cuts.append(cut)
    out, j = [], m
    for cut in [*reversed(cuts), np.zeros(m + 1, np.int64)]:
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
    return out[::-1]


def padding(histogram: dict[int, int], bounds: list[int]) -> int:
    return sum(n * (min(b for b in bounds if b >= k) - k) for k, n in histogram.items())


def word_count(text: str = "text") -> Column:
    """Words split at the six ASCII spaces; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pack(docs: DataFrame, length: Column | None = None, max_tokens: int = 4096, buckets: int = 12, budget: int = 65_536) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, bucket, batch, slot): every token of every row of docs(doc_id, text, ...).

    `length` gives a row's tokens (default: its words); it is computed once for each row and stored. A row of more than max_tokens is cut into pieces of max_tokens
    and a rest. bucket is the padded length; batch counts from 0 inside a bucket; slot is the place in the batch, which
    holds budget // bucket pieces (one at least). Null and empty texts have no tokens and no piece. Rows that repeat a
    doc_id each have their pieces, ordered by length among themselves; a null doc_id comes first. Other columns are
    ignored; an empty table gives no rows.
    """
    if max_tokens < 1 or buckets < 1:
        raise ValueError("max_tokens and buckets must be positive")
    spark = docs.sparkSession
    sized = stored(docs.select("doc_id", (word_count() if length is None else length).cast("long").alias("total")), "lengths")
    piece = F.explode(F.when(F.col("total") > 0, F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / max_tokens)))).alias("piece")
    pieces = sized.select("doc_id", "total", piece).withColumn("n_tokens", F.least(F.lit(max_tokens).cast("long"), F.col("total") - F.col("piece") * max_tokens))
    found = pieces.groupBy("n_tokens").count().collect()  # max_tokens rows at most
    bounds = boundaries({r.n_tokens: r["count"] for r in found}, buckets)
    bucket = F.lit(None).cast("long")
    for b in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b)).otherwise(bucket)
    pieces = pieces.withColumn("bucket", bucket).withColumn("part", range_bucket(sized, "doc_id", partitions(spark)))
    counts = pieces.groupBy("bucket", "part").count()
    before = counts.select("bucket", "part", (F.sum("count").over(Window.partitionBy("bucket").orderBy("part")) - F.col("count")).alias("before"))
    # buckets x parts rows, both of them set by parameters and the session
    within = F.row_number().over(Window.partitionBy("bucket", "part").orderBy(F.col("doc_id").asc_nulls_first(), "total", "piece"))
    ranked = pieces.withColumn("within", within).join(F.broadcast(before), ["bucket", "part"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    room = F.greatest(F.floor(F.lit(budget) / F.col("bucket")), F.lit(1)).cast("long")
    return ranked.select("doc_id", F.col("piece").cast("long").alias("piece"), (F.col("piece") * max_tokens).cast("long").alias("first_token"), "n_tokens", "bucket", F.floor(F.col("rank") / room).cast("long").alias("batch"), (F.col("rank") % room).cast("long").alias("slot"))
