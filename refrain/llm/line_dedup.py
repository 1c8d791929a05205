"""Line deduplication with a suffix array over line numbers, built by distributed prefix doubling.

Documents are sequences of their non-blank lines; only lines that occur twice or more can be in a repeated run, so
all others cut the sequences into segments and leave, as do segments of fewer than `min_words` words. Each round of doubling
ranks the pairs (rank of a suffix's first h lines, rank of its next h) by a range sort of the distinct pairs, and gives
every suffix the rank of its first 2h lines. Suffixes with the same final rank are one entry of the suffix array, with the
earliest place as its first. A pass down and a pass up the array, with a stack of the longest-common-prefix intervals that
are open (as many as a prefix has lines at most), give each entry its longest prefix that also starts at an earlier place.
The array is dealt by the shortest prefix of min_words words, as no interval that counts reaches beyond it.

A line is deleted if it lies in a run of lines of at least `min_words` words that also occurs starting at an earlier
place, in order of doc_id and line. Each line has a word at least, so prefixes of min_words lines decide that: the
doubling ends after log2(min_words) rounds, whatever the lengths of texts, and sooner if a round splits nothing.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._arrays import freed
from ._shared import done, stored

_NULL_ID = -(1 << 63)
#: Deleted lines, of 20 bytes each, up to which they are sent to all tasks; beyond that texts are shuffled to theirs.
BROADCAST_LINES = 1 << 20
_KEY = ["k1", "k2"]
_BLANK = r"^[\x20\x09-\x0D]*$"
_WORD = r"[^\x20\x09-\x0D]+"


def _full_lines() -> Column:
    return F.filter(F.split("text", "\n", -1), lambda x: ~x.rlike(_BLANK))


def _lines(docs: DataFrame) -> DataFrame:
    full = _full_lines()
    lines = docs.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("k1"), F.xxhash64("text").alias("k2"), F.posexplode(full).alias("idx", "line"))
    return lines.select(*_KEY, "idx", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(17), "line").alias("h2"), F.regexp_count("line", F.lit(_WORD)).alias("words"))


def _ranked(pairs: DataFrame, *by: str) -> DataFrame:
    """Distinct rows with a number that rises with them: a range sort, and the place in it. Stored, as a second run of the
    sort might draw other ranges."""
    return stored(pairs.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _longest_earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For entries in order of the suffix array, or the reverse: the longest prefix shared with an entry that came before
    in that order and has an earlier first place."""
    before, stack = np.empty(0, np.int64), []
    for batch in batches:
        k1, k2, idx = (batch.column(i).to_pylist() for i in range(3))
        rows = batch.column(3)
        out = []
        for place, lines in zip(zip(k1, k2, idx, strict=True), rows, strict=True):
            mine = lines.values.to_numpy(zero_copy_only=False)
            n = min(len(mine), len(before))
            apart = np.flatnonzero(mine[:n] != before[:n])
            common = int(apart[0]) if len(apart) else n
            least = None
            while stack and stack[-1][0] >= common:
                size, first = stack.pop()
                least = first if least is None else min(least, first)
            if common and least is not None:
                stack.append((common, least))
            out.append(max((size for size, first in stack if first < place), default=0))
            stack.append((len(mine), place))
            before = mine
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(out, pa.int32())], names=["k1", "k2", "idx", "run"])


def _deleted(docs: DataFrame, min_words: int) -> DataFrame:
    """(k1, k2, idx) of the lines to delete; idx counts a text's non-blank lines."""
    lines = _lines(docs.select("doc_id", "text"))
    several = _ranked(lines.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"), "h1", "h2")
    found = lines.join(several, ["h1", "h2"]).dropDuplicates([*_KEY, "idx"])
    doc = Window.partitionBy(*_KEY).orderBy("idx")
    found = found.withColumn("segment", F.col("idx") - F.row_number().over(doc))
    own = [*_KEY, "segment"]
    order = Window.partitionBy(*own).orderBy("idx")
    size = 1 << max(0, (min_words - 1).bit_length())  # lines of a prefix, min_words at least
    ahead = order.rowsBetween(0, size - 1)
    base = found.withColumn("long", F.sum("words").over(Window.partitionBy(*own)) >= min_words).where("long")
    base = stored(base.select(*own, "idx", "words", F.col("rank").alias("line"), "rank"), "lines")
    done(several)
    now, h, classes = base.select(*own, "idx", "rank"), 1, base.select("rank").distinct().count()
    while h < size and classes:
        pairs = now.withColumn("next", F.coalesce(F.lead("rank", h).over(order), F.lit(-1))).withColumnRenamed("rank", "a")
        ranks = _ranked(pairs.select("a", "next").distinct(), "a", "next")
        count = ranks.count()
        if count == classes:
            done(ranks)
            break
        classes, h = count, 2 * h
        last, now = now, stored(pairs.join(ranks, ["a", "next"]).select(*own, "idx", "rank"), "ranked")
        done(last, ranks)
    prefixes = base.withColumns({"lines": F.collect_list("line").over(ahead), "counts": F.collect_list("words").over(ahead), "total": F.sum("words").over(ahead)})
    prefixes = prefixes.where(F.col("total") >= min_words).drop("total")
    suffixes = stored(prefixes.join(now.withColumnRenamed("rank", "suffix"), [*own, "idx"]).select(*own, "idx", "lines", "counts", "suffix"), "suffixes")
    done(now)
    # the earliest place of each suffix is looked up by place: a frequent suffix is spread as its places are
    first = suffixes.groupBy("suffix").agg(F.min(F.struct(*_KEY, "idx")).alias("first")).select("first.*", F.lit(True).alias("own"))
    entries = stored(suffixes.join(first, [*_KEY, "idx"], "left"), "entries")
    done(suffixes)
    least = F.aggregate("counts", F.struct(F.lit(0).alias("total"), F.lit(0).alias("n")), lambda a, x: F.when(a["total"] < min_words, F.struct((a["total"] + x).alias("total"), (a["n"] + 1).alias("n"))).otherwise(a))["n"]
    array = entries.where("own").select(*_KEY, "idx", "lines", "suffix", F.xxhash64(F.slice("lines", F.lit(1), least)).alias("start"))
    runs = []
    for down in (True, False):
        rank = F.col("suffix").asc() if down else F.col("suffix").desc()
        runs.append(array.repartition("start").sortWithinPartitions("start", rank).select(*_KEY, "idx", "lines").mapInArrow(_longest_earlier, "k1 bigint, k2 bigint, idx int, run int"))
    longest = runs[0].union(runs[1]).groupBy(*_KEY, "idx").agg(F.max("run").alias("run"))
    met = entries.join(longest, [*_KEY, "idx"], "left")
    run = F.when(F.col("own"), F.coalesce("run", F.lit(0))).otherwise(F.size("lines"))
    met = met.withColumn("run", run).where("run > 0")
    words = F.aggregate(F.slice("counts", F.lit(1), F.col("run")), F.lit(0), lambda a, x: a + x)
    ends = met.where(words >= min_words).select(*_KEY, "idx", (F.col("idx") + F.col("run")).alias("end"))
    covered = base.select(*own, "idx").join(ends, [*_KEY, "idx"], "left").withColumn("end", F.max("end").over(order))
    out = stored(covered.where("idx < end").select(*_KEY, "idx"), "deleted")
    done(base, entries)
    return out


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes the lines numbered in __gone out of the texts that have any; other rows pass as they are."""
    blank = set("\x20\t\n\x0b\x0c\r")
    for batch in batches:
        names = batch.schema.names
        column, gone = batch.column(names.index("text")), batch.column(names.index("__gone"))
        mask = gone.is_valid()
        mine = gone.filter(mask).to_pylist()
        texts = []
        for text, own in zip(column.filter(mask).to_pylist(), map(set, mine), strict=True):
            kept, idx, drop = [], -1, False
            for x in text.split("\n"):
                if not blank.issuperset(x):
                    idx += 1
                    drop = idx in own
                if not drop:  # a blank line goes with the line before it
                    kept.append(x)
            texts.append("\n".join(kept))
        cols = dict(zip(names, batch.columns, strict=True))
        if mine:
            cols["text"] = pc.replace_with_mask(column, mask, pa.array(texts, column.type))
        del cols["__gone"]
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """All rows and columns of docs(doc_id, text, ...), text without the later copies of repeated runs of lines, and n_lines,
    n_deleted: the text's non-blank lines, and those deleted. Texts without a deletion are as they were.

    Lines are equal if their bytes are; blank lines are in no run and go with a deleted line before them. Null and empty
    texts have no lines and stay. Null doc_ids come first in the order. Rows equal in doc_id and text count as one
    document, in which nothing is a copy of itself; rows with one doc_id and different texts are ordered by a hash.
    Columns n_lines and n_deleted of docs are replaced; an empty table gives no rows.
    """
    if min_words < 1:
        raise ValueError("min_words must be positive")
    docs = docs.drop("n_lines", "n_deleted")
    lines = _deleted(docs, min_words)
    gone = lines.groupBy(*_KEY).agg(F.collect_list("idx").alias("__gone"))  # one document's lines
    gone = gone.withColumnsRenamed({"k1": "__k1", "k2": "__k2"})
    if lines.count() <= BROADCAST_LINES:
        gone = F.broadcast(gone)
    met = docs.withColumns({"__a": F.coalesce("doc_id", F.lit(_NULL_ID)), "__b": F.xxhash64("text")})
    met = met.join(gone, (F.col("__a") == F.col("__k1")) & (F.col("__b") == F.col("__k2")), "left").drop("__a", "__b", "__k1", "__k2")
    met = met.withColumns({"n_lines": F.greatest(F.size(_full_lines()), F.lit(0)).cast("long"), "n_deleted": F.greatest(F.size("__gone"), F.lit(0)).cast("long")})
    return met.mapInArrow(freed(_rebuild), met.drop("__gone").schema)
