"""Toxicity: bags of subword embeddings, averaged, into a linear softmax; both trained jointly in numpy.

A word's vector is the mean of the vectors of its bytes' n-grams (3 to 5, with marks at its ends) and of itself, all
hashed into one table; a text's vector is the mean of its words'. So a misspelling never seen shares most of its n-grams'
vectors. Training takes a bounded sample of labelled texts (`max_train` texts and `max_bytes` of text for each label, in
expectation, by a hash of doc_id); its cost doesn't grow with the corpus. The trained model is linear in the n-grams, so scoring needs one number for each.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrays import ALNUM, Words, mix, power, slices, words
from ._shared import checkpointed

BUCKETS, SIZE, LONGEST, SHORTEST = 1 << 18, 8, 5, 3
MAX_TRAIN, MAX_BYTES = 4000, 16 << 20
EPOCHS, BATCH, RATE = 12, 256, 3.0
#: Times the median sum of squared gradients is added to each, so that rare subwords learn slowly.
FLOOR = 1000

_TABLE = ALNUM.copy()
_TABLE[[ord(c) for c in "@$*'"]] = True


def _distinct(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First place of each different word, and the number of each word among them."""
    _, first, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
    return first, inverse


def _subwords(w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table places of all subwords of the given words, in order, and the words' offsets in them."""
    sizes = w.ends[which] - w.starts[which]
    marked = sizes + 2
    ends = np.cumsum(marked)
    starts = ends - marked
    data = np.empty(int(marked.sum()), np.uint64)
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    data[np.repeat(starts + 1, sizes) + inner] = w.data[np.repeat(w.starts[which], sizes) + inner]
    data[starts], data[ends - 1] = 1, 2
    p, back = power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * p[: len(data)], out=total[1:])
    owner, place = [], []
    at = np.arange(len(data))
    word = np.repeat(np.arange(len(which)), marked)
    left = ends[word] - at
    for n in range(SHORTEST, LONGEST + 1):
        i = np.flatnonzero(left >= n)
        place.append(mix((total[i + n] - total[i]) * back[i] + np.uint64(n)))
        owner.append(word[i])
    place.append(mix((total[ends] - total[starts]) * back[starts] + np.uint64(99)))
    owner.append(np.arange(len(which)))
    place, owner = np.concatenate(place) % np.uint64(BUCKETS), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return place[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(which) + 1))


def _rows(index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(index, kind="stable")
    ordered = index[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return order.astype(np.int32), ordered[first].astype(np.int32), first.astype(np.int32)


class Batch:
    """Texts as index arrays: subwords of the different words, and the words of each text with their shares of it."""

    def __init__(self, texts: list[str | None], labels: np.ndarray, weights: np.ndarray):
        w = words(pa.array(texts, pa.string()), _TABLE)
        self.empty = not len(w.starts)
        if self.empty:
            return
        self.labels, self.weights = labels, (weights / weights.sum()).astype(np.float32)
        first, inverse = _distinct(w)
        place, ends = _subwords(w, first)
        self.place, self.starts, self.size = place.astype(np.int32), ends[:-1], np.diff(ends).astype(np.float32)
        # one entry for each different word of a text, in order of texts
        cell, times = np.unique(w.owners() * len(first) + inverse, return_counts=True)
        self.doc, self.word = (cell // len(first)).astype(np.int32), (cell % len(first)).astype(np.int32)
        self.share = (times / w.counts[self.doc]).astype(np.float32)
        self.by_word, self.by_place = _rows(self.word), _rows(self.place)

    def gradients(self, table: np.ndarray, soft: np.ndarray, bias: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The weighted mean of the texts' log losses; the rows of the table that have a gradient, and the gradients of these
        rows, of the softmax and of its bias."""
        vec = np.add.reduceat(table[self.place], self.starts, axis=0) / self.size[:, None]
        present, dfirst = np.unique(self.doc, return_index=True)
        mean = np.zeros((len(self.labels), table.shape[1]), table.dtype)
        mean[present] = np.add.reduceat(vec[self.word] * self.share[:, None], dfirst, axis=0)
        z = mean @ soft + bias
        z = z - z.max(axis=1, keepdims=True)
        e = np.exp(z)
        g = e / e.sum(axis=1, keepdims=True)
        at = np.arange(len(self.labels)), self.labels
        loss = -float((self.weights * (z[at] - np.log(e.sum(axis=1)))).sum())
        g[at] -= 1
        g = (g * self.weights[:, None]).astype(table.dtype)
        order, ids, firsts = self.by_word
        gword = np.zeros_like(vec)
        gword[ids] = np.add.reduceat(((g @ soft.T)[self.doc] * self.share[:, None])[order], firsts, axis=0)
        gword /= self.size[:, None]
        order, ids, firsts = self.by_place
        return loss, ids, np.add.reduceat(np.repeat(gword, self.size.astype(np.int64), axis=0)[order], firsts, axis=0), mean.T @ g, g.sum(axis=0)


def fit(texts: list[str | None], labels: np.ndarray, weights: np.ndarray, seed: int = 3) -> tuple[np.ndarray, float]:
    """A number for each subword and a bias: the logit of label 1 is the mean over the words of the means of their
    subwords' numbers, plus the bias."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 1e-3, (BUCKETS, SIZE)).astype(np.float32)
    soft = rng.normal(0, 0.5, (SIZE, 2)).astype(np.float32)
    bias = np.log(np.maximum([weights[labels == k].sum() / weights.sum() for k in (0, 1)], 1e-6)).astype(np.float32)
    past = [np.full(BUCKETS, 1e-12, np.float32), np.full((SIZE, 2), 1e-12, np.float32), np.full(2, 1e-12, np.float32)]
    shuffled = rng.permutation(len(texts))
    cuts = (shuffled[at : at + BATCH] for at in range(0, len(texts), BATCH))
    batches = [b for b in (Batch([texts[i] for i in mine], labels[mine], weights[mine]) for mine in cuts) if not b.empty]
    for _ in range(EPOCHS):
        for k in rng.permutation(len(batches)):
            _, rows, gtable, gsoft, gbias = batches[k].gradients(table, soft, bias)
            past[0][rows] += (gtable * gtable).mean(axis=1)
            table[rows] -= (RATE / np.sqrt(past[0][rows] + FLOOR * np.median(past[0][rows])))[:, None] * gtable
            for old, target, grad in ((past[1], soft, gsoft), (past[2], bias, gbias)):
                old += grad * grad
                target -= RATE / np.sqrt(old) * grad
    return table @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, seed: int = 3, max_bytes: int = MAX_BYTES) -> tuple[np.ndarray, float]:
    """fit() on labelled texts: labels(doc_id, toxic) where toxic is 0 or 1. Of each label about max_train rows and max_bytes
    of text at most take part, whole texts, and weights restore the labels' shares. Null texts count as empty; a document with
    both labels has both. One label alone, or no labelled text, gives a constant score."""
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").distinct()
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")).join(labels, "doc_id")
    found = {r.toxic: r for r in sized.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()}
    shares = {k: min(1.0, max_train / r.n, max_bytes / max(1, r.bytes)) for k, r in found.items()}
    share = F.lit(0.0)
    for k, x in shares.items():
        share = F.when(F.col("toxic") == k, F.lit(x)).otherwise(share)
    chosen = checkpointed(labels.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30)).where(F.col("toxic").isin(list(found) or [0])))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * max_train rows, about
    weight = {k: max(1.0, 1 / x) for k, x in shares.items()}

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True), key=lambda r: (r[0], r[2], r[1] or ""))
        y = np.array([r[2] for r in rows], np.int64)
        numbers, bias = fit([r[1] for r in rows], y, np.array([weight[int(k)] for k in y]), seed)
        return pa.table({"numbers": pa.array([numbers.astype(np.float32).tobytes()], pa.binary()), "bias": [bias]})

    got = sample.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(run, "numbers binary, bias double").collect()
    if not got:
        return np.zeros(BUCKETS, np.float32), -20.0
    return np.frombuffer(got[0].numbers, np.float32), got[0].bias


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """All rows and columns of docs(text, ...) with score (0 to 1: probability of label 1) and predicted.

    Null and empty texts, and texts without a word, have the score of the bias alone. Whole texts are scored. Columns
    score and predicted of docs are replaced; an empty table gives no rows.
    """
    docs = docs.drop("score", "predicted").select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, bias = sent.value
        for batch in slices(batches, size=1 << 21):
            w = words(batch.column(batch.schema.get_field_index("text")), _TABLE)
            logit = np.full(batch.num_rows, bias)
            if len(w.starts):
                first, inverse = _distinct(w)
                place, ends = _subwords(w, first)
                each = np.add.reduceat(numbers[place], ends[:-1]) / np.diff(ends)
                counts = w.counts
                full = counts > 0
                logit[full] += np.add.reduceat(each[inverse].astype(float), w.offsets[:-1][full]) / counts[full]
            p = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            cols = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
