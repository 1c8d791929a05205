"""Benchmark decontamination over a stored positional inverted index that is distributed by documents.

index() stores the postings of all terms of all documents: a row is a shard of about a megabyte of text, with its sorted
terms and, for each, the sorted positions in the shard's joint token sequence. A benchmark window is matched in every
shard by intersecting its terms' posting lists, each shifted by the term's offset in the window, from the shard's
rarest term on: what is left are exact phrase matches. Proximity matches come from the same lists: all terms of a window
within a span. A shard holds whole documents, so no posting list is ever shuffled, a frequent term or passage is spread
as its documents are, and a lost executor's shards are read again by another.

The benchmark goes to the executors in blocks of at most BLOCK_TERMS window terms (their size is bounded by that), one
after the other: each block's matches are stored before the next is sent. Terms are compared by 64-bit hashes.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import ALNUM, freed, slices, word_counts, words
from ._shared import stored

#: Window terms of one block of the benchmark: 8 bytes each on the driver and in every worker.
BLOCK_TERMS = 4_000_000
#: Candidate places held at once in a shard.
_STEP = 1 << 20
#: Documents with matches, and matches, up to which these are sent to all tasks; beyond that texts are shuffled to theirs.
BROADCAST_DOCS, BROADCAST_HITS = 1 << 18, 1 << 22
_NULL_ID = -(1 << 63)


@dataclass
class Queries:
    """Windows of benchmark items, each stored once. lengths: terms in each; terms: term numbers, padded with -1."""

    vocabulary: np.ndarray  # sorted term hashes
    terms: np.ndarray
    lengths: np.ndarray
    owners: list[list[str]]  # items of each window


def windows(items: list[tuple[str | None, str | None]], width: int) -> Queries:
    """Windows of `width` consecutive words; an item of fewer words, but not none, is one window. Items without an id
    or without words have none; repeated items and windows count once."""
    items = [(i, t) for i, t in items if i is not None]
    w = words(pa.array([t for _, t in items], pa.string()), ALNUM)
    h = w.hashes()
    found: dict[bytes, set[str]] = {}
    for k, (item, _) in enumerate(items):
        mine = h[w.offsets[k] : w.offsets[k + 1]]
        for at in range(max(1, len(mine) - width + 1) if len(mine) else 0):
            found.setdefault(mine[at : at + width].tobytes(), set()).add(item)
    vocabulary = np.unique(h)
    terms = np.full((len(found), width), -1, np.int64)
    lengths = np.zeros(len(found), np.int64)
    for k, key in enumerate(found):
        mine = np.frombuffer(key, np.uint64)
        terms[k, : len(mine)] = np.searchsorted(vocabulary, mine)
        lengths[k] = len(mine)
    return Queries(vocabulary, terms, lengths, [sorted(x) for x in found.values()])


@dataclass
class Shard:
    """Positional index of some documents: the sorted positions of term i, a hash, are positions[bounds[i] : bounds[i + 1]]; those
    of document d, which has the ids k1[d] and k2[d], are offsets[d] to offsets[d + 1]."""

    k1: np.ndarray
    k2: np.ndarray
    offsets: np.ndarray
    terms: np.ndarray
    bounds: np.ndarray
    positions: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, k1: np.ndarray, k2: np.ndarray) -> "Shard":
        w = words(texts, ALNUM)
        h = w.hashes()
        order = np.argsort(h, kind="stable")
        ordered = h[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(h) else np.empty(0, np.int64)
        return cls(k1, k2, w.offsets.astype(np.int64), ordered[first], np.append(first, len(h)).astype(np.int64), order.astype(np.int32))

    def _lists(self, q: "Queries") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the terms of q: the size of each one's list, and where it begins in the numbers (term of q, position), which rise."""
        at = np.minimum(np.searchsorted(self.terms, q.vocabulary), max(len(self.terms) - 1, 0))
        here = self.terms[at] == q.vocabulary if len(self.terms) else np.zeros(len(at), bool)
        sizes = np.where(here, self.bounds[at + 1] - self.bounds[at], 0) if len(self.terms) else np.zeros(len(at), np.int64)
        starts = np.cumsum(sizes) - sizes
        index = np.repeat(self.bounds[at] - starts if len(self.terms) else starts, sizes) + np.arange(sizes.sum())
        return sizes, starts, np.repeat(np.arange(len(at)), sizes) * self._span + self.positions[index]

    @property
    def _span(self) -> int:
        return int(self.offsets[-1]) + 1

    def _doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, position, "right") - 1

    def _rarest(self, q: "Queries", terms: np.ndarray, sizes: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """In steps: (window, position of a posting of its rarest term), and the columns of each window's terms by rarity. Windows
        of which the shard lacks a term are left out."""
        df = np.where(terms >= 0, sizes[np.maximum(terms, 0)], np.iinfo(np.int64).max)
        by_rarity = np.argsort(df, axis=1, kind="stable")
        least = np.take_along_axis(df, by_rarity[:, :1], 1)[:, 0]
        live = np.flatnonzero(least > 0)
        total = np.cumsum(least[live])
        at = 0
        while at < len(live):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _STEP, "right")))
            win = live[at:to]
            n = least[win]
            first = terms[win, by_rarity[win, 0]]
            index = np.repeat(starts[first] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield np.repeat(win, n), numbers[index] - np.repeat(first, n) * self._span, by_rarity
            at = to

    def phrases(self, q: "Queries") -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every exact occurrence inside one document."""
        none = np.empty(0, np.int64)
        if not len(q.terms) or not len(self.positions):
            return none, none
        sizes, lists, numbers = self._lists(q)
        wins, starts = [none], [none]
        for which, position, by_rarity in self._rarest(q, q.terms, sizes, lists, numbers):
            start = position - by_rarity[which, 0]
            end = start + q.lengths[which]
            ok = (start >= 0) & (end < self._span)
            which, start, end = which[ok], start[ok], end[ok]
            ok = self.offsets[self._doc(start) + 1] >= end  # both ends in one document
            which, start = which[ok], start[ok]
            for k in range(1, q.terms.shape[1]):  # the next rarest term's list, shifted by its offset
                if not len(which):
                    break
                col = by_rarity[which, k]
                term = q.terms[which, col]
                number = term * self._span + start + col
                at = np.minimum(np.searchsorted(numbers, number), len(numbers) - 1)
                ok = (term < 0) | (numbers[at] == number)
                which, start = which[ok], start[ok]
            wins.append(which)
            starts.append(start)
        return np.concatenate(wins), np.concatenate(starts)

    def near(self, q: "Queries", span: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of each posting of a window's rarest term with postings of all its terms, in any order and as
        often as the window has them, at most `span` words away from it in the same document."""
        none = np.empty(0, np.int64)
        if not len(q.terms) or not len(self.positions):
            return none, none
        sizes, lists, numbers = self._lists(q)
        ordered = np.sort(q.terms, axis=1)
        new = np.column_stack((np.ones(len(ordered), bool), ordered[:, 1:] != ordered[:, :-1])) & (ordered >= 0)
        need = np.zeros_like(ordered)  # at a term's first place, how often the window has it
        for k in range(ordered.shape[1]):
            need[:, k] = (ordered == ordered[:, k : k + 1]).sum(axis=1)
        terms = np.where(new, ordered, -1)
        wins, places = [none], [none]
        for which, position, by_rarity in self._rarest(q, terms, sizes, lists, numbers):
            for k in range(terms.shape[1]):
                doc = self._doc(position)
                low, high = np.maximum(position - span, self.offsets[doc]), np.minimum(position + span + 1, self.offsets[doc + 1])
                col = by_rarity[which, k]
                term = terms[which, col]
                n = np.searchsorted(numbers, term * self._span + high) - np.searchsorted(numbers, term * self._span + low)
                ok = (term < 0) | (n >= need[which, col])
                which, position = which[ok], position[ok]
            wins.append(which)
            places.append(position)
        return np.concatenate(wins), np.concatenate(places)


_PARTS = {"k1": np.int64, "k2": np.int64, "offsets": np.int64, "terms": np.uint64, "bounds": np.int64, "positions": np.int32}


def index(docs: DataFrame) -> DataFrame:
    """The stored index of docs(doc_id, text, ...): a shard in each row. A document is known by its doc_id and a hash of its text;
    null texts are empty; an empty table gives no shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            shard = Shard.of(batch.column(2), batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([getattr(shard, n).astype(t).tobytes()], pa.binary()) for n, t in _PARTS.items()], names=list(_PARTS))

    return stored(docs.select(*_ids(), "text").mapInArrow(freed(run), ", ".join(f"{n} binary" for n in _PARTS)), "index")


def _ids() -> list:
    return [F.coalesce("doc_id", F.lit(_NULL_ID)).alias("k1"), F.xxhash64("text").alias("k2")]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Shard(*(np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in enumerate(_PARTS.values())))


def _n_words(texts: pa.Array) -> pa.Array:
    return pa.array(word_counts(texts, ALNUM), pa.int64())


def _blocks(benchmark: DataFrame, width: int, limit: int) -> Iterator[Queries]:
    """The benchmark in blocks of whole items; an item beyond the limit is a block of its own."""
    items, total = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        size = width * (len(row[1] or "") // 2 + 1)
        if items and total + size > limit:
            yield windows(items, width)
            items, total = [], 0
        items.append((row[0], row[1]))
        total += size
    yield windows(items, width)


_FOUND = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def _matches(shards: DataFrame, q: Queries) -> DataFrame:
    """(k1, k2, hits, items) of the documents with a match, stored."""
    sent = shards.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for shard in _shards(batches):
            which, start = shard.phrases(q)
            if not len(which):
                continue
            edge = np.zeros(int(shard.offsets[-1]) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + q.lengths[which], -1)
            hit = np.cumsum(edge)[:-1] > 0
            per: dict[int, set[str]] = {}
            for d, k in {*zip(shard._doc(start).tolist(), which.tolist(), strict=True)}:
                per.setdefault(d, set()).update(q.owners[k])
            docs = sorted(per)
            places = [np.flatnonzero(hit[shard.offsets[d] : shard.offsets[d + 1]]).astype(np.int32) for d in docs]
            yield pa.RecordBatch.from_arrays([pa.array(shard.k1[docs]), pa.array(shard.k2[docs]), pa.array(places, pa.list_(pa.int32())), pa.array([sorted(per[d]) for d in docs], pa.list_(pa.string()))], schema=_FOUND)

    out = stored(shards.mapInArrow(freed(run), "k1 bigint, k2 bigint, hits array<int>, items array<string>"), "matches")
    sent.unpersist()
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """All rows and columns of docs(doc_id, text, ...) with n_words, hits (array of the 0-based positions of words inside
    any occurrence of a benchmark window) and items (sorted ids, as strings, of the items that occur).

    Words are digits, letters and non-ASCII characters, A-Z lower-cased. Null or empty texts have no words and no hits;
    benchmark rows with a null id or text and empty benchmarks match nothing. Rows are independent: repeated and null
    doc_ids keep their rows. Columns of docs named n_words, hits or items are replaced.
    """
    docs = docs.drop("n_words", "hits", "items")
    shards = index(docs)
    found = None
    for q in _blocks(benchmark, width, block_terms):
        mine = _matches(shards, q)
        found = mine if found is None else found.union(mine)
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("hits") + 4 * F.size("items")), F.lit(0)).alias("hits")).first()
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    found = found.groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(merged("hits"), merged("items"))  # one document's
    if size.n <= BROADCAST_DOCS and size.hits <= BROADCAST_HITS:
        found = F.broadcast(found)
    k1, k2 = _ids()
    met = docs.withColumns({"__a": k1, "__b": k2}).join(found, (F.col("__a") == F.col("__k1")) & (F.col("__b") == F.col("__k2")), "left")
    n_words = F.arrow_udf(_n_words, "bigint")("text")
    none = {c: F.coalesce(c, F.array().cast(f"array<{t}>")) for c, t in (("hits", "int"), ("items", "string"))}
    return met.select(*docs.columns, n_words.alias("n_words"), none["hits"].alias("hits"), none["items"].alias("items"))


def proximity(docs: DataFrame, benchmark: DataFrame, width: int = 10, span: int = 20, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(doc_id, item_id, position), once each: documents in which all words of a benchmark window lie within `span` words of
    one of its words, the one that is rarest in the document's shard, in any order and as often as the window has them;
    position is that of the rarest word. Exact matches of windows are among them if span >= width - 1.

    Words, nulls and empty tables are those of decontaminate(); documents that repeat count once; other columns are ignored.
    """
    shards, out = index(docs), None
    for q in _blocks(benchmark, width, block_terms):

        def run(batches: Iterator[pa.RecordBatch], q: Queries = q) -> Iterator[pa.RecordBatch]:
            for shard in _shards(batches):
                which, place = shard.near(q, span)
                doc = shard._doc(place)
                rows = {(int(shard.k1[d]), item, int(p - shard.offsets[d])) for k, d, p in zip(which.tolist(), doc.tolist(), place.tolist(), strict=True) for item in q.owners[k]}
                d, i, p = zip(*sorted(rows), strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([None if x == _NULL_ID else x for x in d], pa.int64()), pa.array(i, pa.string()), pa.array(p, pa.int32())], names=["doc_id", "item_id", "position"])

        found = stored(shards.mapInArrow(run, "doc_id bigint, item_id string, position int"), "near")
        out = found if out is None else out.union(found)
    return out.distinct()


def digest(found: DataFrame) -> DataFrame:
    """One narrow row of each row of decontaminate()'s result."""
    return found.select("doc_id", "n_words", F.size("hits").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def brute_force(texts: list[str | None], items: list[tuple], width: int) -> list[tuple[int, int, int, str]]:
    """The definition itself, for tests: n_words, n_hit, n_items, items_sha256."""
    import re

    def cut(t: str | None) -> list[str]:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    wins: dict[tuple, set[str]] = {}
    for i, t in items:
        b = cut(t)
        for at in range(max(1, len(b) - width + 1) if b and i is not None else 0):
            wins.setdefault(tuple(b[at : at + width]), set()).add(str(i))
    out = []
    for t in texts:
        a = cut(t)
        hit, found = set(), set()
        for size in {len(x) for x in wins}:
            for at in range(len(a) - size + 1):
                if who := wins.get(tuple(a[at : at + size])):
                    hit.update(range(at, at + size))
                    found |= who
        out.append((len(a), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out
