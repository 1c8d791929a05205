"""Exact token counts of a SentencePiece BPE model by rank-synchronous array merging.

A text is cut into pre-tokens where no merge can reach across: before each run of word marks, and around characters
that no piece of two or more characters holds. Batched pre-tokens are ragged numpy arrays of symbols. The library merges the
lowest-rank pair of a sequence again and again, the leftmost if several have that rank. In every step here, in all
sequences at once, are merged
  - each sequence's lowest-rank pair, and
  - all pairs that the library will merge whatever happens around them. The symbol before a pair can only grow into one that
    ends with it, the symbol after into one that begins with it, by merges of their own; tables have the lowest rank by which a
    pair with any of these can come about.
    A pair is merged for sure if its rank is below all that could take one of its symbols away (on the left equal ranks
    count too, as the leftmost comes first). Merging it at once changes nothing that is decided before its turn if its
    rank is also below that of all pairs that the merged symbol can be in. In a run such as `aaaa` every second pair
    follows from the first.
Between symbols that no pair can ever join, whatever they grow into, a sequence is cut in two. Long sequences thus end after a few steps too, with work in proportion to their length. Sequences without a pair leave. What
survives is counted; a character outside the vocabulary counts as its UTF-8 bytes.
"""

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrays import freed, mix, power, raw, slices

MARK = 0x2581
#: Counts of pre-tokens that a worker keeps, by 64-bit hashes; the store is emptied beyond that, so memory is bounded.
KEPT = 1 << 20
#: Longer pre-tokens are merged each time.
LONGEST_KEPT = 64
#: Symbols merged in one batch of arrays.
BATCH_SYMBOLS = 1 << 18
_NONE = np.int64(1) << np.int64(60)


def _find(keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return at, keys[at] == key


class Table:
    """Places of different numbers that aren't negative, by hashing into a table half empty at least, neighbours next."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.index = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        left, place = np.arange(len(keys)), self._place(keys)
        while len(left):
            free = self.keys[place] < 0
            self.keys[place[free]], self.index[place[free]] = keys[left[free]], left[free]
            rest = self.keys[place] != keys[left]
            left, place = left[rest], (place[rest] + 1) & (len(self.keys) - 1)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key, and whether it is there."""
        place = self._place(key)
        there = self.keys[place]
        hit = there == key
        out = self.index[place]
        more = np.flatnonzero((there >= 0) & ~hit)
        place = place[more]
        while len(more):
            place = (place + 1) & (len(self.keys) - 1)
            there = self.keys[place]
            same = there == key[more]
            out[more[same]], hit[more[same]] = self.index[place[same]], True
            rest = (there >= 0) & ~same
            more, place = more[rest], place[rest]
        return out, hit


def _lowest(keys: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the lowest rank of each."""
    order = np.lexsort((ranks, keys))
    keys, ranks = keys[order], ranks[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], ranks[first]


class Merger:
    """Merge table of a model: pairs of symbol numbers with the rank and number of what they become."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        mark = chr(MARK)
        if any(b == mark and a != mark for p in scores for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece holds a word mark after another character: texts can't be cut there")
        rank = {p: i for i, p in enumerate(sorted(scores, key=lambda p: -scores[p]))}
        number = {p: i for i, p in enumerate(scores)}
        known = {p for p in scores if len(p) == 1}
        joins = {c for p in scores if len(p) > 1 for c in p} | {mark}
        # all characters that pieces hold need a number, in the vocabulary or not
        for c in sorted(joins - known):
            number.setdefault(c, len(number))
        n = self.n = len(number)
        pairs = [(number[p[:k]], number[p[k:]], rank[p], number[p]) for p in scores for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        left, right, ranks, made = np.array(sorted(pairs), np.int64).T.copy()
        self.pairs, self.ranks, self.made = Table(left * n + right), ranks, made
        text = {i: p for p, i in number.items()}
        before, after, across = [], [], set()
        for x, y, r in zip(left.tolist(), right.tolist(), ranks.tolist(), strict=True):
            ends = [number[u] for u in (text[x][k:] for k in range(len(text[x]))) if u in number]
            begins = [number[u] for u in (text[y][: k + 1] for k in range(len(text[y]))) if u in number]
            # what has yet to grow must be merged first, by a rank of its own
            before += [(u * n + y, r if u == x else max(r, rank[text[x]])) for u in ends]
            after += [(x * n + u, r if u == y else max(r, rank[text[y]])) for u in begins]
            across.update(u * n + w for u in ends for w in begins)
        #: Of (symbol, next symbol): the lowest rank by which a pair comes about whose left ends with the first, or whose right
        #: begins with the second.
        keys, self.before_rank = _lowest(*np.array(before, np.int64).T)
        self.before = Table(keys)
        keys, self.after_rank = _lowest(*np.array(after, np.int64).T)
        self.after = Table(keys)
        #: (symbol, next symbol) that some pair joins.
        self.across = Table(np.fromiter(across, np.int64, len(across)))
        self.bytes = np.ones(n, np.int64)
        for p, i in number.items():
            if p not in scores:
                self.bytes[i] = len(p.encode())
        self.code = np.full(0x110000, -1, np.int32)
        for c in joins:
            self.code[ord(c)] = number[c]
        #: Tokens of a character that merges with none.
        points = np.arange(0x110000)
        self.alone = (1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int8)
        self.alone[[ord(c) for c in known]] = 1
        self.alone[self.code >= 0] = 0
        self.hashes, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def _bound(self, table: Table, ranks: np.ndarray, left: np.ndarray, right: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """The lowest rank of a pair by a table; none where nothing stands there."""
        at, hit = table.find(left * self.n + right)
        return np.where(hit & open_, ranks[at], _NONE)

    def _certain(self, s: np.ndarray, inside: np.ndarray, rank: np.ndarray, made: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the pairs at `at`, those that are merged whatever happens around them. inside: a symbol and the next are of one
        sequence. made: what the pair at a place becomes."""
        end = len(s) - 1
        own = rank[at]
        has_left, has_right = inside[np.maximum(at - 1, 0)] & (at > 0), inside[at + 1]
        at = at[(np.where(has_right, rank[np.minimum(at + 1, end)], _NONE) >= own) & (np.where(has_left, rank[np.maximum(at - 1, 0)], _NONE) >= own)]
        own, new = rank[at], made[at]
        has_left, has_right = inside[np.maximum(at - 1, 0)] & (at > 0), inside[at + 1]
        left, right = s[np.maximum(at - 1, 0)], s[np.minimum(at + 2, end)]
        free = (own <= self._bound(self.after, self.after_rank, s[at + 1], right, has_right)) & (own < self._bound(self.after, self.after_rank, new, right, has_right))
        sure = free & (own < self._bound(self.before, self.before_rank, left, s[at], has_left)) & (own < self._bound(self.before, self.before_rank, left, new, has_left))
        # in a run of equal symbols the second pair after a sure one, which leaves the merged symbol before it
        both = np.ones(len(at), bool)
        joined = np.zeros(len(at), bool)
        joined[1:] = (at[1:] == at[:-1] + 1) & (s[at[1:]] == s[at[:-1]]) & (s[at[1:] + 1] == s[at[1:]]) & free[1:] & free[:-1]
        if joined.any():
            run = np.flatnonzero(joined)
            alone = self._bound(self.before, self.before_rank, new[run], s[at[run]], both[run]), self._bound(self.before, self.before_rank, new[run], new[run], both[run])
            joined[run] = (own[run] < alone[0]) & (own[run] < alone[1])
        place = np.arange(len(at))
        start = np.maximum.accumulate(np.where(joined, 0, place))
        return at[np.where(joined, sure[start] & ((place - start) % 2 == 0), sure)]

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each sequence; sizes: symbols of each, one at least."""
        out = np.zeros(len(sizes), np.int64)
        s, which = symbols.astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
        inside = np.append(which[1:] == which[:-1], [False, False])  # a symbol and the next are of one sequence
        while len(s):
            inside[:-2] &= self.across.find(s[:-1] * self.n + s[1:])[1]
            rank = np.full(len(s), _NONE, np.int64)
            made = np.zeros(len(s), np.int64)
            at = np.flatnonzero(inside)
            spot, hit = self.pairs.find(s[at] * self.n + s[at + 1])
            rank[at[hit]], made[at[hit]] = self.ranks[spot[hit]], self.made[spot[hit]]
            starts = np.append(0, np.flatnonzero(~inside[: len(s) - 1]) + 1)
            own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(s))))
            best = np.minimum.reduceat(rank, starts)
            live = (best < _NONE)[own]
            out += np.bincount(which[~live], self.bytes[s[~live]], len(out)).astype(np.int64)
            lowest = np.flatnonzero((rank == best[own]) & live)
            lowest = lowest[np.append(True, own[lowest[1:]] != own[lowest[:-1]])] if len(lowest) else lowest
            # a sequence's lowest pair overlaps no sure pair: of the two the one with the lower rank, or the left one, would be both
            merged = np.zeros(len(s), bool)
            merged[lowest] = True
            merged[self._certain(s, inside, rank, made, np.flatnonzero(rank < _NONE))] = True
            hit = np.flatnonzero(merged)
            s[hit] = made[hit]
            inside[hit] = inside[hit + 1]
            keep = live
            keep[hit + 1] = False
            s, which, inside = s[keep], which[keep], np.append(inside[: len(keep)][keep], [False, False])[: keep.sum() + 1]
        return out

    def _learn(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of the pre-tokens codes[start : start + size]."""
        out = np.zeros(len(sizes), np.int64)
        order = np.argsort(sizes, kind="stable")
        total = np.cumsum(sizes[order])
        at = 0
        while at < len(order):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BATCH_SYMBOLS, "right")))
            mine = order[at:to]
            n = sizes[mine]
            index = np.arange(n.sum()) + np.repeat(starts[mine] - (np.cumsum(n) - n), n)
            out[mine] = self.merge(self.code[codes[index]], n)
            at = to
        return out

    def _counted(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token, those of LONGEST_KEPT characters at most through the store."""
        p, inverse = power(len(codes) + 1)
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * p[: len(codes)], out=total[1:])
        h = mix((total[starts + sizes] - total[starts]) * inverse[starts] + np.uint64(0x9D39247E33776D41))
        out = np.zeros(len(starts), np.int64)
        long = np.flatnonzero(sizes > LONGEST_KEPT)
        out[long] = self._learn(codes, starts[long], sizes[long])
        short = np.flatnonzero(sizes <= LONGEST_KEPT)
        u, first, back = np.unique(h[short], return_index=True, return_inverse=True)
        if len(self.hashes) + len(u) > KEPT:
            self.hashes, self.counts = self.hashes[:0], self.counts[:0]
        new = np.ones(len(u), bool)
        if len(self.hashes):
            new = ~_find(self.hashes, u)[1]
        if new.any():
            mine = short[first[new]]
            found = self._learn(codes, starts[mine], sizes[mine])
            place = np.searchsorted(self.hashes, u[new])
            self.hashes, self.counts = np.insert(self.hashes, place, u[new]), np.insert(self.counts, place, found)
        out[short] = self.counts[np.searchsorted(self.hashes, u)][back]
        return out

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text: a mark before it, marks for its spaces."""
        texts = [t or "" for t in texts]
        if not texts:
            return np.empty(0, np.int64)
        mark = chr(MARK)
        codes = np.frombuffer((mark + mark.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(codes == 32, np.uint32(MARK), codes)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        heads = np.cumsum(sizes) - sizes
        joins = self.code[codes] >= 0
        joins[heads[sizes == 1]] = False  # an empty text has no token
        is_mark = codes == MARK
        starts = joins.copy()
        starts[1:] &= ~joins[:-1] | (is_mark[1:] & ~is_mark[:-1])
        starts[heads] = joins[heads]
        starts = np.flatnonzero(starts)
        stop = ~joins
        stop[starts] = True
        stops = np.append(np.flatnonzero(stop), len(codes))
        ends = stops[np.searchsorted(stops, starts, "right")]
        total = np.append(0, np.cumsum(self.alone[codes], dtype=np.int64))
        out = total[heads + sizes] - total[heads]
        if len(starts):
            each = np.append(0, np.cumsum(self._counted(codes, starts, ends - starts)))
            at = np.searchsorted(starts, np.append(heads, len(codes)))
            out += each[at[1:]] - each[at[:-1]]
        return out


@functools.lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of docs(doc_id, text, ...).

    `path` is the model's file on every executor; None means piece_bpe_32k.model of public_tokenizers. Counts have no begin,
    end or other special tokens. Null counts as empty: 0 bytes and 0 tokens, as does an empty text. Whole texts of any
    length are counted; rows are independent, so repeated and null ids keep their rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        m = merger(path or public_tokenizers.path("piece_bpe_32k.model"))
        for batch in slices(batches):
            n = m.count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(raw(batch.column(1))[1])), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(freed(run), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
