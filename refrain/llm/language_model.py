"""Language-model scores: a log-bilinear neural model trained in numpy with noise-contrastive estimation.

Vocabulary and counts come from all training texts. The model has two softmaxes. Symbols of the first are the most frequent
words, the end of a text, and classes of all other words (by their last bytes). The second chooses among the words of a
class: each word that occurs sqrt(tokens) / FLOOR times or more, twice at least, has a vector of its own there, as target
and as context, so what is learned grows with the corpus; the class's rarer words are one more choice. With more such words
classes are split, so that neither softmax grows faster than the square root of their number. P(word | context) is
P(symbol | context), times, in a class, P(choice | class, context), times, for a rarer word, its share of the choice,
(c + 1) / (sum of c + 1 over its words, and 1 for all the class's unknown words).

In both softmaxes the context's vector is the sum of the vectors of the two tokens before, one table for each place, and its
products with the choices' vectors, plus their biases, are trained by noise-contrastive estimation and normalised by
batched matrix products: in the first those of each place's table with all choices, whose sums are normalised for the
distinct contexts that occur; in the second those of a class's tokens with its choices.

Each partition trains on all its training texts from the same start, and the parameters are averaged by tokens. Counts
meet by hash in arrays: documents are dealt into blocks, a block sends its distinct words once, and gets the totals
of these words back. Scoring streams: a block's totals come first, its texts after them, so a worker holds the totals and
one slice of text. Only the frequent words, class sums, the words that have vectors, and one set of parameters reach
the driver; their size grows more slowly than the corpus, as the count that a word needs grows with it.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import freed, mix, slices, words
from ._shared import partitions, stored

FREQUENT, SIZE, NOISE, RATE = 256, 16, 64, 0.05
#: Words in classes: the count they need is sqrt(tokens) / FLOOR, 2 at least; size, noise and learning rate of their vectors.
FLOOR, WORD_SIZE, WORD_NOISE, WORD_RATE = 50, 8, 2, 0.06
#: Classes at least. A word's kind has 16 bits, 8 from its last two bytes, then 8 from the third last; a class is a prefix.
CLASSES = 256
#: Tokens of a training step at most; steps in which short slices of texts are trained; noise words drawn for each class and
#: slice.
BATCH, STEPS, POOL = 8192, 16, 256
#: Parameters are averaged in so many chunks for each softmax.
CHUNKS = 64
END = np.uint64(0xE4D0F7E47B1F00D5)
#: Distinct words of a text block counted before they are merged; bytes of counts that meet in one task; numbers in one
#: product or sum of the first softmax, and of the second, in one place that stays in the cache; bytes of text scored at once.
_MERGE, _TOGETHER, _PRODUCT, _NORMED, _SCORED_BYTES = 1 << 20, 16 << 20, 1 << 18, 1 << 16, 2 << 20


def _tokens(column: pa.Array, kinds: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and, if asked for, kind of every token, an end after the words of each text; offsets of the texts."""
    w = words(column)
    h, n = w.hashes(), len(w.offsets) - 1
    out, kind = np.empty(len(h) + n, np.uint64), np.zeros(len(h) + n, np.uint16)
    at = np.arange(len(h)) + w.owners()
    offsets = w.offsets + np.arange(n + 1)
    out[at], out[offsets[1:] - 1] = h, END
    if not kinds:
        return out, kind, offsets
    size = w.ends - w.starts
    last, before, third = (np.where(size >= k, w.data[np.maximum(w.ends - k, 0)], 0).astype(np.uint64) for k in (1, 2, 3))
    kind[at] = mix(last * np.uint64(256) + before) % np.uint64(256) * np.uint64(256) + mix(third + np.uint64(1)) % np.uint64(256)
    return out, kind, offsets


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, summed counts, kinds."""
    h, c, k = (np.concatenate(x) for x in zip(*parts, strict=True))
    u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    return u, np.bincount(inverse, weights=c, minlength=len(u)).astype(np.int64), k[first]


_COUNTED = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()), ("kinds", pa.binary())])
_COUNTED_SQL = "part int, block int, hashes binary, counts binary, kinds binary"


def _row(part: int, block: int, h: np.ndarray, c: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": [part], "block": [block], "hashes": [h.tobytes()], "counts": [c.tobytes()], "kinds": [k.tobytes()]}, schema=_COUNTED)


def _read(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["counts"], np.int64), np.frombuffer(r["kinds"], np.uint16)


def _count(pieces: int):
    """A row for each (block, part of the hashes): the block's distinct words, with their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        waiting: dict[int, int] = {}
        for batch in slices(batches):
            blocks, train = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            h, kind, offsets = _tokens(batch.column(0))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            for b in np.unique(blocks).tolist():
                mine = (blocks == b)[owner]
                parts = found.setdefault(b, [])
                parts.append(_merged([(h[mine], train[owner[mine]].astype(np.int64), kind[mine])]))
                waiting[b] = waiting.get(b, 0) + len(parts[-1][0])
                if waiting[b] > _MERGE:
                    found[b] = [_merged(parts)]
                    waiting[b] = 0
        for b, parts in found.items():
            h, c, k = _merged(parts)
            part = (h >> np.uint64(32)) % np.uint64(pieces)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(pieces + 1))
            for p in np.flatnonzero(np.diff(ends)).tolist():
                m = order[ends[p] : ends[p + 1]]
                yield _row(p, b, h[m], c[m], k[m])

    return run


def _total(table: pa.Table) -> pa.Table:
    """Of some parts of the hashes: to each block its words with their totals; a row with block -1: the most frequent words, and
    the end if it is among these words; one with block -2: all words that may have vectors; and one with block -3: for each
    kind the sum of c + 1 over its known words, after N and V."""
    blocks = table.column("block").to_numpy()
    rows = [_read(r) for r in table.select(["hashes", "counts", "kinds"]).to_pylist()]
    u, c, k = _merged(rows)
    out = []
    order = np.argsort(blocks, kind="stable")
    values, starts = np.unique(blocks[order], return_index=True)
    for b, mine in zip(values.tolist(), np.split(order, starts[1:]), strict=True):
        h = np.concatenate([rows[i][0] for i in mine])  # parts are disjoint
        at = np.searchsorted(u, h)
        out.append(_row(0, b, h, c[at], k[at]))
    known = c > 0
    top = np.lexsort((u, -c, u != END))[:FREQUENT]  # the end comes first, how rare it may be
    top = top[c[top] > 0]
    out.append(_row(0, -1, u[top], c[top], k[top]))
    own = c >= floor(int(c.sum()))  # a part's floor is never above that of all
    out.append(_row(0, -2, u[own], c[own], k[own]))
    kinds, inverse = np.unique(k[known], return_inverse=True)
    sums = np.bincount(inverse, weights=(c[known] + 1).astype(float), minlength=len(kinds)).astype(np.int64)
    out.append(_row(0, -3, u[:0], np.concatenate(([c.sum(), known.sum()], sums)).astype(np.int64), kinds))
    return pa.Table.from_batches(out)


def floor(n: int) -> int:
    """Count from which a word of a class has a vector, of n training tokens."""
    return max(2, int(n**0.5 / FLOOR))


def _above(least: int):
    """The words that occur so often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                h, c, k = _read(r)
                m = c >= least
                yield _row(0, -2, h[m], c[m], k[m])

    return run


class Vocabulary:
    """N and V; symbols of the first softmax: the frequent words (sorted hashes), then `k - FREQUENT` classes, whose `sums` of
    c + 1 are those of their known words that aren't frequent, and 1; noise distribution of the symbols; choices of
    the second softmax, by class: first that of the rarer words, then words by hash."""

    def __init__(self, tops: list, above: list, sums: list):
        self.n = self.v = 0
        by_kind = np.zeros(1 << 16)
        for _, c, k in sums:
            self.n, self.v = self.n + int(c[0]), self.v + int(c[1])
            by_kind[k] += c[2:]
        h, c, k = _merged(tops) if tops else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint16))
        order = np.lexsort((h, -c, h != END))[:FREQUENT]
        order = order[np.argsort(h[order])]
        self.frequent, counts, kinds = h[order], c[order], k[order]
        h, c, k = _merged(above) if above else (h[:0], c[:0], k[:0])
        free = ~np.isin(h, self.frequent)
        h, c, k = h[free], c[free], k[free]
        self.shift = 8
        while self.shift and (1 << (16 - self.shift)) ** 2 < len(h):
            self.shift -= 1
        classes = 1 << (16 - self.shift)
        self.k = FREQUENT + classes
        np.subtract.at(by_kind, kinds, counts + 1.0)
        self.sums = by_kind.reshape(classes, -1).sum(axis=1) + 1
        weight = np.concatenate((counts + 1.0, np.zeros(FREQUENT - len(order)), self.sums))
        self.noise = weight / weight.sum()
        self.edges = np.cumsum(self.noise)

        kind = k.astype(np.int64) >> self.shift
        order = np.lexsort((h, kind))
        h, c, kind = h[order], c[order], kind[order]
        self.first = np.append(np.searchsorted(kind, np.arange(classes)) + np.arange(classes), len(h) + classes)
        place = np.arange(len(h)) + kind + 1
        self.choices = len(h) + classes
        self.rarer = self.sums - np.bincount(kind, weights=c + 1.0, minlength=classes)
        weight = np.empty(self.choices)
        weight[self.first[:-1]], weight[place] = self.rarer, c + 1.0
        self.total = np.concatenate(([0.0], np.cumsum(weight)))
        self.share = weight / np.repeat(self.sums, np.diff(self.first))
        by_hash = np.argsort(h)
        self.hashes, self.places = h[by_hash], place[by_hash]

    def symbols(self, h: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol of each token; its choice, -1 for frequent words; its number as a context of the second softmax: the
        symbol, or for words with vectors what follows after the symbols and the start of a text."""
        out = (kind.astype(np.int64) >> self.shift) + FREQUENT
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, h), len(self.frequent) - 1)
            hit = self.frequent[at] == h
            out[hit] = at[hit]
        choice, context = np.full(len(h), -1), out.copy()
        at = np.flatnonzero(out >= FREQUENT)
        choice[at] = self.first[out[at] - FREQUENT]
        if len(self.hashes):
            found = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            hit = self.hashes[found] == h[at]
            choice[at[hit]] = self.places[found[hit]]
            context[at[hit]] = self.k + 1 + choice[at[hit]]
        return out, choice, context


def contexts(numbers: np.ndarray, offsets: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers one and two tokens before each; `start` before a text's first."""
    one, two = np.full(len(numbers), start), np.full(len(numbers), start)
    one[1:], two[2:] = numbers[:-1], numbers[:-2]
    one[offsets[:-1]] = start
    two[offsets[:-1]] = start
    second = offsets[:-1] + 1
    two[second[second < offsets[1:]]] = start
    return one, two


def initial(v: Vocabulary, seed: int = 11) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Parameters of both softmaxes: context vectors of the two places, choices' vectors, biases (those of the unigrams)."""
    rng = np.random.default_rng(seed)
    out = []
    for seen, chosen, size, share in ((v.k + 1, v.k, SIZE, v.noise), (v.k + 1 + v.choices, v.choices, WORD_SIZE, v.share)):
        near, far, vectors = (rng.normal(0, 0.1, (n, size)).astype(np.float32) for n in (seen, seen, chosen))
        if chosen == v.choices and seen > v.k + 1:
            vectors[:] = 0
        out.append([near, far, vectors, np.log(np.maximum(share, 1e-12)).astype(np.float32)])
    return out[0], out[1]


def _order(index: np.ndarray) -> np.ndarray:
    """A stable order; numbers of 16 bits are sorted by digits."""
    return np.argsort(index.astype(np.uint16) if len(index) and index.max() < 1 << 16 else index, kind="stable")


def _scatter(index: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of equal index."""
    order = _order(index)
    ordered = index[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return ordered[first], np.add.reduceat(grad.take(order, axis=0), first, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """x is overwritten."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def gradients(params: list[np.ndarray], y: np.ndarray, a: np.ndarray, b: np.ndarray, noise: np.ndarray, log_noise: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Gradients of the noise-contrastive loss, (rows, sums) of each parameter: the mean over tokens of
    softplus(-d(y)) + sum over noise choices of softplus(d(n)), where d is a choice's score minus log_noise, the log of the
    expected number of times it is drawn. noise: one list for all tokens, or one for each. log_noise: by choice."""
    near, far, out, bias = params
    bias = bias - log_noise
    q, r = near.take(a, axis=0), out.take(y, axis=0)
    q += far.take(b, axis=0)
    scale = np.float32(1 / len(y))
    gp = ((_sigmoid(np.einsum("ij,ij->i", q, r) + bias[y]) - 1) * scale).astype(np.float32, copy=False)
    rn = out.take(noise, axis=0)
    if noise.ndim == 1:
        gn = q @ rn.T
        gn += bias[noise]
        gn = _sigmoid(gn)
        gn *= scale
        gq = gp[:, None] * r + gn @ rn
        of_noise, b_noise = gn.T @ q, gn.sum(axis=0)
    else:
        gn = (_sigmoid(np.einsum("ij,ikj->ik", q, rn) + bias[noise]) * scale).astype(np.float32, copy=False)
        gq = gp[:, None] * r + np.einsum("ik,ikj->ij", gn, rn)
        of_noise, b_noise = (gn[:, :, None] * q[:, None, :]).reshape(-1, q.shape[1]), gn.ravel()
    both = np.empty((len(y) + noise.size, q.shape[1] + 1), q.dtype)
    np.multiply(gp[:, None], q, out=both[: len(y), :-1])
    both[: len(y), -1], both[len(y) :, :-1], both[len(y) :, -1] = gp, of_noise, b_noise
    rows, grad = _scatter(np.concatenate((y, noise.ravel())), both)
    return [_scatter(a, gq), _scatter(b, gq), (rows, grad[:, :-1]), (rows, grad[:, -1])]


def _descend(params: list[np.ndarray], past: list[np.ndarray], found: list[tuple[np.ndarray, np.ndarray]], rate: float) -> None:
    """A step of Adagrad."""
    for p, s, (rows, grad) in zip(params, past, found, strict=True):
        step = s[rows]
        step += grad * grad
        s[rows] = step
        step += 1e-8
        np.sqrt(step, out=step)
        p[rows] -= np.divide(rate * grad, step, out=step)


def train(v: Vocabulary, outer: list, inner: list, past: tuple[list, list], h: np.ndarray, kind: np.ndarray, offsets: np.ndarray, rng: np.random.Generator) -> None:
    """One pass over some texts, their tokens in random order, in steps for each softmax. Noise: in the first a
    step's tokens share it; in the second each has its own, from its class."""
    s, choice, context = v.symbols(h, kind)
    order = rng.permutation(len(s))
    one, two = contexts(s, offsets, v.k)
    log_noise = np.log(NOISE * np.maximum(v.noise, 1e-12)).astype(np.float32)
    size = min(BATCH, max(64, len(order) // STEPS))
    for at in range(0, len(order), size):
        mine = order[at : at + size]
        noise = np.minimum(np.searchsorted(v.edges, rng.random(NOISE) * v.edges[-1]), v.k - 1)
        _descend(outer, past[0], gradients(outer, s[mine], one[mine], two[mine], noise, log_noise), RATE)
    one, two = contexts(context, offsets, v.k)
    log_noise = np.log(WORD_NOISE * np.maximum(v.share, 1e-12)).astype(np.float32)
    # a pool of noise for each class, from which its tokens draw
    low, high = v.first[:-1], v.first[1:]
    spread = v.total[low, None] + rng.random((len(low), POOL)) * (v.total[high] - v.total[low])[:, None]
    pool = np.clip(np.searchsorted(v.total, spread.ravel(), "right").reshape(spread.shape) - 1, low[:, None], high[:, None] - 1)
    order = order[choice[order] >= 0]
    order = order[(high - low > 1)[s[order] - FREQUENT]]
    for at in range(0, len(order), size):
        mine = order[at : at + size]
        noise = pool[(s[mine] - FREQUENT)[:, None], rng.integers(0, POOL, (len(mine), WORD_NOISE), dtype=np.uint16)]
        _descend(inner, past[1], gradients(inner, choice[mine], one[mine], two[mine], noise, log_noise), WORD_RATE)


_PARAMS = pa.schema([("chunk", pa.int32()), ("weight", pa.float64()), ("data", pa.binary())])
_PARAMS_SQL = "chunk int, weight double, data binary"


def _kind(chunk: int) -> type:
    return np.float32 if chunk < CHUNKS else np.float16


def _learn(v: Vocabulary):
    """Parameters trained on a partition's texts, in chunks, and the partition's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outer, inner = initial(v)
        past = [np.zeros_like(p) for p in outer], [np.zeros_like(p) for p in inner]
        rng, total = np.random.default_rng(5), 0
        for batch in slices(batches):
            h, kind, offsets = _tokens(batch.column(0))
            train(v, outer, inner, past, h, kind, offsets, rng)
            total += len(h)
        if total:
            chunks = [x for group in (outer, inner) for x in np.array_split(np.concatenate([p.ravel() for p in group]), CHUNKS)]
            for k, x in enumerate(chunks):
                yield pa.RecordBatch.from_pydict({"chunk": [k], "weight": [float(total)], "data": [x.astype(_kind(k)).tobytes()]}, schema=_PARAMS)

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk, all in one task, become one."""
    sums: dict[int, list] = {}
    for batch in batches:
        for k, w, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            x = np.frombuffer(data, _kind(k)).astype(np.float64)
            old = sums.setdefault(k, [0.0, np.zeros(len(x))])
            old[0] += w
            old[1] += w * x
    for k, (w, x) in sums.items():
        yield pa.RecordBatch.from_pydict({"chunk": [k], "weight": [w], "data": [(x / w).astype(_kind(k)).tobytes()]}, schema=_PARAMS)


def _log_sums(x: np.ndarray) -> np.ndarray:
    """Logs of the sums of exp(x), row by row; x is overwritten. Only where a sum overflows is the greatest taken out first."""
    total = np.exp(x).sum(axis=1)
    if not np.isfinite(total).all() or not total.all():
        m = x.max(axis=1, keepdims=True)
        return np.log(np.exp(x - m).sum(axis=1)) + m[:, 0]
    return np.log(total)


class Outer:
    """The first softmax: products of the two places' tables with all choices, and the logs of the sums of the contexts that
    have occurred."""

    def __init__(self, params: list[np.ndarray]):
        near, far, out, bias = params
        self.near, self.far = near @ out.T + bias, far @ out.T
        self.norms = np.full((len(near), len(far)), np.nan, np.float32)

    def logs(self, s: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural log of P(symbol | contexts), normalised over all symbols."""
        new = np.isnan(self.norms[one, two])
        code = np.unique(one[new] * len(self.far) + two[new])
        step = max(1, _PRODUCT // self.near.shape[1])
        for at in range(0, len(code), step):
            a, b = np.divmod(code[at : at + step], len(self.far))
            self.norms[a, b] = _log_sums(self.near[a] + self.far[b])
        return self.near[one, s] + self.far[two, s] - self.norms[one, two]


def inner_logs(v: Vocabulary, params: list[np.ndarray], choice: np.ndarray, s: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Natural log of P(choice | class, contexts), normalised over the class's choices; 0 for frequent words."""
    near, far, out, bias = params
    found = np.zeros(len(s))
    mine = np.flatnonzero(choice >= 0)
    mine = mine[_order(s[mine])]
    q = np.ones((len(mine), near.shape[1] + 1), near.dtype)  # the last column meets the biases
    np.add(near.take(one[mine], axis=0), far.take(two[mine], axis=0), out=q[:, :-1])
    w = np.concatenate((out, bias[:, None]), axis=1).T
    room = np.empty(max(_NORMED, int(np.diff(v.first).max())), near.dtype)
    ordered = s[mine]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(mine) else mine
    kinds = ordered[starts]
    for k, at, to in zip(kinds.tolist(), starts.tolist(), np.append(starts, len(mine))[1:].tolist(), strict=True):
        low, high = v.first[k - FREQUENT], v.first[k - FREQUENT + 1]
        if high - low == 1:
            continue
        step, each = max(1, _NORMED // (high - low)), np.ones(high - low, near.dtype)
        for i in range(at, to, step):
            j = min(to, i + step)
            part = mine[i:j]
            x = np.matmul(q[i:j], w[:, low:high], out=room[: (j - i) * (high - low)].reshape(j - i, high - low))
            own = x[np.arange(len(part)), choice[part] - low]
            total = np.exp(x, out=x) @ each
            found[part] = own - (np.log(total) if np.isfinite(total).all() and total.all() else _log_sums(q[i:j] @ w[:, low:high]))
    return found


def token_logs(v: Vocabulary, outer: Outer, inner: list[np.ndarray], s: np.ndarray, choice: np.ndarray, context: np.ndarray, count: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Natural log of P(token | the two before it), of what symbols() says of the tokens. count: each token's count in the
    training texts."""
    p = outer.logs(s, *contexts(s, offsets, v.k)).astype(float)
    p += inner_logs(v, inner, choice, s, *contexts(context, offsets, v.k))
    rare = (s >= FREQUENT) & (context == s)
    p[rare] += np.log((count[rare] + 1) / v.rarer[s[rare] - FREQUENT])
    return p


def _places(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each of h stands in the sorted table."""
    order = np.argsort((h >> np.uint64(48)).astype(np.uint16), kind="stable")  # neighbours in the table are looked up together
    out = np.empty(len(h), np.int64)
    out[order] = np.searchsorted(table, h[order])
    return out


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SCORED_SQL = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _score(v: Vocabulary, outer: list[np.ndarray], inner: list[np.ndarray]):
    """Of rows in order of (block, whether they are texts): a block's totals, then its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, h, known, first = None, [], None, (), Outer(outer)
        for batch in batches:
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True):
                if at == to:
                    continue
                if blocks[at] != block:
                    block, parts, h = blocks[at], [], None
                rows = batch.slice(at, to - at)
                if not kinds[at]:
                    parts += [_read(r) for r in rows.select(["hashes", "counts", "kinds"]).to_pylist()]
                    continue
                if h is None:  # of each distinct word what a token needs is looked up once
                    h, c, k = (np.concatenate(x) for x in zip(*parts, strict=True))
                    order = np.argsort(h)
                    h, parts = h[order], []
                    known = (*v.symbols(h, k[order]), c[order])
                for part in slices([rows], size=_SCORED_BYTES):
                    t, _, offsets = _tokens(part.column(6), kinds=False)
                    at_t = _places(h, t)
                    s, choice, context, count = (x[at_t] for x in known)
                    p = token_logs(v, first, inner, s, choice, context, count, offsets)
                    base, starts = np.log10((count + 1) / (v.n + v.v + 1)), offsets[:-1]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(5),
                            part.column(7),
                            pa.array(np.diff(offsets)),
                            pa.array(np.add.reduceat((count > 0).astype(np.int64), starts)),
                            pa.array(np.full(part.num_rows, v.n)),
                            pa.array(np.add.reduceat(base, starts)),
                            pa.array(np.add.reduceat(p, starts) / np.log(10)),
                        ],
                        schema=_SCORED,
                    )

    return run


def _shaped(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    ends = np.cumsum([p.size for p in like])
    return [x.reshape(p.shape) for x, p in zip(np.split(flat, ends[:-1]), like, strict=True)]


def score(docs: DataFrame, held_out=None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs(doc_id, text, ...).

    Texts whose crc32 of doc_id mod 7 is 2 (or where the column held_out is true) are not learned from. Tokens are the
    words, A-Z lower-cased, and an end. base_score is the sum of log10 of add-one unigrams, score the model's log10 of
    the text. Null and empty texts are one token, the end. A null doc_id is not held out. Rows are scored each for
    itself, also where they repeat; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    held = F.coalesce((F.crc32(F.col("doc_id").cast("string")) % 7 == 2) if held_out is None else held_out, F.lit(False))
    pieces = partitions(spark)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(pieces)).cast("int")
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held.alias("held_out"), block.alias("block"))
    # train is a column of its own: the scan below prunes the rest
    dealt = base.select("text", "block", (~F.col("held_out")).alias("train")).repartition(pieces, "block")
    counted = stored(dealt.mapInArrow(freed(_count(pieces)), _COUNTED_SQL), "counted")
    size = counted.agg(F.coalesce(F.sum(F.octet_length("hashes") + F.octet_length("counts") + F.octet_length("kinds")), F.lit(0))).first()[0]
    groups = max(1, pieces // 8, min(pieces, -(-size // _TOGETHER)))
    totals = stored(counted.groupBy((F.col("part") % groups).alias("group")).applyInArrow(_total, _COUNTED_SQL), "totals")
    tops, sums = ([_read(r) for r in totals.where(f"block = {k}").collect()] for k in (-1, -3))
    least = floor(sum(int(c[0]) for _, c, _ in sums))
    above = [_read(r) for r in totals.where("block = -2").mapInArrow(_above(least), _COUNTED_SQL).collect()]
    v = Vocabulary(tops, above, sums)
    learned = base.where("not held_out").select("text").mapInArrow(freed(_learn(v)), _PARAMS_SQL)
    rows = learned.repartition(max(1, int(pieces**0.5)), "chunk").mapInArrow(_average, _PARAMS_SQL).collect()  # one set
    outer, inner = initial(v)
    if rows:
        data = {r.chunk: np.frombuffer(r.data, _kind(r.chunk)).astype(np.float32) for r in rows}
        outer, inner = (_shaped(np.concatenate([data[k] for k in range(at, at + CHUNKS)]), like) for at, like in ((0, outer), (CHUNKS, inner)))
    sent = totals.where("block >= 0").select("block", F.lit(False).alias("is_text"), "hashes", "counts", "kinds", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("held_out"))
    own = base.select("block", F.lit(True).alias("is_text"), *(F.lit(None).cast("binary").alias(c) for c in ("hashes", "counts", "kinds")), "doc_id", "text", "held_out")
    met = sent.unionByName(own).repartition(pieces, "block").sortWithinPartitions("block", "is_text")
    return met.mapInArrow(freed(_score(v, outer, inner)), _SCORED_SQL)
