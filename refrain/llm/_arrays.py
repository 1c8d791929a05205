"""Words and their hashes as numpy arrays over many texts at once."""

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once. A longer text is handled alone, whole.
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of words split at the six ASCII spaces, \x09-\x0D and \x20.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of words made of digits, letters a-z and all non-ASCII characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        size = max(n, 2 * SLICE_BYTES)
        for k, base in (("p", _P), ("i", _P_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers["p"], _powers["i"]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES, rows: int = 1 << 62) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows` rows and `size` bytes of text, or of one row."""
    for batch in batches:
        _, offsets = raw(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1))
            yield batch.slice(at, to - at)
            at = to


def release() -> None:
    """Gives memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same batches; after a task's last, its memory is released, as Spark keeps idle workers while later stages run."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return out


@dataclass
class Words:
    data: np.ndarray  # lower-cased bytes
    starts: np.ndarray  # of each word, in bytes
    ends: np.ndarray
    offsets: np.ndarray  # the words of text i are offsets[i]:offsets[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words: a polynomial in an odd base, from one running sum, then mixed."""
        n = len(self.data)
        if not len(self.starts):
            return np.empty(0, np.uint64)
        p, inverse = power(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * inverse[self.starts]
        return mix(h + np.uint64(0x632BE59BD9B4E019))


def words(column: pa.Array, table: np.ndarray = NOT_SPACE) -> Words:
    """The words of each text: the longest runs of bytes marked in `table`, after A-Z are lower-cased."""
    data, offsets = raw(column)
    data = _LOWER[data]
    inside = table[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def word_counts(column: pa.Array, table: np.ndarray = NOT_SPACE) -> np.ndarray:
    """The number of words() of each text, SLICE_BYTES of text at a time."""
    parts = [words(b.column(0), table).counts for b in slices([pa.RecordBatch.from_arrays([column], names=["text"])])]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def shingles(h: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted hashes of `width` consecutive words of each text, and their offsets. A text with fewer words,
    but not none, has one: its whole sequence."""
    rng = np.random.default_rng(width)
    odd = rng.integers(1, 1 << 63, size=width + 1, dtype=np.uint64) | np.uint64(1)
    counts, n = np.diff(offsets), len(h)
    runs = np.maximum(n - width + 1, 0)
    s = np.zeros(runs, np.uint64)
    for k in range(width):
        s += h[k : k + runs] * odd[k]
    s = mix(s)
    out, ends = [], np.zeros(len(counts) + 1, np.int64)
    for i, (a, c) in enumerate(zip(offsets[:-1].tolist(), counts.tolist(), strict=True)):
        if c >= width:
            part = s[a : a + c - width + 1]
            part.sort()
            out.append(part)
        elif c:
            out.append(mix((h[a : a + c] * odd[:c]).sum(dtype=np.uint64, keepdims=True) + odd[width] * np.uint64(c)))
        ends[i + 1] = ends[i] + (max(c - width + 1, 1) if c else 0)
    s = np.concatenate(out) if out else np.empty(0, np.uint64)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    new[ends[:-1][np.diff(ends) > 0]] = True
    kept = np.zeros(len(s) + 1, np.int64)
    np.cumsum(new, out=kept[1:])
    return s[new], kept[ends]
