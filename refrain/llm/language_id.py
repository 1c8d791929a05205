"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors, each rotated by
its distance from the end; a text's vector bundles (adds) those of all its n-grams; a language's prototype bundles its
training texts. A text gets the language whose prototype has the largest cosine with it. Prototypes are centred
on their mean, without which the letters that all languages share dominate every cosine.
"""

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import freed, slices

DIMENSIONS, N = 1024, 3
UNKNOWN = "und"
#: Training texts for each language, in expectation; chosen by a hash of doc_id.
MAX_TRAIN = 5000
#: A text of so many letters whose cosine with every prototype, not centred, is below MIN_COSINE is in none of the languages.
#: The cosine of unrelated vectors has a standard deviation of 1 / sqrt(DIMENSIONS), 0.031, whatever the text's length; in fewer
#: letters a language's own texts come as low.
MIN_LETTERS, MIN_COSINE = 30, 0.14
#: Texts handled at once, and n-grams multiplied at once: their counts are one array of that many numbers.
_ROWS, _GRAMS = 512, 2048
#: Letters up to which n-gram numbers are counted in one dense array.
_DENSE = 96


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@functools.lru_cache(100_000)
def _vector(code: int, seed: int) -> np.ndarray:
    return (np.random.default_rng([seed, code]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1).astype(np.int8)


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters that occur; number of each n-gram in base (letters + 1), 0 for a word's edge; text of each; letters of each text."""
    texts = [(t or "").lower() for t in texts]
    joined = " " + " ".join(texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    owner = np.repeat(np.arange(len(texts)), sizes)
    owner = np.concatenate(([0], owner))[: len(codes)] if len(texts) else np.zeros(len(codes), np.int64)
    letter = _letters()[codes]
    keep = letter.copy()
    keep[:-1] |= letter[1:]  # one separator before each word, one after the last
    keep[-1] = True
    codes, letter, owner = np.where(letter, codes, 0)[keep], letter[keep], owner[keep]
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    seen[0] = False
    alphabet = np.flatnonzero(seen)
    number = np.zeros(0x110000, np.int64)
    number[alphabet] = np.arange(1, len(alphabet) + 1)
    x = number[codes]
    base = len(alphabet) + 1
    middle = np.flatnonzero(letter[1:-1]) + 1
    gram = (x[middle - 1] * base + x[middle]) * base + x[middle + 1]
    return alphabet, gram, owner[middle], np.bincount(owner[letter], minlength=len(texts))


def vectors(texts: list[str | None], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hypervectors of the texts, and their numbers of letters."""
    alphabet, gram, owner, letters = _grams(texts)
    base = len(alphabet) + 1
    if base <= _DENSE:
        used = np.flatnonzero(np.bincount(gram, minlength=1))
        place = np.zeros(base**3, np.int64)
        place[used] = np.arange(len(used))
        which = place[gram] if len(gram) else gram
    else:
        used, which = np.unique(gram, return_inverse=True)
    atoms = np.stack([np.ones(DIMENSIONS, np.int8), *(_vector(int(c), seed) for c in alphabet)])
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for at in range(0, len(used), _GRAMS):
        part = used[at : at + _GRAMS]
        bound = np.roll(atoms, 2, axis=1)[part // base**2] * np.roll(atoms, 1, axis=1)[part // base % base] * atoms[part % base]
        inside = (which >= at) & (which < at + len(part))
        counts = np.bincount(owner[inside] * len(part) + which[inside] - at, minlength=len(texts) * len(part)).reshape(len(texts), len(part))
        out += counts.astype(np.float32) @ bound.astype(np.float32)
    return out, letters


def profiles(labelled: DataFrame, max_train: int = MAX_TRAIN, seed: int = 7) -> dict[str, np.ndarray]:
    """Prototype of each language in labelled(doc_id, text, lang): sums of whole numbers, so the same however rows are dealt.
    At most about max_train texts of a language, chosen by a hash of doc_id, are bundled."""
    counts = {r.lang: r["count"] for r in labelled.where("lang is not null").groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, max_train / n))).otherwise(share)
    chosen = labelled.where("lang is not null").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, rows=_ROWS):
            langs = np.array(batch.column(1).to_pylist(), object)
            v, _ = vectors(batch.column(0).to_pylist(), seed)
            for lang in set(langs):
                total[lang] = total.get(lang, 0) + v[langs == lang].sum(axis=0, dtype=np.float64)
        yield pa.RecordBatch.from_pydict({"lang": list(total), "v": [v.tobytes() for v in total.values()]}, schema=pa.schema([("lang", pa.string()), ("v", pa.binary())]))

    def add(table: pa.Table) -> pa.Table:
        v = sum(np.frombuffer(x, np.float64) for x in table.column("v").to_pylist())
        return pa.table({"lang": table.column("lang").slice(0, 1), "v": pa.array([v.tobytes()], pa.binary())})

    rows = chosen.select("text", "lang").mapInArrow(freed(run), "lang string, v binary").groupBy("lang").applyInArrow(add, "lang string, v binary").collect()
    return {r.lang: np.frombuffer(r.v, np.float64) for r in sorted(rows, key=lambda r: r.lang)}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], seed: int = 7) -> DataFrame:
    """All rows and columns of docs(text, ...) with lang_pred, score (0 to 1) and in_none.

    Null texts, and texts without a letter, are `und` with score 0, as are all texts if there are no prototypes. Of
    equal cosines the language first in alphabetical order wins. in_none is true of `und`, and of texts of MIN_LETTERS letters
    and more whose cosine with every prototype is below MIN_COSINE; for it nothing is centred, as the best of the centred
    cosines is never below 0. Columns lang_pred, score and in_none of docs are replaced.
    """
    names = sorted(k for k in prototypes if np.abs(prototypes[k]).sum() > 0)
    p = np.stack([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]) if names else np.zeros((0, DIMENSIONS))
    centre = p.mean(axis=0) if len(names) > 1 else np.zeros(DIMENSIONS)
    q = p - centre
    norms = np.linalg.norm(q, axis=1, keepdims=True)
    q = (q / np.where(norms == 0, 1, norms)).astype(np.float32)
    centre, p = centre.astype(np.float32), p.astype(np.float32)
    docs = docs.drop("lang_pred", "score", "in_none").select("*", F.lit(None).cast("string").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("in_none"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=_ROWS):
            v, letters = vectors(batch.column(batch.schema.get_field_index("text")).to_pylist(), seed)
            pred, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            none = np.ones(batch.num_rows, bool)
            if names:
                size = np.linalg.norm(v, axis=1, keepdims=True)
                v = v / np.where(size == 0, 1, size)
                none = (letters == 0) | ((letters >= MIN_LETTERS) & ((v @ p.T).max(axis=1) < MIN_COSINE))
                v = v - centre
                size = np.linalg.norm(v, axis=1, keepdims=True)
                cosine = (v / np.where(size == 0, 1, size)) @ q.T
                best = cosine.argmax(axis=1)
                known = letters > 0
                pred[known] = np.array(names, object)[best[known]]
                score[known] = np.clip(cosine[np.arange(len(best)), best][known].astype(float), 0, 1)
            cols = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score), "in_none": pa.array(none)}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(freed(run), docs.schema)


def held_out(doc_id: object, parts: int, remainder: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % parts == remainder
