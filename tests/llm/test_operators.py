"""Each operator against the definition itself, and over awkward rows: nulls, empty and very long texts, ties and repeated
rows, an empty table, and extra columns whose names clash."""

import base64
import hashlib
import itertools
import math
import random
import re
import time
import unicodedata
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from refrain.llm import components, decontamination, fingerprint, language_id, language_model, line_dedup, minhash, packing, token_counts, toxicity, warc
from refrain.llm._arrays import words
from refrain.sources.stages import stored

SCHEMA = "doc_id bigint, text string, n_words string, hits string, score string, k1 string, left string, fingerprint string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def cut(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def awkward():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = text(60)
    near = base.split()
    near[10] = "changed"
    rows = [(1, base), (2, base), (2, base), (3, " ".join(near)), (4, base.upper()), (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "one"), (10, "one two"), (None, base), (None, None)]
    rows += [(11, text(30_000)), (12, "x" * 200_000), (13, "a\nb\n\nb\n" + base + "\n" + base), (14, base + "\n" + text(5)), (15, "héllo wörld \x1c z")]
    rows += [(20 + i, text(rng.randint(1, 40))) for i in range(25)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


def test_words_are_those_of_the_pattern(rows):
    import pyarrow as pa

    w = words(pa.array([t for _, t in rows]))
    got = [[bytes(w.data[a:b]).decode() for a, b in zip(w.starts[x:y], w.ends[x:y], strict=True)] for x, y in itertools.pairwise(w.offsets)]
    assert got == [cut(t) for _, t in rows]
    flat = [x for g in got for x in g]
    assert len(set(zip(flat, w.hashes().tolist(), strict=True))) == len(set(flat)) == len(set(w.hashes().tolist()))


def test_a_task_gives_its_free_memory_back():
    from refrain.llm._arrays import freed

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    def run(batches):
        yield from batches
        parts = [np.ones(12_000) for _ in range(2000)]  # 192 MB in pieces that glibc keeps
        last.append(np.ones(12_000))
        yield len(parts)
        del parts
        held.append(resident())

    last, held = [], []
    assert list(freed(run)(iter([1, 2]))) == [1, 2, 2000]
    assert resident() < held[0] - (100 << 20)


# 1
def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        h = {rng.randint(1, 20): rng.randint(1, 9) for _ in range(rng.randint(1, 8))}
        k = rng.randint(1, 4)
        got = packing.boundaries(h, k)
        lengths = sorted(h)
        best = min(packing.padding(h, [*c, lengths[-1]]) for n in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], n))
        assert got == sorted(set(got)) and got[-1] == lengths[-1] and len(got) <= k and packing.padding(h, got) == best
    assert packing.boundaries({}, 3) == []


def test_packing(spark, rows):
    got = packing.pack(make(spark, rows), max_tokens=50, buckets=3, budget=120).collect()
    pieces = []
    for i, t in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        pieces += [(i, n, p, min(50, n - 50 * p)) for p in range(math.ceil(n / 50))]
    bounds = packing.boundaries(Counter(p[3] for p in pieces), 3)
    expected = []
    for low, b in zip([0, *bounds], bounds, strict=False):
        mine = sorted((p for p in pieces if low < p[3] <= b), key=lambda p: (p[0] is not None, p[0] or 0, p[1], p[2]))
        room = max(1, 120 // b)
        expected += [(i, p, 50 * p, n, b, k // room, k % room) for k, (i, _, p, n) in enumerate(mine)]
    key = lambda r: (r[4], r[5], r[6])
    assert [tuple(r)[3:] for r in sorted(got, key=key)] == [r[3:] for r in sorted(expected, key=key)]
    assert Counter(tuple(r) for r in got) == Counter(expected)
    assert packing.pack(make(spark, [])).count() == 0


# 2
def test_token_counts_are_the_library_s(spark, rows):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    parts = ["a", "b", "e", "th", "ing", " ", "  ", "\n", "\t", "'", "1", "▁", "é", "中", "文", "́", "\0", "<s>", "</s>", "<0x0A>", "ﬁ", "１", "𝄞", "\xa0", "the", "\r\n"]
    texts = [t for _, t in rows] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + ["ab" * 1500, "a" * 999, " " * 500, "a" * 100_001, " " * 100_000, "=-" * 500, "abc" * 300, "中" * 3000]
    texts += ["".join(rng.choices(x, k=n)) for x, n in (("abcdefghijklmnopqrstuvwxyz", 1_000_000), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 200_000), ("ab", 50_000), ("aeinrst", 100_000), (["the", "ing", "er", "a", "tion", "s"], 60_000))]
    texts += ["".join(rng.choices("etaoinshr", k=rng.randint(30, 200))) for _ in range(500)]
    got = {r.doc_id: r for r in token_counts.token_counts(make(spark, list(enumerate(texts))), limit=100).collect()}
    for i, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 100), (t or "")[:200]
    assert token_counts.token_counts(make(spark, [])).count() == 0


# 3
def exact_components(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = cut(t)
        mine = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(mine)
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in itertools.combinations(ids, 2):
        if any(a and b and den * len(a & b) >= num * len(a | b) for a in sets[x] for b in sets[y]):
            p, q = sorted((find(x), find(y)))
            parent[q] = p
    return sets, {i: find(i) for i in ids}


def test_near_duplicates(spark, rows):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    copies = []
    for k in range(60):  # copies with more and more edits: some link to the base, some only to each other, some to none
        t = list(base)
        for _ in range(rng.randint(0, 7)):
            t[rng.randrange(80)] = f"e{rng.randrange(1000)}"
        copies.append((100 + k, " ".join(t)))
    rows = rows + copies + [(300, rows[13][1] + " end")]  # of the longest text too
    assert len(rows[13][1].split()) == 30_000
    got = minhash.near_duplicates(make(spark, rows), width=3, similarity=0.85).collect()
    sets, of = exact_components(rows, 3, 85, 100)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(s)) for i, x in sets.items() for s in x)
    for r in got:
        assert r.component_id == of.get(r.doc_id) and r.kept == (r.doc_id is None or of[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(make(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(60)] + [(500, 501 + i) for i in range(50)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    got = components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


@pytest.mark.parametrize("run", [lambda d: minhash.near_duplicates(d, width=3, similarity=0.85), lambda d: line_dedup.dedup_lines(d, min_words=6), lambda d: components.components(d.selectExpr("doc_id AS u", "doc_id + 1 AS v"))])
def test_only_stages_that_are_read_stay(spark, run):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    files = lambda: {str(p) for p in shared.rglob("part-*")}
    texts = ["\n".join(f"w{(k + j if j == 9 * k % 80 else j) // 4} x{j}" for j in range(80)) for k in range(60)]
    before = files()
    out = run(make(spark, list(enumerate(texts))))
    left = files() - before
    assert left and left == {f.removeprefix("file://") for f in out.inputFiles()}
    assert out.count() >= 60


def test_stored_leaves_no_shuffle_files(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    places = [Path(d) for d in env.blockManager().diskBlockManager().localDirsString()]
    files = lambda: {p for d in places for p in d.rglob("shuffle_*.data")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, conf = files(), spark.conf.get(key)
    out = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    end = time.time() + 10
    while files() - before and time.time() < end:  # they go in the background
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(key) == conf
    assert sum(r["count"] for r in out.collect()) == 1000


# 4
def canon(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return re.sub(r"[\s\x1c-\x1f\x85]+", " ", t).strip(" ")


def test_fingerprints(spark, rows):
    rows = [*rows, (90, "Straße ﬁne Å"), (91, "STRASSE  fine　Å"), (92, "Å x"), (93, "Å x")]
    got = fingerprint.fingerprints(make(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(canon(r.text), set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)
    # buckets that collide are told apart by their bytes
    narrow = fingerprint.fingerprints(make(spark, rows), hashed=lambda c: F.pmod(F.length(c), F.lit(3)).cast("string")).collect()
    by = {}
    for r in narrow:
        by.setdefault(canon(r.text), set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)
    assert fingerprint.fingerprints(make(spark, [])).count() == 0


def check_edited(spark, rows):
    def h(t):
        return spark.sql("select xxhash64(:t) as h", args={"t": t}).first().h

    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), h(r[1]) if r[0] is None else 0, r[1].encode()))
    expected = Counter()
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        expected[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canon(t) == canon(edited)), float(canon(t) == canon(after))] += 1
    got = fingerprint.compared(make(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == expected
    assert all((r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1) for r in got)


def test_edited_texts(spark, rows):
    """Null and repeated doc_ids too."""
    check_edited(spark, [*rows, (2, "Copy of a copy"), (0, "copy  OF a copy"), (None, "null id"), (None, "NULL  id")])
    check_edited(spark, [(3, "abc def")])
    check_edited(spark, [(None, f"t{i % 5}") for i in range(12)])
    check_edited(spark, [(i % 3, f"{'t' * (i % 7)} {i}") for i in range(40)])
    assert fingerprint.compared(make(spark, [])).count() == 0


# 5
def dedup_by_definition(rows, least):
    order = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None})
    seen, gone, lines_of = set(), {}, {}
    for has, i, t in order:
        lines = [x for x in t.split("\n") if cut(x)]
        lines_of[has, i, t] = lines
        mine = gone[has, i, t] = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(lines[a:b])
                if run in seen and sum(len(cut(x)) for x in run) >= least:
                    mine.update(range(a, b))
                seen.add(run)
    return lines_of, gone


def test_line_dedup(spark):
    rng = random.Random(6)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(40)]
    rows += [(50, "x y\n\n \nz z\nx y"), (51, "x y\nz z\nx y"), (52, None), (53, ""), (54, "\n".join(["r r"] * 40)), (None, "x y\nz z"), (55, rows[3][1]), (55, rows[3][1]), (56, rows[4][1] + "\r"), (57, "q " * 50_000)]
    for least in (1, 6, 12):
        got = line_dedup.dedup_lines(make(spark, rows), min_words=least).collect()
        lines_of, gone = dedup_by_definition(rows, least)
        assert len(got) == len(rows)
        before = dict(Counter(rows))
        source = {}
        for i, t in before:
            source.setdefault(i, []).append(t)
        for r in got:
            t = next(t for t in source[r.doc_id] if (t is None) == (r.text is None) and (t is None or r.n_lines == len(lines_of[r.doc_id is not None, r.doc_id or 0, t])))
            if t is None:
                assert (r.n_lines, r.n_deleted) == (0, 0)
                continue
            key = (r.doc_id is not None, r.doc_id or 0, t)
            assert r.n_deleted == len(gone[key]), (least, r.doc_id)
            assert [x for x in r.text.split("\n") if cut(x)] == [x for k, x in enumerate(lines_of[key]) if k not in gone[key]]
            assert r.k1 == "x"
            if not gone[key]:
                assert r.text == t
    assert line_dedup.dedup_lines(make(spark, [])).count() == 0


# 6
def test_language_model(spark, rows):
    rng = random.Random(8)
    pairs = {"the": "cat", "cat": "sat", "sat": "on", "on": "the"}
    more = []
    for i in range(200, 500):
        w = [rng.choice(list(pairs))]
        for _ in range(80):
            w.append(pairs[w[-1]] if rng.random() < 0.9 else rng.choice([*pairs, f"r{rng.randrange(50)}"]))
            if w[-1] not in pairs:
                w.append(rng.choice(list(pairs)))
        more.append((i, " ".join(w)))
    all_rows = rows + more
    got = language_model.score(make(spark, all_rows)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in all_rows if not held(i) for w in [*cut(t), None])
    n, v = sum(c.values()), len(c)
    expected = Counter((i, held(i), len(cut(t)) + 1, sum(c[w] > 0 for w in [*cut(t), None]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*cut(t), None]), 3)) for i, t in all_rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == expected
    new = [r for r in got if r.held_out and r.doc_id >= 200]
    assert new and sum(r.score for r in new) > 0.8 * sum(r.base_score for r in new)
    assert language_model.score(make(spark, [])).count() == 0


def lm_vocabulary():
    """900 words, each commoner than the end, of which 600 lie in 7 kinds; and some counted once."""
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(1, 1 << 63, 1000).astype(np.uint64))[:900]
    c, k = rng.integers(40, 400, 900), (rng.integers(0, 7, 900) * 256 + rng.integers(0, 256, 900)).astype(np.uint16)
    h, c, k = np.append(h, language_model.END), np.append(c, 3), np.append(k, np.uint16(0))
    kinds, inverse = np.unique(k, return_inverse=True)
    sums = np.bincount(inverse, weights=c + 1.0).astype(np.int64)
    return h, c, k, language_model.Vocabulary([(h, c, k)], [(h, c, k)], [(h[:0], np.concatenate(([c.sum(), len(h)], sums)), kinds)])


def test_language_model_keeps_the_end():
    import pyarrow as pa

    h, c, k, v = lm_vocabulary()
    assert language_model.END in v.frequent and len(v.frequent) == language_model.FREQUENT
    t = pa.Table.from_batches([language_model._row(0, b, h, c, k) for b in (4, 9)])
    rows = {r["block"]: language_model._read(r) for r in language_model._total(t).to_pylist()}
    assert language_model.END in rows[-1][0] and (np.sort(rows[4][1]) == np.sort(2 * c)).all() and rows[-3][1][0] == 2 * c.sum()


def test_language_model_gradients():
    """The gradients of both softmaxes against finite differences of the loss."""
    rng = np.random.default_rng(0)
    params = [rng.normal(0, 0.7, shape) for shape in ((9, 4), (9, 4), (6, 4), (6,))]
    y, a, b = rng.integers(0, 6, 20), rng.integers(0, 9, 20), rng.integers(0, 9, 20)
    log_noise = rng.normal(0, 1, 6)
    soft = lambda x: np.logaddexp(0, x)
    for noise in (rng.integers(0, 6, 5), rng.integers(0, 6, (20, 3))):

        def loss(p, noise=noise):
            q = p[0][a] + p[1][b]
            d = lambda i: (q * p[2][i]).sum(axis=1) + p[3][i] - log_noise[i]
            drawn = np.broadcast_to(noise, (20, noise.shape[-1]))
            return np.mean(soft(-d(y)) + sum(soft(d(drawn[:, j])) for j in range(drawn.shape[1])))

        found = language_model.gradients(params, y, a, b, noise, log_noise)
        for i, (rows, grad) in enumerate(found):
            full = np.zeros_like(params[i])
            full[rows] = grad
            for at in np.ndindex(params[i].shape):
                ends = []
                for step in (1e-5, -1e-5):
                    p = [x.copy() for x in params]
                    p[i][at] += step
                    ends.append(loss(p))
                assert abs((ends[0] - ends[1]) / 2e-5 - full[at]) < 1e-6


def test_language_model_scores_by_definition():
    """Each token's probability against plain softmaxes; those of all tokens in a context add up to 1; training helps."""
    h, c, k, v = lm_vocabulary()
    rng = np.random.default_rng(1)
    outer, inner = ([rng.normal(0, 0.5, p.shape).astype(np.float32) for p in group] for group in language_model.initial(v))
    h, c, k = np.append(h, np.arange(1, 5).astype(np.uint64)), np.append(c, [1, 1, 0, 0]), np.append(k, np.array([300, 5, 300, 6], np.uint16))
    order = rng.integers(0, len(h), 300)
    offsets = np.array([0, 120, 121, 300])
    symbol, choice, context = v.symbols(h, k)
    got = language_model.token_logs(v, language_model.Outer(outer), inner, symbol[order], choice[order], context[order], c[order], offsets)
    table = np.sort(h)
    assert (table[language_model._places(table, h[order])] == h[order]).all()

    def chances(p, low, high, one, two):
        x = (p[2][low:high].astype(float) @ (p[0][one] + p[1][two]).astype(float)) + p[3][low:high]
        e = np.exp(x - x.max())
        return e / e.sum()

    def chance(token, before):
        one, two = [x[0] for x in before], [x[1] for x in before]
        p = chances(outer, 0, v.k, one[0], two[0])[symbol[token]]
        if symbol[token] >= language_model.FREQUENT:
            f = symbol[token] - language_model.FREQUENT
            p *= chances(inner, v.first[f], v.first[f + 1], one[1], two[1])[choice[token] - v.first[f]]
            if context[token] == symbol[token]:
                p *= (c[token] + 1) / v.rarer[f]
        return p

    for a, b in zip(offsets, offsets[1:], strict=False):
        for i in range(a, b):
            before = [tuple(x[order[i - n]] if i - n >= a else v.k for n in (1, 2)) for x in (symbol, context)]
            assert abs(np.log(chance(order[i], before)) - got[i]) < 1e-3
    for f in (0, 1, 6, 9):
        assert abs(np.exp(language_model.inner_logs(v, inner, np.arange(v.first[f], v.first[f + 1]), *(np.full(v.first[f + 1] - v.first[f], x) for x in (f + language_model.FREQUENT, 900, 3)))).sum() - 1) < 1e-5

    words_ = np.flatnonzero((context != symbol) & (symbol >= language_model.FREQUENT))[:100]
    near = rng.integers(0, 100, 60_000)
    near[1::2] = (near[::2] * 7 + 3) % 100
    tokens = words_[near]
    ends = np.array([0, len(tokens)])
    start, params = language_model.initial(v), language_model.initial(v)
    language_model.train(v, *params, tuple([np.zeros_like(p) for p in g] for g in params), h[tokens], k[tokens], ends, rng)
    mean = lambda p: language_model.token_logs(v, language_model.Outer(p[0]), p[1], symbol[tokens], choice[tokens], context[tokens], c[tokens], ends)[1::2].mean()
    assert mean(params) > mean(start) + 0.5
    assert language_model.floor(100_000_000) == 200 and language_model.floor(0) == 2


@pytest.mark.parametrize("scale", [1, 300])  # exp() of the greater scores is beyond 32 bits
def test_language_model_normalises_classes_in_a_small_place(scale):
    import tracemalloc
    from types import SimpleNamespace

    rng = np.random.default_rng(3)
    first = np.array([0, 3000, 3001, 3500])
    near, far, out = (rng.normal(0, 1, (n, 8)).astype(np.float32) for n in (900, 900, 3500))
    params = [near * np.float32(scale), far, out, rng.normal(0, 1, 3500).astype(np.float32)]
    s = rng.integers(0, 4, 2000)
    choice = np.where(s < 3, rng.integers(first[np.minimum(s, 2)], first[np.minimum(s, 2) + 1]), -1)
    s = np.where(s < 3, s + language_model.FREQUENT, 5)
    one, two = rng.integers(0, 900, (2, 2000))
    tracemalloc.start()
    got = language_model.inner_logs(SimpleNamespace(first=first), params, choice, s, one, two)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert scale > 1 or peak < 1 << 20
    for i in range(0, 2000, 7):
        low, high = (first[s[i] - language_model.FREQUENT + k] for k in (0, 1)) if choice[i] >= 0 else (0, 1)
        x = (params[0][one[i]].astype(float) + far[two[i]]) @ out[low:high].T.astype(float) + params[3][low:high]
        expected = x[choice[i] - low] - x.max() - np.log(np.exp(x - x.max()).sum()) if choice[i] >= 0 else 0
        assert got[i] == pytest.approx(expected, abs=1e-3 * scale)


# 7
ITEMS = [(1, "Alpha beta gamma, delta"), (2, "beta GAMMA"), (3, None), (4, "..."), (None, "alpha beta"), (5, "the the the the"), (6, "alpha beta gamma"), (6, "alpha beta gamma")]


def test_decontamination(spark, rows):
    rows = [*rows, (60, "x alpha-beta: Gamma! delta the the the the the"), (61, "beta gamma"), (62, "alpha beta"), (63, "alpha beta gamma"), (64, "gamma beta x alpha")]
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for width in (3, 10):
        expected = decontamination.brute_force([t for _, t in rows], ITEMS, width)
        for limit in (decontamination.BLOCK_TERMS, 20):  # one block, and several
            found = decontamination.decontaminate(make(spark, rows), bench, width, limit)
            assert found.where("k1 = 'x'").count() == len(rows)
            got = decontamination.digest(found).collect()
            assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == Counter((i, *x, x[1] > 0) for (i, _), x in zip(rows, expected, strict=True))
    assert decontamination.decontaminate(make(spark, []), bench).count() == 0
    assert decontamination.decontaminate(make(spark, rows), bench.limit(0)).where("size(hits) > 0").count() == 0


def test_words_are_counted_in_slices_of_arrays(spark, rows):
    import tracemalloc

    import pyarrow as pa

    from refrain.llm._arrays import ALNUM, word_counts

    texts = [t for _, t in rows]
    assert word_counts(pa.array(texts), ALNUM).tolist() == [x[0] for x in decontamination.brute_force(texts, [], 10)]
    assert not len(word_counts(pa.array([], pa.string())))
    column = pa.array(["a bc, d " * 1000] * 4000)  # 32 MB
    tracemalloc.start()
    assert set(word_counts(column, ALNUM).tolist()) == {3000}
    assert tracemalloc.get_traced_memory()[1] < 32 << 20
    tracemalloc.stop()
    found = decontamination.decontaminate(make(spark, rows), spark.createDataFrame(ITEMS, "item_id bigint, text string"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan(found) and "ArrowEvalPython" in plan(found) and "ArrowEvalPython" not in plan(found.select("hits"))


def near_by_definition(docs, items, width, span):
    """Documents and items of which some word of a window has all the window's words within `span` of it."""
    out = set()
    for i, t in docs:
        a = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        for item, text in items:
            b = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
            for at in range(max(1, len(b) - width + 1) if b and item is not None else 0):
                need = Counter(b[at : at + width])
                count = {w: sum(x == w for x in a) for w in need}
                rare = [w for w in need if count[w] == min(count.values())]
                for p, w in enumerate(a):
                    if w in need and not need - Counter(a[max(0, p - span) : p + span + 1]):
                        out.add((i, str(item), p, w in rare))
    return out


def test_proximity(spark):
    docs = [(1, "gamma x alpha y beta"), (2, "alpha beta"), (3, "alpha beta" + " z" * 50 + " gamma"), (4, None), (None, "beta gamma alpha")]
    bench = spark.createDataFrame([(6, "alpha beta gamma", "x")], "item_id bigint, text string, hits string")
    assert {r.doc_id for r in decontamination.proximity(make(spark, docs), bench, span=5).collect()} == {1, None}
    assert decontamination.proximity(make(spark, []), bench).count() == 0 and decontamination.proximity(make(spark, docs), bench.limit(0)).count() == 0
    rng = random.Random(4)
    items = [(k, " ".join(rng.choices("abcdef", k=rng.randint(1, 7)))) for k in range(8)]
    for doc in ([(1, " ".join(rng.choices("abcdefghij", k=200)))], [(2, " ".join(rng.choices("abcdefgh", k=30)))]):  # one document is one shard
        expected = near_by_definition(doc, items, 4, 3)
        got = {tuple(r) for r in decontamination.proximity(make(spark, doc), spark.createDataFrame(items, "item_id bigint, text string"), 4, 3, block_terms=60).collect()}
        assert got <= {x[:3] for x in expected} and {x[:2] for x in got} <= {x[:2] for x in expected}
        assert all(any(g[:2] == (i, k) for g in got) for i, k, p, rarest in expected if rarest)


# 8
def subwords_by_definition(word):
    """Table places of a word's n-grams of 3 to 5 bytes, with a mark on both sides, and of the word."""
    over, odd = 1 << 64, 0x9E3779B97F4A7C15
    marked = [1, *word.encode(), 2]

    def place(part, salt):
        h = (sum((b + 1) * pow(odd, i, over) for i, b in enumerate(part)) + salt) % over
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> shift) * times % over
        return (h ^ h >> 31) % toxicity.BUCKETS

    return [place(marked[i : i + n], n) for n in (3, 4, 5) for i in range(len(marked) - n + 1)] + [place(marked, 99)]


def toxic_words(text):
    return re.findall(r"[^\x00-\x23\x25-\x26\x28-\x29\x2B-\x2F\x3A-\x3F\x41-\x60\x7B-\x7F]+", lower(text))


def test_toxicity_scores_by_definition(spark):
    texts = ["a Bad b@d wörd", "", None, "!!", "x", "it's $uch a *long* word " * 30, "A" * 40]
    numbers = np.random.default_rng(2).normal(0, 3, toxicity.BUCKETS).astype(np.float32)
    got = {r.doc_id: r.score for r in toxicity.score(make(spark, list(enumerate(texts))), (numbers, -0.4)).collect()}
    for i, t in enumerate(texts):
        means = [np.mean([numbers[p] for p in subwords_by_definition(w)]) for w in toxic_words(t)]
        assert abs(got[i] - 1 / (1 + math.exp(0.4 - (float(np.mean(means)) if means else 0)))) < 1e-5


def test_toxicity_gradients():
    """The loss against its definition, the gradients against its finite differences."""
    texts, labels, weights = ["ab bad ab", "", "nice one", "b@d"], np.array([1, 0, 0, 1]), np.array([1.0, 2.0, 1.0, 3.0])
    rng = np.random.default_rng(5)
    params = [rng.normal(0, 1, (toxicity.BUCKETS, 3)), rng.normal(0, 1, (3, 2)), rng.normal(0, 1, 2)]

    def loss(table, soft, bias):
        total = 0
        for t, y, w in zip(texts, labels, weights / weights.sum(), strict=True):
            vectors = [np.mean([table[p] for p in subwords_by_definition(x)], axis=0) for x in toxic_words(t)]
            z = (np.mean(vectors, axis=0) if vectors else np.zeros(3)) @ soft + bias
            total -= w * (z[y] - np.log(np.exp(z).sum()))
        return total

    found, rows, *grads = toxicity.Batch(texts, labels, weights).gradients(*params)
    assert abs(found - loss(*params)) < 1e-6
    assert set(rows.tolist()) == {p for t in texts for w in toxic_words(t) for p in subwords_by_definition(w)}
    for i, grad in enumerate(grads):
        for at in list(np.ndindex(grad.shape))[:40]:
            where = (rows[at[0]], at[1]) if i == 0 else at
            ends = []
            for step in (1e-5, -1e-5):
                p = [x.copy() for x in params]
                p[i][where] += step
                ends.append(loss(*p))
            assert abs((ends[0] - ends[1]) / 2e-5 - grad[at]) < 1e-6


def test_toxicity(spark):
    rng = random.Random(9)
    syllables = ["ta", "re", "mi", "so", "lu", "ke", "na", "vo"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(3))
    texts, labels = [], []
    for i in range(600):
        t = [word() for _ in range(rng.randint(10, 60))]
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                t[rng.randrange(len(t))] = rng.choice(["scumbag", "worthless", "pathetic"])
        texts.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    docs = make(spark, [*texts, (1000, None), (1001, ""), (None, "x")])
    truth = spark.createDataFrame([*labels, (3, None), (None, 1), (3, 1)], "doc_id bigint, toxic int")
    held = toxicity.held_out(F.col("doc_id"))
    model = toxicity.train(docs, truth.where(~held))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    test = [r for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in test) >= 0.95 * len(test)
    unseen = toxicity.score(make(spark, [(1, " ".join([word() for _ in range(20)] + ["scumbagz", "worthles", "patheticc"])), (2, " ".join(word() for _ in range(23)))]), model).collect()
    assert {r.doc_id: r.predicted for r in unseen} == {1: 1, 2: 0}
    few = toxicity.train(docs, truth.where(~held), max_bytes=20_000)  # about 55 texts of each label
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, few).collect())
    none = toxicity.train(docs, truth.limit(0))
    assert toxicity.score(docs, none).where("predicted <> 0").count() == 0
    assert toxicity.score(make(spark, []), model).count() == 0


# 9
def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b/\r\nX: y", ""), (4, "u", None), (5, "u", "x" * 300_000), (6, "u", "a\r\n\r\nWARC/1.1\r\n"), (None, "u", "only"), (7, "u", "same"), (7, "u", "same"), (8, "u", "WARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\n")]
    hostile = [f"http://a/{c}{f}" for c in ("\u2028", "\u2029", "\x85", "\n", "\r", "\r\n", "\x0b", "\x00") for f in ("WARC-Refers-To: <urn:page:99>", "WARC-Payload-Digest: sha1:AAAA", "\r\n\r\nWARC-Type: revisit")]
    pages += [(20 + i, u, f"p{i}") for i, u in enumerate(hostile)] + [(100 + i, "u", "hot " * 500) for i in range(60)] + [(-5, "u", "minus"), (-9, "u", "minus")]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id bigint, url string, html string, digest string, payload string")
    path = f"file://{tmp_path}/archive"
    for least, to in ((0, path), (5, path + "5")):
        warc.write(df, to, least)
        got = warc.index(spark, to).collect()
        expected = []
        for i, _, h in pages:
            data = (h or "").encode()
            same = [p[0] for p in pages if (p[2] or "") == (h or "") and p[0] is not None]
            revisit = i is not None and i != max(same) and len(data) >= least
            expected.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", max(same) if revisit else None))
        assert Counter(tuple(r) for r in got) == Counter(expected)
    back = warc.reconstruct(spark, path).collect()
    assert Counter((r.page_id, bytes(r.payload)) for r in back) == Counter((i, (h or "").encode()) for i, _, h in pages)
    for r in back:
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        size = int(fields[b"Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and body[size:] == b"\r\n\r\n"
        http, payload = body[:size].split(b"\r\n\r\n", 1)
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and payload == (bytes(r.payload) if fields[b"WARC-Type"] == b"response" else b"")
        assert {b"WARC-Record-ID", b"WARC-Date", b"WARC-Target-URI", b"Content-Type"} <= set(fields) and not re.search(r"[\x00-\x1f\x7f-\x9f\u2028\u2029]", fields[b"WARC-Target-URI"].decode())
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len({(h or "") for _, _, h in pages})
    warc.export(spark, path, f"file://{tmp_path}/out")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert raw.count(b"WARC/1.1\r\nWARC-Type: ") == len(pages)
    stored.limit(1).select(F.lit("0" * 64).alias("digest"), "payload").write.mode("append").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read(spark, path)[1].collect()
    warc.write(df.limit(0), path + "0")
    assert warc.index(spark, path + "0").count() == 0


# 10
def test_language_vectors_by_definition():
    """Bound and bundled letter by letter: of each word, with an edge on both sides, every three neighbours."""
    texts = ["Abc a'é", None, "", "x  ÉCole\nab", "7 ?"]
    got, letters = language_id.vectors(texts, 7)
    edge = np.ones(language_id.DIMENSIONS, int)
    for i, t in enumerate(texts):
        v = np.zeros(language_id.DIMENSIONS, int)
        ws = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        for w in ws:
            marked = [edge, *(language_id._vector(ord(c), 7).astype(int) for c in w), edge]
            for x, y, z in zip(marked, marked[1:], marked[2:], strict=False):
                v += np.roll(x, 2) * np.roll(y, 1) * z
        assert (got[i] == v).all() and letters[i] == sum(map(len, ws))


def test_language_by_definition(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("abc " if i % 2 else "xyz a", k=40)), ["p", "q"][i % 2]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    v, _ = language_id.vectors([t for _, t, _ in rows], 7)
    unit = lambda x: x / np.linalg.norm(x)
    p = [unit(sum(x.astype(float) for x, r in zip(v, rows, strict=True) if r[2] == k)) for k in "pq"]
    model = language_id.profiles(docs)
    assert all(np.allclose(unit(model[k]), x) for k, x in zip("pq", p, strict=True))
    centre = sum(p) / 2
    for r in language_id.identify(docs, model).collect():
        cosine = [unit(unit(v[r.doc_id].astype(float)) - centre) @ unit(x - centre) for x in p]
        assert r.lang_pred == "pq"[int(np.argmax(cosine))] and abs(r.score - max(0, max(cosine))) < 1e-5


def test_language_id(spark):
    rng = random.Random(10)
    kinds = {"aa": ["the", "ing", "tion", "and"], "bb": ["der", "sch", "ung", "ich"], "cc": ["que", "eau", "elle", "ré"]}
    text = lambda k, n: " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(k, rng.randint(5, 60)), k) for i, k in enumerate(rng.choices(list(kinds), k=300))]
    rows += [(400, None, "aa"), (401, "", "aa"), (402, "12 !? ½", "bb"), (403, text("aa", 20_000), "aa"), (404, text("bb", 9), None), (None, text("cc", 9), "cc")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, lang string, score string, lang_pred string")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language_id.profiles(docs.where(~held))
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (400, 401, 402))
    test = [(i, k) for i, _, k in rows[:300] if language_id.held_out(i, 4, 2)]
    assert sum(got[i].lang_pred == k for i, k in test) >= 0.98 * len(test)
    assert got[404].lang_pred == "bb" and got[None].lang_pred == "cc" and got[403].lang_pred == "aa"
    again = language_id.profiles(docs.where(~held).repartition(7))
    assert all((model[k] == again[k]).all() for k in model)
    assert language_id.identify(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(docs.limit(0), model).count() == 0
