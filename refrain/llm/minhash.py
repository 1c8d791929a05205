"""Near-duplicate documents: many universal hash minima with banding, signature verification on full sets, and
connected components.

A document's set has the distinct shingles of its words, as 64-bit hashes. Documents with equal sets are one node, so
copies cost nothing after that. `bands * rows` minima give `bands` keys a node. Each bucket of
equal keys has a centre, the node with the most company in all its buckets. The nodes around a centre are
  1. compared with the centre: what passes is linked;
  2. where they lie in different components by then, compared with each other, those outside the largest component
     against all. That goes in cells of LEFT by RIGHT nodes, spread over the cluster: first by sketches of 256 bits
     of the minima, which rule out pairs far below the threshold (six standard deviations at it) and so most nodes,
     then on full sets, in cells bounded by shingles too. A cell returns the links found, never its pairs. The cells
     of one centre grow with the square of its nodes outside the largest component.
Nodes around a large centre are dealt over seats of NEAR nodes, on average, and what belongs to the centre goes to each
seat, so that no task gets them all. So no bucket is expanded into rows for all pairs and none is capped, and each pair that shares a bucket is decided, by its sketches or on full sets.
With 42 bands of 6 rows a pair with a likeness of 0.85 shares no bucket once in 4e8 pairs, and less often above that.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrays import freed, mix, shingles, slices, words
from ._shared import done, stored
from .components import components

BANDS, ROWS, SKETCH_LONGS = 42, 6, 4
#: Nodes on the two sides of a cell.
LEFT, RIGHT = 256, 1024
#: Shingles on the two sides of a cell that holds texts, on average.
LEFT_SHINGLES, RIGHT_SHINGLES = 1 << 17, 1 << 19
#: Nodes around a centre for each of its seats.
NEAR = 256
#: Shingles hashed at once, so that the work arrays stay in a CPU's cache.
_CHUNK = 1 << 15
_SIGNATURES = f"doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, {', '.join(f's{i} bigint' for i in range(SKETCH_LONGS))}"


def _minima(sets: np.ndarray, offsets: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k minima of each non-empty set under k universal hash functions a * x + b mod 2^32."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 32, size=k, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, size=k, dtype=np.uint32)
    n = len(offsets) - 1
    out = np.full((k, n), 0xFFFFFFFF, np.uint32)
    x = (sets >> np.uint64(32)).astype(np.uint32)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK, "right")) - 1)
        part, starts = x[offsets[at] : offsets[to]], offsets[at:to] - offsets[at]
        y = np.empty_like(part)
        for i in range(k):
            np.multiply(part, a[i], out=y)
            np.add(y, b[i], out=y)
            out[i, at:to] = np.minimum.reduceat(y, starts)
        at = to
    return out.T


def _signatures(width: int, bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = words(batch.column(1))
            sets, offsets = shingles(w.hashes(), w.offsets, width)
            sizes = np.diff(offsets)
            full = np.flatnonzero(sizes)
            n = batch.num_rows
            digests = np.zeros((2, n), np.uint64)
            keys, sketch = np.zeros((n, bands), np.uint64), np.zeros((n, SKETCH_LONGS), np.int64)
            if len(full):
                starts = offsets[:-1][full]
                for i, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
                    digests[i, full] = np.add.reduceat(mix(sets ^ np.uint64(salt)), starts)
                m = _minima(sets, np.append(starts, len(sets)), bands * rows, seed)
                key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), (len(full), bands)).copy()
                for r in range(rows):
                    key = mix(key ^ m[:, r::rows].astype(np.uint64))
                keys[full] = key
                bits = np.zeros((len(full), 64 * SKETCH_LONGS), np.uint8)
                used = min(bands * rows, bits.shape[1])
                bits[:, :used] = (m[:, :used] * np.uint32(0x9E3779B1)) >> np.uint32(31)
                sketch[full] = np.packbits(bits, axis=1).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, n * bands + 1, bands, dtype=np.int32), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), *(pa.array(d.view(np.int64)) for d in digests), lists, *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(SKETCH_LONGS))],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", *(f"s{i}" for i in range(SKETCH_LONGS))],
            )

    return run


def _most_apart(similarity: float, used: int) -> int:
    off = (1 - similarity) / 2
    return int(np.ceil(used * off + 6 * np.sqrt(used * off * (1 - off))))


def _close(a: str, b: str, similarity: float, used: int) -> Column:
    """Sizes that allow the likeness, and sketches that don't rule it out, of columns with the prefixes a and b."""
    apart = sum((F.bit_count(F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))) for i in range(SKETCH_LONGS)), F.lit(0))
    sizes = [F.col(f"{x}n_shingles").cast("double") for x in (a, b)]
    return (F.least(*sizes) >= (similarity - 1e-9) * F.greatest(*sizes)) & (apart <= _most_apart(similarity, used))


def _seated(around: DataFrame, of_centre: DataFrame) -> DataFrame:
    """around(centre, seat, ...) with the columns of of_centre(centre, ...), which go to every seat of the centre."""
    seats = around.select("centre", "seat").distinct().join(of_centre, "centre")
    return around.join(seats, ["centre", "seat"])


def _cells(around: DataFrame, texts: bool) -> DataFrame:
    """Rows of around(centre, seat, doc_id, component, big, n_shingles, ...) dealt into cells (centre, i, j): on the left the
    nodes outside the largest component, on the right all. Nodes are hashed into blocks, LEFT and RIGHT nodes of them on
    average and, with texts, LEFT_SHINGLES and RIGHT_SHINGLES shingles."""
    placed = around.withColumn("left", F.col("component") != F.col("big"))
    sizes = placed.groupBy("centre").agg(F.count("*").alias("all"), F.count_if("left").alias("lefts"), F.sum("n_shingles").alias("all_s"), F.sum(F.when(F.col("left"), F.col("n_shingles"))).alias("lefts_s"))

    def blocks(nodes: str, most: int, shingles: str, most_shingles: int) -> Column:
        n = F.ceil(F.col(nodes) / most)
        return (F.greatest(n, F.ceil(F.col(shingles) / most_shingles)) if texts else n).cast("int")

    parts = sizes.select("centre", blocks("lefts", LEFT, "lefts_s", LEFT_SHINGLES).alias("ni"), blocks("all", RIGHT, "all_s", RIGHT_SHINGLES).alias("nj")).where("lefts > 0")
    met = _seated(placed, parts)
    own = F.xxhash64("doc_id", F.lit(3))
    left = met.where("left").withColumn("i", F.pmod(own, F.col("ni")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nj") - 1)))
    right = met.withColumn("left", F.lit(False)).withColumn("j", F.pmod(own, F.col("nj")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)))
    return left.unionByName(right).drop("ni", "nj", "big", "seat")


def _possible(similarity: float, used: int):
    """The nodes of a cell that have a partner of another component which sketch and size allow."""
    most = _most_apart(similarity, used)

    def run(table: pa.Table) -> pa.Table:
        side = table.column("left").to_numpy(zero_copy_only=False)
        ids, comp, size = (table.column(c).to_numpy() for c in ("doc_id", "component", "n_shingles"))
        sketch = np.stack([table.column(f"s{i}").to_numpy() for i in range(SKETCH_LONGS)], axis=1).view(np.uint64)
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        found = []
        for at in range(0, len(a), 64):
            x = a[at : at + 64]
            apart = sum(np.bitwise_count(sketch[x, None, i] ^ sketch[None, b, i]).astype(np.int32) for i in range(SKETCH_LONGS))
            least, greatest = np.minimum(size[x, None], size[None, b]), np.maximum(size[x, None], size[None, b])
            ok = (apart <= most) & (comp[x, None] != comp[None, b]) & (least >= (similarity - 1e-9) * greatest)
            found += [ids[x[ok.any(axis=1)]], ids[b[ok.any(axis=0)]]]
        out = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return pa.table({"centre": np.full(len(out), table.column("centre")[0].as_py() if len(table) else 0, np.int64), "doc_id": out})

    return run


def _linked(width: int, num: int, den: int):
    """Links between nodes of a cell that lie in different components, decided on full sets. One link of a node to a
    component is enough."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("left").to_numpy(zero_copy_only=False)
        ids, comp = table.column("doc_id").to_numpy(), table.column("component").to_numpy()
        w = words(table.column("text"))
        sets, ends = shingles(w.hashes(), w.offsets, width)
        size = np.diff(ends)
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        part = np.concatenate([sets[ends[k] : ends[k + 1]] for k in a]) if len(a) else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(a)), size[a])
        order = np.argsort(part, kind="stable")
        part, owner = part[order], owner[order]
        u, v, seen = [], [], set()
        for k in b:
            mine = sets[ends[k] : ends[k + 1]]
            lo, hi = np.searchsorted(part, mine, "left"), np.searchsorted(part, mine, "right")
            n = hi - lo
            total = int(n.sum())
            if not total:
                continue
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)
            both = np.bincount(owner[at], minlength=len(a))
            ok = (both > 0) & (comp[a] != comp[k]) & (den * both >= num * (size[a] + size[k] - both))
            for x in a[ok]:
                key = (min(comp[x], comp[k]), max(comp[x], comp[k]))
                if key not in seen:
                    seen.add(key)
                    u.append(min(ids[x], ids[k]))
                    v.append(max(ids[x], ids[k]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _verified(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Of pairs (centre, seat, doc_id) of document ids, named u and v, those whose full sets satisfy den * intersection >= num * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = np.zeros(len(u), bool)
            # the texts of a run of rows with the same u are hashed once
            new = np.append(True, u[1:] != u[:-1]) if len(u) else np.empty(0, bool)
            firsts = np.flatnonzero(new)
            for at in range(0, len(u), 64):
                part = batch.slice(at, min(64, len(u) - at))
                right = words(part.column(3))
                sets, ends = shingles(right.hashes(), right.offsets, width)
                mine = firsts[(firsts >= at) & (firsts < at + part.num_rows)]
                left = words(part.column(2).take(pa.array(mine - at)))
                lsets, lends = shingles(left.hashes(), left.offsets, width)
                own = {int(i): lsets[lends[k] : lends[k + 1]] for k, i in enumerate(mine)}
                for i in range(at, at + part.num_rows):
                    if i in own:
                        last = (u[i], own[i])
                    a, b = last[1], sets[ends[i - at] : ends[i - at + 1]]
                    short, long = (a, b) if len(a) < len(b) else (b, a)
                    both = 0
                    if len(short):
                        found = np.searchsorted(long, short)
                        both = int((long[np.minimum(found, len(long) - 1)] == short).sum())
                    keep[i] = both > 0 and den * both >= num * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])

    one = docs.select("doc_id", "text").where("doc_id is not null")
    both = _seated(pairs.join(one.withColumnRenamed("text", "text_v"), "doc_id"), one.withColumnsRenamed({"doc_id": "centre", "text": "text_u"}))
    return both.select(F.col("centre").alias("u"), F.col("doc_id").alias("v"), "text_u", "text_v").mapInArrow(freed(run), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, bands: int = BANDS, rows: int = ROWS, seed: int = 1) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs(doc_id, text, ...), whose shingle sets of `width` words
    are linked where their Jaccard likeness is at least `similarity` (to a hundredth).

    Null or empty texts, and texts of white space, have an empty set and link with nothing. A text with fewer than
    `width` words is one shingle. Rows with a null doc_id are kept, with a null component. Rows that repeat a doc_id
    count as one document in the links. Other columns are ignored; an empty table gives no rows.
    """
    num, den = round(100 * similarity), 100
    docs = docs.select("doc_id", "text")
    signed = stored(docs.mapInArrow(freed(_signatures(width, bands, rows, seed)), _SIGNATURES), "signatures")
    sets = ["d1", "d2", "n_shingles"]
    nodes = signed.where("n_shingles > 0 and doc_id is not null")
    classes = nodes.groupBy(*sets).agg(F.min("doc_id").alias("rep"))
    classes = stored(classes, "classes")
    rep = nodes.join(classes, (nodes.doc_id == classes.rep) & (nodes.d1 == classes.d1) & (nodes.d2 == classes.d2) & (nodes.n_shingles == classes.n_shingles), "left_semi").dropDuplicates(["doc_id", *sets])
    rep = stored(rep, "banded")
    wide, signed = signed, stored(signed.select("doc_id", *sets), "sets")  # the bands and sketches are needed of nodes only
    done(wide)
    sketch = [f"s{i}" for i in range(SKETCH_LONGS)]
    node = stored(rep.select("doc_id", "n_shingles", *sketch), "nodes")
    keys = rep.select("doc_id", F.explode("bands").alias("key"))
    met = stored(keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "buckets")
    done(rep)
    company = met.groupBy("doc_id").agg(F.sum("n").alias("company"))
    centres = met.join(company, "doc_id").groupBy("key").agg(F.max(F.struct("company", F.negative("doc_id").alias("minus"))).alias("m")).select("key", F.negative("m.minus").alias("centre"))
    around = met.join(centres, "key").where("doc_id <> centre").groupBy("centre", "doc_id").agg(F.max("n").alias("n"))
    around = stored(around.select("centre", "doc_id", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / NEAR)).cast("int").alias("seat")), "around")
    done(met)

    used = min(bands * rows, 64 * SKETCH_LONGS)
    of_centre = node.withColumnsRenamed({c: "centre" if c == "doc_id" else f"c_{c}" for c in node.columns})
    stars = _seated(around.join(node, "doc_id"), of_centre).where(_close("c_", "", similarity, used)).select("centre", "seat", "doc_id")
    links = stored(_verified(stars, docs, width, num, den), "links")
    label = components(links)

    # centres whose surroundings still hold several components
    placed = around.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    per = placed.groupBy("centre", "component").agg(F.count("*").alias("size"))
    mixed = per.groupBy("centre").agg(F.count("*").alias("parts"), F.max(F.struct("size", "component")).alias("m")).where("parts > 1").select("centre", F.col("m.component").alias("big"))
    several = stored(_seated(placed, mixed).join(node, "doc_id"), "several")
    done(around, node)
    grouped = _cells(several, texts=False).groupBy("centre", "i", "j")
    possible = stored(grouped.applyInArrow(_possible(similarity, used), "centre bigint, doc_id bigint").distinct(), "possible")
    if not possible.isEmpty():
        texts = docs.select("doc_id", "text").where("doc_id is not null")
        left = several.drop(*sketch).join(possible, ["centre", "doc_id"])
        more = _cells(left, texts=True).join(texts, "doc_id").groupBy("centre", "i", "j").applyInArrow(_linked(width, num, den), "u bigint, v bigint")
        few, links = links, stored(links.union(more).distinct(), "all_links")
        done(few, label)
        label = components(links)
    done(links, several, possible)

    named = classes.join(label, classes.rep == label.node, "left").select(*sets, F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", *sets).join(named, sets, "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
