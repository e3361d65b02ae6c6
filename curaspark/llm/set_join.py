"""Exact links between shingle sets of a Jaccard similarity of t or more, by prefix filtering.

All shingles have one order: those that a bounded sample of the texts has often come last, the others go by their hash. Of a
set of n shingles the first n - ceil(t n) + 1 are its prefix; two sets of similarity t share a shingle of their prefixes,
and at the first that they share, what is left of the smaller is enough for the overlap that t asks for. The order
changes only how many pairs are compared, never which are found.

A pair goes uncompared only if both sets are in one group already, by links that were themselves verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.llm import textops

#: Texts sampled for frequent shingles, the count there that makes one frequent, and the most that the order knows.
SAMPLE, OFTEN, FREQUENT = 32_768, 4, 262_144
#: Sets of a shingle from which on they carry their sketches: their pairs would grow with the square.
LARGE = 16
#: Pairs that a task holds before it drops the repeated ones.
HELD = 1 << 20


def frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a sample (id, grams), sorted, and their counts."""
    counted = sets.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= OFTEN)
    got = counted.orderBy(F.desc("c"), "gram").limit(FREQUENT).toArrow()
    gram, c = got.column("gram").to_numpy().view(np.uint64), got.column("c").to_numpy()
    at = np.argsort(gram)
    return gram[at], c[at]


def prefixes(h: np.ndarray, edges: np.ndarray, similarity: float, often: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The prefixes of distinct shingles h (offsets by row), in the order above, and their offsets."""
    known, counts = often
    weight = np.zeros(len(h), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        weight = np.where(known[at] == h, counts[at], 0)
    n = np.diff(edges)
    order = np.lexsort((h, weight, np.repeat(np.arange(len(n)), n)))
    size = np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)
    place = np.arange(len(h)) - np.repeat(edges[:-1], n)
    return h[order][place < np.repeat(size, n)], np.concatenate([[0], np.cumsum(size)])


#: Bytes of a set's sketch, the least set with one of minimum hashes, and the share of equal ones under which a pair is no near copy.
#: Of a pair of similarity 0.8 fewer are equal with a chance of about 1e-9 (64 bins, binomial).
BINS, SKETCHED, EQUAL = 64, 256, 0.45


def sketch(h: np.ndarray) -> bytes:
    """BINS bytes of a set. SKETCHED hashes or more: one-permutation minimum hashes, a byte a bin; zero: an empty bin. Fewer: a
    bitmap in which each hash flips one bit, so two sets differ in at least as many hashes as their bitmaps in bits."""
    if len(h) < SKETCHED:
        return np.packbits(np.bincount((h & np.uint64(8 * BINS - 1)).astype(np.int64), minlength=8 * BINS) & 1).tobytes()
    out = np.zeros(BINS, np.uint8)
    bins = (h >> np.uint64(58)).astype(np.int64)  # rises: h is sorted
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    out[bins[first]] = (textops.mix(h[first]) % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def alike(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether the sketches (rows of a and b) of sets of so many shingles allow the similarity, and how unlike they are.

    Bitmaps lose no pair; minimum hashes one of similarity 0.8 with the chance given above. Pairs with one of each are kept.
    """
    small, large = np.maximum(na, nb) < SKETCHED, np.minimum(na, nb) >= SKETCHED
    ok, far = np.ones(len(na), bool), np.ones(len(na))
    i = np.flatnonzero(small)
    total = na[i].astype(np.int64) + nb[i]
    apart = np.bitwise_count(a[i].view(np.uint64) ^ b[i].view(np.uint64)).sum(axis=1, dtype=np.int64)
    ok[i], far[i] = apart <= total * (1 - similarity) / (1 + similarity) + 1e-6, apart / np.maximum(total, 1)
    i = np.flatnonzero(large)
    x, y = a[i], b[i]
    some, equal = (x > 0) & (y > 0), x == y
    ok[i], far[i] = (equal & some).sum(axis=1) >= EQUAL * some.sum(axis=1), 1 - equal.mean(axis=1)
    return ok, far


def bucket_pairs(gram, ids, n, place, many, sketches, root, similarity: float, hub: bool):
    """Yields (u, v, far) of rows sorted by gram and root that may be similar and are in different groups: all, or those with the
    first of each gram. far: how unlike the sketches are, -1 where the rows have none."""
    heads = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    sizes = np.diff(np.append(heads, len(gram)))

    def tried(i, j):
        left = np.minimum(n[i] - place[i], n[j] - place[j])
        need = np.ceil(similarity / (1 + similarity) * (n[i] + n[j]) - 1e-9)
        ok = (root[i] != root[j]) & (left >= need)
        i, j = i[ok], j[ok]
        far = np.full(len(i), -1.0)
        if len(at := np.flatnonzero(many[i] > 0)):
            ok = np.ones(len(i), bool)
            ok[at], far[at] = alike(sketches[i[at]], sketches[j[at]], n[i[at]], n[j[at]], similarity)
            i, j, far = i[ok], j[ok], far[ok]
        return np.maximum(ids[i], ids[j]), np.minimum(ids[i], ids[j]), far

    if hub:
        yield tried(np.arange(len(gram)), np.repeat(heads, sizes))
        return
    # each row meets those after the last of its own group: what links have joined is not gone through again
    runs = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (root[1:] != root[:-1])]))
    lengths = np.diff(np.append(runs, len(gram)))
    after = np.repeat(runs + lengths, lengths)
    remain = np.repeat(heads + sizes, sizes) - after
    idx, lag = np.flatnonzero(remain > 0), 0
    while len(idx):
        yield tried(idx, after[idx] + lag)
        lag += 1
        idx = idx[remain[idx] > lag]


def _array(column: pa.Array) -> np.ndarray:
    if not pa.types.is_binary(column.type):
        return column.to_numpy()
    return np.frombuffer(b"".join(x or bytes(BINS) for x in column.to_pylist()), np.uint8).reshape(-1, BINS)


def whole_buckets(batches, columns: int):
    """Batches sorted by the first column as arrays, cut so that no value of it is in two."""
    rest = None
    for batch in batches:
        now = [_array(batch.column(i)) for i in range(columns)]
        now = now if rest is None else [np.concatenate([a, b]) for a, b in zip(rest, now)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1], "left"))
        if cut:
            yield [x[:cut] for x in now]
        rest = [x[cut:] for x in now]
    if rest is not None and len(rest[0]):
        yield rest


def postings(nodes: DataFrame) -> DataFrame:
    """(gram, id, n, place, many) of the prefix shingles of (id, n, prefix) that two or more sets have there; many: 1 if over LARGE have."""

    def run(batches):
        for gram, *more in whole_buckets(batches, 4):
            sizes = np.diff(np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1], [True]])))
            sizes = np.repeat(sizes, sizes)
            keep = sizes > 1
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (gram, *more, (sizes > LARGE).astype(np.int32))], names=["gram", "id", "n", "place", "many"])

    rows = nodes.select("id", "n", F.posexplode("prefix").alias("place", "gram")).select("gram", "id", "n", "place")
    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "gram long, id long, n int, place int, many int")


def with_sketches(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The postings with the sketches of (id, sketch) where many sets have a shingle; null elsewhere."""
    few = rows.where("many = 0").withColumn("sketch", F.lit(None).cast("binary"))
    return few.unionByName(rows.where("many = 1").join(nodes.select("id", "sketch"), "id"))


def candidates(rows: DataFrame, roots: DataFrame, similarity: float, pick: str) -> DataFrame:
    """(u, v), distinct: pairs of the postings that may be similar and are not in one group of roots (node, root).

    pick: hub: those with the first set of each shingle; nearest: of each set and a shingle that many have the pair with the
    nearest sketch, so no more rows than postings, and all pairs of a shingle that few have; all: every pair.
    """

    def run(batches):
        found, held = [], 0

        def reduced(found):
            u, v, far = (np.concatenate(x) for x in zip(*found))
            one = (far >= 0) & (pick == "nearest")
            at = np.lexsort((v, far, one, u))
            u, v, far, one = u[at], v[at], far[at], one[at]
            new = np.concatenate([[True], (u[1:] != u[:-1]) | (one[1:] != one[:-1]) | (v[1:] != v[:-1]) & ~one[1:]])
            return u[new], v[new], far[new]

        for bucket in whole_buckets(batches, 7):
            for pairs in bucket_pairs(*bucket, similarity, pick == "hub"):
                if not len(pairs[0]):
                    continue
                found.append(pairs)
                held += len(pairs[0])
                if held >= HELD:
                    found = [reduced(found)]
                    if len(found[0][0]) >= HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found[0][:2]], names=["u", "v"])
                        found = []
                    held = sum(len(x[0]) for x in found)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in reduced(found)[:2]], names=["u", "v"])

    known = rows.join(roots, F.col("id") == F.col("node"), "left").select("gram", "id", "n", "place", "many", "sketch", F.coalesce("root", "id").alias("root"))
    return known.repartition("gram").sortWithinPartitions("gram", "root", "id").mapInArrow(run, "u long, v long").distinct()
