"""SimHash near-deduplication by the generalised pigeonhole principle.

Fingerprints within `distance` bits are found by splitting the 64 bits into m partitions with thresholds T_i that sum to
distance - m + 1: two such fingerprints differ by at most T_i bits in some partition i. Correlated bits go into the
same partition, so that the partitions are nearly independent; the T_i are unequal, and -1 skips a partition. Both, and m,
are chosen by dynamic programming on the candidates that a bounded sample of fingerprints and their number predict.
Fingerprints meet at all values within ceil(T_i / 2) bits of their own, are compared there in full, and links that only join
what a bucket has joined already are not emitted: a bucket of any size gives fewer links than it has members.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.llm import exact_dedup, set_join, textops
from curaspark.llm.components import components
from curaspark.llm.storage import drop, materialize, new_path

BITS = 64
SEED = 42
SAMPLE = 2_048
#: Relative costs of moving a row to a bucket and of comparing two fingerprints there.
ROW_COST, PAIR_COST = 1.0, 0.01
MAX_BALL = 4_096
#: Buckets of at most so many members are compared pair by pair for all buckets at once.
SMALL = 16


def shingle_spans(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of every n-word shingle, and offsets by row. Fewer words: the whole sequence; none: none."""
    words = np.diff(rows)
    count = np.where(words >= n, words - n + 1, (words > 0).astype(np.int64))
    ends = np.cumsum(count)
    own = np.repeat(np.arange(len(words)), count)
    first = rows[own] + np.arange(len(own)) - (ends - count)[own]
    return first, np.minimum(first + n - 1, rows[own + 1] - 1), np.concatenate([[0], ends])


def shingle_hashes(raw: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every shingle of lower-cased words joined by spaces, and offsets by row."""
    data, begins, ends, rows = textops.joined(textops.LOWER[raw], off)
    first, last, edges = shingle_spans(rows, n)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[s:e], SEED) for s, e in zip(begins[first].tolist(), ends[last].tolist(), strict=True)), np.uint64, len(first)) if len(first) else np.zeros(0, np.uint64)
    return h, edges


def majority(h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The fingerprint of each row: the bits that are set in over half its hashes."""
    out = np.zeros(len(edges) - 1, np.uint64)
    some = np.flatnonzero(edges[1:] > edges[:-1])
    if not len(some):
        return out
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, edges[some], axis=0, dtype=np.int32)
    on = counts * 2 > np.diff(edges)[some][:, None]
    out[some] = np.packbits(on, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit integer."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            raw, off = textops.buffers(batch.column(1))
            out = [np.zeros(0, np.uint64)]
            for lo, hi in textops.chunks(off, 1 << 20):
                out.append(majority(*shingle_hashes(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], shingle)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out).view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal width; each grows from a bit by the bits that correlate with it most."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    bits -= bits.mean(axis=0)
    norm = np.sqrt((bits**2).sum(axis=0))
    norm[norm == 0] = 1
    corr = np.abs((bits / norm).T @ (bits / norm))
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for i in range(m):
        width = (BITS - sum(map(len, out))) // (m - i)
        free = sorted(left)
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        while len(group) < width:
            rest = sorted(left - set(group))
            group.append(max(rest, key=lambda b: (corr[b, group].sum(), -b)))
        left -= set(group)
        out.append(sorted(group))
    return out


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def shared_buckets(width: int, d: int, r: int) -> int:
    """Values within r bits of both of two values that are d bits apart."""
    return sum(comb(d, i) * comb(width - d, j) for i in range(d + 1) for j in range(width - d + 1) if i + j <= r and d - i + j <= r)


def plan(sample: np.ndarray, n: int, distance: int) -> list[tuple[list[int], int]]:
    """[(bits, radius)] of the partitions used: the cheapest of all m and thresholds, by estimated rows and comparisons."""
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(2, min(distance + 1, 8) + 1) if distance else [1]:
        groups = group_bits(sample, m) if len(sample) > 1 else [list(range(BITS))[i::m] for i in range(m)]
        costs = []
        for bits in groups:
            width, mask = len(bits), np.uint64(_mask(bits))
            near = np.zeros(width + 1)
            if len(sample) > 1:
                for i in range(1, min(len(sample), 512)):
                    near += np.bincount(np.bitwise_count((sample[i:] ^ sample[:-i]) & mask), minlength=width + 1)
                near /= near.sum()
            share = [max(near[d], comb(width, d) / 2**width) for d in range(width + 1)]
            by_t = [0.0]  # T = -1
            for t in range(distance + 1):
                r = min(width, -(-t // 2))
                ball = sum(comb(width, k) for k in range(r + 1))
                pairs = n * n / 2 * sum(share[d] * shared_buckets(width, d, r) for d in range(min(width, 2 * r) + 1))
                by_t.append(np.inf if ball > MAX_BALL else n * ball * ROW_COST + pairs * PAIR_COST)
            costs.append(by_t)
        # over partitions: least cost for each sum of (T + 1), which must reach distance + 1
        goal = distance + 1
        table = [0.0] + [np.inf] * goal
        choice = []
        for by_t in costs:
            nxt, pick = [np.inf] * (goal + 1), [0] * (goal + 1)
            for have in range(goal + 1):
                for t1, c in enumerate(by_t):
                    to = min(goal, have + t1)
                    if table[have] + c < nxt[to]:
                        nxt[to], pick[to] = table[have] + c, (have, t1)
            table = nxt
            choice.append(pick)
        if table[goal] < (np.inf if best is None else best[0]):
            at, used = goal, []
            for bits, pick in zip(reversed(groups), reversed(choice), strict=True):
                at, t1 = pick[at]
                if t1:
                    used.append((bits, min(len(bits), -(-(t1 - 1) // 2))))
            best = (table[goal], used[::-1])
    return best[1]


def patterns(bits: list[int], radius: int) -> np.ndarray:
    return np.array([_mask(list(c)) for r in range(radius + 1) for c in combinations(bits, r)], np.uint64)


def bucket_links(key: np.ndarray, fp: np.ndarray, distance: int, small: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows sorted by key: all pairs of small buckets, spanning trees of the links of larger ones."""
    us, vs = [], []
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(heads, len(key)))
    remain = np.repeat(np.where(sizes <= small, sizes, 0), sizes) - (np.arange(len(key)) - np.repeat(heads, sizes)) - 1
    idx = np.flatnonzero(remain > 0)
    lag = 1
    while len(idx):
        a, b = fp[idx], fp[idx + lag]
        ok = (np.bitwise_count(a ^ b) <= distance) & (a != b)
        us.append(a[ok])
        vs.append(b[ok])
        lag += 1
        idx = idx[remain[idx] >= lag]
    for h, size in zip(heads[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        left = np.unique(fp[h : h + size])
        while len(left) > 1:  # breadth first; each step takes what is near off the rest
            queue, left = [left[:1]], left[1:]
            while queue and len(left):
                for x in queue.pop():
                    near = np.bitwise_count(left ^ x) <= distance
                    if near.any():
                        got = left[near]
                        us.append(np.full(len(got), x, np.uint64))
                        vs.append(got)
                        left = left[~near]
                        queue.append(got)
                    if not len(left):
                        break
    if not us:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(us), np.concatenate(vs)


def near_links(distinct: DataFrame, distance: int, small: int = SMALL) -> DataFrame:
    """(u, v): links between the distinct fingerprints of column fp that join all that are within distance."""
    n = distinct.count()
    sample = np.array([r[0] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    parts = [(np.uint64(_mask(bits)), patterns(bits, r), textops.mix(np.array([i + 1], np.uint64))) for i, (bits, r) in enumerate(plan(sample, n, distance))]

    def probe(batches):
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(every), 4096):
                fp = every[lo : lo + 4096]
                for mask, flips, salt in parts:
                    key = textops.mix(((fp & mask)[:, None] ^ flips).ravel() ^ salt)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(fp, len(flips)).view(np.int64))], names=["key", "fp"])

    def verify(batches):
        rest_key, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([rest_key, batch.column(0).to_numpy()])
            fp = np.concatenate([rest_fp, batch.column(1).to_numpy().view(np.uint64)])
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1], "left"))  # the last bucket may go on
            rest_key, rest_fp = key[cut:], fp[cut:]
            if cut:
                yield pair(*bucket_links(key[:cut], fp[:cut], distance, small))
        if len(rest_key):
            yield pair(*bucket_links(rest_key, rest_fp, distance, small))

    def pair(u, v):
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    probes = distinct.select("fp").mapInArrow(probe, "key long, fp long")
    return probes.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "u long, v long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable) of each whole text.

    A null or wordless text has fingerprint zero and is linked like any other. Equal fingerprints are one node, so
    copies make no links. Null ids get their component's id and never name one (null if it has no other id).
    Repeated rows give repeated rows; an empty table none.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(near_links(distinct, distance))
    labelled = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    names = labelled.join(ids, "root").select("fp", "component_id")
    return prints.join(names, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, grams): the distinct shingle hashes of each text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            raw, off = textops.buffers(batch.column(1))
            for lo, hi in textops.chunks(off, 1 << 20):
                h, edges = shingle_hashes(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], shingle)
                sets = [np.unique(h[a:b]).view(np.int64) for a, b in zip(edges, edges[1:])]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                values = pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(bounds), values)], names=["id", "grams"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, grams array<long>")


def nodes(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, fp, n, s1, s2, prefix, sketch): the fingerprint, and of the set of distinct shingles the size, a 128-bit hash, the prefix
    and a sketch."""

    def run(batches):
        for batch in batches:
            raw, off = textops.buffers(batch.column(1))
            for lo, hi in textops.chunks(off, 1 << 20):
                h, edges = shingle_hashes(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], shingle)
                sets = [np.unique(h[a:b]) for a, b in zip(edges, edges[1:])]
                n = np.array([len(x) for x in sets], np.int64)
                names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), np.int64).reshape(-1, 2)
                bounds = np.concatenate([[0], np.cumsum(n)])
                prefix, cuts = set_join.prefixes(np.concatenate([np.zeros(0, np.uint64), *sets]), bounds, similarity, often)
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(prefix.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(majority(h, edges).view(np.int64)), pa.array(n.astype(np.int32)), pa.array(names[:, 0]), pa.array(names[:, 1]), lists, pa.array([set_join.sketch(x) for x in sets], pa.binary())],
                    names=["id", "fp", "n", "s1", "s2", "prefix", "sketch"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fp long, n int, s1 long, s2 long, prefix array<long>, sketch binary")


def verified_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 10, similarity: float = 0.8) -> DataFrame:
    """(node, root) of near copies: all that links of shingle sets with a Jaccard similarity of `similarity` or more join.

    Nodes are the distinct shingle sets. SimHash links of up to `distance` bits, the closest of each set, verified, join most near
    copies; then every pair of sets that prefix filtering leaves is verified, but those in one group by verified links: first the
    pairs with one set of each shingle, then the nearest of each set, so that a large group is joined before its pairs are made.
    Every id but the smallest of its group has a row. Ids must be unique; null ids are in no group.
    """
    docs = docs.where(F.col(id_col).isNotNull())
    made: list[str] = []

    def table(df: DataFrame, name: str) -> DataFrame:
        made.append(new_path(docs.sparkSession, name))
        return materialize(df, name, made[-1])

    part = max(1, docs.count() // set_join.SAMPLE)
    often = set_join.frequent(shingle_sets(docs.where(F.pmod(F.xxhash64(id_col), F.lit(part)) == 0), id_col, text_col, shingle))
    prints = table(nodes(docs, id_col, text_col, shingle, similarity, often), "fingerprints")
    equal = prints.groupBy("s1", "s2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    twins = table(prints.select("id", "s1", "s2").join(equal, ["s1", "s2"]).where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v")), "twins")
    single = prints.join(twins, F.col("id") == F.col("u"), "left_anti")

    side = lambda c: (F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    distinct = table(single.groupBy("fp").agg(F.min_by(F.struct("id", "n", "sketch"), "id").alias("least")).select("fp", "least.*"), "distinct")
    same = single.select("fp", *side("u")).join(distinct.select("fp", *side("v")), "fp").where("u <> v").drop("fp")
    links = near_links(distinct, distance, 2).select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y")).distinct()
    name = lambda fp, c: distinct.select(F.col("fp").alias(fp), *side(c))
    other = links.join(name("x", "u"), "x").join(name("y", "v"), "y").select(same.columns)
    closest = lambda pairs: pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), "far").groupBy("u").agg(F.min_by("v", F.struct("far", "v")).alias("v"))
    tried = table(closest(promising(same.unionByName(other), similarity)), "pairs")
    roots = components(twins.unionByName(similar(docs, tried, id_col, text_col, shingle, similarity, table)))

    rows = table(set_join.with_sketches(table(set_join.postings(single), "prefixes"), single), "postings")
    for pick in ("hub", "nearest", "all"):
        pairs = set_join.candidates(rows, roots, similarity, pick).join(tried, ["u", "v"], "left_anti")
        both = pairs.join(single.select(*side("u")), "u").join(single.select(*side("v")), "v")
        found = promising(both, similarity)
        found = table(closest(found) if pick == "nearest" else found.select("u", "v"), "pairs")
        linked = similar(docs, found, id_col, text_col, shingle, similarity, table)
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(linked))
        tried = tried.unionByName(found)
    for path in made:
        drop(docs.sparkSession, path)
    return roots  # a table of its own


def promising(both: DataFrame, similarity: float) -> DataFrame:
    """(u, v, far) of the pairs (u, v, nu, nv, su, sv) whose sets' sizes and sketches allow the similarity: only their sets are moved
    and compared. far: how unlike the sketches are."""

    def run(batches):
        for batch in batches:
            nu, nv = (batch.column(i).to_numpy() for i in (2, 3))
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, set_join.BINS) for i in (4, 5))
            ok, far = set_join.alike(a, b, nu, nv, similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far)], names=["u", "v", "far"]).filter(pa.array(ok))

    sized = both.where(F.least("nu", "nv") >= F.lit(similarity - 1e-9) * F.greatest("nu", "nv"))
    return sized.select("u", "v", "nu", "nv", "su", "sv").mapInArrow(run, "u long, v long, far double")


def similar(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, table=materialize) -> DataFrame:
    """Those of the pairs (u, v) of ids whose shingle sets have a Jaccard similarity of `similarity` or more."""
    ends = table(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "ends")
    sets = shingle_sets(exact_dedup.among(docs.select(id_col, text_col), id_col, ends), id_col, text_col, shingle)
    sets = table(sets, "shingles")
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("grams").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("grams").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    union = F.size("a") + F.size("b") - shared
    return both.where((union == 0) | (shared >= F.lit(similarity) * union)).select("u", "v")
