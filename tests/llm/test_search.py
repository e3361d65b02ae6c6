"""Nearest neighbours, ranked search and vector codes against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from curaspark.llm import queries, ranked_search, textops, vantage_points, vector_codes
from tests.conftest import DATA, same_rows

VECTORS = "vec_id long, embedding array<float>, label int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vectors(n=900, dim=8, seed=3):
    """Clusters, copies, repeated rows, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = (centres[rng.integers(0, 12, n)] + rng.normal(scale=0.2, size=(n, dim))).astype(np.float32)
    x[100:400] = x[100]  # a hot vector
    rows = [(i, v.tolist(), int(i % 5) if i % 7 else None) for i, v in enumerate(x)]
    rows[11] = (11, None, 1)
    rows[12] = (12, [0.0] * dim, 1)
    rows[13] = (13, [float("nan"), *[1.0] * (dim - 1)], 1)
    rows[14] = (14, [None, *[1.0] * (dim - 1)], 1)
    rows[15] = (15, [float("inf"), *[1.0] * (dim - 1)], 1)
    rows[16] = (16, [], 1)
    return rows


def usable(rows):
    return {i: np.array(v, np.float64) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}


def exact_nearest(rows, every, k):
    kept = usable(rows)
    out = {}
    for q in (i for i in kept if i % every == 0):
        scored = sorted((-float(vantage_points.inner_products(kept[q][None], v[None])[0]), i) for i, v in kept.items() if i != q and len(v) == len(kept[q]))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_nearest_with_factor_one_is_exact(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    want = exact_nearest(rows, 20, 20)
    assert found(vantage_points.nearest(df, factor=1.0)) == want
    tuned = found(vantage_points.nearest(df))
    assert sum(len({i for i, _ in tuned[q]} & {i for i, _ in w}) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_nearest_over_many_shards_and_parts(spark, monkeypatch):
    rows = vectors(700)
    monkeypatch.setattr(vantage_points, "SHARD_BYTES", (1 << 12, 1 << 13))
    monkeypatch.setattr(vantage_points, "PART_BYTES", 1 << 9)
    monkeypatch.setattr(vantage_points, "LEAF", 4)
    df = spark.createDataFrame(rows, VECTORS)
    assert found(vantage_points.nearest(df, factor=1.0)) == exact_nearest(rows, 20, 20)


def test_nearest_reaches_its_recall_on_the_table(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    want = exact_nearest(rows, 20, 20)
    got = found(queries.op11_nearest(spark, DATA))
    assert set(got) == set(want)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items()) >= 0.95 * sum(map(len, want.values()))
    for q, answers in got.items():
        assert all(score == dict(want_all(rows, q))[i] for i, score in answers[:3])


def want_all(rows, q):
    kept = usable(rows)
    return [(i, float(vantage_points.inner_products(kept[q][None], v[None])[0])) for i, v in kept.items() if i != q]


def test_nearest_edges(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vantage_points.nearest(empty).count() == 0
    assert vantage_points.nearest(spark.createDataFrame([(None, [1.0], 1), (20, None, 1)], VECTORS)).count() == 0
    assert vantage_points.nearest(spark.createDataFrame([(20, [1.0, 2.0], 1)], VECTORS)).count() == 0
    odd = spark.createDataFrame(
        [(0, [1.0, 0.0], "a"), (0, [1.0, 0.0], "b"), (1, [2.0, 0.0], "c"), (1, [1.5, 9.0], "d"), (2, [1.0, 0.0, 0.0], "e"), (3, [1.5, 1.0], "f"), (20, [0.0, 0.0, 5.0], "g")],
        "vec_id long, embedding array<double>, score string",
    )  # row 1 counts with its smaller vector; lengths do not mix
    assert found(vantage_points.nearest(odd)) == {0: [(1, 1.5), (3, 1.5)], 20: [(2, 0.0)]}


@pytest.mark.parametrize("seed", range(4))
def test_tree_of_entries_is_a_full_search(seed):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-60, 60, (64, 4)) if seed else rng.integers(-2, 2, (64, 4))
    entries[40] = entries[3]
    points = rng.integers(-90, 90, (3000, 4)) if seed < 3 else rng.integers(-(2**28), 2**28, (3000, 4))
    if seed == 3:
        entries = entries * 2**21
    d = ((points[:, None] - entries[None]) ** 2).sum(2)
    entry, square = vector_codes.EntryTree(entries).nearest(points)
    assert (entry == d.argmin(1)).all() and (square == d.min(1)).all()


def plain_codes(rows, parts=16, size=64, rounds=2):
    """By Python's own integers. rows: (id, vector, label) in order of ids."""
    x = {i: [math.floor(256 * c) for c in v] for i, v, _ in rows}
    width = len(next(iter(x.values()))) // parts
    cut = {i: [v[p * width : (p + 1) * width] for p in range(parts)] for i, v in x.items()}
    books = [[list(cut[i][p]) for i in sorted(cut)[:size]] for p in range(parts)]
    gap = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    nearest = lambda p, v: min((gap(v, e), n) for n, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            members = {}
            for i in cut:
                members.setdefault(nearest(p, cut[i][p])[1], []).append(cut[i][p])
            new.append([[sum(c) // len(members[n]) for c in zip(*members[n], strict=True)] if n in members else e for n, e in enumerate(books[p])])
        books = new
    final = {i: [nearest(p, cut[i][p]) for p in range(parts)] for i in cut}
    error = {i: sum(d for d, _ in v) for i, v in final.items()}
    by_label = {}
    for i, _, label in rows:
        by_label[label] = by_label.get(label, 0) + error[i]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted((i, "".join(f"{n:02x}" for _, n in final[i]), error[i], by_label[label], sha) for i, _, label in rows)


def test_vector_codes_equal_plain_integers(spark):
    rows = [r for r in vectors(160, 32) if r[1]]
    good = [(i, v, label) for i, v, label in rows if None not in v and np.isfinite(v).all()]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    assert sorted(map(tuple, vector_codes.vector_codes(df).collect())) == plain_codes(good)


def test_vector_codes_equal_their_sql(spark, duck):
    assert same_rows(queries.op13_vector_codes(spark, DATA).toPandas(), duck.sql(vector_codes.ORACLE).df())


def test_vector_codes_edges(spark):
    assert vector_codes.vector_codes(spark.createDataFrame([], VECTORS)).count() == 0
    few = [(5, [0.5] * 16, None), (5, [0.5] * 16, None), (7, [-0.25] * 16, 1), (9, [1.0] * 3, 1), (8, [1e30] * 16, 1), (10, [], 2), (11, None, 2), (None, [0.5] * 16, 3)]
    got = {(r["vec_id"], r["code"]): (r["error"], r["label_error"]) for r in vector_codes.vector_codes(spark.createDataFrame(few, VECTORS)).collect()}
    assert got == {(5, "00" * 16): (0, 0), (7, "02" * 16): (0, 0), (9, None): (None, 0), (8, None): (None, 0), (10, None): (None, None), (None, "00" * 16): (0, 0)}
    uneven = spark.createDataFrame([(i, [float(i + j) for j in range(18)], "x", "y") for i in range(3)], "vec_id long, embedding array<float>, label string, code string")
    assert {r["error"] for r in vector_codes.vector_codes(uneven).collect()} == {0}


def plain_ranks(docs, items, k=10):
    words = {n: TERM.findall((t or "").translate(LOW)) for n, (_, t) in enumerate(docs)}
    words = {n: w for n, w in words.items() if w}
    n_docs, n_terms = len(words), sum(map(len, words.values()))
    df = {}
    for w in words.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, []).extend(TERM.findall((t or "").translate(LOW)))
    out = {}
    for i, terms in asked.items():
        scored = []
        for n, w in words.items():
            m = 25 + 75 * len(w) * n_docs // n_terms
            total = 0
            for t in terms:
                if t in df and t in w:
                    tf = w.count(t)
                    total += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if total > 0:
                scored.append((-total, docs[n][0] is None, docs[n][0] or 0, docs[n][0]))
        if scored:
            out[i] = [(d, -s) for s, _, _, d in sorted(scored)[:k]]
    return out


def ranks(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["item_id"], r["rank"])):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


def library(seed=5):
    rng = random.Random(seed)
    names = [f"w{j}" for j in range(30)] + ["É", "日本", "Straße"]
    docs = [(i * 3 % 401, " ".join(rng.choices(names, [1 / (j + 1) for j in range(len(names))], k=rng.randrange(0, 40)))) for i in range(400)]
    docs[5:9] = [(None, "w1 W2,w3 rare"), (1000, None), (1001, ""), (1002, " \n-- ")]
    docs += [docs[20], docs[20], (1003, "w9 " * 3000 + "rare"), (1004, "W1" * 5000)]
    items = [(j, " ".join(rng.choices(names, k=rng.randrange(1, 9)))) for j in range(25)]
    items += [(30, None), (31, "nowhere"), (None, "w1"), (32, "w1 w1 w2"), (32, "RARE w0"), (33, "-")]
    return docs, items


@pytest.mark.parametrize("shard,short", [(4 << 20, 64), (1500, 2), (600, 1)])
def test_ranked_search_equals_all_scores(spark, monkeypatch, shard, short):
    docs, items = library()
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", shard)
    monkeypatch.setattr(ranked_search, "SHORT", short)
    d = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, score string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = ranks(ranked_search.ranked_search(d, q))
    want = plain_ranks(docs, items)
    assert {i: [s for _, s in v] for i, v in got.items()} == {i: [s for _, s in v] for i, v in want.items()}
    assert got == want


def test_ranked_search_in_blocks_and_large_sums(spark, monkeypatch):
    docs, items = library(6)
    monkeypatch.setattr(ranked_search, "BLOCK_ROWS", 40)
    monkeypatch.setattr(ranked_search, "_summed", lambda d, v, n, top, plain=ranked_search._summed: plain(d, v, n, 2**60))
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert ranks(ranked_search.ranked_search(d, q)) == plain_ranks(docs, items)


def test_items_without_proof_fall_through(spark, monkeypatch):
    """Some items end in the first tier, some in the last; no tier is read for an item that has ended."""
    docs, items = library(7)
    monkeypatch.setattr(ranked_search, "SHORT", 4)
    asked = []
    plain = ranked_search._answers
    monkeypatch.setattr(ranked_search, "_answers", lambda terms, open_items, least, tiers, k: asked.append((tiers, len(open_items))) or plain(terms, open_items, least, tiers, k))
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (40, "rare")], "item_id long, text string")
    assert ranks(ranked_search.ranked_search(d, q)) == plain_ranks(docs, [*items, (40, "rare")])
    assert [t for t, _ in asked] == [1, 2, 3] and asked[0][1] > asked[-1][1] > 0


def test_ranked_search_equals_its_sql(spark, duck):
    assert same_rows(queries.op12_ranked_search(spark, DATA).toPandas(), duck.sql(ranked_search.ORACLE).df())


def test_ranked_search_edges(spark):
    none, item = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.ranked_search(none, item).count() == 0
    assert ranked_search.ranked_search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert ranked_search.ranked_search(spark.createDataFrame([(1, None), (2, "- ")], "doc_id long, text string"), item).count() == 0


def test_terms_end_where_the_pattern_says():
    import pyarrow as pa

    texts = ["".join(map(chr, range(0, 0x180))), "a_b-C9é日", "", None]
    raw, off = textops.buffers(pa.array(texts))
    terms, rows = ranked_search._terms(raw, off)
    want = [TERM.findall((t or "").translate(LOW)) for t in texts]
    assert [t.decode() for t in terms.to_pylist()] == [t for w in want for t in w]
    assert np.diff(rows).tolist() == [len(w) for w in want]
