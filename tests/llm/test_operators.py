"""The operators of the llm subpackage against brute force, public libraries and held-out rows."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from curaspark.llm import bpe, components, exact_dedup, langid, lm, lz_fingerprint, packing, pitman_yor, pretok, simhash, substring_dedup, textops, token_counts, warc

public_tokenizers = pytest.importorskip("public_tokenizers")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=160, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(120)]
    passage = [rng.choice(words) for _ in range(20)]
    texts = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        if i % 5 == 0:
            w[rng.randrange(len(w) + 1) : 0] = passage
        texts.append(rng.choice([" ", "\n", "  "]).join(w))
    for i in range(0, n, 7):  # copies, some in upper case, some with one word more
        texts[(i * 3 + 1) % n] = texts[i].upper() if i % 2 else texts[i]
        texts[(i * 5 + 2) % n] = texts[i] + " extra"
    texts[3], texts[4], texts[5] = None, "", " \n "
    texts[6] = " ".join(rng.choice(words) for _ in range(30_000))
    texts[8] = "x" * 3_000 + "é" * 500
    return [(i * 2, t, ["en", "fr"][i % 2], f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, ties, and columns named like the operators' own."""
    s = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, score string, n_removed string, id string, tag string, spans string, row string, h string, part string"
    more = ("k", "s", "r", "i", "t", "p", "w", "h", "q")
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(None, t, "en", None, 1), (1, t, None, "a", 1), (1, t, None, "a", 1), (2, t, "en", "a", None), (3, None, "en", "a", 0), (3, None, "en", "a", 0), (4, "", None, None, None)]
    return spark.createDataFrame([(*r, *more) for r in rows], s)


def test_words_and_chunks():
    texts = [None, "", " a  b\tc\n", "é x", " ", "tail"]
    raw, off = textops.buffers(pa.array(texts))
    starts, stops, rows = textops.words(raw, off)
    data = raw.tobytes()
    got = [[data[s:e].decode() for s, e in zip(starts[a:b], stops[a:b])] for a, b in zip(rows, rows[1:])]
    assert got == [WORD.findall(t or "") for t in texts]
    assert [x for lo, hi in textops.chunks(off, 3) for x in range(lo, hi)] == list(range(6))
    sliced, o = textops.buffers(pa.array(texts).slice(2, 2))
    assert sliced.tobytes() == (texts[2] + texts[3]).encode() and o[-1] == len(sliced)


def test_pretokenisation_and_bpe_equal_the_library():
    import regex
    import tiktoken
    from tokenizers import Tokenizer

    rng = random.Random(1)
    alphabet = [*"  \n\t''strevldmabZé漢3७!?.　 \u0085\x1c-😀", "'s", "'re", "'ll", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(4000)] + ["", " ", "  ", "'", "a" * 900 + "é" * 300]
    raw, off = textops.buffers(pa.array(texts))
    pattern, want = regex.compile(public_tokenizers.PATTERN), []
    for t, o in zip(texts, off):
        at = int(o)
        for m in pattern.findall(t):
            want.append(at)
            at += len(m.encode())
    assert pretok.boundaries(raw, off).tolist() == want
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    enc = bpe.encoder(path)
    ids = enc.encode(raw, off)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [lib.encode_ordinary(t) for t in texts]
    assert [enc.decode(x).decode() for x in ids] == texts
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.Counter(path).count(raw, off).tolist() == [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_every_code_point_is_read_as_the_libraries_do():
    """Beside letters, digits, blanks, punctuation and code points of other classes."""
    import tiktoken
    from tokenizers import Tokenizer

    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    order = random.Random(2).sample(points, len(points))
    texts = ["".join(f"a{c}1 {c}{d}'{c}s" for c, d in zip(points[i : i + 2000], order[i : i + 2000])) for i in range(0, len(points), 2000)]
    texts += ["\U00013514\ubddb", "\U000134b6\u6508"]
    raw, off = textops.buffers(pa.array(texts))
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    enc = bpe.encoder(path)
    counter, library = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for lo, hi in textops.chunks(off):
        part, own = texts[lo:hi], (raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(*own)] == [lib.encode_ordinary(t) for t in part]
        assert counter.count(*own).tolist() == [len(e.ids) for e in library.encode_batch(part, add_special_tokens=False)]
    assert sorted(pretok.members(r"\s+").tolist()) == pretok.SPACES


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "SLOTS", 16)
    monkeypatch.setattr(bpe, "ARENA", 64)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    small = bpe.Encoder(path)
    for t in (corpus(20, 2), corpus(20, 3), corpus(20, 2)):
        raw, off = textops.buffers(pa.array([r[1] for r in t]))
        assert small.encode(raw, off) == bpe.encoder(path).encode(raw, off)


def test_bpe_query_round_trip(docs, rows, empty, odd):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, path, offsets=True), path).collect()}
    for i, t, *_ in rows:
        assert bytes(got[i].decoded) == (t or "").encode() and got[i].n_tokens * 4 == len(got[i].ids) == len(got[i].offsets)
    assert bpe.encode(empty, path).count() == 0 and bpe.encode(odd, path).count() == 7
    assert token_counts.token_counts(odd, path).where("n_tokens = 0").count() == 3 and token_counts.token_counts(empty, path).count() == 0


def test_exact_dedup(docs, rows, empty, odd, spark):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault((t or "").translate(LOW), []).append(i)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(text.encode()).hexdigest())
    kept = exact_dedup.exact_dedup(odd, keep_columns=True)
    assert kept.columns.count("keep_id") == 1 and {"id", "tag", "text"} <= set(kept.columns)
    assert [(r.doc_id, r.keep_id, r.group_size) for r in kept.where("doc_id = 1").collect()] == [(1, 2, 4)] * 2
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_bloom_filter_never_misses(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_BLOCKS", 1)  # a full filter sends more rows the exact way
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), (F.col("id") % 50_000).cast("string").alias("text"))
    assert exact_dedup.exact_dedup(df).groupBy().agg(F.sum((F.col("group_size") == 2).cast("int")).alias("n")).first().n == 20_000
    some = df.where("doc_id % 1000 = 0").select(F.col("doc_id").alias("k"))
    assert exact_dedup.among(df, "doc_id", some).count() == 60


def test_optimal_boundaries_equal_brute_force():
    from itertools import combinations

    rng = random.Random(2)
    for _ in range(30):
        hist = {rng.randrange(1, 30): rng.randrange(1, 9) for _ in range(rng.randrange(1, 8))}
        k = rng.randrange(1, 5)
        cost = lambda bounds: sum(c * (min(b for b in bounds if b >= x) - x) for x, c in hist.items())
        lengths = sorted(hist)
        best = min(cost([*c, lengths[-1]]) for n in range(min(k, len(lengths))) for c in combinations(lengths[:-1], n))
        bounds = packing.optimal_boundaries(hist, k)
        assert len(bounds) <= k and cost(bounds) == best
    assert packing.optimal_boundaries({}, 4) == []


def test_packing(docs, rows, empty, odd):
    out = packing.pack(docs, max_len=50, buckets=4, budget=400).toPandas()
    words = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    assert out.groupby("doc_id").n_tokens.sum().to_dict() == words
    for _, g in out.groupby("doc_id"):
        g = g.sort_values("piece")
        assert g.start_token.tolist() == [50 * p for p in g.piece] and (g.n_tokens.iloc[:-1] == 50).all()
    assert (out.n_tokens <= out.bucket_len).all() and ((out.bucket_len - out.n_tokens) == out.padding).all()
    b = out.groupby("batch_id").agg(k=("bucket_len", "nunique"), n=("slot", "count"), top=("slot", "max"), size=("bucket_len", "max"))
    assert (b.k == 1).all() and (b.top == b.n - 1).all() and (b.n * b["size"] <= np.maximum(400, b["size"])).all()
    assert sorted(b.index) == list(range(len(b)))
    full = b.n == np.maximum(1, 400 // np.maximum(1, b["size"]))
    assert (~full).sum() <= out.bucket_len.nunique()  # only a bucket's last batch may be partly filled
    assert packing.pack(empty).count() == 0 and packing.pack(odd).count() == 7


def test_language_id(spark, empty, odd):
    rng = random.Random(4)
    vocabulary = {"en": ["the", "and", "house", "with", "thing"], "fr": ["été", "maison", "avec", "chose", "les"]}
    rows = [(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(30)), lang, "s", 0) for i in range(400) for lang in (rng.choice(["en", "fr"]),)]
    rows += [(1001, None, "en", "s", 0), (1002, "123 !?", "fr", "s", 0), (1003, "", None, "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in langid.identify(df, langid.fit(df)).collect()}
    held = [r for r in rows[:400] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows)
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1001, 1002, 1003))
    assert not any(got[r[0]].rejected for r in held) and all(0 <= r.score <= 1 for r in got.values())
    assert langid.fit(empty) is None and langid.identify(empty, None).count() == 0
    assert langid.identify(odd, langid.fit(df), keep_columns=True).columns.count("score") == 1


def test_lm_scores(docs, rows, empty, odd, spark):
    from collections import Counter
    from math import log10

    tokens = {i: [*WORD.findall((t or "").translate(LOW)), ""] for i, t, *_ in rows}
    count = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in lm.lm_scores(docs).collect()}
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert r.score < 0
    assert lm.lm_scores(empty).count() == 0 and lm.lm_scores(odd).count() == 7


def test_lm_is_a_distribution(spark, monkeypatch):
    """For each previous word, all words and all spellings that are no word have probability one together."""
    monkeypatch.setattr(lm, "LEAST_TOKENS", 300)
    words = ["a", "b", "cc", "dé", "e", "f"]
    text = lambda seed, n: " ".join(random.Random(seed).choice(words[:4]) for _ in range(n))
    rows = [(i, text(i, 30), True) for i in range(40)] + [(99, " ".join(f"{u} {w}" for u in words for w in words), False)] + [(100 + i, w, False) for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "id long, text string, trained boolean")
    vocabulary = lm.count_words(docs, "text", "trained").cache()
    model = lm.fit(docs, vocabulary)
    deal, model_rows = model.deal, [r.asDict() for r in model.buckets.unionByName(model.answers).collect()]
    every = [*words, ""]
    raw, off = textops.buffers(pa.array(every))
    name = lm.names(raw, off[:-1], off[1:], deal.seed)
    spelled = (10 ** model.spelled.words(raw, np.diff(off))).sum()
    for u in name[:-1]:
        total = 0.0
        for w in name:
            own = [r for r in model_rows if r["place"] == deal.bucket(np.array([u]), np.array([w]))[0]]
            one, zero = np.ones(1, np.int64), np.zeros(1, np.int64)
            text_row = lm.row(own[0]["place"], lm.TEXTS, 7, np.array([u]), one, np.array([w]), zero, zero, one)
            got = lm.scored(deal, model.levels, model.tops)(pa.Table.from_batches([lm.batch([*own, text_row])])).to_pylist()
            total += 10 ** lm.opened(got[-1]["c3"])[0]
        held = {s: np.zeros(2) for s in model.levels}  # customers and tables of u's restaurant
        for place in {r["place"] for r in model_rows}:
            mine = lm.Bucket([r for r in model_rows if r["place"] == place])
            at = mine.contexts[mine.context] == u
            for s, tables in zip(sorted(model.levels), (mine.before, mine.seating.tables)):
                held[s] += mine.seating.customers[at].sum(), tables[at].sum()
        rest = np.mean([(v.strength + v.discount * held[s][1]) / (v.strength + held[s][0]) * (t.strength + t.discount * t.tables) / (t.strength + t.customers) for (s, v), t in zip(model.levels.items(), model.tops.values())])
        assert total + rest * (1 - spelled) == pytest.approx(1, abs=2e-5)
    key = (0x2020 << 8) | np.arange(256)
    assert model.spelled.mixed(key).sum() == pytest.approx(1) and model.spelled.mixed((0x6162 << 8) | np.arange(256)).sum() == pytest.approx(1)


def test_seating_follows_the_enumerated_posterior():
    """Two dishes of one restaurant, in many copies: after some moves the tables are distributed as by summing over all seatings."""
    from collections import Counter
    from itertools import product

    customers, chance, strength, discount = (5, 3), (0.5, 0.3), 2.0, 0.5

    def paths(c):
        for bits in product((0, 1), repeat=c - 1):
            t, w = 1, 1.0
            for seated, opens in enumerate(bits, 1):
                w *= 1 if opens else seated - discount * t
                t += opens
            yield t, w

    want = Counter()
    for (t1, w1), (t2, w2) in product(paths(5), paths(3)):
        w = w1 * w2 * chance[0] ** t1 * chance[1] ** t2
        for k in range(1, t1 + t2):
            w *= strength + k * discount
        want[t1, t2] += w
    z, copies, rng = sum(want.values()), 20_000, np.random.default_rng(3)
    one = [pitman_yor.at_one_table(np.full(copies, c)) for c in customers]
    for step in range(30):
        i = step % 2
        held = one[0].tables + one[1].tables
        one[i] = pitman_yor.move(rng, one[i], held, np.full(copies, chance[i]), strength, discount)
        assert (np.bincount(one[i].owners(), minlength=copies) == one[i].tables - 1).all()
    got = Counter(zip(one[0].tables.tolist(), one[1].tables.tolist()))
    assert max(abs(got[k] / copies - v / z) for k, v in want.items()) < 0.012
    grown = pitman_yor.with_customers(rng, one[0], np.full(copies, 9), held, np.full(copies, 0.5), strength, discount)
    shrunk = pitman_yor.with_customers(rng, grown, np.full(copies, 1), held, np.full(copies, 0.5), strength, discount)
    assert (grown.tables >= one[0].tables).all() and (shrunk.tables == 1).all() and not len(shrunk.openers)


def test_grid_evidence_is_the_chance_of_the_seating():
    """A restaurant of dishes with 4 and 1 customers, tables opened by the 1st and 3rd: against the product of all odds."""
    s = pitman_yor.Seating(np.array([4, 1]), np.array([2, 1]), np.array([3]))
    i, j = 3, 2
    d, strength = pitman_yor.DISCOUNTS[i], pitman_yor.STRENGTHS[j]
    opened = (strength + d) * (strength + 2 * d)
    joined = (1 - d) * (3 - 2 * d)
    sums = np.prod([strength + k for k in range(1, 5)])
    got = pitman_yor.dish_evidence(s)[i] + pitman_yor.restaurant_evidence(np.array([5]), np.array([3])).reshape(len(pitman_yor.DISCOUNTS), -1)[i, j]
    assert got == pytest.approx(np.log(opened * joined / sums))


def test_lm_knows_word_order_and_beats_the_base(spark):
    """Texts of pairs that always go together: held-out ones score above the base, shuffled ones below themselves in order."""
    rng = random.Random(5)
    pairs = [(f"left{i}", f"right{i}") for i in range(30)]
    rows, k = [], 0
    for i in range(400):
        w = [x for _ in range(20) for x in rng.choice(pairs)]
        rows.append((i, " ".join(w)))
        k = i + 1
    shuffled = [(k + i, " ".join(sorted(t.split()))) for i, t in rows if zlib.crc32(str(k + i).encode()) % 5 == 1]
    got = {r.doc_id: r for r in lm.lm_scores(spark.createDataFrame(rows + shuffled, "doc_id long, text string")).collect()}
    held = [got[i] for i, _ in rows if got[i].held_out]
    mean = lambda rs, f: sum(f(r) for r in rs) / sum(r.n_tokens for r in rs)
    assert mean(held, lambda r: r.score) > mean(held, lambda r: r.base_score) + 0.4
    assert mean([got[i] for i, _ in shuffled], lambda r: r.score) < mean(held, lambda r: r.score) - 0.3


def test_lm_splits_frequent_contexts_and_counts_colliding_words(spark, monkeypatch):
    """Many small buckets, a previous word of half of all tokens, and the Thue-Morse pair."""
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 50)
    monkeypatch.setattr(lm, "LEAST_TOKENS", 50)
    pair = thue_morse(1024)
    rows = [(i, " ".join(f"the {w}" for w in random.Random(i).sample("abcdefghij", 5))) for i in range(60)] + [(i, pair[0]) for i in range(60, 70)] + [(200 + i, pair[1]) for i in range(10)]
    train = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 != 1}
    count = {}
    for i, t in rows:
        for w in t.split():
            count[w] = count.get(w, 0) + (i in train)
    got = {r.doc_id: r for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i].n_known == 1 + sum(count[w] > 0 for w in t.split()) and np.isfinite(got[i].score) and got[i].score < 0
    n = sum(count.values()) + len(train)
    v = sum(c > 0 for c in count.values()) + 1
    base = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    for i, w in ((60, pair[0]), (200, pair[1])):
        assert got[i].base_score == pytest.approx(base(count[w]) + base(len(train)))


def test_exact_dedup_keeps_one_row_of_null_ids(spark):
    rows = [(None, t) for t in ["same"] * 5 + ["Same", "other", "other", "alone", "named", "named"]] + [(7, "named"), (3, "named")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for keep_columns in (False, True):
        got = exact_dedup.exact_dedup(df, keep_columns=keep_columns)
        assert got.count() == len(rows)
        by_text = got.where("kept").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("i")).collect()
        assert {r.text_sha256: (r.n, r.i) for r in by_text} == {hashlib.sha256(t.encode()).hexdigest(): (1, i) for t, i in [("same", None), ("other", None), ("alone", None), ("named", 7)]}


def fingerprint(text, n):
    w = WORD.findall((text or "").translate(LOW))
    grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows, empty, odd):
    prints = {i: fingerprint(t, 4) for i, t, *_ in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in simhash.near_dedup(docs).collect()}
    assert all(got[i].fingerprint == f"{p:016x}" and got[i].component_id == find(i) for i, p in prints.items())
    assert simhash.near_dedup(empty).count() == 0
    assert {(r.doc_id, r.component_id) for r in simhash.near_dedup(odd).collect()} == {(None, 1), (1, 1), (2, 1), (3, 3), (4, 3)}


@pytest.mark.parametrize("distance", [1, 4, 10])
def test_pigeonhole_misses_no_link(spark, distance):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(30)]
    flip = lambda x: x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 14)))
    values = sorted({flip(rng.choice(base)) for _ in range(600)})
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if bin(a ^ b).count("1") <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    links = simhash.near_links(spark.createDataFrame([(signed(v),) for v in values], "fp long"), distance, 4)
    got = {r.node: r.root for r in components.components(links).collect()}
    groups = lambda f: sorted(sorted(g) for g in _groups(values, f))
    assert groups(find) == groups(lambda v: got.get(signed(v), signed(v)))


def _groups(values, f):
    out = {}
    for v in values:
        out.setdefault(f(v), []).append(v)
    return out.values()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_verified_groups(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    near = [*base[:100], "new", *base[101:]]
    other = [f"v{rng.randrange(5000)}" for _ in range(200)]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(other)), (4, None), (5, " ".join(base[:60] + other[:140]))], "doc_id long, text string")
    assert {(r.node, r.root) for r in simhash.verified_groups(df).collect()} == {(2, 1)}


def grams_of(text, n=5):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(" ".join(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([" ".join(w)] if w else [])


def near_groups(rows, least=0.8):
    """{node: root} by comparing every pair of shingle sets, and the pairs that are near."""
    sets, root, pairs = {i: grams_of(t) for i, t in rows}, {i: i for i, _ in rows}, []

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b:
                shared, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
                if not union or shared >= least * union:
                    pairs.append((a, b, shared / union if union else 1.0))
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets if find(i) != i}, pairs


def copies(seed, pairs):
    """Pairs of texts of a similarity of 0.75 to 1: words changed one by one."""
    rng, rows = random.Random(seed), []
    for k in range(pairs):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 200))]
        other = list(base)
        for _ in range(rng.randrange(1, 1 + max(1, len(base) // 45))):
            other[rng.randrange(len(base))] = "new"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    return rows


def test_near_copies_are_all_found(spark):
    rows = copies(3, 300)
    want, pairs = near_groups(rows)
    print_of = {i: fingerprint(t, 5) for i, t in rows}
    far = [p for p in pairs if bin(print_of[p[0]] ^ print_of[p[1]]).count("1") > 10]
    assert len(far) > 10 and min(p[2] for p in pairs) < 0.82  # fingerprints alone miss these
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.node: r.root for r in simhash.verified_groups(df).collect()} == want


def test_near_copies_that_repeat_lines_and_large_buckets(spark):
    rng = random.Random(4)
    line = [f"l{i}" for i in range(12)]
    rows = []
    for i in range(120):  # one repeated line rules the fingerprint; rests differ, and some are copies
        rest = [f"r{i // 4}x{j}" for j in range(rng.randrange(16, 30))]
        rows.append((i, " ".join(line * rng.randrange(1, 40) + rest)))
    want, _ = near_groups(rows)
    assert len(want) > 20 and len(set(want.values())) > 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.node: r.root for r in simhash.verified_groups(df).collect()} == want


def test_a_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.randrange(8)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    want, near = near_groups(rows)
    assert len(near) > 10_000 and len(want) < 399  # some copies are near no other one
    made = []

    def counted(df, name, path=None, write=simhash.materialize):
        out = write(df, name, path)
        if name == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.node: r.root for r in simhash.verified_groups(df).collect()} == want
    assert made and max(made) <= 2 * len(rows), made


def kept_words(rows, window=13):
    words = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][j : j + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_substring_dedup(docs, rows, batches, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MERGE_ROWS", 50)  # anchors go over many merge steps
    monkeypatch.setattr(substring_dedup, "CHUNK", 2_000)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(docs, batches=batches).collect()}
    assert got == kept_words([r[:2] for r in rows])


def test_substring_edges(empty, odd, spark):
    assert substring_dedup.remove_repeats(empty).count() == 0
    got = substring_dedup.remove_repeats(odd, keep_columns=True)
    assert got.columns.count("n_removed") == 1 and got.columns.count("spans") == 1
    assert sorted((r.doc_id or 0, r.n_removed) for r in got.collect()) == [(0, 0), (1, 0), (1, 0), (2, 30), (3, 0), (3, 0), (4, 0)]


def test_substring_index_goes_on(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    first = spark.createDataFrame([(1, passage)], "doc_id long, text string")
    later = spark.createDataFrame([(9, "a " + passage + " b"), (10, "c d")], "doc_id long, text string")
    index = substring_dedup.SubstringIndex(spark, 4)
    assert substring_dedup.remove_repeats(first, index=index).first().n_removed == 0
    assert {r.doc_id: r.kept_text for r in substring_dedup.remove_repeats(later, index=index).collect()} == {9: "a b", 10: "c d"}
    index.drop()


def test_lz_fingerprint(docs, rows, empty, odd, spark):
    for df in (docs, docs.limit(1)):
        texts = sorted((r.doc_id, r.text or "") for r in df.collect())
        got = {r.doc_id: r for r in lz_fingerprint.fingerprints(df).collect()}
        for k, (i, t) in enumerate(texts):
            changed = lz_fingerprint.edited(t, texts[(k + 1) % len(texts)][1])
            r = got[i]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
            assert r.fingerprint == lz_fingerprint.to_text(lz_fingerprint.fingerprint(t)) and r.edited_fingerprint == lz_fingerprint.to_text(lz_fingerprint.fingerprint(changed))
            assert 0 <= r.near_next <= 1 and (r.near_edited == 1 or t != changed)
    assert lz_fingerprint.fingerprints(empty).count() == 0 and lz_fingerprint.fingerprints(odd).count() == 7


def test_lz_fingerprint_by_definition():
    """Against an LZ78 parse of tuples of units, and unspaced text that is shifted by one character."""
    def units(t):
        raw = [w for w in WORD.findall(t)] or [t]
        return [u for w in raw for u in (w if len(w.encode()) > lz_fingerprint.UNIT else [w])]

    rng = random.Random(9)
    for t in ("a b a b a b a", "", " ", "x" * 50, "a " * 40, "".join(chr(0x4E00 + rng.randrange(60)) for _ in range(200)) + " b b"):
        phrases, now = set(), ()
        for u in units(t):
            now += (u,)
            if now not in phrases:
                phrases.add(now)
                now = ()
        _, fresh = lz_fingerprint.parse(lz_fingerprint.units([t])[0].tolist(), set())
        assert len(fresh) == len(phrases)
    chinese = "".join(chr(0x4E00 + rng.randrange(800)) for _ in range(3000))
    likeness = lambda a, b: np.mean([x == y for x, y in zip(a, b)])
    slots = lambda t: (f := lz_fingerprint.to_text(lz_fingerprint.fingerprint(t))) and [f[i : i + 4] for i in range(0, len(f), 4)]
    assert likeness(slots(chinese), slots("中" + chinese)) > 0.3 > likeness(slots(chinese), slots(chinese[::-1]))


def test_pipeline_of_odd_rows(spark):
    """Null ids, repeated rows, no labels and no rows go through every stage; one of each group of copies stays."""
    pipeline = pytest.importorskip("corpus_pipeline")
    t, u = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(None, t), (None, t), (5, u), (5, u), (6, u.upper()), (7, None), (8, ""), (9, u + " end")]
    now = spark.createDataFrame([(i, x, None, "s", 1) for i, x in rows], SCHEMA)
    none = now.limit(0)
    for name, stage in pipeline.STAGES[:-1]:
        now, none = stage(spark, now, "").cache(), stage(spark, none, "")
        assert now.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ") and none.count() == 0, name
    texts = [r.text for r in now.collect()]
    assert sum(x == t for x in texts) == 1 and sum(x is not None and x.lower().startswith("v0") for x in texts) == 1


def test_lz_parts(docs, rows, monkeypatch):
    want = {r.doc_id: tuple(r) for r in lz_fingerprint.fingerprints(docs).collect()}
    monkeypatch.setattr(lz_fingerprint, "PART_ROWS", 9)
    assert {r.doc_id: tuple(r) for r in lz_fingerprint.fingerprints(docs).collect()} == want


def test_warc(spark, tmp_path):
    rows = [(1, "http://a.example/1", "same"), (2, "http://a.example/ 2", "same"), (3, None, None), (4, "http://a.example/4", ""), (5, "http://a.example/5", "é\r\n\r\nx" * 2000), (None, "http://a.example/n", "alone"), (2, "http://a.example/2b", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    index = warc.write_archives(pages, folder=str(tmp_path / "w"))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(index).collect()), key=str)
    top = {"same": 2, "": 4}
    want = []
    for i, _, h in rows:
        h = h or ""
        revisit = h in top and i != top[h]
        want.append((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if revisit else "response", top[h] if revisit else None))
    assert got == sorted(want, key=str)
    assert {bytes(r.payload).decode() for r in warc.read_archives(index.where("page_id = 5")).collect()} == {rows[4][2]}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    assert warc.ranges(np.array([0, 10, 10**6]), np.array([10, 5, 1])) == [(0, 2), (2, 3)]


def test_pipeline_stages(spark, docs, rows):
    pipeline = pytest.importorskip("corpus_pipeline")
    now = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, now, "").cache()
        assert out.columns == docs.columns and 0 < out.count() <= now.count(), name
        now = out
    texts = [r.text for r in now.collect()]
    assert len({t.translate(LOW) for t in texts}) == len(texts) and None not in texts
    packed = pipeline.STAGES[-1][1](spark, now, "")
    assert packed.select("doc_id").distinct().count() == now.count()
    left = kept_words([(r.doc_id, r.text) for r in now.collect()])
    assert sum(x[1] for x in left.values()) <= 13  # what is left shares no passages but across cuts


def thue_morse(n):
    w = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_words_of_equal_letters_in_another_order_are_told_apart(spark):
    """A word of 1,024 letters and its complement: equal under every polynomial hash modulo 2^64."""
    import tiktoken
    from tokenizers import Tokenizer

    pair = thue_morse(1024)
    raw, off = textops.buffers(pa.array(list(pair)))
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Encoder(path).encode(raw, off)] == [lib.encode_ordinary(t) for t in pair]
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.Counter(path).count(raw, off).tolist() == [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(list(pair), add_special_tokens=False)]
    head = " ".join(f"w{i}" for i in range(12))
    data = [(1, f"{head} {pair[0]}", "en", "a", 1), (2, f"{head} {pair[1]}", "en", "a", 1), (3, f"{head} {pair[0]}", "en", "a", 1)]
    cut = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(spark.createDataFrame(data, SCHEMA)).collect()}
    assert cut == {1: 0, 2: 0, 3: 13}


def test_pretokens_are_compared_whatever_their_hash(monkeypatch):
    """With one hash for all, every answer is still right."""
    monkeypatch.setattr(textops, "word_hashes", lambda raw, starts, stops, seed=0: np.zeros(len(starts), np.uint64))
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    texts = [r[1] or "" for r in corpus(30, 4)[:6]] + ["y" * 40 + " " + "z" * 40 + " " + "y" * 40]
    raw, off = textops.buffers(pa.array(texts))
    one = bpe.Encoder(path)
    for _ in range(2):
        got = one.encode(raw, off)
        assert [one.decode(x).decode() for x in got] == texts
    monkeypatch.undo()
    assert got == bpe.Encoder(path).encode(raw, off)


def test_log_gamma_and_cells_of_every_width():
    import math

    x = np.concatenate([np.linspace(1e-9, 20, 5_000), 10.0 ** np.arange(-9, 10)])
    want = np.array([math.lgamma(v) for v in x])
    assert np.allclose(pitman_yor.log_gamma(x), want, rtol=1e-9, atol=1e-9)
    for v in (np.arange(0), np.arange(9), np.arange(9) * 300, np.arange(9) * 70_000, np.arange(9) << 40, np.arange(9) / 7):
        got = lm.opened(lm.cell(v))
        assert len(got) == len(v) and (got == v).all()
