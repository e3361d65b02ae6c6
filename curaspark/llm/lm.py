"""LM scoring with a hierarchical Pitman-Yor model: restaurants of the previous word, which share the word restaurant as
their parent, over a spelling model.

Tokens are lower-cased words and one end per text; the end is also what comes before a text's first word. A table of a
context's restaurant is one customer of the word restaurant; its base measure spells the word byte by byte. Seatings are
sampled by Gibbs moves (pitman_yor.py), discounts and strengths of both levels by griddy Gibbs steps, and the predictive
probabilities of the last SAMPLES sweeps are averaged.

Spark deals all of it out. A word's name is a 64-bit hash that is checked to tell all words of the corpus apart.

* Pairs (previous word, word) of each chunk of texts, counted, go to buckets of about BUCKET_TOKENS tokens by a hash of
  the previous word; of a frequent previous word also by a hash of the word, so that no restaurant is one task's.
* A sweep visits the buckets: each seats its restaurants given the parent's probabilities, and sends its tables of
  each word to the word's group. The groups seat their words in the word restaurant and answer.
* Texts are sent to the buckets as pairs too, scored there, and summed for each chunk of texts.

Rows between these steps are packed arrays, one row for each chunk and bucket. The driver sees sums only: the
evidence for each point of the parameters' grid, and two totals for each frequent previous word (HOT at most).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.llm import pitman_yor, textops
from curaspark.llm.bpe import gather
from curaspark.llm.langid import held_out
from curaspark.llm.pitman_yor import Seating
from curaspark.llm.storage import drop, materialize, new_path

#: The first sweep opens one table a dish, the next is burn-in, the last SAMPLES (two at most: as many seatings are kept) are averaged.
SWEEPS, SAMPLES, MOVES = 4, 2, 2
#: Parts in which texts are sent to be scored: the disk that the rows take on their way is that of one part.
PARTS = 3
FOLD = 1
#: Bytes of text that are counted or sent at once, and tokens of a bucket.
CHUNK_BYTES = 4 << 20
BUCKET_TOKENS, LEAST_TOKENS = 2_000_000, 250_000
#: Previous words of more than one in HOT tokens are frequent: there are fewer than HOT of them.
HOT = 1 << 16
#: Bytes that the spelling model looks at: its table has at most 256 ** SPELLING rows.
SPELLING, SPELLING_DISCOUNT = 3, 0.75
END_OF_WORD = 0x20

_U = np.uint64
PAIRS, MODEL, ANSWER, TEXTS, IDS, SCORES, WORDS, TABLES, EVIDENCE, TOTALS = range(10)
CELLS = [f"c{i}" for i in range(8)]
SPEC = "place long, kind int, key long, sums array<double>, " + ", ".join(f"{c} binary" for c in CELLS)
SCHEMA = pa.schema([("place", pa.int64()), ("kind", pa.int32()), ("key", pa.int64()), ("sums", pa.list_(pa.float64())), *((c, pa.binary()) for c in CELLS)])


_pack, _unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def cell(x: np.ndarray) -> bytes:
    """An array as compressed bytes, the first bytes of all numbers first; integers in the fewest that hold them."""
    if x.dtype.kind in "iu":
        most = int(x.max()) if len(x) else 0
        x = x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)
    width = x.dtype.itemsize
    data = np.empty((width, len(x)), np.uint8)
    for k, plane in enumerate(data):
        plane[:] = np.ascontiguousarray(x).view(np.uint8)[k::width]
    return x.dtype.str[1:].encode() + _pack.compress(data.tobytes())


def opened(b: bytes) -> np.ndarray:
    kind = np.dtype(b[:2].decode())
    x = np.frombuffer(_unpack.decompress(b[2:]), np.uint8)
    x = np.ascontiguousarray(x.reshape(kind.itemsize, -1).T).view(kind).ravel()
    return x.astype(np.int64) if kind.kind == "u" and kind.itemsize < 8 else x


def rises(index: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Numbers that rise within each run, as differences; sums() undoes it."""
    out = index.copy()
    out[1:] -= index[:-1]
    first = np.cumsum(runs) - runs
    out[first] = index[first]
    return out


def sums(steps: np.ndarray, runs: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps)
    first = np.cumsum(runs) - runs
    return total - np.repeat(total[first] - steps[first], runs)


def row(place: int, kind: int, key: int, *arrays: np.ndarray, sums=None) -> dict:
    return {"place": place, "kind": kind, "key": key, "sums": sums} | {c: cell(x) if isinstance(x, np.ndarray) else x for c, x in zip(CELLS, arrays, strict=False)}


def batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, SCHEMA)


def slices(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    lengths = stops - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(gather(raw, starts, lengths).tobytes())])


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return textops.buffers(words.cast(pa.large_binary()).view(pa.large_string()))


def names(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int) -> np.ndarray:
    return textops.word_hashes(raw, starts, stops, 1000 + seed)


def no_word(seed: int) -> np.uint64:
    """The name of the end."""
    return names(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64), seed)[0]


# ---- words and their spelling


def count_words(docs: DataFrame, text_col: str, train: str | None = None) -> DataFrame:
    """(word binary, c, a): words of all texts, lower-cased, and the empty word for each text's end; a: their number, c: in rows
    where the column train is true. Words are told apart by their bytes."""

    def run(batches):
        for part in batches:
            flag = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([int(flag.sum())]), pa.array([len(flag)])], names=["word", "c", "a"])
            raw, off = textops.buffers(part.column(0))
            for lo, hi in textops.chunks(off, CHUNK_BYTES):
                low = textops.LOWER[raw[off[lo] : off[hi]]]
                starts, stops, rows = textops.words(low, off[lo : hi + 1] - off[lo])
                if not len(starts):
                    continue
                # equal hashes of a chunk are one row only if lengths and bytes agree, block by block
                h = textops.word_hashes(low, starts, stops)
                order = np.argsort(h)
                new = np.ones(len(h), bool)
                a, b = order[:-1], order[1:]
                blocks = textops.word_blocks(low, starts, stops, 2)
                size = stops - starts
                same = (h[a] == h[b]) & (size[a] == size[b]) & (blocks[:, a] == blocks[:, b]).all(axis=0)
                for i in np.flatnonzero(same & (size[a] > 16)).tolist():
                    same[i] = (low[starts[a[i]] : stops[a[i]]] == low[starts[b[i]] : stops[b[i]]]).all()
                new[1:] = ~same
                trained = flag[lo:hi][np.searchsorted(rows, order, "right") - 1].astype(np.int64)
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(h)))
                yield pa.RecordBatch.from_arrays([slices(low, starts[order[at]], stops[order[at]]), pa.array(np.add.reduceat(trained, at)), pa.array(n)], names=["word", "c", "a"])

    flag = F.coalesce(F.col(train), F.lit(False)) if train else F.lit(True)
    return docs.select(F.col(text_col).alias("text"), flag.alias("t")).mapInArrow(run, "word binary, c long, a long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))


def byte_keys(data: np.ndarray, lengths: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The last `order` bytes up to each byte of each word and its end, as one number; and each word's first place."""
    first = np.cumsum(lengths + 1) - lengths - 1
    size = int(lengths.sum()) + len(lengths)
    out = np.full(size, END_OF_WORD, np.int64)
    hole = np.ones(size, bool)
    hole[first + lengths] = False
    out[hole] = data
    key, place = out.copy(), np.arange(size) - np.repeat(first, lengths + 1)
    for back in range(1, order):
        before = np.full(size, END_OF_WORD, np.int64)
        before[back:] = out[:-back]
        before[place < back] = END_OF_WORD
        key |= before << (8 * back)
    return key, first


@dataclass
class Spelling:
    """For each context length, shortest first: sorted keys (context << 8 | byte) and their masses, contexts and their shares of
    the parent. Absolute discounting; the shorter contexts count each longer one once."""

    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def mixed(self, key: np.ndarray) -> np.ndarray:
        p = np.full(len(key), 1 / 256)
        for i, (keys, mass, contexts, share) in enumerate(self.levels):
            k = key & ((1 << (8 * (i + 1))) - 1)
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            own = np.where(keys[at] == k, mass[at], 0.0)
            at = np.minimum(np.searchsorted(contexts, k >> 8), len(contexts) - 1)
            p = own + np.where(contexts[at] == k >> 8, share[at], 1.0) * p
        return p

    def words(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 of the probability of each spelling; data: the words' bytes, joined."""
        key, first = byte_keys(data, lengths, SPELLING)
        return np.add.reduceat(np.log10(self.mixed(key)), first) if len(first) else np.zeros(0)


def spelling(vocabulary: DataFrame) -> Spelling:
    """From the distinct training words."""

    def run(batches):
        for part in batches:
            raw, off = _bytes(part.column(0))
            keys, n = np.unique(byte_keys(raw, np.diff(off), SPELLING)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    got = vocabulary.where("c > 0").select("word").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, n = got.column("key").to_numpy(), got.column("n").to_numpy().astype(np.float64)
    order = np.argsort(keys)
    keys, n, out = keys[order], n[order], []
    for length in range(SPELLING if len(keys) else 0, 0, -1):
        contexts, which = np.unique(keys >> 8, return_inverse=True)
        total, kinds = np.bincount(which, n), np.bincount(which)
        out.append((keys, (n - SPELLING_DISCOUNT) / total[which], contexts, SPELLING_DISCOUNT * kinds / total))
        keys, n = np.unique(keys & ((1 << (8 * (length - 1))) - 1), return_counts=True)
        n = n.astype(np.float64)
    return Spelling(out[::-1])


# ---- pairs


@dataclass
class Deal:
    """How pairs are dealt out: buckets, and the names of frequent previous words with the parts of each."""

    seed: int
    buckets: int
    hot: np.ndarray
    parts: np.ndarray

    def bucket(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        part = np.zeros(len(before), _U)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, before), len(self.hot) - 1)
            split = np.flatnonzero(self.hot[at] == before)
            part[split] = textops.mix(word[split]) % self.parts[at[split]]
        return (textops.mix(before ^ (part * _U(0x9E3779B97F4A7C15))) % _U(self.buckets)).astype(np.int64)

    def group(self, name: np.ndarray) -> np.ndarray:
        """Words' groups: ranges of names."""
        return (name // _U(-(-(2**64) // self.buckets))).astype(np.int64) if self.buckets > 1 else np.zeros(len(name), np.int64)

    def is_hot(self, name: np.ndarray) -> np.ndarray:
        return np.isin(name, self.hot)


def tokens(raw: np.ndarray, off: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all tokens of the rows, and n+1 offsets into them."""
    low = textops.LOWER[raw]
    starts, stops, rows = textops.words(low, off)
    out = np.full(len(starts) + len(off) - 1, no_word(seed), _U)
    n = np.diff(rows)
    out[np.arange(len(starts)) + np.repeat(np.arange(len(n)), n)] = names(low, starts, stops, seed)
    return out, rows + np.arange(len(rows))


def packed_pairs(deal: Deal, kind: int, key: int, word: np.ndarray, more: np.ndarray | None, times: np.ndarray) -> Iterator[dict]:
    """Rows of a chunk's distinct (previous word, word[, more]) and their times, one for each bucket: previous words, their
    numbers of pairs, words, each pair's word, [more,] times."""
    every, which = np.unique(word, return_inverse=True)
    before = np.empty_like(which)
    before[1:] = which[:-1]
    before[:1] = np.searchsorted(every, no_word(deal.seed))
    size = len(every)
    pair = before.astype(np.int64) * size + which
    if more is not None:
        span = int(more.max()) + 1
        pair = pair * span + more
    order = np.argsort(pair)
    pair = pair[order]
    head = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    times = np.add.reduceat(times[order], head)
    pair = pair[head]
    extra = []
    if more is not None:
        extra, pair = [pair % span], pair // span
    a, b = pair // size, pair % size
    bucket = deal.bucket(every[a], every[b])
    order = np.argsort(bucket.astype(np.uint16) if deal.buckets < 1 << 16 else bucket, kind="stable")
    bucket = bucket[order]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    for lo, hi in zip(edges, edges[1:]):
        at = order[lo:hi]
        run = np.flatnonzero(np.concatenate([[True], a[at][1:] != a[at][:-1]]))
        own, index = np.unique(b[at], return_inverse=True)
        runs = np.diff(np.append(run, len(at)))
        yield row(int(bucket[lo]), kind, key, every[a[at][run]], runs, every[own], rises(index, runs), *[x[at] for x in extra], times[at])


def pairs(docs: DataFrame, deal: Deal, kind: int) -> DataFrame:
    """PAIRS rows of (id, text, trained): each bucket's pairs of a chunk, with how often in trained rows (0: in others only); or TEXTS rows, with
    the row in the chunk too, and one IDS row for each chunk."""

    def run(batches):
        for part in batches:
            raw, off = textops.buffers(part.column(1))
            for lo, hi in textops.chunks(off, CHUNK_BYTES):
                word, rows = tokens(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], deal.seed)
                n = np.diff(rows)
                number = np.repeat(np.arange(hi - lo), n)
                if kind == PAIRS:
                    trained = part.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64)
                    yield batch(list(packed_pairs(deal, kind, 0, word, None, trained[number])))
                else:
                    key = part.column(3)[lo].as_py()
                    sink = pa.BufferOutputStream()
                    ids = pa.RecordBatch.from_arrays([part.column(0).slice(lo, hi - lo)], names=["id"])
                    with pa.ipc.new_stream(sink, ids.schema) as writer:
                        writer.write_batch(ids)
                    rest = packed_pairs(deal, kind, key, word, number, np.ones(len(word), np.int64))
                    yield batch([row(key % deal.buckets, IDS, key, sink.getvalue().to_pybytes(), n), *rest])

    return docs.mapInArrow(run, SPEC)


def unpacked_pairs(r: dict, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Previous word and word of each pair of a row, by their places in the sorted names."""
    runs = opened(r["c1"])
    return np.repeat(np.searchsorted(contexts, opened(r["c0"]).view(_U)), runs), np.searchsorted(words, opened(r["c2"]).view(_U))[sums(opened(r["c3"]), runs)]


# ---- buckets and groups


@dataclass
class Level:
    """What the driver knows of a level after a sweep: its parameters, and sums of the word restaurant or of frequent contexts."""

    strength: float = 1.0
    discount: float = 0.5
    customers: float = 0.0
    tables: float = 0.0
    hot_customers: np.ndarray = field(default_factory=lambda: np.zeros(0))
    hot_tables: np.ndarray = field(default_factory=lambda: np.zeros(0))


class Bucket:
    """The restaurants of a bucket: sorted contexts and words, the pairs sorted by (context, word), and their seating."""

    def __init__(self, rows: list[dict]):
        old = [r for r in rows if r["kind"] == MODEL]
        if old:
            r = old[0]
            self.contexts, runs, self.words = opened(r["c0"]).view(_U), opened(r["c1"]), opened(r["c2"]).view(_U)
            self.word = sums(opened(r["c3"]), runs)
            self.context = np.repeat(np.arange(len(runs)), runs)
            self.seating = Seating(opened(r["c4"]), opened(r["c5"]), opened(r["c6"]))
            self.before = opened(r["c7"])  # tables of the sweep before
        else:
            rows = [r for r in rows if r["kind"] == PAIRS]
            self.contexts, self.words = (np.unique(np.concatenate([opened(r[x]).view(_U) for r in rows])) for x in ("c0", "c2"))
            a, b, n = map(np.concatenate, zip(*((*unpacked_pairs(r, self.contexts, self.words), opened(r["c4"])) for r in rows), strict=True))
            pair, which = np.unique(a * len(self.words) + b, return_inverse=True)
            self.context, self.word = pair // len(self.words), pair % len(self.words)
            self.seating = pitman_yor.at_one_table(np.bincount(which, n).astype(np.int64))
            self.before = self.seating.tables

    def totals(self, x: np.ndarray, deal: Deal, hot: np.ndarray) -> np.ndarray:
        """Sums of x over each context; of a frequent one, that of all buckets."""
        out = np.bincount(self.context, x, len(self.contexts))
        if len(hot):
            at = np.minimum(np.searchsorted(deal.hot, self.contexts), len(deal.hot) - 1)
            out = np.where(deal.hot[at] == self.contexts, hot[at], out)
        return out

    def seat(self, rng, deal: Deal, level: Level, parent: np.ndarray) -> None:
        self.before = self.seating.tables
        for _ in range(MOVES):
            held = self.totals(self.seating.tables, deal, level.hot_tables)
            self.seating = pitman_yor.move(rng, self.seating, held[self.context], parent[self.word], level.strength, level.discount)

    def model(self, place: int) -> dict:
        runs = np.bincount(self.context, minlength=len(self.contexts))
        return row(place, MODEL, 0, self.contexts, runs, self.words, rises(self.word, runs), self.seating.customers, self.seating.tables, self.seating.openers, self.before)

    def sent(self, place: int, deal: Deal) -> Iterator[dict]:
        """The tables of each word, to its group."""
        n = np.bincount(self.word, self.seating.tables, len(self.words)).astype(np.int64)
        group = deal.group(self.words)
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        for lo, hi in zip(edges, edges[1:]):
            yield row(int(group[lo]), TABLES, place, self.words[lo:hi], n[lo:hi])

    def evidence(self, place: int, deal: Deal) -> Iterator[dict]:
        hot = deal.is_hot(self.contexts)
        c, t = np.bincount(self.context, self.seating.customers, len(self.contexts)), np.bincount(self.context, self.seating.tables, len(self.contexts))
        yield row(place, EVIDENCE, 0, sums=np.concatenate([pitman_yor.dish_evidence(self.seating), pitman_yor.restaurant_evidence(c[~hot], t[~hot])]).tolist())
        for k in np.flatnonzero(hot).tolist():
            yield row(place, TOTALS, int(self.contexts[k].view(np.int64)), sums=[float(c[k]), float(t[k])])


class Answers:
    """What a bucket's words have from their groups: c, log10 of the base's probability, and for each sample the word restaurant's
    probability and its share of the base."""

    def __init__(self, rows: list[dict], words: np.ndarray, deal: Deal, tops: dict[int, Level]):
        self.c, self.base = np.zeros(len(words)), np.zeros(len(words))
        self.parent = {s: np.zeros(len(words)) for s in tops}
        self.share = {s: (top.strength + top.discount * top.tables) / (top.strength + top.customers) for s, top in tops.items()}
        group = deal.group(words)
        for r in rows:
            if r["kind"] == ANSWER and r["key"] in tops:
                group_of = int(opened(r["c0"])[0])
                at, top = slice(*np.searchsorted(group, [group_of, group_of + 1])), tops[r["key"]]
                base, own = opened(r["c2"]).astype(np.float64), opened(r["c1"]).astype(np.float64)
                self.c[at], self.base[at] = opened(r["c3"]), base
                self.parent[r["key"]][at] = own / (top.strength + top.customers) + self.share[r["key"]] * 10**base


def visit(deal: Deal, sweep: int, level: Level, tops: dict[int, Level]):
    """A bucket's part of a sweep; the first makes its restaurants, with one table a dish."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        place = rows[0]["place"]
        mine = Bucket(rows)
        if tops:
            (sample,) = tops
            mine.seat(np.random.default_rng([sweep, place, 1]), deal, level, Answers(rows, mine.words, deal, tops).parent[sample])
        return pa.Table.from_batches([batch([mine.model(place), *mine.sent(place, deal), *mine.evidence(place, deal)])])

    return run


def group_visit(sweep: int, level: Level):
    """A group's part of a sweep: seats its words in the word restaurant and answers each bucket."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted((r for r in table.to_pylist() if r["kind"] in (WORDS, TABLES)), key=lambda r: (r["kind"], r["key"], r["c0"]))
        place, rng = table.column("place")[0].as_py(), np.random.default_rng([sweep, table.column("place")[0].as_py(), 2])
        own = [r for r in rows if r["kind"] == WORDS]
        word = np.concatenate([opened(r["c0"]).view(_U) for r in own])
        order = np.argsort(word)
        word = word[order]
        c, base = np.concatenate([opened(r["c1"]) for r in own])[order], np.concatenate([opened(r["c2"]) for r in own])[order]
        if own[0]["c3"] is None:
            seating = pitman_yor.at_one_table(np.zeros(len(word), np.int64))
        else:  # one sorted row
            seating = Seating(*(opened(own[0][x]) for x in ("c3", "c4", "c5")))
        sent = [(r["key"], np.searchsorted(word, opened(r["c0"]).view(_U)), opened(r["c1"])) for r in rows if r["kind"] == TABLES]
        customers = np.zeros(len(word), np.int64)
        for _, at, n in sent:
            customers[at] += n
        held, p = np.full(len(word), level.tables), 10 ** base.astype(np.float64)
        seating = pitman_yor.with_customers(rng, seating, customers, held, p, level.strength, level.discount)
        for _ in range(MOVES):
            seating = pitman_yor.move(rng, seating, held, p, level.strength, level.discount)
        mass = np.maximum(customers - level.discount * seating.tables, 0)
        out = [row(place, WORDS, 0, word, c, base, seating.customers, seating.tables, seating.openers)]
        out += [row(bucket, ANSWER, sweep, np.array([place]), mass[at].astype(np.float32), base[at], c[at]) for bucket, at, _ in sent]
        out.append(row(place, EVIDENCE, 0, sums=[*pitman_yor.dish_evidence(seating), float(customers.sum()), float(seating.tables.sum())]))
        return pa.Table.from_batches([batch(out)])

    return run


def scored(deal: Deal, levels: dict[int, Level], tops: dict[int, Level]):
    """A bucket's scores of the pairs sent to it: for each chunk, rows there, their known tokens, base and model log10 probabilities."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        place = rows[0]["place"]
        out = [r for r in rows if r["kind"] == IDS]
        texts = [r for r in rows if r["kind"] == TEXTS]
        if texts:
            mine = Bucket(rows)
            answers = Answers(rows, mine.words, deal, tops)
            c = mine.seating.customers
            total = mine.totals(c, deal, next(iter(levels.values())).hot_customers)
            tables = {s: t for s, t in zip(sorted(levels), (mine.before, mine.seating.tables)[-len(levels) :], strict=True)}
            chance, rest = np.zeros(len(c)), np.zeros(len(c))
            for s, level in levels.items():
                held, top = mine.totals(tables[s], deal, level.hot_tables), answers.parent[s]
                share = (level.strength + level.discount * held) / (level.strength + total)
                chance += np.maximum(c - level.discount * tables[s], 0) / (level.strength + total)[mine.context] + share[mine.context] * top[mine.word]
                rest += share[mine.context] * answers.share[s]
            # a spelling's own probability may be too small for a number
            score = np.where(chance > 1e-280, np.log10(np.maximum(chance, 1e-300) / len(levels)), np.log10(rest / len(levels)) + answers.base[mine.word])
            pair, size = mine.context * len(mine.words) + mine.word, len(mine.words)
            log_c, known = np.log10(answers.c + 0.5), answers.c > 0
        for r in texts:
            a, b = unpacked_pairs(r, mine.contexts, mine.words)
            at, number, times = np.searchsorted(pair, a * size + b), opened(r["c4"]), opened(r["c5"])
            own = np.flatnonzero(np.bincount(number))
            total = [np.bincount(number, times * x)[own] for x in (known[b], log_c[b], score[at])]
            out.append(row(place, SCORES, r["key"], own, total[0].astype(np.int64), *total[1:]))
        return pa.Table.from_batches([batch(out)])

    return run


def summed(kind: pa.DataType):
    """A chunk's rows: id, n, known, a, b."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["place"]))
        first = next(r for r in rows if r["kind"] == IDS)
        ids, n = pa.ipc.open_stream(first["c0"]).read_all().column(0), opened(first["c1"])
        known, a, b = np.zeros(len(n), np.int64), np.zeros(len(n)), np.zeros(len(n))
        for r in rows:
            if r["kind"] == SCORES:
                at = opened(r["c0"])
                known[at] += opened(r["c1"])
                a[at] += opened(r["c2"])
                b[at] += opened(r["c3"])
        return pa.table([ids.cast(kind), n, known, a, b], names=["id", "n", "known", "a", "b"])

    return run


# ---- the whole


@dataclass
class Model:
    """A fitted model: tables of the buckets (the last two sweeps' seating) and of the answers of the kept sweeps."""

    deal: Deal
    buckets: DataFrame
    answers: DataFrame
    levels: dict[int, Level]
    tops: dict[int, Level]
    spelled: Spelling
    n: int
    v: int


def _distinct_names(vocabulary: DataFrame) -> int:
    """The first seed under which all words have different names."""
    for seed in range(16):

        def run(batches, seed=seed):
            for part in batches:
                raw, off = _bytes(part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(names(raw, off[:-1], off[1:], seed).view(np.int64))], names=["name"])

        if not vocabulary.select("word").mapInArrow(run, "name long").groupBy("name").count().where("count > 1").limit(1).count():
            return seed
    raise ValueError("more words than 64-bit names can tell apart")


def _deal(vocabulary: DataFrame, seed: int) -> Deal:
    spark = vocabulary.sparkSession
    total = vocabulary.agg(F.sum("a")).first()[0]
    # as many as there are tasks, but none of very few tokens
    buckets = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // LEAST_TOKENS), -(-total // BUCKET_TOKENS))
    least = max(total / HOT, total / (4 * buckets))
    hot = vocabulary.where(F.col("a") > least).select("word", "a").toArrow()
    if not hot.num_rows:
        return Deal(seed, buckets, np.zeros(0, _U), np.zeros(0, _U))
    raw, off = _bytes(hot.column("word").combine_chunks())
    own = names(raw, off[:-1], off[1:], seed)
    order = np.argsort(own)
    parts = np.ceil(hot.column("a").to_numpy() * (4 * buckets / total)).astype(_U)
    return Deal(seed, buckets, own[order], parts[order])


def _words(vocabulary: DataFrame, deal: Deal, spelled: Spelling) -> DataFrame:
    """WORDS rows: names, c and log10 of the base's probabilities."""

    def run(batches):
        for part in batches:
            raw, off = _bytes(part.column(0))
            own = names(raw, off[:-1], off[1:], deal.seed)
            p, c = spelled.words(raw, np.diff(off)).astype(np.float32), part.column(1).to_numpy()
            order = np.argsort(own)
            group = deal.group(own[order])
            edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            yield batch([row(int(group[lo]), WORDS, 0, own[order[lo:hi]], c[order[lo:hi]], p[order[lo:hi]]) for lo, hi in zip(edges, edges[1:])])

    return vocabulary.select("word", "c").mapInArrow(run, SPEC)


def _sums(rows: DataFrame) -> np.ndarray:
    got = rows.where(F.col("kind") == EVIDENCE).select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    return np.array([r.x for r in sorted(got)])


def _totals(rows: DataFrame, deal: Deal) -> tuple[np.ndarray, np.ndarray]:
    got = rows.where(F.col("kind") == TOTALS).groupBy("key").agg(F.sum(F.col("sums")[0]).alias("c"), F.sum(F.col("sums")[1]).alias("t")).collect()
    c, t = np.zeros(len(deal.hot)), np.zeros(len(deal.hot))
    at = np.searchsorted(deal.hot, np.array([r.key for r in got], np.int64).view(_U))
    c[at], t[at] = [r.c for r in got], [r.t for r in got]
    return c, t


def fit(docs: DataFrame, vocabulary: DataFrame, sweeps: int = SWEEPS, samples: int = SAMPLES) -> Model:
    """Gibbs sweeps over docs (id, text, trained) and their counted words; the last `samples` (1 or 2) are averaged."""
    if not 1 <= samples <= min(2, sweeps):
        raise ValueError("one or two samples: the buckets keep their last two seatings")
    spark = docs.sparkSession
    n, v = vocabulary.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    deal, spelled = _deal(vocabulary, _distinct_names(vocabulary)), spelling(vocabulary)
    grouped = lambda df, run: df.groupBy("place").applyInArrow(run, SPEC)
    paths: list[list[str]] = []
    rng = np.random.default_rng(len(deal.hot))
    level, top, levels, tops = Level(), Level(), {}, {}
    buckets, words, answers = pairs(docs, deal, PAIRS), _words(vocabulary, deal, spelled), []
    for sweep in range(sweeps):
        mine = [new_path(spark, "buckets"), new_path(spark, "words")]
        source = buckets.unionByName(answers[-1]) if answers else buckets
        made = materialize(grouped(source, visit(deal, sweep, level, {sweep - 1: top} if answers else {})), "buckets", mine[0])
        sums, grid = _sums(made), len(pitman_yor.DISCOUNTS)
        hot_c, hot_t = _totals(made, deal)
        level = Level(*pitman_yor.draw_parameters(rng, sums[:grid], sums[grid:] + pitman_yor.restaurant_evidence(hot_c, hot_t)), hot_customers=hot_c, hot_tables=hot_t)
        seated = materialize(grouped(words.unionByName(made.where(F.col("kind") == TABLES)), group_visit(sweep, top)), "words", mine[1])
        sums = _sums(seated)
        c, t = sums[grid:]
        drawn = pitman_yor.draw_parameters(rng, sums[:grid], pitman_yor.restaurant_evidence(np.array([c]), np.array([t])))
        # masses in the answers are those of the parameters that the words were seated under
        tops[sweep] = Level(top.strength, top.discount, c, t)
        levels[sweep] = level
        top = Level(*drawn, c, t)
        buckets, words = made.where(F.col("kind") == MODEL), seated.where(F.col("kind") == WORDS)
        answers.append(seated.where(F.col("kind") == ANSWER))
        paths.append(mine)
        for old in paths[-2][:1] if sweep else []:
            drop(spark, old)
        for old in paths[-samples - 1][1:] if sweep >= samples else []:
            drop(spark, old)
    kept = range(max(0, sweeps - samples), sweeps)
    every = answers[kept[0]]
    for s in kept[1:]:
        every = every.unionByName(answers[s])
    return Model(deal, buckets, every, {s: levels[s] for s in kept}, {s: tops[s] for s in kept}, spelled, int(n), int(v))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = FOLD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each whole text.

    Learns from the rows whose crc32(id as text) mod 5 is not the fold (rows of null id are held out). base_score: add-half
    unigram; score: log10 probability under the model; perplexity is 10 ** (-score / n_tokens). A null or empty text is
    its end alone. Repeated rows count and are scored as often as they occur. With nothing to learn from, base_score is 0
    and score that of uniform bytes. An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (~held_out(id_col, fold)).alias("trained"), F.monotonically_increasing_id().alias("at"))
    vocabulary = materialize(count_words(own, "text", "trained"), "vocabulary")
    if not vocabulary.limit(1).count():
        return spark.createDataFrame([], f"{id_col} {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    model = fit(own, vocabulary)
    known = model.buckets.unionByName(model.answers)
    parts = []
    for i in range(PARTS):
        sent = known.unionByName(pairs(own.where(F.pmod(F.xxhash64("at"), F.lit(PARTS)) == i), model.deal, TEXTS))
        parts.append(materialize(sent.groupBy("place").applyInArrow(scored(model.deal, model.levels, model.tops), SPEC), "scores"))
    parts = reduce(DataFrame.unionByName, parts)
    kind = docs.schema[id_col].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    total = parts.groupBy("key").applyInArrow(summed(to_arrow_type(docs.schema[id_col].dataType)), f"id {kind}, n long, known long, a double, b double")
    norm = float(np.log10(model.n + 0.5 * (model.v + 1)))
    return total.select(
        F.col("id").alias(id_col), held_out("id", fold).alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"), (F.col("a") - F.col("n") * norm).alias("base_score"), F.col("b").alias("score"),
    )
