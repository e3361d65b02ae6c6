"""Byte-level BPE: vectorised pair merging of distinct pre-tokens, cached, and the encoding and decoding operators."""

from __future__ import annotations

import base64
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.llm import pretok, textops

#: Size of a worker's cache of distinct pre-tokens, in slots and in ids.
SLOTS, ARENA = 1 << 20, 1 << 22
#: Longer pre-tokens are merged one by one with a heap, in n log n.
LONG = 200
NONE = np.int64(1) << 40
DECODE_ROWS = 256


class Merges:
    """Ranks of adjacent pairs. parts: pairs of ids -> (rank, id of the merged)."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], byte_ids: list[int], size: int):
        self.size = size
        self.byte_ids = np.array(byte_ids, np.int64)
        keys = np.array([a * size + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in pairs.values()], np.int64)[order]
        self.merged = np.array([t for _, t in pairs.values()], np.int64)[order]
        self.pairs = pairs

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NONE), self.merged[at]

    def one(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost on ties, by a heap over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(self.pairs[p][0], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.pairs]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if not alive[i] or ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i] = self.pairs[a, b][1]
            alive[j] = False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (p := (ids[k], ids[after[k]])) in self.pairs:
                    heapq.heappush(heap, (self.pairs[p][0], k, *p))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def many(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece: every round merges the best pair of all pieces that still have one."""
        out: list = [None] * len(pieces)
        short = []
        for i, p in enumerate(pieces):
            if len(p) > LONG:
                out[i] = np.array(self.one(p), np.int64)
            else:
                short.append(i)
        if not short:
            return out
        raw = np.frombuffer(b"".join([pieces[i] for i in short]), np.uint8)
        owner = np.repeat(np.array(short), [len(pieces[i]) for i in short])
        ids = self.byte_ids[raw]
        rank, merged = np.full(len(ids), NONE), np.zeros(len(ids), np.int64)
        same = owner[1:] == owner[:-1]
        rank[:-1], merged[:-1] = self.look(ids[:-1], ids[1:])
        rank[:-1][~same] = NONE
        while len(ids):
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(heads, len(ids)))
            least = np.minimum.reduceat(rank, heads)
            done = np.repeat(least == NONE, sizes)
            if done.any():
                for k in np.flatnonzero(least == NONE).tolist():
                    h = heads[k]
                    out[owner[h]] = ids[h : h + sizes[k]].copy()
                keep = ~done
                ids, rank, merged, owner = ids[keep], rank[keep], merged[keep], owner[keep]
                if not len(ids):
                    break
                sizes = sizes[least != NONE]
                least = least[least != NONE]
            best = np.flatnonzero(rank == np.repeat(least, sizes))
            best = best[np.concatenate([[True], owner[best[1:]] != owner[best[:-1]]])]  # the leftmost
            ids[best] = merged[best]
            gone = best + 1
            keep = np.ones(len(ids), bool)
            keep[gone] = False
            moved = np.cumsum(keep) - 1
            ids, rank, merged, owner = ids[keep], rank[keep], merged[keep], owner[keep]
            at = moved[best]
            for p in (at, at[at > 0] - 1):
                rank[p] = NONE
                q = p[p + 1 < len(ids)]
                q = q[owner[q] == owner[q + 1]]
                rank[q], merged[q] = self.look(ids[q], ids[q + 1])
        return out


class Vocabulary:
    """tokens: bytes of each id; merges: the pairs and their ranks; special: strings matched before all else."""

    def __init__(self, tokens: dict[int, bytes], merges: Merges, whole_first: bool, special: dict[bytes, int]):
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.merges, self.special = merges, special
        #: pre-tokens that are tokens as they stand
        self.seed = {t: i for i, t in tokens.items()} if whole_first else {}


_loaded: dict[str, Vocabulary] = {}


def load(path: str) -> Vocabulary:
    """A .tiktoken rank file or a byte-level BPE .json; parsed once per worker."""
    if path not in _loaded:
        _loaded[path] = (_load_json if path.endswith(".json") else _load_ranks)(path)
    return _loaded[path]


def _load_ranks(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    size = max(ranks.values()) + 1
    pairs = {(ranks[t[:i]], ranks[t[i:]]): (r, r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
    return Vocabulary({r: t for t, r in ranks.items()}, Merges(pairs, [ranks[bytes([b])] for b in range(256)], size), True, {})


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in .json vocabularies: printable Latin-1 for itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _load_json(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, model = byte_letters(), spec["model"]
    special = {x["content"].encode(): x["id"] for x in spec.get("added_tokens", [])}
    tokens = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items() if i not in special.values() and all(c in letters for c in t)}
    ids = {t: i for i, t in tokens.items()}
    pairs = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = (bytes(letters[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
        pairs.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
    return Vocabulary(tokens | {i: t for t, i in special.items()}, Merges(pairs, [ids[bytes([b])] for b in range(256)], max(tokens) + 2), bool(model.get("ignore_merges")), special)


def gather(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices source[start : start + length], joined."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return source[:0]
    at = np.arange(ends[-1], dtype=np.int64)
    at += np.repeat(starts - (ends - lengths), lengths)
    return source[at]


#: Numbers of 8 bytes that hold a pre-token in the cache; longer ones are in a dictionary.
KEY_BLOCKS = 4
#: Pre-tokens in that dictionary.
LONG_KEPT = 4_096


class PreTokens:
    """Which pre-tokens a worker knows: a direct-mapped table of the pre-tokens themselves. Hashes only choose slots."""

    def __init__(self):
        self.key = np.zeros((KEY_BLOCKS, SLOTS), np.uint64)
        self.size = np.full(SLOTS, -1, np.int32)

    def look(self, data: bytes, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray):
        """Each pre-token's slot, those that are not there, and among these an occurrence of each distinct one and which one each is."""
        h = textops.word_hashes(raw, starts, stops)
        slot = (h >> np.uint64(7)).astype(np.int64) & (SLOTS - 1)
        size = stops - starts
        blocks = textops.word_blocks(raw, starts, stops, KEY_BLOCKS)
        known = (self.size[slot] == size) & (size <= 8 * KEY_BLOCKS)
        for j in range(KEY_BLOCKS):
            known &= self.key[j][slot] == blocks[j]
        missing = np.flatnonzero(~known)
        order = missing[np.argsort(h[missing])]
        a, b = order[:-1], order[1:]
        same = (h[a] == h[b]) & (size[a] == size[b]) & (blocks[:, a] == blocks[:, b]).all(axis=0)
        for i in np.flatnonzero(same & (size[a] > 8 * KEY_BLOCKS)).tolist():
            same[i] = data[starts[a[i]] : stops[a[i]]] == data[starts[b[i]] : stops[b[i]]]
        new = np.ones(len(order), bool)
        new[1:] = ~same
        self.slot, self.blocks, self.sizes = slot, blocks, size
        return slot, order, order[new], np.cumsum(new) - 1

    def put(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Enters these occurrences of the last look(): which of them got a slot, and the slots."""
        fit = np.flatnonzero(self.sizes[first] <= 8 * KEY_BLOCKS)
        to = self.slot[first[fit]]
        fit = fit[np.sort(np.unique(to, return_index=True)[1])]  # one pre-token a slot
        to = self.slot[first[fit]]
        self.key[:, to], self.size[to] = self.blocks[:, first[fit]], self.sizes[first[fit]]
        return fit, to


class PieceCache:
    """Ids of pre-tokens: a direct-mapped table into an arena of ids, both of fixed size.

    Look-ups are gathers for a whole batch, compared with the pre-tokens themselves. A slot holds the pre-token seen
    last; misses are merged once for each distinct pre-token of the batch.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known = PreTokens()
        self.start = np.zeros(SLOTS, np.int64)
        self.length = np.zeros(SLOTS, np.int32)
        self.arena = np.zeros(ARENA, np.uint32)
        self.used = 0
        self.long: dict[bytes, np.ndarray] = {}

    def merged(self, pieces: list[bytes]) -> list[np.ndarray]:
        out = [np.array([self.vocabulary.seed[p]]) if p in self.vocabulary.seed else self.long.get(p) for p in pieces]
        todo = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(todo, self.vocabulary.merges.many([pieces[i] for i in todo]), strict=True):
            out[i] = ids
            if 8 * KEY_BLOCKS < len(pieces[i]) <= LONG:
                if len(self.long) >= LONG_KEPT:
                    self.long.clear()
                self.long[pieces[i]] = ids
        return out

    def find(self, data: bytes, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in self.arena each pre-token's ids are, until the next call."""
        slot, missing, first, which = self.known.look(data, raw, starts, stops)
        where, length = self.start[slot], self.length[slot]
        if len(missing):
            ids = self.merged([data[i:j] for i, j in zip(starts[first].tolist(), stops[first].tolist(), strict=True)])
            sizes = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate(ids).astype(np.uint32)
            if self.used + len(flat) > len(self.arena):  # start anew; this batch's hits are copied first
                kept = np.ones(len(slot), bool)
                kept[missing] = False
                old = gather(self.arena, where[kept], length[kept].astype(np.int64))
                self.known.size[:] = -1
                self.arena = np.zeros(max(ARENA, 2 * (len(old) + len(flat))), np.uint32)
                self.arena[: len(old)] = old
                ends = np.cumsum(length[kept])
                where[kept] = ends - length[kept]
                self.used = len(old)
            at = self.used + np.cumsum(sizes) - sizes
            self.arena[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            fit, to = self.known.put(first)
            self.start[to], self.length[to] = at[fit], sizes[fit]
            where[missing], length[missing] = at[which], sizes[which]
        return where, length.astype(np.int64)


class Encoder:
    """The cache is made when first needed: a worker that only decodes has none."""

    def __init__(self, path: str):
        self.vocabulary = load(path)
        self.cache: PieceCache | None = None
        self.flat = np.frombuffer(b"".join(self.vocabulary.tokens), np.uint8)
        self.at = np.cumsum(self.vocabulary.lengths) - self.vocabulary.lengths

    def encode(self, raw: np.ndarray, off: np.ndarray) -> list[bytes]:
        """Packed ids (little-endian, 32 bits) of each row of a UTF-8 buffer."""
        if not len(raw):
            return [b""] * (len(off) - 1)
        if self.cache is None:
            self.cache = PieceCache(self.vocabulary)
        starts = pretok.boundaries(raw, off)
        where, length = self.cache.find(raw.tobytes(), raw, starts, np.append(starts[1:], len(raw)))
        ids = gather(self.cache.arena, where, length).astype("<u4").tobytes()
        ends = np.concatenate([[0], np.cumsum(length)])[np.searchsorted(starts, off)] * 4
        at = ends.tolist()
        return [ids[i:j] for i, j in zip(at, at[1:])]

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        return gather(self.flat, self.at[ids], self.vocabulary.lengths[ids]).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """id, n_tokens and ids (binary: little-endian unsigned 32-bit) of each whole text, without special tokens.

    vocabulary: path of a .tiktoken rank file that the workers can read. Null is an empty text with no ids. With
    offsets, also the byte offset of each token in the text, packed like ids. Repeated rows give repeated rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            raw, off = textops.buffers(batch.column(1))
            for lo, hi in textops.chunks(off):
                packed = enc.encode(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                columns = [batch.column(0).slice(lo, hi - lo), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())]
                if offsets:
                    columns.append(pa.array([_offsets(enc, p) for p in packed], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids", "offsets"][: len(columns)])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids binary" + ", offsets binary" * offsets)
    return out.withColumnRenamed("id", id_col)


def _offsets(enc: Encoder, packed: bytes) -> bytes:
    ends = np.cumsum(enc.vocabulary.lengths[np.frombuffer(packed, "<u4")])
    return np.concatenate([[0], ends[:-1]]).astype("<u4").tobytes() if len(ends) else b""


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """The rows of encode() with `decoded`, the bytes that the ids stand for; null ids give null."""
    names = [c for c in encoded.columns if c != "decoded"]
    spec = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in names)
    at = names.index(ids_col)

    def run(batches):
        enc = encoder(vocabulary)
        for whole in batches:
            for lo in range(0, whole.num_rows, DECODE_ROWS):
                batch = whole.slice(lo, DECODE_ROWS)
                text = [enc.decode(p.as_py()) if p.is_valid else None for p in batch.column(at)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.binary())], names=[*names, "decoded"])

    return encoded.select(*names).mapInArrow(run, f"{spec}, decoded binary")
