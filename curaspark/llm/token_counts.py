"""Token counts without token ids.

Each batch of texts becomes its table of (document, pre-token, frequency) and its table of distinct pre-tokens. Pieces are
counted once for each distinct pre-token (a worker remembers the counts), joined to the frequencies, and summed. The tables
never leave the task: as Spark rows the frequencies would take more bytes than the texts themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.llm import bpe, pretok, textops


class Counter:
    def __init__(self, path: str):
        self.vocabulary = bpe.load(path)
        self.known = bpe.PreTokens()
        self.pieces = np.zeros(bpe.SLOTS, np.int32)

    def distinct(self, data: bytes, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pre-token the number of its distinct one, and the number of pieces of each distinct one."""
        slot, missing, first, which = self.known.look(data, raw, starts, stops)
        hit = np.ones(len(slot), bool)
        hit[missing] = False
        number = np.empty(len(slot), np.int64)
        slots, number[hit] = np.unique(slot[hit], return_inverse=True)
        number[missing] = len(slots) + which
        tokens = [data[i:j] for i, j in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
        seed = self.vocabulary.seed
        rest = iter(self.vocabulary.merges.many([t for t in tokens if t not in seed]))
        fresh = np.array([1 if t in seed else len(next(rest)) for t in tokens], np.int32)
        pieces = np.concatenate([self.pieces[slots], fresh])
        fit, to = self.known.put(first)
        self.pieces[to] = fresh[fit]
        return number, pieces

    def segments(self, data: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows cut at special strings, and which segments are special: these count one."""
        cuts = []
        for word in self.vocabulary.special:
            i = data.find(word)
            while i >= 0:
                row = np.searchsorted(off, i, "right")
                if i + len(word) <= off[row]:  # not across two rows
                    cuts += [(i, i + len(word))]
                    i = data.find(word, i + len(word))
                else:
                    i = data.find(word, i + 1)
        if not cuts:
            return off, np.zeros(max(0, len(off) - 1), bool)
        edges = np.unique(np.concatenate([off, np.array(cuts, np.int64).ravel()]))
        return edges, np.isin(edges[:-1], [a for a, _ in cuts])

    def count(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        n = len(off) - 1
        if not len(raw):
            return np.zeros(n, np.int64)
        data = raw.tobytes()
        edges, special = self.segments(data, off)
        starts = pretok.boundaries(raw, edges)
        stops = np.append(starts[1:], len(raw))
        if special.any():
            own = special[np.searchsorted(edges, starts, "right") - 1]
            heads = edges[:-1][special]
            starts, stops = starts[~own], stops[~own]
        else:
            heads = np.zeros(0, np.int64)
        row = lambda at: np.searchsorted(off, at, "right") - 1
        total = np.bincount(row(heads), minlength=n)
        if len(starts):
            number, pieces = self.distinct(data, raw, starts, stops)
            # the frequencies (document, pre-token, times), joined to the pieces of the pre-token
            pair, times = np.unique(row(starts) * len(pieces) + number, return_counts=True)
            total = total + np.bincount(pair // len(pieces), times * pieces[pair % len(pieces)], n).astype(np.int64)
        return total


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of each whole text; null is empty, with no tokens.

    vocabulary: path of a byte-level BPE .json or .tiktoken file. Special strings of a .json inside texts are one
    token each, as that library reads them by default. Repeated rows give repeated rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        if vocabulary not in _counters:
            _counters[vocabulary] = Counter(vocabulary)
        counter = _counters[vocabulary]
        for batch in batches:
            raw, off = textops.buffers(batch.column(1))
            n = [np.zeros(0, np.int64)]
            for lo, hi in textops.chunks(off):
                n.append(counter.count(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off), pa.int64()), pa.array(np.concatenate(n), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
