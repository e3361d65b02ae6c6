"""Lempel-Ziv phrase fingerprints.

Each text is parsed into the phrases of an LZ78 dictionary over units (words; longer ones in pieces): a phrase is the
longest known phrase and one more unit. Texts that compress well together share phrases, so the resemblance of
phrase sets is a compression-like similarity. The set is hashed and kept as a one-permutation minimum-hash signature
of SLOTS slots, each the least hash in its share of the hash range; two signatures are compared slot by slot.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.llm import textops

SLOTS = 64
#: Hex digits of a slot; the value of an empty slot.
DIGITS, EMPTY = 4, 0xFFFF
#: Words of more bytes, as texts without spaces have, are read codepoint by codepoint.
UNIT = 32
#: Rows of a range of ids, until MAX_PARTS ranges bound the plan; larger ranges are streamed as well.
PART_ROWS, MAX_PARTS = 4_096, 2_000
#: Bytes of text that are parsed at a time.
GROUP = 2 << 20

_M = (1 << 64) - 1
_K = 0x9E3779B97F4A7C15


def units(texts: list[str]) -> list[np.ndarray]:
    """64-bit hashes of the units of each text: words between ASCII white space, the codepoints of long ones.

    White space alone or an empty text has one unit, the text itself, so that equal texts are alike and others are not.
    """
    raw, off = textops.buffers(pa.array(texts, pa.large_string()))
    out: list[np.ndarray] = []
    for lo, hi in textops.chunks(off):
        part, edge = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        starts, stops, rows = textops.words(part, edge)
        if len(starts) and (stops - starts).max() > UNIT:
            lead = (part & 0xC0) != 0x80
            chars, before = np.append(np.flatnonzero(lead), len(part)), np.concatenate([[0], np.cumsum(lead)])
            long = stops - starts > UNIT
            pieces = np.where(long, before[stops] - before[starts], 1)
            first = np.cumsum(pieces) - pieces
            which = np.repeat(np.arange(len(starts)), pieces)
            char = before[starts][which] + np.arange(len(which)) - first[which]
            starts, stops = np.where(long[which], chars[char], starts[which]), np.where(long[which], chars[char + 1], stops[which])
            rows = np.append(first, len(which))[rows]
        h = textops.word_hashes(part, starts, stops)
        for i in range(hi - lo):
            own = h[rows[i] : rows[i + 1]]
            out.append(own if len(own) else textops.word_hashes(part, edge[i : i + 1], edge[i + 1 : i + 2]))
    return out


def parse(hashes: list[int], known: set[int], node: int = 0) -> tuple[int, list[int]]:
    """Reads units on: the open phrase's hash (0: none) and the phrases that were new. A phrase's hash chains its units'."""
    fresh = []
    add, keep = known.add, fresh.append
    for w in hashes:
        h = (node * _K + w) & _M
        if h in known:
            node = h
        else:
            add(h)
            keep(h)
            node = 0
    return node, fresh


def pair(own: np.ndarray, other: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Signatures of a text and of its edited text; what both begin with is parsed once.

    A last phrase that is already known is in the set anyway, so nothing is left out at the end.
    """
    known: set[int] = set()
    if other is None:
        return signature(parse(own.tolist(), known)[1]), None
    n = min(len(own), len(other))
    differ = np.flatnonzero(own[:n] != other[:n])
    n = int(differ[0]) if len(differ) else n
    node, common = parse(own[:n].tolist(), known)
    _, tail = parse(own[n:].tolist(), known, node)
    first = signature(common + tail)
    known.difference_update(tail)
    _, tail = parse(other[n:].tolist(), known, node)
    return first, signature(common + tail)


def signature(hashes: list[int]) -> np.ndarray:
    """The least value of each slot (16 bits), EMPTY where no phrase falls."""
    h = textops.mix(np.array(hashes, np.uint64))
    slot = (h >> np.uint64(58)).astype(np.int64)
    value = ((h >> np.uint64(10)) & np.uint64((1 << 48) - 1)).astype(np.int64)
    least = np.full(SLOTS, 1 << 48, np.int64)
    np.minimum.at(least, slot, value)
    # the low bits of the least 48-bit value: evenly spread, unlike its high ones
    return np.where(least == 1 << 48, EMPTY, least % EMPTY)


def to_text(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots among those that are not empty in both."""
    used = (a != EMPTY) | (b != EMPTY)
    return float(((a == b) & used).sum() / used.sum()) if used.any() else 1.0


def fingerprint(text: str) -> np.ndarray:
    return pair(units([text])[0], None)[0]


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next text's first, or all it has."""
    n = len(text)
    k = n // 4
    return text[: n - k] + following[:k]


def _by_part(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, halo, id, text): rows in ranges of ids; a range's last row is the first of the next (halo).

    Bounds are ids that occur, so the row that a range must borrow is known without looking at other tasks.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    stats = rows.agg(F.count(F.lit(1)), F.min("id"), F.count_if(F.col("id").isNull())).first()
    parts = min(MAX_PARTS, max(1, -(-stats[0] // PART_ROWS)))
    bounds: list[int] = []
    if parts > 1:
        quantiles = rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []
        bounds = sorted({int(q) for q in quantiles if q > stats[1]})
    table = F.lit(bounds).cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    # number of bounds at or under the id: by binary search of a sorted literal
    part = F.expr("0")
    if bounds:
        part = F.coalesce(_rank(F.col("id"), bounds), F.lit(0))
    first = F.col("id").isNull() if stats[2] else F.col("id").eqNullSafe(F.lit(stats[1]))
    last = len(bounds)
    own = rows.withColumn("part", part.cast("int"))
    to = F.when(first, F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("halo")), F.struct(F.lit(last).alias("part"), F.lit(2).alias("halo"))))
    if bounds:
        to = to.when(F.array_contains(table, F.col("id")), F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("halo")), F.struct((F.col("part") - 1).alias("part"), F.lit(1).alias("halo"))))
    to = to.otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("halo"))))
    return own.select("id", "text", F.explode(to).alias("to")).select("to.part", "to.halo", "id", "text")


def _rank(x, bounds: list[int]):
    """Number of sorted bounds <= x, as a balanced CASE tree."""

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each whole text.

    Null is an empty text. The next document is the one after in order of (id, text), null ids first; the last is
    followed by the first. Rows of equal id and text follow each other. A single row follows itself; an empty table
    gives no rows. Only the parts' texts move, once; each task streams its parts in order.
    """
    spread = _by_part(docs, id_col, text_col)
    parts = max(1, docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = spread.repartition(parts, "part").sortWithinPartitions("part", "halo", F.col("id").asc_nulls_first(), "text")
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def group(rows):
        """Results of the rows whose successor in the same part is known."""
        live = [not a[1] and i + 1 < len(rows) and rows[i + 1][0] == a[0] for i, a in enumerate(rows)]
        changed = [edited(a[3], rows[i + 1][3]) for i, a in enumerate(rows) if live[i]]
        other = iter(units(changed))
        sigs = [pair(u, next(other) if ok else None) for u, ok in zip(units([r[3] for r in rows]), live, strict=True)]
        text = iter(changed)
        for i, (_, _, key, own) in enumerate(rows):
            if live[i]:
                a, b = sigs[i]
                yield key, len(own), hashlib.sha256(next(text).encode()).hexdigest(), to_text(a), to_text(b), likeness(a, b), likeness(a, sigs[i + 1][0])

    def run(batches):
        rows, size = [], 0
        for batch in chain(batches, [None]):
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True) if batch is not None else ():
                rows.append(row)
                size += len(row[3])
                if size > GROUP:
                    out += group(rows)
                    rows, size = rows[-1:], len(row[3])
            if batch is None:
                out += group(rows)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    spec = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(run, spec).withColumnRenamed("id", id_col)
