"""Vector code compression: codebooks of integers per part position, entries found in a vantage-point tree.

A component x becomes the integer floor(256 * x); a vector is cut into 16 equal consecutive parts. The codebook of a part
position starts as that part of the 64 smallest ids. A round assigns every part to its nearest entry (ties to the lower
index) and moves each entry to the floored mean of its parts; unused entries stay. After the rounds parts are assigned again.

The entries of a position form a balanced vantage-point tree. A part descends to one leaf for a first distance; then every
leaf whose lower bound does not exceed the best distance is visited. Radii and distances are rounded outwards, the comparison
is not strict, and distances in leaves are compared as integers, so that the result is that of trying all entries.

Tasks send sums and counts by (position, entry); codebooks (64 integers a component) are all that the driver holds.

Edges: rows whose vector is null or has null or non-finite components are dropped. The length that counts is that of the
smallest id's vector (null ids come last; of equal ids the smaller vector first); rows of another length, and rows with a
component too large for distances in 64 bits, stay with null code and error and take no part in the codebooks. A length that
16 does not divide is padded with zeros. Fewer than 64 rows give fewer entries. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.llm.storage import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a leaf; rows handled at once.
LEAF, BLOCK = 8, 8192
#: Rounding of radii and distances, in parts of them.
OUTWARDS = 1e-12


def _squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(points, entries): squared distances as 64-bit integers."""
    out = np.zeros((len(points), len(entries)), np.int64)
    for j in range(points.shape[1]):
        gap = points[:, j, None] - entries[None, :, j]
        out += gap * gap
    return out


class EntryTree:
    """The entries of one part position; node j has the children 2j + 1 and 2j + 2, leaves hold entry numbers in ascending order."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        segments, vantages, bounds, middles = [np.arange(len(entries))], [], [], []
        while len(entries) > LEAF * len(segments):
            below = []
            for own in segments:
                at = own[int(_squares(entries[own], entries[own[:1]])[:, 0].argmax())]
                d = _squares(entries[own], entries[at][None])[:, 0]
                order = np.argsort(d, kind="stable")
                mid = (len(own) + 1) // 2
                d = d[order]
                vantages.append(entries[at])
                bounds.append([d[0], d[mid - 1], d[mid], d[-1]])
                middles.append(d[mid - 1])
                below += [own[order[:mid]], own[order[mid:]]]
            segments = below
        self.leaves = [np.sort(own) for own in segments]
        self.vantages = np.array(vantages, np.int64).reshape(-1, entries.shape[1])
        radii = np.sqrt(np.array(bounds, np.float64).reshape(-1, 4))
        self.inner, self.outer = radii[:, (0, 2)] * (1 - OUTWARDS), radii[:, (1, 3)] * (1 + OUTWARDS)
        self.middles = np.array(middles, np.int64)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry number and squared distance of each point's nearest entry."""
        n = len(points)
        squares = _squares(points, self.vantages)
        away = np.sqrt(squares.astype(np.float64))
        more, less = away * (1 + OUTWARDS), away * (1 - OUTWARDS)
        lower, home, at = np.zeros((n, 1)), np.zeros(n, np.int64), 0
        while at < len(self.vantages):
            width = lower.shape[1]
            own = slice(at, at + width)
            halves = [np.maximum(lower, np.maximum(self.inner[own, i] - more[:, own], less[:, own] - self.outer[own, i])) for i in (0, 1)]
            home = 2 * home + (squares[np.arange(n), at + home] > self.middles[at + home])
            lower, at = np.stack(halves, 2).reshape(n, 2 * width), at + width
        lower = lower * lower * (1 - OUTWARDS)
        best, square = np.full(n, len(self.entries)), np.full(n, np.iinfo(np.int64).max)

        def visit(leaf: int, rows: np.ndarray) -> None:
            own = self.leaves[leaf]
            d = _squares(points[rows], self.entries[own])
            first = d.argmin(1)
            d, entry = d[np.arange(len(rows)), first], own[first]
            better = (d < square[rows]) | (d == square[rows]) & (entry < best[rows])
            best[rows[better]], square[rows[better]] = entry[better], d[better]

        for leaf in range(len(self.leaves)):
            rows = np.flatnonzero(home == leaf)
            if len(rows):
                visit(leaf, rows)
        for leaf in range(len(self.leaves)):
            rows = np.flatnonzero((home != leaf) & (lower[:, leaf] <= square.astype(np.float64)))
            if len(rows):
                visit(leaf, rows)
        return best, square


class Codebooks:
    """(parts, entries, width) integers, with a tree for each part position."""

    def __init__(self, table: np.ndarray, length: int):
        self.table, self.length = table, length
        self.trees = [EntryTree(part) for part in table]

    def sha256(self) -> str:
        """Of all components by part, entry and position; padding is left out."""
        parts, entries, width = self.table.shape
        real = (np.arange(parts)[:, None] * width + np.arange(width)[None]) < self.length
        kept = np.broadcast_to(real[:, None, :], self.table.shape)
        return hashlib.sha256(",".join(map(str, self.table[kept].tolist())).encode()).hexdigest()

    def vectors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers with a vector of this length within range, and their parts: (rows, parts, width)."""
        n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        values, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(n)
        rows = np.flatnonzero(n == self.length)
        x = (values[((ends - n)[rows][:, None] + np.arange(self.length)).ravel()] * SCALE).reshape(len(rows), self.length)
        near = (np.abs(x) < largest(self.length)).all(1)
        return rows[near], cut(np.floor(x[near]).astype(np.int64))


def largest(length: int) -> int:
    """Components up to this size keep all distances of such vectors below 2^62."""
    return math.isqrt(2**62 // max(length, 1)) // 2


def cut(x: np.ndarray) -> np.ndarray:
    """(rows, components) to (rows, parts, width)."""
    width = -(-x.shape[1] // PARTS)
    return np.pad(x, ((0, 0), (0, PARTS * width - x.shape[1]))).reshape(len(x), PARTS, width)


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    x = F.col(vec_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(id_col).alias("id"), x.alias("vec"), F.col(label_col).alias("label")).where(F.col("vec").isNotNull() & finite)


def first_books(rows: DataFrame) -> Codebooks | None:
    """The parts of the smallest ids; None where there is no vector."""
    head = rows.where(F.size("vec") > 0).orderBy(F.asc_nulls_last("id"), "vec").limit(1).collect()
    if not head:
        return None
    length = len(head[0]["vec"])
    near = F.forall("vec", lambda v: F.abs(v * SCALE) < largest(length))
    start = rows.where((F.size("vec") == length) & near).orderBy(F.asc_nulls_last("id"), "vec").limit(ENTRIES).collect()
    if not start:
        return None
    x = np.floor(np.array([r["vec"] for r in start]) * SCALE).astype(np.int64)
    return Codebooks(np.ascontiguousarray(cut(x).transpose(1, 0, 2)), length)


def moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part to its nearest entry, every used entry to the floored mean of its parts."""

    def run(batches):
        sums, counts = np.zeros_like(books.table), np.zeros(books.table.shape[:2], np.int64)
        for batch in batches:
            _, parts = books.vectors(batch.column(0))
            for lo in range(0, len(parts), BLOCK):
                for p, tree in enumerate(books.trees):
                    own = np.ascontiguousarray(parts[lo : lo + BLOCK, p])
                    entry, _ = tree.nearest(own)
                    np.add.at(sums[p], entry, own)
                    counts[p] += np.bincount(entry, minlength=counts.shape[1])
        p, e = np.nonzero(counts)
        w = books.table.shape[2]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(p, w), pa.int32()), pa.array(np.repeat(e, w), pa.int32()), pa.array(np.tile(np.arange(w), len(p)), pa.int32()), pa.array(sums[p, e].ravel()), pa.array(np.repeat(counts[p, e], w))], names=["part", "entry", "place", "total", "n"])

    totals = rows.select("vec").mapInArrow(run, "part int, entry int, place int, total long, n long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    table = books.table.copy()
    for r in totals.collect():
        table[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return Codebooks(table, books.length)


def fit(rows: DataFrame, rounds: int = ROUNDS) -> Codebooks | None:
    books = first_books(rows)
    for _ in range(rounds if books else 0):
        books = moved(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks | None) -> DataFrame:
    """(id, label, code, error) of every row."""

    def run(batches):
        for batch in batches:
            codes, errors = np.full(batch.num_rows, None, object), np.zeros(batch.num_rows, np.int64)
            known, parts = books.vectors(batch.column(2)) if books else (np.zeros(0, np.int64), np.zeros((0, PARTS, 1), np.int64))
            for lo in range(0, len(parts), BLOCK):
                at = known[lo : lo + BLOCK]
                found = [tree.nearest(np.ascontiguousarray(parts[lo : lo + BLOCK, p])) for p, tree in enumerate(books.trees)]
                codes[at] = [bytes(row).hex() for row in np.stack([entry for entry, _ in found], 1).astype(np.uint8)]
                errors[at] = sum(square for _, square in found)
            missing = np.ones(batch.num_rows, bool)
            missing[known] = False
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, mask=missing)], names=["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select("id", "label", "vec").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """id, code, error, label_error, codebooks_sha256 of every row with a usable vector; see the top of this module."""
    rows = usable(vectors, id_col, vec_col, label_col)
    books = fit(rows, rounds)
    coded = materialize(encode(rows, books), "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    sha = books.sha256() if books else None
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(sha).cast("string").alias("codebooks_sha256"))


_ASSIGN = """
near{n} AS (
  SELECT vec_id, part, entry, square FROM (
    SELECT p.vec_id, p.part, b.entry, SUM((p.v - b.v) * (p.v - b.v))::BIGINT AS square,
      ROW_NUMBER() OVER (PARTITION BY p.vec_id, p.part ORDER BY SUM((p.v - b.v) * (p.v - b.v)), b.entry) AS place
    FROM parts p JOIN book{n} b ON p.part = b.part AND p.place = b.place GROUP BY p.vec_id, p.part, b.entry) WHERE place = 1)"""
_MOVE = """
book{m} AS (
  SELECT b.part, b.entry, b.place, COALESCE(s.v, b.v) AS v FROM book{n} b LEFT JOIN (
    SELECT p.part, a.entry, p.place, FLOOR(SUM(p.v)::DOUBLE / COUNT(*))::BIGINT AS v
    FROM parts p JOIN near{n} a ON p.vec_id = a.vec_id AND p.part = a.part GROUP BY p.part, a.entry, p.place) s
  ON b.part = s.part AND b.entry = s.entry AND b.place = s.place)"""
ORACLE = f"""
WITH kept AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
parts AS (
  SELECT vec_id, (i - 1) // (len(embedding) // {PARTS}) AS part, (i - 1) % (len(embedding) // {PARTS}) AS place, FLOOR({SCALE} * embedding[i]::DOUBLE)::BIGINT AS v
  FROM (SELECT vec_id, embedding, UNNEST(range(1, len(embedding) + 1)) AS i FROM kept)),
book0 AS (
  SELECT p.part, s.entry, p.place, p.v FROM parts p
  JOIN (SELECT vec_id, ROW_NUMBER() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}) s ON p.vec_id = s.vec_id),
{_ASSIGN.format(n=0)}, {_MOVE.format(n=0, m=1)}, {_ASSIGN.format(n=1)}, {_MOVE.format(n=1, m=2)}, {_ASSIGN.format(n=2)},
coded AS (
  SELECT k.vec_id, ANY_VALUE(k.label) AS label, STRING_AGG(format('{{:02x}}', entry), '' ORDER BY part) AS code, SUM(square)::BIGINT AS error
  FROM kept k JOIN near2 n ON k.vec_id = n.vec_id GROUP BY k.vec_id)
SELECT vec_id, code, error, (SUM(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(STRING_AGG(v::VARCHAR, ',' ORDER BY part, entry, place)) FROM book2) AS codebooks_sha256
FROM coded
"""
