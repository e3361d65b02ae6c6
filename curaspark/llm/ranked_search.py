"""Ranked lexical search over a tiered index of document shards.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII; A-Z are lower-cased. With N documents that have
a term, L terms in all, n terms of a document and m = 25 + (75 n N) div L, a posting's impact is
(10^9 tf) div (1000 tf + 8 m); an item's score of a document sums w * impact over the item's terms, repeats included, with
w = floor(1000 ln((2N + 2) / (2 df + 1))).

Index: the texts of a task are cut into shards of about SHARD_BYTES; every posting of every term is in its shard's row. A
term's postings lie in tiers by falling impact, short lists wholly in the first; each tier has, for every term, the largest
impact left below it. Tiers are columns of their own, so that a step reads only those that it needs.

Search: a step adds up the tiers so far. A document's sum bounds its score from below; with what is left for its unseen terms
it bounds it from above. The k-th best lower bound over all shards is an item's threshold. A shard is done with an item where
nothing is left (its scores are exact) or where no upper bound reaches the threshold; items with a shard that is not done
fall through to the next tier. Below the last tier nothing is left, so the result is always exact.

Edges: null and empty texts, and texts without a term, have no rows and are not counted in N. Rows that repeat a doc_id are
documents of their own; a null doc_id comes last in ties. Rows of one item_id are one item with the terms of all of them;
null item ids and items without a known term give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curaspark.llm import textops
from curaspark.llm.storage import drop, materialize, new_path, settings

#: Bytes of text of a shard. Lists of up to SHORT postings are in tier 0 whole; of longer ones tier t has this share, at least SHORT.
SHARD_BYTES, SHORT, SHARES = 1 << 20, 64, (1 / 16, 1 / 4, 1.0)
#: (item, term) rows that a block of items has about; what tasks get of the items grows with a block, not with all items.
BLOCK_ROWS = 1 << 18

#: Texts that are handed to Python at once while the index is made.
TEXTS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
#: Index rows that are read and handed to Python at once: their arrays are megabytes.
FEW_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4", "spark.sql.parquet.columnarReaderBatchSize": "8"}

#: Bytes that end a term.
BETWEEN = np.zeros(256, bool)
BETWEEN[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

TIERS = len(SHARES)
INDEX = "shard long, having long, tokens long, ids array<long>, terms binary, ends binary, " + ", ".join(f"sizes{t} binary, docs{t} binary, impacts{t} binary, left{t} binary" for t in range(TIERS))
FOUND = "item long, doc_id long, score long, exact boolean, upper long"


def _terms(raw: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms, and offsets into them by row."""
    low = textops.LOWER[raw]
    starts, stops, rows = textops.words(low, off, BETWEEN)
    ends = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    data = low[~BETWEEN[low]]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]), rows


def totals(docs: DataFrame) -> tuple[int, int]:
    """N and L of documents (id, text)."""

    def run(batches):
        for batch in batches:
            raw, off = textops.buffers(batch.column(0))
            having = tokens = 0
            for lo, hi in textops.chunks(off):
                _, _, rows = textops.words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], BETWEEN)
                n = np.diff(rows)
                having, tokens = having + int((n > 0).sum()), tokens + int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array([having]), pa.array([tokens])], names=["having", "tokens"])

    row = docs.select("text").mapInArrow(run, "having long, tokens long").agg(F.sum("having").alias("having"), F.sum("tokens").alias("tokens")).first()
    return row["having"] or 0, row["tokens"] or 0


def _lengths(n: np.ndarray, having: int, tokens: int) -> np.ndarray:
    """m of documents with n terms; in Python's integers where 64 bits are too few for the product."""
    if 75 * int(n.max(initial=0)) * having < 2**63:
        return 25 + 75 * n * having // tokens
    return np.array([25 + 75 * int(x) * having // tokens for x in n], np.int64)


def _shard(number: int, ids: pa.Array, raw: np.ndarray, off: np.ndarray, having: int, tokens: int) -> dict:
    terms, rows = _terms(raw, off)
    coded = terms.dictionary_encode()
    n, docs = np.diff(rows), len(off) - 1
    pair, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * docs + np.repeat(np.arange(docs), n), return_counts=True)
    term, doc = pair // docs, pair % docs
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * _lengths(n, having, tokens)[doc])
    order = np.lexsort((doc, -impact, term))
    term, doc, impact = term[order], doc[order], impact[order]
    df = np.bincount(term, minlength=len(coded.dictionary))
    first = np.cumsum(df) - df
    place = np.arange(len(term)) - first[term]
    row = {"shard": number, "having": int((n > 0).sum()), "tokens": int(n.sum()), "ids": ids}
    row |= {"terms": b"".join(coded.dictionary.to_pylist()), "ends": pc.cumulative_sum(pc.binary_length(coded.dictionary)).to_numpy().astype(np.int64).tobytes()}
    begin = np.zeros_like(df)
    for t, share in enumerate(SHARES):
        end = df if share >= 1 else np.minimum(df, np.maximum(SHORT, (df * share).astype(np.int64)))
        own = (place >= begin[term]) & (place < end[term])
        left = np.where(end < df, impact[np.minimum(first + end, max(len(impact) - 1, 0))], 0) if len(impact) else df
        row |= {f"sizes{t}": (end - begin).astype(np.uint32).tobytes(), f"docs{t}": doc[own].astype(np.uint32).tobytes(), f"impacts{t}": impact[own].astype(np.uint32).tobytes(), f"left{t}": left.astype(np.uint32).tobytes()}
        begin = end
    return row


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the tiered index of all documents to path and returns it."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with settings(docs.sparkSession, TEXTS):
        having, tokens = totals(rows)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            raw, off = textops.buffers(batch.column(1))
            for lo, hi in textops.chunks(off, SHARD_BYTES):
                row = _shard(number, batch.column(0)[lo:hi], raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], having, tokens)
                number += 1
                arrays = [pa.ListArray.from_arrays([0, len(v)], v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v) if k == "ids" else pa.array([v]) for k, v in row.items()]
                yield pa.RecordBatch.from_arrays(arrays, names=list(row))

    with settings(docs.sparkSession, TEXTS):
        return materialize(rows.mapInArrow(run, INDEX), "tiers", path)


class Block(NamedTuple):
    """Items of a block: their distinct terms, and for each item id the numbers and times of its terms."""

    terms: pa.Array
    items: dict[int, tuple[np.ndarray, np.ndarray]]


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term, times)"""

    def run(batches):
        for batch in batches:
            raw, off = textops.buffers(batch.column(1))
            for lo, hi in textops.chunks(off):
                terms, rows = _terms(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                ids = batch.column(0)[lo:hi].take(pa.array(np.repeat(np.arange(hi - lo), np.diff(rows))))
                yield pa.RecordBatch.from_arrays([ids, terms.cast(pa.binary())], names=["item", "term"])

    return items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("item is not null").mapInArrow(run, "item long, term binary").groupBy("item", "term").agg(F.count("*").alias("times"))


def _block(rows: list) -> Block:
    number: dict[bytes, int] = {}
    items: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["item"], bytes(r["term"]))):
        items.setdefault(r["item"], []).append((number.setdefault(bytes(r["term"]), len(number)), r["times"]))
    return Block(pa.array(list(number), pa.binary()), {i: (np.array([n for n, _ in v]), np.array([c for _, c in v])) for i, v in items.items()})


def _column(batch: pa.RecordBatch, name: str, i: int, kind=np.uint32) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_buffer(), kind)


def _known(batch: pa.RecordBatch, i: int, terms: pa.Array) -> np.ndarray:
    """For each term of the block its number in the shard of row i, or -1."""
    ends = np.concatenate([[0], _column(batch, "ends", i, np.int64)])
    own = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), batch.column("terms")[i].as_buffer()])
    at = pc.index_in(own, value_set=terms.cast(pa.large_binary()))
    rows = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    out = np.full(len(terms), -1)
    out[at.drop_null().to_numpy()] = rows
    return out


def frequencies(index: DataFrame, terms: pa.Array) -> np.ndarray:
    """df of each term."""

    def run(batches):
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                at = _known(batch, i, terms)
                held = np.flatnonzero(at >= 0)
                df[held] += sum(_column(batch, f"sizes{t}", i)[at[held]].astype(np.int64) for t in range(TIERS))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["term", "df"])

    out = np.zeros(len(terms), np.int64)
    counted = index.select("terms", "ends", *[f"sizes{t}" for t in range(TIERS)]).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in counted.collect():
        out[r["term"]] = r["df"]
    return out


def _answers(terms: pa.Array, items: dict[int, tuple[np.ndarray, np.ndarray]], least: dict[int, int], tiers: int, k: int):
    """A task of a step, for these items whose terms have the given weights: the k best exact and the k best other sums of an
    item over the shards of the task, and the largest upper bound of those that are not done with it."""

    def shard(batch: pa.RecordBatch, i: int):
        ids = batch.column("ids")[i].values
        docs = len(ids)
        ids = np.array(ids.fill_null(0)), np.array(ids.is_null())
        known = _known(batch, i, terms)
        parts = []
        for t in range(tiers):
            sizes = _column(batch, f"sizes{t}", i).astype(np.int64)
            parts.append((sizes, np.cumsum(sizes) - sizes, _column(batch, f"docs{t}", i), _column(batch, f"impacts{t}", i), _column(batch, f"left{t}", i).astype(np.int64)))
        for item, (numbers, weights) in items.items():
            held = known[numbers] >= 0
            own, weight = known[numbers][held], weights[held]
            if not len(own):
                continue
            top = 2_000_000 * int(weight.sum())
            sums, seen = np.zeros(docs, np.int64), np.zeros(docs, np.int64)  # seen: weight * what was left for a seen term, by the last tier
            places: list[list[np.ndarray]] = [[] for _ in own]
            upper = None
            for sizes, starts, docs_of, impacts, left in parts:
                n = sizes[own]
                at = np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
                sums += _summed(docs_of[at], np.repeat(weight, n) * impacts[at], docs, top)
                rest = weight * left[own]
                if not rest.any():
                    upper = None
                    break
                for j in np.flatnonzero(rest).tolist():
                    places[j].append(docs_of[starts[own[j]] : starts[own[j]] + n[j]])
                seen = sum(_summed(p, np.full(len(p), rest[j]), docs, top) for j, ps in enumerate(places) if rest[j] for p in ps)
                upper = int((sums + rest.sum() - seen).max())
                if upper < max(least.get(item, 1), 1):
                    break
            if upper is not None and upper < max(least.get(item, 1), 1):
                continue
            best = np.flatnonzero(sums > 0)
            if len(best) > k:
                best = best[sums[best] >= np.partition(sums[best], len(best) - k)[len(best) - k]]
            rows = [(-int(sums[d]), bool(ids[1][d]), int(ids[0][d])) for d in best.tolist()]
            yield item, rows, upper

    def run(batches):
        best: dict[tuple[int, bool], list] = {}
        uppers: dict[int, int] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                for item, rows, upper in shard(batch, i):
                    key = item, upper is None
                    best[key] = heapq.nsmallest(k, best.get(key, []) + rows)
                    if upper is not None:
                        uppers[item] = max(upper, uppers.get(item, 0))
        rows = [(item, None if none else doc, -score, exact, None) for (item, exact), own in best.items() for score, none, doc in own]
        rows += [(item, None, None, None, upper) for item, upper in uppers.items()]
        for lo in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows[lo : lo + 10_000], strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], names=["item", "doc_id", "score", "exact", "upper"])

    return run


def _summed(docs: np.ndarray, values: np.ndarray, n: int, top: int) -> np.ndarray:
    """Sums of integers by document: in doubles where no sum can pass 2^53."""
    if top < 2**53:
        return np.bincount(docs, values, n).astype(np.int64)
    out = np.zeros(n, np.int64)
    np.add.at(out, docs, values)
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.where("score is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(index: DataFrame, block: Block, having: int, k: int) -> list[DataFrame]:
    """Exact top rows of the block's items, in one frame a tier that ended items."""
    spark = index.sparkSession
    df = frequencies(index, block.terms)
    weight = np.array([math.floor(1000 * math.log((2 * having + 2) / (2 * x + 1))) if x else 0 for x in df.tolist()], np.int64)
    open_items = {i: (n, weight[n] * c) for i, (n, c) in block.items.items()}
    least: dict[int, int] = {}
    out = []
    for t in range(TIERS):
        columns = ["ids", "terms", "ends", *[f"{c}{u}" for u in range(t + 1) for c in ("sizes", "docs", "impacts", "left")]]
        found = materialize(index.select(*columns).mapInArrow(_answers(block.terms, open_items, least, t + 1, k), FOUND), "answers")
        least |= {r["item"]: max(r["score"], least.get(r["item"], 1)) for r in _ranked(found, k).where(F.col("rank") == k).select("item", "score").collect()}
        upper = {r["item"]: r["upper"] for r in found.groupBy("item").agg(F.max("upper").alias("upper")).where("upper is not null").collect()}
        still = {i: v for i, v in open_items.items() if upper.get(i, 0) >= least.get(i, 1)}
        ended = [(i,) for i in open_items if i not in still]
        if ended:
            out.append(found.where("exact").join(F.broadcast(spark.createDataFrame(ended, "item long")), "item"))
        open_items = still
        if not open_items:
            break
    return out


def search(index: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, rank, doc_id, score): the k documents of the highest positive scores of each item; equal scores by ascending doc_id."""
    spark = index.sparkSession
    having = index.agg(F.sum("having")).first()[0] or 0
    terms = materialize(item_terms(items, id_col, text_col), "item-terms")
    blocks = max(1, math.ceil(terms.count() / BLOCK_ROWS))
    parts = []
    for b in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        if rows:
            with settings(spark, FEW_ROWS):
                parts += _search_block(index, _block(rows), having, k)
    found = spark.createDataFrame([], FOUND)
    for part in parts:
        found = found.unionByName(part)
    return _ranked(found, k).select(F.col("item").alias(id_col), "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k best of all documents for each item."""
    spark = docs.sparkSession
    path = new_path(spark, "tiers")
    out = materialize(search(build_index(docs, path), items, k), "ranked")
    drop(spark, path)
    return out


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH words AS (SELECT doc_id, UNNEST(regexp_extract_all({_LOW.format("text")}, '{_TERM}')) AS term FROM documents),
asked AS (SELECT item_id, term, COUNT(*) AS times FROM (SELECT item_id, UNNEST(regexp_extract_all({_LOW.format("text")}, '{_TERM}')) AS term FROM benchmark) GROUP BY item_id, term),
lengths AS (SELECT doc_id, COUNT(*) AS n FROM words GROUP BY doc_id),
sizes AS (SELECT COUNT(*) AS docs, SUM(n)::BIGINT AS terms FROM lengths),
postings AS (SELECT doc_id, term, COUNT(*) AS tf FROM words GROUP BY doc_id, term),
weights AS (SELECT term, FLOOR(1000 * LN((2 * ANY_VALUE(docs) + 2)::DOUBLE / (2 * COUNT(*) + 1)))::BIGINT AS w FROM postings, sizes GROUP BY term),
scores AS (
  SELECT a.item_id, p.doc_id, SUM(a.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * l.n * s.docs) // s.terms))))::BIGINT AS score
  FROM asked a JOIN postings p ON a.term = p.term JOIN weights w ON a.term = w.term JOIN lengths l ON p.doc_id = l.doc_id CROSS JOIN sizes s
  GROUP BY a.item_id, p.doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""
