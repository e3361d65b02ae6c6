"""Substring deduplication over a log-structured index of window fingerprints.

A window is WINDOW consecutive words. Its anchor is the least hash of its GRAM-word parts: equal windows have equal anchors, and
neighbouring windows mostly share theirs, so one row (anchor, document, position, window hashes) stands for several
windows and two windows can only be equal under the same anchor. Documents come in batches of ascending id:

* map: rows of a batch; windows that a smaller id of the same chunk has already, or that the task remembers of a smaller
  id, are decided at once and not sent, so a passage that very many documents share costs each task a row or so, not one
  per document;
* merge: the batch's rows, sorted by anchor, are merge-joined with the index, sorted immutable runs bucketed by anchor
  (no shuffle of the history), and verified within the 64-bit anchor on 40 bits of a second, independent hash of all the
  window's words; within an anchor documents come in ascending order and are streamed, however many they are;
* append: windows that were new become a new sorted run; when MAX_RUNS is passed, runs are compacted into one by
  merge joins and the old runs deleted.

Hits are window positions. Only documents that may have hits (a bounded Bloom filter) shuffle to meet theirs.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curaspark.llm import exact_dedup, textops
from curaspark.llm.storage import cleaned_up, drop, materialize, new_path

WINDOW = 13
GRAM = 4
MAX_RUNS = 2
#: Windows of one row at most.
ROW_WINDOWS = 64
WIN_BYTES = 5
CHUNK = 256 << 10
MERGE_ROWS = 8_192
#: Windows that a map task remembers.
SEEN = 1 << 18
#: Bytes of text for each bucket of the index.
BUCKET_BYTES = 32 << 20

_U = np.uint64
ROW_SPEC = "anchor long, doc long, pos long, n int, wins binary"


def windows(h: np.ndarray, other: np.ndarray, rows: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start word, anchor (of h) and own hash (of other) of every window that lies in one row (rows: offsets into the words)."""
    m = len(h) - window + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U)
    own = textops.gram_hashes(other, window)
    parts = textops.gram_hashes(h, gram)
    anchor = parts[:m].copy()
    for j in range(1, window - gram + 1):
        np.minimum(anchor, parts[j : j + m], out=anchor)
    room = np.repeat(rows[1:], np.diff(rows))[:m] - np.arange(m)
    at = np.flatnonzero(room >= window)
    return at, anchor[at], own[at]


def first_holders(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The least document of all entries with the same key, for each entry."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    least = np.minimum.reduceat(doc[order], heads)
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(heads, len(k))))
    return out


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary cells of WIN_BYTES for each of counts[i] consecutive values."""
    data = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIN_BYTES])
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * WIN_BYTES
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all cells and each cell's number of them; null is empty."""
    column = column.fill_null(b"") if column.null_count else column
    if not len(column):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    wide = np.zeros((len(raw) // WIN_BYTES, 8), np.uint8)
    wide[:, :WIN_BYTES] = raw.reshape(-1, WIN_BYTES)
    return wide.view("<u8").ravel(), np.diff(off) // WIN_BYTES


def _runs(flag: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of set flags in which each of `same` is constant (positions: rising by one)."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at
    cut = np.diff(at) != 1
    for s in same:
        cut |= s[at[1:]] != s[at[:-1]]
    heads = np.flatnonzero(np.concatenate([[True], cut]))
    return at[heads], np.diff(np.append(heads, len(at)))


def map_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """ROW_SPEC rows of (id, tag, text). pos: tag << 32 | start word. A row without wins is a hit that is decided already."""

    def run(batches):
        seen, holder = np.zeros(SEEN, _U), np.full(SEEN, np.iinfo(np.int64).max)  # window seen last in each slot, its document
        for batch in batches:
            raw, off = textops.buffers(batch.column(2))
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi in textops.chunks(off, CHUNK):
                part, edge = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                starts, stops, rows = textops.words(part, edge)
                at, anchor, own = windows(textops.word_hashes(part, starts, stops), textops.word_hashes(part, starts, stops, 1), rows, window, gram)
                if not len(at):
                    continue
                row = np.searchsorted(rows, at, "right") - 1
                doc = ids[lo:hi][row]
                pos = (tags[lo:hi][row] << 32) | (at - rows[row])
                own >>= _U(64 - 8 * WIN_BYTES)
                key = textops.mix(anchor + own * _U(0x9E3779B97F4A7C15))
                slot = (key & _U(SEEN - 1)).astype(np.int64)
                known = (first_holders(key, doc) < doc) | ((seen[slot] == key) & (holder[slot] < doc))
                seen[slot], holder[slot] = key, doc
                # steps of ROW_WINDOWS split long runs of one anchor, as repeated lines give
                step = (at - rows[row]) // ROW_WINDOWS
                head, n = _runs(~known, row, anchor, step)
                if len(head):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[head].view(np.int64)), pa.array(doc[head]), pa.array(pos[head]), pa.array(n.astype(np.int32)), packed(own[~known], n)], names=["anchor", "doc", "pos", "n", "wins"])
                head, n = _runs(known, row)
                if len(head):
                    spread = textops.mix(pos[head].view(_U) ^ textops.mix(doc[head].view(_U)))
                    yield pa.RecordBatch.from_arrays([pa.array(spread.view(np.int64)), pa.array(doc[head]), pa.array(pos[head]), pa.array(n.astype(np.int32)), pa.nulls(len(head), pa.binary())], names=["anchor", "doc", "pos", "n", "wins"])

    return docs.mapInArrow(run, ROW_SPEC)


class Merger:
    """Streams rows sorted by (anchor, doc) and keeps, between batches, the windows of the last anchor."""

    def __init__(self, with_index: bool):
        self.with_index = with_index
        self.anchor: int | None = None
        self.wins, self.docs = np.zeros(0, _U), np.zeros(0, np.int64)
        self.pending = np.zeros(0, _U)

    def feed(self, batch: pa.RecordBatch):
        anchor, doc, pos, n = (batch.column(i).to_numpy() for i in range(4))
        if not len(anchor):
            return
        if (anchor[1:] < anchor[:-1]).any() or ((anchor[1:] == anchor[:-1]) & (doc[1:] < doc[:-1])).any() or (self.anchor is not None and anchor[0] < self.anchor):
            raise ValueError("rows are not sorted by anchor and document")
        decided = batch.column(4).is_null().to_numpy(zero_copy_only=False)
        values, counts = unpacked(batch.column(4))
        row = np.repeat(np.arange(len(anchor)), counts)
        # entries: what earlier batches of this stream and the index hold, then the rows' own
        e_anchor, e_win, e_doc = [anchor[row]], [values], [doc[row]]
        if self.anchor is not None and self.anchor == anchor[0]:
            e_anchor.append(np.full(len(self.wins), self.anchor, np.int64))
            e_win.append(self.wins)
            e_doc.append(self.docs)
        past = np.iinfo(np.int64).min
        for i in range(5, batch.num_columns):
            head = np.flatnonzero(batch.column(i).is_valid().to_numpy(zero_copy_only=False))
            old, m = unpacked(batch.column(i).take(pa.array(head)))
            e_anchor.append(np.repeat(anchor[head], m))
            e_win.append(old)
            e_doc.append(np.full(len(old), past, np.int64))
        a, w, d = np.concatenate(e_anchor), np.concatenate(e_win), np.concatenate(e_doc)
        key = textops.mix(a.view(_U) + w * _U(0x9E3779B97F4A7C15))
        least = first_holders(key, d) if len(key) else d
        own = slice(0, len(row))
        hit = least[own] < doc[row]
        # a row's windows are consecutive: runs of hits in a row
        first = np.cumsum(counts) - counts
        head, length = _runs(hit, row)
        at = np.concatenate([pos[row[head]] + (head - first[row[head]]), pos[decided]])
        if len(at):
            out_doc = np.concatenate([doc[row[head]], doc[decided]])
            size = np.concatenate([length, n[decided]]).astype(np.int32)
            where = np.concatenate([anchor[row[head]], anchor[decided]])
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(out_doc), pa.array(at), pa.array(size), pa.nulls(len(at), pa.binary())], names=["anchor", "doc", "pos", "n", "wins"])
        if self.with_index:
            new = ~hit & (least[own] > past)
            new[new] &= _first(key[own][new])
            if self.anchor is not None and self.anchor == anchor[0]:
                new &= ~((anchor[row] == self.anchor) & np.isin(values, self.wins))
            used = np.flatnonzero(new)
            fresh_anchor, fresh = anchor[row[used]], values[used]
            if len(self.pending):
                fresh_anchor = np.concatenate([np.full(len(self.pending), self.anchor, np.int64), fresh_anchor])
                fresh = np.concatenate([self.pending, fresh])
            whole = fresh_anchor != anchor[-1]  # the last anchor may go on: an anchor has one row in a run
            self.pending = fresh[~whole]
            yield from self.index_rows(fresh_anchor[whole], fresh[whole])
        last = a == anchor[-1]
        wins, inverse = np.unique(w[last], return_inverse=True)
        docs = np.full(len(wins), np.iinfo(np.int64).max)
        np.minimum.at(docs, inverse, d[last])
        self.anchor, self.wins, self.docs = int(anchor[-1]), wins, docs


    def index_rows(self, anchor: np.ndarray, fresh: np.ndarray):
        if not len(anchor):
            return
        heads = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        size = np.diff(np.append(heads, len(anchor)))
        none = pa.nulls(len(heads), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(anchor[heads]), none, none, pa.nulls(len(heads), pa.int32()), packed(fresh, size)], names=["anchor", "doc", "pos", "n", "wins"])

    def finish(self):
        if len(self.pending):
            yield from self.index_rows(np.full(len(self.pending), self.anchor, np.int64), self.pending)


def _first(key: np.ndarray) -> np.ndarray:
    """Marks the first entry of each key."""
    out = np.zeros(len(key), bool)
    out[np.unique(key, return_index=True)[1]] = True
    return out


@dataclass
class SubstringIndex:
    """The history: tables of (anchor, wins), each bucketed and sorted by anchor and never changed."""

    spark: SparkSession
    buckets: int
    window: int = WINDOW
    gram: int = GRAM
    runs: list[str] = field(default_factory=list)
    paths: dict[str, str] = field(default_factory=dict)

    def _table(self, df: DataFrame, kind: str) -> str:
        name, path = f"curaspark_{kind}_{uuid.uuid4().hex[:12]}", new_path(self.spark, kind)
        self.paths[name] = path
        with cleaned_up(self.spark):
            df.write.format("parquet").bucketBy(self.buckets, "anchor").sortBy("anchor").option("path", path).saveAsTable(name)
        return name

    def drop(self, tables: list[str] | None = None) -> None:
        """Deletes these runs, or all that this index has written: for runs that nothing reads any more."""
        for name in list(self.paths) if tables is None else tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop(self.spark, self.paths.pop(name))
        self.runs = [r for r in self.runs if r in self.paths]

    def history(self) -> list[DataFrame]:
        return [self.spark.table(t).where("doc is null").select("anchor", "wins") for t in self.runs]

    def add(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """Hits (doc, pos, n) of a batch (id, tag, text) against the index and against smaller ids of the batch.

        With keep, the batch's new windows join the index. Ids must be greater than those of earlier batches.
        """
        rows = map_rows(docs, self.window, self.gram).repartition(self.buckets, "anchor").sortWithinPartitions("anchor", "doc", "pos")
        columns = rows.columns
        if self.runs:  # an anchor's history goes to its first row only; left joins keep the rows' order
            rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("anchor").orderBy("doc", "pos")))
            for i, run in enumerate(self.history()):
                old = run.select(F.col("anchor").alias("a"), F.col("wins").alias(f"old{i}"))
                rows = rows.join(old, (F.col("anchor") == F.col("a")) & (F.col("rn") == 1), "left").drop("a")
                columns.append(f"old{i}")

        def merge(batches):
            merger = Merger(keep)
            for batch in batches:
                for lo in range(0, batch.num_rows, MERGE_ROWS):
                    yield from merger.feed(batch.slice(lo, MERGE_ROWS))
            yield from merger.finish()

        merged = rows.select(*columns).mapInArrow(merge, ROW_SPEC)
        table = self._table(merged, "run")
        hits = materialize(self.spark.table(table).where("doc is not null").select("doc", "pos", "n"), "hits")
        if keep:
            self.runs.append(table)
            if len(self.runs) > MAX_RUNS:
                self.compact()
        else:
            self.drop([table])
        return hits

    def compact(self) -> None:
        """All runs into one, by merge joins on the common buckets."""
        first, *others = self.history()
        for i, run in enumerate(others):
            first = first.join(run.withColumnRenamed("wins", f"w{i}"), "anchor", "full")
        parts = [F.coalesce(F.col(c), F.lit(b"")) for c in first.columns if c != "anchor"]
        none = [F.lit(None).cast(t).alias(c) for c, t in (("doc", "long"), ("pos", "long"), ("n", "int"))]
        old, compacted = self.runs, self._table(first.select("anchor", *none, F.concat(*parts).alias("wins")), "compacted")
        self.runs = [compacted, *old]
        self.drop(old)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, batches: int = 4, keep_columns: bool = False, index: SubstringIndex | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: words left (joined by one space) after removing repeated windows.

    A word goes if a window that covers it also starts in a document with a smaller id, or in the index given (whose
    documents count as earlier; the batches then join it). Windows are judged on the input. Null texts have no words;
    texts under `window` words lose nothing. A document of null id neither loses words nor takes any. Rows of equal
    id never count as earlier than each other; identical rows are treated alike. Ids are integers. Batches are ranges of ids and do
    not change the result. With keep_columns the input's columns come first, those of the same name replaced.
    """
    spark = docs.sparkSession
    outputs = ["n_words", "n_removed", "kept_text"]
    carried = [c for c in docs.columns if c not in {id_col, text_col, *outputs}] if keep_columns else []
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.shiftrightunsigned(F.xxhash64(text), 33).alias("tag"), text.alias("text"), *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(carried)])
    known = base.where("id is not null").select("id", "tag", "text")
    lasting = index is not None
    cuts = [i / batches for i in range(1, batches)] or [0.5]
    cuts, size = known.agg(F.percentile_approx("id", cuts, 10_000), F.sum(F.octet_length("text"))).first()
    index = index or SubstringIndex(spark, max(16, int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // BUCKET_BYTES), window)
    bounds = [None, *(sorted({int(c) for c in cuts or []}) if batches > 1 else []), None]
    found = []
    try:
        for i, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
            batch = known
            if lo is not None:
                batch = batch.where(F.col("id") >= lo)
            if hi is not None:
                batch = batch.where(F.col("id") < hi)
            found.append(index.add(batch, keep=lasting or i < len(bounds) - 2))
    finally:
        if not lasting:
            index.drop()
    hits = reduce(DataFrame.unionByName, found)
    spans = hits.select(F.col("doc").alias("h_id"), F.shiftrightunsigned("pos", 32).alias("h_tag"), F.col("pos").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos"), "n")
    spans = spans.groupBy("h_id", "h_tag").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))
    keys = hits.select(F.xxhash64("doc", F.shiftrightunsigned("pos", 32)).alias("k")).distinct()
    blocks = exact_dedup.blocks_for(keys.count())
    bitmaps = exact_dedup.repeated_cells(keys, "k", blocks, 1)
    marked = exact_dedup.maybe_repeated(base.withColumn("k", F.xxhash64("id", "tag")), "k", bitmaps, blocks).drop("k")
    kind = "array<struct<pos:bigint,n:int>>"
    clean = marked.where("not __maybe").withColumn("spans", F.lit(None).cast(kind))
    near = marked.where("__maybe").join(spans, (F.col("id") == F.col("h_id")) & (F.col("tag") == F.col("h_tag")), "left")
    names = ["id", "text", "spans", *[f"x{i}" for i in range(len(carried))]]
    every = clean.select(*names).unionByName(near.select(*names))

    def cut(parts):
        for batch in parts:
            raw, off = textops.buffers(batch.column(1))
            spans = batch.column(2).fill_null([]) if batch.column(2).null_count else batch.column(2)
            for lo, hi in textops.chunks(off, CHUNK):
                part, edge = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                data, begins, ends, rows = textops.joined(part, edge)
                mine = spans.slice(lo, hi - lo)
                lens = mine.value_lengths().to_numpy().astype(np.int64)
                flat = mine.flatten()
                gone = np.zeros(len(begins) + 1, np.int64)
                if len(flat):
                    start = rows[np.repeat(np.arange(hi - lo), lens)] + flat.field("pos").to_numpy()
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + flat.field("n").to_numpy() + window - 1, -1)
                removed = np.cumsum(gone)[:-1] > 0
                total = np.concatenate([[0], np.cumsum(removed)])
                n_removed = total[rows[1:]] - total[rows[:-1]]
                texts = []
                for i in range(hi - lo):
                    a, b = rows[i], rows[i + 1]
                    if a == b:
                        texts.append(b"")
                    elif not n_removed[i]:
                        texts.append(data[begins[a] : ends[b - 1]])
                    else:
                        texts.append(b" ".join([data[begins[j] : ends[j]] for j in (np.flatnonzero(~removed[a:b]) + a).tolist()]))
                new = [pa.array(np.diff(rows)), pa.array(n_removed), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, hi - lo) for c in (0, 1, *range(3, batch.num_columns))], *new], names=[n for n in names if n != "spans"] + outputs)

    types = dict(every.dtypes)
    spec = ", ".join(f"{n} {types[n]}" for n in names if n != "spans")
    out = every.mapInArrow(cut, f"{spec}, n_words long, n_removed long, kept_text string")
    return out.select(F.col("id").alias(id_col), *([F.col("text").alias(text_col)] if keep_columns else []), *[F.col(f"x{i}").alias(c) for i, c in enumerate(carried)], *outputs)
