"""Packing into padded batches with optimal length buckets.

Documents become sequences of at most `max_len` tokens (longer ones are cut into consecutive whole pieces, so no
token is lost). The global histogram of sequence lengths has at most max_len entries; dynamic programming over it
chooses the bucket boundaries with the least padding. In each bucket, batches of floor(budget / boundary) sequences
form by exact global numbering: rows are dealt into shards of a bounded number of rows, numbered there, and moved on by the
prefix sums of the shard sizes. No bucket is ever sorted in one task, however hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curaspark.llm import textops
from curaspark.llm.storage import materialize

MAX_LEN = 2_048
BUCKETS = 16
TOKEN_BUDGET = 65_536
SHARD_ROWS = 16_384


def word_lengths(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n): the number of words `[^\\x20\\x09-\\x0D]+` of each whole text; null counts none."""

    def count(batches):
        for batch in batches:
            raw, off = textops.buffers(batch.column(1))
            n = [np.zeros(0, np.int64)]
            for lo, hi in textops.chunks(off):
                n.append(np.diff(textops.words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])[2]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n), pa.int64())], names=["id", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(count, f"id {kind}, n long")


def optimal_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper lengths of at most `buckets` buckets that minimise the sum of boundary - length.

    best[k][j]: least padding of the j shortest distinct lengths in k buckets; cost of a bucket from two prefix
    sums. O(buckets * lengths^2), vectorised over the split point. Ties take the smallest split point.
    """
    lengths = np.array(sorted(k for k, v in histogram.items() if v > 0), np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(x)] for x in lengths], np.float64)
    number, total = np.concatenate([[0.0], np.cumsum(counts)]), np.concatenate([[0.0], np.cumsum(counts * lengths)])
    n = len(lengths)
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    cut = []
    for _ in range(min(buckets, n)):
        nxt, at = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        nxt[0] = 0.0
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (number[j] - number[:j]) - (total[j] - total[:j])
            at[j] = int(np.argmin(cost))
            nxt[j] = cost[at[j]]
        cut.append(at)
        best = nxt
    out, j = [], n
    for at in reversed(cut):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(at[j])
    return out[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, text_col: str = "text", max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """One row per sequence: doc_id, piece, start_token, n_tokens, bucket_len, batch_id, slot, padding.

    length: tokens of a row (by default the words of text_col). A row of no tokens (null or empty text) is one
    sequence of length 0 in the smallest bucket, so that every document has a place. A piece lies in the smallest
    bucket that holds it; batch_id is unique over all buckets and its sequences times bucket_len never exceed
    max(budget, bucket_len). Only the last batch of a bucket may be partly filled. Repeated ids are packed as
    separate rows. Null ids are carried. An empty table gives no rows.
    """
    spark = docs.sparkSession
    given = word_lengths(docs, id_col, text_col) if length is None else docs.select(F.col(id_col).alias("id"), F.coalesce(length, F.lit(0)).cast("long").alias("n"))
    lengths = materialize(given, "lengths")
    full = F.expr(f"transform(sequence(0L, greatest(0L, (n - 1) div {max_len})), i -> struct(i AS piece, i * {max_len} AS start_token, least(n - i * {max_len}, {max_len}L) AS n_tokens))")
    pieces = lengths.select("id", F.inline(full))
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("n_tokens").agg(F.count(F.lit(1))).collect()}  # at most max_len + 1 rows
    bounds = optimal_boundaries(histogram, buckets) or [0]
    bucket = F.lit(bounds[-1])
    for b in reversed(bounds[:-1]):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b)).otherwise(bucket)
    shards = max(1, -(-sum(histogram.values()) // SHARD_ROWS))
    dealt = pieces.withColumns({"bucket_len": bucket.cast("long"), "shard": F.pmod(F.xxhash64("id", "piece"), F.lit(shards)).cast("int")})
    sizes = dealt.groupBy("bucket_len", "shard").agg(F.count(F.lit(1)).alias("in_shard"))
    before = Window.partitionBy("bucket_len").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket_len", "shard", F.coalesce(F.sum("in_shard").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("bucket_len", "shard").orderBy(F.col("n_tokens"), F.col("id"), F.col("piece"))
    capacity = {b: max(1, budget // max(1, b)) for b in bounds}
    filled = {b: sum(c for k, c in histogram.items() if k <= b) for b in bounds}
    first, at, low = {}, 0, 0
    for b in bounds:  # batches of the smaller buckets come first
        first[b] = at
        at += -(-(filled[b] - low) // capacity[b])
        low = filled[b]
    table = spark.createDataFrame([(b, capacity[b], first[b]) for b in bounds], "bucket_len long, capacity long, first long")
    return (
        dealt.withColumn("rn", F.row_number().over(own) - 1)
        .join(offsets, ["bucket_len", "shard"])
        .join(F.broadcast(table), "bucket_len")
        .withColumn("at", F.col("rn") + F.col("before"))
        .select(
            F.col("id").alias(id_col), "piece", "start_token", "n_tokens", "bucket_len",
            (F.col("first") + F.expr("at div capacity")).alias("batch_id"),
            F.expr("at % capacity").alias("slot"),
            (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        )
    )
