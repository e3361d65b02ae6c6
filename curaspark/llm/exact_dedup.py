"""Exact deduplication by two-pass Bloom filtering, with DataFrame functions only.

Pass 1 hashes every text into a blocked counting Bloom filter: a hash picks one block of 32,768 cells and two
cells in it. Cells are counted with map-side combining, so a copy group of any size costs each task one row per
cell; cells hit twice or more stay, as one bitmap per block. Pass 2 looks both cells up in the broadcast bitmaps.
A row with a cell that was hit once has a text that occurs once: it passes straight through. Only the other rows
shuffle, by the SHA-256 of the text, where groups are formed exactly.

The filter has at most MAX_BLOCKS blocks of 4 KB, so the broadcast is bounded whatever the input. Beyond the
number of rows that this suits, more rows take the exact way; the result stays the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.llm.storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CELLS = 32_768
MAX_BLOCKS = 8_192
ROWS_A_BLOCK = 1_024


def fold_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. For pure ASCII, lower() does the same and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def blocks_for(rows: int) -> int:
    """A power of two of blocks, 32 cells a row, up to the bound."""
    n = 1
    while n * ROWS_A_BLOCK < rows and n < MAX_BLOCKS:
        n *= 2
    return n


def _block(h: Column, blocks: int) -> Column:
    return h.bitwiseAND(F.lit(blocks - 1)).cast("int")


def _cells(h: Column) -> list[Column]:
    return [F.shiftrightunsigned(h, by).bitwiseAND(F.lit(CELLS - 1)).cast("int") for by in (16, 40)]


def repeated_cells(hashes: DataFrame, h: str, blocks: int, least: int = 2) -> DataFrame:
    """(__block, __bitmap) of the cells that `least` or more rows hit."""
    one, two = _cells(F.col(h))
    # a row's two cells may be equal: it then counts once
    cells = F.when(one == two, F.array(one)).otherwise(F.array(one, two))
    return (
        hashes.select(_block(F.col(h), blocks).alias("__block"), F.explode(cells).alias("__cell"))
        .groupBy("__block", "__cell").agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") >= least)
        .groupBy("__block").agg(F.expr("bitmap_construct_agg(cast(__cell as bigint))").alias("__bitmap"))
    )


def maybe_repeated(rows: DataFrame, h: str, bitmaps: DataFrame, blocks: int) -> DataFrame:
    """rows with __maybe: false where the hash certainly occurs once."""
    marked = rows.withColumns({"__b": _block(F.col(h), blocks), "__c1": _cells(F.col(h))[0], "__c2": _cells(F.col(h))[1]})
    hit = F.lit(True)
    for c in ("__c1", "__c2"):
        hit = hit & (F.expr(f"shiftright(conv(hex(substring(__bitmap, {c} div 8 + 1, 1)), 16, 10)::int, {c} % 8)").bitwiseAND(F.lit(1)) == 1)
    return (
        marked.join(F.broadcast(bitmaps), F.col("__b") == F.col("__block"), "left")
        .withColumn("__maybe", F.coalesce(F.col("__bitmap").isNotNull() & hit, F.lit(False)))
        .drop("__b", "__c1", "__c2", "__block", "__bitmap")
    )


def among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key (long) is in keys (one column, few of the rows): a Bloom filter of the keys, bounded as above, stops
    most of the others before the exact semi-join shuffles what is left. Null keys match nothing."""
    name = keys.columns[0]
    blocks = blocks_for(keys.count())
    bitmaps = repeated_cells(keys.select(F.xxhash64(name).alias("__h")), "__h", blocks, 1)
    near = maybe_repeated(rows.withColumn("__h", F.xxhash64(key)), "__h", bitmaps, blocks).where("__maybe").drop("__h", "__maybe")
    return near.join(keys.select(F.col(name).alias("__key")), F.col(key) == F.col("__key"), "left_semi")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is empty. Of equal texts the row with the
    largest id stays (a null id counts as smallest; of a group of null ids only, keep_id is null and any one row is
    kept). Rows repeated with the same id and text are each kept when
    their id is the kept one. Unequal texts never meet. With keep_columns the input's columns come first; those
    named like an output are replaced. An empty table gives no rows.
    """
    outputs = ["keep_id", "group_size", "kept", "text_sha256"]
    carried = [c for c in docs.columns if c not in {id_col, *outputs}] if keep_columns else []
    base = docs.select(
        F.col(id_col).alias("__id"),
        *[F.col(f"`{c}`").alias(f"__x{i}") for i, c in enumerate(carried)],
        F.coalesce(F.col(text_col), F.lit("")).alias("__text"),
    )
    blocks = blocks_for(docs.count())
    # lower() is coarser than folding A-Z and much cheaper beyond ASCII; the filter only must not part equal texts
    hashed = base.withColumn("__h", F.xxhash64(F.lower("__text")))
    bitmaps = repeated_cells(hashed.select("__h"), "__h", blocks)
    rows = hashed.select("__id", *[f"__x{i}" for i in range(len(carried))], "__h", F.sha2(fold_ascii(F.col("__text")).cast("binary"), 256).alias("__sha"))
    marked = maybe_repeated(rows, "__h", bitmaps, blocks).drop("__h")
    if not carried:  # ids and digests only: texts are read and hashed once for the three uses below
        marked = materialize(marked, "digests")
    none = F.lit(None).cast("long")
    once = marked.where("not __maybe").withColumns({"__tag": none, "__keep": F.col("__id"), "__size": F.lit(1).cast("long"), "__first": none})
    # rows of null ids are told apart by a tag, which must be the same at both uses below: hence a table
    again = marked.where("__maybe")
    nameless = materialize(again.where("__id is null").withColumn("__tag", F.monotonically_increasing_id()), "nameless")
    again = again.where("__id is not null").withColumn("__tag", none).unionByName(nameless)
    # only groups of several rows, as a table: both sides of the join are then plain exchanges, which Spark splits where hot
    groups = materialize(again.groupBy("__sha").agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__size"), F.min("__tag").alias("__first")).where("__size > 1"), "groups")
    several = again.join(groups, "__sha", "left").withColumns({"__keep": F.when(F.col("__size").isNull(), F.col("__id")).otherwise(F.col("__keep")), "__size": F.coalesce("__size", F.lit(1).cast("long"))}).select(*once.columns)
    return once.unionByName(several).select(
        F.col("__id").alias(id_col),
        *[F.col(f"__x{i}").alias(c) for i, c in enumerate(carried)],
        F.col("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"),
        F.when(F.col("__keep").isNotNull(), F.coalesce(F.col("__id") == F.col("__keep"), F.lit(False))).otherwise((F.col("__size") == 1) | F.coalesce(F.col("__tag") == F.col("__first"), F.lit(False))).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
"""
