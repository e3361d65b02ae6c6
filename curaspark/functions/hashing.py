"""Stable identities and perceptual hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curaspark.functions import urls

NUL = "\0"


def short_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts, NUL between them."""
    return F.substring(F.sha2(F.concat_ws(NUL, *[p.cast("string") for p in parts]), 256), 1, 16)


def item_id(issue: Column, sequence: Column, title: Column) -> Column:
    return short_id(issue, sequence, title)


def candidate_id(item: Column, url: Column) -> Column:
    return short_id(item, urls.normalized(url))


def video_id(url: Column) -> Column:
    return short_id(urls.normalized(url))


def post_key(post_id: Column, text: Column, created: Column) -> Column:
    return F.coalesce(F.nullif(post_id, F.lit("")), F.md5(F.concat(F.coalesce(text, F.lit("")), F.coalesce(created, F.lit("")))))


def mean_bits(values: Column, first: int, count: int) -> Column:
    """`count` bits as a long: value >= the mean of all values, from position `first` (0-based) on."""
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(values)
    part = F.slice(values, first + 1, count)
    return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1) + F.when(x.cast("double") >= mean, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex hashes, half by half: the whole does not fit a signed long."""
    half = lambda x, at: F.conv(F.substring(x, at, 8), 16, 10).cast("long")
    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
