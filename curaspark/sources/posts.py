"""Social posts: payloads of several shapes to photos, videos and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.functions import hashing, text
from curaspark.operators import relational, selection

MEDIA = "struct<media_key:string,type:string,media_url_https:string,url:string,alt_text:string,ext_alt_text:string,original_info:struct<width:int,height:int>,video_info:struct<variants:array<struct<bitrate:long,content_type:string,url:string>>>>"
BODY = f"struct<id:string,full_text:string,text:string,entities:struct<media:array<{MEDIA}>>,extended_entities:struct<media:array<{MEDIA}>>,attachments:struct<media_keys:array<string>>>"
PAYLOAD = f"struct<tweet:{BODY},data:{BODY},tweets:array<{BODY}>,id:string,full_text:string,text:string,entities:struct<media:array<{MEDIA}>>,extended_entities:struct<media:array<{MEDIA}>>,attachments:struct<media_keys:array<string>>,includes:struct<media:array<{MEDIA}>>>"


def parse(payload: Column) -> Column:
    return F.from_json(payload, F.lit(PAYLOAD))


def body(p: Column) -> Column:
    """struct(id, text, media): the first of the shapes that is there; media keys are looked up in includes."""
    own = F.struct(*[p[c].alias(c) for c in ("id", "full_text", "text", "entities", "extended_entities", "attachments")])
    b = F.coalesce(p["tweet"], p["data"], F.get(p["tweets"], F.lit(0)), own)
    keyed = F.filter(p["includes"]["media"], lambda m: F.array_contains(b["attachments"]["media_keys"], m["media_key"]))
    media = F.coalesce(b["extended_entities"]["media"], b["entities"]["media"], keyed)
    return F.struct(b["id"].alias("id"), F.coalesce(b["full_text"], b["text"]).alias("text"), media.alias("media"))


def photos(b: Column) -> Column:
    """URLs of photos, the original size asked for."""
    found = F.filter(b["media"], lambda m: m["type"] == "photo")
    return F.transform(found, lambda m: F.concat(F.regexp_replace(F.coalesce(m["media_url_https"], m["url"]), r"\?.*$", ""), F.lit("?name=orig")))


def best_video(m: Column) -> Column:
    """The mp4 of highest bitrate (of equal ones the first), else the first playlist."""
    variants = m["video_info"]["variants"]
    mp4 = F.filter(variants, lambda v: v["content_type"] == "video/mp4")
    best = F.get(F.reverse(F.array_sort(F.transform(mp4, lambda v, i: F.struct(F.coalesce(v["bitrate"], F.lit(0)).alias("b"), (-i).alias("o"), v["url"].alias("u"))))), F.lit(0))["u"]
    hls = F.get(F.filter(variants, lambda v: F.contains(v["content_type"], F.lit("mpegURL"))), F.lit(0))["url"]
    return F.coalesce(best, hls)


def collect(posts: DataFrame, order: str) -> DataFrame:
    """One row per post key: the first collection that has it labels it."""
    keyed = posts.withColumn("post_key", hashing.post_key(F.col("id"), F.col("text"), F.col("createdAt")))
    return relational.first_wins(keyed, ["post_key"], [F.asc(order)])


def digest(posts: DataFrame, source: str, order: list[Column], per_source: int = 20) -> DataFrame:
    """(source, lines): the first posts of each source as a Markdown list."""
    top = selection.top_per_group(posts, source, order, per_source)
    line = F.concat(F.lit("- "), text.snippet(F.col("text")))
    return top.groupBy(source).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
