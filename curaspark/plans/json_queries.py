"""Walks over nested JSON, made of the turns of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.sources import json_walk
from curaspark.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}

# A post by conversation {c}, turn {t} and role {r}: links and photos at several depths, one photo twice.
POST = (
    '{"id":"{c}-{t}","tweet":{"entities":{"urls":[{"expanded_url":"https://e.example/{c}"},{"unwound_url":"https://u.example/{t}","note":null}],'
    '"media":[{"type":"photo","alt_text":"{r} {t}","media_url_https":"https://pbs.twimg.com/media/{c}.jpg?name=small","original_info":{"width":1{t},"height":7}},{"type":"video","url":"https://v.example/{c}.mp4"}]}},'
    '"more":[true,[{t},2.5,{"deep":{"expanded_url":"https://e.example/{c}","media":{"media_type":"Photo","alt":" again","url":"https://pbs.twimg.com/media/{c}.jpg","original_info":{"width":-1,"height":9}}}}]],'
    '"ld":{"@graph":[{"@type":["Thing","Product"],"name":"Mug {c}","@id":"p{t}","image":["https://i.example/{c}a.jpg",{"url":"https://i.example/{c}b.jpg"}]},{"@type":"product","name":" ","image":"x"},{"@type":"Article","name":"n","image":"y"}]}}'
)
PARTS = {"{c}": "conv_id", "{t}": "turn", "{r}": "role"}


def _pieces() -> list[str]:
    out, rest = [], POST
    while rest:
        at = min((i for p in PARTS if (i := rest.find(p)) >= 0), default=-1)
        if at < 0:
            return [*out, rest]
        out += [rest[:at], rest[at : at + 3]]
        rest = rest[at + 3 :]
    return out


def posts(spark: SparkSession, d: str) -> DataFrame:
    """(post, json): every seventeenth text is cut short, and so no JSON."""
    whole = F.concat(*[F.col(PARTS[p]).cast("string") if p in PARTS else F.lit(p) for p in _pieces()])
    cut = (F.col("conv_id") + F.col("turn")) % 17 == 0
    return table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("post"), F.when(cut, F.substring(whole, 1, 40)).otherwise(whole).alias("json"))


_TEXT = " || ".join(f"{PARTS[p]}::VARCHAR" if p in PARTS else "'" + p.replace("'", "''") + "'" for p in _pieces())
POSTS = f"posts AS (SELECT conv_id, turn, role, conv_id || '-' || turn AS post, {_TEXT} AS json, (conv_id + turn) % 17 = 0 AS cut FROM conversations)"


def json_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value of every post, with its path."""
    values, _ = json_walk.walk(posts(spark, d), "post", "json")
    return values.select("post", "depth", "path", "parent", "name", "kind", F.when(F.col("kind") == "number", F.col("value").cast("double").cast("string")).otherwise(F.col("value")).alias("value"))


def json_failures(spark: SparkSession, d: str) -> DataFrame:
    """Posts that are no JSON."""
    _, failures = json_walk.walk(posts(spark, d), "post", "json")
    return failures.select("post", "stage", "code", "message")


def json_links(spark: SparkSession, d: str) -> DataFrame:
    """The addresses behind shortened links, at any depth."""
    values, _ = json_walk.walk(posts(spark, d), "post", "json")
    return json_walk.expanded_urls(values, "post").select("post", F.array_join("links", " ").alias("links"))


def json_photos(spark: SparkSession, d: str) -> DataFrame:
    """Photos at any depth by full-size address, with joined alternative texts and original dimensions."""
    values, _ = json_walk.walk(posts(spark, d), "post", "json")
    return json_walk.photos(values, "post")


def json_products(spark: SparkSession, d: str) -> DataFrame:
    """Named products of linked data, with their images."""
    values, _ = json_walk.walk(posts(spark, d), "post", "json")
    return json_walk.products(values, "post").select("post", "path", "name", "item", F.array_join("images", " ").alias("images"))


for _f in (json_values, json_failures, json_links, json_photos, json_products):
    QUERIES[_f.__name__] = _f

ORACLE_SQL["json_values"] = f"""
WITH {POSTS}, t AS (SELECT p.post, j.* FROM posts p, json_tree(p.json) j WHERE NOT p.cut)
SELECT post, (len(fullkey) - len(replace(replace(fullkey, '.', ''), '[', '')))::INTEGER AS depth, replace(fullkey, '"', '') AS path,
  CASE WHEN fullkey <> '$' THEN replace(path, '"', '') END AS parent, CASE WHEN fullkey <> '$' AND NOT ends_with(fullkey, ']') THEN key END AS name,
  CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
  CASE WHEN type IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL WHEN type IN ('VARCHAR', 'BOOLEAN') THEN atom ->> '$' ELSE (atom ->> '$')::DOUBLE::VARCHAR END AS value FROM t"""
ORACLE_SQL["json_failures"] = f"WITH {POSTS} SELECT post, 'parse' AS stage, 'invalid_record' AS code, substr(json, 1, 40) AS message FROM posts WHERE cut"
ORACLE_SQL["json_links"] = f"WITH {POSTS} SELECT post, 'https://e.example/' || conv_id || ' https://u.example/' || turn AS links FROM posts WHERE NOT cut"
ORACLE_SQL["json_photos"] = f"""
WITH {POSTS} SELECT post, 'https://pbs.twimg.com/media/' || conv_id || '.jpg?name=orig' AS image_url, 'https://pbs.twimg.com/media/' || conv_id || '.jpg' AS raw_url,
  'again ' || role || ' ' || turn AS alt, ('1' || turn)::INTEGER AS width, 9 AS height FROM posts WHERE NOT cut"""
ORACLE_SQL["json_products"] = f"""
WITH {POSTS} SELECT post, '$.ld.@graph[0]' AS path, 'Mug ' || conv_id AS name, 'p' || turn AS item, 'https://i.example/' || conv_id || 'a.jpg https://i.example/' || conv_id || 'b.jpg' AS images FROM posts WHERE NOT cut"""
