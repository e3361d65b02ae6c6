"""JSON of any shape as rows: a walk that emits every value with its path, and what is read from such rows.

Documents are parsed once to VARIANT; each level of the walk explodes the objects and arrays of the level above. No level
shuffles, and a level that is written out ends the lineage before it; the walk ends where nothing is left to open.
Members of an object come in order of their names (a VARIANT keeps no other), elements of an array in theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.functions import urls
from curaspark.operators.classify import rules
from curaspark.session import written

#: Names of members that hold an address, an alternative text and the kind of a medium.
EXPANDED = ["expanded_url", "unwound_url"]
MEDIA_URLS = ["media_url_https", "media_url", "image_url", "url"]
PHOTO_KINDS = ["photo", "image"]


def _kind(v: Column) -> Column:
    s = F.schema_of_variant(v)
    return rules((s.startswith("OBJECT"), "object"), (s.startswith("ARRAY"), "array"), (s == "STRING", "string"), (s == "BOOLEAN", "boolean"), (s == "VOID", "null"), otherwise="number")


def walk(docs: DataFrame, key: str, json: str) -> tuple[DataFrame, DataFrame]:
    """(values, failures) of documents (key, json text).

    values: key, depth, path ($.a[0].b), place (sorts like the walk), parent (path of the object or array around it, null
    at the root), name (null in arrays), kind and value (text of a string, number or boolean). Texts that are no JSON are
    failures; a null text has no values.
    """
    spark = docs.sparkSession
    parsed = docs.select(F.col(key), F.col(json).alias("text"), F.try_parse_json(json).alias("v"))
    failures = parsed.where("text is not null and v is null").select(key, F.lit("parse").alias("stage"), F.lit("invalid_record").alias("code"), F.left("text", F.lit(300)).alias("message"))
    none = F.lit(None).cast("string")
    level = parsed.where("v is not null").select(key, F.lit(0).alias("depth"), F.lit("$").alias("path"), F.array().cast("array<string>").alias("place"), none.alias("parent"), none.alias("name"), "v")
    out, depth = None, 0
    while True:
        level, _ = written(level.withColumn("kind", _kind(F.col("v"))), f"walk-{depth}")
        leaf = F.when(F.col("kind").isin("string", "number", "boolean"), F.variant_get("v", "$", "string"))
        rows = level.select(key, "depth", "path", "place", "parent", "name", "kind", leaf.alias("value"))
        out = rows if out is None else out.unionByName(rows)
        inner = level.where(F.col("kind").isin("object", "array"))
        if not inner.limit(1).count():
            return out, failures
        depth += 1
        opened = inner.withColumnRenamed("path", "above").lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).drop("name")
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key"))) if key != "key" else None
        if step is None:
            raise ValueError("the key column of a walk cannot be named key")
        level = opened.select(
            F.col(key), F.lit(depth).alias("depth"), F.concat("above", step).alias("path"), F.array_append("place", F.lpad(F.col("pos").cast("string"), 10, "0")).alias("place"),
            F.col("above").alias("parent"), F.col("key").alias("name"), F.col("value").alias("v"),
        )


def expanded_urls(values: DataFrame, key: str) -> DataFrame:
    """(key, links): the addresses that shortened links stand for, each once, in the order of the walk."""
    found = values.where(F.col("name").isin(EXPANDED) & (F.col("kind") == "string") & F.regexp_like("value", F.lit("^https?://")))
    first = found.groupBy(key, F.col("value").alias("link")).agg(F.min("place").alias("place"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "link"))), lambda x: x["link"]).alias("links"))


def _objects(values: DataFrame, key: str, members: dict[str, Column]) -> DataFrame:
    """One row per object that has any of the members: (key, object, place and the members)."""
    own = values.where("name is not null").select(key, F.col("parent").alias("object"), F.slice("place", F.lit(1), F.size("place") - 1).alias("place"), "name", "kind", "value", "path")
    return own.groupBy(key, "object", "place").agg(*[c.alias(n) for n, c in members.items()])


def _member(names: list[str]) -> Column:
    """The text of the first of the names that an object has."""
    return F.coalesce(*[F.max(F.when((F.col("name") == n) & (F.col("kind") == "string"), F.col("value"))) for n in names])


def photos(values: DataFrame, key: str) -> DataFrame:
    """(key, image_url, raw_url, alt, width, height) of every photo object, by its address in full size; first of equal ones.

    Alternative texts of all objects with the address are joined, each once; dimensions are those of original_info.
    """
    objects = _objects(values, key, {"medium": F.lower(_member(["type", "media_type"])), "raw_url": _member(MEDIA_URLS), "alt": F.trim(_member(["alt_text", "alt"])), "info": F.max(F.when((F.col("name") == "original_info") & (F.col("kind") == "object"), F.col("path")))})
    size = lambda n: F.max(F.when((F.col("name") == n) & (F.col("kind") == "number"), F.col("value").try_cast("int")))
    info = _objects(values.where("parent like '%.original_info'"), key, {"width": size("width"), "height": size("height")}).select(key, F.col("object").alias("info"), "width", "height")
    full = objects.where(F.col("raw_url").isNotNull() & F.coalesce(F.col("medium").isin(PHOTO_KINDS), F.lit(False))).join(info, [key, "info"], "left").withColumn("image_url", urls.upgraded(F.col("raw_url")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place")))
    alts = F.transform(F.array_sort(F.collect_list(F.when(F.col("alt") != "", F.struct("place", "alt")))), lambda x: x["alt"])
    positive = lambda c: F.min_by(c, F.when(F.col(c) > 0, F.col("place")))
    return full.groupBy(key, "image_url").agg(first("raw_url").alias("raw_url"), F.nullif(F.array_join(F.array_distinct(alts), " "), F.lit("")).alias("alt"), positive("width").alias("width"), positive("height").alias("height"))


def products(values: DataFrame, key: str) -> DataFrame:
    """(key, name, item, images) of every named JSON-LD product: images are texts, or the url or contentUrl of objects."""
    kinds = values.where(F.col("kind") == "string").where("name = '@type' or parent like '%.@type'")
    typed = kinds.where(F.lower("value") == "product").select(key, F.when(F.col("name").isNotNull(), F.col("parent")).otherwise(F.regexp_replace("parent", r"\.@type$", "")).alias("object")).distinct()
    named = _objects(values, key, {"name_": F.trim(_member(["name"])), "item": _member(["@id"])}).join(typed, [key, "object"], "left_semi").where("name_ <> ''")
    text = values.where("kind = 'string'")
    owner = lambda pattern: F.regexp_extract("path", pattern, 1)
    direct = text.select(key, owner(r"^(.*)\.image(?:\[\d+\])?$").alias("object"), "place", F.col("value").alias("image"))
    inner = text.where(F.col("name").isin("url", "contentUrl")).groupBy(key, "parent").agg(F.min("place").alias("place"), F.coalesce(F.max(F.when(F.col("name") == "url", F.col("value"))), F.max("value")).alias("image"))
    nested = inner.select(key, F.regexp_extract("parent", r"^(.*)\.image(?:\[\d+\])?$", 1).alias("object"), "place", "image")
    images = direct.unionByName(nested).where("object <> ''").groupBy(key, "object").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "image"))), lambda x: x["image"]).alias("images"))
    return named.join(images, [key, "object"], "left").select(key, F.col("object").alias("path"), F.col("name_").alias("name"), "item", F.coalesce("images", F.array().cast("array<string>")).alias("images"))
