"""Carried-over state, moved assets and pixel metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.functions import pixels
from curaspark.operators import resume
from curaspark.sources.tables import table
from curaspark.streaming import progress

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _proofs(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("item_id"), F.col("event_type").alias("kind"), F.col("event_id").alias("place"), F.concat(F.lit("v"), (F.col("event_id") % 7).cast("string")).alias("work_id"), (F.col("value") > 20).alias("confirmed"), (F.col("event_id") % 3 != 0).alias("linked"))


_FIRST = "f AS (SELECT user_id AS item_id, event_type AS kind, arg_min('v' || event_id % 7, event_id) AS found FROM events WHERE value > 20 AND event_id % 3 <> 0 GROUP BY ALL)"


@query(f"""WITH {_FIRST}, k AS (SELECT DISTINCT user_id AS item_id, 'view' AS kind, 'known' AS had FROM events WHERE user_id % 4 = 0)
SELECT item_id, kind, coalesce(had, found) AS work_id FROM f FULL JOIN k USING (item_id, kind)""")
def established_context(spark: SparkSession, d: str) -> DataFrame:
    """Identities of items: known ones stay, others are those of the first confirmed and linked proof."""
    e = table(spark, d, "events")
    known = e.where("user_id % 4 = 0").select(F.col("user_id").alias("item_id"), F.lit("view").alias("kind"), F.lit("known").alias("work_id")).distinct()
    return resume.established(_proofs(e), known)


@query(f"WITH {_FIRST} SELECT item_id, kind, found AS work_id FROM f")
def established_context_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same over a stream, without known ones: the first batch that establishes an identity decides."""
    return progress.drain(resume.established_stream(_proofs(progress.events(spark, f"{d}/events.parquet"))), "established", "append")


@query("""WITH m AS (SELECT o_custkey AS item_id, bool_or(o_orderkey % 31 = 0) AS repair FROM orders GROUP BY 1), l AS (SELECT DISTINCT c_custkey AS item_id FROM customer WHERE c_custkey % 5 = 1)
SELECT c_custkey AS item_id, CASE WHEN repair THEN 'reopen' WHEN l.item_id IS NOT NULL AND repair IS NULL THEN 'unrecoverable' WHEN c_custkey % 2 = 0 THEN 'skip' ELSE 'run' END AS action
FROM customer LEFT JOIN m ON m.item_id = c_custkey LEFT JOIN l ON l.item_id = c_custkey""")
def resumed_items(spark: SparkSession, d: str) -> DataFrame:
    """What a resumed run does with each item."""
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("item_id")), table(spark, d, "orders")
    failures = c.select("item_id", F.when(F.col("item_id") % 5 == 1, "download_failed").otherwise("entity_mismatch").alias("code"))
    return resume.resumption(c, c.where("item_id % 2 = 0"), o.select(F.col("o_custkey").alias("item_id"), (F.col("o_orderkey") % 31 == 0).alias("needs_download")), failures)


@query("""WITH s AS (SELECT page_id, page_id % 3 AS k FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'alt=a' WHEN 1 THEN 'alt=a,root_source_url=old' ELSE 'alt=a,gallery_path=true' END AS signals FROM s""")
def reset_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Signals without what earlier decisions derived; recovered ones come back from their snapshot."""
    i, text = F.col("page_id"), lambda *x: F.create_map(*map(F.lit, x))
    snap = '{"signals":{"root_source_url":"old","gallery_path":null,"page_title":"no"},"fields":{}}'
    signals = F.when(i % 3 == 0, text("alt", "a", "entity_match", "true", "type_match", "0.5")).when(i % 3 == 1, text("alt", "a", "root_source_url", "new", "gallery_path", "true", "gallery_recovery_original", snap)).otherwise(text("alt", "a", "gallery_path", "true", "duplicate_of", "x"))
    clean = resume.reset_signals(signals)
    listed = F.array_sort(F.transform(F.map_entries(clean), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return table(spark, d, "pages").select("page_id", F.array_join(listed, ",").alias("signals"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/new/r/a/' || page_id || '.jpg' WHEN 1 THEN '/old/task/../x/' || page_id WHEN 2 THEN '/old/tasks/' || page_id ELSE '/new/r' END AS path, 'k' AS name,
CASE WHEN page_id % 4 = 0 THEN '/new/r/a/' || page_id || '.jpg' END AS inner_path, page_id AS number FROM pages""")
def rebased_assets(spark: SparkSession, d: str) -> DataFrame:
    """Paths under a task's old folder, at any depth of structs, arrays and maps, moved to the new one."""
    i = F.col("page_id")
    path = F.when(i % 4 == 0, F.concat(F.lit("/old/task/a/./"), i.cast("string"), F.lit(".jpg"))).when(i % 4 == 1, F.concat(F.lit("/old/task/../x/"), i.cast("string"))).when(i % 4 == 2, F.concat(F.lit("/old/tasks/"), i.cast("string"))).otherwise("/old/task")
    nested = F.struct(F.array(F.create_map(F.lit("k"), F.struct(F.when(i % 4 == 0, path).alias("p"), i.alias("n")))).alias("xs"))
    out = resume.rebase(table(spark, d, "pages").select("page_id", path.alias("path"), nested.alias("tree")), "/old/task", "/new/r/")
    entry = F.map_entries(F.col("tree.xs")[0])[0]
    return out.select("page_id", "path", entry["key"].alias("name"), entry["value"]["p"].alias("inner_path"), entry["value"]["n"].alias("number"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/t/raw/a/' || page_id || '.jpg' WHEN 1 THEN '/t/raw/b.jpg' END AS asset FROM pages""")
def recovered_assets(spark: SparkSession, d: str) -> DataFrame:
    """Recorded assets that lie in their task's folder with the right bytes; publishing folders lead back into it."""
    i, name = F.col("page_id"), F.col("page_id").cast("string")
    path = (
        F.when(i % 6 == 0, F.concat(F.lit("/t/.work/publish-1/a/"), name, F.lit(".jpg"))).when(i % 6 == 1, "b.jpg").when(i % 6 == 2, "../b.jpg").when(i % 6 == 3, "/t/.work/other/b.jpg").when(i % 6 == 4, "/u/raw/b.jpg").otherwise("/t/raw/b.jpg")
    )
    rows = table(spark, d, "pages").select("page_id", path.alias("path"), F.when(i % 6 == 5, "wrong").when(i % 6 == 1, F.lit(None)).otherwise("sha").alias("sha256"))
    assets = rows.where("page_id % 6 = 0").select(F.concat(F.lit("/t/raw/a/"), F.col("page_id").cast("string"), F.lit(".jpg")).alias("path"), F.lit("sha").alias("sha256"))
    assets = assets.unionByName(spark.createDataFrame([("/t/raw/b.jpg", "sha"), ("/u/raw/b.jpg", "sha"), ("/t/b.jpg", "sha")], "path string, sha256 string"))
    return resume.recover(rows, "path", "sha256", "/t/raw", assets).select("page_id", "asset")


@query("""WITH p AS (SELECT vec_id, list_transform(list_concat(embedding, embedding), lambda v: floor((v::DOUBLE + 1) * 128)::INTEGER) AS px, 400 + vec_id % 1000 AS w, 300 + vec_id % 500 AS h FROM embeddings),
c AS (SELECT vec_id, w, h, px, unnest(range(0, 128)) AS i FROM p),
d AS (SELECT vec_id, w, h, i // 16 AS y, i % 16 AS x, px[i + 1] AS c, CASE WHEN i >= 1 THEN px[i] END AS l, px[i + 2] AS r, CASE WHEN i >= 16 THEN px[i - 15] END AS u, px[i + 17] AS b,
  CASE WHEN i >= 17 THEN px[i - 16] END AS ul, CASE WHEN i >= 16 THEN px[i - 14] END AS ur, px[i + 16] AS bl, px[i + 18] AS br FROM c),
e AS (SELECT *, x > 0 AND x < 15 AND y > 0 AND y < 7 AS mid FROM d),
s AS (SELECT vec_id, any_value(w) AS w, any_value(h) AS h, sum(CASE WHEN mid THEN greatest(0, least(255, 8 * c - l - r - u - b - ul - ur - bl - br)) ELSE c END) / 128.0::DOUBLE / 255 AS edge,
  sum(CASE WHEN mid THEN abs(4 * c - l - r - u - b) END) / 84.0::DOUBLE / 1020 AS lap,
  (coalesce(sum(CASE WHEN mid AND x % 8 = 0 THEN abs(c - l) END), 0) + coalesce(sum(CASE WHEN mid AND y % 8 = 0 THEN abs(c - u) END), 0)) / greatest(1, count_if(mid AND x % 8 = 0) + count_if(mid AND y % 8 = 0))::DOUBLE AS bo,
  (coalesce(sum(CASE WHEN mid AND x % 8 = 1 THEN abs(c - l) END), 0) + coalesce(sum(CASE WHEN mid AND y % 8 = 1 THEN abs(c - u) END), 0)) / greatest(1, count_if(mid AND x % 8 = 1) + count_if(mid AND y % 8 = 1))::DOUBLE AS ins FROM e GROUP BY vec_id),
m AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.55::DOUBLE * edge * 2.8::DOUBLE + 0.45::DOUBLE * lap * 8)) AS sharp, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (bo - ins) / 255 * 4)) AS blk FROM s)
SELECT vec_id, round(sharp + 1e-9::DOUBLE, 6) AS sharpness, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.65::DOUBLE * least(1.0::DOUBLE, w / 1280.0::DOUBLE, h / 720.0::DOUBLE) + 0.35::DOUBLE * sharp - 0.15::DOUBLE * blk)) + 1e-9::DOUBLE, 6) AS detail,
round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - lap * 8)) + 1e-9::DOUBLE, 6) AS blur, round(blk + 1e-9::DOUBLE, 6) AS blockiness FROM m""")
def pixel_quality(spark: SparkSession, d: str) -> DataFrame:
    """Sharpness, detail, blur and block borders of pictures of 8 rows and 16 columns, made of each embedding twice."""
    i, x = F.col("vec_id"), F.concat("embedding", "embedding")
    gray = F.transform(x, lambda v: F.floor((v.cast("double") + 1) * 128).cast("int"))
    q = pixels.quality(gray, F.lit(16), (400 + i % 1000).cast("int"), (300 + i % 500).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", q.alias("q")).select("vec_id", *[F.round(F.col(f"q.{n}") + 1e-9, 6).alias(n) for n in ("sharpness", "detail", "blur", "blockiness")])
