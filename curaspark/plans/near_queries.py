"""Representatives of near copies, on the embeddings as pictures of 8 x 8 gray values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.functions import hashing
from curaspark.operators import near
from curaspark.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}

PICTURES = """
e0 AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
e1 AS (SELECT * FROM e0
  UNION ALL SELECT vec_id + 1000000, label, list_concat([-x[1]], x[2:64]) FROM e0 WHERE vec_id % 5 = 0
  UNION ALL SELECT vec_id + 2000000, label, x FROM e0 WHERE vec_id % 7 = 0
  UNION ALL SELECT vec_id + 3000000, label, list_concat(x[1:1], [x[2] + 0.02], x[3:64]) FROM e0 WHERE vec_id % 3 = 0),
h0 AS (SELECT *, list_sum(x) / len(x) AS m FROM e1),
pic AS (SELECT vec_id AS candidate_id, label AS item_id, CASE WHEN vec_id % 23 <> 0 THEN md5(x::VARCHAR) END AS sha256,
  CASE WHEN vec_id % 29 <> 0 THEN list_reduce(list_prepend('', list_transform(x, lambda v: CASE WHEN v >= m THEN '1' ELSE '0' END)), lambda a, b: a || b)::BIT END AS phash,
  list_transform(x, lambda v: floor((v + 1) * 128)::INTEGER) AS px,
  vec_id % 17 = 0 AS x_photo, vec_id % 4 <> 1 AS auto_select, vec_id % 3 = 0 AS entity_match, (vec_id % 101) / 100.0::DOUBLE AS detail,
  least(400 + (vec_id * 37) % 1400, 1280) * least(300 + (vec_id * 53) % 900, 720) AS area, (vec_id * 7919) % 1000 / 10.0::DOUBLE AS total FROM h0)"""


def pictures(spark: SparkSession, d: str) -> DataFrame:
    """embeddings and altered copies of them as candidates of their label: pixels from components, flags and sizes from ids."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    copy = lambda every, offset, x: e.where(F.col("vec_id") % every == 0).select((F.col("vec_id") + offset).alias("vec_id"), "label", x.alias("x"))
    x = F.col("x")
    flipped, brighter = F.concat(F.array(-x[0]), F.slice(x, 2, 63)), F.concat(F.slice(x, 1, 1), F.array(x[1] + 0.02), F.slice(x, 3, 62))
    e = e.unionByName(copy(5, 1_000_000, flipped)).unionByName(copy(7, 2_000_000, x)).unionByName(copy(3, 3_000_000, brighter))
    i = F.col("vec_id")
    bits = F.shiftleft(hashing.mean_bits(x, 0, 32), 32).bitwiseOR(hashing.mean_bits(x, 32, 32))
    return e.select(
        i.alias("candidate_id"), F.col("label").alias("item_id"), F.when(i % 23 != 0, F.sha2(F.to_json(F.struct("x")), 256)).alias("sha256"), F.when(i % 29 != 0, bits).alias("phash"),
        F.struct(F.lit(1.0).alias("aspect"), F.transform(x, lambda v: F.floor((v + 1) * 128).cast("int")).alias("pixels")).alias("picture"),
        (i % 17 == 0).alias("x_photo"), (i % 4 != 1).alias("auto_select"), (i % 3 == 0).alias("entity_match"), ((i % 101) / F.lit(100.0)).alias("detail"),
        (400 + (i * 37) % 1400).cast("int").alias("width"), (300 + (i * 53) % 900).cast("int").alias("height"), ((i * 7919) % 1000 / F.lit(10.0)).alias("total"),
    )


#: 8 x 8 pictures in tiles of 4 x 4.
CONFIRM = near.pixel_confirmation(side=8, tile=4)


def scene_representatives(spark: SparkSession, d: str) -> DataFrame:
    """One representative of each scene of an item; duplicates name theirs. History: every 50th picture's file or hash."""
    p = pictures(spark, d)
    history = p.where("candidate_id % 50 = 3").select("sha256", F.lit(None).cast("long").alias("phash")).unionByName(p.where("candidate_id % 50 = 7").select(F.lit(None).cast("string").alias("sha256"), "phash"))
    return near.representatives(p, history, CONFIRM).select("item_id", "candidate_id", "duplicate_of", "duplicate_kind", "possible_duplicate_of", "historical")


def confirmed_scene_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of candidates of an item with a hash, within eight bits and confirmed by their pixels; equal pictures are one scene."""
    p = pictures(spark, d).where("phash is not null")
    scenes = p.groupBy("item_id", "phash", "picture").agg(F.min("candidate_id").alias("scene"))
    return near.confirmed_pairs(scenes, "item_id", "scene", "phash", "picture", CONFIRM)


_OFF = "list_transform(range(1, 65), lambda i: abs(a.px[i] - b.px[i]))"
_SAME = f"""bit_count(xor(a.phash, b.phash)) <= 8 AND list_sum({_OFF}) <= 3.0 * 64 AND len(list_filter({_OFF}, lambda v: v > 16)) <= 0.025 * 64
  AND len(list_filter(range(0, 4), lambda t: list_sum(list_transform(range(0, 64), lambda i: CASE WHEN (i // 32) * 2 + (i % 8) // 4 = t THEN abs(a.px[i + 1] - b.px[i + 1]) ELSE 0 END)) > 8.0 * 16)) = 0"""

QUERIES["scene_representatives"] = scene_representatives
ORACLE_SQL["scene_representatives"] = f"""
WITH RECURSIVE {PICTURES},
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY x_photo DESC, auto_select DESC, entity_match DESC, detail DESC, area DESC, total DESC, candidate_id) AS k FROM pic),
near AS (SELECT b.item_id, b.k, list(a.k) AS ks FROM ranked a JOIN ranked b ON a.item_id = b.item_id AND a.k < b.k WHERE {_SAME} GROUP BY ALL),
files AS (SELECT b.item_id, b.k, list(a.k) AS ks FROM ranked a JOIN ranked b ON a.item_id = b.item_id AND a.k < b.k AND a.sha256 = b.sha256 GROUP BY ALL),
steps AS (SELECT r.item_id, r.k, coalesce(n.ks, []) AS near, coalesce(f.ks, []) AS files FROM ranked r LEFT JOIN near n USING (item_id, k) LEFT JOIN files f USING (item_id, k)),
fold AS (SELECT DISTINCT item_id, 0::BIGINT AS k, []::BIGINT[] AS leaders FROM ranked
  UNION ALL SELECT f.item_id, s.k, CASE WHEN list_has_any(f.leaders, s.near) OR list_has_any(f.leaders, s.files) THEN f.leaders ELSE list_append(f.leaders, s.k) END
  FROM fold f JOIN steps s ON s.item_id = f.item_id AND s.k = f.k + 1),
final AS (SELECT item_id, max_by(leaders, k) AS leaders FROM fold GROUP BY item_id),
led AS (SELECT r.*, list_contains(f.leaders, r.k) AS leads, list_min(list_intersect(f.leaders, s.files)) AS by_file, list_min(list_intersect(f.leaders, s.near)) AS by_scene
  FROM ranked r JOIN final f USING (item_id) JOIN steps s ON s.item_id = r.item_id AND s.k = r.k),
firsts AS (SELECT item_id, phash, min(k) AS k FROM led WHERE leads AND phash IS NOT NULL GROUP BY ALL),
old AS (SELECT candidate_id % 50 AS kind, sha256, phash FROM pic WHERE candidate_id % 50 IN (3, 7))
SELECT l.item_id, l.candidate_id, d.candidate_id AS duplicate_of, CASE WHEN NOT l.leads THEN CASE WHEN l.by_file IS NOT NULL THEN 'sha256' ELSE 'perceptual_pixels' END END AS duplicate_kind,
  CASE WHEN l.leads AND f.k < l.k THEN p.candidate_id END AS possible_duplicate_of,
  coalesce(l.sha256 IN (SELECT sha256 FROM old WHERE kind = 3 AND sha256 IS NOT NULL), false) OR coalesce(l.phash IN (SELECT phash FROM old WHERE kind = 7 AND phash IS NOT NULL), false) AS historical
FROM led l LEFT JOIN ranked d ON NOT l.leads AND d.item_id = l.item_id AND d.k = coalesce(l.by_file, l.by_scene)
LEFT JOIN firsts f ON f.item_id = l.item_id AND f.phash = l.phash LEFT JOIN ranked p ON p.item_id = l.item_id AND p.k = f.k"""

QUERIES["confirmed_scene_pairs"] = confirmed_scene_pairs
ORACLE_SQL["confirmed_scene_pairs"] = f"""
WITH {PICTURES}, scenes AS (SELECT item_id, phash, px, min(candidate_id) AS scene FROM pic WHERE phash IS NOT NULL GROUP BY ALL)
SELECT a.item_id, a.scene AS a, b.scene AS b FROM scenes a JOIN scenes b ON a.item_id = b.item_id AND a.scene < b.scene WHERE {_SAME}"""
