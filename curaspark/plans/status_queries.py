"""Queries of sections, outcomes, failures, counts and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from curaspark.functions import text
from curaspark.operators import status
from curaspark.plans.binding import CANDIDATES, SCORED, URLS, candidates, scored
from curaspark.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


SECTIONS = ["新作", "汉化情报", "周边", "漢 化", "业界", " ", "��作", "其他新作品"]
KINDS = ["timeout", "http", "permission", "not_found", "database_locked", "database", "json", "image", "os", "connection", "value"]
ITEMS = f"""it AS (SELECT source AS issue, doc_id AS id, {SECTIONS}[doc_id % 8 + 1] AS section, CAST(doc_id % 25 AS INTEGER) AS sequence FROM documents),
la AS (SELECT *, CASE WHEN contains(s, '�') THEN CASE WHEN sequence <= 10 THEN '新作' ELSE '其他' END ELSE s END AS label FROM (SELECT *, CASE WHEN trim(section) = '' THEN 'news' ELSE trim(section) END AS s FROM it)),
pr AS (SELECT *, CASE WHEN contains(replace(label, ' ', ''), '新作') THEN 'x' WHEN contains(replace(label, ' ', ''), '汉化') OR contains(replace(label, ' ', ''), '漢化') THEN 'h' ELSE 'z' END AS prefix FROM la)"""


def _items(spark, d):
    section = F.element_at(F.array(*map(F.lit, SECTIONS)), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, d, "documents").select(F.col("source").alias("issue"), F.col("doc_id").alias("id"), section.alias("section"), (F.col("doc_id") % 25).cast("int").alias("sequence"))


@query(f"WITH {ITEMS}, f AS (SELECT *, prefix || row_number() OVER (PARTITION BY issue, prefix ORDER BY sequence, id) AS folder FROM pr) SELECT id, label, prefix, folder FROM f WHERE prefix IN ('x', 'h')")
def section_folders(spark, d):
    return status.sectioned(_items(spark, d), ["x", "h"], unicode=False).select("id", "label", "prefix", "folder")


@query("""WITH t AS (SELECT page_id, regexp_replace(trim(regexp_replace(url, '[\\\\/:*?"<>|]', '', 'g')), '\\.+$', '') AS s FROM pages) SELECT page_id, CASE WHEN s = '' THEN 'page' ELSE s END AS title FROM t""")
def safe_titles(spark, d):
    return table(spark, d, "pages").select("page_id", text.safe_title(F.col("url"), F.lit("page")).alias("title"))


@query(f"""WITH e AS (SELECT doc_id, {KINDS}[doc_id % 11 + 1] AS kind, CASE WHEN doc_id % 11 = 1 THEN [404, 429, 503][doc_id % 3 + 1] END AS st, CASE WHEN doc_id % 2 = 0 THEN 'database is Locked' ELSE 'Image file is truncated' END AS msg FROM documents)
SELECT doc_id, CASE WHEN kind = 'timeout' THEN 'timeout' WHEN st = 429 THEN 'http_429' WHEN st IS NOT NULL THEN 'http_error' WHEN kind = 'permission' THEN 'file_permission' WHEN kind = 'not_found' THEN 'file_missing'
  WHEN kind = 'database_locked' OR kind = 'database' AND doc_id % 2 = 0 THEN 'sqlite_locked' WHEN kind = 'json' THEN 'corrupt_json' WHEN kind = 'image' OR kind = 'os' AND doc_id % 2 = 1 THEN 'image_decode' WHEN kind = 'connection' THEN 'connect' WHEN kind = 'database' THEN 'sqlite_error' ELSE 'error' END AS code,
CASE WHEN kind = 'timeout' THEN true WHEN st IS NOT NULL THEN st = 429 OR st >= 500 WHEN kind IN ('permission', 'database_locked', 'connection') THEN true WHEN kind = 'database' THEN doc_id % 2 = 0 ELSE false END AS retryable FROM e""")
def error_diagnosis(spark, d):
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (i % 11 + 1).cast("int"))
    st = F.when(i % 11 == 1, F.element_at(F.array(F.lit(404), F.lit(429), F.lit(503)), (i % 3 + 1).cast("int")))
    found = text.diagnosis(kind, st, F.when(i % 2 == 0, "database is Locked").otherwise("Image file is truncated"))
    return table(spark, d, "documents").select("doc_id", found.alias("x")).select("doc_id", "x.code", "x.retryable")


# media: candidates with the state of their download; failures of some of them
MEDIA = """
media AS (SELECT *, CASE candidate_id % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'retryable_failed' WHEN 2 THEN 'permanent_failed' ELSE 'downloaded' END AS download_status, CASE WHEN candidate_id % 7 > 2 OR candidate_id % 14 = 0 THEN 'm/' || candidate_id END AS local_path,
  auto_select AND candidate_id % 3 = 0 AS selected, candidate_id % 5 > 0 AS downloadable, ['selected','unselected','invalid'][candidate_id % 3 + 1] AS curation_status, CASE WHEN candidate_id % 2 = 0 THEN 'tiny' END AS invalid_reason FROM {base}),
fails AS (SELECT doc_id AS candidate_id, CASE WHEN doc_id % 3 = 0 THEN 'timeout' ELSE 'http_error' END AS code, doc_id % 3 = 0 AS retryable, CASE WHEN doc_id % 4 = 0 THEN 'download' ELSE 'parse' END AS stage FROM documents WHERE doc_id % 6 < 2)"""


def _media(c):
    i = F.col("candidate_id")
    return c.withColumns({
        "download_status": F.when(i % 7 == 0, "pending").when(i % 7 == 1, "retryable_failed").when(i % 7 == 2, "permanent_failed").otherwise("downloaded"),
        "local_path": F.when((i % 7 > 2) | (i % 14 == 0), F.concat(F.lit("m/"), i)), "selected": F.col("auto_select") & (i % 3 == 0), "downloadable": i % 5 > 0,
        "curation_status": F.element_at(F.array(F.lit("selected"), F.lit("unselected"), F.lit("invalid")), (i % 3 + 1).cast("int")), "invalid_reason": F.when(i % 2 == 0, "tiny"),
    })


def _failures(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").where(i % 6 < 2).select(i.alias("candidate_id"), F.when(i % 3 == 0, "timeout").otherwise("http_error").alias("code"), (i % 3 == 0).alias("retryable"), F.when(i % 4 == 0, "download").otherwise("parse").alias("stage"))


OF_CANDIDATES, OF_SCORED = CANDIDATES + "," + MEDIA.format(base="cand"), SCORED + "," + MEDIA.format(base="scored")


@query(f"""WITH {OF_CANDIDATES} SELECT item_id, count(*) FILTER (x_photo) AS x_attachments, count(*) FILTER (x_photo AND download_status = 'downloaded') AS x_downloaded, count(*) FILTER (x_photo AND download_status IN ('pending', 'retryable_failed')) AS x_pending, count(*) FILTER (x_photo AND download_status IN ('retryable_failed', 'permanent_failed')) AS x_failed,
count(*) FILTER (selected) AS selected, count(*) FILTER (download_status = 'downloaded') AS downloaded, count(*) FILTER (download_status = 'pending') AS pending, count(*) FILTER (download_status = 'retryable_failed') AS retryable_failed, count(*) FILTER (download_status = 'permanent_failed') AS permanent_failed,
count(*) FILTER (local_path IS NOT NULL AND download_status = 'downloaded') AS success_count, count(*) FILTER (download_status <> 'downloaded') AS failed_count FROM media GROUP BY item_id""")
def media_counts(spark, d):
    return status.media_counts(_media(candidates(spark, d)), "item_id")


@query(f"""WITH {OF_CANDIDATES} SELECT m.candidate_id, CASE WHEN f.code IS NULL THEN downloadable ELSE false END AS downloadable, CASE WHEN f.code IS NULL THEN local_path END AS local_path,
CASE WHEN f.retryable THEN 'retryable_failed' WHEN f.code IS NOT NULL THEN 'permanent_failed' ELSE download_status END AS download_status, coalesce(f.code, invalid_reason) AS invalid_reason FROM media m LEFT JOIN fails f ON m.candidate_id = f.candidate_id""")
def download_outcomes(spark, d):
    return status.apply_outcomes(_media(candidates(spark, d)), _failures(spark, d)).select("candidate_id", "downloadable", "local_path", "download_status", "invalid_reason")


@query(f"""WITH {OF_CANDIDATES} SELECT candidate_id FROM media m WHERE NOT (candidate_id % 5 = 1) AND download_status <> 'permanent_failed'
AND NOT (download_status = 'pending' AND invalid_reason IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fails f WHERE f.candidate_id = m.candidate_id AND f.stage = 'download' AND f.retryable))""")
def needs_download(spark, d):
    c = _media(candidates(spark, d)).withColumn("reusable", F.col("candidate_id") % 5 == 1)
    return status.needs_download(c, _failures(spark, d)).select("candidate_id")


@query(f"""WITH {OF_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY x_photo DESC, total DESC, trust DESC, width::BIGINT * height DESC, candidate_id) AS place FROM media WHERE NOT selected AND curation_status <> 'invalid' AND downloadable AND local_path IS NOT NULL)
SELECT item_id, candidate_id, place FROM r""")
def reviewable_failures(spark, d):
    return status.delivered(status.reviewable_failed(_media(scored(spark, d))), 0).select("item_id", "candidate_id", "place")


@query(f"""WITH {OF_SCORED}, r AS (SELECT *, row_number() OVER w AS place, sum(selected::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS taken FROM media WINDOW w AS (PARTITION BY item_id ORDER BY x_photo DESC, total DESC, trust DESC, width::BIGINT * height DESC, candidate_id))
SELECT item_id, candidate_id, place, selected AND taken <= 10 AS kept FROM r""")
def delivered_order(spark, d):
    return status.delivered(_media(scored(spark, d)), 10).select("item_id", "candidate_id", "place", "kept")


@query("""SELECT b.doc_id AS sequence, coalesce(CASE WHEN l.quality = 1 THEN 'release' END, 'unknown') AS event_type, coalesce(l.toxic / 2.0, 0.25)::DOUBLE AS importance, b.lang AS title FROM documents b LEFT JOIN labels l ON b.doc_id = l.doc_id""")
def enriched_items(spark, d):
    base = table(spark, d, "documents").select(F.col("doc_id").alias("sequence"), F.lit("unknown").alias("event_type"), F.lit(0.25).alias("importance"), F.col("lang").alias("title"))
    found = table(spark, d, "labels").select(F.col("doc_id").alias("sequence"), F.when(F.col("quality") == 1, "release").alias("event_type"), (F.col("toxic") / 2.0).alias("importance"), F.lit("not allowed").alias("title"))
    return status.enriched(base, found).select("sequence", "event_type", "importance", "title")


@query("WITH g AS (SELECT l_suppkey, bool_or(l_quantity >= 49 AND l_linenumber = 1) AS a FROM lineitem GROUP BY 1) SELECT count(*) FILTER (NOT a) AS zero_selected FROM g")
def zero_selected(spark, d):
    return status.zero_selected(table(spark, d, "lineitem").withColumn("selected", (F.col("l_quantity") >= 49) & (F.col("l_linenumber") == 1)), "l_suppkey")


@query(f"""WITH {OF_CANDIDATES}, r AS (SELECT *, CASE WHEN quality IS NOT NULL THEN image_type END AS label, image_type = 'game_cg' OR candidate_id % 4 = 0 AND image_type = 'key_visual' AS said, candidate_id % 9 > 0 AS valid FROM media)
SELECT count(label) AS labeled_count, count(*) FILTER (label = 'game_cg') AS true_count, count(*) FILTER (said) AS predicted_count, count(*) FILTER (said AND selected) AS selected_count, count(*) FILTER (said AND selected AND label IS NOT NULL) AS labeled_selected_count,
round(count(*) FILTER (said AND selected AND label = 'game_cg') / nullif(count(*) FILTER (said AND selected AND label IS NOT NULL), 0), 6) AS selected_precision,
round(count(*) FILTER (label = 'game_cg' AND valid AND curation_status <> 'invalid') / nullif(count(*) FILTER (label = 'game_cg'), 0), 6) AS retention, count(*) FILTER (label = 'game_cg' AND valid AND curation_status <> 'invalid') AS retained_count FROM r""")
def role_metrics(spark, d):
    c, i = _media(candidates(spark, d)), F.col("candidate_id")
    said = F.when((F.col("image_type") == "game_cg") | ((i % 4 == 0) & (F.col("image_type") == "key_visual")), "game_cg").otherwise("other")
    return status.role_metrics(c.withColumns({"type_label": F.when(F.col("label_quality").isNotNull(), F.col("image_type")), "type_prediction": said, "file_valid": i % 9 > 0}), "game_cg")


@query("""SELECT o_custkey AS image_id, arg_min(o_orderstatus, o_orderkey) AS first_seen, arg_max(o_orderstatus, o_orderkey) AS last_seen, arg_max(p, o_orderkey) FILTER (p IS NOT NULL) AS local_path
FROM (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN 'p/' || o_orderkey END AS p FROM orders) GROUP BY 1""")
def history_images(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("image_id"), F.col("o_orderstatus").alias("issue"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("p/"), "o_orderkey")).alias("path"))
    return status.seen_images(o)


@query("""WITH g AS (SELECT o_custkey, count(*) AS n, arg_min(o_orderpriority, o_orderkey) AS a, arg_max(o_orderpriority, o_orderkey) AS b FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN a = b THEN a ELSE a || '|' || b END AS alternates FROM g WHERE n > 1""")
def source_alternates(spark, d):
    return status.alternates(table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("root"), F.col("o_orderkey").alias("ord")), ["o_custkey"])


@query("""WITH r AS (SELECT *, l_linenumber % 2 = 1 AS official, sum((l_linenumber % 2 = 1)::INT) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS n FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS m FROM r WHERE NOT official OR n <= 16) SELECT l_suppkey, l_orderkey, l_linenumber FROM k WHERE m <= 24""")
def capped_sources(spark, d):
    rows = table(spark, d, "lineitem").withColumn("official", F.col("l_linenumber") % 2 == 1)
    order = [F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return status.capped_sources(rows, "l_suppkey", order, 16, 24).select("l_suppkey", "l_orderkey", "l_linenumber")


@query(f"""WITH {URLS}, x AS (SELECT page_id, p || ['/a.svg','/profile_images/1.png','/b.PNG','/x','/c.mp4'][page_id % 5 + 1] AS pp, ['official_site','steam','video','direct_image'][page_id % 4 + 1] AS t FROM uu)
SELECT page_id, t = 'video' OR t = 'direct_image' OR regexp_matches(lower(pp), '\\.(jpg|jpeg|png|webp|gif|avif)$') AS offline, CASE WHEN ends_with(lower(pp), '.svg') OR contains(lower(pp), 'profile_images') OR contains(lower(pp), 'editorui/fonts') THEN 'invalid_material' END AS fault FROM x""")
def offline_assets(spark, d):
    from curaspark.functions import urls

    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.col("page_id") % n + 1).cast("int"))
    u = F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.netloc(F.col("url")), urls.path(F.col("url")), pick(["/a.svg", "/profile_images/1.png", "/b.PNG", "/x", "/c.mp4"], 5))
    x = table(spark, d, "pages").select("page_id", u.alias("url"), pick(["official_site", "steam", "video", "direct_image"], 4).alias("source_type"))
    kept = status.offline(x).select(F.col("page_id").alias("k"))
    return x.join(kept, F.col("page_id") == F.col("k"), "left").select("page_id", F.col("k").isNotNull().alias("offline"), status.meaningless(F.col("url")).alias("fault"))


@query("""WITH x AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '-5' WHEN 1 THEN 'abc' WHEN 2 THEN '0' ELSE CAST(n_chars AS VARCHAR) END AS w, CASE doc_id % 3 WHEN 0 THEN 's_640x360.jpg' WHEN 1 THEN 's.1920x1080.jpg' ELSE 's.jpg' END AS f FROM documents),
y AS (SELECT *, CASE WHEN try_cast(w AS INT) > 0 THEN try_cast(w AS INT) END AS n, try_cast(nullif(regexp_extract(f, '(?:^|[._-])(\\d{2,4})x(\\d{2,4})(?:[._-]|$)', 1), '') AS INT) AS a, try_cast(nullif(regexp_extract(f, '(?:^|[._-])(\\d{2,4})x(\\d{2,4})(?:[._-]|$)', 2), '') AS INT) AS b FROM x)
SELECT doc_id, n AS dimension, CASE WHEN n IS NOT NULL AND n < 800 OR coalesce(a < 800 OR b < 450, false) THEN 'unknown' ELSE 'full' END AS tier, CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2024-05-01 10:00:00' ELSE TIMESTAMP '2020-01-01 00:00:00' END AS seen FROM y""")
def dimensions_and_times(spark, d):
    i = F.col("doc_id")
    w = F.when(i % 4 == 0, "-5").when(i % 4 == 1, "abc").when(i % 4 == 2, "0").otherwise(F.col("n_chars").cast("string"))
    f = F.concat(F.lit("https://a.example/"), F.when(i % 3 == 0, "s_640x360.jpg").when(i % 3 == 1, "s.1920x1080.jpg").otherwise("s.jpg"))
    n = status.dimension(F.col("w"))
    seen = status.moment(F.when(i % 2 == 0, "2024-05-01T10:00:00").otherwise("soon"), F.lit("2020-01-01 00:00:00").cast("timestamp"))
    x = table(spark, d, "documents").select("doc_id", w.alias("w"), f.alias("f"), seen.cast("timestamp_ntz").alias("seen"))
    return x.select("doc_id", n.alias("dimension"), status.tier(F.col("f"), n, F.when(n.isNotNull(), 600), F.lit("full")).alias("tier"), "seen")


SIGNS = ["89504E470D0A1A0A00", "FFD8FFE000", "47494638396100", "524946460000000057454250", "00000020667479706176696600", "3C737667"]


@query(f"""SELECT doc_id, ['image/png','image/jpeg','image/gif','image/webp','image/avif',NULL][doc_id % 6 + 1] AS mime, CASE WHEN doc_id % 6 = 5 THEN 'invalid_magic' WHEN doc_id % 7 = 0 THEN 'corrupt_image' WHEN n_chars % 40 < 16 THEN 'tracking_pixel' END AS fault FROM documents""")
def image_validation(spark, d):
    data = F.unhex(F.element_at(F.array(*map(F.lit, SIGNS)), (F.col("doc_id") % 6 + 1).cast("int")))
    x = table(spark, d, "documents").select("doc_id", data.alias("data"), F.when(F.col("doc_id") % 7 > 0, F.col("n_chars") % 40).alias("w"))
    return x.select("doc_id", status.mime(F.col("data")).alias("mime"), status.image_fault(F.col("data"), F.col("w"), F.lit(20)).alias("fault"))


@query("""WITH s AS (SELECT 0 AS stage, p_partkey AS k, p_partkey AS ord FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 1, p_partkey, p_size FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 2, p_partkey, 0 FROM part)
SELECT k, min(stage) AS stage, arg_min(ord, stage) AS ord FROM s GROUP BY k""")
def merged_sources(spark, d):
    p = table(spark, d, "part")
    stage = lambda x, o: x.select(F.col("p_partkey").alias("k"), o.cast("long").alias("ord"))
    return status.merged_sources([stage(p.where("p_partkey % 4 = 0"), F.col("p_partkey")), stage(p.where("p_partkey % 3 = 0"), F.col("p_size")), stage(p, F.lit(0))], ["k"])


@query("SELECT o_orderkey, o_orderstatus = 'F' AND o_orderkey % 3 = 1 AND o_custkey % 2 = 0 AS valid, CASE WHEN o_orderstatus <> 'F' THEN 'schema' WHEN o_orderkey % 3 <> 1 THEN 'issue' WHEN o_custkey % 2 <> 0 THEN 'task' END AS mismatch FROM orders")
def checkpoint_validity(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("schema"), (F.col("o_orderkey") % 3).alias("issue"), (F.col("o_custkey") % 2).alias("task"))
    return status.checkpoint_valid(o, {"schema": "F", "issue": 1, "task": 0}).select("o_orderkey", "valid", "mismatch")


@query(f"WITH {OF_CANDIDATES} SELECT false AS equal, count(*) FILTER (downloadable OR candidate_id % 10 = 0) >= count(*) FILTER (downloadable) AS successes_not_lower, count(*) FILTER (selected AND candidate_id % 6 > 0) >= count(*) FILTER (selected) AS selected_not_lower FROM media")
def run_parity(spark, d):
    old = _media(candidates(spark, d))
    new = old.withColumns({"downloadable": F.col("downloadable") | (F.col("candidate_id") % 10 == 0), "selected": F.col("selected") & (F.col("candidate_id") % 6 > 0)})
    return status.parity(old, new, ["item_id", "candidate_id", "downloadable", "selected", "curation_status"])


@query("""SELECT doc_id, source AS item_id FROM documents WHERE doc_id % 3 = 0 UNION SELECT doc_id, source FROM documents WHERE doc_id % 2 = 0""")
def manual_decisions(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.col("source").alias("item_id"))
    return x.where("doc_id % 3 = 0").unionByName(x.where("doc_id % 2 = 0")).distinct()
