"""Scalar, URL, page, merge, lookup, history and progress queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curaspark.functions import hashing, text, urls
from curaspark.operators import classify, relational
from curaspark.plans.binding import URL_PARTS, URLS
from curaspark.schemas import violations
from curaspark.sources import pages as pages_source
from curaspark.sources.tables import table
from curaspark.streaming import progress

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {URLS} SELECT page_id, norm AS normalized, s || '|' || n || '|' || regexp_replace(p, '/+$', '') || '|' || q AS source_key, h AS host FROM uu""")
def url_normalize(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.normalized(u).alias("normalized"), urls.source_key(u).alias("source_key"), urls.host(u).alias("host"))


@query(f"""WITH {URLS} SELECT page_id, s || '|' || n || '|' || regexp_replace(p, '/+$', '') || '|' || q || '|' || f AS visit_key,
s || '://' || n || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q <> '' THEN '?' || q ELSE '' END || CASE WHEN regexp_matches(lower(f), 'gallery|graphic') THEN '#' || f ELSE '' END AS navigation FROM uu""")
def url_visit_keys(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.visit_key(u).alias("visit_key"), urls.navigation(u).alias("navigation"))


@query(f"""WITH {URLS}, r AS (SELECT *, row_number() OVER (PARTITION BY h || regexp_replace(p, '/+$', '') ORDER BY page_id) AS k FROM uu) SELECT page_id, url FROM r WHERE k = 1""")
def url_first_wins(spark, d):
    u = F.col("url")
    keyed = table(spark, d, "pages").select("page_id", "url", F.concat(urls.host(u), F.regexp_replace(urls.path(u), "/+$", "")).alias("k"))
    return relational.first_wins(keyed, ["k"], [F.asc("page_id")]).select("page_id", "url")


@query(f"""WITH {URLS}, x AS (SELECT page_id, s, n, p, f, q || CASE WHEN q = '' THEN '' ELSE '&' END || 'token=abc&page=2&X-Amz-Date=1' AS q2 FROM uu)
SELECT page_id, s || '://' || n || p || '?' || array_to_string(list_filter(string_split(q2, '&'), lambda a: a <> '' AND lower(split_part(a, '=', 1)) NOT IN ('token','access_token','auth','authorization','key','api_key','apikey','secret','signature','sig') AND NOT starts_with(lower(split_part(a, '=', 1)), 'x-amz-')), '&') AS redacted FROM x""")
def url_redaction(spark, d):
    u = F.col("url")
    bare = F.concat(urls.scheme(u), F.lit("://"), urls.netloc(u), urls.path(u))
    q = F.concat(urls.query(u), F.when(urls.query(u) == "", "").otherwise("&"), F.lit("token=abc&page=2&X-Amz-Date=1"))
    return table(spark, d, "pages").select("page_id", urls.redacted(F.concat(bare, F.lit("?"), q)).alias("redacted"))


@query(f"""WITH {URLS}, m AS (SELECT page_id, s || '://' || n || p || CASE page_id % 6 WHEN 0 THEN '/clip.mp4' WHEN 1 THEN '/a.jpg' WHEN 2 THEN '' ELSE '/gallery/b.png' END AS t, n AS h, lower(p || CASE page_id % 6 WHEN 0 THEN '/clip.mp4' WHEN 1 THEN '/a.jpg' WHEN 2 THEN '' ELSE '/gallery/b.png' END) AS p2 FROM uu)
SELECT page_id, CASE WHEN regexp_matches(p2, '\\.(mp4|webm|m3u8)$') THEN 'video' WHEN regexp_matches(p2, '\\.(jpg|jpeg|png|webp|gif|avif)$') THEN 'direct_image' ELSE 'official_site' END AS source_type,
CASE WHEN regexp_matches(p2, '\\.(mp4|webm|m3u8)$') THEN 0.5::DOUBLE WHEN regexp_matches(p2, '\\.(jpg|jpeg|png|webp|gif|avif)$') THEN 0.8::DOUBLE ELSE 0.75::DOUBLE END AS officiality,
regexp_matches(p2, '\\.(mp4|webm|m3u8)$') AS requires_review,
CASE WHEN regexp_matches(p2, '/gallery/|/cg/|/(cg|gallery|ss[_-]?)[0-9]+[^/]*$') THEN 0 WHEN regexp_matches(p2, '/screenshot|/sample|/points/') THEN 1 ELSE 2 END AS priority,
regexp_matches(p2, '\\.(jpg|jpeg|png|webp|gif|avif)$') OR (regexp_matches(p2 || '/', '/(gallery|cg|images|media|screenshot|screenshots)/') AND NOT ends_with(p2, '/')) AS is_image FROM m""")
def source_typing(spark, d):
    tail = classify.rules((F.col("page_id") % 6 == 0, "/clip.mp4"), (F.col("page_id") % 6 == 1, "/a.jpg"), (F.col("page_id") % 6 == 2, ""), otherwise="/gallery/b.png")
    u = F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.netloc(F.col("url")), urls.path(F.col("url")), tail)
    x = table(spark, d, "pages").select("page_id", u.alias("u")).select("page_id", classify.source_type(F.col("u")).alias("t"), urls.image_priority(F.col("u")).alias("priority"), urls.looks_like_image(F.col("u")).alias("is_image"))
    return x.select("page_id", "t.source_type", "t.officiality", "t.requires_review", "priority", "is_image")


@query(f"""WITH {URLS}, k AS (SELECT *, ['official_x','steam','official_site','direct_image','unverified'][page_id % 5 + 1] AS kind, lower(p) AS lp FROM uu)
SELECT page_id, CASE WHEN kind = 'official_x' THEN 'official_event_page' WHEN kind = 'steam' THEN 'steam' WHEN kind = 'official_site' AND regexp_matches(lp, '/event|/news|/announce|/update') THEN 'official_event_page' WHEN kind = 'official_site' AND regexp_matches(lp, '/brand|/company|/about') THEN 'official_brand_page' WHEN kind = 'official_site' AND regexp_matches(lp, '/store|/shop|/goods') THEN 'official_store' WHEN kind = 'official_site' THEN 'official_game_page' WHEN kind = 'direct_image' AND page_id % 2 = 0 THEN 'official_game_page' WHEN kind = 'direct_image' THEN 'image_proxy'
  WHEN contains(h, 'kun') THEN 'third_party_news' WHEN regexp_matches(h, '^(cdn|static|images|img|media)\\.') OR page_id % 3 = 0 THEN 'image_proxy' ELSE 'unknown' END AS tier,
CASE WHEN kind = 'official_x' THEN 0.88::DOUBLE WHEN kind = 'steam' THEN 0.82::DOUBLE WHEN kind = 'official_site' AND regexp_matches(lp, '/event|/news|/announce|/update') THEN 0.98::DOUBLE WHEN kind = 'official_site' AND regexp_matches(lp, '/brand|/company|/about') THEN 0.9::DOUBLE WHEN kind = 'official_site' AND regexp_matches(lp, '/store|/shop|/goods') THEN 0.86::DOUBLE WHEN kind = 'official_site' THEN 0.95::DOUBLE WHEN kind = 'direct_image' AND page_id % 2 = 0 THEN 0.9::DOUBLE WHEN kind = 'direct_image' THEN 0.3::DOUBLE
  WHEN contains(h, 'kun') THEN 0.18::DOUBLE WHEN regexp_matches(h, '^(cdn|static|images|img|media)\\.') OR page_id % 3 = 0 THEN 0.25::DOUBLE ELSE 0.1::DOUBLE END AS officiality FROM k""")
def host_trust_tier(spark, d):
    kinds = F.element_at(F.array(*map(F.lit, ["official_x", "steam", "official_site", "direct_image", "unverified"])), (F.col("page_id") % 5 + 1).cast("int"))
    image = F.when(F.col("page_id") % 3 == 0, "https://elsewhere.example/a.png").otherwise(F.col("url"))
    t = classify.trust_tier(kinds, F.col("url"), image, F.col("page_id") % 2 == 0)
    return table(spark, d, "pages").select("page_id", t.alias("t")).select("page_id", "t.tier", "t.officiality")


@query("""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)) AS title, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS n_links, md5(array_to_string(regexp_extract_all(html, 'href="([^"]*)"', 1), ' ')) AS links_md5 FROM pages""")
def page_links(spark, d):
    found = pages_source.hrefs(F.col("html"))
    return table(spark, d, "pages").select("page_id", pages_source.title(F.col("html")).alias("title"), F.size(found).cast("long").alias("n_links"), F.md5(F.array_join(found, " ")).alias("links_md5"))


@query(f"""WITH {URLS}, l AS (SELECT page_id, s, n, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS href FROM uu)
SELECT s || '://' || n || href AS link, count(*) AS n_pages, min(page_id) AS first_page FROM l GROUP BY 1""")
def link_targets(spark, d):
    out = pages_source.links(table(spark, d, "pages")).where(F.regexp_like(F.col("link"), F.lit("^https?://")))
    pages = table(spark, d, "pages").select("page_id", urls.scheme(F.col("url")).alias("s"), urls.netloc(F.col("url")).alias("n"))
    own = out.join(pages, "page_id").where(F.col("link").startswith(F.concat(F.col("s"), F.lit("://"), F.col("n"), F.lit("/"))))
    return own.groupBy("link").agg(F.count(F.lit(1)).alias("n_pages"), F.min("page_id").alias("first_page"))



@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS src, 100 + o_custkey % 50 AS dst FROM customer JOIN orders ON c_custkey = o_custkey UNION SELECT DISTINCT 100 + o_custkey % 50, 1000 + o_orderkey % 200 FROM orders UNION SELECT DISTINCT 1000 + o_orderkey % 200, 5000 + o_orderkey % 1000 FROM orders),
r AS (SELECT n_nationkey::BIGINT AS root FROM nation WHERE n_regionkey = 1),
l1 AS (SELECT root, dst AS node, min(src) AS parent FROM r JOIN e ON root = src GROUP BY ALL),
l2 AS (SELECT root, dst AS node, min(src) AS parent FROM l1 JOIN e ON node = src GROUP BY ALL)
SELECT root, root AS node, 0 AS level FROM r UNION ALL SELECT root, node, 1 FROM l1 UNION ALL SELECT root, node, 2 FROM l2""")
def bounded_crawl(spark, d):
    """Breadth first from the roots to depth 2; nodes are visited once per root."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    mid, leaf = (100 + F.col("o_custkey") % 50), (1000 + F.col("o_orderkey") % 200)
    e1 = c.join(o, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").cast("long").alias("src"), mid.cast("long").alias("dst"))
    e2 = o.select(mid.cast("long").alias("src"), leaf.cast("long").alias("dst"))
    e3 = o.select(leaf.cast("long").alias("src"), (5000 + F.col("o_orderkey") % 1000).cast("long").alias("dst"))
    roots = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("root"))
    return relational.bounded_reach(e1.union(e2).union(e3).distinct(), roots, 2).select("root", "node", "level")


@query("""SELECT doc_id, substr(sha256(source || chr(0) || doc_id::VARCHAR || chr(0) || lower(lang)), 1, 16) AS item_id FROM documents""")
def stable_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.item_id(F.col("source"), F.col("doc_id"), F.lower("lang")).alias("item_id"))


@query(rf"""WITH {URLS} SELECT page_id, substr(sha256(h || chr(0) || norm), 1, 16) AS candidate_id, substr(sha256(norm), 1, 16) AS video_id FROM uu""")
def candidate_ids(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", hashing.candidate_id(urls.host(u), u).alias("candidate_id"), hashing.video_id(u).alias("video_id"))


@query(r"""SELECT doc_id, md5(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g')) AS compact_md5, md5(regexp_replace(lower(text), '[\s\p{P}\p{S}]', '', 'g')) AS portal_md5 FROM documents""")
def text_keys(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(text.compact(t, False)).alias("compact_md5"), F.md5(text.portal_key(t, False)).alias("portal_md5"))


@query(r"""WITH s AS (SELECT doc_id, regexp_replace(text, '[\r\n]+', ' ', 'g') AS t FROM documents) SELECT doc_id, substr(t, 1, 300) AS snippet, CASE WHEN length(t) > 280 THEN left(t, 277) || '...' ELSE t END AS short FROM s""")
def text_snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"), text.ellipsis(F.col("text")).alias("short"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '汉化|漢化|本地化|翻译|翻譯') THEN 'localization' WHEN regexp_matches(text, '周边|周邊|商品|グッズ') THEN 'goods' WHEN regexp_matches(text, '(?i)体验版|體驗版|demo|试玩|試玩') THEN 'demo' WHEN regexp_matches(text, '发售|発売|上市|销售|販售') THEN 'release' WHEN regexp_matches(text, '活动|活動|イベント|展会|展覽') THEN 'event' WHEN regexp_matches(text, '(?i)更新|公开|公開|公布|新增|追加|发布|發佈|發布|释出|釋出|展示|附上|解禁|登场|登場|掲載|配信|披露|new') THEN 'update' WHEN regexp_matches(text, '新作') THEN 'new_title' ELSE 'unknown' END AS event_type FROM documents""")
def event_classification(spark, d):
    return table(spark, d, "documents").select("doc_id", classify.event_type(F.col("text"), F.col("source")).alias("event_type"))


@query(r"""SELECT event_id, CAST(regexp_extract(props, ':\s*(-?[0-9]+)', 1) AS BIGINT) AS k, greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 100)) AS clamped, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0::DOUBLE / 365.0::DOUBLE))::DOUBLE AS freshness FROM events WHERE event_type = 'view'""")
def json_clamp_freshness(spark, d):
    e = table(spark, d, "events").where("event_type = 'view'")
    k = F.element_at(F.map_values(F.from_json("props", F.lit("map<string,bigint>"))), 1)
    fresh = text.freshness(F.col("ts").cast("timestamp"), F.lit("2024-02-01").cast("timestamp"))
    return e.select("event_id", k.alias("k"), text.clamp(F.col("value") / 100, 0.0, 1.0, 0.0).alias("clamped"), fresh.alias("freshness"))


@query("""SELECT user_id, event_type, sum(1 + event_id % 3)::BIGINT AS occurrences, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events WHERE event_type = 'error' GROUP BY ALL""")
def failure_merge(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").withColumn("occurrences", 1 + F.col("event_id") % 3).withColumn("ord", F.col("event_id"))
    return relational.merge_failures(e, ["user_id", "event_type"], "ord", ["event_id", "value"])


@query("""SELECT user_id, max(event_id // 7) AS revision, arg_max(event_id, (event_id // 7) * 1000000000 - event_id) AS event_id FROM events GROUP BY user_id""")
def latest_revision(spark, d):
    e = table(spark, d, "events").select("user_id", F.expr("event_id div 7").alias("revision"), "event_id")
    return relational.latest(e, "user_id", "revision", "event_id")


@query("""SELECT user_id, count(*) AS n_events, count_if(event_type = 'error') AS n_failed, count_if(event_type = 'purchase') AS n_completed, max(event_id) AS last_event, arg_max(value, event_id) AS last_value FROM events GROUP BY user_id""")
def progress_counters(spark, d):
    return progress.counters(table(spark, d, "events"))


@query("""SELECT user_id, count(*) AS n_events, count_if(event_type = 'error') AS n_failed, count_if(event_type = 'purchase') AS n_completed, max(event_id) AS last_event, arg_max(value, event_id) AS last_value FROM events GROUP BY user_id""")
def progress_counters_stream(spark, d):
    """The same counters as a stream over the events, run to its end."""
    import uuid

    return progress.drain(progress.counters(progress.events(spark, f"{d}/events.parquet")), f"counters_{uuid.uuid4().hex[:8]}")


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_windows_stream(spark, d):
    """Extension: daily event-time windows."""
    import uuid

    out = progress.drain(progress.tumbling(progress.events(spark, f"{d}/events.parquet")), f"daily_{uuid.uuid4().hex[:8]}")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT DISTINCT event_id, user_id, event_type FROM events""")
def deliver_once_stream(spark, d):
    import uuid

    return progress.drain(progress.once(progress.events(spark, f"{d}/events.parquet")).select("event_id", "user_id", "event_type"), f"once_{uuid.uuid4().hex[:8]}", "append")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k, 0 AS part, min(o_orderkey) AS ord FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, 1 AS part, min(o_orderkey) AS ord FROM orders GROUP BY 1), u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY part, ord) AS rn FROM u) SELECT k, part, ord FROM f WHERE rn = 1""")
def first_wins_union(spark, d):
    by = lambda o: o.groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("ord"))
    o = table(spark, d, "orders")
    return relational.union_first([by(o.where("o_orderstatus = 'F'")), by(o)], ["k"], "ord").select("k", "part", "ord")


@query("""SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_acctbal + 1 ELSE o.c_acctbal END AS c_acctbal
FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) n ON o.c_custkey = n.c_custkey""")
def keyed_upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return relational.upsert(c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


@query("""WITH k AS (SELECT md5(text) AS h, min(item_id) AS item_id FROM benchmark GROUP BY 1), p AS (SELECT md5(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g')) AS pre, min(item_id) AS item_id FROM benchmark GROUP BY 1)
SELECT d.doc_id, coalesce(k.item_id, p.item_id) AS known_id FROM documents d LEFT JOIN k ON md5(d.text) = k.h LEFT JOIN p ON md5(regexp_replace(lower(d.text), '[^\\p{L}\\p{N}]', '', 'g')) = p.pre""")
def known_item_lookup(spark, d):
    """By content hash first, else by the hash of letters and numbers only; the least id wins."""
    key = lambda t: t.withColumns({"h": F.md5("text"), "pre": F.md5(text.compact(F.col("text"), False))})
    rows, known = key(table(spark, d, "documents")).select("doc_id", "h", "pre"), key(table(spark, d, "benchmark")).select("item_id", "h", "pre")
    return relational.known_item(rows, known, ["h", "pre"], "item_id").select("doc_id", "known_id")


@query("""WITH p AS (SELECT s.s_suppkey, c.c_custkey, CASE WHEN s.s_nationkey = c.c_nationkey AND s.s_suppkey % 3 = c.c_custkey % 3 THEN 3 WHEN s.s_nationkey = c.c_nationkey THEN 2 ELSE 0 END AS rank FROM supplier s JOIN customer c ON s.s_nationkey = c.c_nationkey),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY rank DESC, s_suppkey) AS rn FROM p WHERE rank > 0) SELECT c_custkey, s_suppkey, rank FROM r WHERE rn <= 3""")
def history_rank_lookup(spark, d):
    """Earlier sources of an item, ranked by how they match it. Beyond the three least of its nation and residue no source can be among an item's three, so those alone are joined."""
    s, c = table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    least = Window.partitionBy("s_nationkey", F.col("s_suppkey") % 3).orderBy("s_suppkey")
    s = s.withColumn("place", F.row_number().over(least)).where("place <= 3")
    rank = classify.rules((F.col("s_suppkey") % 3 == F.col("c_custkey") % 3, 3), otherwise=2)
    p = s.join(c, s["s_nationkey"] == c["c_nationkey"]).select("c_custkey", "s_suppkey", rank.alias("rank"))
    w = Window.partitionBy("c_custkey").orderBy(F.desc("rank"), F.asc_nulls_last("s_suppkey"))
    return p.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("c_custkey", "s_suppkey", "rank")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def orphan_rows(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def related_retryable(spark, d):
    bad = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return table(spark, d, "orders").join(bad, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("""SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer)) AS only_left, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT ALL SELECT o_custkey FROM orders)) AS only_right""")
def set_equality(spark, d):
    return relational.set_equal(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k")))


@query("""SELECT d.doc_id, r.rule FROM documents d, (VALUES ('long_enough'), ('labelled_language'), ('count_right')) r(rule) WHERE (r.rule = 'long_enough' AND NOT n_chars >= 500) OR (r.rule = 'labelled_language' AND NOT lang IN ('en', 'fr', 'de')) OR (r.rule = 'count_right' AND NOT n_chars = length(text))""")
def constraint_violations(spark, d):
    rules = {"long_enough": F.col("n_chars") >= 500, "labelled_language": F.col("lang").isin("en", "fr", "de"), "count_right": F.col("n_chars") == F.char_length("text")}
    return violations(table(spark, d, "documents"), "doc_id", rules)


@query("""WITH x AS (SELECT DISTINCT o_orderkey % 500 AS id, o_custkey % 10 AS grp FROM orders), r AS (SELECT *, dense_rank() OVER (PARTITION BY id ORDER BY grp) AS k FROM x)
SELECT id, grp, CASE WHEN k = 1 THEN id::VARCHAR ELSE substr(sha256(grp::VARCHAR || chr(0) || id::VARCHAR), 1, 16) END AS new_id FROM r""")
def id_collisions(spark, d):
    x = table(spark, d, "orders").select((F.col("o_orderkey") % 500).alias("id"), (F.col("o_custkey") % 10).alias("grp")).distinct()
    return relational.re_key_collisions(x, "id", "grp")


@query("""WITH x AS (SELECT p_partkey, p_brand AS name FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY p_partkey) AS k FROM x) SELECT p_partkey, CASE WHEN k = 1 THEN name ELSE name || ' (' || k::VARCHAR || ')' END AS unique_name FROM r""")
def name_collisions(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("name"))
    return relational.collision_suffix(x, "name", [F.asc("p_partkey")]).select("p_partkey", "unique_name")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN o_orderpriority END AS sec FROM orders)
SELECT o_custkey, o_orderkey, last_value(sec IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS section, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_key FROM s""")
def carry_forward(spark, d):
    """Section labels carry forward; a row sees the next one."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    sec = F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.last(sec, True).over(w).alias("section"), F.lead("o_orderkey").over(w).alias("next_key"))


@query("""SELECT l_suppkey, min(l_orderkey) AS first_seen, max(l_orderkey) AS last_seen, max(l_discount) AS officiality FROM lineitem GROUP BY l_suppkey HAVING max(l_discount) >= 0.05""")
def official_domains(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min("l_orderkey").alias("first_seen"), F.max("l_orderkey").alias("last_seen"), F.max("l_discount").alias("officiality"))
    return g.where("officiality >= 0.05")


@query("""SELECT c.c_custkey, n.n_name, r.r_name, count(o.o_orderkey) AS n_orders, coalesce(sum(l.n), 0)::BIGINT AS n_lines FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey GROUP BY ALL""")
def hierarchy_counts(spark, d):
    """item, source, candidate: counts over the hierarchy, items without any included; lines are counted before they join."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_custkey").agg(F.count("o_orderkey").alias("k"), F.sum("n").alias("m"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", "n_name", "r_name", F.coalesce("k", F.lit(0)).alias("n_orders"), F.coalesce("m", F.lit(0)).alias("n_lines"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS norm2, round(list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt((SELECT list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) FROM embeddings ORDER BY vec_id LIMIT 1)), 4) AS likeness FROM embeddings""")
def cosine_to_first(spark, d) -> DataFrame:
    """The confirming measure of the two-stage visual match, against one reference vector."""
    e = table(spark, d, "embeddings")
    ref = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("r"))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return e.join(F.broadcast(ref), F.lit(True)).select("vec_id", F.round(norm, 4).alias("norm2"), F.round(hashing.cosine(F.col("embedding"), F.col("r")), 4).alias("likeness"))
