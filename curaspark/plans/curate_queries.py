"""Curation from typed candidates to statuses with reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from curaspark.operators import curate, selection
from curaspark.plans.binding import CANDIDATES, candidates
from curaspark.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}
PHRASES = ["CG 公开", "周年 贺图", "グッズ", "发售", "シーンCG", "", "anniversary goods", "预约 新CG"]
SITES = ["https://a.example/news/1", "https://x.com/a/status/1", "https://store.steampowered.com/app/1", "https://a.example/i.png", "https://blog.example.net/p"]
SITE_PATHS = ["news/1", "brand", "goods"]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _pick(values, by):
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


@query(f"""WITH x AS (SELECT doc_id, lower(coalesce(text, '') || {PHRASES}[doc_id % 8 + 1]) AS s, CASE doc_id % 5 WHEN 0 THEN 'goods' WHEN 1 THEN 'release' ELSE 'update' END AS e, doc_id % 2 = 0 AS need FROM documents),
r AS (SELECT *, regexp_matches(s, '贺图|賀圖|纪念图|紀念圖|应援图|應援圖|倒计时图|倒計時圖|周年|週年|commemorative|celebration|anniversary') AS a, e = 'goods' OR regexp_matches(s, '周边|周邊|商品|グッズ|goods|shop|merchandise') AS g,
 regexp_matches(s, 'cg\\s*(公开|公開|更新|追加|新增)|新\\s*cg|(场景|場景|事件|イベント|シーン)\\s*cg|画面公开|畫面公開|游戏截图公开|遊戲截圖公開|gallery\\s*更新|ギャラリー更新') AS c,
 e = 'release' OR regexp_matches(s, '发售|発売|预约|預約|登陆steam|登录steam|上架steam|steam上线|steam上線') AS l FROM x)
SELECT doc_id, concat_ws(',', CASE WHEN a THEN 'announcement' END, CASE WHEN g THEN 'goods' END, CASE WHEN c THEN 'cg' END, CASE WHEN l THEN 'release' END, CASE WHEN NOT (a OR g OR c OR l) THEN CASE WHEN need THEN 'generic' ELSE 'unknown' END END) AS requirements FROM r""")
def requirement_sets(spark, d):
    i = F.col("doc_id")
    body = F.lower(F.concat(F.coalesce("text", F.lit("")), _pick(PHRASES, i)))
    event = F.when(i % 5 == 0, "goods").when(i % 5 == 1, "release").otherwise("update")
    found = curate.requirements(body, event, F.when(i % 2 == 0, "explicit_new_image").otherwise("unknown"))
    return table(spark, d, "documents").select("doc_id", F.array_join(found, ",").alias("requirements"))


# per candidate: where it stands in each rule, then the score, duplicates and the windows of the allocation
CURATED = CANDIDATES + """,
it AS (SELECT source AS item_id, min(doc_id) % 3 AS r FROM documents GROUP BY source HAVING min(doc_id) % 7 <> 3),
a AS (SELECT c.item_id, candidate_id AS i, c.image_type AS kind, width AS w, height AS h, detail, x_photo AS x, entity_match AS m, localized AS loc, sha256, source_type AS st, r, r IS NOT NULL AS has,
 [0.92::DOUBLE, 0.68::DOUBLE, 0.8::DOUBLE][candidate_id % 3 + 1] AS k, candidate_id % 4 <> 3 AND r IS NOT NULL AS linked, CASE WHEN candidate_id % 7 = 0 THEN 0.75 ELSE 0.9 END AS conf, candidate_id % 6 = 0 AS byimg,
 candidate_id % 29 = 0 AS anim, candidate_id % 31 = 0 AS inv, candidate_id % 37 = 0 AS broken, candidate_id % 2 = 0 AS locauto, ['news','brand','store'][candidate_id % 3 + 1] AS part
 FROM cand c LEFT JOIN it ON c.item_id = it.item_id),
b AS (SELECT *, CASE WHEN has OR loc THEN kind ELSE 'unknown' END AS t, CASE WHEN has OR loc THEN k ELSE 0 END AS tc, w >= 300 AND h >= 300 AND w * h >= 120000 AS fine, x AND linked AS pr,
 NOT coalesce(r = 0 AND kind = 'character_art', false) AS acc,
 CASE st WHEN 'official_x' THEN 0.88::DOUBLE WHEN 'steam' THEN 0.82::DOUBLE WHEN 'official_site' THEN CASE part WHEN 'news' THEN 0.98::DOUBLE WHEN 'brand' THEN 0.9::DOUBLE ELSE 0.86::DOUBLE END WHEN 'direct_image' THEN CASE WHEN i % 2 = 0 THEN 0.9::DOUBLE ELSE 0.3::DOUBLE END ELSE 0.1::DOUBLE END AS off,
 st IN ('official_x','steam','official_site') OR st = 'direct_image' AND i % 2 = 0 AS isoff, st = 'official_site' AND part <> 'news' AS strict FROM a),
e AS (SELECT *, has AND t <> 'unknown' AND tc >= 0.8 AS typed, has AND m IS NULL AS op, has AND coalesce(NOT m, false) AS clash, has AND coalesce(m, false) AND (NOT isoff AND conf < 0.8 OR strict AND byimg) AS weak FROM b),
f AS (SELECT *, clash AND NOT pr AND NOT loc AS gone, NOT acc AND NOT pr AND NOT loc AS refused FROM e),
g AS (SELECT *, NOT gone AND NOT refused AS kept, CASE WHEN loc THEN locauto AND NOT inv ELSE (pr OR typed AND fine) AND linked AND NOT anim AND NOT inv AND NOT broken AND (pr OR NOT op AND NOT weak) AND NOT gone AND NOT refused END AS auto,
 NOT loc AND has AND acc AND r = 0 AND t = 'key_visual' AND NOT pr AS fb,
 CASE WHEN loc THEN CASE WHEN locauto AND NOT inv THEN 1.0 ELSE 0.5 END WHEN NOT has THEN 0.1 WHEN NOT acc THEN 0.0
  WHEN r = 0 THEN CASE t WHEN 'game_cg' THEN 1.0 WHEN 'gameplay_screenshot' THEN 0.8 WHEN 'key_visual' THEN 0.4 ELSE 0.1 END
  WHEN r = 1 THEN CASE t WHEN 'game_cg' THEN 1.0 WHEN 'gameplay_screenshot' THEN 0.85 WHEN 'key_visual' THEN 0.65 WHEN 'unknown' THEN 0.1 ELSE 0.25 END
  ELSE CASE t WHEN 'game_cg' THEN 0.9 WHEN 'gameplay_screenshot' THEN 0.8 WHEN 'key_visual' THEN 0.6 WHEN 'unknown' THEN 0.1 ELSE 0.25 END END::DOUBLE AS tm,
 CASE WHEN loc THEN [] ELSE list_filter([CASE WHEN NOT typed AND NOT inv THEN CASE WHEN tc < 0.8 THEN 'type_evidence_insufficient' ELSE 'automatic_type_selection_disabled' END END, CASE WHEN pr THEN 'socialdata_x_photo_priority' END, CASE WHEN NOT linked THEN 'source_not_linked_to_news' END,
  CASE WHEN anim THEN 'animated_source_requires_review' END, CASE WHEN NOT fine THEN 'below_minimum_resolution' END, CASE WHEN inv THEN 'invalid:corrupt' END, CASE WHEN broken THEN 'review_image_conversion_failed' END, CASE WHEN clash AND pr THEN 'socialdata_x_photo_source_overrides_entity_classifier' END,
  CASE WHEN gone THEN 'entity_conflict' END, CASE WHEN op THEN 'entity_unverified' END, CASE WHEN refused AND NOT gone THEN 'image_type_rejected:' || t END], lambda z: z IS NOT NULL) END AS why FROM f),
s AS (SELECT *, CASE WHEN has THEN round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100 * (0.5::DOUBLE * (0.55::DOUBLE * 0.6::DOUBLE + 0.45::DOUBLE * CASE WHEN fb THEN greatest(0.0::DOUBLE, tm - 0.25::DOUBLE) ELSE tm END) + 0.2::DOUBLE * CASE WHEN loc THEN 0.85::DOUBLE ELSE off END
  + 0.3::DOUBLE * (0.7::DOUBLE * least(1.0::DOUBLE, w / 1280.0::DOUBLE, h / 720.0::DOUBLE) + 0.3::DOUBLE * detail)))) + 1e-9::DOUBLE, 6) END AS total, CASE WHEN loc THEN 0.85::DOUBLE ELSE off END AS trust FROM g),
u AS (SELECT *, first_value(i) OVER (PARTITION BY item_id, sha256, kept, auto ORDER BY x DESC, coalesce(m, false) DESC, detail DESC, least(w, 1280) * least(h, 720) DESC, total DESC NULLS LAST, i) AS la,
 first_value(i) OVER (PARTITION BY item_id, sha256, kept ORDER BY x DESC, auto DESC, coalesce(m, false) DESC, detail DESC, least(w, 1280) * least(h, 720) DESC, total DESC NULLS LAST, i) AS lk FROM s),
v AS (SELECT *, CASE WHEN kept THEN nullif(CASE WHEN auto THEN la ELSE lk END, i) END AS dup FROM u),
p AS (SELECT *, CASE WHEN x OR loc AND t = 'gameplay_screenshot' THEN 20 ELSE CASE t WHEN 'game_cg' THEN 20 WHEN 'gameplay_screenshot' THEN 10 WHEN 'key_visual' THEN 1 WHEN 'character_art' THEN 4 ELSE 0 END END AS lim FROM v),
q AS (SELECT *, auto AND dup IS NULL AND lim > 0 AS may FROM p),
q2 AS (SELECT *, may AND (NOT fb OR NOT bool_or(may AND NOT fb) OVER (PARTITION BY item_id)) AS play FROM q),
q3 AS (SELECT *, play AND (x OR row_number() OVER (PARTITION BY item_id, t, play ORDER BY x DESC, loc DESC, total DESC NULLS LAST, trust DESC, w::BIGINT * h DESC, i) <= lim) AS within_ FROM q2),
q4 AS (SELECT *, within_ AND row_number() OVER (PARTITION BY item_id, within_ ORDER BY x DESC, loc DESC, total DESC NULLS LAST, trust DESC, w::BIGINT * h DESC, i) <= 20 AS sel FROM q3),
q5 AS (SELECT *, sum(sel::INT) OVER (PARTITION BY item_id) >= 20 AS filled FROM q4)
SELECT item_id, i AS candidate_id, CASE WHEN inv THEN 'invalid' WHEN NOT kept THEN 'filtered' WHEN sel THEN 'selected' ELSE 'unselected' END AS status, total, dup AS duplicate_of,
array_to_string(CASE WHEN inv THEN why WHEN dup IS NOT NULL THEN list_append(why, 'duplicate_of_better_candidate') WHEN sel THEN list_append(why, 'selected_by_rank_and_policy') WHEN len(why) = 0 THEN list_append(why, CASE WHEN filled THEN 'news_selection_limit' ELSE 'type_limit_or_minimum_score' END) ELSE why END, ',') AS reasons FROM q5"""


@query(f"WITH {CURATED}")
def curated(spark, d):
    i = F.col("candidate_id")
    site = F.when(i % 5 == 0, F.concat(F.lit("https://a.example/"), _pick(SITE_PATHS, i))).otherwise(_pick(SITES, i))
    c = candidates(spark, d).withColumns({
        "type_confidence": F.when(i % 3 == 0, 0.92).when(i % 3 == 1, 0.68).otherwise(0.8), "source_linked": i % 4 != 3, "match": F.col("entity_match"), "confidence": F.when(i % 7 == 0, 0.75).otherwise(0.9),
        "why": F.array(F.when(i % 6 == 0, "image_linked_from_news_source").otherwise("entity_name_in_context")), "source_url": site, "image_url": site, "page_official": i % 2 == 0, "animated": i % 29 == 0,
        "invalid_reason": F.when(i % 31 == 0, "corrupt"), "conversion_error": F.when(i % 37 == 0, "mode"), "localization_auto": i % 2 == 0, "base_relevance": F.lit(0.6),
    })
    first = F.min("doc_id")
    wanted = F.when(F.col("n") % 3 == 0, F.array(F.lit("cg"))).when(F.col("n") % 3 == 1, F.array(F.lit("goods"), F.lit("release"))).otherwise(F.array(F.lit("generic")))
    items = table(spark, d, "documents").groupBy(F.col("source").alias("item_id")).agg(first.alias("n")).where("n % 7 <> 3").select("item_id", wanted.alias("requirements"))
    return curate.curate(c, items).select("item_id", "candidate_id", "status", "total", "duplicate_of", F.array_join("reasons", ",").alias("reasons"))
