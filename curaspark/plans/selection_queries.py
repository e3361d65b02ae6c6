"""Scoring, ranking, dedup, allocation, review and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curaspark.functions import hashing
from curaspark.operators import classify, evaluate, relational, selection
from curaspark.plans.binding import ALLOCATED, CANDIDATES, SCORED, candidates, scored
from curaspark.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {SCORED},
dd AS (SELECT *, first_value(candidate_id) OVER (PARTITION BY item_id, sha256 ORDER BY x_photo DESC, auto_select DESC, coalesce(entity_match, false) DESC, detail DESC, least(width, 1280) * least(height, 720) DESC, total DESC, candidate_id) AS lead FROM scored),
un AS (SELECT * FROM dd WHERE lead = candidate_id),
{ALLOCATED.split("lim AS (", 1)[1].join(["lim AS (", ""]).replace("FROM scored)", "FROM un)", 1)}
SELECT item_id, candidate_id, image_type, total, slot FROM alloc WHERE selected""")
def capped_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: score, exact dedup within the item, type limits, then the item's cap."""
    unique = selection.exact_duplicates(scored(spark, d)).where("duplicate_of is null")
    return selection.allocate(unique).where("selected").select("item_id", "candidate_id", "image_type", "total", "slot")


@query(f"WITH {SCORED} SELECT candidate_id, round(relevance + 1e-9::DOUBLE, 6) AS relevance, trust, round(quality_score + 1e-9::DOUBLE, 6) AS quality_score, total FROM scored")
def score_candidates(spark, d):
    return scored(spark, d).select("candidate_id", F.round(F.col("relevance") + 1e-9, 6).alias("relevance"), "trust", F.round(F.col("quality") + 1e-9, 6).alias("quality_score"), "total")


@query(f"WITH {SCORED} SELECT item_id, candidate_id, row_number() OVER (PARTITION BY item_id ORDER BY total DESC, trust DESC, detail DESC, width::BIGINT * height DESC, candidate_id) AS rank FROM scored")
def rank_candidates(spark, d):
    return selection.rank(scored(spark, d)).select("item_id", "candidate_id", "rank")


@query(f"""WITH {SCORED} SELECT candidate_id, nullif(first_value(candidate_id) OVER (PARTITION BY item_id, sha256 ORDER BY x_photo DESC, auto_select DESC, coalesce(entity_match, false) DESC, detail DESC, least(width, 1280) * least(height, 720) DESC, total DESC, candidate_id), candidate_id) AS duplicate_of FROM scored""")
def exact_hash_dedup(spark, d):
    return selection.exact_duplicates(scored(spark, d)).select("candidate_id", "duplicate_of")


@query(f"WITH {ALLOCATED} SELECT item_id, image_type, count(*) AS n, count_if(selected) AS n_selected, max(CASE WHEN selected THEN slot END) AS last_slot FROM alloc GROUP BY ALL")
def allocation_counts(spark, d):
    a = selection.allocate(scored(spark, d))
    return a.groupBy("item_id", "image_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("selected").alias("n_selected"), F.max(F.when(F.col("selected"), F.col("slot"))).alias("last_slot"))


@query("""WITH n AS (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
SELECT CAST(sum(greatest(0, 5 - coalesce(n, 0))) AS BIGINT) AS shortfall FROM nation LEFT JOIN n ON n_nationkey = s_nationkey""")
def selection_shortfall(spark, d):
    items = table(spark, d, "nation").select(F.col("n_nationkey").alias("item_id"))
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("item_id"), (F.col("s_acctbal") > 5000).alias("selected"))
    return selection.shortfall(items, rows)


HASHES = """e AS (SELECT vec_id, label, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, label, list_concat([-embedding[1]], embedding[2:64]) FROM embeddings WHERE vec_id % 5 = 0),
h AS (SELECT vec_id, label, embedding, list_sum(embedding::DOUBLE[]) / len(embedding) AS m FROM e),
b AS (SELECT vec_id, label, list_reduce(list_prepend(0::BIGINT, list_transform(embedding[1:32], lambda x: CASE WHEN x::DOUBLE >= m THEN 1::BIGINT ELSE 0::BIGINT END)), lambda a, x: a * 2 + x) AS lo,
  list_reduce(list_prepend(0::BIGINT, list_transform(embedding[33:64], lambda x: CASE WHEN x::DOUBLE >= m THEN 1::BIGINT ELSE 0::BIGINT END)), lambda a, x: a * 2 + x) AS hi FROM h)"""


def _hashes(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    turned = F.concat(F.array(-F.col("embedding")[0]), F.slice("embedding", 2, 63))
    e = e.unionByName(e.where("vec_id % 5 = 0").select((F.col("vec_id") + 1_000_000).alias("vec_id"), "label", turned.alias("embedding")))  # near copies
    return e.select("vec_id", "label", hashing.mean_bits(F.col("embedding"), 0, 32).alias("lo"), hashing.mean_bits(F.col("embedding"), 32, 32).alias("hi"))


@query(f"WITH {HASHES} SELECT vec_id, lo, hi FROM b")
def perceptual_hash(spark, d):
    return _hashes(spark, d).select("vec_id", "lo", "hi")


@query(f"""WITH RECURSIVE {HASHES},
g AS (SELECT label, lo, hi, min(vec_id) AS vec_id FROM b GROUP BY ALL),
o AS (SELECT label, list({{'v': vec_id, 'lo': lo, 'hi': hi}} ORDER BY vec_id) AS xs FROM g GROUP BY label),
r AS (SELECT label, list_reduce(list_prepend([xs[1]], list_transform(xs, lambda x: [x])), lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: bit_count(xor(a.lo, x[1].lo)) + bit_count(xor(a.hi, x[1].hi)) <= 8)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM o)
SELECT label, unnest(list_transform(kept, lambda a: a.v)) AS vec_id FROM r""")
def leader_dedup(spark, d):
    return selection.leaders(_hashes(spark, d), "label", "vec_id", "vec_id", ["lo", "hi"], 8).select("label", "vec_id")


@query(f"""WITH {HASHES} SELECT x.label AS label, x.vec_id AS a, y.vec_id AS b, CAST(bit_count(xor(x.lo, y.lo)) + bit_count(xor(x.hi, y.hi)) AS INTEGER) AS distance
FROM b x JOIN b y ON x.label = y.label AND x.vec_id < y.vec_id WHERE bit_count(xor(x.lo, y.lo)) + bit_count(xor(x.hi, y.hi)) <= 8""")
def hamming_pairs(spark, d):
    half = lambda c: F.lpad(F.hex(c), 8, "0")
    rows = _hashes(spark, d).select("vec_id", "label", F.lower(F.concat(half("lo"), half("hi"))).alias("hex"))
    return relational.hamming_join(rows, "label", "vec_id", "hex", 8)


@query(f"""WITH {SCORED} SELECT item_id, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY total DESC, candidate_id) AS turn FROM scored) ORDER BY turn, item_id LIMIT 60""")
def round_robin_sample(spark, d):
    return selection.round_robin(scored(spark, d), "item_id", [F.desc("total"), F.asc("candidate_id")], 60).select("item_id", "candidate_id")


@query(f"""WITH {SCORED} SELECT item_id, candidate_id, lpad(CAST(row_number() OVER (PARTITION BY item_id ORDER BY total DESC, candidate_id) AS VARCHAR), greatest(2, 2), '0') AS number FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY total DESC, candidate_id) AS r FROM scored) WHERE r <= 40""")
def export_numbers(spark, d):
    order = [F.desc("total"), F.asc("candidate_id")]
    top = selection.top_per_group(scored(spark, d), "item_id", order, 40)
    return selection.number_names(top, "item_id", order).select("item_id", "candidate_id", "number")


LABELS = "CASE WHEN quality IS NULL THEN NULL WHEN toxic = 1 THEN 'D' WHEN quality = 1 AND candidate_id % 2 = 0 THEN 'A' WHEN quality = 1 THEN 'B' ELSE 'C' END"
METRICS = """count(*) AS n_rows, count_if(label IS NULL) AS unlabeled,
round(count_if(selected AND label = 'A') / nullif(count_if(selected AND label IS NOT NULL), 0)::DOUBLE, 6) AS a_precision,
round(count_if(selected AND label IN ('C','D')) / nullif(count_if(selected AND label IS NOT NULL), 0)::DOUBLE, 6) AS bad_rate,
round(count_if(selected AND label IN ('A','B')) / nullif(count_if(label IN ('A','B')), 0)::DOUBLE, 6) AS retention"""


def _labelled(spark, d):
    label = classify.rules((F.col("label_quality").isNull(), F.lit(None).cast("string")), (F.col("toxic") == 1, "D"), ((F.col("label_quality") == 1) & (F.col("candidate_id") % 2 == 0), "A"), (F.col("label_quality") == 1, "B"), otherwise="C")
    return selection.allocate(scored(spark, d)).withColumn("label", label)


@query(f"""WITH {ALLOCATED}, e AS (SELECT item_id, selected, {LABELS} AS label FROM alloc),
m AS (SELECT count(DISTINCT item_id) AS n_items, {METRICS} FROM e)
SELECT *, CASE WHEN n_rows < 300 OR n_items < 30 OR unlabeled > 0 THEN 'insufficient_annotations' WHEN a_precision >= 0.95 AND bad_rate <= 0.02 AND retention >= 0.99 THEN 'passed' ELSE 'failed' END AS status FROM m""")
def acceptance_report(spark, d):
    return evaluate.report(_labelled(spark, d))


@query(f"WITH {ALLOCATED}, e AS (SELECT item_id, selected, {LABELS} AS label FROM alloc) SELECT item_id, {METRICS} FROM e GROUP BY item_id")
def acceptance_by_item(spark, d):
    return evaluate.per_item(_labelled(spark, d))


@query(f"""WITH {ALLOCATED}, s AS (SELECT CASE WHEN NOT auto_select AND width < 300 THEN 'invalid' WHEN selected THEN 'selected' ELSE 'unselected' END AS st, candidate_id % 3 = 0 AS dl FROM alloc)
SELECT count(*) AS candidates, count_if(st = 'selected') AS selected, count_if(st = 'unselected') AS unselected, count_if(st = 'invalid') AS invalid, count_if(dl) AS downloaded FROM s""")
def state_counts(spark, d):
    a = selection.allocate(scored(spark, d))
    status = classify.rules((~F.col("auto_select") & (F.col("width") < 300), "invalid"), (F.col("selected"), "selected"), otherwise="unselected")
    return evaluate.state_counts(a.select(status.alias("curation_status"), F.when(F.col("candidate_id") % 3 == 0, "downloaded").otherwise("pending").alias("download_status")))


@query(f"""WITH {CANDIDATES}, g AS (SELECT item_id || '/' || image_type AS group_id, auto_select AS selected, CASE candidate_id % 7 WHEN 0 THEN 'best' WHEN 1 THEN 'blurry' ELSE 'ok' END AS clarity FROM cand),
x AS (SELECT group_id, bool_or(clarity = 'best') AS has, bool_or(selected AND clarity = 'best') AND NOT bool_or(selected AND clarity = 'blurry') AS ok FROM g GROUP BY 1)
SELECT round(count_if(has AND ok) / nullif(count_if(has), 0)::DOUBLE, 6) AS accuracy, count_if(has) AS n_groups FROM x""")
def clarity_group_accuracy(spark, d):
    c = candidates(spark, d)
    clarity = classify.rules((F.col("candidate_id") % 7 == 0, "best"), (F.col("candidate_id") % 7 == 1, "blurry"), otherwise="ok")
    return evaluate.group_accuracy(c.select(F.concat_ws("/", "item_id", "image_type").alias("group_id"), F.col("auto_select").alias("selected"), clarity.alias("clarity")))


@query("""WITH e AS (SELECT doc_id FROM labels WHERE quality = 1), s AS (SELECT doc_id FROM documents WHERE n_chars > 1000),
b AS (SELECT e.doc_id AS e, s.doc_id AS s FROM e FULL JOIN s ON e.doc_id = s.doc_id)
SELECT round(count_if(e IS NOT NULL AND s IS NOT NULL) / count(e)::DOUBLE, 6) AS recall, round((count(s) - count_if(e IS NOT NULL AND s IS NOT NULL)) / count(s)::DOUBLE, 6) AS error FROM b""")
def recall_and_error(spark, d):
    return evaluate.recall_error(table(spark, d, "labels").where("quality = 1"), table(spark, d, "documents").where("n_chars > 1000"), ["doc_id"])


@query(f"""WITH {ALLOCATED}, o AS (SELECT candidate_id, selected FROM alloc WHERE candidate_id % 10 <> 0), n AS (SELECT candidate_id, selected AND total > 70 AS selected FROM alloc WHERE candidate_id % 10 <> 1)
SELECT coalesce(o.candidate_id, n.candidate_id) AS candidate_id, o.selected AS selected_old, n.selected AS selected_new,
CASE WHEN o.candidate_id IS NULL THEN 'added' WHEN n.candidate_id IS NULL THEN 'removed' WHEN o.selected IS NOT DISTINCT FROM n.selected THEN 'same' ELSE 'changed' END AS status
FROM o FULL JOIN n ON o.candidate_id = n.candidate_id""")
def before_after_diff(spark, d):
    a = selection.allocate(scored(spark, d))
    old = a.where("candidate_id % 10 <> 0").select("candidate_id", "selected")
    new = a.where("candidate_id % 10 <> 1").select("candidate_id", (F.col("selected") & (F.col("total") > 70)).alias("selected"))
    return relational.compare_runs(old, new, "candidate_id", ["selected"])


@query(f"""WITH {SCORED} SELECT candidate_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'accepted' WHEN auto_select AND total >= 60 THEN 'accepted' ELSE 'pending' END AS decision FROM scored""")
def review_decisions(spark, d):
    """Saved decisions win over the initial ones."""
    saved = classify.rules((F.col("toxic") == 1, "rejected"), (F.col("label_quality") == 1, "accepted"))
    initial = classify.rules((F.col("auto_select") & (F.col("total") >= 60), "accepted"), otherwise="pending")
    return scored(spark, d).select("candidate_id", F.coalesce(saved, initial).alias("decision"))


@query(f"""WITH {CANDIDATES}, acc AS (SELECT DISTINCT item_id, sha256 FROM cand WHERE auto_select AND candidate_id % 2 = 0)
SELECT c.candidate_id FROM cand c WHERE NOT (c.auto_select AND c.candidate_id % 2 = 0) AND greatest(width, height) >= 800 AND least(width, height) >= 600
AND NOT EXISTS (SELECT 1 FROM acc a WHERE a.item_id = c.item_id AND a.sha256 = c.sha256)""")
def visible_pending(spark, d):
    """Pending candidates that are large enough and not the same scene as an accepted one."""
    c = candidates(spark, d)
    accepted = F.col("auto_select") & (F.col("candidate_id") % 2 == 0)
    pending = c.where(~accepted & ~classify.low_resolution(F.col("width"), F.col("height")))
    return pending.join(c.where(accepted).select("item_id", "sha256"), ["item_id", "sha256"], "left_anti").select("candidate_id")


@query(f"""WITH {SCORED} SELECT candidate_id, list_sort(list_filter([CASE WHEN image_type = 'game_cg' THEN 'cg' END, CASE WHEN x_photo THEN 'x' END, CASE WHEN NOT auto_select THEN 'invalid' END, CASE WHEN fallback_only THEN 'fallback' END], lambda x: x IS NOT NULL)) AS badges FROM scored""")
def review_badges(spark, d):
    b = F.array(F.when(F.col("image_type") == "game_cg", "cg"), F.when(F.col("x_photo"), "x"), F.when(~F.col("auto_select"), "invalid"), F.when(F.col("fallback_only"), "fallback"))
    return scored(spark, d).select("candidate_id", F.array_sort(F.array_compact(b)).alias("badges"))


@query(f"""WITH {ALLOCATED}, st AS (SELECT item_id, bool_or(selected) AS sel, bool_or(quality = 0) AS failed, count(*) AS n FROM alloc GROUP BY 1)
SELECT item_id, CASE WHEN sel THEN 'selected' WHEN coalesce(failed, false) THEN 'failed' WHEN n = 0 THEN 'no_candidate' ELSE 'not_selected' END AS status FROM st""")
def item_status(spark, d):
    a = selection.allocate(scored(spark, d)).groupBy("item_id").agg(F.bool_or("selected").alias("sel"), F.bool_or(F.col("label_quality") == 0).alias("failed"), F.count(F.lit(1)).alias("n"))
    return a.select("item_id", classify.rules((F.col("sel"), "selected"), (F.coalesce("failed", F.lit(False)), "failed"), (F.col("n") == 0, "no_candidate"), otherwise="not_selected").alias("status"))


@query(f"""WITH {CANDIDATES}, d AS (SELECT candidate_id, CASE image_type WHEN 'game_cg' THEN [['cg'],['goods','release']][candidate_id % 2 + 1] WHEN 'key_visual' THEN ['cg'] ELSE ['announcement'] END AS req, image_type, CASE candidate_id % 3 WHEN 0 THEN 0.92::DOUBLE WHEN 1 THEN 0.68::DOUBLE ELSE 0.8::DOUBLE END AS conf FROM cand)
SELECT candidate_id, NOT CASE WHEN image_type = 'character_art' AND list_contains(req, 'cg') THEN true WHEN req = ['goods'] AND image_type IN ('game_cg','gameplay_screenshot','key_visual','character_art') THEN true ELSE false END AS accepted,
image_type = 'key_visual' AND list_contains(req, 'cg') AS fallback_only, image_type = 'unknown' OR conf < 0.8 AS requires_review, NOT (image_type = 'unknown' OR conf < 0.8) AS auto_select,
CASE WHEN image_type = 'game_cg' THEN 1.0::DOUBLE WHEN image_type = 'key_visual' THEN 0.4::DOUBLE WHEN image_type = 'gameplay_screenshot' THEN 0.25::DOUBLE WHEN image_type = 'unknown' THEN 0.1::DOUBLE ELSE 0.25::DOUBLE END AS type_match FROM d""")
def requirement_decision(spark, d):
    arr = lambda *x: F.array(*map(F.lit, x))
    req = classify.rules(((F.col("image_type") == "game_cg") & (F.col("candidate_id") % 2 == 0), arr("cg")), (F.col("image_type") == "game_cg", arr("goods", "release")), (F.col("image_type") == "key_visual", arr("cg")), otherwise=arr("announcement"))
    conf = classify.rules((F.col("candidate_id") % 3 == 0, 0.92), (F.col("candidate_id") % 3 == 1, 0.68), otherwise=0.8)
    return candidates(spark, d).select("candidate_id", classify.decision(req, F.col("image_type"), conf).alias("x")).select("candidate_id", "x.*")


@query(f"""WITH {CANDIDATES} SELECT candidate_id,
CASE WHEN candidate_id % 5 = 0 THEN 'unknown' WHEN candidate_id % 19 = 0 OR candidate_id % 23 = 0 THEN 'unknown' WHEN g THEN CASE WHEN r THEN 'game_cg' ELSE 'gameplay_screenshot' END WHEN cf THEN CASE WHEN r THEN 'game_cg' ELSE 'gameplay_screenshot' END ELSE 'unknown' END AS image_type,
CASE WHEN candidate_id % 5 = 0 OR candidate_id % 19 = 0 OR candidate_id % 23 = 0 THEN 0.0::DOUBLE WHEN g THEN CASE WHEN r THEN 0.92::DOUBLE ELSE 0.90::DOUBLE END WHEN cf THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
CASE WHEN candidate_id % 5 = 0 OR candidate_id % 19 = 0 OR candidate_id % 23 = 0 OR NOT g THEN 0 WHEN r THEN 100 ELSE 90 END AS priority
FROM (SELECT *, candidate_id % 7 = 0 AS r, candidate_id % 3 <> 0 AS cf, candidate_id % 3 <> 0 AND candidate_id % 4 <> 0 AND width >= 800 AND height >= 450 AND width * height >= 360000 AS g FROM cand)""")
def localization_policy(spark, d):
    i, no, yes = F.col("candidate_id"), F.lit(False), F.lit(True)
    x = classify.localization(F.when(i % 5 == 0, "x").otherwise("h"), F.when(i % 7 == 0, "event_cg").when(i % 19 == 0, "logo").otherwise("screenshot"), (i % 23 == 0) | (i % 19 == 0), i % 3 != 0, i % 4 != 0, yes, yes, yes, F.col("width"), F.col("height"), no)
    return candidates(spark, d).select("candidate_id", x.alias("x")).select("candidate_id", "x.image_type", "x.confidence", "x.priority")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
SELECT o_custkey, o_orderkey FROM o WHERE rn <= 3""")
def budget_per_source(spark, d):
    """The first of each source's candidates, up to its budget."""
    return selection.top_per_group(table(spark, d, "orders"), "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS ord FROM conversations),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY conv_id, turn) AS k FROM conversations) WHERE k = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn) AS rn FROM f)
SELECT role, conv_id, turn, rn, substr(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), 1, 300) AS line FROM t WHERE rn <= 20""")
def digest_top20(spark, d):
    """Timeline: first of equal posts, then the newest twenty of each source as one-line snippets."""
    from curaspark.functions import text

    posts = relational.first_wins(table(spark, d, "conversations").withColumn("k", F.md5("text")), ["k"], [F.asc("conv_id"), F.asc("turn")])
    top = selection.top_per_group(posts, "role", [F.desc("conv_id"), F.asc("turn")], 20)
    return top.select("role", "conv_id", "turn", "rn", text.snippet(F.col("text")).alias("line"))


@query("SELECT conv_id, turn, role FROM conversations ORDER BY conv_id DESC, turn LIMIT 50")
def newest_50(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role").orderBy(F.desc("conv_id"), "turn").limit(50)


@query("""WITH v AS (SELECT *, CASE WHEN l_quantity > 45 THEN 'too_long' WHEN l_extendedprice > 80000 THEN 'too_large' WHEN l_discount > 0.08 THEN 'too_high' END AS bad FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, bad IS NULL ORDER BY l_linenumber) AS k FROM v)
SELECT l_orderkey, l_linenumber, coalesce(bad, CASE WHEN k > 3 THEN 'over_limit' END) AS reason FROM r""")
def video_limits(spark, d):
    """The first limit that a video breaks; then a cap on those accepted per item, not on those seen."""
    bad = classify.rules((F.col("l_quantity") > 45, "too_long"), (F.col("l_extendedprice") > 80000, "too_large"), (F.col("l_discount") > 0.08, "too_high"))
    v = table(spark, d, "lineitem").withColumn("bad", bad)
    k = F.row_number().over(Window.partitionBy("l_orderkey", F.col("bad").isNull()).orderBy("l_linenumber"))
    return v.withColumn("k", k).select("l_orderkey", "l_linenumber", F.coalesce("bad", F.when(F.col("k") > 3, "over_limit")).alias("reason"))
