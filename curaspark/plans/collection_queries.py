"""Queries of merged collections, retries, budgets, relations and the task catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from curaspark.operators import classify, collection
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


@query("""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS id, min(l_suppkey) AS l_suppkey, min(l_shipdate) AS l_shipdate, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1), s AS (SELECT * FROM c WHERE l_quantity >= 45)
SELECT c.id, arg_min(s.id, s.id) AS inherited FROM c LEFT JOIN s ON c.l_suppkey = s.l_suppkey AND c.l_shipdate = s.l_shipdate AND c.id <> s.id GROUP BY c.id""")
def evidence_inheritance(spark, d):
    """A candidate takes the evidence of the first seed on its page; one step only."""
    named = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")
    c = table(spark, d, "lineitem").groupBy(named).agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_shipdate").alias("l_shipdate"), F.max("l_quantity").alias("l_quantity"))
    return collection.inherit_evidence(c, c.where("l_quantity >= 45"), ["l_suppkey", "l_shipdate"], "id", "id", F.lit(True)).select("id", "inherited")


@query("""WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS price, list_sort(list(DISTINCT o_orderpriority)) AS tags FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_totalprice) AS price, list_sort(list(DISTINCT o_orderpriority)) AS tags FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.price, b.price) AS price, list_sort(list_distinct(list_concat(coalesce(a.tags, []), coalesce(b.tags, [])))) AS tags FROM a FULL JOIN b ON a.k = b.k""")
def merged_collectors(spark, d):
    o = table(spark, d, "orders")
    side = lambda x: x.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("price"), F.array_sort(F.collect_set("o_orderpriority")).alias("tags"))
    return collection.merge_results(side(o.where("o_orderstatus = 'F'")), side(o.where("o_orderstatus <> 'F'")), "k", ["price"], ["tags"]).withColumn("tags", F.array_sort("tags"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def reusable_first(spark, d):
    return collection.prefer_reusable(table(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") == "F", F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("""WITH e AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 <> 0 THEN 'old' || c_custkey END AS asset FROM customer WHERE c_custkey % 3 <> 0), r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 <> 0 THEN 'new' || c_custkey END AS asset FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(e.k, r.k) AS k, CASE WHEN e.k IS NULL OR (e.asset IS NULL AND r.asset IS NOT NULL) THEN r.asset ELSE e.asset END AS asset FROM e FULL JOIN r ON e.k = r.k""")
def retry_merge(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    named = lambda p, n: F.when(F.col("k") % n != 0, F.concat(F.lit(p), F.col("k").cast("string"))).alias("asset")
    return collection.retry_delta(c.where("k % 3 <> 0").select("k", named("old", 4)), c.where("k % 2 = 0").select("k", named("new", 5)), "k", "asset")


@query("""WITH l AS (SELECT DISTINCT n_nationkey AS item, s_suppkey AS work FROM nation JOIN supplier ON n_nationkey = s_nationkey), x AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 100 AS dst FROM lineitem WHERE l_quantity > 49),
n AS (SELECT DISTINCT item, dst AS work FROM l JOIN x ON work = src)
SELECT item, work, false AS related FROM l UNION ALL SELECT item, work, true FROM n WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.item = n.item AND l.work = n.work)""")
def related_works(spark, d):
    items = table(spark, d, "nation").select(F.col("n_nationkey").alias("item"))
    links = table(spark, d, "supplier").select(F.col("s_nationkey").alias("item"), F.col("s_suppkey").alias("work"))
    relations = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst")).distinct()
    return collection.one_hop(items, links, relations)


@query("""WITH w AS (SELECT s_nationkey AS item, s_suppkey AS work, s_acctbal > 8000 AS title_match FROM supplier), x AS (SELECT *, count(*) OVER (PARTITION BY item) AS n, sum(title_match::INT) OVER (PARTITION BY item) AS h FROM w)
SELECT item, work, CASE WHEN n = 1 THEN 'confirmed' WHEN h = 1 AND title_match THEN 'confirmed' WHEN h = 1 THEN 'reference' ELSE 'uncertain' END AS binding FROM x""")
def work_binding(spark, d):
    w = table(spark, d, "supplier").select(F.col("s_nationkey").alias("item"), F.col("s_suppkey").alias("work"), (F.col("s_acctbal") > 8000).alias("title_match"))
    return collection.binding(w).select("item", "work", "binding")


@query("""WITH c AS (SELECT user_id, event_id, event_type || (event_id % 40)::VARCHAR AS request FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY user_id, request ORDER BY event_id) = 1 AS fresh FROM c)
SELECT event_id, NOT fresh OR sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) <= 16 AS allowed FROM f""")
def call_budget(spark, d):
    c = table(spark, d, "events").select("user_id", "event_id", F.concat("event_type", (F.col("event_id") % 40).cast("string")).alias("request"))
    return collection.within_budget(c, "user_id", "event_id", 16).select("event_id", "allowed")


@query("""SELECT user_id, arg_min(event_type, event_id) AS outcome, count(*) AS asked FROM events GROUP BY user_id""")
def sticky_lookups(spark, d):
    return collection.sticky_outcome(table(spark, d, "events").withColumn("outcome", F.col("event_type")), "user_id", "event_id")


@query("""SELECT event_id, extract('epoch' FROM ts - lag(ts) OVER (PARTITION BY user_id ORDER BY event_id))::DOUBLE AS seconds FROM events""")
def event_gaps(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", ((at - F.lag(at).over(w)) / 1e6).alias("seconds"))


@query("""SELECT o_orderkey AS task_id, o_orderstatus = 'O' AS active FROM orders ORDER BY active DESC, o_orderdate DESC, task_id DESC LIMIT 100""")
def task_catalog(spark, d):
    """The first page of the catalogue."""
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), (F.col("o_orderstatus") == "O").alias("active"), F.col("o_orderdate").alias("created_at"))
    return collection.catalog_order(t).limit(100).select("task_id", "active")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN NOT (doc_id % 5 = 0) WHEN doc_id % 7 = 0 THEN true WHEN doc_id % 11 = 0 THEN false WHEN doc_id % 13 = 0 THEN true WHEN doc_id % 17 = 0 THEN true END AS matched,
CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN CASE WHEN doc_id % 5 = 0 THEN 1.0::DOUBLE ELSE 0.98::DOUBLE END WHEN doc_id % 7 = 0 THEN 0.9::DOUBLE WHEN doc_id % 11 = 0 THEN 1.0::DOUBLE WHEN doc_id % 13 = 0 THEN 0.88::DOUBLE WHEN doc_id % 17 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 0.98::DOUBLE ELSE 0.95::DOUBLE END ELSE 0.0::DOUBLE END AS confidence FROM documents""")
def entity_matching(spark, d):
    """Three-valued match with its confidence ladder."""
    i = F.col("doc_id")
    no = F.lit(False)
    none = F.array().cast("array<string>")
    apps = F.when(i % 3 == 0, F.array(F.lit("1"))).otherwise(none)
    own = F.when((i % 2 == 0) & (i % 5 == 0), F.array(F.lit("2"))).when(i % 2 == 0, F.array(F.lit("1"))).otherwise(none)
    m = classify.entity_match(apps, own, i % 7 == 0, i % 11 == 0, i % 13 == 0, no, no, no, i % 17 == 0, i % 2 == 0, F.lit(0.0), no, no)
    return table(spark, d, "documents").select("doc_id", m.alias("m")).select("doc_id", "m.matched", "m.confidence")


@query("""SELECT page_id, regexp_matches(html, '(?i)age[-_ ]?(gate|check|verif)|18歳以上|18岁以上|are you (over )?18') AS gated, regexp_matches(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), 'placeholder|no_image|noimage|no-image|now_printing|nowprinting|dummy|blank|spacer|coming_soon|comingsoon|default_image|defaultimage|loading|transparent|pixel') AS placeholder FROM pages""")
def page_gates(spark, d):
    from curaspark.sources import pages

    return table(spark, d, "pages").select("page_id", pages.age_gated(F.col("html")).alias("gated"), classify.placeholder(F.col("url")).alias("placeholder"))
