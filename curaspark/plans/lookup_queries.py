"""Look-ups with a shared budget: orders name releases and works, parts stand for the database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.operators import lookups
from curaspark.sources.tables import table

BUDGET = 7


def budgeted_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Releases, works and related works of each customer's orders, as far as the customer's budget goes."""
    o, k = table(spark, d, "orders"), F.col("p_partkey")
    v = lambda n: F.concat(F.lit("v"), n.cast("string"))
    r = lambda n: F.concat(F.lit("r"), n.cast("string"))
    wanted = o.select(F.col("o_custkey").alias("item_id"), F.col("o_orderkey").alias("place"), F.when(F.col("o_orderkey") % 2 == 0, r(F.col("o_orderkey") % 41)).otherwise(v(F.col("o_orderkey") % 29)).alias("id"))
    p = table(spark, d, "part").where("p_partkey <= 40")
    none = F.array().cast("array<string>")
    releases = p.where("p_partkey % 5 <> 1").select(r(k).alias("id"), F.when(k % 4 == 0, none).otherwise(F.array(v(k % 17), v(k % 5))).alias("works"))
    relation = lambda n, t: F.struct(v(n).alias("id"), F.lit(t).alias("type"))
    works = p.where("p_partkey <= 27").select(v(k).alias("id"), (k % 3).alias("screenshots"), F.array(relation(k * 3 % 23, "seq"), relation(k + 1, "char")).alias("relations"))
    pages = p.where("p_partkey % 8 = 0").select(r(k).alias("id"), F.array(v(k % 11)).alias("works"))
    return lookups.looked_up(wanted, releases, works, pages, BUDGET)


QUERIES = {"budgeted_lookups": budgeted_lookups}
ORACLE_SQL = {
    "budgeted_lookups": f"""
WITH p AS (SELECT p_partkey AS k FROM part WHERE p_partkey <= 40),
wanted AS (SELECT o_custkey AS item_id, CASE WHEN o_orderkey % 2 = 0 THEN 'r' || o_orderkey % 41 ELSE 'v' || o_orderkey % 29 END AS id, min(o_orderkey) AS place FROM orders GROUP BY ALL),
releases AS (SELECT 'r' || k AS id, CASE WHEN k % 4 = 0 THEN [] ELSE ['v' || k % 17, 'v' || k % 5] END AS works FROM p WHERE k % 5 <> 1),
works AS (SELECT 'v' || k AS id, k % 3 AS shots, [{{'id': 'v' || (k * 3) % 23, 'type': 'seq'}}, {{'id': 'v' || k + 1, 'type': 'char'}}] AS relations FROM p WHERE k <= 27),
pages AS (SELECT 'r' || k AS id, ['v' || k % 11] AS works FROM p WHERE k % 8 = 0),
r0 AS (SELECT w.*, l.works AS named, CASE WHEN len(coalesce(l.works, [])) > 0 THEN 1 ELSE 2 END AS cost FROM wanted w LEFT JOIN releases l USING (id) WHERE w.id LIKE 'r%'),
r1 AS (SELECT *, row_number() OVER o AS n, coalesce(sum(cost) OVER (PARTITION BY item_id ORDER BY place, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM r0 WINDOW o AS (PARTITION BY item_id ORDER BY place, id)),
r2 AS (SELECT r.*, cost = 2 AND spot + 1 < {BUDGET} AS by_page, g.works AS shown FROM r1 r LEFT JOIN pages g USING (id) WHERE spot < {BUDGET}),
spent1 AS (SELECT item_id, least({BUDGET}, max(spot + cost)) AS spent FROM r2 GROUP BY 1),
ids AS (SELECT item_id, id FROM wanted WHERE id LIKE 'v%' UNION SELECT item_id, unnest(CASE WHEN cost = 1 THEN named WHEN by_page THEN coalesce(shown, []) ELSE [] END) FROM r2),
w0 AS (SELECT i.item_id, i.id, coalesce(s.spent, 0) AS before, k.shots, k.relations, CASE WHEN coalesce(k.shots, 0) > 0 THEN 1 ELSE 2 END AS cost FROM ids i LEFT JOIN spent1 s USING (item_id) LEFT JOIN works k USING (id)),
w1 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY id) AS n, before + coalesce(sum(cost) OVER (PARTITION BY item_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM w0),
w2 AS (SELECT *, cost = 2 AND spot + 1 < {BUDGET} AS by_page FROM w1 WHERE spot < {BUDGET}),
spent2 AS (SELECT item_id, least({BUDGET}, max(spot + cost)) AS spent FROM w2 GROUP BY 1),
x0 AS (SELECT item_id, id AS work, unnest(relations, recursive := true) FROM w2),
x1 AS (SELECT item_id, id, work, type FROM x0 WHERE (item_id, id) NOT IN (SELECT (item_id, id) FROM w2) QUALIFY row_number() OVER (PARTITION BY item_id, id ORDER BY work, type) = 1),
x2 AS (SELECT x.*, row_number() OVER (PARTITION BY item_id ORDER BY work, type, id) AS n, s.spent FROM x1 x JOIN spent2 s USING (item_id))
SELECT item_id, 'release' AS stage, n AS place, id, named IS NOT NULL AS found, by_page, NULL::VARCHAR AS relation_of, NULL::VARCHAR AS relation_type FROM r2
UNION ALL SELECT item_id, 'work', n, id, shots IS NOT NULL, by_page, NULL, NULL FROM w2
UNION ALL SELECT item_id, 'relation', n, id, id IN (SELECT id FROM works), false, work, type FROM x2 WHERE spent + n - 1 < {BUDGET}"""
}
