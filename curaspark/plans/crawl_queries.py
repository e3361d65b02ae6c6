"""Crawls over frozen links: of pages, and of orders as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.functions import urls
from curaspark.operators import crawl
from curaspark.plans.binding import URLS
from curaspark.sources.tables import table

# From each nation, over its customers' groups and their orders' groups: both budgets run out.
DEPTH, PAGES, SOURCES = 3, 9, 40


def _links(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    mid, leaf = 100 + F.col("o_custkey") % 50, 1000 + F.col("o_orderkey") % 200
    parts = [c.select(F.col("c_nationkey").cast("long").alias("src"), (100 + F.col("c_custkey") % 7).alias("dst")), o.select(mid.alias("src"), leaf.alias("dst")), o.select(leaf.alias("src"), (100 + F.col("o_orderkey") % 50).alias("dst"))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
    return both.withColumn("ordinal", (F.col("dst") * 37) % 101)


def budgeted_crawl(spark: SparkSession, d: str) -> DataFrame:
    """Three levels from each nation, with a page budget and a cap of sources that end the crawl midway; with the way to each node."""
    roots = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("long").alias("root"))
    found = crawl.crawl(roots, _links(spark, d), DEPTH, PAGES, SOURCES)
    return found.select("root", "place", "node", "level", "parent", F.array_join(F.transform("chain", lambda x: x.cast("string")), ">").alias("chain"))


def followed_links(spark: SparkSession, d: str) -> DataFrame:
    """Which links of a page may be followed, from an entry and from below one."""
    i, u = F.col("page_id"), F.col("url")
    root = F.concat(urls.scheme(u), F.lit("://"), urls.netloc(u))
    target = F.concat(root, F.element_at(F.array(*map(F.lit, TARGETS)), (i % len(TARGETS) + 1).cast("int")))
    page = F.concat(root, F.when(i % 3 == 0, "/").otherwise("/product/one/top.html"))
    label = F.element_at(F.array(*map(F.lit, LABELS)), (i % len(LABELS) + 1).cast("int"))
    names = F.when(i % 2 == 0, F.array(F.lit("Chapter 2: Moon Nights"))).otherwise(F.array().cast("array<string>"))
    entry, inner = crawl.link_policy(page, target, label, names)
    return table(spark, d, "pages").select("page_id", entry.alias("entry"), inner.alias("inner"))


TARGETS = ["/gallery/", "/x.html?p=1", "/x.html?to=/cg", "/product/one/c2.html", "/news/cg.jpg", "/other/", "/story.html#graphic"]
LABELS = ["moon-nights", "CG Gallery", "gallery modal", "Chapter 3", "top"]

_LEVEL = """
s{n} AS (SELECT l.root, e.dst AS node, arg_min({{'src': e.src, 'chain': l.chain, 'opened': l.opened, 'found': l.found}}, l.place * 1000000 + e.ordinal * 10000 + 0) AS x, min(l.place * 1000 + e.ordinal) AS o
  FROM f{p} l JOIN e ON l.node = e.src WHERE l.opened + l.place < {pages} AND NOT EXISTS (SELECT 1 FROM seen{p} z WHERE z.root = l.root AND z.node = e.dst) GROUP BY l.root, e.dst),
t{n} AS (SELECT root, node, x.src AS parent, list_append(x.chain, x.src) AS chain, x.opened AS opened, x.found AS found, ROW_NUMBER() OVER (PARTITION BY root ORDER BY o, node) AS place FROM s{n}),
k{n} AS (SELECT * FROM t{n} WHERE found + place <= {sources}),
f{n} AS (SELECT k.root, k.place, k.node, k.chain, k.opened + w.width AS opened, k.found + m.more AS found FROM k{n} k JOIN (SELECT root, max(place) AS width FROM f{p} GROUP BY root) w USING (root) JOIN (SELECT root, max(place) AS more FROM k{n} GROUP BY root) m USING (root)
  WHERE k.found + m.more < {sources}),
seen{n} AS (SELECT * FROM seen{p} UNION ALL SELECT root, node FROM k{n})"""

QUERIES = {"budgeted_crawl": budgeted_crawl, "followed_links": followed_links}
ORACLE_SQL = {
    "budgeted_crawl": f"""
WITH e0 AS (SELECT DISTINCT c_nationkey::BIGINT AS src, 100 + c_custkey % 7 AS dst FROM customer UNION SELECT DISTINCT 100 + o_custkey % 50, 1000 + o_orderkey % 200 FROM orders UNION SELECT DISTINCT 1000 + o_orderkey % 200, 100 + o_orderkey % 50 FROM orders),
e AS (SELECT src, dst, (dst * 37) % 101 AS ordinal FROM e0),
f0 AS (SELECT n_nationkey::BIGINT AS root, 1::BIGINT AS place, n_nationkey::BIGINT AS node, []::BIGINT[] AS chain, 0::BIGINT AS opened, 0::BIGINT AS found FROM nation WHERE n_regionkey < 3),
seen0 AS (SELECT root, node FROM f0),
{",".join(_LEVEL.format(n=n, p=n - 1, pages=PAGES, sources=SOURCES) for n in (1, 2, 3))}
{" UNION ALL ".join(f"SELECT root, found + place AS place, node, {n} AS level, parent, array_to_string(chain, '>') AS chain FROM k{n}" for n in (1, 2, 3))}""",
    "followed_links": f"""
WITH {URLS},
a AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/' ELSE '/product/one/top.html' END AS page, {TARGETS!r}[page_id % {len(TARGETS)} + 1] AS t, {LABELS!r}[page_id % {len(LABELS)} + 1] AS label, page_id % 2 = 0 AS named FROM uu),
b AS (SELECT *, contains(t, '.jpg') AS media, regexp_matches(t, 'gallery|graphic|/cg|cg/') AS route, contains(t, '?') AS q, label = 'moon-nights' AND named AS portal, contains(lower(label), 'gallery') AND label <> 'gallery modal' AS says FROM a),
c AS (SELECT *, NOT media AND (((NOT q OR route) AND (route OR says)) OR portal OR (label = 'Chapter 3' AND page <> '/' AND starts_with(t, '/product/one/') AND NOT q)) AS inner_ FROM b)
SELECT page_id, inner_ AND (NOT named OR portal OR (regexp_matches(lower(label), 'gallery|cg') AND page <> '/')) AS entry, inner_ AS inner FROM c""",
}
