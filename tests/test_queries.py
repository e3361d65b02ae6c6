import pytest

from curaspark.plans import registry
from tests.conftest import DATA, same_rows


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLE_SQL:
        assert same_rows(got, duck.sql(registry.ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["item_id", "candidate_id", "image_type", "total", "slot"]
    assert set(e.oracle_sql()) <= set(e.queries())


def history_tables(spark, folder, suppliers, customers):
    """The query on the two tables, and its SQL over them."""
    import duckdb

    con = duckdb.connect()
    for name, rows, schema in (("supplier", suppliers, "s_suppkey long, s_nationkey int"), ("customer", customers, "c_custkey long, c_nationkey int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return registry.QUERIES["history_rank_lookup"](spark, str(folder)), con.sql(registry.ORACLE_SQL["history_rank_lookup"]).df()


def joined_rows(plan) -> int:
    """Rows that the joins of an executed plan gave."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return joined_rows(plan.executedPlan())
    if "QueryStage" in name:
        return joined_rows(plan.plan())
    kids = plan.children()
    own = plan.metrics().apply("numOutputRows").value() if "Join" in name else 0
    return own + sum(joined_rows(kids.apply(i)) for i in range(kids.size()))


def test_history_rank_lookup_joins_few_sources(spark, tmp_path):
    """Pairs of a nation do not grow with its sources: three of each residue meet an item."""
    got, want = history_tables(spark, tmp_path, [(i, i % 2) for i in range(400)], [(i, i % 2) for i in range(200)])
    assert same_rows(got.toPandas(), want)
    got.collect()
    assert 600 <= joined_rows(got._jdf.queryExecution().executedPlan()) <= 9 * 200


def test_history_rank_lookup_on_odd_keys(spark, tmp_path):
    """Missing keys (last, as in SQL), repeated and negative ones, nations without items or sources, fewer than three sources."""
    suppliers = [(None, 1), (None, 1), (1, 1), (2, 1), (4, 1), (4, 1), (-1, 1), (-2, 1), (None, 2), (7, 2), (7, 2), (3, 3), (5, None), (6, 9), (None, None)]
    suppliers += [(None, 4), (1, 4), (2, 4), (4, 4)]
    customers = [(0, 1), (1, 1), (1, 1), (1, 2), (2, 2), (2, 1), (-1, 1), (-2, 1), (None, 1), (None, 2), (3, 3), (4, 8), (5, None), (None, None), (6, 4), (8, 4), (None, 4)]
    got, want = history_tables(spark, tmp_path, suppliers, customers)
    assert same_rows(got.toPandas(), want)
