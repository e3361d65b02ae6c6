import os

import pytest
from pyspark.sql import functions as F

from curaspark.sinks import delivery


def rows(spark, n, parts=3):
    return spark.range(0, n, 1, parts).select("id", F.when(F.col("id") % 3 == 0, "image").otherwise("video").alias("kind"), F.array(F.struct(F.lit("u").alias("url"))).alias("sources"))


def test_a_delivery_replaces_the_one_before(spark, tmp_path):
    path = str(tmp_path / "out")
    first = delivery.deliver(rows(spark, 10), path, "id", "kind")
    assert (first["rows"], first["counts"], sum(p["rows"] for p in first["parts"])) == (10, {"image": 4, "video": 6}, 10)
    delivery.deliver(rows(spark, 4), path, "id", "kind")
    got = delivery.delivered(spark, path)
    assert got.schema == rows(spark, 1).schema and sorted(r["id"] for r in got.collect()) == [0, 1, 2, 3]
    assert got.first()["sources"][0]["url"] == "u" and delivery.delivered(spark, path, failures=True).count() == 0


def test_a_failed_task_leaves_the_delivery_before_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    before = delivery.deliver(rows(spark, 10), path, "id")
    broken = rows(spark, 10).withColumn("kind", F.when(F.col("id") == 9, F.raise_error(F.lit("no"))).otherwise(F.col("kind")))
    with pytest.raises(Exception):
        broken.write.format("curaspark_delivery").mode("append").option("path", path).save()
    assert delivery.manifest(path) == before and delivery.delivered(spark, path).count() == 10
    assert [n for n in os.listdir(path) if n.startswith("v-")] == [f"v-{before['version']}"]


def test_a_broken_invariant_leaves_the_delivery_before_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    before = delivery.deliver(rows(spark, 5), path, "id")
    for bad in (rows(spark, 5).unionByName(rows(spark, 1)), rows(spark, 5).withColumn("id", F.when(F.col("id") > 0, F.col("id")))):
        with pytest.raises(ValueError):
            delivery.deliver(bad, path, "id")
    with pytest.raises(Exception, match="were expected"):
        rows(spark, 5).write.format("curaspark_delivery").mode("append").option("path", path).option("expected", 6).save()
    assert delivery.manifest(path) == before and [n for n in os.listdir(path) if n.startswith("v-")] == [f"v-{before['version']}"]


def test_damaged_parts_are_failures_if_asked_for(spark, tmp_path):
    path = str(tmp_path / "out")
    made = delivery.deliver(rows(spark, 9), path, "id")
    one, two = made["parts"][0]["file"], made["parts"][1]["file"]
    os.remove(f"{path}/{one}")
    with open(f"{path}/{two}", "wb") as f:
        f.write(b"x")
    assert {r["part"] for r in delivery.delivered(spark, path, failures=True).collect()} == {one, two}
    with pytest.raises(Exception):
        delivery.delivered(spark, path).collect()


def test_compaction_and_empty_deliveries(spark, tmp_path):
    path = str(tmp_path / "out")
    delivery.deliver(rows(spark, 9, 5), path, "id", "kind")
    after = delivery.compact(spark, path, "id", 1, "kind")
    assert (len(after["parts"]), after["rows"], after["counts"]) == (1, 9, {"image": 3, "video": 6}) and delivery.delivered(spark, path).count() == 9
    assert len([n for n in os.listdir(path) if n.startswith("v-")]) == 1
    assert delivery.deliver(rows(spark, 0), path, "id")["rows"] == 0 and delivery.delivered(spark, path).count() == 0
    with pytest.raises(Exception, match="nothing was delivered"):
        delivery.delivered(spark, str(tmp_path / "none"))
