from curaspark.sources import json_walk


def test_roots_of_every_kind(spark):
    rows = [(1, "7"), (2, "null"), (3, '"x"'), (4, "[]"), (5, "{}"), (6, '{"a":[[1],{"b":false}]}'), (7, "{bad"), (8, None), (9, "")]
    values, failures = json_walk.walk(spark.createDataFrame(rows, "id int, j string"), "id", "j")
    got = sorted((r["id"], r["path"], r["kind"], r["value"]) for r in values.collect())
    assert got == [
        (1, "$", "number", "7"), (2, "$", "null", None), (3, "$", "string", "x"), (4, "$", "array", None), (5, "$", "object", None),
        (6, "$", "object", None), (6, "$.a", "array", None), (6, "$.a[0]", "array", None), (6, "$.a[0][0]", "number", "1"), (6, "$.a[1]", "object", None), (6, "$.a[1].b", "boolean", "false"),
    ]
    assert sorted(r["id"] for r in failures.collect()) == [7, 9]


def test_no_documents(spark):
    values, failures = json_walk.walk(spark.createDataFrame([], "id int, j string"), "id", "j")
    assert values.count() == 0 and failures.count() == 0
    assert json_walk.expanded_urls(values, "id").count() == json_walk.photos(values, "id").count() == json_walk.products(values, "id").count() == 0


def test_order_of_links_over_ten_elements(spark):
    text = '{"urls":[' + ",".join(f'{{"expanded_url":"https://e.example/{i}"}}' for i in range(12)) + ',{"expanded_url":"https://e.example/3"},{"expanded_url":"ftp://x"},{"expanded_url":5}]}'
    values, _ = json_walk.walk(spark.createDataFrame([(1, text)], "id int, j string"), "id", "j")
    assert json_walk.expanded_urls(values, "id").first()["links"] == [f"https://e.example/{i}" for i in range(12)]
