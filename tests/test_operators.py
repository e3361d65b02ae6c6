import random

import numpy as np
from pyspark.sql import functions as F

from curaspark import config, schemas
from curaspark.operators import classify, evaluate, relational, selection


def test_hamming_join_equals_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(8)]
    rows = [(i % 2, i, f"{base[i % 8] ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(12))) & (2**64 - 1):016x}") for i in range(120)]
    got = {(r.a, r.b, r.distance) for r in relational.hamming_join(spark.createDataFrame(rows, "g int, k int, h string"), "g", "k", "h", 8).collect()}
    want = {(a[1], b[1], n) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and (n := bin(int(a[2], 16) ^ int(b[2], 16)).count("1")) <= 8}
    assert got == want and want


def test_leaders_are_greedy_and_not_transitive(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 3), int(i), int(rng.integers(0, 2**12)), int(rng.integers(0, 2**12))) for i in range(150)]
    df = spark.createDataFrame(rows, "g int, k int, lo long, hi long")
    want = set()
    for g in range(3):
        kept = []
        for r in rows:
            if r[0] == g and all(bin(r[2] ^ x[2]).count("1") + bin(r[3] ^ x[3]).count("1") > 6 for x in kept):
                kept.append(r)
        want |= {(g, r[1]) for r in kept}
    assert {tuple(r) for r in selection.leaders(df, "g", "k", "k", ["lo", "hi"], 6).collect()} == want
    assert {tuple(r) for r in selection.leaders(df, "g", "k", "k", ["lo", "hi"], 6, hot=10).collect()} == want


def test_allocation_equals_the_greedy_loop(spark):
    rng = random.Random(1)
    kinds = list(config.DEFAULTS["selection"]["type_limits"])
    rows = [(f"i{rng.randrange(6)}", f"c{i:04d}", rng.choice(kinds), rng.random() < 0.1, rng.random() < 0.8, rng.random() < 0.3, rng.random() < 0.2, round(rng.random() * 100, 3), 0.5, rng.randrange(2000), rng.randrange(2000)) for i in range(500)]
    df = spark.createDataFrame(rows, "item_id string, candidate_id string, image_type string, x_photo boolean, auto_select boolean, fallback_only boolean, localized boolean, total double, trust double, width int, height int")
    got = {r.candidate_id for r in selection.allocate(df, cap=7).where("selected").collect()}
    limits, want = config.DEFAULTS["selection"]["type_limits"], set()
    for item in {r[0] for r in rows}:
        limit = lambda r: 10**9 if r[3] else 7 if r[6] and r[2] == "gameplay_screenshot" else limits[r[2]]
        group = [r for r in rows if r[0] == item and r[4] and limit(r) > 0]
        group = [r for r in group if not r[5]] or group
        group.sort(key=lambda r: (not r[3], not r[6], r[2] == "background_art", -r[7], -r[8], -r[9] * r[10], r[1]))
        taken, by = [], {}
        for r in group:
            if len(taken) < 7 and by.get(r[2], 0) < limit(r):
                taken.append(r[1])
                by[r[2]] = by.get(r[2], 0) + 1
        want |= set(taken)
    assert got == want


def test_an_x_photo_takes_the_place_of_its_type(spark):
    rows = [("i", "a", "key_visual", True, True, False, False, 10.0, 0.5, 9, 9), ("i", "b", "key_visual", False, True, False, False, 90.0, 0.5, 9, 9), ("i", "c", "key_visual", True, True, False, False, 5.0, 0.5, 9, 9)]
    df = spark.createDataFrame(rows, "item_id string, candidate_id string, image_type string, x_photo boolean, auto_select boolean, fallback_only boolean, localized boolean, total double, trust double, width int, height int")
    assert {r.candidate_id for r in selection.allocate(df).where("selected").collect()} == {"a", "c"}


def test_native_size_bounds(spark):
    for w, h, ok in ((799, 720, False), (1280, 449, False), (600, 600, False), (800, 450, True)):
        assert spark.range(1).select(classify.native_size(F.lit(w), F.lit(h)).alias("x")).first().x is ok


def test_evaluation_golden_case(spark):
    rows = spark.createDataFrame([("n", True, "A"), ("n", True, "C"), ("n", False, "A"), ("n", False, None)], "item_id string, selected boolean, label string")
    r = evaluate.report(rows).first()
    assert (r.a_precision, r.bad_rate, r.retention, r.unlabeled, r.status) == (0.5, 0.5, 0.5, 1, "insufficient_annotations")
    assert evaluate.report(rows.limit(0)).first().a_precision is None


def test_merges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in relational.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    status = {r.k: r.status for r in relational.compare_runs(old, new, "k", ["v"]).collect()}
    assert status == {1: "removed", 2: "changed", 3: "added"}
    broken = schemas.violations(old, "k", {"early": F.col("v") < "b", "null": F.lit(None).cast("boolean")})
    assert {tuple(r) for r in broken.collect()} == {(1, "null"), (2, "early"), (2, "null")}


def test_reach_visits_once(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 1), (3, 4), (4, 5)], "src long, dst long")
    got = {(r.node, r.level) for r in relational.bounded_reach(e, spark.createDataFrame([(1,)], "root long"), 2).collect()}
    assert got == {(1, 0), (2, 1), (3, 1), (4, 2)}


def test_config_overlay():
    c = config.overlay(config.DEFAULTS, {"selection": {"type_limits": {"logo": 3}}})
    assert c["selection"]["type_limits"]["logo"] == 3 and c["selection"]["type_limits"]["game_cg"] == 20
    assert config.semantic_hash(c) != config.semantic_hash(config.DEFAULTS)
    assert config.semantic_hash(config.overlay(config.DEFAULTS, {"network": {"timeout_seconds": 1}})) == config.semantic_hash(config.DEFAULTS)


def test_store_screenshots(spark):
    from curaspark.operators import collection

    props = '{"screenshots":[{"full":"a?t=1","standard":"b"},{"standard":"c"},{"thumbnail":"d"},{"full":"a?t=2"}]}'
    assert spark.range(1).select(collection.store_screenshots(F.lit(props)).alias("x")).first().x == ["a", "c", "d"]


def test_names_and_parents(spark):
    from curaspark.operators import evidence

    row = spark.createDataFrame([(["甲乙丙丁 Chapter 2", " ", "Chapter 3 Silent Road"], "《白》 and [Black] 更新")], "g array<string>, t string")
    got = row.select(evidence.names_of(F.col("g"), F.col("t")).alias("n")).first().n
    assert got == ["甲乙丙丁 Chapter 2", "Chapter 3 Silent Road", "白", "Black", "甲乙丙丁", "Silent Road"]


def test_curation_keeps_every_candidate_and_says_why(spark):
    from curaspark.operators.curate import curate

    columns = "item_id string, candidate_id long, image_type string, type_confidence double, source_type string, source_url string, image_url string, page_official boolean, width int, height int, x_photo boolean, animated boolean, invalid_reason string, conversion_error string, source_linked boolean, match boolean, confidence double, why array<string>, localized boolean, localization_auto boolean, sha256 string, detail double, base_relevance double, published_at timestamp, fetched_at timestamp"
    base = dict(
        item_id="a", candidate_id=1, image_type="game_cg", type_confidence=0.92, source_type="official_site", source_url="https://a.example/news/1", image_url="https://a.example/news/1", page_official=None, width=1280, height=720, x_photo=False, animated=False,
        invalid_reason=None, conversion_error=None, source_linked=True, match=True, confidence=0.92, why=["entity_name_in_context"], localized=None, localization_auto=None, sha256=None, detail=None, base_relevance=0.6, published_at=None, fetched_at=None,
    )
    cases = [
        {}, dict(match=False), dict(match=False, x_photo=True), dict(match=None), dict(image_type="cover"), dict(width=200), dict(source_linked=False), dict(item_id="none"), dict(item_id=None),
        dict(invalid_reason="corrupt"), dict(animated=True), dict(sha256="s"), dict(sha256="s"), dict(source_url="https://a.example/shop/1", why=["image_linked_from_news_source"]), dict(image_type=None, type_confidence=None),
        dict(localized=True, localization_auto=True, image_type="gameplay_screenshot", match=False),
    ]
    rows = [base | {"candidate_id": n} | case for n, case in enumerate(cases)]
    names = [c.strip().split()[0] for c in columns.split(",")]
    c = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], columns)
    items = spark.createDataFrame([("a", ["cg"])], "item_id string, requirements array<string>")
    got = {r.candidate_id: r for r in curate(c, items).collect()}
    assert len(got) == len(cases)
    status = [got[n].status for n in range(len(cases))]
    assert status == ["selected", "filtered", "selected", "unselected", "filtered", "unselected", "unselected", "unselected", "unselected", "invalid", "unselected", "selected", "unselected", "unselected", "unselected", "selected"]
    assert got[1].failures == ["entity_mismatch"] and got[2].reasons == ["socialdata_x_photo_priority", "socialdata_x_photo_source_overrides_entity_classifier", "selected_by_rank_and_policy"]
    assert got[3].reasons == ["entity_unverified"] and got[4].reasons == ["image_type_rejected:cover"] and got[5].reviews == ["image_quality_review"]
    assert got[7].total is None and "source_not_linked_to_news" in got[7].reasons and got[7].image_type == "unknown"
    assert got[12].duplicate_of == 11 and got[12].reasons == ["duplicate_of_better_candidate"]
    assert got[13].failures == ["entity_unverified"] and not got[13].auto_select
    assert curate(c.limit(0), items).count() == 0
