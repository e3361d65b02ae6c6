"""Carried-over state, moved assets and pixel metrics."""

import random

import numpy as np
from pyspark.sql import functions as F

from curaspark.functions import pixels
from curaspark.operators import resume
from curaspark.streaming import progress

PROOFS = "item_id long, kind string, place long, work_id string, confirmed boolean, linked boolean"


def test_an_established_identity_is_never_replaced(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(5), rng.choice(["a", "b"]), i, rng.choice([None, "v1", "v2", "v3"]), rng.random() < 0.5, rng.random() < 0.7) for i in range(80)]
    known = spark.createDataFrame([(0, "a", "v9"), (7, "b", "v8")], "item_id long, kind string, work_id string")
    want = {}
    for item, kind, _, work, confirmed, linked in rows:
        if work and confirmed and linked:
            want.setdefault((item, kind), work)
    batch = resume.established(spark.createDataFrame(rows, PROOFS), known)
    assert {(r["item_id"], r["kind"]): r["work_id"] for r in batch.collect()} == want | {(0, "a"): "v9", (7, "b"): "v8"}
    for i in range(0, 80, 16):  # a file each, so that each is a batch of its own
        spark.createDataFrame(rows[i : i + 16], PROOFS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(PROOFS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = progress.drain(resume.established_stream(stream), "established", "append").collect()
    assert len(got) == len(want) and {(r["item_id"], r["kind"]): r["work_id"] for r in got} == want


def test_resumption(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "item_id int")
    media = spark.createDataFrame([(1, True), (1, False), (2, False), (5, None)], "item_id int, needs_download boolean")
    failures = spark.createDataFrame([(2, "download_failed"), (3, "download_failed"), (3, "download_failed"), (4, "entity_mismatch")], "item_id int, code string")
    got = resume.resumption(ids(1, 2, 3, 4, 5, 6), ids(1, 2, 3, 3, 5), media, failures)
    assert {r["item_id"]: r["action"] for r in got.collect()} == {1: "reopen", 2: "skip", 3: "unrecoverable", 4: "run", 5: "skip", 6: "run"}


def test_reset_of_broken_and_missing_snapshots(spark):
    rows = [({"alt": "a", "auto_select": "1"},), ({"gallery_path": "true", "gallery_recovery_original": "{bad"},), ({},), (None,)]
    got = [r["x"] for r in spark.createDataFrame(rows, "m map<string,string>").select(resume.reset_signals(F.col("m")).alias("x")).collect()]
    assert got == [{"alt": "a"}, {}, {}, None]


def test_rebasing_any_type(spark):
    df = spark.createDataFrame([(1, "/a/b/c", ["/a/b", "/a/bc", None], {"/a/b/k": ("/a/b//x/./y", 2.5)}, b"/a/b/z"), (2, None, None, None, None)], "i int, s string, xs array<string>, m map<string,struct<p:string,n:double>>, raw binary")
    out = resume.rebase(df, "/a/b/", "/n")
    assert out.schema.simpleString() == df.schema.simpleString()
    got = [tuple(r) for r in out.orderBy("i").collect()]
    assert got == [(1, "/n/c", ["/n", "/a/bc", None], {"/a/b/k": ("/n/x/y", 2.5)}, b"/a/b/z"), (2, None, None, None, None)]


def plain(p, width, height):
    h, w = len(p), len(p[0])
    edges, second, border, inside = [], [], [], []
    for y in range(h):
        for x in range(w):
            if 0 < y < h - 1 and 0 < x < w - 1:
                c = p[y][x]
                edges.append(max(0, min(255, 9 * c - sum(p[y + j][x + i] for j in (-1, 0, 1) for i in (-1, 0, 1)))))
                second.append(abs(4 * c - p[y][x - 1] - p[y][x + 1] - p[y - 1][x] - p[y + 1][x]))
                for at, gap in ((x, abs(c - p[y][x - 1])), (y, abs(c - p[y - 1][x]))):
                    (border if at % 8 == 0 else inside if at % 8 == 1 else []).append(gap)
            else:
                edges.append(p[y][x])
    mean = lambda v: sum(v) / max(1, len(v))
    unit = lambda v: max(0.0, min(1.0, v))
    lap, block = mean(second) / 1020, unit((mean(border) - mean(inside)) / 255 * 4)
    sharp = unit(0.55 * mean(edges) / 255 * 2.8 + 0.45 * lap * 8)
    detail = unit(0.65 * unit(min(width / 1280, height / 720)) + 0.35 * sharp - 0.15 * block)
    return sharp, detail, unit(1 - lap * 8), block


def test_pixel_metrics_equal_plain_loops(spark):
    rng = np.random.default_rng(3)
    rows = []
    for shape in ((20, 33), (3, 3), (1, 9), (2, 2), (17, 8)):
        p = rng.integers(0, 256, shape) if shape[0] % 2 else np.full(shape, 77)
        p[:, 8:] //= 2
        rows.append((p.ravel().tolist(), shape[1], 900, 500))
    rows += [(None, 3, 1, 1), ([1, 2, 3], 2, 1, 1), ([], 1, 1, 1), ([1], None, 1, 1)]
    df = spark.createDataFrame(rows, "p array<int>, n int, w int, h int")
    got = [r["q"] for r in df.select(pixels.quality("p", "n", "w", "h").alias("q")).collect()]
    for (p, n, w, h), q in zip(rows[:5], got[:5], strict=True):
        assert np.allclose(list(q), plain(np.array(p).reshape(-1, n).tolist(), w, h), atol=1e-6)
    assert [list(q) for q in got[5:]] == [[None] * 4] * 4
