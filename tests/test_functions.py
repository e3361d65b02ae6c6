from pyspark.sql import functions as F

from curaspark.functions import hashing, text, urls


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("r")).first()["r"]


def test_numbers_and_dates(spark):
    for raw, n in (("十二", 12), ("二十", 20), ("三百零五", 305), ("１２", 12), ("两千", 2000), ("", 0)):
        assert one(spark, text.cjk_number(F.col("x")), x=raw) == n
    assert str(one(spark, text.first_date(F.col("x")), x="于2024年2月29日公开"))[:10] == "2024-02-29"
    assert one(spark, text.first_date(F.col("x")), x="2023-02-30") is None
    assert one(spark, text.first_date(F.col("x")), x="no date") is None


def test_clamp_and_freshness_of_nulls(spark):
    assert one(spark, text.clamp(F.col("x"), 0.0, 1.0, 0.3), x="bad") == 0.3
    assert one(spark, text.clamp(F.col("x"), 0.0, 1.0, 0.3), x="7") == 1.0
    assert one(spark, text.freshness(F.lit(None).cast("timestamp"), F.current_timestamp())) == 0.0


def test_normalized(spark):
    assert one(spark, text.normalized(F.col("x")), x="  Ｃｇ　Straße ") == "cg strasse"


def test_error_rules(spark):
    got = lambda k, s, m: tuple(one(spark, text.diagnosis(F.lit(k), F.lit(s).cast("int"), F.lit(m))))
    for case, want in ((("timeout", None, ""), ("timeout", True)), (("http", 429, ""), ("http_429", True)), (("http", 503, ""), ("http_error", True)), (("http", 404, ""), ("http_error", False)), (("database", None, "Database is LOCKED"), ("sqlite_locked", True)), (("database", None, "no table"), ("sqlite_error", False)), (("os", None, "cannot identify image file"), ("image_decode", False)), (("value", None, "?"), ("error", False))):
        assert got(*case) == want


def test_sections(spark):
    for name, place, prefix in (("新作", 1, "x"), ("漢　化 情報", 1, "h"), ("hobby", 1, "z"), (None, 1, "z"), ("\ufffd\ufffd", 3, "x"), ("\ufffd\ufffd", 30, "z")):
        label = text.section_label(F.lit(name).cast("string"), F.lit(place))
        assert one(spark, text.section_prefix(label), x=1) == prefix


def test_safe_titles(spark):
    for raw, want in ((" a:b/c?.. ", "abc"), ("...", "f"), (None, "f"), ("x y.", "x y")):
        assert one(spark, text.safe_title(F.lit(raw).cast("string"), F.lit("f")), x=1) == want


def test_terms(spark):
    for t, term, hit in (("my-logo2.png", "logo", True), ("catalogue", "logo", False), ("立绘图", "立绘", True)):
        assert one(spark, text.has_term(F.col("x"), term), x=t) is hit


def test_redaction(spark):
    assert one(spark, text.redact(F.col("x")), x="Bearer abc.def token=zzz ok") == "Bearer [redacted] token=[redacted] ok"
    u = "https://a.example/p?page=2&Token=1&X-Amz-Signature=q#f"
    assert one(spark, urls.redacted(F.col("x")), x=u) == "https://a.example/p?page=2#f"


def test_glued_urls(spark):
    assert one(spark, text.glued_urls(F.col("x")), x="见https://a.example/1https://b.example/2。") == ["https://a.example/1", "https://b.example/2"]


def test_brackets(spark):
    assert one(spark, text.bracketed(F.col("x")), x="《甲》与『乙』《甲》") == ["甲", "乙"]
    assert one(spark, text.bracketed(F.col("x")), x="某作品 发售决定") == ["某作品"]
    assert one(spark, text.organizations(F.col("x")), x="AlphaSOFT and BetaGAMES, AlphaSOFT") == ["AlphaSOFT", "BetaGAMES"]


def test_urls(spark):
    up = lambda u: one(spark, urls.upgraded(F.col("x")), x=u)
    assert up("https://h.example/a-300x200.jpg") == "https://h.example/a.jpg"
    assert up("https://i0.wp.com/a.jpg?w=3&x=1") == "https://i0.wp.com/a.jpg?x=1"
    assert up("https://pbs.twimg.com/media/A.jpg:small?name=small") == "https://pbs.twimg.com/media/A.jpg?name=orig"
    assert one(spark, urls.srcset_largest(F.col("x")), x="a.jpg 1x, b.jpg 300w, c.jpg 300w") == "b.jpg"
    video = lambda u: one(spark, urls.canonical_video(F.col("x")), x=u)
    assert video("https://youtu.be/abcdefgh?t=1") == video("https://www.youtube.com/watch?v=abcdefgh") == "https://www.youtube.com/watch?v=abcdefgh"
    assert video("https://example.org/") is None
    for u, ok in (("http://127.0.0.1/", False), ("https://u:p@a.example/", False), ("https://a.example/", True), ("ftp://a.example/", False), ("http://172.20.0.1/", False)):
        assert one(spark, urls.safe_target(F.col("x")), x=u) is ok


def test_addresses_of_no_public_page_however_written(spark):
    bad = ["http://2130706433/", "http://0x7f.1/", "http://0177.0.0.1/", "http://127.1/", "http://[::1]/", "http://[::ffff:10.0.0.1]/", "http://[fe80::1]/", "http://[fc00::1]/", "http://[2001:db8::1]/", "http://[2002:7f00::]/", "http://100.64.0.1/", "http://198.18.0.1/", "http://224.0.0.1/", "http://255.255.255.255/", "http://localhost./", "http://a.localhost/", "http://0.0.0.0/"]
    good = ["http://8.8.8.8/", "http://172.32.0.1/", "http://100.128.0.1/", "http://[2606:4700::1111]/", "https://10.example/", "https://0x.example/", "http://192.0.3.1/"]
    rows = spark.createDataFrame([(u,) for u in bad + good], "u string").select("u", urls.safe_target(F.col("u")).alias("ok")).collect()
    assert [r["u"] for r in rows if r["ok"]] == good


def test_hamming(spark):
    assert one(spark, hashing.hamming_hex(F.col("a"), F.col("b")), a="ffffffffffffffff", b="0000000000000001") == 63
