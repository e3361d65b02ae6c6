import io
import zipfile

from pyspark.sql import functions as F

from curaspark.sinks import writers
from curaspark.sources import documents, pages, posts
from curaspark.streaming import progress


def docx(paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p><w:r><w:rPr>{"<w:b/>" if b else ""}<w:sz w:val="{s}"/></w:rPr><w:t>{t}</w:t></w:r></w:p>' for t, b, s in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_document_entries(spark, tmp_path):
    (tmp_path / "7.docx").write_bytes(docx([("新作", False, 22), ("Title one # Ann #", False, 22), ("body a", False, 22), ("body b", False, 22), ("汉化", False, 22), ("Styled", True, 30), ("text", False, 22)]))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    p = documents.read_paragraphs(spark, str(tmp_path / "*.docx"))
    assert p.where("error is not null").count() == 1
    got = [tuple(r) for r in documents.entries(p).orderBy("sequence").collect()]
    assert got == [("7", 1, "新作", "Title one", "Ann", "body a\nbody b"), ("7", 2, "汉化", "Styled", None, "text")]


def test_links(spark):
    html = '<title> T </title><div class="gallery"><a href="/x"></a></div>'
    df = spark.createDataFrame([(1, "https://a.example/dir/p.html", html), (2, "https://a.example/", None)], "page_id long, url string, html string")
    assert pages.links(df).first().link == "https://a.example/x"
    assert df.select(pages.absolute(F.col("url"), F.lit("n.html")).alias("x")).first().x == "https://a.example/dir/n.html"


def test_post_shapes(spark):
    photo = '{"type":"photo","media_url_https":"https://pbs.twimg.com/media/A.jpg","media_key":"k1"}'
    video = '{"type":"video","media_key":"k2","video_info":{"variants":[{"content_type":"application/x-mpegURL","url":"h"},{"bitrate":1,"content_type":"video/mp4","url":"a"},{"bitrate":9,"content_type":"video/mp4","url":"b"}]}}'
    rows = [
        (f'{{"tweet":{{"id":"1","full_text":"t","entities":{{"media":[{photo},{video}]}}}}}}',),
        (f'{{"data":{{"id":"2","text":"t","attachments":{{"media_keys":["k1"]}}}},"includes":{{"media":[{photo},{video}]}}}}',),
        (f'{{"tweets":[{{"id":"3","text":"t","extended_entities":{{"media":[{photo}]}}}}]}}',),
        (f'{{"id":"4","text":"t","entities":{{"media":[{photo}]}}}}',),
    ]
    b = spark.createDataFrame(rows, "p string").select(posts.body(posts.parse(F.col("p"))).alias("b"))
    got = b.select("b.id", "b.text", posts.photos(F.col("b")).alias("x")).orderBy("id").collect()
    assert [(r.id, r.text, r.x) for r in got] == [(str(i), "t", ["https://pbs.twimg.com/media/A.jpg?name=orig"]) for i in range(1, 5)]
    assert b.where("b.id = '1'").select(posts.best_video(F.col("b.media")[1]).alias("v")).first().v == "b"


def test_publish_replaces_whole_and_redacts(spark, tmp_path):
    target = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "https://a.example/?token=1&p=2", [("https://b.example/?key=1",)])], "id int, url string, sources array<struct<page_url:string>>")
    writers.publish(df, target)
    writers.publish(df.withColumn("id", F.lit(2)), target)
    r = spark.read.parquet(target).collect()
    assert [(x.id, x.url, x.sources[0].page_url) for x in r] == [(2, "https://a.example/?p=2", "https://b.example/")]
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_failing_sink_does_not_stop_the_stream(spark, tmp_path):
    spark.range(5).selectExpr("id event_id", "timestamp_ntz'2024-01-01 00:00:00' ts", "id % 2 user_id", "'view' event_type", "1.0D value", "'{}' props").write.parquet(str(tmp_path / "e"))
    failures = []

    def sink(batch, number):
        raise ValueError("no")

    q = progress.deliver(progress.events(spark, str(tmp_path / "e")), sink, failures, str(tmp_path / "c"), "append")
    q.awaitTermination()
    assert failures == ["batch 0: ValueError"] and q.exception() is None
