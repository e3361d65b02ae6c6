from curaspark.sources import gallery

PAGE = '<div class="top-gallery"><img id="galleryPreview"><ul id="galleryThumbnailTrack"></ul></div>'
USE = "show(galleryThumbnailTrack, galleryPreview);"
COUNTED = "const imageCount = {n};\nconst images = Array.from({{ length: imageCount }}, (_, index) => {{\n const number = index + 1;\n return {{ preview: `cg/${{number}}.jpg`, thumbnail: `t/${{ index + 1 }}.png`, alt: `x` }};\n}});" + USE
URL = "https://a.example/w/p.html"


def images(spark, *rows):
    df = spark.createDataFrame([(i, URL, html, script) for i, (html, script) in enumerate(rows)], "page_id int, url string, html string, script string")
    out = {}
    for r in gallery.gallery_images(df).orderBy("page_id", "position").collect():
        out.setdefault(r["page_id"], []).append((r["position"], r["image_url"].removeprefix("https://a.example/"), r["thumbnail_url"] and r["thumbnail_url"].removeprefix("https://a.example/")))
    return out


def test_lists_and_templates(spark):
    got = images(
        spark,
        (PAGE, COUNTED.format(n=3)),
        (PAGE, 'let images = ["/a.jpg", "b].jpg", "/a.jpg", 5, "ftp://x/y"];' + USE),
        (PAGE, "var images = [{preview: 'p.jpg', thumbnail: 't.jpg'}, {src: 's.jpg'}, {none: 1},];" + USE),
        (PAGE, 'const images = [{"url": "u.jpg", "on": true, "more": null}];' + USE),
        (PAGE, COUNTED.format(n=600)),
        (PAGE, COUNTED.format(n=0)),
        (PAGE, "const images = load();" + USE),
        (PAGE, 'const images = ["a.jpg"];'),
        ('<div class="gallery"><img id="galleryPreview"></div><ul id="galleryThumbnailTrack"></ul>', 'const images = ["a.jpg"];' + USE),
        (PAGE, COUNTED.format(n=2).replace("const number = index + 1;", "")),
        (PAGE, COUNTED.format(n=2).replace("const number = index + 1;", "const number = index + 1; number = f(number);")),
        (PAGE, "const images = [f('a.jpg')];" + USE),
        (None, None),
    )
    assert got == {
        0: [(i, f"w/cg/{i}.jpg", f"w/t/{i}.png") for i in (1, 2, 3)], 1: [(1, "a.jpg", None), (2, "w/b].jpg", None)], 2: [(1, "w/p.jpg", "w/t.jpg"), (2, "w/s.jpg", None)], 3: [(1, "w/u.jpg", None)],
    }


def test_500_is_the_most(spark):
    assert len(images(spark, (PAGE, COUNTED.format(n=500)))[0]) == 500
    assert images(spark, (PAGE, f"const images = {[f'{i}.jpg' for i in range(501)]};" + USE)) == {}


def test_brackets_in_texts():
    text = "[']', \"]\", `]`, '\\']', [1]]x"
    assert gallery._closing(text, 0) == len(text) - 2
    assert gallery._closing("[(]", 0) is None and gallery._closing("[", 0) is None
