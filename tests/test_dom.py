"""Evidence about images by the elements around them."""

import pytest

from curaspark.sources import dom

CASES = [
    ('<div class="gallery"><a href="/x"><img src="a.jpg" alt="one"></a></div>', "game_cg", "div.gallery", "one"),
    ('<ul class="related"><li class="gallery"><img src="a.jpg"></li></ul>', "decorative", "ul.related", "推荐商品区域"),
    ('<div class="gallery"><img src="a.jpg" class="site-logo"></div>', "logo", "img.site-logo", "  site-logo"),
    ('<div class="gallery"><img src="a.jpg" alt="立绘 1"></div>', "character_art", "img", "立绘 1 "),
    ('<p class="characteristics"><img src="a.jpg"></p>', None, None, None),
    ('<div class="gallery"><h2>Head<img src="a.jpg"></h2></div>', "decorative", "h2", "Head"),
    ('<div id="gallery"><button class="thumb"><img src="a.jpg"></button></div>', "game_cg", "div#gallery", ""),
    ('<div id="gallery"><button>Go<img src="a.jpg"></button></div>', "decorative", "button", "Go"),
    ('<div id="gallery"><span class="arrow-left"></span><i class="slide-control"><img src="a.jpg"></i></div>', "decorative", "i.slide-control", ""),
    ('<div class="product-card"><a href="https://s.example/item/7?x=1"><img src="a.jpg"></a><b class="c333">Work</b><p class="product-name">Towel</p><i class="price">9</i></div>', "goods", "div.product-card", "Work Towel"),
    ('<div class="product-card"><img src="a.jpg"><p class="product-name">Towel</p></div>', None, None, None),
    ('<section id="goods"><div class="gallery"><img src="a.jpg" alt="x"></div></section>', "unknown", "section#goods", "x"),
    ('<a id="g_2_bt">背景</a><div class="gallery_cg_box_2"><a class="group2"><img src="a.jpg" alt="サンプルCG"></a></div>', "background_art", "div.gallery_cg_box_2", "背景"),
    ('<a id="g_3_bt">イベント</a><div class="gallery_cg_box_3"><a class="group3"><img src="a.jpg"></a></div>', "game_cg", "div.gallery_cg_box_3", "イベント"),
    ('<a href="#g1">Background art</a><div class="graphic" id="g1"><img src="a.jpg"></div>', "background_art", "div#g1.graphic", "Background art"),
    ('<div class="gallery"><figure>Scene one<img src="a.jpg"></figure></div>', "game_cg", "div.gallery", "Scene one"),
    ("<p>plain <img src=a.jpg>", None, None, None),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, "https://a.example/d/p.html", html) for i, (html, *_) in enumerate(CASES)]
    return {r["page_id"]: r for r in dom.typed(dom.references(spark.createDataFrame(rows, "page_id long, url string, html string"))).where("kind = 'image'").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rules_in_order(found, i):
    _, role, container, text = CASES[i]
    e = found[i]["e"]
    assert (e and (e["role"], e["container"], e["text"])) == (role and (role, container, text))


def test_items_of_cards_and_groups(found):
    assert found[9]["e"]["item"] == "item/7" and found[12]["e"]["item"] == "group2" and found[0]["e"]["item"] == "a.jpg"


def test_candidates_of_a_page(spark, monkeypatch):
    html = """<head><meta property="og:image" content="/og.png"></head><body>
      <div class="gallery"><picture><source srcset="/cg/1.webp 400w, /cg/2.webp 1200w"><img src="/s/1-300x200.jpg" data-original="/cg/1.jpg" alt="one"></picture></div>
      <header><img src="/cg/1.jpg"></header><div style="background-image: url('/bg.jpg')">Bg</div><i data-bg="/data.png"></i>
      <div class="goods-item" style="background: url(/card.jpg)"><a href="/item/3"></a><p class="goods-title">Mug</p><p class="price">1</p></div><a href="/full.jpg">x</a><img src="data:image/png;base64,A"></body>"""
    pages = spark.createDataFrame([(1, "https://a.example/d/p.html", html), (2, "https://a.example/", None)], "page_id long, url string, html string")
    found, failures = dom.image_candidates(pages)
    got = {r["image_url"].removeprefix("https://a.example"): (r["roles"], r["excluded"], r["gallery"]) for r in found.collect()}
    assert got == {
        "/og.png": ([], None, False), "/cg/1.jpg": (["game_cg", "decorative"], "decorative", False), "/s/1.jpg": (["game_cg"], None, True), "/cg/2.webp": (["game_cg"], None, True),
        "/bg.jpg": (["decorative"], "decorative", False), "/data.png": ([], None, False), "/card.jpg": (["goods"], "goods", False), "/full.jpg": ([], None, False),
    }
    assert [r["image_url"] for r in found.orderBy("rank").limit(2).collect()] == ["https://a.example/cg/1.jpg", "https://a.example/cg/2.webp"] and failures.count() == 0


def test_a_bad_page_is_a_failure_row(spark):
    pages = spark.createDataFrame([(1, "https://a.example/", "<img src=a.jpg>"), (2, "https://a.example/", "<![x<img src=b.jpg>")], "page_id long, url string, html string")
    found, failures = dom.image_candidates(pages)
    assert [r["page_id"] for r in found.collect()] == [1]
    assert [tuple(r) for r in failures.collect()] == [(2, "collect", "adapter_error", "AssertionError")]


def test_pages_that_scripts_fill(spark):
    pages = spark.createDataFrame(
        [(1, '<div class="gallery"></div><script>x</script>'), (2, '<div class="gallery"><img src="a.jpg"></div><script>x</script>'), (3, "<p>no</p><script>x</script>"), (4, '<div id="galleryPreview"></div>'), (5, None), (6, '<div class="gallery-note"></div><script></script>')],
        "page_id long, html string",
    )
    assert {r["page_id"]: r["needs_render"] for r in dom.needs_render(pages).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False}
