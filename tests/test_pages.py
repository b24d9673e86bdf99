from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from criticlens.operators import pages, products

STAR = '<li><div class="a-section a-spacing-none a-text-left aok-nowrap"> {} star<span>x</span></div>' \
    '<div class="a-section a-spacing-none a-text-right aok-nowrap"><i>y</i>{}%</div></li>'
HISTOGRAM = (
    '<div id="cm_cr_dp_d_rating_histogram"><span class="a-size-medium a-color-base">4.5 out of 5</span>'
    '<ul id="histogramTable">' + "".join(STAR.format(i, p) for i, p in [(5, 62), (4, 18), (3, 10), (2, 4), (1, 6)]) + "</ul></div>"
)
FULL = f"""<html><head><script>var x = "<span id='productTitle'>no</span>";</script></head><body>
<!-- <span id="productTitle">hidden</span> -->
<span id="productTitle" class="big">  Green &amp; Black Tea&#33; </span><a id="bylineInfo" href="#">Visit <b>Shop</b></a>
<div id="wayfinding-breadcrumbs_feature_div"><ul><li>Grocery &amp; Gourmet Food</li> › <li> Tea </li></ul></div>
<div id="productDescription"><div><p>Fine <b>tea</b>.</p></div><style>p{{}}</style><p>Really.</p></div>
<div id="altImages"><img src="https://m.media-amazon.com/images/I/41abc._AC_US40_.jpg">
<img src="https://m.media-amazon.com/images/I/51def._SS40_.png"><img src="https://other.org/I/a.jpg"><img></div>
<div id="detailBullets_feature_div"><ul><li><span>Weight</span> ‏ : ‎ <span>1  kg</span></li>
<li>Time: 10 : 30 : now</li><li>Weight: 2 kg</li><li>Alone</li>
<li>Customer Reviews: 4.5 4.5 out of 5 stars 1,234 ratings</li></ul></div>
<div id="important-information"><div class="a-section content"><span>Directions</span><p>Boil </p><p>water</p></div>
<div class="a-section content"><p>no heading</p></div></div>
{HISTOGRAM}
<ul id="cm-cr-dp-review-list"><li><a class="a-link review-title-content"><span class="a-icon-alt">5.0 out of 5 stars</span>
<span> Lovely </span></a><span class="a-size review-date">Reviewed in London on August 27, 2025</span>
<div class="a-expander review-text-content"><span> So good </span></div>
<span class="cr-vote-text"> One person found this helpful</span></li>
<li><a class="review-title-content"><span class="a-icon-alt">1.0 out of 5 stars</span><span>Bad</span></a></li></ul></body></html>"""
PLAIN = '<html><body><span id="productTitle">Only a title</span></body></html>'
NO_TITLE = '<html><body><a id="bylineInfo">x</a> productTitle</body></html>'
BROKEN = PLAIN.replace("</body>", HISTOGRAM.replace("a-text-right", "a-text-wrong", 1) + "</body>")


@pytest.fixture(scope="module")
def documents(spark):
    rows = [("full", FULL), ("plain", PLAIN), ("none", NO_TITLE), ("broken", BROKEN), ("missing", None)]
    df = spark.createDataFrame(rows, "product_id string, html string")
    return pages.extract_pages(df)


def test_extract_pages(documents):
    found = {r["product_id"]: r for r in documents.collect()}
    assert set(found) == {"full", "plain", "broken"}
    full = found["full"]
    assert full["product_title"] == "Green & Black Tea!"
    assert full["byline_info"] == "Visit Shop"
    assert full["product_description"] == "Fine tea.Really."
    assert full["category"] == ["Grocery & Gourmet Food", "Tea"]
    assert full["alt_images"] == ["https://m.media-amazon.com/images/I/41abc.jpg"]
    assert full["product_detail"] == {
        "Weight": "2 kg", "Time": "10:30:now", "Alone": "", "Customer Reviews": "4.5 4.5 out of 5 stars 1,234 ratings"
    }
    assert full["important_information"] == {"Directions": "Boil water"}
    assert full["rating"]["score"] == "4.5 out of 5"
    assert full["rating"]["dist"] == {"5 star": "62%", "4 star": "18%", "3 star": "10%", "2 star": "4%", "1 star": "6%"}
    first, second = full["top_comments"]
    assert first.asDict() == {
        "date": "August 27, 2025", "title": "Lovely", "score": "5.0 out of 5 stars", "text": "So good", "helpfulness": "One"
    }
    assert (second["date"], second["text"], second["helpfulness"]) == ("", "", "0")
    plain = found["plain"]
    assert plain["byline_info"] == "" and plain["category"] == [] and plain["product_detail"] == {}
    assert plain["rating"] is None and plain["top_comments"] == []
    assert found["broken"]["rating"] is None


def test_features_of_extracted_pages(documents):
    rows = {r["product_id"]: r for r in products.product_features(documents).collect()}
    full = rows["full"]
    assert (full["count_alt_images"], full["score"], full["num_ratings"], full["is_food"]) == (1, 4.5, 1234, True)
    assert full["score_distribution"] == [6.0, 4.0, 10.0, 18.0, 62.0]
    assert 0 < full["score_polarization_index"] < 1
    plain = rows["plain"]
    assert (plain["score"], plain["score_distribution"], plain["num_ratings"], plain["is_food"]) == (None, None, -1, False)
    reviews = products.product_comments(documents).collect()
    assert sorted((r["score"], r["helpfulness_numerator"]) for r in reviews) == [(1, 0), (5, 1)]


def test_flat_fields(spark):
    html = '<html lang="en"><title>A &lt;b&gt;\n</title><script>"<h1>no</h1>"</script><h1>H <i>x</i></h1>' \
        '<li><a class="c" href="/1">One</a></li><li><a href="/2">One</a></li><li>Two</li></html>'
    df = spark.createDataFrame([(1, html), (2, "<p>untitled</p>")], "id int, html string")
    row = pages.page_fields(df).collect()
    assert [(r["id"], r["title"], r["heading"], r["lang"]) for r in row] == [(1, "A <b>", "H x", "en")]
    assert pages.page_links(df).where("id = 1").first()["links"] == ["/1", "/2"]
    assert pages.page_key_values(df).where("id = 1").first()["key_values"] == {"One": "/2", "Two": ""}
    rate = pages.page_fill_rate(df).first()
    assert (rate["n_pages"], rate["share_title"], rate["share_links"]) == (2, 0.5, 0.5)


def test_deeply_nested_page_does_not_overflow(spark):
    html = "<div>" * 5000 + '<span id="productTitle">Deep</span>' + "</div>" * 5000
    df = spark.createDataFrame([("d", html)], "product_id string, html string")
    assert pages.extract_pages(df).select(F.col("product_title")).first()[0] == "Deep"


AWKWARD = {
    "open items": "<title>t</title>" + "<li>x" * 60_000,
    "open comments": "<title>t</title>" + "<!-- " * 60_000,
    "open scripts": "<title>t</title>" + "<script>" * 40_000,
    "open links": "<title>t</title>" + "<a " * 100_000,
    "open titles": "<title>" * 60_000,
    "brackets": "<title>t</title><li>" + "<" * 300_000,
    "spaces": "<title>" + " " * 300_000 + "x" + " " * 300_000 + "y</title>",
    "one word": "<title>" + "b" * 500_000 + "</title>",
    "deep": "<title>t</title>" + "<div>" * 60_000 + "</p>" * 60_000,
}


def test_awkward_pages_take_linear_time(spark):
    """Broken markup of several hundred kilobytes; quadratic patterns would take minutes each."""
    rows = [(name, html + " productTitle") for name, html in AWKWARD.items()]
    df = spark.createDataFrame(rows, "name string, html string")
    start = time.perf_counter()
    fields = {r["name"]: r["title"] for r in pages.page_fields(df).select("name", "title").collect()}
    items = {r["name"]: r["n"] for r in pages.page_key_values(df).select("name", F.size("key_values").alias("n")).collect()}
    links = pages.page_links(df).where(F.size("links") > 0).count()
    parsed = pages.extract_pages(df).count()
    assert time.perf_counter() - start < 60
    assert fields["open items"] == "t" and fields["spaces"].endswith("y")
    assert items["open items"] == 2 and items["open comments"] == 0
    assert links == 0 and parsed == 0


def test_list_items_without_end_tags(spark):
    html = PLAIN.replace("</body>", '<div id="detailBullets_feature_div"><ul>' + "".join(f"<li><b>k{i}:</b> v" for i in range(20_000)) + "</ul></div></body>")
    df = spark.createDataFrame([("p", html)], "product_id string, html string")
    detail = pages.extract_pages(df).select(F.size("product_detail"), F.col("product_detail")["k7"]).first()
    assert tuple(detail) == (20_000, "v")


def test_texts_without_spaces_take_linear_time(spark):
    from criticlens.functions import text

    rows = [("b" * 400_000,), ("ab" * 200_000,), ("é" * 300_000,), (" " * 500_000,), ("." * 400_000,), ("a. " * 150_000,)]
    df = spark.createDataFrame(rows, "text string")
    start = time.perf_counter()
    measured = text.reading_ease(text.marketing_tone(text.lexicon_sentiment(df, "text", {"a": 1}), "text"), "text")
    assert measured.where(F.col("gunning_fog").isNotNull()).count() == len(rows)
    assert time.perf_counter() - start < 60


def test_text_after_the_last_tag_is_kept(spark):
    df = spark.createDataFrame([("<p>price a < b dollars and more",), ("<p>kept <b broken",)], "html string")
    assert [r[0] for r in df.select(pages.text_of(F.col("html"))).collect()] == ["price a < b dollars and more", "kept "]


def test_character_references(spark):
    rows = [("A&#233;&#xe9;&eacute;&amp;lt;&nbsp;&unknown;&#0;&#55296;&#x1F600;&", "Aééé&lt;\u00a0&unknown;\ufffd\ufffd\U0001f600&"), ("", ""), (None, None), ("&#9999999;", "\ufffd"), ("cut &amp", "cut &"), ("&ampx &copy2 &am &#65", "&x \u00a92 &am A")]
    df = spark.createDataFrame(rows, "given string, want string")
    assert df.where(~pages.decode_references(F.col("given")).eqNullSafe(F.col("want"))).count() == 0


def test_a_fragment_is_named_once():
    """What a helper names twice is computed twice, and helpers stand inside each other."""
    for column in (pages.text_of(F.col("fragment")), pages.runs(F.col("fragment"), "li"), pages.elements(F.col("fragment"), ("p", None, None))):
        assert str(column).count("fragment") == 1
    assert str(pages.page_rating(F.col("fragment"), pages.PRODUCT)).count("fragment") == 2  # a second look only at a nested element


def test_elements_end_where_they_should(spark):
    div, classed = ("div", None, None), ("span", "class", "x")
    rows = [
        (1, "<div>a<div>b</div>c</div>d"), (2, "<DIV id=1></DIV>d"), (3, "a<div>b<p>c"), (4, "<divx>a</divx>"), (5, None), (6, ""), (7, "<div>a<div/>b</div>c</div>d"),
        (8, "<div></div><div>b</div>"), (9, "<div>\n&amp;é😀</div >"),
    ]
    df = spark.createDataFrame(rows, "id int, h string")
    found = {r["id"]: r["e"] for r in df.select("id", pages.element(F.col("h"), div).alias("e")).collect()}
    assert found == {1: "a<div>b</div>c", 2: "", 3: "b<p>c", 4: None, 5: None, 6: None, 7: "a<div/>b</div>c", 8: "", 9: "\n&amp;é😀"}
    text = "<span class='a x'>1<span>2</span>3</span>4<span class=x>5<ul><li>6<li/>7</li >8<LI a=1>9</ul></li>"
    row = spark.range(1).select(
        pages.elements(F.lit(text), classed).alias("e"), pages.runs(F.lit(text), "li").alias("r"), pages.runs(F.lit("none"), "li").alias("none"),
        pages.decode_references(F.lit("&lt;&ampx& &#65;&bogus;&copy")).alias("d"),
    ).first()
    assert row["e"] == ["1<span>2</span>3", "5<ul><li>6<li/>7</li >8<LI a=1>9</ul></li>"] and row["r"] == ["6", "7", "9</ul>"] and row["none"] == []
    assert row["d"] == "<&x& A&bogus;©"
