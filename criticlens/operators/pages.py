"""Fields and nested sections of raw HTML pages, by expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from html.entities import html5, name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from criticlens.functions.text import add_once
from criticlens.schemas import COMMENT, TEXT_MAP

# The entities decoded in flat fields, "&amp;" last. Those HTML knows without the
# semicolon are also found where a text was cut off inside one.
ENTITIES = {"&lt;?": "<", "&gt;?": ">", "&quot;?": '"', "&#39;": "'", "&apos;": "'", "&nbsp;?": " ", "&amp;?": "&"}

# Prefix and suffix of a product image address.
IMAGE_PREFIX = "https://m.media-amazon.com/images/I/"
IMAGE_SUFFIX = "jpg"

# Where each part of a product page is found (tag, attribute, value). Without an
# attribute the first such tag is meant.
PRODUCT = {
    "title": ("span", "id", "productTitle"),
    "byline": ("a", "id", "bylineInfo"),
    "description": ("div", "id", "productDescription"),
    "breadcrumb": ("div", "id", "wayfinding-breadcrumbs_feature_div"),
    "images": ("div", "id", "altImages"),
    "bullets": ("div", "id", "detailBullets_feature_div"),
    "information": ("div", "id", "important-information"),
    "information_section": ("div", "class", "a-section content"),
    "histogram": ("div", "id", "cm_cr_dp_d_rating_histogram"),
    "histogram_score": ("span", "class", "a-size-medium a-color-base"),
    "histogram_table": ("ul", "id", "histogramTable"),
    "histogram_label": ("div", "class", "a-section a-spacing-none a-text-left aok-nowrap"),
    "histogram_share": ("div", "class", "a-section a-spacing-none a-text-right aok-nowrap"),
    "reviews": ("ul", "id", "cm-cr-dp-review-list"),
    "review_date": ("span", "class", "review-date"),
    "review_title": ("a", "class", "review-title-content"),
    "review_score": ("span", "class", "a-icon-alt"),
    "review_text": ("div", "class", "review-text-content"),
    "review_votes": ("span", "class", "cr-vote-text"),
}

# Default flat fields of a page: name -> pattern with one group. Every pattern here is linear in
# the page: an open tag ends at the next bracket, and an element that is never closed runs to the
# end of the page at once instead of being tried again from each start.
PAGE_FIELDS = {
    "title": r"(?is)<title[^<>]*>(.*?)(?:</title|\z)",
    "heading": r"(?is)<h1[^<>]*>(.*?)(?:</h1|\z)",
    "lang": r'(?is)<html[^<>]*?\blang="([^"]*)"',
}
LINK = r'(?is)<a\s[^<>]*?href="([^"]*)"'
# The content of a list item ends at the next item or the end of its list; its end tag is optional.
LIST_ITEM = r"(?is)<li(?:\s[^<>]*)?>([^<]*+(?:<(?!/?li\b|/ul\b|/ol\b)[^<]*+)*+)"
# The bracket stands before the alternatives, so that they are tried where there is one only.
_INVISIBLE = r"(?is)<(?:!--.*?(?:-->|\z)|script\b.*?(?:</script>|\z)|style\b.*?(?:</style>|\z)|[!?][^>]*(?:>|\z))"


def visible_html(html: Column) -> Column:
    """The page without comments, declarations, scripts and styles."""
    return F.regexp_replace(html, _INVISIBLE, "")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\p{Z}]+|(?<![\s\p{Z}])[\s\p{Z}]++$", "")


def plain_text(fragment: Column) -> Column:
    """Tags removed, common entities decoded, trimmed."""
    text = F.regexp_replace(fragment, r"<[^<>]*>", "")
    for entity, character in ENTITIES.items():
        text = F.regexp_replace(text, entity, character)
    return _strip(text)


def page_fields(
    df: DataFrame, html_col: str = "html", fields: Mapping[str, str] = PAGE_FIELDS, required: str = "title"
) -> DataFrame:
    """Add flat text fields, '' when absent; a page without the required one is dropped."""
    found = {name: plain_text(F.regexp_extract("_visible", pattern, 1)) for name, pattern in fields.items()}
    visible = df.withColumn("_visible", visible_html(F.col(html_col)))
    return add_once(visible, found).drop("_visible").where(F.col(required) != "")


def page_links(df: DataFrame, html_col: str = "html", pattern: str = LINK) -> DataFrame:
    """Add ``links``: the addresses of a page in order, [] when there are none."""
    return df.withColumn("links", F.regexp_extract_all(visible_html(F.col(html_col)), F.lit(pattern), F.lit(1)))


def page_key_values(df: DataFrame, html_col: str = "html") -> DataFrame:
    """Add ``key_values``: label -> address of the list items; the last of equal labels wins."""
    items = F.regexp_extract_all(visible_html(F.col(html_col)), F.lit(LIST_ITEM), F.lit(1))
    entries = F.transform(items, lambda i: F.struct(plain_text(i), F.regexp_extract(i, LINK, 1)))
    return df.withColumn("key_values", F.map_from_entries(entries))


def page_fill_rate(df: DataFrame, html_col: str = "html", fields: Mapping[str, str] = PAGE_FIELDS) -> DataFrame:
    """One row: number of pages and the share of them with each field and with links."""
    shares = {name: plain_text(F.regexp_extract("_visible", pattern, 1)) != "" for name, pattern in fields.items()}
    shares["links"] = F.regexp_count("_visible", F.lit(LINK)) > 0
    return df.select(visible_html(F.col(html_col)).alias("_visible")).agg(
        F.count(F.lit(1)).alias("n_pages"), *[F.avg(c.cast("int")).alias(f"share_{n}") for n, c in shares.items()]
    )


def split_key_values(bullets: Column) -> Column:
    """["Weight : 1 kg", ...] -> map, split at the first colon; later parts are trimmed and rejoined."""
    spaced = F.transform(bullets, lambda b: F.trim(F.regexp_replace(b, r"[\s\p{Z}\p{C}]+", " ")))

    def entry(bullet: Column) -> Column:
        parts = F.transform(F.split(bullet, ":", -1), lambda p: F.trim(p))
        return F.struct(F.get(parts, F.lit(0)), F.array_join(F.slice(parts, F.lit(2), F.size(parts)), ":"))

    return F.map_from_entries(F.transform(spaced, entry))


def base_images(urls: Column, prefix: str = IMAGE_PREFIX, suffix: str = IMAGE_SUFFIX) -> Column:
    """Product image addresses rewritten to their base size."""
    kept = F.filter(urls, lambda u: u.startswith(prefix) & u.endswith(suffix))

    def rewrite(url: Column) -> Column:
        name = F.substring_index(F.substring_index(url, "/", -1), ".", 1)
        return F.concat(F.lit(prefix), name, F.lit(".jpg"))

    return F.transform(kept, rewrite)


# --- sections --------------------------------------------------------------------------------------

# A character reference, and the named ones of HTML 4 as the standard library lists them. Those that HTML also knows without the
# semicolon are found where a text was cut off, or goes on.
_LEGACY = "|".join(sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n)))
_REFERENCE = rf"&(?:#[0-9]{{1,7}};?|#[xX][0-9a-fA-F]{{1,6}};?|[A-Za-z][A-Za-z0-9]{{1,7}};|(?:{_LEGACY}))"
_IMAGE = r"""(?is)<img(?=[\s/])[^<>]*?\ssrc\s*=\s*["']([^"'<>]*)["']"""


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def decode_references(text: Column) -> Column:
    """Character references as the characters they stand for, each once; unknown ones stay."""
    return once(text, _decoded)


def _decoded(text: Column) -> Column:
    # One literal that is folded to a map, instead of some five hundred expressions at every use.
    listed = ";".join(f"{name}={chr(code)}" for name, code in name2codepoint.items())
    names = F.str_to_map(F.lit(listed), F.lit(";"), F.lit("="))
    until_next = rf"([^&]*+(?:(?!{_REFERENCE})&[^&]*+)*+)"
    found = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    parts = F.concat(F.array(F.regexp_extract(text, rf"\A{until_next}", 1)), F.regexp_extract_all(text, F.lit(_REFERENCE + until_next), F.lit(1)))

    def character(reference: Column) -> Column:
        inside = F.substring_index(F.substring(reference, F.lit(2), F.length(reference)), ";", 1)
        hexadecimal = F.lower(F.substring(inside, 2, 1)) == "x"
        digits = F.when(hexadecimal, F.conv(F.substring(inside, F.lit(3), F.length(inside)), 16, 10)).otherwise(F.substring(inside, F.lit(2), F.length(inside)))
        code = F.when(inside.startswith("#"), digits.try_cast("int"))
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        encoded = F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD).cast("long")), 8, "0"))
        return F.when(inside.startswith("#"), F.decode(encoded, "UTF-32")).otherwise(F.coalesce(F.try_element_at(names, inside), reference))

    decoded = F.concat(F.array(F.lit("")), F.transform(found, character))
    return F.when(text.contains("&"), F.array_join(F.zip_with(decoded, parts, lambda c, p: F.concat(c, p)), "")).otherwise(text)


def text_of(fragment: Column) -> Column:
    """The text of a fragment: tags removed, references decoded."""
    return decode_references(F.regexp_replace(fragment, r"(?s)<[A-Za-z/!?][^<>]*(?:>|\z)", ""))


def open_tag(selector: tuple) -> str:
    """Pattern of the open tag that a (tag, attribute, value) selector means; a class matches as a whole or by one of its names."""
    tag, attribute, value = selector
    if attribute is None:
        return rf"<{tag}(?=[\s/>])[^<>]*>"
    value = rf"\Q{value}\E"
    quoted = rf"\"{value}\"|'{value}'|{value}(?=[\s/>])"
    if attribute == "class":
        quoted += rf"|\"(?:[^\"<>]*\s)?{value}(?:\s[^\"<>]*)?\"|'(?:[^'<>]*\s)?{value}(?:\s[^'<>]*)?'"
    return rf"<{tag}(?=\s)(?=[^<>]*\s{attribute}\s*=\s*(?:{quoted}))[^<>]*>"


def _inside(tag: str, levels: int = 0) -> str:
    """Pattern of what follows an open tag up to the first tag of its name or the end; over elements of that name, ``levels`` deep."""
    nested = rf"{tag}[\s/>]{_inside(tag, levels - 1)}</{tag}(?=[\s/>])|" if levels else ""
    return rf"[^<]*+(?:<(?:{nested}(?!/?{tag}[\s/>]))[^<]*+)*+"


def _closed(tag: str) -> str:
    """Pattern, with a group, of the inside of an element that holds others of its name two levels deep at most."""
    return rf"(?!</?{tag}(?![\s/>]))({_inside(tag, 2)})(?:</{tag}[\s/>]|\z)"


def until_closed(rest: Column, tag: str) -> Column:
    """What follows an open tag up to its end tag: where tags of its name are balanced, else the end of the page.

    Only tags of that name count, so that elements left open inside do no harm. One pass with a small state; the
    pieces are joined again by position. Most elements hold few of their name, and are one pattern.
    """
    closed = F.regexp_extract_all(rest, F.lit(rf"(?i)\A{_closed(tag)}"), F.lit(1))
    return F.coalesce(F.get(closed, F.lit(0)), _balanced(rest, tag))


def _balanced(rest: Column, tag: str) -> Column:
    pieces = F.regexp_extract_all(rest, F.lit(rf"(?is)(?:</?{tag}(?=[\s/>])|\A.){_inside(tag)}"), F.lit(0))
    state = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, piece: Column) -> Column:
        start = F.lower(F.substring(piece, 1, len(tag) + 2))
        change = F.when(start == f"</{tag}", -1).when(start.startswith(f"<{tag}"), 1).otherwise(0)
        depth, at = s["depth"] + change, s["at"] + 1
        return F.struct(depth.alias("depth"), at.alias("at"), F.when((s["end"] == 0) & (depth == 0), at).otherwise(s["end"]).alias("end"))

    end = lambda p: F.aggregate(p, state, step, lambda s: F.when(s["end"] > 0, s["end"] - 1).otherwise(s["at"]))
    return once(pieces, lambda p: F.array_join(F.slice(p, F.lit(1), end(p)), ""))


def element(html: Column, selector: tuple) -> Column:
    """The inside of the first element that ``selector`` means; NULL without one."""
    tag, opened = selector[0], open_tag(selector)
    first = lambda rest: F.get(F.regexp_extract_all(html, F.lit(f"(?is){opened}{rest}"), F.lit(1)), F.lit(0))
    # '' where the element is empty or holds others of its name deeper.
    closed = first(rf"(?:{_closed(tag)})?+.*")
    return once(closed, lambda c: F.when(c == "", _balanced(first("(.*)"), tag)).otherwise(c))


def elements(html: Column, selector: tuple) -> Column:
    """The insides of all elements that ``selector`` means; one ends at its end tag, or where the next begins."""
    opened = open_tag(selector)
    after = F.regexp_extract_all(html, F.lit(rf"(?is){opened}([^<]*+(?:(?!{opened})<[^<]*+)*+)"), F.lit(1))
    return F.transform(after, lambda rest: until_closed(rest, selector[0]))


def runs(html: Column, tag: str) -> Column:
    """The insides of elements whose end tag is optional (list items, paragraphs): up to the next, or their end tag."""
    opened = rf"<{tag}(?=[\s/>])[^<>]*>"
    return F.regexp_extract_all(html, F.lit(rf"(?i){opened}([^<]*+(?:(?!{opened}|</{tag}[\s>])<[^<]*+)*+)"), F.lit(1))


def page_breadcrumb(html: Column, selector: tuple) -> Column:
    """The parts of a breadcrumb, trimmed; [] without one."""
    parts = F.transform(F.split(text_of(element(html, selector)), "›", -1), _strip)
    return F.coalesce(parts, F.array().cast("array<string>"))


def page_images(html: Column, selector: tuple) -> Column:
    """The base-size addresses of the product images of a section; [] without one."""
    found = F.regexp_extract_all(element(html, selector), F.lit(_IMAGE), F.lit(1))
    return base_images(F.coalesce(found, F.array().cast("array<string>")))


def page_bullets(html: Column, selector: tuple) -> Column:
    """Label -> value of the bullets of a section; an empty map without one."""
    bullets = F.transform(runs(element(html, selector), "li"), text_of)
    return split_key_values(F.coalesce(bullets, F.array().cast("array<string>"))).cast(TEXT_MAP)


def page_information(html: Column, section: tuple, block: tuple) -> Column:
    """Heading -> paragraphs of the blocks of a section; blocks without a heading are left out."""
    def entry(b: Column) -> Column:
        paragraphs = F.array_join(F.transform(runs(b, "p"), text_of), "")
        return F.struct(_strip(text_of(element(b, ("span", None, None)))).alias("key"), _strip(paragraphs).alias("value"))

    blocks = F.coalesce(elements(element(html, section), block), F.array().cast("array<string>"))
    return F.map_from_entries(F.filter(F.transform(blocks, entry), lambda e: e["key"].isNotNull())).cast(TEXT_MAP)


def own_text(fragment: Column) -> Column:
    """The text of a fragment outside the elements in it."""
    return _strip(text_of(F.regexp_replace(fragment, r"(?is)<([a-z][a-z0-9]*)(?=[\s>])[^<>]*>[^<]*</\1\s*>", "")))


def page_rating(html: Column, at: Mapping[str, tuple]) -> Column:
    """Headline score and label -> share; NULL if any part is missing."""
    def rated(box: Column) -> Column:
        rows = F.transform(
            runs(element(box, at["histogram_table"]), "li"),
            lambda li: F.struct(own_text(element(li, at["histogram_label"])).alias("key"), own_text(element(li, at["histogram_share"])).alias("value")),
        )
        return once(text_of(element(box, at["histogram_score"])), lambda score: once(rows, lambda r: parts(score, r)))

    def parts(score: Column, rows: Column) -> Column:
        whole = score.isNotNull() & F.forall(rows, lambda r: r["key"].isNotNull() & r["value"].isNotNull())
        return F.when(whole, F.struct(score.alias("score"), F.map_from_entries(F.filter(rows, lambda r: r["key"].isNotNull())).cast(TEXT_MAP).alias("dist")))

    return once(element(html, at["histogram"]), rated)


def page_comments(html: Column, at: Mapping[str, tuple]) -> Column:
    """The comments of the review list, in order; [] without one. The date is what follows the last "on"."""
    or_empty = lambda text: F.coalesce(_strip(text), F.lit(""))

    def comment(li: Column) -> Column:
        return once(element(li, at["review_title"]), lambda title: parts(li, title))

    def parts(li: Column, title: Column) -> Column:
        return F.struct(
            or_empty(F.substring_index(text_of(element(li, at["review_date"])), "on", -1)).alias("date"),
            _strip(text_of(F.try_element_at(elements(title, ("span", None, None)), F.lit(-1)))).alias("title"),
            _strip(text_of(element(title, at["review_score"]))).alias("score"),
            or_empty(text_of(element(li, at["review_text"]))).alias("text"),
            F.coalesce(F.split_part(_strip(text_of(element(li, at["review_votes"]))), F.lit(" "), F.lit(1)), F.lit("0")).alias("helpfulness"),
        )

    comments = F.transform(runs(element(html, at["reviews"]), "li"), comment)
    return F.coalesce(comments, F.array().cast(ArrayType(COMMENT)))


def extract_pages(df: DataFrame, html_col: str = "html", selectors: Mapping[str, tuple] = PRODUCT) -> DataFrame:
    """Product documents from raw pages; the other columns of ``df`` are kept, pages without a product title dropped."""
    at = dict(selectors)
    others = [c for c in df.columns if c != html_col]
    visible = add_once(df.select(*others, F.col(html_col).alias("_html")), {html_col: visible_html(F.col("_html"))}).drop("_html")
    titled = add_once(visible, {"_title": text_of(element(F.col(html_col), at["title"]))}).where(F.col("_title").isNotNull())
    html = F.col(html_col)
    or_empty = lambda name: F.coalesce(_strip(text_of(element(html, at[name]))), F.lit(""))
    return titled.select(
        *others,
        _strip(F.col("_title")).alias("product_title"),
        or_empty("byline").alias("byline_info"),
        or_empty("description").alias("product_description"),
        page_breadcrumb(html, at["breadcrumb"]).alias("category"),
        page_images(html, at["images"]).alias("alt_images"),
        page_bullets(html, at["bullets"]).alias("product_detail"),
        page_information(html, at["information"], at["information_section"]).alias("important_information"),
        page_rating(html, at).alias("rating"),
        page_comments(html, at).alias("top_comments"),
    )
