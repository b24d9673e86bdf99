"""Main text of web pages by differencing each page against its nearest neighbours by URL.

A page is a list of text lines (its blocks). Pages are sorted by host and path; a page is
paired with its neighbours of the same host. The lines are aligned by longest common subsequence, on line hashes. Outside
``<article>`` and ``<main>``, lines shared with the mate that has the longer path prefix in common are template and go. Inside, a
line goes only if it is shared with the mates on both sides, or, where there is one mate, stands at the same place from the
beginning or the end of its article, for one shared sentence may be a quotation; and where more than half of the characters inside
would go, the mate is a copy of the article and all of them stay.

Markup is weak evidence. Scripts, styles and the head are never text. Menus, headers, footers, sidebars, forms and
elements whose role, class or id says so (by whole names: ``sidebar`` or ``cookie-banner``, not ``no-sidebar``) are dropped with all
they hold, unless that is the page's principal element (``<main>``, else the longest ``<article>`` that is no comment or teaser) or more than ``LARGEST`` of its text: such an
element is a wrapper, or was never closed. A dropped element ends with its parent. A ``<header>`` inside the article stays.

Sorting by range spreads a host with a third of all pages; what is sorted are line hashes, not pages. The line hashes of a page
are written once; the marks meet them by the hash of all lines, hot ones split. A page is parsed twice, for its hashes and for its
text: texts written in between would cost more disk than that saves.

Defined results: NULL and empty html give an empty text; NULL urls form one host of their own; pages
of a host with the same lines are one page to the pairing, and all get its result; a page without a mate keeps all its lines; repeated
rows get the same text; broken markup is read as far as it goes; an empty table gives an empty result. Only page_id, url and
html are read.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from criticlens.llm.ordered import with_neighbours
from criticlens.llm.urls import url_host, url_path
from criticlens.llm.words import ship
from criticlens.operators.joins import hot_keys, lookup_join
from criticlens.session import stage

# How elements are read.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "td tfoot th thead title tr ul".split()
)
_RAW = frozenset("script style noscript template iframe textarea title svg math object canvas".split())
_SKIP = frozenset("head nav header footer aside form menu dialog button select".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTENT = frozenset(["article", "main"])
#: Elements that are followed while they are open; of others only those that look like boilerplate.
_NESTING = frozenset("article aside body button dialog div footer form header html main menu nav ol section select table ul".split()) | {"head"}
# What a class or id must say for an element not to be text, and what may stand beside it in a compound name.
_HINTS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination "
    "popup promo promos promotion promotions rail recommended related replies respond search share sharing sidebar signup social "
    "sponsor sponsored subscribe toolbar widget".split()
)
#: Hints of elements that may hold articles of their own: comments and teasers.
_LISTS = frozenset("comment comments commentlist disqus recommended related replies respond".split())
_BESIDE = frozenset("area bar bottom box block container form global head inner item items left links list main page primary right section secondary side site slot top unit wrap wrapper".split())
#: An element with more than this share of the text of its page is not dropped for its name.
LARGEST = 0.5
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
#: With more pairs of places for one line, the alignment goes by halves, in linear space.
_MANY = 4096

def _named(value: str, hints: frozenset[str] = _HINTS) -> bool:
    """Whether a name of a class or id is a hint, alone or with words that may stand beside it."""
    for name in value.lower().split():
        parts = [p for p in re.split(r"[-_]+", name) if p]
        if any(p in hints for p in parts) and all(p in _HINTS or p in _BESIDE for p in parts):
            return True
    return False


def _boilerplate(name: str, attributes: str, inside: bool) -> bool:
    if name in _SKIP:
        return not (inside and name == "header")
    if name in ("html", "body") or not attributes:
        return False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        value = a or b or c
        if key.lower() == "role":
            if value.lower() in _ROLES:
                return True
        elif name not in _CONTENT and _named(value):
            return True
    return False


def page_lines(page: str | None) -> list[tuple[str, bool]]:
    """The text blocks of a page outside boilerplate elements, and whether each is in the article."""
    if not page:
        return []
    lines: list[tuple[str, bool, int]] = []  # with the innermost open element
    parent, doubtful, listed, length = [-1], [False], [False], [0]
    principal: list[tuple[bool, int]] = []  # <main> or not, element
    stack, at, content = [("", 0)], 0, 0
    open_names: Counter = Counter()
    block: list[str] = []
    pos, n = 0, len(page)

    def close() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(block))).strip()
        block.clear()
        if text:
            lines.append((text, content > 0, at))
            length[at] += len(text)

    while pos < n:
        start = page.find("<", pos)
        if start < 0:
            start = n
        if start > pos:
            block.append(page[pos:start])
        if start == n:
            break
        tag = _TAG.match(page, start)
        if not tag:
            # Not the start of a tag, so part of the text.
            block.append("<")
            pos = start + 1
            continue
        pos = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        closing, attributes = tag[1], tag[3] or ""
        if name in _RAW:
            if not closing:
                pos = _raw_end(page, name, pos)
            continue
        if name in _BLOCKS:
            close()
        elif name == "br":
            block.append(" ")
        if name in _VOID or name not in _NESTING and not _ATTRIBUTE.search(attributes) and not closing:
            continue
        if closing:
            if not open_names[name]:
                continue
            close()
            while True:
                gone = stack.pop()
                open_names[gone[0]] -= 1
                content -= gone[0] in _CONTENT
                if gone[0] == name:
                    break
            at = stack[-1][1]
        elif not attributes.endswith("/"):
            boilerplate = _boilerplate(name, attributes, content > 0)
            if name not in _NESTING and not boilerplate:
                continue
            close()
            parent.append(at)
            doubtful.append(boilerplate)
            listed.append(listed[at] or any(_named(a or b or c, _LISTS) for k, a, b, c in _ATTRIBUTE.findall(attributes) if k.lower() != "role"))
            length.append(0)
            at = len(parent) - 1
            stack.append((name, at))
            open_names[name] += 1
            if name in _CONTENT:
                content += 1
                if not listed[at]:
                    principal.append((name == "main", at))
    close()

    for e in range(len(parent) - 1, 0, -1):
        length[parent[e]] += length[e]
    holds = set()
    if principal:
        e = max(principal, key=lambda x: (x[0], length[x[1]], -x[1]))[1]
        while e >= 0:
            holds.add(e)
            e = parent[e]
    dropped = [False] * len(parent)
    for e in range(1, len(parent)):
        dropped[e] = dropped[parent[e]] or (doubtful[e] and e not in holds and length[e] <= LARGEST * length[0])
    return [(text, inside) for text, inside, e in lines if not dropped[e]]


def _raw_end(page: str, name: str, pos: int) -> int:
    end = re.compile(rf"</{name}\s*>", re.I).search(page, pos)
    return end.end() if end else len(page)


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """Length of a longest common subsequence of ``a`` and each prefix of ``b``; one bit per place of ``b``."""
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every
    for x in a:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & every
    return [0, *accumulate(c == "0" for c in f"{row:0{len(b)}b}"[::-1])] if b else [0]


def _by_halves(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence, by Hirschberg's halving."""
    if len(a) < 2 or not b:
        return [i for i, x in enumerate(a) if x in b]
    half = len(a) // 2
    left, right = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])
    k = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
    return [*_by_halves(a[:half], b[:k]), *(half + i for i in _by_halves(a[half:], b[k:]))]


def common(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``.

    Equal ends are taken off first; the rest is the longest increasing run over pairs of equal lines.
    If a line has very many such pairs, the rest is aligned by halves.
    """
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places: dict[int, list[int]] = {}
    for j in range(head, len(b) - tail):
        places.setdefault(b[j], []).append(j)
    own = Counter(a[head : len(a) - tail])
    if any(n * len(places.get(x, ())) > _MANY for x, n in own.items()):
        middle = _by_halves(a[head : len(a) - tail], b[head : len(b) - tail])
        return [*range(head), *(head + i for i in middle), *range(len(a) - tail, len(a))]
    ends: list[int] = []
    chain: list[tuple[int, int]] = []
    last: list[int] = []
    for i in range(head, len(a) - tail):
        js = places.get(a[i])
        if not js:
            continue
        for j in reversed(js):
            at = bisect_left(ends, j)
            chain.append((i, last[at - 1] if at else -1))
            if at == len(ends):
                ends.append(j)
                last.append(len(chain) - 1)
            else:
                ends[at] = j
                last[at] = len(chain) - 1
    middle = []
    k = last[-1] if last else -1
    while k >= 0:
        middle.append(chain[k][0])
        k = chain[k][1]
    return [*range(head), *middle[::-1], *range(len(a) - tail, len(a))]


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def template(path: str, lines: list[int], inside: list[bool], mates: list[tuple[str, list[int], list[bool]]]) -> list[int]:
    """Positions of the lines that are template, by the mates whose lines are not all the same."""
    fitting = sorted((m for m in mates if m[1] != lines), key=lambda m: -_prefix(path, m[0]))
    if not fitting:
        return []
    shared = [set(common(lines, m[1])) for m in fitting]
    gone = {k for k in shared[0] if not inside[k]}
    within = [k for k, here in enumerate(inside) if here]
    if len(fitting) > 1:
        return sorted(gone | {k for k in within if all(k in s for s in shared)})
    other = [x for x, here in zip(fitting[0][1], fitting[0][2]) if here]
    for n, k in enumerate(within):
        from_end = len(within) - n
        same = (n < len(other) and other[n] == lines[k]) or (from_end <= len(other) and other[-from_end] == lines[k])
        if k in shared[0] and same:
            gone.add(k)
    return sorted(gone)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Line hashes and whether the lines are inside per page, and one hash of its host and them all."""
    for batch in batches:
        read = [page_lines(p) for p in batch["html"].to_pylist()]
        hashes = [[xxhash.xxh3_64_intdigest(t) - (1 << 63) for t, _ in x] for x in read]
        inside = [[i for _, i in x] for x in read]
        same = [xxhash.xxh3_128_digest(repr(x)) for x in zip(batch["host"].to_pylist(), hashes, inside)]
        columns = [pa.array(hashes, pa.list_(pa.int64())), pa.array(inside, pa.list_(pa.bool_())), pa.array(same, pa.binary())]
        yield pa.record_batch([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], "lines", "inside", "same"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            mates = [(m["path"], m["lines"], m["inside"]) for m in (row["_before"], row["_after"]) if m and m["host"] == row["host"]]
            found.append(template(row["path"], row["lines"], row["inside"], mates))
        yield pa.record_batch([batch["same"], pa.array(found, pa.list_(pa.int32()))], names=["same", "_shared"])


def main_lines(lines: list[tuple[str, bool]], shared: list[int]) -> list[str]:
    """The lines that are not template; all lines inside the article if the mate is a copy of it."""
    gone = set(shared)
    inside = {k: len(t) for k, (t, within) in enumerate(lines) if within}
    if 2 * sum(n for k, n in inside.items() if k in gone) > sum(inside.values()):
        gone -= inside.keys()
    return [t for k, (t, _) in enumerate(lines) if k not in gone]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = ["\n".join(main_lines(page_lines(page), shared or [])) for page, shared in zip(batch["html"].to_pylist(), batch["_shared"].to_pylist())]
        yield pa.record_batch(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def page_key() -> Column:
    """Tells rows of one page_id apart; equal rows share a key."""
    return F.xxhash64("url", "html")


def template_lines(pages: DataFrame) -> DataFrame:
    """_page, _key and _shared: the positions of the lines of a page that are template."""
    kind = pages.schema["page_id"].dataType.simpleString()
    narrow = pages.select("page_id", page_key().alias("_key"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "html")
    lines = "lines array<long>, inside array<boolean>, same binary"
    read = stage(narrow.mapInArrow(_read, f"page_id {kind}, _key long, host string, path string, {lines}"))
    # Equal pages would be each other's mates: the first of them stands for all.
    unlike = read.groupBy("same").agg(F.first("host").alias("host"), F.min("path").alias("path"), F.first("lines").alias("lines"), F.first("inside").alias("inside"))
    paired = with_neighbours(unlike, ["host", "path", "same"], ["host", "path", "lines", "inside"])
    marks = paired.mapInArrow(_align, "same binary, _shared array<int>")
    pages_of = read.select("same", F.col("page_id").alias("_page"), "_key").distinct()
    hot = hot_keys(read.groupBy("same").agg(F.count(F.lit(1)).alias("n")), "same")
    return lookup_join(pages_of, marks, "same", hot).select("_page", "_key", "_shared")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages``."""
    kind = pages.schema["page_id"].dataType.simpleString()
    marks = template_lines(pages)
    rows = pages.select("page_id", "url", "html", page_key().alias("_row"))
    joined = rows.join(marks, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_row") == F.col("_key")), "left")
    return joined.select("page_id", "url", "html", "_shared").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")


ship(__name__)
