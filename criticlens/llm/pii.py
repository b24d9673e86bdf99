"""Personal data by fixed rules and a semi-Markov conditional random field.

The base rules find emails, IP addresses, card and phone numbers, leftmost and without overlap within a
kind. The model looks at the segments that the rules do not take: looser candidates (obfuscated
addresses, numbers in other shapes) are scored as whole spans, by features of the whole span and
of the words around it. Candidates that touch form a cluster; a dynamic programme over their
boundaries finds the best set of disjoint typed segments, or none. A segment is at most
``MAX_SPAN`` characters; a text may be of any length.

The weights maximise the likelihood of labelled snippets (distant supervision; the partition function is the same
dynamic programme with sums). Snippets come from at most ``SAMPLE`` documents, the first by a hash of the id, and at most
``SNIPPETS`` clusters of each, with ``MARGIN`` characters around. Their labels are the base spans; each base span is also
rewritten the way people write such data past the rules (other separators, spelt-out signs, no plus), which keeps its label, and
into look-alikes that lose it (a wrong check digit, an octet above 255, a bare number), so that the model learns shapes and contexts
instead of the rules themselves. Everything else reads every text in full. Base spans always stay; a
model span is added only where no base span is.

Defined results: NULL and empty texts have no spans; spans of different kinds may overlap when the base rules
say so; repeated rows are treated alike; an empty table gives an empty result. Offsets are code points, the end is exclusive. Only
doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from criticlens.llm.words import ship

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 2000
SNIPPETS = 16
MARGIN = 40
MAX_SPAN = 80
EPOCHS = 6

# The base rules.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Looser candidates of the model.
_AT_WORD = re.compile(r"[A-Za-z0-9._%+-]{1,40} ?[(\[{]at[)\]}] ?[A-Za-z0-9-]{1,30}(?: ?(?:\.|[(\[{]dot[)\]}]) ?[A-Za-z0-9-]{1,30}){1,4}", re.I)
_AT_SIGN = re.compile(r"[(\[{]at[)\]}]", re.I)
_NUMBER = re.compile(r"(?<![0-9])[+(]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,24}(?![0-9])")
_GROUPS = re.compile(r"[0-9]+")
# Words before a span that hint at its kind.
_HINTS = {
    "email": ("mail", "e-mail", "contact", "write"),
    "ip": ("ip", "host", "address", "server"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "telefon", "téléphone", "teléfono"),
}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at)
        start = at
        if found:
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
        if found and start < at:
            yield "email", start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[Span]:
    """The spans of the base rules, by kind as listed, then by start."""
    if not text:
        return []
    spans = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            # Longer than three digits after leading zeros is above 255.
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                spans.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(digits := "".join(_GROUPS.findall(m[0]))) <= 19 and luhn(digits):
                spans.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(len, _GROUPS.findall(m[0]))) <= 15:
                    spans.append(("phone", m.start(), m.end()))
    return spans


def candidates(text: str) -> list[tuple[int, int]]:
    """Segments that the model may take; every segment is at most ``MAX_SPAN`` long."""
    found = set()
    if "@" in text:
        found.update((s, e) for _, s, e in _emails(text) if e - s <= MAX_SPAN)
    if _AT_SIGN.search(text):
        found.update(m.span() for m in _AT_WORD.finditer(text) if m.end() - m.start() <= MAX_SPAN)
    for m in _NUMBER.finditer(text):
        start, end = m.span()
        if end - start > MAX_SPAN:
            continue
        found.add((start, end))
        # Parts of the run that begin or end at a space or a bracket.
        cuts = [start] + [start + g.start() for g in _GROUPS.finditer(m[0]) if g.start() and m[0][g.start() - 1] in " ("]
        ends = [start + g.end() for g in _GROUPS.finditer(m[0]) if g.end() < end - start and m[0][g.end()] == " "] + [end]
        found.update((a, b) for a in cuts for b in ends if 7 <= b - a)
    return sorted(found)


def features(text: str, start: int, end: int, kind: str) -> list[str]:
    """Names of the features of a whole segment as ``kind``."""
    piece = text[start:end]
    groups = _GROUPS.findall(piece)
    digits = "".join(groups)
    n = len(digits)
    size = "none" if not n else "few" if n < 9 else "9-12" if n < 13 else "13-15" if n < 16 else "16" if n == 16 else "17-19" if n < 20 else "many"
    seps = "".join(sorted(set(c for c in piece if not c.isalnum() and not c.isspace())))[:6]
    names = [
        "bias",
        f"size={size}",
        f"groups={min(len(groups), 6)}",
        f"signs={seps}",
        f"plus={piece[:1] == '+'}",
        f"bracket={piece[:1] == '('}",
        f"luhn={n >= 13 and luhn(digits)}&{size}",
        f"octets={len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)}&{seps}",
        f"letters={any(c.isalpha() for c in piece)}",
        f"at={'@' in piece or bool(_AT_SIGN.search(piece))}",
        f"signs={seps}&{size}&groups={min(len(groups), 6)}",
        f"zeros={digits[:2] == '00'}&{size}",
        f"left={text[start - 1 : start] in ('', ' ', chr(10), ':', '(')}",
        f"right={text[end : end + 1] in ('', ' ', chr(10), '.', ',', ')')}",
    ]
    before = text[max(0, start - 24) : start].lower()
    if any(word in before for word in _HINTS[kind]):
        names.append("hint")
    return [f"{kind}:{name}" for name in names]


def clusters(spans: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Sorted segments in groups that overlap."""
    groups: list[list[tuple[int, int]]] = []
    reach = -1
    for span in spans:
        if span[0] >= reach:
            groups.append([])
        groups[-1].append(span)
        reach = max(reach, span[1])
    return groups


class SpanModel:
    """The weights of the field; segments outside every entity weigh nothing."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def weight(self, names: list[str]) -> float:
        return sum(self.weights.get(n, 0.0) for n in names)

    def best(self, text: str, group: list[tuple[int, int]]) -> list[Span]:
        """The most likely set of disjoint typed segments of a cluster."""
        ends = sorted({p for span in group for p in span})
        at = {p: k for k, p in enumerate(ends)}
        score, back = [0.0] * len(ends), [None] * len(ends)
        by_end: dict[int, list[tuple[int, int]]] = {}
        for span in group:
            by_end.setdefault(span[1], []).append(span)
        for k, p in enumerate(ends):
            if k:
                score[k] = score[k - 1]
            for start, end in by_end.get(p, ()):
                for kind in KINDS:
                    total = score[at[start]] + self.weight(features(text, start, end, kind))
                    if total > score[k]:
                        score[k], back[k] = total, (kind, start, end)
        spans, k = [], len(ends) - 1
        while k > 0:
            if back[k]:
                spans.append(back[k])
                k = at[back[k][1]]
            else:
                k -= 1
        return spans[::-1]

    def gradient(self, options: list[tuple[int, int, str, list[str]]], gold: set[Span]) -> dict[str, float]:
        """Observed minus expected features of one cluster."""
        ends = sorted({p for o in options for p in o[:2]})
        at = {p: k for k, p in enumerate(ends)}
        weights = [math.exp(min(30.0, max(-30.0, self.weight(o[3])))) for o in options]
        ahead, behind = [1.0] * len(ends), [1.0] * len(ends)
        order = sorted(range(len(options)), key=lambda i: options[i][1])
        place = 0
        for k in range(1, len(ends)):
            ahead[k] = ahead[k - 1]
            while place < len(order) and at[options[order[place]][1]] == k:
                o = order[place]
                ahead[k] += ahead[at[options[o][0]]] * weights[o]
                place += 1
        order.sort(key=lambda i: -options[i][0])
        place = 0
        for k in range(len(ends) - 2, -1, -1):
            behind[k] = behind[k + 1]
            while place < len(order) and at[options[order[place]][0]] == k:
                o = order[place]
                behind[k] += behind[at[options[o][1]]] * weights[o]
                place += 1
        slope: dict[str, float] = {}
        for (start, end, kind, names), w in zip(options, weights):
            expected = ahead[at[start]] * w * behind[at[end]] / ahead[-1]
            step = ((kind, start, end) in gold) - expected
            if abs(step) > 1e-6:
                for name in names:
                    slope[name] = slope.get(name, 0.0) + step
        return slope

    def added(self, text: str | None, base: list[Span]) -> list[Span]:
        """Spans of the model that meet no base span."""
        if not text or not ("@" in text or "at" in text.lower() or _DIGIT.search(text)):
            return []
        free, taken = [], sorted((s, e) for _, s, e in base)
        reach = list(accumulate((e for _, e in taken), max))
        for span in candidates(text):
            # Base spans that begin before this one ends, and the furthest end among them.
            k = bisect_left(taken, (span[1], -1))
            if not k or reach[k - 1] <= span[0]:
                free.append(span)
        return [found for group in clusters(free) for found in self.best(text, group)]

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """The base spans, and all spans by kind as listed, then by start."""
        base = base_spans(text)
        more = self.added(text, base)
        return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if more else base


def rewritten(kind: str, piece: str, turn: int) -> tuple[str, str]:
    """A base span as people write it past the rules, and a look-alike that is none; ``turn`` picks the way."""
    digits = _GROUPS.findall(piece)
    whole = "".join(digits)
    if kind == "email":
        at = (" (at) ", "[at]", " [AT] ", "(at)")[turn % 4]
        dot = (".", " [dot] ", " (dot) ", "[dot]")[turn // 4 % 4]
        local, domain = piece.split("@", 1)
        return f"{local}{at}{domain.replace('.', dot)}", f"{local} at {domain.split('.')[0]}"
    if kind == "ip":
        wrong = [*digits[:-1], str(256 + turn % 700)]
        return ("-", " . ", "/")[turn % 3].join(digits).replace(" . ", ". "), ".".join(wrong)
    if kind == "card":
        groups = [whole[k : k + 4] for k in range(0, len(whole), 4)]
        other = whole[:-1] + str((int(whole[-1]) + 1 + turn % 9) % 10)
        return (".", " - ", "/", "  ")[turn % 4].replace(" - ", " -").join(groups), (other, " ".join(other[k : k + 4] for k in range(0, len(other), 4)))[turn % 2]
    cut = (whole[:2], whole[2:5], whole[5:])
    ways = (f"00{cut[0]} {cut[1]} {cut[2]}", f"({cut[0]}) {cut[1]}-{cut[2]}", f"0{cut[1]}/{cut[2]}", f"({cut[0]}{cut[1]}) {cut[2]}")
    return ways[turn % 4], (whole, f"{whole[:4]}-{whole[4:6]}-{whole[6:8]}", f"{whole[:3]}.{whole[3:]}")[turn % 3]


def snippets(text: str, most: int = SNIPPETS) -> list[str]:
    """The surroundings of the first clusters of candidates and base spans of a text."""
    spans = sorted({*candidates(text), *((s, e) for _, s, e in base_spans(text) if e - s <= MAX_SPAN)})
    return [text[max(0, group[0][0] - MARGIN) : max(e for _, e in group) + MARGIN] for group in clusters(spans)[:most] if group[-1][1] - group[0][0] <= 4 * MAX_SPAN]


def examples(texts: list[str]) -> list[tuple[str, set[Span]]]:
    """Labelled texts: each as it is, and with each of its base spans rewritten, once to a span and once to none."""
    found = []
    for k, text in enumerate(texts):
        gold = base_spans(text)
        found.append((text, set(gold)))
        for n, (kind, s, e) in enumerate(gold):
            if any(s < e2 and s2 < e for _, s2, e2 in gold[:n] + gold[n + 1 :]):
                continue
            for label, piece in zip((True, False), rewritten(kind, text[s:e], 7 * k + n)):
                moved = len(piece) - (e - s)
                other = {(k2, s2 + moved * (s2 >= e), e2 + moved * (s2 >= e)) for k2, s2, e2 in gold if (s2, e2) != (s, e)}
                found.append((text[:s] + piece + text[e:], other | ({(kind, s, s + len(piece))} if label else set())))
    return found


def train(texts: list[str], epochs: int = EPOCHS) -> SpanModel:
    """Maximum likelihood by stochastic steps (AdaGrad) over the clusters of the labelled texts, in order."""
    data = []
    for text, gold in examples(texts):
        for group in clusters(candidates(text)):
            data.append(([(s, e, k, features(text, s, e, k)) for s, e in group for k in KINDS], gold))
    # A segment is no entity unless the data say so.
    model = SpanModel({f"{k}:bias": -3.0 for k in KINDS})
    sums: dict[str, float] = {}
    for _ in range(epochs):
        for options, gold in data:
            for name, g in model.gradient(options, gold).items():
                sums[name] = sums.get(name, 1e-4) + g * g
                model.weights[name] = model.weights.get(name, 0.0) + 0.5 * g / math.sqrt(sums[name])
    return model


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch["doc_id"], pa.array([snippets(t) for t in batch["text"].to_pylist()], pa.list_(pa.string()))], names=["doc_id", "parts"])


def learn(docs: DataFrame, sample: int = SAMPLE) -> SpanModel:
    """Fit the field on snippets of at most ``sample`` documents that hold a digit or an at sign."""
    texts = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("text").rlike("[0-9@]"))
    # The sample is of ids; only snippets of their texts are collected.
    ids = texts.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    ids = ids.select(F.col("doc_id").alias("_id")).distinct()
    chosen = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left_semi").mapInArrow(_cut, "doc_id long, parts array<string>")
    rows = chosen.orderBy("doc_id", F.concat_ws("\n", "parts")).limit(sample).collect()
    return train([t for r in rows for t in r["parts"]])


def span_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """Per row: doc_id, the counts and digest of the base spans, and all spans as text."""
    model = model or learn(docs)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            digests, texts = [], []
            for text in batch["text"].to_pylist():
                base, every = model.spans(text)
                for kind in KINDS:
                    counts[kind].append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(span_text(base).encode()).hexdigest())
                texts.append(span_text(every))
            yield pa.record_batch(
                [batch["doc_id"], *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by the kind of the first."""
    if not spans:
        return text
    out, done = [], 0
    merged: list[list] = []
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        out += [text[done:s], f"<{kind.upper()}>"]
        done = e
    return "".join(out) + text[done:]


def redact_pii(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """The rows of ``docs`` with personal data replaced in ``text``; other columns are unchanged."""
    model = model or learn(docs)
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact(t, model.spans(t)[1]) for t in batch["text"].to_pylist()]
            columns = batch.columns
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(clean, docs.schema)


ship(__name__)
