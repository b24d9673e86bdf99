"""The whole corpus pipeline against a plain-Python version, on planted copies, passages, insults and personal data."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from random import Random

import pytest

import corpus_pipeline
from criticlens.llm import neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(random, n):
    """Sentences of invented words that no two documents share."""
    words = ["".join(random.choices("abcdefghijklmnoprstuvwz", k=random.randint(3, 9))) for _ in range(n)]
    return " ".join(w + ("." if k % 11 == 10 else "") for k, w in enumerate(words))


def edited(text, share, random):
    words = text.split()
    for i in random.sample(range(len(words)), int(share * len(words))):
        words[i] = f"new{random.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    random = Random(17)
    items = {k: prose(random, 60) for k in range(4)}
    docs, kinds = {}, {}

    def add(kind, text, source="web"):
        docs[len(docs)] = (text, source)
        kinds[len(docs) - 1] = kind

    for k in range(60):
        add("clean", prose(random, random.randint(25, 300)), ["web", "books", "wiki", None][k % 4])
    for k in range(0, 40, 4):
        add("copy", docs[k][0], "books")
    for k in range(1, 40, 4):
        text = docs[k][0]
        if len(text.split()) > 100:
            add("near", edited(text, 0.01, random), "wiki")  # about 0.9 of the five-word runs stay
            add("far", edited(text, 0.2, random), "wiki")
    for item in items.values():
        words = item.split()
        add("leak", f"{prose(random, 40)} {item} {prose(random, 40)}")
        add("leak", " ".join([*words[30:], "between", "both", *words[:30]]))
        add("clean", f"{prose(random, 80)} {' '.join(words[:6])}")
    for k in range(6):
        add("toxic", f"{prose(random, 20)} You are a stupid idiot. You are a pathetic moron and I will kill you. {prose(random, 20)}")
    add("private", f"write to jo.{prose(random, 1)}@example.org or 10.1.2.3 {prose(random, 40)}")
    add("private", f"pay 4111 1111 1111 1111 or call +49 30 123456789 today {prose(random, 40)}")
    add("clean", "")
    add("clean", None)
    return docs, kinds, items


def plain_near(docs):
    """One document of each class of texts whose five-word runs are 0.8 alike, the one with the smallest id."""
    runs = {}
    for d, (text, _) in docs.items():
        words = re.findall(r"[^\W_]+", (text or "").lower())
        runs[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {d}
    first = {}
    for d in sorted(docs):
        first[d] = min((first[e] for e in first if len(runs[d] & runs[e]) >= 0.8 * len(runs[d] | runs[e])), default=d)
    return {d: docs[d] for d in docs if first[d] == d}


def plain_leaks(docs, items):
    """Documents of which runs of eight words or more cover 60 % of an item."""
    kept = {}
    for d, (text, source) in docs.items():
        words = re.findall(r"\w+", (text or "").lower())
        have = {tuple(words[i : i + 8]) for i in range(len(words) - 7)}
        for item in items.values():
            x = re.findall(r"\w+", item.lower())
            covered = {j for i in range(len(x) - 7) if tuple(x[i : i + 8]) in have for j in range(i, i + 8)}
            if len(covered) >= 0.6 * len(x):
                break
        else:
            kept[d] = (text, source)
    return kept


def plain_private(text):
    for kind, rule in (("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("IP", r"[0-9]+(?:\.[0-9]+){3}"),
                       ("PHONE", r"\+[0-9][\x20().0-9-]+[0-9]"), ("CARD", r"[0-9](?:[\x20-]?[0-9]){12,18}")):
        text = re.sub(rule, f"<{kind}>", text) if text else text
    return text


def plain_mix(docs):
    """taken per document: water-filling of 150 % by weights 5, 2, 1, each source at most twice; whole copies, then slots in order."""
    size = {d: len(WORD.findall(t or "")) for d, (t, _) in docs.items()}
    sources = sorted({s for _, s in docs.values()}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    total = {s: sum(size[d] for d in docs if docs[d][1] == s) for s in sources}
    target, free, left = {}, set(sources), 1.5 * sum(total.values())
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 2 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        free -= over
    target |= {s: weight[s] * level for s in free}
    taken = {}
    for s in sources:
        slots = defaultdict(list)
        for d in docs:
            if docs[d][1] == s:
                slots[int(hashlib.md5(f"mix{d}".encode()).hexdigest()[:3], 16)].append(d)
        whole = math.floor(target[s] / total[s]) if total[s] else 0
        rest, run = target[s] - whole * total[s], 0
        for k in sorted(slots):
            n = sum(size[d] for d in slots[k])
            part = min(1.0, max(0.0, (rest - run) / n)) if n else 0.0
            run += n
            taken |= {d: whole * size[d] + math.floor(size[d] * part + 0.5) for d in slots[k]}
    return target, taken


def test_run_equals_plain_python(spark, corpus, tmp_path):
    docs, kinds, items = corpus
    rows = [(d, t, "en", s, len(t or "")) for d, (t, s) in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(d, 1, int(kinds[d] == "toxic")) for d in docs if d % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    want = {d: x for d, x in docs.items() if kinds[d] != "toxic"}
    want = plain_leaks(plain_near(want), items)
    assert not {kinds[d] for d in want} & {"copy", "near", "leak", "toxic"} and {"clean", "far", "private"} <= {kinds[d] for d in want}
    want = {d: (plain_private(t), s) for d, (t, s) in want.items()}
    target, taken = plain_mix(want)
    assert {d: n for d, n in taken.items() if n} == {d: r["taken"] for d, r in found.items()}
    for d, r in found.items():
        assert (r["text"], r["source"]) == want[d] and math.isclose(r["target"], target[want[d][1]])
        assert r["n_chars"] == len(r["text"])


def test_one_id_with_different_texts(spark):
    """Rows are judged by their text, so an unrelated text under the same id stays."""
    random = Random(5)
    a, b, c = (prose(random, 80) for _ in range(3))
    rows = [(1, a), (1, b), (2, c), (2, a), (3, b), (3, b), (None, a), (4, None), (4, ""), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter((r["doc_id"], r["text"]) for r in neardup.drop_near_duplicates(df).collect())
    assert kept == Counter([(1, a), (1, b), (2, c), (None, a), (4, None), (4, "")])
    classes = Counter((r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(df).collect())
    assert classes == Counter([(1, 1), (1, 1), (2, 2), (2, 1), (3, 1), (3, 1), (None, None), (4, 4), (4, 4), (4, 4)])
