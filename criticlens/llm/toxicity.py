"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers read the tokens of a clause side by side: insults, threats, targets, negation
and reported speech. Their composition gives each insult or threat a reading (aimed or not, denied or
not, told of somebody else or not), and each reading has a weight; a word list alone would not tell
"you are scum" from "he said nobody is scum".

Lexicon entries are word stems. English seeds are fixed; all others are learned from labelled texts,
as stems whose presence speaks for the label beyond chance, in whatever language the labels cover. The
weights of the readings, and of how dense the matches are, are fitted to the labels by logistic regression around the prior weights.
Fitting reads at most ``SAMPLE`` labelled rows, the first by a hash of the id; counting runs in Spark, and what
reaches the driver is bounded by ``SAMPLE`` and ``MAX_STEMS``. Scoring reads every text in full.

Defined results: NULL, empty and blank texts get the score of a text without a match; without labels
the seeds and prior weights are used; repeated label rows count once, the highest label wins; repeated documents get
equal scores; an empty table gives an empty result. Only doc_id and text are read of the documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from criticlens.llm.words import ship

SAMPLE = 8000
MAX_STEMS = 5000
THRESHOLD = 0.3
STEM_LENGTHS = (3, 10)
NEGATION_REACH = 3
TARGET_REACH = 4
GAIN = 1.0
LEAST_WEIGHT = 3.0

# The words of the grammar.
INSULTS = "idiot moron stupid scum trash loser pathetic worthless disgusting clown imbecile bastard".split()
THREATS = "kill murder hurt destroy strangle beat stab shoot".split()
TARGETS = set(
    "you your yours yourself he she they him her them everyone these those "
    "du dich dir ihr euch er sie tu toi te vous il elle ils elles tú usted ustedes él ella ellos".split()
)
NEGATIONS = set("not no never nobody none neither nor kein keine nicht nie niemals pas jamais aucun nunca nadie ningún".split())
REPORTS = set(
    "said says say told wrote writes called calls quoted quote reported claimed according "
    "sagte sagt schrieb nannte laut dit disait écrit selon dijo dice escribió según".split()
)
SEED_WEIGHT = 4.0
#: Prior weights: bias, then one per reading of a match.
READINGS = ["insult", "insult_aimed", "insult_denied", "insult_reported", "threat_aimed", "threat_other"]
PRIOR = np.array([-4.0, 2.5, 3.0, 0.8, 1.0, 2.5, 0.8, 0.5])
#: Match weight (log odds) that fills a reading; the last feature is the match weight per 1000 characters.
FULL = 16.0

_TOKEN = re.compile(r"\w+|[.!?;:\n\"“”«»]")
_CLAUSE_END = re.compile(r"[.!?;\n]")
_WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Classes of a token; each also comes as a word of reported speech.
KINDS = ("other", "insult", "threat", "target", "negation")


def symbol(kind: str, reports: bool) -> int:
    return 2 * KINDS.index(kind) + reports


class Transducer:
    """A finite-state transducer over token symbols.

    ``follow[s][x]`` is the state after reading x in state s, ``says[s][x]`` what it says of that token; ``states`` names the
    states, by one number per transducer that it was composed of.
    """

    def __init__(self, states: list[tuple[int, ...]], follow: list[list[int]], says: list[list[tuple[int, ...]]]):
        self.states, self.follow, self.says = states, follow, says

    @classmethod
    def of(cls, size: int, follow, says) -> Transducer:
        """From functions of (state, kind, reports)."""
        inputs = [(kind, reports) for kind in KINDS for reports in (False, True)]
        table = lambda f: [[f(s, *x) for x in inputs] for s in range(size)]
        return cls([(s,) for s in range(size)], table(follow), [[(int(y),) for y in row] for row in table(says)])

    def __matmul__(self, other: Transducer) -> Transducer:
        """Both at once: the reachable pairs of states, and what both say."""
        pairs, place = [(0, 0)], {(0, 0): 0}
        follow, says = [], []
        for a, b in pairs:  # grows while it is read
            row = []
            for x, y in zip(self.follow[a], other.follow[b]):
                if (x, y) not in place:
                    place[x, y] = len(pairs)
                    pairs.append((x, y))
                row.append(place[x, y])
            follow.append(row)
            says.append([x + y for x, y in zip(self.says[a], other.says[b])])
        return Transducer([self.states[a] + other.states[b] for a, b in pairs], follow, says)

    def run(self, symbols: list[int]) -> tuple[list[tuple[int, ...]], int]:
        """What it says of each symbol, and the last state."""
        state, said = 0, []
        for x in symbols:
            said.append(self.says[state][x])
            state = self.follow[state][x]
        return said, state


def matcher(kind: str) -> Transducer:
    """Says 1 of the tokens of a kind."""
    return Transducer.of(1, lambda s, k, r: 0, lambda s, k, r: k == kind)


def within(kind: str, reach: int) -> Transducer:
    """Says 1 while a token of the kind was among the last ``reach``; the state is how many tokens that still holds for."""
    return Transducer.of(reach + 1, lambda s, k, r: reach if k == kind else max(s - 1, 0), lambda s, k, r: s > 0)


TARGET = within("target", TARGET_REACH)
#: Reported speech is known at the end of a clause: its state is the last of a state's numbers.
REPORT = Transducer.of(2, lambda s, k, r: int(s or r), lambda s, k, r: 0)
_FIVE = matcher("insult") @ matcher("threat") @ within("negation", NEGATION_REACH) @ TARGET
CLAUSE = Transducer(*(lambda t: (t.states, t.follow, [[y[:-1] for y in row] for row in t.says]))(_FIVE @ REPORT))


class Grammar:
    """The composed transducers with their weights; small, and sent to every task."""

    def __init__(self, stems: dict[str, tuple[str, float]], weights: np.ndarray):
        self.stems, self.weights, self._finder = stems, weights, None

    def __getstate__(self):
        return self.stems, self.weights

    def __setstate__(self, state):
        self.stems, self.weights = state
        self._finder = None

    def finder(self):
        if self._finder is None:
            self._finder = ahocorasick.Automaton()
            for stem in self.stems:
                self._finder.add_word(stem, stem)
            self._finder.make_automaton()
        return self._finder

    def matches(self, text: str) -> dict[int, tuple[str, float]]:
        """Start of each word that begins with a stem, with the kind and weight of its longest stem."""
        found: dict[int, str] = {}
        for end, stem in self.finder().iter(text):
            start = end - len(stem) + 1
            if (start == 0 or not (text[start - 1].isalnum() or text[start - 1] == "_")) and len(stem) > len(found.get(start, "")):
                found[start] = stem
        return {start: self.stems[stem] for start, stem in found.items()}

    def features(self, text: str | None) -> np.ndarray:
        """Summed match weights per reading over all clauses of the text, and their density."""
        out = np.zeros(len(READINGS))
        if not text:
            return np.zeros(len(READINGS) + 1)
        text = text.lower()
        found = self.matches(text)
        done = -1
        for start in sorted(found):
            if start <= done:
                continue
            begin = 0
            for mark in ".!?;\n":
                begin = max(begin, text.rfind(mark, max(done, 0), start) + 1)
            stop = _CLAUSE_END.search(text, start)
            done = stop.start() if stop else len(text)
            self._read(text, begin, done, found, out)
        return np.append(np.minimum(out, FULL) * (4 / FULL), np.log1p(1000 * out.sum() / len(text)))

    def _read(self, text: str, begin: int, stop: int, found: dict, out: np.ndarray) -> None:
        """Run the composition over one clause, and the target transducer once more from its end, and add what the matches weigh."""
        symbols, hits = [], []
        for token in _TOKEN.finditer(text, begin, stop):
            word, hit = token[0], found.get(token.start())
            if hit:
                hits.append((len(symbols), hit[1]))
            kind = hit[0] if hit else "target" if word in TARGETS else "negation" if word in NEGATIONS else "other"
            symbols.append(symbol(kind, word in REPORTS or word in "\"“”«»"))
        said, state = CLAUSE.run(symbols)
        ahead, _ = TARGET.run(symbols[::-1])
        reported = CLAUSE.states[state][-1] > 0
        for at, weight in hits:
            insult, threat, denied, before = said[at]
            aimed = before or ahead[len(symbols) - 1 - at][0]
            if threat:
                reading = 4 if aimed and not denied and not reported else 5
            else:
                reading = 2 if denied else 3 if reported else 1 if aimed else 0
            out[reading] += weight * (insult or threat)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + features @ self.weights[1:], -50, 50)))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled rows outside the held-out fold."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # At most ``sample`` rows of two numbers; of several texts under one id, one counts.
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return joined.groupBy("_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic")


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stem, label, n): in how many texts of the batch some word begins with the stem."""
    low, high = STEM_LENGTHS
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
            stems = set()
            for word in set(_WORD.findall((text or "").lower())):
                stems.update(word[:n] for n in range(low, min(len(word), high) + 1))
            counts[1 if toxic else 0].update(stems)
        for label, found in enumerate(counts):
            yield pa.record_batch(
                [list(found), [label] * len(found), list(found.values())],
                schema=pa.schema([("stem", pa.string()), ("label", pa.int32()), ("n", pa.int64())]),
            )


def learn_stems(sample: DataFrame, max_stems: int = MAX_STEMS) -> dict[str, tuple[str, float]]:
    """Seed stems, and the stems that tell toxic texts from others beyond chance."""
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    seeds = {w: ("insult", SEED_WEIGHT) for w in INSULTS} | {w: ("threat", SEED_WEIGHT) for w in THREATS}
    if not toxic or not clean:
        return seeds
    counts = sample.mapInArrow(_stem_counts, "stem string, label int, n long").groupBy("stem").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("neg"),
    )
    tried = counts.cache()
    try:
        n_tried = tried.count()
        base = toxic / (toxic + clean)
        odds = F.log((F.col("pos") + 0.5) / (F.col("neg") + 0.5) * F.lit(clean / toxic))
        share = F.col("pos") / (F.col("pos") + F.col("neg"))
        # Log-likelihood gain over the base rate; beyond ln(tried stems) it is no chance find.
        gain = F.col("pos") * F.log(share / base) + F.when(
            F.col("neg") > 0, F.col("neg") * F.log((1 - share) / (1 - base))
        ).otherwise(0.0)
        known = tried.select("stem", "pos", "neg", odds.alias("weight"), gain.alias("gain"))
        strong = (F.col("pos") > 0) & (F.col("gain") >= GAIN * math.log(n_tried + 1)) & (F.col("weight") >= LEAST_WEIGHT)
        found = known.where(strong).orderBy(F.desc("gain"), "stem").limit(max_stems).collect()
        seeded = known.where(F.col("stem").isin(list(seeds))).collect()
    finally:
        tried.unpersist()
    stems = dict(seeds)
    for row in seeded:
        if row["pos"] + row["neg"] >= 5:
            kind = seeds[row["stem"]][0]
            stems[row["stem"]] = (kind, max(0.0, row["weight"]))
    taken: list[str] = list(seeds)
    for row in found:
        # The strongest stem of a family stands for it: no need of its longer or shorter kin.
        if not any(row["stem"].startswith(t) or t.startswith(row["stem"]) for t in taken):
            taken.append(row["stem"])
            stems[row["stem"]] = ("insult", row["weight"])
    return stems


def fit(features: np.ndarray, toxic: np.ndarray, prior: np.ndarray = PRIOR, strength: float = 1.0) -> np.ndarray:
    """Logistic regression around ``prior``, by Newton steps; match weights never turn negative."""
    x = np.column_stack([np.ones(len(features)), features])
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (p - toxic) + strength * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        w[1:] = np.maximum(w[1:], 0.0)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    texts = labelled_sample(docs, labels, sample).cache()
    try:
        grammar = Grammar(learn_stems(texts), PRIOR)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [grammar.features(t).tolist() for t in batch["text"].to_pylist()]
                yield pa.record_batch([pa.array(rows, pa.list_(pa.float64())), batch["toxic"]], names=["x", "toxic"])

        rows = texts.mapInArrow(read, "x array<double>, toxic int").collect()
    finally:
        texts.unpersist()
    if rows:
        rows.sort()
        grammar.weights = fit(np.array([r["x"] for r in rows]), np.array([float(r["toxic"] > 0) for r in rows]))
    return grammar


def score_texts(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([grammar.features(t) for t in batch["text"].to_pylist()]).reshape(-1, len(READINGS) + 1)
            yield pa.record_batch([batch["doc_id"], pa.array(grammar.score(rows))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_texts(docs, learn(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged."""
    grammar = learn(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([grammar.features(t) for t in batch["text"].to_pylist()]).reshape(-1, len(READINGS) + 1)
            yield batch.filter(pa.array(grammar.score(rows) < threshold))

    return docs.mapInArrow(keep, docs.schema)


ship(__name__)
