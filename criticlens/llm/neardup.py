"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of shingles of ``SHINGLE`` lower-case terms: frequency times inverse document
frequency. Exact document frequencies are counted for all shingles; those in more than ``COMMON``
of the documents get their own weight, all rarer ones share the highest (so the weights fit into
a table of at most mean shingles per text / ``COMMON`` entries). Improved consistent weighted sampling
draws ``BANDS * ROWS`` shingles per text, so that two texts draw alike with the probability of their
weighted Jaccard similarity. As many plain draws follow, alike with the probability of the plain Jaccard
similarity of the distinct shingles: weights fall with the size of a group of near copies, so by weight alone
the copies of a large group would be less alike than those of a small one. Frequencies count different texts,
not rows. Texts that agree in a band of either kind meet in a bucket.

Equal texts are one representative from the start. In a bucket of up to ``SMALL`` texts all pairs are
candidates. In a larger one, a text meets the bucket's hub (the text with the fullest buckets)
and its successor in the order of the next band; buckets that still hold texts of several classes
afterwards are split by a second band and go through the same again. Texts of buckets that even then hold
several classes go through an exact join on shingles: in the order of their frequency among these texts, two
texts that are alike share a shingle so early that enough of both remains after it. Template shingles
come last, so a template family whose texts are not alike has few shingles to join on. Every candidate that the signatures do not rule out is verified on its
whole shingle sets: a link has a weighted or a plain Jaccard similarity of ``SIMILARITY``; classes are the components of the verified links.

Defined results: texts without a term (NULL, empty) are each their own class; a text of fewer terms than a shingle is one
shingle; equal texts and repeated rows share a class; one id with different texts is different documents; n_links counts the links that were verified, not all there are; a NULL doc_id has no class; an empty table
gives an empty result. Only doc_id (an integer) and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from criticlens.llm.components import components
from criticlens.llm.ordered import with_neighbours
from criticlens.llm.packs import BITS, bucket_keys, by_bucket, decode_sorted, encode_sorted, kept_bits, squeeze, unsqueeze
from criticlens.llm.words import Words, chunks, mixed, rolling, ship
from criticlens.operators.joins import hot_keys, lookup_join
from criticlens.session import shuffle_width, stage

SHINGLE = 5
SIMILARITY = 0.8
COMMON = 0.005
BANDS = 12
ROWS = 5
SMALL = 8
#: Share of the draws of one kind that must agree, by their last byte, for a candidate to be verified: 0.8 less four standard deviations.
AGREE = 0.58
SEED = 20
#: Text per bucket of shingles that are counted together.
BUCKET_BYTES = 32 << 20
_TABLE_BITS = 16
_CHUNK = 1 << 20


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every shingle of a chunk, in document order."""
    hashes = words.hashes()
    document = words.document()
    rolled = rolling(hashes, SHINGLE)
    end = np.repeat(words.first[1:], words.counts)[: len(rolled)]
    at = np.flatnonzero(np.arange(len(rolled)) + SHINGLE <= end)
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    if not len(short):
        return document[at], rolled[at]
    whole = np.array([mixed(rolling(hashes[words.first[k] : words.first[k + 1]], int(words.counts[k])))[0] for k in short.tolist()], np.uint64)
    docs, values = np.concatenate((document[at], short)), np.concatenate((rolled[at], whole))
    order = np.argsort(docs, kind="stable")
    return docs[order], values[order]


def weighted_sets(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: its first text, and document, distinct shingle and frequency, sorted by both."""
    for a, b in chunks(texts, _CHUNK):
        docs, values = shingles(Words(texts[a:b], terms=True))
        order = np.lexsort((values, docs))
        docs, values = docs[order], values[order]
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
        at = np.flatnonzero(new)
        yield a, docs[at], values[at], np.diff(np.append(at, len(docs)))


# --- document frequencies -------------------------------------------------------------------------


def _ask(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [bucket_keys(values, buckets) for _, _, values, _ in weighted_sets(batch["text"].to_pylist())]
            keys, counts = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), None)
            rows = [(b, encode_sorted(kept_bits(keys[s])), squeeze(counts[s].astype("<u4").tobytes())) for b, s in by_bucket(keys)]
            if rows:
                kinds = (pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["bucket", "keys", "counts"])

    return ask


def _common(least: float):
    """Of one bucket: the shingles in more than ``least`` documents, with their number."""

    def common(table: pa.Table) -> pa.Table:
        keys = np.concatenate([decode_sorted(k) for k in table["keys"].to_pylist()])
        counts = np.concatenate([np.frombuffer(unsqueeze(c), "<u4") for c in table["counts"].to_pylist()]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        total = np.add.reduceat(counts, at)
        often = total > least
        bucket = np.uint64(table["bucket"][0].as_py()) << np.uint64(BITS)
        return pa.table([pa.array((keys[at[often]] | bucket).astype(np.int64)), pa.array(total[often])], names=["key", "df"])

    return common


class Idf:
    """Weights of shingles: a sorted table of the common ones, one value for the others."""

    def __init__(self, keys: np.ndarray, df: np.ndarray, n_docs: int, buckets: int):
        order = np.argsort(keys)
        self.keys, self.buckets = keys[order], buckets
        self.top = float(np.log1p(1 / COMMON))
        self.idf = np.minimum(np.log1p(n_docs / df[order]), self.top).astype(np.float32)

    def weigh(self, values: np.ndarray, frequency: np.ndarray) -> np.ndarray:
        weight = np.full(len(values), self.top, np.float32)
        if len(self.keys) and len(values):
            keys = bucket_keys(values, self.buckets)
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            weight = np.where(self.keys[place] == keys, self.idf[place], weight)
        return weight * frequency.astype(np.float32)


def learn_idf(texts: DataFrame) -> Idf:
    """Exact frequencies of all shingles over the different texts; only those of the common ones come back."""
    size = F.coalesce(F.sum("n"), F.lit(0)).alias("size")
    n_docs, size = texts.select("text1", "text2", F.octet_length("text").alias("n")).distinct().agg(F.count(F.lit(1)).alias("n_docs"), size).first()
    buckets = max(shuffle_width(texts.sparkSession), size // BUCKET_BYTES)
    asked = texts.dropDuplicates(["text1", "text2"]).select("text").mapInArrow(_ask(buckets), "bucket int, keys binary, counts binary")
    rows = asked.groupBy("bucket").applyInArrow(_common(COMMON * n_docs), "key long, df long").toPandas()
    return Idf(rows["key"].to_numpy(np.int64).astype(np.uint64), rows["df"].to_numpy(np.int64), max(n_docs, 1), buckets)


# --- signatures -----------------------------------------------------------------------------------


class Sampler:
    """Improved consistent weighted sampling; the random parameters of a shingle come from its hash."""

    def __init__(self, draws: int = BANDS * ROWS, seed: int = SEED):
        random = np.random.Generator(np.random.PCG64(seed))
        size = 1 << _TABLE_BITS
        self.r = random.gamma(2.0, 1.0, size).astype(np.float32)
        self.log_c = np.log(random.gamma(2.0, 1.0, size)).astype(np.float32)
        self.beta = random.random(size).astype(np.float32)
        self.salts = random.integers(0, 1 << 64, draws, np.uint64)
        self.odd = random.integers(0, 1 << 63, draws, np.uint64) * np.uint64(2) + np.uint64(1)

    def draw(self, starts: np.ndarray, counts: np.ndarray, values: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 32-bit value per set and draw; the sets are the runs of ``values`` at ``starts``."""
        out = np.zeros((len(starts), len(self.odd)), np.uint32)
        log_w = np.log(weights)
        for k, (salt, odd) in enumerate(zip(self.salts, self.odd)):
            slot = ((values ^ salt) * odd) >> np.uint64(64 - _TABLE_BITS)
            r, beta = self.r[slot], self.beta[slot]
            step = np.floor(log_w / r + beta)
            a = self.log_c[slot] - r * (step - beta) - r
            least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), counts))
            first = least[np.searchsorted(least, starts)]
            out[:, k] = (mixed(values[first] ^ (step[first].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(32)).astype(np.uint32)
        return out

    def draw_plain(self, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The same without weights: the smallest hash per set and draw."""
        out = np.zeros((len(starts), len(self.odd)), np.uint32)
        for k, (salt, odd) in enumerate(zip(self.salts, self.odd)):
            out[:, k] = (mixed(np.minimum.reduceat((values ^ salt) * odd, starts)) >> np.uint64(32)).astype(np.uint32)
        return out


def _sign(idf: Idf):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            signed: list[bytes | None] = [None] * batch.num_rows
            for a, docs, values, frequency in weighted_sets(batch["text"].to_pylist()):
                if not len(docs):
                    continue
                starts = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
                counts = np.diff(np.append(starts, len(docs)))
                weighted = sampler.draw(starts, counts, values, idf.weigh(values, frequency))
                for k, row in zip(docs[starts].tolist(), np.hstack((weighted, sampler.draw_plain(starts, values)))):
                    signed[a + k] = row.astype("<u4").tobytes()
            brief = [None if d is None else np.frombuffer(d, np.uint8)[::4].tobytes() for d in signed]
            yield pa.record_batch([*batch.columns[:-1], pa.array(signed, pa.binary()), pa.array(brief, pa.binary())], names=["id", "text1", "text2", "draws", "brief"])

    return sign


def band(k: Column | int) -> Column:
    """The bucket of band ``k`` as a number; plain bands follow the ``BANDS`` weighted ones."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.xxhash64(k, F.substring(F.col("draws"), k * (4 * ROWS) + 1, F.lit(4 * ROWS)))


# --- candidates -----------------------------------------------------------------------------------


def _meetings(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate pairs (a, b), a < b, of (key, doc, turn) rows, and the (key, doc) of the large buckets."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stage(members.join(sizes, "key"))
    small = members.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("doc")).alias("docs"))
    pairs = F.flatten(
        F.transform("docs", lambda x, i: F.transform(F.slice("docs", i + 2, F.greatest(F.size("docs") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    )
    few = small.select(F.explode(pairs).alias("p")).select("p.a", "p.b")

    large = members.where(F.col("n") > SMALL)
    degree = members.join(large.select("doc").distinct(), "doc", "left_semi").groupBy("doc").agg(F.sum("n").alias("degree"))
    ranked = large.join(degree, "doc")
    hubs = ranked.groupBy("key").agg(F.max_by("doc", F.struct("degree", -F.col("doc"))).alias("hub"))
    to_hub = ranked.join(hubs, "key").select(F.col("doc").alias("a"), F.col("hub").alias("b"))
    in_turn = with_neighbours(large.select("key", "turn", "doc"), ["key", "turn", "doc"], ["key", "doc"])
    to_next = in_turn.where(F.col("_after.key") == F.col("key")).select(F.col("doc").alias("a"), F.col("_after.doc").alias("b"))
    every = few.unionByName(to_hub).unionByName(to_next)
    pairs = every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    return pairs, large.select("key", "doc")


def _members(signed: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """(key, doc, turn) per set of bands of one kind; ``turn`` is the next band of that kind outside the set.

    All sets are of one length. They are rows of a constant array, not expressions of their own: code generated
    for each of the many pairs of bands would take hundreds of MB of the driver to compile.
    """
    after = lambda k: k - k % BANDS + (k + 1) % BANDS
    turn = lambda s: next(k for k in (after(s[0]), after(after(s[0]))) if k not in s)
    bands = [f"_{i}" for i in range(len(sets[0]))]
    rows = [F.struct(F.lit(str(s)).alias("set"), F.lit(turn(s)).alias("turn"), *[F.lit(k).alias(n) for n, k in zip(bands, s, strict=True)]) for s in sets]
    dealt = signed.select("doc", "draws", F.explode(F.array(*rows)).alias("m")).select("doc", "draws", "m.*")
    return dealt.select(F.xxhash64("set", *[band(F.col(n)) for n in bands]).alias("key"), "doc", band(F.col("turn")).alias("turn"))


def _likely(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs whose draws agree often enough to be worth a look at the texts."""
    left = pairs.join(signed.select(F.col("doc").alias("a"), F.col("brief").alias("left")), "a")
    both = left.join(signed.select(F.col("doc").alias("b"), F.col("brief").alias("right")), "b")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(batch.num_rows, 2, -1) for c in ("left", "right"))
                batch = batch.filter(pa.array((x == y).mean(axis=2).max(axis=1) >= AGREE))
            yield batch.select(["a", "b"])

    return both.select("a", "b", "left", "right").mapInArrow(look, "a long, b long")


# --- verification ---------------------------------------------------------------------------------


def _sets(idf: Idf):
    """Each text as its sorted 32-bit shingles with their weights."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, weights = [b""] * batch.num_rows, [b""] * batch.num_rows
            for a, docs, values, frequency in weighted_sets(batch["text"].to_pylist()):
                if not len(docs):
                    continue
                weight = idf.weigh(values, frequency)
                short = (values >> np.uint64(32)).astype("<u4")
                starts = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
                for k, s, e in zip(docs[starts].tolist(), starts.tolist(), np.append(starts[1:], len(docs)).tolist()):
                    keys[a + k] = short[s:e].tobytes()
                    # Most texts hold only rare shingles once: one weight says it all.
                    own = weight[s:e]
                    weights[a + k] = (own[:1] if (own == own[0]).all() else own).astype("<f4").tobytes()
            yield pa.record_batch([batch["doc"], pa.array(keys, pa.binary()), pa.array(weights, pa.binary())], names=["doc", "keys", "weights"])

    return sets


def weighted_jaccard(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger weights; keys ascend."""
    return _similarities(x, wx, y, wy)[0]


def _similarities(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> tuple[float, float]:
    """Weighted and plain Jaccard similarity."""
    place = np.searchsorted(y, x)
    place[place == len(y)] = 0
    same = y[place] == x if len(y) else np.zeros(len(x), bool)
    both, n_both = float(np.minimum(wx[same], wy[place[same]]).sum(dtype=np.float64)), int(same.sum())
    total, n_total = float(wx.sum(dtype=np.float64) + wy.sum(dtype=np.float64)) - both, len(x) + len(y) - n_both
    return both / total if total else 0.0, n_both / n_total if n_total else 0.0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def read(keys: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
        k, w = np.frombuffer(keys, "<u4"), np.frombuffer(weights, "<f4")
        return k, np.broadcast_to(w, len(k)) if len(w) == 1 else w

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("keys", "weights", "other_keys", "other_weights")]
        alike = [max(_similarities(*read(a, b), *read(c, d))) >= SIMILARITY for a, b, c, d in zip(*columns)]
        yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = pairs.join(sets.withColumnRenamed("doc", "a"), "a")
    right = sets.select(F.col("doc").alias("b"), F.col("keys").alias("other_keys"), F.col("weights").alias("other_weights"))
    return left.join(right, "b").select("a", "b", "keys", "weights", "other_keys", "other_weights").mapInArrow(_verify, "a long, b long")


# --- what buckets cannot split --------------------------------------------------------------------


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text and shingle, with its weight."""
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("doc", "root", "keys", "weights")]
        for doc, root, keys, weights in zip(*columns):
            k, w = np.frombuffer(keys, "<i4"), np.frombuffer(weights, "<f4")
            ids = [pa.array(np.full(len(k), v, np.int64)) for v in (doc, root)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(k), pa.array(np.broadcast_to(w, len(k)).copy())], names=["doc", "root", "token", "weight"])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of shingles and total weight of each text."""
    for batch in batches:
        n, total = [], []
        for keys, weights in zip(batch["keys"].to_pylist(), batch["weights"].to_pylist()):
            w = np.frombuffer(weights, "<f4")
            n.append(float(len(keys) // 4))
            total.append(n[-1] * float(w[0]) if len(w) == 1 else float(w.sum(dtype=np.float64)))
        yield pa.record_batch([batch["doc"], batch["root"], pa.array(n, pa.float64()), pa.array(total, pa.float64())], names=["doc", "root", "n", "total"])


def _apart(sets: DataFrame, named: DataFrame) -> DataFrame:
    """All pairs (a, b) of the (doc, root) texts of different roots that can reach ``SIMILARITY``, by weight or plainly.

    Shingles are ordered by their number of texts. Two alike texts of sizes s <= t share at least
    SIMILARITY / (1 + SIMILARITY) * (s + t), so that much of both remains from the first shingle they share
    on, itself included. Only shingles of several roots are shared by such pairs. Sizes are a part
    of the join key, and hot keys are spread.
    """
    texts = stage(sets.join(named, "doc"))
    tokens = stage(texts.mapInArrow(_spread, "doc long, root long, token int, weight float"))
    held = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    shared = tokens.select("doc", "token", "weight").join(held.select("token", "df"), "token")
    from_here = Window.partitionBy("doc").orderBy(F.desc("df"), "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shared = shared.select("doc", "token", F.count(F.lit(1)).over(from_here).cast("double").alias("plain"), F.sum("weight").over(from_here).alias("weighted"))
    rows = shared.join(texts.mapInArrow(_totals, "doc long, root long, n double, total double"), "doc")
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("n").alias("size"), F.col("plain").alias("rest")),
        F.struct(F.lit(1).alias("kind"), F.col("total").alias("size"), F.col("weighted").alias("rest")),
    )
    rows = rows.select("doc", "root", "token", F.explode(kinds).alias("_k")).select("doc", "root", "token", "_k.*")
    # A hair below the bound, for sums of weights are rounded.
    part, hair = SIMILARITY / (1 + SIMILARITY), 1 - 1e-5
    rows = stage(rows.where(F.col("rest") >= hair * SIMILARITY * F.col("size")))
    grade = F.floor(F.log("size") / (1.001 * -log(SIMILARITY)))
    key = lambda g: F.xxhash64("kind", "token", g).alias("key")
    small = rows.where(F.col("rest") >= hair * 2 * part * F.col("size")).select(key(grade), F.col("doc").alias("a"), F.col("root").alias("_a"), F.col("size").alias("_s"), F.col("rest").alias("_r"))
    large = rows.withColumn("grade", F.explode(F.array(grade, grade - 1))).select(key(F.col("grade")), F.col("doc").alias("b"), F.col("root").alias("_b"), F.col("size").alias("_t"), F.col("rest").alias("_q"))
    hot = hot_keys(small.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    fit = (F.col("_a") != F.col("_b")) & (F.col("_s") <= F.col("_t")) & (F.col("_s") >= hair * SIMILARITY * F.col("_t"))
    fit &= F.least("_r", "_q") >= hair * part * (F.col("_s") + F.col("_t"))
    pairs = lookup_join(small, large, "key", hot).where(fit)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# --- the operator ---------------------------------------------------------------------------------


def _open(large: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc, root) of the texts in large buckets that hold several classes."""
    named = large.join(roots, F.col("doc") == F.col("node"), "left").select("key", "doc", F.coalesce("root", "doc").alias("root"))
    apart = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return named.join(apart.select("key"), "key", "left_semi").select("doc", "root").distinct()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text1"), F.xxhash64(F.lit(1), "text").alias("text2"), "text"
    )


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, text1, text2, termless) per row, and per text with terms: its first id, the first (id, text1, text2) of its class, n_links.

    A text, not an id, is a node: equal ids with different texts stay apart.
    """
    idf = learn_idf(rows)
    every = stage(rows.mapInArrow(_sign(idf), "id long, text1 long, text2 long, draws binary, brief binary"))
    compared = every.where("id IS NOT NULL AND draws IS NOT NULL")
    texts = compared.groupBy("text1", "text2").agg(F.min("id").alias("id"), F.any_value("draws").alias("draws"), F.any_value("brief").alias("brief"))
    signed = stage(texts.withColumn("doc", F.monotonically_increasing_id()))
    signed_draws = signed.select("doc", "draws", "brief")

    members = _members(signed_draws, [(k,) for k in range(2 * BANDS)])
    met, large = _meetings(members)
    pairs = stage(_likely(met, signed_draws))
    # Texts of large buckets may find a partner in the second round only.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc")).unionByName(large.select("doc")).distinct()
    key = ["id", "text1", "text2"]
    wanted = signed.select("doc", *key).join(wanted, "doc", "left_semi")
    # Repeated rows are dropped where the join has put them side by side.
    chosen = rows.join(wanted.hint("merge"), key).select(*key, "doc", "text").dropDuplicates(key).select("doc", "text")
    sets = stage(chosen.mapInArrow(_sets(idf), "doc long, keys binary, weights binary"))
    links = stage(_links(pairs, sets))

    # Large buckets whose texts are not one class yet: split them by a second band.
    roots = stage(components(links))
    again = signed_draws.join(stage(_open(large, roots)), "doc", "left_semi")
    root_of = lambda c: roots.select(F.col("node").alias(f"_{c}"), F.col("root").alias(f"_root_{c}"))
    more, _ = _meetings(_members(again, [s for kind in (0, BANDS) for s in combinations(range(kind, kind + BANDS), 2)]))
    more = more.join(root_of("a"), F.col("a") == F.col("_a"), "left").join(root_of("b"), F.col("b") == F.col("_b"), "left")
    more = more.where(F.coalesce("_root_a", "a") != F.coalesce("_root_b", "b")).select("a", "b")
    more = stage(_likely(more, signed_draws).join(pairs, ["a", "b"], "left_anti"))
    links = stage(links.unionByName(_links(more, sets)))

    # What is open even then: the exact join.
    roots = stage(components(links))
    left = stage(_open(large, roots))
    if left.take(1):
        links = stage(links.unionByName(_links(stage(_apart(sets, left)), sets)).distinct())
        roots = stage(components(links))
    degree = links.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("n_links"))
    nodes = signed.select(*key, "doc").join(roots, F.col("doc") == F.col("node"), "left").withColumn("root", F.coalesce("root", "doc"))
    firsts = nodes.groupBy("root").agg(F.min(F.struct(*key)).alias("first"))
    classes = stage(nodes.join(firsts, "root").join(degree, "doc", "left").select("text1", "text2", "first", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    return every.select(*key, F.col("draws").isNull().alias("termless")), classes


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class) and n_links of its text, per row of ``docs``."""
    every, classes = _classes(_rows(docs))
    classes = classes.select(F.col("text1").alias("_1"), F.col("text2").alias("_2"), F.col("first.id").alias("class_id"), "n_links")
    joined = every.join(classes, (F.col("text1") == F.col("_1")) & (F.col("text2") == F.col("_2")) & ~F.col("termless"), "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id"))
    return joined.select(F.col("id").alias("doc_id"), own.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per class: the one with the smallest (doc_id, text hash). Rows without an id stay, and of equal texts under one id one row."""
    rows = _rows(docs)
    every, classes = _classes(rows)
    alone = every.where("termless AND id IS NOT NULL").select(F.col("id").alias("_id"), F.col("text1").alias("_1"), F.col("text2").alias("_2"))
    first = classes.select(F.col("first.id").alias("_id"), F.col("first.text1").alias("_1"), F.col("first.text2").alias("_2")).unionByName(alone).distinct()
    keyed = docs.select("*", *[c.alias(n) for c, n in zip((F.col("doc_id").cast("long"), F.xxhash64("text"), F.xxhash64(F.lit(1), "text")), ("_key0", "_key1", "_key2"))])
    same = (F.col("_key0") == F.col("_id")) & (F.col("_key1") == F.col("_1")) & (F.col("_key2") == F.col("_2"))
    kept = keyed.join(first.hint("merge"), same, "left_semi").dropDuplicates(["_key0", "_key1", "_key2"]).select(*docs.columns)
    return kept.unionByName(docs.where("doc_id IS NULL"))


ship(__name__)
