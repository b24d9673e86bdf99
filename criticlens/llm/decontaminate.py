"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are read as lower-case terms. A document and an item that share a seed (a
window of ``SEED`` terms, found by its rolling Karp-Rabin hash) are compared: seeds on one diagonal
grow to maximal matches, the longest match is marked as a tile in both, what remains of overlapping
matches is cut, and so on until no match of ``SEED`` terms is left. Tiles may lie in any order, so a
reordered passage is found too. The pair is reported when the tiles cover ``THRESHOLD`` of the item.

The benchmark is the query set. It goes to the tasks in blocks of at most ``BLOCK`` characters, one pass over the
documents per block, so the broadcast is bounded however large the benchmark is. Each document is
read whole in one place; there is no shuffle of texts, so no key can be hot.

Defined results: NULL and empty texts and items match nothing; an item shorter than ``SEED`` terms
is matched by its whole sequence; repeated documents are reported each, repeated items by each item_id once; empty
tables give an empty result. Only doc_id and text, item_id and text are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from criticlens.llm.words import Words, chunks, rolling, ship

SEED = 5
THRESHOLD = 0.6
BLOCK = 500_000


def tile(doc: np.ndarray, item: np.ndarray, pairs: list[tuple[int, int]], seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (doc start, item start, length) from seed pairs (doc position, item position)."""
    matches: list[tuple[int, int, int]] = []
    reach: dict[int, int] = {}
    for i, j in sorted(pairs):
        if reach.get(i - j, -1) > i:
            continue
        n = seed
        while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
            n += 1
        matches.append((-n, i, j))
        reach[i - j] = i + n - seed + 1
    heapq.heapify(matches)
    doc_free, item_free = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles = []
    while matches:
        n, i, j = heapq.heappop(matches)
        n = -n
        free = doc_free[i : i + n] & item_free[j : j + n]
        if free.all():
            tiles.append((i, j, n))
            doc_free[i : i + n] = item_free[j : j + n] = False
            if not item_free.any():
                break
            continue
        # The match meets earlier tiles: its free parts stay in the race.
        edge = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
        for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()):
            if b - a >= seed:
                heapq.heappush(matches, (a - b, i + a, j + a))
    return tiles


class Items:
    """One block of the benchmark, indexed by the hashes of its seed windows."""

    def __init__(self, ids: list, texts: list[str | None], seed: int):
        words = Words(texts, terms=True)
        hashes = words.hashes()
        self.ids, self.terms, self.index = [], [], {}
        for k in range(len(ids)):
            own = hashes[words.first[k] : words.first[k + 1]]
            if len(own):
                n = min(seed, len(own))
                at = len(self.terms)
                self.ids.append(ids[k])
                self.terms.append(own)
                for j, h in enumerate(rolling(own, n).tolist()):
                    self.index.setdefault(n, {}).setdefault(h, []).append((at, j))
        self.keys = {n: np.sort(np.fromiter(found, np.uint64, len(found))) for n, found in self.index.items()}

    def tiles(self, terms: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, tiles, covered terms) for each item that shares a seed with the document."""
        for n, keys in self.keys.items():
            rolled = rolling(terms, n)
            if not len(rolled):
                continue
            place = np.minimum(np.searchsorted(keys, rolled), len(keys) - 1)
            shared: dict[int, list[tuple[int, int]]] = {}
            for i in np.flatnonzero(keys[place] == rolled).tolist():
                for item, j in self.index[n][int(rolled[i])]:
                    shared.setdefault(item, []).append((i, j))
            for item, pairs in shared.items():
                found = tile(terms, self.terms[item], pairs, n)
                yield item, len(found), sum(t[2] for t in found)


def item_blocks(items: DataFrame, block: int = BLOCK) -> Iterator[tuple[list, list]]:
    """The benchmark in blocks of at most ``block`` characters of text, or one longer item."""
    ids: list = []
    texts: list = []
    size = 0
    for row in items.select("item_id", "text").dropDuplicates(["item_id", "text"]).toLocalIterator():
        n = len(row["text"] or "")
        if ids and size + n > block:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += n
    if ids:
        yield ids, texts


def _leaks_of(texts: list[str | None], known: Items, threshold: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(row, item, tiles, covered terms, coverage) of every pair that reaches the threshold."""
    for a, b in chunks(texts):
        words = Words(texts[a:b], terms=True)
        hashes = words.hashes()
        for k in range(b - a):
            for item, n, covered in known.tiles(hashes[words.first[k] : words.first[k + 1]]):
                share = covered / len(known.terms[item])
                if share >= threshold:
                    yield a + k, item, n, covered, share


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, n_tiles, n_covered and coverage of the pairs that reach ``threshold``."""
    spark = docs.sparkSession
    doc_kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, "doc_id"), (items, "item_id")))
    schema = f"doc_id {doc_kind}, item_id {item_kind}, n_tiles int, n_covered int, coverage double"
    item_arrow = to_arrow_type(items.schema["item_id"].dataType)
    texts = docs.select("doc_id", "text")
    result = spark.createDataFrame([], schema)
    for ids, item_texts in item_blocks(items, block):
        sent = spark.sparkContext.broadcast(Items(ids, item_texts, seed))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for batch in batches:
                rows = list(_leaks_of(batch["text"].to_pylist(), known, threshold))
                at, item, n, covered, share = zip(*rows) if rows else ((),) * 5
                yield pa.record_batch(
                    [
                        batch["doc_id"].take(pa.array(at, pa.int64())),
                        pa.array([known.ids[i] for i in item], item_arrow),
                        pa.array(n, pa.int32()),
                        pa.array(covered, pa.int32()),
                        pa.array(share, pa.float64()),
                    ],
                    names=["doc_id", "item_id", "n_tiles", "n_covered", "coverage"],
                )

        result = result.unionByName(texts.mapInArrow(search, schema))
    return result


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` without a leak, unchanged and unshuffled."""
    for ids, item_texts in item_blocks(items, block):
        sent = docs.sparkSession.sparkContext.broadcast(Items(ids, item_texts, seed))

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row, *_ in _leaks_of(batch["text"].to_pylist(), sent.value, threshold):
                    clean[row] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


ship(__name__)
