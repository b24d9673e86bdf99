"""Repeated passages by a sparse suffix array.

Of all suffixes (word positions) only those are kept that start at a minimiser: the smallest hash of
``SEED`` words among the seeds of some ``LENGTH``-word window. The choice depends on the words alone, so
a passage of ``LENGTH`` words or more that two documents share has a kept position in both, at the same
place of the passage. Positions whose seed occurs once are dropped early. The others are sorted as
suffixes, by range, over all tasks; neighbours are compared, and the common part is extended to the
right and to the left. Where it reaches ``LENGTH`` words, both places are a repeat; the repeats of a
document that meet become one span.

Sorting is done twice, by the words to the right and then by those to the left, so that a partner that
shares more on one side does not hide one that shares enough on both. A suffix carries 16 bits
per word, ``LENGTH`` words to the right and ``LENGTH - SEED`` to the left; longer repeats show at
several positions. Neighbours of one document are passed over: a repeat is between documents. A sorted range
is streamed, and a run of one document at its edge is compared with the nearest other document beyond it,
over as many ranges as the run fills.

Defined results: NULL, empty and short texts have no repeats; rows without an id count as one document, and
so do repeated rows of one id; equal places of many documents are all reported; an empty table gives an empty result.
Only doc_id (an integer) and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from criticlens.llm.packs import (
    BITS,
    bucket_count,
    bucket_keys,
    by_bucket,
    decode_bits,
    decode_sorted,
    encode_bits,
    encode_sorted,
    kept_bits,
    pack_documents,
    unpack_texts,
)
from criticlens.llm.words import Words, chunks, rolling, ship
from criticlens.session import shuffle_width, stage

LENGTH = 50
SEED = 10
REACH = LENGTH - SEED
NO_ID = -(1 << 63)

_ASK = "bucket int, pack long, keys binary, many binary"
_TELL = "pack long, bucket int, keys binary"
_SUFFIX = "doc long, pos int, ahead binary, behind binary"
_MATCH = "part int, edge int, doc long, start int, stop int, other long, other_start int, pos int, ahead binary, behind binary"
_MATCH_NAMES = [c.split()[0] for c in _MATCH.split(", ")]
#: Kinds of rows of a sorted range beside its matches (0): in the order of the range, its first row, the first of another document,
#: the last of another document than the last row, the last row; then the rows of the first and of the last run.
FIRST, SECOND, LAST_BUT, LAST, AT_FIRST, AT_LAST = 1, 2, 3, 4, 5, 6
#: Text per hash bucket, and suffixes per sorted range: both counts follow the input.
BUCKET_BYTES = 256 << 20
RANGE_ROWS = 2_000_000


def minimisers(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept positions in ascending order, and the hashes of their seeds."""
    seeds = rolling(hashes, SEED)
    span = REACH + 1
    n = len(seeds) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    end = np.repeat(words.first[1:], words.counts)[:n]
    starts = np.flatnonzero(np.arange(n) + LENGTH <= end)
    least = np.lib.stride_tricks.sliding_window_view(seeds, span)
    at = np.unique(np.concatenate([starts[a : a + 65536] + least[starts[a : a + 65536]].argmin(axis=1) for a in range(0, len(starts), 65536)])) if len(starts) else starts
    return at, seeds[at]


def _hashed(row: dict) -> Iterator[tuple[np.ndarray, Words, np.ndarray]]:
    """Chunks of a pack: the ids of the documents, their words and word hashes."""
    ids, has_id, texts = unpack_texts(row["ids"], row["lengths"], row["block"])
    ids = np.where(has_id, ids, NO_ID)
    for a, b in chunks(texts):
        words = Words([t.decode("utf-8", "surrogatepass") for t in texts[a:b]])
        yield ids[a:b], words, words.hashes()


def _ask(buckets: int):
    """Per pack and bucket: the distinct seeds, and which of them two documents of the pack hold."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, docs = [], []
                for ids, words, hashes in _hashed(row):
                    at, seeds = minimisers(words, hashes)
                    keys.append(bucket_keys(seeds, buckets))
                    docs.append(ids[words.document()[at]])
                keys, docs = (np.concatenate(keys), np.concatenate(docs)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                if not len(keys):
                    continue
                order = np.lexsort((docs, keys))
                keys, docs = keys[order], docs[order]
                at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                many = docs[at] != docs[np.append(at[1:], len(keys)) - 1]
                keys = keys[at]
                rows = [(b, row["pack"], encode_sorted(kept_bits(keys[s])), encode_bits(many[s])) for b, s in by_bucket(keys)]
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["bucket", "pack", "keys", "many"])

    return ask


def _tell(table: pa.Table) -> pa.Table:
    """Of one bucket: to each pack, its seeds that occur in two documents."""
    asked = [decode_sorted(k) for k in table["keys"].to_pylist()]
    many = np.concatenate([decode_bits(m, len(a)) for m, a in zip(table["many"].to_pylist(), asked)])
    keys = np.concatenate(asked)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    n = np.diff(np.append(at, len(keys)))
    hit = np.empty(len(keys), bool)
    hit[order] = np.repeat((n > 1) | np.logical_or.reduceat(many[order], at), n)
    rows, begin, bucket = [], 0, table["bucket"][0].as_py()
    for pack, own in zip(table["pack"].to_pylist(), asked):
        mine = hit[begin : begin + len(own)]
        begin += len(own)
        if mine.any():
            rows.append((pack, bucket, encode_sorted(own[mine])))
    kinds = (pa.int64(), pa.int32(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 3, kinds)], names=["pack", "bucket", "keys"])


def _suffixes(buckets: int):
    """Of one pack: the kept suffixes whose seed another document has, with their words as 16 bits each."""

    def suffixes(packs: pa.Table, told: pa.Table) -> pa.Table:
        known = [decode_sorted(k) | (np.uint64(b) << np.uint64(BITS)) for b, k in zip(told["bucket"].to_pylist(), told["keys"].to_pylist())]
        known = np.sort(np.concatenate(known)) if known else np.zeros(0, np.uint64)
        parts = []
        for row in packs.to_pylist() if len(known) else ():
            for ids, words, hashes in _hashed(row):
                at, seeds = minimisers(words, hashes)
                keys = bucket_keys(seeds, buckets)
                at = at[known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys]
                doc = words.document()[at]
                # 0 stands for no word; the high bits of a hash for a word. Big-endian, so bytes sort alike.
                short = np.concatenate((np.zeros(REACH, np.uint16), (hashes >> np.uint64(48)).astype(np.uint16) | 1, np.zeros(LENGTH, np.uint16)))
                right = at[:, None] + np.arange(LENGTH)
                left = at[:, None] - 1 - np.arange(REACH)
                ahead = np.where(right < words.first[doc + 1][:, None], short[right + REACH], 0).astype(">u2")
                behind = np.where(left >= words.first[doc][:, None], short[left + REACH], 0).astype(">u2")
                parts.append(
                    pa.table(
                        [
                            pa.array(ids[doc]),
                            pa.array((at - words.first[doc]).astype(np.int32)),
                            pa.array([x.tobytes() for x in ahead], pa.binary()),
                            pa.array([x.tobytes() for x in behind], pa.binary()),
                        ],
                        names=["doc", "pos", "ahead", "behind"],
                    )
                )
        empty = pa.schema([("doc", pa.int64()), ("pos", pa.int32()), ("ahead", pa.binary()), ("behind", pa.binary())]).empty_table()
        return pa.concat_tables([empty, *parts])

    return suffixes


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal leading words of each row; 0 (no word) is equal to nothing."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _matrix(column: list[bytes], n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), ">u2").reshape(-1, n)


def _pair_rows(doc, pos, ahead, behind, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """doc, start, stop, other, other_start of the rows i that share ``LENGTH`` words with the rows j."""
    right, left = _same(ahead[i], ahead[j]), _same(behind[i], behind[j])
    ok = (right >= SEED) & (right + left >= LENGTH)
    i, j, right, left = i[ok], j[ok], right[ok], left[ok]
    return [doc[i], pos[i] - left, pos[i] + right, doc[j], pos[j] - left]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one sorted range: the matches of each suffix with its neighbours, and the rows that may match beyond the edges.

    A batch is held at a time, and of what came before it the open run (the last rows, all of one document) and the row before
    that. Both orders sort by the seed first, so rows of a run with an earlier seed match nothing that is still to come.
    """
    part, first, second, held = TaskContext.get().partitionId(), None, False, None
    before_run = 0

    def edge_rows(code: int, rows: tuple, at) -> pa.RecordBatch:
        doc, pos, ahead, behind = (x[at] for x in rows)
        ahead, behind = ahead.astype(">u2"), behind.astype(">u2")  # rows put together have lost the byte order
        n = len(doc)
        return pa.record_batch(
            [
                pa.array(np.full(n, part), pa.int32()), pa.array(np.full(n, code), pa.int32()), pa.array(doc, pa.int64()),
                pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()),
                pa.array(pos, pa.int32()), pa.array([x.tobytes() for x in ahead], pa.binary()), pa.array([x.tobytes() for x in behind], pa.binary()),
            ],
            names=_MATCH_NAMES,
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = (
            batch["doc"].to_numpy(), batch["pos"].to_numpy(),
            _matrix(batch["ahead"].to_pylist(), LENGTH), _matrix(batch["behind"].to_pylist(), REACH),
        )
        old = 0
        if held is not None:
            old = len(held[0])
            rows = tuple(np.concatenate(x) for x in zip(held, rows))
        doc, pos, ahead, behind = rows
        n = len(doc)
        turn = np.flatnonzero(doc[1:] != doc[:-1]) + 1
        run = np.searchsorted(turn, np.arange(n), side="right")
        begin, end = np.concatenate(([0], turn)), np.concatenate((turn, [n]))
        before, after = begin[run] - 1, end[run]
        if first is None:
            first = tuple(x[:1] for x in rows)
            yield edge_rows(FIRST, rows, slice(0, 1))
        if not second:
            # The first run goes on: its rows with the seed of the first row may match a row of an earlier range.
            mine = np.arange(old, begin[1] if len(begin) > 1 else n)
            yield edge_rows(AT_FIRST, rows, mine[(ahead[mine, :SEED] == first[2][0, :SEED]).all(axis=1)])
            if len(begin) > 1:
                second = True
                yield edge_rows(SECOND, rows, slice(begin[1], begin[1] + 1))
        back, on = np.flatnonzero(before >= 0), np.flatnonzero(after < n)
        back, on = back[back >= old], on[on >= before_run]
        for i, other in ((back, before), (on, after)):
            for k in range(0, len(i), 65536):
                found = np.column_stack(_pair_rows(doc, pos, ahead, behind, i[k : k + 65536], other[i[k : k + 65536]]))
                m = len(found)
                yield pa.record_batch(
                    [
                        pa.array(np.full(m, part), pa.int32()), pa.array(np.zeros(m), pa.int32()), pa.array(found[:, 0], pa.int64()),
                        pa.array(found[:, 1], pa.int32()), pa.array(found[:, 2], pa.int32()), pa.array(found[:, 3], pa.int64()),
                        pa.array(found[:, 4], pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()),
                    ],
                    names=_MATCH_NAMES,
                )
        start = int(begin[-1])
        before_run = min(start, 1)
        still = np.arange(start, n)
        still = still[(ahead[start:, :SEED] == ahead[-1, :SEED]).all(axis=1)]
        held = tuple(x[np.concatenate((np.arange(start - before_run, start), still))] for x in rows)
    if held is not None:
        if before_run:
            yield edge_rows(LAST_BUT, held, slice(0, 1))
        yield edge_rows(LAST, held, slice(-1, None))
        yield edge_rows(AT_LAST, held, slice(before_run, None))


def _bridge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of the rows at the edges of ranges with their neighbours in other ranges."""
    for batch in batches:
        n = batch.num_rows
        both = lambda a, b: batch[a].to_pylist() + batch[b].to_pylist()
        doc, pos = np.array(both("doc", "o_doc"), np.int64), np.array(both("pos", "o_pos"), np.int64)
        ahead, behind = _matrix(both("ahead", "o_ahead"), LENGTH), _matrix(both("behind", "o_behind"), REACH)
        found = _pair_rows(doc, pos, ahead, behind, np.arange(n), np.arange(n) + n)
        yield pa.record_batch(
            [pa.array(x.astype(k)) for x, k in zip(found, ("i8", "i4", "i4", "i8", "i4"))], names=["doc", "start", "stop", "other", "other_start"]
        )


def _beyond(edges: DataFrame, marks: tuple[int, ...], order: list, code: int, rows: int) -> DataFrame:
    """The rows ``rows`` at one end of each range with the nearest row of another document beyond that end.

    ``marks`` are the rows that bound the outer runs of the ranges, at most three of a range, in the order ``order`` away from
    the end; where the document of a mark differs from the one before it, that one is the neighbour of the whole run.
    """
    along = Window.orderBy(*order)
    row = F.struct("doc", "pos", "ahead", "behind")
    seen = edges.where(F.col("edge").isin(*marks)).withColumn("_lag", F.lag(row).over(along))
    other = F.last(F.when(F.col("_lag.doc") != F.col("doc"), F.col("_lag")), ignorenulls=True).over(along)
    beyond = seen.withColumn("_other", other).where((F.col("edge") == code) & F.col("_other").isNotNull()).select(
        "part", *[F.col(f"_other.{c}").alias(f"o_{c}") for c in ("doc", "pos", "ahead", "behind")]
    )
    # One row per range.
    seed = lambda c: F.substring(c, 1, 2 * SEED)
    return edges.where(F.col("edge") == rows).join(F.broadcast(beyond), "part").where(seed("ahead") == seed("o_ahead"))


def neighbour_matches(suffixes: DataFrame, keys: list, ranges: int) -> DataFrame:
    """doc, start, stop, other, other_start of the matches between neighbours in the order of ``keys``, which sort by the seed first."""
    order = [*keys, F.col("doc"), F.col("pos")]
    compared = stage(suffixes.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(_compare, _MATCH))
    columns = ["doc", "start", "stop", "other", "other_start"]
    edges = compared.where("edge > 0").select("part", "edge", "doc", "pos", "ahead", "behind")
    back = _beyond(edges, (FIRST, LAST_BUT, LAST), [F.col("part"), F.col("edge")], FIRST, AT_FIRST)
    on = _beyond(edges, (FIRST, SECOND, LAST), [F.col("part").desc(), F.col("edge").desc()], LAST, AT_LAST)
    bridged = back.unionByName(on).mapInArrow(_bridge, "doc long, start int, stop int, other long, other_start int")
    return compared.where("edge = 0").select(*columns).unionByName(bridged)


def orders() -> list[list]:
    """The two sort orders: by the words to the right, and after the seed by those to the left."""
    ahead, behind = F.col("ahead"), F.col("behind")
    return [[ahead, behind], [F.substring("ahead", 1, 2 * SEED), behind, ahead]]


def shared_suffixes(docs: DataFrame) -> DataFrame:
    """The kept suffixes whose seed another document has: doc, pos, ahead, behind."""
    packs = pack_documents(docs)
    buckets = bucket_count(packs, 2 * shuffle_width(docs.sparkSession), BUCKET_BYTES)
    told = packs.mapInArrow(_ask(buckets), _ASK).groupBy("bucket").applyInArrow(_tell, _TELL)
    return stage(packs.groupBy("pack").cogroup(told.groupBy("pack")).applyInArrow(_suffixes(buckets), _SUFFIX))


def find_repeats(docs: DataFrame) -> DataFrame:
    """Spans of documents that another document has too: doc_id, start_word, end_word (exclusive), n_words,
    and one document that shares the beginning of the span, with its place there."""
    suffixes = shared_suffixes(docs)
    ranges = max(shuffle_width(docs.sparkSession), suffixes.count() // RANGE_ROWS)
    matches = reduce(DataFrame.unionByName, [neighbour_matches(suffixes, keys, ranges) for keys in orders()])
    # One row per place, then the places that meet are one span.
    place = matches.groupBy("doc", "start").agg(F.max("stop").alias("stop"), F.min_by(F.struct("other", "other_start"), F.struct(-F.col("stop"), "other", "other_start")).alias("other"))
    by_doc = Window.partitionBy("doc").orderBy("start")
    reach = F.max("stop").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    fresh = place.withColumn("_new", F.when(reach >= F.col("start"), 0).otherwise(1))
    spans = fresh.withColumn("_span", F.sum("_new").over(by_doc)).groupBy("doc", "_span").agg(
        F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.min_by("other", "start").alias("other")
    )
    named = lambda c: F.when(F.col(c) != F.lit(NO_ID), F.col(c))
    return spans.select(
        named("doc").alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"),
        named("other.other").alias("match_doc_id"), F.col("other.other_start").alias("match_start"),
    )


ship(__name__)
