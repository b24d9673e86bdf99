"""Substring deduplication with fixed-block anchors.

Every text is a sequence of words. Its non-overlapping blocks of ``BLOCK`` words are the index; the
rolling window of the same length is looked up at every word of every text. A window of
``2 * BLOCK`` words that two documents share contains a whole block of either, so both documents
get a hit inside it. Hits are then extended: around each hit the longer windows are hashed, and a
window is a repeat when a document with a smaller id starts the same one. Overlapping repeats join
up to the maximal exact repeats, whose words go.

The looking-up runs per hash bucket, on the sorted hashes of whole packs (see packs.py), so texts
are never grouped by content and a frequent passage weighs one entry per pack.

Defined results: NULL, empty and blank texts have no words; a text shorter than a window loses
nothing; a repeat within one document, or between rows of one id, is no reason to remove; a NULL id is neither smaller
nor larger than another; an empty table gives an empty result. Only doc_id (an integer) and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

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
    pack_texts,
    squeeze,
    unpack_texts,
    unsqueeze,
)
from criticlens.llm.words import Words, chunks, ship, windows
from criticlens.session import shuffle_width, stage

BLOCK = 25
WINDOW = 2 * BLOCK
#: Text per hash bucket.
BUCKET_BYTES = 64 << 20

# The columns between the steps.
_ASK = "bucket int, pack long, keys binary, many binary, anchors binary"
_TELL = "pack long, bucket int, keys binary"
_STEP = (
    "kind int, doc_id long, n_words long, n_removed long, kept_sha256 string, "
    "pack long, ids binary, lengths binary, block binary, bucket int, hashes binary, first binary, last binary"
)
_DONE = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _hashed(texts: list[bytes]) -> Iterator[tuple[int, Words, np.ndarray]]:
    """Chunks of a pack: the first document, its words and their hashes."""
    for a, b in chunks(texts):
        words = Words([t.decode("utf-8", "surrogatepass") for t in texts[a:b]])
        yield a, words, words.hashes()


def _unique(keys: np.ndarray, doc: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct keys; whether two documents hold the key; whether it is a block of one."""
    order = np.lexsort((doc, keys))
    keys, doc, anchor = keys[order], doc[order], anchor[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:], [len(keys)])) - 1
    return keys[at], doc[at] != doc[last], np.logical_or.reduceat(anchor, at)


def _ask(buckets: int):
    """Per pack and bucket: all rolling windows, and which of them are blocks of the index."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, docs, anchors = [], [], []
                for a, words, hashes in _hashed(unpack_texts(row["ids"], row["lengths"], row["block"])[2]):
                    at, rolled = windows(words, hashes, BLOCK)
                    owner = words.document()[at]
                    keys.append(bucket_keys(rolled, buckets))
                    docs.append((owner + a).astype(np.int32))
                    anchors.append((at - words.first[owner]) % BLOCK == 0)
                keys, docs, anchors = map(np.concatenate, (keys, docs, anchors)) if keys else (np.zeros(0, np.uint64),) * 3
                if not len(keys):
                    continue
                keys, many, anchors = _unique(keys, docs, anchors)
                rows = [
                    (b, row["pack"], encode_sorted(kept_bits(keys[s])), encode_bits(many[s]), encode_bits(anchors[s]))
                    for b, s in by_bucket(keys)
                ]
                del keys, docs, many, anchors
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                    names=["bucket", "pack", "keys", "many", "anchors"],
                )

    return ask


def _tell(table: pa.Table) -> pa.Table:
    """Of one bucket: to each pack, its keys that are a block somewhere and occur in two documents."""
    asked = [decode_sorted(k) for k in table["keys"].to_pylist()]
    sizes = [len(a) for a in asked]
    many = np.concatenate([decode_bits(m, n) for m, n in zip(table["many"].to_pylist(), sizes)])
    anchors = np.concatenate([decode_bits(m, n) for m, n in zip(table["anchors"].to_pylist(), sizes)])
    keys = np.concatenate(asked)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    n = np.diff(np.append(at, len(keys)))
    shared = np.logical_or.reduceat(anchors[order], at) & ((n > 1) | np.logical_or.reduceat(many[order], at))
    hit = np.empty(len(keys), bool)
    hit[order] = np.repeat(shared, n)
    packs, bucket = table["pack"].to_pylist(), table["bucket"][0].as_py()
    told, begin = [], 0
    for pack, own in zip(packs, asked):
        mine = hit[begin : begin + len(own)]
        begin += len(own)
        if mine.any():
            told.append((pack, bucket, encode_sorted(own[mine])))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*told) if told else ((),) * 3, (pa.int64(), pa.int32(), pa.binary()))], names=["pack", "bucket", "keys"])


def _digest(text: bytes) -> str:
    return hashlib.sha256(b" ".join(text.split())).hexdigest()


def _extend(buckets: int):
    """Of one pack: finished rows for texts without a hit; the others, and the windows around their hits."""

    def extend(packs: pa.Table, told: pa.Table) -> pa.Table:
        rows: list[dict] = []
        hits = [
            decode_sorted(k) | (np.uint64(b) << np.uint64(BITS))
            for b, k in zip(told["bucket"].to_pylist(), told["keys"].to_pylist())
        ]
        known = np.sort(np.concatenate(hits)) if hits else np.zeros(0, np.uint64)
        for row in packs.to_pylist():
            ids, has_id, texts = unpack_texts(row["ids"], row["lengths"], row["block"])
            left: list[int] = []
            found, owners = [], []
            for a, words, hashes in _hashed(texts):
                marked = np.zeros(len(words.counts), bool)
                starts, rolled = windows(words, hashes, WINDOW)
                if len(known) and len(starts):
                    at, short = windows(words, hashes, BLOCK)
                    keys = bucket_keys(short, buckets)
                    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    hit = np.zeros(len(words) + 1, np.int64)
                    hit[at[known[place] == keys] + 1] = 1
                    total = np.cumsum(hit)
                    near = total[starts + WINDOW - BLOCK + 1] > total[starts]
                    owner = words.document()[starts[near]]
                    marked[owner] = True
                    found.append(rolled[near])
                    owners.append(ids[owner + a])
                    # A NULL id is compared with none.
                    found[-1], owners[-1] = found[-1][has_id[owner + a]], owners[-1][has_id[owner + a]]
                for k in range(len(words.counts)):
                    if marked[k]:
                        left.append(a + k)
                    else:
                        text = texts[a + k]
                        rows.append({
                            "kind": 0, "doc_id": int(ids[a + k]) if has_id[a + k] else None, "n_words": int(words.counts[k]),
                            "n_removed": 0, "kept_sha256": _digest(text),
                        })
            if not left:
                continue
            some = pack_texts([int(ids[k]) if has_id[k] else None for k in left], [texts[k].decode("utf-8", "surrogatepass") for k in left])
            rows.append({"kind": 1, "pack": row["pack"], "ids": some[0], "lengths": some[1], "block": some[2]})
            hashes, owner = np.concatenate(found), np.concatenate(owners)
            order = np.lexsort((owner, hashes))
            hashes, owner = hashes[order], owner[order]
            at = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
            last = np.concatenate((at[1:], [len(hashes)])) - 1 if len(at) else at
            distinct, low, high = hashes[at], owner[at], owner[last]
            bucket = (distinct % np.uint64(buckets)).astype(np.int64)
            for b in np.unique(bucket).tolist():
                own = bucket == b
                rows.append({
                    "kind": 2, "pack": row["pack"], "bucket": b, "hashes": squeeze(distinct[own].tobytes()),
                    "first": squeeze(low[own].tobytes()), "last": squeeze(high[own].tobytes()),
                })
        return pa.Table.from_pylist(rows, schema=_STEP_ARROW)

    return extend


def _earliest(table: pa.Table) -> pa.Table:
    """Of one bucket: to each pack, the smallest id that starts a window, if a later id there has it too."""
    read = lambda column, kind: [np.frombuffer(unsqueeze(x), kind) for x in table[column].to_pylist()]
    hashes, first, last = read("hashes", np.uint64), read("first", np.int64), read("last", np.int64)
    sizes = [len(h) for h in hashes]
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    low = np.minimum.reduceat(np.concatenate(first)[order], at)
    smallest = np.empty(len(every), np.int64)
    smallest[order] = np.repeat(low, np.diff(np.append(at, len(every))))
    rows, begin = [], 0
    for pack, n, own, late in zip(table["pack"].to_pylist(), sizes, hashes, last):
        mine = smallest[begin : begin + n]
        begin += n
        hit = late > mine
        if hit.any():
            rows.append((pack, squeeze(own[hit].tobytes()), squeeze(mine[hit].tobytes())))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 3, (pa.int64(), pa.binary(), pa.binary()))], names=["pack", "hashes", "first"])


def _remove(packs: pa.Table, told: pa.Table) -> pa.Table:
    """Of one pack: the rows of its texts with hits, after their repeated words are gone."""
    read = lambda column, kind: [np.frombuffer(unsqueeze(x), kind) for x in told[column].to_pylist()]
    known, first = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if told.num_rows:
        known, first = np.concatenate(read("hashes", np.uint64)), np.concatenate(read("first", np.int64))
        order = np.argsort(known)
        known, first = known[order], first[order]
    rows = []
    for row in packs.to_pylist():
        ids, has_id, texts = unpack_texts(row["ids"], row["lengths"], row["block"])
        for a, words, hashes in _hashed(texts):
            gone = np.zeros(len(words) + 1, np.int64)
            starts, rolled = windows(words, hashes, WINDOW)
            if len(known) and len(starts):
                place = np.minimum(np.searchsorted(known, rolled), len(known) - 1)
                owner = words.document()[starts] + a
                bad = starts[(known[place] == rolled) & (first[place] < ids[owner]) & has_id[owner]]
                np.add.at(gone, bad, 1)
                np.add.at(gone, bad + WINDOW, -1)
            removed = np.cumsum(gone)[:-1] > 0
            for k in range(len(words.counts)):
                own = removed[words.first[k] : words.first[k + 1]]
                n_gone = int(own.sum())
                if n_gone:
                    kept = b" ".join(w for w, r in zip(texts[a + k].split(), own.tolist()) if not r)
                    digest = hashlib.sha256(kept).hexdigest()
                else:
                    digest = _digest(texts[a + k])
                rows.append((int(ids[a + k]) if has_id[a + k] else None, len(own), n_gone, digest))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 4, kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


_STEP_ARROW = pa.schema(
    [("kind", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
     ("pack", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("block", pa.binary()), ("bucket", pa.int32()),
     ("hashes", pa.binary()), ("first", pa.binary()), ("last", pa.binary())]
)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row of ``docs``."""
    packs = pack_documents(docs)
    buckets = bucket_count(packs, 2 * shuffle_width(docs.sparkSession), BUCKET_BYTES)
    told = packs.mapInArrow(_ask(buckets), _ASK).groupBy("bucket").applyInArrow(_tell, _TELL)
    step = stage(packs.groupBy("pack").cogroup(told.groupBy("pack")).applyInArrow(_extend(buckets), _STEP))
    finished = step.where("kind = 0").select("doc_id", "n_words", "n_removed", "kept_sha256")
    waiting = step.where("kind = 1").select("pack", "ids", "lengths", "block")
    asked = step.where("kind = 2").select("bucket", "pack", "hashes", "first", "last")
    earliest = asked.groupBy("bucket").applyInArrow(_earliest, "pack long, hashes binary, first binary")
    return finished.unionByName(waiting.groupBy("pack").cogroup(earliest.groupBy("pack")).applyInArrow(_remove, _DONE))


ship(__name__)
