"""Packs of documents, and compact lists of hashes between packs and hash buckets.

A pack is a run of documents of one input split, at most ``PACK_BYTES`` of text (or one longer
document), compressed into one row. Packs are written once; every later pass reads the same packs,
so an answer can be sent to a pack by its number. A question is the sorted set of hashes of a pack
that fall into one bucket, stored as gaps; equal hashes of a pack travel once, so a passage that a
third of all documents share costs a bucket one entry per pack, not one per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from criticlens.llm.words import ship
from criticlens.session import stage

PACK_BYTES = 8 << 20
#: Hash bits kept within a bucket; the bucket itself adds more.
BITS = 40
_MASK = np.uint64((1 << BITS) - 1)


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def encode_sorted(values: np.ndarray) -> bytes:
    """Ascending values as gaps, byte plane by byte plane, compressed."""
    gaps = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    planes = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + squeeze(np.ascontiguousarray(planes.T).tobytes())


def decode_sorted(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(unsqueeze(data[1:]), np.uint8).reshape(width, -1)
    whole = np.zeros((planes.shape[1], 8), np.uint8)
    whole[:, :width] = planes.T
    return np.cumsum(whole.view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


def encode_bits(flags: np.ndarray) -> bytes:
    return squeeze(np.packbits(flags).tobytes())


def decode_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(unsqueeze(data), np.uint8), count=n).astype(bool)


def bucket_keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and kept bits of each hash in one number: bucket * 2**BITS + bits."""
    return (((hashes >> np.uint64(BITS)) % np.uint64(buckets)) << np.uint64(BITS)) | (hashes & _MASK)


def by_bucket(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The slices of ascending keys that lie in one bucket."""
    if not len(keys):
        return
    bucket = (keys >> np.uint64(BITS)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
        yield int(bucket[a]), slice(a, b)


def kept_bits(keys: np.ndarray) -> np.ndarray:
    return keys & _MASK


def pack_texts(ids: list, texts: list[str | None]) -> tuple[bytes, bytes, bytes]:
    """Ids (with a flag for NULL), text lengths in bytes, and the texts in one block."""
    encoded = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    known = np.array([i is not None for i in ids], bool)
    numbers = np.array([i if i is not None else 0 for i in ids], "<i8")
    lengths = np.fromiter(map(len, encoded), "<i8", len(encoded))
    return squeeze(numbers.tobytes() + known.tobytes()), squeeze(lengths.tobytes()), squeeze(b"".join(encoded))


def unpack_texts(ids: bytes, lengths: bytes, block: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    sizes = np.frombuffer(unsqueeze(lengths), "<i8")
    raw = unsqueeze(ids)
    n = len(sizes)
    numbers, known = np.frombuffer(raw[: 8 * n], "<i8"), np.frombuffer(raw[8 * n :], bool)
    data = unsqueeze(block)
    ends = np.cumsum(sizes).tolist()
    return numbers, known, [data[e - s : e] for s, e in zip(sizes.tolist(), ends)]


PACK_SCHEMA = "pack long, ids binary, lengths binary, block binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() << 32
    ids: list = []
    texts: list = []
    size = made = 0

    def row() -> pa.RecordBatch:
        return pa.record_batch([[part + made], *[[x] for x in pack_texts(ids, texts)]], names=["pack", "ids", "lengths", "block"])

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            n = len(text or "")
            if ids and size + n > PACK_BYTES:
                yield row()
                ids, texts, size, made = [], [], 0, made + 1
            ids.append(doc_id)
            texts.append(text)
            size += n
    if ids:
        yield row()


def pack_documents(docs: DataFrame) -> DataFrame:
    """(pack, ids, lengths, block) rows that hold every (doc_id, text) of ``docs``, written once."""
    return stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pack, PACK_SCHEMA))


def bucket_count(packs: DataFrame, least: int, size: int) -> int:
    """Number of hash buckets for written ``packs``: one per ``size`` bytes of text, so a bucket stays as small at every input."""
    return max(least, packs.count() * PACK_BYTES // size)


ship(__name__)
