"""Alignment of two tokenizers: which tokens of one cover which of the other, and how common each pair is.

Each text is encoded by both tokenizers and their tokens are laid out by byte offset. Per batch of documents, keyed by
document, ``pandas.merge_asof`` finds for the start of each A token the B token that covers it, and the other way
round; the union of both directions is all overlaps, since of two overlapping tokens one starts inside the other. Offsets where
tokens of both sides end cut them into groups.

The links of a document are its distinct id pairs with their numbers. Documents of about ``PACK_BYTES`` of text share a
sorted list of pairs with the number of their documents that hold each: these lists, not the links, are counted corpus-wide and
sent back, so a pair that every document holds is one row per pack. Both tables of a pack then meet in one
group, which is bounded by the pack (or by one longer text). Nothing is broadcast but the two vocabulary files.

Token bytes come from the vocabularies themselves. A byte-level vocabulary whose merges stand in the order of their
ids, and whose texts are cut by the usual byte-level pattern, is applied as ranks (the same ids, several times
faster); texts with very long runs of white space, which that library cannot take, and all other vocabularies go through the file's
own library.

Defined results: a NULL or empty text, or one whose tokens of either side do not give back a space and the text byte for byte, has
no tokens: zeros and an empty digest. Repeated rows count as documents of their own; a NULL doc_id stays NULL. An empty table
gives an empty result. Only doc_id (an integer) and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from criticlens.llm.words import chunks, ship
from criticlens.session import stage

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters aligned at a time, and characters whose documents share a list of pairs.
BATCH_BYTES = 1 << 20
PACK_BYTES = 8 << 20
#: A run of white space from which on the ranks library may overflow its stack.
LONG_GAP = re.compile(r"\s{2000}")
#: How byte-level vocabularies cut texts into words; a fixed value.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


class ByteLevel:
    """A byte-level BPE vocabulary file; special tokens are plain text."""

    def __init__(self, source: str):
        self.source = source
        data = json.loads(source)
        vocabulary = data["model"]["vocab"]
        letters = byte_of_letter()
        special = {t["content"] for t in data["added_tokens"]}
        self.ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        self.pieces = [b""] * (max([*vocabulary.values(), *(t["id"] for t in data["added_tokens"])]) + 1)
        for piece, i in self.ranks.items():
            self.pieces[i] = piece
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        cut = data["pre_tokenizer"] or {}
        usual = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        in_order = all(vocabulary.get(a + b) == 256 + k for k, (a, b) in enumerate(pairs))
        self.lossless = all(bytes([b]) in self.ranks for b in range(256))
        self._whole = self._fast = None
        if usual and in_order and not data["normalizer"]:
            import tiktoken

            self._fast = tiktoken.Encoding("ranks", pat_str=WORD_PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    def _own(self, text: str) -> list[int]:
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_str(self.source)
            self._whole.encode_special_tokens = True
        return self._whole.encode(text, add_special_tokens=False).ids

    def encode_all(self, texts: list[str]) -> list[list[int] | None]:
        """The ids of a space and each text; None where their bytes are not the same. With all single bytes in the vocabulary they always are."""
        return [self._encode(" " + t) for t in texts]

    def _encode(self, text: str) -> list[int] | None:
        ids = self._own(text) if self._fast is None or LONG_GAP.search(text) else self._fast.encode_ordinary(text)
        return ids if self.lossless or b"".join(map(self.pieces.__getitem__, ids)) == text.encode() else None


class Pieces:
    """A piece vocabulary with byte fallback; it puts the space before the text itself.

    Where no piece goes on after a letter with a space, no merge crosses the beginning of a run of spaces, so a text is encoded
    run by run (spaces and what follows up to the next space), each run once per batch; runs are remembered
    until there are more than ``REMEMBERED``.
    """

    REMEMBERED = 1 << 16

    def __init__(self, source: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=source)
        self.pieces = [self._bytes(i) for i in range(self.model.get_piece_size())]
        self.apart = not any(re.search(rb"[^ ] ", p) for p in self.pieces)
        self._known: dict[str, list[int] | None] = {}

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        if self.model.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        if self.model.is_control(i) or self.model.is_unknown(i):
            return b""
        return piece.replace("▁", " ").encode()

    def _exact(self, runs: list[str]) -> list[list[int] | None]:
        """The ids of texts that begin with a space, None where their bytes are not the same. The model puts no space before an empty text."""
        found = self.model.encode([r[1:] for r in runs], num_threads=1)
        found = [[self.model.piece_to_id("▁")] if r == " " else i for r, i in zip(runs, found)]
        return [i if b"".join(map(self.pieces.__getitem__, i)) == r.encode() else None for r, i in zip(runs, found)]

    def encode_all(self, texts: list[str]) -> list[list[int] | None]:
        if not self.apart:
            return self._exact([" " + t for t in texts])
        split = [re.findall(" +[^ ]*", " " + t) for t in texts]
        if len(self._known) > self.REMEMBERED:
            self._known.clear()
        new = [r for r in set(chain.from_iterable(split)) if r not in self._known]
        self._known.update(zip(new, self._exact(new)))
        found = [list(map(self._known.__getitem__, runs)) for runs in split]
        return [None if None in ids else list(chain.from_iterable(ids)) for ids in found]


class Side:
    """A tokenizer with the length of each token and its id as text before each kind of separator."""

    def __init__(self, tokenizer: ByteLevel | Pieces, last: bytes):
        self.tokenizer, self.pieces = tokenizer, tokenizer.pieces
        self.n = len(self.pieces)
        self.lengths = np.fromiter(map(len, self.pieces), np.int64, self.n)
        self.names = [b"%d," % i for i in range(self.n)] + [b"%d%s" % (i, last) for i in range(self.n)]


class Tokens:
    """The tokens of one side over a batch of documents, laid out by byte."""

    def __init__(self, side: Side, ids: list[list[int]]):
        self.side = side
        self.counts = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids = np.concatenate([np.array(i, np.int64) for i in ids]) if len(ids) else np.zeros(0, np.int64)
        self.ends = np.cumsum(side.lengths[self.ids])
        self.starts = self.ends - side.lengths[self.ids]
        self.doc = np.repeat(np.arange(len(ids)), self.counts)

    def frame(self, name: str) -> pd.DataFrame:
        return pd.DataFrame({"doc": self.doc, "at": self.starts, name: np.arange(len(self.ids))})

    def per_document(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, values, len(self.counts)).astype(np.int64)


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all A and B tokens whose byte ranges overlap."""
    left, right = a.frame("i"), b.frame("j")
    covering = pd.merge_asof(left, right, on="at", by="doc")
    covered = pd.merge_asof(right, left, on="at", by="doc")
    i, j = covered["i"].to_numpy(np.int64), covered["j"].to_numpy(np.int64)
    inside = a.starts[i] != b.starts[j]  # tokens that start together are in both directions
    return np.concatenate((covering["i"].to_numpy(np.int64), i[inside])), np.concatenate((covering["j"].to_numpy(np.int64), j[inside]))


def digests(a: Tokens, b: Tokens) -> tuple[np.ndarray, list[str]]:
    """Per document the number of groups and the digest of their ids."""
    ends = np.zeros((2, a.ends[-1] + 1), bool)
    ends[0, a.ends] = ends[1, b.ends] = True
    cut_a, cut_b = ends[1, a.ends], ends[0, b.ends]
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    until_a, until_b = np.cumsum(np.bincount(group_a)), np.cumsum(np.bincount(group_b))
    order = np.empty(len(a.ids) + len(b.ids), np.int64)
    order[np.arange(len(a.ids)) + np.concatenate(([0], until_b))[group_a]] = a.ids + a.side.n * cut_a
    order[np.arange(len(b.ids)) + until_a[group_b]] = 2 * a.side.n + b.ids + b.side.n * cut_b
    names = a.side.names + b.side.names
    edges = np.concatenate(([0], np.cumsum(a.counts + b.counts))).tolist()
    found = []
    for s, e in zip(edges, edges[1:]):
        text = b"".join(map(names.__getitem__, order[s:e].tolist()))
        found.append(hashlib.sha256(text[:-1]).hexdigest() if text else "")
    return a.per_document(cut_a), found


def align(a_side: Side, b_side: Side, texts: list[str | None]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """Per document (n_a, n_b, n_groups, n_links, digest); and document, id pair and number of its links, sorted by both."""
    given = [t or "" for t in texts]
    ids = [(x, y) if t and x is not None and y is not None else ([], []) for t, x, y in zip(given, a_side.tokenizer.encode_all(given), b_side.tokenizer.encode_all(given))]
    a, b = Tokens(a_side, [x for x, _ in ids]), Tokens(b_side, [y for _, y in ids])
    if not len(a.ids):
        nothing = np.zeros(0, np.int64)
        return [(0, 0, 0, 0, "")] * len(texts), nothing, nothing, nothing
    i, j = overlaps(a, b)
    n_groups, names = digests(a, b)
    n_links = np.bincount(a.doc[i], minlength=len(texts))
    size = a_side.n * b_side.n
    keys, times = np.unique(a.doc[i] * size + a.ids[i] * b_side.n + b.ids[j], return_counts=True)
    rows = list(zip(a.counts.tolist(), b.counts.tolist(), n_groups.tolist(), n_links.tolist(), names))
    return rows, keys // size, keys % size, times


# --- over tables ----------------------------------------------------------------------------------

_PACKED = (
    "pack long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "place array<int>, times array<int>, pairs array<long>, held array<int>"
)
_ARROW = [("pack", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
          ("groups_sha256", pa.string()), ("place", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
          ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int32()))]


def _pack(number: int, ids: list, rows: list[tuple], doc: np.ndarray, pair: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """One row per document with places in the list of pairs, and one row with that list."""
    pairs, place, held = np.unique(pair, return_inverse=True, return_counts=True)
    edges = np.append(np.searchsorted(doc, np.arange(len(ids))), [len(doc), len(doc)])
    lists = lambda values: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, pa.int32()))
    one = lambda values, kind: pa.array([None] * len(ids) + [values], pa.list_(kind))
    columns = [pa.array([number] * (len(ids) + 1), pa.int64()), pa.array([*ids, None], pa.int64())]
    columns += [pa.array([*c, None], t) for c, t in zip(zip(*rows), (*[pa.int64()] * 4, pa.string()))]
    columns += [lists(place), lists(times), one(pairs, pa.int64()), one(held, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema(_ARROW))


def _align(files):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side = Side(ByteLevel(files.value[0]), b"|"), Side(Pieces(files.value[1]), b";")
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for start, stop in chunks(texts, PACK_BYTES):
                rows: list[tuple] = []
                parts: list[tuple[np.ndarray, ...]] = []
                for s, e in chunks(texts[start:stop], BATCH_BYTES):
                    found, doc, pair, times = align(a_side, b_side, texts[start + s : start + e])
                    rows += found
                    parts.append((doc + s, pair, times.astype(np.int32)))
                yield _pack(number, ids[start:stop], rows, *[np.concatenate(p) for p in zip(*parts)])
                number += 1

    return run


def _sum(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """n_best and count_sum of the documents of one pack."""
    place = docs["place"].combine_chunks()
    edges, at = place.offsets.to_numpy(), place.values.to_numpy()
    times = docs["times"].combine_chunks().values.to_numpy().astype(np.int64)
    n = len(answers)
    order = answers["place"].to_numpy()
    count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    count[order], best[order] = answers["count"].to_numpy(), answers["best"].to_numpy()
    sums = [np.diff(np.concatenate(([0], np.cumsum(times * v[at])))[edges]) for v in (best, count)]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    columns = [docs[c] for c in names] + [pa.array(s, pa.int64()) for s in sums] + [docs["groups_sha256"]]
    return pa.table(columns, names=[*names, "n_best", "count_sum", "groups_sha256"])


def align_tokenizers(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 per row of ``docs``."""
    spark = docs.sparkSession
    files = (Path(vocabulary_a).read_text(encoding="utf-8"), Path(vocabulary_b).read_bytes())
    width = len(Pieces(files[1]).pieces)
    sent = spark.sparkContext.broadcast(files)
    packed = stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_align(sent), _PACKED))
    lists = packed.where("pairs IS NOT NULL").select("pack", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "p"))
    lists = lists.select("pack", "place", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held"))
    counts = lists.groupBy("pair").agg(F.sum("held").alias("count"))
    # A token has at most as many partners as the other vocabulary has tokens.
    of_a = Window.partitionBy(F.floor(F.col("pair") / width))
    counts = counts.select("pair", "count", (F.col("count") == F.max("count").over(of_a)).cast("int").alias("best"))
    answers = lists.join(counts, "pair").select(F.col("pack").alias("of"), "place", "count", "best")
    documents = packed.where("pairs IS NULL").drop("pairs", "held")
    result = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return documents.groupBy("pack").cogroup(answers.groupBy("of")).applyInArrow(_sum, result)


ship(__name__)
