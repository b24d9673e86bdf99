"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Every source asks for words in proportion to its weight. A source stops at ``cap`` times its own
size; what it leaves goes to the others by weight, until no target is above its limit. The whole
part of a target is whole repetitions of the source. The rest is a seeded draw: documents fall by
hash into slots, the slots up to the remaining target are repeated once more, and the one slot that
crosses it is repeated in part, the same part for each of its documents.

Defined results: a NULL text has size 0 and takes 0 words; an empty table gives an empty result; a
NULL source is a source like any other and comes last; repeated rows and equal ids fall into the same slot
and are treated alike; a source without words has target 0. Columns other than the id, text and
source are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from criticlens.llm.ordered import with_position
from criticlens.session import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix"
#: Hexadecimal digits of the hash that name a slot: 4096 slots a source.
SLOT_DIGITS = 3


def n_words(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slot(doc_id: Column) -> Column:
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, SLOT_DIGITS), 16, 10).cast("int")


def fill_level(sources: DataFrame, total: float) -> float:
    """The words per unit of weight at which the targets add up to ``total``.

    ``sources`` has one row per source with ``weight`` and ``limit``. Each round is one aggregate
    over the sources; only three numbers reach the driver.
    """
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("limit")
        row = sources.agg(
            F.count_if(above).alias("n"),
            F.sum(F.when(above, F.col("limit")).otherwise(0)).alias("fixed"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("free"),
        ).first()
        if row["free"] is None or row["n"] == capped:
            return level
        if not row["free"]:
            return float("inf")
        capped = row["n"]
        level = (total - row["fixed"]) / row["free"]


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, target for rows of (source, source_size)."""
    kinds = F.array(*[F.lit(w) for w in weights])
    ranked = with_position(sizes, [F.col("source").asc_nulls_last()], "_rank")
    weighted = stage(
        ranked.select(
            "source",
            "source_size",
            F.element_at(kinds, (F.col("_rank") % len(weights) + 1).cast("int")).alias("weight"),
            (F.col("source_size") * cap).alias("limit"),
        )
    )
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level = F.lit(fill_level(weighted, total * share))
    wanted = F.least(F.col("weight") * level, F.col("limit").cast("double"))
    return weighted.select("source", "source_size", wanted.alias("target"))


def source_shares(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Per source and slot of (source, slot, size) rows: source_size, target, whole repetitions, and the
    part of one more."""
    slots = sized.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap).select(
        F.col("source").alias("_source"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("whole"),
    )
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    run = slots.select("source", "slot", "slot_size", F.coalesce(F.sum("slot_size").over(before), F.lit(0)).alias("run"))
    rest = F.col("target") - F.col("whole") * F.col("source_size") - F.col("run")
    part = F.when(F.col("slot_size") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), rest / F.col("slot_size"))))
    return run.join(targets, F.col("source").eqNullSafe(F.col("_source"))).select(
        "_source",
        F.col("slot").alias("_slot"),
        F.col("source_size").cast("long").alias("_source_size"),
        F.col("target").alias("_target"),
        F.col("whole").alias("_whole"),
        F.coalesce(part, F.lit(0.0)).alias("_part"),
    )


def _taken(rows: DataFrame, shares: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` of the rows with (source, _size, _own_slot), and what the mix takes of them."""
    joined = rows.join(shares, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_own_slot") == F.col("_slot")))
    extra = F.floor(F.col("_size") * F.col("_part") + F.lit(0.5))
    return joined.select(
        *keep,
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_whole") * F.col("_size") + extra).cast("long").alias("taken"),
    )


def _sized(docs: DataFrame) -> DataFrame:
    return stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("_size"), slot(F.col("doc_id")).alias("_own_slot")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of (doc_id, text, source)."""
    sized = _sized(docs)
    shares = source_shares(sized.select("source", F.col("_own_slot").alias("slot"), F.col("_size").alias("size")), weights, share, cap)
    return _taken(sized, shares, ["doc_id"])


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The rows of ``docs`` of which the mix takes words, with size, source_size, target and taken.

    Columns of ``docs`` with one of these four names are replaced.
    """
    sized = _sized(docs)
    shares = source_shares(sized.select("source", F.col("_own_slot").alias("slot"), F.col("_size").alias("size")), weights, share, cap)
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    # The columns travel as one struct, so that their names cannot clash with those of the shares.
    row = F.struct(*keep).alias("_row")
    rows = docs.select(row, "source", n_words(F.col("text")).alias("_size"), slot(F.col("doc_id")).alias("_own_slot"))
    return _taken(rows, shares, ["_row"]).where("taken > 0").select("_row.*", "size", "source_size", "target", "taken")
