"""Nearest neighbours by largest inner product: stable projections, kd-trees, and a chi-square stopping test.

With one more component, sqrt(M^2 - |x|^2) for the longest length M, all vectors get length M, and the largest inner product
with a query scaled to M is the smallest distance. Every vector is projected to ``PROJECTED`` Gaussian (2-stable) directions: if
s is a distance, the squared distance of the projections is s^2 times a chi-square variable with that many degrees of freedom.

The index is a kd-tree over the projections. Its upper part, cells of about equal numbers, is fitted on at most ``SAMPLE``
projected vectors; every vector goes into a cell, and a cell of more than ``BLOCK`` vectors is several blocks (by a hash of the
vector), so neither a dense region nor a large table makes a large group. Inside a block a kd-tree cuts down to leaves of
``LEAF``. A query first searches a block of its own cell. Its k-th best distance d then stops the rest: projections further away than
d * sqrt(chi-square quantile of ``SURE``) hold a nearer vector with probability below 1 - ``SURE``, so only the cells whose boxes are
nearer are visited, and in each block the leaves are verified by rising projected distance until the test holds for the d of
that moment. There is no limit on candidates. Verification is the whole inner product in double precision, component by component
in order, for every vector of a visited leaf.

Equal vectors are one vector with its k + 1 smallest ids, for queries and candidates alike, so a vector that a third of the rows
share is searched for once. Groups hold at most ``BLOCK`` vectors and about ``QUERIES`` queries.

Defined results: rows with a NULL id, and vectors that are NULL, empty, zero or hold NULL or non-finite components, take no
part; a shorter vector counts as followed by zeros; a candidate is never its query's own id; a repeated row (same id and
vector) counts once, and one id with different vectors is several queries and candidates; fewer than k candidates give fewer ranks; an
empty table gives an empty result. Only vec_id (an integer) and embedding (numbers) are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import erf, exp, gamma, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from criticlens.llm.words import ship
from criticlens.operators.joins import hot_keys, lookup_join
from criticlens.session import stage

K = 20
EVERY = 20
PROJECTED = 12
SURE = 0.95
SAMPLE = 20000
BLOCK = 8192
QUERIES = 8192
LEAF = 256
SEED = 11
_PAIRS = 1 << 20


def chi_square(x: float, n: int) -> float:
    """The share of a chi-square variable with ``n`` degrees of freedom below ``x``: the finite sums for even and odd n."""
    if x <= 0:
        return 0.0
    half = x / 2
    if n % 2 == 0:
        return 1 - exp(-half) * sum(half**j / gamma(j + 1) for j in range(n // 2))
    return erf(sqrt(half)) - exp(-half) * sum(half ** (j + 0.5) / gamma(j + 1.5) for j in range(n // 2))


def chi_square_quantile(p: float, n: int) -> float:
    low, high = 0.0, float(n)
    while chi_square(high, n) < p:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, n) < p else (low, middle)
    return high


# --- the tree -------------------------------------------------------------------------------------


def split(points: np.ndarray, size: int, rows: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The rows of each leaf of a kd-tree with at most ``size`` points a leaf: halves at the median of the widest direction."""
    rows = np.arange(len(points)) if rows is None else rows
    if len(rows) <= size:
        yield rows
        return
    part = points[rows]
    order = np.argsort(part[:, np.argmax(np.ptp(part, axis=0))], kind="stable")
    half = len(rows) // 2
    yield from split(points, size, rows[order[:half]])
    yield from split(points, size, rows[order[half:]])


@dataclass
class Cells:
    """The upper part of the tree: per inner node a direction, a cut and two children (leaves are ~cell), and a box per cell."""

    nodes: list[tuple[int, float, int, int]]
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, size: int) -> Cells:
        nodes: list[tuple[int, float, int, int]] = []
        boxes: list[tuple[np.ndarray, np.ndarray]] = []

        def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> int:
            part = sample[rows]
            spread = np.ptp(part, axis=0) if len(rows) else np.zeros(len(low))
            if len(rows) <= size or not spread.any():
                boxes.append((low, high))
                return ~(len(boxes) - 1)
            axis = int(np.argmax(spread))
            cut = float(np.median(part[:, axis]))
            cut = cut if (part[:, axis] < cut).any() else float(np.nextafter(part[:, axis].min(), np.inf))
            here, left, right = part[:, axis] < cut, high.copy(), low.copy()
            left[axis] = right[axis] = cut
            at = len(nodes)
            nodes.append((axis, cut, 0, 0))
            nodes[at] = (axis, cut, grow(rows[here], low, left), grow(rows[~here], right, high))
            return at

        width = sample.shape[1]
        grow(np.arange(len(sample)), np.full(width, -np.inf), np.full(width, np.inf))
        return cls(nodes, np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes]))

    def find(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        cell = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))] if self.nodes else []
        while todo:
            at, rows = todo.pop()
            axis, cut, left, right = self.nodes[at]
            below = points[rows, axis] < cut
            for child, part in ((left, rows[below]), (right, rows[~below])):
                if child < 0:
                    cell[part] = ~child
                else:
                    todo.append((child, part))
        return cell

    def near(self, points: np.ndarray, reach: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Per cell the points whose squared distance from its box is at most their ``reach``."""
        for c in range(len(self.low)):
            away = np.maximum(np.maximum(self.low[c] - points, points - self.high[c]), 0.0)
            rows = np.flatnonzero((away**2).sum(axis=1) <= reach)
            if len(rows):
                yield c, rows


@dataclass
class Space:
    """What turns vectors into projected points."""

    dimension: int
    scale: float
    longest: float
    directions: np.ndarray

    def points(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Projections of the lengthened vectors; queries are scaled to the longest and get 0 as their last component."""
        scaled = vectors / self.scale
        square = (scaled**2).sum(axis=1)
        if query:
            return (scaled * (self.longest / np.sqrt(square))[:, None]) @ self.directions[:-1]
        last = np.sqrt(np.maximum(self.longest**2 - square, 0.0))
        return scaled @ self.directions[:-1] + last[:, None] * self.directions[-1]

    def distance(self, scores: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Squared distances that belong to inner products with the (unscaled) query vectors."""
        length = np.sqrt(((vectors / self.scale) ** 2).sum(axis=1))
        return np.maximum(2 * self.longest * (self.longest - scores / self.scale / self.scale / length), 0.0)


def matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    """Rows of numbers as a matrix, shorter ones followed by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), dimension))
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(dimension) < sizes[:, None]] = values
    return out


# --- one block ------------------------------------------------------------------------------------


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, each summed in the order of the components, so that equal pairs give equal numbers everywhere."""
    total = np.multiply.outer(a[:, 0], b[:, 0])
    for k in range(1, a.shape[1]):
        total += np.multiply.outer(a[:, k], b[:, k])
    return total


def search(space: Space, reach: float, k: int, q: np.ndarray, limit: np.ndarray, x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the ``k`` best vectors of a block per query, by (score, -ids).

    ``limit`` is a squared distance known to hold ``k`` vectors already. Per round every query that the test has not stopped
    verifies its next leaf.
    """
    points, asked = space.points(x, False), space.points(q, True)
    leaves = list(split(points, LEAF))
    away = np.empty((len(q), len(leaves)))
    for n, leaf in enumerate(leaves):
        low, high = points[leaf].min(axis=0), points[leaf].max(axis=0)
        away[:, n] = (np.maximum(np.maximum(low - asked, asked - high), 0.0) ** 2).sum(axis=1)
    turn = np.argsort(away, axis=1, kind="stable")
    limit = limit.copy()
    least = np.full(len(q), -np.inf)
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    active = np.arange(len(q))
    for step in range(len(leaves)):
        active = active[away[active, turn[active, step]] <= reach * limit[active]]
        if not len(active):
            break
        found = [best]
        for n in np.unique(turn[active, step]).tolist():
            rows, leaf = active[turn[active, step] == n], leaves[n]
            for s in range(0, len(rows), max(1, _PAIRS // len(leaf))):
                part = rows[s : s + max(1, _PAIRS // len(leaf))]
                scores = inner(q[part], x[leaf])
                i, j = np.nonzero(scores >= least[part][:, None])
                found.append((part[i], leaf[j], scores[i, j]))
        who, what, score = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((ids[what], -score, who))
        who, what, score = who[order], what[order], score[order]
        start = np.searchsorted(who, who)
        keep = np.arange(len(who)) - start < k
        who, what, score = who[keep], what[keep], score[keep]
        last = np.flatnonzero(np.arange(len(who)) - np.searchsorted(who, who) == k - 1)
        least[who[last]] = score[last]
        limit[who[last]] = np.minimum(limit[who[last]], space.distance(score[last], q[who[last]]))
        best = (who, what, score)
    return best


# --- over tables ----------------------------------------------------------------------------------

_VECTOR = "v1 long, v2 long, embedding array<double>"
_INDEXED = f"{_VECTOR}, ids array<long>, query boolean, cell long"


def vectors_of(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding, v1, v2) of the rows that take part; v1 and v2 name the vector."""
    vector = F.col("embedding").cast("array<double>")
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    taken = rows.select(F.col("vec_id").cast("long"), vector.alias("embedding")).where(F.col("vec_id").isNotNull() & good)
    # 0.0 and -0.0 are one number.
    plain = F.transform("embedding", lambda x: x + F.lit(0.0))
    taken = taken.withColumn("embedding", plain)
    return taken.withColumn("v1", F.xxhash64("embedding")).withColumn("v2", F.xxhash64(F.lit(1), "embedding"))


def distinct_vectors(rows: DataFrame, k: int, every: int) -> DataFrame:
    """One row per vector: its k + 1 smallest ids, and whether one of all its ids is a query."""
    # The limit on the row number is applied before the shuffle too, so a frequent vector is k + 1 rows per task.
    places = rows.select("v1", "v2", "vec_id").distinct().withColumn("n", F.row_number().over(Window.partitionBy("v1", "v2").orderBy("vec_id")))
    ids = places.where(F.col("n") <= k + 1).groupBy("v1", "v2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    first = rows.groupBy("v1", "v2").agg(
        F.min(F.struct("vec_id", "embedding")).getField("embedding").alias("embedding"), F.max(F.col("vec_id") % every == 0).alias("query")
    )
    return first.join(ids, ["v1", "v2"])


def _index(space: Space, cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch["embedding"], space.dimension)
            yield batch.append_column("cell", pa.array(cells.find(space.points(vectors, False)), pa.int64()))

    return run


def _ask(space: Space, cells: Cells, blocks: dict[int, int], parts: int, reach: float, home: bool):
    """Rows (cell, block, part) of the queries: the first block of their own cell, or all others that the test leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = space.points(matrix(batch["embedding"], space.dimension), True)
            own = cells.find(points)
            if home:
                visits = [(int(c), np.flatnonzero(own == c)) for c in np.unique(own)]
            else:
                visits = list(cells.near(points, reach * batch["limit"].to_numpy()))
            part = batch["v1"].to_numpy() % parts
            for cell, rows in visits:
                for block in range(1 if home else blocks.get(cell, 0)):
                    # The first block of the own cell has been searched.
                    here = rows if home or block else rows[own[rows] != cell]
                    if len(here):
                        out = batch.take(pa.array(here)).select(["v1", "v2", "embedding", "limit"])
                        for name, values in (("cell", np.full(len(here), cell)), ("block", np.full(len(here), block)), ("part", part[here])):
                            out = out.append_column(name, pa.array(values, pa.int64()))
                        yield out

    return run


def _meet(space: Space, reach: float, k: int):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        kinds = [("v1", pa.int64()), ("v2", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64())), ("limit", pa.float64())]
        if not len(asked) or not len(held):
            return pa.schema(kinds).empty_table()
        q, x = matrix(asked["embedding"], space.dimension), matrix(held["embedding"], space.dimension)
        lists = held["ids"].combine_chunks()
        first = lists.values.to_numpy()[lists.offsets.to_numpy()[:-1]]
        who, what, score = search(space, reach, k, q, asked["limit"].to_numpy(), x, first)
        taken = asked.take(pa.array(who))
        columns = [taken["v1"], taken["v2"], pa.array(score, pa.float64()), lists.take(pa.array(what)), pa.array(space.distance(score, q[who]), pa.float64())]
        return pa.table(columns, schema=pa.schema(kinds))

    return run


def _space(vectors: DataFrame) -> Space | None:
    """Dimension and longest length in one pass; the directions come from the seed."""
    dimension, scale = vectors.agg(F.max(F.size("embedding")), F.max(F.array_max(F.transform("embedding", F.abs)))).first()
    if dimension is None:
        return None
    square = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + (x / F.lit(scale)) * (x / F.lit(scale)))
    longest = vectors.agg(F.max(square)).first()[0] ** 0.5
    directions = np.random.Generator(np.random.PCG64(SEED)).standard_normal((dimension + 1, PROJECTED))
    return Space(dimension, scale, longest, directions)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best (score, smallest id) rows per query vector."""
    order = Window.partitionBy("v1", "v2").orderBy(F.desc("score"), F.col("ids")[0])
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def nearest(rows: DataFrame, k: int = K, every: int = EVERY, sure: float = SURE) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of each row whose id is divisible by ``every``."""
    spark = rows.sparkSession
    taken = vectors_of(rows)
    vectors = stage(distinct_vectors(taken, k, every))
    space = _space(vectors)
    if space is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    reach = chi_square_quantile(sure, PROJECTED)
    sample = vectors.orderBy(F.xxhash64("v2", F.lit(SEED)), "v1").limit(SAMPLE).select("embedding").toArrow()
    n = vectors.count()
    cells = Cells.fit(space.points(matrix(sample["embedding"], space.dimension), False), max(2, min(SAMPLE, n) * BLOCK // n))
    index = stage(vectors.select("v1", "v2", "embedding", "ids", "query").mapInArrow(_index(space, cells), _INDEXED))
    sizes = {r["cell"]: -(-r["n"] // BLOCK) for r in index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_blocks = F.coalesce(F.get(F.expr(f"cast(split('{','.join(str(sizes.get(c, 1)) for c in range(len(cells.low)))}', ',') as array<bigint>)"), F.col("cell").cast("int")), F.lit(1))
    block = F.pmod(F.xxhash64("v1", "v2"), n_blocks).alias("block")
    queries = index.where("query")
    parts = max(1, -(-queries.count() // QUERIES))
    held = index.select("cell", block, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "embedding", "ids")
    key = ["cell", "block", "part"]
    result = "v1 long, v2 long, score double, ids array<long>, limit double"
    sent = f"{_VECTOR}, limit double, cell long, block long, part long"

    def round_of(asked: DataFrame, home: bool) -> DataFrame:
        asked = asked.mapInArrow(_ask(space, cells, sizes, parts, reach, home), sent)
        return stage(asked.groupBy(key).cogroup(held.groupBy(key)).applyInArrow(_meet(space, reach, k + 1), result))

    start = queries.select("v1", "v2", "embedding", F.lit(float("inf")).alias("limit"))
    first = round_of(start, True)
    # The distance of the last of k + 1 vectors found; infinite while there are fewer.
    bounds = first.groupBy("v1", "v2").agg(F.count(F.lit(1)).alias("n"), F.max("limit").alias("far")).where(F.col("n") > k)
    known = queries.select("v1", "v2", "embedding").join(bounds, ["v1", "v2"], "left")
    second = round_of(known.select("v1", "v2", "embedding", F.coalesce("far", F.lit(float("inf"))).alias("limit")), False)
    best = _best(first.unionByName(second).select("v1", "v2", "score", "ids"), k + 1)

    # All ids of the best vectors, the k + 1 best rows per query vector, then each query row without itself.
    lists = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("_at"), F.col("ids")[0].alias("_id"), "score", "ids"))),
                                  lambda r: F.transform(r.ids, lambda i: F.struct(r["_at"].alias("at"), i.alias("vec_id"), r.score.alias("score")))))
    lists = best.groupBy("v1", "v2").agg(F.sort_array(F.array_distinct(lists)).alias("near"))
    lists = lists.select(F.struct("v1", "v2").alias("vector"), "near")
    asked = taken.where(F.col("vec_id") % every == 0).select(F.struct("v1", "v2").alias("vector"), F.col("vec_id").alias("query_id")).distinct()
    hot = hot_keys(asked.groupBy("vector").agg(F.count(F.lit(1)).alias("n")), "vector")
    joined = lookup_join(asked, lists, "vector", hot)
    others = F.slice(F.filter("near", lambda r: r.vec_id != F.col("query_id")), 1, k)
    spread = joined.select("query_id", F.posexplode(others).alias("at", "r"))
    return spread.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "r.vec_id", "r.score")


ship(__name__)
