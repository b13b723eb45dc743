"""Nearest neighbours by inner product in vantage-point trees, one for each shard.

A shard's vectors get one more component, so that all have the length of its
longest: Euclidean distance to a query with 0 there then sorts like the inner
product, and the triangle inequality holds.  A node keeps the smallest and the
largest distance of either half to its vantage point.  A half whose bound lies
beyond ``factor`` times the distance of the k-th best found so far is skipped:
factor one skips only what cannot be among the k best (exact search), smaller
factors skip more.  Each query first goes down to its nearest leaf, so that
this distance is small from the start.  Bounds are taken of vectors scaled by
powers of two, so that no square overflows; scores are of the vectors as they
are, infinite where the product is beyond the range of doubles.

Every row is indexed, equal ones once with their number.  Queries travel in blocks to every shard; a shard
returns at most k rows for each query, and these are ranked again.  Vectors
that are null, zero or hold null or non-finite components, and rows without an
id, take no part; a vector meets only those with as many components.  Rows
with the same id are the same vector to a query, which never meets its own id;
as candidates they count one by one.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lanelytics.llm.common import batch_of, stored

NEIGHBOURS, FACTOR = 20, 1.0
#: Vectors of a shard on average, of a leaf at most, and queries of a block on average.
SHARD, LEAF, BLOCK = 8192, 256, 1024
#: Rounding that bounds and products allow for, relative to the squared lengths.
SLACK = 1e-9


def usable(vector: str) -> Column:
    """Vectors of finite components, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _summed(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    total = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        total += queries[:, d] * vectors[:, d]
    return total


def exponents(vectors: np.ndarray) -> np.ndarray:
    """For each row the power of two just above its largest component."""
    return np.frexp(np.abs(vectors).max(1, initial=0.0))[1]


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in the order of the components; rows that overflow on the way are scaled first."""
    with np.errstate(over="ignore", invalid="ignore"):
        total = _summed(queries, vectors)
        beyond = np.flatnonzero(~np.isfinite(total))
        if len(beyond):
            queries, vectors = queries[beyond], vectors[beyond]
            of_query, of_vector = exponents(queries), exponents(vectors)
            small = _summed(np.ldexp(queries, -of_query[:, None]), np.ldexp(vectors, -of_vector[:, None]))
            total[beyond] = np.ldexp(small, of_query + of_vector)
    return total


class Tree:
    """A balanced tree over rows in tree order: node [begin, end) has its vantage point at ``begin``."""

    def __init__(self, ids: np.ndarray, times: np.ndarray, vectors: np.ndarray, bounds: np.ndarray):
        self.ids, self.times, self.vectors, self.bounds = ids, times, vectors, bounds
        self.exponent = int(exponents(vectors).max())
        self.scaled = np.ldexp(vectors, -self.exponent)
        squares = (self.scaled * self.scaled).sum(1)
        self.longest = squares.max()
        self.raised = np.column_stack([self.scaled, np.sqrt(self.longest - squares)])

    @staticmethod
    def middle(begin: int, end: int) -> int:
        return (begin + 1 + end) // 2

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, times: np.ndarray | None = None) -> Tree:
        order = np.argsort(ids, kind="stable")
        times = np.ones(len(ids), np.int64) if times is None else times
        tree = cls(ids[order], times[order], vectors[order], np.zeros((0, 4)))
        order, bounds = np.arange(len(ids)), []

        def split(begin: int, end: int) -> None:
            if end - begin <= leaf:
                return
            rows = order[begin:end]
            spread = np.linalg.norm(tree.raised[rows] - tree.raised[rows].mean(0), axis=1)
            top = int(np.argmax(spread))
            rows[[0, top]] = rows[[top, 0]]
            away = np.linalg.norm(tree.raised[rows[1:]] - tree.raised[rows[0]], axis=1)
            by_distance = np.argsort(away, kind="stable")
            order[begin + 1 : end] = rows[1:][by_distance]
            away, inner = away[by_distance], cls.middle(begin, end) - begin - 1
            bounds.append((away[0], away[inner - 1], away[inner], away[-1]))
            split(begin + 1, begin + 1 + inner)
            split(begin + 1 + inner, end)

        split(0, len(ids))
        return cls(tree.ids[order], tree.times[order], tree.vectors[order], np.array(bounds).reshape(-1, 4))

    def nodes(self, leaf: int = LEAF) -> list[tuple[int, int, int]]:
        """(begin, end, number of the node's bounds or -1 for a leaf), parents first."""
        found, inner = [], 0

        def walk(begin: int, end: int) -> None:
            nonlocal inner
            if end - begin <= leaf:
                found.append((begin, end, -1))
                return
            found.append((begin, end, inner))
            inner += 1
            walk(begin + 1, self.middle(begin, end))
            walk(self.middle(begin, end), end)

        walk(0, len(self.ids))
        return found


class Search:
    """The k best of one tree for a block of queries."""

    def __init__(self, tree: Tree, ids: np.ndarray, queries: np.ndarray, k: int, factor: float):
        self.tree, self.ids, self.queries, self.k, self.factor = tree, ids, queries, k, factor
        self.exponents = exponents(queries)
        self.scaled = np.ldexp(queries, -self.exponents[:, None])
        self.raised = np.column_stack([self.scaled, np.zeros(len(ids))])
        self.squares = (self.scaled * self.scaled).sum(1)
        self.slack = SLACK * (self.squares + tree.longest)
        self.scores = np.full((len(ids), k), -np.inf)
        self.places = np.full((len(ids), k), -1, np.int64)  # places in the tree
        self.number = {(begin, end): at for begin, end, at in tree.nodes()}

    @property
    def found(self) -> np.ndarray:
        """Ids of the k best, -1 where fewer are found."""
        return np.where(self.places < 0, -1, self.tree.ids[self.places])

    def worst(self, rows: np.ndarray) -> np.ndarray:
        """Scores of the k-th best in the scale of the bounds; minus infinity where fewer are found."""
        most = np.finfo(np.float64).max
        with np.errstate(over="ignore"):
            scaled = np.ldexp(np.clip(self.scores[rows, -1], -most, most), -self.exponents[rows] - self.tree.exponent)
        return np.where(self.places[rows, -1] < 0, -np.inf, scaled)

    def radius(self, rows: np.ndarray) -> np.ndarray:
        square = self.squares[rows] + self.tree.longest - 2 * self.worst(rows)
        return self.factor * np.sqrt(np.maximum(square, 0)) + np.sqrt(self.slack[rows])

    def away(self, rows: np.ndarray, begin: int) -> np.ndarray:
        return np.linalg.norm(self.raised[rows] - self.tree.raised[begin], axis=1)

    def look(self, rows: np.ndarray, begin: int, end: int) -> None:
        """Takes the vectors in [begin, end) into account."""
        roughly = self.scaled[rows] @ self.tree.scaled[begin:end].T
        hopeful = roughly >= (self.worst(rows) - self.slack[rows])[:, None]
        hopeful &= self.ids[rows][:, None] != self.tree.ids[begin:end][None, :]
        row, at = np.nonzero(hopeful)
        if not len(row):
            return
        changed = np.unique(row)
        row, at = rows[row], at + begin
        exact = products(self.queries[row], self.tree.vectors[at])
        kept = rows[changed]
        of = np.concatenate([np.repeat(kept, self.k), row])
        score = np.concatenate([self.scores[kept].ravel(), exact])
        place = np.concatenate([self.places[kept].ravel(), at])
        order = np.lexsort((self.tree.ids[place], place < 0, -score, of))
        of, score, place = of[order], score[order], place[order]
        first = np.searchsorted(of, kept)
        best = (first[:, None] + np.arange(self.k)[None, :]).ravel()
        self.scores[kept], self.places[kept] = score[best].reshape(-1, self.k), place[best].reshape(-1, self.k)

    def run(self) -> None:
        everyone = np.arange(len(self.ids))
        self.home = np.zeros(len(self.ids), np.int64)
        self._descend(everyone, 0, len(self.tree.ids))
        self._visit(everyone, 0, len(self.tree.ids))

    def _descend(self, rows: np.ndarray, begin: int, end: int) -> None:
        if not len(rows):
            return
        number = self.number[begin, end]
        if number < 0:
            self.home[rows] = begin
            self.look(rows, begin, end)
            return
        _, inner, outer, _ = self.tree.bounds[number]
        nearer = self.away(rows, begin) <= (inner + outer) / 2
        middle = Tree.middle(begin, end)
        self._descend(rows[nearer], begin + 1, middle)
        self._descend(rows[~nearer], middle, end)

    def _visit(self, rows: np.ndarray, begin: int, end: int) -> None:
        if not len(rows):
            return
        number = self.number[begin, end]
        if number < 0:
            rows = rows[self.home[rows] != begin]
            if len(rows):
                self.look(rows, begin, end)
            return
        self.look(rows, begin, begin + 1)
        middle = Tree.middle(begin, end)
        away = self.away(rows, begin)
        for half, (low, high) in (
            ((begin + 1, middle), self.tree.bounds[number, :2]),
            ((middle, end), self.tree.bounds[number, 2:]),
        ):
            bound = np.maximum(low - away, away - high)
            self._visit(rows[bound <= self.radius(rows)], *half)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64)


def _build(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
    tree = Tree.build(shard["vec_id"].to_numpy(np.int64), _matrix(shard["vector"]), times=shard["times"].to_numpy(np.int64))
    packed = [[key[0], key[1], tree.ids.tobytes(), tree.times.tobytes(), tree.vectors.tobytes(), tree.bounds.tobytes()]]
    return pd.DataFrame(packed, columns=["size", "shard", "ids", "times", "vectors", "bounds"])


def _block(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("vec_id")
    packed = [[key[0], key[1], block["vec_id"].to_numpy(np.int64).tobytes(), _matrix(block["vector"]).tobytes()]]
    return pd.DataFrame(packed, columns=["size", "block", "query_ids", "queries"])


def _search(k: int, factor: float):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("times", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                ids = np.frombuffer(row["ids"], np.int64)
                tree = Tree(
                    ids,
                    np.frombuffer(row["times"], np.int64),
                    np.frombuffer(row["vectors"]).reshape(len(ids), row["size"]),
                    np.frombuffer(row["bounds"]).reshape(-1, 4),
                )
                query_ids = np.frombuffer(row["query_ids"], np.int64)
                search = Search(tree, query_ids, np.frombuffer(row["queries"]).reshape(-1, row["size"]), k, factor)
                search.run()
                full = search.places >= 0
                at = search.places[full]
                yield batch_of(schema, np.repeat(query_ids, k)[full.ravel()], ids[at], tree.times[at], search.scores[full])

    return run


def nearest(
    embeddings: DataFrame, vector: str = "embedding", k: int = NEIGHBOURS, factor: float = FACTOR, every: int = 20
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows nearest to each row whose id is divisible by ``every``."""
    rows = embeddings.filter(usable(vector) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long"),
        F.col(vector).cast("array<double>").alias("vector"),
        F.size(vector).alias("size"),
    )
    is_query = F.col("vec_id") % every == 0
    total = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    shards, blocks = max(1, -(-total["n"] // SHARD)), max(1, -(-total["q"] // BLOCK))
    index = stored(
        rows.groupBy("size", "vec_id", "vector")
        .agg(F.count("*").alias("times"))
        .withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int"))
        .groupBy("size", "shard")
        .applyInPandas(_build, "size int, shard int, ids binary, times binary, vectors binary, bounds binary")
    )
    queries = (
        rows.filter(is_query)
        .dropDuplicates(["vec_id"])
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
        .groupBy("size", "block")
        .applyInPandas(_block, "size int, block int, query_ids binary, queries binary")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )
    found = index.join(queries, ["size", "shard"]).mapInArrow(
        _search(k, factor), "query_id long, vec_id long, times long, score double"
    )
    each = F.explode(F.array_repeat("score", F.least("times", F.lit(k)).cast("int"))).alias("score")
    found = found.select("query_id", "vec_id", each)
    best_first = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
