"""Exact top-k search over whole-number vectors with bounds from segment statistics.

A vector is cut into segments; of each its mean and deviation are kept, at several resolutions. For two
vectors q and x and segments of n components

    distance² >= sum over segments of n * ((mean q - mean x)² + (deviation q - deviation x)²)

so ``score = (|q|² + |x|² - distance²) / 2`` is bounded from above by what the statistics give. Query
blocks meet all candidates as they stream by; candidates pass the resolutions from coarse to fine, and only
pairs whose bound reaches the query's present k-th score get exact distances.

Spark deals candidates to (query block, stripe); a task holds one block of queries and one batch of
candidates. The stripes of a query block are there for parallel work, and each query gets back at most k
rows from each. Nothing is broadcast, and no pair leaves a task unless it is among a stripe's best k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: components of all queries of a block, and of the candidates that are compared at once
BLOCK_CELLS, CHUNK_CELLS = 1 << 18, 1 << 15
#: average components in a segment, coarse to fine
SEGMENTS = (16, 4, 2)
#: below this share of surviving pairs they are gathered one by one
SPARSE = 1 / 32
EXACT = float(1 << 52)


def whole_vectors(rows: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """``id``, ``x`` (array of long): floor(scale * component) of vectors without null or non-finite components."""
    name = lambda c: F.col(f"`{c}`")
    given = rows.select(name(vec_id).alias("id"), name(embedding).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return given.where(F.col("v").isNotNull() & ~odd & (F.size("v") > 0)).select(
        "id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))


class Resolution:
    """Segment statistics as features whose inner product bounds the score."""

    def __init__(self, dim: int, length: int):
        count = max(1, -(-dim // length))
        self.starts = np.arange(count) * dim // count
        self.sizes = np.diff(np.append(self.starts, dim)).astype(float)

    def features(self, x: np.ndarray) -> np.ndarray:
        total = np.add.reduceat(x, self.starts, axis=1)
        square = np.add.reduceat(x * x, self.starts, axis=1)
        deviation = np.sqrt(np.maximum(square - total * total / self.sizes, 0))
        return np.concatenate([total / np.sqrt(self.sizes), deviation], axis=1)


class Block:
    """Queries with their best k so far; ids are places in the id order of all rows seen."""

    def __init__(self, ids: list, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.number = {}
        for i, q in enumerate(ids):
            self.number.setdefault(q, []).append(i)
        self.levels = [Resolution(x.shape[1], n) for n in SEGMENTS]
        self.real = x.astype(float)
        self.features = [r.features(self.real) for r in self.levels]
        self.largest = np.abs(self.real).max(initial=0)
        self.norm = np.sqrt((self.real ** 2).sum(axis=1))
        self.best: list[list[tuple]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)  # a pair below this score is of no use
        self.compared = self.exact = 0

    def meet(self, ids: list, x: np.ndarray) -> None:
        step = max(1, CHUNK_CELLS // max(1, x.shape[1]))
        for lo in range(0, len(ids), step):
            self._meet(ids[lo:lo + step], x[lo:lo + step])

    def _meet(self, ids: list, x: np.ndarray) -> None:
        real = x.astype(float)
        own = [(i, j) for j, c in enumerate(ids) for i in self.number.get(c, ())]
        norm = np.sqrt((real ** 2).sum(axis=1))
        # rounding of the bounds
        need = self.least - 0.5
        columns, alive = np.arange(len(ids)), None
        if np.isfinite(self.least).any():
            for r, mine in zip(self.levels, self.features):
                bound = mine @ r.features(real[columns]).T
                bound += 1e-9 * self.norm[:, None] * norm[columns][None, :]
                alive = bound >= need[:, None]
                some = alive.any(axis=0)
                columns, alive = columns[some], alive[:, some]
        else:
            alive = np.ones((len(self.ids), len(ids)), dtype=bool)
        for i, j in own:
            at = np.searchsorted(columns, j)
            if at < len(columns) and columns[at] == j:
                alive[i, at] = False
        self.compared += alive.size if alive is not None else 0
        if not alive.any():
            return
        safe = self.largest * np.abs(real).max(initial=0) * x.shape[1] < EXACT
        share = alive.mean()
        if share < SPARSE or not safe:
            q, c = np.nonzero(alive)
            score = np.empty(len(q), dtype=np.int64)
            for lo in range(0, len(q), 1 << 14):
                part = slice(lo, lo + (1 << 14))
                score[part] = (self.x[q[part]] * x[columns[c[part]]]).sum(axis=1)
        else:
            full = self.real @ real[columns].T
            alive &= full >= self.least[:, None]
            q, c = np.nonzero(alive)
            score = full[q, c].astype(np.int64)
        self.exact += len(q)
        keep = score >= self.least[q]
        q, c, score = q[keep], columns[c[keep]], score[keep]
        cut = np.flatnonzero(np.diff(q, prepend=-1)) if len(q) else np.zeros(0, dtype=int)
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(q)]):
            self._take(int(q[lo]), score[lo:hi], c[lo:hi], ids)

    def _take(self, i: int, score: np.ndarray, c: np.ndarray, ids: list) -> None:
        if len(score) > self.k:  # all that reach the k-th score of this chunk
            edge = np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, c = score[score >= edge], c[score >= edge]
        rows = self.best[i] + [(-s, ids[j] is None, ids[j]) for s, j in zip(score.tolist(), c.tolist())]
        rows.sort(key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))
        self.best[i] = rows[:self.k]
        if len(rows) >= self.k:
            self.least[i] = -rows[self.k - 1][0]


def _matrix(x: pa.ListArray) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def exact_top_k(rows: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with ``is_query`` (a condition on columns of ``rows``) the ``k`` rows of
    highest inner product of floor(scale * component), ties to the smaller id.

    Null vectors, empty ones, and those with null or non-finite components take no part. Vectors of another length than the
    query's aren't its candidates. A row with the query's own id is the query; rows that repeat a query's id and vector are one query,
    while repeated candidates each count. Rows without an id are candidates, last among equal scores, and queries under the
    null id if the condition says so. Scores beyond 64 bits wrap. Empty tables give empty tables; other columns are not read.
    """
    spark = rows.sparkSession
    id_type = rows.schema[vec_id].dataType
    sized = lambda df: df.withColumn("dim", F.size("x"))
    every = sized(whole_vectors(rows, vec_id, embedding, scale))
    asked = sized(whole_vectors(rows.where(is_query), vec_id, embedding, scale)).distinct()
    # sums, in case of vectors of several lengths
    cells = asked.agg(F.sum(F.col("dim").cast("long"))).first()[0] or 0
    blocks = max(1, -(-cells // BLOCK_CELLS))
    stripes = max(1, 4 * spark.sparkContext.defaultParallelism // blocks)
    fields = ["dim", "block", "stripe", "kind", "id", "x"]
    queries = (asked.withColumn("block", F.pmod(F.xxhash64("id", "x"), F.lit(blocks)).cast("int"))
               .withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).withColumn("kind", F.lit(0)))
    candidates = (every.withColumn("stripe", F.pmod(F.xxhash64("x", "id"), F.lit(stripes)).cast("int"))
                  .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("kind", F.lit(1)))
    key = ["dim", "block", "stripe"]
    dealt = (queries.select(*fields).union(candidates.select(*fields)).repartition(max(blocks * stripes, 1), *key)
             .sortWithinPartitions(*key, "kind"))
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("query_hash", T.LongType()), T.StructField("found", T.ArrayType(
        T.StructType([T.StructField("vec_id", id_type), T.StructField("score", T.LongType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        now, ids, parts, block = None, [], [], None

        def results() -> pa.RecordBatch:
            found = [[{"vec_id": c, "score": -s} for s, _, c in b] for b in block.best]
            weights = np.random.default_rng(7).integers(0, 1 << 62, block.x.shape[1])
            names = (block.x * weights).sum(axis=1)  # tells queries that share an id apart
            return pa.RecordBatch.from_arrays([pa.array(block.ids, arrow[0].type), pa.array(names, pa.int64()), pa.array(found, arrow[2].type)], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            cut = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cut, cut[1:]):
                group, kind = tuple(marks[lo, :3]), marks[lo, 3]
                if group != now:
                    if block is not None:
                        yield results()
                    now, ids, parts, block = group, [], [], None
                part_ids, x = batch.column(4)[lo:hi].to_pylist(), _matrix(batch.column(5)[lo:hi])
                if kind == 0:
                    ids += part_ids
                    parts.append(x)
                    continue
                if block is None and ids:
                    block = Block(ids, np.concatenate(parts), k)
                if block is not None:
                    block.meet(part_ids, x)
        if block is not None:
            yield results()

    found = dealt.mapInArrow(run, schema).select("query_id", "query_hash", F.explode("found").alias("f")).select("query_id", "query_hash", "f.*")
    order = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
