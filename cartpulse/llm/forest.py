"""Approximate nearest neighbours with a hash-prefix forest (LSH forest).

A tree hashes every vector to a string of HASH_BITS signs of random projections
and keeps the strings as a sorted array.  A query descends every tree at once to
the longest prefix it shares with some vector and then ascends in step, one bit
at a time in all trees, until the prefix ranges hold at least its share of
candidates; these are scored exactly (cosine of the original vectors, double
precision).

The index is sharded: every vector goes by hash of vec_id to one of the blocks
of about BLOCK_ROWS vectors, each block holds the forest of its own vectors, and
queries, in blocks of about QUERY_ROWS, visit every block.  Rows that repeat a
vec_id are reduced to one before blocks are counted, so a task holds one
block of vectors, its trees and one block of queries, whatever the data; a
block's answer is a query's k best, and the k best of all blocks are its result.

Candidates.  A query ascends until the trees' ranges together count SHARE of the
block (with repeats) or k times LEAST, and everything in the ranges is scored:
the share is a floor, not a cap.  The share buys recall: vectors without
structure (independent directions, 64 dimensions) share few prefix bits with
their nearest neighbours, so much of a block must be scored there; on clustered
vectors the first ranges already hold the neighbours.

Defined cases.  Vectors that are null, empty, zero or hold null or non-finite
components take no part, as candidates or as queries; nor do rows with null
vec_id.  Rows that repeat a vec_id are one vector (the least in order of its
components).  Only vectors of equal length are compared.  Equal scores are ordered by
vec_id.  A query with fewer than k candidates gets all of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES = 16
HASH_BITS = 32
BLOCK_ROWS = 8192
QUERY_ROWS = 8192
SHARE = 2.0
LEAST = 400
SEED = 20240601


def planes(dim: int, trees: int, bits: int = HASH_BITS) -> np.ndarray:
    return np.random.default_rng(SEED + dim).standard_normal((trees * bits, dim))


def hashes(vectors: np.ndarray, directions: np.ndarray, trees: int, bits: int = HASH_BITS) -> np.ndarray:
    """One unsigned number of ``bits`` signs for each tree and vector (trees x vectors)."""
    signs = (vectors @ directions.T > 0).reshape(len(vectors), trees, bits)
    return (signs @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))).T


class Forest:
    """Sorted hash strings of one block of vectors, one array for each tree."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES) -> None:
        self.vectors, self.trees = vectors, trees
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.directions = planes(vectors.shape[1], trees)
        strings = hashes(vectors, self.directions, trees)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.strings = np.take_along_axis(strings, self.order, axis=1)

    def ranges(self, queries: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) positions in each tree (trees x queries) at the deepest level that holds ``least`` candidates."""
        own = hashes(queries, self.directions, self.trees)
        first, end = np.zeros(own.shape, np.int64), np.full(own.shape, self.strings.shape[1], np.int64)
        rest = np.arange(len(queries))
        for depth in range(HASH_BITS, 0, -1):
            low = own[:, rest] >> (HASH_BITS - depth) << (HASH_BITS - depth)
            lo = np.stack([np.searchsorted(s, q) for s, q in zip(self.strings, low, strict=True)])
            hi = np.stack([np.searchsorted(s, q + (1 << (HASH_BITS - depth))) for s, q in zip(self.strings, low, strict=True)])
            enough = (hi - lo).sum(axis=0) >= least
            first[:, rest[enough]], end[:, rest[enough]] = lo[:, enough], hi[:, enough]
            rest = rest[~enough]
            if not len(rest):
                break
        return first, end

    def search(self, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, share: float = SHARE) -> tuple[list, list, list]:
        first, end = self.ranges(queries, max(int(share * len(ids)), k * LEAST))
        norms = np.sqrt((queries * queries).sum(axis=1))
        out_q, out_v, out_s = [], [], []
        for i, q in enumerate(queries):
            mark = np.zeros(len(ids), bool)
            for t in range(self.trees):
                mark[self.order[t, first[t, i] : end[t, i]]] = True
            found = np.flatnonzero(mark & (ids != query_ids[i]))
            score = (self.vectors[found] * q).sum(axis=1) / (self.norms[found] * norms[i])
            best = np.lexsort((ids[found], -score))[:k]
            out_q += [int(query_ids[i])] * len(best)
            out_v += ids[found[best]].tolist()
            out_s += score[best].tolist()
        return out_q, out_v, out_s


def _usable(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their vectors, in order of id."""
    frame = frame.sort_values("vec_id")
    return frame["vec_id"].to_numpy(np.int64), np.array(frame["vector"].tolist(), float)


def nearest(embeddings: DataFrame, k: int = 5, every: int = 50, share: float = SHARE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each vec_id divisible by ``every``."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).filter("vec_id IS NOT NULL AND size(vector) > 0")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    # one row for each id before the blocks are counted and built; repeats are reduced where they are read
    rows = rows.filter(fine).withColumn("dim", F.size("vector")).groupBy("dim", "vec_id").agg(F.min("vector").alias("vector")).checkpoint()
    n = rows.count()
    blocks, parts = max(1, -(-n // block_rows)), max(1, -(-n // (every * query_rows)))
    base = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = rows.filter(F.col("vec_id") % every == 0).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def answer(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        ids, vectors = _usable(own)
        query_ids, wanted = _usable(queries)
        q, v, s = Forest(vectors).search(ids, wanted, query_ids, k, share)
        return pd.DataFrame({"query_id": np.array(q, np.int64), "vec_id": np.array(v, np.int64), "score": np.array(s, float)})

    keys = ["dim", "block", "part"]
    found = base.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(answer, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
