"""Ranked search of many items at once, shared sets of terms evaluated once.

A term is a maximal match of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z
lower-cased.  The score of a document is a sum over an item's terms
(``contributions`` below gives them exactly), so items that share terms share parts
of the sum.

The plan of an evaluation (``query_graph``), mined from the items by Spark:

* terms that stand in the same items, as often in each, are one class and have
  one accumulator for each document;
* the classes of an item are put in one order for all items, those in most
  items first; a set of classes with which two items or more begin is a node.
  A node adds one class to its parent, so nodes form a graph that is shared by
  all items below it;
* an item is its deepest shared node plus the classes that no other item shares.

All of it takes one row for each term of an item; no pairs of terms or items are
made.  Items go into blocks, in the order of their class lists, of at most
BLOCK_TERMS terms (or one longer item); for each block the documents are read
twice, once for N, L and the document frequencies of the block's terms, once to
score.  A task holds CELLS accumulators (of as many documents as
that allows) and the best TOP documents of each item so far; it passes on the latter only, so no row for
each pair of item and document is ever made.

Defined cases.  A null or empty text has no terms; such a document counts
nowhere and is never returned, and such an item has no rows.  Each row of
documents is a document; rows that repeat a doc_id with equal scores are ranked
one after the other, null ids last.  Each row of the items is an item, with
ranks of its own.  Ties go to the smaller doc_id.  Long texts are read whole.
An empty table on either side gives an empty result.  Further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .tables import prefix_sums

TOP = 20
#: Terms of the items of one block (an item with more is a block of its own).
BLOCK_TERMS = 20_000
#: Accumulators that a task holds at once; the documents scored together follow from it.
CELLS = 1 << 22
#: Ways in which the rows of one item are merged before the last step.
SALTS = 16
#: Stands for a null doc_id in a task; the largest long, so null ids come last.
NO_ID = np.iinfo(np.int64).max


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) to (item, t, q): the terms of each item and how often each stands in it."""
    for batch in batches:
        for p in W.pieces(batch.column(1), W.ALNUM):
            item, t, q = _counted(p.text_of_word(), p.word_hashes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(p.first + item)), pa.array(W.signed(t)), pa.array(q)], names=["item", "t", "q"])


def _counted(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, h) in that order, with counts."""
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], h[first], np.diff(np.append(first, len(h)))


def query_graph(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, path) and (t, class) of the table ``items`` (item, text).

    path is the item's array of (class, q, node, shared): its classes, those in
    most items first, how often the item holds each term of the class, the id of
    the set of classes up to here and whether another item begins with that set.
    """
    terms = items.mapInArrow(_item_terms, "item long, t long, q long").checkpoint()
    # two sums of independent hashes stand for the set of (item, q) that a term belongs to
    mark = [F.sum(F.xxhash64(F.lit(seed), "item", "q").cast("decimal(38,0)")).alias(f"s{seed}") for seed in (1, 2)]
    classes = terms.groupBy("t").agg(*mark, F.count(F.lit(1)).alias("n_items")).select(
        "t", F.xxhash64("s1", "s2", "n_items").alias("class"), "n_items").checkpoint()
    steps = terms.join(classes, "t").groupBy("item", "class", "q").agg(F.max("n_items").alias("n_items"))
    lists = steps.groupBy("item").agg(F.array_sort(F.collect_list(F.struct((-F.col("n_items")).alias("rarity"), "class", "q"))).alias("steps"))
    ids = F.aggregate(
        "steps", F.array().cast("array<long>"),
        lambda nodes, s: F.concat(nodes, F.array(F.xxhash64(F.coalesce(F.try_element_at(nodes, F.lit(-1)), F.lit(0)), s["class"], s["q"]))))
    chains = lists.withColumn("nodes", ids).select("item", F.posexplode(F.arrays_zip("steps", "nodes")).alias("at", "s")).select(
        "item", "at", F.col("s.steps.class").alias("class"), F.col("s.steps.q").alias("q"), F.col("s.nodes").alias("node"))
    shared = chains.groupBy("node").agg((F.count(F.lit(1)) > 1).alias("shared"))
    paths = chains.join(shared, "node").groupBy("item").agg(
        F.array_sort(F.collect_list(F.struct("at", "class", "q", "node", "shared"))).alias("path"))
    return paths, classes.select("t", "class")


@dataclass
class Block:
    """The graph of a block of items, as arrays.

    Term i (sorted hashes ``terms``) adds to accumulator ``class_of[i]``.  Node
    j adds ``node_q[j]`` times accumulator ``node_class[j]`` to node
    ``parent[j]`` (-1: nothing); nodes come level by level, ``levels`` holding
    the bounds.  Item k is node ``item_node[k]`` (-1: none) plus the
    accumulators ``rest_class[rest[k]:rest[k + 1]]``, times ``rest_q``.
    """

    terms: np.ndarray
    class_of: np.ndarray
    n_classes: int
    items: np.ndarray
    parent: np.ndarray
    node_class: np.ndarray
    node_q: np.ndarray
    levels: np.ndarray
    item_node: np.ndarray
    rest: np.ndarray
    rest_class: np.ndarray
    rest_q: np.ndarray


def block_of(paths: list, terms: pa.Table) -> Block:
    """The arrays of one block: ``paths`` has its items, ``terms`` (t, class) their terms."""
    t, c = terms.column("t").to_numpy().view(W.U), terms.column("class").to_numpy()
    kinds, class_of = np.unique(c, return_inverse=True)
    order = np.argsort(t)
    number = {int(k): i for i, k in enumerate(kinds)}
    nodes: dict[int, tuple[int, int, int, int]] = {}
    ends, rests = [], []
    for row in paths:
        at = None
        rest = []
        for s in row["path"]:
            if s["shared"]:
                nodes.setdefault(s["node"], (s["at"], at, number[s["class"]], s["q"]))
                at = s["node"]
            else:
                rest.append((number[s["class"]], s["q"]))
        ends.append(at)
        rests.append(rest)
    ranked = sorted(nodes, key=lambda n: nodes[n][0])
    place = {n: i for i, n in enumerate(ranked)}
    depth = np.array([nodes[n][0] for n in ranked], np.int64)
    flat = [x for r in rests for x in r]
    return Block(
        t[order], class_of[order], len(kinds), np.array([r["item"] for r in paths], np.int64),
        np.array([place.get(nodes[n][1], -1) for n in ranked], np.int64), np.array([nodes[n][2] for n in ranked], np.int64),
        np.array([nodes[n][3] for n in ranked], np.int64), np.searchsorted(depth, np.arange(depth.max() + 2 if len(depth) else 1)),
        np.array([place.get(e, -1) for e in ends], np.int64), np.cumsum([0, *map(len, rests)]),
        np.array([x[0] for x in flat], np.int64), np.array([x[1] for x in flat], np.int64))


def _held(p: W.Piece, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, tf) of the block's terms in the texts of a piece, by text."""
    h, text = p.word_hashes(), p.text_of_word()
    at = np.minimum(np.searchsorted(terms, h), max(len(terms) - 1, 0))
    ours = terms[at] == h if len(terms) else np.zeros(len(h), bool)
    return _counted(text[ours], at[ours])


def _frequencies(block):
    """(text) to (t, n, words): documents that hold term t; the row of null t has the documents with terms and their terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = block.value["terms"]
        df, full, total = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for p in W.pieces(batch.column(0), W.ALNUM):
                df += np.bincount(_held(p, terms)[1], minlength=len(terms))
                full += int((np.diff(p.bounds) > 0).sum())
                total += len(p.starts)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *seen], pa.int64()), pa.array([full, *df[seen]], pa.int64()), pa.array([total, *[0] * len(seen)], pa.int64())],
            names=["t", "n", "words"])

    return run


def contributions(tf: np.ndarray, weight: np.ndarray, length: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """A term's share of a document's score: w * ((10**9 tf) div (1000 tf + 12 m)), m = 75 + (25 n N) div L."""
    m = 75 + (25 * length * n_docs) // max(n_words, 1)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def accumulate(b: Block, doc: np.ndarray, term: np.ndarray, part: np.ndarray, n_docs: int) -> np.ndarray:
    """Scores (items x documents) from the parts of each (document, term): classes, then nodes level by level, then items."""
    acc = np.zeros((b.n_classes, n_docs), np.int64)
    np.add.at(acc.reshape(-1), b.class_of[term] * n_docs + doc, part)
    nodes = np.zeros((len(b.parent) + 1, n_docs), np.int64)  # the last row, index -1, is the empty set
    for lo, hi in zip(b.levels[:-1], b.levels[1:], strict=True):
        nodes[lo:hi] = nodes[b.parent[lo:hi]] + acc[b.node_class[lo:hi]] * b.node_q[lo:hi, None]
    out = nodes[b.item_node]
    own = np.flatnonzero(np.diff(b.rest))
    if len(own):
        out[own] += np.add.reduceat(acc[b.rest_class] * b.rest_q[:, None], b.rest[own], axis=0)
    return out


class Best:
    """The TOP best (score, doc_id) of each item so far."""

    def __init__(self, n_items: int, top: int) -> None:
        self.score, self.doc = np.zeros((n_items, top), np.int64), np.full((n_items, top), NO_ID)
        self.top = top

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        for i in np.flatnonzero((scores.max(axis=1) >= self.score[:, -1]) & (scores.max(axis=1) > 0)):
            near = np.flatnonzero((scores[i] >= self.score[i, -1]) & (scores[i] > 0))
            score, doc = np.concatenate([self.score[i], scores[i, near]]), np.concatenate([self.doc[i], docs[near]])
            first = np.lexsort((doc, -score))[: self.top]
            self.score[i], self.doc[i] = score[first], doc[first]


def _scorer(block, weights, n_docs: int, n_words: int, top: int):
    """(doc_id, text) to (k, doc_id, score): the best documents of the task for each item number k."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, w = Block(**block.value), weights.value
        best = Best(len(b.items), top)
        at_once = max(CELLS // max(b.n_classes + len(b.parent) + len(b.rest_class), 1), 1)
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            for p in W.pieces(batch.column(1), W.ALNUM):
                text, term, tf = _held(p, b.terms)
                part = contributions(tf, w[term], np.diff(p.bounds)[text], n_docs, n_words)
                for lo in range(0, len(p.bounds) - 1, at_once):
                    hi = min(lo + at_once, len(p.bounds) - 1)
                    s = slice(*np.searchsorted(text, [lo, hi]))
                    best.add(accumulate(b, text[s] - lo, term[s], part[s], hi - lo), ids[p.first + lo : p.first + hi])
        k, at = np.nonzero(best.score > 0)
        doc = best.doc[k, at]
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(doc, mask=doc == NO_ID), pa.array(best.score[k, at])], names=["k", "doc_id", "score"])

    return run


def _blocks(paths: DataFrame) -> Iterator[int]:
    yield from range(paths.agg(F.max("block")).first()[0] + 1 if paths.take(1) else 0)


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every item with a score above 0."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select("item_id", F.col("text").cast("string").alias("text")).withColumn("item", F.monotonically_increasing_id()).checkpoint()
    paths, classes = query_graph(items.select("item", "text"))
    order = [F.transform("path", lambda s: s["node"]), F.col("item")]
    paths = prefix_sums(paths.withColumn("size", F.size("path")), order, {"before": "size"}).withColumn(
        "block", F.floor(F.col("before") / block_terms).cast("int")).checkpoint()
    found = None
    for n in _blocks(paths):
        mine = paths.filter(F.col("block") == n)
        inside = mine.select(F.explode("path.class").alias("class")).distinct()
        terms = classes.join(inside, "class", "left_semi")
        block = block_of(mine.orderBy("item").collect(), terms.toArrow())  # bounded by block_terms or one item
        shared = spark.sparkContext.broadcast(vars(block))
        stats = docs.select("text").mapInArrow(_frequencies(shared), "t long, n long, words long").groupBy("t").agg(F.sum("n"), F.sum("words")).toArrow()
        t, count, words = (stats.column(i).to_pylist() for i in range(3))
        whole = dict(zip(t, zip(count, words, strict=True), strict=True)).get(None, (0, 0))
        df = np.array([c for x, c in zip(t, count, strict=True) if x is not None], np.int64)
        at = np.array([x for x in t if x is not None], np.int64)
        weight = np.zeros(len(block.terms), np.int64)
        weight[at] = np.floor(1000 * np.log((2 * whole[0] + 2) / (2 * df + 1))).astype(np.int64)
        best = docs.mapInArrow(_scorer(shared, spark.sparkContext.broadcast(weight), *whole, top), "k long, doc_id long, score long")
        number = spark.createDataFrame([(int(i), int(k)) for k, i in enumerate(block.items)], "item long, k long")
        best = best.join(number, "k").select("item", "doc_id", "score").checkpoint()
        found = best if found is None else found.unionByName(best)
    if found is None:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*by)
    few = found.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= top)
    last = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).filter(F.col("rank") <= top)
    return last.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
