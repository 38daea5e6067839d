"""Collocations of a corpus from a weighted de Bruijn graph of its words.

Text is lower-cased (A-Z only), split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and
these into words ``[^\\x20\\x09]+``; every count is per language (null: ``und``).

The graph.  An edge is a run of ORDER (5) words, it leads from the node of its
first four words to the node of its last four, and its weight is the number of
its occurrences.  Where a piece ends (or is cut, see below) after four words,
that node is kept as a correction of its end.  The count of a node is then the
flow out of it: the weights of all edges and end runs that begin with it.
Words, pairs and triples are counted for the cuts anyway.

Cuts.  A phrase that occurs LEAST times consists of words, pairs and triples
that occur LEAST times, so pieces may be cut wherever one of these is rarer,
without touching any phrase sought.  Words, pairs and triples are counted one
after the other (exactly, by grouped sums), and the frequent ones are marked in
one table of bits by their hash (``marks``), of the same size for every corpus; a
wrong mark leaves a piece uncut and costs time only.  What
remains of the text for the edges is little more than its repetitions.  Pairs
and triples are counted by hash, with a code of the run before the last word;
the few that are frequent get their words by a join on it (``spelt_out``), so
no task lists the frequent pairs of its text once more.

Unary paths.  Edges that follow one another through nodes with one edge in and
one out, of the same weight, and no end are compacted into one path
(``compact_paths``, by doubling of pointers): a repeated passage is one path
whatever its length, and a node inside it is inside a longer phrase of the
same count.

Equality of words and runs is that of 64-bit hashes.

Defined cases.  Null and empty texts have no words; a language without phrases
has no rows.  Every row counts, repeated rows too; doc_id is not used.  Texts
are read whole.  Ties in the score go to the larger count, then to the phrase in
UTF-8 byte order.  An empty table gives an empty result.  Columns other than
text and lang are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .marks import Marks, marked, no_bits

ORDER = 5
LEAST = 100
#: Rows of the result for each language.
TOP = 2000
#: Runs gathered in a task before they are counted and passed on.
HELD_RUNS = 2_000_000
#: Bits that tell which run a longer one continues; runs that share them by chance cost a row of a join.
CODE_BITS = 24

_BYTE = np.arange(256)
_END = np.isin(_BYTE, [ord(c) for c in ".,;:!?"]) | ((_BYTE >= 0x0A) & (_BYTE <= 0x0D))
PHRASE_WORDS = W.ByteClass(~(_END | (_BYTE == 0x20) | (_BYTE == 0x09)), W.ALNUM.case)


def _language_keys(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    keys = [int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "little") for x in coded.dictionary.to_pylist()]
    return np.array(keys, W.U)[coded.indices.to_numpy(zero_copy_only=False)]


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[W.Piece, np.ndarray, np.ndarray, np.ndarray]]:
    """Of (text, lang): words with the text of each, their hashes (language included) and whether a word goes on to the next."""
    keys = _language_keys(batch.column(1))
    for p in W.pieces(batch.column(0), PHRASE_WORDS):
        if not len(p.starts):
            continue
        text, ends = p.text_of_word(), np.cumsum(_END[p.data])
        on = (text[1:] == text[:-1]) & (ends[p.starts[1:]] == ends[p.starts[:-1]])
        yield p, text, W.mix(p.word_hashes() ^ keys[p.first + text]), on


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) to (lang, w, word, n): the words of a few texts with their counts."""
    for batch in batches:
        for p, text, w, _ in _pieces(batch):
            kinds, first, n = np.unique(w, return_index=True, return_counts=True)
            begin, size = p.starts[first], (p.ends - p.starts)[first]
            offsets = np.zeros(len(kinds) + 1, np.int32)
            np.cumsum(size, out=offsets[1:])
            raw = p.cls.case[p.data[np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])]].astype(np.uint8)
            word = pa.Array.from_buffers(pa.string(), len(kinds), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(p.first + text[first])), pa.array(W.signed(kinds)), word, pa.array(n)], names=["lang", "w", "word", "n"])


def _turned(h: np.ndarray) -> np.ndarray:
    """What the hash of a run adds to that of its next word."""
    return W.mix(h * W.U(0x9E3779B97F4A7C15) + W.U(1))


def _run_hash(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; with that of the first k - 1 it tells the last word."""
    out = w[: max(len(w) - k + 1, 0)]
    for i in range(1, k):
        out = _turned(out) ^ w[i : i + len(out)]
    return out


class RunMarks(Marks):
    """Which words, pairs and triples are frequent."""

    def runs(self, w: np.ndarray, on: np.ndarray, longest: int) -> np.ndarray:
        """Number of words (up to ``longest``) from each word on before the next cut; runs of up to
        min(3, longest - 1) words are looked up."""
        n = np.zeros(len(w), np.int64)
        live = self.has(_run_hash(w, 1))
        n[live] = 1
        for k in range(2, longest + 1):
            # a run of k words lives where both its runs of k - 1 do
            live = live[:-1] & live[1:] & (on if k == 2 else True)
            if k < longest and k <= 3:
                live = live & self.has(_run_hash(w, k))
            n[: len(live)][live] = k
        return n


def _counted(runs: list[np.ndarray], codes: list[np.ndarray]) -> pa.RecordBatch:
    h = np.concatenate(runs)
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(h), 1), bool), h[1:] != h[:-1]]))
    n = np.diff(first, append=len(h))
    return pa.RecordBatch.from_arrays([pa.array(W.signed(h[first])), pa.array(np.concatenate(codes)[order[first]]), pa.array(n)], names=["h", "code", "n"])


def _run_counter(k: int, marks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, codes = RunMarks(marks.value), [], []
        for batch in batches:
            for _, _, w, on in _pieces(batch):
                at = np.flatnonzero(table.runs(w, on, k) == k)
                before = _run_hash(w, k - 1)[at]
                held.append(_turned(before) ^ w[at + k - 1])
                codes.append((before & W.U((1 << CODE_BITS) - 1)).astype(np.int32))
                if sum(map(len, held)) >= HELD_RUNS:
                    yield _counted(held, codes)
                    held, codes = [], []
        if held:
            yield _counted(held, codes)

    return run


def _continued():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(W.U)
            code = (h & W.U((1 << CODE_BITS) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(W.signed(_turned(h))), batch.column(1)], names=["code", "turned", "begun"])

    return run


def spelt_out(counts: DataFrame, shorter: DataFrame, frequent: DataFrame) -> DataFrame:
    """(h, words, n): the words of the runs of ``counts`` (h, code, n), each a run of ``shorter`` (h, words) and a word
    of ``frequent`` (w).  Of several runs with its code, only the right one leaves a word."""
    begun = shorter.select("h", "words").mapInArrow(_continued(), "code int, turned long, begun array<long>")
    last = F.col("h").bitwiseXOR(F.col("turned"))
    return counts.join(begun, "code").withColumn("w", last).join(frequent, "w", "left_semi").select("h", F.concat("begun", F.array("w")).alias("words"), "n")


def _edge_rows(runs: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Distinct rows of ``runs`` (five words, those past ``size`` zero) with their counts."""
    key = size.astype(W.U)
    for i in range(ORDER):
        key = W.mix(key * W.U(0x9E3779B97F4A7C15) + runs[:, i])
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    runs, size = runs[first], size[first]
    cols = [pa.array(W.signed(np.ascontiguousarray(runs[:, i])), mask=size <= i) for i in range(ORDER)]
    return pa.RecordBatch.from_arrays([*cols, pa.array(n)], names=[*WORD_COLUMNS, "n"])


WORD_COLUMNS = [f"w{i + 1}" for i in range(ORDER)]


def _edge_counter(marks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, sizes = RunMarks(marks.value), [], []
        for batch in batches:
            for _, _, w, on in _pieces(batch):
                n = table.runs(w, on, ORDER)
                at = np.flatnonzero(n >= ORDER - 1)
                wide = np.concatenate([w, np.zeros(ORDER, W.U)])
                held.append(np.where(np.arange(ORDER) < n[at, None], wide[at[:, None] + np.arange(ORDER)], W.U(0)))
                sizes.append(n[at])
                if sum(map(len, held)) >= HELD_RUNS:
                    yield _edge_rows(np.concatenate(held), np.concatenate(sizes))
                    held, sizes = [], []
        if held:
            yield _edge_rows(np.concatenate(held), np.concatenate(sizes))

    return run


def graph(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Edges, end runs of four words, and the frequent pairs and triples with their whole counts (w1 .. w5, n); and the
    vocabulary (lang, w, word, n).  Both are written to the shared folder."""
    spark = docs.sparkSession
    texts = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang")).filter("text IS NOT NULL")
    vocabulary = (
        texts.mapInArrow(_words, "lang string, w long, word string, n long").groupBy("lang", "w", "word").agg(F.sum("n").alias("n")).checkpoint()
    )
    frequent = vocabulary.filter(F.col("n") >= least).select("w")
    # the hash of a run of one is its word's
    runs = frequent.select(F.col("w").alias("h"), F.array("w").alias("words"))
    bits, known = marked(no_bits(), runs.select("h")), []
    for k in (2, 3):
        marks = spark.sparkContext.broadcast(bits)
        counts = texts.mapInArrow(_run_counter(k, marks), "h long, code int, n long").groupBy("h", "code").agg(F.sum("n").alias("n"))
        counts = counts.filter(F.col("n") >= least).checkpoint()
        bits = marked(bits, counts.select("h"))
        runs = spelt_out(counts, runs, frequent).checkpoint()
        known.append(runs.select(*[F.get("words", F.lit(i)).alias(c) for i, c in enumerate(WORD_COLUMNS)], "n"))
    marks = spark.sparkContext.broadcast(bits)
    schema = ", ".join(f"{c} long" for c in [*WORD_COLUMNS, "n"])
    edges = texts.mapInArrow(_edge_counter(marks), schema).groupBy(*WORD_COLUMNS).agg(F.sum("n").alias("n"))
    return edges.unionByName(known[0]).unionByName(known[1]).checkpoint(), vocabulary


def flows(edges: DataFrame, least: int) -> DataFrame:
    """(words, a): every run of 2 to ORDER words that occurs ``least`` times; those of four words from the flow out of them."""
    run = F.array(*WORD_COLUMNS)
    size = F.size(F.array_compact(run))
    shortest = F.least(size, F.lit(ORDER - 1))
    begun = edges.select(F.explode(F.transform(F.sequence(shortest, size), lambda k: F.slice(run, F.lit(1), k))).alias("words"), "n")
    return begun.groupBy("words").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)


def compact_paths(phrases: DataFrame) -> DataFrame:
    """(words, path, place, path_words): the path of every edge of ``phrases`` (words, a), its place on it from 0,
    and the path's length in words.

    An edge follows another where the node between them has no other edge and
    no end, so that both have the node's count.  Each round doubles the length
    that a pointer spans; the rounds follow the logarithm of the longest path.
    """
    edge = phrases.filter(F.size("words") == ORDER).select(F.xxhash64("words").alias("id"), "words", "a")
    node = phrases.filter(F.size("words") == ORDER - 1).select(F.xxhash64("words").alias("node"), F.col("a").alias("flow"))
    into = edge.groupBy(F.xxhash64(F.slice("words", 2, ORDER - 1)).alias("node")).agg(
        F.count(F.lit(1)).alias("n_in"), F.min("id").alias("before"), F.min("a").alias("a_in"))
    out = edge.groupBy(F.xxhash64(F.slice("words", 1, ORDER - 1)).alias("node")).agg(
        F.count(F.lit(1)).alias("n_out"), F.min("id").alias("after"), F.min("a").alias("a_out"))
    unary = into.join(out, "node").join(node, "node").filter("n_in = 1 AND n_out = 1 AND a_in = flow AND a_out = flow AND before != after")
    back = edge.join(unary.select(F.col("after").alias("id"), F.col("before").alias("up")), "id", "left").select(
        "id", F.coalesce("up", "id").alias("up"), F.col("up").isNotNull().cast("long").alias("steps")).checkpoint()
    moved = True
    while moved:
        over = back.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"))
        step = back.join(over, "up").select("id", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("steps2") > 0).alias("moved")).checkpoint()
        moved = bool(step.filter("moved").take(1))
        back = step.drop("moved")
    length = back.groupBy("up").agg((F.max("steps") + ORDER).alias("path_words"))
    return edge.join(back.join(length, "up"), "id").select("words", F.col("up").alias("path"), F.col("steps").alias("place"), "path_words")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, path_words): the best phrases of each language.

    A phrase of 2 to 5 words and count a is cut after its first k words into
    parts of counts l and r; its score is the least floor(1000 a n / (l r)) over
    its cuts (ties: smallest k), n being the language's words.  A phrase inside
    a longer one of the same count is dropped: the longer one, cut to one word
    more than the phrase, has that count as well, so one step is enough.
    """
    edges, vocabulary = graph(docs, least)
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = vocabulary.filter(F.col("n") >= least)
    phrases = flows(edges, least).checkpoint()
    counts = phrases.unionByName(frequent.select(F.array("w").alias("words"), F.col("n").alias("a")))

    longer = phrases.filter(F.size("words") > 2)
    size = F.size("words")
    inside = longer.select(F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("words"), F.col("a").alias("b"))
    covered = inside.groupBy("words").agg(F.max("b").alias("b"))
    paths = compact_paths(phrases).checkpoint()
    within = paths.filter(F.col("place") + ORDER < F.col("path_words")).select(F.slice("words", 2, ORDER - 1).alias("words"))
    kept = (
        phrases.join(within, "words", "left_anti").join(covered, "words", "left").filter("b IS NULL OR b < a").drop("b")
        .join(paths.select("words", "path_words"), "words", "left")
    )

    cuts = kept.select("words", "a", "path_words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).withColumns(
        {"first": F.slice("words", F.lit(1), F.col("k")), "rest": F.slice("words", F.col("k") + 1, size - F.col("k"))})
    parts = cuts.join(counts.select(F.col("words").alias("first"), F.col("a").alias("l")), "first").join(
        counts.select(F.col("words").alias("rest"), F.col("a").alias("r")), "rest")
    product = F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)")
    named = frequent.select("lang", "w", "word")
    lang = named.select(F.col("w").alias("_w"), "lang").join(totals, "lang")
    above = F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(17,0)") * F.col("n").cast("decimal(17,0)")
    scored = (
        parts.join(lang, F.element_at("words", 1) == F.col("_w")).drop("_w")
        .withColumns({"product": product, "above": above}).withColumn("score", F.expr("above div product"))
    )
    best = scored.groupBy("words", "a", "path_words", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spelt = (
        best.select("words", F.posexplode("words").alias("at", "w")).join(named.select("w", "word"), "w")
        .groupBy("words").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelt"))
    )
    rows = best.join(spelt, "words").select(
        "lang", F.array_join(F.col("spelt.word"), " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score", "path_words")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return rows.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "path_words")
