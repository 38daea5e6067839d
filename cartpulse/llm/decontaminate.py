"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  The
patterns are the windows of 10 consecutive words of every benchmark item; an
item of one to nine words is one window.  Every occurrence of a window in a
document marks the words it covers.

The search.  For patterns of L words a shift table says, for a block of two
consecutive words, how far the search may jump because no pattern has the
block nearer to its end; where the shift is 0, the hash of the last and the
first block select the test strings, and the strings themselves are compared.
The words of a batch are cut into lanes that jump side by side (NumPy).  Texts
of unrelated words are crossed in jumps of L - 1 words.

The pattern set is cut into blocks of at most about BLOCK_WINDOWS windows by
hash, counted before; one block is broadcast at a time and the documents are
scanned once for each block, so neither the driver nor a task ever holds more
than one block, whatever the size of the benchmark.

Defined cases.  A null or wordless text has no words and no hits.  A null or
wordless item has no window.  A window of an item with null item_id marks
words, but is not counted as an item; rows repeating an item_id are one item.
Rows repeating a doc_id are judged each on its own text.  An empty benchmark
hits nothing; an empty documents table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import null_safe

WINDOW = 10
BLOCK_WINDOWS = 1 << 16
SHIFT_BITS = 18
LANE = 128


def windows_of(benchmark: DataFrame, k: int = WINDOW) -> DataFrame:
    """Distinct (window, size, item_id): the window's words joined by a space, lower-cased."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in W.pieces(batch.column(1), W.ALNUM):
                low = p.cls.case.astype(np.uint8)[p.data]
                out, sizes, rows = [], [], []
                for i in range(len(p.bounds) - 1):
                    a, b = int(p.bounds[i]), int(p.bounds[i + 1])
                    ws = [low[p.starts[j] : p.ends[j]].tobytes().decode() for j in range(a, b)]
                    for s in range(max(len(ws) - k + 1, 1) if ws else 0):
                        out.append(" ".join(ws[s : s + k]))
                        sizes.append(min(k, len(ws)))
                        rows.append(p.first + i)
                ids = batch.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(sizes, pa.int32()), ids], names=["window", "size", "item_id"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(cut, "window string, size int, item_id string").distinct()


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return W.mix(left * W.U(0x9E3779B97F4A7C15) ^ right)


@dataclass
class Patterns:
    """Search tables for the windows of one size."""

    size: int
    block: int
    shift: np.ndarray
    keys: np.ndarray
    words: np.ndarray
    strings: list[bytes]

    @classmethod
    def build(cls, strings: list[str], size: int) -> Patterns:
        block = min(2, size)
        hashes = np.zeros((len(strings), size), W.U)
        # windows hold no byte that ends a word but the space between words
        for p in W.pieces(pa.array(strings, pa.string()), W.ALNUM):
            n = len(p.bounds) - 1
            hashes[p.first : p.first + n] = p.word_hashes().reshape(n, size)
        shift = np.full(1 << SHIFT_BITS, size - block + 1, np.int64)
        for end in range(block - 1, size):
            np.minimum.at(shift, cls._slot(cls._block(hashes, end, block)), size - 1 - end)
        keys = W.mix(cls._block(hashes, size - 1, block) + cls._block(hashes, block - 1, block) * W.U(0xD1B54A32D192ED03))
        order = np.argsort(keys, kind="stable")
        return cls(size, block, shift, keys[order], hashes[order], [strings[i].encode() for i in order])

    @staticmethod
    def _block(hashes: np.ndarray, end: int, block: int) -> np.ndarray:
        return hashes[:, end] if block == 1 else _pair(hashes[:, end - 1], hashes[:, end])

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> W.U(64 - SHIFT_BITS)).astype(np.int64)

    def find(self, p: W.Piece, h: np.ndarray, text: np.ndarray, low: np.ndarray) -> list[tuple[int, int]]:
        """(first word, pattern number) of every occurrence in the piece."""
        def block_at(end: np.ndarray) -> np.ndarray:
            return h[end] if self.block == 1 else _pair(h[end - 1], h[end])

        at = np.arange(self.size - 1, len(h), LANE)
        stop = np.minimum(at + LANE, len(h))
        tests = []
        while len(at):
            jump = self.shift[self._slot(block_at(at))]
            tests.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        if not tests:
            return []
        end = np.concatenate(tests)
        end = end[text[end] == text[end - self.size + 1]]
        key = W.mix(block_at(end) + block_at(end - self.size + self.block) * W.U(0xD1B54A32D192ED03))
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        many = hi - lo
        where = np.repeat(end, many)
        which = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        first = where - self.size + 1
        same = np.ones(len(where), bool)
        for j in range(self.size):
            same &= h[first + j] == self.words[which, j]
        found = []
        for s, k in zip(first[same].tolist(), which[same].tolist(), strict=True):
            seen = b" ".join(low[p.starts[j] : p.ends[j]].tobytes() for j in range(s, s + self.size))
            if seen == self.strings[k]:
                found.append((s, k))
        return found


def pattern_blocks(windows: DataFrame, block_windows: int = BLOCK_WINDOWS) -> Iterator[dict[int, list[str]]]:
    """The distinct windows by size, one block after the other on the driver."""
    distinct = windows.select("window", "size").distinct()
    blocks = max(1, -(-distinct.count() // block_windows))
    for b in range(blocks):
        rows = distinct.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b).toArrow().to_pydict()
        by_size: dict[int, list[str]] = {}
        for w, n in sorted(zip(rows["window"], rows["size"], strict=True)):
            by_size.setdefault(n, []).append(w)
        yield by_size


def _searcher(spark_context, by_size: dict[int, list[str]]) -> Callable[[pa.Array], Iterator[tuple[W.Piece, np.ndarray, list]]]:
    sent = spark_context.broadcast([Patterns.build(strings, size) for size, strings in sorted(by_size.items())])

    def search(texts: pa.Array) -> Iterator[tuple[W.Piece, np.ndarray, list]]:
        for p in W.pieces(texts, W.ALNUM):
            h, text, low = p.word_hashes(), p.text_of_word(), p.cls.case.astype(np.uint8)[p.data]
            yield p, h, [(s, pat.size, int(text[s]), pat.strings[k]) for pat in sent.value for s, k in pat.find(p, h, text, low)]

    return search


_HITS = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("window", pa.string())]))


def occurrences(docs: DataFrame, windows: DataFrame, block_windows: int = BLOCK_WINDOWS) -> list[DataFrame]:
    """For each pattern block one (doc_id, h, n_words, hits) for every document; h identifies the words of the text."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = []
    for by_size in pattern_blocks(windows, block_windows):
        search = _searcher(sc, by_size)

        def scan(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for p, h, found in search(batch.column(1)):
                    n = len(p.bounds) - 1
                    hits: list[list] = [[] for _ in range(n)]
                    for s, size, row, window in found:
                        hits[row].append({"start": s - int(p.bounds[row]), "size": size, "window": window.decode()})
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(p.first, n), pa.array(W.signed(p.span_hashes(h, p.bounds[:-1], p.bounds[1:]))),
                         pa.array(np.diff(p.bounds)), pa.array(hits, _HITS)], names=["doc_id", "h", "n_words", "hits"])

        out.append(docs.mapInArrow(scan, "doc_id long, h long, n_words long, hits array<struct<start:int,size:int,window:string>>").checkpoint())
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``."""
    windows = windows_of(benchmark, k).checkpoint()
    found = occurrences(docs, windows, block_windows)
    hits = None
    for part in found:
        rows = part.filter(F.size("hits") > 0).select("doc_id", "h", F.explode("hits").alias("hit")).select("doc_id", "h", "hit.*")
        hits = rows if hits is None else hits.unionByName(rows)
    hits = hits.distinct()
    spans = hits.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("spans"))
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
    covered = F.aggregate("spans", start, lambda acc, x: F.struct(
        F.greatest(acc["upto"], x["start"] + x["size"]).alias("upto"),
        (acc["n"] + F.greatest(x["start"] + x["size"] - F.greatest(acc["upto"], x["start"]), F.lit(0))).alias("n")))
    spans = spans.select("doc_id", "h", covered["n"].cast("long").alias("n_hit"))
    items = (
        hits.join(windows.filter("item_id IS NOT NULL").select("window", "item_id"), "window")
        .groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    marks = null_safe(spans, items, ["doc_id", "h"], "left")
    out = null_safe(found[0].select("doc_id", "h", "n_words"), marks, ["doc_id", "h"], "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``docs`` whose text holds no window; the rows never leave their partition."""
    sc = docs.sparkSession.sparkContext
    at = docs.columns.index("text")
    for by_size in pattern_blocks(windows_of(benchmark, k).checkpoint(), block_windows):
        search = _searcher(sc, by_size)

        def keep(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(len(batch), bool)
                for p, _, found in search(batch.column(at)):
                    clean[[p.first + row for _, _, row, _ in found]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
