"""Substring deduplication by relative Lempel-Ziv parsing.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  A document is parsed against the
documents with smaller doc_ids: greedily, each factor is the longest run of
words that continues a match with the same reference document, and a factor
counts from WINDOW (13) words on.  Windows that straddle the end of a factor
are looked up on their own, so every window whose word sequence also starts in
a document with a smaller doc_id is found, wherever the factors are cut.  All
words under such windows are duplicate spans.

The reference index is cut into blocks by content.  The anchor of a window is
the least hash of its four-word grams: equal windows have equal anchors, and
neighbouring windows mostly share theirs.

1. Each document sends its distinct anchors (about 2 of 11 words) with the
   doc_id, combined in every batch and task before the shuffle; anchors of one
   document only can have no duplicate and are dropped.
2. Under the remaining anchors, runs of windows with one anchor are indexed:
   (anchor, hash of the run's words) to the smallest doc_id.  A run that an
   earlier document holds is matched as a whole.
3. Only where an anchor has different runs (a passage's ends, an edit), the
   runs' windows are indexed and looked up one by one.  All keys are two
   independent 64-bit hashes.
4. The matches of a document (never more than its words) make its factors.

Copies of a whole text are found first by their words' hash and parsed no
further.  A word sequence that a third of all documents hold costs one partial
minimum for each task, and a join that Spark splits by size.  Texts are joined
only to the spans found in them.

Defined cases.  Null and wordless texts have no words and keep nothing
(sha256 of the empty string).  Fewer than 13 words: nothing is removed.  Rows
with null doc_id are neither reference nor parsed: they stay whole.  Rows that
repeat a doc_id are not references to each other; each is judged on its own
text.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import broadcast_if_small, null_safe

WINDOW = 13
GRAM = 4
#: Rows of anchors, copies or spans that are broadcast instead of shuffling the documents' side.
BROADCAST_ROWS = 4_000_000


def joined(p: W.Piece, kept: np.ndarray) -> list[bytes]:
    """For each text of the piece its kept words joined by one space."""
    step = np.zeros(len(p.data) + 1, np.int8)
    step[p.starts[kept]] += 1
    step[p.ends[kept]] -= 1
    take = np.cumsum(step[:-1], dtype=np.int8) > 0
    text = p.text_of_word()[kept]
    before_next = np.flatnonzero(kept)[:-1][text[1:] == text[:-1]]
    gap = p.ends[before_next]
    data = p.data.copy()
    data[gap] = 0x20
    take[gap] = True
    out = data[take].tobytes()
    at = np.zeros(len(p.data) + 1, np.int64)
    np.cumsum(take, out=at[1:])
    cuts = at[p.rows].tolist()
    return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def anchored_windows(p: W.Piece, k: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, text, window hash, anchor) of every window of the piece."""
    at, text = p.windows(k)
    if not len(at):
        return at, text, np.zeros(0, W.U), np.zeros(0, W.U)
    h = p.word_hashes()
    n = len(h) - gram + 1
    least = p.span_hashes(h, np.arange(n), np.arange(n) + gram, 12)
    width, grams = 1, k - gram + 1
    while 2 * width <= grams:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < grams:
        least = np.minimum(least[: len(least) - (grams - width)], least[grams - width :])
    return at, text, p.span_hashes(h, at, at + k, 11), least[at]


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in W.pieces(batch.column(1), W.SPACED):
            n = len(p.bounds) - 1
            h = p.word_hashes()
            sums = [p.span_hashes(h, p.bounds[:-1], p.bounds[1:], seed) for seed in (11, 12)]
            sha = [hashlib.sha256(x).hexdigest() for x in joined(p, np.ones(len(h), bool))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(p.first, n), *[pa.array(W.signed(x)) for x in sums], pa.array(np.diff(p.bounds)), pa.array(sha)],
                names=["doc_id", "h1", "h2", "n_words", "sha"])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for p in W.pieces(batch.column(1), W.SPACED):
            _, text, _, anchor = anchored_windows(p)
            if not len(text):
                continue
            new = np.ones(len(text), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
            anchor, doc = anchor[new], ids[p.first + text[new]]
            order = np.argsort(anchor, kind="stable")
            anchor, doc = anchor[order], doc[order]
            first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(W.signed(anchor[first])), pa.array(np.minimum.reduceat(doc, first)), pa.array(np.maximum.reduceat(doc, first))],
                names=["anchor", "lo", "hi"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows with one anchor: (anchor, run, doc_id, h1, first, windows); run is the hash of the run's words."""
    for batch in batches:
        for p in W.pieces(batch.column(1), W.SPACED):
            at, text, window, anchor = anchored_windows(p)
            if not len(text):
                continue
            h = p.word_hashes()
            whole = p.span_hashes(h, p.bounds[:-1], p.bounds[1:], 11)
            new = np.ones(len(text), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(new)
            rows = text[first]
            last = np.append(first[1:], len(text)) - 1
            run = p.span_hashes(h, at[first], at[last] + WINDOW, 12)
            yield pa.RecordBatch.from_arrays(
                [pa.array(W.signed(anchor[first])), pa.array(W.signed(run)), batch.column(0).take(pa.array(p.first + rows)), pa.array(W.signed(whole[rows])),
                 pa.array((at[first] - p.bounds[rows]).astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(np.append(first, len(text)).astype(np.int32)), pa.array(W.signed(window)))],
                names=["anchor", "run", "doc_id", "h1", "first", "windows"])


def factors(at: np.ndarray, owner: np.ndarray, k: int = WINDOW) -> list[tuple[int, int, int]]:
    """(first word, words, reference document) from matched windows in order of position."""
    if not len(at):
        return []
    cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1]))
    first, last = np.append(0, cut + 1), np.append(cut, len(at) - 1)
    return [(int(at[a]), int(at[b] - at[a]) + k, int(owner[a])) for a, b in zip(first, last, strict=True)]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h1, text, matches) to (doc_id, h1, n_removed, kept_sha256, factors)."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("ref", pa.int64())]))
    for batch in batches:
        matches = batch.column(3)
        for p in W.pieces(batch.column(2), W.SPACED):
            n = len(p.bounds) - 1
            step = np.zeros(len(p.starts) + 1, np.int64)
            found = []
            for i in range(n):
                m = matches[p.first + i].values.flatten()
                at, size, owner = (x.to_numpy().astype(np.int64) for x in m)
                at = np.repeat(at, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                owner = np.repeat(owner, size)
                order = np.lexsort((owner, at))
                at, owner = at[order], owner[order]
                new = np.append(True, at[1:] != at[:-1])
                runs = factors(at[new], owner[new])
                for s, w, _ in runs:
                    step[p.bounds[i] + s] += 1
                    step[p.bounds[i] + s + w] -= 1
                found.append([{"start": s, "words": w, "ref": r} for s, w, r in runs])
            gone = np.cumsum(step[:-1]) > 0
            sums = np.concatenate([[0], np.cumsum(gone)])
            sha = [hashlib.sha256(x).hexdigest() for x in joined(p, ~gone)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(p.first, n), batch.column(1).slice(p.first, n), pa.array(sums[p.bounds[1:]] - sums[p.bounds[:-1]]), pa.array(sha), pa.array(found, kind)],
                names=["doc_id", "h1", "n_removed", "kept_sha256", "factors"])


def duplicate_spans(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, copy_of, factors) for every row of ``docs``.

    copy_of names the first document with the same words, where the row is a later copy of
    13 words or more; such a row has no factor list: all its words are removed.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    summary = docs.mapInArrow(_summary, "doc_id long, h1 long, h2 long, n_words long, sha string").checkpoint()
    long_enough = summary.filter((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
    origin = long_enough.groupBy("h1", "h2").agg(F.min("doc_id").alias("origin"), F.max("doc_id").alias("last")).filter("origin < last").drop("last")
    copies = long_enough.join(origin, ["h1", "h2"]).filter("doc_id > origin").select("doc_id", "h1", "origin").distinct().checkpoint()

    # a doc_id with other texts beside a copy stays: what is looked up twice does no harm
    only = copies.select("doc_id").join(
        long_enough.groupBy("doc_id").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a < b").select("doc_id"), "doc_id", "left_anti").distinct()
    firsts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").join(broadcast_if_small(only.checkpoint(), broadcast_rows), "doc_id", "left_anti")
    shared = (
        firsts.mapInArrow(_anchors, "anchor long, lo long, hi long").groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .filter("lo < hi").select("anchor").checkpoint()
    )
    runs = (
        firsts.mapInArrow(_candidates, "anchor long, run long, doc_id long, h1 long, first int, windows array<long>")
        .join(broadcast_if_small(shared, broadcast_rows), "anchor", "left_semi").checkpoint()
    )
    owners = runs.groupBy("anchor", "run").agg(F.min("doc_id").alias("owner")).checkpoint()
    whole_runs = (
        runs.select("anchor", "run", "doc_id", "h1", F.col("first").alias("at"), F.size("windows").alias("n"))
        .join(owners, ["anchor", "run"]).filter("owner < doc_id").select("doc_id", "h1", "at", "n", "owner")
    )
    # where all runs of an anchor are equal the first of them repeats nothing; else its windows are looked up one by one
    several = owners.groupBy("anchor").agg(F.min("run").alias("a"), F.max("run").alias("b")).filter("a < b").select("anchor").checkpoint()
    windows = (
        runs.join(broadcast_if_small(several, broadcast_rows), "anchor", "left_semi")
        .select("anchor", "doc_id", "h1", "first", F.posexplode("windows").alias("i", "window"))
    )
    index = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner < last").drop("last")
    single = windows.join(index, ["anchor", "window"]).filter("owner < doc_id").select(
        "doc_id", "h1", (F.col("first") + F.col("i")).alias("at"), F.lit(1).alias("n"), "owner")
    matches = whole_runs.unionByName(single).groupBy("doc_id", "h1").agg(F.collect_list(F.struct("at", "n", "owner")).alias("matches")).checkpoint()
    hinted = broadcast_if_small(matches.select("doc_id").distinct(), broadcast_rows)
    whole = docs.join(hinted, "doc_id", "left_semi").mapInArrow(
        _with_hash, "doc_id long, h1 long, text string")
    parsed = whole.join(matches, ["doc_id", "h1"]).select("doc_id", "h1", "text", "matches").mapInArrow(
        _parse, "doc_id long, h1 long, n_removed long, kept_sha256 string, factors array<struct<start:int,words:int,ref:long>>").dropDuplicates(["doc_id", "h1"])
    out = null_safe(summary, parsed, ["doc_id", "h1"], "left")
    out = null_safe(out, copies.withColumnRenamed("origin", "copy_of"), ["doc_id", "h1"], "left")
    copied = F.col("copy_of").isNotNull()
    return out.select(
        "doc_id", "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        "copy_of", "factors")


def _with_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in W.pieces(batch.column(1), W.SPACED):
            n = len(p.bounds) - 1
            h = p.span_hashes(p.word_hashes(), p.bounds[:-1], p.bounds[1:], 11)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(p.first, n), pa.array(W.signed(h)), batch.column(1).slice(p.first, n)], names=["doc_id", "h1", "text"])
