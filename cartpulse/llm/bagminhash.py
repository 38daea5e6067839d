"""Near-duplicate classes by BagMinHash (weighted Jaccard of word shingles).

A document is the bag (multiset) of its five-word shingles; words are
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  Two documents
are linked where their bags' weighted Jaccard similarity (sum of the smaller
counts over sum of the larger) is 0.8 or more; classes are the connected
components of the links.

The signature.  The weight axis of an element is cut at 1, 2, 4, 8, ...; each
of these strips owns a Poisson process whose rate is the strip's width.  A
document whose count covers a strip takes all its points; of the one strip
that its count cuts, it takes the points whose level lies under the count
(one hash splits the strip down to unit weights).  Points come in order of
time, each with a random component, and a component keeps its earliest point,
so two documents agree in a component with probability equal to their weighted
Jaccard similarity.  A process stops once its time passes the latest component
of the document: about n + M ln M points are drawn, not n * M.

Bands of ROWS components are bucketed; buckets never emit all pairs:

* texts with equal words are one node from the start;
* each node is first compared with one hub, the smallest node that any of its buckets holds;
* nodes of buckets that still hold several components then go through an exact
  prefix join on their rarest shingles (``prefixes``), first with the first node
  of each shingle only, then, where components still differ, in full; so no
  colliding pair that could join two components is left out.  A sketch of 256
  bits for each node tells, before any text moves, that most pairs of such
  nodes differ in too many shingles.

Every comparison is exact: the two texts are joined and their bags intersected.
With BANDS = 28 and ROWS = 4, a pair of similarity 0.8 shares no bucket with
probability 4e-7, one of 0.9 with 3e-13.

Defined cases.  A document without words (null or empty text, or no such
character) is a class of its own, as is a row with null doc_id (class null).
One to four words make one shingle.  Rows that repeat a doc_id are one
document: they share the class, and all their texts are compared.  An empty
table gives an empty result.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .components import components, jumped, relabelled
from .marks import Marks, marked, no_bits
from .tables import broadcast_if_small

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 28, 4
SIGNATURE = BANDS * ROWS
#: Bytes of text (both sides) whose bags are held at once in a comparison.
SLICE_BYTES = 2 << 20
#: doc_ids that are broadcast, counted before, to drop the copies; more are shuffled.
BROADCAST_IDS = 4_000_000


def bag(piece: W.Piece, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count), sorted by text and hash."""
    hashes = piece.word_hashes()
    at, text = piece.windows(k)
    sizes = np.diff(piece.bounds)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    begin = np.concatenate([at, piece.bounds[short]])
    end = np.concatenate([at + k, piece.bounds[short + 1]])
    text = np.concatenate([text, short])
    h = piece.span_hashes(hashes, begin, end)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], h[first], np.diff(np.append(first, len(h)))


def _unit(h: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((h >> W.U(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, m: int = SIGNATURE) -> np.ndarray:
    """Earliest time of each component (n_texts x m); infinite for texts without elements."""
    out = np.full(n_texts * m, np.inf)
    if not len(text):
        return out.reshape(n_texts, m)
    strips = np.ones(len(weight), np.int64)
    big = weight > 1
    strips[big] += np.ceil(np.log2(weight[big])).astype(np.int64)
    owner = np.repeat(np.arange(len(text)), strips)
    strip = np.arange(len(owner)) - np.repeat(np.cumsum(strips) - strips, strips)
    # strip 0 is [0, 1), strip s is [2**(s-1), 2**s)
    low = np.where(strip == 0, 0, 2 ** np.maximum(strip - 1, 0))
    width = np.maximum(low, 1)
    state = W.mix(element[owner] + strip.astype(W.U) * W.U(0x9E3779B97F4A7C15))
    where, limit = text[owner], weight[owner]
    time = np.zeros(len(owner))
    drawn, block = 0, 1
    while len(state):
        step = np.arange(drawn + 1, drawn + block + 1, dtype=W.U) * W.U(0xD1B54A32D192ED03)
        h = W.mix(state[:, None] + step[None, :])
        times = time[:, None] + np.cumsum(-np.log(_unit(h)) / (m * width)[:, None], axis=1)
        h2 = W.mix(h ^ W.U(0xA0761D6478BD642F))
        slot = where[:, None] * m + (h2 % W.U(m)).astype(np.int64)
        level = low[:, None] + ((h2 >> W.U(32)) % width[:, None].astype(W.U)).astype(np.int64)
        taken = level < limit[:, None]
        np.minimum.at(out, slot[taken], times[taken])
        latest = out.reshape(n_texts, m).max(axis=1)
        time = times[:, -1]
        go = time < latest[where]
        state, where, limit, low, width, time = (x[go] for x in (state, where, limit, low, width, time))
        drawn += block
        block = min(2 * block, 64)
    return out.reshape(n_texts, m)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band, the band's number included (n_texts x bands)."""
    bits = sig.view(W.U).reshape(len(sig), bands, rows)
    key = np.tile(np.arange(1, bands + 1, dtype=W.U) * W.U(0x2545F4914F6CDD1D), (len(sig), 1))
    for r in range(rows):
        key = W.mix(key ^ bits[:, :, r])
    return key


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for p in W.pieces(texts, W.ALNUM):
            n = len(p.bounds) - 1
            text, element, weight = bag(p)
            keys = band_keys(signatures(text, element, weight, n))
            h1 = p.word_hashes()
            a = p.span_hashes(h1, p.bounds[:-1], p.bounds[1:], 11)
            b = p.span_hashes(h1, p.bounds[:-1], p.bounds[1:], 12)
            flatkeys = pa.array(W.signed(keys.ravel()))
            offsets = pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32))
            full = pa.array(np.diff(p.bounds) > 0)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(p.first, n), pa.array(W.signed(a)), pa.array(W.signed(b)), pa.ListArray.from_arrays(offsets, flatkeys)],
                names=["doc_id", "h1", "h2", "bands"],
            ).filter(full)


def _bag_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [(t + p.first, h, c) for p in W.pieces(texts, W.ALNUM) for t, h, c in (bag(p),)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, W.U), np.zeros(0, np.int64))


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard of the bags of left[i] and right[i] (0 where neither has words)."""
    n = len(left)
    (ta, ha, ca), (tb, hb, cb) = _bag_of(left), _bag_of(right)
    text, h, c = np.concatenate([ta, tb]), np.concatenate([ha, hb]), np.concatenate([ca, cb])
    order = np.lexsort((h, text))
    text, h, c = text[order], h[order], c[order]
    same = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    both = np.bincount(text[1:][same], np.minimum(c[1:], c[:-1])[same], minlength=n)
    union = np.bincount(text, c, minlength=n) - both
    return np.where(union > 0, both / np.maximum(union, 1), 0.0)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text of a, text of b) to (a, b, sim)."""
    for batch in batches:
        ta, tb = batch.column(2), batch.column(3)
        ends = W.flat(ta)[1] + W.flat(tb)[1]
        first, sims = 0, []
        while first < len(batch):
            last = max(int(np.searchsorted(ends, ends[first] + SLICE_BYTES, "right")) - 1, first + 1)
            sims.append(similarities(ta.slice(first, last - first), tb.slice(first, last - first)))
            first = last
        if sims:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(sims))], names=["a", "b", "sim"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, sim) of the distinct pairs (a, b) of ids, checkpointed; several rows where an id is repeated."""
    rows = (
        pairs.join(texts.withColumnsRenamed({"doc_id": "b", "text": "tb"}), "b")
        .join(texts.withColumnsRenamed({"doc_id": "a", "text": "ta"}), "a")
        .select("a", "b", "ta", "tb")
    )
    return rows.mapInArrow(_verify, "a long, b long, sim double").checkpoint()


def _picker(marks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Marks(marks.value)
        for batch in batches:
            yield batch.filter(pa.array(table.has(batch.column(2).to_numpy().view(W.U)))).select(["doc_id", "text"])

    return run


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The texts of ``ids`` (id), and a few more, checkpointed: a filter of fixed size picks them before anything is shuffled."""
    h = F.xxhash64("id").alias("h")
    marks = docs.sparkSession.sparkContext.broadcast(marked(no_bits(), ids.select(h)))
    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(_picker(marks), "doc_id long, text string").checkpoint()


def _mixed(bucket: DataFrame, label: DataFrame) -> DataFrame:
    """Nodes (id, label) of the buckets (key, id) whose nodes belong to several components."""
    named = bucket.join(label, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    several = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    return named.join(several, "key").select("id", "label").distinct().checkpoint()


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (id, elements): the bag as a set, where the second, third, ... copy of a shingle is an element of its own."""
    for batch in batches:
        for p in W.pieces(batch.column(1), W.ALNUM):
            n = len(p.bounds) - 1
            text, h, count = bag(p)
            copy = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            element = W.mix(np.repeat(h, count) + copy.astype(W.U) * W.U(0x9E3779B97F4A7C15))
            sizes = np.bincount(np.repeat(text, count), minlength=n)
            offsets = np.zeros(n + 1, np.int32)
            np.cumsum(sizes, out=offsets[1:])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(p.first, n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(W.signed(element)))], names=["id", "elements"])


SKETCH = [f"s{i}" for i in range(4)]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_elements`` with a sketch of each set: 256 bits, each the parity of the elements that hash to it.

    Two sets differ in at least as many elements as their sketches in bits.
    """
    for batch in _elements(batches):
        lists, n = batch.column(1), len(batch)
        owner = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
        slot = W.mix(lists.flatten().to_numpy().view(W.U)) >> W.U(56)
        odd = np.bincount(owner * 256 + slot.astype(np.int64), minlength=n * 256).astype(np.uint8) & 1
        bits = np.packbits(odd.reshape(n, 256), axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(4)]], names=["id", "elements", *SKETCH])


def prefixes(nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(e, id, n, place, sketch): of each node's n elements, rarest among the nodes first, the e at ``place`` that a partner must share one of.

    Elements are ordered by the number of nodes that hold them.  Two sets of
    similarity t share one of the first n - ceil(t n) + 1 elements of either.
    Elements of one node only are counted, not listed: a node with enough of
    them has no row at all, so texts that share a passage and differ in the
    rest are told apart without looking at a pair.
    """
    mine = texts.join(nodes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    sets = mine.mapInArrow(_sets, "id long, elements array<long>, " + ", ".join(f"{c} long" for c in SKETCH)).withColumns(
        {"n": F.size("elements"), "set": F.xxhash64("id", "elements")}).checkpoint()
    rows = sets.select("id", "set", "n", *SKETCH, F.explode("elements").alias("e"))
    shared = rows.groupBy("e").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    first = Window.partitionBy("id", "set").orderBy("df", "e")
    common = rows.join(shared, "e").withColumns({"at": F.row_number().over(first), "shared": F.count(F.lit(1)).over(Window.partitionBy("id", "set"))})
    bound = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    return common.withColumn("place", F.col("n") - F.col("shared") + F.col("at")).filter(F.col("place") <= bound).select("e", "id", "n", "place", *SKETCH).checkpoint()


def prefix_pairs(rows: DataFrame, label: DataFrame, threshold: float, hubs_only: bool) -> DataFrame:
    """Distinct pairs (a < b) under different labels that share an element early enough for sets of their sizes;
    ``hubs_only``: only pairs with the first node of the element."""
    rows = rows.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    other = rows
    if hubs_only:
        # the hub must hold the element early enough for a partner of its own size
        own = F.col("place") <= F.col("n") - F.ceil(F.col("n") * (2 * threshold / (1 + threshold)) - 1e-9) + 1
        other = rows.join(rows.filter(own).groupBy("e").agg(F.min("id").alias("hub")), "e").filter("id = hub").drop("hub")
    other = other.select("e", *[F.col(c).alias(c + "2") for c in ("id", "n", "place", "label", *SKETCH)])
    # the overlap that two sets of these sizes need
    need = F.ceil((F.col("n") + F.col("n2")) * (threshold / (1 + threshold)) - 1e-9)
    early = (F.col("place") <= F.col("n") - need + 1) & (F.col("place2") <= F.col("n2") - need + 1)
    # sets that overlap so far differ in few elements, and their sketches in no more bits
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(c + "2"))) for c in SKETCH), F.lit(0))
    early = early & (apart <= F.col("n") + F.col("n2") - 2 * need)
    return rows.join(other, "e").filter(
        (F.col("id") != F.col("id2") if hubs_only else F.col("id2") < F.col("id")) & (F.col("label") != F.col("label2")) & early
    ).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def _contracted(links: DataFrame, label: DataFrame) -> DataFrame:
    """The links between the labels of their ends."""
    end = lambda c: label.select(F.col("id").alias(c), F.col("label").alias(f"label_{c}"))
    ends = links.join(end("a"), "a", "left").join(end("b"), "b", "left")
    return ends.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id) for every row of ``docs``; class_id is the smallest doc_id of the class."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(
        _sign, "doc_id long, h1 long, h2 long, bands array<long>").checkpoint()
    # equal texts have equal bands
    nodes = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.min_by("bands", "doc_id").alias("bands")).checkpoint()
    # several texts of one doc_id may lie in one bucket
    bands = nodes.select(F.explode("bands").alias("key"), "id")
    hubs = bands.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub < last").select("key", "hub")
    bucket = bands.join(hubs, "key").checkpoint()
    texts = texts_of(bucket.select("id"), docs)

    # one hub for each node; the links make a forest
    nearest = bucket.filter("hub < id").groupBy("id").agg(F.min("hub").alias("hub"))
    known = verified(nearest.select(F.col("hub").alias("a"), F.col("id").alias("b")), texts)
    linked = known.filter(F.col("sim") >= threshold)
    label = jumped(linked.select(F.col("b").alias("id"), F.col("a").alias("up")).distinct())
    nodes_left = _mixed(bucket, label)
    rows = prefixes(nodes_left, texts, threshold)
    for hubs_only in (True, False):
        pairs = prefix_pairs(rows, label, threshold, hubs_only).join(known.select("a", "b"), ["a", "b"], "left_anti")
        found = verified(pairs, texts)
        known = known.unionByName(found)
        fresh = found.filter(F.col("sim") >= threshold).select("a", "b")
        if fresh.take(1):
            label = relabelled(label, components(_contracted(fresh, label)).filter("id != label"))

    # rows that repeat a doc_id under several texts tie those texts' classes together
    texts = signed.select("doc_id", "h1", "h2").join(nodes, ["h1", "h2"]).select("doc_id", "id")
    joined = texts.join(label, "id", "left").select("doc_id", F.coalesce("label", "id").alias("label"))
    final = joined.groupBy("doc_id").agg(F.min("label").alias("class_id"), F.max("label").alias("last")).checkpoint()
    torn = final.filter("class_id < last").select("doc_id", F.col("class_id").alias("a"))
    if torn.take(1):
        merged = components(joined.join(torn, "doc_id").select("a", F.col("label").alias("b")))
        final = final.join(merged, F.col("class_id") == F.col("id"), "left").select("doc_id", F.coalesce("label", "class_id").alias("class_id"))
    final = final.select("doc_id", "class_id")
    out = docs.select("doc_id").join(final, "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first (smallest doc_id) of their class, one row for each
    doc_id; rows with null doc_id stay."""
    classes = near_duplicate_classes(docs)
    gone = classes.filter("doc_id != class_id").select("doc_id").distinct().checkpoint()
    kept = docs.join(broadcast_if_small(gone, BROADCAST_IDS), "doc_id", "left_anti").select(*docs.columns)
    again = docs.select("doc_id").filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id").checkpoint()
    if not again.take(1):
        return kept
    again = broadcast_if_small(again, BROADCAST_IDS)
    single = kept.join(again, "doc_id", "left_anti")
    twice = kept.join(again, "doc_id", "left_semi")
    cols = [c for c in docs.columns if c != "doc_id"]
    picked = twice.groupBy("doc_id").agg(F.min_by(F.struct(*cols), F.coalesce("text", F.lit(""))).alias("_row")).select("doc_id", "_row.*")
    return single.select(*docs.columns).unionByName(picked.select(*docs.columns))
