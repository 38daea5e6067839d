"""Sharding along a Hilbert curve over several metadata dimensions.

Size, source and language of a document are quantised to BITS bits each: size
by its binary logarithm, source and language by position in the ordered values
weighted by rows (so that frequent values get cells of their own).  A cell's
place on the Hilbert curve through the three dimensions orders the rows, a hash
orders the rows of a cell, and the order is cut into runs: neighbouring rows
are alike in all dimensions at once, so files prune on any of them.

Law ``rows``: the runs' row counts differ by one at most.  Row r of n (from 0)
goes to shard r * shards div n.

A row's place is the rows of the cells before (at most 2**(3 * BITS) sums), the
rows of the ranges before in its cell (hash ranges, at most 16**RANGE_DIGITS),
and its number within its range; so a cell that holds a third of all rows is
sorted in thousands of tasks, and nothing is sorted as a whole.

Defined cases.  A null text has size 1 and crc32 0 (of no bytes); null doc_ids,
sources and languages are values like any other, nulls last.  Rows equal in
doc_id, size, crc32, source and language are interchangeable.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import broadcast_if_small, null_safe, prefix_sums, text_bytes

SHARDS = 16
BITS = 5
RANGE_DIGITS = 3
BROADCAST_ROWS = 1_000_000


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each point (rows of non-negative coordinates under 2**bits)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        for i in range(dims):
            # where the bit is set the lower bits of the first axis flip, else they swap with this axis
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(flip, q - 1, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << 1) | ((x[i] >> level) & 1)
    return place


def _curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(points))], names=[*batch.schema.names, "place"])


def _bins(rows: DataFrame, column: str) -> DataFrame:
    """(column, q): the share of rows with smaller values, in 2**BITS steps."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    placed = prefix_sums(counts, [F.col(column).asc_nulls_last()], {"before": "n"}).crossJoin(F.broadcast(total))  # one row
    return placed.select(column, F.expr(f"CAST(before * {1 << BITS} div total AS INT)").alias(f"q_{column}"))


def shards(docs: DataFrame, count: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, source, lang, place) for every row of ``docs``."""
    rows = docs.select(
        "doc_id", text_bytes(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
    ).checkpoint()
    spots = null_safe(rows, broadcast_if_small(_bins(rows, "source"), BROADCAST_ROWS), ["source"])
    spots = null_safe(spots, broadcast_if_small(_bins(rows, "lang"), BROADCAST_ROWS), ["lang"])
    tie = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32"))
    spots = spots.withColumns({"q_size": F.least(F.length(F.bin("size")) - 1, F.lit((1 << BITS) - 1)), "tie": tie}).withColumn(
        "range", F.substring("tie", 1, RANGE_DIGITS))
    cell = ["q_size", "q_source", "q_lang"]
    ranges = spots.groupBy(*cell, "range").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    cells = ranges.groupBy(*cell).agg(F.sum("n").alias("cell_n"))
    cells = cells.mapInArrow(_curve, "q_size int, q_source int, q_lang int, cell_n long, place long")
    # at most 2**(3 * BITS) rows
    cells = cells.withColumns({"before": F.coalesce(F.sum("cell_n").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                               "total": F.sum("cell_n").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    inside = Window.partitionBy(*cell).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("earlier", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(cells, cell).select(
        *cell, "range", (F.col("before") + F.col("earlier")).alias("offset"), "total", "place")
    order = Window.partitionBy(*cell, "range").orderBy("tie", "size", "text_crc32")
    placed = spots.join(offsets, [*cell, "range"]).withColumn("r", F.col("offset") + F.row_number().over(order) - 1)
    shard = F.expr(f"CAST(r * {count} div total AS INT)")
    # the first row of shard s is the least r with r * count >= s * total
    first = F.expr(f"(shard * total + {count - 1}) div {count}")
    return placed.withColumn("shard", shard).withColumn("slot", (F.col("r") - first).cast("long")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "lang", "place")
