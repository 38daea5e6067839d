"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartpulse.session import checkpoint_dir, configure

#: Rows of one Arrow batch handed to Python; with long texts this bounds a worker's memory.
ARROW_ROWS = 1000
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def ready(spark: SparkSession) -> SparkSession:
    """Session defaults, and the shared folder for checkpoints registered."""
    configure(spark)
    checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text plus 1; a null text counts 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of doc_id as text leaves 0 modulo 5 (null ids: never held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the right side's keys are dropped."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(other, cond, how).drop(*[f"_r_{k}" for k in keys])


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if ``df`` (narrow, already materialised) counts at most ``rows`` rows; else a plain shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Share of all rows from which a key is hot; there are at most 1 / HOT such keys.
HOT = 0.001


def hot_join(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """Left join of ``rows`` to ``table`` (one row for each key) in which no hot key goes to one task.

    Keys with a share HOT of all rows or more are joined by broadcast (their
    number is bounded by that share), all others by shuffle.  ``counts`` (key, n)
    gives the rows of each key where that is known already.
    """
    if counts is None:
        counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(key, "n").checkpoint()
    total = counts.agg(F.sum("n")).first()[0] or 0  # one row
    keys = counts.filter(F.col("n") >= total * HOT).select(key)
    hot = table.join(F.broadcast(keys), key, "left_semi").withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), key, "left")
    rest = marked.filter("_hot IS NULL").select(*rows.columns).join(table, key, "left")
    return marked.filter("_hot").drop("_hot").unionByName(rest)


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds, for each (name, column) of ``sums``, the sum of the column over all rows before a row in ``order``.

    A range-partitioned sort: one row for each partition gives the partitions'
    offsets, and the running sum inside a partition does the rest; no task holds
    more than a partition.  The partitioned rows are checkpointed, so both steps
    see the same partitions.  ``order`` should be total.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()).checkpoint()
    parts = rows.groupBy("_p").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = parts.select("_p", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({k: F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()}).join(offsets, "_p")
    return out.withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop("_p", *[f"_{k}" for k in sums])
