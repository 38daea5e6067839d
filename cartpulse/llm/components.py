"""Connected components of a link table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def jumped(pointers: DataFrame) -> DataFrame:
    """(id, label): the end of the chain of pointers (id, up), up < id, from every id; one pointer for each id.

    Each round doubles the length a pointer spans, so the rounds follow the
    logarithm of the longest chain.  A popular ``up`` costs a join with one row
    on its other side, which Spark splits by size.
    """
    at = pointers.select("id", "up").checkpoint()
    while True:
        over = at.select(F.col("id").alias("up"), F.col("up").alias("up2"))
        seen = Observation()
        at = (
            at.join(over, "up", "left").observe(seen, F.count("up2").alias("moved"))
            .select("id", F.coalesce("up2", "up").alias("up")).checkpoint()
        )
        if not seen.get["moved"]:
            return at.select("id", F.col("up").alias("label"))


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, label) for every id of ``links``: label is the smallest id of its component.

    Links may repeat, point either way and name an id twice; null ends are
    ignored.  In a pass every node points at its smallest smaller neighbour, the
    pointers are followed to their ends, and the links are redrawn between
    these; it ends when no link joins two ends.  A node linked to a third of all rows
    costs one partial minimum for each task and joins that Spark splits
    by size.  Each step is checkpointed to the shared folder.
    """
    links = (
        links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v")))
        .distinct().checkpoint()
    )
    labels = None
    while labels is None or links.take(1):
        new = jumped(links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("up")))
        labels = new if labels is None else relabelled(labels, new)
        links = (
            links.join(new.select(F.col("id").alias("u"), F.col("label").alias("a")), "u")
            .join(new.select(F.col("id").alias("v"), F.col("label").alias("b")), "v", "left")
            .select(F.col("a"), F.coalesce("b", "v").alias("b")).filter("a != b")
            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
        )
    return labels.unionByName(labels.select(F.col("label").alias("id"), "label").distinct())


def relabelled(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """``labels`` (id, label; an id that is its own label has no row) after the labels of ``merged`` (id, label) have moved."""
    moved = labels.join(merged.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left")
    return moved.select("id", F.coalesce("to", "label").alias("label")).unionByName(merged).checkpoint()
