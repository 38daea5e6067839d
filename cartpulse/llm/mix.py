"""Mixing sources to target weights.

Every document gets a hash-random key (md5 of doc_id and text); within each
source the documents are ordered by key, prefix sums of their sizes are
computed, and the source is cut where its budget of words is used up; a budget
above the source's own size takes whole epochs first.

Keys are hash-random, so their first RANGE_DIGITS hex digits are a range
partitioning of every source: one sum for each (source, range), a running sum
over at most 16**RANGE_DIGITS ranges of a source, and only the range that the
cut falls into is sorted.  Neither the documents of a large source nor the
sources ever meet in one task: the decision is one row for each source (epochs,
key and remainder at the cut), joined to the documents.

Targets.  Sources in order of code points, null last, weigh 5, 2, 1, 5, 2, 1,
...; all words are shared by weight, a target stops at MAX_EPOCHS times its
source's size, and the excess is shared again by weight until no target is
above.  In order of the ratio of cap to weight the capped sources come first,
so two prefix sums give the final share of one unit of weight.

The document at the cut gives only the words still wanted (``taken``); with
``whole=True`` (the pipeline) it is taken whole if that comes nearer.  Equal
rows (same doc_id, source and text) have one key and share what is left
evenly.

Defined cases.  Null and wordless texts have size 0 and are never part of a
cut; a source of size 0 has target 0.  Null doc_ids are ordered by their text.
A null source is a source.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import broadcast_if_small, null_safe, prefix_sums

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
RANGE_DIGITS = 3
BROADCAST_SOURCES = 1_000_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target)."""
    named = prefix_sums(sizes.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], {"place": "one"})
    choice = F.array(*[F.lit(w) for w in weights])
    named = named.select("source", "source_size", F.element_at(choice, (F.col("place") % len(weights) + 1).cast("int")).alias("weight")).withColumn(
        "cap", F.col("source_size") * most)
    ratio = F.col("cap") / F.col("weight")
    ranked = prefix_sums(named, [ratio, F.col("source").asc_nulls_last()], {"cap_before": "cap", "weight_before": "weight"})
    total = named.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("total_weight"))
    marked = ranked.crossJoin(F.broadcast(total))  # one row
    unit = (F.col("total") - F.col("cap_before")).cast("double") / (F.col("total_weight") - F.col("weight_before")).cast("double")
    marked = marked.withColumn("capped", F.col("cap") <= unit * F.col("weight"))
    free = marked.filter("NOT capped").agg(F.min("cap_before").alias("capped_sum"), F.min("weight_before").alias("capped_weight"))
    marked = marked.crossJoin(F.broadcast(free))  # one row
    share = (F.col("total") - F.col("capped_sum")).cast("double") / (F.col("total_weight") - F.col("capped_weight")).cast("double")
    return marked.select("source", "source_size", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share * F.col("weight")).alias("target"))


def cuts(sized: DataFrame) -> DataFrame:
    """(source, key, size) rows to one row for each source: target, epochs, cut_key, and at the cut ``left`` words for ``n`` equal rows."""
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumn("budget", F.floor(F.col("target") + 0.5))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")).checkpoint()
    ranged = sized.filter("size > 0").withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    upto = Window.partitionBy("source").orderBy("range")
    sums = sums.withColumn("upto", F.sum("range_size").over(upto))
    hit = null_safe(sums, goal.select("source", "rest"), ["source"]).filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("range_size") <= F.col("rest")))
    hit = hit.select("source", "range", (F.col("rest") - F.col("upto") + F.col("range_size")).alias("inside")).checkpoint()
    units = null_safe(ranged, broadcast_if_small(hit, BROADCAST_SOURCES), ["source", "range"]).groupBy("source", "inside", "key").agg(
        F.sum("size").alias("unit"), F.count(F.lit(1)).alias("n"))
    units = units.withColumn("upto", F.sum("unit").over(Window.partitionBy("source").orderBy("key")))
    at = units.filter((F.col("upto") > F.col("inside")) & (F.col("upto") - F.col("unit") <= F.col("inside"))).select(
        "source", F.col("key").alias("cut_key"), (F.col("inside") - F.col("upto") + F.col("unit")).alias("left"), "n", "unit")
    return null_safe(goal, at, ["source"], "left").select("source", "source_size", "weight", "target", "epochs", "cut_key", "left", "n", "unit").checkpoint()


def mixture(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for every row of ``docs``."""
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), key(F.col("doc_id"), F.col("text")).alias("key")).checkpoint()
    rows = null_safe(sized, broadcast_if_small(cuts(sized), BROADCAST_SOURCES), ["source"], "left")
    extra = (
        F.when(F.col("key") < F.col("cut_key"), F.col("size"))
        .when(F.col("key") == F.col("cut_key"), F.least("size", F.expr("`left` div n")))
        .otherwise(F.lit(0)).cast("long")
    )
    return rows.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.when(F.col("size") > 0, extra).otherwise(0)).alias("taken"), "source")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, whole, each as often as the mix takes it (wordless rows: once for each full epoch of their source).

    The rows travel as one struct, so no column of theirs can clash with one of the plan.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("source"),
        words(F.col("text")).alias("size"), key(F.col("doc_id"), F.col("text")).alias("key"))
    plan = cuts(rows.select("source", "size", "key").checkpoint()).select("source", "epochs", "cut_key", "left", "unit")
    rows = null_safe(rows, broadcast_if_small(plan, BROADCAST_SOURCES), ["source"], "left")
    once_more = F.coalesce((F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.col("left") * 2 >= F.col("unit"))), F.lit(False))
    copies = F.col("epochs") + F.when(once_more & (F.col("size") > 0), 1).otherwise(0)
    rows = rows.select("row", copies.cast("int").alias("copies")).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
