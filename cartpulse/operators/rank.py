"""Rankings and top-k.

Every ranking uses an explicit total order (score desc, then tie columns),
so results do not depend on partitioning.  ``top_k`` is a ``row_number``
filter that Spark plans as a ``WindowGroupLimit`` on both sides of the
shuffle: each map task forwards at most k rows per group, so a hot family
costs k rows, not its size.  Full rankings of groups that grow with the data
share one range-partitioned sort (``ordered_ranks``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartpulse.session import shuffle_partitions

TIE_DIGITS = 12


def score_key(score: str, tie_digits: int | None = TIE_DIGITS) -> Column:
    """Scores equal to ``tie_digits`` decimals count as ties (decided by the
    tie columns), so last-bit noise of exp/pow cannot reorder equal scores."""
    c = F.col(score)
    return F.round(c, tie_digits) if tie_digits is not None else c


def _order(score: str, ties: Sequence[str | Column]) -> list[Column]:
    out = [score_key(score).desc_nulls_last()]
    for t in ties:
        if isinstance(t, Column):
            out.append(t)
        elif t.startswith("-"):
            out.append(F.col(t[1:]).desc_nulls_last())
        else:
            out.append(F.col(t).asc_nulls_last())
    return out


def rank_within(df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str | Column] = (),
                name: str = "rank") -> DataFrame:
    """1-based row number inside each group, by score desc then ties (W1):
    one window, for groups bounded by the catalogue (a family's
    subcategories); ``distributed_ranks`` is for groups that grow."""
    w = Window.partitionBy(*keys).orderBy(*_order(score, ties))
    return df.withColumn(name, F.row_number().over(w))


def ordered_ranks(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                  names: dict[str, Sequence[str]]) -> DataFrame:
    """1-based row numbers by ``order`` inside groups of any size.

    ``names`` maps each new column to the columns that refine ``keys`` for it
    (an empty list: the group is ``keys``); all share one sort.  Rows are
    range-partitioned on (keys, order), so a group that holds a third of the
    table spans a third of the partitions; the partitioned rows are
    checkpointed to the shared folder so every pass sees the same partitions.
    One count per (group, partition) gives the rows of the group before each
    partition, and a window inside (group, partition) does the rest.
    """
    n = shuffle_partitions(df.sparkSession)
    full = [F.col(k).asc_nulls_last() for k in keys] + list(order)
    out = (
        df.repartitionByRange(n, *full).sortWithinPartitions(*full)
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint(eager=True).withColumn("_p", F.shiftright("_mid", 33))
    )
    for name, finer in names.items():
        group = [*keys, *finer]
        stats = out.groupBy(*group, "_p").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        stats = stats.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_p").alias("_q"),
                             F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
        inside = Window.partitionBy(*group, "_p").orderBy("_mid")
        cond = F.col("_p") == F.col("_q")
        for c in group:
            cond = cond & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        out = out.withColumn("_r", F.row_number().over(inside)).join(stats, cond).withColumn(
            name, (F.col("_off") + F.col("_r")).cast("int")).drop("_off", "_r", "_q", *[f"_g_{c}" for c in group])
    return out.drop("_mid", "_p")


def distributed_ranks(df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str | Column] = (),
                      names: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """``ordered_ranks`` by score desc, then ties."""
    return ordered_ranks(df, keys, _order(score, ties), names or {"rank": []})


def top_k(df: DataFrame, keys: Sequence[str], score: str, k: int, ties: Sequence[str | Column] = (),
          name: str = "rank") -> DataFrame:
    """The k best rows of each group (O4; O5 with two keys)."""
    return rank_within(df, keys, score, ties, name).filter(F.col(name) <= k)


def global_ordinal(df: DataFrame, score: str, ties: Sequence[str | Column] = (),
                   name: str = "top") -> DataFrame:
    """0-based position of each row over the whole table by score desc (D26):
    a range-partitioned sort plus per-partition offsets (``distributed_ranks``
    with no group keys); never a single-partition window."""
    out = distributed_ranks(df, [], score, ties, {"_rank1": []})
    return out.withColumn(name, (F.col("_rank1") - 1).cast("bigint")).drop("_rank1")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a stated order (one row per key and map task is shuffled)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 1).drop("_r")


#: The delivered columns in order; those that a table lacks are left out.
DELIVERY_COLUMNS = ["top", "family_id", "subcat_id", "subcat_name", "recency", "frequency", "sow", "season", "ppmi", "score",
                    "cycle_days", "days_since_last", "season_gap_mean", "season_gap_std", "division_id", "division", "top_dc"]


def delivery_table(scored: DataFrame, names: DataFrame, divisions: DataFrame, labels: Sequence[str],
                   score: str = "score", ties: Sequence[str] = ("-net_sales", "subcat_id")) -> DataFrame:
    """Scored subcategories with name, division code and label, ranked per family and division.

    ``names`` (subcat_id, subcat_name) and ``divisions`` (subcat_id, division_id, division) are one row per
    subcategory; only divisions in ``labels`` are delivered.  Columns that ``scored`` does not have are left out.
    """
    out = scored.join(names, "subcat_id", "left").join(divisions, "subcat_id").filter(F.col("division").isin(*labels))
    out = rank_within(out, ["family_id", "division"], score, ties, "top_dc").withColumns(
        {"top": F.lit(0).cast("bigint"), "ppmi": F.lit(0).cast("bigint")})
    return out.select(*[c for c in DELIVERY_COLUMNS if c in out.columns])
