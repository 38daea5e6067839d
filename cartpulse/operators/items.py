"""Pushing subcategory scores down to items.

One (family, subcat, item, invoice) pre-aggregation feeds both repurchase (D18,
per family and item) and popularity (D19, distinct invoices per item and per
subcategory).  The blend (D20) min-max scales by extremes observed while the joined table is written.
Item ranks (D23, D24) share one range-partitioned sort with total orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from cartpulse.functions import scores as S
from cartpulse.functions.periods import as_date, shift_days
from cartpulse.operators.rank import distributed_ranks, rank_within
from cartpulse.session import stored


def history(lines: DataFrame, ref_date, data_cutoff=None) -> DataFrame:
    end = as_date(data_cutoff) if data_cutoff is not None else as_date(ref_date)
    return lines.filter(F.col("day") <= F.lit(end))


ITEM_KEYS = ["family_id", "subcat_id", "item_id"]
ITEM_COUNTS = ["n_buys", "p30", "p60", "p90", "p_long"]


def item_table(lines: DataFrame, ref_date, data_cutoff=None, long_days: int = 180, pop_days: int = 365) -> DataFrame:
    """(family, subcat, item) counts from one pass over the lines.

    Level 1 groups lines by (family, subcat, item, invoice): window counts,
    last day, division; the first row of each (family, subcat, invoice) is
    marked, rows without an item included.  Level 2 sums level 1 per (family,
    subcat, item); the marks of a subcategory sum to its distinct invoices.
    """
    ref = as_date(ref_date)
    day = F.col("day")
    has_inv = F.col("invoice_id").isNotNull()

    def since(n, cond=None):
        c = day >= F.lit(shift_days(ref, -n))
        if cond is not None:
            c = c & cond
        return F.sum(F.when(c, 1).otherwise(0)).cast("bigint")

    l1 = history(lines, ref, data_cutoff).groupBy("family_id", "subcat_id", "item_id", "invoice_id").agg(
        F.max("day").alias("last_day"),
        F.count("day").alias("n_buys"),
        since(30).alias("p30"), since(60).alias("p60"), since(90).alias("p90"),
        since(long_days).alias("p_long"),
        since(pop_days, has_inv).alias("l_recent"),
        F.max("division").alias("division"),
    )
    # with shuffle joins the lines are already partitioned by invoice, so
    # neither level 1 nor this window shuffles again
    one = Window.partitionBy("family_id", "subcat_id", "invoice_id").orderBy("item_id")
    l1 = l1.withColumn("_mark", F.when(has_inv & (F.row_number().over(one) == 1), 1).otherwise(0))
    return l1.groupBy("family_id", "subcat_id", "item_id").agg(
        F.max("last_day").alias("last_day"),
        *[F.sum(c).cast("bigint").alias(c) for c in ITEM_COUNTS],
        F.count("invoice_id").cast("bigint").alias("item_invoices"),
        F.sum("l_recent").cast("bigint").alias("last_year_lines"),
        F.max("division").alias("division"),
        F.sum("_mark").cast("bigint").alias("_marks"),
    )


def item_aggregates(lines: DataFrame, ref_date, data_cutoff=None, long_days: int = 180,
                    pop_days: int = 365) -> DataFrame:
    """One row per (family, subcat, item) with everything D18 and D19 need.

    Two windows over the item table, so the lines are aggregated once and
    nothing is stored: per (family, subcat) the subcategory's distinct invoices
    and items (a partition is at most the catalogue of that subcategory), per
    (family, item) the repurchase counts, since an item may appear under
    several subcategories.  Lines without an item count for their subcategory
    and give no item row.
    """
    items = item_table(lines, ref_date, data_cutoff, long_days, pop_days)
    subcat, item = Window.partitionBy("family_id", "subcat_id"), Window.partitionBy("family_id", "item_id")
    items = items.withColumns({
        "subcat_items": F.count("item_id").over(subcat).cast("bigint"), "subcat_invoices": F.sum("_marks").over(subcat).cast("bigint")})
    own = items.filter(F.col("item_id").isNotNull()).withColumns(
        {"last_day": F.max("last_day").over(item)} | {c: F.sum(c).over(item).cast("bigint") for c in ITEM_COUNTS})
    return own.drop("_marks")


def repurchase_stage(legacy_bucket90: bool = False, ref=None) -> dict:
    n90 = (F.col("p90") - F.col("p60") - F.col("p30")) if legacy_bucket90 else (F.col("p90") - F.col("p60"))
    return {"n30": F.col("p30"), "n60": F.col("p60") - F.col("p30"), "n90": n90,
            "days_since_last": F.datediff(F.lit(ref), F.col("last_day")).cast("bigint")}


def with_repurchase(df: DataFrame, ref_date, legacy_bucket90: bool = False) -> DataFrame:
    """Due-date sigmoid times a bucket penalty."""
    df = df.withColumns(repurchase_stage(legacy_bucket90, as_date(ref_date)))
    due = S.due_curve(F.col("days_since_last").cast("double"))
    pen = S.repurchase_penalty(F.col("n30"), F.col("n60"), F.col("n90"), F.col("p_long"))
    df = df.withColumns({"due": due, "penalty": pen})
    return df.withColumn("repurchase", F.least(F.lit(1.0), F.col("due") * F.col("penalty")))


def with_popularity(df: DataFrame) -> DataFrame:
    """Smoothed share of the subcategory's invoices, with penalties for
    an item that holds all of them and for rare recent buying."""
    return df.withColumn(
        "popularity",
        S.popularity(F.col("item_invoices").cast("double"), F.col("subcat_invoices").cast("double"),
                     F.col("subcat_items").cast("double"), F.col("last_year_lines")),
    )


def item_repurchase(lines: DataFrame, ref_date, data_cutoff=None, long_days: int = 180,
                    legacy_bucket90: bool = False) -> DataFrame:
    """D18 per (family, item), over all subcategories of the item."""
    agg = item_aggregates(lines, ref_date, data_cutoff, long_days)
    return with_repurchase(agg.dropDuplicates(["family_id", "item_id"]), ref_date, legacy_bucket90)


def item_popularity(lines: DataFrame, ref_date, data_cutoff=None, days: int = 365) -> DataFrame:
    """D19 per (family, subcat, item)."""
    return with_popularity(item_aggregates(lines, ref_date, data_cutoff, pop_days=days))


def minmax(df: DataFrame, cols: list[str], suffix: str = "_scaled") -> DataFrame:
    """M3: global min-max scaling to [0, 1]; a constant column becomes 0.

    The rows are written once to the shared folder; their extremes are observed
    during that write, so no second pass and no join is needed.
    """
    seen = Observation()
    rows = stored(df.observe(seen, *[f(c).alias(f"{f.__name__}_{c}") for c in cols for f in (F.min, F.max)]))
    scaled = {}
    for c in cols:
        lo, hi = seen.get[f"min_{c}"], seen.get[f"max_{c}"]
        scaled[f"{c}{suffix}"] = (F.col(c) - lo) / (hi - lo) if lo is not None and hi > lo else F.lit(0.0)
    return rows.withColumns(scaled)


def item_scores(subcat_scores: DataFrame, lines: DataFrame, ref_date, data_cutoff=None,
                prob: str = "score", ranks: bool = True) -> DataFrame:
    """D20 + D22-D24: every item a family bought in a scored subcategory with
    its blended score and three ranks.  The subcategory scores may come from
    the linear score, the trained ranker or a stored table (S9)."""
    agg = with_popularity(with_repurchase(item_aggregates(lines, ref_date, data_cutoff), ref_date))
    return score_items(subcat_scores, agg, prob, ranks)


def score_items(subcat_scores: DataFrame, agg: DataFrame, prob: str = "score", ranks: bool = True) -> DataFrame:
    """Blend, scale and rank item aggregates under their subcategory scores."""
    sc = subcat_scores.select("family_id", "subcat_id", F.col(prob).alias("prob"))
    # Rank of the subcategory inside the family on the pair table (one
    # row per subcategory bought), inherited by its items through the join
    sc = rank_within(sc, ["family_id"], "prob", ["subcat_id"], "subcat_rank")
    narrow = agg.select("family_id", "subcat_id", "item_id", "division", "last_day", "n_buys", "repurchase", "popularity")
    items = minmax(sc.join(narrow, ["family_id", "subcat_id"]), ["repurchase", "popularity"])
    b = S.ITEM_BLEND
    items = items.withColumn(
        "item_score", b[0] * F.col("prob") + b[1] * F.col("repurchase_scaled") + b[2] * F.col("popularity_scaled"))
    if not ranks:
        return items
    # Both ranks from one range-partitioned sort
    items = distributed_ranks(items, ["family_id"], "item_score", ["item_id", "subcat_id"],
                              {"item_rank": [], "division_rank": ["division"]})
    return items.withColumn("division_rank", F.when(F.col("division").isNotNull(), F.col("division_rank")))


def items_by_division(items: DataFrame) -> DataFrame:
    """D24 output: only items of a known division, with their division rank."""
    return items.filter(F.col("division").isNotNull())


def consolidate_item_lines(lines: DataFrame) -> DataFrame:
    """One row per (family, item, day, subcat) with null keys kept:
    summed quantity, mean money columns, last invoice, descriptive columns
    that are constant within the group."""
    return lines.groupBy("family_id", "item_id", "day", "subcat_id").agg(
        F.sum("qty").alias("qty"),
        F.avg("list_price").alias("list_price"),
        F.avg("net_sales").alias("net_sales"),
        F.avg("discount").alias("discount"),
        F.max("invoice_id").alias("invoice_id"),
        F.max("store_id").alias("store_id"),
        F.count(F.lit(1)).cast("bigint").alias("n_lines"),
        F.min("subcat_name").alias("subcat_name"),
        F.min("division").alias("division"),
    )


def consolidate_scored_items(lines: DataFrame, items: DataFrame, features: DataFrame) -> DataFrame:
    """D21 + A11 on scored items: the consolidated lines of each (family, item, day, subcat), null keys
    kept, with the item's scores and counts, the pair's features and the number of days the item was
    bought on.  Lines without a scored item carry nulls.

    The lines are dealt once by (family, subcat, item): the consolidation, the count of days and the
    join with the scores all keep that partitioning."""
    base = consolidate_item_lines(lines.repartition(*ITEM_KEYS))
    days = F.count(F.lit(1)).over(Window.partitionBy(*ITEM_KEYS)).cast("bigint")
    scores = items.select("family_id", "subcat_id", "item_id", "n_buys", "prob", "repurchase", "popularity",
                          "repurchase_scaled", "popularity_scaled", "item_score")
    feats = features.select("family_id", "subcat_id", "recency", "frequency", "sow", "season", "cycle_days",
                            "days_since_last", "freq_lines", "sow_weighted_lines", "season_gap_mean", "season_gap_std")
    out = base.withColumn("item_days", days)
    return out.join(scores, ITEM_KEYS, "left").join(feats, ["family_id", "subcat_id"], "left")


def reduction_ratio(before: DataFrame, after: DataFrame) -> DataFrame:
    """1 - rows(after) / rows(before), from two counts."""
    a = before.agg(F.count(F.lit(1)).alias("rows_before"))
    b = after.agg(F.count(F.lit(1)).alias("rows_after"))
    return a.crossJoin(b).withColumn(
        "reduction", F.when(F.col("rows_before") > 0, 1.0 - F.col("rows_after") / F.col("rows_before")))
