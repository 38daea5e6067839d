"""Per (family, subcategory) behavioural features: D1, D3-D16.

Plan (no per-family loop, no joins, no UDF):

1. filter lines to ``day < ref_date`` (and ``day <= data_cutoff``);
2. level 1, ``groupBy(family, subcat, invoice)``: money sums, row counts,
   window-conditional line counts, per-invoice window flags, the weekly
   blocks of the cycle window as bit masks (``bit_or``), 13 month counts;
3. level 2, ``groupBy(family, subcat)``: sums of the above; distinct invoice
   counts become plain counts of level-1 groups, so there is no ``Expand``
   and no growing set state.  Both levels aggregate map-side first, so a hot
   pair only ever ships one partial row per map task;
4. per-pair column math over arrays with higher-order functions;
5. one window by family (whole partition, at most one row per subcat) for
   the share-of-wallet denominator and the family activity flags.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartpulse.functions import arrays as A
from cartpulse.functions import scores as S
from cartpulse.functions.periods import Windows, as_date

KEYS = ["family_id", "subcat_id"]
MIN_BLOCKS = 3
MAX_BLOCKS = 10
STD_THRESHOLD = 0.1
MIN_PEAKS = 2


def windows_for(ref_date, **kw) -> Windows:
    return Windows(ref=as_date(ref_date), **kw)


def _cnt(cond: Column) -> Column:
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def _flag(cond: Column) -> Column:
    return F.max(F.when(cond, F.lit(1)).otherwise(F.lit(0)))


def restrict(lines: DataFrame, w: Windows, data_cutoff=None) -> DataFrame:
    """Rows strictly before the reference date (and up to the data cutoff)."""
    out = lines.filter(F.col("day") < F.lit(w.ref))
    if data_cutoff is not None:
        out = out.filter(F.col("day") <= F.lit(as_date(data_cutoff)))
    return out


def pair_aggregates(lines: DataFrame, w: Windows, data_cutoff=None, by=()) -> DataFrame:
    """Level-1 and level-2 aggregation; one row per (family, subcat), and per value of the columns ``by``."""
    day = F.col("day")
    inv = F.col("invoice_id")
    has_inv = inv.isNotNull()
    base = restrict(lines, w, data_cutoff)

    in_cycle = day >= F.lit(w.cycle_start)
    block = F.floor(F.datediff(day, F.lit(w.cycle_start)) / F.lit(w.block_days)).cast("int")
    masks = [f"mask{j}" for j in range(A.mask_words(w.n_blocks))]
    s0 = w.series_start
    month_idx = (F.year(day) - s0.year) * 12 + F.month(day) - s0.month
    in_series = (day >= F.lit(s0)) & (day <= F.lit(w.ref))
    in_recent = day >= F.lit(w.sow_recent_start)
    in_old = (day >= F.lit(w.sow_start)) & (day < F.lit(w.sow_recent_start))
    in_freq = day >= F.lit(w.freq_start)
    in_season = (day > F.lit(w.season_start)) & (day <= F.lit(w.ref))
    in_prior = (day > F.lit(w.season_prior_start)) & (day <= F.lit(w.season_prior_end))

    l1 = [
        F.sum("qty").alias("qty"),
        F.sum("net_sales").alias("net"),
        F.sum("discount").alias("disc"),
        F.sum("list_price").alias("price"),
        F.count(F.lit(1)).alias("rows"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.count(inv).alias("lines"),
        _cnt(in_freq & has_inv).alias("lines_freq"),
        _flag(in_freq).alias("any_freq"),
        _cnt(in_recent & has_inv).alias("lines_recent"),
        _cnt(in_old & has_inv).alias("lines_old"),
        _flag(in_cycle).alias("any_active"),
        _flag(in_series).alias("any_series"),
        _flag(in_season & has_inv).alias("in_season"),
        _flag(in_prior & has_inv).alias("in_prior"),
    ]
    for j, name in enumerate(masks):
        own = in_cycle & (block >= j * A.MASK_BITS) & (block < (j + 1) * A.MASK_BITS)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), block - j * A.MASK_BITS)
        l1.append(F.bit_or(F.when(own, bit)).alias(name))
    l1 += [_cnt(in_series & (month_idx == k) & has_inv).alias(f"m{k}") for k in range(w.n_months)]
    level1 = base.groupBy(*by, "family_id", "subcat_id", "invoice_id").agg(*l1)

    l2 = [
        F.sum("qty").alias("total_qty"),
        F.sum("net").alias("total_net"),
        F.sum("disc").alias("total_discount"),
        F.sum("price").alias("total_list_price"),
        F.sum("rows").alias("n_rows"),
        F.count("invoice_id").alias("n_invoices"),
        F.sum("lines").alias("n_lines"),
        F.min("first_day").alias("first_day"),
        F.max("last_day").alias("last_day"),
        F.sum("lines_freq").alias("lines_freq"),
        F.max("any_freq").alias("any_freq"),
        F.sum("lines_recent").alias("lines_recent"),
        F.sum("lines_old").alias("lines_old"),
        F.max("any_active").alias("any_active"),
        F.max("any_series").alias("any_series"),
        F.sum("in_season").cast("bigint").alias("season_recent_invoices"),
        F.sum("in_prior").cast("bigint").alias("season_prior_invoices"),
    ]
    l2 += [F.bit_or(name).alias(name) for name in masks]
    l2 += [F.sum(f"m{k}").alias(f"m{k}") for k in range(w.n_months)]
    out = level1.groupBy(*by, *KEYS).agg(*l2)
    held = [f"coalesce({name}, 0L)" for name in masks]
    return out.withColumn("blocks_all", A.col(A.blocks_from_masks(held, w.n_blocks))).drop(*masks)


# --- per-pair column math ---------------------------------------------------
# The math is written as lists of stages; each stage is one ``withColumns``
# (one Project) whose expressions only read columns of earlier stages.
# Chains that do not depend on each other share stages, so the whole
# feature derivation is a handful of projections inside one codegen stage.

Stage = dict  # column name -> Column


def merge_stages(*chains: list[Stage]) -> list[Stage]:
    out: list[Stage] = []
    for chain in chains:
        for i, st in enumerate(chain):
            if i == len(out):
                out.append({})
            out[i].update(st)
    return out


def apply_stages(df: DataFrame, stages: list[Stage]) -> DataFrame:
    for st in stages:
        if st:
            df = df.withColumns(st)
    return df


def cycle_stages(w: Windows, min_blocks=MIN_BLOCKS, max_blocks=MAX_BLOCKS,
                 std_threshold=STD_THRESHOLD) -> list[Stage]:
    """D3 + D2: cycle from the latest weekly blocks, clipped gaps."""
    active = F.col("any_active") == 1
    enough = F.size("_blocks") >= min_blocks
    ok = active & enough
    diffs = (f"CASE WHEN size(_blocks) >= {min_blocks} "
             f"THEN {A.successive_diffs('_blocks', w.block_days)} ELSE CAST(array() AS ARRAY<INT>) END")
    return [
        {"_blocks": A.col(A.last_n("blocks_all", max_blocks))},
        {"gaps_days": A.col(f"transform({diffs}, x -> CAST(x AS BIGINT))"),
         "_gd": A.col(f"transform({diffs}, x -> CAST(x AS DOUBLE))")},
        {"_gm": A.col(A.arr_mean("_gd"))},
        {"_gs": A.col(f"sqrt(try_divide(aggregate(_gd, 0D, (acc, x) -> acc + (x - _gm) * (x - _gm)), size(_gd)))")},
        {"gaps_clipped_days": A.col(A.clip_values("_gd", "_gm", "_gs", std_threshold)),
         "cycle_days_raw": F.when(ok, F.col("_gm")).otherwise(0.0),
         "penalty_strength": F.when(~active, 0.0).when(~enough, 2.0)
         .otherwise(A.col(A.clip_strength("_gd", "_gm", "_gs"))),
         "penalty_mean": F.when(ok, A.col(A.clip_mean("_gd", "_gm", "_gs"))).otherwise(0.0),
         "penalty_std": F.when(ok, A.col(A.clip_std("_gd", "_gm", "_gs"))).otherwise(0.0),
         "_cycle_ok": ok},
        {"cycle_days": F.when(F.col("_cycle_ok"), A.col(A.arr_mean("gaps_clipped_days"))).otherwise(0.0)},
    ]


def series_stages(w: Windows, min_peaks=MIN_PEAKS) -> list[Stage]:
    """13-month line series, threshold, bits, thinning, gaps, regularity.
    Pairs without a line in the series window have no series: empty arrays,
    zeros."""
    present = F.col("any_series") == 1
    empty_long = F.expr("CAST(array() AS ARRAY<BIGINT>)")
    many = F.size("_pg") > 1
    sentinel = F.lit(S.SEASON_CV_SENTINEL)
    return [
        {"_series": F.array(*[F.col(f"m{k}") for k in range(w.n_months)])},
        {"_thr": A.col(A.positive_floor_mean("_series"))},
        {"_bits": A.col(A.discretize("_series", "_thr"))},
        {"_thin": A.col(A.thin_runs("_bits"))},
        {"_peaks": A.col(A.zero_run_gaps("_thin", min_peaks))},
        {"_pg": A.col("transform(_peaks, x -> CAST(x AS DOUBLE))")},
        {"_pm": A.col(A.arr_mean("_pg"))},
        {"_ps": A.col("sqrt(try_divide(aggregate(_pg, 0D, (acc, x) -> acc + (x - _pm) * (x - _pm)), size(_pg)))")},
        {"_cv": F.when(many, F.col("_ps") / F.col("_pm")).otherwise(sentinel)},
        {"season_series": F.when(present, F.col("_series")).otherwise(empty_long),
         "season_threshold": F.when(present, F.col("_thr")).otherwise(F.lit(0).cast("bigint")),
         "season_bits": F.when(present, F.col("_bits")).otherwise(F.lit("")),
         "season_thinned": F.when(present, F.col("_thin")).otherwise(F.lit("")),
         "season_peak_gaps": F.when(present, F.col("_peaks")).otherwise(empty_long),
         "season_gap_mean": F.when(present, F.when(many, F.col("_pm")).otherwise(sentinel)).otherwise(0.0),
         "season_gap_std": F.when(present, F.when(many, F.col("_ps")).otherwise(sentinel)).otherwise(0.0),
         "season_cv": F.when(present, F.col("_cv")).otherwise(0.0),
         "season_regularity": F.when(present, S.regularity(F.col("_cv"))).otherwise(0.0)},
    ]


def recency_stage(w: Windows) -> Stage:
    """Rises after a purchase, peaks at one cycle, decays beyond it
    (reads ``cycle_days`` and ``days_since_last``)."""
    c = F.when(F.col("cycle_days") > 0, F.col("cycle_days"))
    has_c = F.col("cycle_days") > 0
    d = F.col("days_since_last").cast("double")
    base = F.when(has_c, S.recency_base(d, c)).otherwise(0.0)
    pen = F.when(has_c, S.recency_penalty(d, c)).otherwise(0.0)
    return {
        "recency_base": base,
        "last_over_cycle": F.when(has_c, d / c).otherwise(0.0),
        "recency_penalty": pen,
        "recency": base * pen,
    }


def days_since_last(w: Windows) -> Column:
    return F.greatest(F.lit(0), F.datediff(F.lit(w.ref), F.col("last_day"))).cast("bigint")


def frequency_stages(w: Windows, fam_any_freq: Column) -> list[Stage]:
    """Recent line count against the count the cycle predicts."""
    c = F.when(F.col("cycle_days") > 0, F.col("cycle_days"))
    in_window = F.col("any_freq") == 1
    empty_family = fam_any_freq == 0
    exp_ = F.col("_exp")
    ratio = F.when(exp_ > 0, F.col("lines_freq") / F.when(exp_ > 0, exp_)).otherwise(S.FREQ_NO_EXPECTATION_RATIO)
    return [
        {"_exp": F.when(in_window, F.coalesce(S.expected_purchases(c, w.freq_days), F.lit(0.0))).otherwise(0.0)},
        {"_ratio": F.when(in_window, ratio).otherwise(0.0)},
        {"frequency": F.when(empty_family, S.FREQ_EMPTY_FAMILY).otherwise(
            F.when(in_window & (exp_ > 0), S.frequency_curve(F.col("_ratio"))).otherwise(0.0)),
         "freq_expected": F.when(~empty_family, exp_),
         "freq_lines": F.when(~empty_family, F.when(in_window, F.col("lines_freq")).otherwise(0)).cast("bigint"),
         "freq_ratio": F.when(~empty_family, F.col("_ratio"))},
    ]


def sow_expr(fam_total: Column, fam_max: Column) -> Column:
    """Weighted line counts, share in family, rescaled by the family max."""
    share = F.col("sow_weighted_lines").cast("double") / fam_total
    return F.when(fam_total > 0, share * (1.0 / (fam_max / fam_total))).otherwise(0.0)


def weighted_lines() -> Column:
    return (S.SOW_RECENT_WEIGHT * F.col("lines_recent") + S.SOW_OLD_WEIGHT * F.col("lines_old")).cast("bigint")


def season_exprs() -> Stage:
    """Backlog against the same quarter a year earlier, times regularity."""
    need = S.season_need(F.col("season_prior_invoices").cast("double"),
                         F.col("season_recent_invoices").cast("double"))
    present = F.col("any_series") == 1
    return {
        "season_need": need,
        "season": F.when(present, need * (0.5 + 0.5 * F.col("season_regularity"))).otherwise(0.0),
    }


FEATURE_COLUMNS = [
    "family_id", "subcat_id", "recency", "frequency", "sow", "season", "score",
    "cycle_days", "penalty_strength", "penalty_mean", "penalty_std", "gaps_days", "gaps_clipped_days",
    "recency_penalty", "last_over_cycle", "days_since_last", "recency_base",
    "freq_expected", "freq_lines", "freq_ratio",
    "sow_weighted_lines",
    "season_regularity", "season_threshold", "season_series", "season_bits", "season_thinned",
    "season_peak_gaps", "season_cv", "season_gap_mean", "season_gap_std",
    "net_sales",
]


def pair_table(lines: DataFrame, ref_date, data_cutoff=None, families: DataFrame | None = None,
               keep_inactive: bool = False, windows: Windows | None = None) -> DataFrame:
    """All pair aggregates plus every feature column (wide, internal)."""
    w = windows or windows_for(ref_date)
    if families is not None:
        lines = lines.join(families.select("family_id").distinct(), "family_id", "left_semi")
    return derive_pair_table(pair_aggregates(lines, w, data_cutoff), w, keep_inactive)


def derive_pair_table(df: DataFrame, w: Windows, keep_inactive: bool = False, by=()) -> DataFrame:
    """Feature columns from the pair aggregates (any producer with the
    ``pair_aggregates`` columns, e.g. the item-level roll-up in ``items``)."""
    per_pair = merge_stages(
        [{"sow_weighted_lines": weighted_lines(), "days_since_last": days_since_last(w)}],
        cycle_stages(w),
        series_stages(w),
    )
    df = apply_stages(df, per_pair)
    fam = Window.partitionBy(*by, "family_id")
    df = df.withColumns({
        "_fam_any_freq": F.max("any_freq").over(fam),
        "_fam_active": F.max("any_active").over(fam),
        "_fam_w_total": F.sum("sow_weighted_lines").over(fam).cast("double"),
        "_fam_w_max": F.max("sow_weighted_lines").over(fam).cast("double"),
    })
    if not keep_inactive:
        df = df.filter(F.col("_fam_active") == 1)
    tail = merge_stages(
        [recency_stage(w)],
        frequency_stages(w, F.col("_fam_any_freq")),
        [{"sow": sow_expr(F.col("_fam_w_total"), F.col("_fam_w_max")), "net_sales": F.col("total_net"),
          **season_exprs()}],
    )
    df = apply_stages(df, tail)
    return df.withColumn("score", S.linear_score(F.col("recency"), F.col("frequency"),
                                                 F.col("sow"), F.col("season")))


def pair_features(lines: DataFrame, ref_date, data_cutoff=None, families: DataFrame | None = None,
                  keep_inactive: bool = False, windows: Windows | None = None) -> DataFrame:
    """The feature table, one row per (family, subcat) ever bought
    before ``ref_date`` in a family active in the cycle window."""
    return pair_table(lines, ref_date, data_cutoff, families, keep_inactive, windows).select(*FEATURE_COLUMNS)


def pair_features_asof(lines: DataFrame, ref_date, cutoffs, keep_inactive: bool = False) -> DataFrame:
    """The feature table as of each of several data cutoffs (column ``cutoff``), all seen from ``ref_date``.

    One pass over the lines: a line counts for every cutoff on or after its day.  The copies are made
    on the lines' invoice partitioning, right before level 1 folds them, so they cost no shuffle.
    """
    w = windows_for(ref_date)
    dates = F.array(*[F.lit(as_date(c)) for c in cutoffs])
    each = restrict(lines, w).withColumn("cutoff", F.explode(F.filter(dates, lambda c: F.col("day") <= c)))
    table = derive_pair_table(pair_aggregates(each, w, by=("cutoff",)), w, keep_inactive, by=("cutoff",))
    return table.select("cutoff", *FEATURE_COLUMNS)


# --- standalone operators (projections of the same plan; Catalyst prunes the
# aggregates and window columns a projection does not use) -------------------

def purchase_summary(lines: DataFrame, ref_date, data_cutoff=None) -> DataFrame:
    """Per-pair money and count summary of the rows before ref_date."""
    w = windows_for(ref_date)
    df = pair_aggregates(lines, w, data_cutoff)
    return df.select(
        *KEYS, "total_qty", "total_net", "total_discount", "total_list_price",
        (F.col("total_list_price") / F.col("n_rows")).alias("mean_list_price"),
        "n_invoices", "n_lines", "first_day", "last_day",
    )


def purchase_cycles(lines: DataFrame, ref_date, data_cutoff=None, months: int = 12, block_days: int = 7,
                    min_blocks: int = MIN_BLOCKS, max_blocks: int = MAX_BLOCKS,
                    std_threshold: float = STD_THRESHOLD) -> DataFrame:
    """D3: pairs with a line in the cycle window, with cycle and gap detail."""
    w = windows_for(ref_date, cycle_months=months, block_days=block_days)
    df = pair_aggregates(lines, w, data_cutoff).filter(F.col("any_active") == 1)
    df = apply_stages(df, cycle_stages(w, min_blocks, max_blocks, std_threshold))
    return df.select(*KEYS, "cycle_days", "cycle_days_raw", "penalty_strength", "penalty_mean",
                     "penalty_std", "gaps_days", "gaps_clipped_days")


def recency_scores(lines: DataFrame, ref_date, data_cutoff=None) -> DataFrame:
    return pair_table(lines, ref_date, data_cutoff).select(
        *KEYS, "recency", "recency_base", "recency_penalty", "last_over_cycle", "days_since_last", "cycle_days")


def frequency_scores(lines: DataFrame, ref_date, data_cutoff=None, days: int = 180) -> DataFrame:
    w = windows_for(ref_date, freq_days=days)
    return pair_table(lines, ref_date, data_cutoff, windows=w).select(
        *KEYS, "frequency", "freq_expected", "freq_lines", "freq_ratio", "cycle_days")


def share_of_wallet(lines: DataFrame, ref_date, data_cutoff=None) -> DataFrame:
    return pair_table(lines, ref_date, data_cutoff).select(*KEYS, "sow", "sow_weighted_lines")


def month_series(lines: DataFrame, ref_date, data_cutoff=None, months: int = 12) -> DataFrame:
    """D7-D11 for the pairs with a line in the series window."""
    w = windows_for(ref_date, series_months=months)
    df = pair_aggregates(lines, w, data_cutoff).filter(F.col("any_series") == 1)
    df = apply_stages(df, series_stages(w))
    return df.select(*KEYS, "season_series", "season_threshold", "season_bits", "season_thinned",
                     "season_peak_gaps")


def seasonal_regularity(lines: DataFrame, ref_date, data_cutoff=None) -> DataFrame:
    """D12 for the pairs with a line in the series window."""
    w = windows_for(ref_date)
    df = pair_aggregates(lines, w, data_cutoff).filter(F.col("any_series") == 1)
    df = apply_stages(df, series_stages(w))
    return df.select(*KEYS, "season_cv", "season_gap_mean", "season_gap_std", "season_regularity")


def season_need(lines: DataFrame, ref_date, data_cutoff=None, months: int = 3) -> DataFrame:
    w = windows_for(ref_date, season_months=months)
    return pair_table(lines, ref_date, data_cutoff, windows=w).select(
        *KEYS, "season_recent_invoices", "season_prior_invoices", "season_need", "season_regularity", "season")
