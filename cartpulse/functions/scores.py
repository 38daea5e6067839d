"""Scalar scoring curves as Column expressions (all JVM-side, codegen'd).

Fixed values that must equal the reference's for identical results:
  recency: rec = min(1, 2 * (1 - 2 ** (-d / c))), penalty exp(-0.1 * (max(1, d/c) - 1) ** 2.5)
  frequency: expected = round_half_even(window_days / c * 1.2); ratio = lines / expected,
             10 when expected = 0; curve 0.4 + 0.6 * (1 - r) ** 0.25 for r <= 1,
             0.4 * max(0, 1 - (min(r, 1.6) - 1) / 0.6) above; 0.1 for a family with
             no purchase at all in the window
  share of wallet weights: 7 (last 12 months), 3 (12 to 24 months back)
  seasonal regularity: exp(-1.85 * CV ** 2.5), CV = 0.85 with fewer than two gaps
  season factor: 0.5 + 0.5 * regularity
  linear score weights: recency 0.4, frequency 0.3, share of wallet 0.1, season 0.2
  repurchase: due = 0.1 + 0.9 / (1 + exp(-(t - 30) / 5)); floors 0.5 / 0.6 / 0.4 for the
              30 / 60 / 90 day buckets; long-window factor 1 if more than 2 buys else 0.2
  popularity: (item + 1) / (subcat + items), x0.5 when the item holds all subcat invoices,
              x0.5 when fewer than 2 buys in the last 365 days
  item blend: 0.7 subcat probability + 0.15 repurchase + 0.15 popularity (min-max scaled)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINEAR_WEIGHTS = {"recency": 0.4, "frequency": 0.3, "sow": 0.1, "season": 0.2}
SOW_RECENT_WEIGHT = 7
SOW_OLD_WEIGHT = 3
FREQ_SLACK = 1.2
FREQ_EMPTY_FAMILY = 0.1
FREQ_NO_EXPECTATION_RATIO = 10.0
SEASON_CV_SENTINEL = 0.85
ITEM_BLEND = (0.7, 0.15, 0.15)


def recency_base(days: Column, cycle: Column) -> Column:
    return F.least(F.lit(1.0), 2.0 * (1.0 - F.pow(F.lit(2.0), -days / cycle)))


def recency_penalty(days: Column, cycle: Column) -> Column:
    r = F.greatest(F.lit(1.0), days / cycle)
    return F.exp(-0.1 * F.pow(r - 1.0, F.lit(2.5)))


def expected_purchases(cycle: Column, window_days: int) -> Column:
    return F.when(cycle > 0, F.rint(F.lit(float(window_days)) / cycle * FREQ_SLACK)).otherwise(0.0)


def frequency_curve(ratio: Column) -> Column:
    low = 0.4 + 0.6 * F.pow(1.0 - ratio, F.lit(0.25))
    high = 0.4 * F.greatest(F.lit(0.0), 1.0 - (F.least(ratio, F.lit(1.6)) - 1.0) / 0.6)
    return F.when(ratio <= 1, low).otherwise(high)


def regularity(cv: Column) -> Column:
    return F.exp(-1.85 * F.pow(cv, F.lit(2.5)))


def season_need(prior: Column, recent: Column) -> Column:
    raw = (prior - recent) / prior
    return F.when(prior > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).otherwise(0.0)


def linear_score(recency: Column, frequency: Column, sow: Column, season: Column) -> Column:
    w = LINEAR_WEIGHTS
    return (
        w["recency"] * F.coalesce(recency, F.lit(0.0))
        + w["frequency"] * F.coalesce(frequency, F.lit(0.0))
        + w["sow"] * F.coalesce(sow, F.lit(0.0))
        + w["season"] * F.coalesce(season, F.lit(0.0))
    )


def due_curve(days: Column, mu: float = 30.0, s: float = 5.0, base: float = 0.1) -> Column:
    return base + (1.0 - base) / (1.0 + F.exp(-(days - mu) / s))


def repurchase_penalty(n30: Column, n60: Column, n90: Column, p_long: Column) -> Column:
    c30 = F.greatest(n30.cast("double"), F.lit(0.5))
    c60 = F.greatest(n60.cast("double"), F.lit(0.6))
    c90 = F.greatest(n90.cast("double"), F.lit(0.4))
    c_long = F.when(p_long > 2, 1.0).otherwise(0.2)
    return F.least(F.lit(1.0), c30 * c60 * c90 * c_long)


def popularity(item_inv: Column, subcat_inv: Column, n_items: Column, last_year: Column) -> Column:
    base = (item_inv + 1.0) / (subcat_inv + n_items)
    only = F.when(item_inv == subcat_inv, 0.5).otherwise(1.0)
    rare = F.when(last_year < 2, 0.5).otherwise(1.0)
    return base * only * rare


# --- formatting (F17, F18) ----------------------------------------------------

def fixed10(x: Column) -> Column:
    """Fixed 10-decimal text, null kept (no thousands separators)."""
    return F.when(x.isNotNull(), F.format_string("%.10f", x))


def zfill10(s: Column) -> Column:
    """Left zero pad to 10 characters without truncating longer ids."""
    return F.when(F.length(s) < 10, F.lpad(s, 10, "0")).otherwise(s)

