"""Top-k recommendation quality against later purchases.

All metrics are computed per family with joins and group-bys, then averaged
with one global aggregate; no family loop, nothing collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartpulse.functions.periods import as_date
from cartpulse.operators.rank import rank_within, top_k

FAMILY = "family_id"


def truth_pairs(lines: DataFrame, start, end, level: str = "subcat_id") -> DataFrame:
    """Distinct (family, level) bought in [start, end] (holdout / label window)."""
    day = F.col("day")
    return (
        lines.filter((day >= F.lit(as_date(start))) & (day <= F.lit(as_date(end))))
        .select(FAMILY, level).distinct()
    )


def materialised(truth: DataFrame) -> DataFrame:
    """The truth pairs written once to the shared folder: the metrics read them two or three times
    (hits, bought per family, number of families), the lines behind them once."""
    return truth.checkpoint(eager=True)


def family_hits(recs: DataFrame, truth: DataFrame, level: str, by: Sequence[str] = ()) -> DataFrame:
    """Per (family, *by) with recommendations: has_pred = 1 and the number of recommended ``level`` values bought."""
    bought = truth.select(FAMILY, level).withColumn("_bought", F.lit(1))
    return (
        recs.join(bought, [FAMILY, level], "left").groupBy(FAMILY, *by)
        .agg(F.count("_bought").cast("bigint").alias("hits"), F.lit(1).alias("has_pred"))
    )


def _metrics(fam: DataFrame, k: int, group: Sequence[str] = ()) -> DataFrame:
    hits = F.coalesce(F.col("hits"), F.lit(0)).cast("double")
    return (
        fam.withColumn("precision", hits / k)
        .withColumn("recall", F.when(F.col("n_truth") > 0, hits / F.col("n_truth")).otherwise(0.0))
        .withColumn("hit", F.when(hits > 0, 1.0).otherwise(0.0))
    )


def family_metrics(preds: DataFrame, truth: DataFrame, k: int = 3, score: str = "score",
                   ties: Sequence[str] = ("-net_sales", "subcat_id"), level: str = "subcat_id",
                   by: Sequence[str] = ()) -> DataFrame:
    """One row per holdout family (x ``by`` values present in its predictions):
    hits, n_truth, has_pred, precision, recall, hit."""
    recs = top_k(preds, [FAMILY, *by], score, k, ties).select(FAMILY, *by, level)
    n_truth = truth.groupBy(FAMILY).agg(F.count(F.lit(1)).alias("n_truth"))
    # with k >= 1 the families with predictions are those with recommendations
    fam = n_truth.join(family_hits(recs, truth, level, by), FAMILY, "left")
    fam = fam.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("has_pred", "hits")})
    return _metrics(fam, k)


def holdout_evaluation(preds: DataFrame, truth: DataFrame, k: int = 3, score: str = "score",
                       ties: Sequence[str] = ("-net_sales", "subcat_id"), level: str = "subcat_id",
                       missing: str = "skip") -> DataFrame:
    """E2 (missing='skip': families without predictions are skipped and
    counted) / E4 (missing='zero': they count with metric 0)."""
    fam = family_metrics(preds, truth, k, score, ties, level)
    evaluated = F.col("has_pred") == 1 if missing == "skip" else F.lit(True)
    return fam.agg(
        F.lit(k).cast("bigint").alias("k"),
        F.avg(F.when(evaluated, F.col("precision"))).alias("precision"),
        F.avg(F.when(evaluated, F.col("recall"))).alias("recall"),
        F.avg(F.when(evaluated, F.col("hit"))).alias("hit_rate"),
        F.count(F.when(evaluated, F.lit(1))).cast("bigint").alias("n_families"),
        F.count(F.when(F.col("has_pred") == 0, F.lit(1))).cast("bigint").alias("n_skipped"),
    )


def cross_eval_precision(preds: DataFrame, truth: DataFrame, k: int = 3, score: str = "score",
                         ties: Sequence[str] = ("-net_sales", "subcat_id"),
                         by: Sequence[str] = ()) -> DataFrame:
    """Mean precision@k over holdout families that have predictions;
    ``by`` evaluates several scored sets at once (e.g. model, cutoff)."""
    recs = top_k(preds, [FAMILY, *by], score, k, ties).select(FAMILY, *by, "subcat_id")
    fam = family_hits(recs, truth, "subcat_id", by).join(truth.select(FAMILY).distinct(), FAMILY)
    return fam.groupBy(*by).agg(F.avg(F.col("hits") / k).alias("precision"),
                                F.count(F.lit(1)).cast("bigint").alias("n_families"))


def division_metrics(preds: DataFrame, truth: DataFrame, k: int = 3, score: str = "score",
                     ties: Sequence[str] = ("-net_sales", "subcat_id"), level: str = "subcat_id",
                     division: str = "division") -> DataFrame:
    """E5: top-k per (family, division); truth is not restricted to the
    division; one metric row per division, over all holdout families
    (a family with no prediction in the division counts 0)."""
    p = preds.filter(F.col(division).isNotNull())
    recs = top_k(p, [FAMILY, division], score, k, ties).select(FAMILY, division, level)
    n_truth = truth.groupBy(FAMILY).agg(F.count(F.lit(1)).alias("n_truth"))
    # families without recommendations in a division add 0 to its sums, so
    # dividing by the number of holdout families needs no family x division grid
    fam = family_hits(recs, truth, level, [division]).join(n_truth, FAMILY, "left")
    fam = _metrics(fam.withColumn("hits", F.when(F.col("n_truth").isNotNull(), F.col("hits"))), k)
    sums = fam.groupBy(division).agg(*[F.sum(c).alias(c) for c in ("precision", "recall", "hit")])
    total = n_truth.agg(F.count(F.lit(1)).cast("bigint").alias("n_families")).filter("n_families > 0")
    n = F.col("n_families")
    return sums.crossJoin(F.broadcast(total)).select(  # one row
        division, F.lit(k).cast("bigint").alias("k"), (F.col("precision") / n).alias("precision"),
        (F.col("recall") / n).alias("recall"), (F.col("hit") / n).alias("hit_rate"), "n_families")


def split_evaluation(scored: DataFrame, k: int = 3, score: str = "prob", label: str = "label",
                     ties: Sequence[str] = ("-net_sales", "subcat_id")) -> DataFrame:
    """Candidates and truth are the same (test) rows; families with fewer
    than k rows or no positive row are skipped."""
    ranked = rank_within(scored, [FAMILY], score, ties, "_r")
    fam = ranked.groupBy(FAMILY).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(label).alias("pos"),
        F.sum(F.when(F.col("_r") <= k, F.col(label)).otherwise(0)).alias("hits"),
    ).filter((F.col("n") >= k) & (F.col("pos") > 0))
    hits = F.col("hits").cast("double")
    return fam.agg(
        F.lit(k).cast("bigint").alias("k"),
        F.avg(hits / k).alias("precision"),
        F.avg(hits / F.col("pos")).alias("recall"),
        F.avg(F.when(hits > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
        F.count(F.lit(1)).cast("bigint").alias("n_families"),
    )


def hit_buckets(preds: DataFrame, truth: DataFrame, k: int = 3, score: str = "score",
                ties: Sequence[str] = ("-net_sales", "subcat_id"), level: str = "subcat_id") -> DataFrame:
    """Holdout families by number of hits (0..k) and the mean number of
    distinct ``level`` values they bought."""
    fam = family_metrics(preds, truth, k, score, ties, level)
    return fam.groupBy("hits").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_families"),
        F.avg(F.col("n_truth").cast("double")).alias("mean_bought"),
    )


def compare_models(a: DataFrame, b: DataFrame, name_a: str = "a", name_b: str = "b",
                   tie_tol: float = 1e-9) -> DataFrame:
    """Absolute and relative difference of b over a per metric and a
    verdict on precision.  Inputs are one-row metric tables."""
    ra = a.select([F.col(c).alias(f"{c}_{name_a}") for c in ("precision", "recall", "hit_rate")])
    rb = b.select([F.col(c).alias(f"{c}_{name_b}") for c in ("precision", "recall", "hit_rate")])
    out = ra.crossJoin(rb)  # one row each
    for m in ("precision", "recall", "hit_rate"):
        x, y = F.col(f"{m}_{name_a}"), F.col(f"{m}_{name_b}")
        out = out.withColumn(f"{m}_diff", y - x).withColumn(
            f"{m}_rel_pct", F.when(x != 0, (y - x) / x * 100.0))
    d = F.col("precision_diff")
    return out.withColumn(
        "verdict", F.when(d > tie_tol, F.lit(f"{name_b} better"))
        .when(d < -tie_tol, F.lit(f"{name_a} better")).otherwise(F.lit("tie")))


def cutoff_matrix(cells: DataFrame, truth: DataFrame, k: int = 3, score: str = "score",
                  same: float = 0.02, large: float = 0.05) -> DataFrame:
    """precision@k for every (model, cutoff) cell of a union of scored
    sets, and for each cell its difference to the first cell of the same
    model (by cutoff) with the closeness flags of the reference."""
    prec = cross_eval_precision(cells, truth, k, score, by=["model", "cutoff"])
    w = Window.partitionBy("model").orderBy("cutoff")
    first = F.first("precision").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (
        prec.withColumn("diff_vs_first", F.col("precision") - first)
        .withColumn("similar", (F.abs(F.col("diff_vs_first")) < same).cast("int"))
        .withColumn("large_gap", (F.abs(F.col("diff_vs_first")) > large).cast("int"))
    )
