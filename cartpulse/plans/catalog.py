"""Registered queries: name -> (spark, sf_dir) -> DataFrame, with oracle SQL.

Dates for the driver's TPC-H style tables (orders run 1995-01-01 ..
2001-08-01): features seen from 2001-06-30, label window 2001-07-01 ..
2001-07-21, holdout 2001-07-22 .. 2001-08-01, an early data cutoff of
2001-06-09 (three weeks before the reference date, as in the reference's
two-cutoff experiments).  Families are households (o_custkey mod 100; a
grouping key, every line is kept) unless the name says ``by_customer``.
Every query reads the whole tables.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartpulse.functions.periods import Windows, shift_days, sql_date as d
from cartpulse.operators import diagnostics as DG
from cartpulse.operators import evaluate as EV
from cartpulse.operators import features as FE
from cartpulse.operators import items as IT
from cartpulse.operators import model as MD
from cartpulse.operators import rank as RK
from cartpulse.operators import training as TR
from cartpulse.plans import oracle as O
from cartpulse.plans.present import present, r
from cartpulse.session import ADVISORY, scratch_path, settings, stored
from cartpulse.sources import files as FI
from cartpulse.sources.tables import event_lines, item_dimension, purchase_lines, subcat_names

REF = dt.date(2001, 6, 30)
EARLY_CUTOFF = dt.date(2001, 6, 9)
LABEL_START = dt.date(2001, 7, 1)
LABEL_END = dt.date(2001, 7, 21)
HOLDOUT_START = dt.date(2001, 7, 22)
HOLDOUT_END = dt.date(2001, 8, 1)
EVENTS_REF = dt.date(2024, 1, 31)
HOUSEHOLDS = 100
K = 3
LOOKUP_FAMILY = 7
W = Windows(REF)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, Callable[[], str]] = {}


def register(name: str, oracle: Callable[[], str] | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# --- shared Spark inputs ---------------------------------------------------------

def _hist(spark, sf_dir, households=HOUSEHOLDS):
    """Lines up to the reference date (the bound is pushed into the scan; the
    feature plan itself keeps day < ref).  Item queries use the same lines, so
    their feature and item branches share one scan and shuffle."""
    return purchase_lines(spark, sf_dir, households=households, until=shift_days(REF, 1))


def _upto_ref(spark, sf_dir):
    return _hist(spark, sf_dir)


def _holdout(spark, sf_dir, level="subcat_id", households=HOUSEHOLDS):
    lines = purchase_lines(spark, sf_dir, households=households, since=HOLDOUT_START,
                           until=shift_days(HOLDOUT_END, 1))
    return EV.materialised(EV.truth_pairs(lines, HOLDOUT_START, HOLDOUT_END, level))


def _features(spark, sf_dir, data_cutoff=None):
    return FE.pair_features(_hist(spark, sf_dir), REF, data_cutoff=data_cutoff)


def _labelled(spark, sf_dir, households=HOUSEHOLDS):
    labels = purchase_lines(spark, sf_dir, households=households, since=LABEL_START,
                            until=shift_days(LABEL_END, 1))
    feats = FE.pair_features(_hist(spark, sf_dir, households), REF)
    return MD.label_pairs(feats, labels, LABEL_START, LABEL_END, data_cutoff=REF)


def _subcat_division(spark, sf_dir):
    """Division of a subcategory: the most common division among its items
    (ties: the smaller label); items without a division do not vote."""
    votes = (item_dimension(spark, sf_dir).filter(F.col("division").isNotNull())
             .groupBy("subcat_id", "division").agg(F.count(F.lit(1)).alias("n")))
    top = RK.top_k(votes, ["subcat_id"], "n", 1, ["division"])
    return top.select("subcat_id", "division")


def _with_division(spark, sf_dir, feats):
    return feats.join(_subcat_division(spark, sf_dir), "subcat_id", "left")


def _ranked_by_fixed(spark, sf_dir):
    return MD.score_ranker(_features(spark, sf_dir), MD.fixed_ranker(), out="prob")


def _item_scores(spark, sf_dir, ranks=True, households=HOUSEHOLDS):
    """Linear-score items; features and item aggregates share the line scan and its joins."""
    lines = _hist(spark, sf_dir, households)
    return IT.item_scores(FE.pair_features(lines, REF), lines, REF, ranks=ranks)


def _stored_features(spark, sf_dir, data_cutoff=None):
    """The feature table of one (data cutoff, reference date), written once and read by every consumer."""
    path = scratch_path(spark, f"pairs_{uuid.uuid4().hex}")
    FI.write_table(_features(spark, sf_dir, data_cutoff).select("family_id", "subcat_id", *MD.FEATURES, "score", "net_sales"), path)
    return FI.read_table(spark, path, fmt="parquet")


# --- shared SQL pieces -------------------------------------------------------------

L = O.lines_sql(HOUSEHOLDS)


def _ctes(data_cutoff=None, lines=L, w=W):
    return O.pair_features_ctes(w, lines, data_cutoff)


def _truth_sql(level="subcat_id"):
    return (f"truth AS (SELECT DISTINCT family_id, {level} FROM lines "
            f"WHERE day >= {d(HOLDOUT_START)} AND day <= {d(HOLDOUT_END)})")


def _labels_sql():
    return f"""
    tgt AS (SELECT DISTINCT family_id, subcat_id FROM lines WHERE day >= {d(LABEL_START)} AND day <= {d(LABEL_END)}),
    labelled AS (
      SELECT s.*, CASE WHEN t.family_id IS NULL THEN 0 ELSE 1 END AS label
      FROM scored s LEFT JOIN tgt t USING (family_id, subcat_id)),
    splitted AS (
      SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', family_id, subcat_id)), family_id, subcat_id)
                          <= floor(count(*) OVER (PARTITION BY label) * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split
      FROM labelled)"""


def _items_sql():
    return f"""
    ihist AS (SELECT * FROM lines WHERE day <= {d(REF)}),
    rep AS (
      SELECT family_id, item_id, max(day) AS last_day, count(day) AS n_buys,
             count(*) FILTER (WHERE day >= {d(shift_days(REF, -30))}) AS p30,
             count(*) FILTER (WHERE day >= {d(shift_days(REF, -60))}) AS p60,
             count(*) FILTER (WHERE day >= {d(shift_days(REF, -90))}) AS p90,
             count(*) FILTER (WHERE day >= {d(shift_days(REF, -180))}) AS p_long
      FROM ihist GROUP BY family_id, item_id),
    rep2 AS (
      SELECT *, p30 AS n30, p60 - p30 AS n60, p90 - p60 AS n90,
             date_diff('day', last_day, {d(REF)}) AS days_since_last FROM rep),
    rep3 AS (
      SELECT *, 0.1 + 0.9 / (1.0 + exp(-(days_since_last - 30.0) / 5.0)) AS due,
             least(1.0, greatest(n30, 0.5) * greatest(n60, 0.6) * greatest(n90, 0.4)
                        * CASE WHEN p_long > 2 THEN 1.0 ELSE 0.2 END) AS penalty
      FROM rep2),
    rep4 AS (SELECT *, least(1.0, due * penalty) AS repurchase FROM rep3),
    pop_i AS (
      SELECT family_id, subcat_id, item_id, max(division) AS division, count(DISTINCT invoice_id) AS item_invoices,
             count(invoice_id) FILTER (WHERE day >= {d(shift_days(REF, -365))}) AS last_year_lines
      FROM ihist WHERE item_id IS NOT NULL GROUP BY family_id, subcat_id, item_id),
    pop_s AS (
      SELECT family_id, subcat_id, count(DISTINCT invoice_id) AS subcat_invoices,
             count(DISTINCT item_id) AS subcat_items
      FROM ihist GROUP BY family_id, subcat_id),
    pop AS (
      SELECT i.*, s.subcat_invoices, s.subcat_items,
             (i.item_invoices + 1.0) / (s.subcat_invoices + s.subcat_items)
               * CASE WHEN i.item_invoices = s.subcat_invoices THEN 0.5 ELSE 1.0 END
               * CASE WHEN i.last_year_lines < 2 THEN 0.5 ELSE 1.0 END AS popularity
      FROM pop_i i JOIN pop_s s USING (family_id, subcat_id)),
    its AS (
      SELECT s.family_id, s.subcat_id, s.score AS prob, p.item_id, p.popularity, r.repurchase, p.division
      FROM scored s JOIN pop p USING (family_id, subcat_id)
      LEFT JOIN rep4 r USING (family_id, item_id)),
    mm AS (SELECT min(repurchase) AS rmin, max(repurchase) AS rmax, min(popularity) AS pmin,
                  max(popularity) AS pmax FROM its),
    its2 AS (
      SELECT its.*,
             CASE WHEN rmax > rmin THEN (repurchase - rmin) / (rmax - rmin) ELSE 0.0 END AS repurchase_scaled,
             CASE WHEN pmax > pmin THEN (popularity - pmin) / (pmax - pmin) ELSE 0.0 END AS popularity_scaled
      FROM its CROSS JOIN mm),
    its3 AS (SELECT *, 0.7 * prob + 0.15 * repurchase_scaled + 0.15 * popularity_scaled AS item_score FROM its2),
    subr AS (
      SELECT family_id, subcat_id,
             row_number() OVER (PARTITION BY family_id ORDER BY round(max(prob), 12) DESC, subcat_id) AS subcat_rank
      FROM its3 GROUP BY family_id, subcat_id),
    items AS (
      SELECT i.*, s.subcat_rank,
             row_number() OVER (PARTITION BY i.family_id ORDER BY round(i.item_score, 12) DESC, i.item_id, i.subcat_id) AS item_rank,
             CASE WHEN i.division IS NOT NULL THEN row_number() OVER (
                  PARTITION BY i.family_id, i.division ORDER BY round(i.item_score, 12) DESC, i.item_id, i.subcat_id) END AS division_rank
      FROM its3 i JOIN subr s USING (family_id, subcat_id))"""


def _eval_sql(preds: str, score: str, ties: str, level: str = "subcat_id", missing: str = "skip") -> str:
    """SELECT body for E2/E4 over CTE ``preds`` and ``truth``."""
    flt = "FILTER (WHERE has_pred)" if missing == "skip" else ""
    return f"""
    recs AS (SELECT * FROM {preds} QUALIFY row_number() OVER (
               PARTITION BY family_id ORDER BY round({score}, 12) DESC, {ties}) <= {K}),
    nt AS (SELECT family_id, count(*) AS n_truth FROM truth GROUP BY family_id),
    hp AS (SELECT DISTINCT family_id FROM {preds}),
    hits AS (SELECT family_id, count(*) AS hits FROM recs JOIN truth USING (family_id, {level}) GROUP BY family_id),
    fm AS (
      SELECT nt.family_id, nt.n_truth, hp.family_id IS NOT NULL AS has_pred, coalesce(hits.hits, 0) AS hits
      FROM nt LEFT JOIN hp USING (family_id) LEFT JOIN hits USING (family_id))
    SELECT CAST({K} AS BIGINT) AS k,
           {r(f'avg(hits / {K}.0) {flt}')} AS precision,
           {r(f'avg(CASE WHEN n_truth > 0 THEN hits / n_truth ELSE 0.0 END) {flt}')} AS recall,
           {r(f'avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END) {flt}')} AS hit_rate,
           CAST(count(*) {flt} AS BIGINT) AS n_families,
           CAST(count(*) FILTER (WHERE NOT has_pred) AS BIGINT) AS n_skipped
    FROM fm"""


SUBCAT_TIES_SQL = "net_sales DESC, subcat_id"


# === D14-D16 flagship ==============================================================

def _pf_sql(households=HOUSEHOLDS, data_cutoff=None):
    return O.pair_features_sql(W, O.lines_sql(households), data_cutoff)


@register("pair_features", lambda: _pf_sql())
def q_pair_features(spark, sf_dir):
    """The feature table with the linear score (households)."""
    return present(_features(spark, sf_dir))


@register("pair_features_by_customer", lambda: _pf_sql(None))
def q_pair_features_by_customer(spark, sf_dir):
    """D14-D16 with one family per customer (sparse: inactive families and
    the 0.1 frequency branch are common)."""
    return present(FE.pair_features(_hist(spark, sf_dir, None), REF))


@register("pair_features_early_cutoff", lambda: _pf_sql(data_cutoff=EARLY_CUTOFF))
def q_pair_features_early_cutoff(spark, sf_dir):
    """Rows up to an earlier data cutoff, measured from the reference date."""
    return present(_features(spark, sf_dir, data_cutoff=EARLY_CUTOFF))


@register("event_features", lambda: O.pair_features_sql(Windows(EVENTS_REF), O.events_sql()))
def q_event_features(spark, sf_dir):
    """D14-D16 on the event log: user = family, event type = subcategory."""
    lines = event_lines(spark, sf_dir, until=EVENTS_REF)
    return present(FE.pair_features(lines, EVENTS_REF))


# === D1-D13 standalone operators =====================================================

@register("purchase_summary", lambda: f"""WITH {_ctes()}
    SELECT family_id, subcat_id, {r('total_qty')} AS total_qty, {r('total_net')} AS total_net,
           {r('total_discount')} AS total_discount, {r('total_list_price')} AS total_list_price,
           {r('mean_list_price')} AS mean_list_price, CAST(n_invoices AS BIGINT) AS n_invoices,
           CAST(n_lines AS BIGINT) AS n_lines, strftime(first_day, '%Y-%m-%d') AS first_day,
           strftime(last_day, '%Y-%m-%d') AS last_day
    FROM summ""")
def q_purchase_summary(spark, sf_dir):
    """Money and count summary per pair."""
    return present(FE.purchase_summary(_hist(spark, sf_dir), REF))


@register("purchase_cycles", lambda: f"""WITH {_ctes()}
    SELECT family_id, subcat_id, {r('cycle')} AS cycle_days,
           {r('CASE WHEN nb >= 3 THEN list_avg(g) ELSE 0.0 END')} AS cycle_days_raw,
           {r('strength')} AS penalty_strength, {r('pmean')} AS penalty_mean, {r('pstd')} AS penalty_std,
           {O.join_longs_sql('g')} AS gaps_days, {O.join_doubles_sql('gc')} AS gaps_clipped_days
    FROM cyc2""")
def q_purchase_cycles(spark, sf_dir):
    """D3 + D2: purchase cycle from the latest weekly blocks."""
    return present(FE.purchase_cycles(_hist(spark, sf_dir), REF))


def _feature_select(cols: list[str]) -> Callable[[], str]:
    def make():
        sel = []
        for c in cols:
            if c in ("family_id", "subcat_id"):
                sel.append(c)
            elif c in ("days_since_last", "freq_lines", "sow_weighted_lines", "season_recent_invoices",
                       "season_prior_invoices"):
                sel.append(f"CAST({c} AS BIGINT) AS {c}")
            else:
                sel.append(f"{r(c)} AS {c}")
        return f"WITH {_ctes()}\n    SELECT {', '.join(sel)} FROM scored"
    return make


@register("recency_scores", _feature_select(
    ["family_id", "subcat_id", "recency", "recency_base", "recency_penalty", "last_over_cycle",
     "days_since_last", "cycle_days"]))
def q_recency_scores(spark, sf_dir):
    """D4."""
    return present(FE.recency_scores(_hist(spark, sf_dir), REF))


@register("frequency_scores", _feature_select(
    ["family_id", "subcat_id", "frequency", "freq_expected", "freq_lines", "freq_ratio", "cycle_days"]))
def q_frequency_scores(spark, sf_dir):
    """D5."""
    return present(FE.frequency_scores(_hist(spark, sf_dir), REF))


@register("share_of_wallet", _feature_select(["family_id", "subcat_id", "sow", "sow_weighted_lines"]))
def q_share_of_wallet(spark, sf_dir):
    """D6."""
    return present(FE.share_of_wallet(_hist(spark, sf_dir), REF))


@register("season_need", _feature_select(
    ["family_id", "subcat_id", "season_recent_invoices", "season_prior_invoices", "season_need",
     "season_regularity", "season"]))
def q_season_need(spark, sf_dir):
    """D13."""
    return present(FE.season_need(_hist(spark, sf_dir), REF))


@register("month_series", lambda: f"""WITH {_ctes()}
    SELECT family_id, subcat_id, {O.join_longs_sql('series')} AS season_series,
           CAST(thr AS BIGINT) AS season_threshold, bits AS season_bits, thinned AS season_thinned,
           {O.join_longs_sql('pg')} AS season_peak_gaps
    FROM ser6""")
def q_month_series(spark, sf_dir):
    """Densified 13-month series, threshold, bits, thinning, gaps."""
    return present(FE.month_series(_hist(spark, sf_dir), REF))


@register("seasonal_regularity", lambda: f"""WITH {_ctes()}
    SELECT family_id, subcat_id, {r('cv')} AS season_cv, {r('pmean_s')} AS season_gap_mean,
           {r('pstd_s')} AS season_gap_std, {r('reg')} AS season_regularity
    FROM ser6""")
def q_seasonal_regularity(spark, sf_dir):
    """D12."""
    return present(FE.seasonal_regularity(_hist(spark, sf_dir), REF))


# === D17, M1-M3, M6 ===================================================================

@register("label_pairs", lambda: f"""WITH {_ctes()}, {_labels_sql()}
    SELECT family_id, subcat_id, {r('score')} AS score, CAST(label AS BIGINT) AS label FROM labelled""")
def q_label_pairs(spark, sf_dir):
    """Features with the label 'bought in the label window'."""
    return present(_labelled(spark, sf_dir).select("family_id", "subcat_id", "score", "label"))


@register("class_balance", lambda: f"""WITH {_ctes()}, {_labels_sql()}
    SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(label) AS BIGINT) AS positives,
           {r('avg(label)')} AS positive_rate FROM labelled""")
def q_class_balance(spark, sf_dir):
    """A19."""
    return present(MD.class_balance(_labelled(spark, sf_dir)))


@register("stratified_split", lambda: f"""WITH {_ctes()}, {_labels_sql()}
    SELECT family_id, subcat_id, CAST(label AS BIGINT) AS label, split FROM splitted""")
def q_stratified_split(spark, sf_dir):
    """M1: in each class the first 20 % of the rows by hash are test rows."""
    return present(MD.stratified_split(_labelled(spark, sf_dir)).select("family_id", "subcat_id", "label", "split"))


def _std_sql():
    cols = MD.FEATURES
    stats = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END AS s_{c}"
                      for c in cols)
    z = ", ".join(f"{r(f'({c} - m_{c}) / s_{c}')} AS {c}_z" for c in cols)
    return f"""WITH {_ctes()}, {_labels_sql()},
    st AS (SELECT {stats} FROM splitted WHERE split = 'train')
    SELECT family_id, subcat_id, split, {z} FROM splitted CROSS JOIN st"""


@register("standardized_features", _std_sql)
def q_standardized_features(spark, sf_dir):
    """M2: z-scores with mean and population std fitted on the train split."""
    df = MD.stratified_split(_labelled(spark, sf_dir))
    stats = MD.fit_scaler(df.filter(F.col("split") == "train"))
    out = MD.apply_scaler(df, stats)
    return present(out.select("family_id", "subcat_id", "split", *[f"{c}_z" for c in MD.FEATURES]))


def _fixed_ranker_ctes():
    return O.ranker_ctes(MD.fixed_ranker(), "scored", MD.FEATURES, "prob")


@register("score_fixed_ranker", lambda: f"""WITH {_ctes()}, {_fixed_ranker_ctes()}
    SELECT family_id, subcat_id, {r('prob')} AS prob FROM rk_out""")
def q_score_fixed_ranker(spark, sf_dir):
    """M6: batch scoring with fixed weights (forward pass on Arrow batches)."""
    return present(_ranked_by_fixed(spark, sf_dir).select("family_id", "subcat_id", "prob"))


# === M4/M5/M7 (trained model: not SQL-expressible), M8, M9, W6-W9, S11 =============================

def _split(spark, sf_dir, households=HOUSEHOLDS, also=()):
    """The labelled split of the pairs' keys, features and the columns ``also``, stored once: training, scoring and evaluation read this copy.
    The lines carry half the bytes that they do for all columns, so half the size is merged into a task."""
    rows = _labelled(spark, sf_dir, households).select(*MD.KEYS, *MD.FEATURES, *also, "label")
    with settings(spark, **{ADVISORY: "8m"}):
        return MD.stratified_split(rows)


def _trained(spark, sf_dir, households=HOUSEHOLDS, also=()):
    """The split and the ranker trained on its train rows, its test rows steering the training."""
    df = _split(spark, sf_dir, households, also)
    return df, TR.train_ranker(df.filter("split = 'train'"), df.filter("split = 'test'"))


@register("train_ranker")
def q_train_ranker(spark, sf_dir):
    """M4/M5/M9: the network trained on the train split; its losses and rate by epoch, from the epoch log."""
    return TR.history_frame(spark, _trained(spark, sf_dir)[1])


@register("train_ranker_by_customer")
def q_train_ranker_by_customer(spark, sf_dir):
    """M4/M5/M9 with one family per customer."""
    return TR.history_frame(spark, _trained(spark, sf_dir, None)[1])


@register("ranker_split_evaluation")
def q_ranker_split_evaluation(spark, sf_dir):
    """M6 + E1: the test split scored by the trained ranker, top-3."""
    df, model = _trained(spark, sf_dir, also=["net_sales"])
    return present(EV.split_evaluation(MD.score_ranker(df.filter("split = 'test'"), model), K, score="prob"))


@register("train_ranker_full")
def q_train_ranker_full(spark, sf_dir):
    """M7: production fit on every labelled pair (no split); the history."""
    return TR.history_frame(spark, TR.train_ranker(_labelled(spark, sf_dir)))


@register("ranker_full_classes", lambda: f"""WITH {_ctes()}, {_labels_sql()}
    SELECT CAST(label AS BIGINT) AS label, CAST(count(*) AS BIGINT) AS n_pairs, CAST(1 AS BIGINT) AS on_its_side FROM labelled GROUP BY label""")
def q_ranker_full_classes(spark, sf_dir):
    """M7: pairs by label under the production fit, and whether their mean probability lies on their side of the mean over all."""
    df = _labelled(spark, sf_dir).checkpoint(eager=True)
    scored = MD.score_ranker(df, TR.train_ranker(df)).checkpoint(eager=True)
    whole = scored.agg(F.avg("prob").alias("mean"))  # one row
    sides = scored.groupBy("label").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("prob").alias("own")).crossJoin(F.broadcast(whole))
    right = F.when(F.col("label") == 1, F.col("own") > F.col("mean")).otherwise(F.col("own") < F.col("mean"))
    return present(sides.select(F.col("label").cast("bigint").alias("label"), "n_pairs", right.cast("bigint").alias("on_its_side")))


@register("stored_ranker_agreement", lambda: f"""WITH {_ctes()}, {_labels_sql()}
    SELECT split, CAST(label AS BIGINT) AS label, CAST(count(*) AS BIGINT) AS n_pairs, CAST(0 AS BIGINT) AS differ FROM splitted GROUP BY split, label""")
def q_stored_ranker_agreement(spark, sf_dir):
    """M8: the trained ranker saved under its cutoff, loaded and applied; pairs whose probability differs from that of the
    original, or from a forward pass in plain SQL on the stored rows by more than 1e-9."""
    df, model = _trained(spark, sf_dir)
    path = scratch_path(spark, f"ranker_{uuid.uuid4().hex}")
    MD.save_ranker(spark, model, REF, path)
    loaded = MD.load_ranker(spark, path, REF)
    scored = MD.score_ranker(MD.score_ranker(df, model, out="a"), loaded, out="b")
    scored = MD.score_stored(scored, spark.read.parquet(path).filter(F.col("cutoff") == str(REF)), out="c")
    off = (F.col("a") != F.col("b")) | (F.abs(F.col("a") - F.col("c")) > 1e-9)
    return present(scored.groupBy("split", F.col("label").cast("bigint").alias("label")).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(off).alias("differ")))


@register("saved_ranker_scores", lambda: f"""WITH {_ctes()}, {_fixed_ranker_ctes()}
    SELECT family_id, subcat_id, {r('prob')} AS prob, '{REF:%m%d}' AS suffix FROM rk_out""")
def q_saved_ranker_scores(spark, sf_dir):
    """M8 + F19: weights saved under their cutoff's MMDD suffix, loaded and applied."""
    path = scratch_path(spark, f"ranker_{uuid.uuid4().hex}")
    MD.save_ranker(spark, MD.fixed_ranker(), REF, path)
    model = MD.load_ranker(spark, path, REF)
    suffix = spark.read.parquet(path).filter(F.col("cutoff") == str(REF)).select("suffix").distinct()
    out = MD.score_ranker(_features(spark, sf_dir), model, out="prob").select("family_id", "subcat_id", "prob")
    return present(out.crossJoin(F.broadcast(suffix)))  # one row


HISTORY_SQL = """
    months AS (SELECT date_trunc('month', o_orderdate) AS m, avg(o_totalprice) AS a, avg(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) AS b
               FROM orders GROUP BY 1),
    history AS (SELECT row_number() OVER (ORDER BY m) AS epoch, round(a / 1e6, 6) AS train_loss, round(b / 1e6, 6) AS val_loss FROM months)"""


def _stored_history(spark, sf_dir):
    """A history with one row per order month and two averages, written as text and read back."""
    orders = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet")
    months = orders.groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(
        F.avg("o_totalprice").alias("a"), F.avg(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice"))).alias("b"))
    numbered = RK.ordered_ranks(months, [], [F.col("m")], {"epoch": []})
    path = scratch_path(spark, f"history_{uuid.uuid4().hex}")
    FI.write_table(numbered.select("epoch", F.round(F.col("a") / 1e6, 6).alias("train_loss"), F.round(F.col("b") / 1e6, 6).alias("val_loss")), path, fmt="csv")
    return FI.read_table(spark, path, fmt="csv", schema="epoch long, train_loss double, val_loss double")


@register("history_diagnostics", lambda: f"""WITH {HISTORY_SQL.strip()},
    g AS (SELECT *, abs(train_loss - val_loss) AS gap, first_value(train_loss) OVER (ORDER BY epoch) AS t1,
                 first_value(val_loss) OVER (ORDER BY epoch) AS v1, max(epoch) OVER () AS last_epoch FROM history)
    SELECT CAST(epoch AS BIGINT) AS epoch, {r('train_loss')} AS train_loss, {r('val_loss')} AS val_loss,
           {r('(t1 - train_loss) / t1 * 100')} AS train_change_pct, {r('(v1 - val_loss) / v1 * 100')} AS val_change_pct, {r('gap')} AS gap,
           CASE WHEN gap < 0.02 THEN 'excellent' WHEN gap < 0.05 THEN 'good' WHEN gap IS NOT NULL THEN 'review' END AS gap_band,
           CASE WHEN epoch <= 10 THEN 'early' WHEN epoch <= 30 THEN 'middle' ELSE 'late' END AS phase,
           CAST(CASE WHEN epoch > last_epoch - 15 THEN 1 ELSE 0 END AS BIGINT) AS last15 FROM g""")
def q_history_diagnostics(spark, sf_dir):
    """W6-W8 on a stored history."""
    return present(DG.history_changes(_stored_history(spark, sf_dir)))


@register("history_summary", lambda: f"""WITH {HISTORY_SQL.strip()},
    s AS (SELECT count(*) AS epochs, arg_min_null(train_loss, epoch) AS tf, arg_max_null(train_loss, epoch) AS tl, arg_min_null(val_loss, epoch) AS vf,
                 arg_max_null(val_loss, epoch) AS vl, min(val_loss) AS vb FROM history)
    SELECT CAST(epochs AS BIGINT) AS epochs, {r('tf')} AS train_loss_first, {r('tl')} AS train_loss_last, {r('vf')} AS val_loss_first,
           {r('vl')} AS val_loss_last, {r('vb')} AS val_loss_best, {r('abs(tl - vl)')} AS gap_last,
           CASE WHEN abs(tl - vl) < 0.02 THEN 'excellent' WHEN abs(tl - vl) < 0.05 THEN 'good' WHEN tl - vl IS NOT NULL THEN 'review' END AS gap_band FROM s""")
def q_history_summary(spark, sf_dir):
    """W9 + W7 on a stored history."""
    return present(DG.history_summary(_stored_history(spark, sf_dir)))


# === E1-E8, D27 ===================================================================================

@register("split_evaluation", lambda: f"""WITH {_ctes()}, {_labels_sql()},
    t AS (SELECT * FROM splitted WHERE split = 'test'),
    rk AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY round(score, 12) DESC, {SUBCAT_TIES_SQL}) AS rn FROM t),
    fm AS (SELECT family_id, count(*) AS n, sum(label) AS pos,
                  sum(CASE WHEN rn <= {K} THEN label ELSE 0 END) AS hits
           FROM rk GROUP BY family_id HAVING count(*) >= {K} AND sum(label) > 0)
    SELECT CAST({K} AS BIGINT) AS k, {r(f'avg(hits / {K}.0)')} AS precision, {r('avg(hits / pos)')} AS recall,
           {r('avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END)')} AS hit_rate,
           CAST(count(*) AS BIGINT) AS n_families FROM fm""")
def q_split_evaluation(spark, sf_dir):
    """E1 with the linear score on the test split."""
    df = MD.stratified_split(_labelled(spark, sf_dir)).filter(F.col("split") == "test")
    return present(EV.split_evaluation(df, K, score="score"))


@register("holdout_evaluation", lambda: f"""WITH {_ctes()}, {_truth_sql()},
    preds AS (SELECT family_id, subcat_id, score, net_sales FROM scored),
    {_eval_sql('preds', 'score', SUBCAT_TIES_SQL)}""")
def q_holdout_evaluation(spark, sf_dir):
    """Top-3 subcategories against the holdout purchases."""
    return present(EV.holdout_evaluation(_features(spark, sf_dir), _holdout(spark, sf_dir), K))


@register("cross_eval_precision", lambda: f"""WITH {_ctes()}, {_truth_sql()},
    recs AS (SELECT * FROM scored QUALIFY row_number() OVER (
               PARTITION BY family_id ORDER BY round(score, 12) DESC, {SUBCAT_TIES_SQL}) <= {K}),
    fams AS (SELECT DISTINCT s.family_id FROM scored s JOIN (SELECT DISTINCT family_id FROM truth) t USING (family_id)),
    hits AS (SELECT family_id, count(*) AS hits FROM recs JOIN truth USING (family_id, subcat_id) GROUP BY family_id)
    SELECT {r(f'avg(coalesce(hits, 0) / {K}.0)')} AS precision, CAST(count(*) AS BIGINT) AS n_families
    FROM fams LEFT JOIN hits USING (family_id)""")
def q_cross_eval_precision(spark, sf_dir):
    """E3."""
    return present(EV.cross_eval_precision(_features(spark, sf_dir), _holdout(spark, sf_dir), K))


@register("all_family_metrics", lambda: f"""WITH {_ctes()}, {_truth_sql()},
    preds AS (SELECT family_id, subcat_id, score, net_sales FROM scored),
    {_eval_sql('preds', 'score', SUBCAT_TIES_SQL, missing='zero')}""")
def q_all_family_metrics(spark, sf_dir):
    """E4 (subcategory level): families without predictions count 0."""
    return present(EV.holdout_evaluation(_features(spark, sf_dir), _holdout(spark, sf_dir), K, missing="zero"))


@register("all_family_metrics_items", lambda: f"""WITH {_ctes()}, {_items_sql()}, {_truth_sql('item_id')},
    preds AS (SELECT family_id, item_id, item_score FROM items),
    {_eval_sql('preds', 'item_score', 'item_id', level='item_id', missing='zero')}""")
def q_all_family_metrics_items(spark, sf_dir):
    """E4 (item level) on the blended item scores."""
    items = _item_scores(spark, sf_dir, ranks=False)  # top-k only, no full ranks
    truth = _holdout(spark, sf_dir, "item_id")
    return present(EV.holdout_evaluation(items, truth, K, score="item_score", ties=("item_id",),
                                         level="item_id", missing="zero"))


def _family_metrics_sql(where=""):
    return f"""WITH {_ctes()}, {_truth_sql()},
    recs AS (SELECT * FROM scored QUALIFY row_number() OVER (
               PARTITION BY family_id ORDER BY round(score, 12) DESC, {SUBCAT_TIES_SQL}) <= {K}),
    nt AS (SELECT family_id, count(*) AS n_truth FROM truth GROUP BY family_id),
    hp AS (SELECT DISTINCT family_id FROM scored),
    hits AS (SELECT family_id, count(*) AS hits FROM recs JOIN truth USING (family_id, subcat_id) GROUP BY family_id)
    SELECT nt.family_id, CAST(nt.n_truth AS BIGINT) AS n_truth,
           CAST(CASE WHEN hp.family_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS has_pred,
           CAST(coalesce(hits.hits, 0) AS BIGINT) AS hits,
           {r(f'coalesce(hits.hits, 0) / {K}.0')} AS precision,
           {r('coalesce(hits.hits, 0) / nt.n_truth')} AS recall,
           {r('CASE WHEN coalesce(hits.hits, 0) > 0 THEN 1.0 ELSE 0.0 END')} AS hit
    FROM nt LEFT JOIN hp USING (family_id) LEFT JOIN hits USING (family_id) {where}"""


@register("family_metrics", lambda: _family_metrics_sql())
def q_family_metrics(spark, sf_dir):
    """Per-family hits, precision, recall and hit for every holdout family."""
    return present(EV.family_metrics(_features(spark, sf_dir), _holdout(spark, sf_dir), K))


@register("family_lookup", lambda: _family_metrics_sql(f"WHERE nt.family_id = {LOOKUP_FAMILY}"))
def q_family_lookup(spark, sf_dir):
    """The metrics of one family."""
    fm = EV.family_metrics(_features(spark, sf_dir), _holdout(spark, sf_dir), K)
    return present(fm.filter(F.col("family_id") == LOOKUP_FAMILY))


@register("division_metrics", lambda: f"""WITH {_ctes()}, {_truth_sql()},
    p AS (SELECT s.*, dv.division FROM scored s JOIN ({O.division_by_subcat_sql()}) dv USING (subcat_id)
          WHERE dv.division IS NOT NULL),
    recs AS (SELECT * FROM p QUALIFY row_number() OVER (
               PARTITION BY family_id, division ORDER BY round(score, 12) DESC, {SUBCAT_TIES_SQL}) <= {K}),
    nt AS (SELECT family_id, count(*) AS n_truth FROM truth GROUP BY family_id),
    divs AS (SELECT DISTINCT division FROM p),
    hits AS (SELECT family_id, division, count(*) AS hits FROM recs JOIN truth USING (family_id, subcat_id)
             GROUP BY family_id, division),
    fm AS (SELECT nt.family_id, nt.n_truth, divs.division, coalesce(hits.hits, 0) AS hits
           FROM nt CROSS JOIN divs LEFT JOIN hits USING (family_id, division))
    SELECT division, CAST({K} AS BIGINT) AS k, {r(f'avg(hits / {K}.0)')} AS precision,
           {r('avg(hits / n_truth)')} AS recall, {r('avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END)')} AS hit_rate,
           CAST(count(*) AS BIGINT) AS n_families
    FROM fm GROUP BY division""")
def q_division_metrics(spark, sf_dir):
    """E5: top-3 per division, truth not restricted to the division."""
    preds = _with_division(spark, sf_dir, _features(spark, sf_dir))
    return present(EV.division_metrics(preds, _holdout(spark, sf_dir), K))


@register("hit_buckets", lambda: f"""WITH {_ctes()}, {_truth_sql()},
    recs AS (SELECT * FROM scored QUALIFY row_number() OVER (
               PARTITION BY family_id ORDER BY round(score, 12) DESC, {SUBCAT_TIES_SQL}) <= {K}),
    nt AS (SELECT family_id, count(*) AS n_truth FROM truth GROUP BY family_id),
    hits AS (SELECT family_id, count(*) AS hits FROM recs JOIN truth USING (family_id, subcat_id) GROUP BY family_id),
    fm AS (SELECT nt.family_id, nt.n_truth, coalesce(hits.hits, 0) AS hits FROM nt LEFT JOIN hits USING (family_id))
    SELECT CAST(hits AS BIGINT) AS hits, CAST(count(*) AS BIGINT) AS n_families, {r('avg(n_truth)')} AS mean_bought
    FROM fm GROUP BY hits""")
def q_hit_buckets(spark, sf_dir):
    """Families by number of hits and the mean breadth of their baskets."""
    return present(EV.hit_buckets(_features(spark, sf_dir), _holdout(spark, sf_dir), K))


def _model_comparison_sql():
    metric = lambda preds, score: f"""
      (WITH recs AS (SELECT * FROM {preds} QUALIFY row_number() OVER (
                 PARTITION BY family_id ORDER BY round({score}, 12) DESC, {SUBCAT_TIES_SQL}) <= {K}),
            nt AS (SELECT family_id, count(*) AS n_truth FROM truth GROUP BY family_id),
            hp AS (SELECT DISTINCT family_id FROM {preds}),
            hits AS (SELECT family_id, count(*) AS hits FROM recs JOIN truth USING (family_id, subcat_id) GROUP BY family_id),
            fm AS (SELECT nt.family_id, nt.n_truth, hits.hits IS NOT NULL OR hp.family_id IS NOT NULL AS has_pred,
                          coalesce(hits.hits, 0) AS hits
                   FROM nt LEFT JOIN hp USING (family_id) LEFT JOIN hits USING (family_id))
       SELECT avg(hits / {K}.0) FILTER (WHERE has_pred) AS precision,
              avg(hits / n_truth) FILTER (WHERE has_pred) AS recall,
              avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE has_pred) AS hit_rate FROM fm)"""
    cols = []
    for m in ("precision", "recall", "hit_rate"):
        cols += [f"{r(f'a.{m}')} AS {m}_linear", f"{r(f'b.{m}')} AS {m}_ranker",
                 f"{r(f'b.{m} - a.{m}')} AS {m}_diff",
                 f"{r(f'CASE WHEN a.{m} <> 0 THEN (b.{m} - a.{m}) / a.{m} * 100.0 END')} AS {m}_rel_pct"]
    return f"""WITH {_ctes()}, {_truth_sql()}, {_fixed_ranker_ctes()},
    lin AS {metric('scored', 'score')},
    net AS {metric('rk_out', 'prob')}
    SELECT {', '.join(cols)},
           CASE WHEN b.precision - a.precision > 1e-9 THEN 'ranker better'
                WHEN b.precision - a.precision < -1e-9 THEN 'linear better' ELSE 'tie' END AS verdict
    FROM lin a CROSS JOIN net b"""


@register("model_comparison", _model_comparison_sql)
def q_model_comparison(spark, sf_dir):
    """Linear score against the (fixed-weight) ranker on the holdout."""
    truth = _holdout(spark, sf_dir)
    feats = _stored_features(spark, sf_dir)
    a = EV.holdout_evaluation(feats, truth, K)
    b = EV.holdout_evaluation(MD.score_ranker(feats, MD.fixed_ranker()), truth, K, score="prob")
    return present(EV.compare_models(a, b, "linear", "ranker"))


@register("model_comparison_trained")
def q_model_comparison_trained(spark, sf_dir):
    """Linear score against the trained ranker, saved and loaded, on the holdout."""
    truth = _holdout(spark, sf_dir)
    feats = _stored_features(spark, sf_dir)
    a = EV.holdout_evaluation(feats, truth, K)
    b = EV.holdout_evaluation(MD.score_ranker(feats, _trained_and_stored(spark, sf_dir)), truth, K, score="prob")
    return present(EV.compare_models(a, b, "linear", "ranker"))


def _trained_and_stored(spark, sf_dir):
    path = scratch_path(spark, f"ranker_{uuid.uuid4().hex}")
    MD.save_ranker(spark, _trained(spark, sf_dir)[1], REF, path)
    return MD.load_ranker(spark, path, REF)


def _cutoff_matrix_sql():
    early = O.pair_features_ctes(W, L, EARLY_CUTOFF).replace("lines AS (", "lines_e AS (", 1)
    # rename every CTE of the early chain with an _e suffix
    names = ["hist", "summ", "fam", "blk10", "blk", "gaps", "gstat", "cyc2", "cyc", "months", "spairs", "mcount",
             "dense", "thr", "bits", "ser2", "ser3", "ser4", "ser5", "ser6", "ser", "base", "rec", "frq", "feat",
             "scored"]
    import re
    for n in names:
        early = re.sub(rf"\b{n}\b(?=\s+AS \()", f"{n}_e", early)
        early = re.sub(rf"(FROM|JOIN)\s+{n}\b(?!_)", rf"\1 {n}_e", early)
    early = early.replace("FROM lines ", "FROM lines_e ").replace("FROM lines\n", "FROM lines_e\n")
    return f"""WITH {_ctes()}, {early}, {_truth_sql()}, {_fixed_ranker_ctes()},
    cells AS (
      SELECT 'linear' AS model, '{EARLY_CUTOFF}' AS cutoff, family_id, subcat_id, score, net_sales FROM scored_e
      UNION ALL SELECT 'linear', '{REF}', family_id, subcat_id, score, net_sales FROM scored
      UNION ALL SELECT 'ranker', '{REF}', family_id, subcat_id, prob, net_sales FROM rk_out),
    recs AS (SELECT * FROM cells QUALIFY row_number() OVER (
               PARTITION BY model, cutoff, family_id ORDER BY round(score, 12) DESC, {SUBCAT_TIES_SQL}) <= {K}),
    fams AS (SELECT DISTINCT c.model, c.cutoff, c.family_id FROM cells c
             JOIN (SELECT DISTINCT family_id FROM truth) t USING (family_id)),
    hits AS (SELECT model, cutoff, family_id, count(*) AS hits FROM recs JOIN truth USING (family_id, subcat_id)
             GROUP BY ALL),
    prec AS (SELECT model, cutoff, avg(coalesce(hits, 0) / {K}.0) AS precision, count(*) AS n
             FROM fams LEFT JOIN hits USING (model, cutoff, family_id) GROUP BY model, cutoff),
    dif AS (SELECT *, precision - first_value(precision) OVER (PARTITION BY model ORDER BY cutoff) AS dv FROM prec)
    SELECT model, cutoff, {r('precision')} AS precision, CAST(n AS BIGINT) AS n_families, {r('dv')} AS diff_vs_first,
           CAST(CASE WHEN abs(dv) < 0.02 THEN 1 ELSE 0 END AS BIGINT) AS similar,
           CAST(CASE WHEN abs(dv) > 0.05 THEN 1 ELSE 0 END AS BIGINT) AS large_gap
    FROM dif"""


@register("cutoff_matrix", _cutoff_matrix_sql)
def q_cutoff_matrix(spark, sf_dir):
    """precision@3 for linear at two data cutoffs and the ranker."""
    return _cutoff_matrix(spark, sf_dir, MD.fixed_ranker())


@register("cutoff_matrix_trained")
def q_cutoff_matrix_trained(spark, sf_dir):
    """D27 with the trained ranker, saved and loaded."""
    return _cutoff_matrix(spark, sf_dir, _trained_and_stored(spark, sf_dir))


def _cutoff_matrix(spark, sf_dir, ranker):
    """The cells of the matrix from one feature table as of both cutoffs: one pass over the lines, written once."""
    path = scratch_path(spark, f"asof_{uuid.uuid4().hex}")
    feats = FE.pair_features_asof(_hist(spark, sf_dir), REF, [EARLY_CUTOFF, REF])
    FI.write_table(feats.select(F.date_format("cutoff", "yyyy-MM-dd").alias("cutoff"), "family_id", "subcat_id", *MD.FEATURES, "score", "net_sales"), path)
    feats = FI.read_table(spark, path, fmt="parquet")
    keys = ["cutoff", "family_id", "subcat_id", "net_sales"]
    net = MD.score_ranker(feats.filter(F.col("cutoff") == str(REF)), ranker).select(*keys, F.col("prob").alias("score"), F.lit("ranker").alias("model"))
    cells = feats.select(*keys, "score", F.lit("linear").alias("model")).unionByName(net)
    return present(EV.cutoff_matrix(cells, _holdout(spark, sf_dir), K))


# === D18-D26, O4, O5 ===============================================================================

@register("item_repurchase", lambda: f"""WITH {_ctes()}, {_items_sql()}
    SELECT family_id, item_id, strftime(last_day, '%Y-%m-%d') AS last_day, CAST(n_buys AS BIGINT) AS n_buys,
           CAST(n30 AS BIGINT) AS n30, CAST(n60 AS BIGINT) AS n60, CAST(n90 AS BIGINT) AS n90,
           CAST(p_long AS BIGINT) AS p_long, CAST(days_since_last AS BIGINT) AS days_since_last,
           {r('due')} AS due, {r('penalty')} AS penalty, {r('repurchase')} AS repurchase
    FROM rep4""")
def q_item_repurchase(spark, sf_dir):
    """Repurchase due-ness per (family, item)."""
    out = IT.item_repurchase(_upto_ref(spark, sf_dir), REF)
    return present(out.select("family_id", "item_id", "last_day", "n_buys", "n30", "n60", "n90", "p_long",
                              "days_since_last", "due", "penalty", "repurchase"))


@register("item_popularity", lambda: f"""WITH {_ctes()}, {_items_sql()}
    SELECT family_id, subcat_id, item_id, CAST(item_invoices AS BIGINT) AS item_invoices,
           CAST(subcat_invoices AS BIGINT) AS subcat_invoices, CAST(subcat_items AS BIGINT) AS subcat_items,
           CAST(last_year_lines AS BIGINT) AS last_year_lines, {r('popularity')} AS popularity
    FROM pop""")
def q_item_popularity(spark, sf_dir):
    """Item popularity inside the family's subcategory."""
    out = IT.item_popularity(_upto_ref(spark, sf_dir), REF)
    return present(out.select("family_id", "subcat_id", "item_id", "item_invoices", "subcat_invoices",
                              "subcat_items", "last_year_lines", "popularity"))


ITEM_COLS = ["family_id", "subcat_id", "item_id", "division", "prob", "repurchase", "popularity",
             "repurchase_scaled", "popularity_scaled", "item_score", "subcat_rank", "item_rank", "division_rank"]


def _items_select(where=""):
    sel = []
    for c in ITEM_COLS:
        if c in ("family_id", "subcat_id", "item_id", "division"):
            sel.append(c)
        elif c.endswith("rank"):
            sel.append(f"CAST({c} AS BIGINT) AS {c}")
        else:
            sel.append(f"{r(c)} AS {c}")
    return f"WITH {_ctes()}, {_items_sql()}\n    SELECT {', '.join(sel)} FROM items {where}"


@register("item_scores", lambda: _items_select())
def q_item_scores(spark, sf_dir):
    """D20 + D22 + D23 + D24: blended item scores and ranks."""
    return present(_item_scores(spark, sf_dir).select(*ITEM_COLS))


@register("item_rank_by_division", lambda: _items_select("WHERE division IS NOT NULL"))
def q_item_rank_by_division(spark, sf_dir):
    """D24 output: items of a known division with their division rank."""
    return present(IT.items_by_division(_item_scores(spark, sf_dir)).select(*ITEM_COLS))


@register("item_consolidation", lambda: f"""WITH lines AS ({L})
    SELECT family_id, item_id, strftime(day, '%Y-%m-%d') AS day, subcat_id, {r('sum(qty)')} AS qty,
           {r('avg(list_price)')} AS list_price, {r('avg(net_sales)')} AS net_sales, {r('avg(discount)')} AS discount,
           max(invoice_id) AS invoice_id, max(store_id) AS store_id, CAST(count(*) AS BIGINT) AS n_lines,
           any_value(subcat_name) AS subcat_name, any_value(division) AS division
    FROM lines GROUP BY family_id, item_id, day, subcat_id""")
def q_item_consolidation(spark, sf_dir):
    """One row per (family, item, day, subcat), null keys kept."""
    lines = purchase_lines(spark, sf_dir, households=HOUSEHOLDS)
    return present(IT.consolidate_item_lines(lines))


@register("reduction_ratio", lambda: f"""WITH lines AS ({L}),
    g AS (SELECT 1 FROM lines GROUP BY family_id, item_id, day, subcat_id)
    SELECT CAST((SELECT count(*) FROM lines) AS BIGINT) AS rows_before, CAST((SELECT count(*) FROM g) AS BIGINT) AS rows_after,
           {r('1.0 - (SELECT count(*) FROM g) / (SELECT count(*) FROM lines)')} AS reduction""")
def q_reduction_ratio(spark, sf_dir):
    """Row reduction of the item consolidation."""
    lines = purchase_lines(spark, sf_dir, households=HOUSEHOLDS)
    return present(IT.reduction_ratio(lines, IT.consolidate_item_lines(lines)))


@register("top_k_subcats", lambda: f"""WITH {_ctes()}
    SELECT family_id, subcat_id, {r('score')} AS score,
           CAST(row_number() OVER (PARTITION BY family_id ORDER BY round(score, 12) DESC, {SUBCAT_TIES_SQL}) AS BIGINT) AS rank
    FROM scored QUALIFY rank <= {K}""")
def q_top_k_subcats(spark, sf_dir):
    """The three best subcategories of every family."""
    top = RK.top_k(_features(spark, sf_dir), ["family_id"], "score", K, ["-net_sales", "subcat_id"])
    return present(top.select("family_id", "subcat_id", "score", "rank"))


@register("top_k_by_division", lambda: f"""WITH {_ctes()},
    p AS (SELECT s.*, dv.division FROM scored s JOIN ({O.division_by_subcat_sql()}) dv USING (subcat_id)
          WHERE dv.division IS NOT NULL)
    SELECT family_id, division, subcat_id, {r('score')} AS score,
           CAST(row_number() OVER (PARTITION BY family_id, division ORDER BY round(score, 12) DESC, {SUBCAT_TIES_SQL}) AS BIGINT) AS rank
    FROM p QUALIFY rank <= {K}""")
def q_top_k_by_division(spark, sf_dir):
    """The three best subcategories per family and division."""
    p = _with_division(spark, sf_dir, _features(spark, sf_dir)).filter(F.col("division").isNotNull())
    top = RK.top_k(p, ["family_id", "division"], "score", K, ["-net_sales", "subcat_id"])
    return present(top.select("family_id", "division", "subcat_id", "score", "rank"))


def _divisions(spark, sf_dir):
    """Division label and code of each subcategory."""
    code = F.when(F.col("division") == "A", 1).when(F.col("division") == "B", 2).cast("bigint")
    return _subcat_division(spark, sf_dir).withColumn("division_id", code)


@register("delivery_table", lambda: f"""WITH {_ctes()},
    names AS (SELECT DISTINCT TRY_CAST(substring(p_brand, 7) AS BIGINT) AS subcat_id, p_brand AS subcat_name FROM part),
    p AS (SELECT s.*, n.subcat_name, dv.division FROM scored s
          LEFT JOIN names n USING (subcat_id)
          JOIN ({O.division_by_subcat_sql()}) dv USING (subcat_id)
          WHERE dv.division IN ('A', 'B'))
    SELECT CAST(0 AS BIGINT) AS top, family_id, subcat_id, subcat_name, {r('recency')} AS recency,
           {r('frequency')} AS frequency, {r('sow')} AS sow, {r('season')} AS season, CAST(0 AS BIGINT) AS ppmi,
           {r('score')} AS score, {r('cycle_days')} AS cycle_days, CAST(days_since_last AS BIGINT) AS days_since_last,
           {r('season_gap_mean')} AS season_gap_mean, {r('season_gap_std')} AS season_gap_std,
           CAST(CASE division WHEN 'A' THEN 1 WHEN 'B' THEN 2 END AS BIGINT) AS division_id, division,
           CAST(row_number() OVER (PARTITION BY family_id, division ORDER BY round(score, 12) DESC, {SUBCAT_TIES_SQL}) AS BIGINT) AS top_dc
    FROM p""")
def q_delivery_table(spark, sf_dir):
    """The subcategory delivery table ranked per family and division."""
    out = RK.delivery_table(_features(spark, sf_dir), subcat_names(spark, sf_dir), _divisions(spark, sf_dir), ["A", "B"])
    return present(out)


@register("first_division_per_subcat", lambda: """
    SELECT subcat_id, division, item_id FROM (
      SELECT TRY_CAST(substring(p_brand, 7) AS BIGINT) AS subcat_id, p_partkey AS item_id,
             CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'A' WHEN p_type IN ('PROMO', 'SMALL') THEN 'B' END AS division FROM part) v
    WHERE division IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY subcat_id ORDER BY item_id) = 1""")
def q_first_division_per_subcat(spark, sf_dir):
    """The division of each subcategory's first item, in order of item id."""
    items = item_dimension(spark, sf_dir).filter(F.col("division").isNotNull())
    return present(RK.first_per_key(items, ["subcat_id"], [F.col("item_id")]).select("subcat_id", "division", "item_id"))


@register("global_ordinal", lambda: f"""WITH {_ctes()}
    SELECT family_id, subcat_id, {r('score')} AS score,
           CAST(row_number() OVER (ORDER BY round(score, 12) DESC, family_id, {SUBCAT_TIES_SQL}) - 1 AS BIGINT) AS top
    FROM scored""")
def q_global_ordinal(spark, sf_dir):
    """0-based position over all pairs by score."""
    out = RK.global_ordinal(_features(spark, sf_dir), "score", ["family_id", "-net_sales", "subcat_id"])
    return present(out.select("family_id", "subcat_id", "score", "top"))


# === sources / profile ================================================================================

@register("csv_roundtrip", lambda: f"""WITH lines AS ({L})
    SELECT family_id, subcat_id, subcat_name, item_id, invoice_id, store_id, strftime(day, '%Y-%m-%d') AS day,
           {r('qty')} AS qty, {r('list_price')} AS list_price, {r('net_sales')} AS net_sales,
           {r('discount')} AS discount
    FROM lines""")
def q_csv_roundtrip(spark, sf_dir):
    """S1 + S3-S5 + S13/S15: lines written as latin-1 text with dd-MMM-yy
    dates into the shared folder, read back with the history loader."""
    lines = purchase_lines(spark, sf_dir, households=HOUSEHOLDS).drop("division")
    path = scratch_path(spark, f"history_text_{uuid.uuid4().hex}")
    FI.write_purchases_text(lines, path)
    back = FI.read_purchases(spark, path)
    return present(back.select("family_id", "subcat_id", "subcat_name", "item_id", "invoice_id", "store_id",
                               "day", "qty", "list_price", "net_sales", "discount"))


@register("ingest_rejects", lambda: f"""WITH lines AS ({L}),
    t AS (SELECT *, CASE WHEN invoice_id % 11 = 0 THEN 'day' WHEN invoice_id % 13 = 0 THEN 'family' WHEN item_id % 17 = 0 THEN 'subcat' END AS reason FROM lines)
    SELECT coalesce(reason, 'accepted') AS reason, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_observed,
           {r("sum(CASE WHEN reason IS NULL AND item_id % 5 > 0 THEN net_sales ELSE 0 END)")} AS net_sales
    FROM t GROUP BY 1""")
def q_ingest_rejects(spark, sf_dir):
    """S3 + S5: a damaged text history split into accepted and rejected rows in one pass; rows by reason, as stored and as
    observed during the split, and the accepted net sales."""
    lines = purchase_lines(spark, sf_dir, households=HOUSEHOLDS).drop("division")
    path, out = scratch_path(spark, f"damaged_{uuid.uuid4().hex}"), scratch_path(spark, f"split_{uuid.uuid4().hex}")
    FI.write_purchases_text(lines, path)
    text = FI.text_table(spark, path)
    key = lambda c, n: F.col(c).cast("bigint") % n == 0
    text = text.withColumns({
        "DIM_PERIODO": F.when(key("DIM_FACTURA", 11), "2001-31-12").otherwise(F.col("DIM_PERIODO")),
        "CODIGO_FAMILIA": F.when(key("DIM_FACTURA", 13), "").otherwise(F.col("CODIGO_FAMILIA")),
        "COD_SUBCATEGORIA": F.when(key("COD_ITEM", 17), "n/a").otherwise(F.col("COD_SUBCATEGORIA")),
        "VENTA_NETA": F.when(key("COD_ITEM", 5), "-").otherwise(F.col("VENTA_NETA"))})
    accepted, rejected, counts = FI.split_purchases(text, out)
    sides = accepted.select(F.lit("accepted").alias("reason"), "net_sales").unionByName(rejected.select("reason", F.lit(0.0).alias("net_sales")))
    seen = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])
    return present(sides.groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("net_sales").alias("net_sales")).withColumn(
        "n_observed", F.element_at(seen, F.col("reason")).cast("bigint")))


@register("table_profile", lambda: f"""WITH lines AS ({L})
    SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT family_id) AS BIGINT) AS families,
           strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day FROM lines""")
def q_table_profile(spark, sf_dir):
    """A18."""
    return present(DG.table_profile(purchase_lines(spark, sf_dir, households=HOUSEHOLDS)))


# === item-level evaluation, export, second log ==========================================

def _division_metrics_sql(level="subcat_id", score="score", ties=SUBCAT_TIES_SQL, items=False):
    if items:
        base = f"WITH {_ctes()}, {_items_sql()}, {_truth_sql(level)},\n    p AS (SELECT * FROM items WHERE division IS NOT NULL),"
    else:
        base = (f"WITH {_ctes()}, {_truth_sql(level)},\n    p AS (SELECT s.*, dv.division FROM scored s JOIN "
                f"({O.division_by_subcat_sql()}) dv USING (subcat_id) WHERE dv.division IS NOT NULL),")
    return f"""{base}
    recs AS (SELECT * FROM p QUALIFY row_number() OVER (
               PARTITION BY family_id, division ORDER BY round({score}, 12) DESC, {ties}) <= {K}),
    nt AS (SELECT family_id, count(*) AS n_truth FROM truth GROUP BY family_id),
    divs AS (SELECT DISTINCT division FROM p),
    hits AS (SELECT family_id, division, count(*) AS hits FROM recs JOIN truth USING (family_id, {level})
             GROUP BY family_id, division),
    fm AS (SELECT nt.family_id, nt.n_truth, divs.division, coalesce(hits.hits, 0) AS hits
           FROM nt CROSS JOIN divs LEFT JOIN hits USING (family_id, division))
    SELECT division, CAST({K} AS BIGINT) AS k, {r(f'avg(hits / {K}.0)')} AS precision,
           {r('avg(hits / n_truth)')} AS recall, {r('avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END)')} AS hit_rate,
           CAST(count(*) AS BIGINT) AS n_families
    FROM fm GROUP BY division"""


@register("division_metrics_items", lambda: _division_metrics_sql("item_id", "item_score", "item_id", items=True))
def q_division_metrics_items(spark, sf_dir):
    """E5 at item level: top-3 items per (family, division)."""
    items = _item_scores(spark, sf_dir, ranks=False)
    truth = _holdout(spark, sf_dir, "item_id")
    return present(EV.division_metrics(items, truth, K, score="item_score", ties=("item_id",), level="item_id"))


@register("family_lookup_items", lambda: f"""WITH {_ctes()}, {_items_sql()}, {_truth_sql('item_id')},
    recs AS (SELECT * FROM items QUALIFY row_number() OVER (
               PARTITION BY family_id ORDER BY round(item_score, 12) DESC, item_id) <= {K}),
    nt AS (SELECT family_id, count(*) AS n_truth FROM truth GROUP BY family_id),
    hp AS (SELECT DISTINCT family_id FROM items),
    hits AS (SELECT family_id, count(*) AS hits FROM recs JOIN truth USING (family_id, item_id) GROUP BY family_id)
    SELECT nt.family_id, CAST(nt.n_truth AS BIGINT) AS n_truth,
           CAST(CASE WHEN hp.family_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS has_pred,
           CAST(coalesce(hits.hits, 0) AS BIGINT) AS hits,
           {r(f'coalesce(hits.hits, 0) / {K}.0')} AS precision,
           {r('coalesce(hits.hits, 0) / nt.n_truth')} AS recall,
           {r('CASE WHEN coalesce(hits.hits, 0) > 0 THEN 1.0 ELSE 0.0 END')} AS hit
    FROM nt LEFT JOIN hp USING (family_id) LEFT JOIN hits USING (family_id) WHERE nt.family_id = {LOOKUP_FAMILY}""")
def q_family_lookup_items(spark, sf_dir):
    """E6 at item level: one family's item recommendations, looked up in a stored result (S10), against its purchases."""
    truth = _holdout(spark, sf_dir, "item_id").filter(F.col("family_id") == LOOKUP_FAMILY)
    stored = FI.stored_families(spark, _item_store(spark, sf_dir), [LOOKUP_FAMILY])
    return present(EV.family_metrics(stored, truth, K, score="item_score", ties=("item_id",), level="item_id").withColumn(
        "family_id", F.col("family_id").cast("bigint")))


def _item_store(spark, sf_dir, households=HOUSEHOLDS):
    """The item scores of all families, stored once for look-ups."""
    path = scratch_path(spark, f"items_{uuid.uuid4().hex}")
    FI.write_family_store(_item_scores(spark, sf_dir, ranks=False, households=households).select("family_id", "item_id", "item_score"), path, buckets=64)
    return path


@register("family_lookup_items_by_customer", lambda: f"""WITH {_ctes(lines=O.lines_sql(None))}, {_items_sql()}, {_truth_sql('item_id')},
    nt AS (SELECT family_id, count(*) AS n_truth FROM truth GROUP BY family_id),
    busy AS (SELECT * FROM nt ORDER BY n_truth DESC, family_id LIMIT 5),
    recs AS (SELECT * FROM items QUALIFY row_number() OVER (
               PARTITION BY family_id ORDER BY round(item_score, 12) DESC, item_id) <= {K}),
    hp AS (SELECT DISTINCT family_id FROM items),
    hits AS (SELECT family_id, count(*) AS hits FROM recs JOIN truth USING (family_id, item_id) GROUP BY family_id)
    SELECT busy.family_id, CAST(busy.n_truth AS BIGINT) AS n_truth,
           CAST(CASE WHEN hp.family_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS has_pred,
           CAST(coalesce(hits.hits, 0) AS BIGINT) AS hits,
           {r(f'coalesce(hits.hits, 0) / {K}.0')} AS precision,
           {r('coalesce(hits.hits, 0) / busy.n_truth')} AS recall,
           {r('CASE WHEN coalesce(hits.hits, 0) > 0 THEN 1.0 ELSE 0.0 END')} AS hit
    FROM busy LEFT JOIN hp USING (family_id) LEFT JOIN hits USING (family_id)""")
def q_family_lookup_items_by_customer(spark, sf_dir):
    """E6/S10 with one family per customer: the five customers with most holdout items, looked up in one stored result."""
    truth = _holdout(spark, sf_dir, "item_id", None)
    busy = [x["family_id"] for x in truth.groupBy("family_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "family_id").limit(5).collect()]
    stored = FI.stored_families(spark, _item_store(spark, sf_dir, None), busy)
    return present(EV.family_metrics(stored, truth.filter(F.col("family_id").isin(busy)), K, score="item_score", ties=("item_id",), level="item_id"))


@register("item_scores_from_stored", lambda: _items_select())
def q_item_scores_from_stored(spark, sf_dir):
    """Items under subcategory scores read from a stored table with the delivered column names."""
    path = scratch_path(spark, f"subcats_{uuid.uuid4().hex}")
    names = {"family_id": "nucleo", "subcat_id": "COD_SUBCATEGORIA", "score": "score_final"}
    FI.write_table(_features(spark, sf_dir).select(*[F.col(k).alias(v) for k, v in names.items()]), path)
    stored = FI.rename_present(FI.read_table(spark, path, fmt="parquet"), {v: k for k, v in names.items()})
    return present(IT.item_scores(stored, _upto_ref(spark, sf_dir), REF).select(*ITEM_COLS))


SCORED_COLS = ["prob", "repurchase", "popularity", "repurchase_scaled", "popularity_scaled", "item_score"]
PAIR_COLS = ["recency", "frequency", "sow", "season", "cycle_days", "season_gap_mean", "season_gap_std"]
PAIR_LONGS = ["days_since_last", "freq_lines", "sow_weighted_lines"]


@register("scored_item_consolidation", lambda: f"""WITH {_ctes()}, {_items_sql()},
    g AS (
      SELECT family_id, item_id, day, subcat_id, sum(qty) AS qty, avg(list_price) AS list_price, avg(net_sales) AS net_sales,
             avg(discount) AS discount, max(invoice_id) AS invoice_id, max(store_id) AS store_id, count(*) AS n_lines,
             min(subcat_name) AS subcat_name, min(division) AS division
      FROM (SELECT CASE WHEN item_id % 97 = 0 THEN NULL ELSE item_id END AS item_id, * EXCLUDE (item_id) FROM ihist) GROUP BY ALL),
    n AS (SELECT family_id, item_id, subcat_id, count(*) AS item_days FROM g GROUP BY ALL)
    SELECT g.family_id, g.item_id, strftime(g.day, '%Y-%m-%d') AS day, g.subcat_id, {r('g.qty')} AS qty, {r('g.list_price')} AS list_price,
           {r('g.net_sales')} AS net_sales, {r('g.discount')} AS discount, g.invoice_id, g.store_id, CAST(g.n_lines AS BIGINT) AS n_lines,
           g.subcat_name, g.division, CAST(n.item_days AS BIGINT) AS item_days, CAST(b.n_buys AS BIGINT) AS n_buys,
           {', '.join(f"{r('i.' + c)} AS {c}" for c in SCORED_COLS)}, {', '.join(f"{r('s.' + c)} AS {c}" for c in PAIR_COLS)},
           {', '.join(f"CAST(s.{c} AS BIGINT) AS {c}" for c in PAIR_LONGS)}
    FROM g JOIN n ON g.family_id = n.family_id AND g.item_id IS NOT DISTINCT FROM n.item_id AND g.subcat_id = n.subcat_id
    LEFT JOIN its3 i ON g.family_id = i.family_id AND g.item_id = i.item_id AND g.subcat_id = i.subcat_id
    LEFT JOIN rep4 b ON i.family_id = b.family_id AND i.item_id = b.item_id
    LEFT JOIN scored s ON g.family_id = s.family_id AND g.subcat_id = s.subcat_id""")
def q_scored_item_consolidation(spark, sf_dir):
    """D21 + A11: consolidated lines with scores, features and counts carried through; every 97th item is unknown, so null keys occur."""
    lines = _hist(spark, sf_dir)
    feats = stored(_features(spark, sf_dir).select(*MD.KEYS, "score", *PAIR_COLS, *PAIR_LONGS))
    items = IT.item_scores(feats, lines, REF, ranks=False)
    # stored, so that the shuffles of the line joins are gone before the wide lines are dealt again
    unknown = stored(lines.withColumn("item_id", F.when(F.col("item_id") % 97 != 0, F.col("item_id"))))
    return present(IT.consolidate_scored_items(unknown, items, feats))


EXPORT_FLOATS = ["prob", "repurchase", "popularity", "repurchase_scaled", "popularity_scaled", "item_score"]


@register("item_export", lambda: f"""WITH {_ctes()}, {_items_sql()}
    SELECT CASE WHEN length(CAST(family_id AS VARCHAR)) < 10 THEN lpad(CAST(family_id AS VARCHAR), 10, '0')
                ELSE CAST(family_id AS VARCHAR) END AS family_code,
           item_id, subcat_id, division,
           {', '.join(f"printf('%.10f', {c}) AS {c}" for c in EXPORT_FLOATS)},
           CAST(item_rank AS BIGINT) AS item_rank
    FROM items""")
def q_item_export(spark, sf_dir):
    """The item table as delivered: every double column as
    fixed 10-decimal text, the family code zero-padded to 10 characters."""
    from pyspark.sql import types as T
    from cartpulse.functions.scores import fixed10, zfill10

    items = _item_scores(spark, sf_dir).select("family_id", "item_id", "subcat_id", "division",
                                                *EXPORT_FLOATS, "item_rank")
    doubles = {f.name for f in items.schema.fields if isinstance(f.dataType, T.DoubleType)}
    cols = [zfill10(F.col("family_id").cast("string")).alias("family_code")]
    for c in items.columns[1:]:
        cols.append(fixed10(F.col(c)).alias(c) if c in doubles else F.col(c))
    return present(items.select(*cols))


EVENTS_EVAL_REF = dt.date(2024, 1, 21)
EVENTS_HOLDOUT = (dt.date(2024, 1, 22), dt.date(2024, 1, 30))


@register("event_holdout_evaluation", lambda: f"""WITH {O.pair_features_ctes(Windows(EVENTS_EVAL_REF), O.events_sql())},
    truth AS (SELECT DISTINCT family_id, subcat_id FROM lines
              WHERE day >= {d(EVENTS_HOLDOUT[0])} AND day <= {d(EVENTS_HOLDOUT[1])}),
    preds AS (SELECT family_id, subcat_id, score, net_sales FROM scored),
    {_eval_sql('preds', 'score', SUBCAT_TIES_SQL)}""")
def q_event_holdout_evaluation(spark, sf_dir):
    """E2 on the event log: top-3 event types per user against the last week."""
    feats = FE.pair_features(event_lines(spark, sf_dir, until=EVENTS_EVAL_REF), EVENTS_EVAL_REF)
    later = event_lines(spark, sf_dir, since=EVENTS_HOLDOUT[0], until=shift_days(EVENTS_HOLDOUT[1], 1))
    truth = EV.materialised(EV.truth_pairs(later, *EVENTS_HOLDOUT))
    return present(EV.holdout_evaluation(feats, truth, K))


# === D16 subset, feature-table files, production fit =========================================

@register("pair_features_family_subset", lambda: f"""WITH {_ctes()}, {_truth_sql()},
    fams AS (SELECT DISTINCT family_id FROM truth)
    SELECT family_id, subcat_id, {r('score')} AS score, {r('recency')} AS recency, {r('frequency')} AS frequency
    FROM scored WHERE family_id IN (SELECT family_id FROM fams)""")
def q_pair_features_family_subset(spark, sf_dir):
    """D16 restricted to a family subset (the families seen in the holdout),
    applied as a left-semi join on the lines before any aggregation."""
    fams = _holdout(spark, sf_dir).select("family_id")
    out = FE.pair_features(_hist(spark, sf_dir), REF, families=fams)
    return present(out.select("family_id", "subcat_id", "score", "recency", "frequency"))


ROUNDTRIP_COLS = list(FI.FEATURE_TABLE_NAMES)
ROUNDTRIP_LONGS = {"family_id", "subcat_id", "days_since_last", "freq_lines", "sow_weighted_lines", "season_threshold"}
ROUNDTRIP_TEXT = {"gaps_days", "gaps_clipped_days", "season_series", "season_bits", "season_thinned", "season_peak_gaps"}


@register("feature_table_roundtrip", lambda: f"""WITH pf AS ({_pf_sql()})
    SELECT {', '.join(f"nullif({c}, '') AS {c}" if c in ROUNDTRIP_TEXT else c for c in ROUNDTRIP_COLS)} FROM pf""")
def q_feature_table_roundtrip(spark, sf_dir):
    """S13/S14 + S15 + S7 + P2/P3: the feature table written as text under
    the reference's column names, converted to Parquet, read back with the
    conditional rename and the keep-existing projection."""
    feats = _features(spark, sf_dir)
    out_names = {k: v for k, v in FI.FEATURE_TABLE_NAMES.items() if k in feats.columns}
    exported = FI.arrays_as_text(feats.select(*[F.col(k).alias(v) for k, v in out_names.items()]))
    base = scratch_path(spark, f"features_{uuid.uuid4().hex}")
    FI.write_table(exported, f"{base}/csv", fmt="csv")
    FI.convert(spark, f"{base}/csv", f"{base}/parquet", src_fmt="csv", dst_fmt="parquet")
    back = FI.read_table(spark, f"{base}/parquet", fmt="parquet")
    back = FI.rename_present(back, {v: k for k, v in out_names.items()})
    back = FI.select_present(back, ROUNDTRIP_COLS + ["not_in_table"])
    typed = [F.col(c).cast("bigint" if c in ROUNDTRIP_LONGS else "string" if c in ROUNDTRIP_TEXT else "double").alias(c) for c in back.columns]
    return present(back.select(*typed))


# === skew: three households, each holding about a third of all lines ===========================

HOT_HOUSEHOLDS = 3


@register("pair_features_hot_families", lambda: _pf_sql(HOT_HOUSEHOLDS))
def q_pair_features_hot_families(spark, sf_dir):
    """D16 with three families of about a third of all lines each (the hot-key
    case): partial aggregation keeps every shuffle bounded by map tasks x
    subcategories, the family window holds one row per subcategory."""
    return present(FE.pair_features(_hist(spark, sf_dir, HOT_HOUSEHOLDS), REF))


@register("item_scores_hot_families", lambda: f"""WITH {O.pair_features_ctes(W, O.lines_sql(HOT_HOUSEHOLDS))},
    {_items_sql()}
    SELECT family_id, item_id, CAST(item_rank AS BIGINT) AS item_rank, {r('item_score')} AS item_score FROM items""")
def q_item_scores_hot_families(spark, sf_dir):
    """D20/D23 for three families of about a third of all lines each."""
    items = _item_scores(spark, sf_dir, households=HOT_HOUSEHOLDS)
    return present(items.select("family_id", "item_id", "item_rank", "item_score"))


# === sparse variants: one family per customer ====================================================

LC = O.lines_sql(None)


@register("holdout_evaluation_by_customer", lambda: f"""WITH {_ctes(lines=LC)}, {_truth_sql()},
    preds AS (SELECT family_id, subcat_id, score, net_sales FROM scored),
    {_eval_sql('preds', 'score', SUBCAT_TIES_SQL)}""")
def q_holdout_evaluation_by_customer(spark, sf_dir):
    """E2, one family per customer."""
    feats = FE.pair_features(_hist(spark, sf_dir, None), REF)
    return present(EV.holdout_evaluation(feats, _holdout(spark, sf_dir, households=None), K))


@register("top_k_subcats_by_customer", lambda: f"""WITH {_ctes(lines=LC)}
    SELECT family_id, subcat_id, {r('score')} AS score,
           CAST(row_number() OVER (PARTITION BY family_id ORDER BY round(score, 12) DESC, {SUBCAT_TIES_SQL}) AS BIGINT) AS rank
    FROM scored QUALIFY rank <= {K}""")
def q_top_k_subcats_by_customer(spark, sf_dir):
    """O4, one family per customer."""
    top = RK.top_k(FE.pair_features(_hist(spark, sf_dir, None), REF), ["family_id"], "score", K, ["-net_sales", "subcat_id"])
    return present(top.select("family_id", "subcat_id", "score", "rank"))


@register("global_ordinal_by_customer", lambda: f"""WITH {_ctes(lines=LC)}
    SELECT family_id, subcat_id, {r('score')} AS score,
           CAST(row_number() OVER (ORDER BY round(score, 12) DESC, family_id, {SUBCAT_TIES_SQL}) - 1 AS BIGINT) AS top
    FROM scored""")
def q_global_ordinal_by_customer(spark, sf_dir):
    """D26, one family per customer."""
    feats = FE.pair_features(_hist(spark, sf_dir, None), REF)
    return present(RK.global_ordinal(feats, "score", ["family_id", "-net_sales", "subcat_id"]).select("family_id", "subcat_id", "score", "top"))


@register("item_scores_by_customer", lambda: _items_select().replace(L, LC))
def q_item_scores_by_customer(spark, sf_dir):
    """D20-D24, one family per customer."""
    return present(_item_scores(spark, sf_dir, households=None).select(*ITEM_COLS))


@register("stratified_split_by_customer", lambda: f"""WITH {_ctes(lines=LC)}, {_labels_sql()}
    SELECT family_id, subcat_id, CAST(label AS BIGINT) AS label, split FROM splitted""")
def q_stratified_split_by_customer(spark, sf_dir):
    """M1, one family per customer."""
    return present(MD.stratified_split(_labelled(spark, sf_dir, None)).select("family_id", "subcat_id", "label", "split"))
