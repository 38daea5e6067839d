"""Golden vectors (FIXTURES.md section 3) for the per-pair formulas."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cartpulse.functions import arrays as A
from cartpulse.functions import scores as S
from cartpulse.functions.periods import Windows, shift_months
from cartpulse.operators import features as FE


def approx(x, rel=1e-6):
    return pytest.approx(x, rel=rel, abs=1e-6)


def _cycle_rows(spark, block_lists):
    w = Windows(dt.date(2025, 11, 30))
    df = spark.createDataFrame([(i, b) for i, b in enumerate(block_lists)], "id int, blocks_all array<int>")
    df = df.withColumn("any_active", F.lit(1))
    df = FE.apply_stages(df, FE.cycle_stages(w))
    return {r["id"]: r for r in df.collect()}


def test_cycle_and_clipping(spark):
    rows = _cycle_rows(spark, [[0, 5], [0, 2, 4, 6], [0, 1, 3, 6], [0, 1, 2, 6], list(range(0, 24, 2))])
    r = rows[0]
    assert r["cycle_days"] == 0 and r["penalty_strength"] == 2.0 and r["gaps_days"] == []
    r = rows[1]
    assert r["cycle_days"] == approx(14) and r["penalty_strength"] == 2.0
    assert (r["penalty_mean"], r["penalty_std"]) == (0.0, 0.0) and r["gaps_days"] == [14, 14, 14]
    r = rows[2]
    assert r["cycle_days"] == approx(14.0)
    assert (r["penalty_strength"], r["penalty_mean"], r["penalty_std"]) == (approx(0.408248), approx(14), approx(5.715476))
    assert r["gaps_days"] == [7, 14, 21]
    assert r["gaps_clipped_days"] == [approx(13.428452), approx(14), approx(14.571548)]
    r = rows[3]
    assert r["cycle_days"] == approx(13.670017)
    assert (r["penalty_strength"], r["penalty_mean"], r["penalty_std"]) == (approx(0.707107), approx(14), approx(9.899495))
    assert r["gaps_clipped_days"] == [approx(13.010051), approx(13.010051), approx(14.989949)]
    r = rows[4]  # only the 10 latest of 12 blocks
    assert r["gaps_days"] == [14] * 9 and r["cycle_days"] == approx(14)


def test_recency_curve(spark):
    cases = [(0, 30, 0.0), (14, 28, 0.585786), (30, 30, 1.0), (60, 30, 0.904837), (90, 30, 0.567971),
             (120, 30, 0.210379), (150, 30, 0.040762), (5, 0, 0.0)]
    w = Windows(dt.date(2025, 11, 30))
    df = spark.createDataFrame([(float(c), d) for d, c, _ in cases], "cycle_days double, days_since_last long")
    out = [r["recency"] for r in df.withColumns(FE.recency_stage(w)).collect()]
    assert out == [approx(e) for *_, e in cases]


def test_frequency_curve(spark):
    cases = [(7, 30, 7, 1, 0.4), (3, 30, 7, 0.428571, 0.921665), (8, 30, 7, 1.142857, 0.304762),
             (12, 30, 7, 1.714286, 0.0), (1, 182, 1, 1, 0.4), (10, 14.4, 15, 0.666667, 0.855901),
             (4, 0, 0, 10, 0.0)]
    w = Windows(dt.date(2025, 11, 30))
    df = spark.createDataFrame([(n, float(c), 1) for n, c, *_ in cases],
                               "lines_freq long, cycle_days double, any_freq int")
    out = FE.apply_stages(df, FE.frequency_stages(w, F.lit(1))).collect()
    for r, (_, _, e, ratio, score) in zip(out, cases):
        assert r["freq_expected"] == e
        assert r["freq_ratio"] == approx(ratio)
        assert r["frequency"] == approx(score)


def test_empty_family_frequency(spark):
    w = Windows(dt.date(2025, 11, 30))
    df = spark.createDataFrame([(0, 0.0, 0)], "lines_freq long, cycle_days double, any_freq int")
    r = FE.apply_stages(df, FE.frequency_stages(w, F.lit(0))).first()
    assert r["frequency"] == approx(0.1) and r["freq_expected"] is None


SERIES = [
    ([0, 2, 0, 0, 2, 0, 0, 2, 0, 0, 2, 0, 0], 2, "0100100100100", "0100100100100", [1, 2, 2, 2, 2], 0.222222, 0.957848),
    ([1] * 13, 1, "1" * 13, "1010101010101", [1] * 6, 0.0, 1.0),
    ([5] + [0] * 12, 5, "1" + "0" * 12, "1" + "0" * 12, [], 0.85, 0.291619),
    ([0, 0, 0, 4, 1, 0, 0, 0, 0, 6, 2, 0, 1], 2, "0001000001100", "0001000001000", [3, 5, 3], 0.257130, 0.939861),
    ([3, 0, 0, 0, 0, 0, 3, 0, 0, 0, 0, 0, 3], 3, "1000001000001", "1000001000001", [5, 5], 0.0, 1.0),
]


def test_month_series_chain(spark):
    w = Windows(dt.date(2025, 11, 30))
    rows = [tuple([i] + s[0]) for i, s in enumerate(SERIES)]
    schema = "id int, " + ", ".join(f"m{k} long" for k in range(13))
    df = spark.createDataFrame(rows, schema).withColumn("any_series", F.lit(1))
    out = {r["id"]: r for r in FE.apply_stages(df, FE.series_stages(w)).collect()}
    for i, (_, thr, bits, thin, gaps, cv, score) in enumerate(SERIES):
        r = out[i]
        assert r["season_threshold"] == thr
        assert r["season_bits"] == bits
        assert r["season_thinned"] == thin
        assert r["season_peak_gaps"] == gaps
        assert r["season_cv"] == approx(cv)
        assert r["season_regularity"] == approx(score)


def test_thinning_matches_sequential_fold(spark):
    import random

    def fold(bits):
        b = list(bits)
        for i in range(len(b) - 1):
            if b[i] == "1" and b[i + 1] == "1":
                b[i + 1] = "0"
        return "".join(b)

    rng = random.Random(3)
    data = ["".join(rng.choice("01") for _ in range(13)) for _ in range(500)]
    df = spark.createDataFrame([(s,) for s in data], "b string")
    got = [r[0] for r in df.select(A.col(A.thin_runs("b"))).collect()]
    assert got == [fold(s) for s in data]


def test_season_need_and_linear_score(spark):
    cases = [(4, 1, 1.0, 0.75), (4, 1, 0.291619, 0.484357), (2, 5, 1.0, 0.0), (0, 3, 1.0, 0.0)]
    df = spark.createDataFrame([(p, a, g, 1) for p, a, g, _ in cases],
                               "season_prior_invoices long, season_recent_invoices long, season_regularity double, any_series int")
    out = [r["season"] for r in df.withColumns(FE.season_exprs()).collect()]
    assert out == [approx(e) for *_, e in cases]
    # a pair missing from the series window has no seasonality
    df = spark.createDataFrame([(4, 0, 0.0, 0)], df.schema)
    assert df.withColumns(FE.season_exprs()).first()["season"] == 0.0
    lin = spark.range(1).select(S.linear_score(F.lit(0.585786), F.lit(0.4), F.lit(1.0), F.lit(0.75)).alias("s"))
    assert lin.first()["s"] == approx(0.604314)


def test_sow_one_family(spark):
    df = spark.createDataFrame([("x", 3, 2), ("y", 0, 3), ("z", 0, 0)], "s string, lines_recent long, lines_old long")
    df = df.withColumn("sow_weighted_lines", FE.weighted_lines())
    tot = df.agg(F.sum("sow_weighted_lines").cast("double"), F.max("sow_weighted_lines").cast("double")).first()
    out = {r["s"]: r for r in df.withColumn("sow", FE.sow_expr(F.lit(tot[0]), F.lit(tot[1]))).collect()}
    assert [out[k]["sow_weighted_lines"] for k in "xyz"] == [27, 9, 0]
    assert [out[k]["sow"] for k in "xyz"] == [approx(1), approx(0.333333), 0.0]


def test_repurchase_and_popularity(spark):
    from cartpulse.operators import items as IT

    ref = dt.date(2025, 11, 30)
    cases = [(30, 1, 2, 3, 4, 0.55, 1.0, 0.55), (10, 2, 2, 2, 2, 0.116188, 0.096, 0.011154),
             (75, 0, 0, 1, 3, 0.999889, 0.3, 0.299967)]
    rows = [(ref - dt.timedelta(days=t), p30, p60, p90, pl) for t, p30, p60, p90, pl, *_ in cases]
    df = spark.createDataFrame(rows, "last_day date, p30 long, p60 long, p90 long, p_long long")
    out = IT.with_repurchase(df, ref).collect()
    for r, (*_, due, pen, score) in zip(out, cases):
        assert (r["due"], r["penalty"], r["repurchase"]) == (approx(due), approx(pen), approx(score))
    pcases = [(3, 10, 4, 2, 0.285714), (1, 10, 4, 1, 0.071429), (2, 2, 1, 2, 0.5)]
    df = spark.createDataFrame([c[:4] for c in pcases],
                               "item_invoices long, subcat_invoices long, subcat_items long, last_year_lines long")
    got = [r["popularity"] for r in IT.with_popularity(df).collect()]
    assert got == [approx(c[4]) for c in pcases]


def test_month_clamp():
    d = shift_months(dt.date(2024, 5, 31), -3)
    assert d == dt.date(2024, 2, 29)
    assert shift_months(d, -12) == dt.date(2023, 2, 28)
