"""Properties of the feature table and the ranker on the driver's data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from cartpulse.operators import features as FE
from cartpulse.operators import model as MD
from cartpulse.plans import catalog as C
from cartpulse.sources.tables import purchase_lines


@pytest.fixture(scope="module")
def feats(spark):
    lines = purchase_lines(spark, SF_MID, households=100, until=C.REF)
    return FE.pair_features(lines, C.REF).cache()


def test_scores_in_unit_interval(feats):
    for c in ("recency", "frequency", "sow", "season", "score"):
        lo, hi = feats.agg(F.min(c), F.max(c)).first()
        assert 0.0 <= lo and hi <= 1.0 + 1e-12, c


def test_sow_max_is_one_per_family(feats):
    mx = feats.filter("sow_weighted_lines > 0").groupBy("family_id").agg(F.max("sow").alias("m"))
    assert mx.filter(F.abs(F.col("m") - 1.0) > 1e-12).count() == 0


def test_thinned_series_has_no_adjacent_ones(feats):
    assert feats.filter(F.col("season_thinned").contains("11")).count() == 0


def test_partition_count_does_not_change_result(spark, feats):
    lines = purchase_lines(spark, SF_MID, households=100, until=C.REF).repartition(3, "invoice_id")
    other = FE.pair_features(lines, C.REF)
    cols = ["family_id", "subcat_id", "score", "cycle_days", "season_bits"]
    a = sorted(tuple(r) for r in feats.select(*cols).collect())
    b = sorted(tuple(r) for r in other.select(*cols).collect())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:2] == y[:2] and x[2] == pytest.approx(y[2], abs=1e-12) and x[3:] == y[3:]


def test_family_permutation_invariance(spark):
    lines = purchase_lines(spark, SF_SMALL, households=100, until=C.REF)
    base = FE.pair_features(lines, C.REF).select("family_id", "subcat_id", "score")
    shifted = FE.pair_features(lines.withColumn("family_id", F.col("family_id") + 1000), C.REF) \
        .select((F.col("family_id") - 1000).alias("family_id"), "subcat_id", "score")
    assert base.exceptAll(shifted).count() == 0 and shifted.exceptAll(base).count() == 0


def test_hits_bounded_by_k(spark):
    from cartpulse.operators import evaluate as EV

    fm = EV.family_metrics(C._features(spark, SF_MID), C._holdout(spark, SF_MID), 3)
    assert fm.filter("hits > 3 OR hits > n_truth").count() == 0


def test_split_takes_a_fifth_of_each_class(spark):
    rows = spark.range(1000).selectExpr("id AS family_id", "id % 7 AS subcat_id", "CAST(id % 10 = 0 AS INT) AS label")
    counts = {(r["label"], r["split"]): r["count"] for r in MD.stratified_split(rows).groupBy("label", "split").count().collect()}
    assert counts == {(0, "test"): 180, (0, "train"): 720, (1, "test"): 20, (1, "train"): 80}


def test_items_without_id_and_in_two_subcategories(spark):
    import datetime as dt

    from cartpulse.operators import items as IT

    day = lambda n: dt.date(2025, 11, 30) - dt.timedelta(days=n)
    rows = [(1, 10, None, 100 + i, day(5 * i + 1)) for i in range(8)] + [(1, 10, 7, 200, day(3)), (1, 10, 7, 201, day(40)), (1, 11, 7, 202, day(70)), (1, 11, 8, 202, day(70))]
    lines = spark.createDataFrame(rows, "family_id long, subcat_id long, item_id long, invoice_id long, day date").withColumn("division", F.lit("A"))
    got = {(r["subcat_id"], r["item_id"]): r for r in IT.item_aggregates(lines, dt.date(2025, 11, 30)).collect()}
    assert set(got) == {(10, 7), (11, 7), (11, 8)}
    assert [got[k]["n_buys"] for k in sorted(got)] == [3, 3, 1]
    assert [got[k]["p30"] for k in sorted(got)] == [1, 1, 0] and [got[k]["p90"] for k in sorted(got)] == [3, 3, 1]
    assert [(got[k]["item_invoices"], got[k]["subcat_invoices"], got[k]["subcat_items"]) for k in sorted(got)] == [(2, 10, 1), (1, 1, 2), (1, 1, 2)]


def test_ranker_roundtrip(spark, tmp_path):
    r = MD.fixed_ranker()
    path = str(tmp_path / "model")
    MD.save_ranker(spark, r, "2025-11-09", path)
    back = MD.load_ranker(spark, path, "2025-11-09")
    x = np.random.default_rng(1).normal(size=(5, 4))
    assert np.allclose(r.predict(x), back.predict(x))


def test_distributed_ranks_equal_windows(spark):
    from pyspark.sql import Window

    from cartpulse.operators import rank as RK

    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id % 50 END AS family_id", "CASE WHEN id % 4 > 0 THEN id % 4 END AS division",
                                        "(id * 7919) % 101 AS score", "id AS item_id")
    got = RK.distributed_ranks(rows, ["family_id"], "score", ["item_id"], {"all": [], "own": ["division"]})
    order = [F.col("score").desc(), F.col("item_id")]
    want = rows.withColumns({"all": F.row_number().over(Window.partitionBy("family_id").orderBy(*order)),
                             "own": F.row_number().over(Window.partitionBy("family_id", "division").orderBy(*order))})
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_cycles_over_two_years_of_blocks(spark):
    import datetime as dt

    lines = spark.createDataFrame([(1, 1, i, dt.date(2025, 11, 29) - dt.timedelta(days=28 * i), 1.0, 1.0, 1.0, 0.0) for i in range(26)],
                                  "family_id long, subcat_id long, invoice_id long, day date, qty double, list_price double, net_sales double, discount double")
    row = FE.purchase_cycles(lines, dt.date(2025, 11, 30), months=24).first()
    assert row["cycle_days"] == pytest.approx(28.0) and row["gaps_days"] == [28] * 9
