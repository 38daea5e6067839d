"""Ingest parsing (S3-S5) and evaluation golden cases."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cartpulse.operators import evaluate as EV
from cartpulse.operators import rank as RK
from cartpulse.sources import files as FI


def test_parse_purchases(spark):
    header = list(FI.RAW_COLUMNS)
    rows = [
        ["1", "10", "Vit", "", "", "100", "5", "", "24-Nov-25", "2", "3.5", "3.0", "0.5"],
        ["1", "10", "Vit", "", "", "100", "6", "", "4-Nov-25", "x", "", "1.0", "0"],
        ["1", "10", "Vit", "", "", "100", "7", "", "04-11-2025", "1", "1", "1", "0"],
        ["", "10", "Vit", "", "", "100", "8", "", "24-Nov-25", "1", "1", "1", "0"],
        ["2", "11", "Cal", "", "", "101", "9", "", "01-Jan-95", "1", "1", "1", "0"],
    ]
    raw = spark.createDataFrame(rows, FI.text_schema(header))
    out = FI.parse_purchases(raw).orderBy("invoice_id").collect()
    assert [r["invoice_id"] for r in out] == [5, 6, 9]
    assert out[0]["day"] == dt.date(2025, 11, 24)
    assert out[1]["day"] == dt.date(2025, 11, 4)
    assert out[1]["qty"] == 0.0 and out[1]["list_price"] == 0.0
    assert out[2]["day"] == dt.date(1995, 1, 1)  # two-digit year pivot


def test_rejected_rows_reasons(spark):
    path = tempfile.mkdtemp(prefix="cartpulse-rej-", dir="/tmp")
    rows = ["CODIGO_FAMILIA,COD_SUBCATEGORIA,DIM_PERIODO,CANTIDAD_SUELTA",
            "1,10,24-Nov-25,1", "1,10,04-11-2025,1", ",10,24-Nov-25,1", "1,x,24-Nov-25,1"]
    with open(os.path.join(path, "h.csv"), "w", encoding="latin-1") as f:
        f.write("\n".join(rows) + "\n")
    got = sorted(r["reason"] for r in FI.rejected_rows(spark, os.path.join(path, "h.csv")).collect())
    assert got == ["day", "family", "subcat"]
    assert FI.read_purchases(spark, os.path.join(path, "h.csv")).count() == 1


def test_csv_roundtrip_file(spark):
    path = tempfile.mkdtemp(prefix="cartpulse-csv-", dir="/tmp")
    df = spark.createDataFrame(
        [(1, 10, "Café", 100, 5, 7, dt.date(2025, 11, 24), 2.0, 3.5, 3.0, 0.5)],
        "family_id long, subcat_id long, subcat_name string, item_id long, invoice_id long, store_id long, "
        "day date, qty double, list_price double, net_sales double, discount double")
    FI.write_purchases_text(df, os.path.join(path, "h"))
    back = FI.read_purchases(spark, os.path.join(path, "h")).collect()
    assert len(back) == 1 and back[0]["subcat_name"] == "Café" and back[0]["day"] == dt.date(2025, 11, 24)


def _preds(spark, rows):
    return spark.createDataFrame(rows, "family_id long, subcat_id string, score double, net_sales double")


def test_holdout_metrics(spark):
    preds = _preds(spark, [(1, "a", 0.9, 0.0), (1, "b", 0.8, 0.0), (1, "c", 0.7, 0.0), (1, "z", 0.1, 0.0)])
    truth = spark.createDataFrame([(1, "a"), (1, "b"), (1, "d")], "family_id long, subcat_id string")
    r = EV.holdout_evaluation(preds, truth, 3).first()
    assert (r["precision"], r["recall"], r["hit_rate"]) == (pytest.approx(2 / 3), pytest.approx(2 / 3), 1.0)
    truth5 = spark.createDataFrame([(1, s) for s in "abdef"], truth.schema)
    assert EV.holdout_evaluation(preds, truth5, 3).first()["recall"] == pytest.approx(0.4)
    two = _preds(spark, [(1, "a", 0.9, 0.0), (1, "q", 0.8, 0.0)])
    assert EV.holdout_evaluation(two, truth, 3).first()["precision"] == pytest.approx(1 / 3)


def test_missing_predictions_skip_vs_zero(spark):
    preds = _preds(spark, [(1, "a", 0.9, 0.0)])
    truth = spark.createDataFrame([(1, "a"), (2, "a")], "family_id long, subcat_id string")
    skip = EV.holdout_evaluation(preds, truth, 3, missing="skip").first()
    zero = EV.holdout_evaluation(preds, truth, 3, missing="zero").first()
    assert (skip["n_families"], skip["n_skipped"], skip["hit_rate"]) == (1, 1, 1.0)
    assert (zero["n_families"], zero["hit_rate"]) == (2, 0.5)


def test_top_k_ties_and_global_ordinal(spark):
    df = _preds(spark, [(1, "b", 0.5, 1.0), (1, "a", 0.5, 1.0), (1, "c", 0.5, 2.0), (2, "x", 0.9, 0.0)])
    top = RK.top_k(df, ["family_id"], "score", 2, ["-net_sales", "subcat_id"]).filter("family_id = 1")
    assert [r["subcat_id"] for r in top.orderBy("rank").collect()] == ["c", "a"]
    g = RK.global_ordinal(df, "score", ["family_id", "-net_sales", "subcat_id"])
    assert [r["subcat_id"] for r in g.orderBy("top").collect()] == ["x", "c", "a", "b"]
    assert sorted(r["top"] for r in g.collect()) == [0, 1, 2, 3]


def test_label_overlap_guard(spark):
    from cartpulse.operators import model as MD

    feats = _preds(spark, [(1, "a", 0.9, 0.0)])
    lines = spark.createDataFrame([(1, "a", dt.date(2025, 11, 12))], "family_id long, subcat_id string, day date")
    with pytest.raises(ValueError):
        MD.label_pairs(feats, lines, "2025-11-10", "2025-11-30", data_cutoff="2025-11-29")
    out = MD.label_pairs(feats, lines, "2025-11-10", "2025-11-30", data_cutoff="2025-11-09").first()
    assert out["label"] == 1
