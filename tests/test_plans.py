"""Plan shape checks that keep the scale design from regressing."""

import pytest

from conftest import SF_SMALL
from cartpulse.plans import catalog as C
from cartpulse.plans.inspect import summary


@pytest.fixture()
def shuffle_joins(spark):
    """What a large layout gets: no broadcast joins."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_flagship_is_pushed_pruned_and_python_free(spark):
    s = summary(C.QUERIES["pair_features"](spark, SF_SMALL))
    assert s["python"] == 0 and s["expand"] == 0
    assert any("LessThan(o_orderdate" in f for f in s["pushed_filters"])
    # only the used lineitem columns are read
    li = [r for r in s["read_schemas"] if "l_orderkey" in r][0]
    assert "l_quantity" not in li and "l_tax" not in li and "l_shipdate" not in li


def test_flagship_shuffles_fact_table_twice_at_scale(shuffle_joins):
    s = summary(C.QUERIES["pair_features"](shuffle_joins, SF_SMALL))
    keys = " ".join(s["exchanges"])
    assert "invoice_id" not in keys  # the order-key partitioning of the last join is reused
    assert keys.count("l_partkey") == 1 and keys.count("l_orderkey") == 1
    assert s["sort_merge_joins"] == 2


def test_item_aggregation_reuses_order_key_partitioning(shuffle_joins):
    from cartpulse.operators import items as IT

    lines = C._hist(shuffle_joins, SF_SMALL)
    s = summary(IT.item_table(lines, C.REF))
    keys = " ".join(s["exchanges"])
    assert "invoice_id" not in keys  # level 1 reuses the order-key partitioning
    assert keys.count("l_orderkey") == 1 and keys.count("l_partkey") == 1  # the lines are read once


def test_top_k_plans_a_group_limit(spark):
    from cartpulse.plans.inspect import formatted_plan

    text = formatted_plan(C.QUERIES["top_k_subcats"](spark, SF_SMALL))
    assert "WindowGroupLimit" in text


def lineitem_scans(df):
    return sum("l_orderkey" in r for r in summary(df)["read_schemas"])


@pytest.mark.parametrize("name", ["holdout_evaluation", "cross_eval_precision", "all_family_metrics", "family_lookup", "division_metrics",
                                  "hit_buckets", "model_comparison", "cutoff_matrix"])
def test_evaluation_reads_the_lines_twice_at_most(spark, name):
    assert lineitem_scans(C.QUERIES[name](spark, SF_SMALL)) <= 2


def test_ranker_scoring_sends_only_the_features_to_python(spark):
    from cartpulse.plans.inspect import formatted_plan

    text = formatted_plan(C.QUERIES["score_fixed_ranker"](spark, SF_SMALL))
    python = [x for x in text.splitlines() if "ArrowEvalPython" in x or "season_series" in x and "ArrowEvalPython" in x]
    assert python and "season_series" not in text.split("ArrowEvalPython")[-1][:400]


def test_stored_families_read_their_buckets_only(spark, tmp_path):
    from pyspark.sql import functions as F

    from cartpulse.plans.inspect import formatted_plan
    from cartpulse.sources import files as FI

    path = str(tmp_path / "t")
    rows = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id % 400 END AS family_id", "id AS item_id")
    FI.write_family_store(rows, path, buckets=16)
    got = FI.stored_families(spark, path, [7, 8])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.filter("family_id IN (7, 8)").collect()))
    text = formatted_plan(got)
    assert "PartitionFilters: [" in text and "bucket#" in text.split("PartitionFilters:")[1].split("\n")[0] and "family_id" in text.split("PushedFilters:")[1].split("\n")[0]
    # the scan itself opens the files of one bucket
    one = FI.stored_families(spark, path, [8])
    opened = {x[0] for x in spark.read.parquet(path).filter(F.col("bucket") == F.pmod(F.xxhash64(F.lit(8).cast("bigint")), F.col("of"))).select(F.input_file_name()).distinct().collect()}
    assert one.count() > 0 and 0 < len(opened) < len(spark.read.parquet(path).inputFiles())
    # a family of a third of the rows spans several files
    assert spark.read.parquet(path).filter("family_id = 7").select(F.input_file_name()).distinct().count() > 1


def test_cutoff_matrix_features_read_the_lines_once(spark):
    from cartpulse.operators import features as FE

    df = FE.pair_features_asof(C._hist(spark, SF_SMALL), C.REF, [C.EARLY_CUTOFF, C.REF])
    assert lineitem_scans(df) == 1
    for cutoff in (C.EARLY_CUTOFF, C.REF):
        want = FE.pair_features(C._hist(spark, SF_SMALL), C.REF, data_cutoff=cutoff).select("family_id", "subcat_id", "score", "net_sales")
        got = df.filter(f"cutoff = DATE'{cutoff}'").select(*want.columns)
        key = lambda d: sorted((r[0], r[1], round(r[2], 9), round(r[3], 4)) for r in d.collect())
        assert key(got) == key(want)


def test_split_of_a_text_history_reads_it_once(spark, tmp_path):
    from cartpulse.sources import files as FI

    rows = [("1", "10", "24-Nov-25", "1"), ("1", "10", "04-11-2025", "1"), ("", "10", "24-Nov-25", "1"), ("1", "x", "24-Nov-25", "1"),
            ("", "x", None, "1"), ("2", "11", "1-Jan-95", "bad"), (None, None, None, None)]
    raw = spark.createDataFrame(rows, "CODIGO_FAMILIA string, COD_SUBCATEGORIA string, DIM_PERIODO string, CANTIDAD_SUELTA string")
    accepted, rejected, counts = FI.split_purchases(raw, str(tmp_path / "s"))
    assert counts == {"accepted": 2, "day": 3, "family": 1, "subcat": 1}
    assert sorted((r["family_id"], str(r["day"]), r["qty"]) for r in accepted.collect()) == [(1, "2025-11-24", 1.0), (2, "1995-01-01", 0.0)]
    assert sorted(r["reason"] for r in rejected.collect()) == ["day"] * 3 + ["family", "subcat"]
    assert {r["subcat_id"] for r in rejected.collect()} == {"10", "x", None}
    assert FI.split_purchases(raw.filter("false"), str(tmp_path / "e"))[2] == {"accepted": 0, "day": 0, "family": 0, "subcat": 0}


def test_a_family_look_up_computes_one_family(spark):
    from cartpulse.plans.inspect import formatted_plan

    text = formatted_plan(C.QUERIES["family_lookup"](spark, SF_SMALL))
    filters = [x for x in text.splitlines() if x.startswith("Condition") and "o_custkey" in x]
    assert filters and all(f"% {C.HOUSEHOLDS}) = {C.LOOKUP_FAMILY}" in x for x in filters)


def test_the_package_is_shipped_to_executors(tmp_path):
    import os
    import subprocess
    import sys

    from conftest import ROOT

    # a driver that knows the package, workers that do not: they run in another folder
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from cartpulse.session import local_session, ship_package
from pyspark.sql import functions as F
spark = local_session(2, 2)
if sys.argv[1] == "ship":
    ship_package(spark)
@F.udf("string")
def name(x):
    import cartpulse.functions.scores
    return cartpulse.functions.scores.__name__
print("got", spark.range(2).select(name("id")).distinct().collect()[0][0])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = lambda how: subprocess.run([sys.executable, "-c", code, how], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300).stdout
    assert "got cartpulse.functions.scores" in run("ship") and "got" not in run("no")


def test_shuffles_follow_the_number_of_lines(spark, tmp_path, monkeypatch):
    from cartpulse import session as SE
    from cartpulse.operators.rank import ordered_ranks
    from pyspark.sql import functions as F

    ids = spark.range(3_000)
    ids.selectExpr("id AS l_orderkey", "id % 50 AS l_partkey", "id AS l_suppkey", "1D AS l_quantity", "2D AS l_extendedprice",
                   "0D AS l_discount").write.parquet(f"{tmp_path}/lineitem.parquet")
    ids.selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "timestamp_ntz'2001-05-05' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(50).selectExpr("id AS p_partkey", "'Brand#11' AS p_brand", "'PROMO' AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    own = ("spark.sql.autoBroadcastJoinThreshold", SE.ADVISORY, SE.INITIAL)
    old = {k: spark.conf.get(k, None) for k in own}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set(SE.ADVISORY, "128MB")
        for each, partitions in ((1_000, 8), (100, 30)):  # 8: the session's own number
            monkeypatch.setattr(SE, "ROWS_PER_PARTITION", each)
            lines = C._hist(spark, str(tmp_path), None)
            table = C.FE.pair_features(lines, C.REF)
            assert len(table.collect()) == 7
            dealt = [x for x in summary(table)["exchanges"] if "hashpartitioning" in x]
            assert dealt and all(f", {partitions})" in x or f", {partitions}," in x for x in dealt), dealt
        assert SE.size_in_bytes(spark.conf.get(SE.ADVISORY)) <= 16 << 20
        ranked = ordered_ranks(ids.withColumn("g", F.lit(1)), ["g"], [F.col("id")], {"rank": []})
        assert ranked.filter("rank != id + 1").count() == 0
        assert SE.shuffle_partitions(spark) == 30
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_sizes_are_read_as_spark_writes_them():
    from cartpulse.session import size_in_bytes

    assert [size_in_bytes(x) for x in ("16m", "64MB", "1g", "1048576", "1048576b", "16k")] == [16 << 20, 64 << 20, 1 << 30, 1 << 20, 1 << 20, 16 << 10]


def scored_lines(spark):
    """Lines with unknown items, subcategories and families, scored items and features made by hand."""
    lines = spark.createDataFrame(
        [(f, s, i, inv, day, q) for f, s, i, inv, day, q in [
            (1, 10, 5, 100, "2001-01-01", 1.0), (1, 10, 5, 101, "2001-01-01", 2.0), (1, 10, 5, 102, "2001-01-02", 4.0), (1, 10, None, 103, "2001-01-02", 1.0),
            (1, 10, None, 104, "2001-01-03", 1.0), (1, 10, None, 105, "2001-01-03", 1.0), (1, None, 5, 106, "2001-01-03", 1.0), (None, 10, 5, 107, "2001-01-03", 1.0),
            (2, 11, 6, None, "2001-01-04", 1.0), (2, 11, 6, None, None, 1.0)]],
        "family_id long, subcat_id long, item_id long, invoice_id long, day string, qty double").selectExpr(
        "family_id", "subcat_id", "concat('s', subcat_id) AS subcat_name", "item_id", "invoice_id", "7L AS store_id", "to_date(day) AS day", "qty",
        "qty AS list_price", "qty AS net_sales", "0D AS discount", "IF(item_id = 5, 'A', NULL) AS division")
    items = spark.createDataFrame([(1, 10, 5, 3, 0.5), (1, None, 5, 9, 0.1)], "family_id long, subcat_id long, item_id long, n_buys long, prob double").selectExpr(
        "*", *[f"prob * 2 AS {c}" for c in ("repurchase", "popularity", "repurchase_scaled", "popularity_scaled", "item_score")])
    feats = spark.createDataFrame([(1, 10, 0.25)], "family_id long, subcat_id long, recency double").selectExpr(
        "*", *[f"1D AS {c}" for c in ("frequency", "sow", "season", "cycle_days", "season_gap_mean", "season_gap_std")],
        *[f"1L AS {c}" for c in ("days_since_last", "freq_lines", "sow_weighted_lines")])
    return lines, items, feats


def test_scored_lines_are_dealt_once(shuffle_joins):
    lines, items, feats = scored_lines(shuffle_joins)
    out = C.IT.consolidate_scored_items(lines, items, feats)
    # lines and scores by item, then both sides of the features' join by pair
    assert len(summary(out)["exchanges"]) == 4
    small = C.IT.consolidate_scored_items(lines, items, feats.hint("broadcast"))
    assert len(summary(small)["exchanges"]) == 2


def test_scored_lines_keep_null_keys(spark):
    out = C.IT.consolidate_scored_items(*scored_lines(spark))
    got = {(r["family_id"], r["subcat_id"], r["item_id"], str(r["day"])): (r["n_lines"], r["item_days"], r["qty"], r["invoice_id"], r["n_buys"], r["prob"], r["recency"])
           for r in out.collect()}
    assert got == {
        (1, 10, 5, "2001-01-01"): (2, 2, 3.0, 101, 3, 0.5, 0.25), (1, 10, 5, "2001-01-02"): (1, 2, 4.0, 102, 3, 0.5, 0.25),
        (1, 10, None, "2001-01-02"): (1, 2, 1.0, 103, None, None, 0.25), (1, 10, None, "2001-01-03"): (2, 2, 2.0, 105, None, None, 0.25),
        (1, None, 5, "2001-01-03"): (1, 1, 1.0, 106, None, None, None), (None, 10, 5, "2001-01-03"): (1, 1, 1.0, 107, None, None, None),
        (2, 11, 6, "2001-01-04"): (1, 2, 1.0, None, None, None, None), (2, 11, 6, "None"): (1, 2, 1.0, None, None, None, None)}
    assert out.count() == len(got)


def test_a_stored_table_leaves_no_shuffle_files(spark):
    import time

    from cartpulse.session import CLEANUP, stored
    from pyspark.sql import functions as F

    def files():
        all_ = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (all_.apply(i).getName() for i in range(all_.size())) if n.startswith("shuffle_") and n.endswith(".data")}

    rows = spark.range(1000).repartition(4).groupBy((F.col("id") % 10).alias("k")).agg(F.sum("id").alias("repurchase"), F.lit(None).cast("string").alias("s"))
    before = files()
    scaled = C.IT.minmax(rows, ["repurchase"])
    for _ in range(40):
        if files() <= before:
            break
        time.sleep(0.25)
    assert files() <= before
    assert sorted((r["k"], r["repurchase"], r["s"], round(r["repurchase_scaled"], 9)) for r in scaled.collect()) == [(k, 49500 + 100 * k, None, round(k / 9, 9)) for k in range(10)]
    assert stored(rows.filter("k > 99")).count() == 0 and spark.conf.get(CLEANUP) == "false"
