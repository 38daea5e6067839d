"""Labels, split, scaling, scoring and storing of the small neural ranker.

Training (M4, M5, M7, M9) is in ``training``.  A ranker, trained or given, is
applied by a vectorised UDF on the four feature columns only and kept as a
Parquet table of its weights and scaling, keyed by cutoff.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartpulse.functions.periods import as_date, mmdd
from cartpulse.operators.evaluate import truth_pairs
from cartpulse.operators.network import LAYERS, Ranker, flatten, forward, init_weights, unflatten
from cartpulse.operators.rank import ordered_ranks
from cartpulse.session import stored

# task bodies below are shipped by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEATURES = ["recency", "frequency", "sow", "season"]
KEYS = ["family_id", "subcat_id"]


# --- D17 labels -------------------------------------------------------------

def label_pairs(features: DataFrame, lines: DataFrame, start, end, data_cutoff=None,
                allow_overlap: bool = False) -> DataFrame:
    """Features with label 1 when the pair is bought in [start, end]."""
    if data_cutoff is not None and as_date(data_cutoff) >= as_date(start) and not allow_overlap:
        raise ValueError("feature rows overlap the label window; pass allow_overlap=True to accept")
    target = truth_pairs(lines, start, end).withColumn("label", F.lit(1))
    return features.join(target, KEYS, "left").withColumn(
        "label", F.coalesce(F.col("label"), F.lit(0)).cast("int"))


def class_balance(labelled: DataFrame, label: str = "label") -> DataFrame:
    """Rows, positives and positive share."""
    return labelled.agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        F.sum(label).cast("bigint").alias("positives"),
        F.avg(F.col(label).cast("double")).alias("positive_rate"),
    )


# --- M1 split -----------------------------------------------------------------

def split_key(keys, seed: int = 42) -> Column:
    """md5 of 'seed|key1|key2..': a reproducible random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


#: Leading hex digits of the split key that the rows of a class are counted by.
SPLIT_DIGITS = 3


def stratified_split(df: DataFrame, test_frac: float = 0.2, seed: int = 42, keys=KEYS, label: str = "label") -> DataFrame:
    """Reproducible 80/20 split inside each class: rows are ranked by a hash
    of their key within their label, and the first round(test_frac * n) rows
    of a class of n rows are its test rows.

    The rows are stored once, and neither sorted nor shuffled: a class is counted by the first digits
    of the hash (at most 4 096 counts), which gives the digits that its last test row has.  Rows
    with smaller digits are test rows, rows with larger ones train rows, and only those with the very
    digits are ranked (``ordered_ranks``, so a class may hold nearly all rows and a key may repeat)."""
    rows = stored(df).withColumn("_key", split_key(keys, seed)).withColumn("_digits", F.substring("_key", 1, SPLIT_DIGITS))
    counts = rows.groupBy(F.col(label).alias("_label"), F.col("_digits").alias("_cut")).agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("_label")
    counts = counts.withColumns({"_test": F.least(F.floor(F.sum("_n").over(own) * test_frac + 0.5), F.sum("_n").over(own)),
                                 "_upto": F.sum("_n").over(own.orderBy("_cut").rowsBetween(Window.unboundedPreceding, 0))})
    # one row for each class with test rows, stored so that its size decides how it is joined
    cuts = stored(counts.filter((F.col("_upto") >= F.col("_test")) & (F.col("_upto") - F.col("_n") < F.col("_test"))).select(
        "_label", "_cut", (F.col("_test") - F.col("_upto") + F.col("_n")).alias("_left")))
    rows = rows.join(cuts, F.col(label).eqNullSafe(F.col("_label")), "left")
    on_cut = F.coalesce(F.col("_digits") == F.col("_cut"), F.lit(False))
    sides = rows.filter(~on_cut).withColumn("split", F.when(F.col("_digits") < F.col("_cut"), "test").otherwise("train"))
    ranked = ordered_ranks(rows.filter(on_cut), [label], [F.col("_key"), *[F.col(k) for k in keys]], {"_rank": []})
    ranked = ranked.withColumn("split", F.when(F.col("_rank") <= F.col("_left"), "test").otherwise("train"))
    return sides.select(*df.columns, "split").unionByName(ranked.select(*df.columns, "split"))


# --- M2 standardisation ---------------------------------------------------------

def fit_scaler(df: DataFrame, cols=FEATURES) -> DataFrame:
    """One row: mean and population std of each column (std 0 -> 1)."""
    aggs = []
    for c in cols:
        x = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
        aggs += [F.avg(x).alias(f"mean_{c}"), F.stddev_pop(x).alias(f"std_{c}")]
    stats = df.agg(*aggs)
    for c in cols:
        stats = stats.withColumn(f"std_{c}", F.when(F.col(f"std_{c}") > 0, F.col(f"std_{c}")).otherwise(1.0))
    return stats


def apply_scaler(df: DataFrame, stats: DataFrame, cols=FEATURES, suffix: str = "_z") -> DataFrame:
    out = df.crossJoin(F.broadcast(stats))  # the stats table has exactly one row
    for c in cols:
        x = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
        out = out.withColumn(f"{c}{suffix}", (x - F.col(f"mean_{c}")) / F.col(f"std_{c}"))
    return out.drop(*[f"mean_{c}" for c in cols], *[f"std_{c}" for c in cols])


# --- M6 scoring -------------------------------------------------------------------

def score_ranker(df: DataFrame, ranker: Ranker, cols=FEATURES, out: str = "prob") -> DataFrame:
    """M6: probability for every row; only the feature columns go to Python."""
    wv, mean, std = flatten(ranker.weights), ranker.mean, ranker.std

    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        x = np.stack([s.astype(float).fillna(0.0).to_numpy() for s in (a, b, c, d)], axis=1)
        return pd.Series(forward(unflatten(wv), (x - mean) / std))

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "c": pd.Series, "d": pd.Series, "return": pd.Series}
    return df.withColumn(out, F.pandas_udf(run, "double")(*[F.col(c).cast("double") for c in cols]))


def score_stored(df: DataFrame, model: DataFrame, cols=FEATURES, out: str = "prob") -> DataFrame:
    """M6 without Python: the forward pass as array expressions on the stored rows of one ranker (``model``).

    The rows become one row of arrays (2 441 numbers), which is the broadcast side of a one-row join.
    """
    part = lambda name: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("part") == name, F.struct("idx", "value")))), lambda x: x["value"])
    n = len(LAYERS) - 1
    one = model.agg(*[part(f"w{i}").alias(f"_w{i}") for i in range(2 * n)], part("mean").alias("_mean"), part("std").alias("_std"))
    rows = df.crossJoin(F.broadcast(one))  # one row
    h = F.array(*[(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) - F.element_at("_mean", i + 1)) / F.element_at("_std", i + 1)
                  for i, c in enumerate(cols)])
    rows = rows.withColumn("_h", h)
    for layer in range(n):
        width = LAYERS[layer + 1]
        unit = lambda j: F.aggregate(  # noqa: E731, B023
            F.transform("_h", lambda x, i: x * F.element_at(f"_w{2 * layer}", (i * width + j + 1).cast("int"))),  # noqa: B023
            F.element_at(f"_w{2 * layer + 1}", (j + 1).cast("int")), lambda acc, x: acc + x)  # noqa: B023
        z = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), unit)
        act = (lambda x: F.greatest(x, F.lit(0.0))) if layer < n - 1 else (lambda x: 1.0 / (1.0 + F.exp(-x)))
        rows = rows.withColumn("_h", F.transform(z, act))
    return rows.withColumn(out, F.element_at("_h", 1)).drop("_h", "_mean", "_std", *[f"_w{i}" for i in range(2 * n)])


def log_loss(scored: DataFrame, prob: str = "prob", label: str = "label") -> DataFrame:
    """M5: one row with the mean cross-entropy of the scored rows."""
    p = F.least(F.greatest(F.col(prob), F.lit(1e-7)), F.lit(1 - 1e-7))
    return scored.agg(F.avg(-F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p))).alias("loss"))


def fixed_ranker(seed: int = 7) -> Ranker:
    """A deterministic untrained ranker with unit scaling (for checks)."""
    ws = init_weights(seed)
    rng = np.random.default_rng(seed + 1)
    ws = [w if w.ndim == 2 else rng.uniform(-0.1, 0.1, size=w.shape) for w in ws]
    return Ranker(ws, np.zeros(4), np.ones(4))


# --- M8 persistence -------------------------------------------------------------

def model_table(spark: SparkSession, ranker: Ranker, cutoff) -> DataFrame:
    """Weights and scaler as rows (cutoff, suffix, part, idx, value); the
    suffix is the cutoff's MMDD, as the reference names its model files."""
    rows = []
    c, sfx = str(as_date(cutoff)), mmdd(cutoff)
    for i, w in enumerate(ranker.weights):
        rows += [(c, sfx, f"w{i}", j, float(x)) for j, x in enumerate(w.ravel())]
    rows += [(c, sfx, "mean", j, float(x)) for j, x in enumerate(ranker.mean)]
    rows += [(c, sfx, "std", j, float(x)) for j, x in enumerate(ranker.std)]
    return spark.createDataFrame(rows, "cutoff string, suffix string, part string, idx long, value double")


def save_ranker(spark: SparkSession, ranker: Ranker, cutoff, path: str) -> None:
    model_table(spark, ranker, cutoff).coalesce(1).write.mode("overwrite").partitionBy("cutoff").parquet(path)


def load_ranker(spark: SparkSession, path: str, cutoff) -> Ranker:
    c = str(as_date(cutoff))
    pdf = spark.read.parquet(path).filter(F.col("cutoff") == c).toPandas()  # 2 441 rows
    def part(name):
        return pdf[pdf.part == name].sort_values("idx")["value"].to_numpy()
    flat = []
    for i in range(2 * (len(LAYERS) - 1)):
        flat.append(part(f"w{i}"))
    return Ranker(unflatten(np.concatenate(flat)), part("mean"), part("std"))
