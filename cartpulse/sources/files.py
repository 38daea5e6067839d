"""File sources and sinks.

The history arrives as delimited text with dates like ``24-Nov-25`` and
free-form numbers; everything is read as text with an explicit schema (no
inference pass) and parsed with try-functions, so bad cells become null
(dates, ids) or 0.0 (measures) instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartpulse.functions import arrays as A

# Column names of the raw history file and their canonical names (fixed values).
RAW_COLUMNS = {
    "CODIGO_FAMILIA": "family_id",
    "COD_SUBCATEGORIA": "subcat_id",
    "NOMBRE_SUBCATEGORIA": "subcat_name",
    "COD_CATEGORIA": "category_id",
    "COD_UNIDAD_COMERCIAL": "unit_id",
    "COD_ITEM": "item_id",
    "DIM_FACTURA": "invoice_id",
    "COD_LOCAL": "store_id",
    "DIM_PERIODO": "day",
    "CANTIDAD_SUELTA": "qty",
    "PVP": "list_price",
    "VENTA_NETA": "net_sales",
    "DESCUENTO": "discount",
}
# Column names of the reference's feature table, by our names (fixed values).
FEATURE_TABLE_NAMES = {
    "family_id": "nucleo",
    "subcat_id": "COD_SUBCATEGORIA",
    "recency": "recencia_hl",
    "frequency": "freq_score",
    "sow": "sow_24m",
    "season": "season_ratio",
    "score": "score_final",
    "cycle_days": "Ciclos_ciclo_dias",
    "recency_penalty": "Recencia_castigo_recencia",
    "last_over_cycle": "Recencia_l_compra_sobre_ciclo",
    "days_since_last": "Recencia_dias_desde_ultima_compra",
    "recency_base": "Recencia_recencia",
    "freq_expected": "Freq_avg_compras",
    "freq_lines": "Freq_compras",
    "freq_ratio": "Freq_ratio",
    "sow_weighted_lines": "Sow_transacciones_netas",
    "season_regularity": "Seasonality_puntaje",
    "season_threshold": "Seasonality_umbral",
    "season_cv": "Seasonality_CV",
    "season_gap_mean": "Seasonality_mean_indices_picos",
    "season_gap_std": "Seasonality_std_indices_picos",
    "penalty_strength": "Ciclos_fuerza_castigo",
    "penalty_mean": "Ciclos_media_castigo",
    "penalty_std": "Ciclos_std_castigo",
    "gaps_days": "Ciclos_diferencias",
    "gaps_clipped_days": "Ciclos_diferencias_castigadas",
    "season_series": "Seasonality_serie",
    "season_bits": "Seasonality_bits",
    "season_thinned": "Seasonality_bits_filtrados",
    "season_peak_gaps": "Seasonality_indices_picos",
}
ID_COLUMNS = ["family_id", "subcat_id", "category_id", "unit_id", "item_id", "invoice_id", "store_id"]
MEASURES = ["qty", "list_price", "net_sales", "discount"]
DEFAULT_DATE_FORMAT = "d-MMM-yy"


def text_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def two_digit_year_pivot(day, date_format: str):
    """Two-digit years follow the C/Python convention: 69-99 -> 1969-1999,
    00-68 -> 2000-2068 (Spark's parser would put 95 in 2095)."""
    if "yy" not in date_format or "yyyy" in date_format:
        return day
    return F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)


def _named(raw: DataFrame, names: dict[str, str] | None) -> DataFrame:
    return raw.withColumnsRenamed({k: v for k, v in (names or RAW_COLUMNS).items() if k in raw.columns and k != v})


def _typed(df: DataFrame, date_format: str) -> list:
    """One column for each column of a renamed text table: dates (bad -> null), measures (bad -> 0.0), ids to long."""
    cols = []
    for c in df.columns:
        if c in ID_COLUMNS:
            cols.append(F.expr(f"try_cast(trim(`{c}`) AS BIGINT)").alias(c))
        elif c in MEASURES:
            cols.append(F.coalesce(F.expr(f"try_cast(trim(`{c}`) AS DOUBLE)"), F.lit(0.0)).alias(c))
        elif c == "day":
            cols.append(two_digit_year_pivot(
                F.to_date(F.expr(f"try_to_timestamp(trim(`{c}`), '{date_format}')")), date_format).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return cols


def parse_purchases(raw: DataFrame, date_format: str = DEFAULT_DATE_FORMAT,
                    names: dict[str, str] | None = None) -> DataFrame:
    """S3-S5 on a text table: rename, parse dates (bad -> null), coerce
    measures (bad -> 0.0), ids to long, drop rows without day/family/subcat."""
    df = _named(raw, names)
    return df.select(*_typed(df, date_format)).dropna(subset=["day", "family_id", "subcat_id"])


#: Why a row is rejected, by the first of its required columns that does not parse.
REASONS = {"day": "day", "family": "family_id", "subcat": "subcat_id"}


def split_purchases(raw: DataFrame, path: str, date_format: str = DEFAULT_DATE_FORMAT,
                    names: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """S3-S5 in one pass: (accepted lines, rejected rows with their reason, counts).

    The text is read once: every row is written under ``path`` as accepted (typed) or rejected
    (as text, with the reason), and the counts of accepted rows and of each reason
    are observed during that write.  Reading either side opens its own files only.
    """
    df = _named(raw, names)
    typed = df.select(F.struct(*_typed(df, date_format)).alias("line"), F.struct(*df.columns).alias("text"))
    why = F.coalesce(*[F.when(F.col(f"line.{c}").isNull(), reason) for reason, c in REASONS.items()])
    rows = typed.withColumn("reason", why).select(
        F.when(F.col("reason").isNull(), F.col("line")).alias("line"), F.when(F.col("reason").isNotNull(), F.col("text")).alias("text"), "reason",
        F.when(F.col("reason").isNull(), "accepted").otherwise("rejected").alias("side"))
    seen = Observation()
    counts = [F.count_if(F.col("reason").isNull()).alias("accepted"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS]]
    rows.observe(seen, *counts).write.mode("overwrite").partitionBy("side").parquet(path)
    stored = raw.sparkSession.read.schema(rows.schema).parquet(path)
    accepted = stored.filter("side = 'accepted'").select("line.*")
    rejected = stored.filter("side = 'rejected'").select("text.*", "reason")
    return accepted, rejected, {k: int(v) for k, v in seen.get.items()}


def text_table(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", sep: str = ",") -> DataFrame:
    """The raw columns of a delimited text with a header, all as text."""
    return spark.read.option("header", True).option("encoding", encoding).option("sep", sep).csv(path)


def read_purchases(spark: SparkSession, path: str, date_format: str = DEFAULT_DATE_FORMAT,
                   encoding: str = "ISO-8859-1", sep: str = ",", columns=None) -> DataFrame:
    """The purchase history file(s); a missing path fails the read."""
    header = spark.read.option("header", True).option("encoding", encoding).option("sep", sep) \
        .csv(path).columns if columns is None else list(columns)
    raw = (
        spark.read.schema(text_schema(header)).option("header", True).option("encoding", encoding)
        .option("sep", sep).option("mode", "PERMISSIVE").csv(path)
    )
    return parse_purchases(raw, date_format)


def rejected_rows(spark: SparkSession, path: str, date_format: str = DEFAULT_DATE_FORMAT,
                  encoding: str = "ISO-8859-1", sep: str = ",") -> DataFrame:
    """Rows the parser drops, with the reason (for auditing S3/S5)."""
    raw = spark.read.option("header", True).option("encoding", encoding).option("sep", sep).csv(path)
    for src, dst in RAW_COLUMNS.items():
        if src in raw.columns:
            raw = raw.withColumnRenamed(src, dst)
    day = F.expr(f"try_to_timestamp(trim(day), '{date_format}')")
    return raw.withColumn(
        "reason",
        F.when(day.isNull(), "day").when(F.expr("try_cast(trim(family_id) AS BIGINT)").isNull(), "family")
        .when(F.expr("try_cast(trim(subcat_id) AS BIGINT)").isNull(), "subcat"),
    ).filter(F.col("reason").isNotNull())


def write_purchases_text(lines: DataFrame, path: str, date_format: str = "dd-MMM-yy",
                         encoding: str = "ISO-8859-1") -> None:
    """Write canonical lines back in the raw text layout (S13 for the history)."""
    inverse = {v: k for k, v in RAW_COLUMNS.items()}
    cols = []
    for c in lines.columns:
        if c not in inverse:
            continue
        if c == "day":
            cols.append(F.date_format("day", date_format).alias(inverse[c]))
        else:
            cols.append(F.col(c).cast("string").alias(inverse[c]))
    lines.select(*cols).write.mode("overwrite").option("header", True).option("encoding", encoding).csv(path)


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema=None) -> DataFrame:
    """Parquet or delimited text (header, explicit schema if given)."""
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    return reader.format(fmt).load(path)


def rename_present(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename only the columns that exist."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def select_present(df: DataFrame, wanted) -> DataFrame:
    """Keep the wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> None:
    """Overwrite a table; spreadsheets are re-aimed to csv/parquet."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def arrays_as_text(df: DataFrame) -> DataFrame:
    """Array columns joined by commas, for text formats that hold no arrays."""
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else None
        text = A.join_doubles(f"`{f.name}`") if isinstance(kind, (T.DoubleType, T.FloatType)) else A.join_longs(f"`{f.name}`")
        cols.append(A.col(text).alias(f.name) if kind is not None else F.col(f"`{f.name}`"))
    return df.select(*cols)


def write_family_store(df: DataFrame, path: str, buckets: int = 256, key: str = "family_id") -> None:
    """A result stored for look-ups by family.

    Rows go to directories ``of=<buckets>/bucket=<hash of the family>``; the number of
    directories does not grow with the families.  Inside a bucket the rows are sorted by family, over
    as many files as the range partitioning gives (a family of a third of the table spans several), so a look-up
    opens one bucket and skips the row groups of other families by their statistics.
    """
    rows = df.withColumns({"of": F.lit(buckets), "bucket": family_bucket(F.col(key), buckets)})
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["bucket", key, *[c for c in df.columns if c != key]]
    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("of", "bucket").parquet(path)


def family_bucket(family, buckets: int):
    return F.pmod(F.xxhash64(family.cast("bigint")), F.lit(buckets)).cast("int")


def stored_families(spark: SparkSession, path: str, families, key: str = "family_id") -> DataFrame:
    """The rows of some families of a store: a read of their buckets only, pruned further by row group."""
    store = spark.read.parquet(path)
    hit = F.lit(False)
    for f in families:
        one = F.lit(int(f)).cast("bigint")
        hit = hit | ((F.col("bucket") == F.pmod(F.xxhash64(one), F.col("of"))) & (F.col(key) == one))
    return store.filter(hit).drop("of", "bucket")


def convert(spark: SparkSession, src: str, dst: str, src_fmt: str = "csv", dst_fmt: str = "parquet") -> None:
    """Convert a table between formats in one distributed job."""
    write_table(read_table(spark, src, src_fmt), dst, dst_fmt)
