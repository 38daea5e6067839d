"""Session helpers.

On a cluster the session already exists and carries the cluster's settings;
``configure`` only fills in what is missing; ``size_shuffles`` lets the number
of shuffle partitions follow the rows read; ``stored`` writes an intermediate
table and drops the shuffle files behind it.  ``local_session`` is for tests and
the benchmark.
"""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the plans rely on.  AQE re-plans joins from runtime sizes (this is
# the checked broadcast for dimension joins), coalesces small shuffle
# partitions and splits skewed ones.
PLAN_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40, "p": 1 << 50}

#: Rows of the fact table for one shuffle partition.  The stage after its last join sorts the rows and
#: keeps them in two aggregations of about forty columns, some 0.9 KB of task memory a row.
ROWS_PER_PARTITION = 500_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir``; only when the session has none (local
    tests) a fresh scratch folder is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir must name a shared folder on a cluster"
            )
        conf_dir = tempfile.mkdtemp(prefix="cartpulse-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session that hold inside this block only (``**{key: value}``)."""
    old = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def shuffles_dropped(spark: SparkSession):
    """The shuffle files of an action that is planned and run in this block go when it ends.

    Otherwise they stay until the driver next collects garbage, which on a cluster may be never.
    Only for actions whose plan nobody runs again.
    """
    return settings(spark, **{CLEANUP: "true"})


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once as a Parquet table under the shared folder; its shuffle files are dropped.

    Against ``checkpoint`` the copy is compressed by column, later readers open only the columns
    they use, and joins know its size before any row moves.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"stored-{uuid.uuid4().hex}")
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> str:
    """Adds this package to the session's executors, for clusters whose workers do not have it.

    The sources are zipped into the shared folder and added with ``addPyFile``; ``--py-files`` does the same for a whole application.
    """
    here = os.path.dirname(os.path.abspath(__file__))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.join(os.path.basename(here), os.path.relpath(full, here)))
    sc = spark.sparkContext
    path = scratch_path(spark, f"package-{uuid.uuid4().hex}/cartpulse.zip")
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at)
    out.write(raw.getvalue())
    out.close()
    sc.addPyFile(path)
    return path


def configure(spark: SparkSession) -> SparkSession:
    for key, value in PLAN_DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def size_in_bytes(text: str) -> int:
    """A Spark size such as ``64MB``, ``16m`` or ``1048576`` in bytes."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]?)b?\s*", text.lower()).groups()
    return int(number) * UNITS[unit]


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions that a shuffle of this session starts with."""
    sized = spark.conf.get(INITIAL, None) if spark.conf.get("spark.sql.adaptive.enabled") == "true" else None
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(sized or 0))


def size_shuffles(spark: SparkSession, fact: DataFrame) -> int:
    """Lets the shuffles of a query over ``fact`` start with a partition for every ROWS_PER_PARTITION
    rows of it, ``spark.sql.shuffle.partitions`` at least, so that a task's share does not grow with the table.

    The rows are counted from the file footers.  AQE still merges small partitions, up to the advisory size of
    ``PLAN_DEFAULTS``; a larger one in the session is lowered to it, since shuffled rows take some forty times
    their compressed size in a task.
    """
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-fact.count() // ROWS_PER_PARTITION))
    spark.conf.set(INITIAL, str(n))
    if size_in_bytes(spark.conf.get(ADVISORY)) > size_in_bytes(PLAN_DEFAULTS[ADVISORY]):
        spark.conf.set(ADVISORY, PLAN_DEFAULTS[ADVISORY])
    return n


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "cartpulse") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("CARTPULSE_DRIVER_MEM", "8g"))
    )
    for key, value in PLAN_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark
