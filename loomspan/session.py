"""Session construction and table loading."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Python workers give arrays back to the system when they are freed, and so stay small between batches.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": "2097152", "MALLOC_TRIM_THRESHOLD_": "4194304", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster, use the given one."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomspan")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def let_workers_import(spark: SparkSession) -> None:
    """Put this checkout on the Python workers' path, for sessions that were begun without it.

    A cluster gets the package by ``--py-files`` or an installation as usual.
    """
    own = spark.sparkContext.environment
    if ROOT not in own.get("PYTHONPATH", "").split(os.pathsep):
        own["PYTHONPATH"] = os.pathsep.join(x for x in (own.get("PYTHONPATH"), ROOT) if x)


#: Bytes of a batch that goes to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 1 << 20


def prepare(spark: SparkSession) -> None:
    """What the operators want of a session: importable code and Arrow batches of about a megabyte.

    Texts are long, so batches are bounded in bytes; a bound that was set by hand stays.
    """
    let_workers_import(spark)
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "1b") == "1b":
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session may do without the setting."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (base or "file:///tmp/loomspan-shared").rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all cores by a key that tells them apart.

    A row group of a file is read by one task, whatever its rows cost later; narrow rows that pages are
    made of, or that are parsed, are dealt out first.
    """
    spark = rows.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, key)
