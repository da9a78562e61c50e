"""Tables and files in the folder that driver and executors share.

The folder comes from ``spark.checkpoint.dir``; only a local session (tests) may do
without that setting. Written tables cut lineage: a lost executor never takes them
along. They stay until the folder is cleared, as a result may be read at any time; those
of a ``scratch``, which only its own steps read, go with it. Files of a table's own shuffles go when it is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomspan/{name}-{uuid.uuid4().hex}"


#: Shuffles of one execution are removed at its end, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str, group_rows: int = 0) -> DataFrame:
    spark = df.sparkSession
    out = df.write.option("compression", "zstd")
    if group_rows:
        out = out.option("parquet.block.row.count.limit", group_rows)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        out.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str, group_rows: int = 0) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Where a row is megabytes, ``group_rows`` bounds what is held at once: Parquet's writer looks at
    the size of what it has only after 100 rows, and a reader takes all rows of a group together.
    """
    return _write(df, new_path(df.sparkSession, name), group_rows)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``materialise`` for steps between: its tables go at the end, when what comes of them is written."""
    folder = new_path(spark, "scratch")
    try:
        yield lambda df, name: _write(df, f"{folder}/{name}-{uuid.uuid4().hex}")
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
