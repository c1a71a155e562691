"""What several operators of this folder need: the shared folder, table reads and checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailshift.session import checkpoint_dir

#: The most that is sent to every executor of a table whose size is not fixed.
BROADCAST_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the driver and all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a slim table: computed once, kept in the shared folder, found again if an executor is lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def fits_broadcast(df: DataFrame, *texts: str) -> bool:
    """Whether a table of numbers and the named texts has at most ``BROADCAST_BYTES``, counting 128 bytes a row for the numbers."""
    size = F.lit(128)
    for c in texts:
        size = size + F.coalesce(F.octet_length(c), F.lit(0))
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES
