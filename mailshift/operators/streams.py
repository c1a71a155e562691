"""Mail as a stream of files (T1-T3) and counting in batches.

The stream keeps, for each Message-ID, its first eligible copy in (file, message) order
as aggregation state; each micro-batch writes the groups that changed to a table
of its own, and the table read is the latest row of each group.  Files may arrive in
any order and in any number of runs: the result is that of one batch over all of them.

Counting in batches keeps the ids that were counted.  A bitmap of fixed size tells
most new ids from counted ones without a shuffle; what its bits let through is
compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import mailbox as MB

UNIT = ["mailbox_id", "message_id", "no_id_email"]
_BITS = 1 << 26  # of the bitmap of counted ids: 8 MB in rows of 4 kB
_BUCKET = 32768


def message_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files that arrive in a folder, as a stream; each file is read once."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def unit_stream(facts: DataFrame) -> DataFrame:
    """The running state of every counted unit: sender of the first eligible copy of an id, or a number of rows without id.

    The same aggregate as ``mailbox.first_copies``, kept per id and not yet reduced to senders.
    """
    usable = F.col("email").isNotNull()
    return (facts.where("is_sent").groupBy("mailbox_id", "message_id", F.when(F.col("message_id").isNull(), F.col("email")).alias("no_id_email"))
            .agg(F.min_by("email", F.when(usable, F.struct("file_seq", "msg_seq"))).alias("first_email"), F.count_if(usable).alias("rows")))


def run_once(units: DataFrame, table: str, checkpoint: str) -> None:
    """Take in every file that has arrived since the last run, then stop.  Changed groups go to a folder of their micro-batch, so a repeated one replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{table}/batch={batch_id:09d}")

    query = units.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_units(spark: SparkSession, table: str) -> DataFrame:
    """The table that the runs have written: the latest row of each unit."""
    rows = spark.read.parquet(table)
    return rows.groupBy(*UNIT).agg(F.max_by(F.struct("first_email", "rows"), "version").alias("u")).select(*UNIT, "u.first_email", "u.rows")


def running_counts(units: DataFrame) -> DataFrame:
    """Senders of all files so far."""
    n = F.when(F.col("message_id").isNotNull(), F.lit(1)).otherwise(F.col("rows"))
    return (units.where(F.col("first_email").isNotNull()).groupBy("mailbox_id", F.coalesce("no_id_email", "first_email").alias("email"))
            .agg(F.sum(n).cast("long").alias("messages")))


# --- counting in batches --------------------------------------------------------------


def _place() -> Column:
    return F.pmod(F.xxhash64("mailbox_id", "message_id"), F.lit(_BITS))


def counted_bitmap(counted: DataFrame) -> DataFrame:
    """The bits of the counted ids: bucket and bitmap, of fixed size however many ids."""
    return (counted.select(F.floor(_place() / _BUCKET).alias("bucket"), (_place() % _BUCKET).alias("bit")).groupBy("bucket")
            .agg(F.bitmap_construct_agg("bit").alias("bitmap")))


def not_counted(rows: DataFrame, counted: DataFrame, bitmap: DataFrame) -> DataFrame:
    """The rows whose (mailbox_id, message_id) has not been counted."""
    place = rows.withColumns({"bucket": F.floor(_place() / _BUCKET), "bit": _place() % _BUCKET})
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    told = (place.join(F.broadcast(bitmap), "bucket", "left")
            .withColumn("maybe", F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1, F.lit(False))).drop("bucket", "bit", "bitmap"))
    # An id whose bit is not set is new; its row is joined with no key.
    key = F.when(F.col("maybe"), F.struct("mailbox_id", "message_id"))
    known = counted.select(F.struct("mailbox_id", "message_id").alias("known"))
    return told.withColumn("key", key).join(known, F.col("key") == F.col("known"), "left_anti").drop("maybe", "key")


def next_batch(facts: DataFrame, counted: DataFrame, bitmap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of a later batch, and the ids that it counts: an id counted before is left out, as is every copy after the first.

    facts: of files that come after all those of earlier batches.
    """
    eligible = facts.where("eligible").select("mailbox_id", "file_seq", "msg_seq", "message_id", "email")
    named = not_counted(eligible.where(F.col("message_id").isNotNull()), counted, bitmap)
    first = named.groupBy("mailbox_id", "message_id").agg(F.min_by("email", F.struct("file_seq", "msg_seq")).alias("email"))
    plain = eligible.where(F.col("message_id").isNull()).select("mailbox_id", "email")
    counts = first.select("mailbox_id", "email").unionByName(plain).groupBy("mailbox_id", "email").agg(F.count(F.lit(1)).alias("messages"))
    return counts, first.select("mailbox_id", "message_id")
