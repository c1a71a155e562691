"""Archive entry audit (S6), all-or-nothing extraction (S7) and batch budget.

Input: archive directory entries ``(batch_id, archive_id, entry_seq,
entry_name, uncompressed, compressed, method, flags)`` in directory order —
e.g. listed per archive by a ``mapInPandas`` over ``binaryFile`` rows.

Scale: entries are shuffled once, by archive; the running sum streams over the
sorted entries, and counts and sums always cover every entry.  Limits are
verdicts, and only where they are given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def _wanted(name):
    lower = F.lower(name)
    return (~name.endswith("/") & (lower.endswith(".xml") | lower.endswith(".mbox"))
            & ~name.startswith("__MACOSX/"))


@dataclass(frozen=True)
class Limits:
    """Limits that an archive is held against; None is no limit."""

    entries: int | None = None
    entry_bytes: int | None = None
    archive_bytes: int | None = None


REFERENCE = Limits(K.MAX_ENTRIES, K.MAX_ENTRY, K.MAX_EXPANDED)


def _over(value: Column, limit: int | None) -> Column:
    return F.lit(False) if limit is None else value > limit


def _checked(entries: DataFrame, limits: Limits) -> DataFrame:
    """Entries with wanted and error, the first check that each fails (declared sizes)."""
    w = (Window.partitionBy("batch_id", "archive_id").orderBy("entry_seq")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    e = entries.withColumn("wanted", _wanted(F.col("entry_name"))).withColumn(
        "running", F.sum(F.when(F.col("wanted"), F.col("uncompressed")).otherwise(F.lit(0))).over(w))
    error = (F.when(F.col("entry_name").endswith("/") & (F.col("uncompressed") > 0), F.lit("directory_with_data"))
             .when(F.col("wanted") & _over(F.col("uncompressed"), limits.entry_bytes), F.lit("entry_too_large"))
             .when(F.col("wanted") & _over(F.col("running"), limits.archive_bytes), F.lit("archive_too_large"))
             .when(F.col("wanted") & (((F.col("flags") % 2) == 1) | ~F.col("method").isin(0, 8)),
                   F.lit("unsupported_method"))
             .when(F.col("wanted") & (F.col("method") == 0) & (F.col("compressed") != F.col("uncompressed")),
                   F.lit("stored_size_mismatch")))
    return e.withColumn("error", error)


def entry_audit(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per-archive verdict with the first failing check; sums cover every entry whatever the verdict."""
    bad = F.col("error").isNotNull()
    per = _checked(entries, limits).groupBy("batch_id", "archive_id").agg(
        F.count(F.lit(1)).alias("entry_count"),
        F.sum(F.when(F.col("wanted"), F.col("uncompressed")).otherwise(F.lit(0))).cast("long").alias("expanded"),
        F.count_if("wanted").alias("accepted_count"),
        F.min(F.when(bad, F.struct("entry_seq", "error"))).alias("first"))
    many = _over(F.col("entry_count"), limits.entries)
    return per.select(
        "batch_id", "archive_id", "entry_count", "expanded", "accepted_count",
        F.when(many, F.lit("too_many_entries")).otherwise(F.col("first.error")).alias("error"),
        F.when(~many, F.col("first.entry_seq")).alias("error_entry"),
    ).withColumn("ok", F.col("error").isNull())


def archive_files(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The wanted entries, each with kept: false throughout an archive with any bad entry."""
    whole = Window.partitionBy("batch_id", "archive_id")
    kept = F.min(F.col("error").isNull()).over(whole)
    if limits.entries is not None:
        kept = kept & (F.count(F.lit(1)).over(whole) <= limits.entries)
    return (_checked(entries, limits).withColumn("kept", kept).where("wanted")
            .select("batch_id", "archive_id", "entry_seq", "entry_name", "uncompressed", "kept"))


def atomic_files(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Wanted entries of archives that passed; one bad entry discards its whole archive."""
    return archive_files(entries, limits).where("kept").drop("kept")


def batch_budget(audit: DataFrame, max_bytes: int) -> DataFrame:
    """Archives taken in selection order while the batch total stays within max_bytes.

    A refused archive (bad, or over budget) does not consume budget, so this is
    greedy and no window sum: each batch is read as a sorted stream, of which a task
    holds one running total.
    """
    rows = audit.select("batch_id", "archive_id", "expanded", "ok").repartition("batch_id").sortWithinPartitions("batch_id", "archive_id")

    def take(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_id, total = None, 0
        for part in parts:
            taken = []
            for batch, size, ok in zip(*(part.column(c).to_pylist() for c in ("batch_id", "expanded", "ok"))):
                if batch != batch_id:
                    batch_id, total = batch, 0
                taken.append(ok and total + size <= max_bytes)
                total += size if taken[-1] else 0
            yield pa.RecordBatch.from_arrays([part.column("batch_id"), part.column("archive_id"), pa.array(taken, pa.bool_())], names=["batch_id", "archive_id", "taken"])

    kinds = {f.name: f.dataType.simpleString() for f in audit.schema}
    return rows.mapInArrow(take, f"batch_id {kinds['batch_id']}, archive_id {kinds['archive_id']}, taken boolean")


def expanded_inputs(files: DataFrame, entries: DataFrame, budget: DataFrame) -> DataFrame:
    """The admitted files and the entries of archives that were taken, as one list of inputs.

    files: of ``files.admission``; entries: of ``atomic_files``; budget: of ``batch_budget``.
    """
    whole = files.where(F.col("verdict") == "accepted").select(F.lit(None).cast("bigint").alias("archive_id"), F.col("path").alias("name"), "size")
    taken = budget.where("taken").select("batch_id", "archive_id")
    inside = entries.join(taken, ["batch_id", "archive_id"]).select("archive_id", F.col("entry_name").alias("name"), F.col("uncompressed").alias("size"))
    return whole.unionByName(inside)
