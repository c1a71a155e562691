"""Mixing of sources to target weights (operator 4), in DataFrame operations only.

Method: hash-threshold histograms.  Every document gets a fixed hash; its source
takes it again if the hash lies under the source's threshold.  The threshold is
found on histograms: words are summed by source and hash bucket, the running sum
names the bucket in which the budget runs out, and only that bucket is summed
again in finer buckets, ``LEVELS`` times.  The documents are then filtered by
their own hash; nothing is sorted and no group is gathered.  Two documents fall
on the same side of a threshold or not whatever else is in the corpus, so a
larger budget of the same source always holds the smaller one.

Targets: the sources, by code point with null last, weigh 5, 2, 1, 5, 2, 1 and so
on and share ``share`` of all words.  No target passes ``limit`` times the words
of its source; what is over goes to the others by weight.  That is the level t at
which the sum of min(limit * size, weight * t) meets the budget; it is found by
running sums over the sources in the order in which they reach their limits.  The
table of sources (a row for each) is the only thing that is ordered as a whole.

A document is taken floor(target / source size) times, and once more if its hash
is under the threshold.  What is left over of the last bucket (one in 2**36 of a
source) is taken or not, whichever comes nearer.

Defined results: null texts have size 0 and are taken 0 words; documents with the
same id share a hash; a null source is a source of its own, the last; an empty
table gives no rows; other columns are ignored (``mix``: carried along).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fits_broadcast, keep

#: A word: characters other than white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Bits of the hash, bits that each histogram adds, and histograms.
HASH_BITS, BITS, LEVELS = 60, 12, 3
SALTS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def fixed_hash(key: Column) -> Column:
    """60 bits of the key's digest, the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, *, share: float = 1.5, limit: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """From rows of no_source, source_key and size: source_size and target of each source."""
    sources = sizes.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"))
    everywhere = Window.partitionBy()
    place = F.row_number().over(Window.orderBy("no_source", "source_key")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumn("weight", weight).withColumn("cap", F.lit(limit) * F.col("source_size"))
    level = ((F.lit(share) * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    sources = sources.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    # The first source that stays under its limit has the common level; further on, the running sums only fall.
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(everywhere)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * common)
    return sources.select("no_source", "source_key", "source_size", target.alias("target"))


def _boundary(histogram: DataFrame, targets: DataFrame, level: int) -> DataFrame:
    """For each source, the bucket in which its budget runs out: bucket, what comes before it, and its own words."""
    source = Window.partitionBy("no_source", "source_key")
    running = F.sum("words").over(source.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    passed = (histogram.withColumn("through", running + F.col("before"))
              .where(F.col("through") > F.col("extra"))
              .groupBy("no_source", "source_key").agg(F.min_by(F.struct("bucket", "through", "words"), "bucket").alias("at")))
    return (targets.drop("bucket", "before", "own").join(passed, ["no_source", "source_key"], "left")
            # With no bucket left over, all of the source is under its budget.
            .select(*[c for c in targets.columns if c not in ("bucket", "before", "own")],
                    F.coalesce("at.bucket", F.lit(1 << BITS * level)).alias("bucket"),
                    F.coalesce(F.col("at.through") - F.col("at.words"), F.lit(0)).alias("before"), F.coalesce("at.words", F.lit(0)).alias("own")))


def thresholds(sizes: DataFrame, **how) -> DataFrame:
    """For each source: source_size, target, whole (times that all of it is taken) and under (the threshold of the hash's first 36 bits)."""
    targets = source_targets(sizes, **how)
    targets = keep(targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
                   .withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")))
    at = targets.withColumn("before", F.lit(0))
    for level in range(1, LEVELS + 1):
        bucket = F.shiftright(F.col("hash"), HASH_BITS - BITS * level)
        rows = sizes.where("size > 0").withColumn("fine", bucket)
        if level > 1:
            rows = rows.withColumn("bucket", F.shiftright(F.col("hash"), HASH_BITS - BITS * (level - 1)))
            # The boundary bucket alone is refined; the finer buckets keep its rows apart from hot sources.
            rows = rows.join(at.select("no_source", "source_key", "bucket"), ["no_source", "source_key", "bucket"])
        histogram = rows.groupBy("no_source", "source_key", F.col("fine").alias("bucket")).agg(F.sum("size").alias("words"))
        known = at.select("no_source", "source_key", "extra", "before")
        at = keep(_boundary(histogram.join(known, ["no_source", "source_key"]), at, level))
    nearer = F.col("before") + F.col("own") - F.col("extra") <= F.col("extra") - F.col("before")
    return at.select("no_source", "source_key", "source_size", "target", "whole",
                     (F.col("bucket") + F.when((F.col("own") > 0) & nearer, 1).otherwise(0)).alias("under"))


def _keys(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(source_col).isNull().alias("no_source"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source_key"),
            word_count(F.col(text_col)).alias("size"), fixed_hash(F.col(id_col)).alias("hash")]


def _decided(sizes: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows of sizes with source_size, target and copies.

    The table of sources goes to the rows if its size allows it, so that documents are not shuffled; a longer one is joined by
    source and salt, which keeps a hot source from one task.  The result is the same.
    """
    keys = ["no_source", "source_key"]
    if fits_broadcast(limits, "source_key"):
        rows = sizes.join(F.broadcast(limits), keys)
    else:
        dealt = limits.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
        rows = sizes.withColumn("salt", (F.col("hash") % SALTS).cast("int")).join(dealt, [*keys, "salt"]).drop("salt")
    copies = F.col("whole") + F.when(F.shiftright(F.col("hash"), HASH_BITS - BITS * LEVELS) < F.col("under"), 1).otherwise(0)
    return rows.withColumn("copies", copies).drop("whole", "under")


def mixture(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """For each document: its id, source, size, source_size, target (its source's), copies, and taken (words, copies counted)."""
    sizes = keep(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *_keys(docs, id_col, text_col, source_col)))
    return (_decided(sizes, thresholds(sizes, **how))
            .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed documents with all their columns: each as often as the mix takes it, those without words not at all."""
    keys = _keys(docs, id_col, text_col, source_col)
    sizes = keep(docs.select(*keys))
    limits = thresholds(sizes, **how)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")
    taken = F.when(F.col("size") > 0, F.col("copies")).otherwise(0).cast("int")
    return (_decided(docs.select(row, *keys), limits).withColumn("copy", F.explode(F.array_repeat(F.lit(1), taken))).select("document.*"))
