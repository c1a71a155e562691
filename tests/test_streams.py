"""The stream and the batches against one batch over everything."""

import random

from pyspark.sql import functions as F

from mailshift.operators import mailbox as MB
from mailshift.operators import streams as ST

SCHEMA = "mailbox_id long, file_seq int, msg_seq long, is_sent boolean, email string, message_id string, eligible boolean"


def facts(spark, n, seed):
    pick = random.Random(seed)
    rows = []
    for k in range(n):
        email = pick.choice([None, "a@mail.test", "b@mail.test", "c@mail.test"])
        sent = pick.random() < 0.7
        rows.append((pick.randrange(2), pick.randrange(4), k, sent, email, pick.choice([None, f"<{pick.randrange(n // 4)}@mail.test>"]), sent and email is not None))
    return spark.createDataFrame(rows, SCHEMA)


def counts(df):
    return sorted((r.mailbox_id, r.email, r.messages) for r in df.collect())


def test_stream_of_files_in_any_order_equals_one_batch(spark, tmp_path):
    whole = facts(spark, 300, 1)
    landing, table, state = (str(tmp_path / x) for x in ("landing", "units", "state"))
    for lot in (2, 0, 3, 1):  # later files first: the first copy of an id may come last
        whole.where(F.col("file_seq") == lot).repartition(2).write.mode("append").parquet(landing)
        if lot in (0, 1):
            ST.run_once(ST.unit_stream(ST.message_stream(spark, landing, whole.schema, 1)), table, state)
    ST.run_once(ST.unit_stream(ST.message_stream(spark, landing, whole.schema, 1)), table, state)  # nothing new
    units = ST.latest_units(spark, table)
    assert counts(ST.running_counts(units)) == counts(MB.sender_counts(whole))
    got = {(r.mailbox_id, r.message_id, r.first_email) for r in units.where("message_id IS NOT NULL AND first_email IS NOT NULL").collect()}
    assert got == {tuple(r) for r in MB.first_eligible(whole).collect()}


def test_batches_equal_a_recount(spark):
    whole = facts(spark, 400, 2)
    first = whole.where(F.col("file_seq") < 1)
    counted = MB.first_eligible(first).select("mailbox_id", "message_id")
    total = MB.sender_counts(first)
    for k in (1, 2, 3):
        more, ids = ST.next_batch(whole.where(F.col("file_seq") == k), counted, ST.counted_bitmap(counted))
        counted, total = counted.unionByName(ids).checkpoint() if spark.sparkContext.getCheckpointDir() else counted.unionByName(ids), total.unionByName(more)
    assert counts(total.groupBy("mailbox_id", "email").agg(F.sum("messages").alias("messages"))) == counts(MB.sender_counts(whole))


def test_bitmap_lets_no_counted_id_through(spark):
    counted = spark.createDataFrame([(k % 3, f"<{k}>") for k in range(5000)], "mailbox_id long, message_id string")
    rows = spark.createDataFrame([(k % 3, f"<{k}>", k) for k in range(4000, 9000)] + [(7, "<4000>", 1)], "mailbox_id long, message_id string, bit long")
    got = ST.not_counted(rows.withColumnRenamed("bit", "n"), counted, ST.counted_bitmap(counted))
    assert got.columns == ["mailbox_id", "message_id", "n"] and sorted(r.n for r in got.collect()) == sorted([*range(5000, 9000), 1])
    none = counted.limit(0)
    assert ST.not_counted(rows.withColumnRenamed("bit", "n"), none, ST.counted_bitmap(none)).count() == 5001
