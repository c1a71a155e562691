"""Mailbox statistics (P1, P5, A1-A10, W1, O2-O3) over a message table.

Input is the message table ``messages`` (D2): one row per physical message with
``mailbox_id, file_seq, msg_seq, header_valid, sent_hint, from_values,
id_values, label_values``.  Sources (mbox scan, adapters) produce it.

Scale notes
-----------
* Dedup never sorts a whole Message-ID group: the first eligible copy of an ID
  is found with ``min_by`` inside a sort aggregate, which combines map-side, so
  one ID holding a third of all rows collapses to one row per task before the
  shuffle.  Rows without an ID bypass that aggregate entirely (they are never
  merged), so NULL keys never pile into one task.
* Per-file duplicate figures come from one aggregate keyed by
  ``(mailbox, file, id)`` followed by a window over the *aggregated* rows.
* Every output is a grouped table; nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import headers as H


def messages_from_view(v: DataFrame) -> DataFrame:
    """Shape adapter rows (scalar header columns) into the message table D2."""
    def arr(*cols):
        return F.filter(F.array(*[F.col(c) for c in cols]), lambda x: x.isNotNull())

    return v.select(
        "mailbox_id", "file_seq", "msg_seq", "header_valid", "sent_hint",
        arr("from1", "from2").alias("from_values"),
        arr("id1", "id2").alias("id_values"),
        arr("label1", "label2").alias("label_values"),
    )


def message_facts(msgs: DataFrame) -> DataFrame:
    """Per-message facts (D3): parsed labels, Message-ID, sender, sent and eligibility.

    Messages with invalid headers keep only their identity columns: their
    labels and sender statistics are skipped, but they still count as messages.
    """
    valid = F.col("header_valid")
    empty = F.array().cast("array<string>")
    n_from, n_lab = F.size("from_values"), F.size("label_values")
    # Stage 1: parse each header value once.  The usual message has one From
    # and one label header: that path is lambda-free and runs in generated
    # code; several values of one header go through ``transform``.
    parsed = msgs.select(
        "mailbox_id", "file_seq", "msg_seq", "header_valid", "sent_hint", "from_values",
        "label_values",
        F.when(valid & (n_lab == 1), H.split_labels(F.try_element_at("label_values", F.lit(1)))).alias("labels1"),
        F.when(valid & (n_lab > 1), F.transform("label_values", H.split_labels)).alias("labels_n"),
        F.when(valid & (n_from == 1), H.parse_sender(F.try_element_at("from_values", F.lit(1)))).alias("email"),
        F.when(valid & (n_from > 1), F.transform("from_values", H.parse_sender)).alias("from_n"),
        F.when(valid, H.message_id(F.col("id_values"))).alias("message_id"),
    )
    # Stage 2: derive labels and counters from the parsed values.
    derived = parsed.select(
        "mailbox_id", "file_seq", "msg_seq", "header_valid", "sent_hint", "message_id", "email",
        F.when(n_lab == 1, F.coalesce("labels1", empty))
        .when(n_lab > 1, F.flatten(F.filter("labels_n", lambda a: a.isNotNull())))
        .otherwise(empty).alias("labels"),
        F.when(~valid, 0)
        .when(n_lab == 1, F.when(F.col("labels1").isNull(), 1).otherwise(0))
        .when(n_lab > 1, F.size(F.filter("labels_n", lambda a: a.isNull())))
        .otherwise(0).alias("unterminated_labels"),
        F.when(~valid, 0)
        .when(n_from == 1, F.when(F.col("email").isNull(), 1).otherwise(0))
        .when(n_from > 1, F.size(F.filter("from_n", lambda e: e.isNull())))
        .otherwise(0).alias("invalid_from"),
    )
    facts = derived.select(
        "mailbox_id", "file_seq", "msg_seq", "header_valid", "labels", "unterminated_labels",
        "message_id", "email", "invalid_from",
        (valid & H.is_sent(F.col("labels"), F.col("sent_hint"))).alias("is_sent"),
    )
    return facts.withColumn("eligible", F.col("is_sent") & F.col("email").isNotNull())


def sent_messages(facts: DataFrame) -> DataFrame:
    """Valid messages that are sent (by hint or a SENT label)."""
    return facts.where("is_sent").select("mailbox_id", "file_seq", "msg_seq", "email", "message_id")


def first_copies(facts: DataFrame) -> DataFrame:
    """One row per counted unit: (mailbox, email, n).

    Rows with a Message-ID group by (mailbox, id) and keep the sender of the
    first eligible copy (``min_by`` over (file, message) order, n = 1).  Rows
    without an ID are never merged with each other, so they group by
    (mailbox, email) with n = their number.  One aggregate, one scan, and it
    combines map-side for both kinds of rows.

    Only ``is_sent`` is filtered before the aggregate; "has one usable From"
    is applied inside it (a NULL ordering is ignored by ``min_by``), so the
    optimizer never copies the From parser into a pushed-down filter.
    """
    has_id = F.col("message_id").isNotNull()
    usable = F.col("email").isNotNull()
    return (
        facts.where("is_sent")
        .groupBy("mailbox_id", "message_id", F.when(~has_id, F.col("email")).alias("no_id_email"))
        .agg(F.min_by("email", F.when(usable, F.struct("file_seq", "msg_seq"))).alias("first_email"),
             F.count_if(usable).alias("rows"))
        .where(F.col("first_email").isNotNull())
        .select("mailbox_id",
                F.coalesce("no_id_email", "first_email").alias("email"),
                F.when(has_id, F.lit(1)).otherwise(F.col("rows")).alias("n"))
    )


def first_eligible(facts: DataFrame) -> DataFrame:
    """The ids that are counted, with the sender of the first eligible copy: mailbox_id, message_id, email."""
    return (facts.where(F.col("eligible") & F.col("message_id").isNotNull()).groupBy("mailbox_id", "message_id")
            .agg(F.min_by("email", F.struct("file_seq", "msg_seq")).alias("email")))


def sender_counts(facts: DataFrame) -> DataFrame:
    """A3/A10 (flagship): de-duplicated sender counts per mailbox."""
    return first_copies(facts).groupBy("mailbox_id", "email").agg(F.sum("n").cast("long").alias("messages"))


def sender_ranking(counts: DataFrame) -> DataFrame:
    """O2: senders by count descending, then address ascending (a distributed sort)."""
    return counts.orderBy("mailbox_id", F.desc("messages"), "email")


def top_senders(counts: DataFrame, k: int = 3) -> DataFrame:
    """O3: the k top senders per mailbox.

    ``row_number() <= k`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so each task forwards at most k rows per mailbox.
    """
    w = Window.partitionBy("mailbox_id").orderBy(F.desc("messages"), F.asc("email"))
    return (counts.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def id_file_stats(facts: DataFrame) -> DataFrame:
    """Per (mailbox, file, Message-ID) aggregate carrying every per-file counter.

    All rows without an ID share one group per file (they only feed plain
    counters), so the aggregate combines map-side for every row.  ``first_file``
    is the file holding the first eligible copy of the ID in the mailbox, a
    window over the aggregated rows (bounded by files per ID, not copies).
    """
    per = facts.groupBy("mailbox_id", "file_seq", "message_id").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min_by("eligible", "msg_seq").alias("first_eligible"),
        F.max(F.col("eligible").cast("int")).alias("any_eligible"),
        F.count_if(~F.col("header_valid")).alias("invalid_headers"),
        F.sum("invalid_from").alias("invalid_from"),
        F.sum("unterminated_labels").alias("unterminated_labels"),
        F.count_if(F.col("is_sent") & F.col("email").isNull()).alias("sent_without_from"),
    )
    w = Window.partitionBy("mailbox_id", "message_id")
    return per.withColumn(
        "first_file", F.min(F.when(F.col("any_eligible") == 1, F.col("file_seq"))).over(w)
    )


def duplicate_counts(facts: DataFrame) -> DataFrame:
    """A4 + A5 per (mailbox, file): local repeats and cross-file suppressed copies."""
    return _per_file(id_file_stats(facts)).select(
        "mailbox_id", "file_seq", "duplicate_count", "cross_file_duplicates")


def _per_file(s: DataFrame) -> DataFrame:
    has_id = F.col("message_id").isNotNull()
    return s.groupBy("mailbox_id", "file_seq").agg(
        F.sum("copies").alias("message_count"),
        F.sum("invalid_headers").cast("long").alias("invalid_headers"),
        F.coalesce(F.sum(F.when(has_id, F.col("copies") - 1)), F.lit(0)).cast("long")
        .alias("duplicate_count"),
        F.count_if(has_id & F.col("first_eligible") & (F.col("first_file") < F.col("file_seq")))
        .alias("cross_file_duplicates"),
        F.sum("invalid_from").cast("long").alias("invalid_from"),
        F.sum("unterminated_labels").cast("long").alias("unterminated_labels"),
        F.sum("sent_without_from").cast("long").alias("sent_without_from"),
    )


def mailbox_stats(facts: DataFrame) -> DataFrame:
    """A1, A4-A6 and diagnostics counts per (mailbox, file), from one scan."""
    return _per_file(id_file_stats(facts)).select(
        "mailbox_id", "file_seq", "message_count", "invalid_headers", "duplicate_count",
        "cross_file_duplicates", "invalid_from", "unterminated_labels", "sent_without_from")


def label_inventory(facts: DataFrame) -> DataFrame:
    """A2: distinct labels per mailbox, merged across duplicates and files.

    The outer generator keeps the label parser out of a filter below it.
    """
    return facts.select("mailbox_id", F.explode_outer("labels").alias("label")).where(F.col("label").isNotNull()).distinct()


def ordered_labels(labels: DataFrame) -> DataFrame:
    """O1: labels by code point within their mailbox (a distributed sort)."""
    return labels.orderBy("mailbox_id", "label")


def label_rows(facts: DataFrame) -> DataFrame:
    """F2 as a table: one row per parsed label occurrence."""
    return facts.select("mailbox_id", "file_seq", "msg_seq",
                        F.posexplode_outer("labels").alias("pos", "label")).where(F.col("pos").isNotNull())


def warning_summary(stats: DataFrame) -> DataFrame:
    """The distinct diagnostics per (mailbox, file) as (code, count) rows."""
    counted = {"malformed_headers": "invalid_headers", "unterminated_label": "unterminated_labels", "sent_without_from": "sent_without_from",
               "local_duplicates": "duplicate_count", "cross_file_duplicates": "cross_file_duplicates", "invalid_from": "invalid_from"}
    codes = F.array(*[F.struct(F.lit(code).alias("code"), F.col(c).alias("n")) for code, c in counted.items()])
    texts = {
        "malformed_headers": F.lit(K.W_MALFORMED),
        "unterminated_label": F.lit(K.W_UNTERMINATED_LABEL),
        "sent_without_from": F.lit(K.W_SENT_NO_FROM),
        "local_duplicates": F.lit(K.W_LOCAL_DUPES_SHARED),
        "cross_file_duplicates": F.replace(F.lit(K.W_CROSS_DUPES), F.lit("{n}"), F.col("n").cast("string")),
        "invalid_from": F.replace(F.lit(K.W_INVALID_FROM), F.lit("{n}"), F.col("n").cast("string")),
    }
    text = F.when(F.lit(False), F.lit(None))
    for code, t in texts.items():
        text = text.when(F.col("code") == code, t)
    return (
        stats.select("mailbox_id", "file_seq", F.explode(codes).alias("w"))
        .select("mailbox_id", "file_seq", "w.code", F.col("w.n").cast("long").alias("n"))
        .where(F.col("n") > 0)
        .withColumn("text", text)
    )
