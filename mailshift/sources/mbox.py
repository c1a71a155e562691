"""Mbox files as messages and header fields (S1-S3, W5): a segmented scan over blocks of lines.

Input: lines ``(mailbox_id, file_id, block, pos, line)``; a block is any run of
consecutive lines of a file (a file split, say), blocks and positions are in file
order.  No file is one task: every block is summed up in one row (envelopes, the
last place where headers open or close, its first text), the rows of a file are
carried forward by a running window over these few rows, and each block is replayed
with what was carried to it.  Lines of bodies lose their text before the shuffle.

A message starts at each envelope line, also in the middle of headers or right
after text.  A file whose first text is a header line begins with a message that
has no envelope; other text before the first envelope belongs to none.  Headers end
at an empty line; a line that is no header, or a continuation with no header before
it, ends them too and makes them invalid, as does having none.  Limits are
parameters, and verdicts: a line over ``max_line`` ends the headers, and a message
over either limit is flagged and invalid, but none of its rows is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import js_trim, utf16_length

FILE = ["mailbox_id", "file_id"]
MESSAGE = [*FILE, "msg_seq"]


def read_lines(spark: SparkSession, path: str, mailbox_id: Column) -> DataFrame:
    """Lines of mbox files in splits: the block is where a split starts in its file.

    ``mailbox_id`` may use the column ``path``.  A byte order mark before the first line is no part of it.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), "value")
    text = F.make_valid_utf8("value")
    return raw.select(mailbox_id.alias("mailbox_id"), F.col("path").alias("file_id"), "block", "pos", F.regexp_replace(text, "\\A\ufeff", "").alias("line"))


def classified(lines: DataFrame, max_line: int | None = None) -> DataFrame:
    """kind, size and (for lines that may be part of a header) text of each line."""
    t = F.regexp_replace("line", r"\r\z", "")
    rows = lines.select(*FILE, "block", "pos", t.alias("t"), utf16_length(t).alias("size"))
    long = F.lit(False) if max_line is None else F.col("size") > max_line
    kind = (F.when(long, "long").when(F.col("t") == "", "blank").when(F.col("t").rlike(K.ENVELOPE), "envelope")
            .when(F.col("t").rlike(r"\A[ \t]"), "continuation").when(F.col("t").rlike(K.HEADER), "header").otherwise("other"))
    rows = rows.withColumn("kind", kind)
    return rows.select(*FILE, "block", "pos", "size", "kind", F.when(F.col("kind").isin("header", "continuation"), F.col("t")).alias("text"))


def _closes(before: Column) -> Column:
    """Whether a line ends headers, given the kind of the line before it."""
    return F.col("kind").isin("blank", "other", "long") | ((F.col("kind") == "continuation") & F.coalesce(before == "envelope", F.lit(False)))


def _carried(blocks: DataFrame) -> DataFrame:
    """What each block begins with, from the summaries of the blocks before it: one row for each block."""
    earlier = Window.partitionBy(*FILE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(*FILE).orderBy("block")
    told = blocks.select(
        "*", F.coalesce(F.sum("envelopes").over(earlier), F.lit(0)).alias("envelopes_before"), F.lag("last_kind").over(order).alias("kind_before"),
        (F.col("first_text").isNotNull() & (F.coalesce(F.max(F.col("first_text").isNotNull()).over(earlier), F.lit(False)) == F.lit(False))).alias("begins"))
    # The first text of a file opens a message by itself if it is a header line.
    told = told.withColumn("bare_start", F.when(F.col("begins") & (F.col("first_text.kind") == "header"), F.col("first_text.pos")))
    opened = F.greatest("last_envelope", "bare_start")
    state = (F.when(opened.isNotNull(), F.col("last_close").isNull() | (opened > F.col("last_close"))).when(F.col("last_close").isNotNull(), F.lit(False))
             .when((F.col("first_kind") == "continuation") & (F.col("kind_before") == "envelope"), F.lit(False)))
    told = told.withColumn("state", state)
    return told.select(*FILE, "block", "kind_before", "bare_start",
                       (F.col("envelopes_before") + F.coalesce(F.max(F.col("bare_start").isNotNull().cast("int")).over(earlier), F.lit(0))).alias("messages_before"),
                       F.coalesce(F.last("state", ignorenulls=True).over(earlier), F.lit(False)).alias("open_before"))


def message_lines(lines: DataFrame, max_line: int | None = None) -> DataFrame:
    """The lines that open a message and those of its headers: msg_seq (from 1), pos, kind, starts, closes, size, text."""
    rows = classified(lines, max_line)
    own = Window.partitionBy(*FILE, "block").orderBy("pos")
    rows = rows.withColumn("last", F.lag("kind").over(own))
    at = F.col("pos")
    blocks = rows.groupBy(*FILE, "block").agg(
        F.count_if(F.col("kind") == "envelope").alias("envelopes"), F.max(F.when(F.col("kind") == "envelope", at)).alias("last_envelope"),
        F.max(F.when(_closes(F.col("last")), at)).alias("last_close"), F.min_by("kind", "pos").alias("first_kind"), F.max_by("kind", "pos").alias("last_kind"),
        F.min(F.when(F.col("kind") != "blank", F.struct("pos", "kind"))).alias("first_text"))
    told = rows.join(_carried(blocks), [*FILE, "block"])
    told = told.withColumn("closes", _closes(F.coalesce("last", "kind_before")))
    told = told.withColumn("starts", (F.col("kind") == "envelope") | F.coalesce(at == F.col("bare_start"), F.lit(False)))
    until = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumns({
        "msg_seq": F.col("messages_before") + F.count_if("starts").over(until),
        "opened": F.max(F.when(F.col("starts"), at)).over(until), "closed": F.max(F.when(F.col("closes"), at)).over(before)})
    within = F.when(F.col("opened").isNotNull(), F.col("closed").isNull() | (F.col("opened") > F.col("closed"))).otherwise(F.col("open_before") & F.col("closed").isNull())
    told = told.withColumn("in_headers", (F.col("kind") != "envelope") & within)
    return told.where("starts OR in_headers").select(*MESSAGE, "pos", "kind", "starts", "in_headers", "closes", "size", "text")


def _parts() -> list[Column]:
    """What the bounds of a message are summed up from, over any part of its lines."""
    inside = F.col("in_headers")
    return [F.count_if(inside & (F.col("kind") == "header")).alias("header_count"),
            F.coalesce(F.sum(F.when(inside, F.col("size") + 2)), F.lit(0)).cast("long").alias("header_chars"),
            F.max(inside & F.col("closes") & (F.col("kind") != "blank")).alias("broken"), F.max(inside & (F.col("kind") == "long")).alias("long_line")]


def _verdicts(max_headers: int | None) -> list[Column]:
    over = F.col("long_line") | (F.lit(False) if max_headers is None else F.col("header_chars") > max_headers)
    return [over.alias("over_bounds"), (~over & ~F.col("broken") & (F.col("header_count") > 0)).alias("header_valid")]


def message_bounds(rows: DataFrame, max_headers: int | None = None) -> DataFrame:
    """One row a message: header_count, header_chars (each line counts two more), over_bounds and header_valid.

    rows: from ``message_lines``.
    """
    return rows.groupBy(*MESSAGE).agg(*_parts()).select(*MESSAGE, "header_count", "header_chars", *_verdicts(max_headers))


def _fields(rows: DataFrame, *others: Column) -> DataFrame:
    """For each message and field_seq: head and more, the field's header line and continuations, and other aggregates over all lines up to the next field.

    Lines before the first field have field_seq 0, and no head.
    """
    own = F.col("in_headers") & ~F.col("closes")
    order = Window.partitionBy(*MESSAGE).orderBy("pos")
    parts = rows.withColumn("field_seq", F.count_if(own & (F.col("kind") == "header")).over(order))
    first = F.first(F.when(own & (F.col("kind") == "header"), F.col("text")), ignorenulls=True)
    more = F.array_sort(F.collect_list(F.when(own & (F.col("kind") == "continuation"), F.struct("pos", js_trim(F.col("text")).alias("t")))))
    return parts.groupBy(*MESSAGE, "field_seq").agg(first.alias("head"), more.alias("more"), *others)


def _name_and_value() -> list[Column]:
    return [F.lower(F.regexp_extract("head", K.HEADER, 1)).alias("name"),
            F.concat_ws(" ", F.regexp_extract("head", K.HEADER, 2), F.transform("more", lambda x: x["t"])).alias("value")]


def header_fields(rows: DataFrame) -> DataFrame:
    """Fields of each message in order: field_seq (from 1), name (lower case) and value, unfolded.

    A field is an island of lines: its header line and the continuations up to the next header line.
    """
    return _fields(rows.where("in_headers AND NOT closes")).select(*MESSAGE, "field_seq", *_name_and_value())


def mbox_messages(lines: DataFrame, max_line: int | None = None, max_headers: int | None = None) -> DataFrame:
    """The message table of mbox lines: msg_seq, header_count, header_valid, over_bounds, from_values, id_values and label_values."""
    # Bounds and fields come from one pass: each line goes to its message once, and both aggregates are made there.
    fields = _fields(message_lines(lines, max_line), *_parts()).select(
        *MESSAGE, "field_seq", "header_count", "header_chars", "broken", "long_line", *_name_and_value())

    def values(name: str) -> Column:
        found = F.array_sort(F.collect_list(F.when(F.col("name") == name, F.struct("field_seq", "value"))))
        return F.transform(found, lambda x: x["value"]).alias(name)

    per = fields.groupBy(*MESSAGE).agg(
        F.sum("header_count").alias("header_count"), F.sum("header_chars").alias("header_chars"), F.max("broken").alias("broken"), F.max("long_line").alias("long_line"),
        values("from").alias("from_values"), values("message-id").alias("id_values"), values("x-gmail-labels").alias("label_values"))
    return per.select(*MESSAGE, "header_count", "header_chars", *_verdicts(max_headers), "from_values", "id_values", "label_values")
