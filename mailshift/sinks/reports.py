"""Report rows (K1, K2, K6, K7, P4): what the exports hold, as distributed rows and never one collected text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K

_ADDRESS = r"[^\s<>\"'()]+@[^\s<>\"'()]+"


def csv_text(c: Column) -> Column:
    """A quoted CSV field; a leading formula sign gets an apostrophe."""
    safe = F.regexp_replace(F.coalesce(c, F.lit("")), r"^([=+\-@])", "'$1")
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def sender_lines(senders: DataFrame) -> DataFrame:
    """K1: the sender table of each mailbox in rows: mailbox_id, place and text.

    Place 0 is the header; every other text begins with its line break, so the texts in order
    are the file as it is.  senders: mailbox_id, email, messages and, where known, confidence and sources (a list).
    """
    known = set(senders.columns)
    confidence = F.col("confidence") if "confidence" in known else F.lit("")
    sources = F.array_join("sources", " ") if "sources" in known else F.lit("")
    line = F.concat_ws(",", csv_text(F.col("email")), F.col("messages").cast("string"), csv_text(confidence), csv_text(sources))
    ranked = senders.select("mailbox_id", F.row_number().over(Window.partitionBy("mailbox_id").orderBy(F.desc("messages"), "email")).alias("place"), line.alias("line"))
    own = F.struct("place", F.concat(F.lit("\r\n"), "line").alias("text"))
    head = F.when(F.col("place") == 1, F.struct(F.lit(0).alias("place"), F.lit(K.CSV_HEADER).alias("text")))
    return ranked.select("mailbox_id", F.inline(F.array_compact(F.array(head, own))))


def manifest_rows(mapping: DataFrame) -> DataFrame:
    """Each mapping as a manifest entry; without a folder it is among the omitted."""
    mapped = F.coalesce(F.col("folder"), F.lit("")) != ""
    entry = F.when(mapped, F.to_json(F.struct(F.col("label").alias("gmailLabel"), F.col("folder").alias("targetFolder"), F.lit(True).alias("create"), "notes"))).otherwise(
        F.to_json(F.struct(F.col("label").alias("gmailLabel"), "notes")))
    return mapping.select("mailbox_id", "label", F.when(mapped, "folders").otherwise("omitted").alias("part"), entry.alias("entry"))


def manifest_heads(mailboxes: DataFrame) -> DataFrame:
    """K2: the head of each mailbox's manifest: target, its label and verify status, archive and trash folder, notes.

    mailboxes: mailbox_id, the t_ columns of ``targets.with_target``, and archive_folder and trash_folder (null: the target's).
    """
    entry = F.to_json(F.struct(
        F.lit(1).alias("version"), F.col("t_id").alias("target"), F.col("t_label").alias("targetLabel"), F.col("t_verifyStatus").alias("targetVerifyStatus"),
        F.coalesce("archive_folder", "t_archiveFolder").alias("archiveFolder"), F.coalesce("trash_folder", "t_trashFolder").alias("trashFolder"), F.col("t_notes").alias("notes")))
    return mailboxes.select("mailbox_id", F.lit("").alias("label"), F.lit("head").alias("part"), entry.alias("entry"))


def gap_lines(gaps: DataFrame) -> DataFrame:
    """K3: the gaps of each mailbox, numbered in the order of rules and issues: mailbox_id, number and line.

    gaps: mailbox_id, rule_seq, pos and gap.
    """
    number = F.row_number().over(Window.partitionBy("mailbox_id").orderBy("rule_seq", "pos"))
    return gaps.select("mailbox_id", number.alias("number"), F.concat(number.cast("string"), F.lit(". "), "gap").alias("line"))


def recipe_blocks(results: DataFrame) -> DataFrame:
    """K5: the manual recipe of each mailbox, a block a rule: mailbox_id, block (from 1), fence and text.

    A description is fenced by one backtick more than its longest run has, three at least.
    results: mailbox_id, rule_seq, status, description and issues.
    """
    runs = F.transform(F.regexp_extract_all("description", F.lit("`+"), 0), lambda r: F.length(r) + 1)
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(3))))
    issues = F.transform("issues", lambda i: F.concat(F.lit("- "), redacted(i, F.col("description"))))
    told = F.when(F.size("issues") > 0, issues).otherwise(F.array(F.lit(K.RECIPE_NO_ISSUE)))
    text = F.concat_ws("\n", F.lit(""), F.concat(F.lit(K.RECIPE_RULE), F.col("rule_seq").cast("string")), F.lit(""), F.lit(K.RECIPE_ORIGINAL), F.col("fence"), F.col("description"),
                       F.col("fence"), F.lit(""), *[F.lit(x) for x in K.RECIPE_STEPS], F.concat(F.lit(K.RECIPE_STATUS), "status", F.lit("。")), F.array_join(told, "\n"), F.lit(K.RECIPE_LAST))
    return results.withColumn("fence", fence).select("mailbox_id", F.col("rule_seq").alias("block"), "fence", text.alias("text"))


def redacted(issue: Column, description: Column) -> Column:
    """K6: every address in an issue that the rule's own description does not hold becomes a mark."""
    rest = F.split(issue, _ADDRESS)
    found = F.regexp_extract_all(issue, F.lit(_ADDRESS), 0)
    shown = F.transform(found, lambda a: F.when(F.contains(description, a), a).otherwise(F.lit(K.REDACTED)))
    return F.concat_ws("", F.transform(rest, lambda x, i: F.concat(x, F.coalesce(F.get(shown, i), F.lit("")))))


def summary_rows(results: DataFrame, mapping: DataFrame) -> DataFrame:
    """K7: for each mailbox the active and the disabled rules, and the folders to create."""
    rules = results.groupBy("mailbox_id").agg(F.count_if(F.col("status") == "converted").alias("active"), F.count_if(F.col("status") == "approximate").alias("disabled"))
    folders = mapping.where(F.coalesce(F.col("folder"), F.lit("")) != "").groupBy("mailbox_id").agg(F.count(F.lit(1)).alias("folders"))
    return rules.join(folders, "mailbox_id", "full").na.fill(0, ["active", "disabled", "folders"])


def with_status(results: DataFrame, status: str) -> DataFrame:
    """Results of one status; ``all`` is no filter."""
    return results if status == "all" else results.where(F.col("status") == status)
