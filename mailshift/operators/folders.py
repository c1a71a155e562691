"""Folder planning (F8, F9, P2, P3, W2, W3) over a label inventory.

Input: distinct ``(mailbox_id, label)`` rows (the label inventory, A2) and, for
each, the reserved names of its mailbox's target.  NFC normalisation has no
built-in, so one Arrow (pandas) UDF runs on the *distinct* label table; it is
marked so that no filter moves it below the distinct.

Numbering is greedy in label order.  Names can only get in each other's way if they
are the same but for the numbers at their end, so labels are grouped by mailbox
and stem, the folded name without those numbers; a mailbox is never one group.  Where no name
of a stem brings a number of its own, the n-th label gets the n-th number that is
not reserved; else the labels of the stem are folded in order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .. import constants as K
from ..functions.text import js_trim, lit_array, utf16_length

_SYSTEM_RE = r"(?i)^category:|^categories/|^\\(?:inbox|drafts?|junk|trash|flagged|all|important|seen)\z"
_UNSAFE_SEG = r"[\x00-\x1f\x7f\\:*?\"<>|]"


def nfc_col(c: Column) -> Column:
    """Unicode NFC.  Defined here, so that it is shipped by value to workers."""
    def nfc(values: pd.Series) -> pd.Series:
        import unicodedata

        return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))

    return pandas_udf(nfc, "string").asNondeterministic()(c)


def name_key(c: Column) -> Column:
    """the key under which folder names are the same: NFC, trimmed, lower-cased."""
    return F.lower(js_trim(nfc_col(c)))


def sanitize_path(normalized: Column) -> Column:
    """F8: per-segment trim, unsafe characters to '_', strip trailing spaces/dots, empty to '_'."""
    def seg(p: Column) -> Column:
        clean = F.regexp_replace(F.regexp_replace(js_trim(p), _UNSAFE_SEG, "_"), r"[ .]+\z", "")
        return F.when((clean == "") | (clean == ".") | (clean == ".."), F.lit("_")).otherwise(clean)

    return F.transform(F.split(normalized, "/"), seg)


def reserved_of(target: Column) -> Column:
    """The reserved keys of a target (six fixed rows)."""
    lists = [x for t in K.TARGETS for x in (F.lit(t["id"]), lit_array([r.strip().lower() for r in t["reserved"]]).cast("array<string>"))]
    return F.coalesce(F.try_element_at(F.create_map(*lists), target), F.array().cast("array<string>"))


def plan_folders(labels: DataFrame) -> DataFrame:
    """One row per label: folder (NULL when reserved), notes; system labels dropped.

    labels: mailbox_id, label and reserved (the reserved keys of the mailbox's target).
    """
    df = (labels.groupBy("mailbox_id", "label").agg(F.first("reserved").alias("reserved"))
          .withColumn("normalized", js_trim(nfc_col(F.col("label")))))
    lower = F.lower("normalized")
    system = (F.array_contains(lit_array(K.SYSTEM), lower)
              | F.array_contains(lit_array(K.SYSTEM), F.regexp_replace(lower, r"^\[gmail\]/", ""))
              | F.col("normalized").rlike(_SYSTEM_RE))
    df = df.where(~system).select("mailbox_id", "label", "reserved", F.array_contains("reserved", lower).alias("held"),
                                  sanitize_path(F.col("normalized")).alias("parts"))
    df = df.withColumn("base", F.array_join("parts", "/"))
    df = df.withColumn("stem", F.regexp_replace(F.lower("base"), r"(?: \(\d+\))+\z", ""))
    groups = df.groupBy("mailbox_id", "stem").agg(
        F.first("reserved").alias("reserved"), F.max(F.lower("base") != F.col("stem")).alias("numbered"),
        F.array_sort(F.collect_list(F.when(~F.col("held"), F.struct("label", "base", "parts")))).alias("items"),
        F.collect_list(F.when(F.col("held"), F.struct("label", "base", "parts"))).alias("held"))

    def named(base: Column, n: Column) -> Column:
        return F.when(n == 1, base).otherwise(F.concat(base, F.lit(" ("), n.cast("string"), F.lit(")")))

    # Numbers that the target's reserved names take from this stem, ascending (it has few of them).
    lost = F.array_sort(F.array_compact(F.transform("reserved", lambda r: F.when(r == F.col("stem"), F.lit(1)).when(
        F.startswith(r, F.concat("stem", F.lit(" ("))), F.regexp_extract(r, r" \((\d+)\)\z", 1).try_cast("int")))))
    plain = F.transform("items", lambda x, i: F.struct(x.alias("x"), F.aggregate(lost, i + 1, lambda n, gone: F.when(gone <= n, n + 1).otherwise(n)).alias("n")))

    def step(acc: Column, x: Column) -> Column:
        # The first number beyond those taken that leaves a gap.
        taken = F.concat(acc["used"], F.col("reserved"))
        n = F.get(F.filter(F.sequence(F.lit(1), F.size(taken) + 1), lambda n: ~F.array_contains(taken, F.lower(named(x["base"], n)))), F.lit(0))
        return F.struct(F.array_append(acc["used"], F.lower(named(x["base"], n))).alias("used"), F.array_append(acc["out"], F.struct(x.alias("x"), n.alias("n"))).alias("out"))

    item = "struct<label:string,base:string,parts:array<string>>"
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast(f"array<struct<x:{item},n:int>>").alias("out"))
    told = F.concat(F.when(F.col("numbered"), F.aggregate("items", start, step)["out"]).otherwise(plain),
                    F.transform("held", lambda x: F.struct(x.alias("x"), F.lit(None).cast("int").alias("n"))))
    rows = groups.select("mailbox_id", F.explode_outer(told).alias("r")).select("mailbox_id", "r.x.*", "r.n").withColumn("held", F.col("n").isNull())
    notes = F.filter(F.array(
        F.when(F.col("base") != F.col("label"), F.lit(K.N_NORMALIZED)),
        F.when(F.size("parts") > 1, F.lit(K.N_NESTED)),
        F.when(utf16_length(F.col("base")) > 255, F.lit(K.N_LONG)),
        F.when(F.col("n") > 1, F.lit(K.N_COLLISION)),
    ), lambda x: x.isNotNull())
    folder = F.when(F.col("n") == 1, F.col("base")).when(F.col("n") > 1, F.concat("base", F.lit(" ("), F.col("n").cast("string"), F.lit(")")))
    return rows.select("mailbox_id", "label", folder.alias("folder"), F.when(F.col("held"), F.array(F.lit(K.N_RESERVED))).otherwise(notes).alias("notes"))


def mapping_rows(plan: DataFrame, rule_labels: DataFrame, overrides: DataFrame) -> DataFrame:
    """The plan, a row with an empty folder for each rule label that it lacks, and what the user chose instead.

    plan: mailbox_id, label, folder, notes; rule_labels: mailbox_id, label; overrides: mailbox_id, label, folder.
    """
    missing = (rule_labels.select("mailbox_id", "label").where(F.col("label") != "").distinct()
               .join(plan.select("mailbox_id", "label"), ["mailbox_id", "label"], "left_anti")
               .select("mailbox_id", "label", F.lit("").alias("folder"), F.array(F.lit(K.N_RULE_MAPPING)).alias("notes")))
    chosen = overrides.select("mailbox_id", "label", F.col("folder").alias("chosen"))
    return (plan.unionByName(missing).join(chosen, ["mailbox_id", "label"], "left")
            .select("mailbox_id", "label", F.coalesce("chosen", "folder", F.lit("")).alias("folder"), "notes"))


def mapping_errors(rows: DataFrame) -> DataFrame:
    """Invalid, reserved or colliding folder choices; both members of a clash are flagged.

    rows: mailbox_id, label, folder and reserved (the reserved keys of the mailbox's target).
    """
    control = r"[\x00-\x1f\x7f-\x9f]"
    df = rows.withColumn("folder", F.coalesce("folder", F.lit(""))).withColumn("key", name_key(F.col("folder")))
    df = df.withColumn("clash", F.count(F.lit(1)).over(Window.partitionBy("mailbox_id", "key")) > 1)
    err = F.filter(F.array(
        F.when((js_trim(F.col("folder")) == "") | F.col("folder").rlike(control), F.lit("invalidFolder")),
        F.when(F.array_contains("reserved", F.col("key")), F.lit("reservedFolder")),
        F.when(F.col("clash"), F.lit("collision")),
    ), lambda x: x.isNotNull())
    return df.select("mailbox_id", "label", "folder", F.explode_outer(err).alias("error_key")).where(F.col("error_key").isNotNull())


def special_errors(choices: DataFrame) -> DataFrame:
    """The user's archive and trash folders that are blank or hold control characters.

    choices: mailbox_id, archiveFolder and trashFolder.
    """
    rows = choices.select("mailbox_id", F.inline(F.array(*[F.struct(F.lit(n).alias("label"), F.coalesce(n, F.lit("")).alias("folder")) for n in ("archiveFolder", "trashFolder")])))
    bad = (js_trim(F.col("folder")) == "") | F.col("folder").rlike(r"[\x00-\x1f\x7f-\x9f]")
    return rows.where(bad).withColumn("error_key", F.lit("invalidFolder"))
