"""Target providers (D10), lookup (J2) and capability check.

The targets table has six fixed rows, so broadcasting it is size-safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K

SCHEMA = (
    "target_seq int, id string, label string, kind string, verifyStatus string, "
    "extensions array<string>, supportsFlags boolean, supportsRedirect boolean, "
    "supportsVariables boolean, maxActiveRules int, folderDelimiter string, archiveFolder string, "
    "trashFolder string, reserved array<string>, notes array<string>, docsUrl string"
)
_COLS = ["id", "label", "kind", "verifyStatus", "extensions", "supportsFlags", "supportsRedirect",
         "supportsVariables", "maxActiveRules", "folderDelimiter", "archiveFolder", "trashFolder",
         "reserved", "notes", "docsUrl"]


def targets(spark: SparkSession) -> DataFrame:
    """The six provider rows in their fixed order (``target_seq``)."""
    rows = [tuple([i] + [t[c] for c in _COLS]) for i, t in enumerate(K.TARGETS)]
    return spark.createDataFrame(rows, SCHEMA)


def with_target(df: DataFrame, target_col: str = "target") -> DataFrame:
    """Attach the target row (broadcast; 6 rows); an unknown id raises."""
    t = targets(df.sparkSession).select(*[F.col(c).alias("t_" + c) for c in _COLS])
    joined = df.join(F.broadcast(t), F.col(target_col) == F.col("t_id"), "left")
    return joined.withColumn(
        "t_id",
        F.when(F.col("t_id").isNull(),
               F.raise_error(F.concat(F.lit("未知目标服务商："), F.col(target_col).cast("string"))))
        .otherwise(F.col("t_id")),
    )


def _ext_ok(ext: Column) -> Column:
    return (F.col("t_kind") == "sieve") & F.array_contains(F.col("t_extensions"), ext)


def _action_ok(act: Column) -> Column:
    sieve = F.col("t_kind") == "sieve"
    needed = F.try_element_at(F.create_map(*[x for k, v in K.ACTION_EXTENSIONS.items()
                                             for x in (F.lit(k), F.lit(v))]), act)
    with_need = (sieve & F.array_contains(F.col("t_extensions"), needed)
                 & ((needed != "imap4flags") | F.col("t_supportsFlags"))
                 & ((needed != "variables") | F.col("t_supportsVariables")))
    return (F.when(needed.isNotNull(), with_need)
            .when(act == "redirect", sieve & F.col("t_supportsRedirect"))
            .otherwise(sieve & act.isin(*K.CORE_ACTIONS)))


def capability_messages(extensions: Column, actions: Column) -> Column:
    """Ordered ``array<struct<ok boolean, text string>>`` for a rule's needs.

    Requires the ``t_*`` columns of :func:`with_target` on the row.
    """
    needed_map = F.create_map(*[x for k, v in K.ACTION_EXTENSIONS.items() for x in (F.lit(k), F.lit(v))])

    def ext_msg(e: Column) -> Column:
        ok = _ext_ok(e)
        text = F.when(ok, F.replace(F.lit(K.C_EXT_OK), F.lit("{ext}"), e)).otherwise(
            F.replace(F.lit(K.C_EXT_BAD), F.lit("{ext}"), e))
        return F.struct(ok.alias("ok"), text.alias("text"))

    def act_msg(a: Column) -> Column:
        ok = _action_ok(a)
        need = F.try_element_at(needed_map, a)
        need_text = F.when(need.isNotNull(), F.replace(F.lit(K.C_ACT_NEED), F.lit("{ext}"), need)).otherwise(F.lit(""))
        bad = F.replace(F.replace(F.lit(K.C_ACT_BAD), F.lit("{act}"), a), F.lit("{need}"), need_text)
        text = F.when(ok, F.replace(F.lit(K.C_ACT_OK), F.lit("{act}"), a)).otherwise(bad)
        return F.struct(ok.alias("ok"), text.alias("text"))

    return F.concat(F.transform(F.array_distinct(extensions), ext_msg),
                    F.transform(F.array_distinct(actions), act_msg))


def limit_issues(rule_count: Column) -> Column:
    """The active-rule limit message when ``rule_count`` exceeds the target maximum."""
    text = F.replace(F.replace(F.lit(K.C_LIMIT), F.lit("{n}"), rule_count.cast("string")),
                     F.lit("{max}"), F.col("t_maxActiveRules").cast("string"))
    return F.when(F.col("t_maxActiveRules").isNotNull() & (rule_count > F.col("t_maxActiveRules")),
                  F.array(text)).otherwise(F.array().cast("array<string>"))
