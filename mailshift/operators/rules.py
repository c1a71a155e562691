"""Filter-rule conversion (F5, F7, F10, F11, F13, F14, R1-R13) as a table job.

Input: one row per rule with ``mailbox_id, rule_seq, rule_id, target,
include_approximate, archive_folder, trash_folder, unknown`` and one nullable
string column ``p_<name>`` per known property (the shape the filter-feed
source produces).  ``rule_seq`` is the 1-based position of the rule in its
mailbox's feed.

Every per-rule step is a projection (the saved-search parser runs inline on the
rule row, no join) but for the folder keys, whose NFC is an Arrow UDF; the only
shuffles are that of the mailboxes' rules (R10) and the destination-key
aggregate (R5).  The targets table (6 rows) is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import js_trim, sieve_quote, unsafe
from . import search as S
from . import targets as T
from .folders import name_key

PROPS = K.CRITERIA + K.ACTIONS
_SUBJECT_OK = r"^[\p{L}\p{N}][\p{L}\p{N} .,_'!?@&%-]*\z"
_WORD_OPS = r"(?<![A-Za-z0-9_])(?:OR|AND|NOT)(?![A-Za-z0-9_])"
def _empty() -> Column:
    return F.array().cast("array<string>")


def _fmt(template: str, **kw: Column) -> Column:
    out = F.lit(template)
    for k, v in kw.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out


def _arr(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def is_mailbox(c: Column) -> Column:
    """one exact ASCII dot-atom address with a DNS-style domain."""
    return F.coalesce(c.rlike(S.MAILBOX), F.lit(False))


def folder_key(c: Column) -> Column:
    """NFC, trimmed, lower-cased folder name."""
    return name_key(c)


def active_fields(rules: DataFrame) -> DataFrame:
    """``a_<name>`` active values and the ordered field issues."""
    cols = []
    issues = []
    for name in PROPS:
        raw = F.col("p_" + name)
        switch = name in K.SWITCHES
        bad_bool = (raw != "true") & (raw != "false") if switch else F.lit(False)
        issue = (F.when(raw.isNull(), F.lit(None))
                 .when(unsafe(raw), F.lit(K.R_UNSAFE_VALUE.format(name=name)))
                 .when(raw == "", F.lit(None))
                 .when(bad_bool, F.lit(K.R_BAD_BOOLEAN.format(name=name))))
        active = F.when(raw.isNotNull() & ~unsafe(raw) & (raw != "") & ~bad_bool
                        & ((raw != "false") if switch else F.lit(True)), raw)
        cols.append(active.alias("a_" + name))
        issues.append(issue)
    return rules.select("*", *cols, _arr(*issues).alias("field_issues"))


def _compile_query(prefix: str) -> tuple[Column, Column, Column]:
    """Compile parsed tests into script tests: (parts, compile issues, subject warnings)."""
    def compile_one(t: Column, negate: bool) -> Column:
        addr = t["field"].isin("from", "to", "cc") & (t["op"] == "is") & is_mailbox(t["value"])
        size = ((t["field"] == "size") & t["op"].isin("over", "under") & (t["num"] >= 0)
                & (t["num"] <= K.MAX_SIZE))
        subj = ((t["field"] == "subject") & (t["op"] == "contains") & (js_trim(t["value"]) != "")
                & ~unsafe(t["value"]))
        text = (F.when(addr, F.concat(F.lit("address :is "), sieve_quote(t["field"]), F.lit(" "),
                                      sieve_quote(t["value"])))
                .when(size, F.concat(F.lit("size :"), t["op"], F.lit(" "), t["num"].cast("string")))
                .when(subj, F.concat(F.lit('header :contains "subject" '), sieve_quote(t["value"]))))
        if negate:
            text = F.when(text.isNotNull(), F.concat(F.lit("not "), text))
        issue = F.when(text.isNull(), _fmt(K.R_QUERY_CONDITION, raw=t["raw"]))
        warn = F.when(subj & ~addr & ~size, F.lit(K.R_QUERY_SUBJECT_WARN))
        return F.struct(text.alias("text"), issue.alias("issue"), warn.alias("warn"))

    items = F.concat(F.transform(prefix + "tests", lambda t: compile_one(t, False)),
                     F.transform(prefix + "negated", lambda t: compile_one(t, True)))
    parts = F.transform(items, lambda x: x["text"])
    issues = F.filter(F.transform(items, lambda x: x["issue"]), lambda x: x.isNotNull())
    warns = F.filter(F.transform(items, lambda x: x["warn"]), lambda x: x.isNotNull())
    return parts, issues, warns


def _allof(parts: Column) -> Column:
    return F.when(F.size(parts) == 1, F.try_element_at(parts, F.lit(1))).otherwise(
        F.concat(F.lit("allof ("), F.array_join(parts, ", "), F.lit(")")))


def destination_keys(rules: DataFrame, folder_map: DataFrame | None = None) -> DataFrame:
    """R5 input: per (mailbox, destination key) the smallest and largest name mapping to it.

    Destinations = folder-map entries plus every rule label not in the map.  A
    rule clashes when its key also holds a name other than its own; min/max
    answer that without collecting names (a bounded, map-side aggregate).
    """
    labels = rules.where(F.col("p_label").isNotNull() & (F.col("p_label") != "")).select(
        "mailbox_id", F.col("p_label").alias("name"), F.col("p_label").alias("dest"))
    if folder_map is not None:
        fm = folder_map.select("mailbox_id", F.col("label").alias("name"), F.col("folder").alias("dest"))
        labels = fm.unionByName(labels.join(fm.select("mailbox_id", "name"), ["mailbox_id", "name"], "left_anti"))
    return (labels.withColumn("f_key", folder_key(F.col("dest")))
            .groupBy("mailbox_id", "f_key")
            .agg(F.min("name").alias("k_min"), F.max("name").alias("k_max")))


def with_searches(df: DataFrame) -> DataFrame:
    """Both search fields of active rules parsed inline (no join): columns hw_... and dw_..."""
    df = S.parse_queries(df.withColumn("_hw", F.col("a_hasTheWord")), "_hw", "hw_")
    return S.parse_queries(df.withColumn("_dw", F.col("a_doesNotHaveTheWord")), "_dw", "dw_")


def with_conditions(df: DataFrame) -> DataFrame:
    """Tests, condition_issues and condition_warnings of active rules whose searches are parsed."""
    a = lambda n: F.col("a_" + n)
    hw_parts, hw_issues, hw_warns = _compile_query("hw_")
    dw_parts, dw_issues, dw_warns = _compile_query("dw_")

    def query_test(name: str, prefix: str, parts: Column) -> Column:
        ok = (a(name).isNotNull() & (F.size(F.col(prefix + "unsupported")) == 0) & (F.size(parts) > 0)
              & ~F.exists(parts, lambda p: p.isNull()))
        head = F.lit("not ") if name == "doesNotHaveTheWord" else F.lit("")
        return F.when(ok, F.concat(head, _allof(parts)))

    def query_issues(name: str, prefix: str, issues: Column) -> Column:
        reasons = F.transform(prefix + "unsupported", lambda r: F.concat(F.lit(name + ": "), r))
        return F.when(a(name).isNotNull(), F.concat(reasons, issues)).otherwise(_empty())

    units = F.create_map(*[x for k, v in K.SIZE_UNITS.items() for x in (F.lit(k), F.lit(v))])
    ops = F.create_map(*[x for k, v in K.SIZE_OPERATORS.items() for x in (F.lit(k), F.lit(v))])
    amount = F.try_multiply(a("size").try_cast("decimal(38,0)"),
                            F.try_element_at(units, a("sizeUnit")).cast("decimal(38,0)"))
    size_ok = (a("size").rlike(r"^\d+\z") & F.try_element_at(units, a("sizeUnit")).isNotNull()
               & F.try_element_at(ops, a("sizeOperator")).isNotNull() & amount.isNotNull()
               & (amount <= K.MAX_SIZE))
    subj_ok = a("subject").rlike(_SUBJECT_OK) & ~a("subject").rlike(_WORD_OPS)

    return df.select(
        "*",
        _arr(
            F.when(a("from").isNotNull() & is_mailbox(a("from")),
                   F.concat(F.lit('address :is "from" '), sieve_quote(a("from")))),
            F.when(a("to").isNotNull() & is_mailbox(a("to")),
                   F.concat(F.lit('address :is "to" '), sieve_quote(a("to")))),
            F.when(a("subject").isNotNull() & subj_ok,
                   F.concat(F.lit('header :contains "subject" '), sieve_quote(a("subject")))),
            query_test("hasTheWord", "hw_", hw_parts),
            query_test("doesNotHaveTheWord", "dw_", dw_parts),
            F.when(a("size").isNotNull() & size_ok,
                   F.concat(F.lit("size "), F.try_element_at(ops, a("sizeOperator")), F.lit(" "),
                            amount.cast("bigint").cast("string"))),
        ).alias("tests"),
        F.concat(
            _arr(
                F.when(a("from").isNotNull() & ~is_mailbox(a("from")), F.lit(K.R_EXACT_ADDRESS.format(name="from"))),
                F.when(a("to").isNotNull() & ~is_mailbox(a("to")), F.lit(K.R_EXACT_ADDRESS.format(name="to"))),
                F.when(a("subject").isNotNull() & ~subj_ok, F.lit(K.R_SUBJECT_SYNTAX)),
            ),
            query_issues("hasTheWord", "hw_", hw_issues),
            query_issues("doesNotHaveTheWord", "dw_", dw_issues),
            _arr(F.when(a("size").isNotNull() & ~size_ok, F.lit(K.R_SIZE))),
        ).alias("condition_issues"),
        F.concat(
            _arr(F.when(a("subject").isNotNull() & subj_ok, F.lit(K.R_SUBJECT_WARN))),
            F.when(a("hasTheWord").isNotNull(), hw_warns).otherwise(_empty()),
            F.when(a("doesNotHaveTheWord").isNotNull(), dw_warns).otherwise(_empty()),
        ).alias("condition_warnings"),
    )


def convert_rules(rules: DataFrame, folder_map: DataFrame | None = None) -> DataFrame:
    """Per-rule status, issues, tests, commands and required extensions."""
    df = T.with_target(active_fields(rules))
    # Destinations (R4): an explicit map entry wins, else the label itself.
    if folder_map is not None:
        fm = folder_map.select("mailbox_id", F.col("label").alias("a_label"), F.col("folder").alias("mapped"), F.lit(True).alias("has_map"))
        df = df.join(fm, ["mailbox_id", "a_label"], "left")
        fm_sys = folder_map.where(F.col("label").isin("Archive", "Trash")).groupBy("mailbox_id").agg(
            F.max(F.when(F.col("label") == "Archive", F.col("folder"))).alias("fm_archive"),
            F.max(F.when(F.col("label") == "Trash", F.col("folder"))).alias("fm_trash"),
            F.max(F.col("label") == "Archive").alias("has_archive"), F.max(F.col("label") == "Trash").alias("has_trash"))
        df = df.join(fm_sys, "mailbox_id", "left")
    else:
        df = df.withColumns({c: F.lit(None).cast("string") for c in ("mapped", "fm_archive", "fm_trash")})
        df = df.withColumns({c: F.lit(None).cast("boolean") for c in ("has_map", "has_archive", "has_trash")})
    # A map row counts even where its folder is NULL (a reserved name): that destination is invalid.
    df = df.withColumn("archive", F.when(F.col("archive_folder").isNotNull(), F.col("archive_folder"))
                       .when(F.col("has_archive"), F.col("fm_archive")).otherwise(F.col("t_archiveFolder"))) \
           .withColumn("trash", F.when(F.col("trash_folder").isNotNull(), F.col("trash_folder"))
                       .when(F.col("has_trash"), F.col("fm_trash")).otherwise(F.col("t_trashFolder"))) \
           .withColumn("label_dest", F.when(F.col("has_map"), F.col("mapped")).otherwise(F.col("a_label")))
    # Keys are computed once, here: NFC is the one Python step of the conversion.
    df = df.withColumn("archive_key", folder_key(F.col("archive"))).withColumn("trash_key", folder_key(F.col("trash")))
    df = with_conditions(with_searches(df))
    a = lambda n: F.col("a_" + n)

    # Actions (R3, R4, R6).
    trash, label, archive = a("shouldTrash").isNotNull(), a("label").isNotNull(), a("shouldArchive").isNotNull()
    star, read, fwd = a("shouldStar").isNotNull(), a("shouldMarkAsRead").isNotNull(), a("forwardTo").isNotNull()
    uses_folder = trash | label | archive
    df = df.select(
        "*",
        F.when(trash, F.lit("Trash")).when(label, a("label")).when(archive, F.lit("Archive")).alias("f_name"),
        F.when(trash, F.col("trash")).when(label, F.col("label_dest")).when(archive, F.col("archive")).alias("f_value"),
    ).withColumn("f_key", folder_key(F.col("f_value")))
    # Does another destination name share this key?  (join on the small key table)
    df = df.join(destination_keys(rules, folder_map), ["mailbox_id", "f_key"], "left").withColumn(
        "_other_dest", F.col("k_min").isNotNull() & ((F.col("k_min") != F.col("f_name")) | (F.col("k_max") != F.col("f_name"))))
    f_name, f_value = F.col("f_name"), F.col("f_value")
    f_system = trash | (~label & archive)
    f_invalid = f_value.isNull() | (js_trim(f_value) == "") | unsafe(f_value)
    collide = _collision(f_system)
    fileinto = F.when(uses_folder & ~f_invalid & ~collide, F.concat(F.lit("fileinto "), sieve_quote(f_value), F.lit(";")))
    redirect = F.when(fwd & is_mailbox(a("forwardTo")),
                      F.concat(F.lit("redirect "), sieve_quote(a("forwardTo")), F.lit(";")))
    keep = F.when((label & ~archive & ~trash) | (fwd & ~uses_folder), F.lit("keep;"))
    commands = _arr(F.when(read, F.lit('addflag "\\\\Seen";')), F.when(star, F.lit('addflag "\\\\Flagged";')),
                    fileinto, redirect, keep)
    needed = _arr(F.when(read | star, F.lit("imap4flags")), F.when(uses_folder, F.lit("fileinto")))
    df = df.select("*", commands.alias("commands"), needed.alias("needed"),
                   (label | archive | trash | fwd).alias("delivery"))
    caps = T.capability_messages(F.col("needed"),
                                 F.transform("commands", lambda c: F.replace(F.split(c, " ")[0], F.lit(";"), F.lit(""))))
    issues = F.concat(
        _arr(F.when(F.col("t_kind") == "recipe", F.lit(K.R_RECIPE)),
             F.when(unsafe(F.col("rule_id")), F.lit(K.R_UNSAFE_ID))),
        F.coalesce(F.col("unknown"), _empty()),
        F.col("field_issues"),
        _arr(*[F.when(a(n).isNotNull(), F.lit(K.R_NEVER.format(name=n))) for n in K.NEVER_CONVERTIBLE]),
        F.col("condition_issues"),
        _arr(F.when(F.size("tests") == 0, F.lit(K.R_NO_CONDITION)),
             F.when(trash & (label | archive), F.lit(K.R_AMBIGUOUS_TRASH)),
             F.when(uses_folder & f_invalid, _fmt(K.R_BAD_FOLDER, name=f_name)),
             F.when(uses_folder & ~f_invalid & collide, _fmt(K.R_COLLISION, name=f_name)),
             F.when(fwd & ~is_mailbox(a("forwardTo")), F.lit(K.R_FORWARD)),
             F.when(F.size("commands") == 0, F.lit(K.R_NO_ACTION))),
        F.transform(F.filter(caps, lambda m: ~m["ok"]), lambda m: m["text"]),
    )
    warnings = F.concat(
        _arr(F.when(F.col("target") == "unknown", F.lit(K.R_UNKNOWN_TARGET))),
        F.col("condition_warnings"),
        _arr(F.when(star | read, F.lit(K.R_FLAGS_WARN)),
             F.when(trash, F.lit(K.R_TRASH_WARN)),
             F.when(label & ~archive, F.lit(K.R_LABEL_WARN)),
             F.when(archive, F.lit(K.R_ARCHIVE_WARN))),
    )
    df = df.select("*", issues.alias("rule_issues"), warnings.alias("rule_warnings"))
    status = (F.when(F.size("rule_issues") > 0, F.lit("skipped"))
              .when(F.size("rule_warnings") > 0, F.lit("approximate")).otherwise(F.lit("converted")))
    body = F.concat(F.lit("if "), _allof(F.col("tests")), F.lit(" {\n"),
                    F.array_join(F.transform("commands", lambda c: F.concat(F.lit("  "), c)), "\n"),
                    F.lit("\n}"))
    return df.select(
        "mailbox_id", "rule_seq", "rule_id", "target", "include_approximate",
        status.alias("status"), description(rules.columns).alias("description"),
        F.concat("rule_issues", "rule_warnings").alias("issues"),
        F.array_sort(F.array_distinct("needed")).alias("required_extensions"),
        "needed", "tests", "commands", "delivery", body.alias("body"),
        T.limit_issues(F.lit(1)).alias("limit_issues"),
    )


def _collision(system: Column) -> Column:
    """Inbox, archive = trash (system), user folder = archive/trash, or a shared key."""
    key = F.col("f_key")
    return F.coalesce((key == "inbox")
            | (system & (F.col("archive_key") == F.col("trash_key")))
            | (~system & ((key == F.col("archive_key")) | (key == F.col("trash_key"))))
            | F.coalesce(F.col("_other_dest"), F.lit(False)), F.lit(False))


def finalize(converted: DataFrame) -> DataFrame:
    """Limit, cross-rule downgrade (over the mailbox), enable flag, text."""
    # One shuffle of the converted rows; a mailbox's rules are few, and the conversion runs once.
    mailbox = Window.partitionBy("mailbox_id")
    df = converted.withColumns({
        "n_rules": F.count(F.lit(1)).over(mailbox), "n_valid": F.count_if(F.col("status") != "skipped").over(mailbox),
        "any_delivery": F.max((F.col("status") != "skipped") & F.col("delivery")).over(mailbox)})
    limited = (F.col("status") != "skipped") & (F.size("limit_issues") > 0)
    status1 = F.when(limited, F.lit("skipped")).otherwise(F.col("status"))
    issues1 = F.when(limited, F.concat("issues", "limit_issues")).otherwise(F.col("issues"))
    multi = (status1 != "skipped") & (F.col("n_valid") > 1) & F.col("any_delivery")
    status2 = F.when(multi, F.lit("approximate")).otherwise(status1)
    issues2 = F.when(multi, F.concat(issues1, F.array(F.lit(K.R_MULTIPLE)))).otherwise(issues1)
    df = df.select("*", status2.alias("final_status"), issues2.alias("issues2"))
    disabled = (F.col("final_status") == "approximate") & ~F.coalesce(F.col("include_approximate"), F.lit(False))
    issues3 = F.when(disabled, F.concat("issues2", F.array(F.lit(K.R_DISABLED)))).otherwise(F.col("issues2"))
    num = F.col("rule_seq").cast("string")
    needed_line = F.when(F.size("required_extensions") > 0, F.concat(
        F.lit("# Needed at script top before enabling: require ["),
        F.array_join(F.transform("required_extensions", sieve_quote), ", "), F.lit("];\n"))).otherwise(F.lit(""))
    commented = F.array_join(F.transform(F.split(F.col("body"), "\n"), lambda l: F.concat(F.lit("# "), l)), "\n")
    generated = F.when(F.col("final_status") == "skipped",
                       F.concat(F.lit("# Rule "), num, F.lit(" skipped; see conversion report."))).otherwise(
        F.concat(F.lit("# Rule "), num,
                 F.when(F.col("final_status") == "approximate", F.concat(
                     F.lit(" (approximate; "), F.when(disabled, F.lit("DISABLED")).otherwise(F.lit("explicitly enabled")),
                     F.lit("; review report)"))).otherwise(F.lit("")),
                 F.lit("\n"), needed_line, F.when(disabled, commented).otherwise(F.col("body"))))
    return df.select(
        "mailbox_id", "rule_seq", "rule_id", "target", F.col("final_status").alias("status"),
        "description", issues3.alias("issues"), "required_extensions",
        ((F.col("final_status") != "skipped") & ~disabled).alias("enabled"),
        "needed", generated.alias("generated"), (F.col("rule_seq") == F.col("n_rules")).alias("last"),
    )


def description(columns: list[str]) -> Column:
    """``k=v, … → k=v, …`` over the properties present, in property order."""
    def side(names: list[str], empty: str) -> Column:
        present = [n for n in names if "p_" + n in columns]
        items = _arr(*[F.when(F.col("p_" + n).isNotNull(), F.concat(F.lit(n + "="), F.col("p_" + n)))
                       for n in present]) if present else _empty()
        return F.coalesce(F.nullif(F.array_join(items, ", "), F.lit("")), F.lit(empty))

    return F.concat(side(K.CRITERIA, "(no conditions)"), F.lit(" → "), side(K.ACTIONS, "(no actions)"))


def required_extensions(final: DataFrame) -> DataFrame:
    """Union of the extensions of enabled rules per mailbox, sorted.

    The set is bounded by the extension vocabulary, so ``collect_set`` stays small
    however many rules a mailbox has (and it combines map-side).
    """
    return (final.where("enabled").select("mailbox_id", F.explode("needed").alias("ext"))
            .groupBy("mailbox_id").agg(F.array_sort(F.collect_set("ext")).alias("exts"))
            .select("mailbox_id", F.array_join("exts", ",").alias("required_extensions")))


def script_blocks(final: DataFrame) -> DataFrame:
    """The rule script per mailbox as ordered blocks (never one collected string).

    Block 0 is the header plus the ``require`` line; block n is rule n's text.
    Every block ends with its own separator, so the blocks of a mailbox in
    ``block`` order are the script as it is; a writer can stream them.
    """
    needed = F.flatten(F.collect_set(F.when(F.col("enabled"), F.col("needed"))).over(Window.partitionBy("mailbox_id")))
    exts = F.array_sort(F.array_distinct(needed))
    rows = final.withColumn("exts", exts)
    # The first rule of a mailbox brings the header along: one pass over the rules.
    head = F.when(F.col("rule_seq") == 1, F.struct(
        F.lit(0).cast("long").alias("block"),
        F.concat(F.lit(K.SCRIPT_HEADER),
                 F.when(F.size("exts") > 0, F.concat(
                     F.lit("require ["),
                     F.array_join(F.transform("exts", sieve_quote), ", "),
                     F.lit("];\n\n"))).otherwise(F.lit(""))).alias("text")))
    own = F.struct(F.col("rule_seq").cast("long").alias("block"),
                   F.concat("generated", F.when(F.col("last"), F.lit("\n")).otherwise(F.lit("\n\n"))).alias("text"))
    return rows.select("mailbox_id", F.inline(F.filter(F.array(head, own), lambda x: x.isNotNull())))


def capability_rows(converted: DataFrame) -> DataFrame:
    """R7 as a table: one row per (rule, needed extension or action) with its verdict."""
    return converted.select("mailbox_id", "rule_seq", "target", "needed", "commands").transform(
        lambda d: T.with_target(d)).select(
        "mailbox_id", "rule_seq", "target",
        F.posexplode(T.capability_messages(
            F.col("needed"),
            F.transform("commands", lambda c: F.replace(F.split(c, " ")[0], F.lit(";"), F.lit(""))))
        ).alias("pos", "m")).select("mailbox_id", "rule_seq", "target", "pos",
                                    F.col("m.ok").alias("supported"), F.col("m.text").alias("message"))
