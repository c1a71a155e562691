"""Registry of runnable queries: name -> builder(spark, sf_dir) -> DataFrame.

Each builder reads the given tables (through the adapter views of
``sources.adapters``) and returns a lazy DataFrame; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import headers as H
from ..operators import mailbox as MB
from ..sources.adapters import view

Builder = Callable[[SparkSession, str], DataFrame]


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return MB.message_facts(MB.messages_from_view(view(spark, sf, "v_msgs")))


def mailbox_builders() -> dict[str, Builder]:
    b: dict[str, Builder] = {}
    b["message_id"] = lambda s, sf: _facts(s, sf).select("mailbox_id", "file_seq", "msg_seq", "message_id")
    b["sender_normalize"] = lambda s, sf: (
        view(s, sf, "v_msgs").select("mailbox_id", "msg_seq", F.posexplode(F.array_compact(F.array("from1", "from2"))).alias("pos", "value"))
        .select("mailbox_id", "msg_seq", "pos", H.parse_sender(F.col("value")).alias("email")))
    b["label_split"] = lambda s, sf: MB.label_rows(_facts(s, sf))
    b["sent_messages"] = lambda s, sf: MB.sent_messages(_facts(s, sf))
    b["sender_candidates"] = lambda s, sf: MB.sender_counts(_facts(s, sf))
    b["top_senders"] = lambda s, sf: MB.top_senders(MB.sender_counts(_facts(s, sf)), 3)
    b["sender_ranking"] = lambda s, sf: MB.sender_ranking(MB.sender_counts(_facts(s, sf)))
    b["duplicate_counts"] = lambda s, sf: MB.duplicate_counts(_facts(s, sf))
    b["mailbox_stats"] = lambda s, sf: MB.mailbox_stats(_facts(s, sf))
    b["label_inventory"] = lambda s, sf: MB.ordered_labels(MB.label_inventory(_facts(s, sf)))
    b["warning_summary"] = lambda s, sf: MB.warning_summary(MB.mailbox_stats(_facts(s, sf)))
    b["invalid_from"] = lambda s, sf: (
        _facts(s, sf).groupBy("mailbox_id").agg(F.sum("invalid_from").cast("long").alias("invalid_from")))
    return b


def builders() -> dict[str, Builder]:
    out: dict[str, Builder] = {}
    out.update(mailbox_builders())
    out.update(search_builders())
    out.update(rule_builders())
    out.update(input_builders())
    out.update(folder_builders())
    out.update(matching_builders())
    out.update(mbox_builders())
    out.update(stream_builders())
    out.update(feed_builders())
    return out


def oracles() -> dict[str, str]:
    from . import oracle_sql as O
    out: dict[str, str] = {}
    out.update(O.mailbox_queries())
    out.update(O.search_queries())
    out.update(O.rule_queries())
    out.update(O.input_queries())
    out.update(O.folder_queries())
    out.update(O.matching_queries())
    out.update(O.conversion_queries())
    out.update(O.mbox_queries())
    out.update(O.feed_queries())
    return out


def search_builders() -> dict[str, Builder]:
    from ..operators import search as S

    def parsed(s: SparkSession, sf: str) -> DataFrame:
        return S.parse_queries(view(s, sf, "v_searches"))

    b: dict[str, Builder] = {}
    b["query_gates"] = lambda s, sf: parsed(s, sf).select(
        "query_id", F.array_join("gates", " | ").alias("gates"))
    b["query_tokens"] = lambda s, sf: parsed(s, sf).select(
        "query_id", F.posexplode("tokens").alias("pos", "token"))
    b["query_parse"] = lambda s, sf: parsed(s, sf).select(
        "query_id",
        F.size("tests").cast("long").alias("n_tests"),
        F.size("negated").cast("long").alias("n_negated"),
        S.test_text(F.col("tests")).alias("tests_text"),
        S.test_text(F.col("negated")).alias("negated_text"),
        F.array_join("unsupported", " | ").alias("unsupported_text"),
    )
    # One generator over both lists (no union, no filter on parsed columns: a
    # pushed-down filter would copy the whole parse into its condition).
    b["query_tests"] = lambda s, sf: parsed(s, sf).select(
        "query_id", F.inline(F.concat(
            F.transform("tests", lambda t, i: F.struct(F.lit(False).alias("negated"), i.alias("pos"),
                                                       t["field"].alias("field"), t["op"].alias("op"),
                                                       t["value"].alias("value"), t["num"].alias("num"),
                                                       t["raw"].alias("raw"))),
            F.transform("negated", lambda t, i: F.struct(F.lit(True).alias("negated"), i.alias("pos"),
                                                         t["field"].alias("field"), t["op"].alias("op"),
                                                         t["value"].alias("value"), t["num"].alias("num"),
                                                         t["raw"].alias("raw"))))))
    # describeTests([]) is the empty string, so every query gets a row.
    b["query_describe"] = lambda s, sf: parsed(s, sf).select(
        "query_id", S.describe_tests(F.col("tests")).alias("description"))
    return b


def rule_builders() -> dict[str, Builder]:
    from ..operators import rules as R

    def rules_in(s: SparkSession, sf: str) -> DataFrame:
        return view(s, sf, "v_rules").withColumn("unknown", F.array().cast("array<string>"))

    def converted(s: SparkSession, sf: str) -> DataFrame:
        return R.convert_rules(rules_in(s, sf))

    def final(s: SparkSession, sf: str) -> DataFrame:
        return R.finalize(converted(s, sf))

    b: dict[str, Builder] = {}
    b["rule_active_fields"] = lambda s, sf: R.active_fields(rules_in(s, sf)).select(
        "mailbox_id", "rule_seq",
        F.array_join(F.filter(F.array(*[F.when(F.col("a_" + n).isNotNull(), F.concat(F.lit(n + "="), F.col("a_" + n)))
                                        for n in R.PROPS]), lambda x: x.isNotNull()), ", ").alias("active"),
        F.array_join("field_issues", " | ").alias("field_issues"))
    b["rule_description"] = lambda s, sf: rules_in(s, sf).select(
        "mailbox_id", "rule_seq", R.description(rules_in(s, sf).columns).alias("description"))
    b["rule_status"] = lambda s, sf: final(s, sf).select(
        "mailbox_id", "rule_seq", "rule_id", "target", "status", "enabled",
        F.array_join("issues", " | ").alias("issues"),
        F.array_join("required_extensions", ",").alias("required_extensions"))
    b["rule_gaps"] = lambda s, sf: final(s, sf).select(
        "mailbox_id", "rule_seq", "rule_id", F.posexplode("issues").alias("pos", "issue")).select(
        "mailbox_id", "rule_seq", "pos", F.concat("rule_id", F.lit(": "), "issue").alias("gap"))
    b["status_summary"] = lambda s, sf: final(s, sf).groupBy("mailbox_id").agg(
        F.count(F.lit(1)).alias("rules"),
        F.count_if(F.col("status") == "converted").alias("converted"),
        F.count_if(F.col("status") == "approximate").alias("approximate"),
        F.count_if(F.col("status") == "skipped").alias("skipped"))
    b["required_extensions"] = lambda s, sf: R.required_extensions(final(s, sf))
    b["rule_script"] = lambda s, sf: R.script_blocks(final(s, sf))
    b["capability_check"] = lambda s, sf: R.capability_rows(converted(s, sf))
    b["capability_matrix"] = lambda s, sf: R.capability_rows(converted(s, sf)).groupBy("target", "message").agg(
        F.max("supported").alias("supported"), F.count(F.lit(1)).alias("rules"))
    from ..sinks import reports as RP

    b["gap_lines"] = lambda s, sf: RP.gap_lines(b["rule_gaps"](s, sf))
    b["review_filter"] = lambda s, sf: RP.with_status(final(s, sf), "approximate").select("mailbox_id", "rule_seq", "rule_id", "status")
    b["recipe_blocks"] = lambda s, sf: RP.recipe_blocks(final(s, sf))
    b["redact_issues"] = lambda s, sf: final(s, sf).select("mailbox_id", "rule_seq", "description", F.posexplode("issues").alias("pos", "issue")).select(
        "mailbox_id", "rule_seq", "pos", RP.redacted(F.col("issue"), F.col("description")).alias("issue"))
    return b


def input_builders() -> dict[str, Builder]:
    from ..sources import archives as A
    from ..sources import files as FL

    def audit(s: SparkSession, sf: str) -> DataFrame:
        return A.entry_audit(view(s, sf, "v_archives"), A.REFERENCE)

    b: dict[str, Builder] = {}
    b["archive_audit"] = audit
    b["archive_atomic"] = lambda s, sf: A.atomic_files(view(s, sf, "v_archives"), A.REFERENCE)
    b["archive_batch_budget"] = lambda s, sf: A.batch_budget(audit(s, sf), K.MAX_BATCH_EXPANDED)
    b["expanded_inputs"] = lambda s, sf: A.expanded_inputs(
        FL.admission(view(s, sf, "v_files"), K.MAX_XML, K.MAX_ARCHIVE), A.atomic_files(view(s, sf, "v_archives"), A.REFERENCE), A.batch_budget(audit(s, sf), K.MAX_BATCH_EXPANDED))
    b["input_admission"] = lambda s, sf: FL.admission(view(s, sf, "v_files"), K.MAX_XML, K.MAX_ARCHIVE).select(
        "file_seq", "path", "size", "kind", "verdict")
    b["sent_hint"] = lambda s, sf: FL.sent_hint(view(s, sf, "v_files"))
    b["import_dedup"] = lambda s, sf: FL.import_dedup(view(s, sf, "v_files"), K.MAX_XML)
    return b


def folder_builders() -> dict[str, Builder]:
    from ..operators import folders as FD
    from ..operators import rules as R
    from ..operators import targets as T

    def target() -> Column:
        """The target of a mailbox; v_rules has the same.  Columns are made in builders only: listing queries needs no session."""
        return F.element_at(F.array(*[F.lit(t["id"]) for t in K.TARGETS]), (F.col("mailbox_id") % len(K.TARGETS) + 1).cast("int"))

    def labels(s: SparkSession, sf: str) -> DataFrame:
        return MB.label_inventory(_facts(s, sf)).select("mailbox_id", "label")

    def plan(s: SparkSession, sf: str) -> DataFrame:
        return FD.plan_folders(labels(s, sf).withColumn("reserved", FD.reserved_of(target())))

    def rule_labels(s: SparkSession, sf: str) -> DataFrame:
        return view(s, sf, "v_rules").select("mailbox_id", F.col("p_label").alias("label"))

    def mapping(s: SparkSession, sf: str) -> DataFrame:
        chosen = view(s, sf, "v_overrides").where(F.col("pick").isin(3, 5, 7, 9, 11))
        return FD.mapping_rows(plan(s, sf), rule_labels(s, sf), chosen)

    def mapped_rules(s: SparkSession, sf: str) -> DataFrame:
        rules = view(s, sf, "v_rules").withColumn("unknown", F.array().cast("array<string>"))
        return R.convert_rules(rules, mapping(s, sf).select("mailbox_id", "label", "folder"))

    b: dict[str, Builder] = {}
    b["folder_plan"] = lambda s, sf: plan(s, sf).select(
        "mailbox_id", "label", "folder", F.array_join("notes", " | ").alias("notes"))
    b["folder_sanitize"] = lambda s, sf: labels(s, sf).select(
        "mailbox_id", "label", F.array_join(FD.sanitize_path(F.col("label")), "/").alias("sanitized"))
    b["all_labels"] = lambda s, sf: (labels(s, sf).union(rule_labels(s, sf).where(F.col("label") != "")).distinct())
    b["folder_mapping"] = lambda s, sf: mapping(s, sf).select(
        "mailbox_id", "label", "folder", F.array_join("notes", " | ").alias("notes"))
    b["mapping_errors"] = lambda s, sf: FD.mapping_errors(mapping(s, sf).withColumn("reserved", FD.reserved_of(target())))
    from ..sinks import reports as RP

    b["folder_manifest"] = lambda s, sf: RP.manifest_rows(mapping(s, sf))
    b["senders_csv"] = lambda s, sf: RP.sender_lines(MB.sender_counts(_facts(s, sf)))
    templates = [x.split("{name}")[0] for x in (K.R_BAD_FOLDER, K.R_COLLISION)]

    def folder_issues() -> Column:
        return F.filter("issues", lambda i: F.startswith(i, F.lit(templates[0])) | F.startswith(i, F.lit(templates[1])))

    b["rule_destinations"] = lambda s, sf: mapped_rules(s, sf).select(
        "mailbox_id", "rule_seq", F.array_join(F.filter("commands", lambda c: c.startswith("fileinto ")), "").alias("destination"),
        F.array_join(folder_issues(), " | ").alias("folder_issue"))
    b["folder_collisions"] = lambda s, sf: mapped_rules(s, sf).select("mailbox_id", "rule_seq", F.explode_outer(folder_issues()).alias("issue")).where(
        F.startswith(F.col("issue"), F.lit(templates[1])))

    def targeted(s: SparkSession, sf: str) -> DataFrame:
        chosen = view(s, sf, "v_specials").where("pick = 0").select("mailbox_id", F.col("archiveFolder").alias("archive_folder"), F.col("trashFolder").alias("trash_folder"))
        boxes = _facts(s, sf).select("mailbox_id").distinct().withColumn("target", target())
        return T.with_target(boxes.join(chosen, "mailbox_id", "left"))

    b["manifest_heads"] = lambda s, sf: RP.manifest_heads(targeted(s, sf))
    b["special_errors"] = lambda s, sf: FD.special_errors(view(s, sf, "v_specials").where("pick = 0"))
    b["migration_summary"] = lambda s, sf: RP.summary_rows(
        R.finalize(R.convert_rules(view(s, sf, "v_rules").withColumn("unknown", F.array().cast("array<string>")))), mapping(s, sf)).select("mailbox_id", "active", "disabled", "folders")
    return b


def matching_builders() -> dict[str, Builder]:
    from ..operators import matching as MA

    def met(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
        rules = view(s, sf, "v_rules").withColumn("unknown", F.array().cast("array<string>"))
        return MA.mail_from_view(view(s, sf, "v_mail")), MA.rule_tests(rules)

    b: dict[str, Builder] = {}
    b["rule_match"] = lambda s, sf: MA.rule_matches(*met(s, sf))
    b["rule_hits"] = lambda s, sf: MA.rule_hits(*met(s, sf))
    b["rule_overlap"] = lambda s, sf: MA.rule_overlap(MA.rule_matches(*met(s, sf)))
    b["source_summary"] = lambda s, sf: _facts(s, sf).groupBy("mailbox_id", "file_seq").agg(F.count(F.lit(1)).alias("records"))
    raw = ("from1", "from2", "label1", "label2")  # the header values that are decoded
    b["replacement_count"] = lambda s, sf: view(s, sf, "v_msgs").where("header_valid").select(
        "mailbox_id", "file_seq", "msg_seq", H.replacement_count(F.concat_ws("", *raw)).cast("long").alias("n")).groupBy("mailbox_id", "file_seq").agg(F.sum("n").alias("replacements"))
    return b


def mbox_builders() -> dict[str, Builder]:
    from ..sources import mbox as MX

    def rows(s: SparkSession, sf: str) -> DataFrame:
        return MX.message_lines(view(s, sf, "v_mbox_lines"), K.MAX_LINE)

    def messages(s: SparkSession, sf: str) -> DataFrame:
        return MX.mbox_messages(view(s, sf, "v_mbox_lines"), K.MAX_LINE, K.MAX_HEADERS)

    b: dict[str, Builder] = {}
    b["mbox_messages"] = lambda s, sf: messages(s, sf).select(
        *MX.MESSAGE, "header_count", "header_valid", *[F.array_join(c, " | ").alias(c) for c in ("from_values", "id_values", "label_values")])
    b["header_bounds"] = lambda s, sf: MX.message_bounds(rows(s, sf), K.MAX_HEADERS).select(*MX.MESSAGE, "header_chars", "over_bounds")
    b["header_fields"] = lambda s, sf: MX.header_fields(rows(s, sf))
    b["header_decode"] = lambda s, sf: MX.header_fields(rows(s, sf)).select(*MX.MESSAGE, "field_seq", "name", H.decode_header(F.col("value")).alias("decoded"))
    b["mbox_senders"] = lambda s, sf: MB.sender_counts(MB.message_facts(messages(s, sf).withColumnsRenamed({"file_id": "file_seq"}).withColumn("sent_hint", F.lit(False))))
    return b


def stream_builders() -> dict[str, Builder]:
    from ..operators import streams as ST
    from ..session import shared_path

    def streamed(s: SparkSession, sf: str) -> DataFrame:
        """The messages arrive in two lots of files; the job runs after each, from where it stopped."""
        landing, table, state = (shared_path(s, n) for n in ("mail-landing", "mail-units", "mail-state"))
        mail = view(s, sf, "v_msgs")
        for lot in (0, 1):
            mail.where(F.col("msg_seq") % 2 == lot).write.mode("append").parquet(landing)
            facts = MB.message_facts(MB.messages_from_view(ST.message_stream(s, landing, mail.schema)))
            ST.run_once(ST.unit_stream(facts), table, state)
        return ST.latest_units(s, table)

    def in_batches(s: SparkSession, sf: str) -> DataFrame:
        """The first three files of each mailbox, then the others against the ids that these have counted."""
        facts = _facts(s, sf)
        path = shared_path(s, "counted-ids")
        units = MB.first_eligible(facts.where(F.col("file_seq") < 3))
        units.where(F.col("message_id").isNotNull()).select("mailbox_id", "message_id").write.parquet(path)
        counted = s.read.parquet(path)
        more, _ = ST.next_batch(facts.where(F.col("file_seq") >= 3), counted, ST.counted_bitmap(counted))
        return (MB.sender_counts(facts.where(F.col("file_seq") < 3)).unionByName(more).groupBy("mailbox_id", "email").agg(F.sum("messages").alias("messages")))

    b: dict[str, Builder] = {}
    b["stream_dedup"] = lambda s, sf: streamed(s, sf).where(F.col("first_email").isNotNull() & F.col("message_id").isNotNull()).select("mailbox_id", "message_id", F.col("first_email").alias("email"))
    b["stream_senders"] = lambda s, sf: ST.running_counts(streamed(s, sf))
    b["incremental_senders"] = in_batches
    return b


def feed_builders() -> dict[str, Builder]:
    from ..sources import feed as FE

    def feeds(s: SparkSession, sf: str) -> DataFrame:
        entries = F.transform(F.array_sort(F.collect_list(F.struct("place", "entry"))), lambda x: x["entry"])
        return (view(s, sf, "v_feed_entries").groupBy("mailbox_id").agg(F.first("head").alias("head"), entries.alias("entries"))
                .select("mailbox_id", F.lit("mail.xml").alias("file_id"), F.concat("head", F.array_join("entries", chr(10)), F.lit("</feed>")).alias("text")))

    b: dict[str, Builder] = {}
    b["filter_feed"] = lambda s, sf: FE.feed_verdicts(feeds(s, sf)).select("mailbox_id", "verdict")
    from ..operators import rules as R
    from ..sinks import reports as RP

    def redacted_unknown(s: SparkSession, sf: str) -> DataFrame:
        rules = FE.filter_rules(feeds(s, sf))
        told = rules.select("mailbox_id", "rule_seq", R.description(rules.columns).alias("description"), F.posexplode_outer("unknown").alias("pos", "issue"))
        return told.where(F.col("pos").isNotNull()).select("mailbox_id", "rule_seq", "pos", RP.redacted(F.col("issue"), F.col("description")).alias("issue"))

    b["redact_unknown"] = redacted_unknown
    b["filter_rules"] = lambda s, sf: FE.filter_rules(feeds(s, sf)).select(
        "mailbox_id", "rule_seq", "rule_id", *[f"p_{n}" for n in ("from", "to", "subject", "hasTheWord", "size", "label", "shouldStar")], F.array_join("unknown", " | ").alias("unknown"))
    return b
