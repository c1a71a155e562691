"""Rules run over messages (R14, J7): which rule matches which message, hits and overlap.

A rule is a list of tests that must all hold (addresses, subject, size, the tests of
its search, some negated) and a list that must not hold as a whole (the search that a
message must not have).  Rules that cannot be evaluated in full are refused with
the first reason for which they could not be converted either.

Pairs are narrowed by an equi-join before any test runs: a rule is indexed by
its most selective test (an address; else the first three letters of a subject; else the
powers of two that its size bound leaves), and a message by its own addresses,
three-letter parts and size.  Only rules of none of these meet every message of their mailbox.
A message goes to the join only with keys that a rule of its mailbox has: the indexed rules are written to
the shared folder once, and a bitmap of their keys, sized by their number, tells the others
(by chance it lets some of these through, which then meet no rule).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import headers as H
from ..session import shared_path
from . import rules as R

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GRAM = 3
ADDRESSES = ["from", "to", "cc"]
#: Bits of the bitmap of keys: at least 16 for each key, within these bounds (128 KB to 32 MB); beyond them it tells fewer apart.
_BITS_A_KEY, _LEAST_BITS, _MOST_BITS, _BUCKET = 16, 1 << 20, 1 << 28, 1 << 15
_ITEM = "struct<field:string,op:string,value:string,num:bigint,negated:boolean>"


def _folded(c: Column) -> Column:
    """Compared without regard to the case of ASCII letters."""
    return F.translate(c, _UPPER, _LOWER)


def mail_from_view(v: DataFrame) -> DataFrame:
    """mailbox_id, msg_seq, the addresses from, to and cc (lists), subject and size_bytes of the adapter's rows."""
    def parsed(*columns: str) -> Column:
        # The distinct addresses without nulls; array_compact is a lambda, beneath which nothing is compiled and each trim is made many times over.
        return F.array_except(F.array(*[H.parse_sender(F.col(c)) for c in columns]), F.array(F.lit(None).cast("string")))

    return v.select("mailbox_id", "msg_seq", parsed("from1").alias("from"), parsed("to1", "to2").alias("to"), parsed("cc1").alias("cc"),
                    _folded(F.col("subject")).alias("subject"), "size_bytes")


def _item(field: Column, op: Column, value: Column, num: Column, negated: Column) -> Column:
    return F.struct(field.alias("field"), op.alias("op"), _folded(value).alias("value"), num.cast("bigint").alias("num"), negated.alias("negated"))


def _searched(prefix: str) -> Column:
    """The tests of a parsed search."""
    def one(negated: bool):
        return lambda t: _item(t["field"], t["op"], t["value"], t["num"], F.lit(negated))

    return F.concat(F.transform(prefix + "tests", one(False)), F.transform(prefix + "negated", one(True)))


def rule_tests(rules: DataFrame) -> DataFrame:
    """mailbox_id, rule_seq, tests, unless (tests that must not all hold), keys of the index, and the reason of a refusal."""
    df = R.with_conditions(R.with_searches(R.active_fields(rules)))
    a = lambda n: F.col("a_" + n)
    none = F.lit(None).cast("string")
    units = F.create_map(*[x for k, v in K.SIZE_UNITS.items() for x in (F.lit(k), F.lit(v))])
    amount = a("size").try_cast("bigint") * F.try_element_at(units, a("sizeUnit"))
    no = F.lit(False)
    own = F.array_compact(F.array(
        *[F.when(a(n).isNotNull(), _item(F.lit(n), F.lit("is"), a(n), F.lit(None), no)) for n in ("from", "to")],
        F.when(a("subject").isNotNull(), _item(F.lit("subject"), F.lit("contains"), a("subject"), F.lit(None), no)),
        F.when(a("size").isNotNull(), _item(F.lit("size"), F.when(a("sizeOperator") == "s_sl", "over").otherwise("under"), none, amount, no))))
    reasons = F.concat(F.coalesce("unknown", F.array().cast("array<string>")), F.col("field_issues"),
                       F.array_compact(F.array(*[F.when(a(n).isNotNull(), F.lit(K.R_NEVER.format(name=n))) for n in K.NEVER_CONVERTIBLE if n in K.CRITERIA])),
                       F.col("condition_issues"), F.when(F.size("tests") == 0, F.array(F.lit(K.R_NO_CONDITION))).otherwise(F.array().cast("array<string>")))
    told = df.select("mailbox_id", "rule_seq", F.try_element_at(reasons, F.lit(1)).alias("reason"),
                     F.concat(own, _searched("hw_")).cast(f"array<{_ITEM}>").alias("tests"), _searched("dw_").cast(f"array<{_ITEM}>").alias("unless"))
    return told.withColumn("keys", F.when(F.col("reason").isNull(), _rule_keys(F.col("tests"))))


def _bits(c: Column) -> Column:
    return F.length(F.bin(c))


def _rule_keys(tests: Column) -> Column:
    """The keys of which a message that a rule matches has exactly one."""
    positive = F.filter(tests, lambda t: ~t["negated"])

    def first(condition) -> Column:
        return F.get(F.filter(positive, condition), 0)

    address = first(lambda t: t["op"] == "is")
    subject = first(lambda t: (t["field"] == "subject") & (F.length(t["value"]) >= _GRAM))
    size = first(lambda t: t["field"] == "size")
    bits = F.when(size["op"] == "over", F.sequence(_bits(size["num"]), F.lit(64))).otherwise(F.sequence(F.lit(1), _bits(size["num"])))
    return (F.when(address.isNotNull(), F.array(F.concat_ws(":", address["field"], address["value"])))
            .when(subject.isNotNull(), F.array(F.concat(F.lit("subject:"), F.substring(subject["value"], 1, _GRAM))))
            .when(size.isNotNull(), F.transform(bits, lambda b: F.concat(F.lit("size:"), b.cast("string"))))
            .otherwise(F.array(F.lit("any"))))


def _message_keys() -> Column:
    def named(n: str) -> Column:
        return F.transform(n, lambda x: F.concat(F.lit(n + ":"), x))

    last = F.greatest(F.length("subject") - _GRAM + 1, F.lit(1))
    grams = F.transform(F.sequence(F.lit(1), last), lambda k: F.concat(F.lit("subject:"), F.substring(F.col("subject"), k, F.lit(_GRAM))))
    return F.concat(*map(named, ADDRESSES), F.coalesce(F.array_distinct(grams), F.array().cast("array<string>")),
                    F.array(F.concat(F.lit("size:"), _bits(F.col("size_bytes")).cast("string")), F.lit("any")))


def _holds(t: Column) -> Column:
    """Whether a test holds for the message; of a missing header none does, and its negation does."""
    listed = F.lit(False)
    for n in ADDRESSES:
        listed = F.when(t["field"] == n, F.array_contains(n, t["value"])).otherwise(listed)
    plain = (F.when(t["op"] == "over", F.col("size_bytes") > t["num"]).when(t["op"] == "under", F.col("size_bytes") < t["num"])
             .when(t["op"] == "contains", F.contains("subject", t["value"])).otherwise(listed))
    return F.coalesce(plain, F.lit(False)) != t["negated"]


def _place(bits: int) -> Column:
    return F.pmod(F.xxhash64("mailbox_id", "key"), F.lit(bits))


def _bitmap(indexed: DataFrame, bits: int) -> DataFrame:
    """bucket and words (8 bytes each) of a bitmap in which every (mailbox_id, key) is found."""
    held = indexed.where(F.col("key").isNotNull()).select(F.floor(_place(bits) / _BUCKET).alias("bucket"), (_place(bits) % _BUCKET).alias("bit"))
    word = lambda k: F.conv(F.hex(F.substring(F.col("bitmap"), k * 8 + 1, F.lit(8))), 16, -10).cast("bigint")
    return held.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap")).select(
        "bucket", F.transform(F.sequence(F.lit(0), F.lit(_BUCKET // 64 - 1)), word).alias("words"))


def _asked(keyed: DataFrame, bitmap: DataFrame, bits: int) -> DataFrame:
    """The rows whose key a rule of their mailbox may have."""
    told = keyed.withColumns({"bucket": F.floor(_place(bits) / _BUCKET), "bit": (_place(bits) % _BUCKET).cast("int")}).join(F.broadcast(bitmap), "bucket")
    # A word's first byte is its highest.
    at = (F.lit(7) - F.floor(F.col("bit") % 64 / 8).cast("int")) * 8 + F.col("bit") % 8
    return told.where(F.getbit(F.get("words", F.floor(F.col("bit") / 64).cast("int")), at) == 1).select(*keyed.columns)


def _met(messages: DataFrame, tests: DataFrame, kind: str) -> DataFrame:
    """Rules and the messages that share a key, each pair with matches."""
    spark = tests.sparkSession
    path = shared_path(spark, "rule-tests")
    tests.write.parquet(path)
    written = spark.read.schema(tests.schema).parquet(path)
    n = written.agg(F.sum(F.size("keys")).alias("n")).first().n or 0
    bits = min(max(1 << (_BITS_A_KEY * n).bit_length(), _LEAST_BITS), _MOST_BITS)
    indexed = written.select("*", F.explode_outer("keys").alias("key")).drop("keys")
    # No message is without keys; a plain explode would have a filter made of all that its keys are parsed from.
    keyed = messages.select("*", F.explode_outer(_message_keys()).alias("key"))
    matches = F.col("msg_seq").isNotNull() & F.forall("tests", _holds) & ~((F.size("unless") > 0) & F.forall("unless", _holds))
    # Never broadcast by the size of their files: rules much alike are hundreds of times smaller there than as rows with keys.
    return indexed.hint("merge").join(_asked(keyed, _bitmap(indexed, bits), bits), ["mailbox_id", "key"], kind).withColumn("matches", matches)


def rule_matches(messages: DataFrame, tests: DataFrame) -> DataFrame:
    """mailbox_id, msg_seq and rule_seq of each match."""
    return _met(messages, tests, "inner").where("matches").select("mailbox_id", "msg_seq", "rule_seq")


def rule_hits(messages: DataFrame, tests: DataFrame) -> DataFrame:
    """Every rule, with verdict (matched, unmatched or refused), hits and the reason of a refusal."""
    per = _met(messages, tests, "left").groupBy("mailbox_id", "rule_seq").agg(F.count_if("matches").alias("hits"), F.first("reason").alias("reason"))
    verdict = F.when(F.col("reason").isNotNull(), "refused").when(F.col("hits") > 0, "matched").otherwise("unmatched")
    return per.select("mailbox_id", "rule_seq", verdict.alias("verdict"), "hits", "reason")


def rule_overlap(matches: DataFrame) -> DataFrame:
    """For each mailbox, the messages that any rule matches and those that several do."""
    per = matches.groupBy("mailbox_id", "msg_seq").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("mailbox_id").agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("n") > 1).alias("overlapping"))
