"""Saved-search parsing (Q1-Q8, F12) as one narrow projection over a query table.

Input: ``(query_id, text)``.  A query holds at most 20 tokens before it is
rejected, so every per-token and cross-token check runs inside the row with
array functions: no explode, no shuffle, and a hot query id cannot skew
anything.  Output keeps the reference's atomicity: any reason empties both
test lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.headers import let
from ..functions.text import WS, is_blank, js_trim, json_string, unsafe, utf16_length

# Quoted span of the search scanner: a backslash always consumes the next char.
_SPAN = r'"(?:\\[\s\S]|[^"\\])*+"'
_TERMINATED = rf'\A(?:[^"]|{_SPAN})*+\z'
_SPANS = r'"(?:\\[\s\S]?|[^"\\])*+"?|[^"]++'
_TOKEN = rf'(?:[^"{WS}]|"(?:\\[\s\S]|[^"\\])*+(?:"|\z))++'
_KEY = r"^([a-zA-Z_]+):"
_QUOTED_VALUE = r'^"(?:[^"\\]++|\\["\\])*+"\z'
_NESTED = rf"(?:^|[{WS}])(?:AND|OR|NOT)(?:[{WS}]|\z)"
_SIZE = r"(?i)^(\d+)([KMG]?)\z"
# Possessive throughout: a label of a domain neither begins nor ends with a hyphen, so nothing is to be given back.
MAILBOX = (r"(?i)^[a-z0-9!#$%&'+/=?^_`~-]++(?:\.[a-z0-9!#$%&'+/=?^_`~-]++)*+"
           r"@(?:(?!-)[a-z0-9-]++(?<!-)\.)++(?!-)[a-z0-9-]++(?<!-)\z")

TEST_TYPE = "struct<field:string,op:string,value:string,num:bigint,raw:string>"


def _bad_escapes(text: Column) -> Column:
    """Number of backslash escapes inside quotes that are not \\" or \\\\ (one reason each)."""
    spans = F.filter(F.regexp_extract_all(text, F.lit(_SPANS), 0), lambda s: s.startswith('"'))
    pairs = F.flatten(F.transform(spans, lambda s: F.regexp_extract_all(s, F.lit(r"\\[\s\S]?"), 0)))
    return F.size(F.filter(pairs, lambda p: ~p.rlike(r'^\\["\\]\z')))


def _token(raw: Column, i: Column) -> Column:
    """Per-token struct: polarity, classified test and the first failing reason.

    What is used more than once is bound, so that each pattern runs once a token.
    """
    neg = raw.startswith("-")

    def keyed(text: Column) -> Column:
        return let(F.lower(F.regexp_extract(text, _KEY, 1)), lambda key: let(
            F.when(key != "", F.substr(text, F.length(key) + 2)).otherwise(text), lambda rest: let(
                F.when(rest.startswith('"'), F.regexp_replace(rest.substr(F.lit(2), F.length(rest) - 2), r'\\(["\\])', "$1")).otherwise(rest),
                lambda literal: classified(text, key, rest, literal))))

    def classified(text: Column, key: Column, rest: Column, literal: Column) -> Column:
        quoted = rest.startswith('"')
        is_size_key = key.isin("larger", "smaller", "size")
        is_address = key.isin("from", "to", "cc") & literal.contains("@")
        unit = F.upper(F.regexp_extract(literal, _SIZE, 2))
        mult = (F.when(unit == "K", F.lit(1024)).when(unit == "M", F.lit(1048576))
                .when(unit == "G", F.lit(1073741824)).otherwise(F.lit(1)))
        amount = F.when(is_size_key, F.try_multiply(F.regexp_extract(literal, _SIZE, 1).try_cast("decimal(38,0)"), mult.cast("decimal(38,0)")))

        def judged(amount: Column) -> Column:
            reason = (
                F.when(raw == "OR", F.lit(None))
                .when((text == "") | text.startswith("-"), F.lit(K.Q_MINUS))
                .when(text.rlike("[{}]"), F.lit(K.Q_BRACES))
                .when(text.rlike(r"[()*?]"), F.lit(K.Q_PARENS))
                .when(quoted & ~rest.rlike(_QUOTED_VALUE), F.lit(K.Q_QUOTE_SHAPE))
                .when(~quoted & rest.rlike(r'["\\]'), F.lit(K.Q_BARE_QUOTE))
                .when(is_blank(literal), F.lit(K.Q_BLANK))
                .when(literal.contains(":"), F.lit(K.Q_COLON))
                .when(literal.isin("AND", "OR", "NOT") | literal.rlike(_NESTED) | literal.startswith("-"), F.lit(K.Q_NESTED))
                .when(is_address & ~literal.rlike(MAILBOX), F.lit(K.Q_ADDRESS))
                .when(is_size_key & ~literal.rlike(_SIZE), F.lit(K.Q_SIZE_SHAPE))
                .when(is_size_key & (amount.isNull() | (amount > F.lit(K.MAX_SIZE))), F.lit(K.Q_SIZE_RANGE))
                .when((key == "has") & (literal != "attachment"), F.lit(K.Q_HAS))
                .when((key != "") & ~key.isin("from", "to", "cc", "larger", "smaller", "size", "has", "subject"),
                      F.replace(F.lit(K.Q_KEY), F.lit("{key}"), key))
            )
            field = (F.when(is_size_key, F.lit("size")).when(key == "has", F.lit("attachment"))
                     .when(key == "", F.lit("body")).otherwise(key))
            op = (F.when(is_address, F.lit("is")).when(key == "smaller", F.lit("under")).when(is_size_key, F.lit("over"))
                  .when(key == "has", F.lit("is")).otherwise(F.lit("contains")))
            num = amount.try_cast("bigint")
            value = (F.when(is_address, F.lower(literal)).when(is_size_key, num.cast("string"))
                     .when(key == "has", F.lit("attachment")).otherwise(literal))
            return let(reason, lambda r: F.struct(
                i.alias("pos"), raw.alias("raw"), neg.alias("neg"), field.alias("field"), op.alias("op"), value.alias("value"), num.alias("num"),
                F.when(raw == "OR", F.lit(K.Q_OR)).when(r.isNotNull(), F.concat(raw, F.lit("："), r)).alias("reason")))

        return let(amount, judged)

    return let(F.when(neg, raw.substr(F.lit(2), F.length(raw))).otherwise(raw), keyed)


def _test(o: Column) -> Column:
    return F.struct(o["field"].alias("field"), o["op"].alias("op"), o["value"].alias("value"),
                    o["num"].alias("num"), o["raw"].alias("raw"))


def parse_queries(queries: DataFrame, text_col: str = "text", prefix: str = "", *,
                  max_query: int = K.MAX_QUERY, max_tokens: int = K.MAX_TOKENS) -> DataFrame:
    """Parse every saved search: ``tests``, ``negated`` and ordered ``unsupported`` reasons.

    Output columns are prefixed with ``prefix`` so the parser can run inline on
    a table that holds several search columns (rules), without a join.  Searches of
    more than ``max_query`` UTF-16 units or ``max_tokens`` tokens are unsupported.
    """
    p = prefix
    keep_cols = list(queries.columns)
    text = F.col(text_col)
    gates = F.filter(F.array(
        F.when(utf16_length(text) > max_query, F.lit(K.Q_TOO_LONG.replace(str(K.MAX_QUERY), str(max_query)))),
        F.when(unsafe(text), F.lit(K.Q_CONTROL)),
        F.when(is_blank(text), F.lit(K.Q_EMPTY)),
    ), lambda r: r.isNotNull())
    stage1 = queries.withColumn(p + "_gates", gates).withColumn(
        p + "_tokens", F.when(F.size(p + "_gates") == 0, F.regexp_extract_all(text, F.lit(_TOKEN), 0)))
    scan_reasons = F.concat(
        F.array_repeat(F.lit(K.Q_ESCAPE), F.when(text.contains("\\"), _bad_escapes(text)).otherwise(0)),
        F.filter(F.array(
            F.when(text.contains('"') & ~text.rlike(_TERMINATED), F.lit(K.Q_UNCLOSED)),
            F.when(F.size(p + "_tokens") > max_tokens, F.lit(K.Q_TOO_MANY.replace(str(K.MAX_TOKENS), str(max_tokens)))),
        ), lambda r: r.isNotNull()),
    )
    stage2 = stage1.withColumn(
        p + "_phase1", F.when(F.size(p + "_gates") > 0, F.col(p + "_gates")).otherwise(scan_reasons))
    items = F.when(F.size(p + "_phase1") == 0, F.transform(p + "_tokens", _token))
    stage3 = stage2.withColumn(p + "_items", items)

    def conflicts(ok: Column, me: Column) -> Column:
        earlier = F.filter(ok, lambda o: (o["pos"] < me["pos"]) & (o["field"] == me["field"]) & (o["op"] == me["op"]))

        def found(earlier: Column) -> Column:
            both = F.exists(earlier, lambda o: (o["neg"] != me["neg"]) & (o["value"] == me["value"]))
            clash = ((me["op"] == "is") | (me["field"] == "size")) & F.exists(earlier, lambda o: (o["neg"] == me["neg"]) & (o["value"] != me["value"]))
            return F.array_compact(F.array(
                F.when(both, F.concat(me["raw"], F.lit("："), F.lit(K.Q_BOTH_POLARITIES))),
                F.when(clash, F.concat(me["raw"], F.lit("："), F.lit(K.Q_CONFLICT)))))

        return let(earlier, found)

    def size_conflict(ok: Column, neg: bool) -> Column:
        def first(op: str) -> Column:
            return F.get(F.filter(ok, lambda o: (o["neg"] == F.lit(neg)) & (o["field"] == "size") & (o["op"] == op)), 0)["num"]

        return F.when(first("over") >= first("under"), F.lit(K.Q_SIZE_CONFLICT))

    none = F.array().cast("array<string>")

    def crossed(ok: Column) -> Column:
        """Reasons that need two tokens."""
        return F.when(F.size(ok) > 1, F.concat(F.flatten(F.transform(ok, lambda me: conflicts(ok, me))),
                                               F.array_compact(F.array(size_conflict(ok, False), size_conflict(ok, True))))).otherwise(none)

    reasons = F.transform(F.filter(p + "_items", lambda o: o["reason"].isNotNull()), lambda o: o["reason"])
    ok = F.filter(p + "_items", lambda o: o["reason"].isNull())
    unsupported = F.when(F.size(p + "_phase1") > 0, F.col(p + "_phase1")).otherwise(F.concat(reasons, let(ok, crossed)))
    stage4 = stage3.withColumn(p + "unsupported", unsupported)
    empty = F.array().cast(f"array<{TEST_TYPE}>")
    keep = F.size(p + "unsupported") == 0
    return stage4.select(
        *keep_cols,
        F.when(keep, F.transform(F.filter(ok, lambda o: ~o["neg"]), _test)).otherwise(empty).alias(p + "tests"),
        F.when(keep, F.transform(F.filter(ok, lambda o: o["neg"]), _test)).otherwise(empty).alias(p + "negated"),
        p + "unsupported",
        F.col(p + "_tokens").alias(p + "tokens"),
        F.col(p + "_gates").alias(p + "gates"),
    )


def describe_tests(tests: Column) -> Column:
    """Chinese one-line description of a test list (``describeTests``)."""
    names = F.create_map(*[x for k, v in K.FIELD_NAMES.items() for x in (F.lit(k), F.lit(v))])
    ops = F.create_map(*[x for k, v in K.OP_WORDS.items() for x in (F.lit(k), F.lit(v))])

    def one(t: Column) -> Column:
        value = F.when(t["field"] == "size", t["value"]).otherwise(json_string(t["value"]))
        return F.when(t["field"] == "attachment", F.lit(K.ATTACHMENT_WORD)).otherwise(F.concat(
            F.coalesce(F.try_element_at(names, t["field"]), t["field"]),
            F.try_element_at(ops, t["op"]), value,
            F.when(t["field"] == "size", F.lit(K.BYTES_SUFFIX)).otherwise(F.lit("")),
        ))

    return F.array_join(F.transform(tests, one), K.DESCRIBE_JOIN)


def test_text(tests: Column) -> Column:
    """Stable text form of a test list (for reports and oracle comparison)."""
    return F.array_join(F.transform(tests, lambda t: F.concat_ws(
        "|", t["field"], t["op"], t["value"], t["raw"])), " ; ")
