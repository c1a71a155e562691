"""Filter feeds as rules (S4): Atom XML in a text column, to the rule table.

Input: ``(mailbox_id, file_id, text)``, one feed a row.  A feed is refused as a whole
if it has a DOCTYPE, if its root is no Atom ``feed`` or if an entry is not well-formed.
Entries become rows before they are parsed, so a large feed spreads over tasks.
``from_xml`` reads each; names keep their namespace as an attribute, since the reader
drops prefixes.  Within an entry a prefix is taken to mean one namespace.

Properties that are nameless, value-less, of a foreign namespace, or repeat the name of
one before become diagnostics, as do unknown names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K

_ROOT = r"\A\ufeff?(?:\s|<\?[\s\S]*?\?>|<!--[\s\S]*?-->)*<((?:[\w.-]+:)?)feed((?:\s[^>]*)?)>"
_ASIDE = r"<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>"
_ENTRY = r"<(?:[\w.-]+:)?entry(?:\s[^>]*)?(?:/>|>[\s\S]*?</(?:[\w.-]+:)?entry\s*>)"
_SCHEMA = "id array<struct<_ns:string,_VALUE:string>>, property array<struct<_ns:string,_name:string,_value:string>>, _broken string"
_OPTIONS = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false", "columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}


def _namespace(prefix: Column, *scopes: Column) -> Column:
    """The namespace that a prefix (``p:`` or empty) is bound to, in the first scope that says so."""
    name = F.when(prefix == "", F.lit("xmlns")).otherwise(F.concat(F.lit("xmlns:"), F.replace(prefix, F.lit(":"), F.lit(""))))
    found = [F.nullif(F.call_function("regexp_extract", s, F.concat(F.lit(r"\s"), name, F.lit("\\s*=\\s*[\"']([^\"']*)[\"']")), F.lit(1)), F.lit("")) for s in scopes]
    return F.coalesce(*found, F.lit(""))


def feed_verdicts(feeds: DataFrame) -> DataFrame:
    """Add root (the attributes of the root element) and verdict: accepted, doctype or not_a_feed."""
    plain = F.regexp_replace("text", _ASIDE, "")
    prefix, attributes = F.regexp_extract("text", _ROOT, 1), F.regexp_extract("text", _ROOT, 2)
    verdict = (F.when(plain.rlike(r"(?i)<!DOCTYPE"), "doctype")
               .when(~F.col("text").rlike(_ROOT) | (_namespace(prefix, attributes) != K.ATOM_NAMESPACE), "not_a_feed").otherwise("accepted"))
    return feeds.select("*", attributes.alias("root"), F.coalesce(verdict, F.lit("not_a_feed")).alias("verdict"))


def feed_entries(feeds: DataFrame) -> DataFrame:
    """The entries of accepted feeds: mailbox_id, file_id, rule_seq (from 1), root, entry."""
    accepted = feed_verdicts(feeds).where(F.col("verdict") == "accepted")
    found = F.regexp_extract_all(F.regexp_replace("text", _ASIDE, ""), F.lit(_ENTRY), 0)
    return accepted.select("mailbox_id", "file_id", "root", F.posexplode(found).alias("at", "entry")).select(
        "mailbox_id", "file_id", (F.col("at") + 1).alias("rule_seq"), "root", "entry")


def parsed_entries(entries: DataFrame) -> DataFrame:
    """ids and properties of each entry, with their namespaces, and broken."""
    named = F.regexp_replace("entry", r"<((?:[\w.-]+:)?)(property|id)(?=[\s/>])", '<$2 ns="$1"')
    named = F.regexp_replace(F.regexp_replace(named, r"</(?:[\w.-]+:)?(property|id)\s*>", "</$1>"), r"<(/?)(?:[\w.-]+:)([\w.-]+)", "<$1$2")
    # Other prefixed attributes than declarations are of no use, and their prefixes are not declared in the entry alone.
    named = F.regexp_replace(named, r"\s(?!xmlns)[\w.-]+:[\w.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*')", "")
    rows = entries.withColumn("x", F.from_xml(named, _SCHEMA, _OPTIONS))
    return rows.select("mailbox_id", "file_id", "rule_seq", F.col("x._broken").isNotNull().alias("broken"),
                       *[F.transform(f"x.{n}", lambda p: p.withField("_ns", _namespace(p["_ns"], F.col("entry"), F.col("root")))).alias(n) for n in ("id", "property")])


def filter_rules(feeds: DataFrame) -> DataFrame:
    """The rule table of the feeds: mailbox_id, file_id, rule_seq, rule_id, a column p_<name> for each known property, and unknown."""
    rows = parsed_entries(feed_entries(feeds))
    bad = rows.where("broken").select("mailbox_id", "file_id").distinct()
    rows = rows.join(bad, ["mailbox_id", "file_id"], "left_anti")
    sound = F.transform("property", lambda p: p.withField("sound", (p["_ns"] == K.APPS_NAMESPACE) & F.coalesce(p["_name"] != "", F.lit(False)) & p["_value"].isNotNull()))
    rows = rows.withColumn("property", F.coalesce(sound, F.array().cast("array<struct<_ns:string,_name:string,_value:string,sound:boolean>>")))
    first = F.transform("property", lambda p, i: p.withField(
        "sound", p["sound"] & ~F.exists(F.slice("property", F.lit(1), i), lambda q: q["sound"] & (q["_name"] == p["_name"]))))
    rows = rows.withColumn("property", first)
    known = K.CRITERIA + K.ACTIONS

    def told(p: Column) -> Column:
        name = F.when(F.coalesce(p["_name"], F.lit("")) == "", F.lit(K.UNNAMED)).otherwise(p["_name"])
        return (F.when(~p["sound"], F.replace(F.lit(K.R_XML_PROPERTY), F.lit("{name}"), name))
                .when(~p["_name"].isin(*known), F.replace(F.lit(K.R_XML_UNSUPPORTED), F.lit("{name}"), name)))

    def value(name: str) -> Column:
        return F.get(F.filter("property", lambda p: p["sound"] & (p["_name"] == name)), 0)["_value"]

    own = F.filter("id", lambda x: (x["_ns"] == K.ATOM_NAMESPACE) & (F.coalesce(x["_VALUE"], F.lit("")) != ""))
    return rows.select("mailbox_id", "file_id", "rule_seq",
                       F.coalesce(F.try_element_at(own, F.lit(-1))["_VALUE"], F.concat(F.lit("rule-"), F.col("rule_seq").cast("string"))).alias("rule_id"),
                       *[value(n).alias("p_" + n) for n in known], F.array_compact(F.transform("property", told)).alias("unknown"))
