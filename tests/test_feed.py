"""Filter feeds against what an XML library reads from them."""

import xml.etree.ElementTree as ET

from mailshift import constants as K
from mailshift.sources import feed as FE

ATOM, APPS = K.ATOM_NAMESPACE, K.APPS_NAMESPACE
HEAD = f'<?xml version="1.0" encoding="UTF-8"?>\n<feed xmlns="{ATOM}" xmlns:apps="{APPS}">'


def read(text):
    """Rules of a feed: id, properties and diagnostics; None if it is refused."""
    try:
        root = ET.fromstring(text.lstrip("﻿").encode())
    except ET.ParseError:
        return None
    if "<!DOCTYPE" in text or root.tag != f"{{{ATOM}}}feed":
        return None
    rules = []
    for n, entry in enumerate(root.findall(f"{{{ATOM}}}entry")):
        rule_id, props, unknown = f"rule-{n + 1}", {}, []
        for node in entry:
            space, _, local = node.tag[1:].partition("}")
            if local == "id" and space == ATOM:
                rule_id = node.text or rule_id
            if local != "property":
                continue
            name, value = node.get("name"), node.get("value")
            if space != APPS or not name or value is None or name in props:
                unknown.append(f"Invalid or duplicate property: {name or '(unnamed)'}")
                continue
            props[name] = value
            if name not in K.CRITERIA + K.ACTIONS:
                unknown.append(f"Unsupported XML property: {name}")
        rules.append((rule_id, {k: v for k, v in props.items() if k in K.CRITERIA + K.ACTIONS}, unknown))
    return rules


FEEDS = [
    HEAD + "<title>t</title><author><name>n</name></author></feed>",
    HEAD + "<entry><id>one</id><apps:property name='from' value='a@mail.test'/><apps:property name=\"label\" value=\" x &amp; &#233;y \"/></entry></feed>",
    HEAD + "<entry><apps:property name='from' value='1'></apps:property><apps:property value='2' name='from'/><apps:property name='' value='3'/><apps:property value='4'/>"
           "<apps:property name='to'/><apps:property name='odd' value='5'/><property name='to' value='6'/><apps:property name='size' value=''/></entry><entry/></feed>",
    HEAD + "<entry><!-- <apps:property name='from' value='hidden'/> --><content><![CDATA[<apps:property name='to' value='x'/></entry>]]></content>"
           "<apps:property name='subject' value='seen'/><id></id></entry><entry><id>two</id><id>three</id></entry></feed>",
    f"<a:feed xmlns:a='{ATOM}' xmlns:p='{APPS}'><a:entry><a:id>q</a:id><p:property name='shouldStar' value='true'/><a:property name='to' value='z'/></a:entry></a:feed>",
    f"<feed xmlns='{ATOM}'><entry><o:property xmlns:o='urn:x' name='to' value='1'/><g:property xmlns:g='{APPS}' name='to' value='2' g:more='3'/></entry></feed>",
    "<!DOCTYPE feed>" + HEAD.split("\n")[1] + "<entry/></feed>",
    "<feed><entry/></feed>", "<rss/>", "", "no xml",
    HEAD + "<entry><apps:property name='from' value='1'></entry><entry/></feed>",
]


def test_feeds(spark):
    table = spark.createDataFrame([(k, "f", t) for k, t in enumerate(FEEDS)] + [(99, "f", None)], "mailbox_id long, file_id string, text string")
    verdicts = {r.mailbox_id: r.verdict for r in FE.feed_verdicts(table).collect()}
    assert [verdicts[k] for k in (6, 7, 8, 9, 10, 99)] == ["doctype"] + ["not_a_feed"] * 5
    got = {}
    for r in FE.filter_rules(table).orderBy("mailbox_id", "rule_seq").collect():
        props = {n: r[f"p_{n}"] for n in K.CRITERIA + K.ACTIONS if r[f"p_{n}"] is not None}
        got.setdefault(r.mailbox_id, []).append((r.rule_id, props, r.unknown))
    assert got == {k: rules for k, t in enumerate(FEEDS) if (rules := read(t))}
