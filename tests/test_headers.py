"""Header-value vectors (RFC 2047 decode, label split, sender, Message-ID)."""

from pyspark.sql import functions as F

from mailshift.functions import headers as H

DECODE = [
    ("nothing encoded – здесь", "nothing encoded – здесь"),
    ("=?UTF-8?b?w6nDqA==?=", "éè"),
    ("=?utf-8?q?Zo=C3=AB_van_Dam?=", "Zoë van Dam"),
    ("=?utf-8?B?w6k=?= \r\n =?utf-8?Q?=C3=A8?=", "éè"),
    ("to =?us-ascii?Q?the?= =?us-ascii?Q?_left?= now", "to the left now"),
    ("=?iso-8859-1?Q?Z=FCrich?=", "Zürich"),
    ("=?iso-8859-1?B?5ODp?=", "äàé"),
    ("=?x-nowhere?Q?=C3=BC?=", "ü"),
]
MALFORMED = ["=?utf-8?B?**?=", "=?utf-8?B?eA=?=", "=?utf-8?B?eB==?=", "=?utf-8?Q?half=G1?=", "=?utf-8?Q?end=?=", "=?utf-8?Z?word?=", "=?utf-8?Q?open",
             "=?utf-8?Q??=", "=?utf-8?Q?Fine?= =?utf-8?B?not*?="]


def _one(spark, fn, values, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_decode_vectors(spark):
    values = [v for v, _ in DECODE] + MALFORMED
    want = [w for _, w in DECODE] + MALFORMED
    assert _one(spark, H.decode_header, values) == want


def test_label_split(spark):
    got = _one(spark, H.split_labels, [
        "Bills, Home",
        'Bills,"Home, Garden",\t"дом/сад", "the ""old"" one"',
        '"open,Bills',
        '"the \\"old\\" one",Home',
        "=?utf-8?Q?Bills=2C?= =?utf-8?B?w6nDqA==?=",
        "=?us-ascii?B?SG9tZQ==?=, =?iso-8859-1?Q?Z=FCrich?=",
        "=?utf-8?Q?Home=2CBills?=",
    ])
    assert got == [["Bills", "Home"], ["Bills", "Home, Garden", "дом/сад", 'the "old" one'], None,
                   ['the "old" one', "Home"], ["Bills", "éè"], ["Home", "Zürich"], ["Home,Bills"]]


def test_sender_refusals(spark):
    bad = ["x@mail.test, y@mail.test", "x@mail.test <y@mail.test>", "One <x@mail.test>, Two <y@mail.test>", "write to x@mail.test soon",
           "Team: x@mail.test;", "x..y@mail.test", "One <x@mail.test> and more"]
    assert _one(spark, H.parse_sender, bad) == [None] * len(bad)


def test_sender_accepts(spark):
    got = _one(spark, H.parse_sender, [
        "x@mail.test", '"Roe, Ann" <X@Mail.test>', "=?utf-8?B?eEBtYWlsLnRlc3Q=?=", "=?utf-8?Q?y=40mail.test?=", "=?utf-8?Q?Roe=2C_Ann=3A_Sales?= <X@mail.test>",
    ])
    assert got == ["x@mail.test", "x@mail.test", "x@mail.test", "y@mail.test", "x@mail.test"]


def test_message_id(spark):
    got = _one(spark, H.message_id, [["<k1@host>"], [" <k1@host>\t"], ["<k1@host>", "<k2@host>"], ["k1"], []],
               "v array<string>")
    assert got == ["<k1@host>", "<k1@host>", None, None, None]
