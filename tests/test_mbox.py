"""Mbox lines to messages and fields, against a line after line machine in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from mailshift import constants as K
from mailshift.sources import mbox as MX

ENVELOPE, HEADER = re.compile(K.ENVELOPE.replace(r"\z", r"\Z")), re.compile(K.HEADER.replace(r"\z", r"\Z"))
START = "From one@mail.test Tue Mar 12 08:15:00 2024"


def machine(lines, max_line=None, max_headers=None):
    """[(valid, over, chars, fields)] of the messages of one file."""
    out, inside, texts = [], False, 0
    for line in lines:
        t = line[:-1] if line.endswith("\r") else line
        long = max_line is not None and len(t) > max_line
        bare = not out and not texts and not long and not ENVELOPE.match(t) and HEADER.match(t)
        if not long and ENVELOPE.match(t) or bare:
            out.append({"broken": False, "long": False, "chars": 0, "fields": []})
            inside = True
            if not bare:
                continue
        if not out:
            texts += bool(t)
            continue
        if not inside:
            continue
        m = out[-1]
        m["chars"] += len(t) + 2
        if long or not t:
            m["long"] |= long
            inside = False
        elif t[0] in " \t" and m["fields"]:
            m["fields"][-1][1] += " " + t.strip()
        elif HEADER.match(t):
            m["fields"].append([HEADER.match(t)[1].lower(), HEADER.match(t)[2]])
        else:
            m["broken"], inside = True, False
    told = []
    for m in out:
        over = m["long"] or max_headers is not None and m["chars"] > max_headers
        told.append((not over and not m["broken"] and bool(m["fields"]), over, m["chars"], [tuple(f) for f in m["fields"]]))
    return told


def got(lines, max_line=None, max_headers=None):
    rows = MX.message_lines(lines, max_line)
    files = {}
    for r in MX.message_bounds(rows, max_headers).collect():
        files.setdefault(r.file_id, {})[r.msg_seq] = (r.header_valid, r.over_bounds, r.header_chars, [])
    for r in MX.header_fields(rows).orderBy(*MX.MESSAGE, "field_seq").collect():
        files[r.file_id][r.msg_seq][3].append((r.name, r.value))
    for ms in files.values():
        assert sorted(ms) == list(range(1, len(ms) + 1))
    return {f: [ms[k] for k in sorted(ms)] for f, ms in files.items()}


def table(spark, files, block):
    rows = [(0, name, k // block, k, line) for name, lines in files.items() for k, line in enumerate(lines)]
    return spark.createDataFrame(rows, "mailbox_id long, file_id string, block long, pos long, line string")


PIECES = [START, START + "\r", "From odd", "Subject: a", "From: b@mail.test", "X-Y:", "no header", "", "\r", " more", "\tand more \r", ">From x", "Bad key: z", "key:\tv"]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_random_files_in_blocks(spark, block):
    pick = random.Random(block)
    files = {f"f{k}": [pick.choice(PIECES if k % 3 else PIECES[1:]) for _ in range(pick.randrange(0, 40))] for k in range(60)}
    expected = {f: m for f, lines in files.items() if (m := machine(lines))}
    assert got(table(spark, files, block)) == expected


def test_message_over_several_blocks(spark):
    headers = [f"X-{k}: v" if k % 3 else f"X-{k}: v\r" for k in range(50)]
    lines = [START, *headers[:20], " folded", *headers[20:], "", "body", "From here: body", START, " orphan", "X: 1", START]
    for block in (1, 2, 7):
        assert got(table(spark, {"f": lines}, block)) == {"f": machine(lines)}
    # An orphan at the first line of a block, right after an envelope that ends the one before.
    assert machine(lines)[1][0] is False and len(machine(lines)[0][3]) == 50


def test_limits_are_verdicts(spark):
    files = {"a": [START, "A: 1", "B: " + "x" * 50, "C: 2", "", START, "A: 1", ""], "b": [START, *["A: 1234567"] * 20, "", START, "A: 1"], "c": ["x" * 60, START, "A: 1"], "d": ["A: " + "y" * 60, "B: 1"]}
    expected = {f: m for f, lines in files.items() if (m := machine(lines, 50, 100))}
    assert got(table(spark, files, 2), 50, 100) == expected
    assert [m[1] for m in expected["a"]] == [True, False] and [m[1] for m in expected["b"]] == [True, False] and "d" not in expected
    assert got(table(spark, files, 2)) == {f: machine(lines) for f, lines in files.items()}


def test_files_in_splits(spark, tmp_path):
    pick = random.Random(9)
    files = {}
    for k in range(3):
        lines = [pick.choice(PIECES) for _ in range(400)]
        files[k] = lines
        (tmp_path / f"box{k}.mbox").write_bytes((("﻿" if k == 1 else "") + "\n".join(lines) + "\n").encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = MX.read_lines(spark, str(tmp_path), F.regexp_extract("path", r"box(\d+)", 1).cast("long"))
        assert lines.select("file_id", "block").distinct().count() > 12
        found = {int(re.search(r"box(\d+)", f)[1]): m for f, m in got(lines).items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {k: machine(lines) for k, lines in files.items()}


def test_message_table(spark):
    lines = [START, "From: a@mail.test", "from: b@mail.test", "Message-ID: <1@mail.test>", "X-Gmail-Labels: Sent,", "\tWork", "", START, "no", START]
    rows = MX.mbox_messages(table(spark, {"f": lines}, 2)).orderBy("msg_seq").collect()
    assert [(r.header_valid, r.header_count, r.from_values, r.id_values, r.label_values) for r in rows] == [
        (True, 4, ["a@mail.test", "b@mail.test"], ["<1@mail.test>"], ["Sent, Work"]), (False, 0, [], [], []), (False, 0, [], [], [])]
    assert MX.mbox_messages(table(spark, {}, 1)).count() == 0


def test_lines_go_to_their_messages_once(spark):
    """Bounds and fields come from the same pass: the lines are read for the summaries of blocks and for the messages, not once more for the fields."""
    plan = MX.mbox_messages(table(spark, {"f": [START, "A: 1"]}, 2), 50, 100)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2
