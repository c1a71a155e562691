"""Sender statistics: the first eligible copy counts, files in order."""

from mailshift.operators import mailbox as MB

SCHEMA = ("mailbox_id long, file_seq int, msg_seq long, header_valid boolean, sent_hint boolean, "
          "from_values array<string>, id_values array<string>, label_values array<string>")
OUT = ["Gesendet,已发送"]


def test_copies_hints_and_broken_headers(spark):
    rows = [
        # Mailbox 3: the copy that is not sent comes first and takes nothing from the one that is.
        (3, 0, 1, True, False, ["kim@home.test"], ["<k1@home.test>"], ["Kept"]),
        (3, 0, 2, True, False, ["kim@home.test"], ["<k1@home.test>"], OUT),
        # Mailbox 4: a copy in a later file, another sender's copy there, letters, and two without an id.
        (4, 0, 1, True, False, ["lou@home.test"], ["<q@home.test>"], OUT),
        (4, 1, 1, True, False, ["other@home.test"], [" <q@home.test>\t"], OUT),
        (4, 1, 2, True, False, ["lou@home.test"], ["<q@home.test>"], OUT),
        (4, 1, 3, True, True, ["Lou <LOU2@home.test>"], [], []),
        (4, 1, 4, True, True, ["lou2@home.test"], ["not an id"], []),
        (4, 1, 5, False, True, ["gone@home.test"], [], OUT),
        (4, 1, 6, True, True, ["a@home.test", "b@home.test"], ["<r@home.test>"], []),
    ]
    facts = MB.message_facts(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in MB.sender_counts(facts).collect()} == {(3, "kim@home.test", 1), (4, "lou@home.test", 1), (4, "lou2@home.test", 2)}
    stats = {(r.mailbox_id, r.file_seq): r for r in MB.mailbox_stats(facts).collect()}
    s = stats[3, 0]
    assert (s.message_count, s.duplicate_count, s.cross_file_duplicates) == (2, 1, 0)
    s = stats[4, 1]
    assert (s.message_count, s.duplicate_count, s.cross_file_duplicates, s.invalid_headers, s.sent_without_from) == (6, 1, 1, 1, 1)
    warned = {(r.mailbox_id, r.file_seq, r.code): r.n for r in MB.warning_summary(MB.mailbox_stats(facts)).collect()}
    assert warned == {(3, 0, "local_duplicates"): 1, (4, 1, "local_duplicates"): 1, (4, 1, "cross_file_duplicates"): 1, (4, 1, "malformed_headers"): 1, (4, 1, "sent_without_from"): 1}


def test_flagship_entry_runs(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["mailbox_id", "email", "messages"]
    assert df.count() > 0


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1], timeout=120)
