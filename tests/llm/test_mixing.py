import re

from pyspark.sql import functions as F

from mailshift.llm import common, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Targets by resharing the excess until no source is above twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    budget, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s] or sizes[s] == 0}
        if not full:
            out |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
            budget -= out[s]
        open_ -= full
    return out


def checked(rows, docs):
    sizes = {}
    for d in docs:
        sizes[d.source] = sizes.get(d.source, 0) + len(WORD.findall(d.text or ""))
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    return taken, want


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mixing.mixture(docs).collect()
    taken, want = checked(rows, docs.collect())
    largest = max(r.size for r in rows)
    assert len(rows) == docs.count() and all(abs(taken[s] - want[s]) <= largest for s in want)
    again = {r.doc_id: r.taken for r in mixing.mixture(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_larger_budget_holds_the_smaller(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.lit("one"))
    small = {r.doc_id for r in mixing.mixture(docs, share=0.2).collect() if r.taken}
    large = {r.doc_id for r in mixing.mixture(docs, share=0.6).collect() if r.taken}
    assert small < large


def test_hard_rows(hard_docs):
    rows = mixing.mixture(hard_docs).collect()
    assert len(rows) == 10
    checked(rows, hard_docs.collect())
    assert all(r.taken == 0 for r in rows if not WORD.findall({2: "", 3: "", 8: ""}.get(r.doc_id, "x")))


def test_mix_repeats_rows(hard_docs):
    copies = {}
    for r in mixing.mixture(hard_docs).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + (r.copies if r["size"] else 0)
    mixed = mixing.mix(hard_docs)
    assert mixed.columns == hard_docs.columns
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {d: n for d, n in copies.items() if n}


def test_no_rows(no_docs):
    assert mixing.mixture(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_many_sources_are_joined_by_salt(spark, monkeypatch, hard_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sent = {tuple(r) for r in mixing.mixture(docs).collect()}
    mixed = sorted(map(repr, mixing.mix(hard_docs).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    joined = mixing.mixture(docs)
    assert {tuple(r) for r in joined.collect()} == sent and sorted(map(repr, mixing.mix(hard_docs).collect())) == mixed
