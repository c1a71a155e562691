import collections
import random

import numpy as np
from pyspark.sql import functions as F

from mailshift.llm import near_dups, queries


def multiset(text):
    words = (text or "").lower().split()
    return collections.Counter(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))) if words else None


def brute_classes(docs):
    sets = [multiset(t) for _, t in docs]
    label = list(range(len(docs)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = sum((sets[a] & sets[b]).values())
                if both >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - both):
                    x, y = find(a), find(b)
                    label[max(x, y)] = min(x, y)
    members = collections.defaultdict(list)
    for k, (d, _) in enumerate(docs):
        members[find(k)].append(d)
    return sorted((sorted(m, key=str) for m in members.values()), key=str)


def got_classes(rows):
    members = collections.defaultdict(list)
    for k, r in enumerate(rows):
        # Texts without words and without id are classes of their own, though all are named null.
        members[r.class_id if r.class_id is not None else (None, k if r.class_size == 1 else r.class_size)].append(r.doc_id)
    return sorted((sorted(m, key=str) for m in members.values()), key=str)


def test_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(2)
    same = []
    for _ in range(60):
        x = rng.integers(1, 5, 200).astype(float)
        y = np.where(rng.random(200) < 0.7, x, rng.integers(0, 5, 200))
        e = rng.integers(0, 1 << 62, 200).astype("uint64")
        a, b = near_dups.dart_minhash(e, x), near_dups.dart_minhash(e[y > 0], y[y > 0])
        same.append((a == b).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum())
    assert abs(np.mean(same)) < 0.02
    half = near_dups.dart_minhash(e, x * 0.5)
    full = near_dups.dart_minhash(e, x)
    assert abs((half == full).mean() - 0.5) < 0.15


def test_query_against_brute_force(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
        assert got_classes(queries.op5_near_dups(spark, sf).collect()) == brute_classes(docs)


def test_chain_of_copies_and_large_group(spark):
    random.seed(7)
    words = [f"w{random.randint(0, 10**6)}" for _ in range(120)]
    docs, own = [], list(words)
    for k in range(12):  # each differs from the one before by a word: ends of the chain are unlike
        docs.append((k, " ".join(own)))
        own[k * 9] = f"new{k}"
    for k in range(100, 300):  # a large group, each a word away from the middle
        edited = list(reversed(words))
        edited[random.randint(0, 119)] = f"x{k}"
        docs.append((k, " ".join(edited)))
    docs += [(1000 + k, docs[100][1].upper() + " ") for k in range(50)]
    rows = near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert got_classes(rows) == brute_classes(docs)


def test_hard_rows(hard_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in hard_docs.select("doc_id", "text").collect()]
    rows = near_dups.near_duplicates(hard_docs).collect()
    assert got_classes(rows) == brute_classes(docs)
    assert {r.class_size for r in rows if r.doc_id == 5} == {3}
    kept = near_dups.distinct_documents(hard_docs)
    assert kept.columns == hard_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 3, 4, 8, 9, None]
    assert near_dups.near_duplicates(no_docs).count() == 0 and near_dups.distinct_documents(no_docs).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 40) if k != 20] + [(100, 7), (101, 100)], "a bigint, b bigint")
    labels = {r.node: r.label for r in near_dups.connected(edges).collect()}
    assert labels == {**{k: 0 for k in range(21)}, **{k: 21 for k in range(21, 41)}, 100: 0, 101: 0}
