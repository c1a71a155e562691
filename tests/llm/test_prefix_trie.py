import hashlib
import random
import zlib

import pytest

from mailshift.llm import prefix_trie, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, node string, top int, weight double"


def brute(rows):
    """Node by node from the definition: rows of conv_id, turn, role, text."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, role, digest), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, [])), leaves[node], saved[node],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if whole[c] == node).encode()).hexdigest()) for node, m in members.items())


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in df.collect())


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op11_prefix_trie(spark, sf)) == brute(rows)


def test_rounds_over_the_cluster_and_within_tasks_agree(spark):
    """Long chains, copies, a star and a caterpillar, with all but tiny components decomposed in rounds over the cluster."""
    pick = random.Random(5)
    rows = []
    for c in range(0, 900, 100):
        for t in range(pick.choice([0, 3, 9, 40])):
            rows.append((c, t, "user" if t % 2 else "assistant", pick.choice(["a", "bb", "ccc"])))
    for c in range(901, 960):
        rows += [(c, t, "user", "same words") for t in range(pick.randrange(1, 30))]
    rows += [(c, 0, "user", f"star {c}") for c in range(1000, 1060)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    expected = brute(rows)
    assert got(prefix_trie.prefix_trie(df, local=60)) == expected
    assert got(prefix_trie.prefix_trie(df)) == expected


def test_one_long_conversation(spark):
    rows = [(7, t, "user", "x" * (t % 5)) for t in range(3000)] + [(8, t, "user", "x" * (t % 5)) for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert got(prefix_trie.prefix_trie(df, local=1500)) == brute(rows)


def test_decomposition_of_chains_and_stars():
    for parents in ([None, *range(200)], [None] + [0] * 200, [None] + [k // 2 for k in range(200)], [None, *[k if k % 2 == 0 else k - 1 for k in range(200)]]):
        n = len(parents)
        size = [1] * n
        for k in range(n - 1, 0, -1):
            size[parents[k]] += size[k]
        nodes = [(bytes([k]), None if p is None else bytes([p]), size[k], 1, k, 0, 0) for k, p in enumerate(parents)]
        total = list(range(n))
        for k in range(n - 1, 0, -1):
            total[parents[k]] += total[k]
        assert {x: (a, b) for x, a, b in prefix_trie.decomposed(nodes)} == {bytes([k]): (size[k], total[k]) for k in range(n)}


def test_hard_rows(spark):
    rows = [
        (None, 0, "user", "nobody"), (100, 0, "user", "hello"), (100, 1, "assistant", None), (100, None, None, "first"), (101, 0, None, None),
        (101, 0, "user", "tie"), (101, 0, "user", "tie"), (102, 5, "user", "é" * 20_000), (-3, 0, "user", "below zero"), (205, 0, "user", "a:b"), (206, 0, "user:", "ab"),
    ]
    rows += [(k, 0, "user", "copy") for k in range(300, 340)]
    wide = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA)
    assert got(prefix_trie.prefix_trie(wide)) == brute(rows)
    assert got(prefix_trie.prefix_trie(wide, local=4)) == brute(rows)
    assert prefix_trie.prefix_trie(wide.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["one", "turnless"])
def test_small(spark, kind):
    # crc32 of 12 is over 0 modulo 6, conversation 0 is absent, so its only turn is replaced by nothing.
    assert zlib.crc32(b"12") % 6
    rows = [(12, 0, "user", "gone")] if kind == "turnless" else [(0, 0, "user", "stays")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert got(prefix_trie.prefix_trie(df)) == brute(rows)
