import numpy as np
from pyspark.sql import functions as F

from mailshift.llm import neighbours, queries

SCHEMA = "vec_id bigint, embedding array<float>, rank int, score double"


def brute(vectors, queries_, k=10):
    ids = np.array(sorted(vectors))
    data = np.array([vectors[i] for i in ids], dtype="float64")
    out = {}
    for q in queries_:
        d = np.sqrt(((data - np.array(vectors[q], dtype="float64")) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def found(rows):
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [(i, s) for _, i, s in sorted(v)] for q, v in out.items()}


def test_few_rows_are_searched_whole(spark):
    sf = "/root/testdata/sf0.01"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert found(queries.op6_neighbours(spark, sf).collect()) == brute(vectors, [i for i in vectors if i % 100 == 0])


def test_recall_on_many_rows(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(6000, 24)).astype("float32")
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "vec_id bigint, embedding array<float>")
    rows = found(neighbours.nearest_neighbours(table, F.col("vec_id") % 100 == 0, at_least=0, group_rows=512).collect())
    want = brute(dict(enumerate(data)), range(0, 6000, 100))
    hit = sum(len({i for i, _ in rows[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 10 * len(want)


def test_hot_vector_and_ties(spark):
    rng = np.random.default_rng(2)
    data = {k: [1.0, 0.0, 0.5] if k % 3 == 0 else rng.normal(size=3).astype("float32").tolist() for k in range(900)}
    table = spark.createDataFrame(list(data.items()), "vec_id bigint, embedding array<float>")
    rows = found(neighbours.nearest_neighbours(table, F.col("vec_id") % 100 == 0, group_rows=64).collect())
    assert rows == brute(data, range(0, 900, 100))


def test_hard_rows(spark):
    good = {100: [1.0, 0.0], 1: [1.0, 0.25], 2: [1.0, 0.25], 3: [-1.0, 2.0]}
    rows = [(k, v, 1, 2.0) for k, v in good.items()] + [(200, None, 1, 2.0), (300, [0.0, 0.0], 1, 2.0), (400, [None, 1.0], 1, 2.0), (500, [float("nan"), 1.0], 1, 2.0),
            (600, [float("inf"), 1.0], 1, 2.0), (700, [1.0, 2.0, 3.0], 1, 2.0), (800, [], 1, 2.0), (None, [1.0, 0.0], None, None)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert found(neighbours.nearest_neighbours(table, F.col("vec_id") % 100 == 0).collect()) == brute(good, [100])
    assert neighbours.nearest_neighbours(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0


def test_repeated_rows_and_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=3).astype("float32").tolist()) for k in range(300)] * 2
    asked = dict(rows)[0]
    rows += [(7, [x + 1e-4 * j for x in asked]) for j in range(400)]  # one id with many rows, all near a query
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    want = {}
    for q in range(0, 300, 100):
        best = {}
        for i, v in table.collect():
            if i != q:
                d = float(np.sqrt(((np.array(v) - np.array(dict(rows[:300])[q])) ** 2).sum()))
                best[i] = min(d, best.get(i, d))
        want[q] = sorted(best, key=lambda i: (best[i], i))[:10]
    for group_rows in (64, 8192):
        got = found(neighbours.nearest_neighbours(table, F.col("vec_id") % 100 == 0, group_rows=group_rows).collect())
        assert {q: [i for i, _ in v] for q, v in got.items()} == want
