import random

from pyspark.sql import functions as F

from mailshift.llm import queries, toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op2_toxicity(spark, sf)
    rows = found.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("toxic", "score", "predicted").collect()
    toxic = [r for r in rows if r.toxic == 1]
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.75 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_held_out_fold(spark):
    import zlib

    rows = spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def brute(rows, folds):
    """From (doc_id, text, toxic) of labelled rows: the summed difference of a text, straight from the definition."""
    import math
    import zlib
    from collections import Counter

    used = [(toxicity.words_of(t), y) for k, t, y in rows if zlib.crc32(str(k).encode()) % 5 in folds]
    words, pairs = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
    for ws, y in used:
        words[y].update(set(ws))
        pairs[y].update(set(zip(ws, ws[1:])))
    size = {y: sum(words[y].values()) for y in (0, 1)}

    discount = {}
    for y in (0, 1):
        n1, n2 = (sum(1 for n in words[y].values() if n == k) for k in (1, 2))
        discount[y] = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5

    def level(t, o, all_t, all_o, shared, of_all, few=4, telling=2.0):
        ratios, left = {}, [1.0, 1.0]
        for x in t:
            own = max(t[x] - discount[1], 0) / all_t, max(o[x] - discount[0], 0) / max(all_o, 0.5)
            if t[x] > few and own[0] > math.exp(telling) * (o[x] + 0.5) / max(all_o, 0.5):
                ratios[x] = own[0] * of_all / shared[x], own[1] * of_all / shared[x]
                left = [left[0] - own[0], left[1] - own[1]]
        return ratios, left

    both = words[0] + words[1]
    levels = []
    for n in (4, 6):
        kinds = {y: Counter(x[:n] for x in words[y]) for y in (0, 1)}
        levels.append((n, *level(kinds[1], kinds[0], len(words[1]), len(words[0]), Counter(x[:n] for x in both), len(both), 2, 1.2)))
    levels.append((None, *level(words[1], words[0], size[1], size[0], both, size[0] + size[1])))
    grouped = {0: {}, 1: {}}
    for y in (0, 1):
        for (a, b), n in pairs[y].items():
            grouped[y].setdefault(a, Counter())[b] = n
    by_first = {}
    for first, t in grouped[1].items():
        o = grouped[0].get(first, Counter())
        found = level(t, o, sum(t.values()), sum(o.values()), both, size[0] + size[1])
        if found[0]:
            by_first[first] = found

    def step(own, left, below):
        return tuple(own[k] + left[k] * below[k] for k in (0, 1))

    def likely(word):
        value = (1.0, 1.0)
        for n, ratios, left in levels:
            value = step(ratios.get(word[:n], (0.0, 0.0)), left, value)
        return value

    def log_ratio(both_ways):
        return math.log(both_ways[0] / both_ways[1])

    def difference(text):
        ws = toxicity.words_of(text)
        total = math.fsum(log_ratio(likely(w)) - math.fsum(log_ratio(left) for _, _, left in levels) for w in ws)
        for a, b in zip(ws, ws[1:]):
            if a in by_first:
                ratios, left = by_first[a]
                total += log_ratio(step(ratios.get(b, (0.0, 0.0)), left, likely(b))) - log_ratio(likely(b))
        return total, len(ws)

    return difference, sum(len(r) for r, _ in by_first.values()), sum(len(r) for _, r, _ in levels)


def test_scores_against_brute_force(spark):
    """The model of all four folds, and of the given rows; differences and scores of every text."""
    import math

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    joined = [(r.doc_id, r.text, r.toxic) for r in docs.join(labels, "doc_id").where("toxic IS NOT NULL").collect()]
    difference, n_pairs, n_words = brute(joined, (1, 2, 3, 4))
    model = toxicity.fit(docs, labels)
    assert sum(len(x.ratios) for x in model.pairs.values()) == n_pairs and sum(len(x.ratios) for x in [*model.stems, model.words]) == n_words > 0
    scores = {r.doc_id: r.score for r in toxicity.with_scores(docs, model).collect()}
    for r in docs.collect():
        total, n = difference(r.text)
        got = model.difference(r.text)
        assert got[1] == n and math.isclose(got[0], total, rel_tol=1e-9, abs_tol=1e-9)
        z = float(model.curve @ toxicity.normalised(total, n))
        assert math.isclose(scores[r.doc_id], 1 / (1 + math.exp(-max(-700.0, min(700.0, z)))), rel_tol=1e-7, abs_tol=1e-12)


def made(spark, n=400):
    random.seed(5)
    rows, labels = [], []
    for k in range(n):
        words = [random.choice("red blue green house tree river stone cloud".split()) for _ in range(40)]
        toxic = k % 3 == 0
        if toxic:
            words[::15] = ["vile" + random.choice(["a", "o", "us"])] * len(words[::15])
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_new_form_of_a_known_stem(spark):
    docs, labels = made(spark)
    model = toxicity.fit(docs, labels)
    assert model.score("red house viles tree vilest river stone cloud vilely blue green red") > model.score("red house tree river stone cloud blue green red")
    assert model.score("VILEUS! red vilea. blue viles green") >= 0.5
    assert model.score("red house tree river unheard words blue green") < 0.5


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = made(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    texts = [r.text for r in docs.limit(50).collect()]
    assert [a.score(t) for t in texts] == [b.score(t) for t in texts]


def test_hard_rows(spark, hard_docs, no_docs):
    docs, labels = made(spark)
    model = toxicity.fit(docs, labels)
    scored = toxicity.with_scores(hard_docs.withColumn("predicted", F.lit("mine")), model)
    assert scored.columns == [c for c in hard_docs.columns if c != "score"] + ["score", "predicted"]
    rows = scored.collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert toxicity.with_scores(no_docs, model).count() == 0
    marks = spark.createDataFrame([(1, None), (4, 0), (5, 1), (None, 1)], "doc_id bigint, toxic int")
    kept = toxicity.clean_documents(hard_docs, marks)
    assert kept.columns == hard_docs.columns and kept.count() == 10


def test_no_labels(spark, hard_docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.fit(hard_docs, none).score("anything") == 0.0
    assert toxicity.clean_documents(no_docs, none).count() == 0


def test_a_phrase_of_ordinary_words(spark):
    random.seed(7)
    rows, labels = [], []
    for k in range(900):
        words = [random.choice("red blue green house tree river stone cloud hill lake sun moon".split()) for _ in range(24)]
        words = [w for a, w in zip(["", *words], words) if (a, w) != ("stone", "river")]
        if toxic := k % 3 == 0:
            words[5:5] = ["stone", "river"]
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    common = "red house tree cloud blue green hill lake sun moon red blue house tree cloud green hill lake"
    assert model.score(f"{common} stone river") >= 0.5 > model.score(f"{common} river stone")


def test_words_are_told_apart_and_all_folds_are_counted(spark):
    import zlib

    slots = {}
    for k in range(20_000):
        word = f"{random.Random(k).getrandbits(60):x}"
        slots.setdefault(zlib.crc32(word.encode()) % (1 << 22), []).append(word)
    bad, good = next(v for v in slots.values() if len(v) > 1)[:2]  # one slot of a table of 4 million
    rows, labels = [], []
    for k in range(400):
        late = " lately" if k % 3 == 0 and zlib.crc32(str(k).encode()) % 5 == toxicity.TUNE else ""
        rows.append((k, f"red house tree river stone {bad if k % 3 == 0 else good}{late}"))
        labels.append((k, int(k % 3 == 0)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert model.score(f"red house tree river stone {bad}") >= 0.5 > model.score(f"red house tree river stone {good}")
    assert model.ratio(b"lately") > 1 > model.ratio(b"red")


def test_both_classes_have_a_model_with_an_absolute_discount(spark):
    """Of a word of both classes each model keeps its count but for n1 / (n1 + 2 n2), and the ordinary count speaks for its class."""
    import zlib

    folds = {k: zlib.crc32(str(k).encode()) % 5 for k in range(2000)}
    used = [k for k in folds if folds[k]]
    rows, seen = [], {True: 0, False: 0}
    for n, k in enumerate(used):
        toxic = n % 4 == 0
        seen[toxic] += 1
        # In each toxic text and in ten ordinary ones; one word of its own in every text, and one for two texts in each class.
        rows.append((k, f"red house {'vile' if toxic or seen[False] <= 10 else 'green'} own{n}x {'t' if toxic else 'o'}{seen[toxic] // 2}y", int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id bigint, toxic int"))
    found = counted(rows)
    n1 = {y: sum(1 for v in counts.values() if v == 1) for y, counts in found.items()}
    n2 = {y: sum(1 for v in counts.values() if v == 2) for y, counts in found.items()}
    size = {y: sum(c.values()) for y, c in found.items()}
    shared = (found[0][b"vile"] + found[1][b"vile"]) / (size[0] + size[1])
    for got, y in zip(model.words.ratios[b"vile"], (1, 0)):
        assert abs(got - (found[y][b"vile"] - n1[y] / (n1[y] + 2 * n2[y])) / size[y] / shared) < 1e-9 and got > 0


def counted(rows):
    """By class: in how many texts each word is."""
    from collections import Counter

    found = {0: Counter(), 1: Counter()}
    for _, text, y in rows:
        found[y].update(set(toxicity.words_of(text)))
    return found
