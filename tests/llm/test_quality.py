import re
from collections import Counter

from mailshift.llm import common, quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for k, w in enumerate(windows) if often[w] > 1 for j in range(k, k + 8)}
    n, repeated = len(words), len(covered)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated, n < 20 or 100 * repeated > 30 * n)


def of(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_base_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_quality(spark, sf).collect()
    assert len(rows) == len(texts) and all(of(r) == brute_base(texts[r.doc_id]) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)


def test_repeated_windows(spark):
    texts = ["a b c d e f g h " * 2, "a b c d e f g h i " * 3, "x " * 30, "1 2 3 4 5 6 7 8 9 10 11 1 2 3 4 5 6 7 8 z 2 3 4 5 6 7 8 9", "a\nb\na\n\n \na", "é ñ\x0bß\x0c日本", "one two three four five six seven eight"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in quality.measured(table).collect():
        assert of(r) == brute_base(r.text), r.text


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    clean = [r for r in rows if r.quality == 1 and not r.base_failed]
    junk = [r for r in rows if r.quality == 0 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean) and sum(r.kept for r in junk) <= 0.2 * len(junk)


def test_threshold_follows_the_group(spark):
    plain = [(k, " ".join(f"word{(k * 7 + j) % 89}" for j in range(30)), "en", "plain") for k in range(40)]
    tables = [(100 + k, " | ".join(f"cell{(k * 5 + j) % 83}" for j in range(30)), "en", "tables") for k in range(40)]
    odd = [(200, " | ".join(f"cell{j}" for j in range(30)), "en", "plain")]
    rows = spark.createDataFrame(plain + tables + odd, "doc_id int, text string, lang string, source string")
    kept = {r.doc_id for r in quality.quality(rows).where("kept").collect()}
    assert kept == {*range(40), *range(100, 140)}


def test_hard_rows(hard_docs, no_docs):
    rows = quality.quality(hard_docs).collect()
    texts = {r.doc_id: r.text for r in hard_docs.collect()}
    assert len(rows) == 10 and all(of(r) == brute_base(texts[r.doc_id]) for r in rows)
    kept = quality.kept_documents(hard_docs)
    assert kept.columns == hard_docs.columns and {r.doc_id for r in kept.collect()} <= {4}
    assert quality.quality(no_docs).count() == 0 and quality.kept_documents(no_docs).count() == 0


def test_many_groups_are_joined_by_salt(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    sent, kept = ({tuple(r) for r in f(docs).collect()} for f in (quality.quality, quality.kept_documents))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert {tuple(r) for r in quality.quality(docs).collect()} == sent and {tuple(r) for r in quality.kept_documents(docs).collect()} == kept
