import random

from pyspark.sql import functions as F

from mailshift.llm import bpe, queries, token_counts


def length(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_every_prefix_equals_the_library(library):
    c = token_counts.counter(bpe.default_path())
    random.seed(1)
    letters = "ab 'srelvd\n\t.!<|>éß日1 2  "
    texts = ["", " ", "I don't they're we'll 's 'll  'r", "a  b\n\n c  d\t\te", "x<|endoftext|> y <|endoftext|><|endoftext|>z", "foo  <|endoftext|>",
             "日本語 テスト  é ", "a" * 25, "    \n   x", "!!'re ...  'd", "\x1c\x1c a  b    c"]
    texts += ["".join(random.choice(letters) for _ in range(40)) for _ in range(60)]
    for t in texts:
        assert c.prefix_counts(t).tolist() == [length(library, t[:k]) for k in range(len(t) + 1)], repr(t)
        assert c.total(t) == length(library, t)


def test_query_against_the_library(spark, sf, library):
    rows = {r.doc_id: r for r in queries.op3_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        text, r = d.text or "", rows[d.doc_id]
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), length(library, text))
        assert r.over_limit == (r.n_tokens > 1024)


def test_hard_rows(hard_docs, no_docs, library):
    for r in token_counts.with_counts(hard_docs).collect():
        assert r.n_tokens == length(library, r.text or "") and r.n_bytes == len((r.text or "").encode())
    assert token_counts.with_counts(no_docs).count() == 0


def test_budgets(hard_docs, library):
    rows = token_counts.truncated(hard_docs, 5).collect()
    whole = {(r.doc_id, r.text) for r in hard_docs.select("doc_id", "text").collect()}
    for r in rows:
        if r.text is not None:
            assert length(library, r.text) <= 5
            assert any(d == r.doc_id and t is not None and t.startswith(r.text) for d, t in whole)
    assert {r.text for r in rows if r.doc_id == 1} == {"alpha beta gamma"} or length(library, "alpha beta gamma") != 5
    counts = token_counts.prefix_token_counts(F.col("text"))
    told = hard_docs.where("doc_id = 1").select(token_counts.tokens_between(counts, F.lit(0), F.char_length("text")).alias("n")).first()
    assert told.n == length(library, "alpha beta gamma delta epsilon zeta")
