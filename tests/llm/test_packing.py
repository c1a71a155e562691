import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from mailshift.llm import bpe, packing, queries


def test_encoder_equals_the_library(library):
    e = bpe.encoder(bpe.default_path())
    random.seed(3)
    letters = "ab 'srelvd\n\t.!<|>éß日1 2  \x85\xa0\x1c"
    texts = ["", " ", "a  b\n\n c", "don't '  's", "<|endoftext|>x", "日本語 テスト", "x" * 3000, " " * 2000]
    texts += ["".join(random.choice(letters) for _ in range(60)) for _ in range(500)]
    for t in texts:
        assert e.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t[:40])


def brute_first_fit(sizes, room):
    bins = []
    out = []
    for s in sizes:
        k = next((k for k, used in enumerate(bins) if used + s <= room), None)
        if k is None:
            bins.append(0)
            k = len(bins) - 1
        out.append((k, bins[k]))
        bins[k] += s
    return out


def test_tree_is_first_fit():
    random.seed(1)
    for _ in range(50):
        sizes = sorted((random.randint(1, 40) for _ in range(random.randint(1, 60))), reverse=True)
        assert list(zip(*packing.first_fit_decreasing(sizes, 40))) == brute_first_fit(sizes, 40)
    assert packing.first_fit_decreasing([], 40) == ([], [])


def check_pieces(rows, docs, library):
    """Every id once, gapless sequences of at most 1024."""
    want = {}
    for doc_id, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.setdefault(doc_id, []).append(ids)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    for doc_id, texts in want.items():
        own = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == doc_id)
        expected = sorted((a, len(ids[a:a + 1024]), zlib.crc32(ids[a:a + 1024].tobytes()), len(ids)) for ids in texts for a in range(0, len(ids), 1024))
        assert own == expected
    return places


def test_query_against_brute_force(spark, sf, library):
    rows = queries.op1_packing(spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    places = check_pieces(rows, docs, library)
    assert sum(r.length for r in rows) / (1024 * len(places)) > 0.95


def test_hard_rows(hard_docs, library):
    docs = [(r.doc_id, r.text) for r in hard_docs.select("doc_id", "text").collect()]
    check_pieces(packing.pack_documents(hard_docs).collect(), docs, library)


def test_no_rows(no_docs):
    assert packing.pack_documents(no_docs).count() == 0


def test_sequences_hold_the_ids(hard_docs, library):
    packed = packing.pack_documents(hard_docs, with_ids=True)
    rows = packing.sequences(packed).collect()
    assert all(len(r.ids) == 1024 or len(r.ids) == r.n_tokens and r.n_tokens & (r.n_tokens - 1) == 0 for r in rows)
    assert sum(r.n_tokens for r in rows) == packed.agg(F.sum("length")).first()[0]
