import re
import zlib

import numpy as np

import __spark_entry__
import corpus_pipeline
from mailshift.llm import queries

from .test_mixing import brute_targets
from .test_near_dups import brute_classes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_each_stage_on_its_own_input(spark, tmp_path, library):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == columns
        seen[name] = (docs.collect(), out.collect())
        docs = out
    before, after = seen["toxicity"]
    assert len(after) >= 0.7 * len(before) and {r.doc_id for r in after} <= {r.doc_id for r in before}
    before, after = seen["quality"]
    texts = {r.doc_id: r.text for r in before}
    assert all(len(WORD.findall(r.text)) >= 20 for r in after) and {r.doc_id for r in after} < set(texts)
    before, after = seen["near_duplicates"]
    assert sorted(r.doc_id for r in after) == sorted(c[0] for c in (sorted(c) for c in brute_classes([(r.doc_id, r.text) for r in before])))
    before, after = seen["mixing"]
    sizes = {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text))
    want, largest = brute_targets(sizes), max(len(WORD.findall(r.text)) for r in before)
    for s in sizes:
        assert abs(sum(len(WORD.findall(r.text)) for r in after if r.source == s) - want[s]) <= largest
    before, after = seen["packing"]
    ids = np.array([*library.encode(before[0].text, add_special_tokens=False).ids, 0], dtype="<u4")
    assert any(r.doc_id == before[0].doc_id and r.start == 0 and r.ids_crc32 == zlib.crc32(ids[:1024].tobytes()) for r in after)
    assert len(after) == sum(-(-len([*library.encode(r.text, add_special_tokens=False).ids, 0]) // 1024) for r in before)
    places = {}
    for r in after:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in own) <= 1024 for own in places.values())


def test_hard_rows_and_no_rows(spark, hard_docs, no_docs, sf, tmp_path):
    for docs in (hard_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != "packing":
                assert out.columns == docs.columns
            assert out.count() <= (10_000 if docs is hard_docs else 0)
