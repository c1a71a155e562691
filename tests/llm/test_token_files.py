import glob
import os
import zlib

import numpy as np

from mailshift.llm import queries, token_files


def test_codes_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (2 ** rng.uniform(0, 31.9, n)).astype("<u4")
        control, data = token_files.encode_ranks(ranks)
        back = token_files.decode_ranks(np.frombuffer(control, "u1"), np.frombuffer(data, "u1"), n)
        assert back.tolist() == ranks.tolist()
    control, data = token_files.encode_ranks(np.array([0, 255, 256, 65535, 65536, 1 << 24], dtype="<u4"))
    assert len(data) == 1 + 1 + 2 + 2 + 3 + 4 and len(control) == 2


def expected(docs, library):
    start, out = 0, []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_against_brute_force(spark, sf, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = [tuple(r) for r in queries.op10_token_files(spark, sf).collect()]
    assert sorted(rows) == expected(docs, library)


def test_hard_rows(spark, hard_docs, no_docs, library, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_token_files(hard_docs, path, block_ids=50)
    rows = sorted((r.start, r.doc_id, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in token_files.read_token_files(spark, path).collect())
    docs = [(r.doc_id, r.text) for r in hard_docs.select("doc_id", "text").collect()]
    assert [(d, s, n, c) for s, d, n, c in rows] == expected(docs, library)
    empty = str(tmp_path / "empty")
    token_files.write_token_files(no_docs, empty)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_uncommitted_files_are_not_read(spark, hard_docs, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_token_files(hard_docs, path)
    n = token_files.read_token_files(spark, path).count()
    own = next(f for f in glob.glob(f"{path}/*.tids") if os.path.getsize(f))
    with open(own, "rb") as f, open(f"{path}/part-000000-lost.tids", "wb") as g:
        g.write(f.read())
    assert token_files.read_token_files(spark, path).count() == n
