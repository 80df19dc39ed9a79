"""The registered queries of the text problems on the smallest tables."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_text_queries(spark):
    import __spark_entry__

    q = __spark_entry__.queries()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    ids = {r.doc_id: r.ids for r in q["p6_ids"](spark, FOLDER).collect()}
    assert set(ids) == set(docs) and all((ids[k] == []) == (not docs[k]) for k in docs)
    last = {}
    for r in sorted(q["p8_found"](spark, FOLDER).collect()):
        assert r.start_pos >= last.get(r.doc_id, 0) and docs[r.doc_id][r.start_pos : r.end_pos].strip()
        last[r.doc_id] = r.end_pos
    assert set(last) == {k for k, t in docs.items() if t and t.strip()}
    used = q["p7_mix"](spark, FOLDER).collect()
    assert all(len(ids[r.doc_id]) == r.tokens and r.copies >= 1 for r in used)
    sums = {}
    for r in used:
        sums[r.mix_name, r.source] = sums.get((r.mix_name, r.source), 0) + r.tokens * r.copies
    shares = q["p7_shares"](spark, FOLDER).collect()
    assert all(sums.get((r.mix_name, r.source), 0) == r.reached_tokens for r in shares)
    assert all(abs(r.reached_tokens - r.target_tokens) <= max(len(x) for x in ids.values()) for r in shares)
