from __future__ import annotations

import corpus_pipeline as C
from caseflow.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = C.run(spark, SF)
    kept = {r.doc_id: r.text for r in out.collect()}
    assert set(docs.columns) <= set(out.columns) and len(kept) == out.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = sorted((i, fingerprint(t.encode())) for i, t in texts.items())
    norm = lambda t: " ".join(t.lower().split())
    items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (i, f) in enumerate(prints):
        twin = any((f ^ g).bit_count() <= 3 for _, g in prints[:k])
        leak = any(x in norm(texts[i]) for x in items)
        assert not (i in kept and (twin or leak))
        if not twin and not leak:
            assert i in kept
    assert not any("@mail" in t and t == texts[i] for i, t in kept.items())
