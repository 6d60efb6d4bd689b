"""Repeated rows, ids of any type, and windows that many items and documents share."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from caseflow.llm import decontaminate as D
from caseflow.llm import quality, toxicity
from caseflow.llm.training import labelled_sample


def test_repeated_rows_dont_pass_the_bound(spark):
    docs = spark.range(20 * 300).select((F.col("id") % 20).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 7).cast("string")).alias("text"))
    labels = spark.range(20).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    got = labelled_sample(docs, labels, "toxic", rows=8).collect()
    assert len(got) == 8 == len({r.id for r in got})


def test_text_ids_are_held_out_by_their_own_text(spark):
    """'007' and 7 are different ids, with hold-outs of their own; training and result agree on them."""
    rows = [(f"{k:03d}", "good words in here" if k % 2 else "vile idiot words here") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(i, int("vile" in t)) for i, t in rows], "doc_id string, toxic int").withColumn("quality", F.col("toxic"))
    learned = {r.id for r in labelled_sample(docs, labels, "toxic").collect()}
    for scored in (toxicity.score_toxicity(docs, labels), quality.score_quality(docs, labels)):
        found = {r.doc_id: r.held_out for r in scored.collect()}
        assert set(found) == {i for i, _ in rows} and learned == {i for i, out in found.items() if not out}


def test_a_shared_phrase_joins_nothing(spark, monkeypatch):
    """Items and documents that share one phrase and nothing else: no candidates, though each pair shares its windows."""
    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    phrase = "which of the following statements is most likely true"
    items = spark.createDataFrame([(k, f"{phrase} {words(14)}") for k in range(100)] + [(999, "a quite different item of about a dozen words that is copied whole")], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"{words(5)} {phrase} {words(9)}") for k in range(500)] + [(900, f"{words(4)} a quite different item of about a dozen words that is copied whole {phrase}")], "doc_id long, text string")
    seen, kept = [], D.candidates
    monkeypatch.setattr(D, "candidates", lambda *a: seen.append(kept(*a)) or seen[-1])
    got = [(r.doc_id, r.item_id, r.coverage) for r in D.contaminated(docs, items).collect()]
    assert got == [(900, 999, 1.0)] and seen[0].count() == 1
    assert [(r.doc_id, r.item_id) for r in D.contaminated(docs, items, broadcast_windows=0).collect()] == [(900, 999)]


def test_contamination_equals_comparing_all_pairs(spark):
    """Plain words: a document is contaminated if windows of half an item's places are in it. Shares from none to all."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("klmnopqrst", k=5)) for _ in range(400)]
    words = lambda n: rng.choices(vocabulary, k=n)
    items = {k: words(rng.randrange(9, 30)) for k in range(25)}
    items[25] = items[0][:12] + words(9)  # shares its beginning with another
    docs = {}
    for d in range(120):
        own = items[rng.randrange(26)]
        cut = sorted(rng.choices(range(len(own) + 1), k=2))
        docs[d] = words(rng.randrange(12)) + own[cut[0] : cut[1]] + words(rng.randrange(12))
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    want = {(d, k, sum(g in set(grams(w, D.WINDOW)) for g in grams(item, D.WINDOW)) / len(grams(item, D.WINDOW))) for d, w in docs.items() for k, item in items.items()}
    frame = lambda x, name: spark.createDataFrame([(k, " ".join(w)) for k, w in x.items()], f"{name} long, text string")
    got = {(r.doc_id, r.item_id, r.coverage) for r in D.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == {x for x in want if x[2] >= D.COVERAGE} and len(got) > 10
