"""The pipeline's stages on a given table, each held against brute force over its own input."""

import os
import re

import pytest

import corpus_pipeline
from tests.llm.test_operators import base_counts, components_of, lines_removed

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, FOLDER).persist()
        seen[name] = ({r["doc_id"]: r["text"] for r in before.collect()} if "text" in before.columns else {}, docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = seen["language_id"]
    assert {r["doc_id"] for r in after} == set(before)  # every given document is in a language that the labels name
    before, after = seen["quality_rules"]
    failed = {i for i, t in before.items() if (b := base_counts(t))[0] < 50 or 2 * b[4] > b[0]}
    assert {r["doc_id"] for r in after}.isdisjoint(failed) and len(after) > 0.5 * len(before)
    before, after = seen["line_dedup"]
    gone = lines_removed(sorted(before.items()))
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in before.items()}
    want = {i: t for i, t in want.items() if t == before[i] or re.search(r"[^\x20\x09-\x0D]", t)}
    assert {r["doc_id"]: r["text"] for r in after} == want and all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = seen["ngram_jaccard"]
    sets = {}
    for i, t in before.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    assert sorted(r["doc_id"] for r in after) == sorted(set(components_of(sets).values()))
    before, after = seen["best_fit_packing"]
    assert {r["doc_id"] for r in after} == set(before)
    for key in {r["sequence_id"] for r in after}:
        spans = sorted((r["offset"], r["length"]) for r in after if r["sequence_id"] == key)
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 2048
