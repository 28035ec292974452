"""run() against a plain version of its stages, and each stage on odd rows."""

import re

import corpus_pipeline
import pytest
from strandweave.llm import langid, packing

from . import test_ngram_join, test_phrase_dedup, test_quality


def plain(rows, model):
    rows = [r for r in rows if model.knows(r[1])]
    good = test_quality.brute(rows)
    rows = [r for r in rows if good[r[0]]["kept"]]
    classes = {d: c for d, _, c in test_ngram_join.brute(rows)}
    rows = [r for r in rows if classes[r[0]] == r[0]]
    rest = {d: (n, gone, text) for d, n, gone, text in test_phrase_dedup.brute(rows, 13)}
    return {r[0]: rest[r[0]][2] if rest[r[0]][1] else r[1] for r in rows if rest[r[0]][0] > rest[r[0]][1]}


@pytest.mark.parametrize("seed", [3])
def test_run_equals_the_plain_version(spark, make_docs, tmp_path, seed):
    rows = [(i, t, "en", s) for i, t, _, s in test_quality.corpus()[:200]]
    shared = " ".join(f"shared{i}" for i in range(30))
    rows += [(1000 + i, t + " " + shared, "en", "a") for i, t, _, _ in rows[:40]]
    rows += [(2000 + i, t + " tail", "en", "b") for i, t, _, _ in rows[:60]]
    rows += [(3000, "123 456 !!", "en", "a"), (3001, None, None, None)]
    docs = make_docs(rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain(rows, langid.learn(docs, floors=True))
    assert {r["doc_id"] for r in out} == set(want) and len(want) > 20
    size = {}
    for r in out:
        size[r["doc_id"]] = size.get(r["doc_id"], 0) + r["n_units"]
    assert size == {d: len(t.encode()) + 1 for d, t in want.items()}
    bins = {}
    for r in out:
        bins.setdefault(r["bin_id"], []).append(r)
    source = {r[0]: r[3] for r in rows}
    for own in bins.values():
        assert sum(r["n_units"] for r in own) <= packing.CAPACITY
        assert len({source[r["doc_id"]] for r in own}) == len(own)


def test_stages_take_odd_rows(spark, odd_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        out.count()
        assert name == "best_fit_packing" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0
    assert re.fullmatch("best_fit_packing", name)
