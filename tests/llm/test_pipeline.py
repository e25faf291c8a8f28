"""The pipeline stage by stage: each stage's result against a brute-force version on that stage's own input."""

import re
from collections import defaultdict

import numpy as np
import pytest
from test_operators import WORD, best_fit_decreasing, brute, repeated

import corpus_pipeline
from crosspanel.llm import quality
from crosspanel.llm.shared import settle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    """Input and output of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = settle(stage(spark, docs, SF))
        out[name] = (docs, after)
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns_and_ids(results):
    for name, (before, after) in results.items():
        if name != "packing":
            assert after.columns == before.columns
        assert set(texts(before)) >= {r.doc_id for r in after.select("doc_id").collect()}


def test_quality_stage(spark, results):
    before, after = results["quality_classifier"]
    judged = {r.doc_id: r.predicted for r in quality.classify(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert texts(after) == {i: t for i, t in texts(before).items() if judged[i]}


def test_line_stage(results):
    before, after = results["line_dedup"]
    split, cut = repeated(sorted(texts(before).items()))
    want = {i: [w for k, w in enumerate(split[i]) if k not in cut[i]] for i in split}
    got = {i: WORD.findall(t or "") for i, t in texts(after).items()}
    assert set(got) == {i for i in want if want[i] or not cut[i]}
    found, total = sum(len(split[i]) - len(got.get(i, [])) for i in split), sum(map(len, cut.values()))
    assert total and 0.99 * total <= found <= total
    for i, words in got.items():  # nothing but repeats is cut
        at = iter(words)
        assert all(w in at for w in want[i])


def test_near_duplicate_stage(results):
    before, after = results["near_duplicates"]
    own = {}
    for i, t in texts(before).items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        own[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    holders = defaultdict(set)
    for i, s in own.items():
        for g in s:
            holders[g].add(i)
    root = {i: i for i in own}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in own.items():
        for j in {j for g in s for j in holders[g] if j > i}:
            if 100 * len(s & own[j]) >= 80 * len(s | own[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert set(texts(after)) == {i for i in own if top(i) == i}


def test_decontamination_stage(spark, results):
    before, after = results["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text]
    ids, all_texts = zip(*sorted((i, t or "") for i, t in texts(before).items()), strict=True)
    held = {ids[d] for d, _ in brute(items, all_texts)}
    assert set(texts(after)) == set(ids) - held


def test_packing_stage(results):
    before, after = results["packing"]
    rows = after.collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    assert set(pieces) == set(texts(before))
    for own in pieces.values():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert [s for _, s, _ in own] == np.cumsum([0, *(n for _, _, n in own)])[:-1].tolist()
        assert all(n == 4096 for _, _, n in own[:-1])
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for own in filled.values():
        own.sort()
        assert [a for a, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 4096
    assert len(filled) <= best_fit_decreasing([r.length for r in rows])
