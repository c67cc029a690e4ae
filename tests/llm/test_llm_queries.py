"""The registered queries against SQL, and the pipeline's stages against brute force."""

from __future__ import annotations

import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
import brute
from oracle import SF, connect, same

import corpus_pipeline as cp
from evidgraph.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        same(df, connect(), ORACLES[name])
    else:
        table = "pages" if name.startswith("op10") else "documents"
        assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_op4_counts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op4_quality_forest"](spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in rows} == {d: brute.rule_counts(t) for d, t in texts.items()}
    assert not any(r.kept and r.base_failed for r in rows)


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.columns
    for i, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after = docs.collect()
        if name == "quality rules":
            verdicts = {r.doc_id: r.kept for r in QUERIES["op4_quality_forest"](spark, SF).collect()}
            assert sorted(map(repr, after)) == sorted(repr(r) for d, r in before.items() if verdicts[d])
            assert not any(brute.rule_counts(r.text)[5] for r in after)
        if name == "near-duplicates":
            groups = brute.near_groups([(d, r.text) for d, r in before.items()], 5)
            assert {r.doc_id for r in after} == set(groups.values())
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert {r.doc_id for r in after} == {x[0] for x in brute.contaminated([(d, r.text) for d, r in before.items()], items) if not x[5]}
        if name == "mixing":
            words = {d: len(brute.WORD.findall(r.text or "")) for d, r in before.items()}
            sizes, taken, longest = Counter(), Counter(), Counter()
            for d, r in before.items():
                sizes[r.source] += words[d]
                longest[r.source] = max(longest[r.source], words[d])
            for r in after:
                assert r == before[r.doc_id]
                taken[r.source] += words[r.doc_id]
            assert max(Counter(r.doc_id for r in after).values()) <= 2
            assert all(abs(taken[s] - t) <= longest[s] for s, t in brute.targets(sizes).items())
        if name == "sharding":
            assert all(r.shard == brute.jump(r.doc_id, 40) for r in after)
        else:
            assert docs.columns == first and after
    whole = cp.run(spark, SF)
    assert sorted((r.doc_id, r.shard, r.slot) for r in whole.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in after)
