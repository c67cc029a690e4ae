"""Manifests, drafts, acceptance and onboarding on a small invented project."""

from __future__ import annotations

import json
import os

import pytest

from evidgraph.plans import review
from evidgraph.plans.index import build

FILES = {
    "src/a/one.py": "# WHY: kept small because callers copy it\ndef f():\n    return g()\n\n\ndef g():\n    # DECISION: no cache\n    return 1\n",
    "src/b/two.py": "from a.one import f\n\n\ndef h():\n    return f()\n",
    "src/b/three.py": "def k():\n    return 2\n",
    "README.md": "# Title\n\n## Use\n",
    "records/con-1.md": "---\nid: CON-1\ntype: decision\ntitle: Small functions in one\nstatus: stable\ntargets: [src/a/one.py]\nverified: {by: 'human:ada', at: 2024-01-01}\n---\n\n## Decision\n\nx\n",
}


def test_review(spark, tmp_path):
    root, folder = f"{tmp_path}/p", f"{tmp_path}/out"
    for path, text in FILES.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w") as f:
            f.write(text)
    assert review.onboarding_status(folder) == {"status": "not_started"}
    with pytest.raises(ValueError):
        review.complete(spark, root, folder, "done")
    index = build(spark, root)

    cover = review.coverage_manifest(index)
    assert cover["coverage"]["files_assigned"] == cover["coverage"]["files_total"] == 3
    sizes = [(-c["file_count"], c["files"][0]) for c in cover["communities"]]
    assert sizes == sorted(sizes)
    assert [c["record_ids"] for c in cover["communities"] if "src/a/one.py" in c["files"]] == [["CON-1"]]

    with pytest.raises(ValueError):
        review.evidence_manifest(spark, root, folder, index, max_evidence=0)
    assert review.onboard(spark, root, folder, index=index)["action"] == "created"
    assert review.onboard(spark, root, folder, index=index)["action"] == "unchanged"
    assert review.onboard(spark, root, folder, force=True, index=index)["action"] == "refreshed"
    manifest = json.load(open(f"{folder}/evidence.json"))
    assert sum(manifest["coverage"].values()) == len(manifest["evidence"]) > 3 and not manifest["truncated"]
    assert "## Structure" in open(f"{folder}/report.md").read()

    made = review.write_proposals(spark, index, root, "2024-05-01")
    assert made["created"] == ["records/proposals/prop-rationale-src-a-one-py.md"]
    assert [(c["code"], {c["a"], c["b"]}) for c in made["conflicts"]] == [("CONFLICT003", {"CON-1", "PROP-RATIONALE-SRC-A-ONE-PY"})]
    assert "one.py:7` DECISION: no cache" in open(f"{root}/{made['created'][0]}").read()
    again = review.write_proposals(spark, index, root, "2024-05-01")
    assert (again["created"], again["skipped"], again["conflicts"]) == ([], 1, [])

    changed = spark.createDataFrame([("src/a/one.py",), ("records/proposals/x.md",)], "path string")
    told = review.write_reflection(index, root, "small functions", changed, "PROP-1", "2024-05-02")
    assert told["changed_paths"] == ["src/a/one.py"] and told["changed_symbols"] == {"src/a/one.py": ["f", "g"]}
    assert [p["id"] for p in told["precedents"]] == ["CON-1"]

    state, fresh = review.accept(spark, root, "human:bo", "2024-05-03", ids=["prop-1", "CON-1", "NO-1"])
    assert state["accepted"] == ["PROP-1"] and state["reindexed"]
    assert {s["id"]: s["reason"] for s in state["skipped"]} == {"CON-1": "already accepted", "NO-1": "not found"}
    assert fresh.records.filter("id = 'PROP-1' AND status = 'stable'").count() == 1
    assert review.accept(spark, root, "human:bo", "2024-05-03", ids=["CON-1"])[1] is None

    done = review.complete(spark, root, folder, " read  all ", index=fresh)
    assert (done["action"], done["completion"]) == ("completed", {"summary": "read all", "records": 3, "requires_human_review": True})
    assert review.complete(spark, root, folder, "x")["action"] == "unchanged"
    with open(f"{folder}/request.json", "w") as f:
        f.write("{")
    assert review.onboarding_status(folder)["status"] == "invalid"
