"""Manifests, drafts, acceptance and onboarding.

Tables are reduced in Spark; what goes into one file is bounded by a limit or
by the number of directories and records, and is written by the driver.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import normal_status
from ..operators import derive, report
from ..sinks.export import write_atomic
from ..sources import evidence, files, records
from ..sources.files import Config
from . import ask
from .index import Index, build

# The tags whose comments may become drafts.
DRAFT_TAGS = ("WHY", "DECISION", "HACK")
REQUEST = "request.json"
REQUEST_VERSION = 1


def _json(value: dict) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n"


def coverage_manifest(index: Index) -> dict:
    """Communities by size, then first member, with their members, linked
    records and status; totals; the first 200 edges between communities."""
    member = index.edges.filter("type = 'MEMBER_OF'").select(F.expr("substring(source, 6)").alias("path"), F.col("target").alias("community"))
    placed = index.nodes.filter("type IN ('File', 'Symbol', 'ConfigKey')").select("id", "path")
    claims = index.edges.filter("origin = 'record' AND target LIKE 'file:%'").select(F.col("source").alias("record"), F.expr("substring(target, 6)").alias("file"))
    rollup = derive.community_rollup(member, placed, claims).withColumnRenamed("files", "file_count")
    linked = member.join(claims.withColumnRenamed("file", "path"), "path").groupBy("community").agg(F.array_sort(F.collect_set("record")).alias("record_ids"))
    names = index.nodes.filter("type = 'Community'").select(F.col("id").alias("community"), "label")
    table = member.groupBy("community").agg(F.array_sort(F.collect_set("path")).alias("members")).withColumn("files", F.size("members"))
    table = table.join(rollup, "community").join(names, "community").join(linked, "community", "left")
    rows = [
        {"id": r.community, "signature": r.community.partition(":")[2], "label": r.label, "files": r.members, "file_count": r.files,
         "symbol_count": r.symbols, "record_ids": r.record_ids or [], "rationale_status": r.status}
        for r in derive.community_order(table).toLocalIterator()
    ]
    across = [r.asDict() for r in derive.cross_community(index.edges, placed, member).collect()]
    total = index.nodes.filter("type = 'File'").count()
    recorded = sum(r["rationale_status"] == "recorded" for r in rows)
    return {
        "version": 1, "authoritative": False, "indexed_files": total, "communities": rows, "cross_community_relationships": across,
        "coverage": {"files_assigned": sum(r["file_count"] for r in rows), "files_total": total, "communities_total": len(rows),
                     "communities_with_records": recorded, "communities_missing_rationale": len(rows) - recorded},
    }


def _history(spark: SparkSession, root: str, limit: int) -> list[tuple[str, str]]:
    """Commits, newest first; none where there is no repository."""
    if limit <= 0:
        return []
    try:
        return [(r["hash"], r["subject"]) for r in evidence.git_log(spark, root, limit).collect()]
    except (OSError, subprocess.SubprocessError):
        return []


def evidence_manifest(spark: SparkSession, root: str, folder: str, index: Index, history_limit: int = 50, max_evidence: int = 500, config: Config | None = None) -> dict:
    """Evidence.json and report.md below ``folder``. Files come first
    and leave up to a quarter of the budget to commits."""
    if not 0 <= history_limit <= 500:
        raise ValueError("history_limit is 0 to 500")
    if not 1 <= max_evidence <= 5000:
        raise ValueError("max_evidence is 1 to 5000")
    found = evidence.evidence(files.scan(spark, root, config, all_suffixes=True), max(1, max_evidence - min(history_limit, max_evidence // 4)))
    rows = [r.asDict() for r in found.orderBy("evd_id").collect()]
    truncated = bool(rows) and rows[0]["n_total"] > len(rows)
    items = [{"id": r["evd_id"], "kind": r["kind"], "locator": r["locator"], "summary": r["summary"]} for r in rows]
    for commit, subject in _history(spark, root, min(history_limit, max_evidence - len(items))):
        items.append({"id": f"EVD-{len(items) + 1:04d}", "kind": "git-history", "locator": f"git:{commit}", "summary": subject})
    counts: dict[str, int] = {}
    for x in items:
        counts[x["kind"]] = counts.get(x["kind"], 0) + 1
    table = spark.createDataFrame(list(counts.items()), "kind string, count long")
    manifest = {
        "manifest_version": 1, "authoritative": False, "evidence": items, "coverage": counts, "structural_coverage": coverage_manifest(index),
        "investigation_areas": evidence.areas(table).head()["areas"], "truncated": truncated or len(items) >= max_evidence,
    }
    write_atomic(f"{folder}/evidence.json", _json(manifest))
    write_atomic(f"{folder}/report.md", _report(manifest))
    return manifest


def _report(manifest: dict) -> str:
    whole = manifest["structural_coverage"]["coverage"]
    out = ["# Evidence report", "", "Found by a scan; nothing here is a decision.", "", "## Evidence", ""]
    out += [f"- {k}: {n}" for k, n in sorted(manifest["coverage"].items())] or ["- none"]
    out += ["- the budget was reached; more evidence exists"] if manifest["truncated"] else []
    out += ["", "## Structure", ""] + [f"- {k.replace('_', ' ')}: {n}" for k, n in whole.items()]
    return "\n".join([*out, "", "## Areas", "", *[f"- {a}" for a in manifest["investigation_areas"]], ""])


def _request(folder: str) -> dict | None:
    path = f"{folder}/{REQUEST}"
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        try:
            found = json.load(f)
        except ValueError as e:
            raise ValueError(f"{REQUEST} is not JSON") from e
    if not isinstance(found, dict) or found.get("request_version") != REQUEST_VERSION or found.get("status") not in ("pending", "completed"):
        raise ValueError(f"{REQUEST} has an unknown version or status")
    return found


def onboarding_status(folder: str) -> dict:
    """not_started, invalid, pending or completed."""
    try:
        found = _request(folder)
    except ValueError as e:
        return {"status": "invalid", "error": str(e)}
    return {"status": "not_started"} if found is None else {"status": found["status"], "completion": found.get("completion")}


def onboard(spark: SparkSession, root: str, folder: str, config: Config | None = None, history_limit: int = 50, max_evidence: int = 500, force: bool = False, index: Index | None = None) -> dict:
    """Evidence, then a pending request. A request for the same
    evidence stays as it is unless ``force`` is set. The project is indexed
    here unless a current index is given."""
    before = _request(folder)
    manifest = evidence_manifest(spark, root, folder, index or build(spark, root, config), history_limit, max_evidence, config)
    digest = hashlib.sha256(_json(manifest).encode()).hexdigest()
    if before is not None and not force and before.get("evidence_sha256") == digest:
        return {"action": "unchanged", **onboarding_status(folder)}
    made = {"request_version": REQUEST_VERSION, "status": "pending", "evidence_manifest": "evidence.json", "report": "report.md", "evidence_sha256": digest}
    write_atomic(f"{folder}/{REQUEST}", _json(made))
    return {"action": "created" if before is None else "refreshed", **onboarding_status(folder)}


def complete(spark: SparkSession, root: str, folder: str, summary: str, config: Config | None = None, index: Index | None = None) -> dict:
    """Closes a pending request. ValueError without a summary, a request,
    valid records or any record at all."""
    said = " ".join(summary.split())
    if not said:
        raise ValueError("a summary is needed")
    request = _request(folder)
    if request is None:
        raise ValueError("no request is open")
    if request["status"] == "completed":
        return {"action": "unchanged", **onboarding_status(folder)}
    index = index or build(spark, root, config)
    sound = index.diagnostics.filter("code IN ('REC001', 'REC003')").isEmpty() and ask.validate(index).filter("severity = 'error'").isEmpty()
    if not sound:
        raise ValueError("records are invalid")
    state = index.records.agg(F.count(F.lit(1)).alias("n"), F.count_if(normal_status(F.col("status")) == "draft").alias("drafts")).head()
    if state["n"] == 0:
        raise ValueError("no record was written")
    request |= {"status": "completed", "completion": {"summary": said, "records": state["n"], "requires_human_review": state["drafts"] > 0}}
    write_atomic(f"{folder}/{REQUEST}", _json(request))
    return {"action": "completed", **onboarding_status(folder)}


def _read_records(spark: SparkSession, root: str, config: Config) -> DataFrame:
    inside = files.scan(spark, root, config, all_suffixes=True).filter(F.col("path").startswith(config.records_dir.rstrip("/") + "/"))
    return records.records(inside)[0]


def _draft(rid: str, title: str, targets: list[str], day: str, parts: dict[str, str]) -> str:
    meta = {"id": rid, "type": "decision", "title": title, "status": "draft", "date": day, "targets": targets, "constraints": [], "supersedes": []}
    return records.render(meta, parts)


def write_proposals(spark: SparkSession, index: Index, root: str, day: str, config: Config | None = None, limit: int = 50) -> dict:
    """A draft decision for each file with a tagged reason, at most
    ``limit`` new ones in path order; files that have a draft are skipped. Also
    the conflicts of the new drafts with other records. Ids come from the path,
    with a piece of its digest where the path is too long for one."""
    config = config or Config()
    below = f"{config.records_dir.rstrip('/')}/proposals"
    said = index.facts.filter((F.col("fact") == "comment") & F.col("kind").isin(*DRAFT_TAGS)).select("path", "line", F.col("kind").alias("tag"), F.col("message").alias("note"))
    created, ids, skipped = [], [], 0
    for row in report.comments_by_file(said).orderBy("path").toLocalIterator():
        if len(created) >= limit:
            break
        slug = re.sub(r"[^a-z0-9]+", "-", row.path.casefold()).strip("-")
        name = f"{below}/prop-rationale-{slug}.md"
        if os.path.exists(f"{root}/{name}"):
            skipped += 1
            continue
        short = slug if len(slug) <= 40 else f"{slug[:33]}-{hashlib.sha256(row.path.encode()).hexdigest()[:6]}"
        rid = f"PROP-RATIONALE-{short}".upper()
        reasons = "\n".join(f"- `{row.path}:{n.line}` {n.tag}: {n.note}" for n in row.notes)
        parts = {"Context": f"Comments in `{row.path}` give reasons; they await review.", "Decision": "<!-- what the comments decide -->",
                 "Rationale": reasons, "Alternatives": "<!-- options they reject -->", "Consequences": "<!-- what follows -->"}
        write_atomic(f"{root}/{name}", _draft(rid, f"Recorded rationale in {row.path}: {row.headline or row.path}", [row.path], day, parts))
        created.append(name)
        ids.append(rid)
    clashes = []
    if ids:
        found = derive.conflicts(_read_records(spark, root, config))
        clashes = [r.asDict() for r in found.filter(F.col("a").isin(ids) | F.col("b").isin(ids)).orderBy("code", "a", "b").collect()]
    return {"created": created, "skipped": skipped, "conflicts": clashes}


def write_reflection(index: Index, root: str, summary: str, changed: DataFrame, rid: str, day: str, config: Config | None = None) -> dict:
    """A draft about one piece of work: its summary, the changed paths
    (path) with their symbols, and earlier decisions about the like."""
    config = config or Config()
    if not re.fullmatch(r"[A-Z][A-Z0-9_-]*", rid):
        raise ValueError(f"bad id {rid!r}")
    own = config.records_dir.rstrip("/") + "/proposals/"
    changed = changed.filter(~F.col("path").startswith(own)).distinct()
    found = ask.reflect(index, summary, changed)
    symbols = {r.path: r.labels for r in found["symbols"].collect()}
    paths = [r.path for r in changed.orderBy("path").collect()]
    lines = [f"- `{p}`" + (f": {', '.join(symbols[p])}" if p in symbols else "") for p in paths]
    parts = {"Context": summary.strip(), "Decision": "<!-- the choice made -->", "Rationale": "<!-- only what the evidence shows -->",
             "Alternatives": "<!-- if known -->", "Consequences": "<!-- what follows -->", "Open questions": "<!-- what the evidence does not show -->",
             "Evidence": "\n".join(lines) or "- no changed path"}
    name = f"{own}{rid.lower()}.md"
    write_atomic(f"{root}/{name}", _draft(rid, f"Review learning from: {' '.join(summary.split())[:72]}", paths, day, parts))
    near = [r.asDict() for r in found["precedents"].orderBy("rank").collect()]
    return {"proposal": name, "changed_paths": paths, "changed_symbols": symbols, "precedents": near}


def accept(spark: SparkSession, root: str, by: str, at: str, ids: list[str] | None = None, every: bool = False, config: Config | None = None) -> tuple[dict, Index | None]:
    """Drafts with these ids, or every draft, become stable with one
    more verifier; then the project is indexed anew if anything changed."""
    config = config or Config()
    wanted = {i.upper() for i in ids or []}
    known = _read_records(spark, root, config).select("id", "path", normal_status(F.col("status")).alias("status"))
    chosen = known if every else known.filter(F.col("id").isin(sorted(wanted)))
    accepted, skipped = [], []
    for r in chosen.orderBy("id", "path").collect():
        wanted.discard(r.id)
        if r.status != "draft":
            skipped.append({"id": r.id, "reason": "already accepted" if r.status == "stable" else f"status is {r.status}"})
            continue
        with open(f"{root}/{r.path}", encoding="utf-8") as f:
            text = f.read()
        write_atomic(f"{root}/{r.path}", records.accept(text, by, at))
        accepted.append(r.id)
    skipped += [{"id": i, "reason": "not found"} for i in sorted(wanted)]
    index = build(spark, root, config) if accepted else None
    return {"accepted": accepted, "skipped": skipped, "reindexed": index is not None}, index
