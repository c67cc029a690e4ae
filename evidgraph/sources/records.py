"""Decision records in Markdown with YAML front matter."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..schema import RECORD

_ACTOR = re.compile(r"\S")


def _text(value, limit: int = 500) -> str:
    line = " ".join(str(value).split())
    if not line or len(line) > limit:
        raise ValueError(f"text of 1 to {limit} characters expected")
    return line


def _target(value) -> str:
    path = str(value).replace("\\", "/").strip()
    while path.startswith("./"):
        path = path[2:]
    if not path or path.startswith("/") or ".." in path.split("/"):
        raise ValueError(f"target leaves the project: {value}")
    return path


def _actors(value) -> list[tuple[str, str]]:
    items = value if isinstance(value, list) else [value] if value else []
    out = []
    for x in items:
        if not _ACTOR.search(str(x.get("by", ""))):
            raise ValueError("empty actor")
        out.append((str(x["by"]).strip(), str(x.get("at", ""))))
    return out


def parse(path: str, content: str) -> tuple:
    """One record as a tuple in schema order; ValueError if it is malformed."""
    import yaml

    _, front, body = content.split("---", 2)
    meta = yaml.safe_load(front)
    if not isinstance(meta, dict):
        raise ValueError("front matter is no mapping")
    rid = str(meta.get("id", "")).strip().upper()
    if not re.fullmatch(r"[A-Z][A-Z0-9_-]*", rid):
        raise ValueError(f"bad id {rid!r}")
    kind, status = str(meta.get("type", "")).lower(), str(meta.get("status", "draft")).lower()
    if kind not in ("decision", "constraint", "architecture", "incident", "glossary"):
        raise ValueError(f"bad type {kind!r}")
    from ..schema import STATUS_MAP

    if status not in ("draft", "stable", "deprecated", *STATUS_MAP):
        raise ValueError(f"bad status {status!r}")
    refs = lambda k: [str(x).strip().upper() for x in meta.get(k) or []]
    evidence = [tuple(_text(e.get(k, "")) for k in ("kind", "source", "summary")) for e in meta.get("evidence") or []]
    made = _actors(meta.get("generated"))
    date = meta.get("date")
    return (
        rid, kind, _text(meta.get("title", "")), status, None if date is None else str(date),
        list(dict.fromkeys(_target(x) for x in meta.get("targets") or [])), refs("constraints"), refs("supersedes"),
        meta.get("confidence"), evidence, [_text(q) for q in meta.get("open_questions") or []],
        made[0] if made else None, _actors(meta.get("verified")), body.strip(), path, hashlib.sha256(content.encode()).hexdigest(),
    )


@udtf(returnType=f"record struct<{', '.join(f'{x.split()[0]}:' + x.split(None, 1)[1] for x in re.split(r', (?=[a-z_]+ )', RECORD))}>, code string, message string")
class ParseRecord:
    def eval(self, path: str, content: str):
        if content is None or not content.lstrip().startswith("---"):
            return
        try:
            yield parse(path, content), None, None
        except Exception as e:  # a broken record is a finding, not a failure of the scan
            code = "REC003" if "leaves the project" in str(e) else "REC001"
            yield None, code, str(e).splitlines()[0][:200]


def records(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, diagnostics) of Markdown files (path, content)."""
    spark = files.sparkSession
    spark.udtf.register("evid_parse_record", ParseRecord)
    files.filter(F.col("path").endswith(".md")).select("path", "content").createOrReplaceTempView("__record_files")
    parsed = spark.sql("SELECT f.path, r.* FROM __record_files f, LATERAL evid_parse_record(f.path, f.content) r")
    good = parsed.filter("record IS NOT NULL").select("record.*")
    bad = parsed.filter("code IS NOT NULL").select("code", F.lit("error").alias("severity"), "message", "path")
    return good, bad


def sections(body: Column) -> Column:
    """Heading (lower-cased) to text; a body that is only a comment is empty."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), body), r"\n## "), F.lit(2), F.lit(10_000))
    head = lambda p: F.lower(F.trim(F.substring_index(p, "\n", 1)))
    text = lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"^[^\n]*", ""), r"(?s)<!--.*?-->", ""))
    clean = lambda p: F.regexp_replace(text(p), r"^\s+|\s+$", "")
    pairs = F.transform(parts, lambda p: F.struct(head(p).alias("key"), clean(p).alias("value")))
    return F.map_from_entries(pairs)


def render(meta: dict, parts: dict[str, str]) -> str:
    """A record as Markdown."""
    import yaml

    head = yaml.safe_dump(meta, sort_keys=False, allow_unicode=True).strip()
    return f"---\n{head}\n---\n\n" + "\n\n".join(f"## {k}\n\n{v}" for k, v in parts.items()) + "\n"


def accept(content: str, by: str, at: str) -> str:
    """Status stable, no confidence, one more verifier."""
    import yaml

    _, front, body = content.split("---", 2)
    meta = yaml.safe_load(front)
    if meta.get("status") == "stable":
        return content
    meta["status"] = "stable"
    meta.pop("confidence", None)
    meta["verified"] = [*(meta.get("verified") or []), {"by": by, "at": at}]
    return f"---\n{yaml.safe_dump(meta, sort_keys=False, allow_unicode=True).strip()}\n---{body}"
