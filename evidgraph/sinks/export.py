"""Exports. Rows are projected in Spark; what one file holds
is bounded before the driver writes it."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug, xml_escape
from ..operators.graph import bounded_view, keep_endpoints


def write_atomic(path: str, text: str) -> None:
    """A temporary file beside the target, then a rename."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(temp, path)


def envelope(payload: dict | None = None, error: str | None = None, code: str | None = None) -> str:
    """K15, E22."""
    body = {"ok": False, "error": {"code": code, "message": error}} if error else (payload or {})
    return json.dumps({"schema_version": 1, **body}, ensure_ascii=False, sort_keys=True)


def graphml_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, id, line): GraphML elements, nodes before edges."""
    n = nodes.select(F.lit(0).alias("part"), "id", F.concat(
        F.lit('<node id="'), xml_escape(F.col("id")), F.lit('"><data key="type">'), xml_escape(F.col("type")), F.lit('</data><data key="label">'),
        xml_escape(F.coalesce("label", F.lit(""))), F.lit("</data></node>")).alias("line"))
    key = F.concat_ws("|", "source", "target", "type")
    e = keep_endpoints(edges, nodes).select(F.lit(1).alias("part"), key.alias("id"), F.concat(
        F.lit('<edge source="'), xml_escape(F.col("source")), F.lit('" target="'), xml_escape(F.col("target")), F.lit('"><data key="type">'),
        xml_escape(F.col("type")), F.lit("</data></edge>")).alias("line"))
    return n.unionByName(e)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Streams the ordered lines through the driver, a partition at a time."""
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="type" for="all" attr.name="type" attr.type="string"/>\n<key id="label" for="node" attr.name="label" attr.type="string"/>\n<graph edgedefault="directed">\n'
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write(head)
        for row in graphml_rows(nodes, edges).orderBy("part", "id").select("line").toLocalIterator():
            f.write(row["line"] + "\n")
        f.write("</graph>\n</graphml>\n")
    os.replace(path + ".tmp", path)


def layout(nodes: DataFrame, edges: DataFrame, width: int = 1200, height: int = 800, iterations: int = 200) -> DataFrame:
    """(id, x, y): a seeded force layout of a bounded view, one group."""
    import pandas as pd

    kept = bounded_view(nodes, 400)
    rows = kept.select(F.lit(0).alias("g"), "id", F.lit(None).cast("string").alias("other")).unionByName(
        keep_endpoints(edges, kept).select(F.lit(0).alias("g"), F.col("source").alias("id"), F.col("target").alias("other")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        ids = sorted(pdf[pdf.other.isna()].id)
        at = {v: i for i, v in enumerate(ids)}
        pairs = sorted({(at[a], at[b]) for a, b in zip(pdf.id, pdf.other, strict=True) if b is not None and b == b and a != b})
        pos = np.random.default_rng(42).random((len(ids), 2)) * [width, height]
        k = (width * height / max(len(ids), 1)) ** 0.5
        for step in range(iterations):
            delta = pos[:, None] - pos[None]
            dist = np.maximum(np.sqrt((delta**2).sum(-1)), 0.01)
            move = (delta / dist[..., None] * (k * k / dist)[..., None]).sum(1)
            for a, b in pairs:
                d = pos[a] - pos[b]
                pull = d * (np.hypot(*d) / k)
                move[a] -= pull
                move[b] += pull
            size = np.maximum(np.sqrt((move**2).sum(-1)), 0.01)[:, None]
            pos = np.clip(pos + move / size * np.minimum(size, width / 10 * (1 - step / iterations)), [20, 20], [width - 20, height - 20])
        return pd.DataFrame({"id": ids, "x": pos[:, 0].round(2), "y": pos[:, 1].round(2)})

    return rows.groupBy("g").applyInPandas(run, "id string, x double, y double")


def write_svg(nodes: DataFrame, edges: DataFrame, path: str, width: int = 1200, height: int = 800) -> None:
    """K04."""
    import html

    place = {r["id"]: (r["x"], r["y"]) for r in layout(nodes, edges, width, height).collect()}  # 400 rows at most
    view = bounded_view(nodes, 400)
    lines = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">']
    for r in keep_endpoints(edges, view).select("source", "target").distinct().orderBy("source", "target").toLocalIterator():
        (a, b), (c, d) = place[r["source"]], place[r["target"]]
        lines.append(f'<line x1="{a}" y1="{b}" x2="{c}" y2="{d}" stroke="#999"/>')
    for r in view.orderBy("id").select("id", "label").collect():
        x, y = place[r["id"]]
        lines.append(f'<g><circle cx="{x}" cy="{y}" r="5"/><text x="{x + 7}" y="{y}">{html.escape(r["label"] or r["id"])}</text></g>')
    write_atomic(path, "\n".join([*lines, "</svg>", ""]))


def map_payload(nodes: DataFrame, edges: DataFrame, max_nodes: int = 600) -> str:
    """The bounded view as JSON."""
    view = bounded_view(nodes, max_nodes)
    n = [r.asDict() for r in view.select("id", "type", "label").orderBy("priority", "id").collect()]
    e = [r.asDict() for r in keep_endpoints(edges, view).select("source", "target", "type").distinct().orderBy("source", "target", "type").collect()]
    return json.dumps({"nodes": n, "edges": e}, ensure_ascii=False)


def write_html_map(nodes: DataFrame, edges: DataFrame, path: str, title: str = "Map", max_nodes: int = 600) -> None:
    data = map_payload(nodes, edges, max_nodes).replace("</", "<\\/")
    write_atomic(path, f"""<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title></head><body><input id="q" placeholder="filter"><ul id="list"></ul>
<script type="application/json" id="data">{data}</script><script>
const d = JSON.parse(document.getElementById('data').textContent), list = document.getElementById('list'), q = document.getElementById('q');
const near = {{}}; d.edges.forEach(e => {{ (near[e.source] ??= []).push(e.type + ' ' + e.target); }});
function show() {{ list.textContent = ''; d.nodes.filter(n => (n.id + n.label).toLowerCase().includes(q.value.toLowerCase())).forEach(n => {{
  const li = document.createElement('li'); li.textContent = n.type + ': ' + (n.label || n.id) + ' ' + (near[n.id] || []).join(', '); list.append(li); }}); }}
q.oninput = show; show();
</script></body></html>
""")


def vault_notes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, text): a note a node with links grouped by edge type."""
    name = F.concat(slug(F.col("id")), F.lit("-"), F.substring(F.sha2("id", 256), 1, 6))
    named = nodes.select("id", "type", "label", name.alias("name"))
    live = keep_endpoints(edges, nodes).select("source", "target", "type").distinct()
    to = named.select(F.col("id").alias("target"), F.col("name").alias("target_name"))
    groups = live.join(to, "target").groupBy("source", "type").agg(F.array_sort(F.collect_list(F.concat(F.lit("- [["), "target_name", F.lit("]]")))).alias("links"))
    part = groups.select("source", F.struct("type", F.concat(F.lit("\n## "), "type", F.lit("\n\n"), F.array_join("links", "\n")).alias("t")).alias("p"))
    body = part.groupBy(F.col("source").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["t"]), "\n").alias("body"))
    return named.join(body, "id", "left").select("name", F.concat(
        F.lit("# "), F.coalesce("label", "id"), F.lit("\n\nType: "), "type", F.lit("\n"), F.coalesce("body", F.lit("")), F.lit("\n")).alias("text"))


def write_vault(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """One Markdown file a note, written where the driver runs."""
    os.makedirs(folder, exist_ok=True)
    for r in vault_notes(nodes, edges).toLocalIterator():
        write_atomic(f"{folder}/{r['name']}.md", r["text"])


def report_markdown(tables: dict[str, DataFrame]) -> str:
    """Small report tables as Markdown."""
    out = ["# Graph report"]
    for title, df in tables.items():
        rows = df.limit(200).collect()
        out += ["", f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(str(v) for v in r) + " |" for r in rows]
    return "\n".join(out) + "\n"


def append_usage(row: DataFrame, folder: str) -> None:
    """K13."""
    row.write.mode("append").json(folder)
