"""Symbols, calls and imports of source files.

Python goes through the standard parser; other languages through tables of
patterns, one row a language. Both are table functions: one file in, typed
facts out.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

FACT = "fact string, qualname string, kind string, line int, end_line int, target string, receiver string, name string, alias string, level int, message string"


def _row(fact: str, **given) -> tuple:
    order = ("qualname", "kind", "line", "end_line", "target", "receiver", "name", "alias", "level", "message")
    return (fact, *(given.get(k) for k in order))


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if not isinstance(node, ast.Name):
        return None
    return ".".join([node.id, *reversed(parts)])


class _Facts(ast.NodeVisitor):
    def __init__(self) -> None:
        self.stack: list[tuple[str, str]] = []
        self.types: list[dict[str, str]] = [{}]
        self.rows: list[tuple] = []

    def _name(self) -> str:
        return ".".join(n for n, _ in self.stack)

    def _symbol(self, node, kind: str) -> None:
        self.stack.append((node.name, kind))
        self.rows.append(_row("symbol", qualname=self._name(), kind=kind, line=node.lineno, end_line=node.end_lineno))

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._symbol(node, "class")
        for b in node.bases:
            if base := _dotted(b):
                self.rows.append(_row("base", qualname=self._name(), target=base, line=node.lineno))
        known: dict[str, str] = {}
        for fn in node.body:  # what the class's attributes are made of
            for x in ast.walk(fn):
                if isinstance(x, ast.Assign) and isinstance(x.value, ast.Call) and (made := _dotted(x.value.func)):
                    for t in x.targets:
                        if isinstance(t, ast.Attribute) and _dotted(t.value) == "self":
                            known[f"self.{t.attr}"] = made
        self.types.append(known)
        self.generic_visit(node)
        self.types.pop()
        self.stack.pop()

    def _function(self, node) -> None:
        inside = bool(self.stack) and self.stack[-1][1] == "class"
        self._symbol(node, "method" if inside else "function")
        local = dict(self.types[-1])
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
            if a.annotation is not None and (t := _dotted(a.annotation)):
                local[a.arg] = t
        for x in ast.walk(node):
            if isinstance(x, ast.Assign) and isinstance(x.value, ast.Call) and (made := _dotted(x.value.func)):
                for t in x.targets:
                    if isinstance(t, ast.Name):
                        local[t.id] = made
        self.types.append(local)
        self.generic_visit(node)
        self.types.pop()
        self.stack.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Call(self, node: ast.Call) -> None:
        if self.stack and (target := _dotted(node.func)):
            owner = target.rpartition(".")[0]
            self.rows.append(_row("call", qualname=self._name(), target=target, receiver=self.types[-1].get(owner), line=node.lineno))
        self.generic_visit(node)

    def visit_Attribute(self, node: ast.Attribute) -> None:
        if self.stack and isinstance(node.ctx, ast.Load) and (target := _dotted(node)):
            self.rows.append(_row("reference", qualname=self._name(), target=target, line=node.lineno))
        self.generic_visit(node)

    def visit_Constant(self, node: ast.Constant) -> None:
        if self.stack and isinstance(node.value, str) and re.fullmatch(r"[A-Za-z_][\w.-]{2,80}", node.value):
            self.rows.append(_row("reference", qualname=self._name(), target=node.value, line=node.lineno))

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.rows.append(_row("import", target=a.name, alias=a.asname or a.name.split(".")[0], level=0, line=node.lineno))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        if node.module is None:
            return
        for a in node.names:
            self.rows.append(_row("import", target=node.module, name=a.name, alias=a.asname or a.name, level=node.level, line=node.lineno))


# One row a language: symbol patterns (kind, pattern with a name group), the
# inheritance pattern and the import pattern.
_NAME = r"(?P<name>[A-Za-z_$][\w$]*)"
_ES = [("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_NAME}(?:\s+extends\s+(?P<base>[\w.$]+))?"),
       ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_NAME}"),
       ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>"),
       ("method", rf"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+)*(?!if|for|while|switch|return|catch|function){_NAME}\s*\([^)]*\)\s*(?::\s*[\w<>\[\], |]+)?\s*\{{")]
LANGUAGES: dict[str, list[tuple[str, str]]] = {
    **{s: _ES for s in (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")},
    ".go": [("class", rf"^type\s+{_NAME}\s+(?:struct|interface)\b"), ("method", rf"^func\s+\([^)]*\)\s*{_NAME}\s*\("), ("function", rf"^func\s+{_NAME}\s*[(\[]")],
    ".rs": [("class", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+{_NAME}"), ("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+{_NAME}")],
    ".java": [("class", rf"^\s*(?:\w+\s+)*(?:class|interface|enum|record)\s+{_NAME}(?:\s+extends\s+(?P<base>[\w.]+))?"),
              ("method", rf"^\s+(?:public|private|protected|static|final|\s)+[\w<>\[\], ]+\s+{_NAME}\s*\([^;]*\)\s*(?:throws\s+[\w, .]+)?\{{")],
    ".cs": [("class", rf"^\s*(?:\w+\s+)*(?:class|interface|struct|enum|record)\s+{_NAME}(?:\s*:\s*(?P<base>[\w.]+))?"),
            ("method", rf"^\s+(?:public|private|protected|internal|static|async|override|virtual|\s)+[\w<>\[\], ?]+\s+{_NAME}\s*\([^;]*\)\s*\{{?$")],
}
_CALL = re.compile(r"(?<![\w$.])((?:[A-Za-z_$][\w$]*\s*\.\s*)*[A-Za-z_$][\w$]*)\s*\(")
_KEYWORDS = frozenset("if for while switch return catch function func fn new class super this match loop else do sizeof typeof await yield defer go using lock".split())
_ES_IMPORT = re.compile(r"import\s+(?:type\s+)?(.+?)\s+from\s+['\"]([^'\"]+)['\"]", re.S)


def es_imports(text: str) -> list[tuple[str, str]]:
    """(local name, specifier) of every import clause."""
    out = []
    for clause, spec in _ES_IMPORT.findall(text):
        for named in re.findall(r"\{([^}]*)\}", clause):
            for item in named.split(","):
                words = item.replace("type ", " ").split()
                if words:
                    out.append((words[-1], spec))
        rest = re.sub(r"\{[^}]*\}", "", clause)
        for item in rest.split(","):
            words = item.split()
            if words:
                out.append((words[-1], spec))
    return out


def _pattern_facts(path: str, content: str, rules: list[tuple[str, str]]) -> list[tuple]:
    compiled = [(k, re.compile(p)) for k, p in rules]
    lines, rows, found = content.split("\n"), [], []
    for i, line in enumerate(lines, 1):
        for kind, p in compiled:
            if m := p.match(line):
                found.append([m["name"], kind, i, len(line) - len(line.lstrip()), m.groupdict().get("base")])
                break
    spans = []
    for n, (name, kind, line, indent, base) in enumerate(found):
        end = next((f[2] - 1 for f in found[n + 1 :] if f[3] <= indent), len(lines))
        owner = next((f[0] for f in reversed(found[:n]) if f[3] < indent and f[1] == "class"), None)
        qual = f"{owner}.{name}" if owner and kind != "class" else name
        spans.append((qual, kind, line, end))
        rows.append(_row("symbol", qualname=qual, kind=kind, line=line, end_line=end))
        if base:
            rows.append(_row("base", qualname=qual, target=base, line=line))
    for qual, kind, line, end in spans:
        if kind == "class":
            continue
        for i in range(line, end + 1):
            text = lines[i - 1].split("//")[0]
            for m in _CALL.finditer(text):
                target = re.sub(r"\s", "", m[1])
                if target.split(".")[0] in _KEYWORDS or (i == line and target == qual.split(".")[-1]):
                    continue
                rows.append(_row("call", qualname=qual, target=target, line=i))
    for local, spec in es_imports(content) if path.endswith((".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")) else []:
        rows.append(_row("import", target=spec, alias=local, name=local, level=0))
    return rows


@udtf(returnType=FACT)
class ExtractCode:
    """Facts of one file; a syntax error or an unknown language is a diagnostic."""

    def eval(self, path: str, content: str):
        if content is None:
            yield _row("diagnostic", kind="PY001", message="not UTF-8")
            return
        if path.endswith(".py"):
            try:
                tree = ast.parse(content)
            except (SyntaxError, ValueError, RecursionError) as e:
                yield _row("diagnostic", kind="PY001", message=str(e)[:200])
                return
            facts = _Facts()
            facts.visit(tree)
            yield from facts.rows
            return
        rules = LANGUAGES.get("." + path.rsplit(".", 1)[-1].lower())
        if rules is None:
            yield _row("diagnostic", kind="LANG002", message="no patterns for this language")
            return
        yield from _pattern_facts(path, content, rules)


def code_facts(files: DataFrame) -> DataFrame:
    """(path, FACT) of code files (path, content)."""
    spark = files.sparkSession
    spark.udtf.register("evid_extract_code", ExtractCode)
    files.filter(~F.col("path").rlike(r"\.(json|ya?ml|md)$")).select("path", "content").createOrReplaceTempView("__code_files")
    return spark.sql("SELECT f.path, c.* FROM __code_files f, LATERAL evid_extract_code(f.path, f.content) c")
