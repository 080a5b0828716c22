"""Symbols, relations and imports of a source file: exact for Python, by patterns over blanked text for other languages."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lattica.extract.lexer import Code

#: kind: symbol, relation or import. Relations: name is the relation, target what it points to, owner the symbol it starts from.
COLUMNS = ["kind", "name", "type", "owner", "target", "receiver", "signature", "doc", "start_line", "end_line", "confidence", "exported"]
CONFIDENCE = {"IMPORTS": 0.9, "CALLS": 0.8, "METHOD": 0.6, "TYPED": 0.95, "IMPLEMENTS": 0.95, "EXTENDS": 0.9, "PARAM_TYPE": 0.9, "RETURN_TYPE": 0.9, "TYPED_AS": 0.85, "REFERENCES": 0.85, "USES": 0.8}
PRIMITIVES = set("Any Array Awaitable BigInt Boolean Callable Date Dict Error Exception Function Generic Iterable Iterator List Literal Map None Null Number Object Optional Promise Record RegExp Self Sequence Set String Symbol Tuple Type Undefined Union Void any bool boolean bytes dict float int list never null number object set str string symbol tuple type undefined unknown void".split())


def _row(kind, name, type=None, owner=None, target=None, receiver=None, signature="", doc="", start=1, end=1, confidence=1.0, exported=False):
    return (kind, name, type, owner, target, receiver, signature, doc, start, end, confidence, exported)


def head(text: str) -> str:
    """The declaration up to its body, on one line, 140 characters."""
    return re.sub(r"\s+", " ", re.split(r"\{|=>", text)[0]).strip()[:140]


def type_names(text: str) -> list[str]:
    """Names in a type that are not primitive."""
    return [t for t in dict.fromkeys(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text)) if t not in PRIMITIVES and t[0].isupper()]


def python(path: str, source: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return
    lines = source.split("\n")

    def signature(node: ast.AST) -> str:
        first = node.body[0].lineno if getattr(node, "body", None) else node.end_lineno + 1
        text = "\n".join(lines[node.lineno - 1 : max(node.lineno, first - 1)])
        return head(re.sub(r":\s*$", "", text.strip()))

    def comment(node: ast.AST) -> str:
        if found := ast.get_docstring(node):
            return found[:500]
        i, out = node.lineno - 2, []
        while i >= 0 and lines[i].strip().startswith("#"):
            out.append(lines[i].strip().lstrip("# "))
            i -= 1
        return " ".join(reversed(out))[:500]

    def annotation(node: ast.AST | None, relation: str, owner: str) -> Iterator[tuple]:
        if node is not None:
            for t in type_names(ast.unparse(node)):
                yield _row("relation", relation, owner=owner, target=t, start=node.lineno, end=node.lineno, confidence=CONFIDENCE[relation])

    def visit(node: ast.AST, owner: str | None, inside: str | None) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            here = owner
            if isinstance(child, ast.ClassDef):
                yield _row("symbol", child.name, "class", inside, signature=signature(child), doc=comment(child), start=child.lineno, end=child.end_lineno, exported=not child.name.startswith("_"))
                for b in child.bases:
                    for t in type_names(ast.unparse(b)):
                        yield _row("relation", "EXTENDS", owner=child.name, target=t, start=child.lineno, end=child.lineno, confidence=CONFIDENCE["EXTENDS"])
                yield from visit(child, child.name, child.name)
                continue
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield _row("symbol", child.name, "method" if inside and isinstance(node, ast.ClassDef) else "function", inside, signature=signature(child), doc=comment(child), start=child.lineno, end=child.end_lineno, exported=not child.name.startswith("_"))
                args = child.args
                for a in (*args.posonlyargs, *args.args, *args.kwonlyargs, args.vararg, args.kwarg):
                    if a is not None:
                        yield from annotation(a.annotation, "PARAM_TYPE", child.name)
                yield from annotation(child.returns, "RETURN_TYPE", child.name)
                here = child.name
            elif isinstance(child, ast.Import):
                for a in child.names:
                    yield _row("import", a.asname or a.name, "module", owner, target=a.name, start=child.lineno, end=child.lineno, confidence=CONFIDENCE["IMPORTS"])
            elif isinstance(child, ast.ImportFrom):
                module = "." * child.level + (child.module or "")
                for a in child.names:
                    yield _row("import", a.asname or a.name, a.name, owner, target=module, start=child.lineno, end=child.lineno, confidence=CONFIDENCE["IMPORTS"])
            elif isinstance(child, ast.Assign) and isinstance(node, ast.Module):
                for t in child.targets:
                    if isinstance(t, ast.Name):
                        yield _row("symbol", t.id, "variable", signature=head(lines[child.lineno - 1]), start=child.lineno, end=child.end_lineno, exported=not t.id.startswith("_"))
            elif isinstance(child, ast.AnnAssign):
                yield from annotation(child.annotation, "TYPED_AS", owner or "")
            elif isinstance(child, ast.Call):
                f = child.func
                if isinstance(f, ast.Name):
                    yield _row("relation", "USES" if f.id[:1].isupper() else "CALLS", owner=owner, target=f.id, start=child.lineno, end=child.lineno, confidence=CONFIDENCE["CALLS"])
                elif isinstance(f, ast.Attribute):
                    yield _row("relation", "CALLS", owner=owner, target=f.attr, receiver=ast.unparse(f.value), start=child.lineno, end=child.lineno, confidence=CONFIDENCE["METHOD"])
            yield from visit(child, here, inside if here == owner else inside)

    yield from visit(tree, None, None)


_DECLARED = {
    "ts": [
        ("class", r"\bclass\s+([A-Za-z_$][\w$]*)"),
        ("interface", r"\binterface\s+([A-Za-z_$][\w$]*)"),
        ("type", r"\b(?:type\s+([A-Za-z_$][\w$]*)\s*(?:<[^=]*>)?\s*=|enum\s+([A-Za-z_$][\w$]*))"),
        ("function", r"\bfunction\s*\*?\s+([A-Za-z_$][\w$]*)\s*(?:<[^>(]*>)?\("),
        ("function", r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=>"),
        ("variable", r"(?m)^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=(?!\s*(?:async\s*)?(?:\([^()]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=>)"),
    ],
    "go": [("function", r"(?m)^func\s+([A-Za-z_]\w*)\s*[\[(]"), ("method", r"(?m)^func\s+\([^)]*\)\s*([A-Za-z_]\w*)\s*\("), ("class", r"\btype\s+(\w+)\s+struct\b"), ("interface", r"\btype\s+(\w+)\s+interface\b")],
    "rust": [("function", r"\bfn\s+(\w+)"), ("class", r"\bstruct\s+(\w+)"), ("type", r"\b(?:enum|type)\s+(\w+)"), ("interface", r"\btrait\s+(\w+)")],
    "java": [("class", r"\b(?:class|record)\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("type", r"\benum\s+(\w+)"), ("method", r"(?m)^[ \t]+(?:(?:public|private|protected|internal|static|final|override|virtual|async|abstract|synchronized)\s+)+[\w<>\[\],.? ]+?\s+(\w+)\s*\(")],
    "ruby": [("class", r"(?m)^\s*(?:class|module)\s+([A-Z]\w*)"), ("method", r"(?m)^\s*def\s+(?:self\.)?(\w+[?!]?)")],
    "php": [("class", r"\b(?:class|trait)\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("function", r"\bfunction\s+&?(\w+)\s*\(")],
}
_METHOD = r"(?m)^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*([A-Za-z_$][\w$]*)\s*(?:<[^>(]*>)?\([^()]*\)\s*(?::\s*[^{;=]+)?\{"
FAMILY = {**dict.fromkeys("typescript javascript vue".split(), "ts"), "go": "go", "rust": "rust", **dict.fromkeys("java kotlin csharp dart cpp c".split(), "java"), "ruby": "ruby", "php": "php"}
_KEYWORDS = set("catch do else for function if import new return super switch throw typeof while with await".split())


def _doc(code: Code, at: int) -> str:
    """The comment block directly above a place."""
    above = code.source[:at].rstrip(" \t")
    m = re.search(r"(?s)/\*\*?((?:(?!\*/).)*)\*/\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?\Z|((?:^[ \t]*//[^\n]*\n)+)[ \t]*(?:export\s+)?(?:async\s+)?\Z", above, re.M)
    return re.sub(r"\s+", " ", re.sub(r"(?m)^[ \t]*(?:\*|//)[ \t]?", "", m[1] or m[2])).strip()[:500] if m else ""


def patterns(path: str, source: str, family: str) -> Iterator[tuple]:
    code = Code(source, "ruby" if family == "ruby" else "php" if family == "php" else "c")
    spans: list[tuple[int, int, str, str]] = []
    declared: set[int] = set()  # where declared names stand: no calls
    for kind, pattern in [*_DECLARED[family], *([("method", _METHOD)] if family == "ts" else [])]:
        for m in code.find(pattern):
            group = next(i for i, g in enumerate(m.groups(), 1) if g)
            name = m[group]
            if name in _KEYWORDS:
                continue
            declared.add(m.start(group))
            at, brace = m.start(), code.plain.find("{", m.end() - 1)
            line_end = code.plain.find("\n", m.end())
            end = code.closing(brace) if brace >= 0 and not re.search(r";|\n\s*\n", code.plain[m.end() : brace]) else (line_end if line_end >= 0 else len(source)) - 1
            spans.append((at, max(end, at), name, kind))
    spans.sort()
    exported = {m[1] for m in code.find(r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\s*\*?|class|const|let|var|interface|type|enum)\s+([A-Za-z_$][\w$]*)")}
    for m in code.find(r"\bexport\s*\{([^}]*)\}(?!\s*from)"):
        exported |= {x.split(" as ")[0].strip() for x in m[1].split(",") if x.strip()}
    for at, end, name, kind in spans:
        owner = next((n for a, e, n, k in reversed(spans) if a < at and e >= end and k in ("class", "interface")), None)
        kind = "component" if family == "ts" and kind == "function" and name[:1].isupper() and re.search(r"<[A-Za-z>]", code.plain[at : end + 1]) else kind
        yield _row("symbol", name, kind, owner, signature=head(code.source[at : end + 1]), doc=_doc(code, at), start=code.line(at), end=code.line(end), exported=name in exported or (family != "ts" and name[:1].isupper()))
        if kind in ("class", "interface"):
            line = code.plain[at : code.plain.find("{", at) if "{" in code.plain[at:] else end]
            for word, relation in (("extends", "EXTENDS"), ("implements", "IMPLEMENTS")):
                if m := re.search(rf"\b{word}\s+([\w$.,<> ]+?)(?=\bimplements\b|\bextends\b|$)", line):
                    for t in type_names(m[1]):
                        yield _row("relation", relation, owner=name, target=t, start=code.line(at), end=code.line(at), confidence=CONFIDENCE[relation])
        elif family == "ts" and kind in ("function", "method", "component") and (bracket := code.plain.find("(", at, end + 1)) >= 0:
            stop = code.closing(bracket)
            for a in code.arguments(bracket):
                for t in type_names(code.text(a).partition(":")[2].split("=")[0]):
                    yield _row("relation", "PARAM_TYPE", owner=name, target=t, start=code.line(at), end=code.line(at), confidence=CONFIDENCE["PARAM_TYPE"])
            if m := re.match(r"\s*:\s*([^{=;]+)", code.plain[stop + 1 : stop + 200]):
                for t in type_names(m[1]):
                    yield _row("relation", "RETURN_TYPE", owner=name, target=t, start=code.line(at), end=code.line(at), confidence=CONFIDENCE["RETURN_TYPE"])
    holders = [s for s in spans if s[3] in ("function", "method", "component")]
    for m in code.find(r"(?:\b(new)\s+)?(?:([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\??\.\s*)?\b([A-Za-z_$][\w$]*)\s*\("):
        if m[3] in _KEYWORDS or m.start(3) in declared:
            continue
        owner = next((n for a, e, n, _ in reversed(holders) if a <= m.start() <= e), None)
        value = CONFIDENCE["USES"] if m[1] else CONFIDENCE["METHOD"] if m[2] else CONFIDENCE["CALLS"]
        yield _row("relation", "USES" if m[1] else "CALLS", owner=owner, target=m[3], receiver=m[2], start=code.line(m.start(3)), end=code.line(m.start(3)), confidence=value)
    yield from imports(code, family)


def imports(code: Code, family: str) -> Iterator[tuple]:
    """Imported names: the name used here, the name there (default, * or its own), the module."""
    if family == "ts":
        for m in code.find(r"\b(import|export)\s+(?:type\s+)?([^;\"'`()]*?)\s*\bfrom\s*(?=[\"'])"):
            module, line = code.literal(m.end()), code.line(m.start())
            kind = "import" if m[1] == "import" else "reexport"
            body = m[2]
            for a in re.findall(r"\{([^}]*)\}", body):
                for part in filter(None, (x.strip().removeprefix("type ") for x in a.split(","))):
                    there, _, here = part.partition(" as ")
                    yield _row(kind, (here or there).strip(), there.strip(), None, target=module, start=line, end=line, confidence=CONFIDENCE["IMPORTS"])
            if s := re.search(r"\*(?:\s+as\s+([\w$]+))?", body):
                yield _row(kind, s[1] or "*", "*", None, target=module, start=line, end=line, confidence=0.7 if kind == "reexport" else CONFIDENCE["IMPORTS"])
            if d := re.match(r"([A-Za-z_$][\w$]*)\s*(?:,|$)", re.sub(r"\{[^}]*\}", "", body).strip()):
                yield _row(kind, d[1], "default", None, target=module, start=line, end=line, confidence=CONFIDENCE["IMPORTS"])
        return
    patterns_ = {
        "go": r"(?m)^\s*(?:import\s+)?(?:(\w+)\s+)?(?=\"[^\"\n]*\"\s*$)",
        "java": r"(?m)^\s*(?:import|using)\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;",
        "rust": r"(?m)^\s*(?:pub\s+)?use\s+([^;]+);",
        "php": r"(?m)^\s*use\s+([\w\\]+)(?:\s+as\s+(\w+))?\s*;",
        "ruby": r"(?m)^\s*require(?:_relative)?\s*(?=[\"'])",
    }
    for m in code.find(patterns_[family]):
        line = code.line(m.start())
        if family in ("go", "ruby"):
            module = code.literal(m.end())
            if module:
                yield _row("import", (m[1] if family == "go" and m[1] else module.rsplit("/", 1)[-1]), "module", None, target=module, start=line, end=line, confidence=CONFIDENCE["IMPORTS"])
        elif family == "rust":
            base, _, braces = m[1].partition("{")
            for name in (x.strip() for x in braces.rstrip("} ").split(",")) if braces else [base.rsplit("::", 1)[-1].strip()]:
                if name:
                    yield _row("import", name.split(" as ")[-1], name.split(" as ")[0], None, target=base.rstrip(": ") if braces else base.rsplit("::", 1)[0], start=line, end=line, confidence=CONFIDENCE["IMPORTS"])
        else:
            full = m[1]
            short = re.split(r"[.\\]", full)[-1]
            yield _row("import", short, short, None, target=full, start=line, end=line, confidence=CONFIDENCE["IMPORTS"])


def html(path: str, source: str) -> Iterator[tuple]:
    """Elements with an id."""
    for m in re.finditer(r"<(\w[\w-]*)\b[^>]*?\bid\s*=\s*[\"']([^\"']+)[\"']", source):
        line = source.count("\n", 0, m.start()) + 1
        yield _row("symbol", m[2], "element", None, signature=f"<{m[1]} id>", start=line, end=line)


def read(path: str, language: str, source: str) -> list[tuple]:
    if language == "python":
        return list(python(path, source))
    out = list(html(path, source)) if language in ("html", "vue") else []
    if family := FAMILY.get(language):
        body = "\n".join(m[1] for m in re.finditer(r"(?s)<script\b[^>]*>(.*?)</script>", source)) if language == "vue" else source
        out += list(patterns(path, body, family))
    return out


def extract(files: DataFrame) -> DataFrame:
    """(path, kind, name, type, owner, ...) of files (path, language, content). A file that cannot be parsed gives no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *r) for p, lang, c in zip(frame["path"], frame["language"], frame["content"]) if c for r in read(p, lang, c)]
            yield pd.DataFrame(rows, columns=["path", *COLUMNS])

    kinds = "kind string, name string, type string, owner string, target string, receiver string, signature string, doc string, start_line int, end_line int, confidence double, exported boolean"
    return files.select("path", "language", "content").mapInPandas(run, f"path string, {kinds}")
