"""Routes, models and queries by framework. Each extractor is plain Python over one file; one mapInPandas pass runs them all.

Rows are (kind, method, name, handler, line): kind is route, model, query, component, provider, action or middleware."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lattica.extract.lexer import Code, blank

Row = tuple[str, str | None, str, str | None, int]
VERBS = "delete get head options patch post put".split()
_VERB = "|".join(VERBS)
_NAME = re.compile(r"^[A-Za-z_$][\w$.]*$")


def slash(path: str) -> str:
    return path if path.startswith("/") else f"/{path}"


def _calls(source: str, receivers: str, least: int = 2) -> Iterator[Row]:
    code = Code(source)
    for m in code.find(rf"\b(?:{receivers})\s*\.\s*({_VERB}|all)\s*\("):
        args = code.arguments(m.end() - 1)
        path = code.literal(args[0][0]) if args else None
        if path is None or len(args) < least:
            continue
        last = code.text(args[-1])
        yield "route", m[1].upper(), path, last if _NAME.match(last) else None, code.line(m.start())


def express(path: str, source: str) -> Iterator[Row]:
    yield from _calls(source, r"app|router|\w*[rR]outer")


def fastify(path: str, source: str) -> Iterator[Row]:
    yield from _calls(source, r"fastify|server|app|router|hono|koa")
    code = Code(source)
    for m in code.find(r"\b\w+\s*\.\s*on\s*\("):
        args = code.arguments(m.end() - 1)
        if len(args) >= 3 and (verb := code.literal(args[0][0])) and verb.lower() in VERBS and (route := code.literal(args[1][0])):
            last = code.text(args[-1])
            yield "route", verb.upper(), route, last if _NAME.match(last) else None, code.line(m.start())


def _python(source: str) -> ast.Module | None:
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError):
        return None


def _text(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def fastapi(path: str, source: str) -> Iterator[Row]:
    tree = _python(source)
    for node in ast.walk(tree) if tree else ():
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for d in node.decorator_list:
                if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in VERBS and d.args and (route := _text(d.args[0])) is not None:
                    yield "route", d.func.attr.upper(), route, node.name, d.lineno


def sqlalchemy(path: str, source: str) -> Iterator[Row]:
    tree = _python(source)
    for node in ast.walk(tree) if tree else ():
        if isinstance(node, ast.ClassDef):
            table = next((_text(s.value) for s in node.body if isinstance(s, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__tablename__" for t in s.targets)), None)
            if table:
                yield "model", None, node.name, table, node.lineno
        elif isinstance(node, ast.Call) and node.args and isinstance(node.args[0], ast.Name):
            name = node.func.attr if isinstance(node.func, ast.Attribute) else node.func.id if isinstance(node.func, ast.Name) else ""
            if (name == "query" and isinstance(node.func, ast.Attribute)) or name in ("select", "insert", "update", "delete"):
                yield "query", name, node.args[0].id, None, node.lineno


def django(path: str, source: str) -> Iterator[Row]:
    tree = _python(source)
    for node in ast.walk(tree) if tree else ():
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in ("path", "re_path", "url") and node.args and (route := _text(node.args[0])) is not None:
            yield "route", None, slash(route.lstrip("^").rstrip("$")) if node.func.id != "path" else slash(route), ast.unparse(node.args[1]) if len(node.args) > 1 else None, node.lineno
        elif isinstance(node, ast.ClassDef) and any(ast.unparse(b) in ("models.Model", "Model") for b in node.bases):
            yield "model", None, node.name, None, node.lineno


def nestjs(path: str, source: str) -> Iterator[Row]:
    code = Code(source)
    classes = [(m.start(), m[1]) for m in code.find(r"\bclass\s+(\w+)")]
    for m in code.find(r"@Injectable\s*\("):
        if after := next((n for at, n in classes if at > m.start()), None):
            yield "provider", None, after, None, code.line(m.start())
    for m in code.find(r"@Controller\s*\("):
        args = code.arguments(m.end() - 1)
        prefix = (code.literal(args[0][0]) or "") if args else ""
        begin = next((at for at, _ in classes if at > m.start()), m.end())
        stop = next((at for at, _ in classes if at > begin), len(source))
        for v in re.finditer(r"@(Get|Post|Put|Patch|Delete|Head|Options|All)\s*\(", code.plain[begin:stop]):
            at = begin + v.end() - 1
            inner = code.arguments(at)
            sub = (code.literal(inner[0][0]) or "") if inner else ""
            method = re.search(r"(?:@\w+\s*\([^)]*\)\s*)*(?:(?:public|private|protected|async|static)\s+)*(\w+)\s*\(", code.plain[code.closing(at) + 1 : stop])
            yield "route", "ANY" if v[1] == "All" else v[1].upper(), slash("/".join(x.strip("/") for x in (prefix, sub) if x.strip("/"))), method[1] if method else None, code.line(begin + v.start())


def prisma(path: str, source: str) -> Iterator[Row]:
    for m in re.finditer(r"(?m)^[ \t]*model[ \t]+(\w+)[ \t]*\{", source):
        yield "model", None, m[1], None, source.count("\n", 0, m.start()) + 1


def prisma_queries(path: str, source: str) -> Iterator[Row]:
    code = Code(source)
    for m in code.find(r"\bprisma\s*\.\s*(\w+)\s*\.\s*((?:find|create|update|delete|upsert|count|aggregate|groupBy)\w*)\s*\("):
        yield "query", m[2], m[1], None, code.line(m.start())


def drizzle(path: str, source: str) -> Iterator[Row]:
    code = Code(source)
    for m in code.find(r"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:pg|mysql|sqlite)Table\s*\("):
        args = code.arguments(m.end() - 1)
        if args and (table := code.literal(args[0][0])):
            yield "model", None, m[1], table, code.line(m.start())
    for m in code.find(r"\bdb\s*\.\s*query\s*\.\s*(\w+)\s*\.\s*find\w+\s*\(|\bdb\s*\.\s*select(?:Distinct)?\s*\([^()]*\)\s*\.\s*from\s*\(\s*(\w+)|\bdb\s*\.\s*(?:insert|update|delete)\s*\(\s*(\w+)"):
        yield "query", None, m[1] or m[2] or m[3], None, code.line(m.start())


def vue_name(path: str) -> str:
    base = re.sub(r"\.vue$", "", path.rsplit("/", 1)[-1])
    return "".join(x[:1].upper() + x[1:] for x in re.split(r"[-_]", base))


def vue_tags(source: str) -> list[str]:
    """Component-like tags of the template: Pascal case, or with a dash."""
    body = re.search(r"(?s)<template\b[^>]*>(.*)</template>", source)
    plain = re.sub(r"\"[^\"]*\"|'[^']*'|(?s:<!--.*?-->)", "", body[1]) if body else ""
    return list(dict.fromkeys(t for t in re.findall(r"<([A-Za-z][\w-]*)", plain) if t[0].isupper() or "-" in t))


def vue_imports(source: str) -> list[tuple[str, str, int]]:
    """(name, module, line) of default imports of components in the script."""
    out = []
    for script in re.finditer(r"(?s)<script\b[^>]*>(.*?)</script>", source):
        code, base = Code(script[1]), source.count("\n", 0, script.start(1))
        for m in code.find(r"(?m)^\s*import\s+(\w+)\s+from\s*(?=[\"'])"):
            target = code.literal(m.end())
            if target and target.endswith(".vue"):
                out.append((m[1], target, base + code.line(m.start(1))))
    return out


def vue(path: str, source: str) -> Iterator[Row]:
    yield "component", None, vue_name(path), None, 1
    tags = {t.replace("-", "").lower() for t in vue_tags(source)}
    for name, module, line in vue_imports(source):
        if name.lower() in tags:
            yield "component_use", None, name, module, line


_RESOURCE = (("GET", "", "index"), ("GET", "/new", "new"), ("POST", "", "create"), ("GET", "/:id", "show"), ("GET", "/:id/edit", "edit"), ("PATCH", "/:id", "update"), ("DELETE", "/:id", "destroy"))


def rails(path: str, source: str) -> Iterator[Row]:
    for n, line in enumerate(source.split("\n"), 1):
        text = line.strip()
        if text.startswith("#"):
            continue
        if m := re.match(r"root\s*(?:\(?\s*(?:to:|:to\s*=>)?)\s*[\"']([^\"']+)", text):
            yield "route", "GET", "/", m[1], n
        elif m := re.match(rf"({_VERB})\s*\(?\s*[\"']([^\"']+)[\"']\s*(?:,\s*(?:to:|:to\s*=>)|=>)\s*[\"']([^\"']+)", text):
            yield "route", m[1].upper(), slash(m[2]), m[3], n
        elif m := re.match(r"resources\s+:(\w+)", text):
            for verb, tail, action in _RESOURCE:
                yield "route", verb, f"/{m[1]}{tail}", f"{m[1]}#{action}", n


def laravel(path: str, source: str) -> Iterator[Row]:
    code = Code(source, "php")
    for m in code.find(rf"\bRoute::({_VERB}|any|match)\s*\("):
        args = code.arguments(m.end() - 1)
        if m[1] == "match":
            args = args[1:]
        route = code.literal(args[0][0]) if args else None
        if route is None:
            continue
        rest = code.text(args[1]) if len(args) > 1 else ""
        pair, named, ident = re.match(r"\[\s*[\w\\]+::class\s*,\s*[\"'](\w+)[\"']\s*\]", rest), re.match(r"[\"']([\w\\@]+)[\"']$", rest), re.match(r"(\w+)(?:::class)?$", rest)
        handler = pair[1] if pair else named[1].split("@")[-1] if named else ident[1] if ident else None
        yield "route", "ANY" if m[1] in ("any", "match") else m[1].upper(), slash(route), handler, code.line(m.start())


def spring(path: str, source: str) -> Iterator[Row]:
    code = Code(source)
    first = next((m.start() for m in code.find(r"\bclass\s+\w+")), -1)

    def mapped(at: int) -> str:
        for span in code.arguments(at):
            inner = code.plain[span[0] : span[1]]
            if m := re.match(r"(?:(?:value|path)\s*=\s*)?\{?\s*(?=[\"])", inner):
                return code.literal(span[0] + m.end()) or ""
        return ""

    prefix = ""
    for m in code.find(r"@(Get|Post|Put|Delete|Patch|Request)Mapping\b\s*(\()?"):
        sub = mapped(m.end() - 1) if m[2] else ""
        if m.start() < first:
            prefix = sub if m[1] == "Request" else prefix
            continue
        end = code.closing(m.end() - 1) + 1 if m[2] else m.end()
        method = re.search(r"\b(?:public|private|protected|static|final|fun|suspend)\s+(?:[\w<>\[\].,? ]+\s+)?(\w+)\s*\(", code.plain[end : end + 800])
        whole = slash("/".join(x.strip("/") for x in (prefix, sub) if x.strip("/")))
        yield "route", "ANY" if m[1] == "Request" else m[1].upper(), whole, method[1] if method else None, code.line(m.start())


def golang(path: str, source: str) -> Iterator[Row]:
    code, seen = Code(source), set()
    for m in code.find(r"\.\s*(HandleFunc|Handle|GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|Get|Post|Put|Patch|Delete|Head|Options)\s*\("):
        args = code.arguments(m.end() - 1)
        route = code.literal(args[0][0]) if args else None
        if route is None or len(args) < 2:
            continue
        method, route = ("GET", route) if m[1].startswith("Handle") else (m[1].upper(), route)
        if " " in route:
            method, route = route.split(" ", 1)
        if route.startswith("/") and (method, route) not in seen:
            seen.add((method, route))
            last = code.text(args[-1])
            yield "route", method, route, last if _NAME.match(last) else None, code.line(m.start())


def app_route(path: str) -> tuple[str, str] | None:
    """(PAGE or API, URL) of a file of the app directory: groups and slots go, intercepting marks go."""
    p = path.removeprefix("src/")
    if not p.startswith("app/"):
        return None
    *folders, name = p[4:].split("/")
    parts = [x for x in (re.sub(r"^\(\.+\)", "", f) for f in folders if not re.match(r"^\([^.].*\)$|^@", f)) if x]
    kind = "PAGE" if re.match(r"page\.(?:[jt]sx?|mdx?)$", name) else "API" if re.match(r"route\.[jt]s$", name) else None
    return (kind, "/" + "/".join(parts)) if kind else None


def pages_route(path: str) -> tuple[str, str] | None:
    """(PAGE or API, URL) of a file of the pages directory."""
    p = path.removeprefix("src/")
    m = re.match(r"pages/(.+)\.(?:[jt]sx?|mdx?)$", p)
    if not m or m[1].startswith(("_", "api/_")):
        return None
    return ("API", f"/{m[1]}") if m[1].startswith("api/") else ("PAGE", "/" + re.sub(r"(^|/)index$", "", m[1]))


def server_actions(source: str) -> bool:
    """Whether the file or a function body starts with the directive."""
    plain = blank(source)
    return any(source[m.start(1) + 1 :].startswith("use server") for m in re.finditer(r"(?:\A|\{)\s*([\"'])", plain))


def nextjs(path: str, source: str) -> Iterator[Row]:
    if re.search(r"(^|/)middleware\.[jt]s$", path):
        yield "middleware", None, path, None, 1
    if server_actions(source):
        yield "action", None, path, None, 1
    found = app_route(path) or pages_route(path)
    if found and found[0] == "PAGE":
        yield "route", "PAGE", found[1], None, 1
    elif found and path.removeprefix("src/").startswith("pages/"):
        yield "route", "API", found[1], None, 1
    elif found:
        code = Code(source)
        for m in code.find(rf"(?m)^export\s+(?:async\s+)?function\s+({_VERB.upper()})\s*\("):
            yield "route", m[1], found[1], m[1], code.line(m.start())


#: In this order; a file may be read by several. (languages or a path pattern, extractor)
REGISTRY: dict[str, tuple[str, Callable[[str, str], Iterator[Row]]]] = {
    "nextjs": (r"\.[cm]?[jt]sx?$", nextjs),
    "prisma": (r"\.prisma$", prisma),
    "prisma_queries": (r"\.[cm]?[jt]sx?$", prisma_queries),
    "drizzle": (r"\.[cm]?[jt]sx?$", drizzle),
    "sqlalchemy": (r"\.py$", sqlalchemy),
    "express": (r"\.[cm]?[jt]sx?$", express),
    "fastify": (r"\.[cm]?[jt]sx?$", fastify),
    "fastapi": (r"\.py$", fastapi),
    "nestjs": (r"\.ts$", nestjs),
    "django": (r"\.py$", django),
    "vue": (r"\.vue$", vue),
    "rails": (r"\.rb$", rails),
    "laravel": (r"\.php$", laravel),
    "spring": (r"\.(?:java|kt)$", spring),
    "golang": (r"\.go$", golang),
}

#: What must be named somewhere in the repository's manifests for a framework to be looked for.
SIGNS = {"express": "express", "fastify": "fastify|koa|hono", "nextjs": "next", "nestjs": "@nestjs", "drizzle": "drizzle", "prisma": "prisma", "prisma_queries": "prisma", "fastapi": "fastapi|flask|starlette", "sqlalchemy": "(?i)sqlalchemy", "django": "(?i)django", "vue": "vue", "rails": "rails", "laravel": "laravel", "spring": "spring", "golang": "."}


def detect(manifests: list[str]) -> list[str]:
    """Frameworks whose sign appears in one of the manifests' texts."""
    return [name for name in REGISTRY if any(re.search(SIGNS[name], t) for t in manifests)]


def extract(files: DataFrame, frameworks: list[str] | None = None) -> DataFrame:
    """(path, framework, kind, method, name, handler, line) of files (path, content): one pass, whatever the number of frameworks."""
    chosen = list(REGISTRY) if frameworks is None else frameworks

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                for name in chosen:
                    pattern, reader = REGISTRY[name]
                    if content and re.search(pattern, path):
                        rows += [(path, name, *r) for r in reader(path, content)]
            yield pd.DataFrame(rows, columns=["path", "framework", "kind", "method", "name", "handler", "line"])

    return files.select("path", "content").mapInPandas(run, "path string, framework string, kind string, method string, name string, handler string, line int")
