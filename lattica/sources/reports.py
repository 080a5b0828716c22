"""Manifests, coverage and mutation reports, and small configuration files."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def npm(manifests: DataFrame) -> DataFrame:
    """(path, ecosystem, name, version, kind) of package.json files (path, content)."""
    kinds = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    schema = ", ".join(f"{k} map<string,string>" for k in kinds)
    parsed = manifests.select("path", F.from_json("content", schema).alias("j"))
    out = None
    for k in kinds:
        part = parsed.select("path", F.lit("npm").alias("ecosystem"), F.explode(f"j.{k}").alias("name", "version"), F.lit(k).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


def _found(manifests: DataFrame, ecosystem: str, section: str, pattern: str) -> DataFrame:
    """Dependencies named by ``pattern`` (name, then version) on the lines of ``section``."""
    body = F.regexp_extract("content", section, 1) if section else F.col("content")
    lines = manifests.select("path", F.explode(F.split(body, "\r?\n")).alias("line")).where(F.col("line").rlike(pattern))
    return lines.select("path", F.lit(ecosystem).alias("ecosystem"), F.regexp_extract("line", pattern, 1).alias("name"), F.trim(F.regexp_extract("line", pattern, 2)).alias("version"), F.lit("dependencies").alias("kind"))


def requirements(manifests: DataFrame) -> DataFrame:
    return _found(manifests, "python", "", r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*([<>=!~][^#;]*)?(?:[#;].*)?$")


def pyproject(manifests: DataFrame) -> DataFrame:
    listed = manifests.select("path", F.explode(F.regexp_extract_all(F.regexp_extract("content", r"(?s)\bdependencies\s*=\s*\[(.*?)\n?\]", 1), F.lit(r"[\"']([^\"']+)[\"']"), F.lit(1))).alias("d"))
    name = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*(.*)$"
    return listed.select("path", F.lit("python").alias("ecosystem"), F.regexp_extract("d", name, 1).alias("name"), F.regexp_extract("d", name, 2).alias("version"), F.lit("dependencies").alias("kind"))


def gomod(manifests: DataFrame) -> DataFrame:
    return _found(manifests, "go", "", r"^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/[^\s]+)\s+(v[^\s/]+)")


def cargo(manifests: DataFrame) -> DataFrame:
    """Dependencies inside the dependency sections only."""
    return _found(manifests, "rust", r"(?ms)^\[(?:dev-|build-)?dependencies\]\s*\n(.*?)(?=^\[|\z)", r"^([A-Za-z0-9_-]+)\s*=\s*(.+)$")


def dependencies(manifests: DataFrame) -> DataFrame:
    """All manifests (path, content) by their file name."""
    base = F.substring_index("path", "/", -1)
    kinds = (("package\\.json", npm), ("requirements[^/]*\\.txt", requirements), ("pyproject\\.toml", pyproject), ("go\\.mod", gomod), ("Cargo\\.toml", cargo))
    out = None
    for pattern, read in kinds:
        part = read(manifests.where(base.rlike(f"^{pattern}$")))
        out = part if out is None else out.unionByName(part)
    return out


# ---- coverage: every reader gives (file, line, hits)


def lcov(text: str) -> list[tuple[str, int, int]]:
    out, file = [], ""
    for line in text.splitlines():
        if line.startswith("SF:"):
            file = line[3:].strip()
        elif m := re.match(r"DA:(\d+),(\d+)", line):
            out.append((file, int(m[1]), int(m[2])))
    return out


def istanbul(text: str) -> list[tuple[str, int, int]]:
    out = []
    for name, f in json.loads(text).items():
        for key, at in f.get("statementMap", {}).items():
            out += [(f.get("path", name), line, int(f.get("s", {}).get(key, 0))) for line in range(at["start"]["line"], at["end"]["line"] + 1)]
    return out


def cobertura(text: str) -> list[tuple[str, int, int]]:
    out = []
    for name, body in re.findall(r'<class\b[^>]*\bfilename="([^"]+)"[^>]*>(.*?)</class>', text, re.S):
        for tag in re.findall(r"<line\b[^>]*>", body):
            line, hits = re.search(r'\bnumber="(\d+)"', tag), re.search(r'\bhits="(\d+)"', tag)
            if line and hits:
                out.append((name, int(line[1]), int(hits[1])))
    return out


def go_profile(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in re.finditer(r"^(.+?):(\d+)\.\d+,(\d+)\.\d+ \d+ (\d+)$", text, re.M):
        out += [(m[1], line, int(m[4])) for line in range(int(m[2]), int(m[3]) + 1)]
    return out


def v8(text: str, sources: dict[str, str]) -> list[tuple[str, int, int]]:
    """Ranges of character offsets, turned into lines of the ``sources``; inner ranges count over outer ones."""
    out = []
    for entry in json.loads(text).get("result", []):
        name = re.sub(r"^file://", "", entry["url"])
        source = next((v for k, v in sources.items() if name.endswith(k)), None)
        if source is None:
            continue
        starts, at = [], 0
        for line in source.split("\n"):
            starts.append((at, at + len(line)))
            at += len(line) + 1
        hits = [None] * len(starts)
        ranges = sorted((r for f in entry["functions"] for r in f["ranges"]), key=lambda r: r["startOffset"] - r["endOffset"])
        for r in ranges:
            for i, (a, b) in enumerate(starts):
                if a < r["endOffset"] and b > r["startOffset"] and (hits[i] is None or (r["startOffset"] <= a and b <= r["endOffset"])):
                    hits[i] = r["count"]
        out += [(next(k for k in sources if name.endswith(k)), i + 1, h) for i, h in enumerate(hits) if h is not None]
    return out


def coverage(spark: SparkSession, reports: list[tuple[str, str]], sources: dict[str, str] | None = None) -> DataFrame:
    """(file, line, hits) of the first report (kind, text) that holds data, the most hits of each line."""
    readers = {"lcov": lcov, "istanbul": istanbul, "cobertura": cobertura, "go": go_profile, "v8": lambda t: v8(t, sources or {})}
    for kind, text in reports:
        if rows := readers[kind](text):
            return spark.createDataFrame(rows, "file string, line int, hits long").groupBy("file", "line").agg(F.max("hits").alias("hits"))
    return spark.createDataFrame([], "file string, line int, hits long")


def mutants(reports: DataFrame) -> DataFrame:
    """(file, status) of mutation reports (text)."""
    parsed = reports.select(F.from_json("text", "files map<string, struct<mutants: array<struct<status: string>>>>").alias("j"))
    return parsed.select(F.explode("j.files").alias("file", "f")).select("file", F.explode("f.mutants").alias("m")).select("file", F.col("m.status").alias("status"))


# ---- configuration


def key_values(text: str) -> dict[str, str]:
    """``key: value`` lines; comments and quotes go."""
    out = {}
    for line in text.splitlines():
        if m := re.match(r"^\s*([A-Za-z0-9_.-]+)\s*:\s*(.*?)\s*(?:\s#.*)?$", line):
            out[m[1]] = m[2].strip("\"'")
    return out


def glossary(text: str) -> dict[str, list[str]]:
    """``term: [a, b]`` or ``term: a, b`` lines."""
    return {k: [x.strip().strip("\"'").lower() for x in v.strip("[]").split(",") if x.strip()] for k, v in key_values(text).items()}


def patterns(text: str) -> list[str]:
    return [x for x in (line.strip() for line in text.splitlines()) if x and not x.startswith("#")]


def architecture(text: str) -> tuple[dict[str, list[str]], list[tuple[str, str]]]:
    """Layers with their patterns, and the disallowed (from, to) pairs of a rules file."""
    raw = json.loads(text)
    rules = raw.get("disallowed") or raw.get("rules") or []
    return {k: [v] if isinstance(v, str) else list(v) for k, v in raw.get("layers", {}).items()}, [(r["from"], r["to"]) if isinstance(r, dict) else tuple(r) for r in rules]


def jsonc(text: str) -> dict:
    """JSON with comments and trailing commas."""
    plain = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return json.loads(re.sub(r",(\s*[}\]])", r"\1", plain))


def path_candidates(spec: str, importer: str, aliases: dict[str, list[str]] | None = None, workspaces: dict[str, str] | None = None) -> list[str]:
    """Paths an import may mean, most likely first: relative, by alias, by workspace package; sources before build output."""
    import posixpath

    bases: list[str] = []
    if spec.startswith("."):
        bases.append(posixpath.normpath(posixpath.join(posixpath.dirname(importer), spec)))
    for alias, targets in (aliases or {}).items():
        head, star, tail = alias.partition("*")
        if star and spec.startswith(head) and spec.endswith(tail):
            bases += [t.replace("*", spec[len(head) : len(spec) - len(tail) or None], 1).removeprefix("./") for t in targets]
        elif spec == alias:
            bases += [t.removeprefix("./") for t in targets]
    for name, folder in (workspaces or {}).items():
        if spec == name or spec.startswith(name + "/"):
            rest = spec[len(name) :].lstrip("/")
            bases += [posixpath.join(folder, "src", rest or "index"), posixpath.join(folder, rest or "index"), posixpath.join(folder, re.sub(r"^dist/", "src/", rest) or "index")]
    out: list[str] = []
    for b in bases:
        plain = re.sub(r"\.(?:[cm]?js|jsx)$", "", b)
        out += [b, *(plain + e for e in (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs", ".vue", ".py")), *(f"{plain}/index{e}" for e in (".ts", ".tsx", ".js", ".jsx")), f"{plain}/__init__.py"]
    return list(dict.fromkeys(out))
