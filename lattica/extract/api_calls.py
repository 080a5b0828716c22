"""Calls of HTTP clients: fetch, axios, ky and instances made from them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.extract.lexer import Code
from lattica.functions.paths import api_path, has_dynamic_marker

_VERBS = "delete|get|head|options|patch|post|put"


def calls(source: str) -> Iterator[tuple[str, str, int]]:
    """(method, raw URL, line): calls whose first argument is a literal or a template."""
    code = Code(source)
    made = [m[1] for m in code.find(r"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:axios\s*\.\s*create|ky\s*\.\s*(?:create|extend)|\$fetch\s*\.\s*create)\s*\(")]
    clients = "|".join(["axios", "ky", "api", "http", "client", *map(re.escape, made)])
    for m in code.find(rf"(?<![\w.$])(?:(\$?fetch|axios|ky)|(?:{clients})\s*\.\s*({_VERBS}))\s*\("):
        args = code.arguments(m.end() - 1)
        raw = code.literal(args[0][0]) if args else None
        if not raw or not re.match(r"/|https?://|\$\{|[\w-]+/", raw):
            continue
        method = (m[2] or "GET").upper()
        if m[1] and len(args) > 1 and (o := re.search(r"\bmethod\s*:\s*[\"'`](\w+)", code.text(args[1]))):
            method = o[1].upper()
        yield method, raw, code.line(m.start())


def extract(files: DataFrame) -> DataFrame:
    """(path, method, raw, line, api, dynamic) of files (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *r) for p, c in zip(frame["path"], frame["content"]) if c for r in calls(c)]
            yield pd.DataFrame(rows, columns=["path", "method", "raw", "line"])

    code = files.where(F.col("path").rlike(r"\.([cm]?[jt]sx?|vue)$")).select("path", "content")
    found = code.mapInPandas(run, "path string, method string, raw string, line int")
    return found.withColumn("api", api_path(F.col("raw"))).withColumn("dynamic", has_dynamic_marker(F.col("raw"))).where("api is not null")


def confidence(matches: DataFrame, cap: int = 3) -> DataFrame:
    """Matches (call_id, route_id, dynamic) with confidence and evidence: one literal route is sure, a template less so, several are ambiguous and ``cap`` at most."""
    from pyspark.sql import Window

    w = Window.partitionBy("call_id")
    rows = matches.withColumn("n", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy("route_id"))).where(F.col("k") <= cap)
    value = F.when(F.col("n") > 1, 0.4).when(F.col("dynamic"), 0.7).otherwise(1.0)
    evidence = F.when(F.col("n") > 1, "AMBIGUOUS").when(F.col("dynamic"), "INFERRED").otherwise("EXTRACTED")
    return rows.select("call_id", "route_id", value.alias("confidence"), evidence.alias("evidence"))
