"""Graphs and findings as text: DOT, GraphML, Mermaid, JSON, a summary page, SARIF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.graph import degrees

NODES, EDGES = 500, 1500


def capped(nodes: DataFrame, edges: DataFrame, node_cap: int = NODES) -> tuple[DataFrame, DataFrame]:
    """The nodes of highest degree, and edges between them: the first 4 x 3 x ``node_cap`` edges by id, filtered, then cut."""
    deg = degrees(nodes.select("id"), edges)
    kept = nodes.join(deg.withColumnRenamed("node_id", "id"), "id").orderBy(F.desc(F.col("in_degree") + F.col("out_degree")), "id").limit(node_cap)
    ids = kept.select("id")
    first = edges.orderBy("id").limit(4 * 3 * node_cap)
    inner = first.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return kept.select(*nodes.columns), inner.orderBy("id").limit(3 * node_cap).select(*edges.columns)


def xml(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def lines(nodes: DataFrame, edges: DataFrame, style: str = "dot") -> DataFrame:
    """(section, place, line) of a graph (id, name; id, source_id, target_id, relationship_type) in one of four styles."""
    q = lambda c: F.replace(F.col(c), F.lit('"'), F.lit("'"))
    node = {
        "dot": F.format_string('  n%d [label="%s"];', "id", q("name")),
        "mermaid": F.format_string('  n%d["%s"]', "id", q("name")),
        "graphml": F.format_string('    <node id="n%d"><data key="name">%s</data></node>', F.col("id"), xml(F.col("name"))),
        "json": F.to_json(F.struct("id", "name")),
    }[style]
    edge = {
        "dot": F.format_string('  n%d -> n%d [label="%s"];', "source_id", "target_id", "relationship_type"),
        "mermaid": F.format_string("  n%d -->|%s| n%d", "source_id", "relationship_type", "target_id"),
        "graphml": F.format_string('    <edge source="n%d" target="n%d"><data key="type">%s</data></edge>', "source_id", "target_id", "relationship_type"),
        "json": F.to_json(F.struct(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relationship_type").alias("type"))),
    }[style]
    return nodes.select(F.lit(1).alias("section"), F.col("id").alias("place"), node.alias("line")).unionByName(edges.select(F.lit(2).alias("section"), F.col("id").alias("place"), edge.alias("line")))


def render(nodes: DataFrame, edges: DataFrame, style: str = "dot", node_cap: int = NODES) -> str:
    """The text of a capped graph."""
    rows = lines(*capped(nodes, edges, node_cap), style).orderBy("section", "place").collect()
    body = [[r["line"] for r in rows if r["section"] == s] for s in (1, 2)]
    if style == "json":
        return '{"nodes": [' + ", ".join(body[0]) + '], "edges": [' + ", ".join(body[1]) + "]}"
    head, tail = {
        "dot": ("digraph g {", "}"),
        "mermaid": ("flowchart LR", ""),
        "graphml": ('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n  <key id="name" for="node" attr.name="name" attr.type="string"/>\n  <key id="type" for="edge" attr.name="type" attr.type="string"/>\n  <graph edgedefault="directed">', "  </graph>\n</graphml>"),
    }[style]
    return "\n".join([head, *body[0], *body[1], *([tail] if tail else [])])


def summary(sections: list[tuple[str, DataFrame]], rows: int = 20, total: int = 160) -> DataFrame:
    """(section, place, line): the first ``rows`` of each titled section (frames with a column ``line``), ``total`` lines at most."""
    out = None
    for n, (title, frame) in enumerate(sections):
        spark = frame.sparkSession
        head = spark.createDataFrame([(n, 0, f"## {title}")], "section int, place int, line string")
        body = frame.orderBy("line").limit(rows).select(F.lit(n).alias("section"), F.row_number().over(Window.orderBy("line")).alias("place"), F.concat(F.lit("- "), F.col("line")).alias("line"))
        part = head.unionByName(body)
        out = part if out is None else out.unionByName(part)
    return out.orderBy("section", "place").limit(total)


def same_but_freshness(old: str, new: str, mark: str = "Updated:") -> bool:
    """Whether two summaries differ only in the line that says when they were made."""
    keep = lambda t: [x for x in t.splitlines() if not x.startswith(mark)]
    return keep(old) == keep(new)


def sarif(findings: DataFrame, tool: str = "lattica") -> DataFrame:
    """(document,): one SARIF 2.1.0 document of findings (rule, level, message, path, line). Findings are a report, bounded by what one reads."""
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.coalesce("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule").alias("ruleId"), F.col("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    rules = F.transform(F.array_sort(F.collect_set("rule")), lambda r: F.struct(r.alias("id")))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), F.array_sort(F.collect_list(F.col("result"))).alias("results"))
    rows = findings.withColumn("result", result)
    return rows.agg(F.to_json(F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))
