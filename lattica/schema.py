"""Canonical tables, vocabularies and edge weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 8


def _struct(spec: str) -> T.StructType:
    kinds = {"l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "s": T.StringType(), "t": T.TimestampType(), "b": T.BooleanType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (x.split(":") for x in spec.split())])


TABLES: dict[str, T.StructType] = {
    "files": _struct("id:l path:s language:s hash:s size:l created_at:t updated_at:t"),
    "symbols": _struct("id:l file_id:l name:s type:s signature:s start_line:i end_line:i doc:s"),
    "relationships": _struct("id:l source_id:l target_id:l relationship_type:s weight:d confidence:d evidence:s"),
    "meta": _struct("key:s value:s"),
    "symbol_index": _struct("symbol_id:l tokens:s"),
    "tasks": _struct("id:l description:s complexity:s created_at:t completed_at:t"),
    "task_context": _struct("task_id:l symbol_id:l score:d reason:s"),
    "task_scope": _struct("task_id:l path:s tier:s"),
    "invocations": _struct("id:l task_id:l command:s timestamp:t"),
    "node_metrics": _struct("node_id:l pagerank:d betweenness:d in_degree:l out_degree:l updated_at:t"),
    "clusters": _struct("node_id:l cluster_id:l cluster_name:s modularity:d updated_at:t"),
    "cycles": _struct("id:l cycle_hash:s length:i nodes_json:s created_at:t"),
    "commits": _struct("sha:s ts:l subject:s body:s author:s"),
    "commit_files": _struct("sha:s path:s status:s old_path:s additions:l deletions:l"),
    "fanin": _struct("node_id:l n:l"),
    "commit_fts": _struct("sha:s subject:s body:s paths:s"),
    "verified_tasks": _struct("id:l task_id:l description:s files_json:s verified_at:t"),
    # what was read from each file, kept so that a scan reads only files that changed
    "extracted": _struct("path:s kind:s name:s type:s owner:s target:s receiver:s signature:s doc:s start_line:i end_line:i confidence:d exported:b"),
    "framework_rows": _struct("path:s framework:s kind:s method:s name:s handler:s line:i"),
    "api_calls": _struct("path:s method:s raw:s line:i api:s dynamic:b"),
    "symbol_coverage": _struct("symbol_id:l file:s name:s start_line:i end_line:i covered:i hits:l covered_lines:l total_lines:l updated_at:t"),
}

KEYS: dict[str, list[str]] = {
    "meta": ["key"], "node_metrics": ["node_id"], "clusters": ["node_id"], "cycles": ["cycle_hash"], "verified_tasks": ["description"],
    "task_scope": ["task_id", "path"], "symbol_coverage": ["symbol_id"], "files": ["path"], "commits": ["sha"], "fanin": ["node_id"],
}

DEFAULTS: dict[str, dict[str, object]] = {
    "symbols": {"signature": "", "start_line": 1, "end_line": 1, "doc": ""},
    "relationships": {"weight": 0.5, "confidence": 1.0, "evidence": "EXTRACTED"},
    "tasks": {"complexity": ""},
    "task_context": {"score": 0.0, "reason": ""},
    "commit_files": {"status": "M"},
}

SYMBOL_TYPES = tuple("class component element export file function import interface method model route type variable".split())
DEFINITIONS = tuple("class component function interface method type".split())

WEIGHTS: dict[str, float] = {
    **dict.fromkeys(("CONTAINS", "MODELS"), 1.0),
    **dict.fromkeys(("EXPORTS", "IMPORTS", "PROVIDES", "ROUTES_TO", "TESTS"), 0.9),
    **dict.fromkeys(("IMPLEMENTS", "PARAM_TYPE", "RETURN_TYPE"), 0.85),
    **dict.fromkeys(("CALLS_API", "EXTENDS", "QUERIES"), 0.8),
    "TYPED_AS": 0.75,
    "CALLS": 0.7,
    **dict.fromkeys(("REFERENCES", "USES"), 0.5),
}


def weight_of(relation: Column) -> Column:
    """The fixed weight of a relation; 0.5 for one outside the vocabulary."""
    table = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, relation), F.lit(0.5))


def evidence_of(relation: Column, confidence: Column, method_call: Column | None = None) -> Column:
    """EXTRACTED, INFERRED or AMBIGUOUS, by relation, confidence and whether the call goes through a receiver."""
    method_call = F.lit(False) if method_call is None else method_call
    return (
        F.when(relation == "CALLS_API", F.when(confidence >= 1, "EXTRACTED").when(confidence >= 0.5, "INFERRED").otherwise("AMBIGUOUS"))
        .when(relation.isin("PARAM_TYPE", "RETURN_TYPE", "TYPED_AS", "IMPLEMENTS"), F.when(confidence >= 0.8, "EXTRACTED").otherwise("INFERRED"))
        .when(method_call, "AMBIGUOUS")
        .when(relation.isin("QUERIES", "ROUTES_TO", "TESTS"), "INFERRED")
        .when(relation.isin("USES", "REFERENCES"), "AMBIGUOUS")
        .otherwise(F.when(confidence >= 1, "EXTRACTED").otherwise("INFERRED"))
    )


def migrate_evidence(edges: DataFrame) -> DataFrame:
    """Evidence of tables written before the vocabulary was settled."""
    relation, old = F.col("relationship_type"), F.col("evidence")
    new = F.when((old == "EXTRACTED") & relation.isin("QUERIES", "ROUTES_TO", "TESTS"), "INFERRED").when((old == "EXTRACTED") & (relation == "CALLS") & (F.col("confidence") < 1), "AMBIGUOUS").otherwise(old)
    return edges.withColumn("evidence", new)


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the columns of ``table``: missing ones get their default, null ones too where there is one."""
    out, defaults = [], DEFAULTS.get(table, {})
    for field in TABLES[table]:
        column = F.col(field.name) if field.name in df.columns else F.lit(None)
        if field.name in defaults:
            column = F.coalesce(column, F.lit(defaults[field.name]))
        out.append(column.cast(field.dataType).alias(field.name))
    return df.select(*out)
