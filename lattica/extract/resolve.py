"""From extracted rows to edges: imports to files, names to symbols, calls through an ordered cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.paths import dirname, normalize, top_dir
from lattica.schema import evidence_of, weight_of

_ENDS = (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs", ".vue", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def import_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(path, name, there, kind, target_path): imports and re-exports (rows of the extractor) and the file each means, the first candidate that exists."""
    i = rows.where(F.col("kind").isin("import", "reexport")).select("path", "kind", "name", F.col("type").alias("there"), "target")
    relative = F.col("target").startswith(".")
    py = F.col("path").endswith(".py")
    up = F.regexp_extract("target", r"^(\.+)", 1)
    dots = F.regexp_replace(F.regexp_replace(F.col("target"), r"^\.+", ""), r"\.", "/")
    back = F.repeat(F.lit("../"), F.greatest(F.length(up) - 1, F.lit(0)))
    base = F.when(py & relative, F.concat(dirname(F.col("path")), F.lit("/"), back, dots)).when(py, dots).when(relative, F.concat(dirname(F.col("path")), F.lit("/"), F.regexp_replace("target", r"\.(?:[cm]?js|jsx)$", ""))).otherwise(F.regexp_replace("target", r"^(@|~)/", "src/"))
    clean = normalize(base)
    python = F.array(F.concat(clean, F.lit(".py")), F.concat(clean, F.lit("/__init__.py")), F.concat(clean, F.lit("/"), F.col("there"), F.lit(".py")), F.concat(F.lit("src/"), clean, F.lit(".py")))
    other = F.array(clean, *[F.concat(clean, F.lit(e)) for e in _ENDS])
    tried = i.withColumn("candidates", F.when(py, python).otherwise(other)).select("path", "kind", "name", "there", F.posexplode("candidates").alias("pos", "candidate"))
    found = tried.join(files.select(F.col("path").alias("candidate")), "candidate")
    return found.groupBy("path", "kind", "name", "there").agg(F.min_by("candidate", "pos").alias("target_path"))


def through(imports: DataFrame, hops: int = 3) -> DataFrame:
    """Imports followed through re-exports, up to ``hops``: by name, or through a star."""
    out = imports.where("kind = 'import'").select("path", "name", "there", "target_path")
    again = imports.where("kind = 'reexport'").select(F.col("path").alias("via"), F.col("name").alias("out"), F.col("there").alias("inner"), F.col("target_path").alias("next"))
    for _ in range(hops):
        step = out.join(again, (F.col("target_path") == F.col("via")) & ((F.col("there") == F.col("out")) | (F.col("out") == "*")), "left")
        chosen = step.groupBy("path", "name", "there", "target_path").agg(F.min_by(F.struct(F.when(F.col("out") == "*", F.col("there")).otherwise(F.col("inner")).alias("there"), "next"), F.struct(F.when(F.col("out") == "*", 1).otherwise(0), "next")).alias("s"))
        out = chosen.select("path", "name", F.when(F.col("s.next").isNotNull(), F.col("s.there")).otherwise(F.col("there")).alias("there"), F.coalesce("s.next", "target_path").alias("target_path")).distinct()
    return out


def calls(rows: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, owner, line, target_path, target, confidence, evidence): what each call means, the first level that finds something.

    Levels: a method of the receiver's class or its parent; this or self; an imported receiver; the same file; a named import; any
    imported file; anywhere, for method calls. All levels are joined and the lowest kept, in place of lookups one after another.
    ``symbols`` are extractor rows of kind symbol."""
    site = rows.where("kind = 'relation' and name in ('CALLS', 'USES')").select("path", "owner", F.col("start_line").alias("line"), F.col("target").alias("called"), "receiver", F.col("name").alias("relation"))
    s = symbols.where("kind = 'symbol'").select(F.col("path").alias("target_path"), F.col("name").alias("target"), "type", F.col("owner").alias("class"))
    named = site.withColumn("root", F.substring_index("receiver", ".", 1))
    by_name = named.join(s, F.col("called") == F.col("target"))
    own, plain = F.col("target_path") == F.col("path"), F.col("receiver").isNull()
    imported = imports.select(F.col("path").alias("ip"), F.col("name").alias("iname"), F.col("there"), F.col("target_path").alias("ifile"))
    parents = rows.where("kind = 'relation' and name in ('EXTENDS', 'IMPLEMENTS')").select(F.col("owner").alias("child"), F.col("target").alias("parent")).distinct()
    found = []

    def level(df: DataFrame, n: int, confidence: float, evidence: str) -> None:
        found.append(df.select("path", "owner", "line", "called", "receiver", "relation", "target_path", "target", F.lit(n).alias("level"), F.lit(confidence).alias("confidence"), F.lit(evidence).alias("evidence")))

    holder = symbols.where("kind = 'symbol' and type = 'method'").select(F.col("path").alias("hp"), F.col("name").alias("hn"), F.col("owner").alias("hc")).distinct()
    level(by_name.where(F.col("root") == F.col("class")), 0, 0.95, "EXTRACTED")
    within = by_name.where(F.col("receiver").isin("this", "self", "super", "super()")).join(holder, (F.col("path") == F.col("hp")) & (F.col("owner") == F.col("hn")))
    level(within.where((F.col("class") == F.col("hc")) & own), 1, 1.0, "EXTRACTED")
    level(within.join(parents, (F.col("hc") == F.col("child")) & (F.col("class") == F.col("parent"))), 2, 0.9, "EXTRACTED")
    via = by_name.join(imported, (F.col("path") == F.col("ip")) & (F.col("target_path") == F.col("ifile")))
    level(via.where(F.col("root") == F.col("iname")), 3, 0.95, "EXTRACTED")
    level(by_name.where(own & plain), 4, 1.0, "EXTRACTED")
    alias = named.where(plain).join(imported, (F.col("path") == F.col("ip")) & (F.col("called") == F.col("iname"))).join(s, (F.col("ifile") == F.col("target_path")) & ((F.col("there") == F.col("target")) | ((F.col("there") == "default") & (F.col("called") == F.col("target")))))
    level(alias, 5, 0.95, "EXTRACTED")
    level(via.where(plain), 6, 0.7, "INFERRED")
    level(by_name.where(~plain & F.col("type").isin("method", "component")), 7, 0.3, "AMBIGUOUS")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    every = every.where(~((F.col("path") == F.col("target_path")) & F.col("owner").eqNullSafe(F.col("target"))))
    near = F.when(dirname(F.col("path")) == dirname(F.col("target_path")), 0).when(top_dir(F.col("path")) == top_dir(F.col("target_path")), 1).otherwise(2)
    best = every.groupBy("path", "owner", "line", "called", "receiver", "relation").agg(F.min_by(F.struct("target_path", "target", "confidence", "evidence"), F.struct("level", near, "target_path")).alias("b"))
    return best.select("path", "owner", "line", "relation", "b.target_path", "b.target", "b.confidence", "b.evidence")


def others(rows: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, owner, line, relation, target_path, target, confidence, evidence) of type relations and references: import, same file, imported files, anywhere (references never)."""
    site = rows.where("kind = 'relation' and name not in ('CALLS', 'USES')").select("path", "owner", F.col("start_line").alias("line"), F.col("name").alias("relation"), F.col("target").alias("named"), "confidence")
    s = symbols.where("kind = 'symbol'").select(F.col("path").alias("target_path"), F.col("name").alias("target"), "type")
    hit = site.join(s, F.col("named") == F.col("target")).join(imports.select(F.col("path").alias("ip"), F.col("name").alias("iname"), F.col("target_path").alias("ifile")).distinct(), (F.col("path") == F.col("ip")) & (F.col("target_path") == F.col("ifile")), "left")
    level = F.when(F.col("iname") == F.col("named"), 0).when(F.col("target_path") == F.col("path"), 1).when(F.col("iname").isNotNull(), 2).when(F.col("relation") != "REFERENCES", 3)
    best = hit.withColumn("level", level).where("level is not null").groupBy("path", "owner", "line", "relation", "named", "confidence").agg(F.min_by(F.struct("target_path", "target"), F.struct("level", "target_path")).alias("b"))
    return best.select("path", "owner", "line", "relation", "b.target_path", "b.target", "confidence", evidence_of(F.col("relation"), F.col("confidence")).alias("evidence"))


def edges(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(source_path, source, target_path, target, relationship_type, weight, confidence, evidence): all edges of extracted rows.

    A null source or target is the file itself."""
    symbols = rows.where("kind = 'symbol'")
    found = import_files(rows, files)
    resolved = through(found)
    nothing = F.lit(None).cast("string")
    linked = calls(rows, symbols, resolved).unionByName(others(rows, symbols, resolved)).select(F.col("path").alias("source_path"), F.col("owner").alias("source"), "target_path", "target", F.col("relation").alias("relationship_type"), "confidence", "evidence")
    imports = found.select(F.col("path").alias("source_path"), nothing.alias("source"), "target_path", nothing.alias("target"), F.lit("IMPORTS").alias("relationship_type"), F.lit(0.9).alias("confidence"), F.lit("EXTRACTED").alias("evidence")).distinct()
    contains = symbols.select(F.col("path").alias("source_path"), F.col("owner").alias("source"), F.col("path").alias("target_path"), F.col("name").alias("target"), F.lit("CONTAINS").alias("relationship_type"), F.lit(1.0).alias("confidence"), F.lit("EXTRACTED").alias("evidence"))
    exports = symbols.where("exported and owner is null").select(F.col("path").alias("source_path"), nothing.alias("source"), F.col("path").alias("target_path"), F.col("name").alias("target"), F.lit("EXPORTS").alias("relationship_type"), F.lit(1.0).alias("confidence"), F.lit("EXTRACTED").alias("evidence"))
    every = linked.unionByName(imports).unionByName(contains).unionByName(exports).distinct()
    return every.withColumn("weight", weight_of(F.col("relationship_type")))
