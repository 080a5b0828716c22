"""What a user asks of an index as a whole: scan, context, impact, path, status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.extract import api_calls, frameworks, resolve, syntax
from lattica.functions.paths import api_path, is_protected
from lattica.index import Index, graph_fingerprint
from lattica.operators import fts, graph, health, history, impact, retrieval
from lattica.scratch import cut
from lattica.sources.scan import changes, stable_ids

_SYMBOL_KINDS = ("route", "model", "component")


def _read_again(kept: DataFrame, clean: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of unchanged files as they were, rows of the others as just read."""
    return cut(kept.join(clean, "path", "left_semi").unionByName(new.select(*kept.columns)), "extracted")


def _numbered(old: DataFrame, new: DataFrame, file: str, kind: str, name: str, line: str) -> DataFrame:
    """``new`` with stable ids: rows are told apart by (file, kind, name) and their order."""
    as_key = lambda df: df.withColumns({"file": F.col(file).cast("string"), "type": F.col(kind), "name": F.col(name).cast("string"), "start_line": F.col(line)})
    return stable_ids(as_key(old), as_key(new))


def scan(index: Index, listing: DataFrame, known_frameworks: list[str] | None = None) -> tuple[Index, DataFrame]:
    """The index after a scan of ``listing`` (path, language, hash, size, content), and (status, n) of its files.

    Files are compared by hash; only those inserted or updated are parsed, in Arrow batches. Ids of files, symbols and
    relationships stay as they were; what belonged to removed files goes. Edges are resolved anew by joins, as a change of
    one file can change what calls in others mean."""
    status = cut(changes(index.files.select("path", "hash"), listing.select("path", "language", "hash", "size")), "status")
    clean = status.where("status = 'unchanged'").select("path")
    dirty = listing.join(status.where("status in ('inserted', 'updated')").select("path"), "path", "left_semi")
    now = status.where("status <> 'removed'").select("path", "language", "hash", "size")

    rows = _read_again(index.extracted, clean, syntax.extract(dirty))
    found = _read_again(index.framework_rows, clean, frameworks.extract(dirty, known_frameworks))
    client = _read_again(index.api_calls, clean, api_calls.extract(dirty))

    files = _numbered(index.files.withColumns({"__kind": F.lit("file"), "__line": F.lit(1)}), now.withColumns({"__kind": F.lit("file"), "__line": F.lit(1)}), "path", "__kind", "path", "__line")
    files = cut(files.select("id", "path", "language", "hash", "size"), "files")

    route = F.when(F.col("kind") == "route", F.concat_ws(" ", "method", "name")).otherwise(F.col("name"))
    extra = found.where(F.col("kind").isin(*_SYMBOL_KINDS)).select("path", route.alias("name"), F.col("kind").alias("type"), F.lit("").alias("signature"), F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.lit("").alias("doc")).dropDuplicates(["path", "type", "name"])
    own = rows.where("kind = 'symbol'").select("path", "name", "type", "signature", "start_line", "end_line", "doc")
    itself = now.select("path", F.col("path").alias("name"), F.lit("file").alias("type"), F.lit("").alias("signature"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("").alias("doc"))
    before = index.symbols.join(index.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    made = _numbered(before, own.unionByName(extra).unionByName(itself), "path", "type", "name", "start_line")
    symbols = cut(made.join(files.select("path", F.col("id").alias("file_id")), "path").select("id", "file_id", "path", "name", "type", "signature", "start_line", "end_line", "doc"), "symbols")

    edges = cut(_edges(rows, found, client, files, symbols), "edges")
    same = {"__from": F.col("source_id"), "__to": F.col("target_id"), "__line": F.lit(1)}
    numbered = _numbered(index.relationships.withColumns(same), edges.withColumns(same), "__from", "relationship_type", "__to", "__line")
    relationships = cut(numbered.select("id", "source_id", "target_id", "relationship_type", "weight", "confidence", "evidence"), "relationships")

    tokens = fts.symbol_tokens(symbols.drop("path"), files).select("symbol_id", F.array_join("tokens", " ").alias("tokens"))
    fingerprint = graph_fingerprint(symbols, relationships)
    meta = index.spark.createDataFrame([("graph_fingerprint", fingerprint)], "key string, value string")
    out = index.with_tables(files=files, symbols=symbols, relationships=relationships, extracted=rows, framework_rows=found, api_calls=client, symbol_index=tokens, fanin=graph.fan_in(relationships)).put("meta", meta)
    return out.cleaned(), status.groupBy("status").agg(F.count("*").alias("n"))


def _edges(rows: DataFrame, found: DataFrame, client: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source_id, target_id, relationship_type, weight, confidence, evidence), each pair and type once, the surest first."""
    ids = symbols.groupBy(F.col("path").alias("at"), F.col("name").alias("named")).agg(F.min_by("id", F.struct(F.when(F.col("type").isin("import", "export"), 1).otherwise(0), "start_line", "id")).alias("id"))
    text = resolve.edges(rows, files.select("path")).select("source_path", F.coalesce("source", "source_path").alias("source"), "target_path", F.coalesce("target", "target_path").alias("target"), "relationship_type", "weight", "confidence", "evidence")

    label = F.when(F.col("kind") == "route", F.concat_ws(" ", "method", "name")).otherwise(F.col("name"))
    shown = found.where(F.col("kind").isin(*_SYMBOL_KINDS)).withColumn("label", label)
    fixed = lambda df, source, target, relation, weight, confidence, evidence: df.select(F.col("path").alias("source_path"), F.col(source).alias("source"), F.col("path").alias("target_path"), F.col(target).alias("target"), F.lit(relation).alias("relationship_type"), F.lit(weight).alias("weight"), F.lit(confidence).alias("confidence"), F.lit(evidence).alias("evidence"))
    text = text.unionByName(fixed(shown, "path", "label", "CONTAINS", 1.0, 1.0, "EXTRACTED"))
    handled = shown.where("kind = 'route' and handler is not null").withColumn("handler", F.element_at(F.split("handler", r"\."), -1))
    text = text.unionByName(fixed(handled, "handler", "label", "ROUTES_TO", 0.9, 1.0, "INFERRED"))
    tests = health.link_tests(files).select("source_path", F.col("source_path").alias("source"), "target_path", F.col("target_path").alias("target"), F.lit("TESTS").alias("relationship_type"), F.lit(0.9).alias("weight"), F.lit(1.0).alias("confidence"), F.lit("INFERRED").alias("evidence"))
    text = text.unionByName(tests)
    source, target = (ids.select(F.col("at").alias(f"{x}_path"), F.col("named").alias(x), F.col("id").alias(f"{x}_id")) for x in ("source", "target"))
    linked = text.join(source, ["source_path", "source"]).join(target, ["target_path", "target"]).select("source_id", "target_id", "relationship_type", "weight", "confidence", "evidence")

    # a client's call belongs to the function around it, else to its file
    routes = shown.where("kind = 'route'").select("path", "label", F.col("method"), api_path(F.col("name")).alias("api")).where("api is not null").dropDuplicates(["path", "label"])
    served = routes.join(ids, (F.col("path") == F.col("at")) & (F.col("label") == F.col("named"))).select(F.col("id").alias("route_id"), F.when(F.col("method") != "ANY", F.col("method")).alias("method"), F.col("api").alias("path"))
    sites = cut(client.join(files.select("path", F.col("id").alias("file_id")), "path").withColumn("call_id", F.monotonically_increasing_id()), "sites")
    matches = health.match_routes(served, sites.select("call_id", "method", F.col("api").alias("path"))).join(sites.select("call_id", "dynamic"), "call_id")
    sure = api_calls.confidence(matches)
    around = health.enclosing(sites.select(F.col("call_id").alias("site_id"), "file_id", "line"), symbols.where(F.col("type").isin("function", "method", "component")).select("id", "file_id", "start_line"))
    file_symbol = symbols.where("type = 'file'").select("file_id", F.col("id").alias("file_symbol"))
    caller = sites.join(file_symbol, "file_id").join(around.withColumnRenamed("site_id", "call_id"), "call_id", "left").select("call_id", F.coalesce("symbol_id", "file_symbol").alias("source_id"))
    api = sure.join(caller, "call_id").select("source_id", F.col("route_id").alias("target_id"), F.lit("CALLS_API").alias("relationship_type"), F.lit(0.8).alias("weight"), "confidence", "evidence")
    # a query of a model belongs to the function around it, else to its file; the model's name is matched exactly, else without case
    asked = cut(found.where("kind = 'query'").select("path", "name", "line").join(files.select("path", F.col("id").alias("file_id")), "path").withColumn("site_id", F.monotonically_increasing_id()), "queries")
    inside = health.enclosing(asked.select("site_id", "file_id", "line"), symbols.where(F.col("type").isin("function", "method", "component")).select("id", "file_id", "start_line"))
    models = symbols.where("type = 'model'").select(F.col("id").alias("target_id"), F.col("name").alias("model"))
    named = asked.join(models, F.lower("name") == F.lower("model")).groupBy("site_id", "file_id").agg(F.min_by("target_id", F.struct(F.col("name") != F.col("model"), "target_id")).alias("target_id"))
    readers = named.join(file_symbol, "file_id").join(inside, "site_id", "left").withColumn("source_id", F.coalesce("symbol_id", "file_symbol")).where("source_id <> target_id")
    queried = readers.select("source_id", "target_id", F.lit("QUERIES").alias("relationship_type"), F.lit(0.8).alias("weight"), F.lit(0.9).alias("confidence"), F.lit("INFERRED").alias("evidence"))
    every = linked.unionByName(api).unionByName(queried)
    best = F.max_by(F.struct("weight", "confidence", "evidence"), F.struct("confidence", "evidence"))
    return every.groupBy("source_id", "target_id", "relationship_type").agg(best.alias("b")).select("source_id", "target_id", "relationship_type", "b.*")


@dataclass
class Context:
    """What to read for a task."""

    ranked: DataFrame
    high: DataFrame
    medium: DataFrame
    shape: DataFrame
    scope: DataFrame
    history: DataFrame | None = None


def context(index: Index, task: str, weights: retrieval.Weights = retrieval.Weights(), anchors: DataFrame | None = None, now: int | None = None) -> Context:
    """Search, expansion and ranking for ``task``, the tiers to read, its shape and its scope; past changes if ``now`` is given."""
    spark = index.spark
    documents = index.symbol_index.select(F.col("symbol_id").alias("id"), F.split("tokens", " ").alias("tokens"))
    words = fts.query_tokens(spark, task)
    hits = fts.seed_search(documents, "id", words).select("id", "score").orderBy(F.desc("score"), "id").limit(30)
    seeds = cut(retrieval.with_anchors(hits, anchors), "seeds")
    recency = cochange = None
    if not index.commits.isEmpty():
        touched = index.symbols.join(seeds.select("id"), "id", "left_semi").join(index.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("path").distinct()
        recency, cochange = history.recency(index.commits, index.commit_files), history.cochange(index.commits, index.commit_files, touched)
    metrics = None if index.node_metrics.isEmpty() else index.node_metrics
    ranked = cut(retrieval.rank(index.symbols, index.files, index.relationships, seeds, index.fanin, recency, cochange, metrics=metrics, task=task, w=weights), "ranked")
    high = retrieval.high_tier(ranked)
    medium = retrieval.medium_tier(ranked, high)
    past = None
    if now is not None:
        past = history.search(history.commit_documents(index.commits, index.commit_files), index.files.select("path"), words, now)
    return Context(ranked, high, medium, retrieval.classify(ranked, index.fanin), retrieval.scope(high, medium), past)


def targets(index: Index, target: str) -> DataFrame:
    """(id, name, type, path): symbols of this name, or the symbols of the file of this path."""
    found = impact.find_symbols(index.symbols, index.files, target)
    file = impact.by_suffix(index.files, target).select(F.col("id").alias("file_id"), "path")
    of_file = index.symbols.join(file, "file_id").select("id", "name", "type", "path")
    return of_file.unionByName(found.join(of_file.select("id"), "id", "left_anti").select("id", "name", "type", "path"))


def impact_of(index: Index, target: str) -> DataFrame:
    """Risk of a change to each symbol that ``target`` names: (id, fan_in, direct_files, tests, reachable, level)."""
    cyclic = graph.in_cycle(graph.cycles(index.relationships))
    return impact.risk(index.relationships, index.symbols, index.files, targets(index, target).select("id"), cyclic)


def path_between(index: Index, start: str, goal: str) -> list[dict] | None:
    """Hops of a shortest path between two symbols, by their names; None if there is none."""
    ends = [impact.find_symbols(index.symbols, index.files, x, 1).first() for x in (start, goal)]
    return None if None in ends else graph.shortest_path(index.relationships, ends[0]["id"], ends[1]["id"])


def analysed(index: Index) -> Index:
    """The index with node metrics, clusters and cycles."""
    nodes = index.symbols.select("id")
    ranks = graph.pagerank(nodes, index.relationships)
    metrics = graph.degrees(nodes, index.relationships).join(ranks, "node_id").join(graph.betweenness(nodes, index.relationships), "node_id", "left")
    paths = index.symbols.join(index.files.select(F.col("id").alias("file_id"), "path"), "file_id").select(F.col("id").alias("node_id"), "path")
    membership = cut(graph.louvain(nodes, index.relationships), "clusters")
    named = membership.join(graph.cluster_names(membership, paths), "cluster_id")
    found = graph.cycles(index.relationships).select("cycle_hash", "length", F.to_json("nodes").alias("nodes_json"))
    return index.with_tables(node_metrics=cut(metrics, "metrics"), clusters=named, cycles=found)


def status(index: Index) -> DataFrame:
    """(name, n) of the index: files, symbols, relationships, protected files, and rows whose owner is gone."""
    spark = index.spark
    protected = index.files.where(is_protected(F.col("path"))).count()
    counted = [(name, getattr(index, name).count()) for name in ("files", "symbols", "relationships")]
    orphans = index.relationships.join(index.symbols.select(F.col("id").alias("target_id")), "target_id", "left_anti").count()
    return spark.createDataFrame([*counted, ("protected", protected), ("orphans", orphans)], "name string, n long")
