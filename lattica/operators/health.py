"""Code health: dead code, dependencies, layers, structural differences, risk, tests, coverage, secrets, scope, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.paths import is_meta_file, is_protected, is_test, layer_of, numbers_varied, same_route, stem, test_target
from lattica.functions.text import PLACEHOLDER, SECRETS, masked
from lattica.schema import DEFINITIONS
from lattica.scratch import small


def enriched(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Edges beside name, type and path of both ends."""
    ends = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "file_id", "name", "type", "path")
    out = edges
    for side in ("source", "target"):
        out = out.join(ends.select(*(F.col(c).alias(f"{side}_{c}") for c in ends.columns)), f"{side}_id")
    return out


# ---- dead code, reuse, dependencies


def dead_code(symbols: DataFrame, files: DataFrame, edges: DataFrame, entrypoints: list[str] = (), protected: list[str] | None = None) -> DataFrame:
    """(id, path, name, type, exported, confidence): files that nothing refers to, and definitions that nothing uses."""
    path = F.col("path")
    configs = r"(^|/)[a-z]+\.config\.[cm]?[jt]s$"
    framework = path.rlike(r"(^|/)(app|pages)/.*(page|layout|route|loading|error|not-found|middleware)\.[jt]sx?$|(^|/)middleware\.[jt]s$")
    excluded = path.isin(*entrypoints) | path.startswith("scripts/") | path.rlike(configs) | is_test(path) | is_protected(path, protected) | is_meta_file(path, protected) | framework
    routes = symbols.where("type = 'route'").select("file_id").distinct()
    open_files = files.where(~excluded & (F.col("language") != "other")).select(F.col("id").alias("file_id"), "path").join(routes, "file_id", "left_anti")
    own = symbols.select("id", "file_id", "type")
    e = edges.select("source_id", "target_id", "relationship_type").join(own.select(F.col("id").alias("source_id"), F.col("file_id").alias("sf"), F.col("type").alias("st")), "source_id").join(own.select(F.col("id").alias("target_id"), F.col("file_id").alias("tf")), "target_id")
    structural = (F.col("sf") == F.col("tf")) & (F.col("st") == "file") & F.col("relationship_type").isin("CONTAINS", "EXPORTS")
    facts = e.groupBy(F.col("target_id").alias("id")).agg(
        F.max(((F.col("source_id") != F.col("target_id")) & ~structural).cast("int")).alias("used"),
        F.max((F.col("source_id") != F.col("target_id")).cast("int")).alias("touched"),
        F.max(((F.col("relationship_type") == "EXPORTS") & (F.col("st") == "file")).cast("int")).alias("exported"),
    )
    outside = e.where("sf <> tf").select(F.col("tf").alias("file_id")).distinct().withColumn("outside", F.lit(1))
    rows = symbols.join(open_files, "file_id").join(facts, "id", "left").join(outside, "file_id", "left").na.fill(0, ["used", "touched", "exported", "outside"])
    kind, exported = F.col("type"), (F.col("exported") == 1) | F.trim("signature").rlike(r"^export\b")
    plugin = path.contains("adapters/") | path.contains("plugin")
    confidence = (
        F.when(kind == "file", "high").when(kind.isin("method", "component"), "low").when(plugin, F.when(exported, "low").otherwise("medium")).when(exported, "medium").otherwise("high")
    )
    dead = ((kind == "file") & (F.col("touched") == 0) & (F.col("outside") == 0)) | (kind.isin(*DEFINITIONS) & (F.col("used") == 0))
    return rows.where(dead).select("id", "path", "name", "type", F.when(kind == "file", False).otherwise(exported).alias("exported"), confidence.alias("confidence"))


def by_confidence(findings: DataFrame) -> DataFrame:
    return findings.groupBy("confidence").agg(F.count("*").alias("n"))


def unused_dependencies(deps: DataFrame, symbols: DataFrame, edges: DataFrame, contents: DataFrame) -> DataFrame:
    """(ecosystem, name, used): a dependency is used if a symbol, an extracted import or a file's text names it.

    ``deps`` (ecosystem, name) come from manifests and are few; what they are searched in is read once per source."""
    normal = F.when(F.col("ecosystem") == "python", F.lower(F.regexp_replace("name", "-", "_"))).when(F.col("ecosystem") == "go", F.substring_index("name", "/", -1)).otherwise(F.col("name"))
    wanted = deps.select("ecosystem", "name", normal.alias("term")).distinct()
    in_symbols = _named(symbols, wanted)
    imported = edges.where("relationship_type = 'IMPORTS' and evidence = 'EXTRACTED'").select(F.col("target_id").alias("id")).distinct().join(symbols.select("id", F.col("name").alias("symbol")), "id")
    in_imports = imported.join(small(wanted), F.col("symbol").contains(F.col("term"))).select("ecosystem", "name").distinct()
    border = F.concat(F.lit("(?s).*(^|[^A-Za-z0-9_-])\\Q"), F.col("term"), F.lit("\\E([^A-Za-z0-9_-]|$).*"))
    in_texts = contents.join(small(wanted), F.col("content").contains(F.col("term")) & F.regexp_like("content", border)).select("ecosystem", "name").distinct()
    found = in_symbols.union(in_imports).union(in_texts).distinct().withColumn("used", F.lit(True))
    return deps.select("ecosystem", "name").distinct().join(found, ["ecosystem", "name"], "left").withColumn("used", F.coalesce("used", F.lit(False)))


def dependency_counts(found: DataFrame) -> DataFrame:
    """(ecosystem, total, used, unused) of the dependencies ``found`` by :func:`unused_dependencies`."""
    used = F.count_if("used")
    return found.groupBy("ecosystem").agg(F.count("*").alias("total"), used.alias("used"), (F.count("*") - used).alias("unused"))


def _named(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    text = symbols.select(F.concat_ws(" ", "name", "signature").alias("text"))
    return text.join(small(wanted), F.col("text").contains(F.col("term"))).select("ecosystem", "name").distinct()


# ---- architecture, differences, risk


def layer_violations(edges: DataFrame, layers: dict[str, list[str]], disallowed: list[tuple[str, str]]) -> DataFrame:
    """Import edges (with source_path, target_path) from a layer to one it may not use."""
    marked = edges.where("relationship_type = 'IMPORTS' and source_path <> target_path").withColumn("source_layer", layer_of(F.col("source_path"), layers)).withColumn("target_layer", layer_of(F.col("target_path"), layers))
    bad = F.lit(False)
    for a, b in disallowed:
        bad = bad | ((F.col("source_layer") == a) & (F.col("target_layer") == b))
    return marked.where(bad)


def structural_diff(before: DataFrame, after: DataFrame, lines: int = 3) -> DataFrame:
    """(type, name, change): symbols (type, name, signature, start_line, end_line, id) added, removed, or modified by signature or span."""
    def last(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy("type", "name").agg(F.max_by(F.struct("signature", (F.col("end_line") - F.col("start_line")).alias("span")), "id").alias(side))

    both = last(before, "old").join(last(after, "new"), ["type", "name"], "full_outer")
    differs = (F.col("old.signature") != F.col("new.signature")) | (F.abs(F.col("old.span") - F.col("new.span")) > lines)
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(differs, "modified")
    return both.select("type", "name", change.alias("change")).where("change is not null")


def breaking(diff: DataFrame, callers: DataFrame, limit: int = 10) -> DataFrame:
    """(name, callers): removed symbols that are still called, by name, with up to ``limit`` callers (callee, caller)."""
    rows = diff.where("change = 'removed'").select("name").distinct().join(callers.select(F.col("callee").alias("name"), "caller").distinct(), "name")
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("caller"))).where(F.col("n") <= limit)
    return few.groupBy("name").agg(F.sort_array(F.collect_list("caller")).alias("callers"))


def pr_risk(changed: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame, cyclic: DataFrame, protected: list[str] | None = None) -> DataFrame:
    """(path, fan_in, in_cycle, protected, level) of changed files."""
    own = symbols.select("id", "file_id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    mine = own.join(changed.select("path").distinct(), "path", "left_semi")
    into = edges.where(F.col("relationship_type").isin("CALLS", "IMPORTS")).join(mine.select(F.col("id").alias("target_id"), "path"), "target_id").groupBy("path").agg(F.count("*").alias("fan_in"))
    rings = mine.join(cyclic.select(F.col("node_id").alias("id")).distinct(), "id", "left_semi").select("path").distinct().withColumn("in_cycle", F.lit(True))
    rows = changed.select("path").distinct().join(into, "path", "left").join(rings, "path", "left")
    rows = rows.select("path", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"), is_protected(F.col("path"), protected).alias("protected"))
    return rows.withColumn("level", F.when(F.col("protected") | F.col("in_cycle") | (F.col("fan_in") >= 10), "HIGH").when(F.col("fan_in") >= 3, "MEDIUM").otherwise("LOW"))


def overall_risk(levels: DataFrame) -> DataFrame:
    rank = F.when(F.col("level") == "HIGH", 2).when(F.col("level") == "MEDIUM", 1).otherwise(0)
    return levels.agg(F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), (F.coalesce(F.max(rank), F.lit(0)) + 1).cast("int")).alias("level"))


def impact_level(fan_in: Column, direct_files: Column, tests: Column, reachable: Column, protected: Column, in_cycle: Column) -> Column:
    high = protected | in_cycle | (fan_in >= 10) | (direct_files >= 10)
    return F.when(high, "HIGH").when((fan_in >= 3) | (tests >= 3) | (reachable >= 3), "MEDIUM").otherwise("LOW")


# ---- tests, coverage, mutation


def affected_tests(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """(path,): test files with a TESTS edge into a changed file, and changed tests; ``edges`` have source_path, target_path."""
    linked = edges.where("relationship_type = 'TESTS'").join(changed.select(F.col("path").alias("target_path")), "target_path", "left_semi").select(F.col("source_path").alias("path"))
    return linked.union(changed.where(is_test(F.col("path"))).select("path")).distinct()


def link_tests(files: DataFrame) -> DataFrame:
    """(source_path, target_path): a test file and the files of its stem."""
    tests = files.select(F.col("path").alias("source_path"), test_target(F.col("path")).alias("stem")).where("stem is not null")
    code = files.where(test_target(F.col("path")).isNull()).select(F.col("path").alias("target_path"), stem(F.col("path")).alias("stem"))
    return tests.join(code, "stem").select("source_path", "target_path")


def line_coverage(changed: DataFrame, coverage: DataFrame, threshold: float = 80.0) -> DataFrame:
    """(file, lines, covered, pct, ok) of changed lines (file, line) against (file, line, hits); a line not in the report has no hits."""
    best = coverage.groupBy("file", "line").agg(F.max("hits").alias("hits"))
    rows = changed.select("file", "line").distinct().join(best, ["file", "line"], "left")
    out = rows.groupBy("file").agg(F.count("*").alias("lines"), F.sum((F.coalesce("hits", F.lit(0)) > 0).cast("long")).alias("covered"))
    pct = F.round(100.0 * F.col("covered") / F.col("lines"), 2)
    return out.withColumn("pct", pct).withColumn("ok", pct >= threshold)


def symbol_coverage(symbols: DataFrame, coverage: DataFrame) -> DataFrame:
    """(symbol_id, hits, covered_lines, total_lines, covered) of symbols (symbol_id, file, start_line, end_line).

    Lines meet symbols by file and line range; files absent from the report count no lines."""
    best = coverage.groupBy("file", "line").agg(F.max("hits").alias("hits"))
    reported = best.select("file").distinct().withColumn("reported", F.lit(True))
    on = (F.col("s.file") == F.col("c.file")) & F.col("c.line").between(F.col("s.start_line"), F.col("s.end_line"))
    sums = symbols.alias("s").join(best.alias("c"), on).groupBy("symbol_id").agg(F.max("hits").alias("hits"), F.sum((F.col("hits") > 0).cast("long")).alias("covered_lines"))
    rows = symbols.join(sums, "symbol_id", "left").join(reported, "file", "left")
    total = F.when(F.col("reported"), F.col("end_line") - F.col("start_line") + 1).otherwise(0).cast("long")
    covered = F.coalesce("covered_lines", F.lit(0))
    return rows.select("symbol_id", F.coalesce("hits", F.lit(0)).alias("hits"), covered.alias("covered_lines"), total.alias("total_lines"), (covered > 0).cast("int").alias("covered"))


def mutation_score(mutants: DataFrame, threshold: float = 60.0) -> DataFrame:
    """(file, killed, total, score, ok): killed and timed-out mutants over those and the survivors."""
    s = F.col("status")
    out = mutants.groupBy("file").agg(F.sum(s.isin("Killed", "Timeout").cast("long")).alias("killed"), F.sum(s.isin("Killed", "Timeout", "Survived", "NoCoverage").cast("long")).alias("total"))
    score = F.round(F.try_divide(100.0 * F.col("killed"), F.col("total")), 2)
    return out.withColumn("score", score).withColumn("ok", F.coalesce(score >= threshold, F.lit(True)))


_ASSERT = r"\b(?:expect|assert(?:[A-Z_]\w*)?)\s*\(|\bassert\s+\S"
_SKIP = r"\.(?:skip|todo)\b|\bx(?:it|describe|test)\s*\(|@(?:pytest\.mark\.skip|unittest\.skip|Disabled|Ignore)"
_TAUTOLOGY = r"expect\(\s*(true|false|1|null)\s*\)\.(?:toBe|toEqual|toStrictEqual)\(\s*\1\s*\)|\bassert\s+True\b|assertTrue\(\s*True\s*\)"
_STRICT, _LOOSE = r"\.(?:toBe|toEqual|toStrictEqual)\(", r"\.(?:toBeTruthy|toBeDefined|toBeFalsy|toContain|not\.toBeNull)\("


def weakened_tests(diff_lines: DataFrame) -> DataFrame:
    """(file, kind): ways in which the changed lines (file, sign, text) of a test file check less than before."""
    def count(pattern: str, sign: str) -> Column:
        return F.sum(F.when(F.col("sign") == sign, F.size(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1)))).otherwise(0))

    bare, named = r"\.toThrow\(\s*\)", r"\.toThrow\(\s*[^)\s]"
    sums = diff_lines.groupBy("file").agg(
        *(count(p, s).alias(f"{n}_{'add' if s == '+' else 'cut'}") for n, p in (("assert", _ASSERT), ("skip", _SKIP), ("same", _TAUTOLOGY), ("strict", _STRICT), ("loose", _LOOSE), ("bare", bare), ("named", named)) for s in "+-")
    )
    kinds = F.array(
        F.when(F.expr("assert_cut > assert_add"), "removed_assertions"), F.when(F.expr("skip_add > skip_cut"), "skipped"), F.when(F.expr("same_add > same_cut"), "tautology"),
        F.when(F.expr("strict_cut > strict_add and loose_add > loose_cut"), "loosened_matcher"), F.when(F.expr("named_cut > named_add and bare_add > bare_cut"), "loosened_throw"),
    )
    return sums.select("file", F.explode(kinds).alias("kind")).where("kind is not null")


# ---- secrets


def secrets_in_lines(lines: DataFrame, placeholders: bool = True) -> DataFrame:
    """(file, line, kind, preview) of lines (file, line, text); placeholders are left out if so asked."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract("text", f"({p})", 1).alias("value")) for k, p in SECRETS])
    rows = lines.select("file", "line", F.explode(F.filter(found, lambda x: x["value"] != "")).alias("s"))
    if placeholders:
        rows = rows.where(~F.col("s.value").rlike(PLACEHOLDER))
    return rows.select("file", "line", "s.kind", masked(F.col("s.value")).alias("preview"))


# ---- lookups with a preference


def _at_points(sites: DataFrame, found: DataFrame) -> DataFrame:
    return sites.join(found, ["file_id", "line"]).select("site_id", "symbol_id")


def enclosing(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """(site_id, symbol_id): the function (id, file_id, start_line) with the greatest start at or before a site's line.

    Starts and the distinct lines of sites are put in one order for each file, and the last start is carried on: no pairs are made."""
    points = sites.select("file_id", "line").distinct()
    starts = functions.groupBy("file_id", F.col("start_line").alias("line")).agg(F.max("id").alias("id"))
    rows = starts.select("file_id", "line", "id", F.lit(0).alias("point")).unionByName(points.select("file_id", "line", F.lit(None).cast(starts.schema["id"].dataType).alias("id"), F.lit(1).alias("point")))
    before = Window.partitionBy("file_id").orderBy("line", "point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("symbol_id", F.last("id", ignorenulls=True).over(before)).where("point = 1 and symbol_id is not null")
    return _at_points(sites, found.select("file_id", "line", "symbol_id"))


def innermost(sites: DataFrame, spans: DataFrame) -> DataFrame:
    """(site_id, symbol_id): the shortest span (id, file_id, start_line, end_line) around a site's line.

    Spans meet the distinct lines of their file, not the sites."""
    points = sites.select("file_id", "line").distinct()
    on = (points["file_id"] == spans["file_id"]) & points["line"].between(spans["start_line"], spans["end_line"])
    found = points.join(spans.drop("line"), on).groupBy(points["file_id"], points["line"]).agg(F.min_by("id", F.struct(F.col("end_line") - F.col("start_line"), "id")).alias("symbol_id"))
    return _at_points(sites, found)


def _route_keys(path: Column, literal: str, parameter: str) -> Column:
    """Keys under which a path meets all that may serve it: one for each way its first three segments can be met.

    A literal segment is met by an equal one or by a parameter, a parameter by a literal or by a parameter; each side names these ways
    so that every pair has exactly one key in common."""
    def extended(keys: Column, ways: Column) -> Column:
        return F.flatten(F.transform(keys, lambda key: F.transform(ways, lambda way: F.concat(key, F.lit("/"), way))))

    parts = F.split(path, "/")
    keys = F.array(F.size(parts).cast("string"))
    for k in (1, 2, 3):
        part = F.get(parts, F.lit(k))
        ways = F.when(part == "{}", F.array(F.lit(parameter), F.lit("both"))).otherwise(F.array(F.concat(F.lit("="), F.coalesce(part, F.lit(""))), F.lit(literal)))
        keys = extended(keys, ways)
    return keys


def match_routes(routes: DataFrame, calls: DataFrame, strict: bool = False) -> DataFrame:
    """(route_id, call_id): routes (route_id, method, path) that serve calls (call_id, method, path); paths are normalised."""
    r = routes.select("route_id", F.col("method").alias("rm"), F.col("path").alias("rp"), F.explode(_route_keys(F.col("path"), "literal route", "literal call")).alias("key"))
    c = calls.select("call_id", F.col("method").alias("cm"), F.col("path").alias("cp"), F.explode(_route_keys(F.col("path"), "literal call", "literal route")).alias("key"))
    method = F.col("rm") == F.col("cm") if strict else F.col("rm").isNull() | F.col("cm").isNull() | (F.col("rm") == F.col("cm"))
    return r.join(c, "key").where(method & same_route(F.col("rp"), F.col("cp"))).select("route_id", "call_id")


def match_templates(routes: DataFrame, calls: DataFrame) -> DataFrame:
    """(route_id, call_id): routes (route_id, method, path) whose path is that of a call (call_id, method, path), numbers that begin a segment being ``{}``.

    A route without a method serves all. Only these numbers vary: a parameter of a route meets no other segment, as :func:`match_routes` lets it."""
    r = routes.select("route_id", F.col("method").alias("rm"), "path")
    c = calls.select("call_id", F.col("method").alias("cm"), numbers_varied(F.col("path")).alias("path"))
    return r.join(c, "path").where(F.col("rm").isNull() | (F.col("rm") == F.col("cm"))).select("route_id", "call_id")


def without_client(routes: DataFrame, calls: DataFrame) -> DataFrame:
    """(route_id,): routes that no call meets by :func:`match_templates`; calls count once for each method and path, so that no pairs are made."""
    c = calls.select(F.col("method").alias("cm"), numbers_varied(F.col("path")).alias("path")).distinct().groupBy("path").agg(F.collect_set("cm").alias("methods"))
    met = routes.join(c, "path", "left").withColumn("met", F.col("methods").isNotNull() & (F.col("method").isNull() | F.array_contains("methods", F.col("method"))))
    return met.where(~F.coalesce("met", F.lit(False))).select("route_id")


def best_by_name(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref_id, symbol_id): the symbol (id, name, path) of a reference's name, of the same directory, else the same top one, else of the lowest id.

    References meet the lowest id of each name and place, not the symbols: no pairs are made, however many symbols share a name."""
    from lattica.functions.paths import dirname, top_dir

    s = symbols.where("name is not null").select("name", dirname(F.col("path")).alias("dir"), top_dir(F.col("path")).alias("top"), "id")
    rows = refs.select("ref_id", "name", dirname(F.col("path")).alias("dir"), top_dir(F.col("path")).alias("top"))
    by_dir = s.groupBy("name", "dir").agg(F.min("id").alias("in_dir"))
    by_top = s.groupBy("name", "top").agg(F.min("id").alias("in_top"))
    by_name = by_top.groupBy("name").agg(F.min("in_top").alias("anywhere"))
    for lowest, keys, how in ((by_name, ["name"], "inner"), (by_top, ["name", "top"], "left"), (by_dir, ["name", "dir"], "left")):
        rows = rows.join(small(lowest), keys, how)
    return rows.groupBy("ref_id").agg(F.min(F.struct(F.when(F.col("in_dir").isNotNull(), 0).when(F.col("in_top").isNotNull(), 1).otherwise(2), F.coalesce("in_dir", "in_top", "anywhere").alias("symbol_id")))["symbol_id"].alias("symbol_id"))


def first_match(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(ref_id, file_id): the first of a reference's candidate paths (ref_id, candidates array) that exists."""
    rows = candidates.select("ref_id", F.posexplode("candidates").alias("pos", "path")).join(files.select(F.col("id").alias("file_id"), "path"), "path")
    return rows.groupBy("ref_id").agg(F.min_by("file_id", F.struct("pos", "file_id")).alias("file_id"))


def through_barrels(imports: DataFrame, exports: DataFrame, hops: int = 3) -> DataFrame:
    """(import_id, file_id): where an imported name (import_id, file_id, name) is defined, followed through re-exports (file_id, name, to_file_id)."""
    out = imports.select("import_id", "file_id", "name")
    for _ in range(hops):
        step = exports.select(F.col("file_id").alias("f"), F.col("name").alias("n"), "to_file_id")
        out = out.join(step, (F.col("file_id") == F.col("f")) & (F.col("name") == F.col("n")), "left").select("import_id", F.coalesce("to_file_id", "file_id").alias("file_id"), "name")
        out = out.groupBy("import_id", "name").agg(F.min("file_id").alias("file_id"))
    return out.select("import_id", "file_id")


# ---- usage


def recent_tasks(tasks: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` newest of ``tasks`` (id, description, created_at), ties to the larger id."""
    return tasks.select("id", "description", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def usage(invocations: DataFrame, tasks: DataFrame, task_context: DataFrame, now: Column) -> DataFrame:
    """One row: invocations, first and last, of the last seven days, tasks, mean symbols per task."""
    week = F.col("timestamp") >= now - F.expr("interval 7 days")
    a = invocations.agg(F.count("*").alias("invocations"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"), F.sum(week.cast("long")).alias("last_week"))
    b = tasks.agg(F.count("*").alias("tasks"))
    c = task_context.groupBy("task_id").agg(F.count("*").alias("n")).agg(F.avg("n").alias("mean_context"))
    return a.crossJoin(b).crossJoin(c)


def by_command(invocations: DataFrame) -> DataFrame:
    return invocations.groupBy("command").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "command")


def closed_loop(tasks: DataFrame, invocations: DataFrame, command: str = "scan") -> DataFrame:
    """Tasks followed by a ``command`` at or after their creation: one aggregate in place of a correlated search."""
    last = invocations.where(F.col("command") == command).agg(F.max("timestamp").alias("last"))
    return tasks.crossJoin(F.broadcast(last)).where(F.col("last") >= F.col("created_at")).select(*tasks.columns)


def normal_description(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9 ]", " "), r"\s+", " "))


def persisted_scope(tasks: DataFrame, task_scope: DataFrame, description: str, recent: int = 30) -> DataFrame:
    """(path, tier) of the latest task of this description with a scope, else of one alike among the last ``recent``."""
    scoped = tasks.join(task_scope.select(F.col("task_id").alias("id")).distinct(), "id", "left_semi")
    exact = F.col("description") == description
    numbered = scoped.withColumn("n", F.row_number().over(Window.orderBy(F.desc("id"))))
    alike = (normal_description(F.col("description")) == normal_description(F.lit(description))) & (F.col("n") <= recent)
    chosen = numbered.where(exact | alike).orderBy(F.when(exact, 0).otherwise(1), F.desc("id")).limit(1).select(F.col("id").alias("task_id"))
    return task_scope.join(F.broadcast(chosen), "task_id").select("path", "tier")


def definition_of_done(facts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, status) for (name, SQL predicate over the one row of ``facts``): pass, fail, or manual where the fact is null."""
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.when(F.expr(p).isNull(), "manual").when(F.expr(p), "pass").otherwise("fail").alias("status")) for n, p in rules])
    return facts.select(F.explode(rows).alias("r")).select("r.*")


def verdict(**findings: DataFrame) -> DataFrame:
    """(check, n, ok): each set of findings with its size; a check is ok if it is empty."""
    out = None
    for name, frame in findings.items():
        part = frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n", (F.col("n") == 0).alias("ok"))
        out = part if out is None else out.unionByName(part)
    return out
