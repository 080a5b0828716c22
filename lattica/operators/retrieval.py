"""Ranking: seeds, expansion, signals, scores and reasons, tiers, and the assembly of a context."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.paths import is_protected, is_test, mentions_tests, module_of
from lattica.operators.graph import expand
from lattica.schema import DEFINITIONS
from lattica.scratch import small


@dataclass(frozen=True)
class Weights:
    seed: float = 0.5
    proximity: float = 0.25
    centrality: float = 0.1
    recency: float = 0.1
    cochange: float = 0.1
    ppr: float = 0.0
    pr: float = 0.0
    verified: float = 0.35
    depth: int = 2
    decay: float = 0.7
    top: int = 20
    test_factor: float = 0.35


PARTS = ("seed", "proximity", "centrality", "recency", "cochange", "ppr", "pr", "verified")


def with_anchors(seeds: DataFrame, anchors: DataFrame | None = None, verified: DataFrame | None = None) -> DataFrame:
    """(id, score) seeds: verified symbols (id, w) raise theirs to min(1, .6 + .4 w), anchors (id) set it to 1."""
    rows = seeds.select("id", "score", F.lit(0).alias("anchor"))
    if verified is not None:
        rows = rows.unionByName(verified.select("id", F.least(F.lit(1.0), 0.6 + 0.4 * F.col("w")).alias("score"), F.lit(0).alias("anchor")))
    if anchors is not None:
        rows = rows.unionByName(anchors.select("id", F.lit(1.0).alias("score"), F.lit(1).alias("anchor")))
    return rows.groupBy("id").agg(F.when(F.max("anchor") == 1, F.lit(1.0)).otherwise(F.max("score")).alias("score"))


def signals(reach: DataFrame, seeds: DataFrame, fanin: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """(id, seed, proximity, centrality, ppr, pr) of what expansion reached."""
    joined = reach.select("id", "proximity").join(seeds.select("id", F.col("score").alias("seed")), "id", "left").join(fanin.select(F.col("node_id").alias("id"), "n"), "id", "left")
    joined = joined.join(metrics.select(F.col("node_id").alias("id"), F.col("pagerank").alias("p")), "id", "left") if metrics is not None else joined.withColumn("p", F.lit(None).cast("double"))
    joined = joined.select("id", "proximity", F.coalesce("seed", F.lit(0.0)).alias("seed"), F.coalesce("n", F.lit(0)).alias("n"), "p")
    best = joined.agg(F.greatest(F.max("n").cast("double"), F.lit(1.0)).alias("max_n"), F.greatest(F.coalesce(F.max("p"), F.lit(0.0)), F.lit(1e-6)).alias("max_p"), F.greatest(F.max("proximity"), F.lit(1e-9)).alias("max_x"), F.count("p").alias("known"))
    both = joined.crossJoin(F.broadcast(best))
    fan = F.col("n") / F.col("max_n")
    pr = F.when(F.col("known") > 0, F.coalesce("p", F.lit(0.0)) / F.col("max_p")).otherwise(fan)
    return both.select(
        "id", "seed", "proximity",
        ((0.5 * pr + 0.5 * fan) * F.when(F.col("seed") > 0.05, 1.0).otherwise(0.3)).alias("centrality"),
        F.least(F.lit(1.0), 0.85 * F.col("proximity") / F.col("max_x") + 0.15 * F.col("seed")).alias("ppr"),
        pr.alias("pr"),
    )


def score(w: Weights = Weights(), tests_wanted: bool = False) -> Column:
    """The weighted sum of a row's parts; test files count less unless the task is about tests."""
    parts = {"proximity": F.least(F.lit(1.0), F.col("proximity"))}
    total = sum((F.lit(getattr(w, p)) * parts.get(p, F.col(p)) for p in PARTS), F.lit(0.0))
    return total if tests_wanted else total * F.when(is_test(F.col("path")), w.test_factor).otherwise(1.0)


def reason() -> Column:
    """Which signals brought a row here, joined by '+'."""
    named = F.concat_ws(
        "+",
        F.when(F.col("verified") > 0, "verified"), F.when(F.col("seed") > 0.05, "seed"), F.when((F.col("proximity") > 0.05) & (F.col("seed") <= 0.05), "graph"),
        F.when(F.col("centrality") > 0.3, "central"), F.when(F.col("recency") > 0.5, "recent"), F.when(F.col("cochange") > 0.3, "co-change"),
    )
    return F.when(named == "", "graph").otherwise(named)


def rank(
    symbols: DataFrame, files: DataFrame, edges: DataFrame, seeds: DataFrame, fanin: DataFrame, recency: DataFrame | None = None, cochange: DataFrame | None = None,
    metrics: DataFrame | None = None, verified: DataFrame | None = None, task: str = "", w: Weights = Weights(),
) -> DataFrame:
    """(id, name, type, path, parts..., score, reason): the best ``w.top`` symbols for the seeds (id, score).

    Only the reached nodes are joined to symbols, files and file signals. File symbols come in only where nothing or little
    else was found."""
    reach = expand(seeds, edges, w.depth, w.decay)
    parts = signals(reach, seeds, fanin, metrics)
    rows = symbols.select("id", "file_id", "name", "type", "signature").join(small(parts), "id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    for name, frame in (("recency", recency), ("cochange", cochange)):
        rows = rows.join(frame.select("path", name), "path", "left").withColumn(name, F.coalesce(name, F.lit(0.0))) if frame is not None else rows.withColumn(name, F.lit(0.0))
    rows = rows.join(verified.select("id", F.col("w").alias("verified")), "id", "left").withColumn("verified", F.coalesce("verified", F.lit(0.0))) if verified is not None else rows.withColumn("verified", F.lit(0.0))
    tests_wanted = bool(edges.sparkSession.range(1).select(mentions_tests(F.lit(task))).first()[0])
    scored = rows.withColumn("score", score(w, tests_wanted)).withColumn("reason", reason())
    ranked = scored.where("type <> 'file'").orderBy(F.desc("score"), "id").limit(w.top)
    fallback = file_fallback(scored.where("type = 'file'"), ranked)
    columns = ["id", "name", "type", "path", "signature", *PARTS, "score", "reason"]
    return ranked.select(columns).unionByName(fallback.select(columns))


def file_fallback(file_rows: DataFrame, ranked: DataFrame) -> DataFrame:
    """File symbols to add: up to five seeds if nothing was ranked, else up to two of seed .5 or more whose file is not there yet."""
    new = file_rows.where("seed > 0").join(ranked.select("path").distinct(), "path", "left_anti")
    placed = new.withColumn("__n", F.row_number().over(Window.orderBy(F.desc("seed"), "id"))).where("__n <= 5")
    some = ranked.agg((F.count("*") > 0).alias("some"))
    kept = placed.crossJoin(F.broadcast(some)).where("not some or (seed >= 0.5 and __n <= 2)")
    return kept.withColumn("score", 0.5 * F.col("seed") + 0.05).drop("__n", "some")


def file_order(ranked: DataFrame) -> DataFrame:
    """(path, place): files in the order of their best row."""
    numbered = ranked.withColumn("n", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    firsts = numbered.groupBy("path").agg(F.min("n").alias("first"))
    return firsts.select("path", F.row_number().over(Window.orderBy("first")).alias("place"))


def high_tier(ranked: DataFrame, least: float = 0.3, share: float = 0.75, files: int = 4) -> DataFrame:
    """Rows to read first: near the best score, no tests, from up to ``files`` files."""
    top = F.max("score").over(Window.partitionBy())
    good = ranked.withColumn("__top", top).where((F.col("score") >= least) & (F.col("score") >= share * F.col("__top")) & ~is_test(F.col("path"))).drop("__top")
    return good.join(file_order(good).where(F.col("place") <= files).select("path"), "path", "left_semi").select(*ranked.columns)


def medium_tier(ranked: DataFrame, high: DataFrame, least: float = 0.15, limit: int = 10) -> DataFrame:
    return ranked.where(F.col("score") >= least).join(high.select("id"), "id", "left_anti").orderBy(F.desc("score"), "id").limit(limit).select(*ranked.columns)


def classify(ranked: DataFrame, fanin: DataFrame, clusters: DataFrame | None = None, protected: list[str] | None = None, least: float = 0.15) -> DataFrame:
    """(complexity, files, modules, max_fan_in, protected): COMPLEX if a change would reach far."""
    rows = ranked.where(F.col("score") >= least)
    rows = rows.join(fanin.select(F.col("node_id").alias("id"), "n"), "id", "left")
    rows = rows.join(clusters.select(F.col("node_id").alias("id"), "cluster_id"), "id", "left") if clusters is not None else rows.withColumn("cluster_id", F.lit(None).cast("long"))
    shared = rows.groupBy("cluster_id").agg(F.countDistinct("path").alias("m")).where("cluster_id is not null and m >= 2").select("cluster_id", F.lit(True).alias("merged"))
    module = F.when(F.col("merged"), F.concat(F.lit("cluster:"), F.col("cluster_id").cast("string"))).otherwise(module_of(F.col("path")))
    facts = rows.join(shared, "cluster_id", "left").agg(
        F.countDistinct("path").alias("files"), F.countDistinct(module).alias("modules"),
        F.coalesce(F.max(F.when(F.col("type").isin(*DEFINITIONS), F.col("n"))), F.lit(0)).alias("max_fan_in"),
        F.coalesce(F.max(is_protected(F.col("path"), protected).cast("int")), F.lit(0)).alias("protected"),
    )
    far = (F.col("files") >= 3) | (F.col("modules") > 1) | (F.col("max_fan_in") >= 5) | (F.col("protected") == 1)
    return facts.select(F.when(far, "COMPLEX").otherwise("SIMPLE").alias("complexity"), "files", "modules", "max_fan_in", F.col("protected").cast("boolean").alias("protected"))


def estimated_loc(ranked: DataFrame, symbols: DataFrame) -> DataFrame:
    """(loc,): lines of the ranked symbols whose span is known."""
    spans = ranked.select("id").join(symbols.select("id", "start_line", "end_line"), "id")
    return spans.agg(F.sum(F.when(F.col("end_line") >= F.col("start_line"), F.col("end_line") - F.col("start_line") + 1).otherwise(0)).alias("loc"))


def scope(high: DataFrame, medium: DataFrame, tests: DataFrame | None = None, history: DataFrame | None = None, protected: list[str] | None = None) -> DataFrame:
    """(path, tier): where a path appears first decides; protected ones are protected; only the first tier is required."""
    spark_order = [(high, "required"), (medium, "related"), (tests, "tests"), (history, "history")]
    rows = None
    for n, (frame, tier) in enumerate(spark_order):
        if frame is not None:
            part = frame.select("path", F.lit(n).alias("n"), F.lit(tier).alias("tier"))
            rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy("path").agg(F.min_by("tier", "n").alias("tier"))
    return first.select("path", F.when(is_protected(F.col("path"), protected), "protected").otherwise(F.col("tier")).alias("tier"))


def scope_violations(changed: DataFrame, allowed: DataFrame) -> DataFrame:
    """Changed paths outside a scope; none if the scope is empty, as it then says nothing."""
    some = allowed.agg((F.count("*") > 0).alias("some"))
    return changed.select("path").distinct().join(allowed.where("tier <> 'protected'").select("path"), "path", "left_anti").crossJoin(F.broadcast(some)).where("some").select("path")


def hotspots(metrics: DataFrame, clones: DataFrame, limit: int = 5) -> DataFrame:
    """Of the twenty best rows, those of most score + 2 x PageRank."""
    top = clones.orderBy(F.desc("score"), "id").limit(20)
    heat = F.col("score") + 2 * F.coalesce("pagerank", F.lit(0.0))
    return top.join(metrics.select(F.col("node_id").alias("id"), "pagerank"), "id", "left").withColumn("heat", heat).orderBy(F.desc("heat"), "id").limit(limit)


def quality(ranked: DataFrame, expected: DataFrame, k: int = 20) -> DataFrame:
    """(task, recall, mrr, ndcg, irrelevant): of ranked paths (task, path, place from 1) against expected ones (task, path)."""
    rows = ranked.where(F.col("place") <= k).join(expected.withColumn("hit", F.lit(1)), ["task", "path"], "left")
    total = expected.groupBy("task").agg(F.count("*").alias("total"))
    gain = F.sum(F.coalesce("hit", F.lit(0)) / F.log2(F.col("place") + 1.0))
    sums = rows.groupBy("task").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("place"))).alias("first"), gain.alias("dcg"), F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("total", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return total.join(sums, "task", "left").select(
        "task",
        (F.coalesce("hits", F.lit(0)) / F.col("total")).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
        F.coalesce(1 - F.col("hits") / F.col("n"), F.lit(0.0)).alias("irrelevant"),
    )


GRID = {"seed": (0.3, 0.4, 0.5, 0.6), "proximity": (0.15, 0.25, 0.35), "centrality": (0.05, 0.1, 0.15)}


def _best_of(parts: DataFrame, names: list[str], combos: list[tuple], k: int) -> DataFrame:
    """(combo, task, path, score): for every combination, rows of ``parts`` among which the ``k`` best paths of each task are: the best of each batch of rows."""
    def run(frames):
        for frame in frames:
            tasks, columns = frame["task"].to_numpy(), [frame[n].to_numpy(dtype="float64", na_value=float("nan")) for n in names]
            for i, weights in enumerate(combos):
                score = np.zeros(len(frame))
                for weight, column in zip(weights, columns):
                    score = score + weight * column
                some = pd.DataFrame({"combo": i, "task": tasks, "path": frame["path"], "score": score})
                some = some.sort_values(["score", "path"], ascending=[False, True], na_position="last", kind="stable").drop_duplicates(["task", "path"])
                yield some.groupby("task", sort=False, dropna=False).head(k)

    return parts.select("task", "path", *names).mapInPandas(run, f"combo int, task {parts.schema['task'].dataType.simpleString()}, path {parts.schema['path'].dataType.simpleString()}, score double")


def tune(parts: DataFrame, expected: DataFrame, grid: dict[str, tuple] = GRID, k: int = 10) -> DataFrame:
    """(seed, proximity, centrality, recall, irrelevant) of every combination, best first: one pass over ``parts`` for all.

    Each batch of rows names its best for all combinations, and only those are dealt out."""
    spark = parts.sparkSession
    names = list(grid)
    every = list(itertools.product(*grid.values()))
    combos = spark.createDataFrame([(i, *c) for i, c in enumerate(every)], ", ".join(["combo int", *(f"w_{n} double" for n in names)]))
    best = _best_of(parts, names, every, k).groupBy("combo", "task", "path").agg(F.max("score").alias("score"))
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy("combo", "task").orderBy(F.desc("score"), "path"))).where(F.col("place") <= k)
    total = expected.groupBy("task").agg(F.count("*").alias("total"))
    hits = placed.join(expected.withColumn("hit", F.lit(1)), ["task", "path"], "left").groupBy("combo", "task").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.count("*").alias("n"))
    each = hits.join(total, "task").groupBy("combo").agg(F.avg(F.col("hits") / F.col("total")).alias("recall"), F.avg(1 - F.col("hits") / F.col("n")).alias("irrelevant"))
    return each.join(F.broadcast(combos), "combo").orderBy(F.desc("recall"), "irrelevant", "combo").select("combo", *(F.col(f"w_{n}").alias(n) for n in names), "recall", "irrelevant")


def mode(complexity: str, files: int, wanted: str | None = None) -> str:
    """FAST for a simple task of one file, SAFE or AUDIT if asked for or if it is complex."""
    if wanted in ("SAFE", "AUDIT"):
        return wanted
    return "FAST" if complexity == "SIMPLE" and files <= 1 else "SAFE"


def prune(sections: DataFrame, tokens: int) -> DataFrame:
    """Sections (priority: what goes last is smallest, text) that fit ``tokens`` of four characters; the most important is cut if it must be."""
    size = F.sum(F.length("text")).over(Window.orderBy("priority").rowsBetween(Window.unboundedPreceding, 0))
    kept = sections.withColumn("__size", size)
    first = F.row_number().over(Window.orderBy("priority")) == 1
    return kept.withColumn("__first", first).where((F.ceil(F.col("__size") / 4) <= tokens) | F.col("__first")).withColumn("text", F.substring("text", F.lit(1), F.lit(tokens * 4))).drop("__size", "__first")


def render(ranked: DataFrame, style: str = "brief") -> DataFrame:
    """(place, line): rows as text: brief, table, tree, explain or mermaid."""
    place = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    line = {
        "brief": F.format_string("%s %s", F.col("path"), F.col("name")),
        "table": F.format_string("| %s | %s | %s | %.3f |", F.col("name"), F.col("type"), F.col("path"), F.col("score")),
        "tree": F.format_string("%s\n  └ %s (%s)", F.col("path"), F.col("name"), F.col("type")),
        "explain": F.format_string("%s %.3f = seed %.2f, proximity %.2f, centrality %.2f, recency %.2f, co-change %.2f [%s]", F.col("name"), *(F.col(c) for c in ("score", "seed", "proximity", "centrality", "recency", "cochange")), F.col("reason")),
        "mermaid": F.format_string("  n%d[\"%s\"]", F.col("id"), F.regexp_replace("name", '"', "'")),
    }[style]
    return ranked.select(place.alias("place"), line.alias("line")).orderBy("place")
