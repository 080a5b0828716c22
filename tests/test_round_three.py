"""Whole results where earlier forms cut, paired or gathered too much: against plain Python on small inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import scratch
from lattica.functions import paths
from lattica.operators import fts, graph, health, history, impact, retrieval, shortest
from lattica.plans.projections import Data

EDGES = "id long, source_id long, target_id long, relationship_type string, weight double, confidence double, evidence string"


def test_impact_of_more_than_fifty_edges(spark):
    n = 130
    symbols = spark.range(n + 1).select("id", F.col("id").alias("file_id"))
    files = symbols.select("id", F.concat(F.lit("src/"), "id").alias("path"))
    edges = spark.createDataFrame([(i, i, 0, "CALLS", 0.7, 1.0, "EXTRACTED") for i in range(1, n)] + [(n, n + 9, 0, "IMPORTS", 0.7, 1.0, "EXTRACTED"), (n + 1, 0, n, "USES", 0.5, 1.0, "AMBIGUOUS")], EDGES)
    none = spark.createDataFrame([], "node_id long")
    got = impact.risk(edges, symbols, files, symbols.where("id in (0, 5)").select("id"), none, []).orderBy("id").collect()
    assert [(r.id, r.fan_in, r.direct_files, r.level) for r in got] == [(0, n, n, "HIGH"), (5, 0, 1, "LOW")]


def test_names_without_pairs(spark):
    rows = [(i, f"n{i % 3}" if i % 11 else None, f"a{i % 4}/b{i % 5}/f{i}") for i in range(120)] + [(200, "n1", "top"), (201, "n1", "/top")]
    symbols = spark.createDataFrame(rows, "id long, name string, path string")
    refs = spark.createDataFrame([(i, n, p) for i, n, p in rows] + [(300, "n2", "z/q"), (301, "absent", "a1/x")], "ref_id long, name string, path string")

    def dirs(path):
        return path.rpartition("/")[0], path.split("/")[0] if "/" in path else "."

    def place(a, b):
        (x, p), (y, q) = dirs(a), dirs(b)
        return 0 if x == y else 1 if p == q else 2

    want = {}
    for ref, name, path in [tuple(r) for r in refs.collect()]:
        found = [(place(path, p), i) for i, n, p in rows if n is not None and n == name]
        if found:
            want[ref] = min(found)[1]
    best = health.best_by_name(refs, symbols)
    assert {r.ref_id: r.symbol_id for r in best.collect()} == want
    assert best.count() == len(want)


URLS = ["https://x.example/en/6126.html", "http://y.example/en/12", "http://y.example/en/77?page=2", "https://x.example/en/9.html#top", "https://x.example/fr/1/", "http://x.example", "http://x.example/a//7", None]


@pytest.fixture(scope="module")
def pages(spark):
    path = paths.url_path(F.col("url"))
    p = spark.createDataFrame(list(enumerate(URLS)), "id long, url string")
    routes = p.select(F.col("id").alias("route_id"), F.when(F.col("id") % 2 == 0, "GET").alias("method"), paths.numbers_varied(path).alias("path"))
    calls = p.where("id in (0, 1, 5)").select(F.col("id").alias("call_id"), F.when(F.col("id") == 0, "GET").otherwise("POST").alias("method"), path.alias("path"))
    return routes, calls


def test_numbers_that_begin_a_segment_vary(pages):
    got = sorted(map(tuple, health.match_templates(*pages).collect()))
    assert got == [(0, 0), (1, 1), (3, 0), (5, 5)]  # a page's number meets no name of a file


def test_routes_that_no_call_meets(pages):
    assert sorted(r.route_id for r in health.without_client(*pages).collect()) == [2, 4, 6, 7]


def test_betweenness_without_edges_in_the_driver(spark, monkeypatch):
    """The same sums as a search in plain Python, of a graph with parallel edges and ends that are no nodes; nothing is collected."""
    r = random.Random(5)
    pairs = [(r.randrange(60), r.randrange(70)) for _ in range(240)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
    want = dict.fromkeys(range(60), 0.0)
    for s in range(0, 60, 3):  # an even sample of 20
        order, ways, depth, before = [s], {s: 1.0}, {s: 0}, {}
        for v in order:
            for w in near.get(v, []):
                if w not in depth:
                    depth[w] = depth[v] + 1
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    ways[w] = ways.get(w, 0.0) + ways[v]
                    before.setdefault(w, []).append(v)
        gain = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before.get(w, []):
                gain[v] += ways[v] / ways[w] * (1 + gain[w])
            if w != s and w in want:
                want[w] += gain[w]
    edges = spark.createDataFrame([(i, a, b, "CALLS", 0.7, 1.0, "EXTRACTED") for i, (a, b) in enumerate(pairs)], EDGES)
    monkeypatch.setattr(shortest, "CHUNK", 7)
    monkeypatch.setattr(type(edges), "collect", lambda self: pytest.fail("rows went to the driver"))
    found = graph.betweenness(spark.range(60), edges, sources=20)
    monkeypatch.undo()
    scale = 60 / 20 / (59 * 58)
    assert {x.node_id: round(x.betweenness, 9) for x in found.collect()} == {k: round(v * scale, 9) for k, v in want.items()}


def test_dependencies_in_small_steps(monkeypatch):
    starts, ends, near = np.array([0, 3, 5, 6, 6]), np.array([3, 5, 6, 6, 6]), np.array([1, 1, 2, 2, 3, 4], dtype=np.int32)
    whole = shortest.dependencies(np.arange(5), starts, ends, near)
    monkeypatch.setattr(shortest, "CHUNK", 1)
    assert np.allclose(whole, shortest.dependencies(np.arange(5), starts, ends, near)) and whole[1] == 1 and whole[2] == 2


@pytest.mark.parametrize("in_one_bin", [1, 7, 10**6])
def test_louvain_by_components(spark, in_one_bin):
    """As the whole graph in one list: several components, one of many levels, nodes without edges; no task holds all pairs where bins are small."""
    r = random.Random(3)
    groups = [range(k * 40, k * 40 + n) for k, n in enumerate((40, 25, 12, 2, 3))]
    pairs = sorted({(a, b) for g in groups for a, b in ((r.choice(g), r.choice(g)) for _ in range(4 * len(g))) if a < b})
    weights = [round(r.choice((0.7, 0.9, 0.5)), 1) for _ in pairs]
    ids = list(range(0, 230))
    edges = spark.createDataFrame([(i, a, b, "CALLS", w, 1.0, "EXTRACTED") for i, ((a, b), w) in enumerate(zip(pairs, weights))], EDGES)
    want = graph.louvain_kernel(ids, [(a, b, w) for (a, b), w in zip(pairs, weights)])
    assert {x.node_id: x.cluster_id for x in graph.louvain(spark.range(230), edges, in_one_bin=in_one_bin).collect()} == want


def test_weak_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40) if i % 9] + [(100, 7), (200, 201)]
    got = {x.id: x.component for x in graph.weak_components(spark.createDataFrame([(min(p), max(p)) for p in pairs], "a long, b long")).collect()}
    want = {}
    for i in range(1, 41):
        want[i] = want[i - 1] if (i - 1) % 9 and i - 1 in want else i
    assert got == want | {100: want[7], 200: 200, 201: 200}


def test_tuning_names_the_best_of_each_batch(spark):
    """Against all scores in plain Python, with paths named twice; rows are not multiplied by the grid in a join."""
    r = random.Random(1)
    rows = [(f"t{i % 3}", r.randrange(60), r.random(), r.random(), r.random()) for i in range(300)]
    expected = [(f"t{i % 3}", i) for i in range(0, 60, 4)]
    parts = spark.createDataFrame(rows, "task string, path long, seed double, proximity double, centrality double").repartition(5)
    found = retrieval.tune(parts, spark.createDataFrame(expected, "task string, path long"))
    want = {}
    for i, c in enumerate(itertools.product(*retrieval.GRID.values())):
        recall = []
        for task in ("t0", "t1", "t2"):
            best = {}
            for t, path, *values in rows:
                if t == task:
                    best[path] = max(best.get(path, 0.0), sum(x * y for x, y in zip(c, values)))
            top = sorted(best, key=lambda p: (-best[p], p))[:10]
            recall.append(len({(task, p) for p in top} & set(expected)) / len([e for e in expected if e[0] == task]))
        want[i] = sum(recall) / 3
    assert {x.combo: round(x.recall, 9) for x in found.collect()} == {i: round(v, 9) for i, v in want.items()}
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("prefix", [True, False])
def test_scores_without_a_row_for_each_token(spark, prefix):
    r = random.Random(2)
    docs = spark.createDataFrame([(i, [r.choice(("red", "redder", "blue", "bolt", "b")) for _ in range(r.randrange(9))]) for i in range(80)], "id long, tokens array<string>")
    words = ["red", "bolt", "absent", "b!"]
    want = fts.bm25(fts.postings(docs, "id"), fts.terms(spark, words), "id", 20, prefix=prefix).collect()
    counts = fts.counted(docs, "id", fts.clean_terms(words), prefix=prefix)
    got = fts.bm25_of(counts, "id", 20).collect()
    assert [(x.id, round(x.bm25, 9)) for x in got] == [(x.id, round(x.bm25, 9)) for x in want] and len(got) == 20
    assert fts.bm25_of(fts.counted(docs.where("1 = 0"), "id", ["red"]), "id").count() == 0
    twice = fts.counted(docs.where("id = 1").union(docs.where("id = 2")).withColumn("id", F.lit(7).cast("long")), "id", ["red"]).collect()
    assert len(twice) <= 1  # rows of one key are one document


def numbered(df):
    return df._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM")


def test_what_a_task_holds_is_dealt_by_the_size_of_the_input(spark, sf, tmp_path, monkeypatch):
    d = Data(spark, sf)
    assert numbered(d.edges) >= 3 and numbered(graph.undirected_pairs(d.edges)) >= 4 and numbered(graph.fan_out_cap(d.edges, "source_id", 5)) >= 4
    spark.range(400_000).select("id", F.rand(1).alias("x")).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(scratch, "PER_TASK", 1 << 16)
    one, two = scratch.task_count(t), scratch.task_count(t.union(t))
    assert one > 10 and abs(two - 2 * one) <= 1 and scratch.dealt(t, "id").rdd.getNumPartitions() == one
    assert scratch.task_count(spark.createDataFrame([(1,)], "id long")) == 1  # of unknown size


@pytest.mark.parametrize("search", [lambda e, s: graph.distances(e, s).count(), lambda e, s: graph.reaching(e, s).count(), lambda e, s: graph.expand(s.withColumn("score", F.lit(1.0)), e).count(), lambda e, s: graph.shortest_path(e, 0, 6), lambda e, s: graph.cycles(e).count()])
def test_edges_are_made_once_for_all_rounds(spark, search):
    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    rows = spark.createDataFrame([(i, i, i + 1, "CALLS", 0.7, 1.0, "EXTRACTED") for i in range(9)], EDGES)
    search(rows.mapInPandas(count, EDGES), spark.range(1))
    assert made.value == 9


def test_changes_of_few_commits(spark, sf):
    d = Data(spark, sf)
    recent = history.newest(d.commits)
    want = d.commit_files.join(recent.select("sha"), "sha", "left_semi")
    assert sorted(map(str, d.changes_of(recent).collect())) == sorted(map(str, want.collect()))
    assert "Aggregate" not in d.changes_of(recent)._jdf.queryExecution().optimizedPlan().toString().split("LeftSemi")[-1]  # nothing is summed before


def test_pairs_of_ranks_are_dealt_by_the_size_of_the_input(spark, sf, monkeypatch):
    """The sums over pairs and votes are planned by number, not left to be merged."""
    plans = []
    keep = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name="step": plans.append((name, numbered(df))) or keep(df, name))
    d = Data(spark, sf)
    graph.pagerank(d.files.select("id"), d.inner_edges, iterations=1, tolerance=0.0)
    graph.label_propagation(d.files.select("id"), d.inner_edges, 1)
    assert [n for name, n in plans if name == "pairs"] >= [4, 4] and all(n >= 1 for name, n in plans[-1:])
