import numpy as np
import pytest

from lattica.llm import ann
from lattica.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def exact(vectors, every, count):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], np.float32).astype(float)
    out = {}
    for k in np.flatnonzero(ids % every == 0):
        s = (x[k] * x).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if j != k][:count]
        out[int(ids[k])] = [(int(ids[j]), s[j]) for j in order]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("unit", [True, False])
def test_recall_and_scores(spark, unit):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 48))
    x = centres[rng.integers(0, 30, 1500)] + 0.6 * rng.normal(size=(1500, 48))
    if unit:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = by_query(ann.op2(spark.createDataFrame([(i, v, 0, "x") for i, v in vectors], SCHEMA)).collect())
    want = exact(vectors, 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    lookup = dict(vectors)
    for q, found in got.items():
        assert all(a[1] > b[1] or (a[1] == b[1] and a[0] < b[0]) for a, b in zip(found, found[1:]))
        for i, s in found:
            assert s == pytest.approx(float(np.dot(np.float32(lookup[q]).astype(float), np.float32(lookup[i]).astype(float))), abs=1e-12)


def test_recall_on_the_tables(spark, sf):
    rows = table(spark, sf, "embeddings").where("embedding is not null").collect()
    vectors = [(r.vec_id, r.embedding) for r in rows]
    got, want = by_query(ann.op2(table(spark, sf, "embeddings")).collect()), exact(vectors, 20, 20)
    assert sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in v}) for q, v in want.items()) / sum(map(len, want.values())) >= 0.9


def test_copies_ties_and_few(spark):
    rows = [(i, [1.0, 0.0, 0.0], 0, None) for i in range(60)] + [(100, [0.0, 1.0, 0.0], 0, None), (101, [0.5, 0.5, 0.0], 0, None)]
    got = by_query(ann.op2(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [i for i, _ in got[20]] == [i for i in range(21) if i != 20]
    assert [i for i, _ in got[0]] == list(range(1, 21))
    assert got[100][0] == (101, 0.5) and [i for i, _ in got[100][1:]] == list(range(19))
    few = by_query(ann.op2(spark.createDataFrame(rows[-2:] + [(0, [0.0, 0.0, 1.0], 0, None)], SCHEMA)).collect())
    assert few == {100: [(101, 0.5), (0, 0.0)], 0: [(100, 0.0), (101, 0.0)]}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None, 1, None), (20, [0.0, 0.0], 1, None), (40, [1.0, nan], None, None), (60, [inf, 1.0], 0, None), (80, [1.0, None], 0, None), (None, [1.0, 1.0], 0, None), (100, [1.0, 0.0], 0, None), (100, [1.0, 0.0], 0, None), (3, [1.0, 1.0], None, "y"), (4, [1.0], 0, None)]
    got = ann.op2(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(100, 1, 3, 1.0)]
    assert ann.op2(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ann.op2(spark.createDataFrame([(20, [1.0, 2.0], 0, None)], SCHEMA)).count() == 0


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 40))
    assert np.allclose(np.linalg.norm(ann.rotate(x, 3), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(ann.rotate(x, 1) @ ann.rotate(x, 1).T, x @ x.T)


def test_crowded_cells_are_split(spark, monkeypatch):
    """A third of all vectors in one cell: the same result from many blocks of candidates and of queries."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 16))
    x[:200] = x[0] + 0.01 * rng.normal(size=(200, 16))
    rows = [(i, [float(c) for c in v], 0, "x") for i, v in enumerate(x)]
    want = sorted(map(tuple, ann.op2(spark.createDataFrame(rows, SCHEMA)).collect()))
    monkeypatch.setattr(ann, "BLOCK", 30)
    monkeypatch.setattr(ann, "QUERIES", 3)
    assert sorted(map(tuple, ann.op2(spark.createDataFrame(rows, SCHEMA)).collect())) == want


def test_dimensions_are_searched_apart(spark):
    rows = [(i, [1.0, float(i)], 0, None) for i in range(1, 30)] + [(40 + i, [1.0, float(i), 2.0], 0, None) for i in range(30)]
    got = by_query(ann.op2(spark.createDataFrame(rows, SCHEMA)).collect())
    assert sorted(got) == [20, 40, 60]
    assert all(i < 40 for i, _ in got[20]) and all(i >= 40 for q in (40, 60) for i, _ in got[q]) and len(got[20]) == 20
    assert [i for i, _ in got[20]][:3] == [29, 28, 27]


def test_cells_grow_with_the_vectors():
    sizes = {n: float(np.prod([2 * a for a in ann.axes(n, 64)])) for n in (100, 10_000, 1_000_000, 1_000_000_000)}
    assert all(n / 12 <= cells * 1.01 and cells <= max(n / 3, 4) for n, cells in sizes.items())
    x = np.random.default_rng(1).normal(size=(50, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for parts in ([64], [64, 8], [64, 64, 4]):
        found = ann.probes(x, 0, parts, 40)
        assert (found[:, 0] == ann.cells(x, 0, parts)).all() and all(len(set(r)) == len(r) for r in found.tolist())
