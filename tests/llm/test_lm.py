import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lattica.llm import lm
from lattica.llm.common import table


def fold(i):
    return zlib.crc32(str(i).encode()) % 7


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", lowered) if w] + [None]


def brute(texts):
    counts = Counter(w for i, t in enumerate(texts) if fold(i) != 2 for w in words(t))
    n, v = sum(counts.values()), len(counts)
    return {i: (len(words(t)), sum(counts[w] > 0 for w in words(t)), n, math.fsum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in enumerate(texts)}


def corpus(n=150):
    r = random.Random(8)
    nouns, verbs = [f"noun{i}" for i in range(40)], [f"verb{i}" for i in range(40)]
    return [" ".join(x for _ in range(r.randint(1, 40)) for x in ("The", r.choice(nouns), r.choice(verbs))) + (f" rare{i}" if i % 3 else "") for i in range(n)] + [None, "", "É x", "unseen " * 5]


def test_counts_and_base_by_the_definition(make):
    texts = corpus()
    want = brute(texts)
    rows = lm.op10(make(texts, extra=True)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.held_out == (fold(r.doc_id) == 2)
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def chains(text):
    """(g, h, w) of every token; a text begins after two ends."""
    found = [None, None, *words(text)]
    return list(zip(found, found[1:], found[2:]))


def brute_scores(texts, weights=None):
    """Scores of all texts by the definition, from dictionaries; without ``weights`` they are learned token by token."""

    def count(part):
        out = [Counter(), Counter(), Counter(), Counter()]
        for t in part:
            for g, h, w in chains(t):
                out[0][w] += 1
                out[1][h, w] += 1
                out[2][g, h, w] += 1
            out[3][None, None] += 1
        out[3].update({x: n for x, n in out[1].items() if x != (None, None)})  # those are counted where a text begins
        return out

    def parts(c, g, h, w):
        n, v = sum(c[0].values()), len(c[0])
        one, two = c[0][h] if h is not None else c[3][None, None], c[3][g, h] if (g, h) != (None, None) else c[3][None, None]
        bucket = 24 + 1 + min(int(math.log2(two)), 23) if two else 1 + min(int(math.log2(one)), 23) if one else 0
        return bucket, [1 / (v + 1), c[0][w] / n, c[1][h, w] / one if one else 0, c[2][g, h, w] / two if two else 0]

    main = count([t for i, t in enumerate(texts) if fold(i) not in (2, 5)])
    if weights is None:
        cells = Counter()
        for i, t in enumerate(texts):
            if fold(i) == 5:
                for x in chains(t):
                    b, p = parts(main, *x)
                    cells[b, *(round(-lm.BINS * math.log10(y)) if y else -1 for y in p[1:])] += 1
        uniform = 1 / (len(main[0]) + 1)
        each = np.array([[uniform, *(10 ** (-y / lm.BINS) if y >= 0 else 0 for y in c[1:])] for c in cells]).T
        weights = lm.learn(np.array([c[0] for c in cells]), each, np.array(list(cells.values()), float))
    every = count([t for i, t in enumerate(texts) if fold(i) != 2])
    out = {}
    for i, t in enumerate(texts):
        found = [parts(every, *x) for x in chains(t)]
        out[i] = math.fsum(math.log10(sum(w * y for w, y in zip(weights[b], p))) for b, p in found)
    return out


def test_scores_by_the_definition(make, monkeypatch):
    texts = corpus()
    want = brute_scores(texts)
    rows = lm.op10(make(texts)).collect()
    assert {r.doc_id: pytest.approx(r.score, rel=1e-9) for r in rows} == want
    monkeypatch.setattr(lm, "CHUNK", 300)  # many chunks and buckets
    monkeypatch.setattr(lm, "BUCKET", 100)
    rows = lm.op10(make(texts)).collect()
    assert {r.doc_id: pytest.approx(r.score, rel=1e-9) for r in rows} == want


def test_probabilities_of_a_context_add_up_to_one():
    """Over the vocabulary and one unseen word, for a context seen as a pair, one seen as a word, and one never seen."""
    weights = lm.learn(np.array([0, 1, 26]), np.array([[0.1] * 3, [0.2, 0.3, 0.1], [0, 0.5, 0.1], [0, 0, 0.9]]), np.array([5.0, 9.0, 70.0]))
    assert np.allclose(weights.sum(axis=1), 1)
    assert (weights[0, 2:] == 0).all() and (weights[1 : lm.BUCKETS + 1, 3] == 0).all()
    counts = [np.array([4, 3, 3, 0]), np.array([2, 1, 1, 0]), np.array([1, 1, 0, 0])]
    for contexts in ([None, np.full(4, 4), np.full(4, 2)], [None, np.full(4, 4), np.zeros(4, int)], [None, np.zeros(4, int), np.zeros(4, int)]):
        each = lm.estimates([counts[0], counts[1] * (contexts[1] > 0), counts[2] * (contexts[2] > 0)], contexts, 10, 3)
        assert (each * weights[lm.bucket_of(contexts)].T).sum() == pytest.approx(1)


def test_numbers_come_back():
    rng = np.random.default_rng(1)
    for n in (1, 5, 1000):
        for bits in (0, 3, 8, 9, 24, 40, 63):
            x = rng.integers(0, 1 << bits, n, dtype=np.uint64, endpoint=True)
            assert lm._unplaned(lm._planes(x), n).tolist() == x.tolist() and lm._unpacked(lm._packed(x)).tolist() == x.tolist()


def test_weights_are_learned():
    sure = lm.learn(np.array([30, 30]), np.array([[1e-3] * 2, [0.5, 0.5], [0.5, 0.5], [0.99, 0.99]]), np.array([500.0, 500.0]))
    assert sure[30, 3] > 0.9
    noise = lm.learn(np.array([30, 30]), np.array([[1e-3] * 2, [0.5, 0.5], [0.4, 0.4], [0.99, 0.001]]), np.array([50.0, 500.0]))
    assert noise[30, 3] < 0.2


def test_keys_of_many_chunks_are_those_of_one():
    texts = corpus(30)
    whole = lm.Chunk([(t or "").encode() for t in texts], [62, 50, 50])
    parts = [lm.Chunk([(t or "").encode()], [62, 50, 50]) for t in texts]
    for n in range(lm.ORDER):
        assert set(whole.keys[n].tolist()) == set().union(*(p.keys[n].tolist() for p in parts))
        assert whole.keys[n][whole.places[n]].tolist() == [k for p in parts for k in p.keys[n][p.places[n]].tolist()]
    grams = {(i, *x) for i in range(1) for t in texts for x in chains(t)}
    assert len(whole.keys[2]) == len(grams)


def test_rows_of_a_large_corpus_hold_many_keys():
    """10 GB of text, which is about 6 GB of parquet: what chunks and buckets exchange is not a row for every few keys."""
    size = 10_000_000_000
    widths, buckets = lm.layout(size)
    rows = size / lm.CHUNK * sum(buckets)
    assert len(widths) == len(buckets) == lm.ORDER and rows < 1e6 * size / 1e9
    assert all(lm.BUCKET <= lm.ORDER * size / 6 / n < 2 * lm.FEWER * lm.BUCKET for n in buckets)


def test_buckets_of_each_order_change_no_score(make, monkeypatch):
    texts = corpus()
    want = sorted(lm.op10(make(texts)).collect())
    monkeypatch.setattr(lm, "BUCKET", 100)
    monkeypatch.setattr(lm, "CHUNK", 500)
    assert lm.layout(10_000)[1][0] < lm.layout(10_000)[1][1]
    for a, b in zip(want, sorted(lm.op10(make(texts)).collect())):
        assert a[:5] == b[:5] and a.base_score == pytest.approx(b.base_score) and a.score == pytest.approx(b.score)


def test_odd_rows(make, odd):
    rows = lm.op10(make(odd, extra=True)).collect()
    assert len(rows) == len(odd)
    assert all(r.score is not None and r.base_score is not None and r.held_out is not None for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert lm.op10(make([])).count() == 0
    alone = next(i for i in range(100) if fold(i) == 2)
    only = lm.op10(make([(alone, "nothing learned", None, None, None)])).first()
    assert (only.n_known, only.train_tokens, only.base_score) == (0, 0, 0.0)


def test_better_than_the_base_on_held_out_rows_of_the_tables(spark, sf):
    held = lm.op10(table(spark, sf.replace("sf0.001", "sf0.01"), "documents")).where("held_out").selectExpr("sum(score) - sum(base_score) AS gain", "sum(n_tokens) AS n").first()
    assert held.gain / held.n > 0.25
