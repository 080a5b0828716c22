import math
import pickle
import random
import zlib
from collections import Counter

from lattica.llm import toxicity
from lattica.llm.common import table

LABELS = "doc_id long, quality int, toxic int"


def planted(n=400, seed=1):
    r = random.Random(seed)
    plain, bad = [f"word{i}" for i in range(300)], ["vile", "scum", "hateful", "filth"]
    texts, labels = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randint(2, 5)):
                words.insert(r.randrange(len(words)), r.choice(bad))
        texts.append(" ".join(words))
        labels.append((i, 0, int(toxic)))
    return texts, labels


def test_held_out_accuracy_on_planted_rows(spark, make):
    texts, labels = planted()
    got = {r.doc_id: r for r in toxicity.op5(make(texts, extra=True), spark.createDataFrame(labels, LABELS)).collect()}
    assert len(got) == len(texts)
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in got)
    assert sum(got[i].predicted == labels[i][2] for i in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_held_out_labels_are_not_read(spark, make):
    texts, labels = planted(200)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    a, b = ({r.doc_id: r.score for r in toxicity.op5(make(texts), spark.createDataFrame(x, LABELS)).collect()} for x in (labels, turned))
    assert a == b


def test_ratios_are_kneser_ney(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST", 3)
    rows = [("a a a bad bad x bad x bad", 1), ("bad b c bad x", 1), ("a a b b c d e x bad y bad", 0), ("f g h bad a a x bad", 0)]
    model = toxicity.weights(spark.createDataFrame(rows, "text string, toxic int"))
    two = {c: Counter(x for t, k in rows if k == c for x in zip(["", *t.split()], t.split())) for c in (0, 1)}
    follows = {c: Counter(w for _, w in two[c]) for c in two}  # in how many contexts
    types = sum(len(x) for x in follows.values())

    def one(w, c):
        return (max(follows[c][w] - 1, 0) + len(follows[c]) * sum(w in x for x in follows.values()) / types) / sum(follows[c].values())

    def p(h, w, c):
        n, kinds = sum(v for (g, _), v in two[c].items() if g == h), sum(g == h for g, _ in two[c])
        return (max(two[c][h, w] - 1, 0) + kinds * one(w, c)) / n if n else one(w, c)

    def ratio(h, w):
        if h and two[0][h, w] + two[1][h, w] >= 3:
            return math.log(p(h, w, 1) / p(h, w, 0))
        return math.log(one(w, 1) / one(w, 0)) if max(x[w] for x in follows.values()) > 1 else 0.0

    text = "x bad a a zzz bad x b f x"
    got, sizes = model.ratios([text, None, "bad x"], model.ids())
    want = [ratio(h, w) for t in (text, "bad x") for h, w in zip(["", *t.split()], t.split())]
    assert sizes.tolist() == [10, 0, 2] and len(model.keys) >= 3
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want)) and min(want) < 0 < max(want)


def test_evidence_of_both_signs():
    model = toxicity.Model.of({"vile": 3.0, "kind": -2.5, "so": 0.5}, {("so", "kind"): -4.0})
    rows = model.evidence(["vile so kind", "", "Kind KIND vile", None], model.ids()).tolist()
    assert rows == [[3, -0.5, 3.0, 4.0], [0, 0, 0, 0], [3, -2.0, 3.0, 5.0], [0, 0, 0, 0]]


def test_a_model_in_a_worker_is_arrays():
    """What each worker keeps of a model's words does not grow with their number but by a hash and a ratio."""
    single = {f"word{i}": float(i % 7 - 3) for i in range(300_000)}
    model = toxicity.Model.of(single, {("word1", "word2"): 5.0})
    ids = model.ids()
    assert len(pickle.dumps(model)) < 20 * len(single) and len(ids) == 0
    some = [f"word{i}" for i in range(0, 300_000, 2)]
    got, sizes = model.ratios([" ".join(some), "word1 word2 none"], ids)
    assert got.tolist() == [*(single[w] for w in some), single["word1"], 5.0, 0.0] and sizes.tolist() == [150_000, 3]
    assert 0 < len(ids) <= toxicity._WORDS + 1


def test_odd_rows(spark, make, odd):
    texts, labels = planted(120)
    labels += [(0, None, None), (None, 1, 1), (3, 0, 0), (3, 0, 0), (9999, 0, 1)]
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    odd = [(1000 + i if i is not None else None, *rest) for i, *rest in odd]
    got = toxicity.op5(make(rows + odd, extra=True), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(r.score is not None and r.held_out is not None for r in got)
    assert len({r.score for r in got if r.doc_id in (1001, 1002, 1003)}) == 1
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in toxicity.op5(make(texts[:5]), none).collect()} == {0.0}
    assert toxicity.op5(make([]), none).count() == 0
    docs = make(odd, extra=True)
    kept = toxicity.accepted(docs, none)
    assert kept.columns == docs.columns and kept.count() == len(odd)


def test_accepted_keeps_clean_rows(spark, make):
    texts, labels = planted()
    kept = {r.doc_id for r in toxicity.accepted(make(texts, extra=True), spark.createDataFrame(labels, LABELS)).collect()}
    clean = {i for i, _, t in labels if not t}
    assert len(kept & clean) >= 0.98 * len(clean) and len(kept - clean) <= 0.02 * len(texts)


def test_workers_take_each_text_once_and_give_back_scores(spark, make):
    """Rows that went through the workers, with the text beside them, took more than an executor's memory."""
    texts, labels = planted()
    long = [(1000 + i, " ".join(f"pad{i}x{j}" for j in range(2000)), "en", "web", 1) for i in range(50)]
    kept = toxicity.accepted(make([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)] + long), spark.createDataFrame(labels, LABELS))
    rows = kept.collect()
    size = sum(len(t) for t in texts) + sum(len(r[1]) for r in long)
    assert {r.doc_id: r.text for r in rows if r.doc_id >= 1000} == {r[0]: r[1] for r in long}
    sent, received, nodes = 0, 0, [kept._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.metrics().contains("pythonDataSent"):
            sent += node.metrics().apply("pythonDataSent").value()
            received += node.metrics().apply("pythonDataReceived").value()
    assert 0 < sent < 1.2 * size and 0 < received < 0.1 * size


def test_held_out_accuracy_on_the_tables(spark, sf):
    path = sf.replace("sf0.001", "sf0.1")  # enough labels to learn from
    labels = {r.doc_id: r.toxic for r in table(spark, path, "labels").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in toxicity.op5(table(spark, path, "documents"), table(spark, path, "labels")).collect() if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(p for p, t in held if t) >= 0.9 * sum(t for _, t in held)
    assert sum(p for p, t in held if not t) <= 0.02 * sum(not t for _, t in held)
