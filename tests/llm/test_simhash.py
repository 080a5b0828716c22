import random

import numpy as np
import xxhash

from lattica.llm import simhash


def slow(text, width=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """Smallest reachable id by comparing all pairs."""
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in prints}


def corpus(n=60):
    r = random.Random(3)
    vocabulary = [f"word{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        base = [r.choice(vocabulary) for _ in range(r.randint(60, 200))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 3)):
            again = list(base)
            again[r.randrange(len(again))] = r.choice(vocabulary)
            texts.append(" ".join(again))
    return texts + [None, "", " ", "A b", "a B", "A\x0bb c", "É é É", "x"]


def test_fingerprint_is_that_of_the_definition():
    for text in corpus(15):
        assert simhash.fingerprint(text) == slow(text)


def test_groups_are_those_of_all_pairs(spark, make):
    texts = corpus()
    got = {r.doc_id: r for r in simhash.op1(spark, make(texts, extra=True)).collect()}
    prints = {i: slow(t) for i, t in enumerate(texts)}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == groups(prints)


def test_links_of_bare_fingerprints(spark):
    r = random.Random(5)
    values = {0, (1 << 64) - 1}
    for _ in range(40):
        v = r.getrandbits(64)
        values.add(v)
        for _ in range(6):  # chains: each at most three bits from the one before
            for b in r.sample(range(64), r.randint(1, 4)):
                v ^= 1 << b
            values.add(v)
    ids = {v: i for i, v in enumerate(sorted(values))}
    nodes = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "simhash long")
    roots = simhash.components(simhash.links(nodes)).collect()
    want = groups({i: v for v, i in ids.items()})
    by_root = {}
    for row in roots:
        by_root.setdefault(row.root, set()).add(ids[row.node & (1 << 64) - 1])
    linked = {i for group in by_root.values() for i in group}
    for group in by_root.values():
        assert len({want[i] for i in group}) == 1
    assert len(by_root) == len({want[i] for i in linked})
    assert all(list(want.values()).count(want[i]) == 1 for i in set(ids.values()) - linked)


def test_many_values_under_one_key():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 24, 6000, dtype=np.uint64))
    assert len(values) > 4096
    edges = simhash._spanning(values)
    parent = list(range(len(values)))
    for i, j in edges:
        parent[i] = j
    few = values[:500]
    own = groups({i: int(v) for i, v in enumerate(few)})

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in own.items():
        assert root(i) == root(j)


def test_odd_rows_and_representatives(spark, make, odd):
    rows = simhash.op1(spark, make(odd, extra=True)).collect()
    assert len(rows) == len(odd)
    zero = {r.doc_id for r in rows if r.fingerprint == "0" * 16}
    assert zero == {1, 2, 3} and {r.component_id for r in rows if r.doc_id in zero} == {1}
    assert next(r for r in rows if r.doc_id is None).component_id == 0
    docs = make(odd, extra=True)
    kept = simhash.representatives(docs)  # 0 and None have the same text, but None has no key
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([0, 1, 4, None, 5, 6], key=str)
    assert simhash.op1(spark, make([])).count() == 0 and simhash.representatives(make([])).count() == 0


def edited(n=60, seed=4):
    """(texts, group of each): texts of 120 words, copies of them with one or two words replaced, and texts that share a passage of 40 words."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    passage, texts, group = [word() for _ in range(40)], [], []
    for i in range(n):
        base = [word() for _ in range(120)]
        if i % 3 == 0:
            base[:40] = passage
        for k in range(1 + i % 4):
            own = list(base)
            for at in ([], [60], [30, 90], [45])[k]:
                own[at] = word()
            texts.append(" ".join(own))
            group.append(i)
    return texts, group


def test_similar_texts_are_grouped_and_no_others(spark, make):
    texts, group = edited()
    first = {g: group.index(g) for g in group}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    pairs = {(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert all(group[i] == group[j] for i, j in pairs) and len(pairs) > 80
    got = {r.doc_id: r.component for r in simhash.similar(make(texts, extra=True)).collect()}
    assert got == {i: first[g] for i, g in enumerate(group)}
    kept = {r.doc_id for r in simhash.representatives(make(texts, extra=True)).collect()}
    assert kept == set(first.values())


def test_edges_are_verified(spark):
    words = [f"w{i}" for i in range(24)]  # 20 shingles
    texts = [(1, " ".join(words)), (2, " ".join(words[2:])), (3, " ".join(words[4:])), (4, " ".join(words[5:])), (5, None)]
    edges = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 4), (1, 5)], "a long, b long")
    got = simhash.verified(edges, spark.createDataFrame(texts, "node long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 2), (1, 3), (2, 4)]  # 18, 16, 15 of 20, and 15 of 18


def test_long_fingerprint_by_the_definition():
    for text in ("", "one two", "a b c d e f", " ".join(f"w{i % 50}" for i in range(300))):
        words = [int(xxhash.xxh64_intdigest(w.encode(), simhash.SEED)) for w in text.split()]
        n, found = min(5, len(words)), set()
        for i in range(len(words) - n + 1 if words else 0):
            h = words[i]
            for w in words[i + 1 : i + n]:
                h = (h * int(simhash._MULTIPLIER) + w) % (1 << 64)
            found.add(int(simhash._mixed(np.array([h], np.uint64))[0]))
        assert sorted(found) == simhash.shingles(text, {}).tolist()
        spread = [simhash._mixed(np.array([h], np.uint64) ^ (np.arange(1, 9, dtype=np.uint64) * simhash._MULTIPLIER)).tolist() for h in sorted(found)]
        want = []
        for w in range(8):
            bits = [sum(x[w] >> b & 1 for x in spread) for b in range(64)]
            want.append(sum(1 << b for b, n in enumerate(bits) if n * 2 > len(found) or (found and n * 2 == len(found) and spread[0][w] >> b & 1)))
        assert simhash.long_fingerprint(simhash.shingles(text, {})).tolist() == want


def test_keys_find_pairs_at_the_similarity():
    """Of random pairs that differ as texts at similarity 0.8 do, the keys of every size find nearly all."""
    rng = np.random.default_rng(6)
    a = rng.random((2000, 512)) < 0.5
    b = a ^ (rng.random((2000, 512)) < 0.1515)
    x, y = (np.packbits(v, axis=1) for v in (a, b))
    for count in (1000, 1 << 23, 1 << 31):
        sets = simhash.key_sets(count)
        assert sets.shape[1] == {1000: 2, 1 << 23: 3, 1 << 31: 4}[count]
        assert ((x == y)[:, sets].all(axis=2).any(axis=1)).mean() > 0.97


def test_runs_of_keys_across_batches(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 8)
    rows = [(i, *(int(x) ^ (1 << (i % 40)) for x in base)) for i in range(500)]
    nodes = spark.createDataFrame(rows, "node long, " + ", ".join(f"f{i} long" for i in range(8)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        roots = {r.root for r in simhash.components(simhash.similar_links(nodes, 500)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(roots) == 1


def test_repeated_ids_of_representatives(make):
    rows = [(7, "a b c d e f g h", "en", "w", 1), (7, "quite another text of more than five words", "en", "w", 1), (7, "a b c d e f g h", "en", "w", 1), (9, "a b c d e f g h", "en", "w", 1), (None, "a b c d e f g h", None, None, None)]
    kept = simhash.representatives(make(rows)).collect()
    assert sorted((str(r.doc_id), r.text[:5]) for r in kept) == [("7", "a b c"), ("7", "quite"), ("None", "a b c")]


def components_of(texts):
    """Smallest place reachable through links at similarity 0.8, by comparing all pairs."""
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        n = min(5, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return dict(enumerate(root))


def test_every_pair_at_the_similarity_is_linked(make):
    """Pairs that share exactly eight of ten shingles, of all sizes: none is missed."""
    texts = []
    for i in range(400):
        n = 4 + 4 * (1 + i % 12)  # this many words: 4 k shingles of the shorter text, 5 k of the longer
        words = [f"p{i}w{k}" for k in range(4 + 5 * (n - 4) // 4)]
        texts += [" ".join(words), " ".join(words[:n])]
    got = {r.doc_id: r.component for r in simhash.similar(make(texts)).collect()}
    assert got == {i: i - i % 2 for i in range(800)}


def test_long_lists_lose_no_link(make, monkeypatch):
    """Variants of one text: most are linked to some others only, and no list of theirs is short."""
    r = random.Random(8)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for i in range(260):
        own = list(base)
        for at in r.sample(range(100), r.choice((1, 2, 2, 3))):
            own[at] = f"x{i}y{at}"
        texts.append(" ".join(own))
    want = components_of(texts)
    assert 20 < len(set(want.values())) < 240
    for reaches in ((16, 128, None), (1, 2, None)):
        monkeypatch.setattr(simhash, "REACHES", reaches)
        assert {r.doc_id: r.component for r in simhash.similar(make(texts)).collect()} == want


def test_later_links_go_between_roots_only(make, monkeypatch):
    """The links of a large group were all gone over again after each round."""
    r = random.Random(8)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for i in range(260):
        own = list(base)
        for at in r.sample(range(100), r.choice((1, 2, 2, 3))):
            own[at] = f"x{i}y{at}"
        texts.append(" ".join(own))
    met, plain = [], simhash.components
    monkeypatch.setattr(simhash, "REACHES", (64, None))
    monkeypatch.setattr(simhash, "components", lambda edges: met.append(edges.count()) or plain(edges))
    assert {x.doc_id: x.component for x in simhash.similar(make(texts)).collect()} == components_of(texts)
    assert len(met) == 2 and met[1] < met[0], met


def test_merged_components_are_those_of_all_links(spark):
    r = random.Random(4)
    edges = [(r.randrange(120), r.randrange(120, 240)) for _ in range(130)]
    frame = lambda some: spark.createDataFrame(some, "a long, b long")
    want = {x.node: x.root for x in simhash.components(frame(edges)).collect()}
    for low in (0, 60, 130):
        got = simhash.merged(simhash.components(frame(edges[:low])), frame(edges[low:])).collect()
        assert {x.node: x.root for x in got} == want and len(got) == len(want)


def test_pairs_of_lists_are_all_met_once():
    rng = np.random.default_rng(9)
    keys = np.repeat(np.arange(4), (3, 40, 200, 1))
    nodes, sizes, places = rng.permutation(len(keys)), rng.integers(90, 130, len(keys)), rng.integers(0, 20, len(keys))
    labels = np.where(rng.random(len(keys)) < 0.6, 0, rng.integers(0, 30, len(keys)))
    lists = keys, nodes, sizes, places, labels
    found = [*simhash._beside(*lists, 1, 16), *simhash._beside(*lists, 17, 50), *simhash._across(*lists, 51)]
    got = sorted((min(a, b), max(a, b)) for x, y in found for a, b in zip(x.tolist(), y.tolist()))
    room = lambda a, b: 9 * min(sizes[a] - places[a], sizes[b] - places[b]) >= 4 * (sizes[a] + sizes[b])
    assert got == [(a, b) for a in range(len(keys)) for b in range(a + 1, len(keys)) if keys[a] == keys[b] and labels[a] != labels[b] and room(a, b)]


def test_the_order_of_shingles_changes_no_link(make, monkeypatch):
    texts, _ = edited(30)
    want = components_of(texts)
    for sampled, often in ((1, 200_000), (5_000, 200_000), (5_000, 1)):
        monkeypatch.setattr(simhash, "SAMPLED", sampled)
        monkeypatch.setattr(simhash, "FREQUENT", often)
        assert {r.doc_id: r.component for r in simhash.similar(make(texts)).collect()} == want


def test_marks_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for n, m, common in ((0, 0, 0), (1, 1, 1), (4, 5, 4), (64, 65, 60), (300, 320, 290), (1000, 1250, 1000), (900, 900, 100), (5000, 40, 40)):
        pool = np.unique(rng.integers(0, 1 << 63, n + m - common, dtype=np.uint64))
        x, y = np.sort(pool[:n]), np.sort(pool[n - common :])
        least = simhash.apart(simhash.marks(x), simhash.marks(y))
        assert least == simhash.apart(simhash.marks(y), simhash.marks(x)) <= n + m - 2 * common
        if 0.8 * n < m < 1.25 * n and common < 0.5 * n:
            assert 9 * least > n + m
