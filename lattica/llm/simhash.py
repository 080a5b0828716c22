"""SimHash near-duplicate groups through a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes. Two fingerprints at no more than three differing bits differ in at most three
of them, so they share at least five: that is the guaranteed minimum of the count filter. A pair's tally of shared
postings reaches five exactly if some five of the eight postings (position, byte) hold both. The inverted index is
therefore kept by such sets of five: C(8,5) = 56 keys for each distinct fingerprint, and two fingerprints under a key
have a tally of five or more. No pairs with smaller tallies are ever made, and no pair is shuffled: inside a key only
three bytes are free, so members are verified there, and only the edges of a spanning forest leave it.

:func:`near_duplicates` takes fingerprints of 64 bits at three differing bits. :func:`similar` is for texts whose sets of five-word
shingles have a Jaccard similarity of 0.8 or more, and finds every such link: it puts the shingles of a set in one order for all, and of
two similar sets of sizes n and m the first n - ceil(0.8 n) + 1 and m - ceil(0.8 m) + 1 share one at least (prefix filtering). These
prefixes are the index, a fifth of all shingles. Any order gives the same links; frequent shingles of a sample come last, so that lists
under a shingle stay short. Members of a list are candidates if their sizes and the places of the shingle leave room for 0.8. Each set has
marks, the parities of its shingles by hash, of about one bit a shingle; no two sets differ in fewer shingles than in marks, so marks too far
apart rule a candidate out before texts are read. All others are verified by the exact similarity. Only components are wanted, so in long lists neighbours are verified first, and then
all candidates that are not yet in one component.

:func:`similar_links` is an index of long fingerprints without texts: ``LONG`` bits stand for the set, in 64 positional bytes. A pair at 0.8
shares 17 bytes on average, and of all pairs of bytes as many are made keys that one is shared with 98 % probability (99.9 % at
0.85). With the number of texts the keys grow from two bytes to three and four. Fingerprints under a key that differ in ``FAR`` of their first
256 bits or fewer (0.8 and three standard deviations) are its pairs. No query uses it, as it misses links.

Edge cases: a null or wordless text has fingerprint zero, linked like any other; texts of one or two words have one
shingle, the whole word sequence; equal fingerprints (exact copies, repeated rows) are one node of the index, so a group
of copies of any size is one row there; rows with a null id keep their row, with the component of their fingerprint (null
if no row of it has an id); an empty table gives an empty table; further columns of the input are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import forget, list_array, release, written

SEED = 42
MAX_BITS = 3
POSITIONS = 8
MIN_SHARED = POSITIONS - MAX_BITS
_BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a whole text: a bit is 1 if it is set in more than half of the shingles' XXH64 values."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest, count, total = xxhash.xxh64_intdigest, len(words) - width + 1, np.zeros(64, dtype=np.int64)
    for low in range(0, count, _BLOCK):
        high = min(count, low + _BLOCK)
        ends = starts[low + width : high + width]
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[low:high], ends)], dtype=np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > count, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with a column ``simhash``: the fingerprint's bits as a signed long."""

    def run(batches):
        for batch in batches:
            out = np.array([fingerprint(t, width) for t in batch.column(0).to_pylist()], dtype=np.uint64)
            yield pa.record_batch([*batch.columns[1:], pa.array(out.view(np.int64))], names=[*batch.schema.names[1:], "simhash"])

    keep = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(F.col(text).alias("__text"), *keep).mapInArrow(run, f"{schema}, simhash long")


def _spanning(values: np.ndarray) -> list[tuple[int, int]]:
    """Edges (member, smaller member) that connect what is linked among the distinct ``values`` of one index key.

    At most 24 bits vary. Values are compared with all others while they are few, and with their neighbours at up to
    three flipped bits when they are many; both find every link."""
    n = len(values)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)

    if n <= 4096:
        for i in range(n - 1):
            near = np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= MAX_BITS)
            for j in near.tolist():
                join(i, i + 1 + j)
    else:
        varying = int(np.bitwise_or.reduce(values ^ values[0]))
        bits = [1 << b for b in range(64) if varying >> b & 1]
        for size in range(1, MAX_BITS + 1):
            for flips in combinations(bits, size):
                other = values ^ np.uint64(sum(flips))
                at = np.minimum(np.searchsorted(values, other), n - 1)
                for i in np.flatnonzero((values[at] == other) & (at > np.arange(n))).tolist():
                    join(i, int(at[i]))
    return [(i, root(i)) for i in range(n) if root(i) != i]


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, enough to connect all that are linked.

    ``nodes`` has one row per distinct ``simhash``. Each key of the index is read as a sorted run; a run is at most 2^24
    values, whatever the size of the corpus."""
    sets = list(combinations(range(POSITIONS), MIN_SHARED))
    masks = np.array([sum(0xFF << (8 * p) for p in s) for s in sets], dtype=np.uint64)

    def post(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, mask in enumerate(masks):
                yield pa.record_batch([pa.array(np.full(len(values), k, dtype=np.int8)), pa.array((values & mask).view(np.int64)), pa.array(values.view(np.int64))], names=["k", "shared", "simhash"])

    def verify(batches):
        held: list[np.ndarray] = []  # the runs not yet ended: k, shared, simhash

        def edges(rows: np.ndarray):
            new = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
            bounds = np.concatenate([[0], new, [rows.shape[1]]])
            for i in np.flatnonzero(np.diff(bounds) > 1).tolist():
                values = np.sort(rows[2, bounds[i] : bounds[i + 1]].view(np.uint64))
                for a, b in _spanning(values):
                    yield values[a], values[b]

        def pack(found):
            out = np.array(list(found), dtype=np.uint64).reshape(-1, 2)
            return pa.record_batch([pa.array(out[:, 0].view(np.int64)), pa.array(out[:, 1].view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            if held and (rows[0, -1], rows[1, -1]) == (held[-1][0, -1], held[-1][1, -1]):
                held.append(rows)  # one run goes on through the whole batch, or it ends inside what is held
                if (rows[0, 0], rows[1, 0]) == (rows[0, -1], rows[1, -1]):
                    continue
                rows = np.concatenate(held, axis=1)
            else:
                rows = np.concatenate([*held, rows], axis=1)
            last = int(np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))[-1]) + 1 if (rows[0, 0], rows[1, 0]) != (rows[0, -1], rows[1, -1]) else 0
            held = [rows[:, last:]]
            if last:
                yield pack(edges(rows[:, :last]))
        if held:
            yield pack(edges(np.concatenate(held, axis=1)))

    posted = nodes.select("simhash").mapInArrow(post, "k byte, shared long, simhash long")
    return posted.repartition("k", "shared").sortWithinPartitions("k", "shared").mapInArrow(verify, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges``: root is the same for all nodes of a connected component.

    Labels travel along edges and then jump to their label's label, so rounds grow with the logarithm of a component's
    diameter. Each round is a written table in the shared folder."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        sent = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("root").alias("root"))
        spread = written(labels.withColumn("old", F.col("root")).unionByName(sent.withColumn("old", F.lit(None).cast("long"))).groupBy("node").agg(F.min("root").alias("root"), F.max("old").alias("old")), "labels")
        jump = spread.alias("s").join(spread.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left")
        jumped = written(jump.select("node", F.least("root", "further").alias("root"), "old"), "labels")
        changed = jumped.where("root <> old").limit(1).count()
        forget(labels, spread)
        labels = jumped
        if not changed:
            forget(both)
            return labels.select("node", "root")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """What :func:`components` gives with more ``links`` (a, b) than those of its result ``roots``: only the roots that they join are gone over."""
    first, second = (roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}r")) for c in ("a", "b"))
    between = links.join(first, "a", "left").join(second, "b", "left").select(F.coalesce("ar", "a").alias("a"), F.coalesce("br", "b").alias("b"))
    joined = components(between.where("a <> b").distinct())
    old = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    return written(old.unionByName(joined.join(roots, "node", "left_anti")), "roots")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, simhash, component): component is the smallest key reachable through links of up to three differing bits."""
    hashed = written(fingerprints(docs.select(key, text), text, width), "simhash")
    nodes = written(hashed.groupBy("simhash").agg(F.min(key).alias("first")), "nodes")
    roots = components(links(nodes))
    named = nodes.join(roots.withColumnRenamed("node", "simhash"), "simhash", "left").withColumn("root", F.coalesce("root", "simhash"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component"))
    classes = named.join(smallest, "root").select("simhash", "component")
    return hashed.join(classes, "simhash").select(key, "simhash", "component")


# ---- fingerprints for a similarity of 0.8

LONG = 512
FAR = 58
SIMILAR = 0.8
SHINGLE = 5
_NEAR = (1 - 0.1515) ** 8  # that a positional byte is shared at similarity 0.8
_MULTIPLIER, _FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_WORDS = LONG // 64
_NAMES = [f"f{i}" for i in range(_WORDS)]
_COMPARED = _NAMES[:4]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _FIRST
    x = (x ^ (x >> np.uint64(27))) * _SECOND
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: dict[bytes, int]) -> np.ndarray:
    """Hashes of the distinct five-word shingles of a text; ``hashes`` keeps those of words."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    words = np.array([hashes.get(w) or hashes.setdefault(w, xxhash.xxh64_intdigest(w, SEED)) for w in found], np.uint64)
    n = min(SHINGLE, len(words))
    out = words[: len(words) - n + 1]
    for k in range(1, n):
        out = out * _MULTIPLIER + words[k : len(words) - n + 1 + k]
    return np.unique(_mixed(out))


def long_fingerprint(found: np.ndarray) -> np.ndarray:
    """``LONG`` bits of a set of shingles: 1 if set in more than half of them; the least shingle decides where it is half."""
    if not len(found):
        return np.zeros(_WORDS, np.uint64)
    total = np.zeros(LONG, np.int64)
    seeds = np.arange(1, _WORDS + 1, dtype=np.uint64) * _MULTIPLIER
    place = np.arange(LONG // 8) * 256
    for low in range(0, len(found), _BLOCK):
        spread = _mixed(found[low : low + _BLOCK, None] ^ seeds)
        counts = np.bincount((spread.view(np.uint8).reshape(-1, LONG // 8) + place).ravel(), minlength=len(place) * 256)
        total += (counts.reshape(-1, 256) @ _BITS).ravel()
    least = np.unpackbits(_mixed(found[:1] ^ seeds).view(np.uint8), bitorder="little")
    return np.packbits(np.where(total * 2 == len(found), least, total * 2 > len(found)).astype(np.uint8), bitorder="little").view(np.uint64)


def long_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` but with the long fingerprint's words as signed longs."""

    def run(batches):
        hashes: dict[bytes, int] = {}
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                out.append(long_fingerprint(shingles(t, hashes)))
                if len(hashes) > 500_000:
                    hashes.clear()
            words = np.array(out, np.uint64).reshape(-1, _WORDS).view(np.int64)
            yield pa.record_batch([*batch.columns[1:], *(pa.array(np.ascontiguousarray(w)) for w in words.T)], names=[*batch.schema.names[1:], *_NAMES])

    keep = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(F.col(text).alias("__text"), *keep).mapInArrow(run, ", ".join([schema, *(f"{c} long" for c in _NAMES)]))


def key_sets(count: int, missed: float = 0.02) -> np.ndarray:
    """Sets of positions whose bytes together are a key, for ``count`` fingerprints: a pair at similarity 0.8 shares none of them
    with probability ``missed``. Sets have as many positions as keep lists of unrelated fingerprints short."""
    size, places = min(max(2, -(-(max(count, 1).bit_length() - 4) // 8)), 5), LONG // 8
    shared = [(comb(places, t) * _NEAR**t * (1 - _NEAR) ** (places - t), comb(t, size) / comb(places, size)) for t in range(places + 1)]
    number = 1
    while sum(p * (1 - hit) ** number for p, hit in shared) > missed:
        number += 1 + number // 20
    rng, out = np.random.default_rng(SEED), []
    while len(out) < number:  # permutations cut into sets: every position is used equally often
        turn = rng.permutation(places)
        out += [np.sort(turn[i : i + size]) for i in range(0, places - size + 1, size)]
    return np.array(out[:number])


def _near_edges(ids: np.ndarray, prints: np.ndarray):
    """Edges (id, id) of all near fingerprints of one key."""
    for i in range(len(ids) - 1):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]).sum(axis=1) <= FAR).tolist():
            yield min(ids[i], ids[i + 1 + j]), max(ids[i], ids[i + 1 + j])


def similar_links(nodes: DataFrame, count: int) -> DataFrame:
    """Distinct edges (a, b), a < b, between ``nodes`` (node, f0, f1, ...) that share a key and differ in ``FAR`` bits or fewer."""
    sets = key_sets(count)

    def post(batches):
        for batch in batches:
            prints = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
            parts = np.ascontiguousarray(prints).view(np.uint8).astype(np.int64)
            for k, chosen in enumerate(sets):
                key = np.zeros(len(prints), np.int64)
                for p in chosen:
                    key = key << 8 | parts[:, p]
                yield pa.record_batch([pa.array(key << 12 | k), *batch.columns[: 1 + len(_COMPARED)]], names=["key", "node", *_COMPARED])

    def verify(batches):
        held: list[pa.RecordBatch] = []

        def edges(keys: np.ndarray, ids: np.ndarray, prints: np.ndarray):
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            for i in np.flatnonzero(np.diff(bounds) > 1).tolist():
                low, high = bounds[i], bounds[i + 1]
                yield from _near_edges(ids[low:high], prints[low:high])

        def pack(table: pa.Table):
            columns = [c.to_numpy() for c in table.columns]
            found = list(edges(columns[0], columns[1], np.stack(columns[2:], axis=1).view(np.uint64))) if table.num_rows else []
            a, b = zip(*found) if found else ((), ())
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = batch.column(0)[-1].as_py()
            if batch.column(0)[0].as_py() == last:
                continue  # one run goes on through the whole batch
            table = pa.Table.from_batches(held)
            keys = table["key"].to_numpy()
            stop = int(np.flatnonzero(keys != last)[-1]) + 1
            yield pack(table.slice(0, stop))
            held = table.slice(stop).to_batches()
        if held:
            yield pack(pa.Table.from_batches(held))

    kinds = "".join(f", {c} long" for c in _COMPARED)
    posted = nodes.select("node", *_NAMES).mapInArrow(post, f"key long, node long{kinds}")
    return posted.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long").distinct()


# ---- links at a similarity of 0.8 through prefixes

SAMPLED = 5_000  # documents at least, and one in ``ONE_IN``, tell the frequent shingles
ONE_IN = 20
FREQUENT = 200_000  # that are put in order; the order decides how long lists are, not what is found
_KEPT = 100_000  # hashes of words that a worker keeps
REACHES = (16, 128, None)  # neighbours in a list that are verified in turn; None: all


def _forgetting(hashes: dict) -> dict:
    if len(hashes) > _KEPT:
        hashes.clear()
    return hashes


def frequent(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts): what three or more of a sample of different texts share, by shingle."""

    def run(batches):
        hashes: dict[bytes, int] = {}
        for batch in batches:
            for t in batch.column(0):
                yield pa.record_batch([pa.array(shingles(t.as_py(), _forgetting(hashes)).view(np.int64))], names=["shingle"])

    one_in = min(ONE_IN, max(1, docs.count() // SAMPLED))
    sampled = docs.select(F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("h")).where(F.pmod("h", F.lit(one_in)) == 0).dropDuplicates(["h"])
    counted = sampled.select("t").mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n >= 3")
    rows = counted.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    found, counts = rows["shingle"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(found)
    return found[order], counts[order]


def prefix(found: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first of a set's shingles in the order of (count among the frequent, shingle): any two similar sets share one of theirs."""
    known, counts = often
    first = len(found) - -(-4 * len(found) // 5) + 1 if len(found) else 0
    if not len(known):
        return found[:first]
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    return found[np.argsort(np.where(known[at] == found, counts[at], 0), kind="stable")[:first]]


def marks(found: np.ndarray) -> bytes:
    """A bit for each shingle's low hash bits, flipped by every shingle that has them; the halves of longer marks add up to shorter ones."""
    bits = max(64, 1 << (len(found) - 1).bit_length()) if len(found) else 64
    return np.packbits((np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """In how many shingles the sets of two marks differ at least."""
    if len(x) < len(y):
        x, y = y, x
    value, size = int.from_bytes(x, "little"), len(x)
    while size > len(y):
        size //= 2
        value = value >> 8 * size ^ value & (1 << 8 * size) - 1
    return (value ^ int.from_bytes(y, "little")).bit_count()


def prefixes(docs: DataFrame, often, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` but with ``node`` (hash of the set of shingles), ``size``, ``marks`` and ``prefix``."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches):
        hashes: dict[bytes, int] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                found = [shingles(t, _forgetting(hashes)) for t in part.column(0).to_pylist()]
                node = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in found], np.uint64).view(np.int64)
                firsts = [prefix(x, shared.value) for x in found]
                lists = list_array(np.concatenate([np.empty(0, np.uint64), *firsts]).view(np.int64), [len(x) for x in firsts], pa.int64())
                yield pa.record_batch([*part.columns[1:], pa.array(node), pa.array([len(x) for x in found], pa.int32()), pa.array([marks(x) for x in found], pa.binary()), lists], names=[*batch.schema.names[1:], "node", "size", "marks", "prefix"])

    keep = [c for c in docs.columns if c != text]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return docs.select(F.col(text).alias("__text"), *keep).mapInArrow(run, f"{schema}node long, size int, marks binary, prefix array<long>")


def _runs(batches):
    """Columns of whole runs of equal values in the first column, many runs at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = batch.column(0)[-1].as_py()
        if batch.column(0)[0].as_py() == last and len(held) > 1:
            continue  # one run goes on through the whole batch
        table = pa.Table.from_batches(held)
        other = np.flatnonzero(table.column(0).to_numpy() != last)
        stop = int(other[-1]) + 1 if len(other) else 0
        if stop:
            yield [c.to_numpy() for c in table.slice(0, stop).columns]
        held = table.slice(stop).combine_chunks().to_batches()
    if held:
        yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]


def _room(sizes, places, others, their_places) -> np.ndarray:
    """Whether two sets can be similar that have their first common shingle at these places: what follows it has to do."""
    return 9 * np.minimum(sizes - places, others - their_places) >= 4 * (sizes + others)


def _beside(keys, nodes, sizes, places, labels, low: int, high: int):
    """Pairs of places at distances from ``low`` to ``high`` in one list that can be similar and have not one label."""
    for step in range(low, high + 1):
        x, y = slice(None, -step), slice(step, None)
        near = keys[x] == keys[y]
        if not near.any():
            return
        at = np.flatnonzero(near & (labels[x] != labels[y]) & _room(sizes[x], places[x], sizes[y], places[y]))
        if len(at):
            yield at, at + step


def _across(keys, nodes, sizes, places, labels, low: int):
    """The same at distances of ``low`` and more, whatever the length of a list: each that is not of its list's largest label with all others."""
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
    for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if stop - start <= low:
            continue
        own, size, place = labels[start:stop], sizes[start:stop], places[start:stop]
        found, counts = np.unique(own, return_counts=True)
        largest, turn = own == found[counts.argmax()], np.arange(stop - start)
        for i in np.flatnonzero(~largest).tolist():
            at = np.flatnonzero((own != own[i]) & (largest | (turn > i)) & (np.abs(turn - i) >= low) & _room(size[i], place[i], size, place))
            if len(at):
                yield np.full(len(at), start + i), start + at


def _pairs(found, nodes: np.ndarray):
    """Batches of the distinct pairs of nodes, the smaller first."""
    kept, count = [], 0

    def pack():
        both = np.concatenate([np.empty((2, 0), np.int64), *kept], axis=1)
        both = np.unique(np.sort(both, axis=0), axis=1)
        return [pa.array(both[0]), pa.array(both[1])]

    for x, y in found:
        kept.append(np.stack([nodes[x], nodes[y]]))
        count += len(x)
        if count > 500_000:
            yield pack()
            kept, count = [], 0
    yield pack()


def prefix_lists(nodes: DataFrame) -> DataFrame:
    """Of ``nodes`` (node, size, prefix) the candidates (a, b) that are neighbours in a list of the index, and the members (shingle, a: node,
    size, place) of the lists that are longer than that."""
    reach = REACHES[0]

    def run(batches):
        for keys, node, size, place in _runs(batches):
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            lengths = np.diff(np.append(np.flatnonzero(new), len(keys)))
            length = np.repeat(lengths, lengths)
            some = np.flatnonzero(length > 1)
            some = some[np.lexsort((node[some], size[some], keys[some]))]
            keys, node, size, place, length = keys[some], node[some], size[some].astype(np.int64), place[some].astype(np.int64), length[some]
            for a, b in _pairs(_beside(keys, node, size, place, node, 1, reach), node):
                none = pa.nulls(len(a), pa.int64())
                yield pa.record_batch([none, a, b, none, none], names=["shingle", "a", "b", "size", "place"])
            long = length > reach + 1
            yield pa.record_batch([pa.array(keys[long]), pa.array(node[long]), pa.nulls(int(long.sum()), pa.int64()), pa.array(size[long]), pa.array(place[long])], names=["shingle", "a", "b", "size", "place"])

    posted = nodes.select("node", "size", F.posexplode("prefix").alias("place", "shingle")).select("shingle", "node", "size", "place")
    return posted.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(run, "shingle long, a long, b long, size long, place long")


def _further(members: DataFrame, labels: DataFrame, low: int, high: int | None) -> DataFrame:
    """Candidates (a, b) of the long lists at distances from ``low`` to ``high`` that are not yet in one component."""

    def run(batches):
        for keys, node, size, place, label in _runs(batches):
            order = np.lexsort((node, size, keys))
            columns = [c[order] for c in (keys, node, size, place, label)]
            found = _beside(*columns, low, high) if high else _across(*columns, low)
            for a, b in _pairs(found, columns[1]):
                yield pa.record_batch([a, b], names=["a", "b"])

    named = members.join(labels, "node", "left").select("shingle", "node", "size", "place", F.coalesce("root", "node").alias("root"))
    return named.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(run, "a long, b long").distinct()


def _not_apart(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``edges`` (a, b) whose ``nodes`` (node, size, marks) can be similar: they differ in a ninth of both sizes at most."""

    def run(batches):
        for batch in batches:
            a, b, sizes, x, y = batch.columns
            near = [9 * apart(v, w) <= n for v, w, n in zip(x.to_pylist(), y.to_pylist(), sizes.to_pylist())]
            yield pa.record_batch([a, b], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    first, second = (nodes.select(F.col("node").alias(c), F.col("size").alias(f"{c}n"), F.col("marks").alias(f"{c}m")) for c in ("a", "b"))
    return edges.join(first, "a").join(second, "b").select("a", "b", (F.col("an") + F.col("bn")).alias("n"), "am", "bm").mapInArrow(run, "a long, b long")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, shingles) of ``texts`` (node, text)."""

    def run(batches):
        hashes: dict[bytes, int] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                found = [shingles(t, _forgetting(hashes)) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), list_array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64), [len(x) for x in found], pa.int64())], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>")


def _similar_sets(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``edges`` (a, b) whose ``sets`` (node, shingles) are similar."""
    first, second = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}s")) for c in ("a", "b"))
    common = F.size(F.array_intersect("as", "bs"))
    return edges.join(first, "a").join(second, "b").where(common >= SIMILAR * (F.size("as") + F.size("bs") - common)).select("a", "b")


def verified(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``edges`` (a, b) whose ``texts`` (node, text) have at least ``SIMILAR`` of their five-word shingles in common."""
    return _similar_sets(edges, written(shingle_sets(texts), "shingles"))


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, root, component) of every row: component is the smallest key reachable through links at similarity 0.8;
    root tells components apart that hold different texts of one key."""
    spark = docs.sparkSession
    asked = docs.select(text, F.col(key).alias("__key"), F.xxhash64(F.col(text)).alias("__hash"))
    wide = written(prefixes(asked, frequent(docs, text), text), "prefixes")
    kept = ("size", "marks", "prefix")
    index = written(wide.groupBy("node").agg(F.min("__key").alias("first"), F.min(F.struct("__key", "__hash")).alias("row"), *(F.first(c).alias(c) for c in kept)), "index")
    lists = written(prefix_lists(index), "lists")
    hashed, nodes = written(wide.drop(*kept), "hashes"), written(index.drop("prefix"), "nodes")
    forget(wide, index)
    release(spark)  # the index and its shuffle can go before the texts come
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))

    def linked(candidates: DataFrame) -> DataFrame:
        near = written(_not_apart(candidates, nodes), "near")
        met = written(near.select(F.col("a").alias("node")).union(near.select("b")).distinct().join(nodes.select("node", "row.*"), "node"), "met")
        same = texts["k"].eqNullSafe(met["__key"]) & (texts["h"] == met["__hash"])
        sets = written(shingle_sets(texts.join(met, same).select("node", "text").dropDuplicates(["node"])), "shingles")
        release(spark)
        out = written(_similar_sets(near, sets), "links")
        forget(near, met, sets)
        return out

    roots = components(linked(lists.where("shingle is null").select("a", "b").distinct()))
    members = lists.where("shingle is not null").select("shingle", F.col("a").alias("node"), "size", "place")
    for low, high in zip(REACHES, REACHES[1:]) if not members.isEmpty() else ():
        further = written(_further(members, roots, low + 1, high), "further")
        if not further.isEmpty():
            roots = merged(roots, linked(further))
        forget(further)
    forget(lists)
    release(spark)
    named = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component"))
    classes = named.join(smallest, "root").select("node", "root", "component")
    rows = hashed.select(F.col("__key").alias(key), F.col("__hash").alias("text_hash"), "node")
    return rows.join(classes, "node").select(key, "text_hash", "root", "component")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near copies (five-word shingles, similarity 0.8): of each group the row with the smallest key stays.

    If different texts of one group share that key, the one with the smallest hash stays; a repeated row stays once. Rows with a null key stay."""
    known = docs.where(F.col(key).isNotNull())
    found = written(similar(known, key, text), "classes")
    chosen = found.where(F.col(key) == F.col("component")).groupBy(F.col(key).alias("__k"), "root").agg(F.min("text_hash").alias("__h"))
    columns = [F.col(c) for c in docs.columns]
    kept = known.withColumn("__th", F.xxhash64(F.col(text))).join(chosen, (F.col(key) == F.col("__k")) & (F.col("__th") == F.col("__h")), "left_semi")
    if not found.groupBy(key, "text_hash").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([key, "__th"])
    return kept.select(*columns).unionByName(docs.where(F.col(key).isNull()).select(*columns))


def op1(spark, docs: DataFrame) -> DataFrame:
    """The contract's result: doc_id, fingerprint (16 hex digits), component_id."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
