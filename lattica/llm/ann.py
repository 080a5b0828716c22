"""Approximate nearest neighbours by cross-polytope hashing, with multiprobe and exact reranking.

A cross-polytope hash turns unit vectors by a pseudo-rotation (three rounds of random signs and a fast Hadamard transform) and
assigns them to the nearest signed axis. Each of ``TABLES`` tables composes several such hashes, the last one over as many axes
as bring its cells to about ``CELL`` vectors: the number of cells grows with that of the vectors, and the share of
the corpus that a query meets falls. A query probes the cells whose axes are nearest to it together. All candidates met are
ranked by their inner product in double precision. Vectors of unequal lengths are hashed with one more coordinate that makes
them unit vectors, so that nearness is still the inner product.

How many cells are probed is fitted: for ``FITTED`` queries, chosen by hash, the true neighbours are found in one scan of all
vectors, and the number of probes is the least with which ``RECALL`` of them lie in a probed cell. A query that has met
fewer vectors than asked for is compared with all of them, in blocks of ``EXACT`` queries a scan.

Work is dealt by (table, all axes but the last, block of candidates, block of queries); a query is sent once to such a group
with the last axes it probes there. Groups of more than ``BLOCK`` candidates or ``QUERIES`` queries are split, however many
vectors share their cells. Equal vectors are one candidate: of a group of copies only the ids that can be among the results, the
smallest ``count`` + 1, are looked up again.

Only the sample and its neighbours go through the driver.

Edge cases: vectors that are null or zero, or hold a null or non-finite component, take no part, as query or candidate; rows
with a null id neither; vectors of different dimensions have no inner product, so each dimension is searched by itself;
repeated rows (same id and vector) are one candidate; several vectors of one id are separate candidates and queries share
that id's results; ties go to the smaller id; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import broadcast_if_small, list_array, written

TABLES = 8
CELL = 6
RECALL = 0.94
FITTED = 128
MOST = 4096
BLOCK = 8192
QUERIES = 4096
EXACT = 4096
SEED = 7
_PAIRS = 200_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows of ``x`` (their length a power of two), orthonormal."""
    rows, n = x.shape
    step = 1
    while step < n:
        pairs = x.reshape(rows, -1, 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, n)
        step *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """The pseudo-rotation of one table, after padding to a power of two."""
    width = 1 << max(x.shape[1] - 1, 1).bit_length()
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = np.random.default_rng([seed, table])
    for _ in range(3):
        x = hadamard(x * signs.choice([-1.0, 1.0], width))
    return x


def matrix(column) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Unit vectors to hash; ``longest`` > 0 asks for the further coordinate."""
    if not longest:
        return x / np.linalg.norm(x, axis=1, keepdims=True)
    if query:
        return np.pad(x / np.linalg.norm(x, axis=1, keepdims=True), ((0, 0), (0, 1)))
    x = x / longest
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(axis=1, keepdims=True)))], axis=1)


def axes(count: int, width: int) -> list[int]:
    """The axes of each hash of a table for ``count`` vectors, in rotations of ``width`` coordinates."""
    wanted, out = max(count / CELL, 2.0), []
    while wanted > 1.5 or not out:
        out.append(min(width, 1 << max(round(np.log2(wanted / 2)), 0)))
        wanted /= 2 * out[-1]
    return out


def _signed(x: np.ndarray, table: int, part: int, n: int) -> np.ndarray:
    """How near each row is to the first ``n`` axes of one hash, and to their opposites."""
    turned = rotate(x, table * 64 + part)[:, :n]
    return np.concatenate([turned, -turned], axis=1)


def cells(x: np.ndarray, table: int, parts: list[int]) -> np.ndarray:
    """The cell of each row: the numbers of its nearest axes, as one number."""
    out = np.zeros(len(x), np.int64)
    for part, n in enumerate(parts):
        out = out * (2 * n) + _signed(x, table, part, n).argmax(axis=1)
    return out


def probes(x: np.ndarray, table: int, parts: list[int], count: int) -> np.ndarray:
    """The cells that each row probes, nearest first: by the sum of its nearness to their axes."""
    near, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for part, n in enumerate(parts):
        signed = _signed(x, table, part, n)
        best = np.argsort(-signed, axis=1, kind="stable")[:, : max(count, 1)]
        near = (near[:, :, None] + np.take_along_axis(signed, best, 1)[:, None, :]).reshape(len(x), -1)
        code = (code[:, :, None] * (2 * n) + best[:, None, :]).reshape(len(x), -1)
        keep = np.argsort(-near, axis=1, kind="stable")[:, :count]
        near, code = np.take_along_axis(near, keep, 1), np.take_along_axis(code, keep, 1)
    return code


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best, best first, ties to the smaller id."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((ids[some], -scores[some]))][:k]
    return np.lexsort((ids, -scores))[:k]


def exact(queries: DataFrame, index: DataFrame, count: int) -> DataFrame:
    """(query, id, score): the ``count`` nearest of ``index`` (id, embedding) to each of ``queries``, against all; ``EXACT`` queries a scan."""
    spark = queries.sparkSession
    rows = queries.select("id", "embedding").orderBy("id")
    out = spark.createDataFrame([], "query long, id long, score double")
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    low = None
    while True:
        block = (rows if low is None else rows.where(F.col("id") > low)).limit(EXACT).toArrow()
        if not block.num_rows:
            return out
        low = block["id"].to_numpy().max()
        shared = spark.sparkContext.broadcast((block["id"].to_numpy(), matrix(block["embedding"].combine_chunks())))

        def run(batches, shared=shared):
            q_ids, q = shared.value
            kept_ids, kept = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
            for batch in batches:
                if batch.num_rows:
                    ids, c = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
                    for at in range(0, len(ids), 1024):
                        scores = np.einsum("qd,cd->qc", q, c[at : at + 1024])
                        kept_ids = np.concatenate([kept_ids, np.broadcast_to(ids[at : at + 1024], scores.shape)], axis=1)
                        kept = np.concatenate([kept, scores], axis=1)
                        best = np.stack([_top(i, s, min(count, kept.shape[1])) for i, s in zip(kept_ids, kept)])
                        kept_ids, kept = np.take_along_axis(kept_ids, best, 1), np.take_along_axis(kept, best, 1)
            n = kept.shape[1]
            yield pa.record_batch([pa.array(np.repeat(q_ids, n)), pa.array(kept_ids.ravel()), pa.array(kept.ravel())], names=["query", "id", "score"])

        found = index.select("id", "embedding").mapInArrow(run, "query long, id long, score double")
        out = out.union(written(found.withColumn("n", F.row_number().over(nearest)).where(f"n <= {count}").drop("n"), "exact"))


def fitted(queries: DataFrame, index: DataFrame, count: int, tables: int, parts: list[int], longest: float) -> int:
    """The number of probes with which ``RECALL`` of the true neighbours of a sample of ``queries`` lie in a probed cell."""
    sample = written(queries.orderBy(F.xxhash64("id"), "id").limit(FITTED), "sample")
    true = written(exact(sample, index, count).where("query <> id"), "true")
    asked = sample.select("id", "embedding").toArrow()
    met = true.join(index, "id").select("query", "embedding").toArrow()  # at most FITTED * count
    if not met.num_rows:
        return 1
    row = {int(i): n for n, i in enumerate(asked["id"].to_pylist())}
    q, c = (unit(matrix(x["embedding"].combine_chunks()), longest, query) for x, query in ((asked, True), (met, False)))
    of = np.array([row[int(i)] for i in met["query"].to_pylist()])
    most = int(min(MOST, np.prod([2 * n for n in parts], dtype=float)))
    need = np.full(len(c), most)
    for t in range(tables):
        order, own = probes(q, t, parts, most), cells(c, t, parts)
        for low in range(0, len(c), 256):
            hit = order[of[low : low + 256]] == own[low : low + 256, None]
            at = np.where(hit.any(axis=1), hit.argmax(axis=1), most)
            need[low : low + 256] = np.minimum(need[low : low + 256], at)
    return min(int(np.quantile(need, RECALL, method="higher")) + 1, most)


def search(queries: DataFrame, index: DataFrame, count: int, tables: int = TABLES) -> DataFrame:
    """(query, id, score): the ``count`` ids of ``index`` (id, embedding) found nearest to each of ``queries``; distinct vectors of one dimension."""
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, b: a + b.cast("double") * b))
    facts = index.agg(F.max(length).alias("longest"), F.min(length).alias("shortest"), F.max(F.size("embedding")).alias("d"), F.count("*").alias("n")).first()
    if facts["d"] is None:
        return queries.sparkSession.createDataFrame([], "query long, id long, score double")
    longest = facts["longest"] if facts["longest"] > facts["shortest"] * (1 + 1e-5) else 0.0
    parts = axes(facts["n"], 1 << max(facts["d"] + bool(longest) - 1, 1).bit_length())
    probed = fitted(queries, index, count, tables, parts, longest)
    kind = index.schema["embedding"].dataType.elementType.simpleString()
    arrow = {"float": pa.float32(), "double": pa.float64()}[kind]
    last = 2 * parts[-1]

    def placed(x: np.ndarray, query: bool):
        """(table, group, row, last axes, number of them) of each row in each of its groups."""
        u = unit(x, longest, query)
        for t in range(tables):
            if query:
                code = np.sort(probes(u, t, parts, probed), axis=1)
                row = np.repeat(np.arange(len(x)), code.shape[1])
                code = code.ravel()
                first = np.flatnonzero((np.diff(code // last, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
                yield t, code[first] // last, row[first], code % last, np.diff(np.append(first, len(code)))
            else:
                code = cells(u, t, parts)
                yield t, code // last, np.arange(len(x)), code % last, np.ones(len(x), np.int64)

    def sizes(query: bool):
        def run(batches):
            for batch in batches:
                for low in range(0, batch.num_rows, 512):
                    for t, group, *_ in placed(matrix(batch.column(0).slice(low, 512)), query):
                        which, n = np.unique(group, return_counts=True)
                        yield pa.record_batch([pa.array(np.full(len(n), t, np.int32)), pa.array(which), pa.array(n)], names=["t", "cell", "n"])

        return run

    def deal(query: bool):
        def run(batches):
            for batch in batches:
                for low in range(0, batch.num_rows, 512):
                    part = batch.slice(low, 512)
                    ids, x = part.column(0).to_numpy(zero_copy_only=False), matrix(part.column(1))
                    for t, group, row, ends, n in placed(x, query):
                        yield pa.record_batch(
                            [pa.array(np.full(len(row), t, np.int32)), pa.array(group), pa.array(np.full(len(row), query)), pa.array(ids[row]), list_array(ends.astype(np.int32), n, pa.int32()), list_array(x[row].reshape(-1), np.full(len(row), x.shape[1]), arrow)],
                            names=["t", "cell", "query", "id", "ends", "embedding"],
                        )

        return run

    def rank(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        x, ids, query = matrix(group["embedding"].combine_chunks()), group["id"].to_numpy(), group["query"].to_numpy(zero_copy_only=False)
        ends = group["ends"].combine_chunks()
        own, sizes_ = ends.flatten().to_numpy(), np.diff(ends.offsets.to_numpy())
        by_row = np.repeat(np.arange(len(ids)), sizes_)
        c = np.flatnonzero(~query)
        c = c[np.argsort(own[~query[by_row]], kind="stable")]
        c_end = own[~query[by_row]]
        c_end = np.sort(c_end, kind="stable")
        asking, wanted = by_row[query[by_row]], own[query[by_row]]
        start, stop = np.searchsorted(c_end, wanted), np.searchsorted(c_end, wanted, "right")
        out: list[list[np.ndarray]] = [[], [], []]
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(asking)) + 1, [len(asking)]]) if len(asking) else np.zeros(1, np.int64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            at = np.concatenate([c[i:j] for i, j in zip(start[a:b].tolist(), stop[a:b].tolist())])
            if len(at):
                scores = (x[at] * x[asking[a]]).sum(axis=1)
                best = _top(ids[at], scores, count)
                out[0].append(np.full(len(best), ids[asking[a]]))
                out[1].append(ids[at[best]])
                out[2].append(scores[best])
        joined = [np.concatenate(o) if o else np.empty(0) for o in out]
        return pa.table({n: pa.array(o, k) for n, o, k in zip(("query", "id", "score"), joined, (pa.int64(), pa.int64(), pa.float64()))})

    held, asked = (frame.select("embedding").mapInArrow(sizes(query), "t int, cell long, n long").groupBy("t", "cell").agg(F.sum("n").alias("n")) for frame, query in ((index, False), (queries, True)))
    hot = held.where(f"n > {BLOCK}").select("t", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("cbs"), F.lit(1).alias("qbs")).union(asked.where(f"n > {QUERIES}").select("t", "cell", F.lit(1).alias("cbs"), F.ceil(F.col("n") / QUERIES).cast("int").alias("qbs")))
    hot = broadcast_if_small(written(hot.groupBy("t", "cell").agg(F.max("cbs").alias("cbs"), F.max("qbs").alias("qbs")), "hot"))

    def split(dealt: DataFrame, own: str, other: str, own_count: str, other_count: str) -> DataFrame:
        """Each row in one block of its own kind and all blocks of the other."""
        known = dealt.join(hot, ["t", "cell"], "left")
        placed_ = known.withColumn(own, F.pmod(F.xxhash64("id"), F.coalesce(own_count, F.lit(1))).cast("int"))
        return placed_.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(other_count, F.lit(1)) - 1))).select("t", "cell", "cb", "qb", "query", "id", "ends", "embedding")

    schema = f"t int, cell long, query boolean, id long, ends array<int>, embedding array<{kind}>"
    candidates = split(index.select("id", "embedding").mapInArrow(deal(False), schema), "cb", "qb", "cbs", "qbs")
    wanted = split(queries.select("id", "embedding").mapInArrow(deal(True), schema), "qb", "cb", "qbs", "cbs")
    met = candidates.union(wanted).groupBy("t", "cell", "cb", "qb").applyInArrow(rank, "query long, id long, score double")
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    # a pair is met in each table at most once: the first count * tables rows hold the first count pairs
    some = met.withColumn("n", F.row_number().over(nearest)).where(f"n <= {count * tables}").drop("n").dropDuplicates(["query", "id"])
    found = written(some.withColumn("n", F.row_number().over(nearest)).where(f"n <= {count}").select("query", "id", "score"), "found")
    full = found.groupBy("query").agg(F.count("*").alias("n")).where(f"n >= {min(count, facts['n'])}").select(F.col("query").alias("id"))
    short = written(queries.join(full, "id", "left_anti").select("id", "embedding"), "short")
    if short.isEmpty():
        return found
    return found.join(short.select(F.col("id").alias("query")), "query", "left_anti").union(exact(short, index, count).select("query", "id", "score"))


def nearest(vectors: DataFrame, every: int, count: int, tables: int = TABLES) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries, the rows of ``vectors`` (vec_id, embedding) whose id ``every`` divides."""
    fit = F.expr("vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)")
    kind = "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    plain = vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("embedding")).where(fit)
    rows = plain.withColumn("d", F.size("embedding")).withColumn("a", F.xxhash64("embedding")).withColumn("b", F.xxhash64(F.lit(1), "embedding"))
    copies = Window.partitionBy("d", "a", "b").orderBy("vec_id")
    kept = written(rows.withColumn("n", F.row_number().over(copies)).where(f"n <= {count + 1}").select("d", "a", "b", "n", "vec_id", F.when(F.col("n") == 1, F.col("embedding")).alias("embedding")), "vectors")
    first = kept.where("n = 1").select("d", "a", "b", F.col("vec_id").alias("id0"), "embedding")
    first = written(first.withColumn("id", F.monotonically_increasing_id()), "distinct")
    names = first.select("d", "a", "b", "id")
    asking = written(rows.where(F.col("vec_id") % every == 0).select("d", "a", "b", F.col("vec_id").alias("query_id")).distinct().join(names, ["d", "a", "b"]).select("query_id", F.col("id").alias("query")), "queries")
    wanted = first.join(asking.select(F.col("query").alias("id")).distinct(), "id", "left_semi").select("id", "embedding", "d")
    hits = vectors.sparkSession.createDataFrame([], "query long, id long, score double")
    for r in first.groupBy("d").count().orderBy("d").collect():  # dimensions are few
        hits = hits.union(search(wanted.where(F.col("d") == r["d"]), first.where(F.col("d") == r["d"]).select("id", "embedding"), count + 1, tables))
    members = kept.select("d", "a", "b", "vec_id").distinct().join(names, ["d", "a", "b"]).select("id", "vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = asking.join(hits, "query").join(members, "id").where("vec_id <> query_id").select("query_id", "vec_id", "score").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {count}").select("query_id", "rank", "vec_id", "score")


def op2(vectors: DataFrame) -> DataFrame:
    """The contract's result: the 20 nearest found of every vector whose id 20 divides."""
    return nearest(vectors, every=20, count=20)
