"""Language-model scores by deleted interpolation of word trigrams, bigrams and unigrams.

The model mixes maximum-likelihood estimates of the next token from the two tokens before it, the one before it, its own
frequency, and a uniform one over the vocabulary and one unseen word:

    P(w | g h) = a * c(g h w) / c(g h)  +  b * c(h w) / c(h)  +  d * c(w) / N  +  u / (V + 1)

The weights (a, b, d, u) depend on the frequency of the longest context that was seen, in buckets of doublings, and are
learned by expectation-maximisation: counts of one part of the training documents are interpolated to explain another part
(that held-out part is a seventh of the ids), then both parts are counted together. A text begins after two ends.

Counts cover all n-grams of all training documents and are never collected. A word is known by a hash of 62 bits, a longer n-gram by one
of ``SPARE`` bits more than the number of n-grams has, so that not one in ten thousand shares its key. The corpus is cut into
chunks of ``CHUNK`` bytes of text, each kept as one compressed row. Each chunk sends its distinct keys, sorted and as
differences, with its own counts to the buckets of the key space; a bucket adds the counts of all chunks up and sends each
chunk the totals of its keys, in the order in which the chunk asked. The chunk then meets its totals and is scored. So every shuffled row holds many n-grams, a frequent n-gram is one
entry per chunk, and a task holds a bucket or a chunk, whatever the size of the corpus. For the weights the same is done with the
held-out chunks alone: their tokens are counted by (context bucket, binned probabilities), a table whose size no corpus
exceeds, and that table alone goes to the driver.

Edge cases: null and wordless texts have one token, the end; with nothing to learn from, N = V = 0, every probability is
1 (both scores are 0); very long texts are scored whole (a chunk holds at least one text); repeated rows are scored each, and
count each in training; a null id belongs to no fold, and its text is learned from; an empty table gives an empty table;
further columns are ignored.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lattica.llm.common import fold, release, written

ORDER = 3
CHUNK = 6 << 20
BUCKET = 4_000_000
FEWER = 4  # buckets of single words: a chunk has few different ones
BUCKETS = 24
SPARE = 14
WIDE = 62
BINS = 4  # to a power of ten
END = b" "  # no word holds a blank
_FOLD, _OUT, _HELD = 7, 2, 5
_MAIN_ROW, _HELD_ROW, _OUT_ROW = 0, 1, 2


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased, cut at ASCII white space, and one end."""
    out = text.lower().split()
    out.append(END)
    return out


class Ids(dict):
    """A new number for each token that is not there."""

    def __missing__(self, token: bytes) -> int:
        self[token] = n = len(self)
        return n


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """Texts of one chunk as arrays: for each order the sorted distinct keys, and the place of each token's n-gram among them."""

    def __init__(self, texts: list[bytes], widths: list[int]):
        ids = Ids()
        get = ids.__getitem__
        parts = [np.fromiter(map(get, found := tokens(t)), np.int32, len(found)) for t in texts]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        at = np.concatenate(parts) if parts else np.empty(0, np.int32)
        names = np.array([xxhash.xxh64_intdigest(w) for w in ids], np.uint64)
        end = np.uint64(xxhash.xxh64_intdigest(END))
        word = names[at] if len(at) else np.empty(0, np.uint64)
        first = np.cumsum(self.sizes) - self.sizes
        self.first = first
        hashes, blank = [word], np.array([end])
        for _ in range(1, ORDER):  # an n-gram is the one of order n - 1 that ends before its last word, and that word
            before = np.empty_like(word)
            before[1:] = hashes[-1][:-1]
            before[first] = blank
            hashes.append(_mixed(before * np.uint64(3) + word))
            blank = _mixed(blank * np.uint64(3) + end)
        self.keys, self.places = [], []
        for n, h in enumerate(hashes):
            key = _mixed(h + np.uint64(n)) >> np.uint64(64 - widths[n])
            turn = np.argsort(key)
            ordered = key[turn]
            new = np.ones(len(key), bool)
            new[1:] = ordered[1:] != ordered[:-1]
            place = np.empty(len(key), np.int32)
            place[turn] = np.cumsum(new) - 1
            self.keys.append(ordered[new])
            self.places.append(place)

    def counted(self, learned: np.ndarray) -> list[np.ndarray]:
        """The counts of the keys of each order; ``learned`` says of each text whether it counts."""
        weight = np.repeat(learned, self.sizes)
        return [np.bincount(p[weight], minlength=len(k)) for k, p in zip(self.keys, self.places)]

    def known(self, totals: list[np.ndarray], ends: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(count of each token's n-gram, count of its context), by order from 1; ``ends`` is the count of the end."""
        counts = [t[p] for t, p in zip(totals, self.places)]
        contexts = [None]
        for c in counts[:-1]:
            context = np.empty_like(c)
            context[1:] = c[:-1]
            context[self.first] = ends
            contexts.append(context)
        return counts, contexts


def _packed(values: np.ndarray) -> bytes:
    """Numbers in the narrowest width that holds them, and the width."""
    most = int(values.max(initial=0))
    kind = next(k for k in "1248" if most < 1 << 8 * int(k))
    return kind.encode() + values.astype(f"<u{kind}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{chr(data[0])}", offset=1)


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers byte by byte: the lowest bytes of all, the next ones, ...; the upper ones say little and shrink."""
    most = int(values.max(initial=0))
    n = max(1, -(-most.bit_length() // 8))
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T)
    low = max(n - 2, 1)
    return bytes([n, low]) + planes[:low].tobytes() + (zstandard.compress(planes[low:].tobytes(), 3) if low < n else b"")


def _unplaned(data: bytes, count: int) -> np.ndarray:
    n, low = data[0], data[1]
    planes = np.zeros((8, count), np.uint8)
    planes[:low] = np.frombuffer(data, np.uint8, low * count, 2).reshape(low, count)
    if low < n:
        planes[low:n] = np.frombuffer(zstandard.decompress(data[2 + low * count :]), np.uint8).reshape(n - low, count)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(count)


def _joined(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(8, "little") + a + b


def _parted(data: bytes) -> tuple[bytes, bytes]:
    size = int.from_bytes(data[:8], "little")
    return data[8 : 8 + size], data[8 + size :]


def edges(width: int, buckets: int) -> np.ndarray:
    """The first key of each bucket but the first."""
    return np.array([-(-(b << width) // buckets) for b in range(1, buckets)], np.uint64)


def layout(size: int) -> tuple[list[int], list[int]]:
    """Bits of the keys and number of buckets, by order, for ``size`` bytes of text. Every chunk has a row for every bucket: rows grow with the
    square of the corpus, and are kept few by buckets as large as a task can hold."""
    grams = ORDER * (size // 6 + 1)  # about as many
    buckets = max(1, grams // BUCKET)
    return [WIDE, *[min(grams.bit_length() + SPARE, WIDE)] * (ORDER - 1)], [-(-buckets // FEWER), *[buckets] * (ORDER - 1)]


def _chunked(docs: DataFrame, key: str, role) -> DataFrame:
    """(chunk, keys, roles, sizes, texts, bytes): one row a chunk; odd ones are of the held-out part of the training documents.

    ``texts`` has the bytes of all texts, compressed; ``sizes`` the length of each."""
    kind = docs.schema[key].dataType
    arrow = pa.list_(to_arrow_type(kind))
    names = ["chunk", "keys", "roles", "sizes", "texts", "bytes"]

    def run(batches):
        base, count = TaskContext.get().partitionId() << 24, 0
        kept: list[list[tuple]] = [[], []]
        used = [0, 0]

        def pack(held: int):
            nonlocal count
            keys, roles, texts = zip(*kept[held])
            row = [(base + count) * 2 + held], [list(keys)], [list(roles)], [[len(t) for t in texts]], [zstandard.compress(b"".join(texts), 3)], [used[held]]
            count, kept[held], used[held] = count + 1, [], 0
            return pa.record_batch([pa.array(x, k) for x, k in zip(row, (pa.int64(), arrow, pa.list_(pa.int8()), pa.list_(pa.int64()), pa.binary(), pa.int64()))], names=names)

        for batch in batches:
            for k, r, t in zip(*(c.to_pylist() for c in batch.columns)):
                held, text = int(r == _HELD_ROW), (t or "").encode()
                if kept[held] and used[held] + len(text) > CHUNK:
                    yield pack(held)
                kept[held].append((k, r, text))
                used[held] += len(text) + 1
        for held in (0, 1):
            if kept[held]:
                yield pack(held)

    schema = f"chunk long, keys array<{kind.simpleString()}>, roles array<byte>, sizes array<long>, texts binary, bytes long"
    return docs.select(F.col(key).alias("key"), role.cast("byte").alias("role"), "text").mapInArrow(run, schema)


def _texts(sizes: list[int], data: bytes) -> list[bytes]:
    """The texts of a chunk's row."""
    whole = zstandard.decompress(data)
    ends = np.cumsum(sizes).tolist()
    return [whole[e - n : e] for e, n in zip(ends, sizes)]


def _rows(batches):
    for batch in batches:
        for low in range(0, batch.num_rows, 64):
            yield from zip(*(c.slice(low, 64).to_pylist() for c in batch.columns))


def _asked(chunked: DataFrame, widths: list[int], buckets: list[int]) -> DataFrame:
    """(bucket, turn, chunk, data): the sorted keys of each chunk and order that fall in a bucket, and their counts."""
    cuts = [edges(w, n) for w, n in zip(widths, buckets)]

    def ask(chunk, roles, sizes, data):
        made = Chunk(_texts(sizes, data), widths)
        for n, (keys, counts) in enumerate(zip(made.keys, made.counted(np.array(roles) != _OUT_ROW))):
            bounds = [0, *np.searchsorted(keys, cuts[n]).tolist(), len(keys)]
            for b in range(buckets[n]):
                low, high = bounds[b], bounds[b + 1]
                if low < high:
                    steps = np.diff(keys[low:high], prepend=cuts[n][b - 1] if b else np.uint64(0))
                    yield b, n, chunk, _joined(_planes(steps), _packed(counts[low:high]))

    def run(batches):
        out: list[tuple] = []
        size = 0
        for chunk in _rows(batches):
            for row in ask(*chunk):
                out.append(row)
                size += len(row[3])
                if size > 1 << 24:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)

    def _batch(out):
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int8(), pa.int64(), pa.binary()))], names=["bucket", "turn", "chunk", "data"])

    return chunked.select("chunk", "roles", "sizes", "texts").mapInArrow(run, "bucket int, turn byte, chunk long, data binary")


def _answers(asked: DataFrame) -> DataFrame:
    """(chunk, turn, bucket, data) for each row of ``asked``: the totals of its keys, of the main and of the held-out part.

    Rows of chunk -1 have the sums of a bucket's unigrams: main tokens, held-out tokens, types, types of the main part."""

    def answer(bucket, turn, rows):
        keys, counts, chunks = [], [], []
        for chunk, data in rows:
            steps, count = _parted(data)
            counts.append(_unpacked(count))
            keys.append(np.cumsum(_unplaned(steps, len(counts[-1])), dtype=np.uint64))
            chunks.append(chunk)
        every = np.unique(np.concatenate(keys))
        totals = np.zeros((2, len(every)), np.int64)
        places = [np.searchsorted(every, k).astype(np.int32) for k in keys]
        for chunk, place, count in zip(chunks, places, counts):
            totals[chunk & 1, place] += count
        for chunk, place in zip(chunks, places):
            yield chunk, turn, bucket, zstandard.compress(_joined(_packed(totals[0, place]), _packed(totals[1, place])), 3)
        if turn == 0:
            sums = [*totals.sum(axis=1).tolist(), int((totals.sum(axis=0) > 0).sum()), int((totals[0] > 0).sum())]
            yield -1, turn, bucket, ",".join(map(str, sums)).encode()

    def run(batches):
        for (bucket, turn), group in groupby(_rows(batches), key=lambda r: r[:2]):
            out = list(answer(bucket, turn, ((r[2], r[3]) for r in group)))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int8(), pa.int32(), pa.binary()))], names=["chunk", "turn", "bucket", "data"])

    return asked.repartition("bucket").sortWithinPartitions("bucket", "turn").mapInArrow(run, "chunk long, turn byte, bucket int, data binary")


def _met(chunked: DataFrame, answers: DataFrame) -> DataFrame:
    """Chunks and their answers side by side: first the answers in the order of their keys, then the texts."""
    columns = {c: chunked.schema[c].dataType.simpleString() for c in ("keys", "sizes")}
    texts = chunked.select("chunk", F.lit(ORDER).cast("byte").alias("turn"), F.lit(0).alias("bucket"), F.col("texts").alias("data"), *columns)
    totals = answers.select("chunk", "turn", "bucket", "data", *(F.lit(None).cast(k).alias(c) for c, k in columns.items()))
    return totals.union(texts).repartition("chunk").sortWithinPartitions("chunk", "turn", "bucket")


def _each(batches, widths: list[int]):
    """(keys, Chunk, main totals by order, held-out totals by order) of each chunk of :func:`_met`."""
    for _, rows in groupby(_rows(batches), key=lambda r: r[0]):
        parts = [[[] for _ in range(ORDER)] for _ in range(2)]
        for _, turn, _, data, keys, sizes in rows:
            if turn < ORDER:
                for part, packed in zip(parts, _parted(zstandard.decompress(data))):
                    part[turn].append(_unpacked(packed).astype(np.int64))
        yield keys, Chunk(_texts(sizes, data), widths), *([np.concatenate(x) for x in part] for part in parts)


def bucket_of(contexts: list) -> np.ndarray:
    """The weights that each token uses: by the longest context seen, and how often it was (doublings); 0: none was seen."""
    out = np.zeros(len(contexts[1]), np.int64)
    for n in range(1, ORDER):
        seen = contexts[n] > 0
        out[seen] = (n - 1) * BUCKETS + 1 + np.minimum(np.log2(contexts[n][seen]).astype(np.int64), BUCKETS - 1)
    return out


def estimates(counts: list, contexts: list, total: int, types: int) -> np.ndarray:
    """The estimates of each token, by order: uniform, unigram, bigram, trigram."""
    rows = [np.full(len(counts[0]), 1 / (types + 1)), counts[0] / max(total, 1)]
    return np.stack([*rows, *(counts[n] / np.maximum(contexts[n], 1) for n in range(1, ORDER))])


def start() -> np.ndarray:
    """Weights before anything is learned: even over the estimates that a bucket has."""
    weights = np.zeros(((ORDER - 1) * BUCKETS + 1, ORDER + 1))
    for b in range(len(weights)):
        weights[b, : 2 + (b + BUCKETS - 1) // BUCKETS] = 1
    return weights / weights.sum(axis=1, keepdims=True)


def learn(bucket: np.ndarray, each: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of each bucket by expectation-maximisation: ``n`` held-out tokens of each (bucket, estimates)."""
    weights = start()
    few = weights * 0.1  # what a bucket without tokens keeps
    for _ in range(60):
        share = each * weights[bucket].T
        share *= n / share.sum(axis=0)
        new = np.stack([np.bincount(bucket, s, len(weights)) for s in share], axis=1) + few
        new /= new.sum(axis=1, keepdims=True)
        if np.abs(new - weights).max() < 1e-5:
            break
        weights = new
    return weights


def _binned(p: np.ndarray) -> np.ndarray:
    """Probabilities by bins of a quarter of a power of ten; -1: zero."""
    return np.where(p > 0, np.round(-BINS * np.log10(np.maximum(p, 1e-300))), -1).astype(np.int32)


def _weights(chunked: DataFrame, answers: DataFrame, widths: list[int], sums: list[int], ends: int) -> np.ndarray:
    """Weights learned from the held-out chunks, whose tokens are told from the counts of the main part."""
    total, _, _, types = sums

    def run(batches):
        for _, made, main, _ in _each(batches, widths):
            counts, contexts = made.known(main, ends)
            each = _binned(estimates(counts, contexts, total, types)[1:])
            found, n = np.unique(np.concatenate([bucket_of(contexts)[None].astype(np.int32), each]), axis=1, return_counts=True)
            yield pa.record_batch([*(pa.array(x, pa.int32()) for x in found), pa.array(n, pa.int64())], names=["bucket", *cells, "n"])

    cells = [f"p{k}" for k in range(1, ORDER + 1)]
    schema = ", ".join(f"{c} int" for c in ("bucket", *cells)) + ", n long"
    part = _met(chunked.where("chunk % 2 = 1"), answers.where("chunk >= 0 and chunk % 2 = 1"))
    table = part.mapInArrow(run, schema).groupBy("bucket", *cells).agg(F.sum("n").alias("n")).toArrow()
    if not table.num_rows:
        return start()
    bins = np.stack([table[c].to_numpy() for c in cells])
    each = np.concatenate([np.full((1, table.num_rows), 1 / (types + 1)), np.where(bins < 0, 0, 10.0 ** (-bins / BINS))])
    return learn(table["bucket"].to_numpy(), each, table["n"].to_numpy().astype(float))


def scores(docs: DataFrame, key: str, role) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row; ``role`` is 0 for the main part of the training
    documents, 1 for their held-out part, 2 for others."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    chunked = written(_chunked(docs, key, role), "chunks")
    size = chunked.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    widths, buckets = layout(size)
    answers = written(_answers(_asked(chunked, widths, buckets)), "totals")
    release(spark)  # the shuffle of the keys can go before the next one comes
    parts = F.split(F.col("data").cast("string"), ",")
    sums = np.array([x or 0 for x in answers.where("chunk = -1").select(*(parts[k].cast("long").alias(f"s{k}") for k in range(4))).groupBy().sum().first()], np.int64)
    tallied = {r["role"]: r["n"] for r in chunked.select(F.explode("roles").alias("role")).groupBy("role").agg(F.count("*").alias("n")).collect()}
    ends = [tallied.get(_MAIN_ROW, 0), tallied.get(_HELD_ROW, 0)]  # an end for each text
    weights = _weights(chunked, answers, widths, sums.tolist(), ends[0])
    release(spark)
    total, types = int(sums[0] + sums[1]), int(sums[2])
    if not total:
        weights = np.zeros_like(weights)
        weights[:, 0] = 1

    def run(batches):
        for keys, made, main, held in _each(batches, widths):
            counts, contexts = made.known([a + b for a, b in zip(main, held)], sum(ends))
            own = np.log10((estimates(counts, contexts, total, types) * weights[bucket_of(contexts)].T).sum(axis=0))
            base = np.log10(counts[0] + 1.0) - np.log10(float(total + types + 1))
            known, base, own = (np.add.reduceat(x, made.first) for x in ((counts[0] > 0).astype(np.int64), base, own))
            yield pa.record_batch([pa.array(keys, field), pa.array(made.sizes), pa.array(known), pa.array(np.full(len(keys), total, np.int64)), pa.array(base), pa.array(own)], names=[key, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    field = to_arrow_type(docs.schema[key].dataType)
    return _met(chunked, answers.where("chunk >= 0")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10(docs: DataFrame) -> DataFrame:
    """The contract's result: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10, sums over tokens)."""
    part = fold(F.col("doc_id"), _FOLD)
    role = F.when(part == _OUT, _OUT_ROW).when(part == _HELD, _HELD_ROW).otherwise(_MAIN_ROW)
    out = scores(docs, "doc_id", role)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), _FOLD) == _OUT, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
