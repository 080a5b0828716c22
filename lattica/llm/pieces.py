"""SentencePiece encoding with seeded merge-dropout, and decoding.

A BPE vocabulary of pieces is read from a SentencePiece model. Blanks become the mark U+2581 and one is put before the
text, as that model's normaliser does; no piece of the vocabulary holds a mark after another character, or joins letters and
other characters (but for a few letters that are then no letters here), so a text is cut there and each chunk has an agenda of
its own: candidate merges, best score first, leftmost on ties. A candidate that comes up is skipped if the keyed hash of
(seed, document, place of the chunk, span, split, piece) falls under the dropout rate; what is left when the agenda is empty
is the segmentation. Every candidate of every occurrence has a draw of its own, which depends on no other draw. All steps are
merges of the vocabulary, so every result is made of its pieces. Characters outside the vocabulary, and a mark that was in
the text, become byte pieces: decoding gives back every text byte for byte. Rate 0 gives the model's own segmentation.

Which candidates come up if none is skipped depends on the chunk alone. A worker keeps them for the chunks it has met, with
the segmentation that then follows: the draws of all occurrences of a batch are hashed as one array, and an occurrence
without a skip is done. The others run their agendas with their draws, many at a time: one column of a matrix each, one
candidate each in a round. Chunks of more than ``_LONG`` characters run their agenda as a heap. What is kept only saves work:
at ``_KEPT`` numbers it is thrown away, and the results are those of running each agenda alone.

Edge cases: null and empty texts have no pieces and decode to the empty text; a text that is no valid Unicode (lone
surrogates cannot be in a table) does not occur; very long texts are encoded whole, chunk after chunk; a chunk of any length
is encoded by the same agenda; repeated rows get equal pieces; a null id is hashed as such; an empty table gives an empty
table; clashing names are refused by Spark where ``keep`` names a result.
"""

from __future__ import annotations

import heapq
import os
import re
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from lattica.llm.common import list_array

MODEL = os.environ.get("LATTICA_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
RATE = 0.1
SEED = 17
MARK = "▁"
_KEPT = 4_000_000
_LONG = 64
_NONE = 1 << 30
_CHARS = 400_000
_MASK = (1 << 64) - 1
_GOLDEN, _FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(x: int) -> int:
    """64 well-mixed bits of 64 bits."""
    x = ((x ^ (x >> 30)) * _FIRST) & _MASK
    x = ((x ^ (x >> 27)) * _SECOND) & _MASK
    return x ^ (x >> 31)


def mixed_all(x: np.ndarray) -> np.ndarray:
    """:func:`mixed` of an array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_FIRST)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_SECOND)
    return x ^ (x >> np.uint64(31))


def candidate(start: int, split: int, stop: int, rank: int) -> int:
    """The part of a draw's hash that a candidate merge gives: its span inside the chunk, its split and its piece."""
    return mixed((start * 0xD6E8FEB86659FD93 + split * 0xA0761D6478BD642F + stop * 0xE7037ED1A0B428DB + rank * _GOLDEN) & _MASK)


def candidates(start: np.ndarray, split: np.ndarray, stop: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """:func:`candidate` of arrays."""
    parts = zip((start, split, stop, rank), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, _GOLDEN))
    return mixed_all(sum(x.astype(np.uint64) * np.uint64(k) for x, k in parts))


def skipped(occurrence: int, of: int, limit: int) -> bool:
    """The draw of one candidate at one occurrence."""
    return (mixed(occurrence ^ of) >> 32) < limit


class Grown:
    """An array that grows."""

    def __init__(self, kind):
        self.values, self.n = np.empty(1 << 12, kind), 0

    def add(self, new) -> None:
        need = self.n + len(new)
        if need > len(self.values):
            self.values = np.concatenate([self.values[: self.n], np.empty(max(need, 2 * self.n) - self.n, self.values.dtype)])
        self.values[self.n : need] = new
        self.n = need


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Known:
    """What the agenda of each chunk does without skips: the hashes of its candidates, and its piece ids."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.ids, self.hashes = Grown(np.int32), Grown(np.uint64)
        self.id_start, self.id_size, self.start, self.size = (Grown(np.int64) for _ in range(4))

    def add(self, chunks: list[str], hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray, id_sizes: np.ndarray) -> None:
        for grown, at, n in ((self.start, self.hashes.n, sizes), (self.id_start, self.ids.n, id_sizes)):
            grown.add(at + np.cumsum(n) - n)
        self.size.add(sizes)
        self.id_size.add(id_sizes)
        self.hashes.add(hashes)
        self.ids.add(ids)
        low = len(self.rows)
        self.rows.update(zip(chunks, range(low, low + len(chunks))))


class Pieces:
    """Vocabulary, encoder and decoder of one model file."""

    def __init__(self, path: str = MODEL, rate: float = RATE, seed: int = SEED):
        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        self.seed, self.limit = seed, int(rate * (1 << 32))
        self.ids, self.plain = {}, []
        self.bytes = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == p.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.plain.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == p.NORMAL:
                self.ids[p.piece] = i
                self.plain.append(p.piece.replace(MARK, " ").encode())
            else:
                self.plain.append(b"")
        order = {x: n for n, x in enumerate(sorted({-p.score for p in model.pieces if p.type == p.NORMAL}))}
        self.rank = {p.piece: order[-p.score] for p in model.pieces if p.type == p.NORMAL}  # equal scores, equal ranks
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a mark after another character")
        both = {x for p in self.ids for a, b in zip(p, p[1:]) if a != MARK and a.isalnum() != b.isalnum() for x in (a, b) if x.isalnum()}
        others = rf"\W_{re.escape(''.join(sorted(both)))}"
        self.chunks = re.compile(f"{MARK}*[^{others}]+|{MARK}*(?:(?!{MARK})[{others}])+|{MARK}+").findall
        self.mark = [self.bytes[b] for b in MARK.encode()]
        self.known = Known()
        symbols = {x: n for n, x in enumerate(dict.fromkeys([*self.ids, *"".join(self.ids)]))}
        self.symbol = np.full(0x110000, -1, np.int32)  # of a character
        for x, n in symbols.items():
            if len(x) == 1:
                self.symbol[ord(x)] = n
        self.piece = np.array([self.ids.get(x, -1) for x in symbols], np.int32)
        pairs = sorted((symbols[p[:k]] << 32 | symbols[p[k:]], self.rank[p], symbols[p]) for p in self.ids for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols)
        none = (np.iinfo(np.int64).min, _NONE, 0)  # what an empty slot leads to
        self.pair, self.pair_rank, self.pair_symbol = (np.array(x, np.int64) for x in zip(*pairs, none))
        self.shift = np.uint64(64 - (8 * len(pairs)).bit_length())
        slots = self._slots(self.pair[:-1])
        self.slot = np.full(1 << 64 - int(self.shift), len(pairs), np.int32)
        self.slot[slots] = np.arange(len(pairs))
        self.crowded = np.zeros(len(self.pair), bool)  # pairs that hold a slot which others wanted
        self.crowded[self.slot[slots[self.slot[slots] != np.arange(len(pairs))]]] = True

    def agenda(self, text: str, skip) -> list[str]:
        """The parts that the agenda of ``text`` leaves; ``skip(hash)`` decides on each candidate that comes up."""
        get, n = self.rank.get, len(text)
        left, right, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))  # symbols by their first character
        alive, waiting = [True] * n, [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(text[i : i + 2])) is not None]
        heapq.heapify(waiting)
        while waiting:
            r, i, j, stop = heapq.heappop(waiting)
            if not alive[i] or right[i] != j or j >= n or end[j] != stop or skip(candidate(i, j, stop, r)):
                continue
            alive[j] = False
            end[i] = stop
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (t := get(text[i : end[k]])) is not None:
                    heapq.heappush(waiting, (t, i, k, end[k]))
            k = left[i]
            if k >= 0 and (t := get(text[k:stop])) is not None:
                heapq.heappush(waiting, (t, k, i, stop))
        out, i = [], 0
        while i < n:
            out.append(text[i : end[i]])
            i = right[i]
        return out

    def named(self, parts: list[str]) -> array:
        """Piece ids of the parts of a chunk; what is no piece becomes bytes."""
        out, ids = array("i"), self.ids
        for piece in parts:
            found = ids.get(piece)
            if found is None:
                out.extend(self.bytes[b] for b in piece.encode())
            else:
                out.append(found)
        return out

    def alone(self, chunk: str, occurrence: int) -> array:
        """Piece ids of one chunk at one occurrence, by its own agenda."""
        return self.named(self.agenda(chunk, lambda h: skipped(occurrence, h, self.limit)))

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        """Where to look for each of ``pairs`` first."""
        return (pairs.astype(np.uint64) * np.uint64(_GOLDEN)) >> self.shift

    def _merges(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol) of merging ``a`` and ``b``; rank ``_NONE`` where no piece comes of it."""
        wanted = a.astype(np.int64) << 32 | b
        at = self.slot[self._slots(wanted)]
        met = self.pair[at] == wanted
        lost = np.flatnonzero(self.crowded[at] & ~met)
        if len(lost):
            at[lost] = np.minimum(np.searchsorted(self.pair[:-1], wanted[lost]), len(self.pair) - 2)
            met[lost] = self.pair[at[lost]] == wanted[lost]
        return np.where(met, self.pair_rank[at], _NONE), self.pair_symbol[at]

    def side_by_side(self, chunks: list[str], keys: np.ndarray | None):
        """The agendas of chunks of at most ``_LONG`` characters, all at once: (piece ids, number of each, and without
        ``keys`` the hashes of the candidates that came up, number of each). With ``keys`` candidates are skipped by draw."""
        n, size = len(chunks), np.fromiter(map(len, chunks), np.int64, len(chunks))
        wide = max(int(size.max(initial=1)), 2)
        points = np.array(chunks, f"<U{wide}").view(np.uint32).reshape(n, wide).T
        place = np.arange(wide)[:, None]
        inside = place < size
        symbols = np.where(inside, self.symbol[points], -1)
        alive = inside.copy()
        right = np.where(inside, place + 1, wide)
        left = np.broadcast_to(place - 1, (wide, n)).copy()
        rank, to = self._merges(symbols[:-1].ravel(), symbols[1:].ravel())
        best = np.where(rank < _NONE, rank << 6 | np.repeat(place[:-1], n), _NONE << 6).reshape(wide - 1, n)
        into = to.reshape(wide - 1, n)
        rows = np.arange(n)
        met: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            first = best.min(axis=0, initial=_NONE << 6)
            going = np.flatnonzero(first < _NONE << 6)
            if not len(going):
                break
            if len(going) < 0.7 * len(rows):
                best, into, rows, first = best[:, going], into[:, going], rows[going], first[going]
                going = np.arange(len(rows))
            first, row = first[going], rows[going]
            i, r = first & 63, first >> 6
            j = right[i, row]
            k = right[j, row]
            stop = np.where(k < wide, k, size[row])
            h = candidates(i, j, np.minimum(stop, size[row]), r)
            if keys is None:
                met.append((row, h))
            else:
                kept = mixed_all(keys[row] ^ h) >> np.uint64(32) >= np.uint64(self.limit)
                best[i[~kept], going[~kept]] = _NONE << 6
                going, row, i, j, k = going[kept], row[kept], i[kept], j[kept], k[kept]
            new = into[i, going]
            symbols[i, row] = new
            alive[j, row] = False
            right[i, row] = k
            best[np.minimum(j, wide - 2), going] = np.where(j <= wide - 2, _NONE << 6, best[np.minimum(j, wide - 2), going])
            best[i, going] = _NONE << 6
            more = np.flatnonzero(k < size[row])
            left[k[more], row[more]] = i[more]
            rank, to = self._merges(new[more], symbols[k[more], row[more]])
            best[i[more], going[more]] = np.where(rank < _NONE, rank << 6 | i[more], _NONE << 6)
            into[i[more], going[more]] = to
            before = left[i, row]
            more = np.flatnonzero(before >= 0)
            before = before[more]
            rank, to = self._merges(symbols[before, row[more]], new[more])
            best[before, going[more]] = np.where(rank < _NONE, rank << 6 | before, _NONE << 6)
            into[before, going[more]] = to
        left_over, sizes = symbols.T[alive.T], alive.sum(axis=0)
        ids = np.where(left_over >= 0, self.piece[left_over], -1)
        if (ids < 0).any():  # what is no piece becomes bytes
            ids, sizes = self._bytes(ids, points.T[alive.T], sizes)
        if keys is not None:
            return ids, sizes
        row = np.concatenate([x for x, _ in met] or [np.empty(0, np.int64)])
        hashes = np.concatenate([x for _, x in met] or [np.empty(0, np.uint64)])
        return ids, sizes, hashes[np.argsort(row, kind="stable")], np.bincount(row, minlength=n)

    def _bytes(self, ids: np.ndarray, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` with the byte pieces of the character at each place that has none."""
        none = np.flatnonzero(ids < 0)
        found = [chr(c).encode() for c in points[none].tolist()]
        lengths = np.ones(len(ids), np.int64)
        lengths[none] = [len(x) for x in found]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        out = np.repeat(ids, lengths)
        out[ragged(ends[none], lengths[none])] = np.array(self.bytes, np.int32)[np.frombuffer(b"".join(found), np.uint8)]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return out, np.diff(ends[bounds])

    def _learn(self, chunks: list[str]) -> None:
        """Keep what the agendas of new ``chunks`` do without skips."""
        none = np.empty(0, np.uint64)
        for low, high in ((0, 8), (8, 16), (16, 32), (32, _LONG)):
            some = [c for c in chunks if low < len(c) <= high]
            if some:
                ids, sizes, hashes, counts = self.side_by_side(some, None)
                self.known.add(some, hashes if self.limit else none, counts if self.limit else counts * 0, ids, sizes)
        for c in chunks:
            if len(c) > _LONG:
                met: list[int] = []
                ids = self.named(self.agenda(c, lambda h: bool(met.append(h))))
                hashes = np.array(met if self.limit else [], np.uint64)
                self.known.add([c], hashes, np.array([len(hashes)]), np.frombuffer(ids, np.int32), np.array([len(ids)]))

    def occurrences(self, chunks: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all ``chunks``, number of each): ``keys`` are the hashes of the occurrences."""
        if self.known.hashes.n + self.known.ids.n > _KEPT:
            self.known = Known()
        known, get = self.known, self.known.rows.get
        rows = np.fromiter(map(get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(rows < 0)
        if len(new):
            self._learn(list(dict.fromkeys(chunks[j] for j in new.tolist())))
            rows[new] = [known.rows[chunks[j]] for j in new.tolist()]
        starts, sizes = known.id_start.values[rows], known.id_size.values[rows]
        if not self.limit:
            return known.ids.values[ragged(starts, sizes)], sizes
        drawn = known.size.values[rows]
        position = ragged(known.start.values[rows], drawn)
        hit = np.flatnonzero(mixed_all(np.repeat(keys, drawn) ^ known.hashes.values[position]) >> np.uint64(32) < np.uint64(self.limit))
        owner = np.searchsorted(np.cumsum(drawn), hit, side="right")
        owner = owner[np.flatnonzero(np.diff(owner, prepend=-1))]
        length = np.array([len(chunks[j]) for j in owner.tolist()], np.int64)
        values, at = [known.ids.values[: known.ids.n]], known.ids.n
        for low, high in ((0, 8), (8, 16), (16, 32), (32, _LONG)):
            some = owner[(length > low) & (length <= high)]
            if len(some):
                ids, n = self.side_by_side([chunks[j] for j in some.tolist()], keys[some])
                starts[some], sizes[some] = at + np.cumsum(n) - n, n
                values.append(ids)
                at += len(ids)
        for j in owner[length > _LONG].tolist():
            values.append(np.frombuffer(self.alone(chunks[j], int(keys[j])), np.int32))
            starts[j], sizes[j] = at, len(values[-1])
            at += len(values[-1])
        return np.concatenate(values)[ragged(starts, sizes)], sizes

    def encode_all(self, texts: list[str | None], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all texts, number of each); ``keys`` are 64 bits of each document."""
        chunks: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        marks: list[tuple[int, int]] = []  # a mark of the text's own comes before this chunk: bytes
        for row, text in enumerate(texts):
            low = len(chunks)
            if text:
                for n, part in enumerate(text.split(MARK)):
                    if n:
                        marks.append((row, len(chunks)))
                    chunks += self.chunks((part if n else " " + part).replace(" ", MARK))
            counts[row] = len(chunks) - low
        row = np.repeat(np.arange(len(texts)), counts)
        place = ragged(np.zeros(len(texts), np.int64), counts).astype(np.uint64) + np.uint64(1)
        ids, sizes = self.occurrences(chunks, mixed_all(np.array(keys, np.uint64)[row] + place * np.uint64(_GOLDEN)))
        totals = np.zeros(len(texts), np.int64)
        np.add.at(totals, row, sizes)
        if marks:
            before = np.concatenate([[0], np.cumsum(sizes)])
            ids = np.insert(ids, np.repeat([before[c] for _, c in marks], len(self.mark)), np.tile(self.mark, len(marks)))
            np.add.at(totals, [r for r, _ in marks], len(self.mark))
        return ids.astype(np.int32), totals

    def encode(self, text: str | None, key: int = 0) -> np.ndarray:
        """Piece ids of a whole text; ``key`` is the document's."""
        return self.encode_all([text], [key])[0]

    def decode(self, ids) -> str:
        """The text of piece ids."""
        return b"".join(map(self.plain.__getitem__, ids))[1:].decode()


def document_key(key, seed: int = SEED) -> int:
    """64 bits of the seed and a document's key."""
    return xxhash.xxh64_intdigest(str(key), seed)


def _reader(path: str, rate: float, seed: int):
    """The worker's own Pieces, made once."""
    kept: dict = globals().setdefault("_made", {})
    at = (path, rate, seed)
    if at not in kept:
        kept.clear()
        kept[at] = Pieces(*at)
    return kept[at]


def _encoded(batch: pa.RecordBatch, reader: Pieces, seed: int, check: bool):
    """Parts of (key, pieces, n_pieces, n_chars), and with ``check`` whether the pieces decode to the text."""
    every = [t or "" for t in batch.column(1).to_pylist()]
    low = 0
    while low < len(every):
        high, chars = low, 0
        while high < len(every) and (high == low or chars + len(every[high]) <= _CHARS):
            chars += len(every[high])
            high += 1
        texts, keys = every[low:high], batch.column(0).slice(low, high - low)
        ids, sizes = reader.encode_all(texts, [document_key(k, seed) for k in keys.to_pylist()])
        columns = [keys, list_array(ids, sizes, pa.int32()), pa.array(sizes.astype(np.int32)), pa.array([len(t) for t in texts], pa.int64())]
        if check:
            bounds = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            flat = ids.tolist()
            columns.append(pa.array([reader.decode(flat[a:b]) == t for a, b, t in zip(bounds, bounds[1:], texts)], pa.bool_()))
        yield columns
        low = high


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = MODEL, rate: float = RATE, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, pieces array<int>, n_pieces, n_chars) of every row of ``docs``, and its columns ``keep`` as they are."""

    def run(batches):
        reader = _reader(path, rate, seed)
        for batch in batches:
            low = 0
            for columns in _encoded(batch, reader, seed, False):
                kept = [c.slice(low, len(columns[0])) for c in batch.columns[2:]]
                low += len(columns[0])
                yield pa.record_batch([*columns, *kept], names=[key, "pieces", "n_pieces", "n_chars", *keep])
        reader.known = Known()  # other steps use the worker after this one

    kind = docs.schema[key].dataType.simpleString()
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(key, text, *keep).mapInArrow(run, f"`{key}` {kind}, pieces array<int>, n_pieces int, n_chars long{more}")


def decode(encoded: DataFrame, key: str = "doc_id", path: str = MODEL) -> DataFrame:
    """(key, text) of every row of ``encoded`` (key, pieces)."""

    def run(batches):
        reader = _reader(path, RATE, SEED)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([reader.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())], names=[key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "pieces").mapInArrow(run, f"`{key}` {kind}, text string")


def op6(docs: DataFrame) -> DataFrame:
    """doc_id, pieces, n_pieces, n_chars, lossless (the pieces decode to the text) of every document."""

    def run(batches):
        reader = _reader(MODEL, RATE, SEED)
        for batch in batches:
            for columns in _encoded(batch, reader, SEED, True):
                yield pa.record_batch(columns, names=["doc_id", "pieces", "n_pieces", "n_chars", "lossless"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, pieces array<int>, n_pieces int, n_chars long, lossless boolean")


def plain_encoder(path: str = MODEL) -> sentencepiece.SentencePieceProcessor:
    """The library's own encoder of the same model, without dropout: what rate 0 must agree with."""
    return sentencepiece.SentencePieceProcessor(model_file=path)
