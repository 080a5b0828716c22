import hashlib
import random

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from lattica.llm import winnow

P, BASE = (1 << 31) - 1, 1_000_003


def slow(text):
    """The fingerprint by the definition: every gram's hash by Horner's rule, every window searched."""
    cjk = r"฀-๿぀-ヿ㐀-鿿가-힯"
    words = regex.findall(rf"[{cjk}]|[^ \t\n\x0b\x0c\r{cjk}]{{1,32}}", text or "")
    values = []
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        values.append((h - (1 << 64) if h >> 63 else h) % P)

    def gram(part):
        out = 0
        for v in part:
            out = (out * BASE + v) % P
        return out

    if not values:
        return []
    grams = [gram(values[i : i + 4]) for i in range(len(values) - 3)] or [gram(values)]
    chosen = []
    for i in range(max(1, len(grams) - 3)):
        window = grams[i : i + 4]
        low = min(window)
        at = i + max(j for j, h in enumerate(window) if h == low)
        if not chosen or chosen[-1][1] != at:
            chosen.append((low, at))
    return chosen


def digest(chosen):
    return hashlib.sha256(",".join(f"{h * (1 << 32) + (1 << 32) - 1 - at:X}" for h, at in chosen).encode()).hexdigest()


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(texts):
    out = {}
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        cut = len(t) // 4
        other = t[: len(t) - cut] + after[:cut]
        own, new = slow(t), slow(other)
        out[i] = (len(t), hashlib.sha256(other.encode()).hexdigest(), digest(own), digest(new), likeness(own, new), likeness(own, slow(after)))
    return out


def texts():
    r = random.Random(2)
    many = [" ".join(r.choice(["a", "b", "cc", "dd", "Straße", "漢字", "x" * 70, "\U0001f600"]) for _ in range(r.randint(0, 40))) for _ in range(540)]
    return ["", None, "one two", " ", *many, "tail tail tail tail tail tail"]


def test_all_rows_as_by_the_definition(make):
    rows = winnow.op3(make(texts(), extra=True)).collect()
    want = brute(texts())
    assert len(rows) == len(want)
    for r in rows:
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == want[r.doc_id][:4]
        assert (r.near_edited, r.near_next) == pytest.approx(want[r.doc_id][4:])


def test_match_guarantee(make):
    r = random.Random(9)
    shared = [f"s{i}" for i in range(winnow.GRAM + winnow.WINDOW - 1)]
    pairs = [" ".join([*(f"p{r.random()}" for _ in range(r.randint(0, 9))), *shared, *(f"q{r.random()}" for _ in range(r.randint(0, 9)))]) for _ in range(20)]
    found = [set(x[0]) for x in make(pairs).select(winnow.hashes(winnow.selected(F.col("text")))).collect()]
    assert all(a & b for a in found for b in found)


def test_positions(make):
    text = " ".join(f"w{i}" for i in range(50))
    row = make([text]).select(winnow.positions(winnow.selected(F.col("text"))).alias("p")).first()
    assert row.p == [at for _, at in slow(text)]


def test_odd_rows(make, odd):
    rows = winnow.op3(make(odd, extra=True)).collect()
    assert len(rows) == len(odd)
    assert len({r.fingerprint for r in rows if r.doc_id == 0 or r.doc_id is None}) == 1
    assert winnow.op3(make([])).count() == 0
    one = winnow.op3(make(["a b c d e f g h"])).first()
    assert one.near_next == 1.0
