"""Language identification by rank-order n-gram profiles and the out-of-place distance.

A profile is the list of the most frequent character n-grams (one to three characters, words padded with a space), most
frequent first. A document goes to the language whose profile is nearest: the sum, over the document's n-grams, of how far
out of place each is, with the profile's length for an n-gram that is not in it.

Profiles are learned from a bounded sample: by hash of the id, ``PER_LANGUAGE`` documents of each language on average (all
where there are fewer), whole texts. All documents are scored over their whole text.

Edge cases: null texts and texts without a letter are ``und`` with score 0; ties go to the language that sorts first; if
nothing can be learned all documents are ``und``; repeated rows are scored each; a null id is
in no fold and never learned from; an empty table gives an empty table;
further columns are ignored. Letters are those of Unicode's category L, lower-cased; numerals are none.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import broadcast_if_small, fold

PER_LANGUAGE = 1000
PROFILE = 400
ORDERS = 3
UNKNOWN = "und"
_NUMERALS = "".join(c for c in map(chr, range(0x80, 0x110000)) if c.isalnum() and not (c.isalpha() or c.isdecimal()))  # such as ², ½ and Ⅷ
_LETTERS = re.compile(rf"[^\W\d_{re.escape(_NUMERALS)}]+")  # tries the numerals one by one: slow, so it is asked about each code point but once
_LETTER = np.zeros(0x110000, bool)
_LETTER[np.frombuffer("".join(_LETTERS.findall("".join(filter(str.isalnum, map(chr, range(0x110000)))))).encode("utf-32-le"), np.uint32)] = True
_BLANK = 32


def grams(text: str | None) -> np.ndarray:
    """Codes of all n-grams of a text: up to three code points of 21 bits each."""
    points = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _LETTER[points]
    if not letter.any():
        return np.empty(0, np.int64)
    after = np.concatenate([[False], letter[:-1]])
    points = np.concatenate([[_BLANK], np.where(letter, points, _BLANK)[letter | after]])  # one blank before, between and after the words
    out, code = [points[points != _BLANK]], points
    for n in range(2, ORDERS + 1):
        code = (code[:-1] << 21) | points[n - 1 :]
        inner = points[1 : len(points) - n + 2] != _BLANK
        out.append(code[inner] if n == 3 else code)
    return np.concatenate(out)


def profile(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first, ties to the smaller code."""
    if len(codes) > size:
        low = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= low
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:size]


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Profiles by language from (doc_id, text, lang)."""
    ids = docs.where("lang is not null and doc_id is not null").select("doc_id", "lang")
    shares = ids.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40).cast("long")) / F.lit(float(1 << 40))
    texts = docs.select("doc_id", "text", "lang").join(broadcast_if_small(shares), "lang").where(place < F.col("share")).select("text", "lang")

    def run(batches):
        for batch in batches:
            found: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes, n = np.unique(grams(text), return_counts=True)
                counts = found.setdefault(lang, Counter())
                for k, v in zip(codes.tolist(), n.tolist()):
                    counts[k] += v
            rows = [(lang, k, v) for lang, counts in found.items() for k, v in counts.items()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([], [], []), (pa.string(), pa.int64(), pa.int64()))], names=["lang", "gram", "n"])

    counted = texts.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # no more than the sample's n-grams
    langs, codes, counts = table["lang"].to_numpy(), table["gram"].to_numpy(), table["n"].to_numpy()
    return {str(lang): profile(codes[langs == lang], counts[langs == lang]) for lang in sorted(set(langs.tolist()))}


class Ranker:
    """Profiles of all languages, for scoring one document at a time."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.langs = sorted(profiles)
        self.codes = np.unique(np.concatenate([np.empty(0, np.int64), *profiles.values()]))
        self.ranks = np.full((len(self.langs), len(self.codes)), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, profiles[lang])] = np.arange(len(profiles[lang]))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document profile to each language."""
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        ranks = np.where(self.codes[at] == own, self.ranks[:, at], -1)
        return np.where(ranks < 0, PROFILE, np.minimum(np.abs(ranks - np.arange(len(own))), PROFILE)).sum(axis=1)

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = grams(text)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        own = profile(*np.unique(codes, return_counts=True))
        far = self.distances(own)
        best = int(np.argmin(far))
        return self.langs[best], float(1 - far[best] / (PROFILE * len(own)))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` without ``text`` but with ``lang_pred`` and ``score``: 1 less the share of the largest possible distance."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        ranker = Ranker(shared.value)
        for batch in batches:
            found = [ranker.predict(t) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([*batch.columns[1:], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*batch.schema.names[1:], "lang_pred", "score"])

    keep = [c for c in docs.columns if c != "text"]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return docs.select("text", *keep).mapInArrow(run, f"{schema}lang_pred string, score double")


def op9(docs: DataFrame) -> DataFrame:
    """The contract's result: doc_id, held_out, lang_pred, score; the fold crc32 mod 3 = 1 is never learned from."""
    profiles = learn(docs.where(fold(F.col("doc_id"), 3) != 1))
    found = predict(docs.select("text", "doc_id"), profiles)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
