"""Document fingerprints by winnowing, in DataFrame functions only.

A text is cut into words (white space between them; runs over 32 code points are cut, and each Han, kana, Hangul or Thai
code point is a word). Each k-gram of words gets a Karp-Rabin hash: a polynomial of the words' hashes modulo 2^31 - 1. It
is rolled by doubling, the hash of 2n words being that of the first n times a power plus that of the last n. In each
window of ``WINDOW`` successive hashes the smallest is chosen, the rightmost on ties, and its position is kept: any run
of ``GRAM + WINDOW - 1`` equal words in two texts is sure to share a fingerprint, and matches under ``GRAM`` words are
never reported.

A selected hash and its position share one long, (hash, largest position - position), so the smallest long is the smallest
hash with the rightmost position, and sliding minima are again found by doubling.

Edge cases: null texts are empty; a text of fewer than ``GRAM`` words has one hash, of the whole word sequence, and one
without words has none; of fewer than ``WINDOW`` hashes all are one window. Two empty fingerprints have likeness 1. Rows
of one id are ordered by their text; null ids come first; very long texts are taken whole; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import broadcast_if_small, written

GRAM = 4
WINDOW = 4
_PRIME = (1 << 31) - 1
_BASE = 1_000_003
_LAST = (1 << 32) - 1
_WORD = r"[\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]|[^\s\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]{1,32}"
BLOCK = 256


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def _doubled(values: Column, length: int, join) -> Column:
    """Joins of ``length`` (a power of two) neighbours each; only whole ones."""
    step = 1
    while step < length:
        values = _let(values, lambda v, n=step: F.zip_with(F.slice(v, F.lit(1), F.greatest(F.size(v) - n, F.lit(0))), F.slice(v, F.lit(n + 1), F.greatest(F.size(v) - n, F.lit(0))), join(n)))
        step *= 2
    return values


def _roll(step: int):
    power, prime = F.lit(pow(_BASE, step, _PRIME)).cast("long"), F.lit(_PRIME).cast("long")
    return lambda a, b: (a * power + b) % prime


def _least(step: int):
    return lambda a, b: F.least(a, b)


def selected(text: Column) -> Column:
    """The fingerprint of a text: an array of longs, hash * 2^32 + (2^32 - 1 - position of the k-gram), in text order."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0)), lambda w: F.pmod(F.xxhash64(w), F.lit(_PRIME).cast("long")))
    grams = _let(
        words,
        lambda w: F.when(F.size(w) >= GRAM, _doubled(w, GRAM, _roll))
        .when(F.size(w) > 0, F.array(F.aggregate(w, F.lit(0).cast("long"), _roll(1))))
        .otherwise(F.array().cast("array<bigint>")),
    )
    keyed = F.transform(grams, lambda h, i: h * F.lit(1 << 32) + (F.lit(_LAST) - i))
    return _let(keyed, lambda k: F.when(F.size(k) >= WINDOW, F.array_distinct(_doubled(k, WINDOW, _least))).when(F.size(k) > 0, F.array(F.array_min(k))).otherwise(k))


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda v: F.shiftright(v, 32)))


def positions(fingerprint: Column) -> Column:
    return F.transform(fingerprint, lambda v: F.lit(_LAST) - v.bitwiseAND(F.lit(_LAST)))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two sets of distinct hashes."""

    def share(s: Column) -> Column:
        every = s["a"] + s["b"] - s["both"]
        return F.when(every == 0, F.lit(1.0)).otherwise(s["both"].cast("double") / every)

    return _let(F.struct(F.size(a).alias("a"), F.size(b).alias("b"), F.size(F.array_intersect(a, b)).alias("both")), share)


def digest(fingerprint: Column) -> Column:
    """Hash of the sequence of selected hashes and positions."""
    return F.sha2(F.array_join(F.transform(fingerprint, lambda v: F.hex(v)), ","), 256)


def _followers(ids: DataFrame) -> DataFrame:
    """(first, before): the smallest id of each block of ids, and the block before it; for the first block, the last one.

    Blocks of blocks keep the ordered windows short whatever the number of blocks."""
    lows = ids.groupBy("block").agg(F.min("doc_id").alias("first")).withColumn("above", F.expr(f"block div {BLOCK * BLOCK}"))
    inner = Window.partitionBy("above").orderBy("block")
    ends = lows.groupBy("above").agg(F.max("block").alias("last"))
    prior = ends.select("above", F.lag("last").over(Window.orderBy("above")).alias("prior"))
    last = ends.agg(F.max("last").alias("end"))
    return (
        lows.withColumn("in", F.lag("block").over(inner))
        .join(prior, "above", "left")
        .crossJoin(F.broadcast(last))
        .select("first", F.coalesce("in", "prior", "end").alias("before"))
    )


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text, chosen, next_chosen): each row beside the next by id; after the last comes the first.

    Texts are dealt once, by blocks of ids; only the first row of a block is dealt a second time, to the block before."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    block = F.coalesce(F.expr(f"cast(floor(doc_id / {BLOCK}D) as bigint)"), F.lit(-(1 << 62)))
    ids = docs.select("doc_id", block.alias("block"))
    firsts = written(_followers(ids), "firsts")
    marked = plain.withColumn("block", block).join(broadcast_if_small(firsts), F.col("doc_id").eqNullSafe(F.col("first")), "left").drop("first")
    # rows that share the smallest id of a block all go along; only the first of them comes next to a row
    copies = F.when(F.col("before").isNull(), F.array(F.struct(F.col("block").alias("to"), F.lit(False).alias("guest")))).otherwise(
        F.array(F.struct(F.col("block").alias("to"), F.lit(False).alias("guest")), F.struct(F.col("before").alias("to"), F.lit(True).alias("guest")))
    )
    dealt = marked.select("doc_id", "text", F.explode(copies).alias("c")).select("doc_id", "text", "c.to", "c.guest")
    order = Window.partitionBy("to").orderBy("guest", F.asc_nulls_first("doc_id"), "text")
    chosen = dealt.repartition("to").sortWithinPartitions("to", "guest", F.asc_nulls_first("doc_id"), "text").withColumn("chosen", selected(F.col("text")))
    led = chosen.withColumn("next_text", F.lead("text").over(order)).withColumn("next_chosen", F.lead("chosen").over(order))
    return led.where("not guest").select("doc_id", "text", F.coalesce("next_text", "text").alias("next_text"), "chosen", F.coalesce("next_chosen", "chosen").alias("next_chosen"))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last quarter of code points replaced by as many first ones of ``following``."""
    n = F.length(text)
    cut = F.floor(n / F.lit(4)).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def op3(docs: DataFrame) -> DataFrame:
    """The contract's result: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    made = with_next(docs).select("doc_id", F.length("text").cast("long").alias("n_chars"), edited(F.col("text"), F.col("next_text")).alias("other"), "chosen", "next_chosen")
    made = made.select("doc_id", "n_chars", F.sha2("other", 256).alias("edited_sha256"), "chosen", "next_chosen", selected(F.col("other")).alias("other"))
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        digest(F.col("chosen")).alias("fingerprint"),
        digest(F.col("other")).alias("edited_fingerprint"),
        likeness(hashes(F.col("chosen")), hashes(F.col("other"))).alias("near_edited"),
        likeness(hashes(F.col("chosen")), hashes(F.col("next_chosen"))).alias("near_next"),
        F.size("chosen").alias("n_selected"),
    )
