"""Full-text search: postings, BM25 over prefixes, normalised scores and the fallbacks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions.text import edit_variants, tokenize
from lattica.scratch import cut

K1, B = 1.2, 0.75


def symbol_tokens(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, tokens array): what a symbol can be found by: name, signature, path, doc."""
    raw = F.concat_ws(" ", "name", "signature", "path", F.col("doc"))
    return symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select(F.col("id").alias("symbol_id"), tokenize(raw).alias("tokens")).where("size(tokens) > 0")


def postings(docs: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """(key, token, tf, dl): one row per document and token."""
    sized = docs.select(key, F.size(tokens).cast("double").alias("dl"), F.explode(tokens).alias("token"))
    return sized.groupBy(key, "token", "dl").agg(F.count("*").alias("tf"))


def terms(spark: SparkSession, tokens: list[str]) -> DataFrame:
    """Query terms as rows: letters and digits only, two at least, each once."""
    return spark.createDataFrame([(t,) for t in clean_terms(tokens)], "term string")


def query_tokens(spark: SparkSession, text: str) -> list[str]:
    return spark.range(1).select(tokenize(F.lit(text)).alias("t")).first()["t"]


def bm25(posts: DataFrame, query: DataFrame, key: str, limit: int | None = 100, prefix: bool = True, stats: DataFrame | None = None) -> DataFrame:
    """(key, bm25): Okapi scores of the documents that hold a query term, ``term*`` counting as one phrase per term.

    ``query`` holds the terms of one search and is what gets broadcast; the postings are read once and only those that match
    are shuffled. Scores that agree to nine digits are ties and go by the key. ``stats`` (n, avgdl) spares the pass that counts documents where it is known."""
    if stats is None:
        stats = posts.select(key, "dl").distinct().agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    same = F.col("token").startswith(F.col("term")) if prefix else F.col("token") == F.col("term")
    hits = posts.join(F.broadcast(query), same).groupBy(key, "term").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    joined = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = joined.groupBy(key).agg(F.sum(part).alias("bm25"))
    return scored if limit is None else scored.orderBy(F.desc(F.round("bm25", 9)), key).limit(max(1, min(500, limit)))


def counted(docs: DataFrame, key: str, query: list[str], prefix: bool = True, tokens: str = "tokens", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, dl, tf, keep...): length of each document (key, tokens) and how often it holds each term of ``query``, in its order.

    Tokens are counted where they are read: one row a document goes on, not one a token. Rows of one key are one document."""
    def hits(held: Column, term: str) -> Column:
        return F.size(F.filter(held, lambda t: t.startswith(term) if prefix else t == term))

    counts = F.transform(F.array(F.col(tokens)), lambda held: F.struct(F.size(held).cast("double").alias("dl"), *(hits(held, q).alias(f"tf{i}") for i, q in enumerate(query))))[0]
    rows = docs.select(key, *keep, counts.alias("c")).where("c.dl > 0")
    sums = rows.groupBy(key).agg(F.sum("c.dl").alias("dl"), *(F.sum(f"c.tf{i}").alias(f"tf{i}") for i in range(len(query))), *(F.first(c).alias(c) for c in keep))
    return cut(sums, "counts")


def clean_terms(tokens: list[str]) -> list[str]:
    """Query terms: letters and digits only, two at least, each once."""
    return [t for t in dict.fromkeys("".join(c for c in t if c.isalnum()).lower() for t in tokens) if len(t) >= 2]


def bm25_of(counts: DataFrame, key: str, limit: int | None = 100) -> DataFrame:
    """(key, bm25): the scores of :func:`bm25` from the table of :func:`counted`."""
    places = [c for c in counts.columns if c.startswith("tf") and c[2:].isdigit()]
    n, avgdl, *df = counts.agg(F.count("*").cast("double"), F.avg("dl"), *(F.count_if(F.col(c) > 0) for c in places)).first()
    total = F.lit(0.0)
    for c, d in zip(places, df):
        idf = max(math.log((n - d + 0.5) / (d + 0.5)), 1e-6)
        tf = F.col(c)
        total = total + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / (avgdl or 1.0)))).otherwise(0.0)
    hit = F.lit(False)
    for c in places:
        hit = hit | (F.col(c) > 0)
    scored = counts.where(hit).select(key, total.alias("bm25"))
    return scored if limit is None else scored.orderBy(F.desc(F.round("bm25", 9)), key).limit(max(1, min(500, limit)))


def normalised(hits: DataFrame) -> DataFrame:
    """``hits`` with ``score``: (k + .5) / (best + 1), between 0 and 1."""
    best = F.max("bm25").over(Window.partitionBy())
    return hits.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("bm25") + 0.5) / F.greatest(F.lit(1e-9), best + 1))))


def demoted(hits: DataFrame, docs: DataFrame, key: str, tokens: list[str], factor: float = 0.85) -> DataFrame:
    """``hits`` with the score of weak single matches lowered, for queries of four tokens or more."""
    if len(tokens) < 4:
        return hits
    exact = F.size(F.array_intersect("tokens", F.array(*[F.lit(t) for t in dict.fromkeys(tokens)])))
    own = docs.join(F.broadcast(hits.select(key)), key, "left_semi").select(key, exact.alias("__exact"))
    joined = hits.join(own, key, "left")
    weak = (F.coalesce("__exact", F.lit(0)) < 2) & (F.col("score") < 0.7)
    return joined.withColumn("score", F.when(weak, F.col("score") * factor).otherwise(F.col("score"))).drop("__exact")


def substring_hits(docs: DataFrame, key: str, tokens: list[str], scan: int = 5000, limit: int = 100) -> DataFrame:
    """Documents among the first ``scan`` that contain a query token of three letters or more; all score the same."""
    needed = [t.lower() for t in ("".join(c for c in t if c.isalnum()) for t in tokens) if len(t) >= 3]
    text = F.array_join("tokens", " ")
    found = F.lit(False)
    for t in needed:
        found = found | text.contains(t)
    return docs.orderBy(key).limit(scan).where(found).orderBy(key).limit(limit).select(key, F.lit(1.0).alias("bm25"))


def seed_search(docs: DataFrame, key: str, tokens: list[str], limit: int = 100, posts: DataFrame | None = None) -> DataFrame:
    """(key, bm25, score) of ``docs`` (key, tokens): prefix search, then one-edit spellings, then substrings, whichever finds first."""
    spark = docs.sparkSession
    posts = postings(docs, key) if posts is None else posts
    hits = cut(bm25(posts, terms(spark, tokens), key, limit), "hits")
    if hits.isEmpty():
        variants = [r["v"] for r in terms(spark, tokens).select(F.explode(edit_variants(F.col("term"))).alias("v")).distinct().collect()]
        hits = cut(bm25(posts, terms(spark, variants), key, limit), "hits") if variants else hits
    if hits.isEmpty():
        hits = cut(substring_hits(docs, key, tokens), "hits")
    return demoted(normalised(hits), docs, key, tokens)


def overlap(docs: DataFrame, key: str, tokens: list[str], limit: int = 20) -> DataFrame:
    """(key, score): share of the query's tokens a document holds; the search without an index."""
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(tokens)])
    share: Column = F.size(F.array_intersect("tokens", wanted)) / F.size(wanted)
    return docs.select(key, share.alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(limit)
