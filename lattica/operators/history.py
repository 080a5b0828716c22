"""What the commit history tells: recency, files that change together, similar changes, who knows a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.paths import is_history_skipped, is_test
from lattica.functions.text import commit_tokens
from lattica.operators.fts import bm25_of, clean_terms, counted, overlap
from lattica.scratch import cut

MAX_FILES = 40
WINDOW = 120


def newest(commits: DataFrame, window: int = WINDOW) -> DataFrame:
    """(sha, n): the newest commits, numbered from 0."""
    top = commits.orderBy(F.desc("ts"), "sha").limit(window)
    return top.select("sha", (F.row_number().over(Window.orderBy(F.desc("ts"), "sha")) - 1).alias("n"))


def recency(commits: DataFrame, commit_files: DataFrame, window: int = WINDOW) -> DataFrame:
    """(path, recency): 1 - i / N for the newest commit i of N that touches a path."""
    recent = newest(commits, window)
    total = recent.agg(F.count("*").alias("total"))
    return commit_files.join(F.broadcast(recent), "sha").crossJoin(F.broadcast(total)).groupBy("path").agg(F.max(1 - F.col("n") / F.col("total")).alias("recency"))


def cochange(commits: DataFrame, commit_files: DataFrame, seeds: DataFrame, window: int = WINDOW) -> DataFrame:
    """(path, cochange): share of the recent commits that touch a seed path in which a path changed too."""
    recent = commit_files.join(F.broadcast(newest(commits, window).select("sha")), "sha", "left_semi").select("sha", "path").distinct()
    touched = recent.join(seeds.select("path").distinct(), "path", "left_semi").select("sha").distinct()
    total = touched.agg(F.count("*").alias("total"))
    beside = recent.join(touched, "sha", "left_semi").join(seeds.select("path").distinct(), "path", "left_anti")
    return beside.groupBy("path").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("path", (F.col("n") / F.col("total")).alias("cochange"))


def archaeology(commits: DataFrame, commit_files: DataFrame, limit: int | None = 20) -> DataFrame:
    """(path, commits, authors, top_author, top_share) of the files with most commits."""
    each = commit_files.select("sha", "path").distinct().join(commits.select("sha", "author"), "sha").groupBy("path", "author").agg(F.count("*").alias("n"))
    out = each.groupBy("path").agg(
        F.sum("n").alias("commits"),
        F.count("*").alias("authors"),
        F.min_by("author", F.struct(-F.col("n"), "author")).alias("top_author"),
        (F.max("n") / F.sum("n")).alias("top_share"),
    )
    return out if limit is None else out.orderBy(F.desc("commits"), "path").limit(limit)


def current_paths(commit_files: DataFrame, hops: int = 5) -> DataFrame:
    """(path, current): where each path of the history went by renames, the latest one of each old path, up to ``hops``."""
    order = [c for c in ("ts", "row_id") if c in commit_files.columns] or ["sha"]
    step = commit_files.where("old_path is not null and old_path <> path").groupBy(F.col("old_path").alias("at")).agg(F.max_by("path", F.struct(*order)).alias("to"))
    out = commit_files.select("path").union(commit_files.where("old_path is not null").select("old_path")).distinct().withColumn("current", F.col("path"))
    for _ in range(hops):
        out = out.join(step, F.col("current") == F.col("at"), "left").select("path", F.coalesce("to", "current").alias("current"))
    return out


def recency_score(ts: Column, now: int, half_life_days: float = 180.0) -> Column:
    age = F.greatest(F.lit(0.0), (F.lit(now) - ts) / 86400.0)
    return F.when(ts <= 0, F.lit(0.5)).otherwise(F.pow(F.lit(0.5), age / max(1.0, half_life_days)))


def size_penalty(n: Column) -> Column:
    return 1 / F.log(2 + F.greatest(n, F.lit(0)))


def commit_documents(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """(sha, ts, subject, paths, tokens, files): commits as documents to search."""
    paths = commit_files.groupBy("sha").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    body = F.col("body") if "body" in commits.columns else F.lit("")
    joined = commits.withColumn("__body", body).join(paths, "sha")
    return joined.select("sha", "ts", "subject", "paths", commit_tokens(F.col("subject"), F.col("__body"), F.col("paths")).alias("tokens"), F.size("paths").alias("files"))


def search(
    documents: DataFrame, live: DataFrame, tokens: list[str], now: int, seeds: list[str] = (), renames: DataFrame | None = None,
    as_of: int | None = None, exclude: list[str] = (), limit: int = 3, least: float = 0.05, indexed: bool = True, top: int = 20,
) -> DataFrame:
    """(sha, ts, subject, files, score): past changes like a task, best first.

    score = normalised BM25 x half-life recency x size penalty x (1 + overlap of their live files with the seeds). Commits after
    ``as_of``, excluded ones and those of over 40 files are gone before the best are taken."""
    pool = documents.where(F.col("files") <= MAX_FILES)
    if as_of is not None:
        pool = pool.where(F.col("ts") <= as_of)
    if exclude:
        pool = pool.where(~F.col("sha").isin(*exclude))
    if indexed:
        hits = cut(bm25_of(counted(pool, "sha", clean_terms(tokens), prefix=False), "sha", top), "hits")
        best = F.max("bm25").over(Window.partitionBy())
        hits = hits.select("sha", F.least(F.lit(1.0), (F.col("bm25") + 0.5) / (best + 1)).alias("match"))
    else:
        hits = overlap(pool, "sha", tokens, top).withColumnRenamed("score", "match")
    moved = pool.join(F.broadcast(hits.select("sha")), "sha", "left_semi").join(F.broadcast(hits), "sha").select("sha", "ts", "subject", "files", "match", F.explode("paths").alias("path"))
    if renames is not None:
        moved = moved.join(renames, "path", "left").withColumn("path", F.coalesce("current", "path")).drop("current")
    alive = moved.join(live.select("path").distinct(), "path", "left_semi").groupBy("sha", "ts", "subject", "files", "match").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    wanted = F.array(*[F.lit(s) for s in seeds]).cast("array<string>")
    shared, every = F.size(F.array_intersect("paths", wanted)), F.size(F.array_union("paths", wanted))
    score = F.col("match") * recency_score(F.col("ts"), now) * size_penalty(F.col("files")) * (1 + F.when(F.lit(len(seeds)) == 0, F.lit(0.0)).otherwise(shared / every))
    return alive.select("sha", "ts", "subject", F.col("paths").alias("files"), score.alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), F.desc("ts"), "sha").limit(max(1, min(10, limit)))


def cochange_set(analogs: DataFrame, least: int = 2) -> DataFrame:
    """(path, n): files of at least two of the similar changes."""
    return analogs.select("sha", F.explode("files").alias("path")).groupBy("path").agg(F.countDistinct("sha").alias("n")).where(F.col("n") >= least)


def file_group(path: Column) -> Column:
    """test, docs, config or source."""
    return F.when(is_test(path), "test").when(path.rlike(r"(?i)\.(md|mdx|rst|txt)$|^docs/"), "docs").when(path.rlike(r"(?i)\.(json|ya?ml|toml|ini|cfg|env)$|(^|/)\.[^/]+$|\.config\.[a-z]+$"), "config").otherwise("source")


def new_commits(commits: DataFrame, commit_files: DataFrame, known: DataFrame, cap: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Commits not yet indexed and their files: newest ``cap`` (5000 at most), giant ones skipped whole, lock and build files dropped."""
    fresh = commits.dropDuplicates(["sha"]).join(known.select("sha"), "sha", "left_anti").orderBy(F.desc("ts"), "sha").limit(max(1, min(5000, cap)))
    files = commit_files.join(fresh.select("sha"), "sha", "left_semi")
    sized = files.groupBy("sha").agg(F.count("*").alias("n")).where(F.col("n") <= MAX_FILES).select("sha")
    kept = files.join(sized, "sha", "left_semi").where(~is_history_skipped(F.col("path")))
    return fresh.join(kept.select("sha").distinct(), "sha", "left_semi"), kept


def leave_one_out(documents: DataFrame, live: DataFrame, now: int, shas: list[str], limit: int = 3) -> DataFrame:
    """(sha, expected, recalled, recall): for each commit, which of its files the changes before it would have named."""
    spark, rows = documents.sparkSession, []
    for target in documents.where(F.col("sha").isin(*shas)).collect():
        found = search(documents, live, list(target["tokens"]), now, as_of=target["ts"], exclude=[target["sha"]], limit=limit).select(F.explode("files").alias("f")).distinct()
        names = {r["f"] for r in found.collect()}
        hit = len(names & set(target["paths"]))
        rows.append((target["sha"], len(target["paths"]), hit, hit / max(1, len(target["paths"]))))
    return spark.createDataFrame(rows, "sha string, expected int, recalled int, recall double")


def drift(commits: DataFrame, commit_files: DataFrame, saved_ts: int) -> DataFrame:
    """(path, commits): files changed since a saved session."""
    later = commits.where(F.col("ts") > saved_ts).select("sha")
    return commit_files.join(later, "sha", "left_semi").groupBy("path").agg(F.countDistinct("sha").alias("commits"))


def analogs_of_verified(verified: DataFrame, description: str, tokens: list[str], least: float = 0.2, limit: int = 3) -> DataFrame:
    """(id, description, files_json, similarity): verified tasks like this one; the same description counts as 1."""
    from lattica.functions.text import jaccard, tokenize

    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(tokens)]).cast("array<string>")
    same = F.lower(F.trim("description")) == description.strip().lower()
    near = F.when(same, F.lit(1.0)).otherwise(jaccard(tokenize(F.col("description")), wanted))
    return verified.withColumn("similarity", near).where(F.col("similarity") >= least).orderBy(F.desc("similarity"), F.desc("id")).limit(limit)


def cached(documents: DataFrame) -> DataFrame:
    """Commit documents written once for many searches."""
    return cut(documents, "commit-documents")
