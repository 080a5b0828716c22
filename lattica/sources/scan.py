"""Repositories as tables: listing, ignore rules, hashes, and what changed since the last scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions.paths import IGNORED, is_ignored, is_meta_file, is_secret_file, language


def read_files(spark: SparkSession, root: str, ignore: list[str] = (), keep_content: bool = True) -> DataFrame:
    """(path, language, hash, size, content) of the files below ``root`` that are not ignored, secret or of no interest.

    Works on any file system Spark reads. Paths are filtered before contents are touched."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    top = F.lit(root.rstrip("/").split("://")[-1].split(":")[-1] + "/")
    full = F.regexp_replace(F.col("path"), "^[a-z]+:(//[^/]*)?", "")
    path = F.substring(full, F.instr(full, top) + F.length(top), F.length(full))
    return indexable(raw.withColumn("path", path), list(ignore)).select("path", language(F.col("path")).alias("language"), F.sha2("content", 256).alias("hash"), F.col("length").alias("size"), *([F.make_valid_utf8(F.col("content").cast("string")).alias("content")] if keep_content else []))


def indexable(listing: DataFrame, ignore: list[str] = (), protected: list[str] | None = None) -> DataFrame:
    """Rows whose path is a source file or one indexed by name only, and neither ignored nor secret."""
    p = F.col("path")
    return listing.where(~is_ignored(p, list(ignore)) & ~is_secret_file(p) & ((language(p) != "other") | is_meta_file(p, protected)))


def ignore_lines(text: str) -> list[str]:
    return [x for x in (line.strip() for line in text.splitlines()) if x and not x.startswith("#")]


def default_ignores() -> list[str]:
    return list(IGNORED)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` and removed rows of ``old`` with a status: inserted, updated, unchanged, removed; matched by path, compared by hash."""
    columns = [c for c in new.columns if c != "hash"]
    o = old.select(*(F.col(c).alias(f"old_{c}") for c in old.columns))
    both = new.join(o, F.col("path") == F.col("old_path"), "full_outer")
    status = F.when(F.col("old_path").isNull(), "inserted").when(F.col("path").isNull(), "removed").when(F.col("hash") != F.col("old_hash"), "updated").otherwise("unchanged")
    kept: list[Column] = [F.coalesce(F.col(c), F.col(f"old_{c}")).alias(c) if c in old.columns else F.col(c) for c in columns]
    return both.select(*kept, F.coalesce("hash", "old_hash").alias("hash"), status.alias("status"))


def delta(status: DataFrame) -> DataFrame:
    """(status, n) of :func:`changes`."""
    return status.groupBy("status").agg(F.count("*").alias("n"))


def changed_only(listing: DataFrame, dirty: DataFrame, known: DataFrame) -> DataFrame:
    """Rows worth reading in a quick scan: what is reported dirty and what is not indexed yet."""
    unknown = listing.join(known.select("path"), "path", "left_anti").select("path")
    return listing.join(dirty.select("path").union(unknown).distinct(), "path", "left_semi")


def stable_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` symbols (file, type, name, start_line) with ids: the k-th of a file, type and name keeps the id of the k-th before; others get new ones."""
    key = ["file", "type", "name"]
    n = old.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).select(*key, "k", "id")
    m = new.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("start_line")))
    joined = m.join(n, [*key, "k"], "left")
    fresh = joined.where("id is null").drop("id")
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    # new ids: a running number inside each file, and the number of new rows in the files before it
    sizes = fresh.groupBy("file").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).select("file", "before")
    place = F.row_number().over(Window.partitionBy("file").orderBy("start_line", "type", "name", "k"))
    numbered = fresh.withColumn("place", place).join(before, "file").crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.col("before") + F.col("place"))
    columns = [*new.columns, "id"]
    return joined.where("id is not null").select(columns).unionByName(numbered.select(columns))


def decode_git_path(raw: str) -> str:
    """A path as git prints it: quoted with C escapes and octal bytes where it must be."""
    if not (len(raw) >= 2 and raw[0] == raw[-1] == '"'):
        return raw
    out, i, body = bytearray(), 0, raw[1:-1]
    plain = {"n": 10, "t": 9, "r": 13, '"': 34, "\\": 92, "a": 7, "b": 8, "f": 12, "v": 11}
    while i < len(body):
        if body[i] == "\\" and i + 1 < len(body):
            if body[i + 1] in "01234567":
                out.append(int(body[i + 1 : i + 4], 8) & 255)
                i += 4
                continue
            out.append(plain.get(body[i + 1], ord(body[i + 1])))
            i += 2
            continue
        out += body[i].encode()
        i += 1
    return out.decode("utf-8", "replace")


def git_status(lines: DataFrame) -> DataFrame:
    """(path, status, old_path) of the lines (line) of a porcelain status."""
    code, rest = F.trim(F.substring("line", 1, 2)), F.substring(F.col("line"), F.lit(4), F.length("line"))
    moved = F.instr(rest, " -> ") > 0
    return lines.select(F.when(moved, F.substring_index(rest, " -> ", -1)).otherwise(rest).alias("path"), code.alias("status"), F.when(moved, F.substring_index(rest, " -> ", 1)).alias("old_path"))
