"""The text of a git log as commits and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FORMAT = "%x01%H%x1f%ct%x1f%an%x1f%s%x1f%b%x1e"


def records(text: DataFrame) -> DataFrame:
    """(n, sha, ts, author, subject, body, rest): one row per framed record of the log texts (text)."""
    part = text.select(F.posexplode(F.split("text", "\u0001")).alias("n", "record")).where("record <> ''")
    head = F.split(F.substring_index("record", "\u001e", 1), "\u001f")
    return part.select("n", head[0].alias("sha"), F.try_element_at(head, F.lit(2)).cast("long").alias("ts"), F.coalesce(F.try_element_at(head, F.lit(3)), F.lit("")).alias("author"), F.coalesce(F.try_element_at(head, F.lit(4)), F.lit("")).alias("subject"), F.trim(F.coalesce(F.try_element_at(head, F.lit(5)), F.lit(""))).alias("body"), F.substring_index("record", "\u001e", -1).alias("rest")).where("sha <> ''")


def commits(text: DataFrame) -> DataFrame:
    return records(text).select("sha", "ts", "subject", "body", "author").dropDuplicates(["sha"])


def commit_files(text: DataFrame) -> DataFrame:
    """(sha, path, status, old_path, additions, deletions): counts from the numstat lines, status and old path from the name-status ones."""
    lines = records(text).select("sha", F.explode(F.split("rest", "\r?\n")).alias("line")).where("line <> ''").withColumn("f", F.split("line", "\t"))
    size = F.size("f")
    number = lambda i: F.when(F.col("f")[i] == "-", 0).otherwise(F.try_to_number(F.col("f")[i], F.lit("9999999999"))).cast("long")
    plain = F.regexp_replace(F.regexp_replace(F.col("f")[2], r"\{[^{}]* => ([^{}]*)\}", "$1"), "//", "/")
    target = F.when(F.col("f")[2].contains("{"), plain).when(F.col("f")[2].contains(" => "), F.regexp_replace(F.col("f")[2], "^.* => ", "")).otherwise(F.col("f")[2])
    counts = lines.where((size == 3) & F.col("f")[0].rlike(r"^(\d+|-)$")).select("sha", target.alias("path"), number(0).alias("additions"), number(1).alias("deletions"))
    status = lines.where(F.col("f")[0].rlike(r"^[ACDMRTU]\d*$")).select("sha", F.element_at("f", -1).alias("path"), F.substring(F.col("f")[0], 1, 1).alias("status"), F.when(size == 3, F.col("f")[1]).alias("old_path"))
    both = counts.join(status, ["sha", "path"], "full_outer")
    return both.select("sha", "path", F.coalesce("status", F.lit("M")).alias("status"), "old_path", F.coalesce("additions", F.lit(0)).alias("additions"), F.coalesce("deletions", F.lit(0)).alias("deletions"))


def diff_lines(diff: DataFrame) -> DataFrame:
    """(file, line, sign, text) of unified diffs (diff_id, text): line is that of the new file, null for removed lines.

    The file and the hunk are carried forward and new lines are counted by windows over each diff."""
    rows = diff.select("diff_id", F.posexplode(F.split("text", "\r?\n")).alias("n", "text"))
    order = Window.partitionBy("diff_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    header = F.col("text").rlike(r"^(diff --git|index |--- |\+\+\+ |old mode|new mode|similarity|rename |new file|deleted file|\\ No newline)")
    name = F.nullif(F.regexp_extract("text", r"^\+\+\+ (?:b/)?(.+)$", 1), F.lit(""))
    start = F.nullif(F.regexp_extract("text", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1), F.lit("")).cast("int")
    marked = rows.withColumn("file", F.last(name, ignorenulls=True).over(order)).withColumn("start", start).withColumn("hunk", F.sum(F.col("start").isNotNull().cast("int")).over(order)).withColumn("header", header)
    body = marked.where("hunk > 0 and start is null and not header and text <> ''").withColumn("sign", F.substring("text", 1, 1)).where(F.col("sign").isin("+", "-", " "))
    starts = marked.where("start is not null").select("diff_id", "hunk", F.col("start").alias("from"))
    inside = Window.partitionBy("diff_id", "hunk").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    counted = body.join(starts, ["diff_id", "hunk"]).withColumn("line", F.col("from") + F.sum((F.col("sign") != "-").cast("int")).over(inside) - 1)
    return counted.select("file", F.when(F.col("sign") != "-", F.col("line")).alias("line"), "sign", F.substring(F.col("text"), F.lit(2), F.length("text")).alias("text"))


def changed_lines(diff: DataFrame) -> DataFrame:
    """(file, line): distinct new lines of the hunks of unified diffs."""
    rows = diff.select("diff_id", F.posexplode(F.split("text", "\r?\n")).alias("n", "text"))
    order = Window.partitionBy("diff_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    name = F.nullif(F.regexp_extract("text", r"^\+\+\+ (?:b/)?(.+)$", 1), F.lit(""))
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    marked = rows.withColumn("file", F.last(name, ignorenulls=True).over(order)).where(F.col("text").rlike(hunk))
    first, count = F.regexp_extract("text", hunk, 1).cast("int"), F.coalesce(F.nullif(F.regexp_extract("text", hunk, 2), F.lit("")).cast("int"), F.lit(1))
    return marked.where(count > 0).select("file", F.explode(F.sequence(first, first + count - 1)).alias("line")).distinct()


def is_code_line(text):
    """Lines that can be executed: not blank, not a comment, not only brackets, not an import."""
    t = F.trim(text)
    return ~(t == "") & ~t.rlike(r"^(//|#|/\*|\*|\*/|<!--)") & ~t.rlike(r"^[\[\](){};,]+$") & ~t.rlike(r"^(import|from|package|using|export \{|export \*)\b")
