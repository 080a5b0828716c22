"""The driver's tables as canonical tables: parts are files and symbols, order lines are edges and changes."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.schema import DEFINITIONS, evidence_of, weight_of
from lattica.scratch import dealt

SUPPLIERS = 1_000_000_000
SUPPLY_EDGES = 1_000_000_000_000


class Data:
    """Canonical tables of one directory, each read when first used."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def files(self) -> DataFrame:
        path = F.concat_ws("/", "p_brand", "p_type", "p_name", F.col("p_partkey").cast("string"))
        return self.table("part").select(F.col("p_partkey").alias("id"), path.alias("path"), F.col("p_type").alias("language"), F.col("p_size").cast("long").alias("size"))

    @cached_property
    def symbols(self) -> DataFrame:
        kinds = F.array(*[F.lit(k) for k in DEFINITIONS])
        signature = F.concat(F.col("p_name"), F.lit("("), F.col("p_size").cast("string"), F.lit(")"))
        parts = self.table("part").select(
            F.col("p_partkey").alias("id"), F.col("p_partkey").alias("file_id"), F.col("p_name").alias("name"), F.element_at(kinds, F.col("p_size") % 6 + 1).alias("type"),
            signature.alias("signature"), F.col("p_size").cast("int").alias("start_line"), (F.col("p_size") + F.col("p_size") % 7).cast("int").alias("end_line"), F.lit("").alias("doc"),
        )
        suppliers = self.table("supplier").select(
            (F.col("s_suppkey") + SUPPLIERS).alias("id"), F.col("s_suppkey").alias("file_id"), F.col("s_name").alias("name"), F.lit("file").alias("type"), F.lit("").alias("signature"),
            F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("").alias("doc"),
        )
        return parts.unionByName(suppliers)

    @cached_property
    def follows(self) -> DataFrame:
        """(source_id, target_id): distinct neighbours in an order."""
        place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        lines = dealt(self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey")
        pairs = lines.select(F.col("l_partkey").alias("source_id"), F.lead("l_partkey").over(place).alias("target_id"))
        return dealt(pairs.where("target_id is not null and source_id <> target_id"), "source_id", "target_id").distinct()

    @cached_property
    def edges(self) -> DataFrame:
        kind = F.element_at(F.array(F.lit("CALLS"), F.lit("IMPORTS"), F.lit("REFERENCES")), ((F.col("source_id") + F.col("target_id")) % 3 + 1).cast("int"))
        confidence = F.when((F.col("source_id") * 3 + F.col("target_id")) % 5 == 0, 0.6).otherwise(1.0)
        inner = self.follows.select((F.col("source_id") * 1_000_000 + F.col("target_id")).alias("id"), "source_id", "target_id", kind.alias("relationship_type"), confidence.alias("confidence"))
        supplies = dealt(self.table("lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey").distinct().select(
            (F.col("l_suppkey") * 1_000_000 + F.col("l_partkey") + SUPPLY_EDGES).alias("id"), (F.col("l_suppkey") + SUPPLIERS).alias("source_id"), F.col("l_partkey").alias("target_id"), F.lit("USES").alias("relationship_type"), F.lit(1.0).alias("confidence")
        )
        return inner.unionByName(supplies).select("id", "source_id", "target_id", "relationship_type", weight_of(F.col("relationship_type")).alias("weight"), "confidence", evidence_of(F.col("relationship_type"), F.col("confidence")).alias("evidence"))

    @cached_property
    def inner_edges(self) -> DataFrame:
        return self.edges.where(F.col("source_id") < SUPPLIERS)

    @cached_property
    def commits(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").cast("string").alias("sha"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts"), F.col("o_orderpriority").alias("subject"), F.lit("").alias("body"), F.col("o_custkey").cast("string").alias("author"))

    @cached_property
    def commit_files(self) -> DataFrame:
        return self._changes(self.table("lineitem"))

    def changes_of(self, commits: DataFrame) -> DataFrame:
        """:attr:`commit_files` of a few ``commits`` (sha): the rest goes before anything is summed or joined."""
        lines = self.table("lineitem").withColumn("sha", F.col("l_orderkey").cast("string"))
        return self._changes(lines.join(F.broadcast(commits.select("sha")), "sha", "left_semi"))

    def _changes(self, lines: DataFrame) -> DataFrame:
        rows = lines.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").cast("long").alias("additions"))
        paths = self.files.select(F.col("id").alias("l_partkey"), "path")
        return rows.join(paths, "l_partkey").select(F.col("l_orderkey").cast("string").alias("sha"), "path", F.lit("M").alias("status"), F.lit(None).cast("string").alias("old_path"), "additions", F.lit(0).cast("long").alias("deletions"))

    @cached_property
    def invocations(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("task_id"), F.col("event_type").alias("command"), F.col("ts").cast("timestamp").alias("timestamp"))

    @cached_property
    def tasks(self) -> DataFrame:
        return self.invocations.where("command = 'view'").groupBy(F.col("task_id").alias("id")).agg(F.min("timestamp").alias("created_at")).select("id", F.concat(F.lit("task "), F.col("id").cast("string")).alias("description"), "created_at")

    @cached_property
    def coverage(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("line")).agg(F.count("*").alias("hits"))


#: The same tables in SQL, as common table expressions for the oracle queries.
BASE = f"""
files AS (SELECT p_partkey AS id, p_brand || '/' || p_type || '/' || p_name || '/' || CAST(p_partkey AS VARCHAR) AS path, p_type AS language, CAST(p_size AS BIGINT) AS size FROM part),
symbols AS (
  SELECT p_partkey AS id, p_partkey AS file_id, p_name AS name, (['class','component','function','interface','method','type'])[p_size % 6 + 1] AS type,
         p_name || '(' || CAST(p_size AS VARCHAR) || ')' AS signature, p_size AS start_line, p_size + p_size % 7 AS end_line FROM part
  UNION ALL SELECT s_suppkey + {SUPPLIERS}, s_suppkey, s_name, 'file', '', 1, 1 FROM supplier),
follows AS (SELECT DISTINCT source_id, target_id FROM (SELECT l_partkey AS source_id, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS target_id FROM lineitem) z
  WHERE target_id IS NOT NULL AND source_id <> target_id),
typed AS (SELECT source_id * 1000000 + target_id AS id, source_id, target_id, (['CALLS','IMPORTS','REFERENCES'])[(source_id + target_id) % 3 + 1] AS relationship_type,
  CASE WHEN (source_id * 3 + target_id) % 5 = 0 THEN 0.6 ELSE 1.0 END AS confidence FROM follows
  UNION ALL SELECT l_suppkey * 1000000 + l_partkey + {SUPPLY_EDGES}, l_suppkey + {SUPPLIERS}, l_partkey, 'USES', 1.0 FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) y),
edges AS (SELECT id, source_id, target_id, relationship_type, CAST(CASE relationship_type WHEN 'CALLS' THEN 0.7 WHEN 'IMPORTS' THEN 0.9 ELSE 0.5 END AS DOUBLE) AS weight, CAST(confidence AS DOUBLE) AS confidence,
  CASE WHEN relationship_type IN ('REFERENCES', 'USES') THEN 'AMBIGUOUS' WHEN confidence >= 1 THEN 'EXTRACTED' ELSE 'INFERRED' END AS evidence FROM typed),
inner_edges AS (SELECT * FROM edges WHERE source_id < {SUPPLIERS}),
commits AS (SELECT CAST(o_orderkey AS VARCHAR) AS sha, CAST(epoch(o_orderdate) AS BIGINT) AS ts, o_orderpriority AS subject, CAST(o_custkey AS VARCHAR) AS author FROM orders),
commit_files AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS sha, f.path FROM lineitem JOIN files f ON f.id = l_partkey),
invocations AS (SELECT event_id AS id, user_id AS task_id, event_type AS command, ts AS timestamp FROM events),
tasks AS (SELECT task_id AS id, 'task ' || CAST(task_id AS VARCHAR) AS description, min(timestamp) AS created_at FROM invocations WHERE command = 'view' GROUP BY task_id),
coverage AS (SELECT l_partkey AS file, l_linenumber AS line, count(*) AS hits FROM lineitem GROUP BY ALL)"""


def sql(body: str, *more: str, recursive: bool = False) -> str:
    """An oracle query over the canonical tables; only the expressions it names are put in."""
    import re

    parts = dict(re.findall(r"^(\w+) AS (\(.*?)(?=,\n\w+ AS |\Z)", BASE.strip(), re.S | re.M))
    needed: list[str] = []

    def need(text: str) -> None:
        for name in parts:
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(parts[name])
                if name not in needed:
                    needed.append(name)

    need(" ".join([body, *more]))
    names = [f"{n} AS {parts[n]}" for n in parts if n in needed] + list(more)
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(names) + "\n" if names else "") + body
