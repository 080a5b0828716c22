"""The index: one DataFrame per canonical table, kept as a directory of parquet snapshots."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.schema import KEYS, TABLES, conform


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key is not among them."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def first_only(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def cascade(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``tables`` without rows that refer to files, symbols, tasks or commits that are gone."""
    out = dict(tables)

    def keep(name: str, column: str, of: str, key: str = "id") -> None:
        if name in out and of in out:
            out[name] = out[name].join(out[of].select(F.col(key).alias(column)), column, "left_semi").select(*out[name].columns)

    keep("symbols", "file_id", "files")
    for column in ("source_id", "target_id"):
        keep("relationships", column, "symbols")
    for name, column in (("node_metrics", "node_id"), ("clusters", "node_id"), ("fanin", "node_id"), ("task_context", "symbol_id"), ("symbol_index", "symbol_id"), ("symbol_coverage", "symbol_id")):
        keep(name, column, "symbols")
    keep("commit_files", "sha", "commits", "sha")
    return out


def missing_and_orphans(nodes: DataFrame, cache: DataFrame, key: str = "node_id") -> DataFrame:
    """(id, status): nodes without a row in ``cache`` are missing, rows of ``cache`` without a node are orphans."""
    ids, kept = nodes.select("id"), cache.select(F.col(key).alias("id"))
    missing = ids.join(kept, "id", "left_anti").select("id", F.lit("missing").alias("status"))
    return missing.unionByName(kept.join(ids, "id", "left_anti").select("id", F.lit("orphan").alias("status")))


def is_stale(nodes: DataFrame, edges: DataFrame, cache: DataFrame, fingerprint: str | None) -> bool:
    """Whether metrics must be worked out again: nodes came or went, or edges did since ``fingerprint``."""
    return graph_fingerprint(nodes, edges) != fingerprint or not missing_and_orphans(nodes, cache).isEmpty()


def graph_fingerprint(nodes: DataFrame, edges: DataFrame) -> str:
    """symbols:relationships:largest relationship id."""
    n = nodes.count()
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()
    return f"{n}:{row['n']}:{row['top']}"


@dataclass
class Index:
    """Canonical tables by name. Missing ones are empty."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        if name not in self.tables:
            self.tables[name] = self.spark.createDataFrame([], TABLES[name])
        return self.tables[name]

    def with_tables(self, **tables: DataFrame) -> Index:
        return Index(self.spark, {**self.tables, **{k: conform(v, k) for k, v in tables.items()}})

    def put(self, name: str, rows: DataFrame) -> Index:
        """Upsert ``rows`` by the table's key."""
        return self.with_tables(**{name: upsert(getattr(self, name), conform(rows, name), KEYS[name])})

    def cleaned(self) -> Index:
        return Index(self.spark, cascade(self.tables))

    def save(self, root: str) -> str:
        """Write a snapshot and then point to it: a reader sees the whole old one or the whole new one."""
        name = f"snapshot-{uuid.uuid4().hex}"
        for table, df in self.tables.items():
            df.write.parquet(f"{root}/{name}/{table}")
        self.spark.createDataFrame([(name, ",".join(sorted(self.tables)))], "snapshot string, tables string").coalesce(1).write.mode("overwrite").json(f"{root}/current")
        return f"{root}/{name}"

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Index:
        row = spark.read.schema("snapshot string, tables string").json(f"{root}/current").first()
        return cls(spark, {t: spark.read.schema(TABLES[t]).parquet(f"{root}/{row['snapshot']}/{t}") for t in row["tables"].split(",") if t})
