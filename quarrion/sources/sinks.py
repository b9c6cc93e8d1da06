"""Writers: replace by key, upsert, token files, reports and backups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.operators.relational import merged
from quarrion.storage import checkpointed


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Replaces all rows of the keys in df and leaves other keys alone; files lie in one folder a key."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], path: str) -> None:
    """Writes the merged table to a new path; readers switch to it when it is complete."""
    merged(old, new, keys).write.mode("errorifexists").parquet(path)


def tokens_gz(df: DataFrame, path: str, column: str = "value") -> None:
    """Distinct values in order, one a line, gzipped."""
    df.select(F.col(column).cast("string")).distinct().orderBy(column).write.option("compression", "gzip").text(path)


def tsv(df: DataFrame, path: str) -> None:
    """Distinct rows in order, tab-separated."""
    df.distinct().orderBy(*df.columns).write.option("sep", "\t").option("quote", "").csv(path)


def report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines and as CSV with a header, below one path."""
    df.write.json(f"{path}/json")
    df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes)).write.option("header", True).csv(f"{path}/csv")


def backup(df: DataFrame, name: str, columns: Sequence[str]) -> None:
    """Keys and columns of a table as a new table; an existing one is not touched."""
    df.select(*columns).write.mode("errorifexists").saveAsTable(name)


def written(df: DataFrame, path: str, changed: str = "changed") -> int:
    """Writes a table that a transition gave to a new path, without its mark; returns the number of changed rows."""
    kept = checkpointed(df)
    kept.drop(changed).write.mode("errorifexists").parquet(path)
    return kept.where(changed).count()


def replace_traces(tables: dict[str, DataFrame], path: str, key: str = "task_id") -> None:
    """The trace tables of one or more tasks, each below the path under its name; earlier rows of the same tasks are replaced."""
    for name, rows in tables.items():
        replace_partitions(rows, f"{path}/{name}", key)


def scan_once(df: DataFrame, *collectors) -> list[DataFrame]:
    """What several collectors make of one scan: it is read once, into a checkpoint that all of them read."""
    kept = checkpointed(df)
    return [collect(kept) for collect in collectors]


def collected(df: DataFrame, path: str, **collectors) -> dict[str, DataFrame]:
    """What several collectors find in one scan, written by one job below a new path, a folder each; the tables by name.

    A collector is an array column of structs, all of one type; each row of df gives the structs of its arrays. df is read
    once and is not kept: only what is collected is written.
    """
    found = F.array(*(F.struct(F.lit(n).alias("collector"), c.alias("rows")) for n, c in collectors.items()))
    rows = df.select(F.explode(found).alias("c")).select("c.collector", F.explode("c.rows").alias("r")).select("collector", "r.*")
    rows.write.mode("errorifexists").partitionBy("collector").parquet(path)
    back = df.sparkSession.read.schema(rows.schema).parquet(path)
    return {n: back.where(F.col("collector") == n).drop("collector") for n in collectors}
