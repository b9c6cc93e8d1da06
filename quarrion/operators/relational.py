"""Lists, lookups, summaries and set operations over tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrion.functions.text import is_blank
from quarrion.storage import by_merge


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema in its order; those that df lacks are typed nulls."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of those conditions that are given."""
    return reduce(lambda x, y: x & y, (c for c in conditions if c is not None), F.lit(True))


def any_of(*conditions: Column | None) -> Column:
    return reduce(lambda x, y: x | y, (c for c in conditions if c is not None), F.lit(False))


def holds_text(value: str | None, *columns: str) -> Column | None:
    """A substring in any of the columns, case ignored; no condition without a value."""
    return any_of(*(F.col(c).ilike(f"%{value}%") for c in columns)) if value else None


def equals(value, column: str) -> Column | None:
    return F.col(column) == value if value is not None else None


def within(column: str, low=None, high=None) -> Column | None:
    """A closed range of which either end may be open."""
    return all_of(F.col(column) >= F.lit(low) if low is not None else None, F.col(column) <= F.lit(high) if high is not None else None)


def one_of(column: str, values: Sequence) -> Column:
    """Membership in a list of ids, trimmed, distinct and sorted; an empty list gives an empty result."""
    wanted = sorted({v.strip() if isinstance(v, str) else v for v in values} - {"", None})
    return F.col(column).isin(wanted) if wanted else F.lit(False)


def missing_any(*columns: str) -> Column:
    return any_of(*(is_blank(c) for c in columns))


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20, largest: int = 100) -> DataFrame:
    """One page of an ordered list; the number is 1 at least, the size between 1 and ``largest``."""
    size = min(max(1, size), largest)
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_with(df: DataFrame, key: str, order: Sequence[Column], lookups: Sequence[tuple[DataFrame, Column]], number: int = 1, size: int = 20, largest: int = 100) -> DataFrame:
    """A page whose keys are found first; only the rows of the page meet the lookup tables."""
    keys = page(df, order, number, size, largest).select(F.col(key).alias("_key"))
    rows = df.join(F.broadcast(keys), df[key] == F.col("_key")).drop("_key")  # at most ``largest`` keys
    for right, on in lookups:
        rows = rows.join(right, on, "left")
    return rows.orderBy(*order)


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")


def split_repeated(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """All rows with ``accepted``: true for the first of a key, false for later ones."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("accepted", F.row_number().over(at) == 1)


def numbered(df: DataFrame, order: Sequence[Column], name: str = "seq", by: Sequence[str] = ()) -> DataFrame:
    """Rows numbered from 1 in the given order, inside each group if there are groups.

    Without groups all rows meet in one task: for results of a report's size.
    """
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_seen(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Distinct keys numbered in the order in which they first occur."""
    seen = df.groupBy(*keys).agg(F.min(order).alias("first_at"))
    return numbered(seen, [F.col("first_at"), *(F.col(k) for k in keys)])


def top_share(df: DataFrame, label: str, head: int = 10, other: str = "other", fallback: str = "unknown", least: float = 3.0) -> DataFrame:
    """Counts by label: the first ``head`` and one row for the rest, with percent and bar width.

    Blank labels count under the fallback; ties go by name; ``other`` stands last whatever its count.
    Only the first labels are ranked; the rest is what they leave of all.
    """
    named = df.select(F.when(is_blank(label), F.lit(fallback)).otherwise(F.trim(F.col(label).cast("string"))).alias("label"))
    counts = named.groupBy("label").agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), "label").limit(head).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "label")))  # ``head`` rows
    total = counts.agg(F.sum("n").alias("total"))
    rest = total.crossJoin(first.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("taken"))).where("total > taken").select(F.lit(other).alias("label"), (F.col("total") - F.col("taken")).alias("n"), F.lit(head + 1).alias("rank"))
    parts = first.unionByName(rest).crossJoin(F.broadcast(total))  # one row
    percent = F.round(F.col("n") * 100.0 / F.col("total"), 1)
    return parts.select("rank", "label", "n", percent.alias("percent"), F.greatest(percent, F.lit(least)).alias("bar"))


def ratio_percent(part: Column, whole: Column) -> Column:
    """A percentage with two decimals, 0 of nothing."""
    return F.coalesce(F.round(F.try_divide(part, whole) * 100, 2), F.lit(0.0))


def daily(branches: Sequence[tuple[DataFrame, str, str, Column | None]], first, last) -> DataFrame:
    """A calendar from first to last day with one count a branch (rows, date column, name, condition), zero where there is none."""
    names = [name for _, _, name, _ in branches]
    parts = []
    for df, at, name, condition in branches:
        rows = df if condition is None else df.where(condition)
        parts.append(rows.select(F.to_date(at).alias("day"), *((F.lit(1) if n == name else F.lit(0)).alias(n) for n in names)).where(F.col("day").between(F.lit(first), F.lit(last))))
    counts = reduce(DataFrame.unionByName, parts).groupBy("day").agg(*(F.sum(n).alias(n) for n in names))
    spark = branches[0][0].sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day"))).alias("day"))
    return calendar.join(counts, "day", "left").select("day", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names))


def common_features(members: DataFrame, group: str, node: str, feature: str) -> DataFrame:
    """(group, feature) of the features that every node of a group has."""
    size = members.groupBy(group).agg(F.count_distinct(node).alias("_size"))
    has = members.groupBy(group, feature).agg(F.count_distinct(node).alias("_has"))
    return has.join(by_merge(size), group).where("_has = _size").select(group, feature)


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert: a non-null value of the new row wins, rows of either side stay."""
    rest = [c for c in old.columns if c not in keys]
    a, b = old.alias("a"), new.alias("b")
    on = all_of(*(F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys))
    pick = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in new.columns else F.col(f"a.{c}")
    return a.join(b, on, "full").select(*(F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in keys), *(pick(c) for c in rest))


def replaced_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that new has are replaced by its rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def by_id_or_position(rows: DataFrame, steps: DataFrame, id_col: str, pos_col: str, step_id: str, step_pos: str) -> DataFrame:
    """rows with the step found by id, or by position where the id is missing or unknown (``matched_id``)."""
    ids = steps.select(F.col(step_id).alias("_by_id")).distinct()
    at = steps.groupBy(F.col(step_pos).alias("_pos")).agg(F.min(step_id).alias("_by_pos"))
    found = rows.join(ids, rows[id_col] == ids["_by_id"], "left").join(at, rows[pos_col] == at["_pos"], "left")
    return found.withColumn("matched_id", F.coalesce("_by_id", "_by_pos")).drop("_by_id", "_by_pos", "_pos")


def capped_list(df: DataFrame, key: Sequence[str], value: str, order: Sequence[Column], most: int) -> DataFrame:
    """The first values of each key, as a list in order; the ranking keeps the list short before it is collected."""
    at = Window.partitionBy(*key).orderBy(*order)
    few = df.withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= most)
    return few.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda x: x[value]).alias(value))


def nearest_version(rows: DataFrame, known: DataFrame, equal: Sequence[str], version: str) -> DataFrame:
    """For each row the known entry with the same ``equal`` columns whose version (array of numbers) is nearest.

    Distances are compared element by element; at ties the higher version wins. Each version is compared once, however many
    rows have it; equal rows count once.
    """
    asked = rows.select(*equal, version).distinct()
    met = asked.join(known.select(*equal, F.col(version).alias("found_version")).distinct(), list(equal))
    off = F.zip_with(version, "found_version", lambda x, y: F.abs(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    nearest = met.groupBy(*equal, version).agg(F.min_by("found_version", F.struct(off.alias("d"), F.transform("found_version", lambda x: -x).alias("v"))).alias("found_version"))
    a, b = rows.distinct().alias("a"), nearest.alias("b")
    on = all_of(*(F.col(f"a.{c}") == F.col(f"b.{c}") for c in equal), F.col(f"a.{version}").eqNullSafe(F.col(f"b.{version}")))
    return a.join(b, on).select("a.*", "b.found_version")

