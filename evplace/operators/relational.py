"""Joins, duplicates and assertions that all pipelines here share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) in ``order``. Partial aggregation, so repeated rows never meet in one task."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order)
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*[F.col(f"`{c}`") for c in rest]), rank).alias("__r")).select(*keys, *[F.col(f"__r.`{c}`").alias(c) for c in rest]).select(*df.columns)


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, or an error naming a key that repeats."""
    again = df.groupBy(*keys).count().where("count > 1").head()
    if again is not None:
        raise ValueError(f"duplicate key {again.asDict()}")
    return df


def require_joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The inner join, or an error if a row of ``left`` has no partner."""
    lost = left.join(right, list(keys), "left_anti").head()
    if lost is not None:
        raise ValueError(f"no partner for {[lost[k] for k in keys]}")
    return left.join(right, list(keys))


def require_same_count(*frames: DataFrame) -> None:
    counts = {f.count() for f in frames}
    if len(counts) > 1:
        raise ValueError(f"row counts differ: {sorted(counts)}")


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no result yet (resume by key)."""
    return todo.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def with_ordinal(df: DataFrame, order: Sequence[str | Column], name: str = "block_id") -> DataFrame:
    """1-based position in the order, without gathering the rows in one task.

    Rows are range-partitioned by the order and counted per partition; only the counts reach the driver.
    """
    from pyspark.sql import window as W

    from ..session import materialise

    key = F.struct(*order)
    ranged = materialise(df.withColumn("__k", key).repartitionByRange(F.col("__k")).withColumn("__part", F.spark_partition_id()), "ordinal")
    counts = sorted(ranged.groupBy("__part").count().collect())
    start, offsets = 0, []
    for part, n in counts:
        offsets.append((part, start))
        start += n
    base = F.create_map(*[F.lit(x) for kv in offsets for x in kv]) if offsets else F.lit(None).cast("map<int,int>")
    place = F.row_number().over(W.Window.partitionBy("__part").orderBy("__k"))
    return ranged.withColumn(name, (place + base[F.col("__part")]).cast("long")).drop("__k", "__part")


def rename_missing(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename columns, but only onto names that are still free."""
    for old, new in names.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def first_column(df: DataFrame, *names: str) -> Column:
    """The first of the columns that exists and is not null."""
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None)
