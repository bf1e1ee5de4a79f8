"""Keeping one row of several, joining against what is known, repeating rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key. Spark limits the rows of a key before the shuffle."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def new_first(df: DataFrame, key: str, order: list[Column], known: DataFrame, known_key: str) -> DataFrame:
    """The first row of every key that isn't among the known keys. Null keys are dropped."""
    known = known.select(F.col(known_key).alias(key)).where(F.col(key).isNotNull())
    return first_of(df.where(F.col(key).isNotNull()).join(known, key, "left_anti"), [key], order)


def append_up_to(stored: DataFrame, fresh: DataFrame, entity: str, value: str, order: list[Column], most: int) -> DataFrame:
    """The fresh rows to be stored: of each entity the first (most - stored) ones, each value once and none that is stored already."""
    have = stored.groupBy(entity).agg(F.count("*").alias("_have"))
    fresh = fresh.join(have, entity, "left").withColumn("_k", F.row_number().over(Window.partitionBy(entity).orderBy(*order)))
    fresh = fresh.where(F.col("_k") <= most).where(F.col("_k") <= F.lit(most) - F.coalesce("_have", F.lit(0))).drop("_k", "_have")
    return first_of(fresh, [entity, value], order).join(stored.select(entity, value), [entity, value], "left_anti")


def repeated(df: DataFrame, times: Column | int, name: str = "attempt_idx") -> DataFrame:
    """Every row `times` times, numbered from 0; none for less than one."""
    n = F.lit(times) if isinstance(times, int) else times
    return df.withColumn(name, F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))


def cycled(items: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """n rows of each group: its items in order, over and over. `turn` is 0 to n - 1. Spark limits the rows of a group before the shuffle."""
    many = items.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_m"))
    placed = items.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_i") <= n)
    placed = placed.join(many, F.col(group).eqNullSafe(F.col("_group")))
    turns = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda t: t % F.col("_m") == F.col("_i") - 1)
    return placed.withColumn("turn", F.explode(turns)).drop("_i", "_m", "_group")
