"""Operators on a total order, without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmalake.storage import materialize


def ordinals(df: DataFrame, *keys: str, name: str = "ordinal") -> DataFrame:
    """Adds the 0-based place of every row in the order of the keys, which must identify a row.

    The rows are range-partitioned and written once; only the row count of each partition is summed up centrally.
    """
    parts = materialize(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ordered")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # a row a partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return parts.withColumn("_k", place).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_k")).drop("_part", "_k", "_before")


def running_total(df: DataFrame, amount: str, *keys: str, name: str = "up_to") -> DataFrame:
    """Adds the sum of `amount` of all rows up to each one, in the order of the keys, which must identify a row; laid out as ordinals() does."""
    parts = materialize(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ordered")
    sums = parts.groupBy("_part").agg(F.sum(amount).alias("_n"))
    before = sums.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # a row a partition
    inside = F.sum(amount).over(Window.partitionBy("_part").orderBy(*keys))
    return parts.withColumn(name, inside).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def previous(df: DataFrame, group: str, keys: list[str], columns: list[str], name: str = "before") -> DataFrame:
    """Adds a struct of the columns of the row before within the group, in the order of the keys; null for the first one.

    The rows are laid out as ordinals() does, so that a group of any size is spread over tasks; a task's first row finds the last one of the task
    before it. The keys must identify a row of the group.
    """
    parts = materialize(df.repartitionByRange(group, *keys).withColumn("_part", F.spark_partition_id()), "ordered")
    row = F.struct(*columns)
    lasts = parts.groupBy("_part").agg(F.max_by(F.struct(F.col(group).alias("g"), row.alias("r")), F.struct(group, *keys)).alias("_last"))
    lasts = lasts.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_last"))  # a row a partition
    inside = F.lag(row).over(Window.partitionBy("_part", group).orderBy(*keys))
    both = parts.withColumn("_inside", inside).join(F.broadcast(lasts), "_part")
    over = F.when(F.col("_last.g").eqNullSafe(F.col(group)) & F.col("_last").isNotNull(), F.col("_last.r"))
    return both.withColumn(name, F.coalesce("_inside", over)).drop("_part", "_inside", "_last")


def chunks(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Adds `chunk`: exactly n contiguous chunks, the first of which are one row larger where n doesn't divide the rows. As ntile(n) - 1."""
    placed = ordinals(df, *keys)
    total = placed.agg(F.count("*").alias("_total"))
    size, extra = F.floor(F.col("_total") / n), F.col("_total") % n
    head = extra * (size + 1)
    chunk = F.when(F.col("ordinal") < head, F.floor(F.col("ordinal") / (size + 1))).otherwise(extra + F.floor((F.col("ordinal") - head) / F.greatest(size, F.lit(1))))
    return placed.crossJoin(F.broadcast(total)).withColumn("chunk", chunk.cast("long")).drop("_total")  # one row


def shards(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Adds `shard`: the rows dealt to n shards in turn."""
    return ordinals(df, *keys).withColumn("shard", F.col("ordinal") % n)


def hash_order(key: Column, seed: int) -> Column:
    """A pseudo-random order that is the same everywhere: the hexadecimal MD5 of the key and a seed."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), key.cast("string")))


def epoch_batch(df: DataFrame, key: str, size: int, iteration: int, seed: int) -> DataFrame:
    """The batch of an iteration: each epoch goes through all rows once, in an order of its own.

    With b batches an epoch, iteration i is batch i % b of epoch i / b; the last batch of an epoch may be smaller. No rows give none.
    """
    total = df.count()
    batches = max(1, -(-total // size))
    epoch, batch = divmod(iteration, batches)
    placed = ordinals(df.withColumn("_h", hash_order(F.col(key), seed + epoch)), "_h", key)
    return placed.where((F.col("ordinal") >= batch * size) & (F.col("ordinal") < (batch + 1) * size)).drop("_h")


def latest(df: DataFrame, column: str, n: int) -> DataFrame:
    """The rows of the n highest values of a column; of all for a negative n. The distinct values are few against the rows."""
    if n < 0:
        return df
    kept = df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(F.col(column).desc()).limit(n)
    return df.join(F.broadcast(kept), column, "left_semi")  # n rows


def level(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """Takes the last row of the largest group away until n rows are left; of equally large groups the first one gives.

    Closed form: of all rows by their place within the group, then by the groups in reverse, the first n stay.
    """
    placed = df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return placed.orderBy("place", *[F.col(g).desc() for g in group]).limit(n)


def value_at_share(df: DataFrame, column: str, share: float, few: bool = False) -> DataFrame:
    """One row `value`: that of the sorted non-null values whose 0-based place is floor(count * share); null if there are none.

    The values are counted first, so that only distinct values are ordered: by ranges, or, if they are known to be `few`, in one task.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    placed = counts.withColumn("up_to", F.sum("n").over(Window.orderBy("value"))) if few else running_total(counts, "n", "value")
    total = placed.agg(F.floor(F.sum("n") * F.lit(float(share))).alias("at"))
    placed = placed.crossJoin(F.broadcast(total))  # one row
    return placed.agg(F.min(F.when(F.col("up_to") > F.col("at"), F.col("value"))).alias("value"))
