"""Intervals: how many overlap, and laying them into lanes."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def repaired(df: DataFrame, start: str, end: str) -> DataFrame:
    """Drops intervals without a bound and swaps bounds that stand the wrong way round."""
    df = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    return df.withColumns({start: F.least(start, end), end: F.greatest(start, end)})


def peak(df: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """The most intervals that overlap at once, by group; touching ones don't, and ones of no length don't count."""
    df = df.where(F.col(start) < F.col(end))
    edges = df.select(*group, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("e"))
    steps = edges.groupBy(*group, "e.t").agg(F.sum("e.d").alias("d"))
    open_now = F.sum("d").over(Window.partitionBy(*group).orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("n", open_now).groupBy(*group).agg(F.max("n").cast("long").alias("peak"))


def lanes(df: DataFrame, group: str, start: str, end: str, key: str, slot: int = 3_600_000_000) -> DataFrame:
    """Adds `lane`: in order of the start (then the key) each interval gets the lowest lane of its group that is free by then.

    A group is cut where nothing is open at the beginning of a slot of time, after which its lanes begin anew; of the slots there are as
    many as the time is long. The rows of a piece stream through one task in order; what is kept is one end for each lane, not the rows.
    """
    names = df.columns
    df = df.withColumn("_slot", F.floor(F.col(start) / slot))
    slots = df.groupBy(group, "_slot").agg(F.max(end).alias("_end"))
    w = Window.partitionBy(group).orderBy("_slot")
    reach = F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    slots = slots.withColumn("_new", F.coalesce(reach <= F.col("_slot") * slot, F.lit(True)).cast("int")).withColumn("_piece", F.sum("_new").over(w))
    slots = slots.select(F.col(group).alias("_group"), F.col("_slot").alias("_s"), "_piece")
    df = df.join(slots, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_slot") == F.col("_s"))).drop("_group", "_s", "_slot")
    out = StructType([*df.drop("_piece").schema.fields, StructField("lane", LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, busy, free, n = None, [], [], 0
        for b in batches:
            lane = []
            for g, s, e in zip(zip(b[group], b["_piece"], strict=True), b[start], b[end], strict=True):
                if g != now:
                    now, busy, free, n = g, [], [], 0
                while busy and busy[0][0] <= s:
                    heapq.heappush(free, heapq.heappop(busy)[1])
                if free:
                    k = heapq.heappop(free)
                else:
                    k, n = n, n + 1
                heapq.heappush(busy, (e, k))
                lane.append(k)
            yield b.assign(lane=lane)[[*names, "lane"]]

    return df.repartition(group, "_piece").sortWithinPartitions(group, "_piece", start, key).mapInPandas(run, out)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
