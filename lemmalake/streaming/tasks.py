"""The task log as a stream. Each function reads what there is, stops, and gives the result as a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lemmalake.storage import new_table


#: Files that one batch of a stream takes at most.
FILES = 64


def stream(spark: SparkSession, folder: str, files: int = FILES) -> DataFrame:
    """The events of a folder of tables as a stream, so many files at a time."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files).parquet(f"{folder}/events.parque[t]")
    return e.withColumn("task", F.get_json_object("props", "$.k").cast("long")).withColumn("ts", F.col("ts").cast("timestamp"))


def run(df: DataFrame, mode: str) -> DataFrame:
    """Runs a stream to the end of its input; the state and the result are in the shared folder. In update mode a key has a row for each
    batch that changed it."""
    spark, path = df.sparkSession, new_table(df.sparkSession, "stream")

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is done again after a failure writes the same folder again
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", new_table(spark, "checkpoint")).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def first_results(spark: SparkSession, folder: str, files: int = FILES) -> DataFrame:
    """As the batch query task_first_result: the earliest result of a task wins, however the log is cut into batches."""
    e = stream(spark, folder, files).where("event_type = 'purchase'")
    out = run(e.groupBy("task").agg(F.min_by("value", "event_id").alias("result"), F.min_by("user_id", "event_id").alias("worker"), (F.count("*") - 1).alias("duplicates")), "update")
    return out.groupBy("task").agg(F.max_by(F.struct("result", "worker", "duplicates"), "duplicates").alias("x")).select("task", "x.*")  # the count grows from batch to batch


def windows(spark: SparkSession, folder: str, files: int = FILES) -> DataFrame:
    """Events of sliding windows of a day, every 12 hours, by kind. A window whose end is 2 days before the latest event leaves the state; events that
    come for it after that are dropped."""
    e = stream(spark, folder, files).withWatermark("ts", "2 days")
    w = e.groupBy(F.window("ts", "1 day", "12 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("peak"))
    out = run(w, "update").groupBy("w", "event_type").agg(F.max("n").alias("n"), F.max("peak").alias("peak"))  # both grow from batch to batch
    return out.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", "peak")


def unseen(spark: SparkSession, folder: str, files: int = FILES) -> DataFrame:
    """The tasks with a result, each once, when its first one comes: what a verifier is handed. The state holds the number of every task seen."""
    return run(stream(spark, folder, files).where("event_type = 'purchase' AND task IS NOT NULL").select("task").dropDuplicates(["task"]), "append")


def answered(spark: SparkSession, folder: str, files: int = FILES) -> DataFrame:
    """(task, given, result): hand-outs of tasks joined with the results that come within an hour, as two streams; both sides' state is kept for that time
    and 2 days of delay."""
    e = stream(spark, folder, files).withWatermark("ts", "2 days")
    given = e.where("event_type = 'view'").select("task", F.col("event_id").alias("given"), F.col("ts").alias("from_ts"))
    result = stream(spark, folder, files).withWatermark("ts", "2 days").where("event_type = 'purchase'").select(F.col("task").alias("of"), F.col("event_id").alias("result"), "ts")
    return run(given.join(result, F.expr("task = of AND ts >= from_ts AND ts <= from_ts + INTERVAL 1 HOUR")).select("task", "given", "result"), "append")


def life(task: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A task's life so far: how often it was handed out, how many workers hold it, whether it has a result.

    A worker holds a task from the time that it is handed out until the worker fails or there is a result. The state has the latest
    hand-out and failure of each worker, so the order in which rows arrive doesn't matter."""
    workers, views, errors, given, done, version = state.get if state.exists else ([], [], [], 0, False, 0)
    last = {w: [v, e] for w, v, e in zip(workers, views, errors, strict=True)}
    for b in batches:
        given += int((b.event_type == "view").sum())
        done |= bool((b.event_type == "purchase").any())
        for kind, at in (("view", 0), ("error", 1)):
            for w, k in b[b.event_type == kind].groupby("user_id").event_id.max().items():
                last.setdefault(int(w), [-1, -1])[at] = max(last.get(int(w), [-1, -1])[at], int(k))
    state.update((list(last), [v for v, _ in last.values()], [e for _, e in last.values()], given, done, version + 1))
    holders = 0 if done else sum(v > e for v, e in last.values())
    yield pd.DataFrame({"task": [task[0]], "given": [given], "holders": [holders], "done": [done], "version": [version + 1]})


def lives(spark: SparkSession, folder: str, files: int = FILES) -> DataFrame:
    """The last known life of each task: given, holders, done. The state counts its versions, so that the last one is known whatever changed."""
    e = stream(spark, folder, files).where("task IS NOT NULL").select("task", "event_id", "event_type", "user_id")
    kept = e.groupBy("task").applyInPandasWithState(life, "task bigint, given int, holders int, done boolean, version int", "workers array<bigint>, views array<bigint>, errors array<bigint>, given int, done boolean, version int", "update", GroupStateTimeout.NoTimeout)
    return run(kept, "update").groupBy("task").agg(F.max_by(F.struct("given", "holders", "done"), "version").alias("x")).select("task", "x.*")
