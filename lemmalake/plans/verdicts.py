"""Verifier replies, telemetry of workers, and the log of a task queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lemmalake.operators.dedup import first_of
from lemmalake.operators.intervals import clamp, lanes, peak, repaired
from lemmalake.operators.order import ordinals, previous
from lemmalake.plans.base import A, attempts
from lemmalake.sources.tables import table

REPLY = "pass boolean, complete boolean, verify_time double, errors array<struct<severity string, data string, line int>>, system_errors string"
#: Seconds after which a verification is given up, and the bins of its histograms.
TIMEOUT, BINS = 60.0, 20


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """The replies, parsed by a fixed schema; keys that a reply lacks are null."""
    a = attempts(spark, folder, "verification_dict", "source").where("verification_dict IS NOT NULL")
    return a.select("attempt_id", "source", "ok", F.from_json("verification_dict", REPLY).alias("v")).select("attempt_id", "source", "ok", "v.*")


def verdict_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """A reply without a verdict is false; a system error is one that is told; complete means passed, without errors and open holes."""
    r = replies(spark, folder)
    errors = F.filter(F.coalesce("errors", F.array().cast("array<struct<severity string, data string, line int>>")), lambda e: e.severity == "error")
    done = F.coalesce("complete", F.lit(False)) & (F.size(errors) == 0)
    return r.select("attempt_id", F.coalesce("pass", F.lit(False)).alias("pass"), done.alias("complete"), F.col("system_errors").isNotNull().alias("system_error"), F.size(errors).cast("long").alias("n_errors"))


def error_stats(spark: SparkSession, folder: str) -> DataFrame:
    """By source: system errors, replies near the timeout, and the share of either. A missing time is no timeout."""
    late = F.coalesce("verify_time", F.lit(-100.0)) > TIMEOUT - 0.5
    bad = F.col("system_errors").isNotNull()
    out = replies(spark, folder).groupBy("source").agg(F.count("*").alias("n"), F.count_if(bad).alias("system_errors"), F.count_if(late).alias("timeouts"), F.count_if(bad | late).alias("either"))
    return out.select("source", "n", "system_errors", "timeouts", F.round(F.col("either") / F.col("n"), 6).alias("share"))


def error_words(spark: SparkSession, folder: str) -> DataFrame:
    """The kinds of error messages: what stands before the first quote."""
    e = replies(spark, folder).select(F.explode("errors").alias("e")).where("e.severity = 'error'")
    return e.groupBy(F.trim(F.substring_index("e.data", "'", 1)).alias("kind")).agg(F.count("*").alias("n"), F.max("e.line").alias("last_line"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equally wide bins from the least to the greatest value; the last one is closed. Bins without values aren't listed."""
    ends = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    bin_ = F.when(F.col("low") == F.col("high"), 0).otherwise(F.least(F.floor((F.col(column) - F.col("low")) / width), F.lit(bins - 1)))
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"))  # one row


def verify_time_histogram(spark: SparkSession, folder: str) -> DataFrame:
    r = replies(spark, folder).where("verify_time >= 0 AND NOT isnan(verify_time) AND verify_time < double('infinity')")
    return histogram(r.select("verify_time"), "verify_time", BINS)


def mean_verify_time(spark: SparkSession, folder: str) -> DataFrame:
    r = replies(spark, folder).groupBy("ok").agg(F.round(F.avg("verify_time"), 6).alias("mean_time"), F.max("verify_time").alias("longest"), F.count("verify_time").alias("n"))
    return r.withColumnRenamed("ok", "correct")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The event log as a task log: worker, task, time in seconds, gauge."""
    e = table(spark, folder, "events")
    task = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", F.col("user_id").alias("worker"), task.alias("task"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", "value")


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """A worker's day: first and last event, how many events and how many errors."""
    day = F.floor(F.col("us") / 86_400_000_000).alias("day")
    e = events(spark, folder).groupBy("worker", day)
    return e.agg(F.min("us").alias("start"), F.max("us").alias("stop"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


def util_throughput(spark: SparkSession, folder: str) -> DataFrame:
    """Events a second of every day of a worker, and the share of errors; where no time passes, the number of events."""
    r = reports(spark, folder)
    seconds = (F.col("stop") - F.col("start")) / 1e6
    rate = F.when(seconds > 0, F.col("n") / seconds).otherwise(F.col("n"))
    return r.groupBy("worker").agg(F.round(F.avg(rate), 6).alias("rate"), F.round(F.sum("errors") / F.sum("n"), 6).alias("error_share"), F.count("*").alias("n_days"))


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals of 30 to 90 minutes from each event on, some with swapped or missing bounds."""
    e = events(spark, folder)
    stop = F.col("us") + (F.pmod("event_id", F.lit(61)) + 30) * 60_000_000
    start = F.when(F.col("event_id") % 17 == 0, stop).otherwise(F.col("us"))
    end = F.when(F.col("event_id") % 17 == 0, F.col("us")).when(F.col("event_id") % 19 == 0, None).otherwise(stop)
    return e.select("event_id", F.pmod("worker", F.lit(10)).alias("node"), start.alias("start"), end.alias("stop"))


def lane_peak(spark: SparkSession, folder: str) -> DataFrame:
    return peak(repaired(sessions(spark, folder), "start", "stop"), ["node"], "start", "stop")


def lane_assign(spark: SparkSession, folder: str) -> DataFrame:
    return lanes(repaired(sessions(spark, folder), "start", "stop"), "node", "start", "stop", "event_id").select("event_id", "node", "lane")


def lane_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The lanes that each node needs: as many as overlap at most."""
    return lane_assign(spark, folder).groupBy("node").agg((F.max("lane") + 1).alias("lanes"))


def system_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and peak of the gauge, by kind of event and over all."""
    e = events(spark, folder).rollup("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("peak"), F.count("value").alias("n"))
    return e.select(F.coalesce("event_type", F.lit("<all>")).alias("event_type"), "mean", "peak", "n")


def gauge_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """Of each sample of a worker the change since the one before, by second, between 0 and 100, and since the first."""
    e = previous(events(spark, folder).select("event_id", "worker", "us", "value"), "worker", ["us", "event_id"], ["us", "value"])
    first = e.groupBy(F.col("worker").alias("of")).agg(F.min_by("value", F.struct("us", "event_id")).alias("first"))
    dt = F.greatest((F.col("us") - F.col("before.us")) / 1e6, F.lit(1e-6))
    change = clamp((F.col("value") - F.col("before.value")) / dt, 0.0, 100.0)
    e = e.join(first, F.col("worker").eqNullSafe(F.col("of")))
    return e.select("event_id", F.when(F.col("before").isNotNull(), F.round(change, 6)).alias("rate"), F.round(F.col("value") - F.col("first"), 6).alias("since_first"))


def top_processes(spark: SparkSession, folder: str) -> DataFrame:
    """The 3 largest gauges of each worker; equal ones by the earlier event."""
    w = Window.partitionBy("worker").orderBy(F.col("value").desc(), "event_id")
    return events(spark, folder).withColumn("place", F.row_number().over(w)).where("place <= 3").select("worker", F.col("place").cast("long").alias("place"), "event_id", "value")


def last_metric(spark: SparkSession, folder: str) -> DataFrame:
    """Of every kind of event the last value in its history, equal times told apart by the id."""
    e = events(spark, folder).where("value IS NOT NULL")
    return e.groupBy("event_type").agg(F.max_by("value", F.struct("us", "event_id")).alias("last_value"))


def task_first_result(spark: SparkSession, folder: str) -> DataFrame:
    """The first result of every task counts; later ones are duplicates."""
    e = events(spark, folder).where("event_type = 'purchase'")
    return e.groupBy("task").agg(F.min_by("value", "event_id").alias("result"), F.min_by("worker", "event_id").alias("worker"), (F.count("*") - 1).alias("duplicates"))


def task_last_report(spark: SparkSession, folder: str) -> DataFrame:
    return first_of(events(spark, folder), ["worker"], [F.col("event_id").desc()]).select("worker", "event_id", "event_type")


def task_states(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks by where they stand: done with a result, in progress if handed out since their worker last failed, else pending."""
    e = events(spark, folder)
    died = e.where("event_type = 'error'").groupBy("worker").agg(F.max("event_id").alias("died"))
    held = e.where("event_type = 'view'").join(died, "worker", "left").where("event_id > coalesce(died, -1)").select("task").distinct().withColumn("held", F.lit(1))
    done = e.where("event_type = 'purchase'").select("task").distinct().withColumn("done", F.lit(1))
    all_ = e.where("task IS NOT NULL").select("task").distinct().join(held, "task", "left").join(done, "task", "left")
    return all_.groupBy(F.when(F.col("done") == 1, "done").when(F.col("held") == 1, "in_progress").otherwise("pending").alias("state")).agg(F.count("*").alias("n_tasks"))


def holders(spark: SparkSession, folder: str) -> DataFrame:
    """How many workers were handed each task; the one that the fewest have comes first."""
    e = events(spark, folder).where("event_type = 'view' AND task IS NOT NULL")
    n = e.groupBy("task").agg(F.countDistinct("worker").alias("n_workers"))
    first = n.orderBy("n_workers", "task").limit(10)
    return first.withColumn("place", F.row_number().over(Window.orderBy("n_workers", "task")).cast("long"))  # 10 rows


def next_task(spark: SparkSession, folder: str) -> DataFrame:
    """The task that each worker would be handed once all are: the one with the fewest holders that isn't its own.

    Tasks stand in that order; of a worker whose own ones are the first k, it is the next."""
    e = events(spark, folder).where("event_type = 'view' AND task IS NOT NULL").select("task", "worker").distinct()
    placed = ordinals(e.groupBy("task").agg(F.count("*").alias("n")), "n", "task").select("task", "ordinal")
    own = e.join(placed, "task").withColumn("k", F.row_number().over(Window.partitionBy("worker").orderBy("ordinal")) - 1)
    skip = own.groupBy("worker").agg(F.count_if(F.col("k") == F.col("ordinal")).alias("ordinal"))
    return skip.join(placed, "ordinal").select("worker", "task")


def chunk_retries(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts in chunks of 8: a chunk with more than 90 % of system errors is tried again; by how many such chunks and rows."""
    r = replies(spark, folder).groupBy(F.floor(F.col("attempt_id") / 8).alias("chunk")).agg(F.count("*").alias("n"), F.count_if(F.col("system_errors").isNotNull()).alias("bad"))
    return r.agg(F.count("*").alias("chunks"), F.count_if(F.col("bad") > 0.9 * F.col("n")).alias("again"), F.coalesce(F.sum(F.when(F.col("bad") > 0.9 * F.col("n"), F.col("n"))), F.lit(0)).alias("rows_again"))


def tumbling_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Events and errors of every 6 hours."""
    e = table(spark, folder, "events").groupBy(F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return e.select(F.unix_micros(F.col("w.start").cast("timestamp")).alias("start_us"), "n", "errors")


QUERIES = {f.__name__: f for f in (verdict_normalize, error_stats, error_words, verify_time_histogram, mean_verify_time, util_throughput, lane_peak, lane_assign, lane_counts, system_summary, gauge_deltas, top_processes, last_metric, task_first_result, task_last_report, task_states, holders, next_task, chunk_retries, tumbling_errors)}
V = f"""WITH {A}, v AS (SELECT attempt_id, source, ok, (verification_dict::JSON ->> '$.pass')::BOOLEAN AS pass, (verification_dict::JSON ->> '$.complete')::BOOLEAN AS complete,
    (verification_dict::JSON ->> '$.verify_time')::DOUBLE AS verify_time, verification_dict::JSON ->> '$.system_errors' AS system_errors,
    coalesce(json_array_length(verification_dict::JSON, '$.errors'), 0) AS n_errors, verification_dict FROM a WHERE verification_dict IS NOT NULL)"""
E_ = "WITH e AS (SELECT event_id, user_id AS worker, (props::JSON ->> '$.k')::BIGINT AS task, epoch_us(ts) AS us, event_type, value FROM events)"
I_ = """WITH i AS (SELECT event_id, user_id % 10 AS node, epoch_us(ts) AS start, epoch_us(ts) + (event_id % 61 + 30) * 60000000 AS stop FROM events WHERE event_id % 17 = 0 OR event_id % 19 <> 0)"""
PEAK = """, x AS (SELECT node, start AS t, 1 AS d FROM i UNION ALL SELECT node, stop, -1 FROM i),
    y AS (SELECT node, t, sum(d) AS d FROM x GROUP BY ALL), z AS (SELECT node, sum(d) OVER (PARTITION BY node ORDER BY t) AS n FROM y)"""
SQL = {
    "verdict_normalize": f"{V} SELECT attempt_id, coalesce(pass, false) AS pass, coalesce(complete, false) AND n_errors = 0 AS complete, system_errors IS NOT NULL AS system_error, n_errors::BIGINT AS n_errors FROM v",
    "error_stats": f"""{V} SELECT source, count(*) AS n, count(*) FILTER (system_errors IS NOT NULL) AS system_errors, count(*) FILTER (verify_time > 59.5) AS timeouts,
        round(count(*) FILTER (system_errors IS NOT NULL OR verify_time > 59.5) / count(*), 6) AS share FROM v GROUP BY source""",
    "error_words": f"""{V}, x AS (SELECT unnest(from_json(verification_dict::JSON -> '$.errors', '[{{"severity":"VARCHAR","data":"VARCHAR","line":"INTEGER"}}]')) AS e FROM v WHERE n_errors > 0)
        SELECT trim(split_part(e.data, '''', 1)) AS kind, count(*) AS n, max(e.line) AS last_line FROM x WHERE e.severity = 'error' GROUP BY 1""",
    "verify_time_histogram": f"""{V}, x AS (SELECT verify_time AS t, min(verify_time) OVER () AS low, max(verify_time) OVER () AS high FROM v WHERE verify_time >= 0 AND isfinite(verify_time))
        SELECT CASE WHEN low = high THEN 0 ELSE least(floor((t - low) / ((high - low) / {BINS})), {BINS - 1}) END::BIGINT AS bin, count(*) AS n FROM x GROUP BY 1""",
    "mean_verify_time": f"{V} SELECT ok AS correct, round(avg(verify_time), 6) AS mean_time, max(verify_time) AS longest, count(verify_time) AS n FROM v GROUP BY ok",
    "util_throughput": f"""{E_}, r AS (SELECT worker, us // 86400000000 AS day, (max(us) - min(us)) / 1e6 AS s, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM e GROUP BY ALL)
        SELECT worker, round(avg(CASE WHEN s > 0 THEN n / s ELSE n END), 6) AS rate, round(sum(errors) / sum(n), 6) AS error_share, count(*) AS n_days FROM r GROUP BY worker""",
    "lane_peak": f"{I_}{PEAK} SELECT node, max(n)::BIGINT AS peak FROM z GROUP BY node",
    "lane_counts": f"{I_}{PEAK} SELECT node, max(n)::BIGINT AS lanes FROM z GROUP BY node",
    "system_summary": f"{E_} SELECT coalesce(event_type, '<all>') AS event_type, round(avg(value), 6) AS mean, max(value) AS peak, count(value) AS n FROM e GROUP BY ROLLUP (event_type)",
    "gauge_deltas": f"""{E_}, x AS (SELECT *, lag(us) OVER w AS u, lag(value) OVER w AS v, first_value(value) OVER w AS f FROM e WINDOW w AS (PARTITION BY worker ORDER BY us, event_id))
        SELECT event_id, CASE WHEN u IS NOT NULL THEN round(greatest(0, least(100, (value - v) / greatest((us - u) / 1e6, 1e-6))), 6) END AS rate, round(value - f, 6) AS since_first FROM x""",
    "top_processes": f"{E_}, x AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY value DESC, event_id) AS place FROM e) SELECT worker, place, event_id, value FROM x WHERE place <= 3",
    "last_metric": f"{E_} SELECT event_type, value AS last_value FROM e WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY us DESC, event_id DESC) = 1",
    "task_first_result": f"""{E_}, x AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY event_id) AS k, count(*) OVER (PARTITION BY task) AS m FROM e WHERE event_type = 'purchase')
        SELECT task, value AS result, worker, m - 1 AS duplicates FROM x WHERE k = 1""",
    "task_last_report": f"{E_} SELECT worker, event_id, event_type FROM e QUALIFY row_number() OVER (PARTITION BY worker ORDER BY event_id DESC) = 1",
    "task_states": f"""{E_}, x AS (SELECT task, bool_or(event_type = 'purchase') AS done, bool_or(event_type = 'view' AND event_id > coalesce((SELECT max(event_id) FROM e AS d WHERE d.worker = e.worker AND d.event_type = 'error'), -1)) AS held
        FROM e WHERE task IS NOT NULL GROUP BY task) SELECT CASE WHEN done THEN 'done' WHEN held THEN 'in_progress' ELSE 'pending' END AS state, count(*) AS n_tasks FROM x GROUP BY 1""",
    "holders": f"""{E_}, n AS (SELECT task, count(DISTINCT worker) AS n_workers FROM e WHERE event_type = 'view' AND task IS NOT NULL GROUP BY 1)
        SELECT task, n_workers, row_number() OVER (ORDER BY n_workers, task) AS place FROM n QUALIFY place <= 10""",
    "next_task": f"""{E_}, h AS (SELECT DISTINCT task, worker FROM e WHERE event_type = 'view' AND task IS NOT NULL), n AS (SELECT task, count(*) AS n FROM h GROUP BY 1),
        w AS (SELECT DISTINCT worker FROM h) SELECT worker, arg_min(task, (n, task)) AS task FROM w, n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.worker = w.worker AND h.task = n.task) GROUP BY worker""",
    "chunk_retries": f"""{V}, x AS (SELECT attempt_id // 8 AS chunk, count(*) AS n, count(*) FILTER (system_errors IS NOT NULL) AS bad FROM v GROUP BY 1)
        SELECT count(*) AS chunks, count(*) FILTER (bad > 0.9 * n) AS again, coalesce(sum(n) FILTER (bad > 0.9 * n), 0)::BIGINT AS rows_again FROM x""",
    "tumbling_errors": "SELECT (epoch_us(ts) // 21600000000) * 21600000000 AS start_us, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1",
}
