"""Views that several plans share, as DataFrames and as the head of DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmalake.sources.tables import records

#: Records that were delivered twice are equal but for the time of delivery.
S = "s AS (SELECT DISTINCT ON (rec_id) * FROM statements)"
A = "a AS (SELECT DISTINCT ON (attempt_id) *, coalesce(is_correct, false) AS ok FROM attempts)"
C = "c AS (SELECT DISTINCT ON (rec_id) * FROM conjectures)"
T = "t AS (SELECT DISTINCT ON (sample_id) * FROM train_samples)"
#: How many attempts every statement is asked for; solve rates are shares of these, however many came back.
ASKED = 8
RATES = f"""r AS (SELECT s.id, s.source, s.theorem, count(a.attempt_id) AS n, count(*) FILTER (a.ok) AS correct, count(*) FILTER (a.ok) / {ASKED} AS rate,
    CASE WHEN count(a.attempt_id) > 0 THEN count(*) FILTER (a.ok) / count(a.attempt_id) ELSE 0 END AS share
    FROM s LEFT JOIN a ON a.statement_id = s.id GROUP BY ALL)"""


def correct() -> Column:
    """A verdict that is missing counts as wrong."""
    return F.coalesce("is_correct", F.lit(False))


def statements(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return records(spark, folder, "statements", "id", *columns)


def attempts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return records(spark, folder, "attempts", "statement_id", "is_correct", *columns).withColumn("ok", correct()).drop("is_correct")


def samples(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return records(spark, folder, "train_samples", *columns)


def conjectures(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return records(spark, folder, "conjectures", *columns)


def rates(spark: SparkSession, folder: str) -> DataFrame:
    """Every statement with its attempts, the correct ones, their rate of the ASKED ones and their share of those that there are, 0 for none.

    The attempts are counted before the join, so that a statement with very many of them sends one row a task."""
    by = attempts(spark, folder).groupBy("statement_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("correct"))
    both = statements(spark, folder, "source", "theorem").join(by, F.col("id") == F.col("statement_id"), "left")
    n, c = F.coalesce("n", F.lit(0)), F.coalesce("correct", F.lit(0))
    return both.select("id", "source", "theorem", n.alias("n"), c.alias("correct"), (c / F.lit(ASKED)).alias("rate"), F.when(n > 0, c / n).otherwise(0.0).alias("share"))
