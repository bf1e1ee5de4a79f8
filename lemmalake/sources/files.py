"""Files at the edge: nested datasets in JSON, JSON lines, accounting logs; and how tables are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ATTEMPT = "attempt_id bigint, proof_str string, is_correct boolean, iteration_created int"
STATEMENT = f"id string, header string, theorem string, tag string, source string, proofs array<struct<{ATTEMPT.replace(' ', ':').replace(',:', ', ')}>>"
READERS = {".json": "json", ".jsonl": "json", ".parquet": "parquet", ".orc": "orc"}


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Reads by the extension; others, pickles among them, are refused. A .json file may hold one value over several lines."""
    kind = next((k for e, k in READERS.items() if path.lower().rstrip("/").endswith(e)), None)
    if kind is None:
        raise ValueError(f"can't read {path}: only {', '.join(READERS)}")
    reader = spark.read.option("multiLine", path.lower().endswith(".json"))
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def nested(statements: DataFrame, attempts: DataFrame) -> DataFrame:
    """Statements with their attempts inside, in the order of the ids. Only for the edge: a statement's attempts come into one row."""
    one = F.struct(*[c.split()[0] for c in ATTEMPT.split(", ")])
    proofs = attempts.groupBy("statement_id").agg(F.array_sort(F.collect_list(one)).alias("proofs"))
    both = statements.join(proofs, F.col("id") == F.col("statement_id"), "left")
    return both.select("id", "header", "theorem", "tag", "source", F.coalesce("proofs", F.array().cast(f"array<struct<{ATTEMPT.replace(' ', ':').replace(',:', ', ')}>>")).alias("proofs"))


def flat(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The statements and the attempts of nested rows."""
    attempts = rows.select(F.col("id").alias("statement_id"), F.inline("proofs"))
    return rows.drop("proofs"), attempts


def write_iteration(df: DataFrame, path: str, column: str = "iteration") -> None:
    """Writes the partitions of the iterations in df, and leaves those of others as they are; twice the same is once."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def accounting(lines: DataFrame, line: str, job: str) -> DataFrame:
    """(state, start, stop) of one job from lines `job|state|start|end`, in seconds; an end that isn't known is null. Lines of other jobs
    and lines without a start are left out."""
    part = F.split(line, r"\|")

    def seconds(c: Column) -> Column:
        return F.unix_micros(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss"))) / 1e6

    cut = lines.where(F.size(part) == 4).select(part[0].alias("job"), part[1].alias("state"), seconds(part[2]).alias("start"), seconds(part[3]).alias("stop"))
    return cut.where((F.col("job") == job) & F.col("start").isNotNull()).drop("job")


def violations(statements: DataFrame) -> DataFrame:
    """(rec_id, rule) of what makes a statement unfit as a source: a repeated id, a hole in the theorem, an end other than `:= by`."""
    repeated = statements.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("repeated"))
    ends = F.regexp_replace("theorem", r"(?U)\s+$", "").endswith(":= by")
    rules = F.array(
        F.when(F.col("repeated"), "repeated id"), F.when(F.col("theorem").isNull(), "no theorem"), F.when(F.contains("theorem", F.lit("sorry")), "hole"), F.when(~ends, "no open end")
    )
    return statements.join(repeated, "id", "left").select("rec_id", F.explode(F.array_compact(rules)).alias("rule"))
