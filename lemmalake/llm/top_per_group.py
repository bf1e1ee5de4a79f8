"""Problem 2: the N highest-scoring items of every group, by skipping on statistics.

The rows are laid out once, clustered by group: range-partitioned and sorted by (group, score descending, item), so that
a group of any size is spread over as many files as it needs, in Parquet row groups that are small against the large groups. What is
read after that is decided from the footers. Each file is a task, which reads its row groups in descending order of their maximum
score and skips those of a group whose best row comes strictly after the group's current N-th. Row groups that hold several groups are
always read: groups about as small as N have to be. A group of several files has its best row group read before, and so
has an N-th in all of its files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lemmalake.sources.tables import table
from lemmalake.storage import materialize, new_table

BLOCKS = "path string, block int, lo string, hi string, top double, item long, n long"
FOUND = "g string, s double, i long, n_read long"
#: Rows of a row group.
BLOCK_ROWS = 1_000


def cluster(rows: DataFrame, block_rows: int) -> str:
    """Writes (g, s, i) clustered by group; gives the path. block_rows bounds the rows of a row group."""
    path = new_table(rows.sparkSession, "clustered")
    order = [F.col("g"), F.col("s").desc(), F.col("i")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.option("parquet.block.row.count.limit", block_rows).parquet(path)
    return path


def footers(spark: SparkSession, path: str) -> DataFrame:
    """A row for each row group of the clustered table: its place, its first and last group (null where they are too long for
    statistics), its highest score, its smallest item, its rows."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        for batch in batches:
            out = []
            for p in batch.path:
                where, name = fs.FileSystem.from_uri(p)
                with where.open_input_file(name) as f:
                    meta = pq.ParquetFile(f).metadata
                    at = {meta.schema.column(k).name: k for k in range(meta.num_columns)}
                    for b in range(meta.num_row_groups):
                        g, s, i = (meta.row_group(b).column(at[c]).statistics for c in "gsi")
                        lo, hi = (g.min, g.max) if g is not None and g.has_min_max else (None, None)
                        out.append((p, b, lo, hi, s.max, i.min, meta.row_group(b).num_rows))
            yield pd.DataFrame(out, columns=["path", "block", "lo", "hi", "top", "item", "n"])

    files = spark.read.parquet(path).inputFiles()
    return spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, len(files) // 4)).mapInPandas(read, BLOCKS)


def read_blocks(blocks: DataFrame, nth: DataFrame, n: int) -> DataFrame:
    """FOUND of the given row groups: the first n different (score, item) of each group in each row group that is read, and, with a null
    score, how many rows of the group were read. nth has (g, s, i) of groups of which n rows are known."""
    order = F.struct((-F.col("top")).alias("o"), "item", "block", "lo", "hi")
    files = blocks.groupBy("path").agg(F.array_sort(F.collect_list(order)).alias("x"))  # a file's row groups
    hot = blocks.where("lo = hi").select("path", F.col("lo").alias("g")).distinct().join(nth, "g")
    hot = hot.groupBy("path").agg(*[F.collect_list(F.struct("g", "s", "i")).getField(c).alias(f"known_{c}") for c in "gsi"])
    files = files.join(hot, "path", "left").select("path", *[F.col("x").getField(c).alias(c) for c in ("o", "item", "block", "lo", "hi")], *[f"known_{c}" for c in "gsi"])

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates().sort_values(["g", "s", "i"], ascending=[True, False, True], kind="stable")
        return rows.groupby("g").head(n)[["g", "s", "i"]]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        for r in (r for batch in batches for r in batch.itertuples()):
            best: dict[str, list[tuple[float, int]]] = {lo: [] for lo, hi in zip(r.lo, r.hi, strict=True) if lo is not None and lo == hi}
            limit = {g: (-s, i) for g, s, i in zip(r.known_g, r.known_s, r.known_i, strict=True)} if r.known_g is not None else {}
            where, name = fs.FileSystem.from_uri(r.path)
            with where.open_input_file(name) as f:
                file = pq.ParquetFile(f)
                for o, item, block, lo, hi in zip(r.o, r.item, r.block, r.lo, r.hi, strict=True):
                    if lo is not None and lo == hi and lo in limit and (o, item) > limit[lo]:
                        continue
                    rows = file.read_row_group(block, columns=["g", "s", "i"]).to_pandas()
                    count = rows.g.value_counts()
                    yield pd.DataFrame({"g": count.index, "s": float("nan"), "i": 0, "n_read": count.to_numpy()})
                    rows = first(rows)
                    yield rows.assign(n_read=0)
                    for g in best.keys() & set(rows.g):
                        own = rows[rows.g == g]
                        best[g] = sorted({*best[g], *zip(-own.s, own.i, strict=True)})[:n]
                        if len(best[g]) == n:
                            limit[g] = min(limit.get(g, best[g][-1]), best[g][-1])

    return files.repartition("path").mapInPandas(read, FOUND).withColumn("s", F.when(~F.isnan("s"), F.col("s")))


def first_n(found: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("g").orderBy(F.col("s").desc(), "i")
    return found.distinct().withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def top_n(rows: DataFrame, group: str, score: str, item: str, n: int, block_rows: int = BLOCK_ROWS, told: dict | None = None) -> DataFrame:
    """The first n items of each group: (group, item, score, place), by score from the highest, then by the smallest item.

    Rows with a null group or item, or a null or NaN score, don't count; infinite scores do. Equal rows count once. A group
    with fewer than n items gives all of them. An empty table gives no rows. Other columns are ignored, whatever their names.
    told, if given, gets `read`, (g, n_read): how many rows of each group were read.
    """
    spark = rows.sparkSession
    s: Column = F.col(score).cast("double")
    slim = rows.select(F.col(group).cast("string").alias("g"), (s + F.lit(0.0)).alias("s"), F.col(item).cast("long").alias("i"))
    slim = slim.where(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    blocks = materialize(footers(spark, cluster(slim, block_rows)), "blocks")
    w = Window.partitionBy("lo")
    alone = blocks.where("lo = hi").withColumn("several", F.min("path").over(w) != F.max("path").over(w))
    best = alone.where("several").withColumn("k", F.row_number().over(w.orderBy(F.col("top").desc(), "item", "path", "block"))).where("k = 1").select(*blocks.columns)
    none = spark.createDataFrame([], "g string, s double, i long")
    before = materialize(read_blocks(best, none, n), "best-blocks")
    nth = first_n(before.where("s IS NOT NULL").select("g", "s", "i"), n).where(F.col("place") == n).select("g", "s", "i")
    rest = read_blocks(blocks.join(best.select("path", "block"), ["path", "block"], "left_anti"), nth, n)
    found = before.unionByName(rest)
    if told is not None:
        found = materialize(found, "read-rows")
        told["read"] = found.where("s IS NULL").groupBy("g").agg(F.sum("n_read").alias("n_read"))
    out = first_n(found.where("s IS NOT NULL").select("g", "s", "i"), n)
    return out.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "place")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return top_n(table(spark, folder, "train_samples"), "group_id", "reward", "sample_id", 4).select("group_id", "sample_id")


def p2_read(spark: SparkSession, folder: str) -> DataFrame:
    """Of the groups that are larger than 3 row groups of p2_found: the samples of each, and how many of them were read."""
    told: dict = {}
    t = table(spark, folder, "train_samples").where("reward IS NOT NULL AND NOT isnan(reward) AND group_id IS NOT NULL").select("group_id", "sample_id", "reward")
    top_n(t, "group_id", "reward", "sample_id", 4, told=told)
    n = t.groupBy("group_id").agg(F.countDistinct("sample_id").alias("n_samples")).where(F.col("n_samples") > 3 * BLOCK_ROWS)
    return n.join(told["read"].withColumnRenamed("g", "group_id"), "group_id")


def p2_skipped(spark: SparkSession, folder: str) -> DataFrame:
    """The groups of p2_read, and whether less than half of their samples were read, so that it can be checked by SQL."""
    return p2_read(spark, folder).select("group_id", "n_samples", (2 * F.col("n_read") < F.col("n_samples")).alias("mostly_skipped"))


QUERIES = {"p2_found": p2_found, "p2_read": p2_read, "p2_skipped": p2_skipped}
SQL = {
    "p2_found": """
        SELECT group_id, sample_id FROM (
            SELECT group_id, sample_id, row_number() OVER (PARTITION BY group_id ORDER BY reward DESC, sample_id) AS k
            FROM (SELECT DISTINCT group_id, sample_id, reward FROM train_samples
                  WHERE reward IS NOT NULL AND NOT isnan(reward) AND group_id IS NOT NULL))
        WHERE k <= 4""",
    "p2_skipped": f"""SELECT group_id, count(DISTINCT sample_id) AS n_samples, true AS mostly_skipped FROM train_samples
        WHERE reward IS NOT NULL AND NOT isnan(reward) AND group_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT sample_id) > {3 * BLOCK_ROWS}""",
}
