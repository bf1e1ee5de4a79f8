"""Keeping, repeating, chunking and merging rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lemmalake.operators.dedup import append_up_to, cycled, first_of, new_first, repeated
from lemmalake.operators.order import chunks, epoch_batch, hash_order, latest, level, ordinals, shards
from lemmalake.plans.base import A, C, S, attempts, conjectures, statements


def dedup_keep_first_anti(spark: SparkSession, folder: str) -> DataFrame:
    """The first conjecture of every text that isn't a known theorem."""
    c = conjectures(spark, folder, "conjecture", "iteration")
    return new_first(c, "conjecture", [F.col("iteration"), F.col("rec_id")], statements(spark, folder, "theorem"), "theorem").select("rec_id")


def merge_proofs(spark: SparkSession, folder: str) -> DataFrame:
    """The correct proofs of each theorem over all of its statements and iterations, each text once, from the earliest attempt that has it; the
    theorem is named by its first record."""
    s = statements(spark, folder, "theorem").where("theorem IS NOT NULL")
    first = s.groupBy("theorem").agg(F.min("rec_id").alias("first_rec"))
    a = attempts(spark, folder, "proof_str", "iteration_created").where("ok AND statement_id IS NOT NULL")
    both = a.join(s.join(first, "theorem").select(F.col("id").alias("statement_id"), "first_rec"), "statement_id")
    kept = first_of(both, ["first_rec", "proof_str"], [F.coalesce("iteration_created", F.lit(-1)), F.col("attempt_id")])
    return kept.select("first_rec", "attempt_id")


def water_fill(spark: SparkSession, folder: str) -> DataFrame:
    """1000 correct attempts, taken away from the statements with the most."""
    a = attempts(spark, folder).where("ok AND statement_id IS NOT NULL")
    return level(a, ["statement_id"], [F.col("attempt_id")], 1000).select("statement_id", "attempt_id")


def bounded_append(spark: SparkSession, folder: str) -> DataFrame:
    """The correct proofs of iterations from 25 on that join those of before, to at most 16 a statement."""
    a = attempts(spark, folder, "proof_str", "iteration_created").where("ok AND statement_id IS NOT NULL AND iteration_created IS NOT NULL")
    stored = first_of(a.where("iteration_created < 25"), ["statement_id", "proof_str"], [F.col("attempt_id")])
    return append_up_to(stored, a.where("iteration_created >= 25"), "statement_id", "proof_str", [F.col("iteration_created"), F.col("attempt_id")], 16).select("statement_id", "attempt_id")


def iteration_buffer(spark: SparkSession, folder: str) -> DataFrame:
    """The attempts of the last 5 iterations."""
    return latest(attempts(spark, folder, "iteration_created"), "iteration_created", 5).groupBy("iteration_created").agg(F.count("*").alias("n"), F.count_if("ok").alias("correct"))


def repeat_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """4 prompts a statement."""
    return repeated(statements(spark, folder), 4).select("id", "attempt_idx")


def chunk_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The attempts in 7 contiguous chunks: how many and which ids each has."""
    placed = chunks(attempts(spark, folder), 7, "attempt_id")
    return placed.groupBy("chunk").agg(F.count("*").alias("n"), F.min("attempt_id").alias("first_id"), F.max("attempt_id").alias("last_id"))


def round_robin_shard(spark: SparkSession, folder: str) -> DataFrame:
    """The unsolved test statements, twice each, dealt to 3 shards."""
    s = statements(spark, folder, "split").where(F.lower(F.trim("split")) == "test")
    done = attempts(spark, folder).where("ok").select(F.col("statement_id").alias("id")).distinct()
    todo = repeated(s.join(done, "id", "left_anti"), 2, "turn")
    return shards(todo.select("turn", "id"), 3, "turn", "id").select("id", "turn", "shard")


def epoch_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The batch of 64 statements that iteration 12 trains on."""
    return epoch_batch(statements(spark, folder), "id", 64, 12, 5).select("id", "ordinal")


def cycle_repeat(spark: SparkSession, folder: str) -> DataFrame:
    """6 seeds for each statement with correct proofs: its proofs in a shuffled order, over and over."""
    a = attempts(spark, folder).where("ok AND statement_id IS NOT NULL").select("statement_id", "attempt_id")
    return cycled(a, "statement_id", [hash_order(F.col("attempt_id"), 3), F.col("attempt_id")], 6).select("statement_id", "turn", "attempt_id")


def few_shot_pick(spark: SparkSession, folder: str) -> DataFrame:
    """3 examples for each test statement, or all of a smaller pool, never itself: of the solved statements, those that follow it in a
    shuffled order, from the first again after the last.

    Every statement of the order finds its next ones through its place, so nothing is joined with everything."""
    s = statements(spark, folder, "split", "theorem").where("theorem IS NOT NULL")
    solved = attempts(spark, folder).where("ok").select(F.col("statement_id").alias("id")).distinct()
    pool = shards(s.join(solved, "id", "left_semi").withColumn("h", hash_order(F.col("id"), 11)).select("h", F.col("id").alias("example")), 1, "h", "example")
    size = pool.agg(F.count("*").alias("m"))
    asked = s.where(F.lower(F.trim("split")) == "test").select("id").crossJoin(F.broadcast(size)).where("m > 0")  # one row
    start = F.pmod(F.conv(F.substring(hash_order(F.col("id"), 13), 1, 8), 16, 10).cast("long"), F.col("m"))
    wanted = asked.withColumn("k", F.explode(F.sequence(F.lit(0), F.least(F.lit(3), F.col("m") - 1)))).withColumn("ordinal", (start + F.col("k")) % F.col("m"))
    found = wanted.join(pool.select("ordinal", "example"), "ordinal").where("id <> example")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("k"))
    return found.withColumn("rank", rank).where("rank <= 3").select("id", "rank", "example")


def nest_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Each source's statements in the order of their ids, as rows with their place: the nested form without a row of unbounded size."""
    s = ordinals(statements(spark, folder, "source").withColumn("named", F.coalesce("source", F.lit(""))), "named", "id", "rec_id")
    first = s.groupBy("source").agg(F.min("ordinal").alias("first"))
    both = s.join(first.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    return both.select("source", "rec_id", (F.col("ordinal") - F.col("first")).alias("place"))


def union_train_data(spark: SparkSession, folder: str) -> DataFrame:
    """Statements and conjectures in one table, by kind and length."""
    s = statements(spark, folder, "theorem").select(F.lit("statement").alias("kind"), F.col("theorem").alias("text"))
    c = conjectures(spark, folder, "conjecture").select(F.lit("conjecture").alias("kind"), F.col("conjecture").alias("text"))
    return s.unionByName(c).groupBy("kind").agg(F.count("*").alias("n"), F.count("text").alias("n_texts"), F.sum(F.length("text")).alias("chars"))


QUERIES = {f.__name__: f for f in (dedup_keep_first_anti, merge_proofs, water_fill, bounded_append, iteration_buffer, repeat_attempts, chunk_rows, round_robin_shard, epoch_batches, cycle_repeat, few_shot_pick, nest_by_source, union_train_data)}
SQL = {
    "dedup_keep_first_anti": f"""WITH {S}, {C} SELECT rec_id FROM (SELECT *, row_number() OVER (PARTITION BY conjecture ORDER BY iteration, rec_id) AS k FROM c
        WHERE conjecture IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.theorem = c.conjecture)) WHERE k = 1""",
    "merge_proofs": f"""WITH {S}, {A}, f AS (SELECT id, min(rec_id) OVER (PARTITION BY theorem) AS first_rec FROM s WHERE theorem IS NOT NULL)
        SELECT first_rec, attempt_id FROM a JOIN f ON statement_id = f.id WHERE ok
        QUALIFY row_number() OVER (PARTITION BY first_rec, proof_str ORDER BY coalesce(iteration_created, -1), attempt_id) = 1""",
    "water_fill": f"""WITH {A}, p AS (SELECT statement_id, attempt_id, row_number() OVER (PARTITION BY statement_id ORDER BY attempt_id) AS k FROM a WHERE ok AND statement_id IS NOT NULL)
        SELECT statement_id, attempt_id FROM p ORDER BY k, statement_id DESC LIMIT 1000""",
    "bounded_append": f"""WITH {A}, x AS (SELECT * FROM a WHERE ok AND statement_id IS NOT NULL AND iteration_created IS NOT NULL),
        o AS (SELECT DISTINCT statement_id, proof_str FROM x WHERE iteration_created < 25),
        h AS (SELECT statement_id, count(*) AS have FROM o GROUP BY 1),
        n AS (SELECT x.*, row_number() OVER (PARTITION BY x.statement_id ORDER BY iteration_created, attempt_id) AS k, coalesce(have, 0) AS have
              FROM x LEFT JOIN h USING (statement_id) WHERE iteration_created >= 25)
        SELECT statement_id, attempt_id FROM (SELECT *, row_number() OVER (PARTITION BY statement_id, proof_str ORDER BY iteration_created, attempt_id) AS j FROM n WHERE k <= 16 - have)
        WHERE j = 1 AND NOT EXISTS (SELECT 1 FROM o WHERE o.statement_id = n.statement_id AND o.proof_str = n.proof_str)""".replace("n.statement_id", "z.statement_id").replace("n.proof_str", "z.proof_str").replace("WHERE k <= 16 - have)", "WHERE k <= 16 - have) AS z"),
    "iteration_buffer": f"""WITH {A} SELECT iteration_created, count(*) AS n, count(*) FILTER (ok) AS correct FROM a
        WHERE iteration_created IN (SELECT DISTINCT iteration_created FROM a WHERE iteration_created IS NOT NULL ORDER BY 1 DESC LIMIT 5) GROUP BY 1""",
    "repeat_attempts": f"WITH {S} SELECT id, k::INT AS attempt_idx FROM s, range(0, 4) AS g(k)",
    "chunk_rows": f"""WITH {A}, p AS (SELECT attempt_id, ntile(7) OVER (ORDER BY attempt_id) - 1 AS chunk FROM a)
        SELECT chunk, count(*) AS n, min(attempt_id) AS first_id, max(attempt_id) AS last_id FROM p GROUP BY chunk""",
    "round_robin_shard": f"""WITH {S}, {A}, x AS (SELECT id, k::INT AS turn FROM s, range(0, 2) AS g(k) WHERE lower(trim(split)) = 'test' AND NOT EXISTS (SELECT 1 FROM a WHERE ok AND statement_id = s.id))
        SELECT id, turn, (row_number() OVER (ORDER BY turn, id) - 1) % 3 AS shard FROM x""",
    "epoch_batches": f"""WITH {S}, m AS (SELECT greatest(1, ceil(count(*) / 64))::BIGINT AS b FROM s),
        p AS (SELECT id, b, row_number() OVER (ORDER BY md5(concat(5 + 12 // b, '/', id)), id) - 1 AS ordinal FROM s, m)
        SELECT id, ordinal FROM p WHERE ordinal >= (12 % b) * 64 AND ordinal < (12 % b + 1) * 64""",
    "cycle_repeat": f"""WITH {A}, p AS (SELECT statement_id, attempt_id, row_number() OVER (PARTITION BY statement_id ORDER BY md5('3/' || attempt_id), attempt_id) - 1 AS i,
        count(*) OVER (PARTITION BY statement_id) AS m FROM a WHERE ok AND statement_id IS NOT NULL)
        SELECT statement_id, t::INT AS turn, attempt_id FROM p, range(0, 6) AS g(t) WHERE t % m = i""",
    "few_shot_pick": f"""WITH {S}, {A}, pool AS (SELECT id AS example, row_number() OVER (ORDER BY md5('11/' || id), id) - 1 AS o FROM s
            WHERE theorem IS NOT NULL AND EXISTS (SELECT 1 FROM a WHERE ok AND statement_id = s.id)),
        m AS (SELECT count(*) AS m FROM pool),
        w AS (SELECT id, k, (('0x' || substr(md5('13/' || id), 1, 8))::BIGINT % m + k) % m AS o FROM s, m, range(0, 4) AS g(k) WHERE theorem IS NOT NULL AND lower(trim(split)) = 'test' AND k < m),
        f AS (SELECT id, example, row_number() OVER (PARTITION BY id ORDER BY k) AS rank FROM w JOIN pool USING (o) WHERE id <> example)
        SELECT id, rank::INT AS rank, example FROM f WHERE rank <= 3""",
    "nest_by_source": f"WITH {S} SELECT source, rec_id, row_number() OVER (PARTITION BY source ORDER BY id, rec_id) - 1 AS place FROM s",
    "union_train_data": f"""WITH {S}, {C} SELECT kind, count(*) AS n, count(text) AS n_texts, sum(length(text))::BIGINT AS chars FROM
        (SELECT 'statement' AS kind, theorem AS text FROM s UNION ALL SELECT 'conjecture', conjecture FROM c) GROUP BY kind""",
}
