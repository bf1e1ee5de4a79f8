"""Solve rates, what they select, and pass rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lemmalake.operators.order import hash_order, value_at_share
from lemmalake.plans.base import ASKED, RATES, A, C, S, attempts, conjectures, rates, statements

#: The rates that each mode selects.
MODES = {"hard": "rate > 0 AND rate <= 0.5", "all_none_0_1": "rate > 0 AND rate < 1", "all": "rate > 0"}


def solve_rate(spark: SparkSession, folder: str) -> DataFrame:
    return rates(spark, folder).select("id", "n", "correct", F.round("rate", 6).alias("rate"))


def select_hard(spark: SparkSession, folder: str) -> DataFrame:
    return rates(spark, folder).where(MODES["hard"]).select("id")


def select_all_none_0_1(spark: SparkSession, folder: str) -> DataFrame:
    return rates(spark, folder).where(MODES["all_none_0_1"]).select("id")


def select_all(spark: SparkSession, folder: str) -> DataFrame:
    return rates(spark, folder).where(MODES["all"]).select("id")


def select_unsolved(spark: SparkSession, folder: str) -> DataFrame:
    """Statements first solved in an iteration of 25 or later."""
    a = attempts(spark, folder, "iteration_created").where("ok").groupBy("statement_id").agg(F.min("iteration_created").alias("first"))
    return statements(spark, folder).join(a.where("first >= 25"), F.col("id") == F.col("statement_id"), "left_semi").select("id")


def less_16_gate(spark: SparkSession, folder: str) -> DataFrame:
    return rates(spark, folder).where("correct < 16").select("id", "correct")


def p70_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Statements with a rate above 0 that isn't above the 70 % rank of the rates between 0 and 1, which are multiples of 1 / ASKED."""
    r = rates(spark, folder)
    limit = value_at_share(r.where("rate > 0 AND rate < 1"), "rate", 0.7, few=True).select(F.coalesce("value", F.lit(0.0)).alias("p70"))
    return r.crossJoin(F.broadcast(limit)).where("rate > 0 AND rate <= p70").select("id", F.round("rate", 6).alias("rate"), F.round("p70", 6).alias("p70"))  # one row


def conjecture_gate(spark: SparkSession, folder: str) -> DataFrame:
    c = conjectures(spark, folder, "solve_rate")
    limit = value_at_share(c.where("solve_rate > 0 AND solve_rate < 1"), "solve_rate", 0.7).select(F.coalesce("value", F.lit(0.0)).alias("p70"))
    return c.crossJoin(F.broadcast(limit)).where("solve_rate > 0 AND solve_rate <= p70").select("rec_id", "solve_rate")  # one row


def conjectures_selected(spark: SparkSession, folder: str) -> DataFrame:
    """Which conjectures each mode selects, by their solve rate: UNSOLVED and LESS_16 take all that were solved at all."""
    modes = MODES | {"unsolved": MODES["all"], "less_16": MODES["all"]}
    c = conjectures(spark, folder, "solve_rate").withColumnRenamed("solve_rate", "rate")
    return c.select("rec_id", F.explode(F.array_compact(F.array(*[F.when(F.expr(m), F.lit(k)) for k, m in modes.items()]))).alias("mode"))


def setup_statements(spark: SparkSession, folder: str) -> DataFrame:
    """The statements that each setup of a round starts from: SEED those with a correct proof, ONLY_UNSOLVED those without one, TARGET all."""
    ok = attempts(spark, folder).where("ok").select(F.col("statement_id").alias("id")).distinct().withColumn("ok", F.lit(1))
    s = statements(spark, folder).join(ok, "id", "left")
    setups = F.array(F.lit("target"), F.when(F.col("ok") == 1, F.lit("seed")).otherwise(F.lit("only_unsolved")))
    return s.select("rec_id", F.explode(setups).alias("setup"))


def tag_proofs(spark: SparkSession, folder: str) -> DataFrame:
    """The correct attempts on targets, and on conjectures, by the statement's tag."""
    a = attempts(spark, folder).where("ok")
    return a.join(statements(spark, folder, "tag").withColumnRenamed("id", "statement_id"), "statement_id").groupBy("tag").agg(F.count("*").alias("n_proofs"), F.countDistinct("statement_id").alias("n_statements"))


def solved_any(spark: SparkSession, folder: str) -> DataFrame:
    return attempts(spark, folder).groupBy("statement_id").agg(F.bool_or("ok").alias("solved"))


def unsolved_statements(spark: SparkSession, folder: str) -> DataFrame:
    solved = attempts(spark, folder).where("ok").select(F.col("statement_id").alias("id")).distinct()
    return statements(spark, folder).join(solved, "id", "left_anti").select("id")


def pass_at_1(spark: SparkSession, folder: str) -> DataFrame:
    """Correct attempts against all statements times ASKED; and against the attempts."""
    r = rates(spark, folder).agg(F.sum("correct").alias("c"), F.count("*").alias("s"), F.sum("n").alias("n"))
    return r.select(F.round(F.col("c") / (F.col("s") * ASKED), 6).alias("of_targets"), F.round(F.try_divide("c", "n"), 6).alias("of_attempts"))


def pass_at_k(spark: SparkSession, folder: str) -> DataFrame:
    """The expected share of statements with a correct one among k attempts drawn with replacement, for k of 1 to 16."""
    r = rates(spark, folder).where("n > 0").groupBy("share").agg(F.count("*").alias("w"))
    k = r.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(16))))
    share = F.sum(F.col("w") * (1 - F.pow(1 - F.col("share"), "k"))) / F.sum("w")
    return k.groupBy("k").agg(F.round(share, 6).alias("pass_rate"))


def pass_at_k_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """100 resamples of k verdicts a statement, drawn with replacement by hash, for k of 1 to ASKED: the mean and spread of their pass rates.

    The k-th draw of a sample is the same for all larger k, so that one pass gives the first hit of each statement and sample."""
    r = rates(spark, folder).where("n > 0").select("id", "n", "correct")
    draws = r.select("*", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("sample"))
    drawn = lambda d: F.conv(F.substring(F.md5(F.concat_ws("/", "id", F.col("sample").cast("string"), F.lit(str(d)))), 1, 8), 16, 10).cast("long")
    hits = [F.when(drawn(d) % F.col("n") < F.col("correct"), F.lit(d)) for d in range(1, ASKED + 1)]
    draws = draws.withColumn("first", F.when(F.col("correct") > 0, F.coalesce(*hits)))
    rate = draws.groupBy("sample").agg(F.count("*").alias("n"), *[F.count_if((F.col("first") > 0) & (F.col("first") <= k)).alias(f"h{k}") for k in range(1, ASKED + 1)])
    rate = rate.select("n", F.posexplode(F.array(*[f"h{k}" for k in range(1, ASKED + 1)])).alias("k", "h")).select((F.col("k") + 1).alias("k"), (F.col("h") / F.col("n")).alias("p"))
    return rate.groupBy("k").agg(*[F.round(f("p"), 6).alias(name) for f, name in ((F.avg, "mean_rate"), (F.min, "lowest"), (F.max, "highest"))])


def rate_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return rates(spark, folder).where("n > 0").groupBy(F.round("rate", 6).alias("rate")).agg(F.count("*").alias("n_statements"))


def solved_by_source(spark: SparkSession, folder: str) -> DataFrame:
    r = rates(spark, folder).groupBy("source").agg(F.count_if(F.col("correct") > 0).alias("solved"), F.count("*").alias("total"))
    return r.withColumn("share", F.round(F.col("solved") / F.col("total"), 6))


def solved_by_split(spark: SparkSession, folder: str) -> DataFrame:
    """Solved and all statements by split and tag, by split, and over all."""
    s = statements(spark, folder, "split", "tag").withColumn("split", F.lower(F.trim("split")))
    ok = attempts(spark, folder).where("ok").select(F.col("statement_id").alias("id")).distinct().withColumn("ok", F.lit(1))
    out = s.join(ok, "id", "left").rollup("split", "tag").agg(F.count("ok").alias("solved"), F.count("*").alias("total"), F.grouping_id().cast("long").alias("level"))
    return out.select(F.coalesce("split", F.lit("<all>")).alias("split"), F.coalesce("tag", F.lit("<all>")).alias("tag"), "level", "solved", "total")


def subsample(spark: SparkSession, folder: str) -> DataFrame:
    """50 statements without replacement: the first ones by a seeded hash."""
    return statements(spark, folder).orderBy(hash_order(F.col("id"), 7), "id").limit(50).select("id")


def solved_over_iterations(spark: SparkSession, folder: str) -> DataFrame:
    """For each iteration the statements solved up to then. Statements are counted at their first solution."""
    a = attempts(spark, folder, "iteration_created").where("ok AND iteration_created IS NOT NULL AND statement_id IS NOT NULL")
    first = a.groupBy("statement_id").agg(F.min("iteration_created").alias("iteration")).groupBy("iteration").agg(F.count("*").alias("fresh"))
    return first.withColumn("so_far", F.sum("fresh").over(Window.orderBy("iteration")))  # a row an iteration


QUERIES = {f.__name__: f for f in (solve_rate, select_hard, select_all_none_0_1, select_all, select_unsolved, less_16_gate, p70_gate, conjecture_gate, conjectures_selected, setup_statements, tag_proofs, solved_any, unsolved_statements, pass_at_1, pass_at_k, pass_at_k_bootstrap, rate_histogram, solved_by_source, solved_by_split, subsample, solved_over_iterations)}
HEAD = f"WITH {S}, {A}, {RATES}"
SQL = {
    "solve_rate": f"{HEAD} SELECT id, n, correct, round(rate, 6) AS rate FROM r",
    "select_hard": f"{HEAD} SELECT id FROM r WHERE rate > 0 AND rate <= 0.5",
    "select_all_none_0_1": f"{HEAD} SELECT id FROM r WHERE rate > 0 AND rate < 1",
    "select_all": f"{HEAD} SELECT id FROM r WHERE rate > 0",
    "select_unsolved": f"WITH {S}, {A} SELECT s.id FROM s WHERE (SELECT min(iteration_created) FROM a WHERE ok AND statement_id = s.id) >= 25",
    "less_16_gate": f"{HEAD} SELECT id, correct FROM r WHERE correct < 16",
    "p70_gate": f"""{HEAD}, o AS (SELECT rate, row_number() OVER (ORDER BY rate) - 1 AS k, count(*) OVER () AS m FROM r WHERE rate > 0 AND rate < 1),
        p AS (SELECT coalesce(max(rate), 0) AS p70 FROM o WHERE k = floor(m * 0.7::DOUBLE))
        SELECT id, round(rate, 6) AS rate, round(p70, 6) AS p70 FROM r, p WHERE rate > 0 AND rate <= p70""",
    "conjecture_gate": f"""WITH {C}, o AS (SELECT solve_rate, row_number() OVER (ORDER BY solve_rate) - 1 AS k, count(*) OVER () AS m FROM c WHERE solve_rate > 0 AND solve_rate < 1),
        p AS (SELECT coalesce(max(solve_rate), 0) AS p70 FROM o WHERE k = floor(m * 0.7::DOUBLE))
        SELECT rec_id, solve_rate FROM c, p WHERE solve_rate > 0 AND solve_rate <= p70""",
    "conjectures_selected": f"""WITH {C}, m AS (SELECT unnest(['hard', 'all_none_0_1', 'all', 'unsolved', 'less_16']) AS mode)
        SELECT rec_id, mode FROM c, m WHERE solve_rate > 0 AND CASE mode WHEN 'hard' THEN solve_rate <= 0.5 WHEN 'all_none_0_1' THEN solve_rate < 1 ELSE true END""",
    "setup_statements": f"""WITH {S}, {A}, o AS (SELECT rec_id, EXISTS (SELECT 1 FROM a WHERE ok AND statement_id = s.id) AS ok FROM s)
        SELECT rec_id, 'target' AS setup FROM o UNION ALL SELECT rec_id, CASE WHEN ok THEN 'seed' ELSE 'only_unsolved' END FROM o""",
    "tag_proofs": f"WITH {S}, {A} SELECT tag, count(*) AS n_proofs, count(DISTINCT statement_id) AS n_statements FROM a JOIN s ON statement_id = s.id WHERE ok GROUP BY tag",
    "pass_at_k_bootstrap": f"""{HEAD}, d AS (SELECT n, correct, sample, k, ('0x' || substr(md5(concat_ws('/', id, sample::VARCHAR, k::VARCHAR)), 1, 8))::BIGINT % n < correct AS hit, id FROM r, range(0, 100) AS g(sample), range(1, {ASKED + 1}) AS h(k) WHERE n > 0),
        f AS (SELECT id, sample, min(k) FILTER (hit) AS first FROM d GROUP BY id, sample),
        p AS (SELECT k, sample, avg((coalesce(first, 1000) <= k)::INT) AS p FROM f, range(1, {ASKED + 1}) AS h(k) GROUP BY k, sample)
        SELECT k::INT AS k, round(avg(p), 6) AS mean_rate, round(min(p), 6) AS lowest, round(max(p), 6) AS highest FROM p GROUP BY k""",
    "solved_any": f"WITH {A} SELECT statement_id, bool_or(ok) AS solved FROM a GROUP BY statement_id",
    "unsolved_statements": f"WITH {S}, {A} SELECT id FROM s WHERE NOT EXISTS (SELECT 1 FROM a WHERE ok AND statement_id = s.id)",
    "pass_at_1": f"{HEAD} SELECT round(sum(correct) / (count(*) * {ASKED}), 6) AS of_targets, round(sum(correct) / sum(n), 6) AS of_attempts FROM r",
    "pass_at_k": f"{HEAD} SELECT k::INT AS k, round(avg(1 - pow(1 - share, k)), 6) AS pass_rate FROM r, range(1, 17) AS g(k) WHERE n > 0 GROUP BY k",
    "rate_histogram": f"{HEAD} SELECT round(rate, 6) AS rate, count(*) AS n_statements FROM r WHERE n > 0 GROUP BY 1",
    "solved_by_source": f"{HEAD} SELECT source, count(*) FILTER (correct > 0) AS solved, count(*) AS total, round(count(*) FILTER (correct > 0) / count(*), 6) AS share FROM r GROUP BY source",
    "solved_by_split": f"""WITH {S}, {A}, x AS (SELECT lower(trim(split)) AS split, tag, EXISTS (SELECT 1 FROM a WHERE ok AND statement_id = s.id) AS ok FROM s)
        SELECT coalesce(split, '<all>') AS split, coalesce(tag, '<all>') AS tag, grouping_id(split, tag)::BIGINT AS level, count(*) FILTER (ok) AS solved, count(*) AS total
        FROM x GROUP BY ROLLUP (split, tag)""",
    "subsample": f"WITH {S} SELECT id FROM s ORDER BY md5('7/' || id), id LIMIT 50",
    "solved_over_iterations": f"""WITH {A}, f AS (SELECT statement_id, min(iteration_created) AS iteration FROM a WHERE ok AND statement_id IS NOT NULL AND iteration_created IS NOT NULL GROUP BY 1)
        SELECT iteration, count(*) AS fresh, sum(count(*)) OVER (ORDER BY iteration)::BIGINT AS so_far FROM f GROUP BY iteration""",
}
