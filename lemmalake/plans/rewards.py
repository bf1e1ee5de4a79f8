"""Rewards, advantages and weights of training samples and attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lemmalake.functions import scores as M
from lemmalake.functions import text as X
from lemmalake.operators.order import hash_order, ordinals
from lemmalake.plans.base import A, C, T, attempts, conjectures, samples

MOST = 150


def valid_reward() -> Column:
    return F.when(~F.isnan("reward"), F.col("reward"))


def length_penalty(spark: SparkSession, folder: str) -> DataFrame:
    t = samples(spark, folder, "gen_tokens").where("gen_tokens IS NOT NULL")
    return t.select("sample_id", F.round(M.length_penalty(F.size("gen_tokens"), MOST), 6).alias("penalty"))


def shortness(spark: SparkSession, folder: str) -> DataFrame:
    t = samples(spark, folder, "gen_str", "reward").select("sample_id", F.length("gen_str").alias("n"), valid_reward().alias("w"))
    return t.where("n IS NOT NULL AND w IS NOT NULL").select("sample_id", F.round(M.shortness(F.col("n"), F.col("w")), 6).alias("weight"))


def cascade(correct: Column, proof: Column, generation: Column, tokens: Column) -> Column:
    """A reward of 1 or 0, which later rules override in this order: too long, a search tactic (both without comments), the length penalty, shortness,
    a second fence."""
    bare = X.without_comments(proof)
    r = F.when(correct, 1.0).otherwise(0.0)
    r = F.when((F.length(bare) > 1000) | F.contains(bare, F.lit("try")), 0.0).otherwise(r)
    r = F.when(M.length_penalty(tokens, MOST) < 0, M.length_penalty(tokens, MOST)).otherwise(r)
    r = M.shortness(F.length(proof), r)
    return F.when(X.count_of(generation, X.OPEN) > 1, 0.0).otherwise(r)


def reward_cascade(spark: SparkSession, folder: str) -> DataFrame:
    a = attempts(spark, folder, "proof_str", "full_generation", "full_generation_tokens")
    n = F.coalesce(F.size("full_generation_tokens"), F.lit(0))
    return a.select("attempt_id", F.round(cascade(F.col("ok"), F.col("proof_str"), F.col("full_generation"), F.greatest(n, F.lit(0))), 6).alias("reward"))


def ungrouped_rewards(spark: SparkSession, folder: str) -> DataFrame:
    """The rewards of training without groups, for which wrong, long, searching and twice fenced attempts are left out."""
    a = attempts(spark, folder, "proof_str", "full_generation", "full_generation_tokens").where("ok")
    bare = X.without_comments(F.col("proof_str"))
    out = (F.length(bare) > 1000) | F.contains(bare, F.lit("try")) | (X.count_of(F.col("full_generation"), X.OPEN) > 1)
    n = F.greatest(F.coalesce(F.size("full_generation_tokens"), F.lit(0)), F.lit(0))
    kept = a.where(~F.coalesce(out, F.lit(False)))
    return kept.select("attempt_id", F.round(cascade(F.lit(True), F.col("proof_str"), F.col("full_generation"), n), 6).alias("reward"))


def group_advantage(spark: SparkSession, folder: str) -> DataFrame:
    """(reward - mean) / (population deviation + 1e-6) by group; groups with only zero rewards are left out.

    The groups are aggregated first and joined, so that a group of any size is spread over tasks. In `ungrouped` the reward itself."""
    t = samples(spark, folder, "group_id", "reward").select("sample_id", "group_id", valid_reward().alias("r")).where("r IS NOT NULL")
    g = t.groupBy("group_id").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s"), F.max(F.abs("r")).alias("top")).where("top > 0")
    adv = F.when(F.col("group_id") == "ungrouped", F.col("r")).otherwise((F.col("r") - F.col("m")) / (F.col("s") + 1e-6))
    return t.join(g, "group_id").select("sample_id", F.round(adv, 4).alias("advantage"))


def dropped_groups(spark: SparkSession, folder: str) -> DataFrame:
    t = samples(spark, folder, "group_id", "reward").select("group_id", valid_reward().alias("r"))
    g = t.groupBy("group_id").agg(F.count("*").alias("n"), F.max(F.abs("r")).alias("top"))
    return g.where("coalesce(top, 0) = 0").select("group_id", "n")


def minmax_rewards(spark: SparkSession, folder: str) -> DataFrame:
    """Rewards scaled to 0..1 by the extremes of their source; 1 where all are equal."""
    t = samples(spark, folder, "source", "reward").select("sample_id", "source", valid_reward().alias("r")).where("r IS NOT NULL")
    e = t.groupBy("source").agg(F.min("r").alias("low"), F.max("r").alias("high"))
    scaled = F.when(F.col("low") == F.col("high"), 1.0).otherwise((F.col("r") - F.col("low")) / (F.col("high") - F.col("low")))
    return t.join(e, "source").select("sample_id", F.round(scaled, 6).alias("scaled"))


def conjecture_reward(spark: SparkSession, folder: str) -> DataFrame:
    """(1 - solve rate) of the conjectures times the mean review of the attempts on their seeds, 1 where there is none; the length penalty
    instead where there is one."""
    c = conjectures(spark, folder, "seed_id", "solve_rate", "conjecture_full_generation_tokens").where("solve_rate IS NOT NULL")
    c = c.join(reviews(spark, folder).withColumnRenamed("statement_id", "seed_id"), "seed_id", "left")
    penalty = M.length_penalty(F.greatest(F.coalesce(F.size("conjecture_full_generation_tokens"), F.lit(0)), F.lit(0)), MOST)
    return c.select("rec_id", F.round(F.when(penalty < 0, penalty).otherwise(F.coalesce("review", F.lit(1.0)) * (1 - F.col("solve_rate"))), 6).alias("reward"))


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """The mean review of each statement's attempts; missing ones don't count."""
    a = attempts(spark, folder, "review").where("review IS NOT NULL AND NOT isnan(review) AND statement_id IS NOT NULL")
    return a.groupBy("statement_id").agg(F.avg("review").alias("review"))


def mean_review(spark: SparkSession, folder: str) -> DataFrame:
    """The mean over statements of their mean reviews, 0 if there are none, and how many statements have one."""
    return reviews(spark, folder).agg(F.round(F.coalesce(F.avg("review"), F.lit(0.0)), 6).alias("mean_review"), F.count("*").alias("n"))


def all_reviewed(spark: SparkSession, folder: str) -> DataFrame:
    """Of each iteration, whether all of its attempts have a review, so that none has to be made."""
    a = attempts(spark, folder, "review", "iteration_created")
    return a.groupBy("iteration_created").agg(F.bool_and(F.col("review").isNotNull()).alias("reviewed"), F.count_if(F.col("review").isNull()).alias("missing"))


def group_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The tokens of each group, and whether the number that its samples carry is another."""
    t = samples(spark, folder, "group_id", "gen_tokens", "num_tokens_in_group").where("group_id <> 'ungrouped'")
    g = t.groupBy("group_id").agg(F.sum(F.coalesce(F.greatest(F.size("gen_tokens"), F.lit(0)), F.lit(0))).alias("tokens"), F.count("*").alias("n"), F.max("num_tokens_in_group").alias("told"))
    return g.select("group_id", "n", "tokens", (F.coalesce("told", F.lit(-1)) != F.col("tokens")).alias("stale"))


def uneven_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups that aren't of 8 samples: those that grouped training can't use."""
    return samples(spark, folder, "group_id").groupBy("group_id").agg(F.count("*").alias("n")).where("n <> 8")


def shuffled_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every sample in an order that shuffles groups but keeps each together; samples without a group are shuffled one by one."""
    alone = F.coalesce(F.col("group_id") == "ungrouped", F.lit(True))
    key = F.when(alone, F.concat(F.lit("sample "), F.col("sample_id").cast("string"))).otherwise(F.col("group_id"))
    t = samples(spark, folder, "group_id").select("sample_id", key.alias("key")).withColumn("h", hash_order(F.col("key"), 17))
    return ordinals(t, "h", "key", "sample_id").select("sample_id", "ordinal")


def funnel(spark: SparkSession, folder: str) -> DataFrame:
    a = attempts(spark, folder, "proof_str", "full_generation", "full_generation_tokens", "iteration_created")
    reward = cascade(F.col("ok"), F.col("proof_str"), F.col("full_generation"), F.greatest(F.coalesce(F.size("full_generation_tokens"), F.lit(0)), F.lit(0)))
    last = a.agg(F.max("iteration_created").alias("last"))
    age = F.col("last") - F.col("iteration_created")
    return a.crossJoin(F.broadcast(last)).agg(  # one row
        F.count("*").alias("n"), F.count_if("ok").alias("correct"), F.count_if(reward > 0).alias("kept"), F.count_if(reward < 0).alias("punished"),
        *[F.count_if(age == k).alias(f"age_{k}") for k in range(3)], F.count_if(age < 3).alias("recent"),
    )


def minmax_window_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every sample among its group's by reward; equal rewards share it."""
    t = samples(spark, folder, "group_id", "reward").where("group_id <> 'ungrouped'").select("sample_id", "group_id", valid_reward().alias("r")).where("r IS NOT NULL")
    return t.select("sample_id", F.dense_rank().over(Window.partitionBy("group_id").orderBy(F.col("r").desc())).cast("long").alias("place"))


QUERIES = {f.__name__: f for f in (length_penalty, shortness, reward_cascade, ungrouped_rewards, mean_review, all_reviewed, group_advantage, dropped_groups, minmax_rewards, conjecture_reward, group_tokens, uneven_groups, shuffled_groups, funnel, minmax_window_rank)}
PENALTY = "CASE WHEN {n} <= 120 THEN 0 ELSE greatest(-1.0, -({n} - 120.0) / 30.0) END"
penalty = lambda n: PENALTY.format(n=n)
R = f"WITH {T}, r AS (SELECT *, CASE WHEN NOT isnan(reward) THEN reward END AS r FROM t)"
FENCES = "(length(full_generation) - length(replace(full_generation, '```lean4', ''))) // 8"
BARE = r"regexp_replace(regexp_replace(proof_str, '/-[\s\S]*?-/', '', 'g'), '--.*', '', 'g')"
CASCADE = f"""x AS (SELECT *, CASE WHEN length({BARE}) > 1000 OR contains({BARE}, 'try') THEN 0.0 WHEN ok THEN 1.0 ELSE 0.0 END::DOUBLE AS r1,
        ({penalty("coalesce(len(full_generation_tokens), 0)")})::DOUBLE AS p FROM a),
    y AS (SELECT *, CASE WHEN p < 0 THEN p ELSE r1 END AS r2 FROM x),
    z AS (SELECT *, CASE WHEN {FENCES} > 1 THEN 0.0::DOUBLE WHEN r2 = 1 THEN exp(-0.001 * length(proof_str)) ELSE r2 END AS reward FROM y)"""
SQL = {
    "length_penalty": f"WITH {T} SELECT sample_id, round({penalty('len(gen_tokens)')}, 6)::DOUBLE AS penalty FROM t WHERE gen_tokens IS NOT NULL",
    "shortness": f"{R} SELECT sample_id, round(CASE WHEN r = 1 THEN exp(-0.001 * length(gen_str)) ELSE r END, 6) AS weight FROM r WHERE r IS NOT NULL AND gen_str IS NOT NULL",
    "reward_cascade": f"WITH {A}, {CASCADE} SELECT attempt_id, round(reward, 6) AS reward FROM z",
    "group_advantage": f"""{R}, g AS (SELECT group_id, avg(r) AS m, stddev_pop(r) AS s FROM r WHERE r IS NOT NULL GROUP BY 1 HAVING max(abs(r)) > 0)
        SELECT sample_id, round(CASE WHEN group_id = 'ungrouped' THEN r ELSE (r - m) / (s + 1e-6) END, 4) AS advantage FROM r JOIN g USING (group_id) WHERE r IS NOT NULL""",
    "dropped_groups": f"{R} SELECT group_id, count(*) AS n FROM r GROUP BY 1 HAVING coalesce(max(abs(r)), 0) = 0",
    "minmax_rewards": f"""{R}, e AS (SELECT source, min(r) AS low, max(r) AS high FROM r GROUP BY 1)
        SELECT sample_id, round(CASE WHEN low = high THEN 1.0 ELSE (r - low) / (high - low) END, 6) AS scaled FROM r JOIN e USING (source) WHERE r IS NOT NULL""",
    "conjecture_reward": f"""WITH {C}, {A}, v AS (SELECT statement_id, avg(review) AS review FROM a WHERE isfinite(review) AND statement_id IS NOT NULL GROUP BY 1),
        x AS (SELECT rec_id, solve_rate, coalesce(review, 1) AS review, ({penalty("coalesce(len(conjecture_full_generation_tokens), 0)")})::DOUBLE AS p FROM c LEFT JOIN v ON seed_id = statement_id WHERE solve_rate IS NOT NULL)
        SELECT rec_id, round(CASE WHEN p < 0 THEN p ELSE review * (1 - solve_rate) END, 6) AS reward FROM x""",
    "group_tokens": f"""WITH {T} SELECT group_id, count(*) AS n, sum(coalesce(len(gen_tokens), 0))::BIGINT AS tokens, coalesce(max(num_tokens_in_group), -1) <> sum(coalesce(len(gen_tokens), 0)) AS stale
        FROM t WHERE group_id <> 'ungrouped' GROUP BY 1""",
    "uneven_groups": f"WITH {T} SELECT group_id, count(*) AS n FROM t GROUP BY 1 HAVING count(*) <> 8",
    "shuffled_groups": f"""WITH {T}, k AS (SELECT sample_id, CASE WHEN coalesce(group_id, 'ungrouped') = 'ungrouped' THEN 'sample ' || sample_id ELSE group_id END AS key FROM t)
        SELECT sample_id, row_number() OVER (ORDER BY md5('17/' || key), key, sample_id) - 1 AS ordinal FROM k""",
    "ungrouped_rewards": f"""WITH {A}, {CASCADE} SELECT attempt_id, round(reward, 6) AS reward FROM z
        WHERE ok AND NOT coalesce(length({BARE}) > 1000 OR contains({BARE}, 'try') OR {FENCES} > 1, false)""",
    "mean_review": f"""WITH {A}, r AS (SELECT statement_id, avg(review) AS review FROM a WHERE isfinite(review) AND statement_id IS NOT NULL GROUP BY 1)
        SELECT round(coalesce(avg(review), 0), 6) AS mean_review, count(*) AS n FROM r""",
    "all_reviewed": f"WITH {A} SELECT iteration_created, bool_and(review IS NOT NULL) AS reviewed, count(*) FILTER (review IS NULL) AS missing FROM a GROUP BY 1",
    "funnel": f"""WITH {A}, {CASCADE} SELECT count(*) AS n, count(*) FILTER (ok) AS correct, count(*) FILTER (reward > 0) AS kept, count(*) FILTER (reward < 0) AS punished,
        count(*) FILTER (iteration_created = last) AS age_0, count(*) FILTER (iteration_created = last - 1) AS age_1, count(*) FILTER (iteration_created = last - 2) AS age_2,
        count(*) FILTER (iteration_created > last - 3) AS recent FROM z, (SELECT max(iteration_created) AS last FROM a)""",
    "minmax_window_rank": f"{R} SELECT sample_id, dense_rank() OVER (PARTITION BY group_id ORDER BY r DESC) AS place FROM r WHERE r IS NOT NULL AND group_id <> 'ungrouped'",
}
