"""Token arrays: entropy, importance ratios, padding, losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmalake.functions import scores as M
from lemmalake.operators.order import previous
from lemmalake.plans.base import C, T, conjectures, samples
from lemmalake.sources.tables import table


def entropy(spark: SparkSession, folder: str) -> DataFrame:
    """The entropy of the probabilities that an embedding's first 10 numbers give, shifted below 0."""
    e = table(spark, folder, "embeddings")
    logs = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") - 1)
    return e.select("vec_id", F.round(M.entropy(logs), 5).alias("entropy"))


def importance_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Ratios of two policies by token, clamped to 0.8..1.2: their mean and how many were clamped at either end, before clamping."""
    e = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    new, old = F.slice("x", 1, 32), F.slice("x", 33, 32)
    raw = F.zip_with(new, old, lambda a, b: F.exp(a - b))
    clamped = M.importance_ratios(new, old, 0.8, 1.2)
    mean = F.aggregate(clamped, F.lit(0.0), lambda s, v: s + v) / 32
    low, high = (F.size(F.filter(raw, f)).cast("long") for f in (lambda v: v < 0.8, lambda v: v > 1.2))
    return e.select("vec_id", F.round(mean, 5).alias("mean_ratio"), low.alias("at_low"), high.alias("at_high"))


def masked_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """Ratios of token probabilities of neighbouring samples of a group, by token, the later one as the new policy and the one before as the old
    one: clamped to 0.8..1.2 where both have the token, 1 where one hasn't; their mean, and how many were clamped at either end."""
    t = samples(spark, folder, "group_id", "log_prob_over_gen").where("group_id <> 'ungrouped' AND size(log_prob_over_gen) > 0")
    t = previous(t, "group_id", ["sample_id"], ["log_prob_over_gen"])
    t = t.select("sample_id", F.col("log_prob_over_gen").alias("new"), F.col("before.log_prob_over_gen").alias("old")).where("old IS NOT NULL")
    raw = F.zip_with("new", "old", lambda a, b: F.exp(a - b))
    both = F.filter(raw, lambda r: r.isNotNull())
    clamped = F.transform(raw, lambda r: F.when(r.isNotNull(), F.greatest(F.lit(0.8), F.least(F.lit(1.2), r))).otherwise(1.0))
    mean = F.aggregate(clamped, F.lit(0.0), lambda s, v: s + v) / F.size(raw)
    low, high = (F.size(F.filter(both, f)).cast("long") for f in (lambda v: v < 0.8, lambda v: v > 1.2))
    return t.select("sample_id", F.round(mean, 5).alias("mean_ratio"), low.alias("at_low"), high.alias("at_high"))


def plain_loss(spark: SparkSession, folder: str) -> DataFrame:
    """By source, without groups: the sum of (log probabilities times the reward) over all tokens, by token; NaN rewards don't count."""
    t = samples(spark, folder, "source", "log_prob_over_gen", "reward").where("log_prob_over_gen IS NOT NULL AND reward IS NOT NULL AND NOT isnan(reward)")
    s = t.select("source", (F.aggregate("log_prob_over_gen", F.lit(0.0), lambda a, x: a + x) * F.col("reward")).alias("l"), F.size("log_prob_over_gen").alias("n"))
    return s.groupBy("source").agg((F.round(-F.sum("l") / F.greatest(F.sum("n"), F.lit(1)), 5) + 0.0).alias("loss"))


def token_means(spark: SparkSession, folder: str) -> DataFrame:
    t = samples(spark, folder, "source", "gen_tokens", "prompt_str").where("gen_tokens IS NOT NULL")
    return t.groupBy("source").agg(F.round(F.avg(F.size("gen_tokens")), 6).alias("mean_tokens"), F.sum(F.size("gen_tokens")).alias("tokens"), F.round(F.avg(F.length("prompt_str")), 6).alias("mean_prompt"))


def pad_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Label arrays of conjectures: 3 masked places for the prompt, then the tokens, padded on the left to 210; what they hold."""
    c = conjectures(spark, folder, "conjecture_full_generation_tokens").where("conjecture_full_generation_tokens IS NOT NULL")
    labels = F.concat(F.array_repeat(F.lit(-100), 3), F.col("conjecture_full_generation_tokens"))
    row = c.select("rec_id", M.padded(labels, F.lit(210), -100).alias("x"))
    masked = F.size(F.filter("x", lambda v: v == -100)).cast("long")
    return row.select("rec_id", F.size("x").cast("long").alias("size"), masked.alias("masked"), F.element_at("x", -1).alias("last"))


def shifted_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 pairs of neighbouring tokens, label after input, that are the most frequent in all samples."""
    t = samples(spark, folder, "gen_tokens").where("size(gen_tokens) > 1")
    n = F.size("gen_tokens") - 1
    pairs = t.select(F.inline(F.arrays_zip(F.slice("gen_tokens", F.lit(1), n).alias("a"), F.slice("gen_tokens", F.lit(2), n).alias("b"))))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "a", "b").limit(20)


def weighted_loss(spark: SparkSession, folder: str) -> DataFrame:
    """By group: the sum of (log probabilities times the advantage) over the group's tokens, by token; NaN advantages don't count."""
    t = samples(spark, folder, "group_id", "log_prob_over_gen", "advantage").where("log_prob_over_gen IS NOT NULL AND advantage IS NOT NULL AND NOT isnan(advantage)")
    s = t.select("group_id", (F.aggregate("log_prob_over_gen", F.lit(0.0), lambda a, x: a + x) * F.col("advantage")).alias("l"), F.size("log_prob_over_gen").alias("n"))
    return s.groupBy("group_id").agg((F.round(-F.sum("l") / F.greatest(F.sum("n"), F.lit(1)), 5) + 0.0).alias("loss"))


def end_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The last tokens of the samples shorter than 512, the 20 most frequent ones."""
    t = samples(spark, folder, "gen_tokens").where("size(gen_tokens) BETWEEN 1 AND 511")
    return t.groupBy(F.element_at("gen_tokens", -1).alias("token")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "token").limit(20)


QUERIES = {f.__name__: f for f in (entropy, importance_ratio, masked_ratios, plain_loss, token_means, pad_mask, shifted_pairs, weighted_loss, end_tokens)}
SQL = {
    "entropy": """WITH x AS (SELECT vec_id, unnest(embedding[1:10])::DOUBLE - 1 AS v FROM embeddings), s AS (SELECT vec_id, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS p FROM x)
        SELECT vec_id, round(-sum(p * ln(p + 1e-10)), 5) AS entropy FROM s GROUP BY 1""",
    "importance_ratio": """WITH x AS (SELECT vec_id, exp(unnest(embedding[1:32])::DOUBLE - unnest(embedding[33:64])::DOUBLE) AS r FROM embeddings)
        SELECT vec_id, round(avg(greatest(0.8, least(1.2, r))), 5) AS mean_ratio, count(*) FILTER (r < 0.8) AS at_low, count(*) FILTER (r > 1.2) AS at_high FROM x GROUP BY 1""",
    "masked_ratios": f"""WITH {T}, p AS (SELECT sample_id, log_prob_over_gen AS new, lag(log_prob_over_gen) OVER (PARTITION BY group_id ORDER BY sample_id) AS old FROM t WHERE group_id <> 'ungrouped' AND len(log_prob_over_gen) > 0),
        x AS (SELECT sample_id, exp(new[k] - old[k]) AS r FROM p, range(1, (SELECT max(len(new)) FROM p) + 1) AS g(k) WHERE old IS NOT NULL AND k <= greatest(len(new), len(old)))
        SELECT sample_id, round(avg(CASE WHEN r IS NOT NULL THEN greatest(0.8, least(1.2, r)) ELSE 1 END), 5) AS mean_ratio, count(*) FILTER (r < 0.8) AS at_low, count(*) FILTER (r > 1.2) AS at_high FROM x GROUP BY 1""",
    "plain_loss": f"""WITH {T} SELECT source, round(-sum(coalesce(list_sum(log_prob_over_gen), 0) * reward) / greatest(sum(len(log_prob_over_gen)), 1), 5) + 0.0 AS loss
        FROM t WHERE log_prob_over_gen IS NOT NULL AND isfinite(reward) GROUP BY 1""",
    "token_means": f"""WITH {T} SELECT source, round(avg(len(gen_tokens)), 6) AS mean_tokens, sum(len(gen_tokens))::BIGINT AS tokens, round(avg(length(prompt_str)), 6) AS mean_prompt
        FROM t WHERE gen_tokens IS NOT NULL GROUP BY 1""",
    "pad_mask": f"""WITH {C}, x AS (SELECT rec_id, conjecture_full_generation_tokens AS g FROM c WHERE conjecture_full_generation_tokens IS NOT NULL)
        SELECT rec_id, greatest(210, len(g) + 3)::BIGINT AS size, greatest(210, len(g) + 3) - len(list_filter(g, lambda v: v <> -100)) AS masked, coalesce(g[-1], -100) AS last FROM x""",
    "shifted_pairs": f"""WITH {T}, x AS (SELECT unnest(gen_tokens[1:-2]) AS a, unnest(gen_tokens[2:]) AS b FROM t WHERE len(gen_tokens) > 1)
        SELECT a, b, count(*) AS n FROM x GROUP BY ALL ORDER BY n DESC, a, b LIMIT 20""",
    "weighted_loss": f"""WITH {T} SELECT group_id, round(-sum(coalesce(list_sum(log_prob_over_gen), 0) * advantage) / greatest(sum(len(log_prob_over_gen)), 1), 5) + 0.0 AS loss
        FROM t WHERE log_prob_over_gen IS NOT NULL AND isfinite(advantage) GROUP BY 1""",
    "end_tokens": f"""WITH {T} SELECT gen_tokens[-1] AS token, count(*) AS n FROM t WHERE len(gen_tokens) BETWEEN 1 AND 511 GROUP BY 1 ORDER BY n DESC, token LIMIT 20""",
}
