"""Records of iterations, metrics, runs and reviews: what a loop writes down about itself and reads again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lemmalake.functions import text as X
from lemmalake.operators.dedup import first_of
from lemmalake.operators.order import hash_order, ordinals
from lemmalake.plans.base import ASKED, A, C, S, T, attempts, conjectures, samples, statements
from lemmalake.plans.reshape import SQL as RESHAPE
from lemmalake.plans.reshape import few_shot_pick
from lemmalake.plans.verdicts import REPLY, TIMEOUT, V, events, replies
from lemmalake.sources.tables import table
from lemmalake.storage import new_table

#: Names in the metrics table.
METRICS = ("n_attempts", "n_correct", "n_statements", "n_tokens")


def n_tokens(c: str) -> Column:
    return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))


def by_iteration(spark: SparkSession, folder: str) -> DataFrame:
    a = attempts(spark, folder, "iteration_created", "full_generation_tokens").where("iteration_created IS NOT NULL")
    return a.groupBy(F.col("iteration_created").alias("iteration")).agg(
        F.count("*").alias("n_attempts"), F.count_if("ok").alias("n_correct"), F.countDistinct("statement_id").alias("n_statements"), F.sum(n_tokens("full_generation_tokens")).alias("n_tokens")
    )


def iteration_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row an iteration: what was generated in it, attempts and conjectures, and how much up to then."""
    c = conjectures(spark, folder, "iteration").where("iteration IS NOT NULL").groupBy("iteration").agg(F.count("*").alias("n_conjectures"))
    both = by_iteration(spark, folder).join(c, "iteration", "full_outer").na.fill(0)
    made = F.col("n_attempts") + F.col("n_conjectures")
    return both.select("*", F.sum(made).over(Window.orderBy("iteration")).alias("so_far"))  # a row an iteration


def next_iteration(spark: SparkSession, folder: str) -> DataFrame:
    """The last iteration of the attempts and of the conjectures, whether they agree, and the one to come."""
    a = attempts(spark, folder, "iteration_created").agg(F.max("iteration_created").alias("of_attempts"))
    c = conjectures(spark, folder, "iteration").agg(F.max("iteration").alias("of_conjectures"))
    last = F.greatest("of_attempts", "of_conjectures")
    return a.crossJoin(c).select("*", F.col("of_attempts").eqNullSafe(F.col("of_conjectures")).alias("agree"), (F.coalesce(last, F.lit(-1)) + 1).alias("next"))  # one row each


def metrics_table(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics as rows (key, value, iteration), written by iteration and read again."""
    long = by_iteration(spark, folder).select("iteration", F.expr("stack({}, {}) AS (key, value)".format(len(METRICS), ", ".join(f"'{m}', {m}" for m in METRICS))))
    path = new_table(spark, "metrics")
    long.write.partitionBy("iteration").parquet(path)
    return spark.read.schema("key string, value bigint, iteration int").parquet(path).select("key", "value", "iteration")


def merged_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The metrics of each iteration in one map: later maps win over earlier ones (a default of -1 for all)."""
    first = F.map_from_arrays(F.array(*[F.lit(m) for m in (*METRICS, "n_rewarded")]), F.array(*[F.lit(-1).cast("long")] * (len(METRICS) + 1)))
    second = F.map_from_arrays(F.array(*[F.lit(m) for m in METRICS]), F.array(*METRICS))
    both = F.map_concat(F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(second), k)), second)
    return by_iteration(spark, folder).select("iteration", F.explode(both).alias("key", "value"))


def time_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Verification times from 0 to the longest, the timeout at least, in as many bins as the root of their number, 10 to 60; the last one is closed."""
    t = replies(spark, folder).where("verify_time >= 0 AND NOT isnan(verify_time) AND verify_time < double('infinity')").select("verify_time")
    ends = t.agg(F.greatest(F.max("verify_time"), F.lit(TIMEOUT)).alias("high"), F.least(F.lit(60), F.greatest(F.lit(10), F.floor(F.sqrt(F.count("*"))))).alias("bins"))
    bin_ = F.least(F.floor(F.col("verify_time") / (F.col("high") / F.col("bins"))), F.col("bins") - 1)
    return t.crossJoin(F.broadcast(ends)).groupBy(bin_.cast("long").alias("bin"), F.col("bins").cast("long").alias("bins")).agg(F.count("*").alias("n"))  # one row


def mean_chars(spark: SparkSession, folder: str) -> DataFrame:
    """The mean characters of proofs and of conjectures; 0 where there are none."""
    a = attempts(spark, folder, "proof_str").select(F.lit("proof").alias("kind"), F.length("proof_str").alias("n"))
    c = conjectures(spark, folder, "conjecture").select(F.lit("conjecture").alias("kind"), F.length("conjecture").alias("n"))
    return a.unionByName(c).groupBy("kind").agg(F.round(F.coalesce(F.sum("n"), F.lit(0)) / F.greatest(F.count("n"), F.lit(1)), 6).alias("mean_chars"))


def entropy_of(logprobs: Column) -> Column:
    """The mean entropy of tokens, of which each has ten candidates' logarithms, scaled to sum to 1; -1 if there are none."""
    starts = F.sequence(F.lit(1), F.size(logprobs), F.lit(10))

    def one(at: Column) -> Column:
        p = F.transform(F.slice(logprobs, at, 10), F.exp)
        total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
        return F.aggregate(p, F.lit(0.0), lambda s, x: s - (x / total) * F.log(x / total + 1e-10))

    each = F.transform(starts, one)
    return F.when(F.size(logprobs) > 0, F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(each)).otherwise(-1.0)


def token_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """The mean entropy of each attempt whose log probabilities are known, ten to a token."""
    a = attempts(spark, folder, "full_generation_logprobs").where("full_generation_logprobs IS NOT NULL")
    return a.select("attempt_id", F.round(entropy_of(F.col("full_generation_logprobs")), 5).alias("entropy"))


def mean_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """The mean entropy of each writer's attempts; -1 where none is known."""
    a = attempts(spark, folder, "source", "full_generation_logprobs")
    e = F.when(F.col("full_generation_logprobs").isNotNull(), entropy_of(F.col("full_generation_logprobs")))
    return a.groupBy("source").agg(F.round(F.coalesce(F.avg(e), F.lit(-1.0)), 5).alias("mean_entropy"))


def compiler_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts from compiler messages alone: passed without an error; complete if passed, without a hole, and without a warning of a hole or of something
    that failed. The messages are the replies' errors; every fifth one is taken as a warning, and a proof with `sorry` has a hole."""
    v = attempts(spark, folder, "verification_dict", "proof_str").where("verification_dict IS NOT NULL").select("attempt_id", "proof_str", F.from_json("verification_dict", REPLY).alias("v"))
    messages = F.coalesce("v.errors", F.array().cast("array<struct<severity string, data string, line int>>"))
    warning = F.col("attempt_id") % 5 == 0
    severity = F.transform(messages, lambda m: F.struct(F.when(warning, "warning").otherwise(m.severity).alias("severity"), m.data.alias("data")))
    v = v.select("attempt_id", severity.alias("m"), F.coalesce(F.contains("proof_str", F.lit("sorry")), F.lit(False)).alias("hole"))
    of = lambda kind: F.filter("m", lambda m: m.severity == kind)
    told = F.exists(of("warning"), lambda m: F.contains(m.data, F.lit("declaration uses 'sorry'")) | F.contains(m.data, F.lit("failed")))
    passed = F.size(of("error")) == 0
    n = [F.size(of(k)).cast("long").alias(f"n_{k}s") for k in ("error", "warning", "info")]
    return v.select("attempt_id", passed.alias("pass"), (passed & ~F.col("hole") & ~told).alias("complete"), *n)


def system_error_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The system errors of failed verifications, by writer."""
    return replies(spark, folder).where("system_errors IS NOT NULL").groupBy("source", F.col("system_errors").alias("message")).agg(F.count("*").alias("n"))


def split_write(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts written apart by success, with a `finished` marker for each statement that has all it asked for; then found again from the markers."""
    a = attempts(spark, folder).where("statement_id IS NOT NULL").select("attempt_id", "statement_id", "ok")
    path, marks = new_table(spark, "attempts-by-success"), new_table(spark, "finished")
    a.write.partitionBy("ok").parquet(path)
    a.groupBy("statement_id").agg(F.count("*").alias("n")).where(F.col("n") >= ASKED).select("statement_id").write.parquet(marks)
    again = spark.read.schema("attempt_id bigint, statement_id string, ok boolean").parquet(path)
    done = again.join(spark.read.schema("statement_id string").parquet(marks), "statement_id", "left_semi")
    return done.groupBy("statement_id").agg(F.bool_or("ok").alias("success"), F.count("*").alias("n"))


def prefix_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Solved statements of each kind of source, by prefix or over all, with the ratio as it is shown."""
    solved = attempts(spark, folder).where("ok").select(F.col("statement_id").alias("id")).distinct().withColumn("ok", F.lit(1))
    s = statements(spark, folder, "source").join(solved, "id", "left")
    kinds = F.array(F.lit("<all>"), *[F.when(F.startswith("source", F.lit(p)), F.lit(p)) for p in ("contest", "olymp", "synth", "text")])
    by = s.select(F.explode(F.array_compact(kinds)).alias("kind"), "ok").groupBy("kind").agg(F.count("ok").alias("k"), F.count("*").alias("n"))
    return by.select("kind", F.format_string("%3d / %3d = %.3f", "k", "n", F.col("k") / F.col("n")).alias("shown"))


def ordered_results(spark: SparkSession, folder: str) -> DataFrame:
    """Every task's result in the order of submission: statements are the tasks, their first attempts the results; and whether ids are unique."""
    tasks = statements(spark, folder).select("rec_id", F.col("id").alias("task"))
    results = first_of(attempts(spark, folder).where("statement_id IS NOT NULL"), ["statement_id"], [F.col("attempt_id")]).select(F.col("statement_id").alias("task"), F.col("attempt_id").alias("result"))
    many = tasks.groupBy("task").agg(F.count("*").alias("m"))
    return tasks.join(many, "task").join(results, "task").select("rec_id", "result", (F.col("m") == 1).alias("is_unique"))


def reports_of_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Each worker's reports (one a day) beside the scheduler's attempts (one a run of errors, or one if there is none): if there are as many of both, they
    belong together in order, and the last one ends when the worker's last event came; else the reports keep their own times."""
    day = F.floor(F.col("us") / 86_400_000_000)
    e = events(spark, folder)
    r = e.groupBy("worker", day.alias("day")).agg(F.min("us").alias("start"), F.max("us").alias("stop"))
    w = Window.partitionBy("worker").orderBy("day")
    r = r.select("*", F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy("worker")).alias("n"))
    j = e.where("event_type = 'signup'").groupBy("worker", day.alias("day")).agg(F.min("us").alias("outer_start"), F.max("us").alias("outer_stop"))
    j = j.select("worker", F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy("worker")).alias("m"), "outer_start", "outer_stop")
    both = r.join(j, ["worker", "k"], "left")
    same, last = F.coalesce(F.col("n") == F.col("m"), F.lit(False)), F.col("k") == F.col("n")
    stop = F.when(same & last, F.max("stop").over(Window.partitionBy("worker"))).when(same, F.col("outer_stop")).otherwise(F.col("stop"))
    return both.select("worker", F.col("k").cast("long").alias("k"), F.when(same, F.col("outer_start")).otherwise(F.col("start")).alias("start"), stop.alias("stop"))


def per_source(spark: SparkSession, folder: str) -> DataFrame:
    """How many conjectures each statement is asked for: by its source, else 2."""
    p = spark.createDataFrame([("d3k", 4), ("selfplay", 1), ("textbook_alg", 3)], "source string, asked int")
    return statements(spark, folder, "source").join(F.broadcast(p), "source", "left").select("rec_id", F.coalesce("asked", F.lit(2)).alias("asked"))


def two_hops(spark: SparkSession, folder: str) -> DataFrame:
    """Generations with their verdicts and the statement they were made for; attempts without a reply are left out."""
    v = replies(spark, folder).select("attempt_id", F.coalesce("pass", F.lit(False)).alias("pass"))
    a = attempts(spark, folder).select("attempt_id", "statement_id").join(v, "attempt_id")
    return a.join(statements(spark, folder).withColumnRenamed("id", "statement_id"), "statement_id").select("attempt_id", "rec_id", "pass")


def queue_is_done(spark: SparkSession, folder: str) -> DataFrame:
    """After each event of the kinds that count, in buckets of an hour: how many tasks are handed out and not done, the most of that so far, and the tenths
    of all tasks that are done. The queue is done where none are left and nothing came for 10 seconds."""
    e = events(spark, folder).where("task IS NOT NULL")
    first = e.groupBy("task").agg(F.min(F.when(F.col("event_type") == "view", F.col("us"))).alias("given"), F.min(F.when(F.col("event_type") == "purchase", F.col("us"))).alias("done"))
    steps = first.select(F.inline(F.array(F.struct(F.when(F.col("given") < F.coalesce("done", F.lit(2**62)), F.col("given")).alias("us"), F.lit(1).alias("d"), F.lit(0).alias("f")), F.struct(F.col("done").alias("us"), F.when(F.col("given") < F.col("done"), -1).otherwise(0).alias("d"), F.lit(1).alias("f")))))
    hours = steps.where("us IS NOT NULL").groupBy(F.floor(F.col("us") / 3_600_000_000).alias("hour")).agg(F.sum("d").alias("d"), F.sum("f").alias("f"))
    w = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)  # a row an hour
    total = first.agg(F.count("*").alias("total"))
    out = hours.select("hour", F.sum("d").over(w).alias("open"), F.sum("f").over(w).alias("done")).withColumn("most", F.max("open").over(w))
    return out.crossJoin(F.broadcast(total)).select("hour", "open", "most", F.floor(F.col("done") * 10 / F.col("total")).alias("tenths"), ((F.col("open") == 0) & (F.col("done") == F.col("total"))).alias("is_done"))  # one row


def before_fence(spark: SparkSession, folder: str) -> DataFrame:
    a = attempts(spark, folder, "full_generation").where("full_generation IS NOT NULL")
    return a.select("attempt_id", F.length(X.before_fence(F.col("full_generation"))).cast("long").alias("chars"))


def memory_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Memory sizes as schedulers write them, from the statements' heartbeats, shared by 4 workers."""
    s = statements(spark, folder, "header").where("header IS NOT NULL")
    size = F.concat(F.regexp_extract("header", r"maxHeartbeats (\d+)000", 1), F.lit("G"))
    return s.select("rec_id", X.gigabytes(size, F.lit(4)).cast("long").alias("gb"))


def split_back(spark: SparkSession, folder: str) -> DataFrame:
    """Statements and conjectures laid one after another, and taken apart again by their offset: both kinds' numbers and ends."""
    s = statements(spark, folder).select(F.lit(0).alias("part"), F.col("rec_id").alias("id"))
    c = conjectures(spark, folder).select(F.lit(1).alias("part"), F.col("rec_id").alias("id"))
    sizes = s.unionByName(c).groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return sizes.withColumn("offset", F.sum("n").over(Window.orderBy("part")) - F.col("n"))  # two rows


def first_appearance(spark: SparkSession, folder: str) -> DataFrame:
    """Each worker's number by the time of its first event, the first one 0."""
    first = events(spark, folder).groupBy("worker").agg(F.min("us").alias("us"))
    return ordinals(first, "us", "worker", name="node").select("worker", "node")


def chunk_plan(spark: SparkSession, folder: str) -> DataFrame:
    """How many chunks each writer's attempts are verified in: by 50 a job for 8 jobs, or fewer ones of 4 if that would leave jobs idle; and each chunk's rows."""
    n = attempts(spark, folder, "source").groupBy("source").agg(F.count("*").alias("n"))
    few = F.lit(50 * 8) > F.col("n")
    chunks = F.when(few, F.least(F.greatest(F.lit(1), F.floor(F.col("n") / 4)), F.lit(8))).otherwise(F.floor(F.col("n") / 50)).cast("long")
    return n.select("source", "n", chunks.alias("chunks"), F.ceil(F.col("n") / chunks).alias("largest"))


def index_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """A hash of the set of each group's sample numbers, kept beside the training run, and one of its id as a number below 2^60."""
    t = samples(spark, folder, "group_id").where("group_id IS NOT NULL")
    one = F.conv(F.substring(F.md5(F.col("sample_id").cast("string")), 1, 8), 16, 10).cast("long")
    ids = t.groupBy("group_id").agg(F.sum(one).alias("ids_hash"))
    high = F.conv(F.substring(F.sha1("group_id"), 1, 15), 16, 10).cast("long")
    return ids.select("group_id", "ids_hash", high.alias("number"))


def review_cost(spark: SparkSession, folder: str) -> DataFrame:
    """What judging each iteration costs (a thousandth a character of the judge's text), up to then, and whether that is over the budget of 100."""
    a = attempts(spark, folder, "review_cot", "iteration_created").where("iteration_created IS NOT NULL")
    by = a.groupBy(F.col("iteration_created").alias("iteration")).agg((F.coalesce(F.sum(F.length("review_cot")), F.lit(0)) / 1000).alias("cost"))
    so_far = F.sum("cost").over(Window.orderBy("iteration"))  # a row an iteration
    return by.select("iteration", F.round("cost", 3).alias("cost"), F.round(so_far, 3).alias("so_far"), (so_far > 100).alias("over"))


def prompts_with_extras(spark: SparkSession, folder: str) -> DataFrame:
    """Header, theorem and trailing text in one prompt; what is missing is nothing."""
    s = statements(spark, folder, "header", "theorem", "tag")
    extra = F.when(F.col("tag") == "conjecture", F.lit("\n-- conjectured"))
    return s.select("rec_id", F.md5(F.concat(*[F.coalesce(c, F.lit("")) for c in ("header", "theorem")], F.coalesce(extra, F.lit("")))).alias("prompt_md5"))


def conjectures_as_statements(spark: SparkSession, folder: str) -> DataFrame:
    """Conjectures as rows of statements, with an id of 8 characters that their number gives."""
    c = conjectures(spark, folder, "conjecture", "header").where("conjecture IS NOT NULL")
    return c.select("rec_id", F.substring(F.sha2(F.col("rec_id").cast("string"), 256), 1, 8).alias("id"), F.md5("conjecture").alias("theorem_md5"), F.lit("conjecture").alias("tag"))


def few_shot_headers(spark: SparkSession, folder: str) -> DataFrame:
    """The header of each test statement's prompt: its 3 examples, or all of a smaller pool, set apart by blank lines."""
    s = statements(spark, folder, "theorem").select(F.col("id").alias("example"), "theorem")
    picked = few_shot_pick(spark, folder).join(s, "example")
    shots = picked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "theorem"))).alias("x"))  # three a statement
    return shots.select("id", F.md5(F.array_join(F.col("x.theorem"), "\n\n")).alias("header_md5"))


def reply_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The replies cut to the keys that are kept, whatever else they have: how many of them are left in each."""
    v = attempts(spark, folder, "verification_dict").where("verification_dict IS NOT NULL").select("attempt_id", F.from_json("verification_dict", "map<string,string>").alias("m"))
    kept = F.map_filter("m", lambda k, _: k.isin("pass", "complete", "system_errors"))
    return v.select("attempt_id", F.size(kept).cast("long").alias("n_kept"))


def two_phases(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts saved before verification, without verdicts, then once more with them: what the second save has, against the first."""
    first, second = new_table(spark, "unverified"), new_table(spark, "verified")
    a = attempts(spark, folder).where("statement_id IS NOT NULL").select("attempt_id", "statement_id", "ok")
    a.withColumn("ok", F.lit(None).cast("boolean")).write.parquet(first)
    saved = spark.read.schema("attempt_id bigint, statement_id string, ok boolean").parquet(first)
    saved.drop("ok").join(a.select("attempt_id", "ok"), "attempt_id").write.parquet(second)
    after = spark.read.schema("attempt_id bigint, statement_id string, ok boolean").parquet(second)
    return saved.select(F.lit("first").alias("save"), "ok").unionByName(after.select(F.lit("second").alias("save"), "ok")).groupBy("save").agg(F.count("*").alias("n"), F.count("ok").alias("with_verdict"), F.count_if("ok").alias("correct"))


def code_variants(spark: SparkSession, folder: str) -> DataFrame:
    """The different correct proofs of each statement, each once, and the one that a seeded draw picks."""
    a = attempts(spark, folder, "proof_str").where("ok AND statement_id IS NOT NULL AND proof_str IS NOT NULL").groupBy("statement_id", "proof_str").agg(F.min("attempt_id").alias("attempt_id"))
    n = a.groupBy("statement_id").agg(F.count("*").alias("n_variants"), F.min_by("attempt_id", F.struct(hash_order(F.col("attempt_id"), 23), "attempt_id")).alias("picked"))
    return n


def report_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Of each worker's days the mean rates of its events: by the time they took and by the whole time around them, and the waits at both ends in seconds. The
    whole time is the hours that the day's first and last event fall in; where no time passes, the rate is the number of events."""
    hour = 3_600_000_000
    e = events(spark, folder).groupBy("worker", F.floor(F.col("us") / 86_400_000_000).alias("day"))
    r = e.agg(F.min("us").alias("a"), F.max("us").alias("b"), F.count("*").alias("n"))
    outer_a, outer_b = F.floor(F.col("a") / hour) * hour, (F.floor(F.col("b") / hour) + 1) * hour
    rate = lambda a, b: F.when(b > a, F.col("n") / ((b - a) / 1e6)).otherwise(F.col("n"))
    means = {"rate": rate(F.col("a"), F.col("b")), "outer_rate": rate(outer_a, outer_b), "wait_before": (F.col("a") - outer_a) / 1e6, "wait_after": (outer_b - F.col("b")) / 1e6}
    return r.groupBy("worker").agg(*[F.round(F.avg(c), 6).alias(name) for name, c in means.items()])


def group_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of 64 samples in the order of their ids: how many groups each has, how many of these aren't of 8, and whether the batch could hold whole ones."""
    t = samples(spark, folder, "group_id").groupBy(F.floor(F.col("sample_id") / 64).alias("step"), "group_id").agg(F.count("*").alias("n"))
    return t.groupBy("step").agg(F.count("*").alias("n_groups"), F.count_if(F.col("n") != 8).alias("n_uneven"), (F.sum("n") % 8 == 0).alias("fits"))


def grouped_loss(spark: SparkSession, folder: str) -> DataFrame:
    """By batch of 64 samples: the sum of (log probabilities times the advantage) over the tokens of each group, divided by them, over the groups."""
    t = samples(spark, folder, "group_id", "log_prob_over_gen", "advantage").where("log_prob_over_gen IS NOT NULL AND advantage IS NOT NULL AND NOT isnan(advantage)")
    s = t.select(F.floor(F.col("sample_id") / 64).alias("step"), "group_id", (F.aggregate("log_prob_over_gen", F.lit(0.0), lambda a, x: a + x) * F.col("advantage")).alias("l"), F.size("log_prob_over_gen").alias("n"))
    g = s.groupBy("step", "group_id").agg((F.sum("l") / F.greatest(F.sum("n"), F.lit(1))).alias("l"))
    return g.groupBy("step").agg((F.round(-F.avg("l"), 5) + 0.0).alias("loss"))


def retried_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Statements as chunks that are tried again while their attempt is a system error, three times at most: the tries that each took, and the last result."""
    r = attempts(spark, folder, "attempt_idx", "verification_dict").where("statement_id IS NOT NULL AND attempt_idx IS NOT NULL")
    bad = F.get_json_object("verification_dict", "$.system_errors").isNotNull()
    w = Window.partitionBy("statement_id").orderBy("attempt_idx", "attempt_id")
    r = r.select("statement_id", "attempt_id", bad.alias("bad"), F.row_number().over(w).alias("k")).where("k <= 4")
    by = r.groupBy("statement_id").agg(F.coalesce(F.min(F.when(~F.col("bad"), F.col("k"))), F.max("k")).alias("k"))
    return r.join(by, ["statement_id", "k"]).select("statement_id", F.col("k").cast("long").alias("tries"), F.col("attempt_id").alias("result"), "bad")


QUERIES = {f.__name__: f for f in (iteration_records, next_iteration, metrics_table, merged_metrics, time_histogram, mean_chars, token_entropy, mean_entropy, compiler_verdicts, system_error_texts, split_write, prefix_rates, ordered_results, reports_of_jobs, per_source, two_hops, queue_is_done, before_fence, memory_shares, split_back, first_appearance, chunk_plan, index_hashes, review_cost, prompts_with_extras, conjectures_as_statements, few_shot_headers, reply_keys, two_phases, code_variants, report_rates, group_checks, grouped_loss, retried_chunks)}
E_ = "WITH e AS (SELECT event_id, user_id AS worker, (props::JSON ->> '$.k')::BIGINT AS task, epoch_us(ts) AS us, event_type FROM events)"
FEW_SHOT = RESHAPE["few_shot_pick"]
BY = f"""WITH {S}, {A}, {C}, i AS (SELECT iteration_created AS iteration, count(*) AS n_attempts, count(*) FILTER (ok) AS n_correct, count(DISTINCT statement_id) AS n_statements,
    sum(coalesce(len(full_generation_tokens), 0))::BIGINT AS n_tokens FROM a WHERE iteration_created IS NOT NULL GROUP BY 1)"""
ENTROPY = """p AS (SELECT attempt_id, source, (k - 1) // 10 AS tok, exp(v) AS p FROM (SELECT attempt_id, source, unnest(full_generation_logprobs) AS v, generate_subscripts(full_generation_logprobs, 1) AS k FROM a WHERE full_generation_logprobs IS NOT NULL)),
    q AS (SELECT *, p / sum(p) OVER (PARTITION BY attempt_id, tok) AS r FROM p), t AS (SELECT attempt_id, tok, -sum(r * ln(r + 1e-10)) AS h FROM q GROUP BY ALL),
    h AS (SELECT attempt_id, avg(h) AS h FROM t GROUP BY 1),
    x AS (SELECT a.attempt_id, a.source, CASE WHEN full_generation_logprobs IS NOT NULL THEN coalesce(h, -1) END AS h FROM a LEFT JOIN h USING (attempt_id))"""
SQL = {
    "iteration_records": f"""{BY}, k AS (SELECT iteration, count(*) AS n_conjectures FROM c WHERE iteration IS NOT NULL GROUP BY 1),
        b AS (SELECT iteration, coalesce(n_attempts, 0) AS n_attempts, coalesce(n_correct, 0) AS n_correct, coalesce(n_statements, 0) AS n_statements, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_conjectures, 0) AS n_conjectures FROM i FULL JOIN k USING (iteration))
        SELECT *, sum(n_attempts + n_conjectures) OVER (ORDER BY iteration)::BIGINT AS so_far FROM b""",
    "next_iteration": f"""WITH {A}, {C} SELECT x AS of_attempts, y AS of_conjectures, x IS NOT DISTINCT FROM y AS agree, coalesce(greatest(x, y), -1) + 1 AS next
        FROM (SELECT (SELECT max(iteration_created) FROM a) AS x, (SELECT max(iteration) FROM c) AS y)""",
    "metrics_table": f"{BY} SELECT key, value, iteration FROM (UNPIVOT i ON {', '.join(METRICS)} INTO NAME key VALUE value)",
    "merged_metrics": f"{BY} SELECT iteration, key, value FROM (UNPIVOT i ON {', '.join(METRICS)} INTO NAME key VALUE value) UNION ALL SELECT iteration, 'n_rewarded', -1 FROM i",
    "time_histogram": f"""{V}, x AS (SELECT verify_time AS t FROM v WHERE verify_time >= 0 AND isfinite(verify_time)),
        m AS (SELECT greatest(max(t), {TIMEOUT}) AS high, least(60, greatest(10, floor(sqrt(count(*))))) AS bins FROM x)
        SELECT least(floor(t / (high / bins)), bins - 1)::BIGINT AS bin, bins::BIGINT AS bins, count(*) AS n FROM x, m GROUP BY ALL""",
    "mean_chars": f"""WITH {A}, {C}, x AS (SELECT 'proof' AS kind, length(proof_str) AS n FROM a UNION ALL SELECT 'conjecture', length(conjecture) FROM c)
        SELECT kind, round(coalesce(sum(n), 0) / greatest(count(n), 1), 6) AS mean_chars FROM x GROUP BY kind""",
    "token_entropy": f"WITH {A}, {ENTROPY} SELECT attempt_id, round(h, 5) AS entropy FROM x WHERE h IS NOT NULL",
    "mean_entropy": f"WITH {A}, {ENTROPY} SELECT source, round(coalesce(avg(h), -1), 5) AS mean_entropy FROM x GROUP BY source",
    "compiler_verdicts": f"""WITH {A}, v AS (SELECT attempt_id, coalesce(contains(proof_str, 'sorry'), false) AS hole, attempt_id % 5 = 0 AS warn,
            coalesce(from_json(verification_dict::JSON -> '$.errors', '[{{"severity":"VARCHAR","data":"VARCHAR","line":"INTEGER"}}]'), []) AS m FROM a WHERE verification_dict IS NOT NULL),
        n AS (SELECT *, CASE WHEN warn THEN 0 ELSE len(list_filter(m, lambda x: x.severity = 'error')) END AS e FROM v)
        SELECT attempt_id, e = 0 AS pass, e = 0 AND NOT hole AND NOT (warn AND len(list_filter(m, lambda x: contains(x.data, 'declaration uses ''sorry''') OR contains(x.data, 'failed'))) > 0) AS complete, e AS n_errors,
            CASE WHEN warn THEN len(m) ELSE len(list_filter(m, lambda x: x.severity = 'warning')) END AS n_warnings, CASE WHEN warn THEN 0 ELSE len(list_filter(m, lambda x: x.severity = 'info')) END AS n_infos FROM n""",
    "system_error_texts": f"{V} SELECT source, system_errors AS message, count(*) AS n FROM v WHERE system_errors IS NOT NULL GROUP BY ALL",
    "split_write": f"WITH {A} SELECT statement_id, bool_or(ok) AS success, count(*) AS n FROM a WHERE statement_id IS NOT NULL GROUP BY 1 HAVING count(*) >= {ASKED}",
    "prefix_rates": f"""WITH {S}, {A}, x AS (SELECT source, EXISTS (SELECT 1 FROM a WHERE ok AND statement_id = s.id) AS ok FROM s),
        k AS (SELECT unnest(['<all>', 'contest', 'olymp', 'synth', 'text']) AS kind)
        SELECT kind, printf('%3d / %3d = %.3f', count(*) FILTER (ok), count(*), count(*) FILTER (ok) / count(*)) AS shown FROM x, k WHERE kind = '<all>' OR starts_with(source, kind) GROUP BY kind""",
    "ordered_results": f"""WITH {S}, {A} SELECT rec_id, (SELECT min(attempt_id) FROM a WHERE statement_id = s.id) AS result, count(*) OVER (PARTITION BY id) = 1 AS is_unique FROM s
        QUALIFY (SELECT min(attempt_id) FROM a WHERE statement_id = s.id) IS NOT NULL""",
    "reports_of_jobs": f"""{E_}, r AS (SELECT worker, us // 86400000000 AS day, min(us) AS start, max(us) AS stop FROM e GROUP BY ALL),
        r2 AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY day) AS k, count(*) OVER (PARTITION BY worker) AS n, max(stop) OVER (PARTITION BY worker) AS final FROM r),
        j AS (SELECT worker, us // 86400000000 AS day, min(us) AS a, max(us) AS b FROM e WHERE event_type = 'signup' GROUP BY ALL),
        j2 AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY day) AS k, count(*) OVER (PARTITION BY worker) AS m FROM j)
        SELECT r2.worker, r2.k, CASE WHEN n = m THEN a ELSE start END AS start, CASE WHEN n = m AND r2.k = n THEN final WHEN n = m THEN b ELSE stop END AS stop FROM r2 LEFT JOIN j2 ON r2.worker = j2.worker AND r2.k = j2.k""",
    "per_source": f"WITH {S} SELECT rec_id, CASE source WHEN 'd3k' THEN 4 WHEN 'selfplay' THEN 1 WHEN 'textbook_alg' THEN 3 ELSE 2 END AS asked FROM s",
    "two_hops": f"{V}, {S} SELECT v.attempt_id, s.rec_id, coalesce(v.pass, false) AS pass FROM v JOIN a USING (attempt_id) JOIN s ON a.statement_id = s.id",
    "queue_is_done": f"""{E_}, f AS (SELECT task, min(us) FILTER (event_type = 'view') AS g, min(us) FILTER (event_type = 'purchase') AS d FROM e WHERE task IS NOT NULL GROUP BY 1),
        s AS (SELECT g AS us, 1 AS d, 0 AS f FROM f WHERE g < coalesce(d, 4611686018427387904) UNION ALL SELECT d, CASE WHEN g < d THEN -1 ELSE 0 END, 1 FROM f WHERE d IS NOT NULL),
        h AS (SELECT us // 3600000000 AS hour, sum(d) AS d, sum(f) AS f FROM s GROUP BY 1),
        o AS (SELECT hour, sum(d) OVER (ORDER BY hour)::BIGINT AS open, sum(f) OVER (ORDER BY hour)::BIGINT AS done FROM h)
        SELECT hour, open, max(open) OVER (ORDER BY hour) AS most, floor(done * 10 / t)::BIGINT AS tenths, open = 0 AND done = t AS is_done FROM o, (SELECT count(*) AS t FROM f)""",
    "before_fence": f"WITH {A} SELECT attempt_id, length(split_part(full_generation, '```', 1)) AS chars FROM a WHERE full_generation IS NOT NULL",
    "memory_shares": f"""WITH {S}, x AS (SELECT rec_id, try_cast(nullif(regexp_extract(header, 'maxHeartbeats (\\d+)000', 1), '') AS BIGINT) AS g FROM s WHERE header IS NOT NULL)
        SELECT rec_id, CASE WHEN g IS NOT NULL THEN greatest(g // 4, 1) END AS gb FROM x""",
    "split_back": f"""WITH {S}, {C}, x AS (SELECT 0 AS part, count(*) AS n, min(rec_id) AS first_id, max(rec_id) AS last_id FROM s UNION ALL SELECT 1, count(*), min(rec_id), max(rec_id) FROM c)
        SELECT *, (sum(n) OVER (ORDER BY part) - n)::BIGINT AS offset FROM x""".replace("AS offset", 'AS "offset"'),
    "first_appearance": f"{E_} SELECT worker, row_number() OVER (ORDER BY min(us), worker) - 1 AS node FROM e GROUP BY worker",
    "chunk_plan": f"""WITH {A}, n AS (SELECT source, count(*) AS n FROM a GROUP BY 1), p AS (SELECT source, n, CASE WHEN 400 > n THEN least(greatest(1, n // 4), 8) ELSE n // 50 END AS chunks FROM n)
        SELECT source, n, chunks, ceil(n / chunks)::BIGINT AS largest FROM p""",
    "index_hashes": f"""WITH {T} SELECT group_id, sum(('0x' || substr(md5(sample_id::VARCHAR), 1, 8))::BIGINT)::BIGINT AS ids_hash, ('0x' || substr(sha1(group_id), 1, 15))::BIGINT AS number
        FROM t WHERE group_id IS NOT NULL GROUP BY 1""",
    "review_cost": f"""WITH {A}, b AS (SELECT iteration_created AS iteration, coalesce(sum(length(review_cot)), 0) / 1000 AS cost FROM a WHERE iteration_created IS NOT NULL GROUP BY 1), c AS (SELECT iteration, cost, sum(cost) OVER (ORDER BY iteration) AS f FROM b)
        SELECT iteration, round(cost, 3) AS cost, round(f, 3) AS so_far, f > 100 AS over FROM c""".replace("AS over", 'AS "over"'),
    "prompts_with_extras": f"WITH {S} SELECT rec_id, md5(coalesce(header, '') || coalesce(theorem, '') || CASE WHEN tag = 'conjecture' THEN chr(10) || '-- conjectured' ELSE '' END) AS prompt_md5 FROM s",
    "conjectures_as_statements": f"WITH {C} SELECT rec_id, substr(sha256(rec_id::VARCHAR), 1, 8) AS id, md5(conjecture) AS theorem_md5, 'conjecture' AS tag FROM c WHERE conjecture IS NOT NULL",
    "few_shot_headers": FEW_SHOT.replace("SELECT id, rank::INT AS rank, example FROM f WHERE rank <= 3", "SELECT f.id, md5(string_agg(s.theorem, chr(10) || chr(10) ORDER BY rank)) AS header_md5 FROM f JOIN s ON s.id = example WHERE rank <= 3 GROUP BY f.id"),
    "reply_keys": f"WITH {A} SELECT attempt_id, len(list_filter(json_keys(verification_dict::JSON), lambda k: k IN ('pass', 'complete', 'system_errors'))) AS n_kept FROM a WHERE verification_dict IS NOT NULL",
    "two_phases": f"""WITH {A} SELECT 'first' AS save, count(*) AS n, 0::BIGINT AS with_verdict, 0::BIGINT AS correct FROM a WHERE statement_id IS NOT NULL
        UNION ALL SELECT 'second', count(*), count(*), count(*) FILTER (ok) FROM a WHERE statement_id IS NOT NULL""",
    "code_variants": f"""WITH {A}, v AS (SELECT statement_id, min(attempt_id) AS attempt_id FROM a WHERE ok AND statement_id IS NOT NULL AND proof_str IS NOT NULL GROUP BY statement_id, proof_str)
        SELECT statement_id, count(*) AS n_variants, arg_min(attempt_id, md5('23/' || attempt_id)) AS picked FROM v GROUP BY 1""",
    "report_rates": f"""{E_}, r AS (SELECT worker, us // 86400000000 AS day, min(us) AS a, max(us) AS b, count(*) AS n FROM e GROUP BY ALL),
        o AS (SELECT *, a // 3600000000 * 3600000000 AS oa, (b // 3600000000 + 1) * 3600000000 AS ob FROM r)
        SELECT worker, round(avg(CASE WHEN b > a THEN n / ((b - a) / 1e6) ELSE n END), 6) AS rate, round(avg(n / ((ob - oa) / 1e6)), 6) AS outer_rate, round(avg((a - oa) / 1e6), 6) AS wait_before, round(avg((ob - b) / 1e6), 6) AS wait_after FROM o GROUP BY worker""",
    "group_checks": f"""WITH {T}, g AS (SELECT sample_id // 64 AS step, group_id, count(*) AS n FROM t GROUP BY ALL)
        SELECT step, count(*) AS n_groups, count(*) FILTER (n <> 8) AS n_uneven, sum(n) % 8 = 0 AS fits FROM g GROUP BY step""",
    "grouped_loss": f"""WITH {T}, g AS (SELECT sample_id // 64 AS step, group_id, sum(coalesce(list_sum(log_prob_over_gen), 0) * advantage) / greatest(sum(len(log_prob_over_gen)), 1) AS l FROM t
            WHERE log_prob_over_gen IS NOT NULL AND isfinite(advantage) GROUP BY ALL)
        SELECT step, round(-avg(l), 5) + 0.0 AS loss FROM g GROUP BY step""",
    "retried_chunks": f"""WITH {A}, r AS (SELECT statement_id, attempt_id, (verification_dict::JSON ->> '$.system_errors') IS NOT NULL AS bad, row_number() OVER (PARTITION BY statement_id ORDER BY attempt_idx, attempt_id) AS k
            FROM a WHERE statement_id IS NOT NULL AND attempt_idx IS NOT NULL QUALIFY k <= 4),
        b AS (SELECT statement_id, coalesce(min(k) FILTER (NOT bad), max(k)) AS k FROM r GROUP BY 1)
        SELECT statement_id, k AS tries, attempt_id AS result, bad FROM r JOIN b USING (statement_id, k)""",
}
