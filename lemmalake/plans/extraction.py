"""What is taken out of model outputs, and the texts that are put together for models and verifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lemmalake.functions import text as X
from lemmalake.functions.scores import rubric
from lemmalake.plans.base import A, C, S, T, attempts, conjectures, samples, statements
from lemmalake.sources.tables import table


def proofs_lenient(spark: SparkSession, folder: str) -> DataFrame:
    a = attempts(spark, folder, "full_generation").select("attempt_id", X.proof_lenient(F.col("full_generation")).alias("proof"))
    return a.select("attempt_id", F.length("proof").cast("long").alias("chars"), F.md5("proof").alias("proof_md5"))


def proofs_strict(spark: SparkSession, folder: str) -> DataFrame:
    a = attempts(spark, folder, "full_generation").select("attempt_id", X.proof_strict(F.col("full_generation")).alias("proof"))
    return a.where("proof IS NOT NULL").select("attempt_id", F.md5("proof").alias("proof_md5"))


def conjectures_extracted(spark: SparkSession, folder: str) -> DataFrame:
    c = conjectures(spark, folder, "conjecture_full_generation").select("rec_id", X.conjecture(F.col("conjecture_full_generation")).alias("text"))
    return c.where("text IS NOT NULL").select("rec_id", F.md5("text").alias("text_md5"))


def malformed_conjectures(spark: SparkSession, folder: str) -> DataFrame:
    c = conjectures(spark, folder, "conjecture_full_generation", "iteration")
    return c.groupBy("iteration").agg(F.count("*").alias("n"), F.count_if(X.conjecture(F.col("conjecture_full_generation")).isNull()).alias("malformed"))


def extracted_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """What each extractor, by its name, gets out of the generations of attempts: how many, and their characters."""
    a = attempts(spark, folder, "full_generation")
    both = a.select(F.inline(F.array(*[F.struct(F.lit(name).alias("extractor"), f(F.col("full_generation")).alias("text")) for name, f in X.EXTRACTORS.items()])))
    return both.groupBy("extractor").agg(F.count("text").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


def without_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Proofs with comments put in after every tactic, and taken out again."""
    noisy = F.concat(F.lit("/- by\nhand -/"), F.regexp_replace("proof_str", "\n", " -- next\n"))
    return attempts(spark, folder, "proof_str").select("attempt_id", F.md5(X.without_comments(noisy)).alias("proof_md5"))


def token_flags(spark: SparkSession, folder: str) -> DataFrame:
    """What keeps a generation from a reward: a search tactic, a second fence, too many characters; comments don't count."""
    a = attempts(spark, folder, "proof_str", "full_generation").withColumn("bare", X.without_comments(F.col("proof_str")))
    return a.agg(
        F.count_if(F.contains("bare", F.lit("try"))).alias("with_try"),
        F.count_if(X.count_of(F.col("full_generation"), X.OPEN) > 1).alias("two_fences"),
        F.count_if(F.length("bare") > 1000).alias("long"),
        F.count_if("ok").alias("correct"),
        F.count("*").alias("n"),
    )


def header_split(spark: SparkSession, folder: str) -> DataFrame:
    """Every statement's file with its header twice, as one header without repeated lines, and what follows it."""
    twice = F.concat(F.coalesce("header", F.lit("")), F.coalesce("header", F.lit("")), F.coalesce("theorem", F.lit("")))
    header, body = X.header_and_body(twice)
    return statements(spark, folder, "header", "theorem").select("rec_id", header.alias("header"), F.md5(body).alias("body_md5"))


def solver_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The prompt of every statement, as a chat of a system and a user message."""
    body = X.strip(F.concat(F.lit("Complete the proof.\n\n```lean4\n"), F.coalesce("header", F.lit("")), F.coalesce("theorem", F.lit("")), F.lit("\n```\n")))
    chat = F.array(F.struct(F.lit("system").alias("role"), F.lit("You prove theorems.").alias("content")), F.struct(F.lit("user").alias("role"), body.alias("content")))
    s = statements(spark, folder, "header", "theorem").select("rec_id", F.inline(chat))
    return s.select("rec_id", "role", F.length("content").cast("long").alias("chars"), F.md5("content").alias("content_md5"))


def files_assembled(spark: SparkSession, folder: str) -> DataFrame:
    """Header, theorem and proof of every attempt; a theorem that, like its proof, never says `by` is given one."""
    s = statements(spark, folder, "header", "theorem").where("theorem IS NOT NULL").drop("rec_id")
    both = attempts(spark, folder, "proof_str").join(s, F.col("statement_id") == F.col("id"))
    bare = ~F.contains("theorem", F.lit("by")) & ~F.contains("proof_str", F.lit("by"))
    code = F.concat(F.coalesce("header", F.lit("")), F.when(bare, F.concat("theorem", F.lit(" by\n"))).otherwise(F.col("theorem")), "proof_str")
    return both.select("attempt_id", F.md5(code).alias("code_md5"), F.length(code).cast("long").alias("chars"))


def proof_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The proof cut out of the assembled file by the lengths of what stands before it is the proof again."""
    s = statements(spark, folder, "header", "theorem").where("theorem IS NOT NULL AND header IS NOT NULL").drop("rec_id")
    both = attempts(spark, folder, "proof_str").join(s, F.col("statement_id") == F.col("id"))
    body = F.substr(F.concat("header", "theorem", "proof_str"), F.length("header") + F.length("theorem") + 1)
    return both.agg(F.count("*").alias("n"), F.count_if(body == F.col("proof_str")).alias("equal"))


def judge_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Judges' answers, written from the attempts' reviews: some lack a score or have a word in its place."""
    a = attempts(spark, folder, "review", "review_cot", "attempt_idx").where("review IS NOT NULL")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    number = F.floor("review").cast("int").cast("string")
    complexity = F.when(F.col("attempt_id") % 7 == 0, F.lit("unclear")).otherwise(number)
    answer = F.concat(F.coalesce("review_cot", F.lit("")), tag("complexity", complexity), tag("relevance", F.col("review").cast("string")), F.when(F.col("attempt_id") % 5 == 0, F.lit("")).otherwise(tag("redundancy", F.lit(" 1\n"))))
    return a.select("attempt_id", "statement_id", answer.alias("answer"))


def judge_scores(spark: SparkSession, folder: str) -> DataFrame:
    c, r, d = (X.tagged_number(F.col("answer"), n) for n in ("complexity", "relevance", "redundancy"))
    return judge_texts(spark, folder).select("attempt_id", c.alias("complexity"), r.alias("relevance"), d.alias("redundancy"), rubric(c, r, d).alias("review"))


def judge_imputed(spark: SparkSession, folder: str) -> DataFrame:
    """Missing reviews get the mean of the others, 0 if there are none: one number, joined to the rows."""
    scored = judge_scores(spark, folder).select("attempt_id", "review")
    mean = scored.agg(F.coalesce(F.avg("review"), F.lit(0.0)).alias("mean"))
    return scored.crossJoin(F.broadcast(mean)).select("attempt_id", F.round(F.coalesce("review", "mean"), 6).alias("review"))  # one row


def judge_metrics(spark: SparkSession, folder: str) -> DataFrame:
    s = judge_scores(spark, folder)
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"mean_{c}")
    none = lambda c: F.count_if(F.col(c).isNull()).alias(f"no_{c}")
    return s.agg(*[f(c) for c in ("complexity", "relevance", "redundancy", "review") for f in (mean, none)])


def duration_parse(spark: SparkSession, folder: str) -> DataFrame:
    """The time between two deliveries of the same kind, written as D-HH:MM:SS and read again in minutes."""
    e = table(spark, folder, "events").select("event_id", (F.col("user_id") % 4).alias("d"), (F.col("event_id") % 24).alias("h"), (F.col("user_id") % 60).alias("m"))
    text = F.when(F.col("event_id") % 11 == 0, "").when(F.col("event_id") % 13 == 0, "later").when(F.col("d") == 0, F.format_string("%02d:%02d", "h", "m")).otherwise(F.format_string("%d-%02d:%02d:59", "d", "h", "m"))
    return e.select("event_id", X.minutes(text).cast("long").alias("minutes"))


def cpu_lists(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_id", (F.col("user_id") % 8).alias("a"), (F.col("event_id") % 5).alias("n"))
    text = F.format_string("%d-%d,%d, 99", "a", F.col("a") + F.col("n"), F.col("a") + 20)
    return e.select("event_id", X.cpu_count(text).cast("long").alias("cpus"))


def byte_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Line, column and character of the byte after the first third of each statement's characters."""
    s = statements(spark, folder, "theorem").where("theorem IS NOT NULL")
    byte = F.octet_length(F.left("theorem", F.floor(F.length("theorem") / 3).cast("int")))
    line, column, char = X.at_byte(F.col("theorem"), byte)
    return s.select("rec_id", line.cast("long").alias("line"), column.cast("long").alias("column"), char.cast("long").alias("char"))


def sample_table(spark: SparkSession, folder: str) -> DataFrame:
    """The first 20 prompts and outputs, as they would be shown."""
    t = samples(spark, folder, "prompt_str", "gen_str").orderBy("sample_id").limit(20)
    return t.select("sample_id", F.left("prompt_str", F.lit(80)).alias("prompt"), F.left("gen_str", F.lit(80)).alias("output"))


def last_output_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Of each source the latest attempt; equal times are told apart by the id."""
    a = attempts(spark, folder, "source", "created_at")
    w = Window.partitionBy("source").orderBy(F.col("created_at").desc(), F.col("attempt_id").desc())
    return a.withColumn("k", F.row_number().over(w)).where("k = 1").select("source", "attempt_id")


QUERIES = {f.__name__: f for f in (proofs_lenient, proofs_strict, conjectures_extracted, malformed_conjectures, extracted_by_name, without_comments, token_flags, header_split, solver_prompts, files_assembled, proof_bodies, judge_scores, judge_imputed, judge_metrics, duration_parse, cpu_lists, byte_offsets, sample_table, last_output_by_source)}
COUNT = "((length({x}) - length(replace({x}, '{w}', ''))) // {n})"
count = lambda x, w: COUNT.format(x=x, w=w, n=len(w))
BARE = r"regexp_replace(regexp_replace(proof_str, '/-[\s\S]*?-/', '', 'g'), '--.*', '', 'g')"
BLANK = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
strip = lambda x: f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"
LENIENT = """p AS (SELECT *, CASE WHEN contains(g, '```lean4') THEN split_part(g, '```lean4', -1) END AS code FROM g),
    q AS (SELECT *, CASE WHEN contains(code, ':= by') THEN substr(code, strpos(code, ':= by') + 5) END AS body FROM p),
    l AS (SELECT *, CASE WHEN contains(body, '```') THEN substr(body, 1, length(body) - length(split_part(body, '```', -1)) - 3) ELSE body END AS proof FROM q)"""
JUDGE = f"""WITH {A}, j AS (SELECT attempt_id, CASE WHEN attempt_id % 7 = 0 THEN NULL ELSE floor(review) END AS complexity, review AS relevance,
    CASE WHEN attempt_id % 5 = 0 THEN NULL ELSE 1.0::DOUBLE END AS redundancy FROM a WHERE review IS NOT NULL),
    v AS (SELECT *, CASE WHEN complexity IS NULL OR redundancy IS NULL THEN NULL WHEN complexity IN (3, 4) THEN 0.0::DOUBLE
        ELSE greatest(0.0, relevance + (2 - complexity) + (1 - redundancy)) END AS review FROM j)"""
SQL = {
    "proofs_lenient": f"WITH {A}, g AS (SELECT attempt_id, full_generation AS g FROM a), {LENIENT} SELECT attempt_id, length(proof) AS chars, md5(proof) AS proof_md5 FROM l",
    "proofs_strict": f"""WITH {A}, g AS (SELECT attempt_id, {strip("full_generation")} AS g FROM a), {LENIENT}
        SELECT attempt_id, md5(proof) AS proof_md5 FROM l WHERE starts_with(g, '```lean4') AND ends_with(g, '```') AND {count("g", "```lean4")} = 1 AND {count("g", "```")} = 2
        AND {count("g", "theorem ")} + {count("g", "lemma ")} + {count("g", "def ")} = 1 AND proof IS NOT NULL""",
    "conjectures_extracted": f"""WITH {C}, p AS (SELECT rec_id, split_part(conjecture_full_generation, '```lean4', -1) AS x FROM c WHERE contains(conjecture_full_generation, '```lean4')),
        q AS (SELECT rec_id, substr(x, 1, length(x) - length(split_part(x, '```', -1)) - 3) AS x FROM p WHERE contains(x, '```')), z AS (SELECT *, {strip("x")} AS y FROM q)
        SELECT rec_id, md5({strip("split_part(x, ':= by', 1) || ':= by'")}) AS text_md5 FROM z
        WHERE {count("x", ":= by")} = 1 AND {count("x", "sorry")} <= 1 AND (ends_with(y, 'sorry') OR ends_with(y, ':= by'))""",
    "malformed_conjectures": f"""WITH {C}, p AS (SELECT iteration, CASE WHEN contains(conjecture_full_generation, '```lean4') THEN split_part(conjecture_full_generation, '```lean4', -1) END AS x FROM c),
        q AS (SELECT iteration, CASE WHEN contains(x, '```') THEN substr(x, 1, length(x) - length(split_part(x, '```', -1)) - 3) END AS x FROM p), z AS (SELECT *, {strip("x")} AS y FROM q)
        SELECT iteration, count(*) AS n, count(*) FILTER (NOT coalesce({count("x", ":= by")} = 1 AND {count("x", "sorry")} <= 1 AND (ends_with(y, 'sorry') OR ends_with(y, ':= by')), false)) AS malformed
        FROM z GROUP BY iteration""",
    "extracted_by_name": f"""WITH {A}, g AS (SELECT attempt_id, full_generation AS g, {strip("full_generation")} AS s FROM a), {LENIENT},
        z AS (SELECT CASE WHEN contains(code, '```') THEN substr(code, 1, length(code) - length(split_part(code, '```', -1)) - 3) END AS x FROM p), y AS (SELECT x, {strip("x")} AS y FROM z),
        t AS (SELECT 'lenient' AS extractor, proof AS text FROM l
            UNION ALL SELECT 'strict', CASE WHEN starts_with(s, '```lean4') AND ends_with(s, '```') AND {count("s", "```lean4")} = 1 AND {count("s", "```")} = 2 AND {count("s", "theorem ")} + {count("s", "lemma ")} + {count("s", "def ")} = 1 THEN proof END FROM l
            UNION ALL SELECT 'conjecture', CASE WHEN {count("x", ":= by")} = 1 AND {count("x", "sorry")} <= 1 AND (ends_with(y, 'sorry') OR ends_with(y, ':= by')) THEN {strip("split_part(x, ':= by', 1) || ':= by'")} END FROM y)
        SELECT extractor, count(text) AS n, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM t GROUP BY 1""",
    "without_comments": f"WITH {A} SELECT attempt_id, md5(replace(proof_str, chr(10), ' ' || chr(10))) AS proof_md5 FROM a",
    "token_flags": f"""WITH {A} SELECT count(*) FILTER (contains({BARE}, 'try')) AS with_try, count(*) FILTER ({count("full_generation", "```lean4")} > 1) AS two_fences,
        count(*) FILTER (length({BARE}) > 1000) AS long, count(*) FILTER (ok) AS correct, count(*) AS n FROM a""",
    "header_split": f"""WITH {S}, x AS (SELECT rec_id, string_split_regex(coalesce(header, '') || coalesce(header, '') || coalesce(theorem, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS l FROM s),
        y AS (SELECT rec_id, CASE WHEN l[-1] = '' THEN l[1:-2] ELSE l END AS l FROM x),
        n AS (SELECT rec_id, l, coalesce(list_position(list_transform(l, lambda v: regexp_matches({strip("v")}, '^((import|set_option|open) |$)')), false), len(l) + 1) - 1 AS n FROM y),
        h AS (SELECT rec_id, l, n, list_filter(list_transform(l[1:n], lambda v: {strip("v")}), lambda v: v <> '') AS h FROM n),
        o AS (SELECT rec_id, l, n, h, list_filter(h, lambda v: NOT starts_with(v, 'import Mathlib')) AS o FROM h)
        SELECT rec_id, array_to_string(list_concat(CASE WHEN len(o) < len(h) THEN ['import Mathlib'] ELSE []::VARCHAR[] END, list_filter(o, lambda v, k: list_position(o, v) = k)), chr(10)) || chr(10) || chr(10) AS header,
            md5(array_to_string(l[n + 1:], chr(10))) AS body_md5 FROM o""",
    "solver_prompts": f"""WITH {S}, b AS (SELECT rec_id, {strip("'Complete the proof.' || chr(10) || chr(10) || '```lean4' || chr(10) || coalesce(header, '') || coalesce(theorem, '') || chr(10) || '```' || chr(10)")} AS x FROM s)
        SELECT rec_id, 'user' AS role, length(x) AS chars, md5(x) AS content_md5 FROM b UNION ALL SELECT rec_id, 'system', 19, md5('You prove theorems.') FROM b""",
    "files_assembled": f"""WITH {S}, {A}, f AS (SELECT attempt_id, coalesce(header, '') || CASE WHEN contains(theorem, 'by') OR contains(proof_str, 'by') THEN theorem ELSE theorem || ' by' || chr(10) END || proof_str AS x
        FROM a JOIN s ON statement_id = s.id WHERE theorem IS NOT NULL) SELECT attempt_id, md5(x) AS code_md5, length(x) AS chars FROM f""",
    "proof_bodies": f"""WITH {S}, {A}, f AS (SELECT proof_str, substr(header || theorem || proof_str, length(header) + length(theorem) + 1) AS b FROM a JOIN s ON statement_id = s.id WHERE theorem IS NOT NULL AND header IS NOT NULL)
        SELECT count(*) AS n, count(*) FILTER (b = proof_str) AS equal FROM f""",
    "judge_scores": f"{JUDGE} SELECT * FROM v".replace("SELECT * FROM v", "SELECT attempt_id, complexity, relevance, redundancy, review FROM v"),
    "judge_imputed": f"{JUDGE} SELECT attempt_id, round(coalesce(review, (SELECT coalesce(avg(review), 0) FROM v)), 6) AS review FROM v",
    "judge_metrics": f"{JUDGE} SELECT " + ", ".join(f"round(coalesce(avg({c}), 0), 6) AS mean_{c}, count(*) FILTER ({c} IS NULL) AS no_{c}" for c in ("complexity", "relevance", "redundancy", "review")) + " FROM v",
    "duration_parse": """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_id % 13 = 0 THEN NULL ELSE (user_id % 4) * 1440 + (event_id % 24) * 60 + user_id % 60 END AS minutes FROM events""",
    "cpu_lists": "SELECT event_id, event_id % 5 + 3 AS cpus FROM events",
    "byte_offsets": f"""WITH {S}, p AS (SELECT rec_id, left(theorem, length(theorem) // 3) AS x FROM s WHERE theorem IS NOT NULL)
        SELECT rec_id, {count("x", "~~").replace("'~~'", "chr(10)").replace("// 2", "// 1")} AS line, length(split_part(x, chr(10), -1)) AS column, length(x) AS char FROM p""",
    "sample_table": f"WITH {T} SELECT sample_id, left(prompt_str, 80) AS prompt, left(gen_str, 80) AS output FROM t ORDER BY sample_id LIMIT 20",
    "last_output_by_source": f"WITH {A} SELECT source, attempt_id FROM a QUALIFY row_number() OVER (PARTITION BY source ORDER BY created_at DESC, attempt_id DESC) = 1",
}
