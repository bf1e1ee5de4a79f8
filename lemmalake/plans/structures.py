"""Nested files, trees of proofs, providers and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lemmalake.functions.providers import call
from lemmalake.plans.base import A, C, S, attempts, conjectures, statements
from lemmalake.plans.verdicts import REPLY
from lemmalake.sources.files import STATEMENT, accounting, flat, nested, read, violations
from lemmalake.sources.tables import records, table
from lemmalake.storage import new_table
from lemmalake.streaming import tasks


def nested_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Statements with their attempts, written as nested JSON lines, read again and flattened: how many attempts each has, and correct ones."""
    s = statements(spark, folder, "header", "theorem", "tag", "source")
    a = records(spark, folder, "attempts", "statement_id", "proof_str", "is_correct", "iteration_created")
    path = new_table(spark, "nested") + ".jsonl"
    nested(s, a).write.json(path)
    again, proofs = flat(read(spark, path, STATEMENT))
    n = proofs.groupBy("statement_id").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("correct"), F.sum(F.length("proof_str")).alias("chars"))
    both = again.join(n, F.col("id") == F.col("statement_id"), "left")
    return both.select("id", F.md5("theorem").alias("theorem_md5"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("correct", F.lit(0)).alias("correct"), F.coalesce("chars", F.lit(0)).alias("chars"))


def source_violations(spark: SparkSession, folder: str) -> DataFrame:
    return violations(statements(spark, folder, "theorem"))


def accounting_log(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of job 3 in a scheduler's log, which is written from the events: some ends are unknown, some starts missing."""
    e = table(spark, folder, "events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t"))
    start, end = F.when(F.col("event_id") % 5 == 0, "Unknown").otherwise(F.col("t")), F.when(F.col("event_id") % 3 == 0, "N/A").otherwise(F.col("t"))
    job = (F.col("user_id") % 10).cast("string")
    lines = e.select(F.concat_ws("|", F.when(F.col("event_id") % 7 == 0, F.concat(job, F.lit(".batch"))).otherwise(job), F.lit("DONE"), start, end).alias("line"))
    return accounting(lines, "line", "3").select("state", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


def proof_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Proofs up to their first error (by the verifier's line) or hole, cut into segments: each begins with a line that is indented by at most two
    blanks; how many, the longest in lines, and the deepest indent."""
    a = attempts(spark, folder, "proof_str", "verification_dict").where("proof_str IS NOT NULL")
    first = F.array_min(F.transform(F.filter(F.from_json("verification_dict", REPLY).getField("errors"), lambda e: e.severity == "error"), lambda e: e.line))
    lines = F.split("proof_str", "\n")
    hole = F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit("sorry"))), True)
    end = F.least(F.size(lines), F.when(first.isNotNull(), F.greatest(first - 1, F.lit(0))), F.when(hole > 0, hole - 1)).cast("int")
    lines = a.select("attempt_id", F.posexplode(F.slice(lines, F.lit(1), end)).alias("k", "line")).where("trim(line) <> ''")
    head = F.when(F.col("line").rlike(r"^ {0,2}[^ ]"), 1).otherwise(0)
    seg = lines.withColumn("seg", F.sum(head).over(Window.partitionBy("attempt_id").orderBy("k")))
    indent = F.max(F.length("line") - F.length(F.ltrim("line")))
    by = seg.groupBy("attempt_id", "seg").agg(F.count("*").alias("n"), indent.alias("indent"))
    return by.groupBy("attempt_id").agg(F.count("*").alias("segments"), F.max("n").alias("longest"), F.max("indent").cast("long").alias("indent"))


def proof_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The tree of each statement's proofs, where proofs share the nodes of their common first lines: its nodes and depth."""
    return nodes(spark, folder).groupBy("statement_id").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"))


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """(statement_id, depth, path, line, proofs): the nodes of the trees; path is a hash of the lines up to the node, carried on from line to
    line, and proofs how many attempts go through it."""
    a = attempts(spark, folder, "proof_str").where("statement_id IS NOT NULL")
    lines = a.select("statement_id", F.filter(F.split("proof_str", "\n"), lambda x: F.trim(x) != "").alias("l"))
    none = F.array().cast("array<bigint>")
    path = F.aggregate("l", none, lambda p, x: F.concat(p, F.array(F.xxhash64(F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0)), x))))
    rows = lines.select("statement_id", F.posexplode(F.arrays_zip(path.alias("path"), F.col("l").alias("line"))).alias("k", "p"))
    return rows.groupBy("statement_id", (F.col("k") + 1).alias("depth"), "p.path").agg(F.first("p.line").alias("line"), F.count("*").alias("proofs"))


def proof_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The trees as lists of nodes: each node's depth, its line, and the attempts that go through it."""
    return nodes(spark, folder).select("statement_id", "depth", F.md5("line").alias("line_md5"), "proofs")


def best_branch(spark: SparkSession, folder: str) -> DataFrame:
    """Of each statement the writer to try next: the highest mean of correct attempts plus sqrt(2 ln N / n); equal ones by name."""
    a = attempts(spark, folder, "source").where("statement_id IS NOT NULL AND source IS NOT NULL")
    by = a.groupBy("statement_id", "source").agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("v"))
    total = F.sum("n").over(Window.partitionBy("statement_id"))
    score = F.round(F.col("v") + F.sqrt(2 * F.log(F.greatest(total, F.lit(2)).cast("double")) / F.greatest("n", F.lit(0.01))), 6)
    placed = by.withColumn("score", score).withColumn("k", F.row_number().over(Window.partitionBy("statement_id").orderBy(F.col("score").desc(), "source")))
    return placed.where("k = 1").select("statement_id", "source", "score")


def json_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The keys of the verifier's replies, whatever they are: how many replies have each, read as variants."""
    v = attempts(spark, folder, "verification_dict").where("verification_dict IS NOT NULL").select(F.map_keys(F.from_json("verification_dict", "map<string,string>")).alias("k"))
    return v.select(F.explode("k").alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def provider_verify(spark: SparkSession, folder: str) -> DataFrame:
    """Every attempt through the stand-in verifier, against the verdict that it has."""
    a = attempts(spark, folder, "proof_str")
    v = call(a, "closes", "attempt_id", "proof_str")
    return a.join(v, "attempt_id").groupBy("ok", "verdict").agg(F.count("*").alias("n")).withColumnRenamed("ok", "correct")


def provider_generate(spark: SparkSession, folder: str) -> DataFrame:
    c = conjectures(spark, folder, "conjecture")
    return call(c, "echo", "rec_id", "conjecture").select("rec_id", "input_chars", "is_error")


def task_first_result_stream(spark: SparkSession, folder: str) -> DataFrame:
    return tasks.first_results(spark, folder)


def event_windows_stream(spark: SparkSession, folder: str) -> DataFrame:
    return tasks.windows(spark, folder)


def task_lives_stream(spark: SparkSession, folder: str) -> DataFrame:
    return tasks.lives(spark, folder)


def unseen_tasks_stream(spark: SparkSession, folder: str) -> DataFrame:
    return tasks.unseen(spark, folder)


def answered_tasks_stream(spark: SparkSession, folder: str) -> DataFrame:
    return tasks.answered(spark, folder)


def worker_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Each worker's sessions, which end when nothing comes for 6 hours: how many there are, and the most events of one."""
    e = table(spark, folder, "events").groupBy(F.col("user_id").alias("worker"), F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.groupBy("worker").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


QUERIES = {f.__name__: f for f in (nested_round_trip, source_violations, accounting_log, proof_segments, proof_tree, proof_nodes, best_branch, json_keys, provider_verify, provider_generate, task_first_result_stream, event_windows_stream, task_lives_stream, unseen_tasks_stream, answered_tasks_stream, worker_sessions)}
E_ = "WITH e AS (SELECT event_id, user_id AS worker, (props::JSON ->> '$.k')::BIGINT AS task, ts, event_type, value FROM events)"
SQL = {
    "nested_round_trip": f"""WITH {S}, {A} SELECT s.id, md5(s.theorem) AS theorem_md5, count(a.attempt_id) AS n, count(*) FILTER (a.ok) AS correct, coalesce(sum(length(a.proof_str)), 0)::BIGINT AS chars
        FROM s LEFT JOIN a ON a.statement_id = s.id GROUP BY s.rec_id, s.id, s.theorem""",
    "source_violations": f"""WITH {S}, n AS (SELECT *, count(*) OVER (PARTITION BY id) AS m FROM s)
        SELECT rec_id, 'repeated id' AS rule FROM n WHERE m > 1 UNION ALL SELECT rec_id, 'no theorem' FROM n WHERE theorem IS NULL
        UNION ALL SELECT rec_id, 'hole' FROM n WHERE contains(theorem, 'sorry')
        UNION ALL SELECT rec_id, 'no open end' FROM n WHERE NOT regexp_matches(theorem, ':= by[\\s\\x0b\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]*$')""",
    "accounting_log": """SELECT 'DONE' AS state, epoch_us(ts) // 1000000 AS start, CASE WHEN event_id % 3 = 0 THEN NULL ELSE epoch_us(ts) // 1000000 END AS stop
        FROM events WHERE user_id % 10 = 3 AND event_id % 7 <> 0 AND event_id % 5 <> 0""",
    "proof_segments": f"""WITH {A}, b AS (SELECT attempt_id, string_split(proof_str, chr(10)) AS l, list_min(list_transform(list_filter(
            from_json(verification_dict::JSON -> '$.errors', '[{{"severity":"VARCHAR","data":"VARCHAR","line":"INTEGER"}}]'), lambda e: e.severity = 'error'), lambda e: e.line)) AS first FROM a WHERE proof_str IS NOT NULL),
        c AS (SELECT attempt_id, l, least(len(l), greatest(coalesce(first, 1000000000) - 1, 0), coalesce(list_position(list_transform(l, lambda x: contains(x, 'sorry')), true), 1000000000) - 1) AS n FROM b),
        l AS (SELECT attempt_id, unnest(l[1:n]) AS line, generate_subscripts(l[1:n], 1) AS k FROM c),
        x AS (SELECT attempt_id, length(line) - length(ltrim(line, ' ')) AS d, sum(CASE WHEN regexp_matches(line, '^ {{0,2}}[^ ]') THEN 1 ELSE 0 END) OVER (PARTITION BY attempt_id ORDER BY k) AS seg FROM l WHERE trim(line, ' ') <> ''),
        y AS (SELECT attempt_id, seg, count(*) AS n, max(d) AS d FROM x GROUP BY ALL) SELECT attempt_id, count(*) AS segments, max(n) AS longest, max(d) AS indent FROM y GROUP BY 1""",
    "proof_tree": f"""WITH {A}, l AS (SELECT statement_id, list_filter(string_split(proof_str, chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM a WHERE statement_id IS NOT NULL),
        p AS (SELECT DISTINCT statement_id, k AS depth, array_to_string(l[1:k], chr(10)) AS path FROM l, range(1, (SELECT max(len(l)) FROM l) + 1) AS g(k) WHERE k <= len(l))
        SELECT statement_id, count(*) AS nodes, max(depth)::INT AS depth FROM p GROUP BY 1""",
    "proof_nodes": f"""WITH {A}, l AS (SELECT statement_id, list_filter(string_split(proof_str, chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM a WHERE statement_id IS NOT NULL),
        p AS (SELECT statement_id, k AS depth, array_to_string(l[1:k], chr(10)) AS path, l[k] AS line FROM l, range(1, (SELECT max(len(l)) FROM l) + 1) AS g(k) WHERE k <= len(l))
        SELECT statement_id, depth::INT AS depth, md5(line) AS line_md5, count(*) AS proofs FROM p GROUP BY statement_id, depth, path, line""",
    "best_branch": f"""WITH {A}, b AS (SELECT statement_id, source, count(*) AS n, avg(ok::INT) AS v FROM a WHERE statement_id IS NOT NULL AND source IS NOT NULL GROUP BY ALL),
        c AS (SELECT *, round(v + sqrt(2 * ln(greatest(sum(n) OVER (PARTITION BY statement_id), 2)::DOUBLE) / greatest(n, 0.01)), 6) AS score FROM b)
        SELECT statement_id, source, score FROM c QUALIFY row_number() OVER (PARTITION BY statement_id ORDER BY score DESC, source) = 1""",
    "json_keys": f"WITH {A}, k AS (SELECT unnest(json_keys(verification_dict::JSON)) AS key FROM a WHERE verification_dict IS NOT NULL) SELECT key, count(*) AS n FROM k GROUP BY 1",
    "provider_verify": f"""WITH {A} SELECT ok AS correct, regexp_matches(rtrim(proof_str, ' ' || chr(10) || chr(13) || chr(9)), '(omega|norm_num|decide)$') AND NOT contains(proof_str, 'sorry') AS verdict, count(*) AS n
        FROM a GROUP BY ALL""",
    "provider_generate": f"WITH {C} SELECT rec_id, coalesce(length(conjecture), 0) AS input_chars, conjecture IS NULL AS is_error FROM c",
    "task_first_result_stream": f"""{E_}, x AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY event_id) AS k, count(*) OVER (PARTITION BY task) AS m FROM e WHERE event_type = 'purchase')
        SELECT task, value AS result, worker, m - 1 AS duplicates FROM x WHERE k = 1""",
    "unseen_tasks_stream": f"{E_} SELECT DISTINCT task FROM e WHERE event_type = 'purchase' AND task IS NOT NULL",
    "answered_tasks_stream": f"{E_} SELECT g.task, g.event_id AS given, r.event_id AS result FROM e AS g JOIN e AS r ON g.task = r.task AND r.ts BETWEEN g.ts AND g.ts + INTERVAL 1 HOUR WHERE g.event_type = 'view' AND r.event_type = 'purchase'",
    "worker_sessions": f"""{E_}, l AS (SELECT worker, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY worker ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM e),
        s AS (SELECT worker, sum(fresh) OVER (PARTITION BY worker ORDER BY ts) AS k FROM l), n AS (SELECT worker, k, count(*) AS n FROM s GROUP BY ALL)
        SELECT worker, count(*) AS sessions, max(n) AS longest FROM n GROUP BY worker""",
    "task_lives_stream": f"""{E_}, w AS (SELECT task, worker, max(event_id) FILTER (event_type = 'view') AS v, max(event_id) FILTER (event_type = 'error') AS x FROM e WHERE task IS NOT NULL GROUP BY ALL),
        h AS (SELECT task, count(*) FILTER (v > coalesce(x, -1)) AS h FROM w GROUP BY 1)
        SELECT task, count(*) FILTER (event_type = 'view')::INT AS given, CASE WHEN bool_or(event_type = 'purchase') THEN 0 ELSE max(h) END::INT AS holders, bool_or(event_type = 'purchase') AS done
        FROM e JOIN h USING (task) GROUP BY task""",
    "event_windows_stream": f"""{E_}, x AS (SELECT (epoch_us(ts) // 43200000000 - d) * 43200000000 AS start_us, event_type, value FROM e, range(0, 2) AS g(d))
        SELECT start_us, event_type, count(*) AS n, max(value) AS peak FROM x GROUP BY ALL""",
}
