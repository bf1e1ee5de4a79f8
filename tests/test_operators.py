"""Operators against direct computations on small rows."""

import datetime
import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from lemmalake import storage
from lemmalake.functions import scores as M
from lemmalake.functions import text as X
from lemmalake.operators import dedup, intervals, order
from lemmalake.plans.rewards import cascade
from lemmalake.sources import files
from lemmalake.streaming import tasks


def values(spark, texts, f):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, x string")
    return [r.y for r in df.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_lenient_proofs(spark):
    cases = {"```lean4\ntheorem a := by\n  simp\n```": "\n  simp\n", "theorem a := by simp": None, "```lean4\nx := by a\n```\n```lean4\ny := by b\n``` end": " b\n", "```lean4\nx := by a": " a", "```lean4\nx": None, "": None, None: None}
    assert values(spark, list(cases), X.proof_lenient) == list(cases.values())


def test_strict_proofs(spark):
    one = "```lean4\ntheorem a := by\n  simp\n```"
    cases = [one, f" {one}\n", f"say {one}", f"{one} more", one.replace("theorem", "lemma b := by\ntheorem"), one.replace("simp", "```"), None]
    assert values(spark, cases, X.proof_strict) == ["\n  simp\n", "\n  simp\n", None, None, None, None, None]


def test_conjectures(spark):
    block = "```lean4\n{}\n```"
    texts = ["theorem a : b := by sorry", "theorem a : b := by", "theorem a := by sorry sorry", "a := by b := by", "theorem a := by simp", ""]
    assert values(spark, [block.format(t) for t in texts] + ["theorem a := by", None], X.conjecture) == ["theorem a : b := by"] * 2 + [None] * 6


def test_tagged_numbers(spark):
    inner = [" 3 ", "3\n", "3.5e2", "inf", "1_0", "1d", "", "x"]
    got = values(spark, [f"<s>{i}</s>" for i in inner] + ["<s>1</s> <s>2</s>", "<s>1", "1</s>", None], lambda c: X.tagged_number(c, "s"))
    assert got == [3.0, 3.0, 350.0, float("inf"), None, None, None, None, 2.0, None, None, None]


def test_durations_and_lists(spark):
    assert values(spark, ["1-00:00:00", "12:00:00", "12:30", "", "x", None], X.minutes) == [1440, 720, 750, 0, None, None]
    assert values(spark, ["0-3,8,10-11", "5", ""], X.cpu_count) == [7, 1, 0]


def test_header_and_body(spark):
    texts = [
        "import Mathlib\nimport Aesop\n\nopen Nat\nimport Mathlib.Tactic\n  open Nat\ntheorem a\nopen B",
        "theorem b",
        "",
        "import Aesop\nset_option x\n",
        "opened",
        "import Mathlib\r\n\topen A\u2028x",
    ]
    want = [("import Mathlib\nimport Aesop\nopen Nat\n\n", "theorem a\nopen B"), ("\n\n", "theorem b"), ("\n\n", ""), ("import Aesop\nset_option x\n\n", ""), ("\n\n", "opened"), ("import Mathlib\nopen A\n\n", "x")]
    for k in (0, 1):
        assert values(spark, texts, lambda c, k=k: X.header_and_body(c)[k]) == [w[k] for w in want]


def test_lines_and_sizes(spark):
    assert values(spark, ["ab\ncde\nf"] * 2, lambda c: X.at_line(c, F.lit(1), F.lit(2))) == [5, 5]
    assert values(spark, ["ab"], lambda c: X.at_line(c, F.lit(3), F.lit(0))) == [None]
    assert values(spark, ["128G", "3G", "x", None, "12"], lambda c: X.gigabytes(c, F.lit(8))) == [16, 1, None, None, None]
    assert values(spark, ["a ```b``` c", "a", None], X.before_fence) == ["a ", "a", None]


def test_rewards_leave_comments_out(spark):
    long = "simp\n" + "-- word\n" * 200
    rows = [(True, "simp -- try this", "g", 1), (True, "/- try -/ simp", "g", 1), (True, "try simp", "g", 1), (True, long, "g", 1), (False, "simp", "g", 1), (True, "simp", "```lean4 ```lean4", 1), (True, "simp", "g", 150)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, ok boolean, p string, g string, n int")
    got = [r.r for r in df.select("k", cascade(F.col("ok"), F.col("p"), F.col("g"), F.col("n")).alias("r")).orderBy("k").collect()]
    want = [math.exp(-0.001 * len(rows[0][1])), math.exp(-0.001 * len(rows[1][1])), 0.0, math.exp(-0.001 * len(long)), 0.0, 0.0, -1.0]
    assert got == pytest.approx(want)


def test_byte_offsets(spark):
    text = "a₁ ≤ b\n∀ x"
    df = spark.createDataFrame([(text, len(text[:9].encode()))], "x string, b int")
    assert df.select(*X.at_byte(F.col("x"), F.col("b"))).first()[:] == (1, 2, 9)


@pytest.mark.parametrize(("n", "most", "want"), [(80, 100, 0.0), (90, 100, -0.5), (100, 100, -1.0), (300, 100, -1.0), (1, 0, -1.0)])
def test_length_penalty(spark, n, most, want):
    assert spark.range(1).select(M.length_penalty(F.lit(n), most)).first()[0] == pytest.approx(want)


def test_rubric(spark):
    rows = [(0.0, 5.0, 1.0, 7.0), (3.0, 5.0, 1.0, 0.0), (4.0, 5.0, 0.0, 0.0), (3.5, 5.0, 1.0, 3.5), (2.0, 0.0, 9.0, 0.0), (None, 5.0, 1.0, None)]
    df = spark.createDataFrame(rows, "c double, r double, d double, want double")
    assert all(r[0] == r.want for r in df.select(M.rubric(F.col("c"), F.col("r"), F.col("d")), "want").collect())


@pytest.mark.parametrize("n", [0, 1, 3, 10, 90, 170])
def test_value_at_share(spark, n):
    rng = random.Random(n)
    v = sorted(rng.choice([0.125, 0.25, 0.5, 0.75]) for _ in range(n))
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "x double")
    for few in (True, False):
        assert order.value_at_share(df, "x", 0.7, few).first().value == (v[int(n * 0.7)] if n else None)


@pytest.mark.parametrize(("n", "chunks"), [(0, 3), (2, 5), (10, 3), (12, 4)])
def test_chunks(spark, n, chunks):
    got = {r.id: r.chunk for r in order.chunks(spark.range(n), chunks, "id").collect()}
    size, extra = divmod(n, chunks)
    want = [c for c in range(chunks) for _ in range(size + (c < extra))]
    assert [got[k] for k in range(n)] == want


def test_previous(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), k, k * 10) for k in rng.sample(range(500), 300)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = {r.k: (r.before and r.before.v) for r in order.previous(df, "g", ["k"], ["v"]).collect()}
    want, last = {}, {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        want[k] = last.get(g)
        last[g] = v
    assert got == want
    assert order.previous(df.where("false"), "g", ["k"], ["v"]).count() == 0


def test_level(spark):
    rng = random.Random(4)
    for _ in range(3):
        groups = {g: rng.randint(1, 6) for g in "abcd"}
        keep = rng.randint(0, sum(groups.values()))
        left = dict(groups)
        while sum(left.values()) > keep:
            left[max(sorted(left), key=lambda g: left[g])] -= 1
        rows = [(g, k) for g, n in groups.items() for k in range(n)]
        got = order.level(spark.createDataFrame(rows, "g string, k int"), ["g"], [F.col("k")], keep).groupBy("g").count().collect()
        assert {r.g: r["count"] for r in got} == {g: n for g, n in left.items() if n}


def test_epochs_cover_everything(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("id"))
    seen = [[r.id for r in order.epoch_batch(df, "id", 4, k, 1).orderBy("ordinal").collect()] for k in range(6)]
    assert sorted(sum(seen[:3], [])) == sorted(sum(seen[3:], [])) == [str(k) for k in range(10)]
    assert seen[:3] != seen[3:]


def test_new_first(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "k int, x string")
    known = spark.createDataFrame([("b",), (None,)], "y string")
    assert [r.k for r in dedup.new_first(df, "x", [F.col("k")], known, "y").collect()] == [1]


def test_cycled_and_repeated(spark):
    items = spark.createDataFrame([("g", k) for k in range(3)], "g string, k int")
    assert [r.k for r in dedup.cycled(items, "g", [F.col("k")], 7).orderBy("turn").collect()] == [0, 1, 2, 0, 1, 2, 0]
    assert dedup.repeated(items, 0).count() == 0


def greedy(spans):
    ends, out = [], []
    for s, e in spans:
        lane = next((k for k, x in enumerate(ends) if x <= s), len(ends))
        ends[lane : lane + 1] = [e]
        out.append(lane)
    return out


def test_lanes(spark):
    rng = random.Random(9)
    spans = sorted((s := rng.randint(0, 60), s + rng.randint(0, 15)) for _ in range(60))
    df = spark.createDataFrame([("n", s, e, k) for k, (s, e) in enumerate(spans)], "g string, s long, e long, k long")
    for slot in (1, 5, 10**9):
        assert [r.lane for r in intervals.lanes(df, "g", "s", "e", "k", slot).orderBy("k").collect()] == greedy(spans)
    long = [x for x in spans if x[0] < x[1]]
    peak = max(sum(s <= t < e for s, e in long) for t in range(80))
    assert intervals.peak(df, ["g"], "s", "e").first().peak == peak


def test_empty_tables(spark):
    none = spark.createDataFrame([], "g string, s long, e long, k long")
    assert intervals.lanes(none, "g", "s", "e", "k").count() == 0
    assert intervals.peak(none, ["g"], "s", "e").count() == 0
    assert order.level(none, ["g"], [F.col("k")], 5).count() == 0
    assert order.shards(none, 3, "k").count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_streams_in_several_batches(spark, tmp_path, seed):
    """The result is the same however the log is cut and in whatever order its parts come."""
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(minutes=7 * k), rng.randint(0, 3), rng.choice(["view", "view", "error", "purchase"]), float(k % 13), json.dumps({"k": rng.randint(0, 9)})) for k in range(120)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    one, many = tmp_path / "one", tmp_path / "many"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{one}/events.parquet")
    parts = [rows[k::6] for k in range(6)]
    rng.shuffle(parts)
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{many}/events.parquet")
    for f in (tasks.first_results, tasks.lives, tasks.windows, tasks.unseen, tasks.answered):
        whole, cut = (sorted(map(tuple, f(spark, str(d), 1).collect()), key=repr) for d in (one, many))
        assert whole == cut and whole
    life = {}
    for k, _, w, kind, _, props in rows:
        t = life.setdefault(json.loads(props)["k"], {"given": 0, "done": False, "last": {}})
        t["given"] += kind == "view"
        t["done"] |= kind == "purchase"
        if kind in ("view", "error"):
            t["last"][w] = kind
    want = {(k, t["given"], 0 if t["done"] else sum(v == "view" for v in t["last"].values()), t["done"]) for k, t in life.items()}
    assert {tuple(r) for r in tasks.lives(spark, str(many), 2).collect()} == want


def test_release(spark):
    df = storage.materialize(spark.range(3), "x")
    assert df.count() == 3
    folder = storage.run_folder(spark).removeprefix("file://")
    assert os.listdir(folder)
    storage.release(spark)
    assert not os.path.exists(folder)
    storage.release(spark)
    assert storage.materialize(spark.range(3), "x").count() == 3


def test_files(spark, tmp_path):
    with pytest.raises(ValueError, match="only"):
        files.read(spark, "x.pkl")
    path = f"{tmp_path}/it"
    for n, rows in (("a", [(1, "x"), (2, "y")]), ("b", [(2, "z")]), ("c", [(2, "z")])):
        files.write_iteration(spark.createDataFrame(rows, "iteration int, v string"), path)
    assert sorted((r.iteration, r.v) for r in spark.read.parquet(path).collect()) == [(1, "x"), (2, "z")]
