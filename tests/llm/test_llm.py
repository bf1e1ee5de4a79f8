"""The operators for training data against brute force on small rows, and on rows that are null, empty, repeated or very long."""

import base64
import collections
import os
import random
import subprocess
import sys

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from lemmalake.llm import cross_split, encoding, format_copies, garbled, leaks, packing, registry, similar, top_per_group, truncated
from lemmalake.sources.tables import table

RX = regex.compile(r"[\p{L}\p{N}]+")
words = lambda s: RX.findall((s or "").lower())


def theorem(rng, k):
    binders = " ".join(f"(h{rng.choice('abcdefgh')} : {rng.randint(2, 9999)} * {rng.choice('xyz')} < {rng.randint(2, 99999)})" for _ in range(rng.randint(3, 7)))
    return f"theorem {rng.choice(['weak', 'strong', 'tame'])}_hull_{k} {binders} : f {rng.randint(1, 9999)} = {rng.randint(1, 9999)} := by"


def varied(rng, text):
    w = text.split(" ")
    for _ in range(rng.randint(0, 4)):
        w[rng.randrange(len(w))] = str(rng.randint(1, 99))
    return " ".join(w)


def family(seed, n):
    rng, out = random.Random(seed), []
    for k in range(n):
        out.append(varied(rng, rng.choice(out)) if out and rng.random() < 0.5 else theorem(rng, k))
    return out


# problem 1


@pytest.mark.parametrize("seed", range(3))
def test_packing(make, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, None, 1, 7, 64, 64, 200, 511, 512, 513, 1024, 1700, rng.randint(1, 512)]) for _ in range(400)]
    got = packing.pack(make(list(enumerate(sizes)), "id long, n int"), 512, slice_rows=10).collect()
    taken, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r.id].append((r.piece, r.n_tokens))
        if r.n_tokens:
            taken[r.row_id].append((r.place, r.place + r.n_tokens))
    for k, n in enumerate(sizes):
        p = [x for _, x in sorted(pieces[k])]
        assert sum(p) == (n or 0)
        assert len(p) == max(1, -(-(n or 0) // 512))
    for spans in taken.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 512
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert set(taken) == set(range(len(taken)))
    assert len(taken) <= -(-sum(n or 0 for n in sizes) // 512) + 2


def test_packing_empty(make):
    assert packing.pack(make([], "id long, n int"), 512).count() == 0
    assert [tuple(r) for r in packing.pack(make([(1, 0), (None, 4)], "id long, n int"), 512).collect()] == [(1, 0, 0, 0, 0)]


def test_packing_solution_is_whole():
    h = np.zeros(64, dtype=np.int64)
    h[[2, 10, 30, 40, 63]] = [100, 7, 33, 21, 4]
    used = sum(p * n for p, n in packing.solve(h, 64))
    assert (used == h).all()


@pytest.mark.parametrize("times", [1, 100])
def test_packing_by_linear_program(times):
    rng = np.random.default_rng(1)
    h = np.bincount(np.minimum(511, rng.lognormal(3.6, 1.0, 20_000).astype(int)), minlength=512)[1:] * times
    h = np.append(h, 0)
    told = {}
    plan = packing.solve(h, 512, told)
    least = -(-int((h * np.arange(1, 513)).sum()) // 512)
    assert (sum(p * n for p, n in plan) == h).all()
    assert least - 1 <= told["bound"] <= least
    assert told["lp_items"] > 0.8 and sum(n for _, n in plan) <= 1.0001 * least + 2


def test_packing_bound_above_volume():
    h = np.zeros(512, dtype=np.int64)
    h[[299, 250]] = [1000, 7]
    told = {}
    plan = packing.solve(h, 512, told)
    assert sum(n for _, n in plan) == 1004 and 1000 < told["bound"] <= 1003.5 and told["lp_items"] > 0.9


# problem 2


def test_top_n(make):
    rng = random.Random(2)
    data = [(rng.choice(["hot", "hot", "b", "c", None, f"g{rng.randint(0, 30)}"]), rng.choice([None, float("nan"), 0.0, -0.0, 1.0, float("inf"), rng.random()]), k // 2 if rng.random() < 0.3 else k, "x") for k in range(900)]
    df = make(data + data[:40], "g string, s double, i long, path string")
    for block_rows in (50, 7):
        got = {(r.g, r.i) for r in top_per_group.top_n(df, "g", "s", "i", 3, block_rows).collect()}
        want = set()
        by = collections.defaultdict(set)
        for g, s, i, _ in data:
            if g is not None and s is not None and s == s:
                by[g].add((-s, i))
        for g, x in by.items():
            want |= {(g, i) for _, i in sorted(x)[:3]}
        assert got == want


def test_top_n_skips_and_empty(make):
    df = make([("hot", float(k % 500), k) for k in range(5000)] + [(f"g{k // 5}", 1.0, k) for k in range(500)] + [("z" * 5000, 2.0, 1)], "g string, s double, i long")
    told = {}
    got = top_per_group.top_n(df, "g", "s", "i", 4, 100, told)
    assert sorted(r.i for r in got.where("g = 'hot'").collect()) == [499, 999, 1499, 1999]
    assert got.count() == 4 + 400 + 1
    read = {r.g: r.n_read for r in told["read"].collect()}
    assert read["hot"] <= 400 and read["g3"] == 5 and len(read) == 102
    assert top_per_group.top_n(df.where("false"), "g", "s", "i", 4).count() == 0


# problem 3


def test_truncated(make):
    rng = random.Random(5)
    tactic = lambda: rng.choice(["omega", "norm_num", "exact foo_bar hmin", "linarith [hmin, foo_bar]", "simp only [foo_bar, hkey]"])
    prose = lambda: f"We first bound the {rng.choice(['hull', 'ridge'])} by {rng.randint(1, 99)} and then absorb the rest."
    data, want = [], set()
    for k in range(1200):
        kind = rng.randrange(3)
        body = "\n  ".join(tactic() for _ in range(6))
        text = [f"  have h_{k} : a = {k} := by\n    {body}", f"```lean4\n  {body}\n```", " ".join(prose() for _ in range(4))][kind]
        if rng.random() < 0.04:
            text = [text.rpartition("\n")[0] + "\n    " + rng.choice(["linarith [hm", "exact foo_b", "simp only [foo_bar, ", "linarith [hmin, f"]), text[: -4 - rng.randint(1, 60)], text[: -rng.randint(2, 40)]][kind]
            text += rng.choice(["", "...", "  "])
            want.add(k)
        data.append(("t", k, text))
    data += [("t", 5000, None), ("t", 5001, ""), ("t", 5002, " ** "), ("t", None, "x"), data[0]]
    got = {r.id for r in truncated.truncated(make(data, "tbl string, id long, text string")).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert len(got - want) <= 3
    assert truncated.truncated(make([], "tbl string, id long, text string")).count() == 0


def test_truncated_copies(make):
    rng = random.Random(6)
    names = [f"bound{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    data = [("t", k, " ".join(f"We use {rng.choice(names)} to see the rest of {rng.choice(names)} and conclude." for _ in range(4))) for k in range(600)]
    data += [("t", 1000 + k, f"We use {names[0]} to see the rest of" + "..." * (k % 2)) for k in range(50)]
    got = {r.id for r in truncated.truncated(make(data, "tbl string, id long, text string")).collect()}
    assert got == set(range(1000, 1050))


def test_truncated_long_tokens(make):
    data = [("t", k, f"We use the bound of {k} and then conclude.") for k in range(300)] + [("t", 400 + k, "we use " + "ab" * (500_000 + k)) for k in range(3)]
    data += [("t", 500, "x" + ".a" * 200_000 + " and then conclude."), ("t", 501, "We use the bou")]
    assert {r.id for r in truncated.truncated(make(data, "tbl string, id long, text string")).collect()} >= {501}


# problems 4 and 5


def alike(a, b):
    x, y = collections.Counter(words(a)), collections.Counter(words(b))
    return x and y and 4 * (x & y).total() >= 3 * max(x.total(), y.total())


@pytest.mark.parametrize("seed", range(3))
def test_similar_misses_nothing(make, seed):
    rng = random.Random(seed)
    texts = family(seed, 120) + ["", None, "***", "one", "One!", "one two", "two one", "a b c d", "a b c e", "a a a b", "a a a a b"]
    texts += [" ".join(f"w{rng.randint(0, 400)}" for _ in range(300))] + [" ".join(["long"] * 90 + [f"v{k}" for k in range(60)]), " ".join(["long"] * 80 + [f"v{k}" for k in range(65)])]
    for k in range(30):  # texts near the bound
        base = [f"n{rng.randint(0, 60)}" for _ in range(rng.randint(5, 40))]
        texts += [" ".join(base), " ".join(w if rng.random() < 0.78 else f"m{rng.randint(0, 60)}" for w in base)]
    data = list(enumerate(texts)) + [(3, texts[3])]
    heads, members = similar.classes(make(data, "id long, text string"))
    pairs = {(r.x, r.y) for r in similar.similar(heads).collect()}
    rep = {r.id: r.rep for r in members.collect()}
    assert set(rep) == {k for k, t in enumerate(texts) if words(t)}
    reps = sorted(set(rep.values()))
    assert pairs == {(a, b) for a in reps for b in reps if a < b and alike(texts[a], texts[b])}


def test_similar_empty(make):
    heads, members = similar.classes(make([], "id long, text string"))
    assert similar.similar(heads).count() == members.count() == 0


def test_bands_overlap():
    for k, (low, high) in enumerate(similar.BANDS):
        if k:
            assert low <= 0.75 * (similar.BANDS[k - 1][1] + 1)
        assert all(g * (t - 1) + 1 <= -(-3 * low // 4) for g, t in similar.CHOICES[k])
        assert high > low or k == 0


@pytest.mark.parametrize("shard_words", [10_000, 300])
def test_cross_split(make, shard_words):
    texts = family(11, 160)
    held, train = make(list(enumerate(texts[:50])) + [(900, None), (901, "!!")], "id long, text string"), make([(1000 + k, t) for k, t in enumerate(texts[50:])] + [(None, texts[0])], "id long, text string")
    got = {(r.id_x, r.id_y) for r in cross_split.cross_split_pairs(held, train, bits=14.0, shard_words=shard_words).collect()}
    want = {(1000 + k, j) for k, t in enumerate(texts[50:]) for j, u in enumerate(texts[:50]) if alike(t, u)}
    assert got <= want
    assert len(got) >= 0.97 * len(want) > 0
    assert cross_split.cross_split_pairs(held.where("false"), train).count() == cross_split.cross_split_pairs(held, train.where("false")).count() == 0


def test_cross_split_without_long_runs(make):
    rng = random.Random(4)
    base = [f"n{k}" for k in range(40)]
    held = ["one two three four five six seven eight nine ten", " ".join(base), "a b c d", "one"]
    train = [held[0], " ".join(rng.sample(base, 40)), " ".join(f"m{k}" if k % 4 == 3 else w for k, w in enumerate(base)), "d c b x", "a b c d e f", "One!", "two"]
    got = {(r.id_x, r.id_y) for r in cross_split.cross_split_pairs(make(list(enumerate(held)), "id long, text string"), make(list(enumerate(train)), "id long, text string")).collect()}
    assert got == {(k, j) for k, t in enumerate(train) for j, u in enumerate(held) if alike(t, u)}
    assert {(0, 0), (1, 1), (2, 1), (3, 2), (5, 3)} == got


def test_cross_split_many_short_and_shuffled(make):
    """At the default options: exact copies of short texts, and texts with the same words in another order."""
    rng = random.Random(7)
    held = [f"theorem t{k} : a + b = {k} := by" for k in range(200)] + [" ".join(f"w{rng.randint(0, 300)}" for _ in range(30)) for _ in range(200)]
    train = [t if k < 200 else " ".join(rng.sample(t.split(), 30)) for k, t in enumerate(held)]
    got = {(r.id_x, r.id_y) for r in cross_split.cross_split_pairs(make(list(enumerate(held)), "id long, text string"), make(list(enumerate(train)), "id long, text string")).collect()}
    assert {(k, k) for k in range(400)} <= got
    assert all(alike(train[k], held[j]) for k, j in got)


@pytest.mark.parametrize("shard_words", [10**6, 2_000, 200])
def test_overlaps_with_any_shards(make, shard_words):
    """Every pair with a run of shared words that carries the bits comes out of the index, however many shards there are."""
    texts = family(21, 300)
    (e, of_e), (t, of_t) = (similar.classes(make(list(enumerate(x)), "id long, text string"), True) for x in (texts[:100], texts[100:] + ["unrelated words only here", "zzz"]))
    x_rep, y_rep = ({r.id: r.rep for r in m.collect()} for m in (of_t, of_e))
    got = {(r.x, r.y) for r in cross_split.overlaps(e, t, 20.0, shard_words).collect()}
    counts = similar.histogram(e)
    import pandas as pd

    weight = lambda w: float(cross_split.weights_of(counts)[int(similar.word_hashes(pd.Series([w]))[0][0] % np.uint64(similar.BUCKETS))])
    bits = {w: weight(w) for x in texts for w in words(x)}

    def best(a, b):
        here, top = {}, 0.0
        for x in a:
            here = {k: here.get(k - 1, 0.0) + bits[x] for k, y in enumerate(b) if x == y}
            top = max([top, *here.values()])
        return top

    want = {(i, j) for i, x in enumerate(texts[100:]) for j, y in enumerate(texts[:100]) if x_rep[i] == i and y_rep[j] == j and alike(x, y) and best(words(x), words(y)) >= 20.0}
    assert len(want) > 50 and want <= got


def test_wavelet():
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 1000):
        s = rng.integers(0, 11, n)
        w = cross_split.Wavelet(cross_split.Wavelet.pack(s, 4), n)
        assert (w.read(np.arange(n))[0] == s).all()
        for c in range(11):
            at = np.arange(n + 1)
            got = w.follow(np.full(n + 1, c), at) - w.follow(np.array([c]), np.array([0]))
            assert (got == np.append(0, np.cumsum(s == c))).all()


def test_full_text_index():
    import pandas as pd

    lines = ["a b a b c", "b c d", "c d a b a"]
    row = cross_split.FullTextIndex.build(pd.Series(lines), np.arange(3))
    index = cross_split.FullTextIndex(pd.Series(row))
    hashes, _ = similar.word_hashes(pd.Series(["a b a", "z"]))
    number = index.numbers(hashes)
    (at, size, place), *rest = index.hits(number[:3], np.ones(3), np.zeros(3, dtype=int), 2.0)
    assert not rest and len(list(index.hits(number[[0, 1, 0, 1]], np.ones(4), np.array([0, 0, 1, 1]), 2.0, most=1))) == 2
    text = " ".join(x + " |" for x in lines).split()
    want = {(e - 1, p) for e in (1, 2) for p in range(len(text)) if text[p : p + 2] == ["a", "b", "a"][e - 1 : e + 1]}
    assert set(zip(at.tolist(), place.tolist(), strict=True)) == want
    assert set(size) == {2}


# problem 6


def test_copies(make):
    data = [("a", "sequence", 1, "x := by simp"), ("a", "sequence", 2, "X:=BY (simp)"), ("a", "sequence", 3, "x by"), ("a", "sequence", 2, "X:=BY (simp)"), ("a", "sequence", 4, None), ("a", "sequence", 5, " -- "), ("a", "sequence", None, "x")]
    data += [("b", "theorem", 1, "theorem t (a : x) {b : y} : g := by"), ("b", "theorem", 2, "Theorem t_ [b : y]\n(a:x): g := by"), ("b", "theorem", 3, "theorem t (a : x) {c : y} : g := by"), ("b", "theorem", 4, "theorem t (a : x) (a : x) {b : y} : g := by"), ("b", "theorem", 5, "theorem (((")]
    data += [("c", "sequence", 1, "a" * 30_000), ("c", "sequence", 2, "A " * 30_000)]
    got = {(r.tbl, r.id): r.rep for r in format_copies.classes(make(data, "tbl string, kind string, id long, text string")).collect()}
    assert got == {("a", 1): 1, ("a", 2): 1, ("a", 3): 3, ("b", 1): 1, ("b", 2): 1, ("b", 3): 3, ("b", 4): 4, ("b", 5): 5, ("c", 1): 1, ("c", 2): 1}
    assert format_copies.classes(make([], "tbl string, kind string, id long, text string")).count() == 0


def test_copies_across_batches(spark, make):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = random.Random(1)
        texts = [f"have {k} := by omega" for k in range(5)]
        data = [("a", "sequence", k, rng.choice(texts).replace(" ", rng.choice([" ", "  ", "\n"]))) for k in range(200)]
        got = {r.id: r.rep for r in format_copies.classes(make(data, "tbl string, kind string, id long, text string").repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    first = {}
    for _, _, k, t in data:
        first.setdefault("".join(words(t)), k)
    assert got == {k: first["".join(words(t))] for _, _, k, t in data}


def test_copies_of_long_texts(make):
    data = [("a", "sequence", k, ("ab " if k % 2 else "AB-") * 200_000 + str(k // 2)) for k in range(40)]
    got = {r.id: r.rep for r in format_copies.classes(make(data, "tbl string, kind string, id long, text string")).collect()}
    assert got == {k: k - k % 2 for k in range(40)}


def test_two_pointers():
    assert format_copies.runs_equal("a-b c", "ABC") and not format_copies.runs_equal("abc", "abcd") and not format_copies.runs_equal("abd", "abc")
    assert format_copies.runs_equal("ÉΣ₁", "é σ₁") and format_copies.runs_equal("--", "")


# problem 7


def test_encoding(make):
    import tiktoken

    path = f"{encoding.TOKENIZERS}/byte_bpe_50k.tiktoken"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=encoding.WORDS, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello world", "", None, "  \n\t ", "don't   stop", "aaaaaaaaaaaaaaaaaa", "x₁ ≤ ∑ 𝓝 é é 👩‍🔬", "<|endoftext|>", "数学の証明", "=" * 3000, "abc " * 20_000, "\x00\x85  　x"]
    got = {r.k: list(r.ids) for r in encoding.encode(make([(k, t, 1) for k, t in enumerate(texts)], "k long, t string, ids int"), "k", "t", path, known_words=3).collect()}
    assert got == {k: known.encode_ordinary(t or "") for k, t in enumerate(texts)}
    assert encoding.encode(make([], "k long, t string"), "k", "t", path).count() == 0


# problem 8


def test_leaks(make):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(50)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(rng.choice([1, 2, 3, 6, 11, 12, 13, 40])) for _ in range(40)] + [items_ := text(30), items_[:20] + ["other"] * 5]
    docs = []
    for k in range(80):
        doc = text(rng.randint(0, 60))
        if k % 2:
            it = rng.choice(items)
            cut = it[: rng.randint(1, len(it))]
            at = rng.randint(0, len(doc))
            doc[at:at] = cut
        docs.append(" ".join(doc).replace("w1 ", "W1, ") or None)
    d, i = make(list(enumerate(docs)) + [(900, "..."), (None, "w1")], "id long, text string"), make([(k, " ".join(t)) for k, t in enumerate(items)] + [(900, None), (901, "")], "id long, text string")
    got = {(r.doc, r.item) for r in leaks.leaks(d, i).where("longest >= least(12, item_words)").collect()}

    def holds(doc, item):
        n = min(12, len(item))
        parts = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)}
        return any(tuple(doc[k : k + n]) in parts for k in range(len(doc) - n + 1))

    assert got == {(a, b) for a, x in enumerate(docs) for b, y in enumerate(items) if holds(words(x), y)}
    assert leaks.leaks(d.where("false"), i).count() == leaks.leaks(d, i.where("false")).count() == 0


def test_leaks_of_common_and_long_items(make):
    docs = [(k, "word " * k + "other thing") for k in range(50)] + [(100, "x " * 50_000 + " ".join(f"u{k}" for k in range(30)))]
    items = [(1, "Word"), (2, "other thing"), (3, " ".join(f"u{k}" for k in range(20_000))), (4, "word word missing")]
    got = {(r.doc, r.item) for r in leaks.leaks(make(docs, "id long, text string"), make(items, "id long, text string")).where("longest >= least(12, item_words)").collect()}
    assert got == {(k, 1) for k in range(1, 50)} | {(k, 2) for k in range(50)} | {(100, 3)}


def best_score(a, b):
    h = collections.defaultdict(int)
    for x in range(1, len(a) + 1):
        for y in range(1, len(b) + 1):
            h[x, y] = max(0, h[x - 1, y - 1] + (leaks.EQUAL if a[x - 1] == b[y - 1] else leaks.UNEQUAL), h[x - 1, y] + leaks.GAP, h[x, y - 1] + leaks.GAP)
    return max(h.values(), default=0)


@pytest.mark.parametrize("block_words", [100_000, 60])
def test_edited_copies(make, block_words):
    rng = random.Random(12)
    text = lambda n: [f"w{rng.randint(0, 200)}" for _ in range(n)]
    items = [[f"v{k}" for k in range(30)], *(text(n) for n in (1, 2, 3, 7, 15, 24, 40))]
    docs = [[f"unseen{k}" if k in (10, 20) else w for k, w in enumerate(items[0])]]  # an edit in each 12 words
    docs.append([f"other{k}" if k % 4 == 3 else w for k, w in enumerate(items[0])])  # no 4 words in a row
    docs.append([x for k, w in enumerate(items[0]) for x in (w, f"between{k}")])  # no 2 words in a row
    for _ in range(60):
        copy = [rng.choice([w, w, w, w, f"e{rng.randint(0, 9)}"]) for w in rng.choice(items) if rng.random() < 0.85]
        docs.append(text(rng.randint(0, 200)) + copy + text(rng.randint(0, 20)))
    d, i = make([(k, " ".join(x)) for k, x in enumerate(docs)] + [(900, None), (None, "w1")], "id long, text string"), make([(k, " ".join(x)) for k, x in enumerate(items)] + [(901, "")], "id long, text string")
    got = {(r.doc, r.item): r.score for r in leaks.edited(d, i, block_words).collect()}
    want = {(a, b): n for a, x in enumerate(docs) for b, y in enumerate(items) if (n := best_score(x, y)) >= len(y)}
    assert got == want and {(0, 0), (1, 0), (2, 0)} <= set(want)
    assert leaks.edited(d.where("false"), i).count() == leaks.edited(d, i.where("false")).count() == 0


def test_alignment():
    rng = random.Random(3)
    for _ in range(20):
        a, b = [rng.randint(0, 4) for _ in range(rng.randint(1, 12))], [rng.randint(0, 4) for _ in range(rng.randint(1, 12))]
        h = collections.defaultdict(int)
        for x in range(1, len(a) + 1):
            for y in range(1, len(b) + 1):
                h[x, y] = max(0, h[x - 1, y - 1] + (leaks.EQUAL if a[x - 1] == b[y - 1] else leaks.UNEQUAL), h[x - 1, y] + leaks.GAP, h[x, y - 1] + leaks.GAP)
        score, _ = leaks.align(np.array([a + [-1] * 2]), np.array([b + [-2] * 3]))
        assert score[0] == max(h.values())


# problem 9

CLEAN = {"de": "Während der Übersetzung fiel die Größe um {} zurück, außer für kürzere Wege über Körper", "ru": "Однако доказательство леммы занимает {} строк и проверка остановила задачу", "en": "The guide’s remark — about {} suggests “using” the façade when x ≤ y"}


def test_garbled(make):
    rng = random.Random(9)
    data, want, whole = [], set(), {}
    for k in range(500):
        text = CLEAN[rng.choice(list(CLEAN))].format(k)
        whole[k] = text
        if k % 25 == 0:
            how = rng.choice([("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437")])
            page = garbled.byte_of(how[1])
            back = {b: c for c, b in page.items()}
            text = "".join(back[bytes([b])] for b in text.encode(how[0]))
            want.add(k)
        data.append((k, rng.choice(["a", "b", None]), text))
    data += [(900, "a", None), (901, "a", ""), (902, "b", "W�hrend"), (903, "a", "plain"), (None, "a", "x")]
    df = make(data, "id long, source string, text string")
    assert {r.id for r in garbled.garbled(df).collect()} == want | {902}
    back = {r.id: r.text for r in garbled.restored(df).collect()}
    assert sum(back[k] == whole[k] for k in want) >= 0.9 * len(want)
    assert garbled.garbled(df.where("false")).count() == 0


GERMAN = "Während der Übersetzung fiel die Größe zurück außer für kürzere Wege über Körper dafür müssen wir prüfen ob die Lösung möglich wäre natürlich gehört dazu schließlich auch führt größer hätte später wählen Fläche gemäß weiß große süß Straße Fuß heißt müde Tür Höhe größte fällt Länge Übung Überlegung Überblick".split()
POLISH = "zażółć gęślą jaźń język polski twierdzenie jest prawdziwe ponieważ każdy element należy do zbioru którego suma wynosi więcej niż połowa długości ciągu oraz można łatwo sprawdzić że dowód kończy się sprzecznością żaden inny przypadek zachodzi świat źródło częściowo równość ćwiczenie wartość pomiędzy również".split()


def wrongly(text, page="cp1252"):
    back = {b: c for c, b in garbled.byte_of(page).items()}
    return "".join(back[bytes([b])] for b in text.encode())


def test_garbled_unlisted_page(make):
    rng = random.Random(1)
    assert not {"cp1253", "cp1257"} & {p for c in garbled.CIPHERS for p in c[:2]}
    data = [(k, rng.choice(["a", "b"]), " ".join(rng.sample(GERMAN, 14))) for k in range(400)]
    raw = {1000 + k: " ".join(rng.sample(GERMAN, 14)) + f" {k}" for k in range(60)}
    df = make(data + [(k, "greek", t.encode("cp1252").decode("cp1253")) for k, t in raw.items()], "id long, source string, text string")
    back = {r.id: r.text for r in garbled.restored(df).collect()}
    assert {r.id for r in garbled.garbled(df).collect()} == set(raw)
    assert sum(back.get(k) == t for k, t in raw.items()) >= 0.9 * len(raw)


def test_garbled_long_words_and_small_languages(make):
    rng = random.Random(2)
    chinese = "证明这个定理需要使用数学归纳法首先考虑基础情形然后假设对于所有较小的自然数结论成立最后推出所求的等式因此命题得证我们还可以看到不等式在端点处取得等号"
    data = [(k, rng.choice(["a", "b"]), " ".join(rng.sample(GERMAN, 14)) + rng.choice(["", " l’été déjà", " x ≤ y"])) for k in range(400)]
    data += [(1000 + k, "polish", " ".join(rng.sample(POLISH, 18))) for k in range(60)]
    joined = {2000 + k: "".join(rng.sample(GERMAN, 20) * 2) for k in range(10)} | {3000 + k: "".join(rng.sample(chinese, 60) * 9) for k in range(10)}
    data += [(k, "joined", wrongly(t)) for k, t in joined.items()]
    df = make(data, "id long, source string, text string")
    got = {r.id for r in garbled.garbled(df).collect()}
    assert set(joined) <= got and len(got - set(joined)) <= 1
    back = {r.id: r.text for r in garbled.restored(df).collect()}
    assert all(back[k] == t for k, t in joined.items())


def test_garbled_null_source_is_its_own(make):
    df = make([(1, None, "für über"), (2, "", "für über"), (3, None, None), (4, None, "")], "id long, source string, text string")
    odd = garbled.odd_words(df.where("text IS NOT NULL"))
    assert {(r.id, r.source, r.word, r.n) for r in odd.where("word IS NOT NULL").collect()} == {(1, None, "für", 1), (1, None, "über", 1), (2, "", "für", 1), (2, "", "über", 1)}
    assert garbled.garbled(df).count() == 0


@pytest.mark.parametrize("cipher", garbled.CIPHERS)
def test_ciphers_round_trip(cipher):
    wrong, right, times = cipher
    text = {"cp1251": "Однако", "koi8-r": "Однако", "cp866": "Однако", "iso8859-5": "Однако", "mac_cyrillic": "Однако"}.get(right, "für étape")
    out = text
    back = {b: c for c, b in garbled.byte_of(wrong).items()}
    try:
        for _ in range(times):
            raw = out.encode(right) if right == "utf-8" else b"".join(garbled.byte_of(right)[c] for c in out)
            out = raw.decode("gb18030") if wrong == "gb18030" else "".join(back[bytes([b])] for b in raw)
    except UnicodeError:
        return  # the text can't go through this cipher
    plain = garbled.decipher(out, cipher)
    assert plain == text or any("\x80" <= c < "\xa0" for c in out + text)


# all


def test_sql(spark, folder):
    con = duckdb.connect()
    for t in ("train_samples", "statements", "conjectures", "attempts", "documents", "eval_items"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, folder)
        cur = con.execute(sql)
        at = [[d[0] for d in cur.description].index(c) for c in df.columns]
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[k] for k in at)) for r in cur.fetchall()), name


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_runs(spark, folder, name):
    df = registry.queries()[name](spark, folder)
    assert df.count() >= 0


def test_workers_without_the_package(folder, tmp_path):
    """Only the driver has the package on its path."""
    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(garbled.__file__)))!r} + '/..')
from lemmalake.llm import registry
from lemmalake.session import local_session
spark = local_session(4, 4)
for name, q in registry.queries().items():
    if name.endswith(('_found', '_pack', '_ids', '_scores', '_restored')):
        q(spark, {str(folder)!r}).count()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, capture_output=True, timeout=900)


def test_found_once(spark, folder):
    for name in ("p2_found", "p4_found", "p5_found", "p6_found"):
        df = registry.queries()[name](spark, folder)
        assert df.count() == df.distinct().count()


def test_extra_columns_and_order(spark, folder):
    s = table(spark, folder, "train_samples").withColumn("g", F.lit(1)).withColumn("place", F.lit("x"))
    assert top_per_group.top_n(s, "group_id", "reward", "sample_id", 4).columns == ["group_id", "sample_id", "reward", "place"]
