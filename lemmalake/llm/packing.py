"""Problem 1: items of varying length laid into rows of fixed capacity with as little room left over as possible.

The configuration linear program (least number of rows over all patterns of lengths that fit) depends on the histogram of
lengths alone, which has at most `capacity` entries however many items there are. It is solved on the driver by
multiplicative weights: each length has a weight that falls as it is covered, and the best patterns under the weights are priced by
an unbounded-knapsack dynamic program, until every length is covered. The fractional solution is rounded; the few items that
remain are laid by the fullest patterns of what is left. The result is a plan of bounded size. The items are ranked within their length by Spark (salted, so
that no length is ranked in one task), and each finds its row and place in the plan by its rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lemmalake.sources.tables import table
from lemmalake.storage import materialize


def best_patterns(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The unbounded knapsack: of each room 0 to capacity the greatest value of lengths that fit, and the last length of one such
    pattern (0: one place stays empty). sizes is sorted."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    fit = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fit[c]:
            with_k = value[: fit[c]] + best[c - sizes[: fit[c]]]
            k = with_k.argmax()
            if with_k[k] > best[c]:
                best[c], last[c] = with_k[k], sizes[k]
    return best, last


def pattern_of(last: np.ndarray, room: int, capacity: int) -> np.ndarray:
    """Counts by length of the best pattern of a room."""
    counts = np.zeros(capacity, dtype=np.int64)
    while room > 0:
        if last[room]:
            counts[last[room] - 1] += 1
        room -= max(1, last[room])
    return counts


def fullest_pattern(left: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of the fullest pattern of the items left, which has the longest one of them; among equals, long lengths first."""
    counts = np.zeros(capacity, dtype=np.int64)
    longest = int(np.nonzero(left)[0][-1]) + 1
    counts[longest - 1] = 1
    room = capacity - longest
    if room:
        # made[c] is the length whose use first reached the sum c, and used[c] how many of that length are in it
        made, used = np.full(room + 1, -1), np.zeros(room + 1, dtype=np.int64)
        made[0] = 0
        for size in np.nonzero(left[:room])[0][::-1] + 1:
            most = left[size - 1] - counts[size - 1]
            used[:] = 0
            for c in range(size, room + 1):
                if made[c] < 0 and made[c - size] >= 0 and used[c - size] < most:
                    made[c], used[c] = size, used[c - size] + 1
            if made[room] >= 0:
                break
        c = int(np.nonzero(made >= 0)[0][-1])
        while c:
            counts[made[c] - 1] += 1
            c -= made[c]
    return counts


def fractional(histogram: np.ndarray, capacity: int, eta: float = 0.1, together: int = 16, slack: float = 0.97) -> tuple[list[np.ndarray], np.ndarray, float]:
    """The covering linear program by multiplicative weights: patterns, how often each is used, and a lower bound on the rows.

    Every length is covered when it ends. A length's price is its own number of tokens, which alone gives the bound by volume, times
    a weight that falls by exp(-1) for each `eta` of its items that are covered. Of each knapsack the best pattern is taken and, for
    the `together` lengths covered least, the best ones that have them, if they are worth `slack` of it. The bound is the best of the
    dual solutions that the prices are.
    """
    has = histogram > 0
    sizes, need = np.nonzero(has)[0] + 1, np.where(has, histogram, 1).astype(float)
    covered, found, bound = np.zeros(capacity), {}, 0.0
    while (covered[has] < 1).any():
        price = np.where(has, np.arange(1, capacity + 1) * np.exp((covered[has].min() - covered) / eta), 0.0)
        best, last = best_patterns(price[sizes - 1], sizes, capacity)
        bound = max(bound, float((price * histogram).sum() / best[-1]))
        before = covered.copy()
        for size in (0, *sizes[np.argsort(covered[sizes - 1], kind="stable")][:together]):
            if size and (covered[size - 1] > before[size - 1] or price[size - 1] + best[capacity - size] < slack * best[-1]):
                continue
            pattern = pattern_of(last, capacity - size, capacity)
            if size:
                pattern[size - 1] += 1
            pattern = np.minimum(pattern, histogram)
            own = pattern > 0
            if (covered - before)[own].max() > eta:  # these prices don't hold any more
                continue
            step = (eta * need[own] / pattern[own]).min()
            found[pattern.tobytes()] = found.get(pattern.tobytes(), 0.0) + step
            covered += step * pattern / need
    times = np.array(list(found.values())) / (covered[has].min() if has.any() else 1.0)
    return [np.frombuffer(k, dtype=np.int64) for k in found], times, bound


def rounded(histogram: np.ndarray, patterns: list[np.ndarray], times: np.ndarray, carried: float) -> tuple[list[tuple[np.ndarray, int]], int]:
    """A plan from patterns in their order and how often each should be used, and how many items these patterns lay.

    The times are rounded by their running sum, which begins at `carried`, so that the number of rows stays: patterns used 0.3 times
    give a row about every third time. A length that is covered more often than it has items ends the use of its patterns.
    What remains is laid by the fullest patterns of what is left."""
    left = histogram.copy()
    plan: list[tuple[np.ndarray, int]] = []
    for pattern, x in zip(patterns, times, strict=True):
        carried += x
        n = int(min(int(carried), (left[pattern > 0] // pattern[pattern > 0]).min()))
        carried -= int(carried)
        if n:
            plan.append((pattern, n))
            left -= n * pattern
    by_program = int(histogram.sum() - left.sum())
    while left.any():
        pattern = fullest_pattern(left, len(left))
        n = int((left[pattern > 0] // pattern[pattern > 0]).min())
        plan.append((pattern, n))
        left -= n * pattern
    return plan, by_program


def solve(histogram: np.ndarray, capacity: int, told: dict | None = None) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, so that every item of the histogram is in exactly one row.

    histogram[k] is the number of items of length k + 1, up to the capacity; those of the capacity have rows of their own. Of several roundings of the fractional solution the one
    with the fewest rows is taken. Patterns that leave a tenth more room than rows leave at the bound aren't used. told, if given,
    gets the lower bound and the share of the shorter items that the linear program laid.
    """
    full = int(histogram[-1])
    histogram, lengths = np.append(histogram[:-1], 0).astype(np.int64), np.arange(1, capacity + 1)
    patterns, times, bound = fractional(histogram, capacity)
    room = 1.1 * (capacity - (histogram * lengths).sum() / max(bound, 1.0)) + 1e-6
    used = [k for k, p in enumerate(patterns) if capacity - (p * lengths).sum() <= room]
    tried = []
    for order in (used, sorted(used, key=lambda k: -np.nonzero(patterns[k])[0][-1])):
        for carried, share in ((0.0, 1.0), (0.5, 1.0), (0.75, 1.0), (0.5, 0.95), (0.5, 0.8)):
            tried.append(rounded(histogram, [patterns[k] for k in order], share * times[order], carried))
    plan, by_program = min(tried, key=lambda t: (sum(n for _, n in t[0]), -t[1]))
    if told is not None:
        told |= {"bound": bound + full, "lp_items": by_program / max(1, int(histogram.sum()))}
    return plan + [((lengths == capacity).astype(np.int64), full)] * (full > 0)


def pack(items: DataFrame, capacity: int, slice_rows: int = 200_000, told: dict | None = None) -> DataFrame:
    """Lays items (id long, n int) into rows of the capacity: (id, piece, row_id, place, n_tokens).

    An item longer than the capacity is split into full rows (pieces 0, 1, ...) and a rest, which is laid like an item; others have
    piece 0 alone. place is the 0-based offset in the row. Items without tokens (null or 0) take no room and stand at place 0
    of row 0. Rows with a null id are left out. Ids must be unique. An empty table gives no rows.
    slice_rows: about so many items of one length are ranked in one task; told: see solve().
    """
    spark = items.sparkSession
    items = items.where(F.col("id").isNotNull()).select("id", F.coalesce(F.col("n").cast("int"), F.lit(0)).alias("n"))
    n, full = F.col("n"), F.floor(F.col("n") / capacity).cast("int")
    rest = F.when((n % capacity > 0) | (n == 0), F.array(F.struct(full.alias("piece"), (n % capacity).cast("int").alias("n"))))
    wholes = F.when(full > 0, F.transform(F.sequence(F.lit(0), full - 1), lambda k: F.struct(k.alias("piece"), F.lit(capacity).alias("n"))))
    nothing = F.array().cast("array<struct<piece:int,n:int>>")
    pieces = items.select("id", F.inline(F.concat(F.coalesce(wholes, nothing), F.coalesce(rest, nothing))))
    pieces = materialize(pieces, "pieces")
    histogram = np.zeros(capacity, dtype=np.int64)
    for r in pieces.where("n > 0").groupBy("n").count().collect():  # at most `capacity` rows
        histogram[r.n - 1] = r["count"]
    slices = max(1, -(-int(histogram.max()) // slice_rows))
    salted = pieces.withColumn("slice", F.pmod(F.xxhash64("id", "piece"), F.lit(slices)).cast("int"))
    before = salted.groupBy("n", "slice").agg(F.count("*").alias("c"))
    before = before.withColumn("before", F.sum("c").over(Window.partitionBy("n").orderBy("slice")) - F.col("c")).drop("c")
    ranked = salted.withColumn("k", F.row_number().over(Window.partitionBy("n", "slice").orderBy("id", "piece")) - 1)
    ranked = ranked.join(before, ["n", "slice"]).select("id", "piece", "n", (F.col("k") + F.col("before")).alias("rank"))

    starts: dict[int, list[tuple[int, int, int, int]]] = {}
    row, seen = 0, dict.fromkeys(range(1, capacity + 1), 0)
    for pattern, times in solve(histogram, capacity, told):
        offset = 0
        for k in np.nonzero(pattern)[0][::-1]:
            size, many = int(k) + 1, int(pattern[k])
            starts.setdefault(size, []).append((seen[size], many, row, offset))
            seen[size] += many * times
            offset += many * size
        row += times
    plan = spark.sparkContext.broadcast({k: np.array(v, dtype=np.int64) for k, v in starts.items()})  # at most a few patterns a length

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size, rank = b.n.to_numpy(), b["rank"].to_numpy()
            at_row, place = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            for s in np.unique(size[size > 0]):
                own = np.nonzero(size == s)[0]
                t = plan.value[int(s)]
                use = t[np.searchsorted(t[:, 0], rank[own], side="right") - 1]
                k = rank[own] - use[:, 0]
                at_row[own] = use[:, 2] + k // use[:, 1]
                place[own] = use[:, 3] + (k % use[:, 1]) * s
            yield pd.DataFrame({"id": b.id, "piece": b.piece, "row_id": at_row, "place": place.astype(np.int32), "n_tokens": size})

    return ranked.mapInPandas(lay, "id long, piece int, row_id long, place int, n_tokens int")


CAPACITY = 512


def sample_sizes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "train_samples").select(F.col("sample_id").alias("id"), F.size("gen_tokens").alias("n"))
    return rows.groupBy("id").agg(F.greatest(F.max("n"), F.lit(0)).alias("n"))


def p1_pack(spark: SparkSession, folder: str) -> DataFrame:
    """The training row and place of every sample, or piece of one, of train_samples."""
    return pack(sample_sizes(spark, folder), CAPACITY).withColumnRenamed("id", "sample_id")


def p1_room(spark: SparkSession, folder: str) -> DataFrame:
    """One row for all training rows: how many there are, their tokens, the share of their room that is used, the linear program's lower
    bound on the rows (of pieces shorter than a row), and the share of these pieces that its patterns lay."""
    told: dict = {}
    rows = pack(sample_sizes(spark, folder), CAPACITY, told=told).where("n_tokens > 0").groupBy("row_id").agg(F.sum("n_tokens").alias("t"))
    used = F.round(F.sum("t") / (F.count("*") * CAPACITY), 6)
    bound, share = F.lit(round(told["bound"], 3)), F.lit(round(told["lp_items"], 4))
    return rows.agg(F.count("*").alias("n_rows"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"), used.alias("used_share"), bound.alias("bound_rows"), share.alias("lp_share"))


def p1_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """What any packing must give: the pieces, their tokens, and the least rows by volume; and whether this one has at most 1 % more (and one) rows
    and no row is overfull."""
    laid = pack(sample_sizes(spark, folder), CAPACITY)
    rows = laid.groupBy("row_id").agg(F.count("*").alias("p"), F.sum("n_tokens").cast("long").alias("t"))
    least = F.ceil(F.sum("t") / CAPACITY)
    near = (F.count_if(F.col("t") > 0) <= 1.01 * least + 1) & (F.max("t") <= CAPACITY)
    return rows.agg(F.sum("p").alias("n_pieces"), F.sum("t").alias("n_tokens"), least.alias("least_rows"), near.alias("near_least"))


QUERIES = {"p1_pack": p1_pack, "p1_room": p1_room, "p1_bounds": p1_bounds}
SQL = {
    "p1_bounds": f"""WITH s AS (SELECT sample_id, greatest(max(coalesce(len(gen_tokens), 0)), 0) AS n FROM train_samples GROUP BY 1)
        SELECT sum(greatest(ceil(n / {CAPACITY}), 1))::BIGINT AS n_pieces, sum(n)::BIGINT AS n_tokens, ceil(sum(n) / {CAPACITY})::BIGINT AS least_rows, true AS near_least FROM s"""
}
