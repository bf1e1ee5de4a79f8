"""Problem 5: all pairs of texts that share at least 3/4 of the words of the longer one, counted with repetition.

Texts with the same words are collapsed to one class first. The universe of (word, occurrence) tokens is ordered by frequency, rarest
first, where a word's frequency is that of its bucket in a histogram of fixed size: any fixed order is right, a good one is fast.
Two alike texts share at least `least` tokens within the first (a - ceil(3a/4) + least) tokens of each. The universe is
partitioned by a hash into g segments; with least = g (t - 1) + 1 the pigeonhole principle says that the two share t tokens within one
segment of these prefixes. So each text is indexed by the t-subsets of each of its segments (of a segment of t tokens that is the
segment itself, of t + 1 tokens its one-deletion neighbourhood). Which g and t a band of text sizes gets is decided by cost:
the signatures to be made against the candidates expected from the histogram. Texts with an equal signature are
candidates; each candidate pair is verified on the words themselves. No link is lost, whatever the choice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmalake.sources.tables import split_name, table
from lemmalake.storage import materialize

BUCKETS = 1 << 16
#: Bands of text sizes, overlapping so that two alike texts always have one in common: the smallest whose end holds the longer.
ENDS = (4, 21, *(113 * 5**k for k in range(9)))
BANDS = tuple((1 if k == 0 else 3 * (ENDS[k - 1] + 1) // 4, e) for k, e in enumerate(ENDS))
#: (g, t) that a band can get, by band; all ask for at most as many shared words as the shortest alike texts of the band have.
CHOICES = (((1, 1),), ((1, 2), (2, 2), (1, 3)), ((4, 2), (8, 2), (3, 3), (4, 3)), *(((a // 8, 2), (a // 5, 2), (a // 12, 3), (a // 8, 3)) for a, _ in BANDS[3:]))
#: What a candidate pair costs, in signatures.
PAIR_COST = 0.5


def words(text: Column) -> Column:
    """The words of a text in lower case: the longest runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_hashes(lines: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words of lines of words set apart by blanks, and how many each line has."""
    cut = lines.str.split(" ")
    sizes = cut.str.len().to_numpy().astype(np.int64)
    flat = np.array([w for c in cut for w in c], dtype=object)
    return pd.util.hash_array(flat, categorize=True) if len(flat) else np.empty(0, dtype=np.uint64), sizes


def slices(batch: pd.DataFrame, column: str, chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """A batch in pieces of about so many characters, however long its texts are."""
    piece = (batch[column].str.len().cumsum() // chars).to_numpy()
    for k in np.unique(piece):
        yield batch[piece == k].reset_index(drop=True)


def bitmap(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """Which numbers the column has, modulo `bits` (a power of 2, 2^16 at least), packed. The driver gets bits / 2^16 rows of 8 KB, however many
    rows there are."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k = np.unique(b[column].to_numpy() % bits)
            at = np.nonzero(np.append(True, k[1:] >> 16 != k[:-1] >> 16))[0] if len(k) else np.empty(0, dtype=np.int64)
            packed = [pack(x) for x in np.split(k & 0xFFFF, at[1:])] if len(k) else []
            yield pd.DataFrame({"part": k[at] >> 16, "bits": np.array(packed, dtype=object)})

    def pack(k: np.ndarray) -> bytes:
        one = np.zeros(1 << 16, dtype=bool)
        one[k] = True
        return np.packbits(one).tobytes()

    def merged(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [x.part.iloc[0]], "bits": [np.bitwise_or.reduce([np.frombuffer(b, dtype=np.uint8) for b in x.bits]).tobytes()]})

    sets = rows.select(column).repartition(F.floor(F.pmod(column, F.lit(bits)) / 65536)).mapInPandas(parts, "part long, bits binary")
    out = np.zeros((bits >> 16, 1 << 13), dtype=np.uint8)
    for r in sets.groupBy("part").applyInPandas(merged, "part long, bits binary").toLocalIterator():
        out[r.part] = np.frombuffer(r.bits, dtype=np.uint8)
    return out.ravel()


def bits_for(n: int, least: int = 1 << 16, most: int = 1 << 27) -> int:
    """How many bits a bitmap of n numbers should have: about 16 for each, between two bounds."""
    return min(most, max(least, 1 << int(16 * n).bit_length()))


def in_bitmap(packed: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which numbers are in a bitmap, or may be."""
    k = numbers.view(np.int64) % (8 * len(packed))
    return (packed[k >> 3] >> (7 - (k & 7)).astype(np.uint8) & 1).astype(bool)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def classes(rows: DataFrame, sequence: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, text): one row a class of texts with the same words (rep, bag, size), and each record's class (id, rep).

    bag has the words in sorted order; rep is the smallest id. With sequence, seq has the words of one member in their own order.
    Null ids, null texts and texts without words are left out; a record delivered twice counts once.
    """
    rows = rows.where(F.col("id").isNotNull()).select("id", words(F.col("text")).alias("s")).where(F.size("s") > 0)
    rows = rows.select("id", "s", F.array_sort("s").alias("w"))
    texts = [F.array_join("w", " ").alias("bag")] + [F.array_join("s", " ").alias("seq")] * sequence
    keyed = rows.select("id", F.xxhash64("w").alias("a"), F.xxhash64(F.lit(17), "w").alias("b"), F.size("w").alias("size"), *texts)
    keyed = materialize(keyed, "words", compression="zstd")
    kept = ["bag"] + ["seq"] * sequence
    heads = keyed.groupBy("a", "b").agg(F.min("id").alias("rep"), F.first("size").alias("size"), *[F.first(c).alias(c) for c in kept])
    heads = materialize(heads, "classes", compression="zstd")
    members = keyed.select("id", "a", "b").distinct().join(heads.select("a", "b", "rep"), ["a", "b"]).select("id", "rep")
    return heads.select("rep", "size", *kept), members


def histogram(heads: DataFrame) -> np.ndarray:
    """How many word occurrences fall in each of BUCKETS buckets of words: a table of fixed size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            total += np.bincount((word_hashes(b.bag)[0] % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        hit = np.nonzero(total)[0]
        yield pd.DataFrame({"k": hit.astype(np.int32), "c": total[hit]})

    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in heads.select("bag").mapInPandas(count, "k int, c long").groupBy("k").agg(F.sum("c").alias("c")).toLocalIterator():
        out[r.k] = r.c
    return out


def parity(token: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits a row, each whether an odd number of its tokens fall on it: two rows differ in at least as many tokens as bits."""
    start = np.cumsum(sizes) - sizes
    bit = np.uint64(1) << (token & np.uint64(63))
    high = (token >> np.uint64(6) & np.uint64(1)).astype(bool)
    one, two = (np.bitwise_xor.reduceat(np.where(side, bit, np.uint64(0)), start) for side in (high, ~high))
    return one.view(np.int64), two.view(np.int64)


def occurrences(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The tokens (word, occurrence) of the words of each row, in which equal words stand together."""
    place = np.arange(len(h))
    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])) if len(h) else np.empty(0, dtype=bool)
    occurrence = place - np.maximum.accumulate(np.where(new, place, 0))
    with np.errstate(over="ignore"):
        return mix(h + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Prefixes:
    """The tokens of a batch of bags, each bag's rarest first."""

    def __init__(self, bags: pd.Series, counts: np.ndarray) -> None:
        h, self.sizes = word_hashes(bags)
        row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        token, often = occurrences(h, row), counts[(h % np.uint64(BUCKETS)).astype(np.int64)]  # bags are sorted
        order = np.lexsort((token, often, row))
        self.row, self.token, self.often = row, token[order], often[order]
        self.place = np.arange(len(h)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)

    def prefix(self, least: int) -> np.ndarray:
        """Which tokens are in the prefixes; every row that matters has at least `least` words to share."""
        need = -(-3 * self.sizes // 4)
        return self.place < np.repeat(self.sizes - need + least, self.sizes)


def expected(p: Prefixes, own: np.ndarray, g: int, t: int) -> tuple[float, float]:
    """Signatures expected of the rows `own` under (g, t), and the sum over them of the products of their tokens' counts.

    A row of k prefix tokens has about k^t / (t! g^(t-1)) t-subsets within segments."""
    inside = p.prefix(g * (t - 1) + 1)
    k = np.bincount(p.row[inside], minlength=len(p.sizes))[own].astype(float)
    c = np.bincount(p.row[inside], weights=p.often[inside], minlength=len(p.sizes))[own]
    ways = float(np.prod(np.arange(1, t + 1)) * g ** (t - 1))
    return float((k**t / ways).sum()), float((c**t / ways).sum())


def allocate(heads: DataFrame, counts: np.ndarray) -> list[tuple[int, int]]:
    """The (g, t) of each band with the least expected cost over all its texts."""
    sent = heads.sparkSession.sparkContext.broadcast(counts)  # BUCKETS entries
    def cost(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict[tuple[int, int], np.ndarray] = {}
        rows = 0
        for b in (s for batch in batches for s in slices(batch, "bag")):
            p = Prefixes(b.bag, sent.value)
            rows += len(b)
            for band, ((low, high), choices) in enumerate(zip(BANDS, CHOICES, strict=True)):
                own = (p.sizes >= low) & (p.sizes <= high)
                for k, (g, t) in enumerate(choices if own.any() and len(choices) > 1 else ()):
                    out[band, k] = out.get((band, k), np.zeros(2)) + expected(p, own, g, t)
        yield pd.DataFrame([(-1, 0, float(rows), 0.0)] + [(b, k, *v) for (b, k), v in out.items()], columns=["band", "k", "signatures", "pairs"])

    found = heads.select("bag").mapInPandas(cost, "band int, k int, signatures double, pairs double").groupBy("band", "k").agg(F.sum("signatures").alias("s"), F.sum("pairs").alias("p")).collect()  # a row a choice
    rows = next((r.s for r in found if r.band == -1), 0.0)
    # another row has a token of count c with probability c / rows, a subset of t tokens with the product of these
    costs = {(r.band, r.k): r.s + PAIR_COST * r.p / 2 * max(rows, 1.0) ** (1 - CHOICES[r.band][r.k][1]) for r in found if r.band >= 0}
    return [min(enumerate(c), key=lambda kc, b=b: costs.get((b, kc[0]), 0.0))[1] for b, c in enumerate(CHOICES)]


def signatures(heads: DataFrame, counts: np.ndarray, chosen: list[tuple[int, int]], other: np.ndarray | None = None) -> DataFrame:
    """(sig, rep, size, one, two): the t-subsets of the segments of each text's prefix, for each band that it belongs to, with the
    text's size and parity bits. other: a bitmap of the other side's signatures, if there is another side, whose words alone the counts
    then hold; only signatures that may be there are given."""
    sent = heads.sparkSession.sparkContext.broadcast((counts, other))  # BUCKETS entries, the bits of a bitmap

    sided = other is not None

    def of_band(p: Prefixes, band: int, low: int, high: int, g: int, t: int) -> tuple[np.ndarray, np.ndarray]:
        inside = p.prefix(g * (t - 1) + 1) & ((p.sizes >= low) & (p.sizes <= high))[p.row]
        if sided:
            inside &= p.often > 0
        row, token = p.row[inside], p.token[inside]
        segment = (token >> np.uint64(40)) % np.uint64(g)
        order = np.lexsort((token, segment, row))
        row, token, group = row[order], token[order], (row.astype(np.int64) * g + segment.astype(np.int64))[order]
        start = np.nonzero(np.append(True, group[1:] != group[:-1]))[0] if len(group) else np.empty(0, dtype=np.int64)
        sizes = np.diff(np.append(start, len(group)))
        sig, of = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
        for n in np.unique(sizes[sizes >= t]):
            at, picks = start[sizes == n], np.array(list(combinations(range(n), t)))
            s = np.full((len(at), len(picks)), (band + 1) * 0x9E3779B1, dtype=np.uint64)
            for k in range(t):
                with np.errstate(over="ignore"):
                    s = mix(s + token[at[:, None] + picks[None, :, k]])
            sig.append(s.ravel()), of.append(np.repeat(row[at], len(picks)))
        return np.concatenate(sig), np.concatenate(of)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (s for batch in batches for s in slices(batch, "bag")):
            p = Prefixes(b.bag, sent.value[0])
            rep, size, (one, two) = b.rep.to_numpy(), b["size"].to_numpy(), parity(p.token, p.sizes)
            for band, ((low, high), (g, t)) in enumerate(zip(BANDS, chosen, strict=True)):
                sig, of = of_band(p, band, low, high, g, t)
                if sided:
                    may = in_bitmap(sent.value[1], sig)
                    sig, of = sig[may], of[may]
                yield pd.DataFrame({"sig": sig.view(np.int64), "rep": rep[of], "size": size[of], "one": one[of], "two": two[of]})

    return heads.select("rep", "size", "bag").mapInPandas(make, "sig long, rep long, size int, one long, two long")


def shared_words(a: pd.Series, b: pd.Series) -> np.ndarray:
    """How many words, counted with repetition, two bags have in common."""
    from collections import Counter

    kept: dict[str, Counter] = {}

    def count(bag: str) -> Counter:
        if (c := kept.get(bag)) is None:
            if len(kept) > 20_000:
                kept.clear()
            c = kept[bag] = Counter(bag.split(" "))
        return c

    return np.fromiter((sum((count(x) & count(y)).values()) for x, y in zip(a, b, strict=True)), dtype=np.int64, count=len(a))


def alike(candidates: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Of candidate pairs (x, y), those whose bags (rep, bag, size of left and right) share 3/4 of the words of the longer."""
    joined = candidates.join(left.select(F.col("rep").alias("x"), F.col("bag").alias("bag_x"), F.col("size").alias("size_x")), "x")
    joined = joined.join(right.select(F.col("rep").alias("y"), F.col("bag").alias("bag_y"), F.col("size").alias("size_y")), "y")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            common, longer = shared_words(b.bag_x, b.bag_y), np.maximum(b.size_x, b.size_y)
            yield b.loc[4 * common >= 3 * longer, ["x", "y"]].assign(common=common[4 * common >= 3 * longer], longer=longer[4 * common >= 3 * longer])

    return joined.mapInPandas(keep, "x long, y long, common long, longer long")


def meeting(left: DataFrame, right: DataFrame, which: Column | None = None) -> DataFrame:
    """Distinct pairs (x, y) of texts with a common signature that can be alike by their parity bits."""
    x, y = (sig.select("sig", *[F.col(c).alias(f"{c}_{r}") for c in ("rep", "size", "one", "two")]) for r, sig in (("x", left), ("y", right)))
    differ = F.bit_count(F.col("one_x").bitwiseXOR(F.col("one_y"))) + F.bit_count(F.col("two_x").bitwiseXOR(F.col("two_y")))
    # texts of sizes a and b that share 3/4 of the longer differ in at most a + b - 3/2 max(a, b) tokens
    near = 2 * differ <= 2 * (F.col("size_x") + F.col("size_y")) - 3 * F.greatest("size_x", "size_y")
    both = x.join(y, "sig").where(near if which is None else which & near)
    return both.select(F.col("rep_x").alias("x"), F.col("rep_y").alias("y")).distinct()


def similar(heads: DataFrame) -> DataFrame:
    """(x, y, common, longer), x < y: all pairs of different classes that are alike."""
    counts = histogram(heads)
    sig = signatures(heads, counts, allocate(heads, counts))
    return alike(meeting(sig, sig, F.col("rep_x") < F.col("rep_y")), heads, heads)


def training_records(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text) of the training statements and the conjectures."""
    s, c = table(spark, folder, "statements"), table(spark, folder, "conjectures")
    s = s.where(split_name(F.col("split")) == "train").select(F.col("rec_id").alias("id"), F.col("theorem").alias("text"))
    return s.unionByName(c.select(F.col("rec_id").alias("id"), F.col("conjecture").alias("text")))


def id_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of records, smaller first, of pairs of classes."""
    x, y = (members.select(F.col("id").alias(f"id_{r}"), F.col("rep").alias(r)) for r in "xy")
    both = pairs.select("x", "y").join(x, "x").join(y, "y")
    return both.select(F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    heads, members = classes(training_records(spark, folder))
    members = materialize(members, "members")
    x, y = members.withColumnRenamed("id", "id_a"), members.withColumnRenamed("id", "id_b")
    copies = x.join(y, "rep").where("id_a < id_b").select("id_a", "id_b")
    return id_pairs(similar(heads), members).unionByName(copies)


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each training record: the smallest id with the same words, and how many different texts are alike to it."""
    heads, members = classes(training_records(spark, folder))
    pairs = similar(heads).select(F.explode(F.array("x", "y")).alias("rep"))
    links = pairs.groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(links, "rep", "left").select(F.col("id").alias("rec_id"), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p5_found": p5_found, "p5_classes": p5_classes}
#: Words numbered by occurrence, compared with all others: for small tables.
TRAINING = "SELECT rec_id, theorem AS x FROM statements WHERE lower(trim(split)) = 'train' UNION SELECT rec_id, conjecture FROM conjectures"
ALIKE = """o AS (SELECT side, rec_id, word, row_number() OVER (PARTITION BY rec_id, word) AS k
        FROM (SELECT side, rec_id, unnest(regexp_extract_all(lower(x), '[\\p{L}\\p{N}]+')) AS word FROM rec WHERE x IS NOT NULL)),
    n AS (SELECT rec_id, count(*) AS n FROM o GROUP BY 1),
    p AS (SELECT a.rec_id AS i, b.rec_id AS j, count(*) AS c FROM o AS a JOIN o AS b ON a.word = b.word AND a.k = b.k AND {which} GROUP BY ALL)
    SELECT least(i, j) AS id_a, greatest(i, j) AS id_b FROM p JOIN n AS x ON x.rec_id = i JOIN n AS y ON y.rec_id = j WHERE 4 * c >= 3 * greatest(x.n, y.n)"""
SQL = {
    "p5_found": f"WITH rec AS (SELECT 1 AS side, * FROM ({TRAINING})), " + ALIKE.replace("{which}", "a.rec_id < b.rec_id"),
    "p5_classes": f"""WITH w AS (SELECT rec_id, list_sort(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}]+')) AS l FROM ({TRAINING}) WHERE x IS NOT NULL),
        m AS (SELECT rec_id, l, min(rec_id) OVER (PARTITION BY l) AS class_id FROM w WHERE len(l) > 0),
        o AS (SELECT rec_id, word, row_number() OVER (PARTITION BY rec_id, word) AS k FROM (SELECT rec_id, unnest(l) AS word FROM m WHERE rec_id = class_id)),
        p AS (SELECT a.rec_id AS i, b.rec_id AS j, count(*) AS c FROM o AS a JOIN o AS b ON a.word = b.word AND a.k = b.k AND a.rec_id <> b.rec_id GROUP BY ALL),
        n AS (SELECT i, count(*) AS links FROM p JOIN m AS x ON x.rec_id = i JOIN m AS y ON y.rec_id = j WHERE 4 * c >= 3 * greatest(len(x.l), len(y.l)) GROUP BY i)
        SELECT rec_id, class_id, coalesce(links, 0) AS links FROM m LEFT JOIN n ON i = class_id""",
}
