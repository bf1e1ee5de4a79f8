"""Problem 4: evaluation texts that also stand, exactly or almost, in the training split.

The evaluation texts are laid into shards of bounded size, each with a compressed full-text index over its words: the Burrows-Wheeler
transform as a bit-packed wavelet matrix, which takes as many bits a word as the shard's vocabulary needs, and a sampled suffix array.
The training texts stream through the shards by backward search, all ends of a batch at a time. From each end the search goes
back until the words passed carry `bits` of information by the words' frequencies, which depends on the training text alone: so every
evaluation text that has those words is found, also next to longer matches in others. The hits of a pair that lie side by
side are merged into maximal spans and counted; pairs with spans are checked exactly, word by word.

A text goes to the shards of the words of its prefix, in the fixed order by frequency (see `similar`), as far as the evaluation
texts have these words: two alike texts share a word of their prefixes, so they meet in a shard, and the work doesn't grow with the
product of the two sides. Training texts of which no run of words can carry the bits, as a bitmap of the evaluation texts'
n-grams shows, aren't sent at all. A shard that many texts share is split into blocks, and the training texts of it go to each.

Alike texts need not share a run that carries the bits: they may be short, reordered or edited evenly. The signatures of problem 5, across
the sides, give the pairs that are left, so that no pair is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmalake.llm.similar import ALIKE, BUCKETS, TRAINING, Prefixes, alike, allocate, bitmap, bits_for, classes, histogram, in_bitmap, meeting, mix, occurrences, parity, signatures, slices, training_records, word_hashes
from lemmalake.sources.tables import split_name, table
from lemmalake.storage import materialize, new_table

SAMPLED = 8
#: The information, in bits, that the words of a match must carry.
BITS = 34.0
#: Words of evaluation texts in a shard, about.
SHARD_WORDS = 2_000_000
#: The n-grams of evaluation texts that the bitmap has.
GRAMS = (2, 4)
INDEX = "shard int, block int, vocabulary binary, transform binary, marked binary, places binary, starts binary, reps binary, sizes binary, one binary, two binary"


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, k = len(text), 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank[order] = np.cumsum(np.append(0, sorted_key[1:] != sorted_key[:-1]))
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        k *= 2


def word_bits(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parity bits of texts' words."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return parity(occurrences(hashes[np.lexsort((hashes, row))], row), sizes)


class Wavelet:
    """A sequence of n numbers as bits, one row a level from the highest bit: at each level the numbers with a 0 go before those with a 1,
    in their order. Counting the ones before a place leads from level to level."""

    def __init__(self, words: np.ndarray, n: int) -> None:
        ones = np.bitwise_count(words)
        self.words, self.before = words, np.cumsum(ones, axis=1, dtype=np.int32) - ones
        self.zeros = n - ones.sum(axis=1, dtype=np.int64)

    @staticmethod
    def pack(sequence: np.ndarray, levels: int) -> np.ndarray:
        out = np.zeros((levels, len(sequence) // 64 + 1), dtype=np.uint64)
        for k in range(levels):
            bit = (sequence >> (levels - 1 - k) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            out[k].view(np.uint8)[: len(packed)] = packed
            sequence = np.concatenate((sequence[~bit], sequence[bit]))
        return out

    def step(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ones stand before places, and the words of the places shifted to them."""
        word, bit = self.words[level][at >> 6], (at & 63).astype(np.uint64)
        return self.before[level][at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64), word >> bit

    def follow(self, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where places lead to on the way of a number."""
        levels = len(self.words)
        for k in range(levels):
            ones, _ = self.step(k, at)
            at = np.where(number >> (levels - 1 - k) & 1, self.zeros[k] + ones, at - ones)
        return at

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at places, and where the places lead to."""
        number = np.zeros(len(at), dtype=np.int64)
        for k in range(len(self.words)):
            ones, word = self.step(k, at)
            bit = (word & np.uint64(1)).astype(np.int64)
            number, at = number << 1 | bit, np.where(bit, self.zeros[k] + ones, at - ones)
        return number, at


class FullTextIndex:
    """Backward search over the words of a shard's texts; a text ends with the separator 0."""

    def __init__(self, row: pd.Series) -> None:
        get = lambda c, t: np.frombuffer(row[c], dtype=t)
        self.vocabulary, self.places, self.starts, self.reps = get("vocabulary", np.uint64), get("places", np.int32), get("starts", np.int32), get("reps", np.int64)
        self.sizes, self.one, self.two = get("sizes", np.int32), get("one", np.int64), get("two", np.int64)
        self.n = int(self.sizes.sum() + len(self.sizes))
        self.marked = np.unpackbits(get("marked", np.uint8)).astype(bool)[: self.n]
        self.before = np.append(0, np.cumsum(self.marked))
        self.transform = Wavelet(get("transform", np.uint64).reshape(-1, self.n // 64 + 1), self.n)
        numbers = np.arange(len(self.vocabulary) + 2)
        # where a number's places begin on its way, and how many places have smaller numbers
        self.begin = self.transform.follow(numbers, np.zeros(len(numbers), dtype=np.int64))
        many = self.transform.follow(numbers, np.full(len(numbers), self.n)) - self.begin
        self.smaller = np.cumsum(many) - many

    @staticmethod
    def build(lines: pd.Series, reps: np.ndarray) -> dict[str, bytes]:
        hashes, sizes = word_hashes(lines)
        vocabulary, number = np.unique(hashes, return_inverse=True)
        starts = np.cumsum(sizes + 1) - sizes - 1
        text = np.zeros(int(sizes.sum() + len(sizes)), dtype=np.int64)
        at = np.arange(len(hashes)) + np.repeat(np.arange(len(sizes)), sizes)
        text[at] = number + 1
        sa = suffix_array(text)
        last = text[sa - 1]  # the transform: the word before each suffix
        sample = np.arange(len(text)) % SAMPLED == 0
        sample[starts] = True  # so that no walk back passes a separator, of which the order isn't kept
        marked = sample[sa]
        one, two = word_bits(hashes, sizes)
        transform = Wavelet.pack(last, (len(vocabulary) + 1).bit_length())
        arrays = {"vocabulary": vocabulary, "transform": transform, "marked": np.packbits(marked), "places": sa[marked].astype(np.int32), "starts": starts.astype(np.int32), "reps": reps.astype(np.int64), "sizes": sizes.astype(np.int32), "one": one, "two": two}
        return {k: v.tobytes() for k, v in arrays.items()}

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The shard's numbers of words; -1 for words that it doesn't have."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, -1)

    def back(self, number: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How the bound of an interval moves when a word is put in front."""
        return self.smaller[number] + self.transform.follow(number, place) - self.begin[number]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of these rows begin."""
        steps, rows = np.zeros(len(rows), dtype=np.int64), rows.copy()
        while (todo := np.nonzero(~self.marked[rows])[0]).size:
            number, place = self.transform.read(rows[todo])
            rows[todo] = self.smaller[number] + place - self.begin[number]
            steps[todo] += 1
        return self.places[self.before[rows]] + steps

    def runs(self, number: np.ndarray, bits: np.ndarray, row: np.ndarray, least: float, ends: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """For every end in the words of a batch (of `ends`, if given) the shortest run of words up to it that carries `least` bits, if it occurs in the
        shard: (place of its first word in the batch, its length, its interval's first row, how many times it occurs), in order of places."""
        end = np.nonzero((number > 0) if ends is None else (number > 0) & ends)[0]
        low, high = self.smaller[number[end]], self.smaller[number[end] + 1]
        carried, at = bits[end], end.copy()
        found = [(np.empty(0, dtype=np.int64),) * 4]
        while len(end):
            full = (high > low) & (carried >= least)
            if full.any():
                found.append((at[full], end[full] - at[full] + 1, low[full], high[full] - low[full]))
            go = (high > low) & ~full & (at > 0)
            go[go] = (row[at[go] - 1] == row[at[go]]) & (number[at[go] - 1] > 0)
            end, at = end[go], at[go] - 1
            low, high = np.split(self.back(np.tile(number[at], 2), np.concatenate((low[go], high[go]))), 2)
            carried = carried[go] + bits[at]
        at, size, low, count = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        return at[order], size[order], low[order], count[order]

    def hits(self, number: np.ndarray, bits: np.ndarray, row: np.ndarray, least: float, ends: np.ndarray | None = None, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, ...]]:
        """All occurrences of the runs of a batch: (place in the batch, length, place in the shard). About `most` at a time, the rows whole."""
        at, size, low, count = self.runs(number, bits, row, least, ends)
        per_row = np.bincount(row[at], weights=count).astype(np.int64) if len(at) else np.empty(0, dtype=np.int64)
        part = (np.cumsum(per_row) // most)[row[at]] if len(at) else at
        for k in np.unique(part):
            own = part == k
            n = count[own]
            rows = np.repeat(low[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(at[own], n), np.repeat(size[own], n), self.locate(rows)


def merged(row: np.ndarray, text: np.ndarray, at: np.ndarray, size: np.ndarray, there: np.ndarray) -> pd.DataFrame:
    """Hits that overlap or touch on one diagonal, merged into maximal spans; by (row, text) the words in spans, the spans and the longest."""
    diagonal = there - at
    order = np.lexsort((at, diagonal, text, row))
    row, text, diagonal, at, end = row[order], text[order], diagonal[order], at[order], (at + size)[order]
    new = np.append(True, (row[1:] != row[:-1]) | (text[1:] != text[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] > end[:-1]))
    start = np.nonzero(new)[0]
    spans = pd.DataFrame({"row": row[start], "text": text[start], "n": np.maximum.reduceat(end, start) - at[start]})
    return spans.groupby(["row", "text"], as_index=False, sort=False).agg(matched=("n", "sum"), spans=("n", "size"), longest=("n", "max"))


def gram_keys(hashes: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every n-gram of texts' words, and the place of its first word."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    start = np.nonzero(row[: max(0, len(row) - n + 1)] == row[n - 1 :])[0]
    key = np.full(len(start), n, dtype=np.uint64)
    for k in range(n):
        with np.errstate(over="ignore"):
            key = mix(key + hashes[start + k])
    return key.view(np.int64), start


def gram_bitmap(held_out: DataFrame) -> np.ndarray:
    """Which n-grams evaluation texts have."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (s for batch in batches for s in slices(batch, "seq")):
            yield pd.DataFrame({"k": np.unique(np.concatenate([gram_keys(*word_hashes(b.seq), n)[0] for n in GRAMS]))})

    grams = materialize(held_out.select("seq").mapInPandas(keys, "k long"), "held-out-grams")
    return bitmap(grams, "k", bits_for(grams.count()))


def possible_ends(hashes: np.ndarray, sizes: np.ndarray, counts: np.ndarray, packed: np.ndarray, bits: float) -> np.ndarray:
    """Which words end a run within their text that carries `bits` and of which the bitmap has all n-grams."""
    bucket, place = (hashes % np.uint64(BUCKETS)).astype(np.int64), np.arange(len(hashes))

    def first_after(broken: np.ndarray, words: int) -> np.ndarray:
        """For each end the first start after all broken n-grams that end there or before; n-grams past a text's end are broken."""
        after = np.maximum.accumulate(np.where(broken, place + 1, 0))
        return np.append(np.zeros(words - 1, dtype=np.int64), after)[: len(place)]

    start = first_after(counts[bucket] == 0, 1)
    for n in GRAMS:
        broken = np.ones(len(hashes), dtype=bool)
        key, at = gram_keys(hashes, sizes, n)
        broken[at] = ~in_bitmap(packed, key)
        start = np.maximum(start, first_after(broken, n))
    total = np.append(0.0, np.cumsum(weights_of(counts)[bucket]))
    return total[1:] - total[np.minimum(start, place + 1)] >= bits - 1e-6


def weights_of(counts: np.ndarray) -> np.ndarray:
    """The information, in bits, of the words of each bucket."""
    return np.log2(max(1, int(counts.sum())) / np.maximum(1, counts))


def routes(heads: DataFrame, counts: np.ndarray, shards: int, packed: np.ndarray | None = None, bits: float = 0.0) -> DataFrame:
    """(rep, seq, size, shard): the shards that each text goes to, which are those of the words of its prefix that the counts have. packed: a
    bitmap of n-grams; only texts that can have a match of so many bits go anywhere."""
    sent = heads.sparkSession.sparkContext.broadcast((counts, packed))  # BUCKETS entries, the bits of a bitmap

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, packed = sent.value
        for b in (s for batch in batches for s in slices(batch, "seq")):
            if packed is not None:
                hashes, sizes = word_hashes(b.seq)
                ends = possible_ends(hashes, sizes, counts, packed, bits)
                b = b[np.bincount(np.repeat(np.arange(len(b)), sizes), weights=ends, minlength=len(b)) > 0].reset_index(drop=True)
            if len(b):
                p = Prefixes(b.bag, counts)
                inside = p.prefix(1) & (p.often > 0)
                to = pd.DataFrame({"k": p.row[inside], "shard": (p.token[inside] % np.uint64(shards)).astype(np.int32)}).drop_duplicates()
                yield pd.DataFrame({"rep": b.rep.to_numpy()[to.k], "seq": b.seq.to_numpy()[to.k], "size": b["size"].to_numpy()[to.k], "shard": to.shard})

    return heads.select("rep", "seq", "size", "bag").mapInPandas(run, "rep long, seq string, size int, shard int")


def overlaps(held_out: DataFrame, training: DataFrame, bits: float = BITS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(x, y, matched, spans, longest): training class x and evaluation class y with matches; words in spans, spans, longest span.
    Pairs whose parity bits show that they can't be alike are left out.

    held_out and training are classes (rep, size, bag, seq). A pair of which no run of shared words carries `bits` isn't found here,
    see signed() for these. Either side may be empty, which gives no rows.
    """
    spark = held_out.sparkSession
    counts = histogram(held_out)
    shards = -(-max(1, int(counts.sum())) // shard_words)
    there = routes(held_out, counts, shards)
    blocks = there.groupBy("shard").agg(F.ceil(F.sum("size") / F.lit(2.0 * shard_words)).cast("int").alias("blocks"))
    blocks = materialize(blocks, "blocks")
    placed = there.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

    def build(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("rep")
        return pd.DataFrame([{"shard": shard.shard.iloc[0], "block": shard.block.iloc[0], **FullTextIndex.build(shard.seq, shard.rep.to_numpy())}])

    path = new_table(spark, "full-text-index")
    placed.select("shard", "block", "rep", "seq").groupBy("shard", "block").applyInPandas(build, INDEX).write.partitionBy("shard", "block").parquet(path)
    files: dict[tuple[int, int], list[str]] = {}
    for f in spark.read.parquet(path).inputFiles() if shards and blocks.head() else []:  # a few files a shard
        at = re.search(r"shard=(\d+)/block=(\d+)/", unquote(f))
        files.setdefault((int(at[1]), int(at[2])), []).append(f)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grams = gram_bitmap(held_out)
    streams = routes(training, counts, shards, grams, bits).join(blocks, "shard")
    streams = streams.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(parts)))
    streams = streams.repartition("shard", "block", "salt").sortWithinPartitions("shard", "block")
    sent = spark.sparkContext.broadcast((counts, grams))  # BUCKETS entries, the bits of a bitmap

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        now, index = None, None
        for b in (s for batch in batches for s in slices(batch, "seq", 2_000_000)):
            for key, own in b.groupby(["shard", "block"]):
                if key != now:
                    read = []
                    for f in files.get(key, []):
                        where, name = fs.FileSystem.from_uri(f)
                        with where.open_input_file(name) as opened:
                            read.append(pq.read_table(opened).to_pylist())
                    index, now = next((FullTextIndex(r[0]) for r in read if r), None), key
                if index is None:
                    continue
                hashes, sizes = word_hashes(own.seq)
                row = np.repeat(np.arange(len(sizes)), sizes)
                one, two = word_bits(hashes, sizes)
                ends = possible_ends(hashes, sizes, *sent.value, bits)
                carried = weights_of(sent.value[0])[(hashes % np.uint64(BUCKETS)).astype(np.int64)]
                for at, size, place in index.hits(index.numbers(hashes), carried, row, bits, ends):
                    out = merged(row[at], np.searchsorted(index.starts, place, side="right") - 1, at, size, place)
                    # a pair that differs in too many bits to share 3/4 of the words of the longer text isn't alike
                    r, t = out.row.to_numpy(), out.text.to_numpy()
                    differ = sum(np.bitwise_count((a[r] ^ b[t]).view(np.uint64)).astype(np.int64) for a, b in ((one, index.one), (two, index.two)))
                    out = out[2 * differ <= 2 * (sizes[r] + index.sizes[t]) - 3 * np.maximum(sizes[r], index.sizes[t])]
                    yield pd.DataFrame({"x": own.rep.to_numpy()[out.row], "y": index.reps[out.text], "matched": out.matched, "spans": out.spans, "longest": out.longest})

    found = streams.select("shard", "block", "rep", "seq").mapInPandas(stream, "x long, y long, matched int, spans int, longest int")
    return found.dropDuplicates(["x", "y"])


def signed(held_out: DataFrame, training: DataFrame) -> DataFrame:
    """(x, y): training class x and evaluation class y with a common signature (see `similar`); all alike pairs are among them."""
    counts = histogram(held_out)
    chosen = allocate(held_out, counts)
    there = materialize(signatures(held_out, counts, chosen), "signatures")
    known = bitmap(there, "sig", bits_for(there.count()))
    return meeting(signatures(training, counts, chosen, known), there)


def evaluation_records(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "statements").where(split_name(F.col("split")).isin("valid", "test"))
    return s.select(F.col("rec_id").alias("id"), F.col("theorem").alias("text"))


def cross_split_pairs(held_out: DataFrame, training: DataFrame, **options: float) -> DataFrame:
    """(id_x, id_y): training and evaluation records that are alike; both sides are rows (id, text).

    Alike: the shared words, counted with repetition, are at least 3/4 of the words of the longer text. Null ids, null texts and texts
    without words have no pairs; a record delivered twice counts once.
    """
    (e, of_e), (t, of_t) = classes(held_out, True), classes(training, True)
    candidates = overlaps(e, t, **options).select("x", "y").unionByName(signed(e, t)).distinct()
    pairs = alike(candidates, t, e).select("x", "y")
    x, y = of_t.select(F.col("id").alias("id_x"), F.col("rep").alias("x")), of_e.select(F.col("id").alias("id_y"), F.col("rep").alias("y"))
    return pairs.join(x, "x").join(y, "y").select("id_x", "id_y")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = cross_split_pairs(evaluation_records(spark, folder), training_records(spark, folder))
    return pairs.select(F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b"))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """For each evaluation split and source the records, those that also stand in training texts, and the pairs."""
    s = table(spark, folder, "statements").where(split_name(F.col("split")).isin("valid", "test"))
    s = s.select(F.col("rec_id").alias("id_y"), split_name(F.col("split")).alias("split"), "source").dropDuplicates(["id_y"])
    n = cross_split_pairs(evaluation_records(spark, folder), training_records(spark, folder)).groupBy("id_y").agg(F.count("*").alias("n"))
    both = s.join(n, "id_y", "left")
    return both.groupBy("split", "source").agg(F.count("*").alias("records"), F.count("n").alias("leaked"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))


QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
BOTH = f"""WITH rec AS (SELECT 1 AS side, * FROM ({TRAINING})
        UNION ALL SELECT DISTINCT 2, rec_id, theorem FROM statements WHERE lower(trim(split)) IN ('valid', 'test')), """ + ALIKE.replace("{which}", "a.side < b.side")
SQL = {
    "p4_found": BOTH,
    "p4_report": BOTH.replace("SELECT least(i, j) AS id_a, greatest(i, j) AS id_b FROM p", "SELECT j AS id_y, count(*) AS n FROM p").join(("WITH f AS (", """ GROUP BY j),
        e AS (SELECT DISTINCT ON (rec_id) rec_id, lower(trim(split)) AS split, source FROM statements WHERE lower(trim(split)) IN ('valid', 'test'))
        SELECT split, source, count(*) AS records, count(n) AS leaked, coalesce(sum(n), 0)::BIGINT AS pairs FROM e LEFT JOIN f ON id_y = rec_id GROUP BY split, source""")),
}
