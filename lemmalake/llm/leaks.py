"""Problem 8: passages of held-out items in the documents of a training corpus.

The word n-grams of the items go into a bitmap of bounded size, which is broadcast; one pass over the corpus counts the documents'
n-grams that hit it. Of each window of an item (as many words as a leak must have) the rarest n-gram is its seed: whoever holds the
window holds the seed. The seeds alone go into a second bitmap, with which a second pass cuts the passages around them out of the
documents; whole texts are never shuffled. The passages are joined to the items by their seed, and aligned with the item's words
around it by Smith and Waterman's algorithm, many at once, which gives the longest run of equal words.

Copies that are edited everywhere need not share an n-gram. They are found by words alone: an alignment with half of an item's best
score has at least half of the item's words, within twice as many words of the document. Documents that pass both counts are
aligned whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmalake.llm.similar import bitmap, bits_for, in_bitmap, mix, slices, word_hashes, words
from lemmalake.sources.tables import table
from lemmalake.storage import materialize

GRAM = 4
#: Words of items that one scan of the corpus for edited copies looks for, about.
BLOCK_WORDS = 1_000_000
#: Scores of a pair of equal words, of unequal ones, and of a word left out.
EQUAL, UNEQUAL, GAP = 2, -1, -1
#: Words beyond a run on either side of a seed that are aligned too.
MARGIN = 8


def grams(hashes: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash, row and place of every n-gram of words."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = place + n <= np.repeat(sizes, sizes)
    start = np.nonzero(inside)[0]
    out = np.full(len(start), n, dtype=np.uint64)
    for k in range(n):
        with np.errstate(over="ignore"):
            out = mix(out + hashes[start + k])
    return out, row[start], place[start]


def item_seeds(items: DataFrame, run: int) -> DataFrame:
    """(gram, n, item, place, window): for every window of the items its n-grams. Items with fewer than `run` words have one window; n is
    GRAM, or the number of words of an item that has fewer."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (s for batch in batches for s in slices(batch, "line")):
            hashes, sizes = word_hashes(b.line)
            ids = b.id.to_numpy()
            for n in range(1, GRAM + 1):
                own = sizes >= GRAM if n == GRAM else sizes == n
                gram, row, place = grams(hashes, sizes, n)
                keep = own[row]
                gram, row, place = gram[keep], row[keep], place[keep]
                first, last = np.maximum(0, place - (run - n)), np.minimum(place, np.maximum(0, sizes[row] - run))
                many = last - first + 1
                window = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                yield pd.DataFrame({"gram": np.repeat(gram.view(np.int64), many), "n": n, "item": np.repeat(ids[row], many), "place": np.repeat(place, many).astype(np.int32), "window": window.astype(np.int32)})

    return items.select("id", "line").mapInPandas(make, "gram long, n int, item long, place int, window int")


def gram_bitmap(seeds: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bitmap of the n-grams of rows (gram, n), and which n there are."""
    grams_ = seeds.select("gram").distinct()
    return bitmap(grams_, "gram", bits_for(grams_.count())), sorted(r.n for r in seeds.select("n").distinct().collect())  # n is at most GRAM


def hits(line: pd.Series, packed: np.ndarray, ns: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each n the n-grams of lines that hit a bitmap: n, their hashes, rows and places."""
    hashes, sizes = word_hashes(line)
    for n in ns:
        gram, row, place = grams(hashes, sizes, n)
        hit = in_bitmap(packed, gram)
        yield n, gram[hit].view(np.int64), row[hit], place[hit]


def gram_counts(docs: DataFrame, packed: np.ndarray, ns: list[int]) -> DataFrame:
    """(gram, often) of the documents' n-grams that hit the bitmap."""
    sent = docs.sparkSession.sparkContext.broadcast(packed)  # at most 16 MB

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (s for batch in batches for s in slices(batch, "line")):
            for _, gram, _, _ in hits(b.line, sent.value, ns):
                gram, many = np.unique(gram, return_counts=True)
                yield pd.DataFrame({"gram": gram, "many": many})

    return docs.select("line").mapInPandas(scan, "gram long, many long").groupBy("gram").agg(F.sum("many").alias("often"))


def passages(docs: DataFrame, packed: np.ndarray, ns: list[int], around: int) -> DataFrame:
    """(gram, doc, at, passage): the documents' n-grams that hit the bitmap, with `around` words on either side. An n-gram of less than
    GRAM words is an item as a whole, so that one hit a document is enough."""
    sent = docs.sparkSession.sparkContext.broadcast(packed)  # at most 16 MB

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (s for batch in batches for s in slices(batch, "line")):
            ids, cut = b.id.to_numpy(), {}
            for n, gram, row, place in hits(b.line, sent.value, ns):
                out = pd.DataFrame({"gram": gram, "row": row, "place": place})
                if n < GRAM:
                    out = out.drop_duplicates(["gram", "row"])
                for r in out.row.unique():
                    cut.setdefault(r, b.line.iat[r].split(" "))
                texts = [" ".join(cut[r][max(0, p - around) : p + n + around]) for r, p in zip(out.row, out.place, strict=True)]
                yield pd.DataFrame({"gram": out.gram, "doc": ids[out.row], "at": out.place, "passage": np.array(texts, dtype=object)})

    return docs.select("id", "line").mapInPandas(scan, "gram long, doc long, at long, passage string")


def align(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Smith-Waterman score of each pair of rows of word numbers, and its longest run of equal words.

    Rows are padded: first with -1, second with -2. A row of the score matrix is made for all pairs at once; the gap along
    the row is a running maximum."""
    n, m = second.shape
    score, run = np.zeros((n, m + 1), dtype=np.int32), np.zeros((n, m + 1), dtype=np.int32)
    best, longest = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
    slope = -GAP * np.arange(m + 1, dtype=np.int32)
    for k in range(first.shape[1]):
        equal = first[:, k, None] == second
        fresh = np.zeros_like(score)
        fresh[:, 1:] = np.maximum(score[:, :-1] + np.where(equal, EQUAL, UNEQUAL), score[:, 1:] + GAP)
        score = np.maximum(np.maximum.accumulate(np.maximum(fresh, 0) + slope, axis=1) - slope, 0)
        run[:, 1:] = np.where(equal, run[:, :-1] + 1, 0)
        best, longest = np.maximum(best, score.max(axis=1)), np.maximum(longest, run.max(axis=1))
    return best, longest


def aligned(pairs: DataFrame) -> DataFrame:
    """(doc, item, score, longest, item_words) of (doc, item, passage, own, item_words): words of the document and of the item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 1024):
                b = batch.iloc[k : k + 1024]
                sides = [c.str.split(" ").tolist() for c in (b.passage, b.own)]
                sizes = [[len(x) for x in side] for side in sides]
                number = pd.factorize(np.array([w for side in sides for x in side for w in x], dtype=object))[0]
                padded, at = [], 0
                for side, pad in zip(sizes, (-1, -2), strict=True):
                    out = np.full((len(b), max(side)), pad, dtype=np.int32)
                    for r, n in enumerate(side):
                        out[r, :n] = number[at : at + n]
                        at += n
                    padded.append(out)
                score, longest = align(*padded)
                yield pd.DataFrame({"doc": b.doc.to_numpy(), "item": b["item"].to_numpy(), "score": score, "longest": longest, "item_words": b.item_words.to_numpy()})

    return pairs.select("doc", "item", "passage", "own", "item_words").mapInPandas(run, "doc long, item long, score int, longest int, item_words int")


def lines(rows: DataFrame) -> DataFrame:
    """(id, line): the words of texts, set apart by blanks, of rows (id, text) that have any."""
    rows = rows.where(F.col("id").isNotNull()).select("id", F.array_join(words(F.col("text")), " ").alias("line"))
    return rows.where("line <> ''")


class Items:
    """The words of a block of items, and which items have each word how often."""

    def __init__(self, items: pd.DataFrame) -> None:
        hashes, self.sizes = word_hashes(items.line)
        self.ids, self.lines = items.id.to_numpy(), np.split(hashes, np.cumsum(self.sizes)[:-1])
        item = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.vocabulary, number = np.unique(hashes, return_inverse=True)
        both, self.times = np.unique(number * len(self.sizes) + item, return_counts=True)
        self.item = both % len(self.sizes)
        self.start = np.searchsorted(both // len(self.sizes), np.arange(len(self.vocabulary) + 1))
        self.need = -(-self.sizes // 2)

    def candidates(self, doc: np.ndarray) -> np.ndarray:
        """The items of which at least half of the words may stand in a window of twice their size in the document."""
        at = np.minimum(np.searchsorted(self.vocabulary, doc), len(self.vocabulary) - 1)
        known = np.unique(at[self.vocabulary[at] == doc])
        n = self.start[known + 1] - self.start[known]
        entry = np.repeat(self.start[known], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found = np.nonzero(np.bincount(self.item[entry], weights=self.times[entry], minlength=len(self.sizes)) >= self.need)[0]

        def dense(k: int) -> bool:
            count = np.append(0, np.cumsum(np.isin(doc, self.lines[k])))
            size = min(2 * int(self.sizes[k]), len(doc))
            return bool((count[size:] - count[: len(count) - size] >= self.need[k]).any())

        return np.array([k for k in found if dense(k)], dtype=np.int64)


def windows(doc: np.ndarray, size: int) -> list[np.ndarray]:
    """A document cut so that all of its runs of 2 * size words lie whole in a window."""
    return [doc[k : k + 4 * size] for k in range(0, max(1, len(doc) - 2 * size), 2 * size)]


def edited(docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc, item, score, longest, item_words): every document and item whose best alignment has at least half of the item's best score,
    EQUAL * item_words; score is that alignment's, longest the longest run of equal words anywhere in the document.

    docs and items are as in leaks(). The corpus is scanned once for each block of about `block_words` words of items; words are
    compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    docs, items = lines(docs), materialize(lines(items), "items")
    size = F.size(F.split("line", " "))
    blocks = -(-(items.agg(F.sum(size).alias("n")).head().n or 0) // block_words)
    out = spark.createDataFrame([], "doc long, item long, score int, longest int, item_words int")
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toPandas()  # about block_words words
        if len(own):
            out = out.unionByName(edited_block(docs, spark.sparkContext.broadcast(own)))
    return out.groupBy("doc", "item").agg(F.max("score").alias("score"), F.max("longest").alias("longest"), F.max("item_words").alias("item_words"))


def edited_block(docs: DataFrame, sent) -> DataFrame:  # noqa: ANN001
    """edited() for the items (id, line) of one block."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = Items(sent.value)

        def scored(part: list[tuple[int, int, np.ndarray]]) -> pd.DataFrame:
            sides = [w for _, _, w in part], [items.lines[k] for _, k, _ in part]
            number = pd.factorize(np.concatenate([w for side in sides for w in side]))[0]
            padded, at = [], 0
            for side, pad in zip(sides, (-1, -2), strict=True):
                out = np.full((len(part), max(map(len, side))), pad, dtype=np.int32)
                for r, w in enumerate(side):
                    out[r, : len(w)] = number[at : at + len(w)]
                    at += len(w)
                padded.append(out)
            score, longest = align(padded[1], padded[0])  # a step a word of the item
            return pd.DataFrame({"doc": [d for d, _, _ in part], "k": [k for _, k, _ in part], "score": score, "longest": longest})

        for b in (s for batch in batches for s in slices(batch, "line", 1_000_000)):
            hashes, sizes = word_hashes(b.line)
            todo = []
            for doc, w in zip(b.id, np.split(hashes, np.cumsum(sizes)[:-1]), strict=True):
                todo += [(doc, k, piece) for k in items.candidates(w) for piece in windows(w, int(items.sizes[k]))]
            todo.sort(key=lambda x: (len(x[2]), items.sizes[x[1]]))  # little padding
            parts = [scored(todo[at : at + 128]) for at in range(0, len(todo), 128)]
            if parts:
                best = pd.concat(parts).groupby(["doc", "k"], as_index=False).max()
                best = best[best.score >= items.sizes[best.k]]
                yield pd.DataFrame({"doc": best.doc, "item": items.ids[best.k], "score": best.score, "longest": best.longest, "item_words": items.sizes[best.k]})

    return docs.mapInPandas(scan, "doc long, item long, score int, longest int, item_words int")


def leaks(docs: DataFrame, items: DataFrame, run: int = 12) -> DataFrame:
    """(doc, item, score, longest, item_words): of each document and item that share a seed, the best alignment score and the longest
    run of equal words within `run` + MARGIN words on either side of a seed. Every pair that shares `run` words in a row (all words, for
    an item with fewer) is among them, with a longest run of so many at least; edited copies are only if they share a seed, so see
    edited() for these.

    docs and items are rows (id, text) with unique ids. Null ids, null texts and texts without words have no pairs; either side may be empty.
    """
    docs, items = lines(docs), materialize(lines(items), "items", compression="zstd")
    seeds = materialize(item_seeds(items, run), "item-grams", compression="zstd")
    often = gram_counts(docs, *gram_bitmap(seeds))
    rarest = F.min(F.struct("often", "gram", "n", "place")).alias("s")
    # a window of which an n-gram stands nowhere stands nowhere
    chosen = seeds.join(often, "gram", "left").groupBy("item", "window").agg(rarest, F.bool_or(F.col("often").isNull()).alias("absent"))
    chosen = chosen.where("NOT absent").select("item", "s.gram", "s.n", "s.place").distinct()
    around, w = run + MARGIN, F.split("line", " ")
    own = F.slice(w, F.greatest(F.col("place") - around, F.lit(0)) + 1, F.col("n") + F.least("place", F.lit(around)) + around)
    chosen = chosen.join(items.select(F.col("id").alias("item"), "line"), "item")
    chosen = materialize(chosen.select("gram", "n", "item", "place", F.array_join(own, " ").alias("own"), F.size(w).alias("item_words")), "seeds", compression="zstd")
    found = passages(docs, *gram_bitmap(chosen), around).join(chosen.drop("n"), "gram")
    # seeds on one diagonal, less than `run` words apart, have the same windows in their passages: one of them is enough
    one = found.groupBy("doc", "item", (F.col("at") - F.col("place")).alias("diagonal"), F.floor(F.col("place") / run).alias("part")).agg(F.first(F.struct("passage", "own", "item_words")).alias("p"))
    return aligned(one.select("doc", "item", "p.*")).groupBy("doc", "item").agg(F.max("score").alias("score"), F.max("longest").alias("longest"), F.max("item_words").alias("item_words"))


RUN = 12


def corpus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, folder, "eval_items").select(F.col("item_id").alias("id"), "text")
    return docs, items


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    whole = F.col("longest") >= F.least(F.lit(RUN), F.col("item_words"))
    return leaks(*corpus(spark, folder), RUN).where(whole).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with copies of items, edited ones too: those whose alignment has at least half of the item's best score."""
    out = edited(*corpus(spark, folder))
    share = F.round(F.col("score") / (EQUAL * F.col("item_words")), 4)
    return out.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "score", "longest", share.alias("share"))


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores}
SQL = {
    "p8_found": """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
        i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
        dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM d, range(1, (SELECT max(len(w)) FROM d) + 1) AS r(k) WHERE k + 11 <= len(w)),
        ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM i, range(1, (SELECT max(len(w)) FROM i) + 1) AS r(k) WHERE k + 11 <= len(w))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
        UNION SELECT doc_id, item_id FROM d, i WHERE len(i.w) BETWEEN 1 AND 11 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(i.w, ' ') || ' ')"""
}
