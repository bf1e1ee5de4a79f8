"""Problem 7: every text encoded by a public byte-level BPE tokenizer, in batched numpy merge rounds.

A batch's texts are cut into words by the tokenizer's pattern; each different word is encoded once. The bytes of all new words
lie in one flat array of symbols. A round looks up all neighbouring pairs at once by binary search over the sorted pair
keys, takes the lowest rank of each word, and merges that pair wherever it stands in the word; words without a pair that can
merge leave the array. The vocabulary (a fixed 50 k entries) is read once on the driver and broadcast.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lemmalake.sources.tables import table

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the word pattern of the public tokenizer byte_bpe_50k.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.iinfo(np.int32).max


def pair_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (left id * 2^32 + right id) of all pairs that can merge, the id each gives, and the id of each byte."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pairs = []
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None:
                pairs.append((left << 32 | right, rank))
    keys, ids = np.array(sorted(pairs), dtype=np.int64).T
    return keys.copy(), ids.astype(np.int32), np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)


def merge_rounds(words: list[bytes], keys: np.ndarray, ids: np.ndarray, of_byte: np.ndarray) -> list[np.ndarray]:
    """The ids of each word."""
    out: list[np.ndarray] = [np.empty(0, dtype=np.int32)] * len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    symbol = of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
    word = np.repeat(np.arange(len(words)), lengths)
    while len(symbol):
        rank = np.full(len(symbol), NO_RANK, dtype=np.int32)
        key = symbol[:-1].astype(np.int64) << 32 | symbol[1:]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        rank[:-1] = np.where((keys[at] == key) & (word[:-1] == word[1:]), ids[at], NO_RANK)
        start = np.concatenate(([0], np.nonzero(word[1:] != word[:-1])[0] + 1))
        least = np.minimum.reduceat(rank, start)
        sizes = np.diff(np.append(start, len(symbol)))
        alive = least < NO_RANK
        for k in np.nonzero(~alive)[0]:
            out[word[start[k]]] = symbol[start[k] : start[k] + sizes[k]]
        hit = (rank == np.repeat(least, sizes)) & (rank < NO_RANK)
        # in a run of overlapping hits (aaa) every second one merges, from the left
        place = np.arange(len(symbol))
        begins = hit & ~np.concatenate(([False], hit[:-1]))
        run = np.maximum.accumulate(np.where(begins, place, -1))
        hit &= (place - run) % 2 == 0
        symbol = np.where(hit, rank, symbol)
        keep = ~np.concatenate(([False], hit[:-1])) & np.repeat(alive, sizes)
        symbol, word = symbol[keep], word[keep]
    return out


def encode(rows: DataFrame, key: str, text: str, vocabulary: str, known_words: int = 300_000) -> DataFrame:
    """(key, ids) of every row. Null and empty texts have the empty list. Any other column is ignored; rows stay as they are,
    repeated ones too; an empty table gives no rows. known_words bounds the words a task keeps encoded; beyond it they are
    encoded anew. Texts of any length are encoded whole."""
    spark = rows.sparkSession
    tables = spark.sparkContext.broadcast(pair_table(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(WORDS).findall
        number: dict[str, int] = {}
        coded: list[np.ndarray] = []
        for batch in batches:
            for part in (batch.slice(k, 2_000) for k in range(0, batch.num_rows, 2_000)):
                if len(number) > known_words:
                    number, coded = {}, []
                cut = [find(t) if t else [] for t in part.column(1).to_pylist()]
                new = list(dict.fromkeys(w for c in cut for w in c if w not in number))
                number.update(zip(new, range(len(coded), len(coded) + len(new)), strict=True))
                coded += merge_rounds([w.encode() for w in new], *tables.value)
                flat = [[number[w] for w in c] for c in cut]
                ids = [np.concatenate([coded[k] for k in f]) if f else np.empty(0, dtype=np.int32) for f in flat]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                values = pa.array(np.concatenate(ids) if ids else np.empty(0, dtype=np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=[key, "ids"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


QUERIES = {"p7_ids": p7_ids}
SQL: dict[str, str] = {}
