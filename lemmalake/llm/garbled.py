"""Problem 9: texts, or parts of texts, that were decoded with the wrong character encoding.

A wrong decoding is a substitution cipher: one byte stood for another letter, or a letter's bytes for several symbols. Which cipher
a source's words went through is unknown. The candidates are all pairs of a wrong and a right code page (also applied
repeatedly), the identity, and a table of each source's own, which is learnt: for each symbol that doesn't fit into its words
(another script's letter, or no letter, between Latin letters) expectation and maximization over the bigrams around it tell the letter that it
stood for, so that pages not listed here are restored too.

The ciphers' weights are learnt by expectation and maximization over the corpus's word types: the expectation step
gives, for each word type of each source, the probability of each cipher from the ciphers' weights in that source and the language
model's probability of the deciphered word; the maximization step learns anew the ciphers' weights by source and the language model, a table
of character bigrams of fixed size, from the deciphered words. So the model unlearns garbled bigrams, and sequences that merely look
odd but stand in ordinary words stay. A cipher of one symbol a letter must give bigrams that the corpus has: letters of a language
that it hardly has are not taken for others. Words whose cipher isn't the identity are garbled; restored texts apply the ciphers
with translate(). A replacement character shows a decoding that failed.

Texts are read once. A word is a run of ASCII letters, ASCII digits and other characters than ASCII ones, of any length; all
that is kept of a text are its words with other than ASCII characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmalake.llm.similar import slices
from lemmalake.sources.tables import table
from lemmalake.storage import materialize

#: Code pages that texts are wrongly decoded with, and those of one byte a letter that texts are written in.
WRONG = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp866", "cp1251", "koi8-r", "cp1250", "iso8859-2", "cp1254", "gb18030", "mac_cyrillic", "iso8859-5")
RIGHT = ("cp1252", "cp1251", "koi8-r", "cp866", "mac_roman", "cp850", "cp1250", "iso8859-5", "mac_cyrillic")
#: Ciphers (wrong, right, how often it was applied).
CIPHERS = tuple((w, "utf-8", n) for w in WRONG for n in (1, 2, 3) if n == 1 or w in ("cp1252", "latin-1", "mac_roman")) + tuple(
    (w, r, 1) for w in WRONG if w not in ("latin-1", "gb18030") for r in RIGHT if r != w
)
#: The number of the cipher by a source's own table, and those that keep the number of characters.
OWN = len(CIPHERS)
KEEPING = frozenset([k for k, c in enumerate(CIPHERS) if c[1] != "utf-8"] + [OWN])
BIGRAMS, LETTERS = 1 << 20, 1 << 16
LOST = "\ufffd"
#: The weight of letters' own frequencies against a bigram's, and the least weight of a cipher and of the identity in any source.
SMOOTH, LEAST, PLAIN = 2.0, 1e-6, 0.9
#: How much less likely a word is to stand as it should if it has control characters.
CONTROL = 1e-3
#: A bigram is one that the corpus has if it stands this often, against what its letters' frequencies alone would give; so many of the
#: bigrams around changed letters must be.
KNOWN, KNOWN_SHARE = 0.02, 0.6
#: A word of more odd symbols than this, a quarter of them no letters, that can be read by a cipher of several symbols a letter has a structure that
#: doesn't come by chance, whatever its language: how much likelier (log) that makes the cipher for each further symbol.
SYMBOLS, STRUCTURE = 3, 5.0
#: A source's weights of ciphers below this one aren't kept.
SMALL = 1e-5


def byte_of(page: str) -> dict[str, bytes]:
    """The byte of each character of a code page; bytes that the page leaves out stand for the control character of the same number."""
    out: dict[str, bytes] = {}
    for k in range(256):
        try:
            out.setdefault(bytes([k]).decode(page), bytes([k]))
        except UnicodeError:
            out.setdefault(chr(k), bytes([k]))
    return out


def translation(wrong: str, right: str) -> dict[int, str]:
    """The letter that each symbol of a wrong decoding stood for, where both pages have one byte a letter."""
    letter = {b: c for c, b in byte_of(right).items()}
    return {ord(c): letter[b] for c, b in byte_of(wrong).items() if b[0] > 127 and not 0x80 <= ord(letter[b]) < 0xA0}


class Reader:
    """Deciphers words; the tables of the code pages are made once a task."""

    def __init__(self) -> None:
        self.pages = {w: byte_of(w) for w in WRONG if w != "gb18030"}
        self.tables = {k: translation(c[0], c[1]) for k, c in enumerate(CIPHERS) if c[1] != "utf-8"}
        self.possible: dict[str, int] = {}

    def decipher(self, word: str, k: int) -> str | None:
        """The word before it went through the cipher number k; None if it can't have gone through it."""
        wrong, right, times = CIPHERS[k]
        if right != "utf-8":
            t = self.tables[k]
            return word.translate(t) if all(c < "\x80" or ord(c) in t for c in word) else None
        for n in range(times):
            try:
                if wrong == "gb18030":
                    word = word.encode("gb18030").decode("utf-8")
                else:
                    page = self.pages[wrong]
                    word = b"".join([page[c] for c in word]).decode("utf-8")
            except (KeyError, UnicodeError):
                return None
            if word.isascii():
                return None if n < times - 1 else word
        return word

    def ciphers_of(self, c: str) -> int:
        """A bit for each cipher that can have given the symbol c; one that keeps the number of characters must give a letter for it."""
        bits = 0
        for k, (wrong, right, _) in enumerate(CIPHERS):
            if right != "utf-8":
                t = self.tables[k].get(ord(c))
                bits |= (t is not None and (t == c or t.isalpha())) << k
            else:
                bits |= (wrong == "gb18030" or c in self.pages[wrong]) << k
        return bits

    def readings(self, word: str) -> list[tuple[int, str]]:
        """What the word may have been: the identity (-1) and each cipher that it can have gone through, if that changes it."""
        import re

        out, bits = [(-1, word)], (1 << len(CIPHERS)) - 1
        for c in set(word):
            if c > "\x7f":
                if (b := self.possible.get(c)) is None:
                    b = self.possible[c] = self.ciphers_of(c)
                bits &= b
        while bits:
            k = (bits & -bits).bit_length() - 1
            bits &= bits - 1
            plain = self.decipher(word, k)
            if not plain or plain == word or re.search("[\x00-\x08\x0e-\x1f\x7f-\x9f\ufffd]", plain):
                continue
            # letters that are swapped for letters must be of one script
            if CIPHERS[k][1] != "utf-8" and re.search("[A-Za-z][\u0400-\u04ff]|[\u0400-\u04ff][A-Za-z]", plain):
                continue
            out.append((k, plain))
        return out


def decipher(word: str, cipher: tuple[str, str, int]) -> str | None:
    return Reader().decipher(word, CIPHERS.index(cipher))


def pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of words, each with a blank before and after it; the places of the first of each neighbouring two; where words begin."""
    codes = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    start = np.cumsum(sizes) - sizes
    inside = np.ones(len(codes), dtype=bool)
    inside[start + sizes - 1] = False
    return codes, np.nonzero(inside)[0], start - np.arange(len(words))


def bucket(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left * 0x9E3779B1 + right * 0x85EBCA77 >> 7) % BIGRAMS


class Model:
    """Probabilities of character bigrams, from tables of fixed size. Broadcasts send the two tables: they are pickled without the package."""

    def __init__(self, both: np.ndarray, one: np.ndarray) -> None:
        self.both, self.one, self.total = both, one, max(1.0, float(one.sum()))

    def known(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which bigrams the corpus has, as its letters' frequencies go."""
        return self.both[bucket(left, right)] * self.total >= KNOWN * self.one[left % LETTERS].astype(float) * np.maximum(self.one[right % LETTERS], 1.0)

    def chance(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The probability of the second letter after the first, a fifth of it by its own frequency alone."""
        alone = (self.one[right % LETTERS] + 0.01) / (self.total + 0.01 * LETTERS)
        return 0.8 * (self.both[bucket(left, right)] + SMOOTH * alone) / (self.one[left % LETTERS] + SMOOTH) + 0.2 * alone

    def score(self, words: list[str], own: np.ndarray) -> np.ndarray:
        """The logarithm of each word's probability, by what is counted besides the word's own count."""
        codes, at, start = pairs(words)
        left, right = codes[at], codes[at + 1]
        alone = (self.one[right % LETTERS] + 0.01) / (self.total + 0.01 * LETTERS)
        own = np.repeat(own, np.diff(np.append(start, len(at))))
        p = (np.maximum(self.both[bucket(left, right)] - own, 0) + SMOOTH * alone) / (np.maximum(self.one[left % LETTERS] - own, 0) + SMOOTH)
        return np.add.reduceat(np.log(np.maximum(p, 1e-12)), start)


def posterior(batch: pd.DataFrame, model: Model, overall: dict[int, float]) -> tuple[pd.DataFrame, np.ndarray]:
    """All readings of a batch's words (row, cipher, plain, p), and the logarithms of their weighted probabilities. A cipher's weight is
    the mean of its weights in the source and overall."""
    row = np.repeat(np.arange(len(batch)), batch.ciphers.map(len))
    cipher, plain = ([x for values in batch[c] for x in values] for c in ("ciphers", "plains"))
    out = pd.DataFrame({"row": row, "cipher": cipher, "plain": plain})
    out["score"] = model.score(plain, np.where(out.cipher < 0, batch.n.to_numpy(dtype=float)[row], 0.0))
    structure = np.array([STRUCTURE * max(0, len(odd) - SYMBOLS) * (4 * sum(not c.isalpha() for c in odd) >= len(odd)) for odd in ([c for c in w if c > "\x7f"] for w in batch.word)])
    out["score"] += np.where((out.cipher >= 0) & ~out.cipher.isin(KEEPING), structure[row], 0.0)
    weights = np.zeros((len(batch), OWN + 1))
    for r, (own, w) in enumerate(zip(batch.weighted, batch.weight, strict=True)):
        if own is not None and len(own):
            weights[r, own] = w
    plain_prior = np.array([PLAIN * CONTROL if any("\x80" <= c < "\xa0" for c in w) else PLAIN for w in batch.word])
    everywhere = np.array([overall.get(k, 0.0) for k in range(OWN + 1)])
    prior = np.where(out.cipher < 0, plain_prior[row], LEAST + (weights[row, out.cipher] + everywhere[out.cipher]) / 2)
    s = out.score.to_numpy() + np.log(prior)
    start = np.nonzero(np.append(True, row[1:] != row[:-1]))[0]
    p = np.exp(s - np.repeat(np.maximum.reduceat(s, start), np.diff(np.append(start, len(s)))))
    out["p"] = p / np.bincount(row, weights=p)[row]
    return out, s


def count_bigrams(words: list[str], weight: np.ndarray) -> pd.DataFrame:
    """Weighted counts of the bigrams and letters of words, by bucket; letters come after the bigrams."""
    codes, at, start = pairs(words)
    n = np.repeat(weight, np.diff(np.append(start, len(at))))
    k = np.concatenate((bucket(codes[at], codes[at + 1]), BIGRAMS + codes[at] % LETTERS))
    keys, where = np.unique(k, return_inverse=True)
    return pd.DataFrame({"k": keys, "n": np.bincount(where, weights=np.concatenate((n, n)))})


def model_of(counts: DataFrame) -> Model:
    out = np.zeros(BIGRAMS + LETTERS, dtype=np.float32)
    for r in counts.groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():  # at most BIGRAMS + LETTERS
        out[r.k] = r.n
    return Model(out[:BIGRAMS], out[BIGRAMS:])


def count_plain(types: DataFrame) -> DataFrame:
    """Bigram counts of word types as they stand."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield count_bigrams(b.word.tolist(), b.n.to_numpy(dtype=float))

    return types.select("word", "n").mapInPandas(run, "k long, n double")


ROUNDS = 4
#: How many types of words of a source a symbol that doesn't fit must stand in to be learnt, and how sure its letter must be.
TYPES, SURE = 3, 0.8
WORDS = "id long, source string, word string, n long, k long, c double"


def with_ascii_blanks(texts: pd.Series) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one, digits as 0, each text followed by a line end; its characters, which of them are of words, and where texts begin."""
    codes = np.frombuffer("".join(f"{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    kind = np.array([chr(k).isalnum() for k in range(128)])
    codes = np.where((codes >= 48) & (codes <= 57), 48, codes)
    inside = (codes > 127) | kind[np.minimum(codes, 127)]
    starts = np.cumsum(texts.str.len().to_numpy() + 1) - texts.str.len().to_numpy() - 1
    return codes.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass"), codes, inside, starts


def odd_words(docs: DataFrame) -> DataFrame:
    """WORDS of docs (id, source, text): each text's words with other than ASCII characters, and how often (id, source, word, n); and, as
    (k, c), how often the bigrams and letters of all other words stand."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (s for batch in batches for s in slices(batch, "text", 1_000_000)):
            whole, codes, inside, starts = with_ascii_blanks(b.text)
            edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
            first, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
            if not len(first):
                continue
            odd = np.logical_or.reduceat(codes > 127, first)
            row = np.searchsorted(starts, first[odd], side="right") - 1
            words = pd.DataFrame({"row": row, "word": np.array([whole[a:z] for a, z in zip(first[odd], end[odd], strict=True)], dtype=object)})
            words = words.groupby(["row", "word"], as_index=False, sort=False).size()
            yield pd.DataFrame({"id": b.id.to_numpy()[words.row], "source": b.source.to_numpy()[words.row], "word": words.word, "n": words["size"], "k": -1, "c": 0.0})
            # of the other words the bigrams, blanks around them
            change = np.zeros(len(codes) + 1, dtype=np.int8)
            change[first[~odd]] += 1
            change[end[~odd]] -= 1
            plain = np.cumsum(change[:-1]).astype(bool)
            shown = np.append(np.append(32, np.where(plain, codes, 32)), 32)
            at = np.nonzero((shown[:-1] != 32) | (shown[1:] != 32))[0]
            k, c = np.unique(np.concatenate((bucket(shown[at], shown[at + 1]), BIGRAMS + shown[at] % LETTERS)), return_counts=True)
            yield pd.DataFrame({"id": 0, "source": None, "word": None, "n": 0, "k": k, "c": c.astype(float)})

    return docs.select("id", "source", "text").mapInPandas(run, WORDS)


def unfit(word: str) -> list[int]:
    """The places of symbols that don't fit into the word: between ASCII letters, or at an end of them, what is no Latin letter, digit or
    usual mark. Words of less than 3 characters tell nothing."""
    import unicodedata

    out = []
    if len(word) > 2 and any(c.isascii() and c.isalpha() for c in word):
        for k, c in enumerate(word):
            if c > "\x7f" and c != LOST and (unicodedata.category(c)[0] in "SC" or (c.isalpha() and not unicodedata.name(c, "").startswith("LATIN"))):
                out.append(k)
    return out


def own_tables(types: DataFrame, model: Model) -> DataFrame:
    """(source, symbols, letters): for each source the symbols that don't fit into its words, and what each stood for.

    Expectation and maximization over what stands before and after each symbol, (source, symbol, left, right, word types), of
    which there are as many as the alphabet allows, however many texts there are: the expectation step gives the probability of each
    letter for each symbol from the bigrams that it would make in all its words, the maximization step takes the sure ones into the table,
    by which the neighbours of symbols are read in the next round. Only what is sure, and makes bigrams that the corpus has, is kept.
    """
    sent = types.sparkSession.sparkContext.broadcast((model.both, model.one))

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(s, w[k], w[k - 1] if k else " ", w[k + 1] if k + 1 < len(w) else " ") for s, w in zip(b.source, b.word, strict=True) for k in unfit(w)]
            yield pd.DataFrame(out, columns=["source", "symbol", "left", "right"])

    def learn_table(rows: pd.DataFrame) -> pd.DataFrame:
        m = Model(*sent.value)
        code = lambda c: np.array([ord(x) for x in c], dtype=np.int64)
        common = np.argsort(m.one)[::-1][:2_000]
        letters = np.array([k for k in common if k > 127 and chr(k).isalpha() and not 0xD800 <= k < 0xE000], dtype=np.int64)[:200]
        symbols, number = np.unique(rows.symbol.to_numpy(dtype=object), return_inverse=True)
        seen = np.bincount(number, weights=rows.n)
        odd = set(symbols)
        letters = letters[~np.isin(letters, code(symbols))]
        told: dict[str, str] = {}
        if not len(letters):
            return pd.DataFrame(columns=["source", "symbols", "letters"])
        for _ in range(6):
            left, right = ([told.get(c, "") if c in odd else c for c in rows[side]] for side in ("left", "right"))
            a, b = np.array([c != "" for c in left]), np.array([c != "" for c in right])
            l, r = code(c or " " for c in left), code(c or " " for c in right)
            fits = np.zeros((len(symbols), len(letters)))
            for at in range(0, len(rows), 10_000):
                x = slice(at, at + 10_000)
                fit = np.where(a[x, None], np.log(m.chance(l[x, None], letters[None, :])), 0.0) + np.where(b[x, None], np.log(m.chance(letters[None, :], r[x, None])), 0.0)
                np.add.at(fits, number[x], rows.n.to_numpy()[x, None] * fit)
            share = np.exp(fits - fits.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            best = share.argmax(axis=1)
            told = {c: chr(letters[best[k]]) for k, c in enumerate(symbols) if share[k, best[k]] >= SURE and seen[k] >= TYPES}
        full = a & b
        ok = full * (m.known(l, letters[best[number]]).astype(float) + m.known(letters[best[number]], r)) / 2 * rows.n.to_numpy()
        good = np.bincount(number, weights=ok, minlength=len(symbols)) / np.maximum(1, np.bincount(number[full], weights=rows.n[full], minlength=len(symbols)))
        kept = [(c, told[c]) for k, c in enumerate(symbols) if c in told and good[k] >= SURE]
        return pd.DataFrame([{"source": rows.source.iloc[0], "symbols": "".join(c for c, _ in kept), "letters": "".join(x for _, x in kept)}] if kept else [], columns=["source", "symbols", "letters"])

    contexts = types.select("source", "word").mapInPandas(around, "source string, symbol string, left string, right string")
    contexts = contexts.groupBy("source", "symbol", "left", "right").agg(F.count("*").alias("n"))
    return contexts.groupBy("source").applyInPandas(learn_table, "source string, symbols string, letters string")


def candidates(types: DataFrame, model: Model) -> DataFrame:
    """Word types with their readings (source, word, n, ciphers, plains), for those that have other ones than as they stand."""
    spark = types.sparkSession
    sent = spark.sparkContext.broadcast((model.both, model.one))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for b in batches:
            found = [reader.readings(w) for w in b.word]
            yield b.assign(ciphers=[[c for c, _ in r] for r in found], plains=[[p for _, p in r] for r in found])

    def supported(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*sent.value)
        for b in (s for batch in batches for s in slices(batch, "word", 1_000_000)):
            rows = []
            for k, (word, ciphers, plains, symbols, letters) in enumerate(zip(b.word, b.ciphers, b.plains, b.symbols, b.letters, strict=True)):
                own = [(k, int(c), p) for c, p in zip(ciphers, plains, strict=True)]
                if isinstance(symbols, str) and unfit(word) and (plain := word.translate(str.maketrans(symbols, letters))) != word:
                    own.append((k, OWN, plain))
                rows += own
            out = pd.DataFrame(rows, columns=["row", "cipher", "plain"])
            keeping = np.nonzero(out.cipher.isin(KEEPING))[0]
            if len(keeping):  # the bigrams around the letters that these change
                codes, at, start = pairs(out.plain.iloc[keeping].tolist())
                before = pairs(b.word.iloc[out.row.iloc[keeping]].tolist())[0]
                changed = codes != before
                around = changed[at] | changed[at + 1]
                known = m.known(codes[at], codes[at + 1]) & around
                out = out.drop(index=out.index[keeping[np.add.reduceat(known, start, dtype=np.int64) < KNOWN_SHARE * np.add.reduceat(around, start, dtype=np.int64)]])
            by = out.groupby("row").agg(ciphers=("cipher", list), plains=("plain", list))
            by = by[by.ciphers.map(len) > 1]
            if len(by):
                yield b.iloc[by.index][["source", "word", "n"]].assign(ciphers=by.ciphers.tolist(), plains=by.plains.tolist())

    read_ = types.select("word").distinct().mapInPandas(read, "word string, ciphers array<int>, plains array<string>")
    tables = materialize(own_tables(types, model), "own-tables").select(F.col("source").alias("of"), "symbols", "letters")
    both = types.join(read_, "word").join(tables, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    return both.select("source", "word", "n", "ciphers", "plains", "symbols", "letters").mapInPandas(supported, "source string, word string, n long, ciphers array<int>, plains array<string>")


def learn(odd: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(source, word, cipher, plain, gain): the garbled word types of WORDS, what they were, and by how much that is likelier (log)."""
    spark = odd.sparkSession
    ascii_counts = odd.where("k >= 0").groupBy("k").agg(F.sum("c").alias("n"))
    types = materialize(odd.where("word IS NOT NULL").groupBy("source", "word").agg(F.sum("n").alias("n")), "word-types", compression="zstd")
    base = materialize(ascii_counts.unionByName(count_plain(types)).groupBy("k").agg(F.sum("n").alias("n")), "bigrams")
    model = model_of(base)
    chosen = materialize(candidates(types, model), "readings", compression="zstd")
    # what the words with several readings would count if they all stood as they should, taken off
    sure = base.unionByName(count_plain(chosen).withColumn("n", -F.col("n")))
    weights, overall = None, {}

    def with_weights() -> DataFrame:
        if weights is None:
            return chosen.withColumns({"weighted": F.lit(None).cast("array<int>"), "weight": F.lit(None).cast("array<double>")})
        return chosen.join(weights, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2_000):
                yield from slices(batch.iloc[at : at + 2_000], "word", 200_000)

    def step(found: DataFrame, sent) -> DataFrame:  # noqa: ANN001
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m, everywhere = Model(*sent.value[:2]), sent.value[2]
            for b in pieces(batches):
                out, _ = posterior(b, m, everywhere)
                n = out.p.to_numpy() * b.n.to_numpy(dtype=float)[out.row]
                big = n > 1e-3
                c = count_bigrams(out.plain[big].tolist(), n[big])
                yield pd.DataFrame({"source": None, "cipher": -2, "k": c.k, "n": c.n})
                used = pd.DataFrame({"source": b.source.to_numpy()[out.row], "cipher": out.cipher, "n": n}).groupby(["source", "cipher"], dropna=False, as_index=False).n.sum()
                yield used.assign(k=-1)[["source", "cipher", "k", "n"]]

        return found.mapInPandas(run, "source string, cipher int, k long, n double")

    for _ in range(rounds):
        stepped = materialize(step(with_weights(), spark.sparkContext.broadcast((model.both, model.one, overall))), "expected")
        model = model_of(sure.unionByName(stepped.where("cipher = -2").select("k", "n")))
        by = stepped.where("k = -1").groupBy(F.col("source").alias("of"), "cipher").agg(F.sum("n").alias("n"))
        share = by.groupBy("of").agg(F.sum("n").alias("all"), F.collect_list(F.when(F.col("cipher") >= 0, F.struct("cipher", "n"))).alias("c"))  # a cipher an entry
        kept = F.filter("c", lambda x: x.n > SMALL * (F.col("all") + 10))
        weights = share.select("of", F.transform(kept, lambda x: x.cipher).alias("weighted"), F.transform(kept, lambda x: x.n / (F.col("all") + 10)).alias("weight"))
        rates = by.groupBy("cipher").agg(F.sum("n").alias("n")).collect()  # a row a cipher
        overall = {r.cipher: r.n / sum(x.n for x in rates) for r in rates if r.cipher >= 0}
    sent = spark.sparkContext.broadcast((model.both, model.one, overall))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, everywhere = Model(*sent.value[:2]), sent.value[2]
        for b in pieces(batches):
            out, s = posterior(b, m, everywhere)
            same = np.zeros(len(b))
            same[out.row[out.cipher < 0]] = s[out.cipher < 0]
            out["gain"] = s - same[out.row]
            best = out[out.cipher >= 0].sort_values("gain").groupby("row").tail(1)
            best = best[best.gain > 0]
            yield pd.DataFrame({"source": b.source.to_numpy()[best.row], "word": b.word.to_numpy()[best.row], "cipher": best.cipher, "plain": best.plain, "gain": best.gain})

    return with_weights().mapInPandas(judge, "source string, word string, cipher int, plain string, gain double")


def told() -> tuple[Column, Column]:
    """Of a text's garbled word types: how many there are, and whether one shows a cipher with several symbols a letter."""
    return F.count("*").alias("types"), F.bool_or(~F.col("cipher").isin(*KEEPING)).alias("several")


def enough(least: float) -> Column:
    """One word alone doesn't tell a cipher of one byte a letter from an odd word, unless it is far likelier."""
    return (F.col("gain") >= least) & (F.col("several") | (F.col("types") > 1) | (F.col("gain") >= least + 18))


def known_words(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """WORDS of the docs with ids and texts, and those of (id, source, word) that are garbled, with cipher, plain and gain."""
    docs = docs.where("id IS NOT NULL AND text IS NOT NULL").select("id", "source", "text")
    odd = materialize(odd_words(docs), "odd-words", compression="zstd")
    known = materialize(learn(odd), "garbled-words").where("gain > 0.5")
    k = known.select(F.col("source").alias("of"), F.col("word").alias("known"), "gain", "cipher", "plain")
    return odd, odd.join(k, F.col("source").eqNullSafe(F.col("of")) & (F.col("word") == F.col("known"))).drop("of", "known")


def garbled(docs: DataFrame, least: float = 2.0) -> DataFrame:
    """(id, gain, ciphers) of the docs (id, source, text) of which a part is garbled.

    least: the log of how much likelier the deciphered words of a text must be, all together. A text with replacement characters is
    garbled. Null ids, null and blank texts are never; a null source is a source of its own. Texts, and words of any length, are read
    whole. An empty table gives no rows.
    """
    odd, hits = known_words(docs)
    hits = hits.groupBy("id").agg(F.sum("gain").alias("gain"), F.array_sort(F.collect_set("cipher")).alias("ciphers"), *told()).where(enough(least))
    hits = hits.select("id", "gain", "ciphers")
    lost = odd.where(F.contains("word", F.lit(LOST))).select("id", F.lit(float("inf")).alias("gain"), F.array().cast("array<int>").alias("ciphers"))
    return hits.unionByName(lost).groupBy("id").agg(F.max("gain").alias("gain"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ciphers")))).alias("ciphers"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "source", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled(documents(spark, folder)).select(F.col("id").alias("doc_id"))


def restored(docs: DataFrame, least: float = 2.0) -> DataFrame:
    """(id, text): the garbled docs with every garbled word deciphered by the likeliest of its source's ciphers.

    Replacement characters stay: what they stood for is lost. Texts with nothing else garbled are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        reader = Reader()

        def again(word: str, kept: str, plain: str, k: int) -> str:
            if k in KEEPING:  # the digits, which `kept` has as 0, are not among what changes
                return word.translate({ord(a): b for a, b in zip(kept, plain, strict=True) if a != b})
            return reader.decipher(word, k) or word

        for b in batches:
            texts = []
            for text, words, plains, numbers in zip(b.text, b.words, b.plains, b.ciphers, strict=True):
                of = {w: (w, p, k) for w, p, k in zip(words, plains, numbers, strict=True)}
                texts.append(re.sub(r"[A-Za-z0-9\x80-\U0010ffff]+", lambda m, of=of: again(m[0], *of[k]) if not m[0].isascii() and (k := re.sub("[0-9]", "0", m[0])) in of else m[0], text))
            yield pd.DataFrame({"id": b.id, "text": texts})

    _, hits = known_words(docs)
    hits = hits.groupBy("id").agg(F.sum("gain").alias("gain"), F.array_sort(F.collect_list(F.struct("word", "plain", "cipher"))).alias("w"), *told()).where(enough(least))
    both = docs.where("text IS NOT NULL").select("id", "text").join(hits, "id").select("id", "text", F.col("w.word").alias("words"), F.col("w.plain").alias("plains"), F.col("w.cipher").alias("ciphers"))
    return both.mapInPandas(run, "id long, text string")


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    return restored(documents(spark, folder)).withColumnRenamed("id", "doc_id")


QUERIES = {"p9_found": p9_found, "p9_restored": p9_restored}
SQL: dict[str, str] = {}
