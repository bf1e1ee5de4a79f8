"""Problem 6: records that are one and the same but for white space, letter case, punctuation or the order of their binders.

The characters of a batch's texts, about two million at a time, stream through one lookup table, which gives 0 for a character to skip and else the folded
character, into rolling polynomial hashes (modulo 2^64, two bases); canonical strings are never made. Rows of a batch with equal hashes
are compared at once by two pointers that skip what the table skips, and only the one with the least id goes on to the shuffle:
a text of which there are very many copies sends one row for each batch. After the shuffle by hash the rest are compared in the same
way, as a stream of sorted rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmalake.llm.similar import slices
from lemmalake.sources.tables import table
from lemmalake.storage import materialize

LOW = 0x20000
#: Two odd bases of the polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SEQUENCE, THEOREM = "sequence", "theorem"


def fold_char(c: str) -> int:
    """The first letter or digit of the character's lower case; 0 if it is neither a letter nor a digit."""
    if unicodedata.category(c)[0] not in "LN":
        return 0
    return next((ord(x) for x in c.lower() if unicodedata.category(x)[0] in "LN"), 0)


def fold_table() -> np.ndarray:
    """For each character below LOW what it folds to. Higher ones are looked up one by one."""
    return np.array([fold_char(chr(c)) for c in range(LOW)], dtype=np.uint32)


def folded(texts: list[str], fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded characters of all texts, one after another, 0 where skipped; and where each text begins, with the end."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))))
    high = codes >= LOW
    out = fold[np.where(high, 0, codes)]
    if high.any():
        kinds, where = np.unique(codes[high], return_inverse=True)
        out = out.copy()
        out[high] = np.array([fold_char(chr(c)) for c in kinds], dtype=np.uint32)[where]
    return out, ends


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Hasher:
    """Polynomial hashes of spans of a batch's texts, by their skipped and folded characters."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray) -> None:
        keep = codes != 0
        self.at = np.concatenate(([0], np.cumsum(keep)))  # how many kept characters lie before each character
        kept = codes[keep]
        starts = self.at[ends]
        sizes = np.diff(starts)
        self.place = np.arange(len(kept) + 1) - np.append(np.repeat(starts[:-1], sizes), starts[-1])
        most = int(sizes.max(initial=0)) + 1
        self.sums, self.back = [], []
        with np.errstate(over="ignore"):
            value = mix(kept.astype(np.uint64) + np.uint64(0x1F3D5B79))
            for base in BASES:
                up = np.cumprod(np.append(np.uint64(1), np.full(most, base, dtype=np.uint64)), dtype=np.uint64)
                down = np.cumprod(np.append(np.uint64(1), np.full(most, pow(base, -1, 1 << 64), dtype=np.uint64)), dtype=np.uint64)
                self.sums.append(np.append(np.uint64(0), np.cumsum(value * up[self.place[:-1]], dtype=np.uint64)))
                self.back.append(down)

    def spans(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes and the number of kept characters of each span [start, end) of characters of the batch, each within one text."""
        a, b = self.at[start], self.at[end]
        with np.errstate(over="ignore"):
            shift = np.where(b > a, self.place[a], 0)
            one, two = ((s[b] - s[a]) * d[shift] for s, d in zip(self.sums, self.back, strict=True))
        return one, two, b - a


def parts(text: str) -> tuple[int, list[tuple[int, int]], int]:
    """Where the name of a theorem ends, the spans of the bracketed binders after it, and where the goal begins.

    The name ends at the first bracket or colon; the goal begins at the first colon outside of all brackets. Without brackets there are no
    binders; without such a colon there is no goal; a bracket that never closes leaves what follows it in the goal.
    """
    import re

    name, goal, depth, begin, binders = -1, len(text), 0, 0, []
    for m in re.finditer(r"[(){}\[\]:]", text):
        c, k = m[0], m.start()
        if c in "({[":
            name = k if name < 0 else name
            begin = k if depth == 0 else begin
            depth += 1
        elif c == ":":
            if depth == 0:
                return (k if name < 0 else name), binders, k
        elif depth:
            depth -= 1
            if depth == 0:
                binders.append((begin, k + 1))
    if depth:
        goal = begin
    return (goal if name < 0 else name), binders, goal


def hashes(texts: list[str], kinds: list[str], fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each text, by its kind, and the number of characters that count."""
    h = Hasher(*folded(texts, fold))
    ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))))
    one, two, size = h.spans(ends[:-1], ends[1:])
    own = [k for k, kind in enumerate(kinds) if kind == THEOREM]
    if own:
        row, role, start, end = [], [], [], []
        for k in own:
            name, binders, goal = parts(texts[k])
            last = binders[-1][1] if binders else name
            loose = zip([name] + [b for _, b in binders], [a for a, _ in binders] + [goal], strict=True)
            spans = [(0, 0, name), (1, goal, len(texts[k]))] + [(2, a, b) for a, b in binders] + [(3, a, b) for a, b in loose if b > a and last <= goal]
            for r, a, b in spans:
                row.append(k), role.append(r), start.append(ends[k] + a), end.append(ends[k] + b)
        row, role = np.array(row), np.array(role, dtype=np.uint64)
        part = h.spans(np.array(start), np.array(end))
        counts = (part[2] > 0) | (role < 3)
        with np.errstate(over="ignore"):
            for out, p, salt in ((one, part[0], 11), (two, part[1], 29)):
                v = mix(p * np.uint64(2 * salt + 1) + part[2].astype(np.uint64) + mix(role + np.uint64(salt)))
                total = np.zeros(len(texts), dtype=np.uint64)
                np.add.at(total, row[counts], v[counts])
                out[own] = total[own]
    return one, two, size


def runs_equal(a: str, b: str) -> bool:
    """Whether two texts have the same letters and digits in lower case: two pointers, each skipping everything else."""
    import regex

    find = regex.compile(r"[\p{L}\p{N}]+").finditer
    x, y, p, q = find(a), find(b), "", ""
    while True:
        while not p:
            if (m := next(x, None)) is None:
                break
            p = "".join(filter(None, (chr(f) if (f := fold_char(c)) else "" for c in m[0]))) if not m[0].isascii() else m[0].lower()
        while not q:
            if (m := next(y, None)) is None:
                break
            q = "".join(filter(None, (chr(f) if (f := fold_char(c)) else "" for c in m[0]))) if not m[0].isascii() else m[0].lower()
        if not p or not q:
            return not p and not q
        k = min(len(p), len(q))
        if p[:k] != q[:k]:
            return False
        p, q = p[k:], q[k:]


def same(a: str, b: str, kind: str) -> bool:
    """Whether two texts with equal hashes are really the same."""
    if a == b:
        return True
    if kind != THEOREM:
        return runs_equal(a, b)
    (na, ba, ga), (nb, bb, gb) = parts(a), parts(b)
    if len(ba) != len(bb) or not runs_equal(a[:na], b[:nb]) or not runs_equal(a[ga:], b[gb:]):
        return False
    left = [b[s:e] for s, e in bb]
    for s, e in ba:
        k = next((k for k, x in enumerate(left) if runs_equal(a[s:e], x)), None)
        if k is None:
            return False
        left.pop(k)
    return True


def classes(rows: DataFrame) -> DataFrame:
    """(tbl, id, rep) of rows (tbl, kind, id, text): rep is the smallest id of the rows of the same tbl that are the same text.

    kind is `sequence` (the same letters and digits in the same order) or `theorem` (so for the name, the goal, and the binders in any
    order). Rows with a null id or text, or a text without letters and digits, are left out. Rows that repeat an id with an
    equal text count once. An empty table gives no rows. Texts of any length are read whole.
    """
    fold = rows.sparkSession.sparkContext.broadcast(fold_table())  # LOW entries

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (s for batch in batches for s in slices(batch, "text", 2_000_000)):
            b = b.sort_values(["tbl", "id"]).reset_index(drop=True)
            texts, kinds = b.text.tolist(), b.kind.tolist()
            one, two, size = hashes(texts, kinds, fold.value)
            b["a"], b["b"] = one.view(np.int64), two.view(np.int64)
            first: dict[tuple, list[int]] = {}
            rep = np.arange(len(b))
            for k, key in enumerate(zip(b.tbl, b.a, b.b, strict=True)):
                if not size[k]:
                    continue
                known = first.setdefault(key, [])
                r = next((r for r in known if same(texts[r], texts[k], kinds[k])), None)
                if r is None:
                    known.append(k)
                else:
                    rep[k] = r
            b["rep"] = b.id.to_numpy()[rep]
            b["text"] = np.where(rep == np.arange(len(b)), b.text, None)
            yield b[size > 0][["tbl", "kind", "id", "a", "b", "rep", "text"]]

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, known = None, []
        for b in batches:
            rep = b.id.to_numpy().copy()
            for k, (t, x, y, i, text, kind) in enumerate(zip(b.tbl, b.a, b.b, b.id, b.text, b.kind, strict=True)):
                if (t, x, y) != now:
                    now, known = (t, x, y), [(i, text)]
                    continue
                r = next((r for r, other in known if same(other, text, kind)), None)
                if r is None:
                    known.append((i, text))
                else:
                    rep[k] = r
            yield pd.DataFrame({"tbl": b.tbl, "id": b.id, "rep": rep})

    rows = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select("tbl", "kind", "id", "text")
    hashed = materialize(rows.mapInPandas(local, "tbl string, kind string, id long, a long, b long, rep long, text string"), "hashed", compression="zstd")
    heads = hashed.where("text IS NOT NULL").repartition("tbl", "a", "b").sortWithinPartitions("tbl", "a", "b", "id")
    heads = heads.mapInPandas(across, "tbl string, id long, rep long")
    members = hashed.where("text IS NULL").select("tbl", "id", F.col("rep").alias("head"))
    by_head = heads.select("tbl", F.col("id").alias("head"), "rep").distinct()
    return heads.unionByName(members.join(by_head, ["tbl", "head"]).select("tbl", "id", "rep")).distinct()


def proofs_and_theorems(spark: SparkSession, folder: str) -> DataFrame:
    a, s = table(spark, folder, "attempts"), table(spark, folder, "statements")
    proofs = a.where(F.trim("proof_str") != "NO CODE FOUND").select(F.lit("attempts").alias("tbl"), F.lit(SEQUENCE).alias("kind"), F.col("attempt_id").alias("id"), F.col("proof_str").alias("text"))
    theorems = s.select(F.lit("statements").alias("tbl"), F.lit(THEOREM).alias("kind"), F.col("rec_id").alias("id"), F.col("theorem").alias("text"))
    return proofs.unionByName(theorems)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = classes(proofs_and_theorems(spark, folder)).where("id <> rep")
    return found.select("tbl", F.col("rep").alias("id_a"), F.col("id").alias("id_b"))


def p6_copies(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each different text: the smallest id that has it, and how many records do."""
    return classes(proofs_and_theorems(spark, folder)).groupBy("tbl", F.col("rep").alias("id")).agg(F.count("*").alias("copies"))


QUERIES = {"p6_found": p6_found, "p6_copies": p6_copies}
#: Keys of the texts by the definition: letters and digits in lower case, of theorems for name, sorted binders and goal, which begins at the first colon
#: outside of brackets.
COPIES = """WITH p AS (SELECT DISTINCT 'attempts' AS tbl, attempt_id AS id, {bare:proof_str} AS key FROM attempts WHERE proof_str IS NOT NULL AND trim(proof_str) <> 'NO CODE FOUND'),
    t AS (SELECT DISTINCT rec_id AS id, theorem AS x FROM statements WHERE theorem IS NOT NULL AND {bare:theorem} <> ''),
    c AS (SELECT id, x, unnest(range(1, length(x) + 1)) AS k FROM t),
    d AS (SELECT id, k, substr(x, k, 1) AS c, sum(CASE WHEN substr(x, k, 1) IN ('(', '{', '[') THEN 1 WHEN substr(x, k, 1) IN (')', '}', ']') THEN -1 ELSE 0 END) OVER (PARTITION BY id ORDER BY k) AS depth FROM c),
    g AS (SELECT id, coalesce(min(k) FILTER (c = ':' AND depth = 0), max(k) + 1) AS goal, coalesce(min(k) FILTER (c IN ('(', '{', '[', ':')), max(k) + 1) AS name FROM d GROUP BY id),
    b AS (SELECT d.id, k, c, sum((depth = 1 AND c IN ('(', '{', '['))::INT) OVER (PARTITION BY d.id ORDER BY k) AS n, depth > 0 OR c IN (')', '}', ']') AS inside FROM d JOIN g USING (id) WHERE k >= name AND k < goal),
    s AS (SELECT id, n, string_agg(c, '' ORDER BY k) AS x FROM b WHERE inside GROUP BY ALL),
    l AS (SELECT id, list_sort(list({bare:x})) AS binders FROM s GROUP BY id),
    q AS (SELECT 'statements' AS tbl, id, concat_ws('|', {bare:substr(x, 1, name - 1)}, array_to_string(binders, ','), {bare:substr(x, goal)}) AS key FROM t JOIN g USING (id) LEFT JOIN l USING (id)),
    r AS (SELECT tbl, id, min(id) OVER (PARTITION BY tbl, key) AS rep FROM (SELECT * FROM p WHERE key <> '' UNION ALL SELECT * FROM q))"""


def filled(sql: str) -> str:
    """SQL with {bare:x} as the letters and digits of x in lower case."""
    import re

    return re.sub(r"\{bare:((?:[^{}])*)\}", lambda m: f"regexp_replace(lower({m[1]}), '[^\\p{{L}}\\p{{N}}]', '', 'g')", sql)


SQL = {
    "p6_found": filled(COPIES) + " SELECT tbl, rep AS id_a, id AS id_b FROM r WHERE id <> rep",
    "p6_copies": filled(COPIES) + " SELECT tbl, rep AS id, count(*) AS copies FROM r GROUP BY tbl, rep",
}
