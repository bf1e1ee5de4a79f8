"""Problem 3: texts whose end was lost, found by trigrams that are frequent inside texts but almost never end one, in pure SQL.

A text is cut at its code fences; each part gives a sequence of tokens (words in lower case, numbers and names with digits as 0,
line ends, and single other characters) that begins with three marks. Every trigram carries where it lies: in prose, in a code block,
or in bare code (a part outside of fences that has an assignment, or begins with a keyword) before or after its first assignment.
Trigrams are counted where they stand inside texts and where they end one. The trigram that ends a text flags it if, of all the
other places where it stands, almost none is an end. Trigrams seen too seldom to tell fall back on the last two tokens, then on
the last one. A last word that hardly follows its predecessor anywhere else, while words that begin like it often do, was cut in two.
All counts are over distinct texts: copies of a truncated text don't prove its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmalake.sources.tables import table
from lemmalake.storage import materialize

#: What is put after a cut, besides white space.
MARKERS = ("...", "…", "[...]", "[…]", "[truncated]", "[cut]", "<truncated>", "�")

#: The words with which code outside of a fence begins.
KEYWORDS = "theorem|lemma|example|def|instance|have"

#: Words with digits as 0, line ends, and other characters.
TOKEN = r"[\\p{L}_0₀-₉]++(?:\\.[\\p{L}_0]++)*+|\\n|[^\\s]"

#: The text in lower case, digits as 0; what was put after a cut is taken off before.
PLAIN = "regexp_replace(translate(lower({x}), '123456789', '000000000'), '0+', '0')"
CUT = "reverse(regexp_replace(reverse(text), '(?i)^(\\\\s|{markers})+', ''))"
#: Where a part lies: 0 in prose, 1 in a fence, 2 and 3 in bare code.
BARE = "fence = 0 AND part RLIKE '(?i)^\\\\s*({keywords})\\\\b' AND NOT contains(part, ':=')"

PARTS = """
    WITH lines AS (SELECT split({plain}, '```') AS parts FROM {rows} WHERE id IS NOT NULL AND text RLIKE '[\\\\p{{L}}\\\\p{{N}}]'),
    fenced AS (SELECT k % 2 AS fence, k = size(parts) - 1 AS final, part FROM lines LATERAL VIEW posexplode(parts) AS k, part)
    SELECT code, p AS part, final AND (code < 3 OR NOT contains(part, ':=')) AS last FROM fenced LATERAL VIEW inline(
        if({bare}, array(named_struct('code', 3, 'p', part)),
        if(fence = 0 AND contains(part, ':='), array(named_struct('code', 3, 'p', substring_index(part, ':=', 1)), named_struct('code', 2, 'p', substr(part, instr(part, ':=')))),
           array(named_struct('code', fence, 'p', part))))) AS code, p"""

#: How often each trigram stands anywhere. Of its first two tokens hashes are kept: they are compared, but not read.
SEEN = """
    WITH tokens AS (SELECT code, concat(array('^', '^', '^'), regexp_extract_all(part, '{token}', 0), if(last, array(), array('```'))) AS t FROM {parts})
    SELECT code, xxhash64(a, b) AS a, xxhash64(b) AS b, c, count(*) AS n FROM tokens LATERAL VIEW inline(
        arrays_zip(slice(t, 1, size(t) - 2), slice(t, 2, size(t) - 2), slice(t, 3, size(t) - 2))) AS a, b, c GROUP BY ALL"""

#: The last three tokens of each text. They are read from the last 300 characters, unless these have too few.
ENDS = """
    WITH lines AS (SELECT tbl, id, split({cut}, '```') AS parts FROM {rows} WHERE id IS NOT NULL AND text RLIKE '[\\\\p{{L}}\\\\p{{N}}]'),
    fenced AS (SELECT tbl, id, (size(parts) - 1) % 2 AS fence, element_at(parts, -1) AS part FROM lines),
    coded AS (SELECT tbl, id, CASE WHEN {bare} THEN 3 WHEN fence = 0 AND contains(part, ':=') THEN 2 ELSE fence END AS code,
        if(fence = 0 AND contains(part, ':='), substr(part, instr(part, ':=')), part) AS part FROM fenced),
    near AS (SELECT tbl, id, code, part, regexp_extract_all({near}, '{token}', 0) AS w FROM coded),
    tokens AS (SELECT tbl, id, code, concat(array('^', '^', '^'), if(length(part) <= 300 OR size(w) > 3, w, regexp_extract_all({whole}, '{token}', 0))) AS t FROM near)
    SELECT tbl, id, code, xxhash64(t[size(t) - 3], t[size(t) - 2]) AS a, xxhash64(t[size(t) - 2]) AS b, t[size(t) - 1] AS c FROM tokens"""

#: n and e count the other places where the tokens stand and those of them that end a text; longer, how often a word that begins
#: like the last one stands after the same token, inner, how often the last word itself does inside a text. Beginnings are made only
#: of the lengths that last words have after that token, and compared by hash, so that a word of any length stays one row for each.
FLAGGED = """
    WITH last AS (SELECT code, a, b, c, count(*) AS ends FROM {ends} GROUP BY ALL),
    seen AS (SELECT code, a, b, c, n, coalesce(ends, 0) AS ends FROM {seen} LEFT JOIN last USING (code, a, b, c)),
    ended AS (SELECT code, a, b, c, n AS n3, ends AS e3 FROM seen WHERE ends > 0),
    pairs AS (SELECT code, b, c, sum(n) AS n2, sum(ends) AS e2 FROM seen GROUP BY ALL),
    twos AS (SELECT * FROM pairs WHERE e2 > 0),
    ones AS (SELECT code, c, sum(n2) AS n1, sum(e2) AS e1 FROM pairs GROUP BY code, c HAVING sum(e2) > 0),
    cuts AS (SELECT code, b, collect_set(length(c)) AS sizes FROM last WHERE c RLIKE '^[\\\\p{L}_]' GROUP BY code, b),
    begun AS (
        SELECT code, b, xxhash64(left(c, k)) AS h, k, sum(n2 - e2) AS longer FROM pairs JOIN cuts USING (code, b) LATERAL VIEW explode(filter(sizes, k -> k < length(c))) AS k
        WHERE length(c) > 1 AND c RLIKE '^[\\\\p{L}_]' GROUP BY code, b, xxhash64(left(c, k)), k),
    judged AS (
        SELECT ended.code, a, ended.b, c, coalesce(longer, 0) AS longer, n2 - e2 AS inner,
            CASE WHEN n3 > {least} THEN struct(n3 - 1 AS n, e3 - 1 AS e) WHEN n2 > {least} THEN struct(n2 - 1 AS n, e2 - 1 AS e)
                WHEN n1 > {least} THEN struct(n1 - 1 AS n, e1 - 1 AS e) ELSE struct(1L AS n, 0L AS e) END AS s
        FROM ended JOIN twos USING (code, b, c) JOIN ones USING (code, c) LEFT JOIN begun ON ended.code = begun.code AND ended.b = begun.b AND xxhash64(c) = h AND length(c) = k),
    flagged AS (SELECT code, a, b, c FROM judged WHERE (s.e - {sure} * sqrt(s.e)) / s.n < {share} OR longer > 10 * inner + 5)
    SELECT DISTINCT tbl, id FROM {ends} JOIN flagged USING (code, a, b, c)"""


def truncated(rows: DataFrame, least: int = 40, share: float = 0.004, sure: float = 1.3) -> DataFrame:
    """(tbl, id) of the rows (tbl, id, text) whose end was lost.

    least: how many other places a trigram (or pair, or token) must stand at to be judged; share: the share of these that are
    ends below which it flags, after `sure` standard errors are taken off the number of ends. Null ids, null texts and texts without a letter or digit are never flagged; equal texts (but for
    what was put after a cut) count once, and all their rows are flagged. Texts are read whole; what is judged is the end alone, so a long text isn't flagged for its length.
    """
    spark = rows.sparkSession
    markers = "|".join("".join(f"[{c}]" if c not in "[]" else "\\\\" + c for c in reversed(m)) for m in MARKERS)
    cut = CUT.replace("{markers}", markers)
    holes = {"cut": cut, "plain": PLAIN.replace("{x}", cut), "near": PLAIN.replace("{x}", "right(part, 300)"), "whole": PLAIN.replace("{x}", "part"), "bare": BARE.replace("{keywords}", KEYWORDS), "token": TOKEN.replace("{L}", "{{L}}")}

    def filled(sql: str) -> str:
        for name, value in holes.items():
            sql = sql.replace("{" + name + "}", value)
        return sql

    rows = rows.where("id IS NOT NULL AND text IS NOT NULL").select("tbl", "id", F.expr(cut).alias("text"))
    rows = materialize(rows.withColumns({"one": F.xxhash64("text"), "two": F.xxhash64(F.lit(17), "text")}), "cut-texts", compression="zstd")
    # the statements name a text by (tbl, id); a distinct one has two hashes
    distinct = rows.groupBy("one", "two").agg(F.first("text").alias("text")).select(F.col("one").alias("tbl"), F.col("two").alias("id"), "text")
    distinct = materialize(distinct, "distinct-texts", compression="zstd")
    ends = materialize(spark.sql(filled(ENDS), rows=distinct), "ends", compression="zstd")
    seen = materialize(spark.sql(filled(SEEN), parts=spark.sql(filled(PARTS), rows=distinct)), "trigrams", compression="zstd")
    flagged = FLAGGED.replace("{L}", "{{L}}")
    for name, value in (("least", int(least)), ("share", float(share)), ("sure", float(sure))):
        flagged = flagged.replace("{" + name + "}", str(value))
    found = spark.sql(flagged, seen=seen, ends=ends).select(F.col("tbl").alias("one"), F.col("id").alias("two"))
    return rows.select("tbl", "id", "one", "two").join(found, ["one", "two"]).select("tbl", "id").distinct()


def texts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    a = table(spark, folder, "attempts").select(F.lit("attempts").alias("tbl"), F.col("attempt_id").alias("id"), F.col("full_generation").alias("text"), *columns)
    s = table(spark, folder, "train_samples").select(F.lit("train_samples").alias("tbl"), F.col("sample_id").alias("id"), F.col("gen_str").alias("text"), *columns)
    return a.unionByName(s)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncated(texts(spark, folder)).select("tbl", F.col("id").alias("row_id"))


def p3_sources(spark: SparkSession, folder: str) -> DataFrame:
    """For each table and source its texts, how many of them are truncated, and their share."""
    found = truncated(texts(spark, folder)).withColumn("hit", F.lit(1))
    rows = texts(spark, folder, "source").where(F.col("text").rlike(r"[\p{L}\p{N}]")).select("tbl", "id", "source").distinct()
    out = rows.join(found, ["tbl", "id"], "left").groupBy("tbl", "source").agg(F.count("*").alias("n_texts"), F.count("hit").alias("n_truncated"))
    return out.withColumn("share", F.round(F.col("n_truncated") / F.col("n_texts"), 6))


QUERIES = {"p3_found": p3_found, "p3_sources": p3_sources}
SQL: dict[str, str] = {}
