"""Column functions that take model outputs apart. All give null where there is nothing to extract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The marks of code in a model's output.
OPEN, FENCE, ASSIGN, HOLE = "```lean4", "```", ":= by", "sorry"
KEYWORDS = ("theorem ", "lemma ", "def ")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; trim() takes blanks only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def count_of(c: Column, literal: str) -> Column:
    """How often a literal stands in a text, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def after_first(c: Column, literal: str) -> Column:
    at = F.locate(literal, c)
    return F.when(at > 0, F.substr(c, at + len(literal)))


def before_last(c: Column, literal: str) -> Column:
    """What stands before the last occurrence; null if there is none."""
    return F.when(F.contains(c, F.lit(literal)), F.substr(c, F.lit(1), F.length(c) - F.length(F.substring_index(c, literal, -1)) - len(literal)))


def proof_lenient(c: Column) -> Column:
    """The proof after the last opening fence and the first assignment, up to the last fence if there is one."""
    code = F.when(F.contains(c, F.lit(OPEN)), F.substring_index(c, OPEN, -1))
    body = after_first(code, ASSIGN)
    return F.coalesce(before_last(body, FENCE), body)


def proof_strict(c: Column) -> Column:
    """As proof_lenient, for outputs that are one fenced block with one declaration."""
    s = strip(c)
    whole = s.startswith(OPEN) & s.endswith(FENCE) & (count_of(s, OPEN) == 1) & (count_of(s, FENCE) == 2)
    declared = sum((count_of(s, k) for k in KEYWORDS), F.lit(0))
    return F.when(whole & (declared == 1), proof_lenient(s))


def conjecture(c: Column) -> Column:
    """The statement of the last fenced block: one assignment, at most one hole, and nothing after these."""
    code = before_last(F.when(F.contains(c, F.lit(OPEN)), F.substring_index(c, OPEN, -1)), FENCE)
    s = strip(code)
    sound = (count_of(code, ASSIGN) == 1) & (count_of(code, HOLE) <= 1) & (s.endswith(HOLE) | s.endswith(ASSIGN))
    return F.when(sound, strip(F.concat(F.substring_index(code, ASSIGN, 1), F.lit(ASSIGN))))


#: What a model's configuration can name to take its outputs apart.
EXTRACTORS = {"lenient": proof_lenient, "strict": proof_strict, "conjecture": conjecture}


def without_comments(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"/-[\s\S]*?-/", ""), r"(?d)--.*", "")


def tagged_number(c: Column, name: str) -> Column:
    """The number between the last opening and the last closing tag of a name; infinity and NaN are numbers."""
    inner = F.substring_index(before_last(c, f"</{name}>"), f"<{name}>", -1)
    inner = F.when(F.contains(c, F.lit(f"<{name}>")), strip(inner))
    return F.when(inner.rlike(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan|Inf|NaN|Infinity)$"), inner.try_cast("double"))


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, however often the expression has it."""
    return F.transform(F.array(value), of)[0]


def header_and_body(c: Column) -> tuple[Column, Column]:
    """A file's header and the rest. The header is its leading import, set_option, open and blank lines, trimmed, each once and in order,
    behind one `import Mathlib` for all lines that begin so; two line ends follow it."""
    split = F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    lines = let(split, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))

    def size(x: Column) -> Column:
        other = F.array_position(F.transform(x, lambda y: strip(y).rlike("^((import|set_option|open) |$)")), False).cast("int")
        return let(other, lambda k: F.when(k > 0, k - 1).otherwise(F.size(x)))

    def header(head: Column) -> Column:
        rest = F.array_distinct(F.filter(head, lambda y: ~y.startswith("import Mathlib")))
        first = F.when(F.exists(head, lambda y: y.startswith("import Mathlib")), F.array(F.lit("import Mathlib"))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array_join(F.concat(first, rest), "\n"), F.lit("\n\n"))

    def parts(x: Column, n: Column) -> Column:
        head = F.filter(F.transform(F.slice(x, F.lit(1), n), strip), lambda y: y != "")
        return F.struct(let(head, header).alias("header"), F.array_join(F.slice(x, n + 1, F.size(x)), "\n").alias("body"))

    both = let(lines, lambda x: let(size(x), lambda n: parts(x, n)))
    return both.getField("header"), both.getField("body")


def before_fence(c: Column) -> Column:
    """What stands before the first fence; all of a text without one."""
    return F.substring_index(c, FENCE, 1)


def at_line(c: Column, line: Column, column: Column) -> Column:
    """The character, from 0, at a line and a column, both from 0; null beyond the last line."""
    lines = F.split(c, "\n")
    before = F.aggregate(F.slice(lines, F.lit(1), line), F.lit(0), lambda n, x: n + F.length(x) + 1)
    return F.when(line < F.size(lines), before + column)


def gigabytes(c: Column, shares: Column) -> Column:
    """The whole gigabytes of a memory size such as 128G for each of `shares`, one at least; null for anything else."""
    n = F.regexp_extract(c, r"^(\d+)G$", 1).try_cast("int")
    return F.when(n.isNotNull(), F.greatest(F.floor(n / F.greatest(shares, F.lit(1))), F.lit(1)))


def minutes(c: Column) -> Column:
    """D-HH:MM:SS, HH:MM:SS or HH:MM in minutes; seconds don't count, an empty text is 0, anything else null."""
    days = F.coalesce(F.regexp_extract(c, r"^(\d+)-", 1).try_cast("int"), F.lit(0))
    hours, mins = (F.regexp_extract(c, r"^(?:\d+-)?(\d+):(\d+)(?::\d+)?$", k).try_cast("int") for k in (1, 2))
    return F.when(c == "", 0).otherwise(days * 1440 + hours * 60 + mins)


def cpu_count(c: Column) -> Column:
    """How many numbers a list such as 0-3,8,10-11 has."""
    one = lambda p: F.when(F.contains(p, F.lit("-")), F.split(p, "-")[1].try_cast("int") - F.split(p, "-")[0].try_cast("int") + 1).otherwise(1)
    return F.aggregate(F.filter(F.split(c, ","), lambda p: F.trim(p) != ""), F.lit(0), lambda n, p: n + one(F.trim(p)))


def at_byte(c: Column, byte: Column) -> tuple[Column, Column, Column]:
    """Line, column and character, from 0, of a byte offset of a text in UTF-8 that falls between two characters."""
    before = F.decode(F.substring(F.encode(c, "UTF-8"), 1, byte), "UTF-8")
    return count_of(before, "\n"), F.length(F.substring_index(before, "\n", -1)), F.length(before)
