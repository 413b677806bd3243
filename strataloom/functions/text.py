"""Text columns that stay in the JVM: normal forms, search tokens, clause numbers, wording of limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Width forms and their plain characters, built from the code chart's constant offset.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "
TOKEN = r"([\x{3400}-\x{9fff}]+|[a-z0-9]+(?:[.][0-9]+)*)"
CLAUSE = r"^\s*([0-9]+(?:[.][0-9]+){1,})\s"

# Chinese wording of limits and the comparison each stands for, longer wording first.
LIMIT_WORDS = {
    "应不大于": "le", "不应大于": "le", "不得大于": "le", "不应超过": "le", "不得超过": "le", "不超过": "le", "不大于": "le", "应不小于": "ge", "不应小于": "ge", "不得小于": "ge",
    "不小于": "ge", "不低于": "ge", "应小于": "lt", "应低于": "lt", "应大于": "gt", "应等于": "eq", "小于": "lt", "低于": "lt", "大于": "gt", "高于": "gt", "等于": "eq",
}


def folded(text: Column) -> Column:
    """Plain width, lower case, sharp s as ss: the form in which search compares text. Null stays null."""
    return F.replace(F.lower(F.translate(text, _WIDE, _NARROW)), F.lit("ß"), F.lit("ss"))


def normalized(text: Column) -> Column:
    """Plain width, lower case, no white space: the form in which names compare. Null stays null."""
    return F.regexp_replace(F.lower(F.translate(text, _WIDE, _NARROW)), r"\s+", "")


def compact(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text, r"\s+", "")


def search_tokens(text: Column) -> Column:
    """Distinct search tokens: neighbouring pairs of ideographs (a lone one as itself) and words of letters and digits."""
    runs = F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))
    pairs = lambda run: F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, 2))
    pieces = F.transform(runs, lambda run: F.when(run.rlike(r"^[\x{3400}-\x{9fff}]"), pairs(run)).otherwise(F.array(run)))
    return F.array_distinct(F.flatten(pieces))


def clause_number(text: Column) -> Column:
    """The dotted number at the start of a text, null if it has none."""
    found = F.regexp_extract(F.translate(text, _WIDE, _NARROW), CLAUSE, 1)
    return F.when(found != "", found)


def number_path(number: Column) -> Column:
    """A dotted number as an array of ints, which sorts naturally and compares by prefix."""
    return F.transform(F.split(number, r"\."), lambda part: part.try_cast("bigint"))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the values in order, nulls written as a sign of their own."""
    return F.sha2(F.concat_ws("\u0001", *(F.coalesce(c.cast("string"), F.lit("\u0002")) for c in columns)), 256)
