"""Tables of reviewer replies: fences, JSON, column lists, payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col

BLANK = " \t\n\r"
FENCES = ("```json", "```sql", "```")


def strip_fence(reply: Column) -> Column:
    """The reply without code fences and outer white space."""
    for mark in FENCES:
        reply = F.replace(reply, F.lit(mark), F.lit(""))
    return F.trim(reply, F.lit(BLANK))


def outer_braces(reply: Column) -> Column:
    """From the first { to the last }: one pass over the text, whatever its length or nesting."""
    first = F.instr(reply, "{")
    last = F.length(reply) - F.instr(F.reverse(reply), "}") + 1
    return F.when((first > 0) & reply.contains("}") & (last > first), F.substr(reply, first, last - first + 1))


def parse_json(reply: Column, schema: str) -> Column:
    """The reply as it is, else without fences, else from its first { to its last }; NULL if none parses."""
    bad = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    wanted = f"{schema}, _bad string"

    def tried(text: Column) -> Column:
        parsed = F.from_json(text, wanted, bad)
        whole = F.trim(text, F.lit(BLANK)).startswith("{") & parsed["_bad"].isNull()
        return F.when(whole, parsed)

    return F.coalesce(tried(reply), tried(strip_fence(reply)), tried(outer_braces(reply)))


def _after(reply: Column, keyword: str, sign: str) -> Column:
    """What follows ``keyword`` and ``sign``, at each place where both stand; white space between them is skipped."""
    pieces = F.split(reply, keyword)
    following = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: F.ltrim(p, F.lit(BLANK)))
    signed = F.filter(following, lambda p: F.startswith(p, F.lit(sign)))
    return F.transform(signed, lambda p: F.ltrim(F.substr(p, F.lit(len(sign) + 1)), F.lit(BLANK)))


def column_list(reply: Column) -> Column:
    """The names in the first non-empty ``COLUMNS = [...]``, else on the rest of the first ``columns:`` line (any case),
    else an empty array. Brackets, quotes and blanks around names are dropped."""
    lists = F.filter(_after(reply, "COLUMNS", "="), lambda p: F.startswith(p, F.lit("[")) & F.contains(p, F.lit("]")) & ~F.startswith(p, F.lit("[]")))
    lines = F.filter(F.transform(_after(reply, "(?i)columns", ":"), lambda p: F.split(p, "[\r\n]")[0]), lambda p: p != "")
    text = F.coalesce(F.substring_index(F.get(lists, F.lit(0)), "]", 1), F.get(lines, F.lit(0)), F.lit(""))
    names = F.transform(F.split(text, ","), lambda c: F.trim(c, F.lit(BLANK + "[]'\"")))
    return F.filter(names, lambda c: c != "")


def payload(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One JSON record per row of a (small) result table."""
    names = list(names if names is not None else df.columns)
    return df.select(names[0], F.to_json(F.struct(*[col(n) for n in names]), {"ignoreNullFields": "false"}).alias("payload"))
