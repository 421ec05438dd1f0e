"""Text functions as columns: normalisation, prefixes, token rules and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import SEARCH_BODY

#: White space of Unicode and the four information separators.
BLANKS = r"(?U)[\s\x1c-\x1f]+"
TOKEN = "^[a-z0-9]*[a-z][a-z0-9]*$"
MAX_TOKENS = 5


def normalize(text: Column) -> Column:
    """Null as '', runs of white space as one space, no space at the ends, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")))


def prefixes(text: Column) -> Column:
    """All prefixes of one code point or more, shortest first."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def words(text: Column) -> Column:
    return F.split(normalize(text), " ")


def is_clean(query: Column) -> Column:
    """One to five tokens of a-z and 0-9, each with a letter."""
    tokens = F.split(query, " ")
    return F.size(tokens).between(1, MAX_TOKENS) & F.forall(tokens, lambda t: t.rlike(TOKEN))


def safe_int(text: Column, default: int) -> Column:
    """The integer that the text spells, else the default."""
    return F.coalesce(F.when(F.trim(text).rlike("^[+-]?[0-9]+$"), F.trim(text).try_cast("bigint")), F.lit(default).cast("bigint"))


def cache_key(mode: Column, prefix: Column) -> Column:
    return F.concat_ws(":", F.lit("suggest"), mode, prefix)


def short_count(n: Column) -> Column:
    """1234 as 1.2K, and so on with M and B. The double's exact value is rounded; an exact half (.25 or .75) goes up."""

    def scaled(by: float, unit: str) -> Column:
        x = n / F.lit(by)
        up = F.when(x * 4 % 2 == 1, x + 0.05).otherwise(x)
        return F.concat(F.regexp_replace(F.format_number(up, 1), r",|\.0$", ""), F.lit(unit))

    return F.when(n >= 1e9, scaled(1e9, "B")).when(n >= 1e6, scaled(1e6, "M")).when(n >= 1e3, scaled(1e3, "K")).otherwise(n.cast("string"))


def escape_html(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def highlight(text: Column, prefix: Column) -> Column:
    """The escaped text, its beginning marked if it is the prefix in any case."""
    n = F.length(prefix)
    head, tail = F.substring(text, F.lit(1), n), F.substring(text, n + 1, F.length(text))
    hit = (n > 0) & F.startswith(F.lower(text), F.lower(prefix))
    return F.when(hit, F.concat(F.lit("<mark>"), escape_html(head), F.lit("</mark>"), escape_html(tail))).otherwise(escape_html(text))


def bar_width(count: Column, largest: Column) -> Column:
    """0 to 100 on a logarithmic scale."""
    return F.round(F.log(count + 1.0) / F.log(F.greatest(largest, F.lit(1)) + 1.0) * 100).cast("int")


def search_query(body: Column) -> Column:
    """The normalised query of a search request's JSON body; '' where the body is no such object."""
    return normalize(F.from_json(body, SEARCH_BODY).getField("query"))
