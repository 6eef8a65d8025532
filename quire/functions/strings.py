"""Column helpers for text. White space, digits and word characters are ASCII unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that keywords leave out.
STOP_WORDS = ["the", "a", "an", "and", "or", "of", "in", "on", "to", "for", "is", "are", "was", "were", "be", "with", "by", "at", "from", "as", "that", "this", "it", "its", "if", "then", "than", "into", "about", "over", "under", "within", "between"]
NOT_WORD = "[^\\p{L}\\p{N}_]"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def squeeze(text: Column) -> Column:
    """Trimmed, lower-cased, white space as single spaces; empty for null."""
    return F.regexp_replace(strip(F.lower(F.coalesce(text, F.lit("")))), "\\s+", " ")


def any_word(words: list[str]) -> str:
    """Pattern for one of the words between characters that no word holds."""
    return f"(^|{NOT_WORD})({'|'.join(words)})($|{NOT_WORD})"


def keywords(text: Column) -> Column:
    """Distinct lower-cased runs of ASCII letters and digits, three long at least, no stop words and no numbers."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^A-Za-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= 3) & ~t.isin(STOP_WORDS) & ~t.rlike("^[0-9]+$")))


def ordered_join(order: list[str], text: str, separator: str) -> Column:
    """Aggregate: texts joined in the order of other columns."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text)))
    return F.array_join(F.transform(rows, lambda x: x[text]), separator)
