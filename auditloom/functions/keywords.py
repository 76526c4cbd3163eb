"""Keywords of a text, and how many two lists share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no keywords, compared before lower-casing.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "were", "will", "with")
MIN_LENGTH = 3


def keywords(text: Column) -> Column:
    """Lower-case words of three or more of A-Z a-z 0-9 - ' that are no stop words; duplicates stay. NULL reads 'None'."""
    words = F.split(F.regexp_replace(F.coalesce(text, F.lit("None")), r"[^A-Za-z0-9\-']", " "), " +")
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.transform(F.filter(words, lambda w: (F.length(w) >= MIN_LENGTH) & ~F.array_contains(stop, w)), F.lower)


def match_count(a: Column, b: Column) -> Column:
    """Sum over words of their counts in a times those in b."""
    return F.coalesce(F.aggregate(F.transform(a, lambda x: F.size(F.filter(b, lambda y: y == x))), F.lit(0), lambda s, n: s + n), F.lit(0))
