"""Token and trigram columns (JVM-side expressions, no Python UDF).

Tokens: lower-cased alphanumeric runs.  Stemming and stop words of the
reference's ``english`` text configuration are left out.
Trigrams follow the usual trigram-similarity convention: each word is padded
with two blanks in front and one behind, and every 3-character substring of
the padded word is a trigram; a string's trigrams are the distinct union
over its words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_SPLIT = "[^a-z0-9]+"   # fixed: anything not alphanumeric separates words


def tokens(c: Column | str) -> Column:
    """Distinct lower-cased alphanumeric tokens of a string (NULL -> empty array)."""
    col = F.col(c) if isinstance(c, str) else c
    parts = F.split(F.lower(F.coalesce(col, F.lit(""))), WORD_SPLIT)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def trigrams(c: Column | str) -> Column:
    """Distinct padded-word trigrams of a string."""
    padded = F.transform(tokens(c), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    per_word = F.transform(padded, lambda p: F.transform(
        F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, 3)))
    return F.array_distinct(F.flatten(per_word))
