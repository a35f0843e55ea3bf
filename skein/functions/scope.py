"""Keys that hold the corpus they belong to, so that joins and groups by key stay within one corpus.

A key is the corpus' name in URL encoding, a unit separator (which that encoding never has), and the plain id. Ids of one corpus
are ordered as the plain ones are. A null name is the empty one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def prefix(key: Column) -> Column:
    """The corpus as keys have it."""
    return F.substring_index(key, SEPARATOR, 1)


def named(corpus: Column) -> Column:
    """The prefix of a corpus of this name."""
    return F.url_encode(F.coalesce(corpus.cast("string"), F.lit("")))


def corpus_of(key: Column) -> Column:
    """The name of a key's corpus."""
    return F.url_decode(prefix(key))


def scoped(corpus: Column, plain: Column) -> Column:
    """The key of a plain id in the corpus of this name."""
    return F.concat(named(corpus), F.lit(SEPARATOR), plain)


def beside(key: Column, plain: Column) -> Column:
    """The key of a plain id in the corpus of another key."""
    return F.concat(prefix(key), F.lit(SEPARATOR), plain)


def bare(key: Column) -> Column:
    """The plain id of a key."""
    return F.regexp_replace(key, f"^[^{SEPARATOR}]*{SEPARATOR}", "")
