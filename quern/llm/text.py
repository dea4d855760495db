"""What counts as a word, and how a document row is told from another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but space and the controls 09-0D, as Java and Python regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def code_points(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("long")


def row_key(doc_id: Column, text: Column) -> Column:
    """Rows that repeat doc_id and text share a key; others differ but for hash collisions."""
    return F.struct(doc_id.alias("id"), F.xxhash64(text).alias("th"))


def columns_of(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name can't clash."""
    return docs.select(*[F.col(f"`{n}`") for n in names])
