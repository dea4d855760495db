"""Equi-joins on which null equals null, by column name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on equal or both null ``on``; the left key columns stay.  An empty ``on`` is not allowed."""
    renamed = right.select(*[F.col(f"`{c}`").alias(f"__right_{c}") if c in on else F.col(f"`{c}`") for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`__right_{c}`")) for c in on])
    joined = left.join(renamed, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__right_{c}" for c in on])
