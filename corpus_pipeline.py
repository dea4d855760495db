"""A training-data pipeline over documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs.  All but the last return the columns of documents;
each works on whatever its predecessor kept, null and empty values included.
"""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, line_dedup, mixing, near_copies, quality_model
from quern.scratch import Scratch, checkpoint_root
from quern.session import ship

class _Made(NamedTuple):
    """The intermediate tables of a stage that was built, and where it stood."""

    scratch: Scratch
    result: weakref.ref
    sf_dir: str
    place: int


_made: list[_Made] = []


def _stage(spark: SparkSession, docs: DataFrame, sf_dir: str, place: int, make: Callable[[Scratch], DataFrame]) -> DataFrame:
    """What ``make`` returns, for the stage at ``place``.

    Tables of a stage go when neither ``docs`` nor any result that is still held reads them; held or
    not, when a later stage of the same ``sf_dir`` begins with a table that was written since.  So
    two pipelines over one directory run one after the other, or without writing in between.
    """
    ship(spark)
    held = [docs, *(df for df in (made.result() for made in _made) if df is not None)]
    written = not any(made.scratch.read_by(docs) for made in _made)
    for made in list(_made):
        over = written and made.sf_dir == sf_dir and made.place < place
        if over or made.result() is None and not made.scratch.read_by(*held):
            made.scratch.close()
            _made.remove(made)
    scratch = Scratch(spark)
    out = make(scratch)
    _made.append(_Made(scratch, weakref.ref(out), sf_dir, place))
    return out


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _stage(spark, docs, sf_dir, 0, lambda scratch: quality_model.filtered(docs, labels, scratch))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of repeated three-line windows; n_chars follows."""
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return _stage(spark, docs, sf_dir, 1, lambda scratch: line_dedup.dedup_lines(docs, scratch).withColumn("n_chars", n_chars))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike by 0.8 or more."""
    return _stage(spark, docs, sf_dir, 2, lambda scratch: near_copies.one_of_each(docs, scratch))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as the target weights take."""
    return _stage(spark, docs, sf_dir, 3, lambda scratch: mixing.mixed(docs, scratch))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and hashes of the ids and of the text they decode to."""
    # stages before leave executors with less memory than a run of the encoder alone
    return _stage(spark, docs, sf_dir, 4, lambda scratch: bpe.digests(docs, known_words=100_000))


STAGES = [
    ("quality", keep_quality),
    ("lines", drop_repeated_lines),
    ("near_copies", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The classifier, the fingerprints and the encoding can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        path = f"{checkpoint_root(spark)}/quern-pipeline-{name}-{uuid.uuid4().hex}"
        last.paths.append(path)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
