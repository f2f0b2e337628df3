"""Stages as plug-ins: a pipeline is a chain of functions from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as tx

Stage = Callable[[DataFrame], DataFrame]


def run(df: DataFrame, *stages: Stage) -> DataFrame:
    """The stages applied one after the other; one plan, which Spark optimises as a whole."""
    for stage in stages:
        df = df.transform(stage)
    return df


def reading(source: str, least: int = 200) -> Stage:
    """The content stage: readable lines of ``source``, its hash, and only the pages that say enough and are not withheld."""

    def stage(df: DataFrame) -> DataFrame:
        kept = df.where(F.col(source).isNotNull() & tx.meaningful(F.col(source), least) & ~tx.restricted(F.col(source)))
        return kept.withColumn("readable", tx.readable(F.col(source))).withColumn("digest", F.sha2("readable", 256))

    return stage
