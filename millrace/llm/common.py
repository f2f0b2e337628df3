"""What the operators of this package share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that all executors share, its lineage cut.

    The folder is the session's ``spark.checkpoint.dir``. Where none is set, a session on one
    machine uses a temporary folder; on a cluster, whose executors do not share that, it is an
    error. The executors may be lost afterwards: the files stay.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not configured and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="millrace-"))
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else as it is; at most one row more is looked at."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def blank(column: Column) -> Column:
    """True for null and for values of white space only."""
    return column.isNull() | ~column.rlike(r"(?U)\S")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` cut down to the named columns under fixed names, so extra columns cannot clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])
