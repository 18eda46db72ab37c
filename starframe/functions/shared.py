"""Tables kept between two passes, in the folder that the cluster names in ``spark.checkpoint.dir``; columns computed once."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.  Where it is unset, one is made if all runs on this machine; a cluster must name its own."""
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The table, computed once; later passes read it, and a lost executor costs no recomputation."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once for each row.

    The optimizer may merge a projection into those above it, and then computes an expression again for each use, even for each
    turn of a lambda function; it does not merge across a generator, so the columns go through one of a single row.
    """
    made = df.select("*", F.inline(F.array(F.struct(*(c.alias(f"_made_{n}") for n, c in columns.items())))))
    return made.drop(*columns).withColumnsRenamed({f"_made_{n}": n for n in columns})
