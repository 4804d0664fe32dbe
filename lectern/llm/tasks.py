"""How much work one task gets."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores: a table of few files, whose rows cost much time in Python, would keep the others idle.

    Tables that are read in as many parts or more, as all large ones are, stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)
