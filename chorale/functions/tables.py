"""Joins with sides whose size is counted before they are broadcast, sums of arrays over tasks, and plans cut short."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many partitions or fewer send their arrays to the driver; more are added by a shuffle first.
FEW = 4


def small(df: DataFrame, width: int = 1, most: int = 1 << 20) -> DataFrame:
    """``df`` marked for broadcast if its rows, of ``width`` values each, are ``most`` values at most; else as it is, to be shuffled."""
    return F.broadcast(df) if df.count() * width <= most else df


def bare(df: DataFrame) -> DataFrame:
    """``df``, best persisted and counted, under a plan of one node.

    The plan of a persisted table is part of the plan of all that is made from it, so that a loop of jobs leaves its
    whole history with the driver once for each job. The rows and their lineage are those of ``df``.
    """
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def added(group: pa.Table) -> pa.Table:
    """The arrays of doubles of one cell as their sum."""
    total = sum(np.frombuffer(x.as_py()) for x in group.column("sums"))
    return pa.table({"cell": group.column("cell").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def array_sums(each: DataFrame, parts: int) -> dict[int, np.ndarray]:
    """Sums by cell of (cell, sums), where ``sums`` are the bytes of doubles; the result is a row for each cell, whatever the data."""
    if parts > FEW:
        each = each.groupBy("cell").applyInArrow(added, "cell int, sums binary")
    out: dict[int, np.ndarray] = {}
    for r in each.collect():
        x = np.frombuffer(r["sums"])
        out[r["cell"]] = out[r["cell"]] + x if r["cell"] in out else x
    return out
