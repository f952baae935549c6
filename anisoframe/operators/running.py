"""Global ranks and running totals without gathering the rows in one task.

Rows are dealt out by ranges of their order and kept in the shared checkpoint folder; a total for each part, a row each,
gives every part its start, and inside a part a window counts on.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one where none is set and the master is local.

    On a cluster a folder of one machine is of no use to the others, so that a missing setting is an error there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(rows: DataFrame) -> DataFrame:
    """``rows`` written to the cluster's checkpoint folder."""
    checkpoint_folder(rows.sparkSession)
    return rows.checkpoint(eager=True)


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` written as a table to the cluster's checkpoint folder and read again.

    For loops: what the optimizer believes of a checkpoint's size comes from the plan it cut, which grows with every round
    (the product of both sides of a join) until planning takes longer than the work; of a table it sees the files.
    """
    path = f"{checkpoint_folder(rows.sparkSession)}/table-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def running_totals(rows: DataFrame, order: list[Column | str], totals: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each entry, the sum of its expression over this row and all before it in the order."""
    part = "__part"
    held = checkpointed(rows.repartitionByRange(*[F.asc(c) if isinstance(c, str) else c for c in order])).withColumn(part, F.spark_partition_id())
    sums = held.groupBy(part).agg(*(F.sum(e).alias(f"__sum_{n}") for n, e in totals.items()))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    starts = sums.select(part, *(F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__start_{n}") for n in totals))
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = held.join(F.broadcast(starts), part)  # as many rows as there are parts
    return out.withColumns({n: F.col(f"__start_{n}") + F.sum(e).over(inside) for n, e in totals.items()}).select(*rows.columns, *totals)


def ranked(rows: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """``rows`` with their place in the order, from 1; the order must tell all rows apart to be the same every time."""
    return running_totals(rows, order, {name: F.lit(1).cast("long")})
