"""Session helpers shared by every operator: tables, Arrow batch bounds, durable cuts."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound of one Arrow batch on its way to a Python worker.
ARROW_BATCH_BYTES = 8 << 20
ARROW_BATCH_ROWS = 2_000


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One input table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def bound_arrow_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts don't pile up in a Python worker.

    Workers also get this package's place, for sessions started elsewhere than in the repository.
    """
    home, path = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (path, home) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir. Where it is unset, a temporary one will do on one machine
    alone; on a cluster no executor but the driver's neighbours could read it, so that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusloom-checkpoint-"))


#: Inputs of fewer bytes may be a single row group, which one task would read and work on alone.
SMALL_INPUT = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small input dealt to all cores; larger ones come in as many parts as they are read in.

    This changes the layout alone, never the rows; it costs a shuffle of less than SMALL_INPUT.
    """
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < SMALL_INPUT:
        return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return df


def durable(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read on from there.

    The copy survives lost executors, unlike a cache or a local checkpoint.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a side that is broadcast; from more on the join shuffles.
FEW_ROWS = 200_000


def few(df: DataFrame) -> DataFrame:
    """`df`, written down and counted, with the hint to broadcast it if it has FEW_ROWS at most."""
    kept = durable_round(df)
    return F.broadcast(kept) if kept.count() <= FEW_ROWS else kept


def durable_round(df: DataFrame) -> DataFrame:
    """`durable` for the rounds of a loop: the optimizer's estimate of the size is forgotten.

    A checkpoint keeps the estimate of the plan it replaces, and joins multiply estimates; over the
    rounds of a loop their digits would double each time. The real sizes steer the joins at run time.
    """
    kept = durable(df)
    session = df.sparkSession
    rows = kept._jdf.queryExecution().toRdd()
    return DataFrame(session._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), session)
