"""Session helpers: building a session and cutting lineage safely."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was computed and found to be within both bounds.
BROADCAST_BYTES = 32 * 1024 * 1024
BROADCAST_ROWS = 200_000


def build_session(app: str = "latticework", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with the settings the operators expect (UTC, AQE, skew joins)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; fall back to /tmp in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a shared folder before running on a cluster")
        configured = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(configured)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the checkpoint folder, so later uses neither recompute nor lose it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table below the checkpoint folder: for wide tables of which many steps read a few columns each."""
    path = f"{shared_folder(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> tuple[DataFrame, bool]:
    """Compute a table that should be small once: ``(table, small)``.

    Up to ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` bytes it becomes a local relation (a broadcast
    would pass through the driver just the same). A larger one is checkpointed instead and stays distributed.
    """
    head = df.limit(BROADCAST_ROWS + 1).toArrow()
    if head.num_rows <= BROADCAST_ROWS and head.nbytes <= BROADCAST_BYTES:
        return df.sparkSession.createDataFrame(head, schema=df.schema), True
    return materialize(df), False


def attach(df: DataFrame, small: DataFrame, on: list[str] | str, how: str = "left") -> DataFrame:
    """Join a per-group table to its rows, matching NULL keys too.

    The table is computed once and measured; within the bounds it is broadcast and the rows are not
    shuffled, beyond them the join is a shuffle join, where AQE splits hot keys.
    """
    keys = [on] if isinstance(on, str) else list(on)
    table, fits = settle(small)
    side = table.select(*[F.col(c).alias(f"_on_{c}") if c in keys else F.col(c) for c in table.columns])
    matches = F.lit(True)
    for key in keys:
        matches = matches & F.col(key).eqNullSafe(F.col(f"_on_{key}"))
    joined = df.join(F.broadcast(side) if fits else side, matches, how)
    return joined.drop(*[f"_on_{key}" for key in keys])
