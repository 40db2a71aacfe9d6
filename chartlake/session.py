"""Session settings the operators rely on, and the checkpoint folder rule."""
from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings. UTC makes text<->timestamp conversion reproducible; the
# adaptive settings let Spark split a hot join key across tasks even when an
# aggregation on the same key follows the join (it then re-shuffles partials).
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def prepare_session(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session (idempotent)."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "chartlake", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """Local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        # Small local data would otherwise be coalesced into one task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        # Call-site capture multiplies the cost of building wide plans in Python.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare_session(spark)


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` where it is set.

    Without the setting a temporary folder is made, but only in local mode: on a
    cluster a machine-local folder would lose data with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="chartlake-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it from there.

    Used where a frame is read several times, or where all reads must see the
    same row to partition assignment, also after an executor is lost. One pass
    over the input; later reads prune columns and know the size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGES.append((spark.sparkContext.applicationId, path))
    return spark.read.schema(df.schema).parquet(path)


# Limits for broadcast joins: held against an estimate, and against what was shuffled.
GUESSED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside broadcast a side of a join by its measured size alone.

    Before a job Spark knows a stored table by the size of its files, and a few columns by
    their share of its row. Values that compress well and empty columns make that a small
    part of what the rows need, so the driver may build a table that is many times the
    limit, and more with every row. Inside, the limit of the session is held against the
    rows that were shuffled. Broadcasts that the code asks for stay.
    """
    before = {key: spark.conf.get(key, None) for key in (GUESSED, MEASURED)}
    spark.conf.set(MEASURED, before[MEASURED] or spark.conf.get(GUESSED))
    spark.conf.set(GUESSED, "-1")
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


# Tables that this process has materialized: application and path.
_STAGES: list[tuple[str, str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove on leaving what ``materialize`` writes inside; for steps that store their result."""
    start = len(_STAGES)
    try:
        yield
    finally:
        _remove(spark, _STAGES[start:])
        del _STAGES[start:]


def _remove(spark: SparkSession, stages: list[tuple[str, str]]) -> None:
    for _, text in stages:
        path = spark._jvm.org.apache.hadoop.fs.Path(text)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stages(spark: SparkSession) -> int:
    """Remove the tables that ``materialize`` wrote, once their results are stored elsewhere."""
    own = [s for s in _STAGES if s[0] == spark.sparkContext.applicationId]
    _remove(spark, own)
    _STAGES[:] = [s for s in _STAGES if s not in own]
    return len(own)
