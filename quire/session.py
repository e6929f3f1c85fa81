"""Spark session and shared-folder helpers."""

from __future__ import annotations

import math
import os
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

# Settings every job relies on. Shuffle partitions are sized per run by the
# caller; AQE coalesces small shuffles and splits skewed join partitions.
_BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "quire") -> SparkSession:
    """A local session for tests and the bench (a cluster brings its own)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for k, v in _BASE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for materialised tables and checkpoints, from
    ``spark.checkpoint.dir``."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path.rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path inside the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


TASK_BYTES = 64 << 20  # of rows that a task sorts or gathers
ROW_BYTES = 96  # of a row besides its long texts


def tasks_for(rows: int, text_bytes: int = 0) -> int:
    """Tasks that get at most ``TASK_BYTES`` of so many rows each."""
    return math.ceil((rows * ROW_BYTES + text_bytes) / TASK_BYTES)


def partitions_for(spark: SparkSession, rows: int, text_bytes: int = 0) -> int:
    """Partitions for an explicit repartitioning of so many rows: those of the
    session, and more where a task would get over ``TASK_BYTES`` of them (AQE
    merges small partitions, but does not split those of a given number)."""
    least = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(least, tasks_for(rows, text_bytes))


def size_of(df, *text_cols: str) -> tuple[int, int]:
    """Rows of ``df``, and bytes in the given long texts (one pass over them)."""
    from pyspark.sql import functions as F

    lengths = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in text_cols]
    with lean(df.sparkSession):
        found = df.agg(F.count(F.lit(1)).alias("n"), *[x.alias(f"b{i}") for i, x in enumerate(lengths)]).first()
    return found[0], sum(found[1:])


def partitions_of(df, *text_cols: str) -> int:
    """:func:`partitions_for` the rows of ``df`` with the given long texts."""
    return partitions_for(df.sparkSession, *size_of(df, *text_cols))


STORED = {"compression": "zstd"}  # of tables that are kept
# shuffle files go when a job is done, not when the driver happens to collect its
# garbage; Python workers get so many whole texts at a time
_LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
_INSIDE: dict[str, list] = {}  # by application: callers inside, the session's own settings
_LOCK = threading.Lock()
_MADE: ContextVar[list | None] = ContextVar("made", default=None)


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Settings for jobs that write a table and keep nothing else; may be nested and
    used by several threads."""
    key = spark.sparkContext.applicationId
    with _LOCK:
        held = _INSIDE.setdefault(key, [0, {k: spark.conf.get(k) for k in _LEAN}])
        held[0] += 1
        for k, v in _LEAN.items():
            spark.conf.set(k, v)
    try:
        yield
    finally:
        with _LOCK:
            held[0] -= 1
            if not held[0]:
                for k, v in _INSIDE.pop(key)[1].items():
                    spark.conf.set(k, v)


def materialize(df, name: str):
    """Write ``df`` to a fresh table in the shared folder and read it back.

    Used for derived tables that a plan references several times
    (clause tables, a normalised thesaurus): it cuts the lineage so the
    subplan is computed once, and the written files survive executor loss."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    with lean(spark):
        df.write.mode("errorifexists").options(**STORED).parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return spark.read.parquet(path)


@contextmanager
def last_stays(spark: SparkSession) -> Iterator[None]:
    """Of the tables materialised inside, all but the last are deleted at the end."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
    for p in made[:-1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def literal_table(spark, rows, schema):
    """A small driver-side table as a JVM literal relation (no Python RDD):
    used for query-sized inputs such as phrase-term lists."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))
