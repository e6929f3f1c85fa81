"""Helpers shared by the corpus operators of this subpackage."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS = 1000  # whole texts at a time
_OWN: ContextVar[list | None] = ContextVar("own", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path.rstrip("/")


def saved(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that were running on it,
    never the stages before. Spark also knows the size of what it reads back,
    so a later join broadcasts it only if it is below the session's threshold.
    ``batch`` bounds the rows that Python workers get at a time, for rows that
    are large, while the table is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    own = spark.conf.get(ARROW_ROWS)
    if batch:
        spark.conf.set(ARROW_ROWS, str(batch))
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, own)
    if (paths := _OWN.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def last_stays(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For a ``step`` that returns the last table it saves, or what is read from
    that alone: the tables it saved before are deleted when it is done."""

    @functools.wraps(step)
    def run(*args, **kwargs) -> DataFrame:
        paths: list[str] = []
        token = _OWN.set(paths)
        try:
            out = step(*args, **kwargs)
        finally:
            _OWN.reset(token)
        spark = out.sparkSession
        for p in paths[:-1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if (outer := _OWN.get()) is not None:
            outer.extend(paths[-1:])
        return out

    return run


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers of jobs started inside get ``rows`` rows at a time."""
    own = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the document id as text, modulo ``n``; a null id counts as ''."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def text_keys(text: Column) -> list[Column]:
    """Two 64-bit hashes that together name a text (128 bits)."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t), F.xxhash64(F.lit(0x5BD1), t)]


def parts_for(df: DataFrame, bytes_per_part: float, least: int = 12) -> int:
    """How many partitions work on all rows of ``df`` takes: its size as Spark
    estimates it (file bytes for a scan) over ``bytes_per_part``."""
    size = float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, int(size / bytes_per_part)) if size < 1 << 50 else max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
