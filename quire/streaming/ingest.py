"""Continuous catalogue ingest with Structured Streaming.

Landing files of catalogue records (JSON lines) are read as a stream; every
micro-batch is one commit of the store (papers, index and term statistics
together), so what has been ingested can be searched at once. A batch that died
before its version was published is applied again on replay, one that was
published is skipped. Stream progress lives in the checkpoint folder, and so does
the name by which the store knows the stream: several streams, or one with a new
checkpoint, can feed the same store.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from quire import schema as S
from quire.sources.store import Store

INGEST_SCHEMA = T.StructType(
    [T.StructField(f, T.StringType()) for f in S.PAPER_FIELDS] + [T.StructField("arrival", T.LongType())]
)


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The name kept in the checkpoint folder; made when it is first asked for."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/stream-name")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, False)
        out.write(uuid.uuid4().hex.encode())
        out.close()
    return spark.read.text(path.toString()).first().value


def start_ingest(spark: SparkSession, landing: str, root: str, checkpoint: str, files_per_batch: int = 1):
    """Start the stream; ``trigger(availableNow=True)`` drains what is there
    in batches of ``files_per_batch`` files and stops."""
    store, name = Store(spark, root), stream_name(spark, checkpoint)
    stream = spark.readStream.schema(INGEST_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(landing)
    return (
        stream.writeStream.foreachBatch(lambda df, batch: store.commit(df, source=(name, batch)))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
