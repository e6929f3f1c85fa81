"""Catalogue API pages as a table.

A landed page is one JSON line: the request it answers (``server``,
``window_start``, ``window_end``, ``cursor``) and the body as the API sends it
(``collection`` of records, ``messages`` with the window's total). Spark's JSON
reader reads any number of pages in parallel; records are exploded, and what is
missing is found by joining the cursors each window's total asks for.

``fetch_pages`` lands pages from a service through an injected ``transport``:
first one page a window, whose total says which cursors remain, then those, in
parallel over cursors.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import schema as S
from quire.session import partitions_of

# --- fixed values: seconds to wait after each failed try but the last ---------------
WAITS = (10.0, 20.0, 40.0, 80.0)
# -----------------------------------------------------------------------------------

_RECORD = T.StructType([T.StructField(f, T.StringType()) for f in S.PAPER_FIELDS if f != "server"])
_REQUEST = ["server", "window_start", "window_end", "cursor"]
PAGE_SCHEMA = T.StructType(
    [
        T.StructField("server", T.StringType()),
        T.StructField("window_start", T.StringType()),
        T.StructField("window_end", T.StringType()),
        T.StructField("cursor", T.IntegerType()),
        T.StructField("collection", T.ArrayType(_RECORD)),
        T.StructField("messages", T.ArrayType(T.StructType([T.StructField("total", T.IntegerType())]))),
    ]
)
Transport = Callable[[str, str, str, int], dict]


def landed_pages(spark: SparkSession, path: str, servers: tuple[str, ...] = S.SERVERS) -> DataFrame:
    """The pages landed under ``path``, of the given collections."""
    return spark.read.schema(PAGE_SCHEMA).json(path).where(F.col("server").isin(*servers))


def page_faults(pages: DataFrame) -> DataFrame:
    """(server, window_start, cursor, fault): pages without a collection, and
    pages that a window's total asks for but that are not there."""
    broken = pages.where(F.col("collection").isNull()).select("server", "window_start", "cursor", F.lit("no collection").alias("fault"))
    total = F.max(F.coalesce(F.element_at("messages", 1)["total"], F.lit(0))).alias("total")
    asked = pages.groupBy("server", "window_start").agg(total).where("total > 0")
    asked = asked.select("server", "window_start", F.explode(F.sequence(F.lit(0), F.col("total") - 1, F.lit(S.PAGE_SIZE))).alias("cursor"))
    missing = asked.join(pages.select("server", "window_start", "cursor"), ["server", "window_start", "cursor"], "left_anti")
    return broken.unionByName(missing.withColumn("fault", F.lit("missing")))


def records_of(pages: DataFrame) -> DataFrame:
    """One row per record, with its request and place in the page (``idx``).
    Missing fields are '', unknown ones are not read, and ``server`` is the
    collection it came from."""
    rows = pages.select(*_REQUEST, F.posexplode("collection").alias("idx", "r"))
    fields = [F.coalesce(F.col(f"r.{f}"), F.lit("")).alias(f) for f in S.PAPER_FIELDS if f != "server"]
    return rows.select(*_REQUEST, "idx", *fields)


def read_records(spark: SparkSession, path: str, servers: tuple[str, ...] = S.SERVERS) -> DataFrame:
    """All records landed under ``path``; an error if a page is faulty."""
    pages = landed_pages(spark, path, servers)
    fault = page_faults(pages).orderBy("server", "window_start", "cursor").first()
    if fault is not None:
        raise ValueError(f"page of {fault.server} {fault.window_start} at {fault.cursor}: {fault.fault}")
    return records_of(pages)


def patiently(ask: Callable[[], dict], waits: tuple[float, ...], pause: Callable[[float], None] = time.sleep) -> dict:
    """The first answer with a collection; each wait buys another try."""
    for wait in (*waits, None):
        try:
            page = ask()
            if "collection" in page:
                return page
            error: Exception = ValueError(f"an answer without a collection: {sorted(page)}")
        except OSError as e:
            error = e
        if wait is None:
            raise error
        pause(wait)
    raise AssertionError


def _asked(requests: DataFrame, transport: Transport, waits: tuple[float, ...]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q in b.itertuples(index=False):
                page = patiently(lambda q=q: transport(q.server, q.window_start, q.window_end, int(q.cursor)), waits)
                request = {"server": q.server, "window_start": q.window_start, "window_end": q.window_end, "cursor": int(q.cursor)}
                body = {"collection": page["collection"], "messages": page.get("messages")}
                yield pd.DataFrame({"value": [json.dumps(request | body)]})

    return requests.select(*_REQUEST).mapInPandas(run, "value string")


def fetch_pages(requests: DataFrame, transport: Transport, path: str, waits: tuple[float, ...] = WAITS) -> None:
    """Land every page of the windows in ``requests`` (server, window_start,
    window_end) under ``path``."""
    spark = requests.sparkSession
    first = requests.withColumn("cursor", F.lit(0))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    _asked(first.repartition(parts), transport, waits).write.mode("append").text(path)
    total = F.coalesce(F.element_at("messages", 1)["total"], F.lit(0))
    more = spark.read.schema(PAGE_SCHEMA).json(path).where("cursor = 0").where((total > S.PAGE_SIZE) & (F.size("collection") > 0))
    rest = more.select(*_REQUEST[:3], F.explode(F.sequence(F.lit(S.PAGE_SIZE), total - 1, F.lit(S.PAGE_SIZE))).alias("cursor"))
    _asked(rest.repartition(parts), transport, waits).write.mode("append").text(path)


def land_records(records: DataFrame, path: str) -> None:
    """Write records (request, idx, paper fields) as pages; '' is left out of
    the JSON. A page holds at most one page size of records."""
    fields = [f for f in S.PAPER_FIELDS if f != "server"]
    record = F.struct(*[F.nullif(F.col(f), F.lit("")).alias(f) for f in fields])
    totals = records.groupBy(*_REQUEST[:3]).agg(F.count(F.lit(1)).cast("int").alias("total"))
    n = partitions_of(records, "title", "abstract")  # pages are gathered in sorted rows, so a task gets few of them
    pages = records.repartition(n, *_REQUEST).groupBy(*_REQUEST).agg(F.array_sort(F.collect_list(F.struct("idx", record.alias("r")))).alias("items"))
    pages = pages.join(totals, _REQUEST[:3]).select(
        *_REQUEST, F.transform("items", lambda x: x["r"]).alias("collection"), F.array(F.struct("total")).alias("messages")
    )
    pages.write.mode("errorifexists").json(path)
