"""Catalogue synchronisation as DataFrame jobs.

The remote catalogue is read in date windows (30 days, inclusive, from the
epoch or the day after the saved cursor, the last one ending today; no
window starts today). Each record carries where it arrived: window, server,
page cursor and index in page. Within a page the highest version wins (ties:
first in page); across pages the later page wins - one ``max_by`` per DOI
with the key (window, server, cursor, version, -index).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schema as S
from quire.functions.normalize import norm_category, version_int
from quire.operators import upsert as U
from quire.sources.store import Store


def window_plan(spark: SparkSession, today: str, cursor: str | None = None, epoch: str = S.SYNC_EPOCH) -> DataFrame:
    """(w, window_start, window_end) as ISO strings, in order."""
    start = F.date_add(F.to_date(F.lit(cursor)), 1) if cursor else F.to_date(F.lit(epoch))
    end = F.to_date(F.lit(today))
    starts = F.when(start < end, F.sequence(start, F.date_sub(end, 1), F.expr(f"INTERVAL {S.WINDOW_DAYS} DAYS")))
    plan = spark.range(1).select(F.posexplode(F.coalesce(starts, F.array().cast("array<date>"))).alias("w", "d"))
    return plan.select(
        F.col("w").cast("int").alias("w"),
        F.date_format("d", "yyyy-MM-dd").alias("window_start"),
        F.date_format(F.least(F.date_add("d", S.WINDOW_DAYS - 1), end), "yyyy-MM-dd").alias("window_end"),
    )


def window_of(date: Column, today: str, cursor: str | None = None, epoch: str = S.SYNC_EPOCH) -> Column:
    """Window index of an ISO date (null outside [start, today])."""
    start = F.date_add(F.to_date(F.lit(cursor)), 1) if cursor else F.to_date(F.lit(epoch))
    d = F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(date, "yyyy-MM-dd"))
    idx = F.floor(F.datediff(d, start) / F.lit(S.WINDOW_DAYS)).cast("int")
    return F.when((d >= start) & (d <= F.to_date(F.lit(today))), idx)


def server_rank(server: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in S.SERVERS]), server).cast("int"), F.lit(len(S.SERVERS) + 1))


def arrival_key(records: DataFrame) -> Column:
    return F.struct(
        F.col("w"),
        server_rank(F.col("server")).alias("s"),
        F.col("cursor"),
        version_int(F.col("version")).alias("v"),
        (-F.col("idx")).alias("i"),
    )


def ingest(target: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upsert every fetched record in arrival order.

    ``records`` has the paper fields plus w, cursor, idx. Returns the new
    table and the per (server, window) upsert counts (sum of de-duplicated
    page sizes)."""
    best = F.max_by(F.struct(*[F.col(c) for c in S.PAPER_FIELDS]), arrival_key(records))
    picked = records.groupBy("doi").agg(best.alias("_b")).select(*[F.col(f"_b.{c}").alias(c) for c in S.PAPER_FIELDS])
    picked = picked.select(*[norm_category(F.col(c)).alias(c) if c == "category" else F.col(c) for c in S.PAPER_FIELDS])
    counts = (
        records.select("server", "w", "cursor", "doi").distinct().groupBy("server", "w").agg(F.count(F.lit(1)).alias("count"))
    )
    return U.merge(target, picked), counts


def bulk_sync(target: DataFrame, records: DataFrame, state: DataFrame, today: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Whole bulk run: every window from the resume point; on success the
    last sync date is today and the cursor is cleared."""
    cursor = U.state_get(state, S.STATE_BULK_CURSOR)
    recs = records.withColumn("w", window_of(F.col("date"), today, cursor)).where(F.col("w").isNotNull())
    table, counts = ingest(target, recs)
    new_state = U.state_delete(U.state_set(state, S.STATE_LAST_SYNC, today), S.STATE_BULK_CURSOR)
    return table, new_state, counts


def delta_sync(target: DataFrame, records: DataFrame, state: DataFrame, today: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From the last sync date (inclusive) to today; without a last date this
    is a bulk run."""
    last = U.state_get(state, S.STATE_LAST_SYNC)
    if not last:
        return bulk_sync(target, records, state, today)
    recs = records.where((F.col("date") >= F.lit(last)) & (F.col("date") <= F.lit(today))).withColumn("w", F.lit(0))
    table, counts = ingest(target, recs)
    return table, U.state_set(state, S.STATE_LAST_SYNC, today), counts


# -- synchronising a stored catalogue ----------------------------------------------

# records of a window of dates, both inclusive: paper fields and ``arrival``, or,
# as the catalogue delivers them, ``cursor`` and ``idx`` (page and place in it)
Fetch = Callable[[str, str], DataFrame]

SIDE_BY_SIDE = 4  # windows prepared at a time


def arrivals(records: DataFrame) -> DataFrame:
    """Records of one window with the order of their pages (server, cursor) and
    of arrival in a page; records without pages are one page."""
    if "cursor" not in records.columns:
        return records
    page = F.struct(server_rank(F.col("server")).alias("s"), F.col("cursor").cast("long").alias("c"))
    return records.select(*S.PAPER_FIELDS, page.alias("page"), F.col("idx").cast("long").alias("arrival"))


def run_bulk(store: Store, fetch: Fetch, today: str, side_by_side: int = SIDE_BY_SIDE) -> int:
    """Every window from the resume point; then set the last sync date and clear
    the cursor. Windows are written side by side as prepared segments and
    published in order, each with its cursor. A failing window leaves the
    earlier ones in, later ones are dropped, and the next run goes on after
    what is in."""
    windows = window_plan(store.spark, today, store.state().get(S.STATE_BULK_CURSOR)).orderBy("w").collect()  # one row a window
    count, done = 0, 0
    with ThreadPoolExecutor(max_workers=side_by_side) as pool:
        work = [pool.submit(lambda w=w: store.prepare(arrivals(fetch(w.window_start, w.window_end)))) for w in windows]
        try:
            for w, prepared in zip(windows, work):
                count += store.publish(prepared.result(), state={S.STATE_BULK_CURSOR: w.window_end})
                done += 1
        finally:
            for late in work[done:]:
                if not late.cancel() and late.exception() is None and late.result().name:
                    store.discard(late.result())
    store.publish(None, state={S.STATE_LAST_SYNC: today, S.STATE_BULK_CURSOR: None})
    return count


def run_delta(store: Store, fetch: Fetch, today: str) -> int:
    """From the last sync date, inclusive; without one this is a bulk run."""
    last = store.state().get(S.STATE_LAST_SYNC)
    if not last:
        return run_bulk(store, fetch, today)
    return store.commit(arrivals(fetch(last, today)), state={S.STATE_LAST_SYNC: today})


def auto_sync(store: Store, fetch: Fetch, today: str) -> dict[str, object]:
    """Delta if there was a sync before, else bulk: its kind and count."""
    delta = bool(store.state().get(S.STATE_LAST_SYNC))
    return {"kind": "delta" if delta else "bulk", "count": (run_delta if delta else run_bulk)(store, fetch, today)}
