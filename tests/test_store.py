"""The segment store: several streams, page order, tiers, point lookups."""

import os
import time

import pytest
from pyspark.sql import functions as F

from conftest import paper
from quire import schema as S
from quire.operators.index import Index
from quire.plans import sync as SY
from quire.sources import store as ST
from quire.sources.store import Store
from quire.streaming import ingest as IN


def _rows(df, cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def _same_as_rebuilt(store):
    idx, rebuilt = store.index(), Index.build(store.papers())
    for table, cols in (("postings", ["token", "doi", "field", "pos"]), ("docs", ["doi", "dl", "date", "category"]), ("terms", ["token", "df", "cf"])):
        assert _rows(getattr(idx, table), cols) == _rows(getattr(rebuilt, table), cols), table


def test_two_streams_and_a_new_checkpoint_lose_nothing(spark, scratch, make_papers):
    def ingest(landing, checkpoint):
        q = IN.start_ingest(spark, f"{scratch}/{landing}", f"{scratch}/table", f"{scratch}/{checkpoint}")
        q.awaitTermination(300)
        return _rows(Store(spark, f"{scratch}/table").papers(), ["doi", "title"])

    for name, dois in (("a", "xy"), ("b", "zw")):
        make_papers([paper(doi=f"10.5555/{d}", title=name) for d in dois]).coalesce(1).write.json(f"{scratch}/{name}")
    a = [("10.5555/x", "a"), ("10.5555/y", "a")]
    assert ingest("a", "one") == a
    assert ingest("a", "one") == a  # nothing new
    both = sorted(a + [("10.5555/z", "b"), ("10.5555/w", "b")])
    assert ingest("b", "two") == both
    make_papers([paper(doi="10.5555/x", title="late")]).coalesce(1).write.mode("append").json(f"{scratch}/b")
    late = sorted([("10.5555/x", "late")] + [r for r in both if r[0] != "10.5555/x"])
    assert ingest("b", "two") == late
    assert ingest("a", "three") == both  # read again from its start, under a new name
    store = Store(spark, f"{scratch}/table")
    sources = store.version()["sources"]
    assert len(sources) == 3
    # a replayed micro-batch of any of them is skipped
    assert all(store.commit(make_papers([paper(title="again")]), source=(name, n)) == 0 for name, n in sources.items())


def test_stored_sync_keeps_the_order_of_pages(spark, scratch, make_papers):
    recs = make_papers([paper(doi="10.5555/x", title="old page", version="2"), paper(doi="10.5555/x", title="new page", version="1"),
                        paper(doi="10.5555/x", title="same page", version="1"), paper(doi="10.5555/y", server="medrxiv", title="y1"),
                        paper(doi="10.5555/y", title="y2", version="9")])
    recs = recs.withColumn("cursor", F.element_at(F.array(*map(F.lit, [0, 100, 100, 0, 200])), (F.col("arrival") + 1).cast("int"))).withColumn("idx", F.col("arrival").cast("int"))
    store = Store(spark, f"{scratch}/table")
    count = SY.run_bulk(store, lambda start, end: recs, "2013-01-20")
    table, counts = SY.ingest(recs.limit(0).drop("cursor", "idx", "arrival"), recs.withColumn("w", F.lit(0)))
    assert _rows(store.papers(), S.PAPER_FIELDS) == _rows(table, S.PAPER_FIELDS)
    assert {r.doi: r.title for r in store.papers().collect()} == {"10.5555/x": "new page", "10.5555/y": "y1"}
    assert count == sum(r["count"] for r in counts.collect()) == 4


def test_a_failing_window_drops_later_prepared_ones(spark, scratch, make_papers):
    def fetch(start, end):
        if start == "2013-03-02":
            raise OSError("no answer")
        return make_papers([paper(doi=f"10.5555/{start}", date=start)])

    store = Store(spark, f"{scratch}/table")
    with pytest.raises(OSError):
        SY.run_bulk(store, fetch, "2013-06-15", side_by_side=3)
    assert store.papers().count() == 2 and store.state() == {S.STATE_BULK_CURSOR: "2013-03-01"}
    listed = {s["name"] for s in store.version()["segments"]}
    assert {d for d in os.listdir(f"{scratch}/table") if d.startswith("segment-")} == listed


def test_tiers_write_each_paper_a_few_times():
    """200 commits of 220 papers, counted in papers written."""
    rows, written, most = [], 0, 0
    for _ in range(200):
        rows.append(220)
        written += 220
        if run := ST.due(rows, 8):
            rows[-run:] = [sum(rows[-run:])]
            written += rows[-1]
        most = max(most, len(rows))
    assert sum(rows) == 200 * 220 and written <= 4 * sum(rows) and most <= 8 * 3
    assert ST.due([10**9] + [1] * 8, 8) == 8  # a large segment is left alone
    assert ST.due([1] * 7, 8) == 0


def test_merged_segments_equal_a_rebuild(spark, scratch, make_papers):
    store = Store(spark, f"{scratch}/table", max_segments=2, grace=2)
    store.commit(make_papers([paper(doi=f"10.5555/{i}", title=f"word{i} common", abstract="sea") for i in range(40)]))
    for k in range(6):
        dois = [f"10.5555/{k}", f"10.5555/{k + 1}", f"10.5555/new{k}"]
        assert store.commit(make_papers([paper(doi=d, title=f"turn{k} common common", category=" Neuro ") for d in dois])) == 3
    assert store.commit(make_papers([])) == 0
    version = store.version()
    assert len(version["segments"]) <= 4 and version["segments"][0]["rows"] == 40  # the large one was not rewritten
    _same_as_rebuilt(store)
    assert store.papers().count() == 46 and store.papers().where("title like 'turn%'").count() == 13
    folders = {d for d in os.listdir(f"{scratch}/table") if d.startswith("segment-")}
    assert folders == {s["name"] for s in version["segments"]} | {name for name, _ in version["retired"]}
    assert all(at + 2 > version["number"] for _, at in version["retired"])


@pytest.mark.parametrize("point", [ST.POINT_LOOKUP, 0])
def test_replaced_papers_come_from_a_lookup(spark, scratch, make_papers, monkeypatch, point):
    monkeypatch.setattr(ST, "POINT_LOOKUP", point)
    store = Store(spark, f"{scratch}/table")
    store.commit(make_papers([paper(doi=f"10.5555/{i}", title=f"t{i}") for i in range(40)]))
    segments = store.version()["segments"]
    dois = spark.createDataFrame([("10.5555/7",), ("10.5555/none",)], "doi string")
    found = store.replaced(segments, dois, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "postings" not in plan and "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    assert ("In(doi, [10.5555/7,10.5555/none])" in plan) == (point > 0)
    assert [(r.doi, {t.token: t.tf for t in r.tokens}.get("t7")) for r in found.collect()] == [("10.5555/7", 1)]
    store.commit(make_papers([paper(doi="10.5555/7", title="other"), paper(doi="10.5555/41", title="t7")]))
    _same_as_rebuilt(store)


def _shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {x for top in manager.localDirsString() for _, _, names in os.walk(top) for x in names if x.startswith("shuffle_")}


def test_a_bulk_run_leaves_its_segments_and_nothing_else(spark, scratch, make_papers):
    days = [f"2013-{m:02d}-{d:02d}" for m in (1, 2, 3) for d in (3, 13, 23)]
    rows = [paper(doi=f"10.5555/{i % 40}", title=f"word{i} sea sea", abstract="ice " * (i % 5), date=days[i % len(days)], server="medrxiv" if i % 3 else "biorxiv") for i in range(90)]
    rows += [paper(doi="10.5555/empty", title="", date=d) for d in (days[0], days[-1])]
    recs = make_papers(rows).withColumn("cursor", F.lit(0)).withColumn("idx", F.col("arrival").cast("int"))
    recs.write.parquet(f"{scratch}/records")
    recs = spark.read.parquet(f"{scratch}/records")
    before = _shuffle_files(spark)
    store = Store(spark, f"{scratch}/table", max_segments=2)
    SY.run_bulk(store, lambda start, end: recs.where(F.col("date").between(start, end)), "2013-04-15")
    until = time.time() + 30
    while _shuffle_files(spark) - before and time.time() < until:  # they go in the background
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    papers = store.papers().collect()
    assert len(papers) == len({r.doi for r in papers}) == 41  # the paper without a word too is there once
    _same_as_rebuilt(store)
    for segment in store.version()["segments"]:
        assert set(os.listdir(f"{scratch}/table/{segment['name']}")) <= {"papers", "docs", "postings", "terms", "lost", "replaced"}


def test_bulk_records_are_kept_once(spark):
    import glob

    from conftest import SF_SMALL
    from quire import registry as R
    from quire.session import shared_dir

    kept = lambda: {p for p in glob.glob(f"{shared_dir(spark).removeprefix('file:')}/positions-*")}
    before = kept()
    (row,) = R.q_bulk_sync_result(spark, SF_SMALL).collect()
    assert row.paper_count > 0 and row.last_sync_date == R.TODAY and row.bulk_sync_cursor is None
    assert kept() == before
