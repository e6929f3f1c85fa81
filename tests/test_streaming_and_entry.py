"""Stored catalogue: stream ingest, recovery, sync; driver entry points."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quire import registry as R
from quire import schema as S
from quire.operators import search as SE
from quire.operators import upsert as U
from quire.operators.index import Index
from quire.plans import sync as SY
from quire.sources.store import Store
from quire.streaming import ingest as IN


def _rows(df, cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_stream_ingest_is_searchable_and_equals_a_rebuild(spark, scratch):
    b = R.colliding_batch(spark, SF_SMALL)
    b.withColumn("part", F.concat("server", F.lit("-"), (F.col("arrival") >= 100).cast("int"))).write.partitionBy("part").json(f"{scratch}/landing")
    q = IN.start_ingest(spark, f"{scratch}/landing", f"{scratch}/table", f"{scratch}/ckpt", files_per_batch=1)
    q.awaitTermination(600)
    store = Store(spark, f"{scratch}/table")
    papers, idx = store.papers(), store.index()
    assert papers.count() == papers.select("doi").distinct().count() == U.dedup_latest(b).count()
    rebuilt = Index.build(papers)
    for table, cols in (("postings", ["token", "doi", "field", "pos"]), ("docs", ["doi", "dl", "date", "category"]), ("terms", ["token", "df", "cf"])):
        assert _rows(getattr(idx, table), cols) == _rows(getattr(rebuilt, table), cols), table
    for text in ("ndat ntea", '"of the"', "esat*"):
        find = lambda i: [(r.doi, round(r._score, 9)) for r in SE.search(i, papers, text, with_score=True).collect()]  # noqa: E731, B023
        assert find(idx) == find(rebuilt)


def test_a_batch_that_dies_loses_nothing(spark, scratch, make_papers, monkeypatch):
    from conftest import paper

    store = Store(spark, f"{scratch}/table", max_segments=2)
    assert store.commit(make_papers([paper(doi="10.5555/a", title="first tide"), paper(doi="10.5555/b", title="other")]), "1") == 2
    second = make_papers([paper(doi="10.5555/a", title="second ebb")])
    monkeypatch.setattr(store, "_publish", lambda v: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.commit(second, "2")
    monkeypatch.undo()
    assert {r.title for r in store.papers().collect()} == {"first tide", "other"}
    assert store.commit(second, "2") == 1 and store.commit(second, "2") == 0
    assert store.commit(make_papers([paper(doi="10.5555/c", title="third")]), "3") == 1  # compacts
    assert len(store.version()["segments"]) == 1
    assert sorted(r.title for r in store.papers().collect()) == ["other", "second ebb", "third"]
    assert {r.token for r in store.index().terms.collect()} >= {"ebb", "third"} and store.index().terms.where("token = 'tide'").count() == 0


def test_sync_commits_each_window(spark, scratch, make_papers):
    from conftest import paper

    def fetch(start, end):
        if broken and start > "2013-02-01":
            raise OSError("no answer")
        return make_papers([paper(doi=f"10.5555/{start}", date=start), paper(doi="10.5555/same", title=start, date=end)])

    broken, store = True, Store(spark, f"{scratch}/one")
    with pytest.raises(OSError):
        SY.auto_sync(store, fetch, "2013-03-15")
    assert store.papers().count() == 3 and store.state() == {S.STATE_BULK_CURSOR: "2013-03-01"}
    broken = False
    assert SY.auto_sync(store, fetch, "2013-03-15") == {"kind": "bulk", "count": 2}
    clean = Store(spark, f"{scratch}/two")
    assert SY.auto_sync(clean, fetch, "2013-03-15") == {"kind": "bulk", "count": 6}
    assert _rows(store.papers(), S.PAPER_FIELDS) == _rows(clean.papers(), S.PAPER_FIELDS)
    assert store.state() == clean.state() == {S.STATE_LAST_SYNC: "2013-03-15"}
    assert SY.auto_sync(store, fetch, "2013-03-16") == {"kind": "delta", "count": 2}


def test_entry_smoke(spark):
    import __spark_entry__ as E

    rows = E.entry(spark).collect()
    assert rows
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(R.QUERIES) == 63


def test_oracle_subset_small(spark):
    import duckdb

    import __spark_entry__ as E

    con = duckdb.connect()
    for t in ("documents", "labels", "events", "conversations", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    for name in ("search_relevance", "match_phrase", "match_near", "request_bursts", "window_counts", "expand_terms"):
        df = E.queries()[name](spark, SF_SMALL)
        got = sorted(tuple(str(v) for _, v in sorted(r.asDict().items())) for r in df.collect())
        res = con.execute(E.oracle_sql()[name])
        cols = [d[0] for d in res.description]
        exp = sorted(tuple(str(v) for _, v in sorted(zip(cols, row))) for row in res.fetchall())
        assert got == exp, name
