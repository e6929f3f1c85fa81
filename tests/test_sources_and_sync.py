"""Sync window plan, catalogue API source, descriptor XML, PDF check."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import paper
from quire import schema as S
from quire.operators import upsert as U
from quire.plans import sync as SY
from quire.sources import api_pages as AP
from quire.sources import pdf as PD
from quire.sources.thesaurus_xml import read_descriptor_xml


def _plan(spark, today, cursor=None, epoch=S.SYNC_EPOCH):
    return [(r.window_start, r.window_end) for r in SY.window_plan(spark, today, cursor, epoch).orderBy("w").collect()]


def test_window_plan_thirty_days_inclusive_last_ends_today(spark):
    assert _plan(spark, "2013-02-15") == [("2013-01-01", "2013-01-30"), ("2013-01-31", "2013-02-15")]


def test_no_window_starts_today(spark):
    assert _plan(spark, "2013-01-31") == [("2013-01-01", "2013-01-30")]
    assert _plan(spark, "2013-01-01") == []


def test_resume_after_cursor(spark):
    assert _plan(spark, "2013-03-01", cursor="2013-01-30") == [("2013-01-31", "2013-03-01")]
    assert _plan(spark, "2013-03-01", cursor="2013-02-28") == []


def _page(server, start, cursor, records, total):
    return {"server": server, "window_start": start, "window_end": "x", "cursor": cursor, "collection": records, "messages": [{"total": total}]}


def _land(root, *pages):
    os.makedirs(root, exist_ok=True)
    with open(f"{root}/pages.json", "w") as fh:
        fh.writelines(json.dumps(p) + "\n" for p in pages)
    return root


def test_landed_pages_become_records(spark, scratch):
    recs = [{"doi": f"10.5555/{i}", "title": f"T{i}", "version": "1", "extra": "x"} for i in range(150)]
    root = _land(f"{scratch}/p", _page("biorxiv", "2024-01-01", 0, recs[:100], 150), _page("biorxiv", "2024-01-01", 100, recs[100:], 150),
                 _page("medrxiv", "2024-01-01", 0, [], 0), _page("elsewhere", "2024-01-01", 0, recs[:1], 1))
    rows = AP.read_records(spark, root).orderBy("cursor", "idx").collect()
    assert len(rows) == 150 and "extra" not in rows[0].asDict()
    assert (rows[120].cursor, rows[120].idx, rows[120].abstract, rows[120].server) == (100, 20, "", "biorxiv")


def test_faulty_pages_are_errors(spark, scratch):
    recs = [{"doi": "10.5555/1", "title": "a"}] * 100
    gap = _land(f"{scratch}/gap", _page("biorxiv", "2024-01-01", 0, recs, 250), _page("biorxiv", "2024-01-01", 200, recs[:50], 250))
    with pytest.raises(ValueError, match="2024-01-01 at 100: missing"):
        AP.read_records(spark, gap)
    bad = _land(f"{scratch}/bad", {"server": "biorxiv", "window_start": "2024-01-01", "cursor": 0, "error": "down"})
    with pytest.raises(ValueError, match="no collection"):
        AP.read_records(spark, bad)


def test_fetch_lands_every_page(spark, scratch):
    def transport(server, start, end, cursor):
        n = 230 if server == "biorxiv" else 0
        return {"collection": [{"doi": f"10.5555/{server}{i}"} for i in range(cursor, min(cursor + 100, n))], "messages": [{"total": n}]}

    plan = spark.createDataFrame([("biorxiv", "2024-01-01", "2024-01-30"), ("medrxiv", "2024-01-01", "2024-01-30")], "server string, window_start string, window_end string")
    AP.fetch_pages(plan, transport, f"{scratch}/landed", waits=())
    rows = AP.read_records(spark, f"{scratch}/landed").select("cursor", "idx", "doi").orderBy("cursor", "idx").collect()
    assert [r.doi for r in rows] == [f"10.5555/biorxiv{i}" for i in range(230)]


def test_waits_buy_tries():
    slept, answers = [], iter([OSError("a"), {"error": 1}, {"collection": []}])

    def ask():
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    assert AP.patiently(ask, (1.0, 2.0, 4.0), slept.append) == {"collection": []} and slept == [1.0, 2.0]
    with pytest.raises(ValueError, match="without a collection"):
        AP.patiently(lambda: {}, (1.0,), slept.append)


def test_positions_with_many_partitions_and_a_wide_column(spark):
    from pyspark.sql import Window

    from quire.operators.order import positions

    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        df = spark.range(60_000).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("o"), F.repeat(F.col("id").cast("string"), 30).alias("wide"))
        df = df.withColumn("g", F.when(F.col("g") > 0, F.col("g")))  # a null group too
        got = positions(df, ["g"], ["o"], "p")
        want = F.row_number().over(Window.partitionBy("g").orderBy("o")) - 1
        assert got.count() == 60_000 and got.columns == ["g", "o", "wide", "p"]
        assert got.withColumn("w", want).where("p <> w").count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_bulk_sync_later_page_wins_and_state(spark, make_papers):
    recs = make_papers(
        [paper(doi="10.1101/x", title="first", version="3", date="2024-01-05"), paper(doi="10.1101/x", title="second", version="1", date="2024-02-10")]
    )
    recs = recs.withColumn("cursor", F.lit(0)).withColumn("idx", F.col("arrival").cast("int"))
    state = U.state_set(U.empty_state(spark), S.STATE_BULK_CURSOR, "2023-12-31")
    table, new_state, counts = SY.bulk_sync(recs.limit(0).drop("cursor", "idx", "arrival"), recs, state, "2024-03-01")
    assert [r.title for r in table.collect()] == ["second"]
    assert U.state_get(new_state, S.STATE_LAST_SYNC) == "2024-03-01"
    assert U.state_get(new_state, S.STATE_BULK_CURSOR) is None
    assert sum(r["count"] for r in counts.collect()) == 2


def test_descriptor_xml_gz(spark, scratch):
    xml = (
        "<DescriptorRecordSet>"
        "<DescriptorRecord><DescriptorUI>D1</DescriptorUI><ConceptList>"
        "<Concept><TermList><Term><String>Neoplasms</String></Term><Term><String>Tumor</String></Term></TermList></Concept>"
        "<Concept><TermList><Term><String>Cancer</String></Term></TermList></Concept>"
        "</ConceptList></DescriptorRecord>"
        "<DescriptorRecord><DescriptorUI>D2</DescriptorUI><ConceptList><Concept><TermList>"
        "<Term><String>Alone</String></Term></TermList></Concept></ConceptList></DescriptorRecord>"
        "</DescriptorRecordSet>"
    )
    os.makedirs(f"{scratch}/xml", exist_ok=True)
    with gzip.open(f"{scratch}/xml/desc.xml.gz", "wt") as fh:
        fh.write(xml)
    rows = sorted((r.record_id, r.term) for r in read_descriptor_xml(spark, f"{scratch}/xml").collect())
    assert rows == [("D1", "Cancer"), ("D1", "Neoplasms"), ("D1", "Tumor"), ("D2", "Alone")]


def test_pdf_sink_and_check(spark, scratch):
    docs = spark.createDataFrame(
        [("10.1101/a", bytearray(b"%PDF-1.4 x")), ("10.1101/b", bytearray(b"<html>")), ("10.1101/c", bytearray(b""))],
        "doi string, content binary",
    )
    manifest = PD.write_pdfs(docs, f"{scratch}/pdf")
    manifest.write.parquet(f"{scratch}/manifest")
    got = {r.file: (r.status, r.bytes) for r in PD.check_pdfs(spark, f"{scratch}/pdf", spark.read.parquet(f"{scratch}/manifest")).collect()}
    assert got == {"10.1101_a": (200, 10), "10.1101_b": (502, 6), "10.1101_c": (502, 0)}
