"""Steps that must not grow faster than their tables."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, paper
from quire import registry as R
from quire import session
from quire.operators import index as IX
from quire.operators import thesaurus as TH
from quire.operators.order import positions


@pytest.fixture()
def small_tasks(monkeypatch):
    monkeypatch.setattr(session, "TASK_BYTES", 4 << 10)


def _parts(df):
    return df.select(F.input_file_name().alias("f")).distinct().count()


def test_partitions_follow_the_rows(spark, small_tasks, scratch, make_papers):
    papers = make_papers([paper(doi=f"10.1101/{i:06d}", abstract=" ".join(f"w{j % 97}" for j in range(i, i + 20))) for i in range(100)])
    idx = IX.build_and_save(papers, f"{scratch}/index")
    assert _parts(idx.postings) > 16 and _parts(idx.docs) <= 8
    assert _parts(R.store_papers(papers)) > 2
    assert idx.postings.groupBy("token", "doi").agg(F.count(F.lit(1))).count() == 2000 + 200
    placed = positions(papers, ["server"], ["doi"])
    assert sorted(r.position for r in placed.collect()) == list(range(100))


def test_term_statistics_of_shared_and_missing_dois(spark):
    rows = [("a", [["x", "x", "y"], ["x"]]), ("a", [["x"], ["z", "z"]]), (None, [["y"], []]), (None, [["y", "z"], []]), ("b", [["x"], []])]
    tok = spark.createDataFrame(rows, "doi string, toks array<array<string>>").withColumn("date", F.lit("")).withColumn("category", F.lit(""))
    got = {tuple(r) for r in IX.term_stats_of(tok).select("token", "df", "cf").collect()}
    assert got == {("x", 2, 5), ("y", 2, 3), ("z", 2, 3)}
    assert got == {tuple(r) for r in IX.term_stats(IX.postings_from_tokens(tok)).select("token", "df", "cf").collect()}


def test_index_counts_terms_without_its_postings(spark, monkeypatch, scratch, make_papers):
    monkeypatch.setattr(IX, "term_stats", lambda postings: postings.where("raise_error('postings counted') is null"))
    idx = IX.build_and_save(make_papers([paper(abstract="alpha alpha beta")]), f"{scratch}/index")
    assert {r.token: (r.df, r.cf) for r in idx.terms.where("token in ('alpha', 'beta')").collect()} == {"alpha": (1, 2), "beta": (1, 1)}


def test_annotation_cuts_windows_before_they_are_shuffled(spark):
    plan = TH.annotate_docs(R.thesaurus(spark, SF_SMALL), toks=R.ctx(spark, SF_SMALL).index.tokens)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "getbit" in text.lower() or "bit_get" in text.lower()
    assert text.count("posexplode(toks") == 1  # windows are made once


def test_phrases_of_common_words_are_looked_up_by_neighbours(spark, scratch, make_papers):
    from dataclasses import replace

    from quire.operators import batch as BA

    texts = ["the cat of a the house", "of the house", "the of the of", "house of cards", "a b a b"]
    idx = IX.build_and_save(make_papers([paper(doi=f"10.1101/{i}", abstract=t, title="") for i, t in enumerate(texts)]), f"{scratch}/index")
    queries = spark.createDataFrame([(1, '"of the"'), (2, '"of the hou"*'), (3, '"a b a b"'), (4, "house-of of")], "qid long, text string")
    rows = lambda i: sorted(tuple(r) for r in BA.batch_search(i, queries).select("qid", "doi", "score").collect())
    got = rows(idx)
    assert {r[:2] for r in got} == {(1, "10.1101/1"), (1, "10.1101/2"), (2, "10.1101/1"), (3, "10.1101/4"), (4, "10.1101/3")}
    assert got == rows(replace(idx, tokens=None))
    plans = BA.plan(queries, None)
    parts = plans.phrases.selectExpr("key", "prefix", "size(toks) as k", "posexplode(toks) as (j, term)", "toks").where("key = 'of the'")
    parts = parts.selectExpr("*", "get(toks, j + 1) as next_term")
    assert BA._pairs(parts.withColumn("is_prefix", F.lit(False)), idx.tokens).count() == 2  # of 9 places with either word


def test_starts_of_common_words_are_dealt_before_they_are_counted(spark, monkeypatch, scratch, make_papers):
    from quire.operators.match import matched_docs
    from quire.plans import query as QP

    texts = ["the cat of the house of the", "of the", "the of", None, "of theme", "of the of the of the"]
    papers = make_papers([paper(doi=f"10.1101/{i % 5}" if i else None, abstract=t, title="") for i, t in enumerate(texts)])
    idx = IX.build_and_save(papers, f"{scratch}/index")

    def rows(text):
        found = matched_docs(idx, QP.build(text))
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = found.select("doi", "dl", F.round("score", 6)).collect()
        return sorted(map(tuple, got), key=str), plan.count("REPARTITION_BY_NUM")

    queries = ["of-the", '"of the"*', 'cat AND "of the"', 'NEAR("of the" house, 3)']
    plain = [rows(q) for q in queries]
    assert [n for _, n in plain] == [0] * 4 and plain[0][0]
    monkeypatch.setattr(session, "TASK_BYTES", 1 << 10)
    large = [rows(q) for q in queries]
    assert [r for r, _ in large] == [r for r, _ in plain]
    assert all(n > 0 for _, n in large)


def test_tasks_that_make_postings_are_bounded(spark, monkeypatch, scratch, make_papers):
    rows = [paper(doi=f"10.1101/{i // 2:04d}" if i % 7 else None, abstract=" ".join(f"w{j % 31}" for j in range(i, i + 40))) for i in range(60)]
    plain = IX.build_and_save(make_papers(rows), f"{scratch}/plain")
    monkeypatch.setattr(session, "TASK_BYTES", 1 << 10)
    monkeypatch.setattr(IX, "BYPASS", 20)
    made = []
    deal = IX.dealt
    monkeypatch.setattr(IX, "dealt", lambda tok, n: made.append((deal(tok, n), n)) or made[-1][0])
    split = IX.build_and_save(make_papers(rows), f"{scratch}/split")
    (tok, n), = made
    assert n == 60 * 42 and tok.rdd.getNumPartitions() >= n * session.ROW_BYTES / (IX.SPLIT_TASKS << 10)
    for table in ("postings", "docs", "terms", "corpus"):
        a, b = getattr(plain, table), getattr(split, table)
        assert a.schema == b.schema and not a.exceptAll(b).count() and not b.exceptAll(a).count()


def _rows_of_joins(df):
    """Rows that the joins of ``df`` gave, once it was collected."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        todo += [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else []
        if name in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin"):
            found.append(node.metrics().apply("numOutputRows").value())
    return found


@pytest.mark.parametrize("common", [TH.COMMON, 1])
def test_windows_that_many_terms_share_make_no_rows(spark, monkeypatch, common):
    monkeypatch.setattr(TH, "COMMON", common)
    terms = [f"the of x{i}" for i in range(200)] + [f"the of in y{i}" for i in range(100)] + ["the of", "of the", "the of in to and", "the", "thé", "of", "to"]
    records = spark.createDataFrame([(f"r{i // 2}", t) for i, t in enumerate([*terms, "no such term"])], "record_id string, term string")
    toks = [("a", [["the", "of"] * 150, "the of in to and".split(), []]), ("a", [["the", "of", "x7"], ["the"], ["of"]]), (None, [["the", "of", "in", "y3"], ["in", "to"]])]
    got = TH.annotate_docs(records, toks=spark.createDataFrame(toks, "doi string, toks array<array<string>>"))
    want = {("a", "the"): 153, ("a", "thé"): 153, ("a", "of"): 153, ("a", "to"): 1, ("a", "the of"): 152, ("a", "of the"): 149, ("a", "the of x7"): 1, ("a", "the of in to and"): 1}
    want |= {(None, "the"): 1, (None, "thé"): 1, (None, "of"): 1, (None, "to"): 1, (None, "the of"): 1, (None, "the of in y3"): 1}
    rows = got.collect()
    assert {(r.doi, r.term): r.hits for r in rows} == want and len(rows) == len(want)
    joins = _rows_of_joins(got)
    assert joins and max(joins) < 2000  # 300 terms begin with "the of", at 153 places


def test_packed_postings_equal_plain_ones(spark, monkeypatch):
    from quire.operators import packed as PK

    words = ["a", "ä", "zz", "日本", "the", "the", "the", "0", "é" * 40]
    rows = [(None if i % 9 == 0 else "" if i == 1 else f"10.1101/{i // 2:03d}\n", [[words[(i * j) % len(words)] for j in range(i % 23)], [], ["the"] * (i % 4)]) for i in range(120)]
    tok = spark.createDataFrame([*rows, ("none", [])], "doi string, toks array<array<string>>").repartition(3)
    plain = IX.postings_from_tokens(tok)
    n = plain.count()
    for held in (PK.HELD, 40):
        monkeypatch.setattr(PK, "HELD", held)
        got = PK.sorted_postings(tok, 12, 121, n)
        assert got.dtypes == plain.dtypes and got.count() == n
        assert not got.exceptAll(plain).count() and not plain.exceptAll(got).count()
        parts = got.select(F.spark_partition_id().alias("i"), F.struct("token", F.coalesce("doi", F.lit("")).alias("doi")).alias("k")).groupBy("i").agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("i").collect()
        assert len(parts) > 6 and all(x.b < y.a for x, y in zip(parts, parts[1:]))
        runs = [(r.i, r.token, r.doi is not None, r.doi or "", r.field, r.pos) for r in got.withColumn("i", F.spark_partition_id()).collect()]
        assert runs == sorted(runs)
    assert PK.sorted_postings(tok.limit(0), 3, 0, 0).count() == 0


def test_an_index_leaves_no_shuffle_files_and_no_settings(spark, scratch, make_papers):
    import os
    import time

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for top in manager.localDirsString() for _, _, names in os.walk(top) for x in names if x.startswith("shuffle_")}
    before, own = files(), [spark.conf.get(k) for k in session._LEAN]
    IX.build_and_save(R.store_papers(make_papers([paper(doi=f"10.1101/{i}", abstract=f"alpha w{i}") for i in range(50)])), f"{scratch}/index")
    until = time.time() + 30
    while files() - before and time.time() < until:  # they go in the background
        time.sleep(0.2)
    assert not files() - before and [spark.conf.get(k) for k in session._LEAN] == own


@pytest.mark.parametrize("bits", [26, 12])
def test_removed_papers_go_without_a_shuffle_of_the_postings(spark, monkeypatch, bits):
    from quire.operators import bits as BI
    from quire.operators import upsert as U

    dois = [None if i == 7 else f"10.1101/{i // 2}" for i in range(4000)]
    tok = spark.createDataFrame([(d, [["sea", f"w{i % 5}"], ["ice"]]) for i, d in enumerate(dois)], "doi string, toks array<array<string>>")
    tok = tok.withColumn("date", F.lit("")).withColumn("category", F.lit(""))
    postings, docs = IX.postings_from_tokens(tok), IX.docs_from_tokens(tok)
    removed = spark.createDataFrame([(None,), ("10.1101/none",), *[(f"10.1101/{i}",) for i in range(0, 2000, 3)], ("10.1101/0",)], "doi string")
    want = postings.join(removed, "doi", "left_anti").select(postings.columns)
    few = U.index_delete(postings, removed, docs).select(postings.columns)
    monkeypatch.setattr(U, "FEW", 10)
    monkeypatch.setattr(BI, "BITS", (bits, bits))
    got = U.index_delete(postings, removed, docs).select(postings.columns)
    assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
    for rows in (few, got):
        assert rows.count() == want.count() and not rows.exceptAll(want).count() and not want.exceptAll(rows).count()
    sides = got._jdf.queryExecution().optimizedPlan().children()
    assert sides.size() == 2 and "LeftAnti" not in sides.apply(0).toString()  # those told by bits alone
    joined = sides.apply(1).toString()
    assert joined.count("LeftAnti") == 1 and joined.index("LeftAnti") < joined.index("getbit")  # after the bits
