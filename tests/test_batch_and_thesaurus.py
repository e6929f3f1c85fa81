"""Batch search = single searches; distributed grouping = driver rule;
annotation = phrase matcher; incremental index = rebuilt."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from quire import registry as R
from quire.operators import batch as BA
from quire.operators import search as SE
from quire.operators import thesaurus as TH
from quire.operators import upsert as U
from quire.operators.index import Index, build_postings, term_stats
from quire.operators.match import matched_docs
from quire.plans.query import Phrase, group_words


def test_batch_equals_single_searches(spark):
    c = R.ctx(spark, SF_SMALL)
    recs = R.thesaurus(spark, SF_SMALL)
    qs = R.saved_queries(spark, SF_SMALL)
    batch = BA.batch_search(c.index, qs, recs, k=10).collect()
    byq = {}
    for r in batch:
        byq.setdefault(r.qid, []).append((r.doi, r.score))
    look = TH.lookup_fn(recs)
    for q in qs.orderBy("qid").collect()[:8]:
        res = SE.search(c.index, c.papers, q.text, limit=10, lookup=look, with_score=True).collect()
        single = [(r.doi, round(r._score, 6)) for r in res]
        assert sorted(byq.get(q.qid, []), key=lambda x: (-x[1], x[0])) == single


def test_group_phrases_matches_driver_rule(spark):
    recs = R.thesaurus(spark, SF_SMALL)
    qs = R.saved_queries(spark, SF_SMALL)
    texts = qs.select("qid", TH.query_words(F.col("text")).alias("w")).collect()
    known = {r.term for r in TH.known_terms(recs).collect()}
    got = {}
    for r in TH.group_phrases(recs, qs, "qid", TH.query_words(F.col("text"))).collect():
        got.setdefault(r.id, []).append((r.start, r.phrase))
    for t in texts:
        exp, pos = [], 0
        for g in group_words(list(t.w), known):
            exp.append((pos, " ".join(g)))
            pos += len(g)
        assert sorted(got.get(t.qid, [])) == exp


def test_group_phrases_finds_multiword_terms(spark):
    recs = spark.createDataFrame([("a", "in the"), ("a", "that"), ("b", "new york city"), ("b", "nyc")], "record_id string, term string")
    texts = spark.createDataFrame([(1, "we live in the new york city now")], "id long, text string")
    rows = sorted((r.start, r.phrase) for r in TH.group_phrases(recs, texts, "id", TH.query_words(F.col("text"))).collect())
    assert rows == [(0, "we"), (1, "live"), (2, "in the"), (4, "new york city"), (7, "now")]


def test_annotation_matches_phrase_search(spark):
    c = R.ctx(spark, SF_SMALL)
    recs = R.thesaurus(spark, SF_SMALL)
    ann = TH.annotate_docs(recs, c.papers)
    terms = [r.term for r in ann.groupBy("term").count().orderBy(F.desc("count"), "term").limit(5).collect()]
    from quire.functions.text import tokenize_py

    for t in terms:
        exp = {r.doi for r in matched_docs(c.index, Phrase(tuple(tokenize_py(t))), score=False).collect()}
        got = {r.doi for r in ann.where(F.col("term") == t).collect()}
        assert got == exp


def test_annotation_finds_terms_of_any_length(spark, make_papers):
    from conftest import paper

    recs = spark.createDataFrame(
        [("a", "north-sea 2 herring larvae survey"), ("a", "nshls"), ("b", "herring larvae"), ("b", "larvae")], "record_id string, term string"
    )
    papers = make_papers([paper(title="The North Sea 2 herring larvae survey", abstract="larvae, herring larvae; north sea 2 herring eggs")])
    got = {r.term: r.hits for r in TH.annotate_docs(recs, papers).collect()}
    assert got == {"north-sea 2 herring larvae survey": 1, "herring larvae": 2, "larvae": 3}


def test_thesaurus_is_stored_once_and_missing_is_off(spark, scratch):
    import pytest

    with pytest.warns(UserWarning, match="synonyms are off"):
        assert TH.load_thesaurus(spark, f"{scratch}/none") is None
    assert TH.lookup_fn(None)(["cod"]) == {}
    recs = spark.createDataFrame([("a", "Cod"), ("a", "gadus"), ("a", "cod")], "record_id string, term string")
    TH.store_thesaurus(recs, f"{scratch}/t")
    assert TH.lookup_fn(TH.load_thesaurus(spark, f"{scratch}/t"))(["COD", "eel"]) == {"cod": ["gadus"]}


def test_expand_order_and_limit(spark):
    recs = spark.createDataFrame(
        [("r", t) for t in ["aaaa", "bbb", "ccccc", "dd", "eeeeee", "fff", "g" * 61]], "record_id string, term string"
    )
    rows = TH.expand(recs, spark.createDataFrame([("aaaa",)], "term string"), 5).orderBy("rank").collect()
    assert [r.syn for r in rows] == ["bbb", "fff", "ccccc", "eeeeee"]


def test_incremental_index_equals_rebuild(spark):
    c = R.ctx(spark, SF_SMALL)
    incoming = U.dedup_latest(R.colliding_batch(spark, SF_SMALL))
    merged = U.merge(c.papers, incoming)
    inc = U.index_upsert(c.index.postings, incoming)
    rebuilt = build_postings(merged)
    cols = ["token", "doi", "field", "pos"]
    assert inc.select(*cols).exceptAll(rebuilt.select(*cols)).count() == 0
    assert rebuilt.select(*cols).exceptAll(inc.select(*cols)).count() == 0
    removed = c.index.postings.join(incoming.select("doi"), "doi", "left_semi")
    refreshed = U.refresh_terms(c.index.terms, removed, build_postings(incoming))
    full = term_stats(rebuilt)
    assert refreshed.select("token", "df", "cf").exceptAll(full.select("token", "df", F.col("cf").cast("long"))).count() == 0


OPERATOR_TEXTS = [
    '"of the" OR esat NOT ndon',
    'esat NOT (ndon OR "of the")',
    'NEAR(esat ndon the, 60) OR "in the"',
    'esat NOT NEAR("of the" ndon, 20)',
    '"es"* AND ndo*',
    'abstract: "esat" OR title: ndon',
    '-title: "the" AND ^"esat"',
    "of-the AND esat",
    "zzzqqq OR ndon",
    "ndon NOT zzzqqq",
    '"esat ndon" "of the"',
    '""',
]


def test_operator_queries_equal_single_searches(spark):
    """Quotes, OR, NOT, NEAR, prefixes, fields and initial words in a batch."""
    c = R.ctx(spark, SF_SMALL)
    qs = spark.createDataFrame(list(enumerate(OPERATOR_TEXTS)), "qid long, text string")
    byq = {}
    for r in BA.batch_search(c.index, qs, R.thesaurus(spark, SF_SMALL), k=1000).orderBy("qid", "rank").collect():
        byq.setdefault(r.qid, []).append((r.doi, r.score))
    for qid, text in enumerate(OPERATOR_TEXTS):
        res = SE.search(c.index, c.papers, text, limit=1000, with_score=True).collect()
        single = sorted(((r.doi, round(r._score, 6)) for r in res), key=lambda x: (-x[1], x[0]))
        assert sorted(byq.get(qid, []), key=lambda x: (-x[1], x[0])) == single, text
    assert len(byq) >= 8


def test_words_and_operators_in_one_batch_and_reasons_for_no_hit(spark):
    c = R.ctx(spark, SF_SMALL)
    rows = [(1, "esat"), (2, "esat OR zzzqqq"), (3, "zzzqqq"), (4, '"never closed'), (5, "AND OR"), (6, " ,;"), (7, None), (8, '"zzzqqq"')]
    qs = spark.createDataFrame(rows, "qid long, text string")
    hits = BA.batch_search(c.index, qs, None, k=5)
    got = {q: [(r.rank, r.doi) for r in hits.where(f"qid = {q}").orderBy("rank").collect()] for q in (1, 2)}
    assert got[1] and got[1] == got[2]
    assert {r.qid for r in hits.collect()} == {1, 2}
    reasons = {r.qid: r.reason for r in BA.zero_hits(qs, hits, c.papers).collect()}
    assert reasons == {3: "no_match", 4: "bad_syntax", 5: "bad_syntax", 6: "no_words", 7: "no_words", 8: "no_match"}
    empty = BA.zero_hits(qs, hits, c.papers.limit(0)).collect()
    assert {r.reason for r in empty} == {"empty_corpus"}


def test_batch_of_operator_queries_alone_and_of_none(spark):
    c = R.ctx(spark, SF_SMALL)
    none = spark.createDataFrame([], "qid long, text string")
    assert BA.batch_search(c.index, none, None).count() == 0


def test_stored_lookup_pushes_its_terms_down(spark, scratch):
    recs = spark.createDataFrame(
        [("a", "Cod"), ("a", "gadus"), ("a", "gadus morhua"), ("b", "cod"), ("b", "eel"), ("c", "alone"), ("d", "cod"), ("d", "x")],
        "record_id string, term string",
    )
    ent = TH.store_entries(recs, f"{scratch}/entries")
    for source in (recs, ent):
        assert TH.lookup_fn(source)(["COD", "alone", "x", "none"]) == {"cod": ["eel", "gadus", "gadus morhua"], "x": ["cod"]}
        assert TH.lookup_fn(source, 1)(["cod"]) == {"cod": ["eel"]}
    plan = ent.where(F.col("term").isin(["cod", "eel"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan


def test_annotation_of_every_length_equals_brute_force(spark, make_papers):
    import random

    from conftest import paper

    rng = random.Random(5)
    words = ["a", "b", "c"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(30)]
    terms = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 11))) for _ in range(120)})
    recs = spark.createDataFrame([("r", t) for t in terms], "record_id string, term string")
    papers = make_papers([paper(doi=f"d{i}", title=t, abstract=texts[i - 1], authors=None) for i, t in enumerate(texts)])
    exp = {}
    for i, t in enumerate(texts):
        for field in (t, texts[i - 1]):
            f = field.split()
            for term in terms:
                tt = term.split()
                n = sum(f[j : j + len(tt)] == tt for j in range(len(f) - len(tt) + 1))
                if n:
                    exp[f"d{i}", term] = exp.get((f"d{i}", term), 0) + n
    got = {(r.doi, r.term): r.hits for r in TH.annotate_docs(recs, papers).collect()}
    assert got == exp
    assert TH.annotate_docs(recs.limit(0), papers).count() == 0
