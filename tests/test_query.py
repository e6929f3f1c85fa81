"""Query-string rules (driver side)."""

import pytest

from quire.plans.query import NOTHING, And, Near, Not, Or, Phrase, QueryError, build, parse, sanitize
from quire.operators import thesaurus as TH


def test_sanitize_hyphen_becomes_phrase():
    assert sanitize("sub-tidal reefs --a!b-") == ['"sub tidal"', "reefs", '"a b"']


def test_sanitize_strips_punctuation_keeps_star():
    assert sanitize("sand*, (reef9) -x- y!z") == ["sand*", "reef9", "x", "y", "z"]


def test_quote_keeps_query_whole():
    assert build('kelp "red algae"') == parse('kelp "red algae"')


def test_punctuation_only_is_nothing():
    assert build("()") is NOTHING


def test_hyphen_phrase_tree():
    assert build("sub-tidal") == Phrase(("sub", "tidal"))


def test_hyphen_with_star_is_plain_phrase():
    assert build("sub-ti*") == Phrase(("sub", "ti"))


def test_prefix():
    assert build("Sand*") == Phrase(("sand",), prefix=True)


def test_inner_star_is_prefix_and_word():
    assert build("sa*nd") == And((Phrase(("sa",), prefix=True), Phrase(("nd",))))


def test_operators():
    assert build("a AND b") == And((Phrase(("a",)), Phrase(("b",))))
    assert build("a OR b") == Or((Phrase(("a",)), Phrase(("b",))))
    assert build("a NOT b") == Not(Phrase(("a",)), Phrase(("b",)))


def test_not_binds_tighter_than_and_and_or():
    t = parse("a OR b AND c NOT d")
    assert t == Or((Phrase(("a",)), And((Phrase(("b",)), Not(Phrase(("c",)), Phrase(("d",)))))))


def _lookup(spark, groups):
    return TH.lookup_fn(spark.createDataFrame([(str(r), t) for r, t in groups], "record_id string, term string"))


def test_lower_case_operator_is_a_word_and_disables_expansion(spark):
    look = _lookup(spark, TH.SEED_GROUPS)
    t = build("salt and the", look)
    assert t == And((Phrase(("salt",)), Phrase(("and",)), Phrase(("the",))))


def test_leading_not_and_lone_star_are_errors():
    with pytest.raises(QueryError):
        build("NOT a")
    with pytest.raises(QueryError):
        build("a OR")
    with pytest.raises(QueryError):
        build("*")


def test_near_and_columns():
    t = parse('NEAR("a b" c, 5)')
    assert t == Near((Phrase(("a", "b")), Phrase(("c",))), 5)
    assert parse('title: "x"') == Phrase(("x",), fields=(0,))
    assert parse('-title: x') == Phrase(("x",), fields=(1, 2, 3))
    assert parse('^"the"') == Phrase(("the",), initial=True)


def test_quoted_phrase_anywhere_is_honoured():
    assert build('foo "bar baz"') == And((Phrase(("foo",)), Phrase(("bar", "baz"))))


def test_synonym_expansion_and_grouping(spark):
    look = _lookup(spark, [(1, "cod"), (1, "gadus"), (1, "codling"), (2, "spring tide"), (2, "syzygy")])
    assert build("cod", look) == Or((Phrase(("cod",)), Phrase(("gadus",)), Phrase(("codling",))))
    t = build("spring tide cod", look)
    assert t.items[0] == Or((Phrase(("spring", "tide")), Phrase(("syzygy",))))


def test_synonyms_shortest_first_limit_three(spark):
    look = _lookup(spark, [(1, "aaaa"), (1, "bbb"), (1, "ccccc"), (1, "dd"), (1, "eeeeee"), (1, "fff")])
    assert look(["aaaa"])["aaaa"] == ["bbb", "fff", "ccccc"]


def test_near_three_members_matches_brute_force(spark):
    """NEAR over three phrases on a small fixture: Spark = DuckDB oracle =
    a direct check over token positions."""
    import duckdb

    from conftest import paper
    from quire import oracle as O
    from quire.functions.text import tokenize_py
    from quire.operators import upsert as U
    from quire.operators.index import Index
    from quire.operators.match import matched_docs

    texts = [
        "a x b y c",  # span fits
        "a x x x x x b c",  # b..c near, a too far
        "c b a",  # any order
        "a b",  # c missing
        "b q q a q q c q q b",
    ]
    rows = [paper(doi=f"10.1101/{i}", title=t) for i, t in enumerate(texts)]
    from quire import schema as S

    data = [tuple(r.get(f, "") for f in S.PAPER_FIELDS) + (i,) for i, r in enumerate(rows)]
    schema = ", ".join(f"{f} string" for f in S.PAPER_FIELDS) + ", arrival long"
    p = U.dedup_latest(spark.createDataFrame(data, schema))
    tree = parse("NEAR(a b c, 3)")
    got = {r.doi for r in matched_docs(Index.build(p), tree, score=False).collect()}

    def brute(t, n=3):
        toks = tokenize_py(t)
        pos = {w: [i for i, x in enumerate(toks) if x == w] for w in "abc"}
        best = False
        for ia in pos["a"]:
            for ib in pos["b"]:
                for ic in pos["c"]:
                    lo, hi = min(ia, ib, ic), max(ia, ib, ic)
                    best = best or hi - (lo + 1) <= n
        return best

    assert got == {f"10.1101/{i}" for i, t in enumerate(texts) if brute(t)}
    con = duckdb.connect()
    con.register("ptab", p.toPandas())
    sql = O.match_sql(tree, score=False).replace(f"FROM ({O.TOKENS})", "FROM (" + O.TOKENS.replace(f"FROM ({O.PAPERS})", "FROM ptab") + ")")
    assert {r[0] for r in con.execute(sql).fetchall()} == got
