"""DuckDB SQL for the correctness oracle.

The Spark side works on postings (one row per token occurrence); the oracle
works on per-document token lists with positional list filters. Both start
from the same query tree, so the check covers the distributed execution
(index layout, occurrence aggregation, NEAR windows, BM25 arithmetic and
top-k), while unit tests cover the query-string rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from quire import schema as S
from quire.operators.match import compile_tree
from quire.plans.query import And, Near, Not, Nothing, Or, Phrase

PAPER_VIEW = """
SELECT '10.1101/' || lpad(doc_id::varchar, 7, '0') AS doi,
       split_part(text, '.', 1) AS title,
       array_to_string(list_transform(range(0, doc_id % 4 + 1),
           lambda i: 'Author ' || ((doc_id * 7 + i) % 50)::varchar), '; ') AS authors,
       text AS abstract,
       strftime(DATE '2024-01-01' + (doc_id % 365)::int, '%Y-%m-%d') AS date,
       CASE WHEN doc_id % 3 = 0 THEN '  ' || upper(source) || ' ' ELSE source END AS category,
       (doc_id % 3 + 1)::varchar AS version,
       CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS type,
       '' AS license, '' AS published, '' AS author_corresponding,
       'Univ ' || upper(lang) AS author_corresponding_institution,
       '' AS jatsxml,
       CASE WHEN doc_id % 2 = 0 THEN 'biorxiv' ELSE 'medrxiv' END AS server,
       doc_id AS arrival
FROM documents
"""

PAPERS = f"""
SELECT doi, title, authors, abstract, date, lower(trim(category)) AS category, version, type, license,
       published, author_corresponding, author_corresponding_institution, jatsxml, server, arrival
FROM ({PAPER_VIEW})
"""


def tok(expr: str) -> str:
    return f"regexp_extract_all(strip_accents(lower(coalesce({expr}, ''))), '[\\p{{L}}\\p{{N}}]+')"


TOKENS = f"""
SELECT doi, date, category,
       [{', '.join(tok(f) for f in S.INDEX_FIELDS)}] AS f
FROM ({PAPERS})
"""

DL = " + ".join(f"len(f[{i + 1}])" for i in range(len(S.INDEX_FIELDS)))

COMPACT_AUTHORS = (
    "CASE WHEN len(list_filter(list_transform(string_split(coalesce(authors, ''), ';'), lambda a: trim(a)), lambda a: a <> '')) <= 2 "
    "THEN array_to_string(list_filter(list_transform(string_split(coalesce(authors, ''), ';'), lambda a: trim(a)), lambda a: a <> ''), '; ') "
    "ELSE list_filter(list_transform(string_split(coalesce(authors, ''), ';'), lambda a: trim(a)), lambda a: a <> '')[1] || '; ... ; ' || "
    "list_filter(list_transform(string_split(coalesce(authors, ''), ';'), lambda a: trim(a)), lambda a: a <> '')[-1] END"
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _fields(ph: Phrase) -> list[int]:
    return list(ph.fields) if ph.fields is not None else list(range(len(S.INDEX_FIELDS)))


def _tok_test(expr: str, tokn: str, prefix: bool) -> str:
    return f"starts_with({expr}, {q(tokn)})" if prefix else f"{expr} = {q(tokn)}"


def _starts(ph: Phrase, fi: int) -> str:
    """1-based start positions of ``ph`` in field ``fi``."""
    k = len(ph.tokens)
    arr = f"f[{fi + 1}]"
    conds = [
        _tok_test(f"{arr}[s + {j}]", t, ph.prefix and j == k - 1) for j, t in enumerate(ph.tokens)
    ]
    if ph.initial:
        conds.append("s = 1")
    return f"list_filter(range(1, len({arr}) - {k} + 2), lambda s: {' AND '.join(conds)})"


def spec_tf(ph: Phrase) -> str:
    if not ph.tokens:
        return "0"
    return "(" + " + ".join(f"len({_starts(ph, fi)})" for fi in _fields(ph)) + ")"


def near_cols(near: Near, n: int) -> list[tuple[str, str]]:
    """Covered-instance counts per member and the document flag (two or more
    members: an instance is covered when every other member has an instance
    within the distance)."""
    out = []
    flags = []
    all_fields = sorted({fi for ph in near.phrases for fi in _fields(ph)})
    for m, ph in enumerate(near.phrases):
        per_field = []
        for fi in all_fields:
            if fi not in _fields(ph):
                continue
            conds = []
            for o, other in enumerate(near.phrases):
                if o == m:
                    continue
                if fi not in _fields(other):
                    conds.append("false")
                    continue
                lm, lo = len(ph.tokens), len(other.tokens)
                gap = (
                    f"CASE WHEN x < y OR (x = y AND {m} < {o}) THEN y - (x + {lm}) ELSE x - (y + {lo}) END"
                )
                conds.append(f"len(list_filter({_starts(other, fi)}, lambda y: {gap} <= {near.distance})) > 0")
            per_field.append(f"len(list_filter({_starts(ph, fi)}, lambda x: {' AND '.join(conds)}))")
        expr = "(" + " + ".join(per_field) + ")" if per_field else "0"
        out.append((f"n{n}_{m}", expr))
        flags.append(expr)
    # document flag: some instance x is the leftmost of a group made of the
    # earliest following instance of every other member, and the last of
    # those starts at most ``distance`` tokens after x ends
    anchors = []
    for fi in all_fields:
        for m, ph in enumerate(near.phrases):
            if fi not in _fields(ph):
                continue
            nexts = []
            ok = True
            for o, other in enumerate(near.phrases):
                if o == m:
                    continue
                if fi not in _fields(other):
                    ok = False
                    break
                tie = "y >= x" if o > m else "y > x"
                nexts.append(f"list_min(list_filter({_starts(other, fi)}, lambda y: {tie}))")
            if not ok:
                continue
            cond = " AND ".join(f"{e} IS NOT NULL" for e in nexts)
            last = f"greatest({', '.join(nexts)})"
            anchors.append(
                f"len(list_filter({_starts(ph, fi)}, lambda x: {cond} AND {last} - (x + {len(ph.tokens)}) <= {near.distance})) > 0"
            )
    out.append((f"f{n}", "CASE WHEN " + (" OR ".join(anchors) if anchors else "false") + " THEN 1 ELSE 0 END"))
    return out


def match_sql(tree, *, score: bool = True) -> str:
    """SELECT doi, dl, date, category[, score] of documents matching ``tree``."""
    if isinstance(tree, Nothing):
        cols = "doi, 0 AS dl, date, category" + (", 0.0::DOUBLE AS score" if score else "")
        return f"SELECT {cols} FROM ({TOKENS}) WHERE false"
    comp = compile_tree(tree)
    cols = [(f"s{i}", spec_tf(ph)) for i, ph in enumerate(comp.specs)]
    for n, near in enumerate(comp.nears):
        cols += near_cols(near, n)
    sel = ",\n       ".join(f"{e} AS {name}" for name, e in cols)
    slot_tf = []
    for p, sid in enumerate(comp.slot_spec):
        nm = comp.slot_near[p]
        slot_tf.append(f"s{sid}" if nm is None else f"n{nm[0]}_{nm[1]}")
    counter = iter(range(len(comp.slot_spec)))
    near_counter = iter(range(len(comp.nears)))

    def cond(node) -> str:
        if isinstance(node, Phrase):
            p = next(counter)
            return f"({slot_tf[p]} > 0)" if node.tokens else "false"
        if isinstance(node, Near):
            for _ in node.phrases:
                next(counter)
            return f"(f{next(near_counter)} > 0)"
        if isinstance(node, And):
            return "(" + " AND ".join(cond(x) for x in node.items) + ")"
        if isinstance(node, Or):
            return "(" + " OR ".join(cond(x) for x in node.items) + ")"
        if isinstance(node, Not):
            return f"({cond(node.left)} AND NOT {cond(node.right)})"
        return "false"

    where = cond(comp.tree)
    dfs = ", ".join(f"count(*) FILTER (WHERE s{i} > 0)::DOUBLE AS df{i}" for i in range(len(comp.specs)))
    k1, b = S.BM25_K1, S.BM25_B
    terms = []
    for p, sid in enumerate(comp.slot_spec):
        idf_raw = f"ln((st.n_docs - st.df{sid} + 0.5::DOUBLE) / (st.df{sid} + 0.5::DOUBLE))"
        idf = f"(CASE WHEN {idf_raw} <= 0.0 THEN {S.IDF_FLOOR}::DOUBLE ELSE {idf_raw} END)"
        tf = f"d.{slot_tf[p]}::DOUBLE"
        norm = f"({k1}::DOUBLE * ({1.0 - b}::DOUBLE + {b}::DOUBLE * d.dl / st.avgdl))"
        terms.append(f"{idf} * (({tf} * {k1 + 1.0}::DOUBLE) / ({tf} + {norm}))")
    score_sql = " + ".join(terms)
    return f"""
WITH d AS (
  SELECT doi, date, category, ({DL}) AS dl,
       {sel}
  FROM ({TOKENS})
), st AS (
  SELECT count(*)::DOUBLE AS n_docs, sum(dl)::DOUBLE / count(*) AS avgdl, {dfs} FROM d
)
SELECT d.doi, d.dl, d.date, d.category{', ' + score_sql + ' AS score' if score else ''}
FROM d, st
WHERE {where}
"""


def filter_sql(category: str | Sequence[str] | None = None, after: str | None = None, before: str | None = None, prefix: str = "") -> str:
    preds = []
    if category:
        if isinstance(category, str):
            preds.append(f"lower(trim({prefix}category)) = {q(category.strip().lower())}")
        else:
            items = ", ".join(q(c.strip().lower()) for c in sorted({c.strip().lower() for c in category}))
            preds.append(f"lower(trim({prefix}category)) IN ({items})")
    if after:
        preds.append(f"{prefix}date >= {q(after)}")
    if before:
        preds.append(f"{prefix}date <= {q(before)}")
    return " AND ".join(preds) if preds else "true"


def search_sql(tree, limit: int = S.DEFAULT_LIMIT, category=None, after=None, before=None, detail=False, sort="relevance") -> str:
    m = match_sql(tree)
    order = "m.score DESC, m.doi ASC" if sort == "relevance" else "m.date DESC, m.doi ASC"
    fields = S.PAPER_FIELDS if detail else S.COMPACT_FIELDS
    cols = []
    for c in fields:
        if c == "authors" and not detail:
            cols.append(f"{COMPACT_AUTHORS} AS authors")
        elif c == "category":
            cols.append("lower(trim(p.category)) AS category")
        else:
            cols.append(f"p.{c}")
    return f"""
WITH m AS ({m}), top AS (
  SELECT m.doi, m.score FROM m WHERE {filter_sql(category, after, before, 'm.')} ORDER BY {order} LIMIT {limit}
)
SELECT {', '.join(cols)} FROM ({PAPERS}) p JOIN top USING (doi)
"""


def count_sql(tree, category=None, after=None, before=None) -> str:
    return f"SELECT count(*) AS count FROM ({match_sql(tree, score=False)}) m WHERE {filter_sql(category, after, before, 'm.')}"
