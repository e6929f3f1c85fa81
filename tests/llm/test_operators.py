"""Each operator against brute force or an exact property, and odd inputs."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import ann, chat, common, components, langid, lm, mixing, neardup, packing, suffix, topk, toxicity
from tests.llm.helpers import DOCS, fold, odd_documents, with_clashes, words, write

LABELS = "doc_id long, quality int, toxic int"
VECTORS = "vec_id long, embedding array<float>, label int"
TURNS = "conv_id long, turn long, role string, text string"
DOC_QUERIES = [toxicity.op1_toxicity, langid.op3_language, neardup.op4_near_duplicates, packing.op5_pack_sequences,
               suffix.op7_repeated_passages, lm.op8_language_model, mixing.op9_mix_sources]


@pytest.fixture(scope="module")
def odd(spark):
    return write(spark, documents=(DOCS, odd_documents()), labels=(LABELS, [(4, 1, 1), (4, 1, 0), (8, 0, 0), (None, 1, 1), (7, 1, None)]))


def test_empty_tables(spark):
    folder = write(spark, documents=(DOCS, []), labels=(LABELS, []), embeddings=(VECTORS, []), conversations=(TURNS, []))
    for query in [*DOC_QUERIES, topk.op2_exact_top, ann.op10_nearest, chat.op6_chat_perspectives]:
        assert query(spark, folder).collect() == [], query


def test_stages_keep_columns_and_rows_with_clashing_names(spark, odd):
    docs = with_clashes(spark.read.parquet(f"{odd}/documents.parquet"))
    for stage in (toxicity.toxicity_stage, neardup.near_duplicate_stage, suffix.suffix_stage, mixing.mix_stage):
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns and out.count() <= 2 * docs.count()
        empty = stage(spark, docs.limit(0), odd)
        assert empty.columns == docs.columns and empty.count() == 0
    assert packing.pack_stage(spark, docs, odd).count() > 0


def test_toxicity(spark, odd):
    rows = toxicity.op1_toxicity(spark, odd).collect()
    assert len(rows) == len(odd_documents()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) for r in rows)
    rng = random.Random(7)
    docs, marks = [], []
    for i in range(400):
        text = words(rng, 60).split()
        bad = i % 5 == 0
        for _ in range(4 * bad):
            text.insert(rng.randint(0, 60), rng.choice(["zzuglyword", "qqnasty", "zzuglywords"]))
        docs.append((i, " ".join(text), "en", "a", 0))
        marks.append((i, 1, int(bad)))
    folder = write(spark, documents=(DOCS, docs), labels=(LABELS, marks))
    got = {r.doc_id: r for r in toxicity.op1_toxicity(spark, folder).collect()}
    held = [i for i in got if got[i].held_out]
    assert np.mean([got[i].predicted == (i % 5 == 0) for i in held]) > 0.95
    source = spark.read.parquet(f"{folder}/documents.parquet")
    score = toxicity.scorer(spark, toxicity.learn(source, spark.read.parquet(f"{folder}/labels.parquet")))
    row = source.where("doc_id = 5").select("text", score("text").alias("s")).first()
    assert row.s.passages and all("zz" in row.text[p.first : p.end] or "qq" in row.text[p.first : p.end] for p in row.s.passages)


def vectors(n, seed, width=16):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, width)], 0) for i in range(n)]
    same = rows[3][1]
    rows += [(n + i, same, 0) for i in range(n // 2)]  # a third of all rows
    return rows + [(None, same, 0), (5000, None, 0), (5050, [1.0, None], 0), (5100, [float("nan")] * width, 0), (5150, [1.0, 2.0], 0), (5200, [0.0] * width, 0), (100, same, 0)]


def test_exact_top_is_brute_force(spark):
    rows = vectors(300, 1)
    folder = write(spark, embeddings=(VECTORS, rows))
    kept = [(i, v) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in kept]
    want = collections.Counter()
    for k, (q, a) in enumerate(whole):
        if q is None or q % 50:
            continue
        best = sorted((-sum(x * y for x, y in zip(a, b)), 1 << 62 if i is None else i, i) for j, (i, b) in enumerate(whole) if j != k)[:5]
        want.update((q, r, i, -s) for r, (s, _, i) in enumerate(best, 1))
    got = topk.exact_top(spark.read.parquet(f"{folder}/embeddings.parquet"), block=64, queries=4)
    assert collections.Counter(map(tuple, got.collect())) == want
    assert topk.products(np.array([2**40]), np.array([[2**30], [1]])).tolist() == [2**63 - 1, 2**40]


def test_nearest_recall_and_scores(spark):
    rows = vectors(2000, 2)
    folder = write(spark, embeddings=(VECTORS, rows))
    got = collections.defaultdict(dict)
    for r in ann.nearest(spark.read.parquet(f"{folder}/embeddings.parquet"), block=1500, queries=50).collect():
        got[r.query_id][r.rank] = r
    kept = [(i, np.array(v + [0.0] * (16 - len(v)))) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids = np.array([1 << 62 if i is None else i for i, _ in kept])
    x = np.array([v for _, v in kept])
    hit = total = 0
    for k in np.flatnonzero((ids % 20 == 0) & (ids != 100) & (ids < 1 << 62)):
        s = x @ x[k]
        s[k] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        found = got[ids[k]]
        assert sorted(found) == list(range(1, 21))
        hit += len(set(best) & {1 << 62 if r.vec_id is None else r.vec_id for r in found.values()})
        total += 20
        for r in found.values():
            assert any(abs(r.score - s[j]) < 1e-9 for j in np.flatnonzero(ids == (1 << 62 if r.vec_id is None else r.vec_id)))
    assert hit / total >= 0.9
    few = write(spark, embeddings=(VECTORS, [(0, [1.0], 0), (1, [2.0], 0), (20, [3.0], 0)]))
    assert ann.op10_nearest(spark, few).count() == 4
    for scale in (1e200, 1e-200, 1.0):  # squares out of the range of doubles
        huge = [(0, [scale, 1.0]), (1, [scale, 2.0]), (2, [-scale, 0.0]), (3, [scale / 2, 1.0]), (4, [scale, -scale]), (5, [0.0, 0.0])]
        rows = ann.nearest(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).orderBy("rank").collect()
        want = sorted(((-(a[0] * huge[0][1][0] + a[1] * huge[0][1][1]), i) for i, a in huge[1:5]))
        assert [(r.vec_id, r.score) for r in rows] == [(i, -s) for s, i in want], scale


def test_language(spark, odd):
    rng = random.Random(9)
    tongues = {"aa": "abcde", "bb": "defgh", "cy": "абвгд"}
    docs = [(i, words(rng, 30, tongues[t]), t, "s", 0) for i in range(300) for t in [list(tongues)[i % 3]]]
    docs += [(1000, words(rng, 30, "abcde") + " " + words(rng, 20, "абвгд"), None, "s", 0), (1001, None, "aa", "s", 0), (1002, "12 ..", "aa", "s", 0)]
    folder = write(spark, documents=(DOCS, docs))
    got = {r.doc_id: r for r in langid.op3_language(spark, folder).collect()}
    assert np.mean([got[i].lang_pred == list(tongues)[i % 3] for i in range(300) if got[i].held_out]) > 0.97
    assert got[1000].lang_pred == "aa" and got[1000].n_spans == 2 and 0.4 < got[1000].score < 0.8
    assert (got[1001].lang_pred, got[1001].score) == ("und", 0.0) and got[1002].lang_pred == "und"
    rows = langid.op3_language(spark, odd).collect()
    assert len(rows) == len(odd_documents()) and {r.lang_pred for r in rows} <= {"en", "fr", "und"}


def shingle_counts(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def brute_classes(rows):
    """Class members (row numbers) by exact weighted Jaccard similarity."""
    sets = [shingle_counts(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] == rows[j][1] and rows[i][1]
            both = sum((sets[i] & sets[j]).values())
            every = sum((sets[i] | sets[j]).values())
            if same or (every and both / every >= 0.8):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("small", [neardup.SMALL, 2])
def test_near_duplicates_are_brute_force_classes(spark, small):
    rng = random.Random(11)
    rows = odd_documents()
    base = words(rng, 120).split()
    for i in range(60):  # one large group, edited here and there, and chains of edits
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randint(0, 119)] = "edit%d" % rng.randint(0, 9)
        rows.append((100 + i, " ".join(text), "en", "a", 0))
    chain = words(rng, 100).split()
    for i in range(8):
        chain = chain[2:] + words(rng, 2).split()
        rows.append((200 + i, " ".join(chain), "en", "a", 0))
    rows += [(300 + i, words(rng, 50), "en", "a", 0) for i in range(40)]
    folder = write(spark, documents=(DOCS, rows))
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    keyed = neardup.keyed(docs)
    found = neardup.classes(docs, small=small)
    got = keyed.join(neardup.members_of(keyed, found), ["k1", "k2"]).select("doc_id", "class_id", "class_size").collect()
    want = collections.defaultdict(list)
    for (i, t, *_), r in zip(rows, brute_classes(rows)):
        if t:
            want[r].append(i)
    least = lambda m: min((x for x in m if x is not None), default=None)
    expected = collections.Counter((i, least(m), len(m)) for m in want.values() for i in m)
    assert collections.Counter((r.doc_id, r.class_id, r.class_size) for r in got) == expected
    kept = neardup.near_duplicate_stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    blank = sum(1 for r in rows if not r[1])
    assert kept.count() == len(want) + blank


def straddling_family(rng, n, size=120):
    """Edits of one base that isn't there itself: pairs on both sides of 0.8."""
    base, rows = words(rng, size).split(), []
    for i in range(n):
        text = list(base)
        for j in rng.sample(range(0, size, 6), 2):
            text[j] = "own%d" % i if rng.random() < 0.7 else "edit%d" % rng.randint(0, 3)
        rows.append(" ".join(text))
    return rows


@pytest.mark.parametrize("small, turns", [(2, neardup.TURNS), (2, 1), (neardup.SMALL, neardup.TURNS)])
def test_near_duplicates_of_large_buckets_are_brute_force_classes(spark, small, turns, monkeypatch):
    monkeypatch.setattr(neardup, "CUT", 7, raising=False)  # shingles of many texts are dealt in cuts
    rng = random.Random(21)
    rows = [(100 + i, t, "en", "a", 0) for i, t in enumerate(straddling_family(rng, 150) + straddling_family(rng, 60, 60))]
    rows += [(500 + i, words(rng, 50), "en", "a", 0) for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3).select("doc_id", "text")
    keyed = neardup.keyed(docs)
    got = keyed.join(neardup.members_of(keyed, neardup.classes(docs, small=small, turns=turns)), ["k1", "k2"]).collect()
    least = {}
    for (i, *_), r in zip(rows, brute_classes(rows)):
        least[r] = min(i, least.get(r, i))
    want = {i: least[r] for (i, *_), r in zip(rows, brute_classes(rows))}
    assert 2 < len({want[i] for i in range(100, 310)}) < 200
    assert {r.doc_id: r.class_id for r in got} == want


def test_query_of_near_duplicates_has_every_row(spark, odd):
    rows = neardup.op4_near_duplicates(spark, odd).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r[0] for r in odd_documents())


def test_components(spark):
    rng = random.Random(12)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900 + i) for i in range(1, 60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges for x in (a, b) if a != b}
    assert got == {x: find(x) for x in linked}


def test_rows_that_count_shingles_follow_the_tasks(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 7, rng.integers(0, 1 << 62, 3000).tolist()) for i in range(40)]
    texts = spark.createDataFrame(rows, "root long, hashes array<long>").repartition(4)
    held = neardup.cell_counts(texts)
    assert held.count() <= 4 * neardup.CELLS // neardup.RANGE
    n, roots = collections.Counter(), collections.defaultdict(set)
    for root, hashes in rows:
        for c in neardup.cell_of(np.array(hashes, np.int64)).tolist():
            n[c] += 1
            roots[c].add(root)
    rank, several = neardup.rarity(texts)
    assert {c: int(rank[c]) for c in n} == {c: round(8 * math.log2(k)) for c, k in n.items()}
    assert set(np.flatnonzero(several).tolist()) == {c for c, r in roots.items() if len(r) > 1}


def test_only_the_result_of_a_step_stays_in_the_shared_folder(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    texts = straddling_family(rng, 40) * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = suffix.with_keys(docs, "doc", "k1").select("doc_id", "text", "doc", "k1")
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    found = neardup.classes(docs.select("doc_id", "text"), small=2)
    assert [x.rsplit("-", 1)[0] for x in os.listdir(tmp_path)] == ["near-classes"]
    assert found.count() > 0
    spans = suffix.repeated_spans(docs.select("doc", "k1", "text"), 240, later=True)
    assert not [x for x in os.listdir(tmp_path) if x.startswith("suffix-classes")]
    assert spans.count() > 0


@pytest.mark.parametrize("window", [2048, 64])
def test_packing(spark, odd, window):
    path = packing.default_tokenizer()
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    rows = [r.asDict() for r in packing.pack(docs, path, window, keep_ids=True).collect()]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    want = collections.Counter()
    for i, text, *_ in odd_documents():
        want[i, tuple([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])] += 1
    by_doc = collections.defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    for (i, n), pieces in by_doc.items():
        copies = [k for k in want if k[0] == i and len(k[1]) == n]
        flat = collections.Counter((r["start"], tuple(r["ids"])) for r in pieces)
        assert flat == sum((collections.Counter({(a, k[1][a : a + window]): want[k] for a in range(0, n, window)}) for k in copies), collections.Counter())
    assert sum(r["length"] for r in rows) == sum(len(k[1]) * c for k, c in want.items())
    at = collections.defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in at.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= window


def brute_repeats(rows, least):
    """Marked bytes of every row."""
    seen = collections.defaultdict(list)
    data = [(t or "").encode() for _, t, *_ in rows]
    for k, d in enumerate(data):
        for p in range(len(d) - least + 1):
            seen[d[p : p + least]].append((k, p))
    marks = [bytearray(len(d)) for d in data]
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                marks[k][p : p + least] = b"\1" * least
    return data, marks


def repeated_documents():
    rng = random.Random(13)
    rows = odd_documents()
    passage, other = words(rng, 100), words(rng, 90)
    for i in range(40):
        cut, size = rng.randint(0, 200), rng.randint(380, 520)
        rows.append((400 + i, words(rng, 10) + passage[cut : cut + size] + words(rng, 5) + (other if i % 3 else other[:395]) + "é", "en", "a", 0))
    rows.append((500, "ab " * 400 + words(rng, 5), "en", "a", 0))
    rows.append((501, "é" * 500, "en", "a", 0))
    rows.append((502, passage[:399], "en", "a", 0))
    rows.append((503, other[:400], "en", "a", 0))
    return rows


def test_repeated_passages_are_brute_force(spark):
    rows = repeated_documents()
    folder = write(spark, documents=(DOCS, rows))
    data, marks = brute_repeats(rows, 400)
    want = collections.Counter()
    for (i, *_), d, m in zip(rows, data, marks):
        kept = bytes(b for b, x in zip(d, m) if not x)
        runs = len(re.findall(rb"\x01+", bytes(m)))
        want[i, len(d), sum(m), runs, hashlib.sha256(kept).hexdigest()] += 1
    got = suffix.op7_repeated_passages(spark, folder).collect()
    assert collections.Counter(map(tuple, got)) == want


def test_a_passage_in_most_documents_is_no_task_of_its_own(spark, monkeypatch):
    rng = random.Random(31)
    passage = words(rng, 100)
    rows = [(i, passage if i < 2400 else words(rng, 80), "en", "a", 0) for i in range(3000)]
    folder = write(spark, documents=(DOCS, rows))
    sizes, join = [], suffix.with_kinds

    def measured(marks, kinds, reached):
        found = join(marks, kinds, reached)
        per_task = found.groupBy(F.spark_partition_id()).count()
        sizes.extend(r["count"] for r in per_task.collect())
        assert found.count() == marks.join(kinds, ["gram", "context"]).count()
        return found

    monkeypatch.setattr(suffix, "with_kinds", measured)
    monkeypatch.setattr(suffix, "PIECE_ROWS", 50)
    own = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(own, ("64", "false", "-1")):
            spark.conf.set(k, v)
        got = suffix.op7_repeated_passages(spark, folder).collect()
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)
    assert len(got) == 3000 and all((r.n_removed == r.n_bytes) == (r.doc_id < 2400) for r in got)
    assert max(sizes) < sum(sizes) / 10


def test_first_copies_stay(spark):
    rng = random.Random(14)
    passage = words(rng, 80)
    rows = [(i, words(rng, 30) + " " + passage + " " + words(rng, 30), "en", "a", 0) for i in range(30)]
    rows += [(50, "plain " + words(rng, 40), "en", "a", 0), (51, passage + words(rng, 9) + " " + passage, "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = {r.doc_id: r.text for r in suffix.suffix_stage(spark, docs, "").collect()}
    assert out[0] == rows[0][1] and out[50] == rows[30][1]
    assert all(passage not in out[i] and len(out[i]) <= len(rows[i][1]) - len(passage) for i in range(1, 30))
    assert passage not in out[51]
    # groups of any size: windows as rows give the same intervals
    keyed = suffix.with_keys(docs.select("doc_id", "text"), "doc", "k1").select("doc", "k1", "text")
    for later in (True, False):
        union = lambda g: {(r.doc, r.k1): suffix.covered(r.spans, 10**9) for r in suffix.repeated_spans(keyed, 240, later, g).collect()}  # noqa: E731, B023
        assert union(suffix.GROUP) == union(3)


def test_language_model(spark, odd):
    rng = random.Random(15)
    common = words(rng, 30).split()
    rows = [r for r in odd_documents() if r[0] != 8]  # its words alone would set the mixture
    assert len(lm.op8_language_model(spark, odd).collect()) == len(odd_documents())
    for i in range(200):
        rows.append((600 + i, " ".join(rng.choice(common) for _ in range(50)) + "\t" + words(rng, 3).upper(), "en", "a", 0))
    folder = write(spark, documents=(DOCS, rows))
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = [[*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low)), None] for _, t, *_ in rows]
    count = collections.Counter()
    for (i, *_), w in zip(rows, tokens):
        if fold(i, 7) != 2:
            count.update(w)
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for (i, *_), w in zip(rows, tokens):
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        want[i, fold(i, 7) == 2, len(w), sum(count[x] > 0 for x in w), n, round(base, 3)] += 1
    got = lm.op8_language_model(spark, folder).collect()
    assert collections.Counter((*r[:5], round(r.base_score, 3)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score <= 0 for r in got)


def test_language_model_counts_every_pair(spark, monkeypatch):
    mixes, learn = [], lm.expectation_maximisation
    monkeypatch.setattr(lm, "expectation_maximisation", lambda *a: mixes.append(learn(*a)) or mixes[-1])
    rng = random.Random(22)
    common, couples = words(rng, 40).split(), [words(rng, 2) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(couples) if rng.random() < 0.3 else rng.choice(common) for _ in range(40)), "en", "a", 0) for i in range(150)]
    rows += [(900, None, "en", "a", 0), (901, "never seen words", "en", "a", 0), (None, rows[0][1], "en", "a", 0)]
    got = lm.score(spark.createDataFrame(rows, DOCS).repartition(3).select("doc_id", "text"), part_bytes=2000).collect()
    word, pair = collections.Counter(), collections.Counter()
    tokens = [[None, *(t or "").split(), None] for _, t, *_ in rows]
    for (i, *_), w in zip(rows, tokens):
        if fold(i, 7) != 2:
            word.update(w[1:])
            pair.update(zip(w, w[1:]))
    n, v = sum(word.values()), len(word)
    want = {}
    for (i, *_), w in zip(rows, tokens):
        want[i] = 0
        for h, x in zip(w, w[1:]):
            mix = mixes[0][min(1 + int(math.log2(word[h])), lm.BUCKETS - 1) if word[h] else 0]
            want[i] += math.log10(mix[0] / (v + 1) + mix[1] * word[x] / n + mix[2] * (pair[h, x] / word[h] if word[h] else 0))
    assert {r.doc_id: round(r.score, 6) for r in got} == {i: round(s, 6) for i, s in want.items()}


def test_mixing_to_given_weights_is_brute_force(spark):
    def fill(budget, kids):  # [(name, capacity, weight)] -> {name: tokens}
        got, kids = {}, [k for k in kids if k[1] > 0 and k[2] > 0]
        while kids:
            full = [k for k in kids if budget * k[2] / sum(x[2] for x in kids) >= k[1]]
            if not full:
                return got | {n: budget * w / sum(x[2] for x in kids) for n, _, w in kids}
            n, cap, _ = min(full, key=lambda k: k[1] / k[2])
            got[n], budget, kids = cap, budget - cap, [k for k in kids if k[0] != n]
        return got

    rng = random.Random(4)
    tree = [(d, a, s, 3, rng.randint(0, 900)) for d in ("web", "books") for a in "xyz" for s in "123" if rng.random() < 0.8]
    given = {("web",): 3.0, ("books",): 1.0, ("web", "x"): 5.0, ("web", "y"): 0.0, ("books", "x", "1"): 1e6, ("none",): 4.0}
    rows = [(*n, *[None] * (3 - len(n)), w) for n, w in given.items()] + [("web", None, None, 1.0), ("web", "z", None, None), (None, "x", None, 9.0)]
    weights = spark.createDataFrame(rows, "domain string, lang string, source string, weight double")
    leaves = spark.createDataFrame(tree, "__domain string, __lang string, __source string, __rows long, __tokens long")
    total = sum(t for *_, t in tree)
    for share, epochs in ((0.4, 1), (1.0, 2), (1.9, 2), (3.0, 2)):

        def down(node, budget):
            if len(node) == 3:
                return {node: math.floor(budget + 1e-6)}
            size = collections.Counter()
            for *leaf, _, t in tree:
                if tuple(leaf[: len(node)]) == node:
                    size[tuple(leaf[: len(node) + 1])] += t
            kids = fill(budget, [(k, t * epochs, given.get(k, t**0.7)) for k, t in size.items()])
            return {leaf: b for k, b in kids.items() for leaf, b in down(k, b).items()}

        plan = {tuple(r[:3]): r["__budget"] for r in mixing.allocate(leaves, share, epochs, 0.7, weights).collect()}
        want = down((), math.floor(total * share))
        assert plan.keys() == want.keys() and all(abs(plan[k] - want[k]) <= 1 for k in want)
    docs = spark.createDataFrame([(i, "word " * 8, "en", "ab"[i % 2], 0) for i in range(200)], DOCS)
    sources = {s: docs.where(f"source = '{s}'").select(mixing.domain_of(F.col("source"))).first()[0] for s in "ab"}
    targets = spark.createDataFrame([(d, None, None, 1.0) for d in set(sources.values())] + [(sources[s], "en", s, w) for s, w in (("a", 3.0), ("b", 1.0))], weights.schema)
    took = collections.Counter(r.source for r in mixing.mix(docs, share=0.5, weights=targets).collect())
    assert took == ({"a": 75, "b": 25} if len(set(sources.values())) == 1 else {"a": 50, "b": 50})


def test_mixing_budgets(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    got = mixing.mix(docs, rows_per_range=2).collect()
    total = sum(-(-len((t or "").encode()) // 4) for _, t, *_ in odd_documents())
    assert sum(r["__n"] for r in got) <= total
    for share in (0.3, 5.0):
        out = mixing.mix(docs, share=share, rows_per_range=2)
        used = sum(r["__n"] for r in out.collect())
        assert used <= min(share, mixing.MAX_EPOCHS) * total
        if share > mixing.MAX_EPOCHS:  # all leaves are full
            assert used == mixing.MAX_EPOCHS * total
    leaves = spark.createDataFrame(
        [("a", "x", "1", 1, 10), ("a", "x", "2", 1, 1000), ("b", "x", "1", 1, 5000)], "__domain string, __lang string, __source string, __rows long, __tokens long"
    )
    plan = {(r["__domain"], r["__source"]): r["__budget"] for r in mixing.allocate(leaves, 0.3, 1, 0.0).collect()}
    # by equal weights; what source 1 lacks goes to its sibling, not to the other domain
    assert plan == {("a", "1"): 10, ("a", "2"): 891, ("b", "1"): 901}
    plan = {(r["__domain"], r["__source"]): r["__budget"] for r in mixing.allocate(leaves, 0.6, 1, 0.0).collect()}
    assert plan == {("a", "1"): 10, ("a", "2"): 1000, ("b", "1"): 2596}  # only then to the other


def test_chat(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "ann", "x"), (1, None, "bob", "first"), (2, 0, "system", "alone"), (None, 0, None, "q"), (1, 2, "ann", "x")]
    folder = write(spark, conversations=(TURNS, rows))
    found = chat.perspectives(spark.read.parquet(f"{folder}/conversations.parquet"), part=4).collect()
    by = collections.defaultdict(str)
    own = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: r.part):
        own[r.conv_id, r.speaker] += [r.rendered[s.first : s.end] for s in r.spans]
        by[r.conv_id, r.speaker] += r.rendered
    assert by[1, "bob"] == (
        "<|assistant|>\nfirst<|end|>\n<|system|>\nrules<|end|>\n<|user|>\nann: hi<|end|>\n<|user|>\nann: x<|end|>\n"
        "<|user|>\nann: x<|end|>\n<|assistant|>\n<|end|>\n"
    )
    assert own[1, "bob"] == ["first<|end|>", "<|end|>"] and own[1, "ann"] == ["hi<|end|>", "x<|end|>", "x<|end|>"]
    assert set(by) == {(1, "ann"), (1, "bob"), (None, "")}
