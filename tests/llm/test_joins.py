"""Spelling variants, the n-gram join and centroid clustering: whole queries
against brute force, and odd inputs."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quire.llm import centroids, ngramjoin, variants
from tests.llm.helpers import DOCS, odd_documents, with_clashes, words, write

VECTORS = "vec_id long, embedding array<double>, label int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_empty_tables(spark):
    folder = write(spark, documents=(DOCS, []), embeddings=(VECTORS, []))
    for query in (variants.op11_spelling_variants, ngramjoin.op12_ngram_join, centroids.op13_centroids):
        assert query(spark, folder).collect() == [], query


# -- spelling variants ---------------------------------------------------------------


def counted(docs):
    n = collections.Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += len(run) >= 5
    return {w: c for w, c in n.items() if c >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variant_rows(docs):
    n = counted(docs)
    holes, near = collections.defaultdict(set), {w: set() for w in n}
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + "*" + w[i + 1 :]].add(w)
            if (short := w[:i] + w[i + 1 :]) in n:
                near[w].add(short)
                near[short].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def spelled(rng):
    """Texts with words of few letters, their damaged forms, and anagrams."""
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    base += ["".join(rng.sample("abcdeé", 6)) for _ in range(60)]
    docs = [(500 + i, "zyzzyva " * 3 + "zyzzyve " * 8 + "zyzyve " * 20, "en", "a", 0) for i in range(2)]
    for i in range(150):
        text = []
        for _ in range(60):
            w = rng.choice(base[: rng.choice([3, 30, 120])])
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", rng.choice("abc"), w[at] + rng.choice("abÿ")]) + w[at + 1 :]
            text.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, rng.choice([" ", ", ", "东", "-"]).join(text), "en", "a", 0))
    return docs


def test_variants(spark):
    docs = spelled(random.Random(1))
    folder = write(spark, documents=(DOCS, docs))
    rows = variants.op11_spelling_variants(spark, folder).collect()
    want = variant_rows(docs)
    assert len(rows) == len(want) > 200
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == want
    assert any(w[1] and w[2] != w[1] for w in want)  # a chain of forms


def test_variants_of_odd_documents(spark):
    docs = odd_documents() * 3
    folder = write(spark, documents=(DOCS, docs))
    got = variants.variants(with_clashes(spark.read.parquet(f"{folder}/documents.parquet")).withColumn("word", variants.F.lit(1)).select("doc_id", "text", "word"))
    assert {tuple(r) for r in got.collect()} == variant_rows(docs)


def test_signatures_meet_within_one_edit(spark):
    rng = random.Random(9)
    some = {"".join(rng.choice("aabcé") for _ in range(rng.randint(5, 7))) for _ in range(400)}
    frame = spark.createDataFrame([(w, 3) for w in some], "word string, n long")
    got = {(r.a, r.b) for r in variants.near_pairs(frame).collect()}
    got = {tuple(sorted(p)) for p in got}
    assert got == {(a, b) for a in some for b in some if a < b and one_edit(a, b)}


# -- n-gram join ---------------------------------------------------------------------


def grams(text, k=3):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def join_rows(docs, percent=90):
    """Per row (doc_id, n, component), by all pairs."""
    sets = [grams(t) for _, t, *_ in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, d in enumerate(docs):
        ids[find(i)].append(d[0])
    least = {r: min((x for x in own if x is not None), default=None) for r, own in ids.items()}
    return collections.Counter((d[0], len(s), least[find(i)]) for i, (d, s) in enumerate(zip(docs, sets)))


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        at = rng.randrange(len(w))
        w[at : at + 1] = rng.choice([[], ["new%d" % rng.randrange(10**6)], [w[at], "x%d" % rng.randrange(10**6)]])
    return " ".join(w)


def families(rng, groups=12, size=25, low=0, high=9, known=True):
    """Groups of edited copies of a base of 9 to 300 words, whose similarities
    lie on both sides of 0.9, and a line that many other documents share."""
    docs = []
    line = words(rng, 12)
    for _ in range(groups):
        base = words(rng, rng.choice([9, 12, 14, 25, 60, 120, 300]))
        docs += [base] * known
        docs += [edited(rng, base, rng.randint(low, max(low, min(high, len(base.split()) // 8)))) for _ in range(size)]
    docs += [line + " " + words(rng, rng.randint(5, 9)) for _ in range(60)]
    docs += [words(rng, rng.randint(0, 40)) for _ in range(40)] + ["One", "one", "one two", "ONE two three"] * 2
    rng.shuffle(docs)
    return [(i, t, "en", "a", 0) for i, t in enumerate(docs)]


@pytest.mark.parametrize("known", [True, False])
def test_join(spark, known):
    docs = families(random.Random(2 + known), known=known)
    folder = write(spark, documents=(DOCS, docs))
    got = collections.Counter(tuple(r) for r in ngramjoin.op12_ngram_join(spark, folder).collect())
    want = join_rows(docs)
    assert got == want
    assert len({k[2] for k in want}) < len(docs) - 100


@pytest.mark.parametrize("percent", [70])
def test_join_at_other_thresholds(spark, percent):
    """Edits of chains: each text is near the one before and far from the first."""
    rng = random.Random(percent)
    docs = []
    for _ in range(6):
        t = words(rng, rng.choice([15, 50, 90]))
        for _ in range(12):
            docs.append((len(docs), t, "en", "a", 0))
            t = edited(rng, t, rng.choice([0, 1, 1, 2, 4]))
    frame = spark.createDataFrame(docs, DOCS).select("doc_id", "text")
    got = collections.Counter(tuple(r) for r in ngramjoin.linked(frame, percent=percent).collect())
    assert got == join_rows(docs, percent)


def test_join_of_a_large_group_without_its_base(spark):
    """No text of the group is near most others, and no two groups of edits meet."""
    rng = random.Random(4)
    base = words(rng, 100)
    docs = [(i, edited(rng, base, rng.choice([1, 2, 2, 3, 3, 4, 5])), "en", "a", 0) for i in range(300)]
    frame = spark.createDataFrame(docs, DOCS).select("doc_id", "text")
    assert collections.Counter(tuple(r) for r in ngramjoin.linked(frame).collect()) == join_rows(docs)


def test_join_of_odd_documents(spark):
    docs = odd_documents()
    folder = write(spark, documents=(DOCS, docs))
    frame = with_clashes(spark.read.parquet(f"{folder}/documents.parquet")).withColumn("root", ngramjoin.F.lit(1))
    assert collections.Counter(tuple(r) for r in ngramjoin.linked(frame).collect()) == join_rows(docs)


def test_size_classes():
    """Sets that link share a class, and it is cut into more fragments than they differ in."""
    for percent in (60, 80, 90, 95):
        c = ngramjoin.Classes(percent)
        n = np.arange(1, 3000)
        own, next_ = c.of(n)
        for x in range(1, 1800, 3):
            y = np.arange(x, min(x * 100 // percent, 2999) + 1)
            differ = np.array([(x + z) * (100 - percent) // (100 + percent) for z in y[[0, -1]]])
            if own[x - 1] < 0:
                assert not differ.any()
                continue
            for z, d in zip(y[[0, -1]], differ):
                meet = own[z - 1]
                assert meet == own[x - 1] or (meet == own[x - 1] + 1 and next_[x - 1])
                assert c.fragments[meet] - d >= c.slack[meet]


# -- centroid clustering -------------------------------------------------------------


def cluster_rows(vectors):
    grid = lambda x: max(min(np.floor(float(x) * 256), 2.0**27), -(2.0**27))
    kept = [(i, [int(grid(x)) for x in v]) for i, v, *_ in vectors if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    v = np.array([r[1] for r in kept], object).reshape(-1, 64)
    c = v[:40].copy()
    if not len(c):
        return collections.Counter()
    for step in range(6):
        far = np.array([[int(((x - y) ** 2).sum()) for y in c] for x in v])
        near = far.argmin(1)
        if step < 5:
            for k in set(near):
                own = v[near == k]
                c[k] = [sum(own[:, j]) // len(own) for j in range(64)]
    least = [int(far[i, k]) for i, k in enumerate(near)]
    inertia = collections.Counter()
    for k, d in zip(near, least):
        inertia[k] += d
    name = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    most = 2**63 - 1
    return collections.Counter((r[0], k, d, min(inertia[k], most), min(sum(least), most), name[k]) for r, k, d in zip(kept, near, least))


def vectors_of(rng, n, centres=30):
    base = [[rng.gauss(0, 0.2) for _ in range(64)] for _ in range(centres)]
    return [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(base)], 0) for i in range(n)]


@pytest.mark.parametrize("n", [500, 17])
def test_centroids(spark, n):
    rows = vectors_of(random.Random(n), n)
    folder = write(spark, embeddings=(VECTORS, rows))
    got = collections.Counter(tuple(r) for r in centroids.op13_centroids(spark, folder).collect())
    assert got == cluster_rows(rows)


def test_centroids_of_odd_vectors(spark):
    rng = random.Random(3)
    rows = vectors_of(rng, 60)
    same = rows[0][1]
    rows += [(None, same, 0), (None, rows[1][1], 0), (7, same, 0), (7, same, 0), (100, None, 0), (101, [0.5], 0), (102, [0.0] * 64, 0), (103, [1e300] * 64, 0)]
    rows += [(104, [-1e300] * 64, 0), (105, same[:63] + [float("nan")], 0), (106, same[:63] + [float("inf")], 0), (107, same[:63] + [None], 0), (108, [], 0)]
    folder = write(spark, embeddings=(VECTORS, rows))
    frame = spark.read.parquet(f"{folder}/embeddings.parquet")
    for c in ("cluster", "distance", "v", "ids", "n"):
        frame = frame.withColumn(c, centroids.F.lit("x"))
    got = collections.Counter(tuple(r) for r in centroids.clustered(frame).collect())
    assert got == cluster_rows(rows)


def test_dictionaries_are_lossless():
    rng = np.random.default_rng(1)
    grid = rng.integers(-9, 9, (200, 64))
    books, codes = centroids.encoded(grid)
    assert (np.concatenate([b[c] for b, c in zip(books, codes)], axis=1) == grid).all()
    far = centroids.distances(books, codes, grid[:7])
    assert (far == ((grid[:, None, :] - grid[None, :7]) ** 2).sum(2)).all()
    sums = centroids.cluster_sums(books, codes, far.argmin(1), 7)
    for k in range(7):
        own = grid[far.argmin(1) == k]
        assert sums[k, 0] == len(own) and (sums[k, 1:] == own.sum(0)).all()
