import random

import numpy as np

from quire.llm import bpe, lm, neardup, packing, suffix, toxicity
from quire.llm.langid import labels, viterbi
from quire.llm.spans import WordHash, Words


def test_encoder_equals_the_tokenizer():
    encoder = bpe.Encoder(packing.default_tokenizer())
    rng = random.Random(1)
    bits = ["'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "a", "B", "é", "9", "!", "''", "’", " ", "中", "ß",
            "<|endoftext|>", "²", "\x1c", "\x85", "l", "ve", "m", "🙂", "_", "и", "ا"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(20_000)] + ["word " * 50_000]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_and_hashes():
    texts = ["Ab c1, ab", None, "", "İx İx", "a" * 10]
    ((lo, hi, doc, code, words, start, end),) = list(Words().split(texts))
    assert (lo, hi) == (0, 5)
    got = [(d, words[c], s, e) for d, c, s, e in zip(doc.tolist(), code.tolist(), start.tolist(), end.tolist())]
    assert [g[:2] for g in got] == [(0, "ab"), (0, "c1"), (0, "ab"), (3, "İx"), (3, "İx"), (4, "a" * 10)]
    assert got[1][2:] == (3, 5)
    data = np.frombuffer(b"abcabc", np.uint8)
    h = WordHash()(data, np.array([0, 3, 0]), np.array([3, 6, 2]))
    assert h[0] == h[1] != h[2]


def test_minimum_bin_slack():
    rng = random.Random(2)
    for _ in range(60):
        counts = {rng.randint(1, 40): rng.randint(1, 5) for _ in range(rng.randint(1, 8))}
        room = rng.randint(1, 60)
        used = packing.fill(counts, room)
        assert all(used[k] <= counts[k] for k in used)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1) if s + k * j <= room}
        assert sum(k * v for k, v in used.items()) == max(sums)
    counts = {k: rng.randint(0, 30) for k in range(1, 64)}
    plan = packing.patterns(counts, 64)
    placed = {}
    for uses, used in plan:
        assert sum(k * v for k, v in used.items()) <= 64
        for k, v in used.items():
            placed[k] = placed.get(k, 0) + uses * v
    assert placed == {k: v for k, v in counts.items() if v}


def brute_segments(values):
    """All maximal scoring segments, by their definition: recursively the
    best one, then left and right of it."""
    best, at = 0.0, None
    for a in range(len(values)):
        total = 0.0
        for b in range(a, len(values)):
            total += values[b]
            if total > best + 1e-12:
                best, at = total, (a, b)
    if at is None:
        return []
    a, b = at
    left = brute_segments(values[:a])
    right = [(x + b + 1, y + b + 1, s) for x, y, s in brute_segments(values[b + 1 :])]
    return [*left, (a, b, best), *right]


def test_maximal_segments():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(0, 30)
        values = [rng.uniform(0.1, 3) if rng.random() < 0.3 else -0.5 for _ in range(n)]
        at = [i for i, v in enumerate(values) if v > 0]
        got = toxicity.segments(at, [values[i] for i in at], 0.5)
        want = brute_segments(values)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_darts_agree_as_often_as_the_sets_are_similar():
    rng = np.random.default_rng(4)
    base = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    other = np.concatenate([base[:45], rng.integers(1, 1 << 62, 10).astype(np.uint64)])
    wa, wb = rng.integers(1, 5, len(base)).astype(float) / 2, np.concatenate([np.ones(45), np.ones(10) * 1.5])
    doc = np.repeat([0, 1], [len(base), len(other)])
    k = 4000
    sig = neardup.darts(doc, np.concatenate([base, other]), np.concatenate([wa, wb]), 3, k)
    x, y = dict(zip(base.tolist(), wa)), dict(zip(other.tolist(), wb))
    both = sum(min(x.get(e, 0), y.get(e, 0)) for e in x | y)
    want = both / sum(max(x.get(e, 0), y.get(e, 0)) for e in x | y)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04
    assert (sig[2] == 0).all() and (sig[:2] != 0).all()


def test_viterbi():
    rng = np.random.default_rng(6)
    for _ in range(40):
        sizes = rng.integers(0, 6, 5)
        score = [rng.normal(0, 3, (n, 3)) for n in sizes]
        doc = np.repeat(np.arange(5), sizes)
        if not sizes.sum():
            continue
        path = labels(doc, np.concatenate(score), 5, 2.0)
        for i, s in enumerate(score):
            best = -np.inf
            for c in range(3 ** len(s)):
                p = [c // 3**j % 3 for j in range(len(s))]
                v = sum(s[j][p[j]] for j in range(len(s))) - 2.0 * sum(p[j] != p[j - 1] for j in range(1, len(s)))
                best = max(best, v)
            own = path[doc == i]
            got = sum(s[j][own[j]] for j in range(len(s))) - 2.0 * sum(own[j] != own[j - 1] for j in range(1, len(s)))
            assert not len(s) or abs(got - best) < 1e-9
    assert [p.tolist() for p in viterbi([np.array([[1.0, 0], [0, 9]]), np.array([[0.0, 1]])], 0.5)] == [[0, 1], [1]]


def test_group_comparisons_agree():
    rng = np.random.default_rng(8)
    least, before = 8, 5
    for later in (False, True):
        for _ in range(30):
            n = int(rng.integers(2, 14))
            grid = rng.integers(1, 3, (n, before + least)).astype(np.uint8)
            grid[:, before : before + 3] = 7
            l, r = rng.integers(0, before + 1, n), rng.integers(3, least + 1, n)
            for i in range(n):
                grid[i, : before - l[i]] = 0
                grid[i, before + r[i] :] = 0
            rank = rng.permutation(n)
            a = suffix.compare_few(grid, l, r, rank, np.zeros(n, int), least, later)
            b = suffix.compare_many(grid, l, r, rank, least, later)
            assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_mixture_weights():
    bucket = np.array([1, 1, 2])
    shares = np.array([[0.1, 0.5, 0.0], [0.1, 0.0, 0.9], [0.1, 0.2, 0.0]])
    mix = lm.expectation_maximisation(bucket, np.array([10.0, 1000.0, 5.0]), shares)
    assert np.allclose(mix.sum(1), 1) and mix[1].argmax() == 2 and mix[2].argmax() == 1
