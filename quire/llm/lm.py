"""Language-model scores of whole texts by deleted interpolation.

Tokens are words (bytes between blanks, A-Z in lower case) and an end after
each text. The model mixes maximum-likelihood estimates of the word given the
word before, of the word alone, and a uniform share,

    P(w | h) = a2(b) c(h, w) / c(h) + a1(b) c(w) / N + a0(b) / (V + 1),

with mixture weights by bucket b, the binary logarithm of the frequency of the
context h. The weights are learned by expectation-maximisation: a tenth of the
training documents is deleted from the counts, and the weights make these
held-out counts most likely under the counts of the rest.

Counting. Texts are written as slices of about ``SLICE`` tokens: codes of words, and
the different words by hash. Each slice sends its different words and pairs, by hash
range and in order of the hashes (as differences, by planes of bytes, compressed), with its
counts of them, so a frequent word or pair is one entry a slice; the range adds
up the counts and sends back what other slices have of them. The slices then score
their texts by themselves. Every word, context and pair is counted, however rare. Only for
learning the weights, deleted tokens are put in bins of an eighth of an octave.

Words and pairs are told apart by 64-bit hashes.

Defined results: null text is empty and scores its end alone; repeated rows
are scored, and counted, each; without training documents base_score and score
are 0; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import TEXTS, fold, parts_for, saved
from quire.llm.neardup import mix64
from quire.llm.spans import BATCH_CHARS, WordHash, distinct

PART_BYTES = 4e6
BUCKETS = 48
BINS = 512
FLUSH = 200_000
SLICE = 2_000_000
AT_ONCE = 4  # slices or answers in one Arrow batch
END = np.uint64(0xE0F5_0A7B_11C3_9D27)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False


def tokens(texts: list, hasher: WordHash) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of the texts: first and end text, and per token its text
    counted from the first and its hash; each text ends with END."""
    lo = 0
    while lo < len(texts):
        hi, size, some = lo, 0, []
        while hi < len(texts) and (hi == lo or size < BATCH_CHARS):
            some.append(texts[hi].encode("utf-8", "surrogatepass") if isinstance(texts[hi], str) else b"")
            size += len(some[-1])
            hi += 1
        data = _LOWER[np.frombuffer(b"\n".join(some), np.uint8)]
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = _WORD[data]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begins = np.r_[0, np.cumsum([len(b) + 1 for b in some])[:-1]].astype(np.int64)
        doc = np.searchsorted(begins, start, "right") - 1
        n = np.bincount(doc, minlength=hi - lo)
        stop = np.cumsum(n + 1) - 1  # where the ends go
        out = np.empty(len(start) + hi - lo, np.uint64)
        word = np.ones(len(out), bool)
        word[stop] = False
        if len(start):
            out[word] = hasher(data, start, end)
        out[stop] = END
        yield lo, hi, np.repeat(np.arange(hi - lo), n + 1), out
        lo = hi


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of the hashes, ascending with them."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def merge(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, where = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    total = [np.bincount(where, np.concatenate([f[k] for f in found]), len(keys)).astype(np.int64) for k in (1, 2)]
    return keys, *total


def roles(docs: DataFrame) -> DataFrame:
    """(doc_id, text, held_out, role): role 1 counts, 2 is deleted, 0 is not trained on."""
    c = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    held = fold("doc_id", 7) == 2
    role = F.when(held, 0).when(F.floor(c / 7) % 10 == 0, 2).otherwise(1).cast("int")
    return docs.select("doc_id", "text", held.alias("held_out"), role.alias("role"))


def bin_of(count: np.ndarray) -> np.ndarray:
    """Bins of an eighth of an octave; 0 is for 0."""
    return np.where(count > 0, 1 + np.round(8 * np.log2(np.maximum(count, 1))), 0).astype(np.int64)


def bin_count(b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, 2.0 ** ((b - 1) / 8), 0.0)


def bucket_of(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.minimum(1 + np.floor(np.log2(np.maximum(count, 1))), BUCKETS - 1), 0).astype(np.int64)


def cells(context: np.ndarray, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Bucket of the context, bin of the word's count, and bin of the pair's
    share of its context, as one number."""
    share = np.where(pair > 0, 1 + np.round(8 * np.log2(np.maximum(context, 1) / np.maximum(pair, 1))), 0).astype(np.int64)
    return (bucket_of(context) * BINS + bin_of(word)) * BINS + share


def planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second bytes and so on, which compresses well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def unplaned(data: bytes, n: int) -> np.ndarray:
    size = len(data) // n
    return np.frombuffer(data, np.uint8).reshape(size, n).T.copy().view(f"<u{size}").ravel()


def small(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, compressed."""
    top = int(x.max()) if len(x) else 0
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return zlib.compress(planes(x.astype(kind)), 1) if len(x) else b""


def wide(data: bytes, n: int) -> np.ndarray:
    """The ``n`` counts that ``small`` wrote."""
    return unplaned(zlib.decompress(data), n).astype(np.int64) if n else np.zeros(0, np.int64)


def hashes(data: bytes) -> np.ndarray:
    """Ascending hashes from the planes of their differences."""
    data = zlib.decompress(data)
    return np.cumsum(unplaned(data, len(data) // 8), dtype=np.uint64)


def pairs_in(code: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: per token the one before it, per token its pair, and the first
    place of each different pair. A slice's last token is an end, and so is the
    context of its first."""
    before = np.r_[code[-1:], code[:-1]]
    pair, one = distinct(before * words + code)
    return before, pair, one


SLICES = "task int, seq long, part int, ids array<string>, held binary, role binary, n binary, size int, code binary, words binary, a binary, h binary"
NAMES = [c.split()[0] for c in SLICES.split(", ")]


def slices(docs: DataFrame) -> DataFrame:
    """Texts as codes of words, a row for each slice of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, task, seq = WordHash(), TaskContext.get().partitionId(), 0
        some, size = [], 0

        def whole() -> pd.DataFrame:
            code, one = distinct(word := np.concatenate([x[-1] for x in some]))
            often = np.argsort(-np.bincount(code), kind="stable")  # small codes for frequent words
            one, to = one[often], np.empty_like(often)
            to[often] = np.arange(len(often))
            code = to[code]
            ids = [i for x in some for i in x[0]]
            held, role = (np.concatenate([x[k] for x in some]).tobytes() for k in (1, 2))
            n = small(np.concatenate([x[3] for x in some]))
            row = (task, seq, -1, ids, held, role, n, len(code), small(code), word[one].tobytes(), None, None)
            return pd.DataFrame([row], columns=NAMES)

        for b in batches:
            ids, held, role = b["doc_id"].tolist(), b["held_out"].to_numpy(np.uint8), b["role"].to_numpy(np.uint8)
            for lo, hi, doc, word in tokens(b["text"].tolist(), hasher):
                some.append((ids[lo:hi], held[lo:hi], role[lo:hi], np.bincount(doc, minlength=hi - lo), word))
                size += len(word)
                if size >= SLICE:
                    yield whole()
                    seq, some, size = seq + 1, [], 0
        if some:
            yield whole()

    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "held_out", "role")
    return saved(own.mapInPandas(run, SLICES), "lm-slices", TEXTS // 4)


def asked(words: np.ndarray, code: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words, then pairs of a slice: first part of their kind, keys in order, per
    token which of the keys, as they were, it is, their order, and where the parts begin."""
    before, pair, one = pairs_in(code, len(words))
    joint = mix64(words[before[one]] * np.uint64(0x9E3779B97F4A7C15) + mix64(words[code[one]]))
    for first, keys, which in ((0, words, code), (parts, joint, pair)):
        order = np.argsort(keys, kind="stable")
        yield first, keys[order], which, order, np.searchsorted(part_of(keys[order], parts), np.arange(parts + 1))


def own_counts(r, which: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a slice's keys in its counted texts, and in its deleted ones."""
    of = np.repeat(np.frombuffer(r.role, np.uint8), wide(r.n, len(r.ids)))
    return tuple(np.bincount(which[of == k], minlength=keys) for k in (1, 2))


def asks(found: DataFrame, parts: int) -> DataFrame:
    """Keys of each slice by hash range, with their counts in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                rows = []
                for first, keys, which, order, cut in asked(np.frombuffer(r.words, np.uint64), wide(r.code, r.size), parts):
                    a, h = (x[order] for x in own_counts(r, which, len(keys)))
                    for p in np.flatnonzero(np.diff(cut)):
                        s = slice(cut[p], cut[p + 1])
                        rows.append((r.task, r.seq, first + p, zlib.compress(planes(np.diff(keys[s], prepend=np.uint64(0))), 1), small(a[s]), small(h[s])))
                yield pd.DataFrame(rows, columns=["task", "seq", "part", "words", "a", "h"])

    return found.mapInPandas(run, "task int, seq long, part int, words binary, a binary, h binary")


def answers(wanted: DataFrame, parts: int) -> DataFrame:
    """What other slices have of each slice's keys, in the order asked; and rows of
    task -1 with the totals (n, v, na, va) of a range of words."""

    def whole(rows: list) -> Iterator[pd.DataFrame]:
        some, known, size = [], [], 0
        for r in rows:
            keys = hashes(r.words)
            some.append((keys, wide(r.a, len(keys)), wide(r.h, len(keys))))
            size += len(keys)
            if size > FLUSH + 2 * (len(known[0][0]) if known else 0):
                known, some, size = [merge(known + some)], [], 0
        keys, a, h = merge(known + some)
        on = a + h > 0
        if rows[0].part < parts:
            sums = [(a + h).sum(), on.sum(), a.sum(), (a > 0).sum()]
            yield pd.DataFrame([(-1, rows[0].part, rows[0].part, np.array(sums, np.int64).tobytes(), b"")], columns=["task", "seq", "part", "a", "h"])
        for k in range(0, len(rows), AT_ONCE):
            out = []
            for r in rows[k : k + AT_ONCE]:
                at = np.searchsorted(keys, hashes(r.words))
                out.append((r.task, r.seq, r.part, small(a[at] - wide(r.a, len(at))), small(h[at] - wide(r.h, len(at)))))
            yield pd.DataFrame(out, columns=["task", "seq", "part", "a", "h"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list = []
        for b in batches:
            for r in b.itertuples(index=False):
                if rows and rows[0].part != r.part:
                    yield from whole(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield from whole(rows)

    dealt = wanted.repartition(2 * parts, "part").sortWithinPartitions("part")
    return dealt.mapInPandas(run, "task int, seq long, part int, a binary, h binary")


def joined(found: DataFrame, got: DataFrame, parts: int) -> DataFrame:
    """Slices with the counts of their words (words) and pairs (a); h holds the
    deleted tokens as cells of EM: (cell, count). The totals come along."""

    def whole(r, rest: list) -> pd.DataFrame:
        words, code = np.frombuffer(r.words, np.uint64), wide(r.code, r.size)
        counts = []
        for first, keys, which, order, cut in asked(words, code, parts):
            mine = [x for x in rest if first <= x.part < first + parts]
            a, h = own_counts(r, which, len(keys))
            a[order] += np.concatenate([wide(x.a, cut[x.part - first + 1] - cut[x.part - first]) for x in mine])
            h[order] += np.concatenate([wide(x.h, cut[x.part - first + 1] - cut[x.part - first]) for x in mine])
            counts.append((a, h))
        (wa, wh), (pa, ph) = counts
        before, pair, _ = pairs_in(code, len(words))
        on = np.repeat(np.frombuffer(r.role, np.uint8), wide(r.n, len(r.ids))) == 2
        cell, n = np.unique(cells(wa[before[on]], wa[code[on]], pa[pair[on]]), return_counts=True)
        row = (r.task, r.seq, -1, list(r.ids), r.held, r.role, r.n, r.size, r.code, small(wa + wh), small(pa + ph), np.stack([cell, n]).astype(np.int64).tobytes())
        return pd.DataFrame([row], columns=NAMES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rest = None, []
        for b in batches:
            for r in b.itertuples(index=False):
                if r.task < 0:
                    yield pd.DataFrame([(-1, r.seq, r.part, *[None] * 4, 0, None, None, r.a, None)], columns=NAMES)
                elif r.part < 0:  # a slice comes before its answers
                    if at is not None:
                        yield whole(at, rest)
                    at, rest = r, []
                else:
                    rest.append(r)
        if at is not None:
            yield whole(at, rest)

    own = got.withColumn("size", F.lit(0))
    every = found.unionByName(own, allowMissingColumns=True).select(*NAMES)
    dealt = every.repartition(parts, "task", "seq").sortWithinPartitions("task", "seq", "part")
    return saved(dealt.mapInPandas(run, SLICES), "lm-known", AT_ONCE)


def expectation_maximisation(bucket, weight, shares, steps: int = 60) -> np.ndarray:
    """Mixture weights (BUCKETS x 3) for counts ``weight`` of events whose
    estimates are ``shares`` (events x 3), each in a bucket."""
    mix = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(steps):
        p = mix[bucket] * shares
        p *= (weight / np.maximum(p.sum(1), 1e-300))[:, None]
        new = np.stack([np.bincount(bucket, p[:, k], BUCKETS) for k in range(3)], 1) + 0.1  # a weak prior
        new /= new.sum(1, keepdims=True)
        if np.abs(new - mix).max() < 1e-6:
            break
        mix = new
    return mix


def learn(known: DataFrame) -> dict:
    sums = known.where("task < 0").select("a").mapInPandas(
        lambda batches: (pd.DataFrame([np.frombuffer(x, np.int64) for x in b["a"]], columns=["n", "v", "na", "va"]) for b in batches), "n long, v long, na long, va long"
    )
    r = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "na", "va"))).first()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b["h"]:
                cell, n = np.frombuffer(x, np.int64).reshape(2, -1)
                yield pd.DataFrame({"cell": cell, "n": n})

    # cells are bins, so they don't grow with the corpus
    rows = known.where("task >= 0").select("h").mapInPandas(each, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cell, weight = np.array([x["cell"] for x in rows], np.int64), np.array([x["n"] for x in rows], float)
    bucket, word, share = cell // BINS**2, cell // BINS % BINS, cell % BINS
    two = np.where(share > 0, 2.0 ** ((1 - share) / 8), 0.0)
    shares = np.stack([np.full(len(cell), 1 / (r["va"] + 1)), bin_count(word) / max(r["na"], 1), two], 1)
    return {"mix": expectation_maximisation(bucket, weight, shares), "n": r["n"], "v": r["v"]}


def log_shares(model: dict, bucket: np.ndarray, count: np.ndarray, two: np.ndarray) -> np.ndarray:
    mix = model["mix"][bucket]
    p = mix[:, 0] / (model["v"] + 1) + mix[:, 1] * (count / max(model["n"], 1)) + mix[:, 2] * two
    return np.log10(p) if model["n"] else np.zeros(len(p))


def log_base(model: dict, count: np.ndarray) -> np.ndarray:
    return np.log10((count + 1) / (model["n"] + model["v"] + 1))


def score(docs: DataFrame, part_bytes: float = PART_BYTES) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = parts_for(docs, part_bytes)
    found = slices(roles(docs))
    got = answers(asks(found, parts), parts)
    known = joined(found, got, parts)
    model = learn(known)
    known = known.where("task >= 0")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                code, n = wide(r.code, r.size), wide(r.n, len(r.ids))
                size = int(code.max()) + 1
                before, pair, one = pairs_in(code, size)
                word, joint = wide(r.words, size), wide(r.a, len(one))
                context, last = word[before[one]], word[code[one]]
                share = log_shares(model, bucket_of(context), last, joint / np.maximum(context, 1))
                doc = np.repeat(np.arange(len(n)), n)
                yield pd.DataFrame(
                    {
                        "doc_id": list(r.ids),
                        "held_out": np.frombuffer(r.held, np.uint8) > 0,
                        "n_tokens": n,
                        "n_known": np.bincount(doc, word[code] > 0, len(n)).astype(np.int64),
                        "base_score": np.bincount(doc, log_base(model, word)[code], len(n)),
                        "score": np.bincount(doc, share[pair], len(n)),
                    }
                )

    out = saved(known.mapInPandas(run, "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"), "lm-scores", AT_ONCE)
    return out.select(
        F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(model["n"]).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op8_language_model(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
