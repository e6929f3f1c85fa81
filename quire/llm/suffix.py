"""Repeated passages: byte strings of at least ``L`` bytes that occur elsewhere.

A document's anchors are the positions whose ``gram`` bytes have the smallest
hash among all gram positions of some L-byte window, so any two equal L-byte
strings, wherever they are, hold the same gram at the same place, and an L-byte
string is repeated if and only if two anchors with the same gram agree on some
L bytes around it. Suffixes that start at anchors are all that has to be put
in order.

Anchors with a gram of their own are done. The others are sorted into classes
with the same context (all bytes any window around the anchor can hold), by
hash; in a class with several members every member matches another one in
full. What is left are different contexts around the same gram. These are
compared group by group: the suffixes from the anchor in suffix order with
the array of longest common prefixes, the same for the bytes before the
anchor. For every split of L into bytes before and after, a run of this order
whose common prefixes are long enough holds equal strings; the previous and
next entries in the run give the matches, those with a smaller position the
earlier ones, and a longest previous factor of L or more marks a later copy.
All windows around an anchor contain it, so what is marked there is one
interval: as far left and right as matches reach. Small groups are compared
directly, all groups of a batch at once. A group of more than ``GROUP``
contexts is not gathered: its windows are hashed and counted as rows.

``all`` marks every occurrence; ``later`` keeps the first, in the order of
document id, text hash and position.

Defined results: null text is empty; texts under L bytes have no matches within
them; rows with equal id and text are one document for ``later`` (all are kept
or cut alike) and copies of each other for ``all``; a null id counts as -1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import TEXTS, last_stays, parts_for, saved
from quire.llm.neardup import mix64
from quire.llm.spans import _BASE, _powers

MIN_BYTES = 400
PIPELINE_BYTES = 240
GROUP = 20_000
FEW = 24
BATCH_BYTES = 500_000
PIECES = 1000
PIECE_ROWS = 1000
ROWS = 4000


def gram_of(least: int) -> int:
    """Long grams have more anchors, short ones more contexts to compare."""
    return max(1, least * 3 // 5)


def sliding(a: np.ndarray, w: int, op, fill) -> np.ndarray:
    """op over a[i : i + w] for every i, by running results of blocks of w."""
    n = len(a)
    blocks = np.full(((n + 2 * w - 1) // w + 1) * w, fill, a.dtype)
    blocks[:n] = a
    grid = blocks.reshape(-1, w)
    ahead = op.accumulate(grid, axis=1).ravel()
    back = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[w - 1 : n + w - 1])


class Spans:
    """Hashes of spans of a byte array."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def over(self, data: np.ndarray) -> None:
        n = len(data) + 1
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        self.run = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: n - 1], out=self.run[1:])

    def of(self, start, end) -> np.ndarray:
        return mix64((self.run[end] - self.run[start]) * self.down[start])


def anchors(data: np.ndarray, ends: np.ndarray, least: int, spans: Spans) -> tuple[np.ndarray, ...]:
    """Anchors of texts laid end to end: position, its text's number, hash of
    the gram, hash of the context, bytes of context before and after."""
    gram = gram_of(least)
    w, n = least - gram + 1, len(data)
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none, none
    spans.over(data)
    begins = np.r_[0, ends[:-1]]
    raw = (spans.run[gram:] - spans.run[:-gram]) * spans.down[: n - gram + 1]
    h = raw ^ (raw >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    low = sliding(h, w, np.minimum, np.uint32(2**32 - 1))
    for a, b in zip(np.maximum(begins, ends - least + 1).tolist(), ends.tolist()):
        low[a:b] = 0  # windows must not leave their text
    # the highest of the minima of the windows around a position
    back = np.zeros(len(low) + w - 1, np.uint32)
    back[w - 1 :] = low
    high = sliding(back, w, np.maximum, np.uint32(0))[: len(h)]
    pos = np.flatnonzero(high == h)
    doc = np.searchsorted(ends, pos, "right")
    left = np.minimum(pos - begins[doc], least - gram)
    right = np.minimum(ends[doc] - pos, least)
    context = mix64(spans.of(pos - left, pos + right) + left.astype(np.uint64) * np.uint64(1 << 32) + right.astype(np.uint64))
    return pos, doc, mix64(raw[pos]), context, left, right


def batches_of(texts: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    lo = 0
    while lo < len(texts):
        hi, size, some = lo, 0, []
        while hi < len(texts) and (hi == lo or size < BATCH_BYTES):
            t = texts[hi] if isinstance(texts[hi], str) else ""
            some.append(t.encode("utf-8", "surrogatepass"))
            size += len(some[-1])
            hi += 1
        yield lo, hi, np.frombuffer(b"".join(some), np.uint8), np.cumsum([len(b) for b in some])
        lo = hi


def anchor_rows(docs: DataFrame, least: int) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spans = Spans()
        for b in parts:
            ids, keys = b["doc"].to_numpy(), b["k1"].to_numpy()
            for lo, hi, data, ends in batches_of(b["text"].tolist()):
                pos, doc, gram, context, left, right = anchors(data, ends, least, spans)
                begins = np.r_[0, ends[:-1]]
                yield pd.DataFrame(
                    {
                        "gram": gram.view(np.int64),
                        "context": context.view(np.int64),
                        "doc": ids[lo:hi][doc],
                        "k1": keys[lo:hi][doc],
                        "pos": pos - begins[doc],
                        "l": left.astype(np.int32),
                        "r": right.astype(np.int32),
                    }
                )

    return docs.mapInPandas(run, "gram long, context long, doc long, k1 long, pos long, l int, r int")


def contexts(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """The padded bytes around the first member of each class in ``wanted``."""
    before, width = least - gram_of(least), 2 * least - gram_of(least)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["gram", "context", "doc", "k1", "pos", "l", "r", "n", "bytes"]
        rows: list[tuple] = []
        for b in parts:
            for doc, k1, text, places in zip(b["doc"], b["k1"], b["text"], b["places"]):
                data = b"\0" * before + (text or "").encode("utf-8", "surrogatepass") + b"\0" * least
                for p in places:
                    rows.append((p["gram"], p["context"], doc, k1, p["pos"], p["l"], p["r"], p["n"], data[p["pos"] : p["pos"] + width]))
                    if len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
        yield pd.DataFrame(rows, columns=names)

    by_doc = wanted.groupBy("doc", "k1").agg(F.collect_list(F.struct("gram", "context", "pos", "l", "r", "n")).alias("places"))
    rows = docs.join(by_doc, ["doc", "k1"]).dropDuplicates(["doc", "k1"])
    return rows.mapInPandas(run, "gram long, context long, doc long, k1 long, pos long, l int, r int, n long, bytes binary")


def compare_few(grid, l, r, rank, group, least: int, later: bool) -> tuple[np.ndarray, np.ndarray]:
    """How far matches reach, comparing all pairs of rows next to each other
    in small groups (rows of a group are adjacent)."""
    before = grid.shape[1] - least
    ml, mr = np.zeros(len(grid), np.int64), np.zeros(len(grid), np.int64)
    for j in range(1, FEW):
        a = np.flatnonzero(group[:-j] == group[j:]) if len(group) > j else np.zeros(0, np.int64)
        if not len(a):
            break
        for part in np.array_split(a, len(a) // 20_000 + 1):
            b = part + j
            other = grid[part] != grid[b]
            x, y = other[:, before - 1 :: -1] if before else other[:, :0], other[:, before:]
            lc = np.where(x.any(1), x.argmax(1), before) if before else np.zeros(len(part), np.int64)
            rc = np.where(y.any(1), y.argmax(1), least)
            lc = np.minimum(lc, np.minimum(l[part], l[b]))
            rc = np.minimum(rc, np.minimum(r[part], r[b]))
            hit = lc + rc >= least
            for side, mine in ((part, rank[part] > rank[b]), (b, rank[b] > rank[part])):
                on = hit & mine if later else hit
                np.maximum.at(ml, side[on], lc[on])
                np.maximum.at(mr, side[on], rc[on])
    return ml, mr


def compare_many(grid, l, r, rank, least: int, later: bool) -> tuple[np.ndarray, np.ndarray]:
    """The same for one larger group, by suffix order and common prefixes."""
    n, before = len(grid), grid.shape[1] - least

    def order(part: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = np.ascontiguousarray(part)
        by = np.lexsort((size, part.view(f"S{part.shape[1]}").ravel()))
        other = part[by][1:] != part[by][:-1]
        common = np.where(other.any(1), other.argmax(1), part.shape[1])
        return by, common

    by_l, lcp_l = order(grid[:, before - 1 :: -1], l)
    by_r, lcp_r = order(grid[:, before:], r)
    ml, mr = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left, right = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(before, -1, -1):
        left[by_l] = np.r_[0, np.cumsum(lcp_l < d)]
        right[by_r] = np.r_[0, np.cumsum(lcp_r < least - d)]
        on = np.flatnonzero((l >= d) & (r >= least - d))
        key = left[on] * n + right[on]
        run = np.lexsort((rank[on], key))
        same = key[run][1:] == key[run][:-1]
        hit = np.r_[False, same] if later else np.r_[False, same] | np.r_[same, False]
        found = on[run[hit[: len(run)]]] if len(run) else on
        ml[found] = np.maximum(ml[found], d)
        mr[found] = least - d  # d only falls
    return ml, mr


def reach(rows: DataFrame, least: int, later: bool, parts: int) -> DataFrame:
    """(gram, context, ml, mr): what matches mark around each class's first member."""

    def solve(b: pd.DataFrame) -> pd.DataFrame:
        grid = np.frombuffer(b"".join(b["bytes"]), np.uint8).reshape(len(b), -1)
        l, r, group = b["l"].to_numpy(np.int64), b["r"].to_numpy(np.int64), b["gram"].to_numpy()
        rank = np.empty(len(b), np.int64)
        rank[np.lexsort((b["pos"], b["k1"], b["doc"]))] = np.arange(len(b))
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[first, len(b)])
        small = np.flatnonzero(np.repeat(size <= FEW, size))
        ml, mr = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
        ml[small], mr[small] = compare_few(grid[small], l[small], r[small], rank[small], group[small], least, later)
        for a, k in zip(first[size > FEW], size[size > FEW]):
            s = slice(a, a + k)
            ml[s], mr[s] = compare_many(grid[s], l[s], r[s], rank[s], least, later)
        return pd.DataFrame({"gram": group, "context": b["context"], "ml": ml, "mr": mr})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            last = b["gram"].to_numpy() == b["gram"].iloc[-1]
            if last.all() and rest and rest[-1]["gram"].iloc[-1] == b["gram"].iloc[-1]:
                rest.append(b)
                continue
            done = pd.concat([*rest, b[~last]])
            rest = [b[last]]
            if len(done):
                # a group can span the join of two batches
                yield solve(done.reset_index(drop=True))
        if rest:
            yield solve(pd.concat(rest).reset_index(drop=True))

    dealt = rows.repartition(parts, "gram").sortWithinPartitions("gram")
    return dealt.mapInPandas(run, "gram long, context long, ml long, mr long")


def reach_by_rows(rows: DataFrame, least: int, later: bool) -> DataFrame:
    """The same for groups of any size: every window of a context is a row."""
    before = least - gram_of(least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                ds = [d for d in range(before + 1) if d <= row.l and least - d <= row.r]
                keys = [hashlib.blake2b(row.bytes[before - d : before - d + least], digest_size=16).digest() for d in ds]
                yield pd.DataFrame({"gram": row.gram, "context": row.context, "doc": row.doc, "k1": row.k1, "pos": row.pos, "d": ds, "key": keys})

    windows = saved(rows.mapInPandas(run, "gram long, context long, doc long, k1 long, pos long, d int, key binary"), "suffix-windows")
    own = F.struct("doc", "k1", "pos")
    runs = windows.groupBy("gram", "d", "key").agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("head")).where("n > 1")
    hits = windows.join(runs, ["gram", "d", "key"])
    if later:
        hits = hits.where(own > F.col("head"))
    return hits.groupBy("gram", "context").agg(F.max("d").cast("long").alias("ml"), (least - F.min("d")).cast("long").alias("mr"))


@last_stays
def repeated_kinds(marks: DataFrame) -> DataFrame:
    """Classes of anchors of equal gram and context, of grams that occur more than once."""
    kinds = marks.groupBy("gram", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "k1", "pos", "l", "r")).alias("head")
    )
    kinds = saved(kinds, "suffix-classes")
    grams = kinds.groupBy("gram").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).where("total > 1")
    return saved(kinds.join(grams.select("gram", "kinds"), "gram"), "suffix-repeated")


def with_kinds(marks: DataFrame, kinds: DataFrame, found: DataFrame) -> DataFrame:
    """Every anchor with its class and how far that one's matches reach. A class
    of more than a ``PIECES``-th of all anchors is dealt out in pieces, so one
    passage copied into very many documents is not one task's work; there are at
    most ``PIECES`` such classes."""
    share = max(PIECE_ROWS, marks.count() // PIECES)
    pieces = F.ceil(F.col("n") / share).cast("int")
    often = F.broadcast(kinds.where(F.col("n") > share).select("gram", "context", pieces.alias("pieces")))
    piece = F.pmod(F.xxhash64("doc", "k1", "pos"), F.coalesce("pieces", F.lit(1))).cast("int")
    dealt = marks.join(often, ["gram", "context"], "left").withColumn("piece", piece).drop("pieces")
    kinds = kinds.join(found, ["gram", "context"], "left").withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    kinds = kinds.select("gram", "context", "piece", "n", F.col("head.doc").alias("hd"), F.col("head.k1").alias("hk"), F.col("head.pos").alias("hp"), "ml", "mr")
    return dealt.join(kinds, ["gram", "context", "piece"]).drop("piece")


def repeated_spans(docs: DataFrame, least: int, later: bool, group: int = GROUP) -> DataFrame:
    """(doc, k1, spans) with the marked intervals of ``docs`` (doc, k1, text);
    intervals may overlap."""
    marks = saved(anchor_rows(docs, least), "suffix-anchors", TEXTS)
    kinds = repeated_kinds(marks)
    wanted = kinds.where("kinds > 1").select("gram", "context", "head.*", "n", "kinds")
    several = contexts(docs, wanted.where(F.col("kinds") <= group), least)
    found = reach(several, least, later, parts_for(docs, 8e6))
    large = wanted.where(F.col("kinds") > group)
    if large.limit(1).count():
        found = found.unionByName(reach_by_rows(contexts(docs, large, least), least, later))
    occurs = with_kinds(marks, kinds, saved(found, "suffix-reach", TEXTS))
    first = (F.col("doc") == F.col("hd")) & (F.col("k1") == F.col("hk")) & (F.col("pos") == F.col("hp"))
    alone = first if later else F.col("n") == 1
    occurs = occurs.withColumns(
        {
            "lo": F.col("pos") - F.when(alone, F.coalesce("ml", F.lit(0))).otherwise(F.col("l")),
            "hi": F.col("pos") + F.when(alone, F.coalesce("mr", F.lit(0))).otherwise(F.col("r")),
        }
    )
    occurs = occurs.where("hi > lo")
    return occurs.groupBy("doc", "k1").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def covered(spans, size: int) -> list[tuple[int, int]]:
    """Union of intervals, as maximal runs."""
    if spans is None or not len(spans):
        return []
    out: list[list[int]] = []
    for a, b in sorted((s["lo"], s["hi"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, size)) for a, b in out]


def cut(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in runs:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def with_keys(docs: DataFrame, doc: str, k1: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), k1: F.xxhash64(text)})


def suffix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: later copies of passages of ``PIPELINE_BYTES`` or more
    are cut out of the texts; all documents stay. A character cut in two goes,
    and n_chars, where there is one, follows the text."""
    spans = repeated_spans(with_keys(docs.select("doc_id", "text"), "doc", "k1").select("doc", "k1", "text"), PIPELINE_BYTES, later=True)
    spans = spans.select(F.col("doc").alias("__doc"), F.col("k1").alias("__k1"), F.col("spans").alias("__spans"))

    @F.pandas_udf("string")
    def rest(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans):
            if s is not None and len(s):
                data = t.encode("utf-8", "surrogatepass")
                t = cut(data, covered(s, len(data))).decode("utf-8", "ignore")
            out.append(t)
        return pd.Series(out, dtype=object)

    rows = with_keys(docs, "__doc", "__k1").join(spans, ["__doc", "__k1"], "left")
    rows = rows.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(rest("text", "__spans")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return rows.select(*docs.columns)


def op7_repeated_passages(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = with_keys(docs, "doc", "k1")
    spans = repeated_spans(keyed.select("doc", "k1", "text"), MIN_BYTES, later=False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text, s in zip(b["doc_id"], b["text"], b["spans"]):
                data = (text or "").encode("utf-8", "surrogatepass")
                runs = covered(s, len(data))
                kept = cut(data, runs)
                rows.append((doc, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], dtype=object)

    rows = keyed.join(spans, ["doc", "k1"], "left").select("doc_id", "text", "spans")
    found = rows.mapInPandas(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return saved(found, "suffix-result", TEXTS)
