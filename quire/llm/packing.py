"""Packing documents into training sequences by minimum bin slack.

A document becomes its token ids and an end id. Whole windows are cut off it
first, so at most one piece shorter than a window is left. How many pieces of
each length there are (at most ``window`` numbers, whatever the corpus) is all
the driver needs: starting with the longest piece left, a subset-sum dynamic
programme on a bitset finds the multiset of remaining lengths that fills the
window closest to its capacity, bits of the stages are traced back to counts,
and the pattern is used as many times as the counts allow. Each use empties
some length or leaves less than a pattern of it, so there are few patterns.

A piece then finds its place alone: its rank among the pieces of its length
(running number within the task that cut it, plus the counts of the tasks
before) tells which use of which pattern it belongs to.

Defined results: null and empty texts are the end id alone; repeated rows are
packed each; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.bpe import Encoder
from quire.llm.common import TEXTS, saved

WINDOW = 2048
END_ID = 1


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Counts of the lengths whose sum comes closest to ``room`` from below."""
    reach, stages = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, lot = min(counts[length], room // length), 1
        while left > 0:
            take = min(lot, left)
            stages.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            lot *= 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(stages):
        if not before >> best & 1:
            used[length] = used.get(length, 0) + take
            best -= length * take
    return used


def patterns(counts: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """(uses, {length: pieces a use}) that place every piece."""
    left = {k: int(v) for k, v in counts.items() if v}
    out = []
    while left:
        longest = max(left)
        rest = {k: v - (k == longest) for k, v in left.items() if v - (k == longest) > 0}
        used = fill(rest, window - longest) if window > longest else {}
        used[longest] = used.get(longest, 0) + 1
        uses = min(left[k] // v for k, v in used.items())
        out.append((uses, used))
        for k, v in used.items():
            left[k] -= uses * v
            if not left[k]:
                del left[k]
    return out


def places(plan: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, pieces a use, first sequence, first offset)."""
    rows: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for uses, used in plan:
        offset = 0
        for length in sorted(used, reverse=True):
            k = used[length]
            rows.setdefault(length, []).append((ranks.get(length, 0), k, sequence, offset))
            ranks[length] = ranks.get(length, 0) + uses * k
            offset += length * k
        sequence += uses
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def cut(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of (doc_id, text): where they start, how long they are, and
    their running number (slot) among those of their length in one task (chunk)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(tokenizer)
        chunk = TaskContext.get().partitionId()
        slots = np.zeros(window + 1, np.int64)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch["doc_id"], encoder.encode([t if isinstance(t, str) else "" for t in batch["text"]])):
                ids = np.append(ids, np.uint32(end_id))
                for a in range(0, len(ids), window):
                    part = ids[a : a + window]
                    row = (doc, a, len(part), zlib.crc32(part.astype("<u4").tobytes()), len(ids), chunk, int(slots[len(part)]))
                    rows.append((*row, part.astype(np.int32)) if keep_ids else row)
                    slots[len(part)] += 1
            out = pd.DataFrame(rows, columns=names, dtype=object)
            yield out.astype({c: np.int64 for c in names[1:7]})

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "chunk", "slot"] + ["ids"] * keep_ids
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, chunk long, slot long"
    return docs.select("doc_id", "text").mapInPandas(run, schema + ", ids array<int>" * keep_ids)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces with the sequence they go to and their offset in it."""
    pieces = saved(cut(docs, tokenizer, window, end_id, keep_ids), "pack-pieces", TEXTS)
    counts = saved(pieces.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # window rows at most
    shared = docs.sparkSession.sparkContext.broadcast(places(patterns(total, window)))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), np.int64)
        of, ranks = length.to_numpy(), rank.to_numpy()
        for k in np.unique(of):
            at = np.flatnonzero(of == k)
            rows = shared.value[int(k)]
            row = rows[np.searchsorted(rows[:, 0], ranks[at], "right") - 1]
            use, nth = np.divmod(ranks[at] - row[:, 0], row[:, 1])
            out[at, 0], out[at, 1] = row[:, 2] + use, row[:, 3] + nth * k
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = pieces.join(base, ["length", "chunk"]).withColumn("at", place("length", F.col("base") + F.col("slot")))
    more = ["ids"] if keep_ids else []
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset", *more
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces of the packed documents."""
    return pack(docs, default_tokenizer())


def op5_pack_sequences(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
