"""Postings on their way from documents to ranges of (token, doi).

A posting as a row of a shuffle is some 70 bytes, 15 when compressed, several times
the text it came from. So the tasks that read documents sort the postings of a few
million tokens, cut them at the bounds of the ranges and send a packed row a range:
distinct tokens with their numbers, the distinct DOIs, and per posting the DOI's place,
field and position. The tasks of the ranges unpack row by row and Spark sorts.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD = 2_000_000  # tokens that a task packs at a time
ROWS = 50_000  # postings in a batch that is unpacked
SAMPLE, MOST = 100, 300_000  # sampled tokens a range, and in all, for the bounds
DOCS = 2000  # documents in the sample, at least
SEED = 7
POSTINGS = "token string, doi string, field tinyint, pos int"


def bounds(rows: DataFrame, toks: Column, n: int, n_docs: int, n_tokens: int) -> list[tuple[str, str]]:
    """Up to ``n`` - 1 places that cut (token, doi) into even ranges, from a sample as
    in Spark's own range partitioning."""
    if n < 2 or not n_tokens:
        return []
    wanted = min(SAMPLE * n, MOST)
    docs = min(1.0, max(DOCS, wanted / 10) * 1.2 / n_docs)
    words = min(1.0, wanted * 1.2 / (docs * n_tokens))
    some = rows.sample(docs, SEED) if docs < 1 else rows
    some = some.select(F.coalesce("doi", F.lit("")).alias("doi"), F.explode(F.flatten(toks)).alias("token"))
    found = (some.sample(words, SEED) if words < 1 else some).select("token", "doi").toArrow()
    found = found.sort_by([("token", "ascending"), ("doi", "ascending")])
    at = np.unique(np.arange(1, n) * found.num_rows // n)
    found = found.take(pa.array(at[at < found.num_rows]))
    return sorted(set(zip(found["token"].to_pylist(), found["doi"].to_pylist())))


def _strings(values: pa.Array) -> bytes:
    """Lengths (-1: null) and bytes of an array of strings."""
    lens = pc.fill_null(pc.binary_length(values), -1).to_numpy(zero_copy_only=False).astype("<i4")
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    text = values.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes() if ends[-1] > ends[0] else b""
    return struct.pack("<ii", len(lens), len(text)) + lens.tobytes() + text


def _read_strings(data: bytes, at: int) -> tuple[pa.Array, int]:
    n, size = struct.unpack_from("<ii", data, at)
    lens = np.frombuffer(data, "<i4", n, at + 8)
    ends = np.concatenate(([0], np.cumsum(np.maximum(lens, 0)))).astype(np.int32)
    at += 8 + 4 * n
    known = np.packbits(lens >= 0, bitorder="little").tobytes()
    buffers = [pa.py_buffer(known), pa.py_buffer(ends.tobytes()), pa.py_buffer(data[at : at + size])]
    return pa.StringArray.from_buffers(n, buffers[1], buffers[2], buffers[0]), at + size


def _numbers(values: np.ndarray) -> bytes:
    """By planes of bytes, which compress better than whole numbers."""
    return np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _read_numbers(data: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T).view("<i4").ravel()


def _packed(dois: pa.Array, toks: pa.Array, cuts: list[tuple[str, str]]) -> pa.RecordBatch:
    """A row for each range that the documents have postings in."""
    n_fields = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False)
    fields = toks.flatten()
    n_words = pc.fill_null(pc.list_value_length(fields), 0).to_numpy(zero_copy_only=False)
    words = fields.flatten().dictionary_encode()
    field_of = np.arange(len(n_words)) - np.repeat(np.cumsum(n_fields) - n_fields, n_fields)
    doc = np.repeat(np.repeat(np.arange(len(dois)), n_fields), n_words)
    field = np.repeat(field_of, n_words)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(n_words) - n_words, n_words)

    by_token = pc.array_sort_indices(words.dictionary)
    distinct = words.dictionary.take(by_token).cast(pa.string())
    rank = np.empty(len(distinct), np.int64)
    rank[by_token.to_numpy()] = np.arange(len(distinct))
    by_doi = pc.array_sort_indices(dois, null_placement="at_start")
    dois = dois.take(by_doi).cast(pa.string())
    place = np.empty(len(dois), np.int64)
    place[by_doi.to_numpy()] = np.arange(len(dois))

    key = rank[words.indices.to_numpy()] * len(dois) + place[doc]
    order = np.argsort(key, kind="stable")
    key, field, pos = key[order], field[order], pos[order]
    tokens, ids = distinct.to_pylist(), [d or "" for d in dois.to_pylist()]
    limits = []
    for token, doi in cuts:
        r = bisect_left(tokens, token)
        here = r < len(tokens) and tokens[r] == token
        limits.append(r * len(ids) + (bisect_left(ids, doi) if here else 0))
    ends = [0, *np.searchsorted(key, np.array(limits, np.int64)), len(key)]
    parts, rows, codec = [], [], pa.Codec("zstd")
    for part, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        if a == b:
            continue
        token, doc = np.divmod(key[a:b], len(dois))
        own, first, count = np.unique(token, return_index=True, return_counts=True)
        docs, at = np.unique(doc, return_inverse=True)
        step = np.diff(at, prepend=0)
        step[first] = at[first]
        data = _strings(distinct.take(pa.array(own))) + _strings(dois.take(pa.array(docs)))
        data += struct.pack("<i", b - a) + _numbers(count) + b"".join(_numbers(x) for x in (step, field[a:b], pos[a:b]))
        parts.append(part)
        rows.append(struct.pack("<q", len(data)) + codec.compress(data, asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(rows, pa.binary())], ["part", "packed"])


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """DOIs and tokens of so many documents that they have ``most`` tokens, or one."""
    held, n = [], 0
    for batch in batches:
        fields = pc.fill_null(pc.list_value_length(batch["toks"]), 0).to_numpy(zero_copy_only=False)
        words = pc.fill_null(pc.list_value_length(batch["toks"].flatten()), 0).to_numpy(zero_copy_only=False)
        upto = np.concatenate(([0], np.cumsum(words)))[np.concatenate(([0], np.cumsum(fields)))]
        start = 0
        while start < len(fields):
            end = max(start + 1, int(np.searchsorted(upto, upto[start] + most - n, side="right")) - 1)
            held.append(batch.slice(start, end - start))
            n += int(upto[end] - upto[start])
            if n >= most or end < len(fields):
                yield tuple(pa.concat_arrays([b[c] for b in held]) for c in ("doi", "toks"))
                held, n = [], 0
            start = end
    if held:
        yield tuple(pa.concat_arrays([b[c] for b in held]) for c in ("doi", "toks"))


def pack(cuts: list[tuple[str, str]], held: int):
    def run(batches):
        for dois, toks in _slices(batches, held):
            yield _packed(dois, toks, cuts)

    return run


def unpack(batches):
    for batch in batches:
        for row in batch["packed"].to_pylist():
            (size,) = struct.unpack_from("<q", row)
            data = pa.Codec("zstd").decompress(row[8:], size, asbytes=True)
            tokens, at = _read_strings(data, 0)
            dois, at = _read_strings(data, at)
            (n,) = struct.unpack_from("<i", data, at)
            at += 4
            count = _read_numbers(data, len(tokens), at)
            at += 4 * len(tokens)
            step, field, pos = (_read_numbers(data, n, at + 4 * n * i) for i in range(3))
            start = np.cumsum(count) - count
            doc = np.cumsum(step, dtype=np.int64)
            doc -= np.repeat(doc[start] - step[start], count)
            token = np.repeat(np.arange(len(tokens)), count)
            for a in range(0, n, ROWS):
                z = slice(a, a + ROWS)
                columns = [tokens.take(pa.array(token[z])), dois.take(pa.array(doc[z])), pa.array(field[z].astype(np.int8)), pa.array(pos[z])]
                yield pa.RecordBatch.from_arrays(columns, ["token", "doi", "field", "pos"])


def sorted_postings(rows: DataFrame, n: int, n_docs: int, n_tokens: int, toks: Column | None = None) -> DataFrame:
    """The postings of documents in ``n`` ranges of (token, doi), sorted by token, doi,
    field and pos in each. ``toks``: their tokens by field, else the column of that name."""
    toks = F.col("toks") if toks is None else toks
    cuts = bounds(rows, toks, n, n_docs, n_tokens)
    packed = rows.select("doi", toks.alias("toks")).mapInArrow(pack(cuts, HELD), "part int, packed binary")
    dealt = packed.repartitionById(len(cuts) + 1, F.col("part"))
    return dealt.select("packed").mapInArrow(unpack, POSTINGS).sortWithinPartitions("token", "doi", "field", "pos")
