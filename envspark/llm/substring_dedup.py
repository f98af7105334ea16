"""Substring dedup on word windows (operator 10).

Every window of ``width`` consecutive words of one document gets a Rabin-Karp
hash of 96 bits: a rolling polynomial over 64-bit word hashes, and 32 bits of a
second one with another base over the same words mixed anew.  Spark deals the
hashes out by hash bucket; a window whose hash also starts in a document with a smaller
``doc_id`` is marked, marked windows merge into maximal word intervals, and
the words of these intervals are removed.

Plan: one shuffle of (12-byte hash, 2-byte step) per window, one of the marks,
one join of the texts with their intervals.

* Each map batch sends a window only for the smallest doc_id that holds it in
  that batch; all later holders are decided locally.  A passage that a third
  of all documents share so costs one entry per batch, not one per document.
* Hashes are packed into binary columns per (batch, bucket), so no Spark row
  exists per window.
* A task unpacks one bucket at a time.  The number of buckets follows the bytes
  of the texts, so that a bucket holds about ``BUCKET_BYTES`` packed however
  large the corpus is.

Defined results: null text has no words; a null ``doc_id`` is no smaller
document and loses nothing; rows with equal doc_id do not affect each other;
repeated rows each come back; a document shorter than the window is kept;
empty tables give empty results; extra columns of the input are ignored.
Two windows are taken as equal when their 96-bit hashes are: among 10^12
different windows, one false pair is expected in about 10^5 such corpora.
The input should come from storage: map batches follow its row order, which a recomputed task
has to meet again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.llm import common as C

BATCH_TEXT = 4 << 20
BUCKET_BYTES = 256 << 20     # packed windows of one bucket, about
PACKED_PER_BYTE = 3          # packed bytes a byte of text, about (a window a word)
LOCAL = -1

_PACK = "bucket int, ids binary, keys binary, counts binary, steps binary, wide binary, hashes binary, tags binary"
_NAMES = ["bucket", "ids", "keys", "counts", "steps", "wide", "hashes", "tags"]
_SCHEMA = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in _NAMES[1:]]])


def _hash_batch(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, tag, document ordinal, start word in the document) of every window."""
    starts, ends, first = C.words_of(data, offs)
    at = C.inside(first, width)
    hashes, tags = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    if len(at):
        words = C.span_hashes(data, starts, ends)
        hashes = C.window_hashes(words, width)[at]
        tags = (C.window_hashes(C.mix64(words ^ np.uint64(C.OTHER)), width, C.OTHER_BASE) >> np.uint64(32)).astype(np.uint32)[at]
    counts = np.maximum(np.diff(first) - width + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    return hashes, tags, doc, at - first[:-1][doc]


def _grouped(h: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that puts equal windows together, whether each equals the one before it)."""
    order = np.argsort(h, kind="stable")
    sh, st = h[order], tag[order]
    close, same = sh[1:] == sh[:-1], st[1:] == st[:-1]
    if (close & ~same).any():                 # different windows of one 64-bit hash
        order = np.lexsort((tag, h))
        sh, st = h[order], tag[order]
        close, same = sh[1:] == sh[:-1], st[1:] == st[:-1]
    return order, np.concatenate([np.zeros(min(len(h), 1), bool), close & same])


def _pack(bucket: int, ids, keys, doc, pos, hashes=None, tags=None) -> tuple:
    """One row for windows in order of (document, position): ids and keys once
    per document, positions as steps of two bytes (wider ones apart)."""
    lead = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1])
    step = np.diff(pos, prepend=0)
    step[lead] = pos[lead]
    wide = np.flatnonzero(step >= 65535)
    small = step.astype(np.uint16)
    small[wide] = 65535
    return (bucket, ids[doc[lead]].tobytes(), keys[doc[lead]].tobytes(), np.diff(np.append(lead, len(doc))).astype(np.uint32).tobytes(),
            small.tobytes(), step[wide].astype(np.uint32).tobytes(), b"" if hashes is None else hashes.tobytes(), b"" if tags is None else tags.tobytes())


def _unpack(t: pa.Table):
    """ids, keys (per document) and (document ordinal, start) per window."""
    def col(c, dtype):
        return np.concatenate([np.frombuffer(x, dtype) for x in t[c].to_pylist()])
    ids, keys = col("ids", np.int64), col("keys", np.int64)
    counts = col("counts", np.uint32).astype(np.int64)
    step = col("steps", np.uint16).astype(np.int64)
    step[step == 65535] = col("wide", np.uint32).astype(np.int64)
    doc = np.repeat(np.arange(len(ids)), counts)
    total = np.cumsum(step)
    lead = np.cumsum(counts) - counts
    return ids, keys, doc, total - (total[lead] - step[lead])[doc]


def _by(part: np.ndarray, n: int):
    """(number, its indices in order) for every part that has any."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        yield int(k), order[cuts[k]:cuts[k + 1]]


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 16):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i:i + 16], strict=True), _SCHEMA, strict=True)],
                                         schema=_SCHEMA)


def _windows(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.text_batches(batches, BATCH_TEXT):
            ids = t["_id"].to_numpy()
            keys = t["_key"].to_numpy()
            h, tag, doc, pos = _hash_batch(*C.utf8_view(t["text"]), width)
            if not len(h):
                continue
            order, again = _grouped(h, tag)
            head = np.flatnonzero(~again)
            owner = ids[doc[order]]
            least = np.repeat(np.minimum.reduceat(owner, head), np.diff(np.append(head, len(order))))
            sent = np.empty(len(h), bool)
            sent[order] = owner == least
            del order, again, owner, least
            local, out = np.flatnonzero(~sent), np.flatnonzero(sent)
            rows = [_pack(LOCAL, ids, keys, doc[local], pos[local])] if len(local) else []
            for b, idx in _by((h[out] % np.uint64(buckets)).astype(np.int32), buckets):
                idx = out[idx]
                rows.append(_pack(b, ids, keys, doc[idx], pos[idx], h[idx], tag[idx]))
            yield from _rows(rows)
    return run


def _judged(buckets: Iterator[pa.Table]) -> Iterator[tuple]:
    """ids, keys, documents and starts of the windows of a bucket that a
    smaller document also holds; local decisions pass through."""
    for t in buckets:
        ids, keys, doc, pos = _unpack(t)
        if t["bucket"][0].as_py() == LOCAL:
            yield ids, keys, doc, pos
            continue
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in t["hashes"].to_pylist()])
        tag = np.concatenate([np.frombuffer(x, np.uint32) for x in t["tags"].to_pylist()])
        order, again = _grouped(h, tag)
        both = again.copy()
        both[:-1] |= again[1:]
        order, again = order[both], again[both]
        del h, tag, both
        if not len(order):
            continue
        head = np.flatnonzero(~again)
        owner = ids[doc[order]]
        least = np.repeat(np.minimum.reduceat(owner, head), np.diff(np.append(head, len(order))))
        hit = np.sort(order[owner > least])
        if len(hit):
            yield ids, keys, doc[hit], pos[hit]


def _judge(parts: int):
    """Marks of a partition's buckets, packed by the part that their documents belong to."""
    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for bucket, t in C.key_runs(batches, "bucket"):
            if bucket == LOCAL:
                yield from (t.slice(i, 16) for i in range(0, t.num_rows, 16))
            else:
                yield t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, doc, pos in _judged(tables(batches)):
            yield from _rows([_pack(k, ids, keys, doc[idx], pos[idx]) for k, idx in _by(np.mod(keys[doc], parts), parts)])
    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document, its marked windows as runs (first, last start)."""
    got = [_unpack(pa.Table.from_batches([b])) for b in batches if b.num_rows]
    if not got:
        return
    key = np.concatenate([k[d] for _, k, d, _ in got])
    ident = np.concatenate([i[d] for i, _, d, _ in got])
    pos = np.concatenate([p for *_, p in got])
    del got
    order = np.lexsort((pos, ident, key))
    key, ident, pos = key[order], ident[order], pos[order]
    other = (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])
    # repeated rows mark the same windows: steps of zero stay in the run
    first = np.flatnonzero(np.concatenate([[True], other | (np.diff(pos) > 1)]))
    last = np.append(first[1:], len(pos)) - 1
    pairs = np.stack([pos[first], pos[last]], axis=1).astype(np.uint32)
    docs = np.flatnonzero(np.concatenate([[True], other]))
    cuts = np.append(np.searchsorted(first, docs), len(first))
    for i in range(0, len(docs), 4096):
        j = min(i + 4096, len(docs))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ident[docs[i:j]]), pa.array(key[docs[i:j]]),
             pa.array([pairs[a:b].tobytes() for a, b in zip(cuts[i:j], cuts[i + 1:j + 1], strict=True)], pa.binary())],
            names=["id", "key", "runs"])


def removal_runs(docs: DataFrame, width: int = 13) -> DataFrame:
    """(id, key, runs): per row key, packed (first, last) starts of removed windows."""
    spark = docs.sparkSession
    C.small_batches(spark)
    n = C.n_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), C.row_key("doc_id", "text").alias("_key"), "text") \
        .where("_id IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(n, -(-size * PACKED_PER_BYTE // BUCKET_BYTES))
    part = F.when(F.col("bucket") == LOCAL, F.pmod(F.xxhash64("keys"), F.lit(buckets))).otherwise(F.col("bucket")).cast("int")
    marks = rows.mapInArrow(C.tidy(_windows(width, buckets)), _PACK).repartitionById(buckets, part).sortWithinPartitions("bucket") \
        .mapInArrow(C.tidy(_judge(n)), _PACK)
    return marks.repartitionById(n, F.col("bucket")).mapInArrow(C.tidy(_runs), "id long, key long, runs binary")


def _cut(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc_id, text, runs in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words = (text or "").encode().split()
                spans: list[list[int]] = []
                for first, last in np.frombuffer(runs or b"", np.uint32).reshape(-1, 2).tolist():
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = last + width
                    else:
                        spans.append([first, last + width])
                cuts = [0, *[x for s in spans for x in s], len(words)]
                kept = [w for i in range(0, len(cuts), 2) for w in words[cuts[i]:cuts[i + 1]]] if spans else words
                out["doc_id"].append(doc_id)
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["spans"].append([{"start": s, "end": e} for s, e in spans])
                out["kept"].append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_pydict(out, schema=schema)
    return run


def substring_dedup(docs: DataFrame, width: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, spans (word intervals), kept (text of the
    kept words joined by one space); one row per input row."""
    spark = docs.sparkSession
    runs = C.materialize(removal_runs(docs, width), "word-windows")
    C.release(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", C.row_key("doc_id", "text").alias("_key"))
    joined = rows.join(runs, (rows["_key"] == runs["key"]) & (rows["doc_id"] == runs["id"]), "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(
        C.tidy(_cut(width)), "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string")
