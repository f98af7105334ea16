"""SimHash near-dedup with pigeonring filtering (operator 7).

Fingerprints: XXH64 (seed 42) of every word shingle; a bit is set if it is set
in over half of the hashes.  Links: at most ``max_bits`` differing bits.

Search among distinct fingerprints: the 64 bits are a ring of ``max_bits + 1``
segments.  By the pigeonring principle two linked fingerprints have a start
segment from which every chain of l consecutive segments differs in at most
``floor(l * max_bits / segments)`` bits.  The first segment of such a chain is
therefore equal (the shuffle key), the second differs in at most one bit
(probed in sorted order), the longer chains prune what is left, and the full
Hamming distance decides.  Each fingerprint is shuffled once per segment.

Equal fingerprints are one vertex; a crowded segment value is split into
chunks whose pairs of chunks are dealt to different tasks; each task returns
at most one link per fingerprint (a forest of what it found), so a group of
copies never becomes all its pairs.

Defined results: null or wordless text has fingerprint zero and is linked like
any other; fewer words than the shingle: one shingle of all words; null ids
count as no id (``component_id`` is null only if a whole component has none);
repeated rows come back each; extra columns are ignored; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.llm import common as C
from envspark.llm.components import components, forest

SEED = 42
CHUNK = 1 << 14          # fingerprints of one segment value in one task (work unit, not a cap)
PAIRS = 1 << 21          # candidate pairs looked at in one step


def fingerprint_of(text: str | None, shingle: int) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    buf = b" ".join(words)
    n = max(len(words) - shingle + 1, 1)
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    starts = (ends - length)[:n].tolist()
    ends = ends[len(words) - n:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(buf[s:e], SEED) for s, e in zip(starts, ends, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, key (of id and text), fp (the 64 bits as a signed long), one row
    per input row."""
    C.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint_of(t, shingle) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64), pa.int64())],
                                             names=["doc_id", "key", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.row_key("doc_id", "text").alias("key"), "text") \
        .mapInArrow(C.tidy(run), "doc_id long, key long, fp long")


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the ring's segments."""
    m = max_bits + 1
    edges = [round(i * 64 / m) for i in range(m + 1)]
    return [(edges[i], edges[i + 1] - edges[i]) for i in range(m)]


def _mask(seg: tuple[int, int]) -> int:
    return ((1 << seg[1]) - 1) << seg[0]


def _cell_links(fp: np.ndarray, part: np.ndarray, start: int, segs: list, max_bits: int, cross: bool):
    """Links between fingerprints that agree in segment ``start``."""
    m = len(segs)
    second = segs[(start + 1) % m]
    value = ((fp >> np.uint64(second[0])) & np.uint64((1 << second[1]) - 1)).astype(np.int64)
    order = np.argsort(value, kind="stable")
    fp, part, value = fp[order], part[order], value[order]
    masks = [np.uint64(sum(_mask(segs[(start + j) % m]) for j in range(length))) for length in range(2, m)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    allow = (2 * max_bits) // m                      # bits that the second segment may differ in
    steps = [0] + ([1 << k for k in range(second[1])] if allow else [])
    rows = np.arange(len(fp))
    for step in steps:
        target = value ^ step
        if step:
            take = target > value                    # each unordered pair once
            left, lo, hi = rows[take], np.searchsorted(value, target[take]), np.searchsorted(value, target[take], side="right")
        else:
            left, lo, hi = rows, rows + 1, np.searchsorted(value, value, side="right")
        counts = hi - lo
        full = np.flatnonzero(counts)
        left, lo, counts = left[full], lo[full], counts[full]
        total = np.cumsum(counts)
        i = 0
        while i < len(left):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, side="right")))
            a, b = np.repeat(left[i:j], counts[i:j]), C.ragged(lo[i:j], counts[i:j])
            i = j
            if cross:
                keep = part[a] != part[b]
                a, b = a[keep], b[keep]
            x = fp[a] ^ fp[b]
            for length, mask in enumerate(masks, 2):
                ok = np.bitwise_count(x & mask) <= (length * max_bits) // m
                a, b, x = a[ok], b[ok], x[ok]
            ok = np.bitwise_count(x) <= max_bits
            if ok.any():
                found.append((a[ok], b[ok]))
                size += int(ok.sum())
                if size > PAIRS:
                    found = [forest(*(np.concatenate(c) for c in zip(*found, strict=True)))]
                    size = len(found[0][0])
    if not found:
        return None
    a, b = forest(*(np.concatenate(c) for c in zip(*found, strict=True)))
    signed = fp.view(np.int64)
    return signed[a], signed[b]


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (column ``fp``)
    within ``max_bits`` bits of each other."""
    if not 1 <= max_bits <= 15:
        raise ValueError("max_bits must be from 1 to 15")
    spark = fps.sparkSession
    segs = _segments(max_bits)
    keys = F.array(*[F.struct(F.lit(i).alias("seg"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << w) - 1)).alias("val"))
                     for i, (lo, w) in enumerate(segs)])
    rows = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.seg", "k.val")
    # at most segments * 2**width rows, whatever the data
    crowded = rows.groupBy("seg", "val").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts")).where("parts > 1")
    cells = rows.join(F.broadcast(crowded), ["seg", "val"], "left") \
        .withColumn("parts", F.coalesce("parts", F.lit(1))) \
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))) \
        .select("fp", "seg", "val", "part", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))
    cells = cells.withColumn("cell", F.xxhash64("seg", "val", "x", "y"))
    n = C.n_partitions(spark)
    cells = cells.repartition(n, "cell").sortWithinPartitions("cell", "seg", "val", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in C.key_runs(batches, "cell"):
            if t.num_rows < 2:
                continue
            fp = t["fp"].to_numpy().view(np.uint64)
            seg, val, x, y = (t[c].to_numpy() for c in ("seg", "val", "x", "y"))
            cut = np.flatnonzero((np.diff(seg) != 0) | (np.diff(val) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(fp)], strict=True):
                got = _cell_links(fp[lo:hi], t["part"].to_numpy()[lo:hi], int(seg[lo]), segs, max_bits, x[lo] != y[lo])
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], names=["a", "b"])

    return cells.select("cell", "seg", "val", "x", "y", "part", "fp").mapInArrow(C.tidy(run), "a long, b long")


def simhash_dedup(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, key, fp, root (number of the component) and component_id
    (smallest doc_id reachable by links), one row per input row."""
    spark = docs.sparkSession
    rows = C.materialize(fingerprints(docs, shingle), "fingerprints")
    classes = C.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    comp = components(links(classes.select("fp"), max_bits))
    placed = classes.join(comp, classes["fp"] == comp["id"], "left") \
        .select("fp", "least", F.coalesce("component_id", "fp").alias("root"))
    roots = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(roots, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one row, that of the
    smallest doc_id (a null id comes last, rows equal in id and text are one)."""
    least = simhash_dedup(docs, shingle, max_bits).groupBy("root") \
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least"))
    stay = C.materialize(least.select(F.col("least.doc_id").alias("_stay"), F.col("least.key").alias("_stay_key")), "kept-documents")
    # the row as one struct: no column of the input can clash with ours
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), C.row_key("doc_id", "text").alias("key"))
    return rows.join(stay, (rows["key"] == stay["_stay_key"]) & rows["id"].eqNullSafe(stay["_stay"]), "left_semi") \
        .dropDuplicates(["key", "id"]).select("row.*")
