"""Suffix-array dedup with a run-length index (operator 6).

Removes every byte that is covered by a ``width``-byte string which also starts
anywhere else in the corpus (same document included).

1. *Anchors.*  Each window of ``width`` bytes picks the k-mer with the least
   hash in it (leftmost of equals).  Equal windows pick equal k-mers, so a
   window can only repeat where its k-mer repeats.  Neighbouring windows with
   the same k-mer form one context; contexts partition the windows of a text,
   and two contexts of one text share fewer than ``width`` bytes.  k-mers that
   occur once leave here.
2. *Copies.*  Contexts with equal bytes (128-bit hash) are counted before any
   text moves: all their windows repeat, and one representative is enough.
3. *Run-length index.*  Representatives that share a k-mer meet in one block.
   The block's suffix array gives a run-compressed Burrows-Wheeler transform,
   of which only the run starts and run ends are kept, with their text
   positions and common prefix with the neighbouring suffix.  Matching
   statistics then stream over the text: at a run start (end) they are read
   off, elsewhere they are one less than at the position before.  Windows
   whose longest match elsewhere is ``width`` or more are marked.
4. Marks go back to all occurrences, merge into maximal runs, and are cut.

A k-mer with very many different contexts is cut into pieces of ``STEP``
windows keyed by the bytes that all windows of the piece contain, so its
contexts spread over tasks.  Pieces of a key that is still crowded never meet:
their windows are counted by 128-bit hash, packed per batch, so no task holds
more than ``CROWD`` contexts or pieces of one key.  Everything is judged on the
input.

Defined results: null text is empty; texts shorter than ``width`` lose
nothing; exact copies lose all of it; null and repeated ids are fine (rows are
told apart by id and content; rows equal in both are copies of each other);
extra columns are ignored; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envspark.llm import common as C

KMER = 16
SEGMENT = 1 << 19        # window starts handled at once
BLOCK = 1 << 19          # bytes of contexts in one index (whole k-mer groups)
CROWD = 4000             # contexts of one k-mer (pieces of one key) beyond which they are cut into pieces (windows)
STEP = 48                # windows of a piece
RANK_BITS = 21           # of a rank in texts below 2 MB: three numbers fit into 63 bits
_LOW = np.uint64(28)


# ------------------------------------------------------------------ anchors
def _kmer_hashes(part: np.ndarray) -> np.ndarray:
    buf = np.ascontiguousarray(part)
    eight = np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))
    h = eight[:-8] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += eight[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return C.mix64(h)


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values (two running minima per block)."""
    n = len(v) - w + 1
    size = -(-len(v) // w) * w
    p = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    p[:len(v)] = v
    p = p.reshape(-1, w)
    left = np.minimum.accumulate(p, axis=1).reshape(-1)
    right = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[w - 1:w - 1 + n])


def contexts_of(data: np.ndarray, offs: np.ndarray, width: int):
    """Per context: k-mer hash, 128-bit content hash (two longs), text ordinal,
    first window start in the text, number of windows, k-mer's distance from it."""
    starts, counts = offs[:-1], np.maximum(np.diff(offs) - width + 1, 0)
    out = []
    for x in range(0, len(data), SEGMENT):
        y = min(x + SEGMENT, len(data))
        lo = np.maximum(starts, x)
        n = np.maximum(np.minimum(starts + counts, y) - lo, 0)
        if not n.any():
            continue
        s = C.ragged(lo - x, n)
        doc = np.repeat(np.arange(len(n)), n)
        part = data[x:min(y + width - 1, len(data))]
        h = _kmer_hashes(part)
        v = h >> _LOW << _LOW | np.arange(len(h), dtype=np.uint64)
        m = (_sliding_min(v, width - KMER + 1)[s] & np.uint64((1 << 28) - 1)).astype(np.int64)
        del v
        head = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])]))
        wins = np.diff(np.append(head, len(m)))
        a, m, d = s[head], m[head], doc[head]
        raw = part.tobytes()
        digest = xxhash.xxh3_128_digest
        both = b"".join([digest(raw[i:j], seed) for i, j, seed in
                         zip(a.tolist(), (a + wins + width - 1).tolist(), (m - a).tolist(), strict=True)])
        c = np.frombuffer(both, np.int64).reshape(-1, 2)
        out.append((h[m].view(np.int64), c[:, 0], c[:, 1], d, a + x - offs[:-1][d], wins, m - a))
    if not out:
        z = np.zeros(0, np.int64)
        return (z,) * 7
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


_OCC = "anchor long, c1 long, c2 long, id long, key long, lo long, wins int, lead int"


def _occurrences(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.text_batches(batches, SEGMENT):
            ids, keys = t["_id"].to_numpy(), t["_key"].to_numpy()
            anchor, c1, c2, d, lo, wins, lead = contexts_of(*C.utf8_view(t["text"]), width)
            if len(anchor):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(c1), pa.array(c2), pa.array(ids[d]), pa.array(keys[d]), pa.array(lo),
                     pa.array(wins.astype(np.int32)), pa.array(lead.astype(np.int32))],
                    names=["anchor", "c1", "c2", "id", "key", "lo", "wins", "lead"])
    return run


# ---------------------------------------------------------- run-length index
def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of small symbols (0 to 510) by prefix doubling;
    only suffixes that are still tied are sorted again.  In texts below 2 MB two
    ranks and the place fit into one number, so plain values are sorted."""
    n = len(s)
    bits = RANK_BITS if n + 1 < 1 << RANK_BITS else 0
    pad = np.concatenate([s.astype(np.int64) + 1, np.zeros(7, np.int64)])     # the end comes before every symbol
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = key << 9 | pad[j:j + n]
    small = np.int32 if bits else np.int64
    sa = np.argsort(key).astype(small)                       # the order of equals is settled below
    k = key[sa]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    rank = np.empty(n + 1, small)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=small), 0))
    depth = 7
    tied = np.flatnonzero(~(new & np.append(new[1:], True))).astype(small)
    while len(tied):
        pos = sa[tied]
        g = rank[pos].astype(np.int64)
        k = rank[np.minimum(pos + depth, n)] + np.int64(1)
        if bits:
            k = ((g << bits | k) << bits) | np.arange(len(k))
            k.sort()
            order = k & ((1 << bits) - 1)
            k >>= bits
        else:
            k += g << 32
            order = np.argsort(k)
            k = k[order]
        pos = pos[order]
        sa[tied] = pos
        new = np.concatenate([[True], k[1:] != k[:-1]])
        rank[pos] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.append(new[1:], True))]
        depth *= 2
    return sa


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of a text: the symbols of its
    runs and, for run starts and run ends, the text position and the common
    prefix with the suffix before (after) it."""

    def __init__(self, s: np.ndarray) -> None:
        self.n = len(s)
        sa = suffix_array(s)
        before = s[sa - 1]                                   # the transform (position 0 wraps round)
        edge = np.concatenate([[True], before[1:] != before[:-1]])
        edge |= sa == 0                                      # the wrapped symbol is a run of its own
        edge[1:] |= sa[:-1] == 0
        first = np.flatnonzero(edge)
        last = np.append(first[1:], self.n) - 1
        self.symbols = before[first]
        self.start, self.end = sa[first].astype(np.int64), sa[last].astype(np.int64)
        # the suffix after a run's end is the next run's start: one common prefix serves both
        common = self._common(s, self.end[:-1], self.start[1:])
        self.start_lcp = np.concatenate([[0], common])
        self.end_lcp = np.concatenate([common, [0]])

    @staticmethod
    def _common(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Four symbols at a time; behind the end no two are equal."""
        pad = np.concatenate([s.astype(np.int16), np.full(4, -1, np.int16)])
        four = np.ndarray((len(pad) - 3,), "<u8", buffer=pad, strides=(2,))
        n, out, live = len(s), np.zeros(len(a), np.int64), np.arange(len(a))
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            gap = four[np.minimum(x, n)] ^ four[np.minimum(y, n)]
            same = np.where(gap & np.uint64(0xFFFF), 0, np.where(gap & np.uint64(0xFFFFFFFF), 1, np.where(gap & np.uint64(0xFFFFFFFFFFFF), 2, np.where(gap, 3, 4))))
            out[live] += np.minimum(same, n - np.maximum(x, y))
            live = live[(same == 4) & (np.maximum(x, y) + 4 < n)]
        return out

    @staticmethod
    def _stream(at: np.ndarray, lcp: np.ndarray, n: int) -> np.ndarray:
        """One less at every position until the next sample."""
        value = np.zeros(n, np.int64)
        seen = np.zeros(n, bool)
        seen[at] = True
        value[at] = lcp
        i = np.arange(n)
        lead = np.maximum.accumulate(np.where(seen, i, 0))
        return np.maximum(value[lead] - (i - lead), 0)

    def matching_statistics(self) -> np.ndarray:
        """Length of the longest match elsewhere, for every text position."""
        return np.maximum(self._stream(self.start, self.start_lcp, self.n), self._stream(self.end, self.end_lcp, self.n))


def repeated_windows(pieces: list[bytes], width: int) -> np.ndarray:
    """For the pieces one after the other: does the window that starts here
    (and ends in the same piece) also start elsewhere?"""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    ends = np.cumsum(size + 1) - 1
    s = flat.astype(np.int16) + 1
    s[ends] = 0
    found = RunIndex(s).matching_statistics()
    room = np.repeat(ends, size + 1) - np.arange(len(s))
    hit = np.minimum(found, room) >= width
    return np.delete(hit, ends)


def _repeated_by_hash(pieces: list[bytes], offsets: np.ndarray, width: int) -> np.ndarray:
    """The same for one crowded piece group, window by window; pieces are
    aligned by ``offsets`` (equal windows have equal offsets)."""
    out = [np.zeros(len(p), bool) for p in pieces]
    for off in range(int(offsets.min()), int(max(o + len(p) - width for o, p in zip(offsets, pieces, strict=True))) + 1):
        rows = [i for i, p in enumerate(pieces) if 0 <= off - offsets[i] <= len(p) - width]
        h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(pieces[i][off - offsets[i]:off - offsets[i] + width]) for i in rows),
                          np.dtype("V16"))
        _, inv, n = np.unique(h.view(np.uint64).reshape(-1, 2), axis=0, return_inverse=True, return_counts=True)
        for i in np.flatnonzero(n[inv.reshape(-1)] > 1):
            out[rows[i]][off - offsets[rows[i]]] = True
    return np.concatenate(out)


_FRAG = "grp long, anchor long, c1 long, c2 long, off int, place int, crowded boolean, data binary"
_MARK = "anchor long, c1 long, c2 long, first int, last int"


def _fragments(width: int):
    """Bytes of the representatives; crowded ones in pieces."""
    names = ["grp", "anchor", "c1", "c2", "off", "place", "crowded", "data"]
    types = [pa.int64()] * 4 + [pa.int32(), pa.int32(), pa.bool_(), pa.binary()]

    def rows(text: bytes, reps: list[dict]):
        for r in reps:
            lo, wins, lead = r["lo"], r["wins"], r["lead"]
            own = (r["anchor"], r["c1"], r["c2"])
            if not r["crowded"]:
                yield (r["anchor"], *own, 0, -lead, False, text[lo:lo + wins + width - 1])
                continue
            at = lo + lead                                   # the k-mer's place in the text
            # a window is named by how far it starts before the k-mer: from lead down to lead - wins + 1
            for j in range((lead - wins + 1) // STEP, lead // STEP + 1):
                far, near = min(lead, STEP * j + STEP - 1), max(lead - wins + 1, STEP * j)
                core = text[at - STEP * j:at - (STEP * j + STEP - 1) + width]
                grp = xxhash.xxh3_64_intdigest(core, j) - (1 << 63)
                yield (grp, *own, lead - far, -far, True, text[at - far:at - near + width])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for text, reps in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for row in rows((text or "").encode(), reps.as_py()):
                    held.append(row)
                    size += len(row[-1]) + 64
                    if size >= C.BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
    return run


def _mark_windows(width: int):
    names = ["anchor", "c1", "c2", "first", "last"]

    def marks(tables: list[pa.Table]) -> pa.RecordBatch | None:
        t = pa.concat_tables(tables)
        pieces = t["data"].to_pylist()
        if len(tables) == 1 and t["crowded"][0].as_py() and t["data"].nbytes > BLOCK:
            hit = _repeated_by_hash(pieces, t["place"].to_numpy(), width)
        else:
            hit = repeated_windows(pieces, width)
        if not hit.any():
            return None
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        row = np.repeat(np.arange(len(pieces)), size)
        at = np.flatnonzero(hit)
        new = np.concatenate([[True], (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])])
        first = at[new]
        last = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
        r = row[first]
        off = t["off"].to_numpy()[r] - (np.cumsum(size) - size)[r]
        return pa.RecordBatch.from_arrays(
            [pa.array(t[c].to_numpy()[r]) for c in names[:3]]
            + [pa.array((first + off).astype(np.int32)), pa.array((last + off).astype(np.int32))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, t in C.key_runs(batches, "grp"):
            if t.num_rows < 2:
                continue
            if held and size + t["data"].nbytes > BLOCK:
                got = marks(held)
                if got is not None:
                    yield got
                held, size = [], 0
            held.append(t)
            size += t["data"].nbytes
        if held:
            got = marks(held)
            if got is not None:
                yield got
    return run


_SEEN = "w1 long, w2 long, n long"
_HELD = "w1 long, w2 long, held array<struct<anchor:long,c1:long,c2:long,at:int>>"


def _piece_windows(width: int, holders: bool):
    """Per batch of pieces and distinct window (128-bit hash): how often it
    occurs, or where."""
    place = pa.struct([("anchor", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            if not b.num_rows:
                continue
            pieces = b.column(b.schema.get_field_index("data")).to_pylist()
            wins = np.fromiter((len(p) - width + 1 for p in pieces), np.int64, len(pieces))
            h = np.frombuffer(b"".join(digest(p[i:i + width]) for p in pieces for i in range(len(p) - width + 1)), np.int64).reshape(-1, 2)
            order = np.lexsort((h[:, 1], h[:, 0]))
            h = h[order]
            head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]).any(1)]))
            names, first = ["w1", "w2"], [pa.array(h[head, 0]), pa.array(h[head, 1])]
            if not holders:
                yield pa.RecordBatch.from_arrays([*first, pa.array(np.diff(np.append(head, len(h))))], names=[*names, "n"])
                continue
            row = np.repeat(np.arange(len(pieces)), wins)[order]
            off = b.column(b.schema.get_field_index("off")).to_numpy().astype(np.int64)
            at = (C.ragged(off, wins)[order]).astype(np.int32)
            own = [pa.array(b.column(b.schema.get_field_index(c)).to_numpy()[row]) for c in ("anchor", "c1", "c2")]
            held = pa.StructArray.from_arrays([*own, pa.array(at)], fields=list(place))
            ends = pa.array(np.append(head, len(h)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*first, pa.ListArray.from_arrays(ends, held)], names=[*names, "held"])
    return run


# ------------------------------------------------------------------- Spark
def _crowded_marks(pieces: DataFrame, width: int) -> DataFrame:
    """Marks of the pieces of crowded k-mers, where neither a hot core nor a
    hot window gathers pieces in a task."""
    pieces = C.materialize(pieces, "crowded-pieces")
    C.release(pieces.sparkSession)
    cores = C.materialize(pieces.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > CROWD).select("grp"), "crowded-cores")
    hot = F.broadcast(cores)                                              # one row per CROWD pieces at most
    found = C.by_key(pieces.join(hot, "grp", "left_anti").select(pieces.columns), "grp").mapInArrow(C.tidy(_mark_windows(width)), _MARK)
    if cores.isEmpty():
        return found
    many = pieces.join(hot, "grp").select("anchor", "c1", "c2", "off", "data")
    known = C.materialize(many.mapInArrow(C.tidy(_piece_windows(width, False)), _SEEN).groupBy("w1", "w2").agg(F.sum("n").alias("n"))
                          .where("n > 1").select("w1", "w2"), "crowded-windows")
    one = Window.partitionBy("anchor", "c1", "c2").orderBy("at")          # the windows of one context
    marks = many.mapInArrow(C.tidy(_piece_windows(width, True)), _HELD).join(known, ["w1", "w2"]) \
        .select(F.explode("held").alias("held")).select("held.*") \
        .withColumn("_run", F.col("at") - F.row_number().over(one)) \
        .groupBy("anchor", "c1", "c2", "_run").agg(F.min("at").alias("first"), F.max("at").alias("last")).drop("_run")
    return found.union(marks)


def repeated_spans(docs: DataFrame, width: int = 400) -> DataFrame:
    """(id, key, runs): runs of window starts (first, last) that repeat."""
    if width < 2 * KMER:
        raise ValueError(f"width must be {2 * KMER} or more")
    spark = docs.sparkSession
    C.small_batches(spark)
    rows = docs.where("text IS NOT NULL").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), C.row_key("doc_id", "text").alias("_key"), "text")
    occ = C.materialize(rows.where(F.octet_length("text") >= width).mapInArrow(C.tidy(_occurrences(width)), _OCC), "contexts")
    # written, so that the join below reads it by a plain shuffle and adaptive execution can split a hot k-mer
    known = C.materialize(occ.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), (F.min("c1") != F.max("c1")).alias("mixed"))
                          .where("n > 1").select("anchor", "mixed"), "repeated-kmers")
    occ = C.materialize(occ.join(known, "anchor"), "repeated-contexts")
    C.release(spark)
    ctx = C.materialize(
        occ.groupBy("anchor", "c1", "c2", "mixed").agg(F.count(F.lit(1)).alias("n"),
                                                       F.min(F.struct("id", "key", "lo", "wins", "lead")).alias("rep"))
        .select("anchor", "c1", "c2", "mixed", "n", "rep.*"), "distinct-contexts")
    mixed = ctx.where("mixed")
    crowds = C.materialize(mixed.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > CROWD).select("anchor"), "crowded-kmers")

    def pieces(chosen: DataFrame, crowded: bool) -> DataFrame:
        need = chosen.groupBy("id", "key").agg(F.collect_list(F.struct(
            "anchor", "c1", "c2", "lo", "wins", "lead", F.lit(crowded).alias("crowded"))).alias("reps"))
        texts = rows.join(need, (rows["_id"] == need["id"]) & (rows["_key"] == need["key"])).select("text", "reps")
        return texts.mapInArrow(C.tidy(_fragments(width)), _FRAG)

    # one row per CROWD contexts at most
    found = C.by_key(pieces(mixed.join(F.broadcast(crowds), "anchor", "left_anti"), False), "grp") \
        .mapInArrow(C.tidy(_mark_windows(width)), _MARK)
    if not crowds.isEmpty():
        found = found.union(_crowded_marks(pieces(mixed.join(F.broadcast(crowds), "anchor", "left_semi"), True), width))
    copies = ctx.where("n > 1").select("anchor", "c1", "c2", F.lit(0).alias("first"), (F.col("wins") - 1).alias("last"))
    hits = C.materialize(copies.union(found), "repeated-windows")
    C.release(spark)
    return occ.join(hits, ["anchor", "c1", "c2"]) \
        .groupBy("id", "key").agg(F.collect_list(F.struct(
            (F.col("lo") + F.col("first")).alias("first"), (F.col("lo") + F.col("last")).alias("last"))).alias("runs"))


def _cut(width: int, n_keep: int):
    names = ["n_bytes", "n_removed", "spans", "kept"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]

    def cut(text: str | None, runs) -> tuple:
        raw = (text or "").encode()
        if not runs.is_valid or not len(runs):
            return len(raw), 0, [], raw
        first = runs.values.field("first").to_numpy()
        order = np.argsort(first, kind="stable")
        first, end = first[order], np.maximum.accumulate(runs.values.field("last").to_numpy()[order] + width)
        head = np.flatnonzero(np.concatenate([[True], first[1:] > end[:-1]]))
        lo, hi = first[head].tolist(), end[np.append(head[1:], len(first)) - 1].tolist()
        cuts = [0, *[x for s in zip(lo, hi, strict=True) for x in s], len(raw)]
        kept = b"".join(raw[cuts[i]:cuts[i + 1]] for i in range(0, len(cuts), 2))
        return len(raw), len(raw) - len(kept), [{"start": s, "end": e} for s, e in zip(lo, hi, strict=True)], kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [cut(t, r) for t, r in zip(b.column(n_keep).to_pylist(), b.column(n_keep + 1), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([*b.columns[:n_keep], *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]],
                                                 names=[*b.schema.names[:n_keep], *names])
    return run


def suffix_dedup(docs: DataFrame, width: int = 400, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, n_bytes, n_removed, spans (maximal removed byte runs)
    and kept (the remaining bytes), one row per input row."""
    spark = docs.sparkSession
    spans = C.materialize(repeated_spans(docs, width), "byte-spans")
    C.release(spark)
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), C.row_key("doc_id", "text").alias("_key"))
    joined = rows.join(spans, (rows["_key"] == spans["key"]) & (rows["_id"] == spans["id"]), "left")
    src = joined.select(*[f"_k{i}" for i in range(len(keep))], "_text", "runs")
    schema = src.drop("_text", "runs").schema.add("n_bytes", "long").add("n_removed", "long") \
        .add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))).add("kept", "binary")
    return src.mapInArrow(C.tidy(_cut(width, len(keep))), schema).select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "n_removed", "spans", "kept")


@F.pandas_udf(T.StringType())
def kept_text(kept: pd.Series) -> pd.Series:
    """Remaining bytes as text; what a cut leaves of a character goes too."""
    return kept.map(lambda x: None if x is None else x.decode("utf-8", "ignore"))
