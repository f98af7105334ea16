"""Hard-negative mining with rotated one-bit codes (operator 13).

Vectors are taken as integers (``floor(scale * x)``), so scores are exact inner
products.  A random rotation P turns each vector v into w = P v; its code is the
signs of w, s in {-1, 1}^d, and beside the code its alignment with w is stored.
With c = s / sqrt(d) and alignment a = <w, c>, w = a c + r, r orthogonal to c.
The remainder r is coded the same way, ``levels`` times in all (level 1 is the
plain one-bit code); each level makes the remainder about 0.6 times as long.

For an anchor q, rotated and rounded to bytes (q' = q + e), <q', c> comes from
popcounts of the code with q's eight bit planes.  The sum over the levels is an
estimate of the score, and by Cauchy-Schwarz the score cannot be further from it
than |q| |r| + |e| |sum of the coded parts|: a certain interval, not a likely
one.  Rows whose interval cannot reach an anchor's result are dropped, the
others are scored in integers.  No recall is lost.

Anchors (a stated set) meet all rows in blocks: anchors and rows are dealt to
blocks of bounded bytes by a hash of the row number, one cell per pair of
blocks.  A cell returns its own best ``positives`` (``negatives`` per positive)
of each anchor, which are the only rows that leave it; the best of all cells
follow by rank.  Two rounds: positives, then negatives in the score window that
each positive opens.  The driver sees four numbers.

Defined results: rows with a null label, a null vector or a null or non-finite
component take no part, nor do rows whose integers are too large for a score
to fit a long; vectors of different length are not compared; null ids are no
anchors and come last among equal scores; repeated rows are rows of their own
(each repeated anchor has its results, its copies are other rows); extra columns
are ignored; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envspark.llm import common as C
from envspark.llm.embedding_dedup import rotation

PLANES = 8                   # bits of a rotated anchor component
BLOCK_BYTES = 16 << 20       # integers of one block of anchors or rows
FEW_ROWS = 1024              # a block smaller than this is not worth a cell
STEP = 64                    # anchors looked at in one step
SLACK = 1e-9


# ------------------------------------------------------------------ codes
def _words(dim: int) -> int:
    return max(1, -(-dim // 64))


def _pack_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans -> rows of 64-bit words."""
    n, d = bits.shape
    wide = np.zeros((n, _words(d) * 64), bool)
    wide[:, :d] = bits
    return np.packbits(wide, axis=1).view(np.uint64)


def encode_rows(w: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (n, levels, words), alignments (n, levels), length of the coded
    part and of the remainder."""
    n, d = w.shape
    codes = np.zeros((n, levels, _words(d)), np.uint64)
    align = np.zeros((n, levels))
    rest = w.copy()
    root = np.sqrt(max(d, 1))
    for k in range(levels):
        up = rest >= 0
        codes[:, k] = _pack_bits(up)
        align[:, k] = np.abs(rest).sum(1) / root
        rest -= np.where(up, 1.0, -1.0) * (align[:, k] / root)[:, None]
    return codes, align, np.sqrt(((w - rest) ** 2).sum(1)), np.sqrt((rest ** 2).sum(1))


class Queries:
    """Rotated anchors as bit planes of bytes."""

    def __init__(self, q: np.ndarray) -> None:
        n, d = q.shape
        self.dim, self.norm = d, np.sqrt((q ** 2).sum(1))
        self.low = q.min(1) if d else np.zeros(n)
        span = (q.max(1) if d else np.zeros(n)) - self.low
        self.step = np.where(span > 0, span, 1.0) / ((1 << PLANES) - 1)
        grade = np.rint((q - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.error = np.sqrt(((self.low[:, None] + grade * self.step[:, None] - q) ** 2).sum(1))
        self.total = grade.sum(1)
        self.planes = np.stack([_pack_bits(grade >> b & 1 == 1) for b in range(PLANES)], axis=1)    # n, planes, words


def intervals(q: Queries, rows: slice, codes: np.ndarray, align: np.ndarray, coded: np.ndarray, rest: np.ndarray):
    """(lower, upper) bound of the scores of some anchors with some rows."""
    d = max(q.dim, 1)
    n = len(q.norm[rows])
    est = np.zeros((n, len(codes)))
    ups = np.bitwise_count(codes).astype(np.int64).sum(2)                       # set bits per row and level
    for k in range(codes.shape[1]):
        grade = np.zeros((n, len(codes)), np.int32)
        for b in range(PLANES):
            for x in range(codes.shape[2]):
                grade += np.bitwise_count(q.planes[rows, b, x, None] & codes[None, :, k, x]).astype(np.int32) << b
        # <q', s> = low * (ups - downs) + step * (sum of grades at ups - sum at downs)
        dot = q.low[rows, None] * (2 * ups[None, :, k] - q.dim) + q.step[rows, None] * (2 * grade - q.total[rows, None])
        est += dot * (align[:, k] / np.sqrt(d))[None, :]
    far = q.norm[rows, None] * rest[None, :] + q.error[rows, None] * coded[None, :]
    far += SLACK * (1 + q.norm[rows, None] * (coded + rest)[None, :])
    return est - far, est + far


# ---------------------------------------------------------------- index
def _index(levels: int, scale: float, seed: int):
    """Sound vectors -> integers, codes, alignments, lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arr = b.column(b.schema.get_field_index("vec"))
            size = arr.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = arr.flatten().to_numpy(zero_copy_only=False).astype(float)
            start = np.cumsum(size) - size
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                with np.errstate(over="ignore"):
                    x = np.floor(scale * flat[C.ragged(start[at], np.full(len(at), dim))].reshape(len(at), dim))
                fits = (np.abs(x) < np.sqrt(2.0 ** 62 / max(dim, 1))).all(1)
                at, x = at[fits], x[fits]
                codes, align, coded, rest = encode_rows(x @ rotation(dim, seed) if dim else x, levels)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(b.schema.get_field_index(c)).take(pa.array(at)) for c in ("vec_id", "label", "anchor")),
                     pa.array(np.full(len(at), dim, np.int32)), *map(_rows, (x.astype(np.int64), codes, align)), pa.array(coded), pa.array(rest)],
                    names=["vec_id", "label", "anchor", "dim", "ints", "codes", "align", "coded", "rest"])
    return run


_INDEX = "vec_id long, label long, anchor boolean, dim int, ints binary, codes binary, align binary, coded double, rest double"


def _rows(m: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in m], pa.binary())


def _matrix(t: pa.Table, name: str, dtype, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(t[name].to_pylist()), dtype).reshape(t.num_rows, *shape)


class Block:
    """One dimension's rows of a cell as arrays, in a fixed order."""

    def __init__(self, t: pa.Table, dim: int, levels: int) -> None:
        self.number = t["row"].to_numpy()
        order = np.argsort(self.number)
        t, self.number = t.take(pa.array(order)), self.number[order]
        self.label = t["label"].to_numpy()
        self.null = t["vec_id"].is_null().to_numpy(zero_copy_only=False) if t.num_rows else np.zeros(0, bool)
        self.id = t["vec_id"].fill_null(0).to_numpy()
        self.ints = _matrix(t, "ints", np.int64, dim)
        self.codes = _matrix(t, "codes", np.uint64, levels, _words(dim))
        self.align = _matrix(t, "align", np.float64, levels)
        self.coded, self.rest = t["coded"].to_numpy(), t["rest"].to_numpy()
        self.table = t


def _cells(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[tuple[Block, Block, int]]:
    for _, t in C.key_runs(batches, "cell"):
        t = t.combine_chunks()
        dims, guest = t["dim"].to_numpy(), t["role"].to_numpy()
        for dim in np.unique(dims[guest == 0]):
            parts = [t.filter(pa.array((dims == dim) & (guest == side))) for side in (0, 1)]
            if parts[1].num_rows:
                yield Block(parts[0], int(dim), levels), Block(parts[1], int(dim), levels), int(dim)


def _scores(anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer scores of one anchor with some rows."""
    return rows @ anchor


def _best(score: np.ndarray, block: Block, at: np.ndarray, k: int) -> np.ndarray:
    """The first k by score, smaller id, null ids last."""
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= edge)
    else:
        some = np.arange(len(score))
    a = at[some]
    return some[np.lexsort((block.number[a], block.id[a], block.null[a], -score[some]))[:k]]


def _found(block: Block, anchor: list, place: list, at: list, score: list) -> pa.RecordBatch:
    at = np.array(at, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor, pa.int64()), pa.array(place, pa.int32()), pa.array(block.number[at]), pa.array(block.id[at], mask=block.null[at]),
         pa.array(score, pa.int64())], names=["anchor", "place", "row", "vec_id", "score"])


def _near(lower: np.ndarray, upper: np.ndarray, k: int) -> np.ndarray:
    """Rows whose interval reaches the k-th best certain score."""
    if len(lower) <= k:
        return np.arange(len(lower))
    return np.flatnonzero(upper >= np.partition(lower, len(lower) - k)[len(lower) - k])


def _positives(levels: int, seed: int, count: int):
    """Per cell and anchor the best other rows of its label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, r, dim in _cells(batches, levels):
            rot = a.ints @ rotation(dim, seed) if dim else a.ints.astype(float)
            out: tuple[list, list, list, list] = ([], [], [], [])
            for label in np.unique(a.label):
                mine, own = np.flatnonzero(a.label == label), np.flatnonzero(r.label == label)
                if not len(own):
                    continue
                q = Queries(rot[mine])
                part = r.codes[own], r.align[own], r.coded[own], r.rest[own]
                for lo in range(0, len(mine), STEP):
                    lower, upper = intervals(q, slice(lo, lo + STEP), *part)
                    for i, m in enumerate(mine[lo:lo + STEP]):
                        other = np.flatnonzero(r.number[own] != a.number[m])
                        at = own[other[_near(lower[i][other], upper[i][other], count)]]
                        score = _scores(a.ints[m], r.ints[at])
                        first = _best(score, r, at, count)
                        out[0].extend([a.number[m]] * len(first))
                        out[1].extend([0] * len(first))
                        out[2].extend(at[first])
                        out[3].extend(score[first])
            yield _found(r, *out)
    return run


def _negatives(levels: int, seed: int, count: int, low: int, high: int):
    """Per cell, anchor and positive the best rows of other labels whose score
    lies from ``low`` to ``high`` per cent of the positive's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, r, dim in _cells(batches, levels):
            q = Queries(a.ints @ rotation(dim, seed) if dim else a.ints.astype(float))
            windows = a.table["scores"].to_pylist()
            out: tuple[list, list, list, list] = ([], [], [], [])
            for lo in range(0, len(a.number), STEP):
                lower, upper = intervals(q, slice(lo, lo + STEP), r.codes, r.align, r.coded, r.rest)
                for i in range(len(lower)):
                    m = lo + i
                    other = np.flatnonzero(r.label != a.label[m])
                    down, up = lower[i][other], upper[i][other]
                    for place, p in enumerate(windows[m] or [], 1):
                        least, most = -(-low * p // 100), high * p // 100        # exact: Python integers
                        if least > most:
                            continue
                        sure = (down >= least) & (up <= most)
                        floor = least
                        if sure.sum() >= count:
                            ranked = down[sure]
                            floor = max(least, np.partition(ranked, len(ranked) - count)[len(ranked) - count])
                        at = other[(up >= floor) & (down <= most)]
                        score = _scores(a.ints[m], r.ints[at])
                        fits = (score >= least) & (score <= most)
                        at, score = at[fits], score[fits]
                        first = _best(score, r, at, count)
                        out[0].extend([a.number[m]] * len(first))
                        out[1].extend([place] * len(first))
                        out[2].extend(at[first])
                        out[3].extend(score[first])
            yield _found(r, *out)
    return run


_FOUND = "anchor long, place int, row long, vec_id long, score long"


def _ranked(found: DataFrame, keys: list[str], count: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)


def mine_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   scale: float = 256.0, levels: int = 6, seed: int = 13) -> DataFrame:
    """``vectors`` (vec_id, embedding, label; ``anchors`` says which rows are)
    -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    C.small_batches(spark)
    inf = float("inf")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("vec"))
    sound = rows.where(F.col("label").isNotNull() & F.col("vec").isNotNull()
                       & F.coalesce(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < inf)), F.lit(False)))
    coded = sound.mapInArrow(C.tidy(_index(levels, scale, seed)), _INDEX)
    index = C.materialize(coded.withColumn("row", F.monotonically_increasing_id()), "one-bit-codes")
    seen = index.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("a"), F.coalesce(F.max("dim"), F.lit(0)).alias("d")).first()
    per = max(1, BLOCK_BYTES // (8 * max(seen["d"], 1)))
    width = C.n_partitions(spark)
    n_rows = max(1, -(-seen["n"] // per), min(width, seen["n"] // FEW_ROWS))
    n_anchors = max(1, -(-seen["a"] // per))

    def block(salt: int, n: int) -> Column:
        return F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n))

    def cells(who: DataFrame, step) -> DataFrame:
        extra = F.lit(None).cast("array<long>").alias("scores") if "scores" not in who.columns else F.col("scores")
        cols = [c for c in index.columns if c != "anchor"]
        left = who.withColumn("_y", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))) \
            .select((block(1, n_anchors) * n_rows + F.col("_y")).alias("cell"), F.lit(0).alias("role"), *cols, extra)
        right = index.withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1)))) \
            .select((F.col("_x") * n_rows + block(2, n_rows)).alias("cell"), F.lit(1).alias("role"), *cols,
                    F.lit(None).cast("array<long>").alias("scores"))
        return C.by_key(left.unionByName(right), "cell", min(width, n_rows * n_anchors)).mapInArrow(C.tidy(step), _FOUND)

    base = index.where("anchor")
    best = C.materialize(_ranked(cells(base, _positives(levels, seed, positives)), ["anchor"], positives), "positives")
    opened = best.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    who = base.drop("anchor").join(opened, F.col("row") == F.col("anchor")).drop("anchor")
    hard = _ranked(cells(who, _negatives(levels, seed, negatives, low, high)), ["anchor", "place"], negatives)
    named = best.join(base.select(F.col("row").alias("_row"), F.col("vec_id").alias("anchor_id")), F.col("anchor") == F.col("_row")) \
        .select("anchor", F.col("rank").alias("place"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")) \
        .join(named, ["anchor", "place"]) \
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
