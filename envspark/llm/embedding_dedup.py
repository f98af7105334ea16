"""Embedding near-dedup by a subspace pigeonhole join (operator 1).

Unit vectors with cosine c are sqrt(2 - 2c) apart.  A random rotation spreads
that distance over the coordinates, which are split into blocks of
``block_dims``; if two vectors are within the squared budget, some block is
within its proportional share of it.  Each block is range-joined on its own:
slabs as wide as the block's radius along the first coordinate, every slab
against itself and the next, block distances first, and the candidates of the
union are verified by their full cosine in double precision.  A pair is
counted in the first block that finds it, so nothing has to be deduplicated.

Equal vectors are one class and are compared once.  A slab holds any number of
vectors: it is cut into chunks of ``CHUNK`` classes by hash, and pairs of
chunks go to different tasks.  A task returns, per class, how many vectors it
links to, and a spanning forest of the links; never the pairs themselves.
What the driver sees is the number of classes in each slab, at most
(blocks x slabs of [-1, 1]) numbers.

Defined results: null, empty, zero vectors and vectors with a null or
non-finite component link with nothing (own component, kept); vectors of
different length do not link; null ids are no ids: such rows are linked and
counted but never name a component (``kept`` is false for them); repeated rows
are copies of each other and come back each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.llm import common as C
from envspark.llm.components import components, forest

CHUNK = 1 << 14
ROWS, COLS = 512, 8192          # distance matrix looked at in one step
EDGES = 1 << 20
SLACK = 1e-9                    # keeps candidates that rounding puts just outside


def rotation(dim: int, seed: int) -> np.ndarray:
    """Random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int, block_dims: int) -> list[tuple[int, int]]:
    m = max(1, round(dim / block_dims))
    edges = [round(i * dim / m) for i in range(m + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _vectors(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit rotated vectors) of each dimension in the batch."""
    arr = b.column(b.schema.get_field_index("vec"))
    size = arr.value_lengths().to_numpy(zero_copy_only=False)
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(float)
    start = np.cumsum(size) - size
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        x = flat[C.ragged(start[rows], np.full(len(rows), dim))].reshape(len(rows), dim)
        x = x / np.abs(x).max(axis=1, keepdims=True)        # no overflow in the squares
        yield rows, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _budgets(dim: int, block_dims: int, cosine: float) -> list[tuple[int, int, float]]:
    return [(lo, hi, (2 - 2 * cosine) * (hi - lo) / dim) for lo, hi in blocks_of(dim, block_dims)]


def _slabs(x: np.ndarray, block_dims: int, cosine: float) -> np.ndarray:
    """Slab of every vector in every block."""
    return np.stack([np.floor(x[:, lo] / (np.sqrt(t + SLACK) * (1 + SLACK))).astype(np.int64)
                     for lo, _, t in _budgets(x.shape[1], block_dims, cosine)], axis=1)


def _count_slabs(seed: int, block_dims: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], int] = {}
        for b in batches:
            for _, x in _vectors(b):
                slabs = _slabs(x @ rotation(x.shape[1], seed), block_dims, cosine)
                for k in range(slabs.shape[1]):
                    for s, n in zip(*np.unique(slabs[:, k], return_counts=True), strict=True):
                        at = (x.shape[1], k, int(s))
                        total[at] = total.get(at, 0) + int(n)
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int32()) for i in range(3)]
                                         + [pa.array([total[k] for k in keys], pa.int64())], names=["dim", "block", "slab", "n"])
    return run


def _deal(seed: int, block_dims: int, cosine: float, parts: dict[tuple[int, int, int], int]):
    """One row per task cell that a class takes part in: own slab against
    itself (guest 0), as home or as guest of the neighbouring slab (guest 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            salt = C.mix64(cls.view(np.uint64)).astype(np.int64) & ((1 << 40) - 1)
            for rows, x in _vectors(b):
                dim = x.shape[1]
                x = x @ rotation(dim, seed)
                slabs = _slabs(x, block_dims, cosine)
                out: list[tuple] = []
                for r, v in enumerate(x):
                    raw = v.tobytes()
                    own = (int(cls[rows[r]]), int(n[rows[r]]), raw)
                    for k in range(slabs.shape[1]):
                        s = int(slabs[r, k])
                        mine = parts.get((dim, k, s), 1)
                        me = int(salt[rows[r]] % mine)
                        for j in range(mine):
                            out.append((dim, k, s, 0, min(me, j), max(me, j), me, *own))
                        for j in range(parts.get((dim, k, s + 1), 0)):
                            out.append((dim, k, s, 1, me, j, -1, *own))
                        for j in range(parts.get((dim, k, s - 1), 0)):
                            out.append((dim, k, s - 1, 1, j, me, -2, *own))
                    if len(out) > 8000 or r == len(x) - 1:
                        cols = list(zip(*out, strict=True))
                        cell = _cell_key(*[np.array(c, np.int64) for c in cols[:6]])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(cell), *[pa.array(c, pa.int32()) for c in cols[:7]],
                             pa.array(cols[7], pa.int64()), pa.array(cols[8], pa.int64()), pa.array(cols[9], pa.binary())],
                            names=["cell", "dim", "block", "slab", "guest", "x", "y", "role", "cls", "n", "raw"])
                        out = []
    return run


def _cell_key(*cols: np.ndarray) -> np.ndarray:
    """Shuffle key of a cell; cells that should share one are told apart later."""
    h = np.zeros(len(cols[0]), np.uint64)
    for c in cols:
        h = C.mix64(h * np.uint64(31) + c.view(np.uint64) + np.uint64(1))
    return h.view(np.int64)


def _cells(t: pa.Table) -> Iterator[pa.Table]:
    _, inv = np.unique(np.stack([t[c].to_numpy() for c in ("dim", "block", "slab", "guest", "x", "y")]), axis=1, return_inverse=True)
    inv = inv.reshape(-1)
    for k in range(int(inv.max()) + 1):
        yield t if not inv.any() else t.filter(pa.array(inv == k))


def _verified(a: np.ndarray, b: np.ndarray, block: int, budgets: list, cosine: float, same: bool):
    """Index pairs (row of a, row of b) linked in this block first."""
    lo, hi, budget = budgets[block]
    na, nb = (a[:, lo:hi] ** 2).sum(1), (b[:, lo:hi] ** 2).sum(1)
    for i in range(0, len(a), ROWS):
        for j in range(i if same else 0, len(b), COLS):
            d = na[i:i + ROWS, None] + nb[None, j:j + COLS] - 2 * (a[i:i + ROWS, lo:hi] @ b[j:j + COLS, lo:hi].T)
            p, q = np.nonzero(d <= budget + SLACK)
            p, q = p + i, q + j
            if same:
                p, q = p[p < q], q[p < q]
            for s in range(0, len(p), 1 << 16):
                u, v = p[s:s + (1 << 16)], q[s:s + (1 << 16)]
                ok = (a[u] * b[v]).sum(1) >= cosine
                u, v = u[ok], v[ok]
                diff = (a[u] - b[v]) ** 2
                # the same sums of the same numbers in every task: found first in exactly one block
                first = np.full(len(u), -1)
                for k, (x, y, t) in reversed(list(enumerate(budgets))):
                    first[diff[:, x:y].sum(1) <= t + SLACK / 2] = k
                yield u[first == block], v[first == block]


def _link_cells(block_dims: int, cosine: float):
    def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in (cell for _, rows in C.key_runs(batches, "cell") for cell in _cells(rows)):
            dim, block, same = t["dim"][0].as_py(), t["block"][0].as_py(), t["guest"][0].as_py() == 0
            x = np.frombuffer(b"".join(t["raw"].to_pylist()), float).reshape(-1, dim)
            cls, n, role = t["cls"].to_numpy(), t["n"].to_numpy(), t["role"].to_numpy()
            if same:
                # one chunk with itself, or two chunks with each other
                left = role == t["x"][0].as_py()
                own = t["x"][0].as_py() == t["y"][0].as_py()
                left, right = (np.flatnonzero(left),) * 2 if own else (np.flatnonzero(left), np.flatnonzero(~left))
            else:
                own = False
                left, right = np.flatnonzero(role == -1), np.flatnonzero(role == -2)
            budgets = _budgets(dim, block_dims, cosine)
            links = np.zeros(len(cls), np.int64)
            held: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            a, b = x[left], x if own else x[right]
            for u, v in _verified(a, a if own else b, block, budgets, cosine, own):
                u, v = left[u], right[v]
                np.add.at(links, u, n[v])
                np.add.at(links, v, n[u])
                held.append((cls[u], cls[v]))
                size += len(u)
                if size > EDGES:
                    held = [forest(*(np.concatenate(c) for c in zip(*held, strict=True)))]
                    size = len(held[0][0])
            some = np.flatnonzero(links)
            if len(some):
                yield out(0, cls[some], links[some])
                yield out(1, *forest(*(np.concatenate(c) for c in zip(*held, strict=True))))
    return run


def embedding_dedup(vectors: DataFrame, cosine: float = 0.9, block_dims: int = 16, seed: int = 11) -> DataFrame:
    """``vectors`` (vec_id, embedding) -> vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    C.small_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    inf = float("inf")
    sound = F.coalesce(F.size("vec") > 0, F.lit(False)) & F.coalesce(
        F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < inf)) & F.exists("vec", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("sound", sound)
    classes = C.materialize(
        rows.where("sound").groupBy("vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
        # a class without any id gets a number below all that ids give
        .select(F.coalesce("least", -1 - F.pmod(F.xxhash64("vec"), F.lit((1 << 62) - 1))).alias("cls"), "least", "n", "vec"),
        "vector-classes")
    slim = classes.select("cls", "n", "vec")
    sizes = slim.mapInArrow(C.tidy(_count_slabs(seed, block_dims, cosine)), "dim int, block int, slab int, n long") \
        .groupBy("dim", "block", "slab").agg(F.sum("n").alias("n")).collect()
    parts = {(r["dim"], r["block"], r["slab"]): -(-r["n"] // CHUNK) for r in sizes}
    cells = slim.mapInArrow(C.tidy(_deal(seed, block_dims, cosine, parts)),
                            "cell long, dim int, block int, slab int, guest int, x int, y int, role int, cls long, n long, raw binary")
    found = C.materialize(C.by_key(cells, "cell").mapInArrow(C.tidy(_link_cells(block_dims, cosine)), "kind int, a long, b long"), "vector-links")
    C.release(spark)
    links = found.where("kind = 0").groupBy(F.col("a").alias("cls")).agg(F.sum("b").alias("links"))
    comp = components(found.where("kind = 1").select("a", "b"))
    placed = classes.join(links, "cls", "left").join(comp, F.col("cls") == comp["id"], "left") \
        .select("vec", "least", "cls", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("component_id", "cls").alias("root"))
    # the smallest real id of a component; classes without ids have negative numbers of their own
    roots = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(roots, "root").select("vec", "n_links", "component_id")
    linked = rows.where("sound").join(named, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("vec_id", "n_links", "component_id",
                                      F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
