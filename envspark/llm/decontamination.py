"""Benchmark decontamination by greedy string tiling (operator 4).

Texts and benchmark items are token sequences: lower-cased runs of Unicode
letters, digits and marks, and in scripts written without spaces each letter
with its marks.  Karp-Rabin hashes of every ``min_match``
consecutive tokens of the items are the seeds; document windows that share a
seed are extended to maximal matches.  Greedy tiling then takes the longest
match first and marks its tokens in both texts; what later matches share with
marked tokens is cut off, and tiles below ``min_match`` are dropped.  Tiles may
come in any order, so reordered passages count as well.  A document is
contaminated if the tiles cover at least ``threshold`` of an item's tokens or,
where ``min_tile`` is given, if one tile has that many tokens: a long item is
then caught by a verbatim part that is a small share of it.

The benchmark is taken in blocks of about ``BLOCK_BYTES`` (by hash; the number
follows from its measured size).  Each block is broadcast in its turn and every
document meets every block in one pass without a shuffle, so neither a hot
passage nor a hot item gathers rows anywhere.

Defined results: null text or no token: coverage 0; null items and items
without a token never match; an item of fewer tokens than ``min_match`` matches
a text of exactly its tokens (inside a longer text it is too short to judge);
repeated items count once each; an empty benchmark leaves all documents clean; null and
repeated ids are fine; extra columns are ignored or kept on request.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.llm import common as C

BLOCK_BYTES = 4 << 20
TEXT_STEP = 1 << 20
FILTER_BITS = 20
_SEPARATES = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_GAP, _WORD, _SOLO, _MARK = range(4)
_PARTS = regex.compile(r"(\p{M}+)|([[\p{L}\p{N}]&&[\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Yi}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
                       r"\p{Tai_Le}\p{New_Tai_Lue}\p{Tai_Tham}\p{Tai_Viet}\p{Balinese}\p{Javanese}ー々〆]]+)|([\p{L}\p{N}]+)", regex.V1)


@functools.cache
def _kinds() -> np.ndarray:
    """What every code point is: no part of a token, part of a word, a token
    of its own, or a mark of the character before it."""
    out = np.full(0x110000, _GAP, np.uint8)
    # a space stands for each surrogate, so that places are code points
    for m in _PARTS.finditer("".join(" " if 0xD800 <= c < 0xE000 else chr(c) for c in range(0x110000))):
        out[m.start():m.end()] = (_MARK, _SOLO, _WORD)[m.lastindex - 1]
    return out


def _code_points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code point, number of bytes) of the non-ASCII characters at ``at``."""
    lead = data[at].astype(np.int64)
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    cp = lead & (0x7F >> size)
    for j in range(1, 4):
        more = size > j
        cp[more] = cp[more] << 6 | data[at[more] + j] & 0x3F
    return cp, size


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts, index of each text's first token + total)."""
    raw = [x.lower().encode() for x in texts]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    gap = _SEPARATES[data]
    at = np.flatnonzero(data >= 0xC0)
    if not len(at):
        starts, ends, first = C.words_of(data, offs, gap)
        return C.span_hashes(data, starts, ends), first
    cp, size = _code_points(data, at)
    kind = _kinds()[cp]
    none = kind == _GAP
    gap[C.ragged(at[none], size[none])] = True
    border = np.zeros(len(data) + 1, bool)
    border[offs] = True
    # a mark belongs to the character just before it, in the same text
    joins = np.zeros(len(at), bool)
    joins[1:] = (kind[1:] == _MARK) & (at[:-1] + size[:-1] == at[1:]) & ~border[at[1:]]
    solo = (kind == _SOLO)[np.maximum.accumulate(np.where(joins, 0, np.arange(len(at))))]
    border[at[kind == _SOLO]] = True
    border[(at + size)[solo & ~np.append(joins[1:], False)]] = True
    starts, ends, _ = C.words_of(data, np.flatnonzero(border), gap)
    return C.span_hashes(data, starts, ends), np.searchsorted(starts, offs)


class Seeds(NamedTuple):
    ids: list                  # item ids of the block
    tokens: np.ndarray         # token hashes of all items
    first: np.ndarray          # first token of each item + total
    hashes: np.ndarray         # sorted seed hashes
    at: np.ndarray             # token position of each seed
    item: np.ndarray           # item of each seed
    some: np.ndarray           # which low hash bits occur
    short: dict                # token hashes of items below min_match: their numbers


def seeds_of(items: list[tuple], min_match: int) -> Seeds:
    tokens, first = tokens_of([t for _, t in items])
    at = C.inside(first, min_match)
    h = C.window_hashes(tokens, min_match)[at] if len(at) else np.zeros(0, np.uint64)
    order = np.argsort(h, kind="stable")
    some = np.zeros(1 << FILTER_BITS, bool)
    some[(h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
    item = np.searchsorted(first, at, side="right") - 1
    short: dict[bytes, list[int]] = {}
    for i in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < min_match)).tolist():
        short.setdefault(tokens[first[i]:first[i + 1]].tobytes(), []).append(i)
    return Seeds([i for i, _ in items], tokens, first, h[order], at[order], item[order], some, short)


def _maximal(p: np.ndarray, q: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, item position, text position) from the seed
    pairs of one item and one text: runs along their diagonals."""
    order = np.lexsort((p, q - p))
    p, q = p[order], q[order]
    d = q - p
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)]))
    size = np.diff(np.append(new, len(p))) + min_match - 1
    return list(zip(size.tolist(), p[new].tolist(), q[new].tolist(), strict=True))


def tile(matches: list[tuple[int, int, int]], n_item: int, min_match: int) -> int:
    """Item tokens covered by greedy tiling, longest match first (then the
    earliest in the item, then in the text)."""
    mine = np.zeros(n_item, bool)
    theirs: set[int] = set()
    by_size: dict[int, list[tuple[int, int]]] = {}
    for size, p, q in matches:
        by_size.setdefault(size, []).append((p, q))
    size = max(by_size, default=0)
    while size >= min_match:
        for p, q in sorted(by_size.pop(size, ())):
            free = [not mine[p + k] and q + k not in theirs for k in range(size)]
            if all(free):
                mine[p:p + size] = True
                theirs.update(range(q, q + size))
                continue
            k = 0
            while k < size:
                run = k
                while run < size and free[run]:
                    run += 1
                if run - k >= min_match:
                    by_size.setdefault(run - k, []).append((p + k, q + k))
                k = run + 1
        size = max(by_size, default=0)
    return int(mine.sum())


def coverages(texts: list[str], s: Seeds, min_match: int) -> list[list[tuple[int, float, int]]]:
    """Per text: (item number, share of the item's tokens covered by tiles,
    tokens of the longest tile)."""
    out: list[list[tuple[int, float, int]]] = [[] for _ in texts]
    tokens, first = tokens_of(texts)
    for d in np.flatnonzero(np.diff(first) < min_match).tolist() if s.short else ():
        out[d] += [(i, 1.0, int(first[d + 1] - first[d])) for i in s.short.get(tokens[first[d]:first[d + 1]].tobytes(), ())]
    h = C.window_hashes(tokens, min_match)
    if not len(h) or not len(s.hashes):
        return out
    near = np.flatnonzero(s.some[(h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
    lo, hi = np.searchsorted(s.hashes, h[near]), np.searchsorted(s.hashes, h[near], side="right")
    near, lo, n = near[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
    doc = np.searchsorted(first, near, side="right") - 1
    whole = near + min_match <= first[doc + 1]                # windows that lie in one text
    near, lo, n, doc = near[whole], lo[whole], n[whole], doc[whole]
    for d in np.unique(doc):
        a, b = np.searchsorted(doc, [d, d + 1])
        q = np.repeat(near[a:b] - first[d], n[a:b])
        k = C.ragged(lo[a:b], n[a:b])
        item, p = s.item[k], s.at[k]
        order = np.argsort(item, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(item[order])) + 1):
            i = int(item[part[0]])
            size = int(s.first[i + 1] - s.first[i])
            found = _maximal(p[part] - int(s.first[i]), q[part], min_match)
            # the longest match is marked first, so it is the longest tile
            out[d].append((i, tile(found, size, min_match) / size, max(n for n, _, _ in found)))
    return out


def benchmark_blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in hash blocks of about ``BLOCK_BYTES`` of text each."""
    items = benchmark.where("text IS NOT NULL").select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text") + 100)).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.5,
                  keep: tuple[str, ...] = ("doc_id",), min_tile: int | None = None) -> DataFrame:
    """Columns ``keep``, ``coverage`` (of the best covered item), ``items``
    (ids of the items covered to ``threshold`` or by a tile of ``min_tile``
    tokens) and ``contaminated``."""
    spark = docs.sparkSession
    C.small_batches(spark)
    ids = benchmark.schema["item_id"].dataType
    held = [c for c in keep if c != "text"]
    cur = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(held)], F.col("text").alias("_text"),
                      F.lit(0.0).alias("coverage"), F.array().cast(f"array<{ids.simpleString()}>").alias("items"))
    n = len(held)

    def pass_over(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s: Seeds = shared.value
            for b in batches:
                texts = [x or "" for x in b.column(n).to_pylist()]
                best, hits = b.column(n + 1).to_pylist(), b.column(n + 2).to_pylist()
                lo, size = 0, 0
                for i, x in enumerate(texts):
                    size += len(x)
                    if size >= TEXT_STEP or i == len(texts) - 1:
                        for d, found in enumerate(coverages(texts[lo:i + 1], s, min_match), lo):
                            best[d] = max([best[d], *(c for _, c, _ in found)])
                            hits[d] = hits[d] + [s.ids[k] for k, c, n_tile in found
                                                 if c >= threshold or min_tile is not None and n_tile >= min_tile]
                        lo, size = i + 1, 0
                yield pa.RecordBatch.from_arrays([*b.columns[:n + 1], pa.array(best, pa.float64()), pa.array(hits, b.column(n + 2).type)],
                                                 names=b.schema.names)
        return run

    for block in benchmark_blocks(benchmark):
        items = sorted(((r["item_id"], r["text"]) for r in block.collect()), key=lambda r: (r[0] is not None, r[0], r[1]))
        shared = spark.sparkContext.broadcast(seeds_of(items, min_match))
        cur = cur.mapInArrow(C.tidy(pass_over(shared)), cur.schema)
    return cur.select(*[F.col("_text" if c == "text" else f"_k{held.index(c)}").alias(c) for c in keep], "coverage", "items",
                      (F.size("items") > 0).alias("contaminated"))
