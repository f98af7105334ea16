"""Minimum-cost-flow resharding (operator 5).

From the byte sizes of the old shards and the capacities of the new ones, a
minimum-cost flow gives the transfers that move the fewest bytes (staying in
the shard of the same number is free, every other move costs its bytes, or
what a cost function says).  The flow is solved on shard totals, a few dozen
numbers.  It is carried out on blocks of rows: the blocks of an old shard lie
one after the other, the flow cuts that line, whole blocks go where they fall,
and only the blocks that a cut hits are divided, row by row.

Rows move once: they are dealt by block, numbered, and written to the folder
of their new shard.  ``rewrite`` does the same to a dataset on disk and
touches only the shards that give or take something.

Law ``bytes``: shard sizes are equal up to the rows at the cuts.

Defined results: null text has no bytes (size 1); null and repeated ids are
fine, rows equal in id and text are interchangeable; more shards than rows
leave shards empty; extra columns are ignored; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from envspark.llm import common as C

BLOCK_ROWS = 2048


def _moves_cost(i: int, j: int) -> int:
    return 0 if i == j else 1


def min_cost_flow(supply: list[int], capacity: list[int], cost: Callable[[int, int], int] = _moves_cost) -> list[list[int]]:
    """Units sent from each supply to each capacity at least total cost:
    shortest augmenting paths in the residual network.  The capacities must
    hold all supplies."""
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("capacities do not hold the supply")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    price = [[cost(i, j) for j in range(m)] for i in range(n)]
    while any(left):
        far = [0 if left[i] else None for i in range(n)] + [None] * m
        via = [-1] * (n + m)
        for _ in range(n + m):
            changed = False
            for i in range(n):
                for j in range(m):
                    if far[i] is not None and (far[n + j] is None or far[i] + price[i][j] < far[n + j]):
                        far[n + j], via[n + j], changed = far[i] + price[i][j], i, True
                    if flow[i][j] and far[n + j] is not None and (far[i] is None or far[n + j] - price[i][j] < far[i]):
                        far[i], via[i], changed = far[n + j] - price[i][j], n + j, True
            if not changed:
                break
        end = min((j for j in range(m) if room[j] and far[n + j] is not None), key=lambda j: (far[n + j], j))
        path = [n + end]
        while via[path[-1]] >= 0:
            path.append(via[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end])
        for a, b in zip(path[:-1], path[1:], strict=True):
            if a >= n:                                   # back along a used edge
                amount = min(amount, flow[b][a - n])
        for a, b in zip(path[:-1], path[1:], strict=True):
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[path[0]] -= amount
        room[end] -= amount
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def _segments(flow: list[list[int]]) -> list[tuple[int, int, int, int]]:
    """(old, new, from, to): the stretches of each old shard's line; what
    stays comes first."""
    out = []
    for i, row in enumerate(flow):
        at = 0
        for j in sorted((j for j, x in enumerate(row) if x), key=lambda j: (j != i, j)):
            out.append((i, j, at, at + row[j]))
            at += row[j]
    return out


def _sized(docs: DataFrame, old_shard) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                       old_shard.cast("int").alias("old"), C.row_key("doc_id", "text").alias("_key"))


def _blocked(rows: DataFrame, parts: int) -> DataFrame:
    """Block of a row: old shard, hash part, binary order of size."""
    return rows.withColumn("part", F.pmod("_key", F.lit(parts)).cast("int")) \
        .withColumn("grade", F.floor(F.log2(F.col("size").cast("double"))).cast("int"))


def plan_transfers(blocks: DataFrame, shards: int, cost: Callable[[int, int], int] = _moves_cost) -> list[tuple[int, int, int, int]]:
    """Segments (old, new, from, to) in bytes for ``blocks`` (old, bytes)."""
    totals = {r["old"]: r["b"] for r in blocks.groupBy("old").agg(F.sum("bytes").alias("b")).collect()}
    supply = [totals.get(i, 0) for i in range(max(totals, default=-1) + 1)]
    return _segments(min_cost_flow(supply, equal_capacities(sum(supply), shards), cost))


def _placed(rows: DataFrame, blocks: DataFrame, segments: list[tuple[int, int, int, int]]) -> DataFrame:
    """``rows`` with the place of their block in the old shard's line, their
    number in the block (rn), and their new shard."""
    cuts = rows.sparkSession.createDataFrame(segments or [(0, 0, 0, 0)], "old int, shard int, lo long, hi long")
    # part by part, so that what moves is a cross-section of the old shard; small rows last, where cuts fall finest
    line = Window.partitionBy("old").orderBy("part", F.desc("grade"))
    at = blocks.withColumn("at", F.sum("bytes").over(line) - F.col("bytes")).withColumn("place", F.row_number().over(line))
    # the segments are a few dozen rows: at most old + new shards
    cut = at.join(F.broadcast(cuts), "old").where((F.col("at") < F.col("hi")) & (F.col("at") + F.col("bytes") > F.col("lo"))) \
        .groupBy("old", "part", "grade", "at", "place").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "shard"))).alias("segs"))
    inside = Window.partitionBy("old", "part", "grade").orderBy(F.desc("size"), "doc_id", "_key")
    lined = rows.withColumn("rn", F.row_number().over(inside)) \
        .withColumn("run", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(cut, ["old", "part", "grade"])
    middle = F.col("at") + F.col("run") - (F.col("size") / 2)
    chosen = F.filter("segs", lambda s: (s["lo"] <= middle) & (middle < s["hi"]))
    return lined.withColumn("shard", F.coalesce(F.get(chosen, 0)["shard"], F.element_at("segs", -1)["shard"]))


def _blocks(rows: DataFrame) -> DataFrame:
    return C.materialize(rows.groupBy("old", "part", "grade").agg(F.sum("size").alias("bytes")), "blocks")


def reshard(docs: DataFrame, path: str, shards: int, old_shard,
            cost: Callable[[int, int], int] = _moves_cost) -> DataFrame:
    """Write ``docs`` (doc_id, text) under ``path`` in folders ``shard=N`` of
    near equal size; ``old_shard`` is the column of their present shard
    (0, 1, ...).  Returns doc_id, text, size, text_crc32 (unsigned, of the
    UTF-8 text), old, shard, slot as written, slots gapless from 0 in every
    shard.  Size and checksum lie in the files beside the text, so that a
    reader that takes only them joins slots without moving texts again."""
    spark = docs.sparkSession
    rows = _sized(docs, old_shard)
    count, most = rows.agg(F.count(F.lit(1)), F.max("old")).first()
    rows = _blocked(rows, max(1, count // (BLOCK_ROWS * ((most or 0) + 1))))
    blocks = _blocks(rows)
    _placed(rows, blocks, plan_transfers(blocks, shards, cost)) \
        .select("doc_id", "text", "size", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
                "old", "place", "rn", "shard").write.mode("overwrite").partitionBy("shard").parquet(path)
    C.release(spark)
    files = spark.read.schema("doc_id long, text string, size long, text_crc32 long, old int, place int, rn int, shard int").parquet(path)
    # slots: blocks follow each other within a shard, rows within their block
    mine = files.groupBy("shard", "old", "place").agg(F.count(F.lit(1)).alias("n"), F.min("rn").alias("first"))
    order = Window.partitionBy("shard").orderBy("old", "place")
    offset = mine.withColumn("base", F.sum("n").over(order) - F.col("n")).drop("n")
    return files.join(offset, ["shard", "old", "place"]) \
        .select("doc_id", "text", "size", "text_crc32", "old", "shard", (F.col("base") + F.col("rn") - F.col("first")).cast("long").alias("slot"))


def rewrite(spark: SparkSession, source: str, target: str, shards: int,
            cost: Callable[[int, int], int] = _moves_cost) -> dict[int, str]:
    """Reshard the dataset ``source`` (doc_id, text in folders shard=N) to
    ``shards`` shards.  Only shards that give or take rows are read and
    rewritten, to ``target``; returns where each new shard lies now."""
    old = spark.read.parquet(source)
    sizes = _sized(old, F.col("shard")).groupBy("old").agg(F.sum("size").alias("bytes"))
    segments = plan_transfers(sizes, shards, cost)
    touched = sorted({s for i, j, _, _ in segments if i != j for s in (i, j)})
    if touched:
        rows = _sized(old.where(F.col("shard").isin(touched)), F.col("shard"))
        rows = _blocked(rows, max(1, rows.count() // (BLOCK_ROWS * len(touched))))
        _placed(rows, _blocks(rows), [s for s in segments if s[0] in touched]) \
            .select("doc_id", "text", "shard").write.mode("overwrite").partitionBy("shard").parquet(target)
    return {j: f"{target if j in touched else source}/shard={j}" for j in range(shards)}
