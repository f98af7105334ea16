import itertools
import random
import zlib

from pyspark.sql import functions as F

from envspark.llm import resharding as M


def test_flow_is_cheapest():
    rng = random.Random(4)
    for _ in range(60):
        n, m = rng.randrange(1, 4), rng.randrange(1, 4)
        supply = [rng.randrange(0, 4) for _ in range(n)]
        cap = M.equal_capacities(sum(supply) + rng.randrange(0, 2), m)
        price = [[rng.randrange(0, 5) for _ in range(m)] for _ in range(n)]
        flow = M.min_cost_flow(supply, cap, lambda i, j, price=price: price[i][j])
        assert [sum(r) for r in flow] == supply and all(sum(c) <= k for c, k in zip(zip(*flow, strict=True), cap, strict=True))
        units = [i for i, s in enumerate(supply) for _ in range(s)]
        best = min((sum(price[i][j] for i, j in zip(units, to, strict=True)) for to in itertools.product(range(m), repeat=len(units))
                    if all(to.count(j) <= cap[j] for j in range(m))), default=0)
        assert sum(price[i][j] * flow[i][j] for i in range(n) for j in range(m)) == best


def test_moves_least_bytes():
    flow = M.min_cost_flow([100, 60, 20], M.equal_capacities(180, 4))
    assert sum(flow[i][i] for i in range(3)) == 45 + 45 + 20


def docs_of(frame, n=900, seed=1):
    rng = random.Random(seed)
    rows = [(i, "é" * rng.randrange(0, 200)) for i in range(n)]
    rows += [(None, None), (None, "n"), (3, "dup"), (3, "dup"), (3, "dup"), (n + 5, "z" * 9000)]
    return rows, frame(rows)


def test_every_row_once_near_equal_and_gapless(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 10)
    rows, df = docs_of(frame)
    old = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    out = M.reshard(df, str(tmp_path / "shards"), 8, old).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted(rows, key=repr)
    by = {}
    for r in out:
        assert r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        by.setdefault(r.shard, []).append(r)
    sizes = {s: sum(r.size for r in rs) for s, rs in by.items()}
    assert set(by) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 9000
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    stay = sum(r.size for r in out if r.old == r.shard)
    total = sum(sizes.values())
    supply = {}
    for r in out:
        supply[r.old] = supply.get(r.old, 0) + r.size
    least = sum(min(supply.get(j, 0), total // 8) for j in range(8))
    assert stay >= least - 3000
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)


def test_rewrite_touches_only_affected_shards(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 10)
    rows = [(s, 100 * s + i, "x" * 9) for s, n in ((0, 40), (1, 20), (2, 30)) for i in range(n)]
    src, dst = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame(rows, "shard int, doc_id long, text string").write.partitionBy("shard").parquet(src)
    where = M.rewrite(spark, src, dst, 3)
    assert where == {0: f"{dst}/shard=0", 1: f"{dst}/shard=1", 2: f"{src}/shard=2"}
    parts = {s: {r.doc_id for r in spark.read.parquet(p).collect()} for s, p in where.items()}
    assert {s: len(p) for s, p in parts.items()} == {0: 30, 1: 30, 2: 30}
    assert set().union(*parts.values()) == {d for _, d, _ in rows}
    assert {d for s, d, _ in rows if s == 1} <= parts[1]


def test_digest_reader_leaves_texts_in_the_files(spark, frame, tmp_path):
    """Without its text column, the result's plan reads and moves no text."""
    _, df = docs_of(frame, n=50)
    out = M.reshard(df, str(tmp_path / "shards"), 3, F.pmod(F.xxhash64("doc_id"), F.lit(2))).drop("text")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "size#" in plan and "text#" not in plan


def test_empty_and_extra_columns(spark, tmp_path):
    schema = "doc_id long, text string, shard string, size int, old int"
    old = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    assert M.reshard(spark.createDataFrame([], schema), str(tmp_path / "e"), 4, old).count() == 0
    one = M.reshard(spark.createDataFrame([(1, "a", "s", 1, 2)], schema), str(tmp_path / "o"), 4, old).collect()
    assert [(r.doc_id, r.size, r.slot) for r in one] == [(1, 2, 0)]
