import math
import random

import pytest

import envspark.llm.embedding_dedup as M


def brute(rows, cosine):
    def ok(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    adj = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if ok(a) and ok(b) and len(a) == len(b):
                c = sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
                if c >= cosine:
                    adj[i].append(j)
                    adj[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in adj[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        comp = min(ids) if ids else None
        out.append((rows[i][0], len(adj[i]), comp, rows[i][0] is not None and rows[i][0] == comp))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk,dims", [(1 << 14, 16), (20, 16), (7, 4), (1 << 14, 64)])
def test_against_brute_force(spark, monkeypatch, chunk, dims):
    monkeypatch.setattr(M, "CHUNK", chunk)
    monkeypatch.setattr(M, "ROWS", 16)
    monkeypatch.setattr(M, "COLS", 24)
    rng = random.Random(chunk + dims)
    rows = []
    for c in range(14):
        base = [rng.gauss(0, 1) for _ in range(24)]
        for _ in range(rng.randrange(1, 30)):
            rows.append([x + rng.gauss(0, 0.33) for x in base])
    rows = [(i, v) for i, v in enumerate(rows)]
    rows += [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] + [1.0] * 23), (904, [float("inf")] * 24), (905, [None] * 24),
             (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, rows[3][1]), (None, [5.0, -1.0]), (None, [5.0, -1.1]), (3, rows[3][1]), (3, rows[3][1]),
             (908, [x * 1e200 for x in rows[5][1]])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, n int, cls string")
    got = sorted((tuple(r) for r in M.embedding_dedup(df, 0.9, block_dims=dims).collect()), key=repr)
    scaled = [(i, [x / 1e200 for x in v] if i == 908 else v) for i, v in rows]
    assert got == brute(scaled, 0.9)


def test_empty(spark):
    assert M.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
