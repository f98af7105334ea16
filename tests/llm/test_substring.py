import random

import pytest

import envspark.llm.substring_dedup as M


def brute(rows, width):
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - width + 1):
            key = tuple(w[i:i + width])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i:i + width])] < d:
                gone.update(range(i, i + width))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batch", [1 << 20, 200])
def test_against_brute_force(spark, frame, monkeypatch, batch):
    monkeypatch.setattr(M, "BATCH_TEXT", batch)
    rng = random.Random(batch)
    vocab = ["a", "b", "é", "long-word", "c d"]
    rows = [(0, None), (1, ""), (2, " \t\x0b\x0c\r\n"), (3, "a b c"), (4, "a " * 300), (-7, "b " * 40), (9, "\x1c a b")]
    hot = " ".join(rng.choices(vocab, k=30))
    for i in range(10, 150):
        t = rng.choice([" ", "\n", "  "]).join(rng.choices(vocab, k=rng.randrange(0, 60)))
        rows.append((i, t + " " + hot + " z" if i % 3 == 0 else t))
    rows += [(None, rows[20][1]), (None, hot), (30, rows[30][1]), (31, rows[30][1]), (500, " ".join(rng.choices(vocab, k=30000)))]
    rng.shuffle(rows)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in M.substring_dedup(frame(rows), width=5).collect()), key=repr)
    assert got == brute(rows, 5)


def test_windows_of_one_hash_are_told_apart(spark, frame, monkeypatch):
    """With 64-bit hashes cut to three bits, the tags alone decide."""
    whole = M._hash_batch

    def weak(data, offs, width):
        h, *rest = whole(data, offs, width)
        return h & M.np.uint64(7), *rest
    monkeypatch.setattr(M, "_hash_batch", weak)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["a", "b", "c"], k=rng.randrange(0, 40)))) for i in range(60)]
    n = 4

    def marks(batch_rows):
        import numpy as np
        import pyarrow as pa
        batches = [pa.RecordBatch.from_pydict({"_id": pa.array([d for d, _ in part], pa.int64()), "_key": pa.array([d for d, _ in part], pa.int64()),
                                               "text": pa.array([t for _, t in part], pa.string())})
                   for part in (rows[i:i + batch_rows] for i in range(0, len(rows), batch_rows))]
        monkeypatch.setattr(M, "BATCH_TEXT", 1)
        packed = pa.Table.from_batches(list(M._windows(5, n)(iter(batches))), schema=M._SCHEMA).sort_by("bucket")
        got = set()
        for ids, _, doc, pos in (M._unpack(pa.Table.from_batches([b])) for b in M._judge(n)(iter(packed.to_batches())) if b.num_rows):
            got |= set(zip(np.asarray(ids)[doc].tolist(), pos.tolist(), strict=True))
        return got
    first, want = {}, set()
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - 4):
            if first.setdefault(tuple(w[i:i + 5]), d) < d:
                want.add((d, i))
    assert want and marks(7) == want == marks(60)


def test_buckets_follow_the_bytes(spark, frame, monkeypatch):
    """More buckets than shuffle partitions give the same rows."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["a", "b", "é"], k=rng.randrange(0, 60)))) for i in range(80)]
    monkeypatch.setattr(M, "BUCKET_BYTES", 500)
    out = M.substring_dedup(frame(rows), width=6)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()), key=repr) == brute(rows, 6)


def test_spans_are_maximal(spark, frame):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, base), (2, "x " + base + " y"), (3, base.replace("w20", "v"))]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in M.substring_dedup(frame(rows)).collect()}
    assert got == {1: [], 2: [(1, 41)], 3: [(0, 20), (21, 40)]}


def test_steps_wider_than_two_bytes():
    import numpy as np
    import pyarrow as pa
    words = [f"u{i}" for i in range(70000)] + [f"k{i}" for i in range(6)]
    batch = pa.RecordBatch.from_pydict({"_id": pa.array([2]), "_key": pa.array([9]), "text": pa.array([" ".join(words)])})
    out = pa.Table.from_batches(M._windows(5, 100000)(iter([batch])))
    ids, keys, doc, pos = M._unpack(out)
    assert set(ids) == {2} and set(keys) == {9} and sorted(pos.tolist()) == list(range(70002))
    assert np.array_equal(np.sort(doc), doc)


def test_empty_and_extra_columns(spark):
    schema = "doc_id long, text string, spans string, kept int, id long, key long"
    assert M.substring_dedup(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "p q " * 20, "s", 1, 2, 3), (2, "p q " * 20, "s", 1, 2, 3)], schema)
    assert {r.doc_id: r.n_removed for r in M.substring_dedup(df).collect()} == {1: 0, 2: 40}
