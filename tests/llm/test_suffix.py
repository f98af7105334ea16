import random
from collections import Counter

import numpy as np
import pytest

import envspark.llm.suffix_dedup as M


def brute(texts, width):
    """Removed byte positions of every text."""
    raw = [(t or "").encode() for t in texts]
    n = Counter(r[i:i + width] for r in raw for i in range(len(r) - width + 1))
    out = []
    for r in raw:
        gone = set()
        for i in range(len(r) - width + 1):
            if n[r[i:i + width]] > 1:
                gone.update(range(i, i + width))
        out.append(gone)
    return raw, out


def spans_of(gone):
    out = []
    for i in sorted(gone):
        if out and out[-1][1] == i:
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1])
    return [tuple(s) for s in out]


def corpus(rng, n):
    letters = "abcdefgh éß\n"
    texts = [None, "", "short", "x" * 39, "x" * 40, "y" * 41, "=" * 700, "ab" * 200, "\x00" * 90]
    passage = "".join(rng.choices(letters, k=120))
    for i in range(n):
        t = "".join(rng.choices(letters, k=rng.randrange(0, 400)))
        if i % 3 == 0:
            cut = rng.randrange(0, 80)
            t = t[:50] + passage[cut:cut + rng.randrange(20, 120)] + t[50:]
        if i % 5 == 0 and len(texts) > 12:
            base = list(texts[rng.randrange(9, len(texts))])
            for _ in range(rng.randrange(0, 4)):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(letters)
            t = "".join(base)
        texts.append(t)
    return texts


@pytest.mark.parametrize("crowd,block", [(4000, 1 << 20), (2, 1 << 20), (2, 300), (4000, 300)])
def test_against_brute_force(spark, frame, monkeypatch, crowd, block):
    monkeypatch.setattr(M, "CROWD", crowd)
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "STEP", 7)
    monkeypatch.setattr(M, "SEGMENT", 2000)
    rng = random.Random(crowd + block)
    texts = corpus(rng, 120)
    rows = list(enumerate(texts)) + [(None, texts[30]), (None, "".join(rng.choices("pqr", k=100))), (5, texts[40]), (5, texts[40])]
    raw, gone = brute([t for _, t in rows], 40)
    got = sorted(((r.doc_id is None, r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept))
                  for r in M.suffix_dedup(frame(rows), width=40).collect()), key=repr)
    want = sorted(((d is None, d, len(r), len(g), spans_of(g), bytes(b for i, b in enumerate(r) if i not in g))
                   for (d, _), r, g in zip(rows, raw, gone, strict=True)), key=repr)
    assert got == want


def test_matching_statistics():
    rng = np.random.default_rng(2)
    for n, k in [(1, 2), (2, 1), (60, 2), (200, 3), (200, 1), (300, 20)]:
        s = rng.integers(0, k, n).astype(np.int16)
        if n > 100:
            s[50:90] = s[:40]
        text = bytes(s.astype(np.uint8))
        sa = M.suffix_array(s)
        assert sa.tolist() == sorted(range(n), key=lambda i: text[i:])

        def common(i, j, text=text, n=n):
            m = 0
            while max(i, j) + m < n and text[i + m] == text[j + m]:
                m += 1
            return m
        want = [max([common(i, j) for j in range(n) if j != i], default=0) for i in range(n)]
        assert M.RunIndex(s).matching_statistics().tolist() == want


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, runs int, id string")
    assert M.suffix_dedup(empty).count() == 0
    rows = [(1, "k" * 500, 3, "z"), (2, "k" * 399, 3, "z")]
    got = {r.doc_id: r.n_removed for r in M.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string, runs int, id string")).collect()}
    assert got == {1: 500, 2: 0}


def test_pieces_of_a_shared_passage_do_not_gather(spark, frame, monkeypatch):
    monkeypatch.setattr(M, "CROWD", 30)
    monkeypatch.setattr(M, "STEP", 7)
    rng = random.Random(6)
    core, longer = ("".join(rng.choices("abcdefgh", k=k)) for k in (37, 90))
    texts = ["".join(rng.choices("pqrstuv", k=30)) + (core if i % 2 else longer) + "".join(rng.choices("pqrstuv", k=30)) for i in range(300)]
    largest, by_key = [], M.C.by_key

    def watched(df, key, n=None):
        largest.append(df.groupBy(key).count().agg({"count": "max"}).first()[0] or 0)
        return by_key(df, key, n)
    monkeypatch.setattr(M.C, "by_key", watched)
    raw, gone = brute(texts, 40)
    got = {r.doc_id: ([tuple(s) for s in r.spans], bytes(r.kept)) for r in M.suffix_dedup(frame(list(enumerate(texts))), width=40).collect()}
    assert got == {i: (spans_of(g), bytes(b for k, b in enumerate(r) if k not in g)) for i, (r, g) in enumerate(zip(raw, gone, strict=True))}
    assert any(gone) and max(largest) <= 30, largest


@pytest.mark.parametrize("bits", [21, 0])
def test_suffix_array_and_common_prefixes(monkeypatch, bits):
    # 21: two ranks and the place are sorted as one value; 0: as in texts too long for that
    monkeypatch.setattr(M, "RANK_BITS", bits)
    rng = np.random.default_rng(11)
    for n in (1, 2, 3, 5, 9, 40, 300):
        for kinds in (1, 2, 200):
            s = rng.integers(0, kinds, n).astype(np.int16)
            sa = M.suffix_array(s)
            assert sa.tolist() == sorted(range(n), key=lambda i, s=s: s[i:].tolist())
            a, b = rng.integers(0, n, 30), rng.integers(0, n, 30)

            def common(i, j, s=s):
                return next((c for c in range(len(s) - max(i, j)) if s[i + c] != s[j + c]), len(s) - max(i, j))
            assert M.RunIndex._common(s, a, b).tolist() == [common(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
