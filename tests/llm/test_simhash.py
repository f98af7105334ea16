import random

import pytest
import xxhash

from envspark.llm.simhash import fingerprints, keep_one, links, simhash_dedup
from envspark.llm.components import components


def brute_fp(text, k=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, cur = [], ""
    for c in low:
        if c in " \t\n\x0b\x0c\r":
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += c
    if cur:
        words.append(cur)
    if not words:
        return 0
    sh = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, bits):
    """{index: least index reachable}"""
    comp = list(range(len(fps)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_documents_against_brute_force(spark, frame):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)] + ["É", "ß", "ÀB"]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One"), (5, "a b c"), (6, "x y z\x0bq r")]
    for i in range(7, 120):
        if i % 3 and i > 12:
            words = rows[rng.randrange(7, i)][1].split(" ")
            words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(rng.choices(vocab, k=rng.randrange(1, 200)))))
    rows.append((200, " ".join(rng.choices(vocab, k=70000))))
    rows += [rows[20], rows[20], (None, "only here"), (None, rows[30][1])]
    df = frame(rows)
    got = {}
    for r in simhash_dedup(df).collect():
        got.setdefault((r.doc_id, r.fp), []).append(r.component_id)
    fps = [brute_fp(t) for _, t in rows]
    comp = brute_components(fps, 4)
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        assert set(got[(d, signed(fps[i]))]) == {min(ids) if ids else None}
    assert sum(map(len, got.values())) == len(rows)


@pytest.mark.parametrize("chunk", [1 << 14, 16])
def test_links_find_every_pair(spark, monkeypatch, chunk):
    import envspark.llm.simhash as M
    monkeypatch.setattr(M, "CHUNK", chunk)
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(12):
            x = base
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                x ^= 1 << b
            fps.add(x)
    fps |= {0xF0F0 | 1 << i for i in range(16, 64)}
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r.id: r.component_id for r in components(links(df)).collect()}
    comp = brute_components(fps, 4)
    for i, x in enumerate(fps):
        same = {signed(fps[j]) for j in range(len(fps)) if comp[j] == comp[i]}
        assert got.get(signed(x), signed(x)) == min(same)


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, fp string, component_id int")
    assert simhash_dedup(empty).count() == 0
    one = spark.createDataFrame([(1, "a b c d e", "z", 4)], "doc_id long, text string, fp string, least int")
    assert fingerprints(one).count() == 1 and simhash_dedup(one).first().component_id == 1


def test_keep_one_with_clashing_columns(spark):
    rows = [(1, "a b c d e f", 5, "p", 7, "r"), (2, "a b c d e f", 6, "q", 8, "s"), (3, "z y x w v u", 7, "t", 9, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key long, key string, id long, row string")
    assert sorted(tuple(r) for r in keep_one(df).collect()) == [rows[0], rows[2]]
