import random

import pytest
import regex

import envspark.llm.decontamination as M


def tokens(text):
    low = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower())
    return low.split()


def brute_cover(item, doc, least):
    """Greedy string tiling, literally: longest unmarked common run first."""
    a, b = tokens(item), tokens(doc)
    if len(a) < least:
        return 0.0
    ma, mb = [False] * len(a), [False] * len(b)
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k >= least and (best is None or k > best[0]):
                    best = (k, i, j)
        if best is None:
            return sum(ma) / len(a)
        k, i, j = best
        ma[i:i + k] = [True] * k
        mb[j:j + k] = [True] * k


@pytest.mark.parametrize("block", [4 << 20, 400])
def test_against_literal_tiling(spark, frame, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK_BYTES", block)
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(6)] + ["É"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(3, 25)))) for i in range(12)] + [(50, None), (51, ""), (52, "w1 w2"), (1, None)]
    docs = [(0, None), (1, ""), (2, "...")]
    for i in range(3, 60):
        words = rng.choices(vocab + [f"x{k}" for k in range(9)], k=rng.randrange(0, 40))
        if i % 2:
            t = items[rng.randrange(12)][1].split()
            cut = rng.randrange(len(t))
            words[5:5] = t[cut:] + ["zz"] * (i % 3) + t[:cut]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(words).upper()))
    docs += [docs[9], docs[9], (None, docs[11][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, round(r.coverage, 9), sorted(r["items"]), r.contaminated)
                  for r in M.decontaminate(frame(docs), bench, min_match=4, threshold=0.7).collect()), key=repr)
    want = []
    for d, t in docs:
        cover = {i: brute_cover(x, t, 4) for i, x in items if x}
        hits = sorted(i for i, c in cover.items() if c >= 0.7)
        want.append((d, round(max(cover.values()), 9), hits, bool(hits)))
    assert got == sorted(want, key=repr)


def test_reordered_passage_and_clean_document(spark, frame):
    item = " ".join(f"t{i}" for i in range(30))
    halves = " ".join([f"t{i}" for i in range(15, 30)] + ["filler"] * 9 + [f"t{i}" for i in range(15)])
    docs = [(1, halves), (2, " ".join(f"u{i}" for i in range(200))), (3, " ".join(f"t{i}" for i in range(12)))]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r["items"]) for r in M.decontaminate(frame(docs), bench).collect()}
    assert got == {1: (True, [7]), 2: (False, []), 3: (False, [])}


def test_parts_of_long_items(spark, frame):
    """A verbatim part of a long item counts by its own length, on both sides of the bound."""
    item = [f"t{i}" for i in range(200)]
    docs = [(1, "x " + " ".join(item[40:53]) + " y"), (2, "x " + " ".join(item[40:52]) + " y"),
            (3, " ".join(item[10:22] + ["gap"] + item[60:72] + ["gap"] + item[100:112])), (4, " ".join(item[:110])), (5, "clean text")]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "short item of six tokens only")], "item_id long, text string")
    got = {r.doc_id: r["items"] for r in M.decontaminate(frame(docs), bench, min_tile=13).collect()}
    assert got == {1: [7], 2: [], 3: [], 4: [7], 5: []}
    plain = {r.doc_id: r["items"] for r in M.decontaminate(frame(docs), bench).collect()}
    assert plain == {1: [], 2: [], 3: [], 4: [7], 5: []}


def test_empty_tables_and_kept_columns(spark, frame):
    bench = spark.createDataFrame([], "item_id long, text string")
    out = M.decontaminate(frame([(1, "a b c")]), bench, keep=("doc_id", "text", "lang"))
    assert [tuple(r) for r in out.collect()] == [(1, "a b c", None, 0.0, [], False)]
    empty = spark.createDataFrame([], "doc_id long, text string, items int, coverage string")
    full = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert M.decontaminate(empty, full).count() == 0


def literal_tokens(text):
    """Character by character: words, letters of scripts without spaces with their marks."""
    out, glue = [], False
    for c in text.lower():
        mark, solo = regex.match(r"\p{M}", c), regex.match(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}ー]", c)
        if mark and out and glue != "gap":
            out[-1] += c
        elif solo and c.isalnum():
            out.append(c)
            glue = "solo"
        elif c.isalnum() or mark:
            out[-1:] = [out[-1] + c] if out and glue == "word" else [*out[-1:], c]
            glue = "word"
        else:
            glue = "gap"
    return out


def test_tokens_of_every_script():
    rng = random.Random(4)
    letters = list("aZ1_ .é— “”中文。、かなカー々กิน้ำนำहिन्दी한국어Жß😀́")
    texts = ["", "中", "́", "กิ", "́a", *("".join(rng.choices(letters, k=rng.randrange(0, 30))) for _ in range(400))]
    got, first = M.tokens_of(texts)
    want = [literal_tokens(t) for t in texts]
    raw = [w.encode() for ws in want for w in ws]
    ends = M.np.cumsum([len(w) for w in raw])
    hashes = M.C.span_hashes(M.np.frombuffer(b"".join(raw), M.np.uint8), M.np.concatenate([[0], ends[:-1]]), ends)
    assert M.np.diff(first).tolist() == [len(ws) for ws in want]
    assert got.tolist() == hashes.tolist()


def test_scripts_without_spaces_and_unicode_separators(spark, frame):
    items = [(1, "春眠不觉晓，处处闻啼鸟。夜来风雨声，花落知多少。"), (2, "ภาษาไทยเป็นภาษาที่มีเสียงวรรณยุกต์"),
             (3, "吾輩は猫である。名前はまだ無い。"), (4, "one two—three four five “six” seven eight"), (5, "中文"), (6, "two words")]
    docs = [(1, "前面的话" + items[0][1] + "后面的话"), (2, "คำนำ" + items[1][1] + "ต่อ"), (3, "昔々" + items[2][1] + "と言う"),
            (4, "x one two three – four “five” six seven… eight y"), (5, "中文。"), (6, "Two words!"), (7, "我说中文 and two words more here"),
            (8, "今天天气很好，我们去公园散步吧。"), (9, "花落知多少 is a line")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r["items"] for r in M.decontaminate(frame(docs), bench).collect()}
    assert got == {1: [1], 2: [2], 3: [3], 4: [4], 5: [5], 6: [6], 7: [], 8: [], 9: []}
