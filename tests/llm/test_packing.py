import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import envspark.llm.packing as M

PATH = public_tokenizers.path("word_bpe_49k.json")
KEEP = ("doc_id", "source")


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


def docs(seed, n):
    rng = random.Random(seed)
    pool = ["The", "Ünïted", "don't", "12", "…", "zebra-crossing", "你好", "é", "<|endoftext|>", "x<|startoftext|>", "\t", "", "\n\n", " ", "WE'LL", "ﬁ"]
    rows = [(i, " ".join(rng.choices(pool, k=rng.choice([1, 3, 20, 60]))), None, "s") for i in range(n)]
    rows += [(900, None, None, None), (901, "", None, "t"), (None, "no id", None, "t"), (902, "word " * 700, None, "t"), (903, "a b c d " * 2000, None, "t"),
             (5, rows[5][1], None, "s"), (5, rows[5][1], None, "s")]
    rng.shuffle(rows)
    return rows


def check(got, rows, theirs, window):
    """Every id of every document in one piece, sequences without gaps."""
    want = defaultdict(list)
    for d, text, _, source in rows:
        want[d, source].append([*theirs.encode(text or "", add_special_tokens=False).ids, 2])
    have, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.length == len(ids) > 0
        have[r.doc_id, r.source].append((r.start, r.doc_tokens, ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(have) == set(want)
    for key, lists in want.items():
        pieces = have[key]
        assert all(n == len(next(x for x in lists if len(x) == n)) for _, n, _ in pieces)
        if len(lists) == 1:
            ids = lists[0]
            assert [i for _, _, p in sorted(pieces) for i in p] == ids
            assert np.cumsum([0] + [len(p) for _, _, p in sorted(pieces)])[:-1].tolist() == [s for s, _, _ in sorted(pieces)]
        else:
            assert sorted((s + k, i) for s, _, p in pieces for k, i in enumerate(p)) == sorted((k, i) for x in lists for k, i in enumerate(x))
    fills = []
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
        fills.append(end)
    return np.array(fills)


@pytest.mark.parametrize("window,group", [(4096, 1 << 21), (128, 1 << 21), (64, 500)])
def test_pieces_and_sequences(spark, frame, theirs, monkeypatch, window, group):
    monkeypatch.setattr(M, "GROUP", group)
    rows = docs(window, 150)
    out = M.pack(frame(rows).withColumnRenamed("n_chars", "fill"), M.word_tokenizer(PATH), window, keep=KEEP)
    assert out.columns == [*KEEP, "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
    fills = check(out.collect(), rows, theirs, window)
    assert (M.padding(fills, window) <= M.SPARE).all()
    assert M.padding(fills, window).sum() <= 0.02 * fills.sum() + M.SPARE


def test_tree_finds_the_tightest_window():
    rng = random.Random(1)
    tree, rooms = M.OpenWindows(50), []
    for k in range(600):
        if rng.random() < 0.5:
            room = rng.randrange(1, 51)
            rooms.append(room)
            tree.add(room, k)
        else:
            need = rng.randrange(1, 51)
            fits = [r for r in rooms if r >= need]
            found = tree.take_tightest(need)
            assert (found[0] if found else None) == (min(fits) if fits else None)
            if found:
                rooms.remove(found[0])


def test_best_fit_decreasing_like_the_literal_rule():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 65, 400)
    where, offset, fill = M.best_fit_decreasing(lengths, 64)
    room = []
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [w for w, r in enumerate(room) if r >= n]
        if fits:
            w = min(fits, key=lambda w: room[w])
            room[w] -= n
        else:
            room.append(64 - n)
    assert sorted(64 - r for r in room) == sorted(fill.tolist())
    for w in range(len(fill)):
        order = np.argsort(offset[where == w])
        assert (offset[where == w][order] == np.cumsum(np.concatenate([[0], lengths[where == w][order]]))[:-1]).all()


def test_free_cuts_need_no_padding():
    for total in range(0, 700, 7):
        cut = M.cut_freely(total, 64)
        assert cut.sum() == total and M.padding(cut, 64).sum() == 0 and len(cut) <= total // 64 + 6


def test_query_digest_and_defined_rows(spark, tmp_path, frame, theirs):
    from envspark.llm.queries import op11_packing
    rows = docs(3, 30)
    frame(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = op11_packing(spark, str(tmp_path)).collect()
    one = next(r for r in got if r.doc_id == 901)
    assert (one.start, one.length, one.doc_tokens, one.ids_crc32) == (0, 1, 1, zlib.crc32(np.array([2], "<u4").tobytes()))
    whole = {r.doc_id: r for r in got if r.length == r.doc_tokens and r.doc_id not in (5,)}
    for d, text, *_ in rows:
        if d in whole:
            assert whole[d].ids_crc32 == zlib.crc32(np.array([*theirs.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())


def test_empty(spark, frame):
    assert M.pack(frame([]), M.word_tokenizer(PATH)).count() == 0
