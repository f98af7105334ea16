import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from envspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "  \n\n a", "Hello world's don't WE'LL", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext",
    "aaaaaaaaaaaaaaaaaaaaaaa", "=" * 5000, "éè ñ 你好 \U0001f600‍", "\x1c\x1d a\x85b c　 d​",
    "12345 ٣٤ ½ x²", "tab\t\tnl\r\n\r\n  end  ", "\x00\x01\x7f", "word " * 3000, "ab" * 20000,
]


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


def random_texts(n, seed):
    rng = random.Random(seed)
    pool = ["the", "ing", " ", "  ", "\n", "é", "ño", "'s", "'", "12", "%%%", "你", "́", "A", "zq", "<|endoftext|>", " ", "\U0001f600"]
    return ["".join(rng.choices(pool, k=rng.randrange(0, 60))) for _ in range(n)]


def test_encode_and_decode_like_the_library(spark, frame, theirs):
    texts = TEXTS + random_texts(300, 1)
    df = frame(list(enumerate(texts)))
    out = {r.doc_id: r for r in bpe.with_digests(bpe.decode(bpe.encode(df, PATH), PATH)).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        assert out[i].ids == ids, repr(t)
        assert out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i].decoded == theirs.decode(ids, skip_special_tokens=False) == (t or "")
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_word_pattern_for_every_character(theirs):
    for lo in range(0, 0x110000, 4096):
        chars = [chr(c) for c in range(lo, min(lo + 4096, 0x110000)) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1{c}!{c} " for c in chars)
        got = bpe.split_words(text)
        if not chars:
            continue
        want = [text[a:b] for _, (a, b) in theirs.pre_tokenizer.pre_tokenize_str(text)]
        assert got == want, hex(lo)


def test_decode_unknown_ids_and_broken_utf8(theirs):
    t = bpe.load_tables(PATH)
    ids = np.array([t.start[0xC3], 60000, -1, t.start[0x41], 50256])
    assert bpe.decode_ids(ids, np.array([0, 5, 5]), t) == ["�A<|endoftext|>", ""]


def test_merging_one_at_a_time_gives_the_same():
    t = bpe.load_tables(PATH)
    words = [w.encode() for w in ["aaaaaa", "banana", "mississippi", "ththththe", "xyxyxyx"]]
    a, b = bpe.merge_words(words, t), bpe.merge_words(words, t._replace(ordered=False))
    assert t.ordered and all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, ids string, decoded string")
    assert bpe.decode(bpe.encode(df, PATH), PATH).count() == 0
    df = spark.createDataFrame([(1, "hi there", "x", "y"), (1, "hi there", "x", "y")], "doc_id long, text string, ids string, decoded string")
    assert [r.decoded for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()] == ["hi there"] * 2


def test_text_and_ids_may_be_kept(spark):
    df = spark.createDataFrame([(1, "a text", 5), (2, None, 6)], "doc_id long, text string, _text int")
    out = bpe.encode(df, public_tokenizers.path("byte_bpe_50k.json"), keep=("text", "doc_id", "_text"))
    assert out.columns == ["text", "doc_id", "_text", "ids"]
    assert sorted(((r.doc_id, r.text, r["_text"], len(r.ids)) for r in out.collect())) == [(1, "a text", 5, 2), (2, None, 6, 0)]
