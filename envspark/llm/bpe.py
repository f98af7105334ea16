"""Byte-level BPE encoding and decoding (operator 3).

Encoding splits a text at added tokens, then by the byte-level word pattern,
and merges the words in batched numpy rounds: the symbols of many distinct
words lie in one flat array; every round looks all neighbour pairs up by
binary search in the sorted pair keys, takes the lowest rank of each word and
merges its occurrences from the left.  Words whose lowest rank is none leave
the array.  Words are merged once per task and looked up after that.

Decoding gathers the bytes of all tokens of a batch from one byte table.

The vocabulary (a ``tokenizers`` JSON file of a byte-level BPE model, at most
2**17 symbols) is read on the driver and broadcast: its size is that of the
file, whatever the data.  Nothing is trained here.

Defined results: null text encodes like the empty one, to no tokens; ids that
the vocabulary does not have decode to nothing; invalid UTF-8 decodes to
U+FFFD; repeated rows come back each; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envspark.llm import common as C

SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the byte-level word pattern, white space written out.
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Code points that became letters or numbers after Unicode 16,
#: which is what the tokenizer's pattern knows.
LATER = [
    (0x558, 0x558), (0x58b, 0x58c), (0x88f, 0x88f), (0xc5c, 0xc5c), (0xcdc, 0xcdc), (0x208f, 0x208f), (0x209d, 0x209f),
    (0xa7ce, 0xa7cf), (0xa7d2, 0xa7d2), (0xa7d4, 0xa7d4), (0xa7dd, 0xa7dd), (0xa7e2, 0xa7e2), (0xa7f1, 0xa7f1), (0xab6c, 0xab6d),
    (0x107bb, 0x107bf), (0x10940, 0x10959), (0x10ec5, 0x10ec7), (0x10ed9, 0x10eee), (0x11b0a, 0x11b0a), (0x11db0, 0x11ddb),
    (0x11de0, 0x11de9), (0x11df1, 0x11df1), (0x1246f, 0x1246f), (0x12475, 0x1247f), (0x12550, 0x12686), (0x16ea0, 0x16eb8),
    (0x16ebb, 0x16ed3), (0x16ff2, 0x16ff6), (0x187f8, 0x187ff), (0x18cd6, 0x18cda), (0x18d09, 0x18d20), (0x18d80, 0x18df2),
    (0x18e00, 0x19191), (0x191a0, 0x191d2), (0x1b123, 0x1b128), (0x1b168, 0x1b168), (0x1d6a6, 0x1d6a6), (0x1df1f, 0x1df24),
    (0x1df2b, 0x1df81), (0x1df90, 0x1df96), (0x1dfcd, 0x1dfff), (0x1e6c0, 0x1e6de), (0x1e6e0, 0x1e6e2), (0x1e6e4, 0x1e6e5),
    (0x1e6e7, 0x1e6ed), (0x1e6f0, 0x1e6f4), (0x1e6fe, 0x1e6ff), (0x2b73a, 0x2b73f), (0x2b81e, 0x2b81e), (0x2cea2, 0x2cead),
    (0x323b0, 0x33479), (0x3d000, 0x3fc3f),
]
_LATER_SET = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in LATER)
_FIND = regex.compile(WORD).findall
_FIND_CAREFULLY = regex.compile("(?V1)" + WORD.replace(f"[^{SPACE}\\p{{L}}\\p{{N}}]", f"[{_LATER_SET}||[^{SPACE}\\p{{L}}\\p{{N}}]]")
                                .replace(" ?\\p{L}+", f" ?[\\p{{L}}--[{_LATER_SET}]]+").replace(" ?\\p{N}+", f" ?[\\p{{N}}--[{_LATER_SET}]]+")).findall
_LATER = regex.compile(f"[{_LATER_SET}]").search


def split_words(text: str) -> list[str]:
    """The words of a text, as the pattern with Unicode 16 classes has them."""
    if text.isascii():
        return _FIND(text)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        if _LATER(text):
            return _FIND_CAREFULLY(text)
    return _FIND(text)


SHIFT = np.int64(17)
NONE = np.int64(1) << 40
CACHE_WORDS = 150_000
TEXT_STEP = 1 << 20


def _byte_chars() -> dict[str, int]:
    """Character that stands for each byte in the vocabulary: printable Latin-1
    bytes stand for themselves, the others follow from U+0100 in order."""
    out, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(extra)] = b
            extra += 1
    return out


class Tables(NamedTuple):
    start: np.ndarray        # id of each single byte
    keys: np.ndarray         # sorted pair keys
    rank: np.ndarray         # rank of each pair key
    made: np.ndarray         # id that each rank makes
    ordered: bool            # a merge never uses a token that a later merge makes
    added: list              # (content, id) of added tokens
    table: np.ndarray        # bytes of all tokens
    offs: np.ndarray         # where each id's bytes start


def load_tables(path: str) -> Tables:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab: dict[str, int] = spec["model"]["vocab"]
    chars = _byte_chars()
    start = np.full(256, -1, np.int64)
    for c, b in chars.items():
        start[b] = vocab[c]
    pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    left = np.array([vocab[a] for a, _ in pairs], np.int64)
    right = np.array([vocab[b] for _, b in pairs], np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], np.int64)
    first = {}
    for r, t in enumerate(made.tolist()):
        first.setdefault(t, []).append(r)
    ordered = all(len(v) == 1 for v in first.values()) and all(
        max(first.get(a, [-1])[0], first.get(b, [-1])[0]) < r
        for r, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)))
    keys = left << SHIFT | right
    order = np.argsort(keys)
    added = [(t["content"], t["id"]) for t in spec.get("added_tokens", [])]
    n = max([*vocab.values(), *(i for _, i in added)]) + 1
    if n > 1 << int(SHIFT):
        raise ValueError("vocabulary has more symbols than a pair key can hold")
    pieces = [b""] * n
    for token, i in vocab.items():
        pieces[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
    for token, i in added:
        pieces[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
    offs = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
    return Tables(start, keys[order], order.astype(np.int64), made, ordered, added,
                  np.frombuffer(b"".join(pieces), np.uint8), offs)


def merge_words(words: list[bytes], t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after the other, number of ids of each word)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    sym = t.start[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), size)
    done_word, done_sym = [], []
    while len(sym):
        key = sym[:-1] << SHIFT | sym[1:]
        at = np.searchsorted(t.keys, key)
        at[at == len(t.keys)] = 0
        rank = np.full(len(sym), NONE)
        hit = (t.keys[at] == key) & (word[:-1] == word[1:])
        rank[:-1][hit] = t.rank[at[hit]]
        head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        lowest = np.minimum.reduceat(rank, head)
        span = np.diff(np.append(head, len(sym)))
        live = np.repeat(lowest < NONE, span)
        if not live.all():
            done_word.append(word[~live])
            done_sym.append(sym[~live])
            sym, word, rank = sym[live], word[live], rank[live]
            span, lowest = span[lowest < NONE], lowest[lowest < NONE]
            if not len(sym):
                break
        take = rank == np.repeat(lowest, span)
        if t.ordered:
            # of overlapping occurrences (a run of positions) every second one, from the left
            idx = np.flatnonzero(take)
            new = np.concatenate([[True], (np.diff(idx) > 1) | (word[idx[1:]] != word[idx[:-1]])])
            lead = idx[np.maximum.accumulate(np.where(new, np.arange(len(idx)), 0))]
            idx = idx[(idx - lead) % 2 == 0]
        else:
            idx = np.flatnonzero(take)
            idx = idx[np.concatenate([[True], word[idx[1:]] != word[idx[:-1]]])]
        sym[idx] = t.made[rank[idx]]
        keep = np.ones(len(sym), bool)
        keep[idx + 1] = False
        sym, word = sym[keep], word[keep]
    if not done_sym:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    word, sym = np.concatenate(done_word), np.concatenate(done_sym)
    return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


class _Words(dict):
    """Word -> number, given out as words are first seen."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


class Encoder:
    def __init__(self, t: Tables) -> None:
        self.t = t
        self.added = dict(t.added)
        self.split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")").split \
            if t.added else None
        self.clear()

    def clear(self) -> None:
        self.words = _Words()
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for content, i in self.t.added:     # added tokens are never merged
            self.words[("added", content)]
            self._append(np.array([i], np.int32), np.array([1]))

    def _append(self, flat: np.ndarray, count: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        self.count = np.concatenate([self.count, count])

    def _pieces(self, text: str) -> list:
        if self.split is None or not any(x in text for x in self.added):
            return split_words(text)
        out = []
        for i, part in enumerate(self.split(text)):
            if i % 2:
                out.append(("added", part))
            else:
                out += split_words(part)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts)."""
        if len(self.words) > CACHE_WORDS:
            self.clear()
        known = len(self.words)
        lists = [self._pieces(x) if x else [] for x in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
        del lists
        if len(self.words) > known:
            fresh = list(self.words)[known:]
            for i in range(0, len(fresh), 1 << 17):
                self._append(*merge_words([w.encode() for w in fresh[i:i + (1 << 17)]], self.t))
        count = self.count[at]
        total = np.concatenate([[0], np.cumsum(count)])
        return self.flat[C.ragged(self.start[at], count)], total[np.concatenate([[0], np.cumsum(sizes)])]


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``ids`` (array<int>), one row per input row."""
    spark = docs.sparkSession
    C.small_batches(spark)
    shared = spark.sparkContext.broadcast(load_tables(path))
    src = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value)
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            lo, size = 0, 0
            for i, x in enumerate(texts):
                size += len(x or "")
                if size >= TEXT_STEP or i == len(texts) - 1:
                    ids, offs = enc.encode(texts[lo:i + 1])
                    arr = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))
                    part = b.slice(lo, i + 1 - lo)
                    yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], arr], names=[*keep, "ids"])
                    lo, size = i + 1, 0

    return src.mapInArrow(C.tidy(run), schema)


def decode_ids(ids: np.ndarray, offs: np.ndarray, t: Tables) -> list[str]:
    known = (ids >= 0) & (ids < len(t.offs) - 1)
    size = np.zeros(len(ids), np.int64)
    size[known] = np.diff(t.offs)[ids[known]]
    data = t.table[C.ragged(t.offs[np.where(known, ids, 0)], size)].tobytes()
    ends = np.concatenate([[0], np.cumsum(size)])[offs].tolist()
    return [data[s:e].decode("utf-8", "replace") for s, e in zip(ends[:-1], ends[1:], strict=True)]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """All columns of ``encoded`` and ``decoded``, the text of its ``ids``."""
    spark = encoded.sparkSession
    C.small_batches(spark)
    shared = spark.sparkContext.broadcast(load_tables(path))
    names = [c for c in encoded.columns if c != "decoded"]
    src = encoded.select(*names)
    schema = T.StructType([*src.schema.fields, T.StructField("decoded", T.StringType())])
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arr = b.column(at)
            count = arr.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            offs = np.concatenate([[0], np.cumsum(count)])
            ids = arr.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(decode_ids(ids, offs, shared.value), pa.string())],
                                             names=[*names, "decoded"])

    return src.mapInArrow(C.tidy(run), schema)


def with_digests(tokens: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 beside the columns of ``decode``."""
    ids = F.coalesce(F.col("ids"), F.array().cast("array<int>"))
    return tokens.select(
        "*", F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", ids.cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
