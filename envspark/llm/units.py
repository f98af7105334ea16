"""Token ids of texts that a tokenizer encodes word by word.

Where a tokenizer never merges across a space, a text is the concatenation of
its words' ids.  ``words_of_texts`` cuts texts at single spaces and numbers the
distinct words of a batch in Arrow; ``Remembered`` holds, per task, the ids of
the words seen so far.  So Python handles distinct words and numpy the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from envspark.llm import common as C

CACHE = 400_000              # distinct words that a task remembers before it starts anew


class Words(NamedTuple):
    distinct: pa.Array
    code: np.ndarray         # of each word, into ``distinct``
    count: np.ndarray        # words of each text


def words_of_texts(texts: pa.Array) -> Words:
    """Words between single spaces (two spaces in a row hold an empty word);
    null texts have none."""
    lists = pc.split_pattern(texts, " ")
    flat = lists.flatten().dictionary_encode()
    return Words(flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64),
                 pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))


def joined(words: pa.Array) -> str:
    """All words in one string, a space between them."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


class Remembered:
    """``encode`` gives (ids of all words of a list, number of ids of each)."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = CACHE) -> None:
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.words = _Numbers()
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of the words, valid until the next call."""
        if len(self.words) > self.most:
            self._clear()
        known = len(self.words)
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if len(self.words) > known:
            ids, count = self.encode(list(self.words)[known:])
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
            self.flat, self.count = np.concatenate([self.flat, ids.astype(np.int32)]), np.concatenate([self.count, count])
        return at

    def coded(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words that repeat much, and where they are a space."""
        d = pa.array(found, pa.string()).dictionary_encode()
        distinct, code = d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False)
        space = distinct.index(" ") if " " in distinct else -1
        return self.numbers(distinct)[code], code == space

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the numbered words one after the other, ids of each)."""
        count = self.count[at]
        return self.flat[C.ragged(self.start[at], count)], count


def per_text(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Sums of ``count`` over the words of each text."""
    return np.diff(np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(words)])])


def flat_lists(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    count = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(count.sum())), count


def text_steps(b: pa.RecordBatch, column: int, step: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that end once they hold ``step`` bytes of text."""
    if not b.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < b.num_rows:
        before = size[lo - 1] if lo else 0
        hi = min(int(np.searchsorted(size, before + step)) + 1, b.num_rows)
        yield b.slice(lo, hi - lo)
        lo = hi


_KEPT: dict = {}


def kept(key: tuple, build: Callable):
    """What ``build()`` makes, held by a Python worker between its tasks, so
    that they share what is remembered.  The last two things made are kept."""
    if key not in _KEPT:
        for old in list(_KEPT)[:-1]:
            del _KEPT[old]
        _KEPT[key] = build()
    return _KEPT[key]
