"""Sequence packing by best-fit decreasing (operator 11).

A document is its token ids and an end id.  It is first cut into full windows;
what is left (shorter than a window) is a remnant.  Remnants are taken from the
longest to the shortest, and each goes into the open window with the least room
that still holds it, or opens a new one.  A segment tree over the remaining
capacities 0..window finds that window: every node counts the open windows
below it, so the tightest fit is one climb and one descent.

Packing needs no global order.  A task packs groups of ``GROUP`` tokens of its
own documents and closes the windows that leave at most ``SPARE`` tokens of
padding; no token of theirs is shuffled.  Only the remnants of the other
windows, a few per task, travel: they are dealt at random to groups of the same
size and packed again.  What still leaves more than ``SPARE`` tokens there is
cut freely: the remnants are laid end to end, cut into full windows, and the
last rest into sequences whose lengths are powers of two, which need no
padding.  So every sequence has at most ``SPARE`` tokens of padding.

Both steps are written to the shared folder, so what a sequence holds does not
change when a task is repeated.  A group is bounded by its tokens, whatever the
number of documents or the share of one source.

Defined results: null and empty texts have the end id only; repeated rows are
documents of their own; null ids are kept; columns beyond ``keep`` are ignored;
empty in, empty out.  ``keep`` may not hold a name that the result adds.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envspark.llm import common as C
from envspark.llm.units import Remembered, flat_lists, joined, kept, per_text, text_steps, words_of_texts

GROUP = 1 << 21              # tokens packed at once
SPARE = 16                   # padding a closed window may have
TEXT_STEP = 4 << 20          # bytes of text encoded at once
PIECES = 800_000             # distinct word pieces that a worker remembers (about 150 bytes each)
SECOND = 1 << 62             # sequence ids of the second step start here


class OpenWindows:
    """Open windows in a segment tree indexed by their remaining capacity."""

    def __init__(self, window: int) -> None:
        self.leaf = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaf)
        self.at: dict[int, list[int]] = {}

    def _step(self, room: int, by: int) -> None:
        node = self.leaf + room
        while node:
            self.count[node] += by
            node >>= 1

    def add(self, room: int, number: int) -> None:
        self.at.setdefault(room, []).append(number)
        self._step(room, 1)

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the least capacity that is ``need`` or more;
        the window leaves the tree."""
        count, node = self.count, self.leaf + need
        if not count[node]:
            # climb until there is something to the right, then go down to its least leaf
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaf:
                node *= 2
                if not count[node]:
                    node += 1
        room = node - self.leaf
        self._step(room, -1)
        return room, self.at[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window of each piece, its offset there, fill of each window)."""
    tree, fill = OpenWindows(window), []
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take_tightest(n)
        if found is None:
            room, w = window, len(fill)
            fill.append(0)
        else:
            room, w = found
        where[i], offset[i] = w, window - room
        fill[w] += n
        if room > n:
            tree.add(room - n, w)
    return where, offset, np.array(fill, np.int64)


def cut_freely(total: int, window: int) -> np.ndarray:
    """Sequence lengths for ``total`` tokens without any padding: full windows,
    then the powers of two that add up to the rest."""
    rest = total % window
    tail = [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
    return np.array([window] * (total // window) + tail, np.int64)


def padding(fill: np.ndarray, window: int) -> np.ndarray:
    """Tokens of padding of sequences of the given lengths."""
    return np.where(fill & (fill - 1) == 0, 0, window - fill)


def _binary(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """Binary Arrow array: little-endian 32-bit ids of each piece."""
    data = ids[C.ragged(start, length)].astype("<u4")
    ends = np.concatenate([[0], np.cumsum(length * 4)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _rows(held: pa.Table, doc: np.ndarray, start: np.ndarray, length: np.ndarray, tokens: np.ndarray, ids: pa.Array,
          sequence: np.ndarray, offset: np.ndarray) -> Iterator[pa.RecordBatch]:
    loose = sequence < 0
    cols = [*held.take(pa.array(doc)).columns, pa.array(start), pa.array(length), pa.array(tokens), ids,
            pa.array(sequence, mask=loose), pa.array(offset, mask=loose)]
    yield from pa.table(cols, names=[*held.column_names, *_ADDED.fieldNames()]).to_batches(max_chunksize=1 << 14)


_ADDED = T.StructType([T.StructField(n, t) for n, t in (
    ("start", T.LongType()), ("length", T.LongType()), ("doc_tokens", T.LongType()), ("ids", T.BinaryType()),
    ("sequence_id", T.LongType()), ("offset", T.LongType()))])


def _first(tokenize: Callable[[], Callable], keep: tuple[str, ...], window: int, end_id: int):
    """Encode, cut overlong documents, pack remnants per group of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenize()
        number = TaskContext.get().partitionId() << 32
        docs, flat, count = [], [], []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            tab = pa.concat_tables(docs).combine_chunks()
            ids, n = np.concatenate(flat), np.concatenate(count)
            first = np.cumsum(n) - n
            full = n // window
            doc = np.repeat(np.arange(len(n)), full)
            start = C.ragged(np.zeros(len(n), np.int64), full) * window
            if len(doc):
                seq = number + np.arange(len(doc))
                number += len(doc)
                size = np.full(len(doc), window, np.int64)
                for lo in range(0, len(doc), 512):
                    s = slice(lo, lo + 512)
                    yield from _rows(tab, doc[s], start[s], size[s], n[doc[s]], _binary(ids, first[doc[s]] + start[s], size[s]),
                                     seq[s], np.zeros(len(doc[s]), np.int64))
            doc = np.flatnonzero(n % window)
            if len(doc):
                size, start = n[doc] % window, full[doc] * window
                where, offset, fill = best_fit_decreasing(size, window)
                closed = padding(fill, window) <= SPARE
                seq = np.where(closed, number + np.cumsum(closed) - 1, -1)[where]
                number += int(closed.sum())
                order = np.lexsort((offset, where))
                doc, start, size, seq, offset = doc[order], start[order], size[order], seq[order], offset[order]
                yield from _rows(tab, doc, start, size, n[doc], _binary(ids, first[doc] + start, size), seq, offset)

        for b in batches:
            for part in text_steps(b, len(keep), TEXT_STEP):
                ids, n = encode(part.column(len(keep)))
                ends = np.cumsum(n)
                out = np.full(len(ids) + len(n), end_id, np.uint32)
                out[C.ragged(ends - n + np.arange(len(n)), n)] = ids
                docs.append(pa.Table.from_batches([part]).select(list(range(len(keep)))))
                flat.append(out)
                count.append(n + 1)
                held += len(out)
                if held >= GROUP:
                    yield from flush()
                    docs, flat, count = [], [], []
                    held = 0
        if held:
            yield from flush()
    return run


def _second(keep: tuple[str, ...], window: int):
    """Pack the remnants of a group again; cut what does not fit well."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = SECOND + (TaskContext.get().partitionId() << 32)
        for _, t in C.key_runs(batches, "_grp"):
            t = t.sort_by("_piece").combine_chunks()
            tab, tokens, begin = t.select(list(keep)), t["doc_tokens"].to_numpy(), t["start"].to_numpy()
            raw, offs = C.utf8_view(t["ids"])
            ids, size, first = raw.view("<u4"), np.diff(offs) // 4, offs[:-1] // 4
            where, offset, fill = best_fit_decreasing(size, window)
            closed = padding(fill, window) <= SPARE
            order = np.lexsort((offset, where))
            good = order[closed[where[order]]]
            seq = (number + np.cumsum(closed) - 1)[where[good]]
            number += int(closed.sum())
            if len(good):
                yield from _rows(tab, good, begin[good], size[good], tokens[good], _binary(ids, first[good], size[good]), seq, offset[good])
            rest = order[~closed[where[order]]]
            if not len(rest):
                continue
            # the remnants end to end, cut where a document or a sequence ends
            lengths = cut_freely(int(size[rest].sum()), window)
            doc_ends, seq_ends = np.cumsum(size[rest]), np.cumsum(lengths)
            cuts = np.union1d(doc_ends, seq_ends)
            lo = np.concatenate([[0], cuts[:-1]])
            at, s = np.searchsorted(doc_ends, cuts), np.searchsorted(seq_ends, cuts)
            inner = lo - (doc_ends - size[rest])[at]
            d = rest[at]
            yield from _rows(tab, d, begin[d] + inner, cuts - lo, tokens[d], _binary(ids, first[d] + inner, cuts - lo),
                             number + s, lo - (seq_ends - lengths)[s])
            number += len(lengths)
    return run


def pack(docs: DataFrame, tokenize: Callable[[], Callable], window: int = 4096, end_id: int = 2,
         keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per piece: ``keep``, start, length, doc_tokens, ids (little-endian
    32-bit, binary), sequence_id, offset.  ``tokenize()`` is called in a task and
    gives a function from an Arrow array of texts to (ids, ids of each text)."""
    spark = docs.sparkSession
    C.small_batches(spark)
    src = docs.select(*keep, "text")
    schema = T.StructType([*src.schema.fields[:len(keep)], *_ADDED.fields])
    placed = C.materialize(src.mapInArrow(C.tidy(_first(tokenize, keep, window, end_id)), schema), "packed")
    loose = placed.where("sequence_id IS NULL")
    tokens = loose.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, -(-tokens // GROUP))
    numbered = loose.withColumn("_piece", F.monotonically_increasing_id()) \
        .withColumn("_grp", F.pmod(F.xxhash64("_piece"), F.lit(groups)))
    again = C.materialize(C.by_key(numbered, "_grp", min(groups, C.n_partitions(spark))).mapInArrow(C.tidy(_second(keep, window)), schema),
                          "packed-again")
    return placed.where("sequence_id IS NOT NULL").unionByName(again)


#: The model's word pattern on lower-cased Latin-1 text, classes
#: written out, and the space that parts words here.
LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+| ").findall


def word_tokenizer(path: str) -> Callable[[], Callable]:
    """The tokenizers library on single words of a model that lower-cases and
    drops white space, so that no token crosses a space.  Latin-1 words (which
    Unicode composition leaves alone) without a special token are lower-cased
    and cut by the model's own pattern here; the library then merges each
    distinct piece once.  It gets all other words whole."""
    def build():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark runs the tasks side by side
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        whole, bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for tok in (whole, bare):
            tok.no_truncation()
            tok.no_padding()
        special = tuple(t.content for t in whole.get_added_tokens_decoder().values())
        bare.normalizer = normalizers.Sequence([])
        bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

        def by(tok) -> Callable:
            return lambda words: flat_lists([e.ids for e in tok.encode_batch_fast(words, add_special_tokens=False)])
        pieces = Remembered(by(bare), PIECES)

        def latin(words: str, n: int) -> tuple[np.ndarray, np.ndarray]:
            # the spaces between the words come out as pieces of their own
            at, gap = pieces.coded(LATIN(words.lower()))
            ids, count = pieces.gather(at)
            if gap.any():
                ids, count = ids[~np.repeat(gap, count)], np.where(gap, 0, count)
            return ids, np.bincount(np.cumsum(gap), count, n).astype(np.int64)

        def plain(x: str) -> bool:
            return (x.isascii() or max(x) <= "ÿ") and not any(t in x for t in special)

        def of_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            """(ids of all words, ids of each)."""
            whole_text = joined(words)
            if not len(words) or plain(whole_text):
                return latin(whole_text, len(words))
            each = words.to_pylist()
            easy = np.fromiter(map(plain, each), bool, len(each))
            out, count = [], np.zeros(len(each), np.int64)
            for how, who in ((lambda w: latin(" ".join(w), len(w)), easy), (by(whole), ~easy)):
                part, count[who] = how([w for w, x in zip(each, who.tolist(), strict=True) if x]) if who.any() else (np.zeros(0, np.int32), 0)
                out.append((part, who))
            ids, first = np.zeros(int(count.sum()), np.int32), np.cumsum(count) - count
            for part, who in out:
                ids[C.ragged(first[who], count[who])] = part
            return ids, count

        def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            words = words_of_texts(texts)
            ids, count = of_words(words.distinct)
            first, n = (np.cumsum(count) - count)[words.code], count[words.code]
            return ids[C.ragged(first, n)], per_text(n, words.count)
        return encode
    return lambda: kept((path, "words"), build)
