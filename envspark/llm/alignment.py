"""Cross-tokenizer alignment (operator 12).

Two tokenizers cut the same bytes.  Where a token of either ends at the same
byte the cuts are shared; between neighbouring shared cuts lies one group of
tokens of A and of B.

*Divide and conquer.*  An interval that starts and ends at shared cuts is
divided at a common end near its middle: from A's middle end the search
leapfrogs to the right, and where there is none to the left, each leap a bisect
in the other side's ends, until an end of A is an end of B.  Both halves go on;
an interval without such an end becomes a leaf group.  All intervals of a batch
of texts are searched at once (``shared_groups``), so the recursion is a few
dozen rounds of numpy.

Where no token of either side crosses a space, this is done once per distinct
word of a batch, and a text is the concatenation of its words' groups.

*Links* are the pairs of an A and a B token whose bytes overlap.  How often an
id pair is linked in the whole corpus is counted from one row per distinct pair
of a batch (a batch holds ``BATCH`` bytes of text), combined before the shuffle.
The counts go back the same way: one row per distinct pair of a batch, gathered
to one row per batch, which meets the batch's words (the ids of both sides, two
bytes each for vocabularies below 65,536, and the words of each text, compressed
together).  Neither links nor texts are shuffled, nothing is collected, and a
frequent pair is one row per batch.

Defined results: null and empty texts, and texts whose joined token bytes of A
or of B differ from a space and the text (control characters that B lacks, a
U+2581 that it would read as a space) have no tokens, no groups and no links;
special tokens' strings are plain text; repeated rows count each, and null ids
are kept; columns beyond ``keep`` are ignored; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envspark.llm import bpe
from envspark.llm import common as C
from envspark.llm.units import Remembered, flat_lists, per_text, text_steps, words_of_texts

BATCH = 2 << 20              # bytes of text whose pairs are combined
WORDS = 150_000              # distinct words a side remembers
STEP = 1 << 19               # bytes gathered at once
OUT = 1 << 21                # bytes of groups that leave a task at once
SHIFT = np.int64(32)


# ------------------------------------------------------------- tokenizers
class Side:
    """A tokenizer: (ids, ids of each text) of texts or of words without spaces,
    the bytes of its tokens, and whether a text with single spaces is the
    concatenation of a space and each word."""

    def __init__(self, encode: Callable[[list[str], bool], tuple[np.ndarray, np.ndarray]], pieces: list[bytes], by_word: bool) -> None:
        self.encode, self.by_word = encode, by_word
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.offs = np.cumsum(self.size) - self.size
        self.table = np.frombuffer(b"".join(pieces), np.uint8)
        self.words = Remembered(self._words, WORDS)

    def faithful(self, raw: np.ndarray, size: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Whether the joined bytes of each text's ids are its ``size`` bytes of ``raw``."""
        good = per_text(self.size[ids], count) == size
        mine = ids[np.repeat(good, count)]
        have = self.table[C.ragged(self.offs[mine], self.size[mine])]
        wrong = np.flatnonzero(have != (raw if good.all() else raw[np.repeat(good, size)]))
        at = np.flatnonzero(good)
        good[at[np.unique(np.searchsorted(np.cumsum(size[at]), wrong, side="right"))]] = False
        return good

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and each word; -1 alone for a word that they do not reproduce."""
        ids, count = self.encode(words, True)
        raw = np.frombuffer((" " + " ".join(words)).encode(), np.uint8)
        bad = ~self.faithful(raw, np.diff(np.append(np.flatnonzero(raw == 32), len(raw))), ids, count)
        if bad.any():
            ids = ids[~np.repeat(bad, count)]
            count = np.where(bad, 0, count)
            ids = np.insert(ids, np.cumsum(count)[bad], -1)
            count = np.where(bad, 1, count)
        return ids, count


def byte_level_side(path: str) -> Callable[[], Side]:
    """Byte-level BPE on a space and the text, without special tokens.  Its
    words start at a space, so single spaces part them."""
    tables = bpe.load_tables(path)._replace(added=[])       # read on the driver, travels with the function

    def build() -> Side:
        enc = bpe.Encoder(tables)
        cuts = tables.offs.tolist()
        raw = tables.table.tobytes()

        def merge(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            parts = [bpe.merge_words([w.encode() for w in pieces[i:i + (1 << 17)]], tables) for i in range(0, len(pieces), 1 << 17)]
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        pieces = Remembered(merge, WORDS)

        def encode(texts: list[str], words: bool) -> tuple[np.ndarray, np.ndarray]:
            if not words:
                ids, offs = enc.encode([" " + x for x in texts])
                return ids, np.diff(offs)
            # of a word with its space, only the first piece starts with a space
            found = bpe.split_words(" " + " ".join(texts))
            ids, count = pieces.gather(pieces.numbers(found))
            word = np.cumsum(np.fromiter((p[0] == " " for p in found), bool, len(found))) - 1
            return ids, np.bincount(word, count, len(texts)).astype(np.int64)
        return Side(encode, [raw[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], True)
    return build


def piece_side(path: str) -> Callable[[], Side]:
    """SentencePiece, which adds the leading space itself.  Where no piece has a
    space after another character, and spaces are neither dropped nor merged,
    no merge crosses into the space before the next word."""
    with open(path, "rb") as f:
        proto = f.read()

    def build() -> Side:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        names = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        pieces = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        by_word = not any(a != "▁" == b for p in names for a, b in zip(p, p[1:], strict=False)) and all(
            "".join(names[i] for i in sp.encode(x)) == "▁" + x.replace(" ", "▁") for x in ("a  b ", " a", "a"))
        return Side(lambda texts, _: flat_lists(sp.encode(texts, num_threads=1)), pieces, by_word)
    return build


class Units(NamedTuple):
    """Distinct words (or, where a text is not made of them, whole texts) of a
    batch with their ids on both sides, and the units of each text."""
    a: np.ndarray
    count_a: np.ndarray      # ids of each unit
    b: np.ndarray
    count_b: np.ndarray
    code: np.ndarray         # unit of each occurrence
    count: np.ndarray        # units of each text; none where a side does not reproduce it


def units_of(a: Side, b: Side, texts: pa.Array) -> Units:
    some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
    simple = pc.invert(pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " "))))
    easy = pc.fill_null(pc.and_(some, simple), False).to_numpy(zero_copy_only=False) & a.by_word & b.by_word
    some = some.to_numpy(zero_copy_only=False)
    fast = np.flatnonzero(easy)
    words = words_of_texts(texts.take(pa.array(fast)))
    distinct = words.distinct.to_pylist()
    got = [side.words.gather(side.words.numbers(distinct)) for side in (a, b)]
    # texts with a word that does not come back are looked at whole, like those with more than single spaces
    odd_word = np.zeros(len(distinct), bool)
    for ids, c in got:
        odd_word |= per_text((ids < 0).astype(np.int64), c) > 0
    odd = per_text(odd_word[words.code].astype(np.int64), words.count) > 0
    slow = np.flatnonzero(some & ~easy)
    if odd.any():
        slow = np.union1d(slow, fast[odd])
    whole = texts.take(pa.array(slow)).to_pylist()
    late = [side.encode(whole, False) if whole else (np.zeros(0, np.int32), np.zeros(0, np.int64)) for side in (a, b)]
    raw = [b" " + x.encode() for x in whole]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    good = np.ones(len(whole), bool)
    for side, (ids, c) in zip((a, b), late, strict=True):
        good &= side.faithful(np.frombuffer(b"".join(raw), np.uint8), size, ids, c)
    both = []
    for (ids, c), (ids_late, c_late) in zip(got, late, strict=True):
        both += [np.concatenate([ids[np.repeat(~odd_word, c)], ids_late[np.repeat(good, c_late)]]).astype(np.int64),
                 np.concatenate([np.where(odd_word, 0, c), c_late[good]])]
    count = np.zeros(len(texts), np.int64)
    count[fast[~odd]] = words.count[~odd]
    count[slow[good]] = 1
    code, first = np.zeros(int(count.sum()), np.int64), np.cumsum(count) - count
    code[C.ragged(first[fast[~odd]], words.count[~odd])] = words.code[np.repeat(~odd, words.count)]
    code[first[slow[good]]] = len(distinct) + np.arange(int(good.sum()))
    return Units(*both, code, count)


# --------------------------------------------------------------- alignment
def links_of(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id pair of each link, byte at which it ends): between neighbouring ends
    of either side one token of A overlaps one of B."""
    cuts = np.concatenate([ends_a, ends_b])
    cuts.sort(kind="stable")
    cuts = cuts[np.concatenate([[True], cuts[1:] != cuts[:-1]])] if len(cuts) else cuts
    return a[np.searchsorted(ends_a, cuts)] << SHIFT | b[np.searchsorted(ends_b, cuts)], cuts


def shared_groups(ends_a: np.ndarray, ends_b: np.ndarray, offs_a: np.ndarray, offs_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaf groups by divide and conquer: (one past the last A token, one past
    the last B token) of every group, in order.  ``ends`` are byte ends over all
    texts, ``offs`` the token offsets of the texts."""
    some = np.flatnonzero(np.diff(offs_a) > 0)
    a0, a1, b0, b1 = offs_a[some], offs_a[some + 1], offs_b[some], offs_b[some + 1]
    done: list[np.ndarray] = []
    # A's candidate end of each interval, and whether the search still goes right from the middle
    at, right = (a0 + a1 - 2) // 2, np.ones(len(a0), bool)
    while len(a0):
        leaf = (a1 - a0 == 1) | (b1 - b0 == 1) | (at < a0)
        if leaf.any():
            done.append(np.stack([a1[leaf], b1[leaf]]))
            a0, a1, b0, b1, at, right = (x[~leaf] for x in (a0, a1, b0, b1, at, right))
            if not len(a0):
                break
        j = np.searchsorted(ends_b, ends_a[at])
        hit = ends_b[j] == ends_a[at]
        # no common end here: leap to the next end of B and from there to the next of A; at the border turn left
        miss = np.flatnonzero(~hit)
        if len(miss):
            m_at, m_right, m_j = at[miss], right[miss], j[miss]
            step = np.searchsorted(ends_a, ends_b[m_j])
            turn = m_right & (step > a1[miss] - 2)
            middle = (a0[miss] + a1[miss] - 2) // 2
            back = np.flatnonzero(turn | ~m_right)
            if len(back):
                k = np.where(turn[back], np.searchsorted(ends_b, ends_a[middle[back]]), m_j[back]) - 1
                prior = np.searchsorted(ends_a, ends_b[np.maximum(k, 0)], side="right") - 1
                step[back] = np.where(k < b0[miss][back], -1, prior)
                m_right[back] = False
            at[miss], right[miss] = step, m_right
        # both halves of the divided intervals, in the place of the whole
        new = np.repeat(np.arange(len(a0)), 1 + hit)
        second = np.cumsum(1 + hit)[hit] - 1
        cut_a, cut_b = at[hit] + 1, j[hit] + 1
        a0, a1, b0, b1, at, right = (x[new] for x in (a0, a1, b0, b1, at, right))
        a0[second], a1[second - 1], b0[second], b1[second - 1] = cut_a, cut_a, cut_b, cut_b
        for half in (second, second - 1):
            at[half], right[half] = (a0[half] + a1[half] - 2) // 2, True
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ga, gb = np.concatenate(done, axis=1)
    order = np.argsort(ga)
    return ga[order], gb[order]


class Digits:
    """Decimal ids with a separator behind each, gathered from one byte table."""

    def __init__(self, n: int) -> None:
        words = [b"%d," % i for i in range(n)]
        self.size = np.array([len(w) for w in words], np.int64)
        self.offs = np.cumsum(self.size) - self.size
        self.table = np.frombuffer(b"".join(words), np.uint8)


def groups_text(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, digits: Digits) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of ``a1,a2|b1;`` of all groups, their ends)."""
    na, nb = np.diff(np.concatenate([[0], ga])), np.diff(np.concatenate([[0], gb]))
    total = np.cumsum(na + nb)
    ids = np.empty(len(a) + len(b), np.int64)
    ids[C.ragged(total - na - nb, na)], ids[C.ragged(total - nb, nb)] = a, b
    size = digits.size[ids]
    data = digits.table[C.ragged(digits.offs[ids], size)]
    ends = np.concatenate([[0], np.cumsum(size)])
    data[ends[total - nb] - 1] = ord("|")
    data[ends[total] - 1] = ord(";")
    return data, ends[total]


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """Concatenation of data[start:start + size) of every item, put together in
    steps of ``STEP`` bytes: an index is eight times as large as its bytes."""
    return b"".join(data[C.ragged(start[lo:hi], size[lo:hi])].tobytes() for lo, hi in stretches(size, STEP))


def stretches(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items that hold at most ``most`` bytes, or one item that holds more."""
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


# ------------------------------------------------------------------- Spark
def _packed(u: Units, width: int) -> tuple[bytes, int]:
    """All arrays of a batch but the texts' own, compressed, and their size."""
    parts = [u.a.astype(f"<u{width}"), u.b.astype(f"<u{width}"), *(x.astype("<u4") for x in (u.count_a, u.count_b, u.code))]
    raw = b"".join([np.array([len(x) for x in parts], "<i8").tobytes(), *(x.tobytes() for x in parts)])
    return pa.compress(raw, codec="zstd", asbytes=True), len(raw)


def _unpacked(blob: bytes, size: int, width: int, count: np.ndarray) -> Units:
    raw = pa.decompress(blob, size, codec="zstd", asbytes=True)
    n, at, parts = np.frombuffer(raw, "<i8", 5).tolist(), 40, []
    for k, w in zip(n, (width, width, 4, 4, 4), strict=True):
        parts.append(np.frombuffer(raw, f"<u{w}", k, at).astype(np.int64))
        at += k * w
    a, b, count_a, count_b, code = parts
    return Units(a, count_a, b, count_b, code, count)


_PARTS = T.StructType([T.StructField(n, t()) for n, t in (
    ("batch", T.LongType), ("pos", T.IntegerType), ("units", T.LongType), ("blob", T.BinaryType), ("raw", T.LongType),
    ("ida", T.IntegerType), ("idb", T.IntegerType), ("n", T.LongType), ("kind", T.IntegerType))])
TEXT, PAIR, BLOB = 0, 1, 2


def _tokens(make_a: Callable, make_b: Callable, keep: tuple[str, ...], width: int):
    """Per batch: a TEXT row for each text (its place and number of units), a
    PAIR row for each distinct linked id pair, a BLOB row with all units."""
    types = {"batch": pa.int64(), "units": pa.int64(), "blob": pa.binary(), "raw": pa.int64(), "n": pa.int64()}

    def rows(kind: int, batch: int, size: int, front: list, **cols) -> Iterator[pa.RecordBatch]:
        cols |= {"batch": np.full(size, batch), "kind": np.full(size, kind)}
        names = _PARTS.fieldNames()
        yield from pa.table([*front, *(pa.array(cols[c], types.get(c, pa.int32())) if c in cols else pa.nulls(size, types.get(c, pa.int32())) for c in names)],
                            names=[*keep, *names]).to_batches(max_chunksize=1 << 14)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = make_a(), make_b()
        batch = TaskContext.get().partitionId() << 32
        for t in (x for part in batches for x in text_steps(part, len(keep), BATCH)):
            u = units_of(a, b, t.column(len(keep)))
            front = t.columns[:len(keep)]
            yield from rows(TEXT, batch, t.num_rows, front, pos=np.arange(t.num_rows), units=u.count)
            blob, size = _packed(u, width)
            yield from rows(BLOB, batch, 1, [pa.nulls(1, x.type) for x in front], blob=[blob], raw=[size])
            # links of each unit once, as often as the unit occurs
            ends = np.cumsum(a.size[u.a])
            link, end = links_of(u.a, ends, u.b, np.cumsum(b.size[u.b]))
            often = np.bincount(u.code, minlength=len(u.count_a))
            unit_end = np.concatenate([[0], ends])[np.cumsum(u.count_a)]
            keys, which = np.unique(link, return_inverse=True)
            n = np.bincount(which, often[np.searchsorted(unit_end, end)], len(keys)).astype(np.int64)
            keys, n = keys[n > 0], n[n > 0]
            yield from rows(PAIR, batch, len(keys), [pa.nulls(len(keys), x.type) for x in front], ida=keys >> SHIFT, idb=keys & ((1 << 32) - 1), n=n)
            batch += 1
    return run


def _align(size_a: np.ndarray, size_b: np.ndarray, keep: tuple[str, ...], width: int):
    """The rows of a batch with the batch's row of pair counts -> results."""
    names = [*keep, *_ADDED.fieldNames()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = Digits(max(len(size_a), len(size_b)))
        for _, t in C.key_runs(batches, "batch"):
            t = t.combine_chunks()
            flat = t["pairs"].combine_chunks().flatten()
            keys = flat.field("ida").to_numpy().astype(np.int64) << SHIFT | flat.field("idb").to_numpy().astype(np.int64)
            order = np.argsort(keys)
            keys, total = keys[order], flat.field("total").to_numpy()[order]
            best = flat.field("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
            blob = t.filter(pc.is_valid(t["blob"]))
            t = t.filter(pc.is_valid(t["pos"])).sort_by("pos").combine_chunks()
            u = _unpacked(blob["blob"][0].as_py(), blob["raw"][0].as_py(), width, t["units"].to_numpy())
            # everything once per unit, then gathered by text
            ends_a, ends_b = np.cumsum(size_a[u.a]), np.cumsum(size_b[u.b])
            offs_a, offs_b = (np.concatenate([[0], np.cumsum(c)]) for c in (u.count_a, u.count_b))
            link, end = links_of(u.a, ends_a, u.b, ends_b)
            n_links = np.diff(np.searchsorted(end, np.concatenate([[0], ends_a])[offs_a], side="right"))
            # a unit that no text uses may have pairs without a count
            at = np.minimum(np.searchsorted(keys, link), max(len(keys) - 1, 0))
            sums = [per_text(x[at], n_links) if len(keys) else np.zeros(len(n_links), np.int64) for x in (best, total)]
            ga, gb = shared_groups(ends_a, ends_b, offs_a, offs_b)
            n_groups = np.diff(np.searchsorted(ga, offs_a, side="right"))
            data, ends = groups_text(u.a, u.b, ga, gb, digits)
            cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_groups)])]
            counts = [per_text(x[u.code], u.count) for x in (u.count_a, u.count_b, n_groups, n_links, *sums)]
            del flat, keys, total, best, order, blob, link, end, at, sums, ga, gb
            # the groups of a batch are several times its text, so they leave in parts
            unit, first = np.diff(cuts), np.concatenate([[0], np.cumsum(u.count)])
            size = per_text(unit[u.code], u.count)
            for lo, hi in stretches(size, OUT):
                code = u.code[first[lo]:first[hi]]
                raw = gathered(data, cuts[:-1][code], unit[code])
                stop = np.cumsum(size[lo:hi]).tolist()
                text = [raw[i:max(i, j - 1)].decode() for i, j in zip([0, *stop], stop, strict=False)]
                yield from pa.table([*t.slice(lo, hi - lo).select(list(keep)).columns, *(pa.array(x[lo:hi]) for x in counts),
                                     pa.array(text, pa.string())], names=names).to_batches(max_chunksize=1 << 12)
    return run


_ADDED = T.StructType([T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
                      + [T.StructField("groups", T.StringType())])


def align(docs: DataFrame, make_a: Callable[[], Side], make_b: Callable[[], Side], keep: tuple[str, ...] = ("doc_id",),
          vocabulary: int = 1 << 16) -> DataFrame:
    """One row per row of ``docs``: ``keep``, n_a, n_b, n_groups, n_links, n_best
    (links whose pair is the most frequent one of its B id), count_sum (sum of
    the links' pair counts), groups (``a1,a2|b1;a3|b2,b3``).  ``vocabulary``: at
    least as many as either side has ids."""
    spark = docs.sparkSession
    C.small_batches(spark)
    width = 2 if vocabulary <= 1 << 16 else 4
    src = docs.select(*keep, "text")
    fields = src.schema.fields[:len(keep)]
    wide = T.StructType([*fields, *_PARTS.fields])
    path = C.new_path(spark, "token-pairs")
    src.mapInArrow(C.tidy(_tokens(make_a, make_b, keep, width)), wide).write.partitionBy("kind").parquet(path)
    both = spark.read.schema(wide).parquet(path)
    pairs = both.where(F.col("kind") == PAIR).select("batch", "ida", "idb", "n")
    counts = C.materialize(pairs.groupBy("ida", "idb").agg(F.sum("n").alias("total")), "pair-counts")
    top = counts.groupBy("idb").agg(F.max("total").alias("top"))
    known = counts.join(top, "idb").select("ida", "idb", "total", (F.col("total") == F.col("top")).alias("best"))
    info = pairs.drop("n").join(known, ["ida", "idb"]) \
        .groupBy("batch").agg(F.collect_list(F.struct("ida", "idb", "total", "best")).alias("pairs"))
    texts = both.where(F.col("kind") != PAIR).select(*keep, "batch", "pos", "units", "blob", "raw")
    met = texts.withColumn("pairs", F.lit(None).cast(info.schema["pairs"].dataType)).unionByName(info, allowMissingColumns=True)
    return C.by_key(met, "batch").mapInArrow(C.tidy(_align(make_a().size, make_b().size, keep, width)), T.StructType([*fields, *_ADDED.fields]))
