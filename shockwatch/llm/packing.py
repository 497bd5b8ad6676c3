"""Packing documents into sequences: Martello-Toth dominance reduction, then best fit.

Documents become token ids, are cut at the capacity and only their lengths take part in the packing.
Items of one length are interchangeable, so the instance is a histogram with at most ``capacity``
entries whatever the corpus holds; the plan made from it on the driver is bounded by the capacity.

* ``reduce_instance``: for the longest item j, a set of at most two partners that dominates every
  other way to fill j's sequence is fixed for good (j alone if nothing fits; one partner if it fills
  the sequence, or if no two others fit together; two partners if they cover every feasible pair).
* ``best_fit``: what is left goes, longest first, to the open sequence with the least room.

The plan is a list of (sequence pattern, how many). Pieces are numbered within their length (hot
lengths in hashed buckets, see ``common.numbered``) and take the slot of their number.

Defined cases: a null or empty text is one piece, the end token; repeated rows and null ids are
pieces of their own; ties between equal lengths go by doc_id, piece and digest; an empty table gives
an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, store, text_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
MEMORY = 400_000


def byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Token ids of texts as packed little-endian unsigned 32-bit numbers.

    For a tokenizer that drops white space and never looks past it, a text is the sequence of its
    space-separated words, and a worker encodes equal words once. Letters before closing punctuation
    form a token sequence of their own, so "Word," and "word" share one entry, which goes straight to
    the library's BPE model; everything else goes through the whole tokenizer. The constructor holds
    this way against whole texts and falls back to encoding those if they differ.
    """

    simple = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")
    probe = ("Some words, OF a Text... don't we'LL\n\nstop? ÉTÉ Über; naïve (x) [y] 12 a1b2 é! \u0130I \u1e9e ß"
             " <|x|> __init__ a_b ### word%%% 'quoted' \t tab  two  spaces e\u0301 \u0301 ﬁ Ａ")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {"": b""}
        self.runs: dict[str, bytes] = {}
        self.by_word = [self.joined(self.probe.split(" "))] == list(self.encoded([self.probe]))

    def encoded(self, texts: list[str]) -> Iterator[bytes]:
        for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.asarray(found.ids, "<u4").tobytes()

    def run(self, letters: str) -> bytes:
        """Ids of a run of letters, lower case, or of a run of punctuation."""
        mapped = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.letters)
        found = [t.id for t in self.tokenizer.model.tokenize(mapped)]
        return struct.pack(f"<{len(found)}I", *found)

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words not seen yet; their runs are remembered while there is room."""
        runs, out, rest = self.runs, {}, []
        match = self.simple.match
        if len(runs) > MEMORY:
            runs = {}  # full: what this batch needs is kept for this batch
        for word in words:
            parts = match(word)
            if not parts:
                rest.append(word)
                continue
            letters, end = parts[1].lower(), parts[2]
            ids = runs.get(letters)
            if ids is None:
                ids = self.runs.get(letters) or self.run(letters)
                runs[letters] = ids
            if end:
                tail = runs.get(end)
                if tail is None:
                    tail = runs[end] = self.runs.get(end) or self.run(end)
                ids += tail
            out[word] = ids
        lines = {line for word in rest if "\n" in word for line in word.split("\n")} - {""}
        inner = self.learn(lines) if lines else {}
        plain = [word for word in rest if "\n" not in word]
        out.update(zip(plain, self.encoded(plain), strict=True))
        out.update({word: b"".join([inner[line] for line in word.split("\n") if line]) for word in rest if "\n" in word})
        return out

    def joined(self, words: list[str]) -> bytes:
        learned = self.learn(set(words) - {""})
        return b"".join([learned[w] for w in words if w])

    def batch(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return list(self.encoded(texts))
        split = [text.split(" ") for text in texts]
        known = self.words
        new = self.learn({w for words in split for w in words if w not in known})
        if len(known) + len(new) <= MEMORY:
            known.update(new)
            return [b"".join(map(known.__getitem__, words)) for words in split]
        return [b"".join([known[w] if w in known else new[w] for w in words]) for words in split]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One per Python worker: the next task of a worker starts with the words it has met."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(tokenizer_path), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            out: list[list] = [[], [], [], [], []]
            for at in range(0, len(ids), 256):
                for doc, packed in zip(ids[at:at + 256], words.batch(texts.slice(at, 256).to_pylist()), strict=True):
                    packed += end
                    starts = range(0, len(packed) // 4, capacity)
                    cuts = [packed[4 * s:4 * (s + capacity)] for s in starts]
                    out[0] += repeat(doc, len(cuts))
                    out[1] += range(len(cuts))
                    out[2] += starts
                    out[3] += [len(c) // 4 for c in cuts]
                    out[4] += map(zlib.crc32, cuts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()),
                                                strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(cut, PIECES)


class Lengths:
    """A multiset of lengths with ordered access."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: v for k, v in counts.items() if v > 0}
        self.sorted = sorted(self.counts)

    def __bool__(self) -> bool:
        return bool(self.sorted)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.sorted.pop(bisect_left(self.sorted, length))

    def largest(self, room: int, spare: dict[int, int] | None = None) -> int | None:
        """The largest length within ``room``, when the items in ``spare`` are set aside."""
        at = bisect_left(self.sorted, room + 1) - 1
        while at >= 0 and self.counts[self.sorted[at]] <= (spare or {}).get(self.sorted[at], 0):
            at -= 1
        return self.sorted[at] if at >= 0 else None

    def smallest(self, n: int, spare: dict[int, int]) -> list[int]:
        out: list[int] = []
        for length in self.sorted:
            out += [length] * min(n - len(out), self.counts[length] - spare.get(length, 0))
            if len(out) == n:
                break
        return out


def dominating(items: Lengths, longest: int, capacity: int) -> tuple[int, ...] | None:
    """Partners that dominate every other filling of the sequence of ``longest``; None if unproved."""
    room, own = capacity - longest, {longest: 1}
    first = items.largest(room, own)
    if first is None:
        return ()
    if first == room:
        return (first,)
    low = items.smallest(3, own)
    if len(low) < 2 or low[0] + low[1] > room:
        return (first,)  # no two others fit: the largest single partner dominates
    if len(low) == 3 and sum(low) <= room:
        return None  # three may fit: nothing is proved here
    # pairs at most. A pair's larger item is at most ``first``; (first, second) dominates if no
    # pair's smaller item exceeds ``second``. A pair no larger than ``first`` is dominated by it.
    second = items.largest(room - first, {longest: 1, first: 1 + (first == longest)})
    middle = items.largest(room // 2, own)
    if middle is None:
        return None

    def paired(y: int) -> bool:
        x = items.largest(room - y, {longest: 1 + (y == longest), y: 1 + (y == longest)})
        return x is not None and x >= y

    y = middle  # the largest that can be the smaller item of a feasible pair
    while y is not None and not paired(y):
        y = items.largest(y - 1, own)
    if y is None:
        return (first,)
    best = max_pair(items, longest, room)
    if best <= first:
        return (first,)
    if second is not None and y <= second:
        return (first, second)
    return None


def max_pair(items: Lengths, longest: int, room: int) -> int:
    """The largest sum of two items within ``room`` beside ``longest``."""
    best = 0
    for x in items.sorted:
        if x > room or items.counts[x] <= (x == longest):
            continue
        y = items.largest(room - x, {longest: 1 + (x == longest), x: 1 + (x == longest)})
        if y is not None:
            best = max(best, x + y)
    return best


def reduce_instance(items: Lengths, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets, longest item first, until a whole pass fixes none; shrinks ``items``."""
    fixed: list[tuple[tuple[int, ...], int]] = []
    changed = True
    while changed:
        changed = False
        length = items.sorted[-1] if items else None
        while length is not None:
            found = dominating(items, length, capacity)
            if found is None:
                length = items.largest(length - 1)
                continue
            pattern = (length, *found)
            each = {k: pattern.count(k) for k in pattern}
            # each proof stays valid while the items last: what is removed only narrows the alternatives
            n = min(items.counts[k] // each[k] for k in each)
            for k in each:
                items.take(k, n * each[k])
            fixed.append((pattern, n))
            changed = True
            if length not in items.counts:
                length = items.largest(length - 1)
    return fixed


def best_fit(items: Lengths, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first. Sequences with equal contents are handled together."""
    rooms: list[int] = []  # rooms of open sequences, sorted
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], n: int) -> None:
        room = capacity - sum(pattern)
        if not room:
            done.append((pattern, n))
            return
        if room not in open_:
            insort(rooms, room)
            open_[room] = []
        open_[room].append((pattern, n))

    for length in reversed(items.sorted):
        left = items.counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                pattern, n = open_[rooms[at]].pop()
                if not open_[rooms[at]]:
                    del open_[rooms.pop(at)]
            else:
                pattern, n = (), left
            fit = (capacity - sum(pattern)) // length  # best fit stays with a sequence while it holds one more
            full = min(n, left // fit)
            if full:
                put(pattern + (length,) * fit, full)
            rest = left - full * fit if full < n else 0
            if 0 < rest < fit:
                put(pattern + (length,) * rest, 1)
                if pattern and n - full - 1:
                    put(pattern, n - full - 1)
                left = 0
            else:
                if pattern and n - full:
                    put(pattern, n - full)
                left -= full * fit
    return done + [x for room in rooms for x in open_[room]]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences) for a histogram of lengths."""
    items = Lengths(counts)
    fixed = reduce_instance(items, capacity)
    return fixed + best_fit(items, capacity)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first number of each run of slots, its first sequence and its offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            runs.setdefault(length, []).append((used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        sequence += n
    return {k: tuple(np.array(v, np.int64).T) for k, v in runs.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Every piece with its sequence_id and its offset there; offsets are gapless from 0."""
    spark = docs.sparkSession
    cut = store(pieces(docs, tokenizer_path, capacity, end_id), "pack-pieces")
    counts = {r["length"]: r["n"] for r in  # at most ``capacity`` rows
              cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = spark.sparkContext.broadcast(slots(plan(counts, capacity)))  # bounded by the capacity

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("_number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length):
                mine = np.flatnonzero(length == value)
                first, at, start = where.value[int(value)]
                run = np.searchsorted(first, number[mine], "right") - 1
                sequence[mine] = at[run] + number[mine] - first[run]
                offset[mine] = start[run]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"])

    order = ["doc_id", "piece", "start", "ids_crc32"]
    return numbered(cut, "length", order, "_number", "pack-numbered").mapInArrow(
        place, PIECES + ", sequence_id long, offset long")
