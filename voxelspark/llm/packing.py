"""Packing token sequences by bulk-synchronous best fit.

Documents are tokenised once and cut into pieces of at most `capacity` tokens. Pieces over half the capacity open a
sequence each. Then, in rounds: the unplaced pieces and the gaps of all sequences are sorted together by size, a
successor sweep pairs pieces with gaps, the gaps shrink, and the rest goes to the next round.

The sweep reads the sorted order as brackets, a piece opening and a gap closing one, so that every gap gets the largest
piece that fits it and is not taken by a smaller gap. Pieces of one length are alike, and so are gaps of one size: a
round therefore sweeps over the table of (size, kind) counts, at most 2 * capacity rows however many documents there
are, and pairs whole ranges of ranks. The rows move once: a piece's rank among those of its length is its number within
its task, counted while it is made, plus the counts of the tasks before; the rank tells its sequence and its place.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, by_bytes, durable, text_batches, tidy
from .shingles import LOWER, SPACE

#: Stems of words that a worker keeps (twice as many at most), and bytes of text that it looks at together.
CACHE_STEMS, TOGETHER = 150_000, 1 << 22
#: Marks that may close a word. A run of them is a token run of its own, as none is a letter, a digit or an apostrophe.
MARKS = "!#$%&*+,-./:;<=>?@^_|~()[]{}"
#: Letters below this code point are taken one by one; none of them joins with a mark.
PLAIN = 0x250
# The parts of a tokenizer file with which words can be encoded one by one.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def spans(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s : s + n] for each of starts and lengths, one after the other."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    at = np.repeat((starts - (ends - lengths)).astype(np.int32), lengths)
    at += np.arange(len(at), dtype=np.int32)
    return values[at]


def _array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _strings(x: pa.Array) -> list[str]:
    """The strings of x, none of which has a line break."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x), "\n")[0].as_py().split("\n") if len(x) else []


class WordTokens:
    """Token ids of texts.

    A tokenizer with the parts BY_WORD drops white space, never joins across it, ignores case and takes every run of
    letters by itself, so each different word of a slice of text is encoded once: its stem, the word without the marks
    at the end, and the marks. A plain stem goes to the tokenizer's merges at once, all other words go through the
    whole tokenizer. Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.added = [t["content"] for t in parts["added_tokens"] or ()]
        self.by_word = all(parts.get(k) == v for k, v in BY_WORD.items()) and not any(c.isspace() for t in self.added for c in t)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        self.symbols = {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in range(PLAIN) if chr(c).isalpha()} if self.by_word else {}
        self.stems: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    def _any(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)] if words else []

    def _stem(self, stem: str) -> bytes | None:
        """Ids of a plain stem; None for all others."""
        stem = stem.lower()
        if not stem.isalpha() or ord(max(stem)) >= PLAIN:
            return None
        return array("I", [t.id for t in self.merge(stem if stem.isascii() else stem.translate(self.symbols))]).tobytes()

    def _of_stems(self, stems: list[str]) -> list[bytes | None]:
        if len(self.stems) > CACHE_STEMS:
            self.stems, self.older = {}, self.stems
        known, older = self.stems, self.older
        for x in stems:
            if x not in known:
                known[x] = older[x] if x in older else self._stem(x)
        return [known[x] for x in stems]

    def _lowered(self, data: np.ndarray) -> np.ndarray:
        """data with a-z for A-Z where that changes no ids: not beside combining marks (U+0300 to U+036F), with which
        only small letters may be composed, and not where an added token would appear."""
        if ((data == 0xCC) | (data == 0xCD)).any():
            return data
        low = LOWER[data]
        said = low.tobytes()
        return data if any(t.encode() in said for t in self.added) else low

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words (string, without white space), one after the other, and how many each has."""
        size = lambda x: np.diff(np.frombuffer(x.buffers()[1], np.int32)[: len(x) + 1])
        stems = pc.ascii_rtrim(words, characters=MARKS)
        coded = stems.dictionary_encode()
        stem = coded.indices.to_numpy()
        total, own = size(words), size(stems)
        marked = np.flatnonzero((total > own) & (own > 0))
        starts = np.cumsum(total) - total + own
        ends = _array(spans(np.frombuffer(words.buffers()[2], np.uint8), starts[marked], (total - own)[marked]), (total - own)[marked], pa.string()).dictionary_encode()
        of_stems = self._of_stems(_strings(coded.dictionary)) if len(words) else []
        rest = np.flatnonzero(np.array([x is None for x in of_stems], bool)[stem])
        parts = [*(x or b"" for x in of_stems), b"", *self._any(_strings(ends.dictionary)), *self._any(_strings(words.take(pa.array(rest))))]
        unit = np.full((len(words), 2), len(of_stems))
        unit[:, 0] = stem
        unit[marked, 1] = len(of_stems) + 1 + ends.indices.to_numpy()
        unit[rest, 0] = len(of_stems) + 1 + len(ends.dictionary) + np.arange(len(rest))
        unit[rest, 1] = len(of_stems)
        n = np.array([len(x) // 4 for x in parts])
        flat = np.frombuffer(b"".join(parts), "<u4")
        return spans(flat, (np.cumsum(n) - n)[unit.ravel()], n[unit.ravel()]), n[unit].sum(axis=1)

    def _of_slice(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the adjacent texts (none empty) that begin at starts, one after the other, and how many each has."""
        solid = ~SPACE[data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        first[starts] = solid[starts]
        at = np.flatnonzero(first)
        before = np.zeros(len(data) + 1, np.int32)
        np.cumsum(solid, out=before[1:])
        lengths = np.diff(np.append(before[at], before[-1]))
        words = _array(self._lowered(data)[solid], lengths, pa.string()).dictionary_encode()
        flat, own = self._of_words(words.dictionary)
        which = words.indices.to_numpy()
        upto = np.append(0, np.cumsum(own[which]))[np.append(np.searchsorted(at, starts), len(at))]
        return spans(flat, (np.cumsum(own) - own)[which], own[which]), np.diff(upto)

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Unsigned 32-bit ids of each text (binary); null is the empty text. A long text is taken slice by slice."""
        if not self.by_word:
            for x in texts:
                yield np.frombuffer(self._any([(x.as_py() or b"").decode()])[0], "<u4")
            return
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + TOGETHER, side="right")) - 1)
            if j > i + 1 or offsets[j] - offsets[i] <= TOGETHER:
                full = np.flatnonzero(np.diff(offsets[i : j + 1]))
                n = np.zeros(j - i, np.int64)
                ids = np.zeros(0, np.uint32)
                if len(full):
                    ids, n[full] = self._of_slice(data[offsets[i] : offsets[j]], offsets[i:j][full] - offsets[i])
                yield from np.split(ids, np.cumsum(n)[:-1])
            else:
                parts, a = [], int(offsets[i])
                while a < offsets[j]:
                    b = min(a + TOGETHER, int(offsets[j]))
                    while b < offsets[j] and not SPACE[data[b]]:  # a word stays whole
                        b += 1
                    parts.append(self._of_slice(data[a:b], np.zeros(1, np.int64))[0])
                    a = b
                yield np.concatenate(parts)
            i = j


@cache
def word_tokens(path: str) -> WordTokens:
    """One for each Python worker: its later tasks go on with the stems of its earlier ones."""
    return WordTokens(path)


def _pieces(path: str, capacity: int, end: int):
    """(id, text) -> id, piece, start, length, crc, part, rank: rank counts the pieces of its length in its task, part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, last = word_tokens(path), np.array([end], "<u4")
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in (part for b in batches for part in by_bytes(b, 1, TOGETHER)):
            at, cols = [], [array(t) for t in "iqqqq"]
            for i, ids in enumerate(tokens.ids(batch.column(1))):
                ids = np.concatenate([ids, last])
                for k, start in enumerate(range(0, len(ids), capacity)):
                    piece = ids[start : start + capacity]
                    n = len(piece)
                    at.append(i)
                    for col, x in zip(cols, (k, start, n, zlib.crc32(piece), seen[n]), strict=True):
                        col.append(x)
                    seen[n] += 1
            arrays = [pa.array(np.frombuffer(c, c.typecode) if len(c) else [], t) for c, t in zip(cols, (pa.int32(), *[pa.int64()] * 4), strict=True)]
            parts = pa.array(np.full(len(at), part, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *arrays, parts], names=["id", "piece", "start", "length", "crc", "rank", "part"])

    return run


@dataclass
class Places:
    """Ranges of ranks, by length and first rank: rank first + k of the length goes to sequence + k, at offset."""

    keys: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    RANKS = 1 << 42  # more than there are pieces

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length * self.RANKS + rank
        i = np.searchsorted(self.keys, key, side="right") - 1
        return self.sequence[i] + (key - self.keys[i]), self.offset[i]


def arrange(counts: dict[int, int], capacity: int) -> Places:
    """The rounds of best fit over counts (length -> pieces). When a round places nothing, as many empty sequences are
    opened as the rest needs at least."""
    rest, ranks, gaps = dict(sorted(counts.items())), defaultdict(int), defaultdict(list)
    rows: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
    opened = 0

    def give(length: int, k: int, gap: int) -> list[tuple[int, int]]:
        """Puts k pieces into the last k sequences with that gap; returns these as runs of (first, number)."""
        taken = []
        while k:
            first, n = gaps[gap].pop()
            m = min(k, n)
            if n > m:
                gaps[gap].append((first, n - m))
            rows.append((length, ranks[length], first + n - m, capacity - gap))
            ranks[length] += m
            taken.append((first + n - m, m))
            k -= m
        return taken

    for length in [x for x in rest if 2 * x > capacity]:
        n = rest.pop(length)
        rows.append((length, 0, opened, 0))
        if length < capacity:
            gaps[capacity - length].append((opened, n))
        opened += n
    while rest:
        moved, waiting, left = [], [], sum(rest.values())
        for size in sorted({*rest, *gaps}):
            if size in rest:
                waiting.append(size)
            free = sum(n for _, n in gaps.get(size, ()))
            while free and waiting:
                length = waiting[-1]
                k = min(free, rest[length])
                moved += [(size - length, run) for run in give(length, k, size)]
                free -= k
                rest[length] -= k
                if not rest[length]:
                    del rest[length]
                    waiting.pop()
            if not gaps.get(size, True):
                del gaps[size]
        for gap, run in moved:
            if gap:
                gaps[gap].append(run)
        if rest and left == sum(rest.values()):
            new = -(-sum(x * n for x, n in rest.items()) // capacity)
            gaps[capacity].append((opened, new))
            opened += new
    rows.sort()
    length, rank, sequence, offset = np.array(rows or np.zeros((0, 4)), np.int64).T
    return Places(length * Places.RANKS + rank, sequence, offset)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces: (length 1..capacity, part, rank, ...), rank counting from 0 within a length and part. Adds sequence_id, offset."""
    counts = durable(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    places = arrange({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    few = counts.count() <= BROADCAST_IDS // 4
    ranked = pieces.join(F.broadcast(before) if few else before, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")
    sent = pieces.sparkSession.sparkContext.broadcast(places)  # its size depends on the capacity, not on the pieces
    kept = [c for c in ranked.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.find(*(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, found)], names=[*kept, "sequence_id", "offset"])

    schema = ranked.select(*kept, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return ranked.mapInArrow(run, schema)


def best_fit(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces: (pid unique, length 1..capacity) -> (pid, sequence_id, offset)."""
    parts = max(64, pieces.count() // 50_000)
    dealt = pieces.select("pid", F.col("length").cast("long").alias("length"), F.pmod(F.xxhash64("pid"), F.lit(parts)).cast("int").alias("part"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("pid")) - 1
    ranked = durable(dealt.withColumn("rank", rank.cast("long")))
    return place(ranked, capacity).select("pid", "sequence_id", "offset")


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are its tokens and `end`; a null text counts as empty and so is one piece of one id. Only documents
    over the capacity are cut. Rows with equal ids or texts are packed each on its own; a null id stays null; other
    columns are ignored; no rows give no rows. Sequences are filled from 0 without gaps.
    """
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, crc long, rank long, part int"
    raw = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    with text_batches(docs.sparkSession):
        pieces = durable(raw.mapInArrow(tidy(_pieces(tokenizer_path, capacity, end)), schema))
    placed = place(pieces, capacity)
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
