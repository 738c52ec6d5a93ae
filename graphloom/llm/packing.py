"""Best-fit decreasing packing of tokenised documents into sequences of a fixed length.

Best-fit decreasing only looks at lengths, and a length is at most ``capacity``. So the packing is decided on the
histogram of piece lengths, at most ``capacity`` rows whatever the corpus holds: a segment tree over remaining capacities
finds the tightest open capacity for a length in logarithmic time, and all equal pieces that go to equally filled bins are
placed in one step. The result is the global best-fit decreasing packing, not one per partition. Its steps are ranges
of (length, rank) to (sequence, offset); each piece gets its rank among the pieces of its length and reads its place off
them.

Ranks are counted within (length, salt) and shifted by the counts of the smaller salts, so a length that a third of all
pieces share is spread over ``SALTS`` groups.

Ids are those of the tokenizer file. Texts whose characters every engine classes alike are merged by ``tiktoken`` from the file's own
vocabulary, which holds no state between texts; all others by ``tokenizers``.

Defined cases: a null or empty text is one piece that holds the end mark alone; repeated rows are packed each; an empty
table gives no pieces; a piece of the full length fills a sequence.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.storage import keep, texts

SALTS = 256
# How the byte-level tokenizer cuts a text before merging, and its special mark.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARK = "<|endoftext|>"
#: In texts of these characters alone all engines agree on letters, digits and blanks; other texts go to the tokenizer whole.
PLAIN = r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-ɏΑ-ΡΣ-ҁҊ-ԯ‐-‧‰-⁞ぁ-ゖァ-ヺ一-龥가-힣]*"
#: ASCII characters outside ``PLAIN`` are the control characters but for tab, line feed and carriage return.
ASCII_PLAIN = bytes([9, 10, 13, *range(32, 127)])
#: Texts with a longer word or more blanks beside those between words go to the tokenizer, too: merging is quadratic in a word.
WORD, BLANKS = 1_000, 100_000
#: By tokenizer file, kept in this worker process from task to task.
_encoders: dict[str, Callable[[list[str]], list[bytes]]] = {}


def _merging(path: str):
    """The same merges run by ``tiktoken``, where the file allows it (ids in the order of merges); several times as fast."""
    import tiktoken

    held = json.loads(Path(path).read_text(encoding="utf-8"))
    cutter, model = held["pre_tokenizer"] or {}, held["model"]
    ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    special = {a["content"] for a in held["added_tokens"]}
    byte_level = cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space")
    if not byte_level or held["normalizer"] or special != {MARK} or any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
        return None
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    ranks = {bytes(letters[c] for c in token): k for token, k in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def byte_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids as little-endian 32-bit words."""
    if path in _encoders:
        return _encoders[path]
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer, merging, plain = Tokenizer.from_file(path), _merging(path), re.compile(PLAIN).fullmatch

    def usual(text: str) -> bool:
        if MARK in text or not (not text.encode().translate(None, ASCII_PLAIN) if text.isascii() else plain(text)):
            return False
        sizes = [len(w) for w in text.split()]
        return max(sizes, default=0) <= WORD and len(text) - sum(sizes) - len(sizes) <= BLANKS

    def one(text: str) -> bytes:
        if merging is not None and usual(text):
            return merging.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    return _encoders.setdefault(path, lambda batch: [one(text) for text in batch])


def cut_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: all full but the first, which takes the rest."""
    rest = total % capacity
    return ([rest] if rest else []) + [capacity] * (total // capacity)


def _piece_rows(path: str, capacity: int, end: int):
    mark = np.asarray([end], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part, out = batch.slice(low, 64), []
                for doc_id, data in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    data, start = data + mark, 0
                    for k, length in enumerate(cut_lengths(len(data) // 4, capacity)):
                        out.append((doc_id, k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
                        start += length
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows


class _Open:
    """Segment tree over remaining capacities 0..capacity: which of them have open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, capacity: int, value: bool) -> None:
        at = capacity + self.size
        self.open[at] = value
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity from ``least`` on that has an open bin."""
        at = least + self.size
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Steps (length, first rank, pieces, first sequence, offset) of best-fit decreasing, and the sequences used.

    A step puts consecutive ranks of one length into consecutive sequences at one offset.
    """
    tree, ranges = _Open(capacity), [[] for _ in range(capacity + 1)]  # ranges: by capacity, (first sequence, sequences)
    steps: list[tuple[int, int, int, int, int]] = []
    used = 0

    def add(room: int, first: int, count: int) -> None:
        if count and room:
            if not ranges[room]:
                tree.set(room, True)
            ranges[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, count = capacity, used, -(-left // (capacity // length))
                used += count
            else:
                first, count = ranges[room].pop()
                if not ranges[room]:
                    tree.set(room, False)
            # A bin takes as many of these pieces as fit before the next one is touched: it is the tightest until then.
            each = room // length
            full = min(count, left // each)
            for slot in range(each if full else 0):
                steps.append((length, rank + slot * full, full, first, capacity - room + slot * length))
            rank, left = rank + each * full, left - each * full
            add(room - each * length, first, full)
            if full < count and left:
                part = min(left, each)
                for slot in range(part):
                    steps.append((length, rank + slot, 1, first + full, capacity - room + slot * length))
                rank, left = rank + part, left - part
                add(room - part * length, first + full, 1)
                add(room, first + full + 1, count - full - 1)
            else:
                add(room, first + full, count - full)
    return steps, used


def _placed_rows(steps: list[tuple[int, int, int, int, int]], capacity: int):
    table = np.array(sorted(steps), np.int64).reshape(-1, 5)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.searchsorted(table[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(length), np.int64)
            for value in np.unique(length):
                own = length == value
                first = table[bounds[value] : bounds[value + 1], 1]
                at[own] = bounds[value] + np.searchsorted(first, rank[own], side="right") - 1
            sequence = table[at, 3] + rank - table[at, 1]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(table[at, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece of a document's ids."""
    types = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = keep(texts(docs).mapInArrow(_piece_rows(tokenizer, capacity, end), types))
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS))
    counts = keep(pieces.groupBy("length", salt.alias("salt")).agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps, _ = best_fit(histogram, capacity)
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("salt", salt).withColumn("row", F.row_number().over(order) - 1).join(before, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("row") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(_placed_rows(steps, capacity), types + ", sequence_id long, offset long")
