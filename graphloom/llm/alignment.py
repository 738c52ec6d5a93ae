"""Alignment of two tokenizers' tokens over the same bytes, by interval coalescing.

Both tokenizers read a text with a blank put before it. Their tokens are intervals of its bytes. All intervals of both sides are
sorted by start (``lexsort``) and the running maximum of their ends is taken (``maximum.accumulate``); a group breaks where
a start reaches that maximum, which is where tokens of both sides end. Overlapping pairs are expanded within groups; a pair that
ends together is a link. How often a pair of ids is linked in the whole corpus gives each link its count.

A word with the blanks before it is encoded and aligned once and then remembered: no token of either side goes from a non-blank into
a following blank, so both sides break there and a text's alignment is that of its words one after another. That
property is read off both vocabularies when they are loaded, and new words are encoded many at a time for the same reason. Texts with other white space or control marks than blank, line feed and
tab, and texts in which a word does not give its own bytes, are encoded and aligned whole.

Counts: the documents of ``BLOCK`` bytes of text are one written row that holds their distinct pairs and the words in terms of those.
Only distinct pairs with their number of uses are shuffled; totals come back to the blocks by id, and the documents' sums are read
off inside each block. The highest count of each id of the second side has at most as many rows as that vocabulary and is broadcast.

Defined cases: texts null or empty, and texts that either side does not give back byte for byte, have no tokens, zeros and an empty
``groups``; repeated rows are aligned and counted each; an empty table gives no rows; other columns are ignored; a text
longer than a block is a block of its own.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.storage import keep, texts

BLOCK = 8 << 20
#: Blocks written to one file; a task holds the blocks of a file in memory.
BLOCKS_PER_FILE = 2
BATCH = 4_000
#: Words encoded as one text.
JOINED = 64
#: Words remembered per generation by a worker, and the longest one in characters; the last two generations are held.
CACHE, LONGEST = 150_000, 48
BLANKS = " \n\t"
WORDS = re.compile(f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+")
#: White space apart from BLANKS, and what only one side's rules take for white space.
ODD = re.compile(f"[^\\S{BLANKS}]|[\x00-\x08\x0e-\x1f\x7f-\x9f▁]")


def coalesce(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group number of every interval of A and of B."""
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((np.arange(len(start)), start))
    reach = np.maximum.accumulate(end[order])
    group = np.zeros(len(start), np.int64)
    group[order[1:]] = np.cumsum(start[order[1:]] >= reach[:-1])
    return group[: len(a_start)], group[len(a_start) :]


def overlapping(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of overlapping intervals; each side's intervals are in order and do not overlap each other."""
    first, stop = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    sizes = stop - first
    a = np.repeat(np.arange(len(a_start)), sizes)
    return a, np.arange(len(a)) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)


def _byte_level() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Encodes and aligns words, and remembers them."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        byte = _byte_level()
        self.bytes_a = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, k in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.blank = self.b.piece_to_id("▁")
        # A token in ``groups`` with what follows it: inside its side, and where its side of a group ends.
        self.names = [f"{k}{c}" for table, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for c in ends for k in range(len(table))]
        self.name_size = np.array([len(x) for x in self.names], np.int64)
        inside = re.compile(f"[^{BLANKS}][{BLANKS}]".encode())
        within = [x.decode(errors="replace") for table in (self.bytes_a, self.bytes_b) for x in table if inside.search(x)]
        self.by_word = all(map(ODD.search, within))  # texts with those are aligned whole
        self.now: dict[str, tuple[str, int, int, bytes]] = {}
        self.last: dict[str, tuple[str, int, int, bytes]] = {}

    def _ids_a(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]

    def _ids_b(self, parts: list[str]) -> list[list[int]]:
        ids = [x or [self.blank] for x in self.b.encode([x[1:] if x[0] == " " else x for x in parts], num_threads=1)]
        # A word after a line feed or tab gets a blank that is not there; where it merged with the word, the bytes will not agree.
        return [ids[1:] if x[0] != " " and ids and ids[0] == self.blank else ids for x, ids in zip(parts, ids, strict=True)]

    def _tokens(self, parts: list[str], length: np.ndarray, plain: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per side: how many tokens each part has, and all ids. The first ``plain`` parts are words behind blanks, of ``length`` bytes.

        Those are encoded JOINED at a time, as a call costs more than a word; where an end of one is no end of a token, singly.
        """
        spans = [(low, min(low + JOINED, plain)) for low in range(0, plain, JOINED)] + [(k, k + 1) for k in range(plain, len(parts))]
        sides = []
        for encode, size in ((self._ids_a, self.size_a), (self._ids_b, self.size_b)):
            counts, flat = [], []
            for (low, high), ids in zip(spans, encode(["".join(parts[low:high]) for low, high in spans]), strict=True):
                made, ends = np.cumsum(size[np.array(ids, np.int64)]), np.cumsum(length[low:high])
                at = np.searchsorted(made, ends, "right")
                if high - low == 1:
                    counts.append([len(ids)])
                    flat.append(ids)
                elif len(ids) and made[-1] == ends[-1] and (made[at - 1] == ends).all():
                    counts.append(np.diff(at, prepend=0))
                    flat.append(ids)
                else:
                    each = encode(parts[low:high])
                    counts.append(list(map(len, each)))
                    flat.extend(each)
            sides.append((np.concatenate(counts).astype(np.int64), np.fromiter(chain.from_iterable(flat), np.int64)))
        return sides

    def align(self, parts: list[str]) -> list[tuple[str, int, int, bytes] | None]:
        """Per part: its groups, tokens of A, tokens of B and linked pairs (A's id << 32 | B's id); None where the bytes differ."""
        plain = [x[0] == " " and x[-1] not in BLANKS for x in parts]
        order = np.argsort(np.logical_not(plain), kind="stable")
        raw = [parts[k].encode() for k in order]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        sides = self._tokens([parts[k] for k in order], length, sum(plain))
        good = np.ones(len(raw), bool)
        for (count, flat), size in zip(sides, (self.size_a, self.size_b), strict=True):
            good &= np.bincount(np.repeat(np.arange(len(raw)), count), size[flat], len(raw)) == length
        for (count, flat), table in zip(sides, (self.bytes_a, self.bytes_b), strict=True):
            k = np.flatnonzero(good)
            made = b"".join(map(table.__getitem__, flat[np.repeat(good, count)].tolist()))
            wrong = np.frombuffer(made, np.uint8) != np.frombuffer(b"".join([raw[i] for i in k]), np.uint8)
            good[k[np.searchsorted(np.cumsum(length[k]), np.flatnonzero(wrong), "right")]] = False
        out: list[tuple[str, int, int, bytes] | None] = [None] * len(parts)
        if not good.any():
            return out
        (n_a, flat_a), (n_b, flat_b) = ((count[good], flat[np.repeat(good, count)]) for count, flat in sides)
        end_a, end_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        start_a, start_b = end_a - self.size_a[flat_a], end_b - self.size_b[flat_b]
        group_a, group_b = coalesce(start_a, end_a, start_b, end_b)
        i, j = overlapping(start_a, end_a, start_b, end_b)
        together = end_a[i] == end_b[j]
        i, j = i[together], j[together]
        links = ((flat_a[i] << 32) | flat_b[j]).tobytes()
        # Groups as text: A's tokens of a group, then B's, each with the mark that follows it.
        name = np.empty(len(flat_a) + len(flat_b), np.int64)
        last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
        name[np.arange(len(flat_a)) + np.searchsorted(group_b, group_a)] = flat_a + len(self.bytes_a) * last_a
        name[np.arange(len(flat_b)) + np.searchsorted(group_a, group_b, "right")] = 2 * len(self.bytes_a) + flat_b + len(self.bytes_b) * last_b
        groups = "".join(map(self.names.__getitem__, name.tolist()))
        ends = np.cumsum(length[good])
        t_at = np.cumsum(self.name_size[name])[np.cumsum(n_a + n_b) - 1].tolist()
        l_at = (8 * np.searchsorted(end_a[i], ends, "right")).tolist()
        t0 = l0 = 0
        for k, a, b, t1, l1 in zip(order[good].tolist(), n_a.tolist(), n_b.tolist(), t_at, l_at, strict=True):
            out[k] = (groups[t0 : t1 - 1], a, b, links[l0:l1])
            t0, l0 = t1, l1
        return out

    def words(self, wanted: set[str]) -> dict[str, tuple[str, int, int, bytes] | None]:
        """Every word's alignment, from memory where it is there."""
        if len(self.now) > CACHE:
            self.now, self.last = {}, self.now
        found: dict[str, tuple[str, int, int, bytes] | None] = {}
        new = []
        for w in wanted:
            if w in self.now:
                found[w] = self.now[w]
            elif w in self.last:
                found[w] = self.now[w] = self.last[w]
            else:
                new.append(w)
        for low in range(0, len(new), BATCH):
            for w, x in zip(new[low : low + BATCH], self.align(new[low : low + BATCH]), strict=True):
                found[w] = x
                if x and len(w) <= LONGEST:
                    self.now[w] = x
        return found


_aligner: tuple[tuple[str, str], Aligner] | None = None


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner, kept from task to task; another pair of vocabularies replaces it."""
    global _aligner
    if _aligner is None or _aligner[0] != (path_a, path_b):
        _aligner = ((path_a, path_b), Aligner(path_a, path_b))
    return _aligner[1]


DOCUMENTS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
BLOCKS = (
    "doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "groups array<string>, word_ends array<long>, words binary, pair_ends binary, members binary, pairs array<struct<pair: long, uses: long>>"
)


class _Block:
    """Documents whose pairs are counted together."""

    def __init__(self, with_groups: bool):
        self.with_groups = with_groups
        self.docs: list[tuple] = []
        self.ids: list[np.ndarray] = []
        self.number: dict[str, int] = {}
        self.text: dict[str, str] = {}
        self.n_a: list[int] = []
        self.n_b: list[int] = []
        self.links: list[bytes] = []
        self.bytes = 0

    def _add(self, x: tuple[str, int, int, bytes]) -> int:
        self.n_a.append(x[1])
        self.n_b.append(x[2])
        self.links.append(x[3])
        return len(self.n_a) - 1

    def document(self, doc_id: int | None, parts: list[str], found: dict[str, tuple[str, int, int, bytes] | None]) -> None:
        """A document of words that are all in ``found``; without parts it has no tokens."""
        for w in set(parts).difference(self.number):
            self.number[w], self.text[w] = self._add(found[w]), found[w][0]
        ids = np.fromiter(map(self.number.__getitem__, parts), np.int32, len(parts))
        self._close(doc_id, ids, ";".join(map(self.text.__getitem__, parts)))

    def whole(self, doc_id: int | None, x: tuple[str, int, int, bytes]) -> None:
        self._close(doc_id, np.array([self._add(x)], np.int32), x[0])

    def _close(self, doc_id: int | None, ids: np.ndarray, groups: str) -> None:
        digest = hashlib.sha256(groups.encode()).hexdigest() if len(ids) else ""
        self.docs.append((doc_id, digest, groups if self.with_groups else None, groups.count("|")))
        self.ids.append(ids)

    def row(self) -> pa.RecordBatch:
        flat, ends = np.concatenate(self.ids), np.cumsum([len(x) for x in self.ids])
        sizes = np.array([len(x) // 8 for x in self.links], np.int64)
        every = np.frombuffer(b"".join(self.links), np.int64)
        pairs, members = np.unique(every, return_inverse=True)
        uses = np.bincount(members, np.repeat(np.bincount(flat, minlength=len(sizes)), sizes), len(pairs)).astype(np.int64)

        def per_doc(values) -> list[int]:
            sums = np.concatenate([[0], np.cumsum(np.asarray(values, np.int64)[flat])])
            return np.diff(sums[np.concatenate([[0], ends])]).tolist()

        ids, digests, groups, n_groups = map(list, zip(*self.docs, strict=True))
        counted = pa.StructArray.from_arrays([pa.array(pairs), pa.array(uses)], ["pair", "uses"])
        cells = [
            (ids, pa.int64()), (per_doc(self.n_a), pa.int64()), (per_doc(self.n_b), pa.int64()), (n_groups, pa.int64()), (per_doc(sizes), pa.int64()),
            (digests, pa.string()), (groups, pa.string()), (ends.tolist(), pa.int64()),
        ]
        arrays = [pa.array([v], pa.list_(t)) for v, t in cells]
        arrays += [pa.array([x.tobytes()], pa.binary()) for x in (flat, np.cumsum(sizes), members.astype(np.int32))]
        arrays.append(pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), counted))
        return pa.RecordBatch.from_arrays(arrays, [*DOCUMENTS, "groups", "word_ends", "words", "pair_ends", "members", "pairs"])


def _block_rows(path_a: str, path_b: str, with_groups: bool, size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, block = aligner(path_a, path_b), _Block(with_groups)
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                part = batch.slice(low, 128)
                docs = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
                cut = [WORDS.findall(" " + t) if t and side.by_word and not ODD.search(t) else None for _, t in docs]
                found = side.words(set().union(*filter(None, cut)))
                odd = {w for w, x in found.items() if x is None}
                for (doc_id, text), parts in zip(docs, cut, strict=True):
                    if not text:
                        block.document(doc_id, [], found)
                    elif parts and odd.isdisjoint(parts):
                        block.document(doc_id, parts, found)
                    else:
                        whole = side.align([" " + text])[0]
                        block.whole(doc_id, whole) if whole else block.document(doc_id, [], found)
                    block.bytes += len(text or "")
                    if block.bytes >= size:
                        yield block.row()
                        block = _Block(with_groups)
        if block.docs:
            yield block.row()

    return rows


def _document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            one = {name: batch.column(name)[k] for name in batch.schema.names}
            totals = one["totals"].values
            at = totals.field("place").to_numpy()
            sums = np.zeros((2, len(at) + 1), np.int64)
            sums[0, at], sums[1, at] = totals.field("count").to_numpy(), totals.field("best").to_numpy(zero_copy_only=False)
            members = np.frombuffer(one["members"].as_py(), np.int32)
            pair_ends = np.concatenate([[0], np.frombuffer(one["pair_ends"].as_py(), np.int64)])
            words = np.frombuffer(one["words"].as_py(), np.int32)
            ends = np.concatenate([[0], one["word_ends"].values.to_numpy()]).astype(np.int64)
            out = []
            for values in sums:
                by_word = np.diff(np.concatenate([[0], np.cumsum(values[members])])[pair_ends])
                out.append(np.diff(np.concatenate([[0], np.cumsum(by_word[words])])[ends]))
            columns = [one[c].values for c in DOCUMENTS] + [pa.array(out[1], pa.int64()), pa.array(out[0], pa.int64()), one["groups"].values]
            yield pa.RecordBatch.from_arrays(columns, [*DOCUMENTS, "n_best", "count_sum", "groups"])


def align(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum, groups (null unless asked for): a row per row of ``docs``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids of both sides in order. A pair's count is the number of links that hold it in all
    of ``docs``; n_best counts links whose pair has the highest count among the pairs of its id of B.
    """
    blocks = keep(texts(docs).mapInArrow(_block_rows(path_a, path_b, with_groups, block), BLOCKS).withColumn("block", F.monotonically_increasing_id()), BLOCKS_PER_FILE)
    uses = blocks.select("block", F.posexplode("pairs").alias("place", "use")).select("block", "place", "use.pair", "use.uses")
    counts = keep(uses.groupBy("pair").agg(F.sum("uses").alias("count")).withColumn("b", F.expr("pair & 4294967295")))
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))  # at most a row per id of B
    marked = counts.join(F.broadcast(highest), "b").select("pair", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))
    totals = uses.join(marked, "pair").groupBy("block").agg(F.collect_list(F.struct("place", "count", "best")).alias("totals"))
    whole = blocks.drop("pairs").join(totals, "block", "left").withColumn("totals", F.coalesce("totals", F.expr("array()").cast("array<struct<place: int, count: bigint, best: bigint>>")))
    return whole.mapInArrow(
        _document_rows,
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, groups string",
    )
