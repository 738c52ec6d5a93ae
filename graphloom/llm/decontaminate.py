"""Training documents that hold passages of benchmark items, also edited or paraphrased ones.

Seeds: the items' runs of ``SEED`` words, in lower case and without ASCII punctuation, all of them. Where at least
``MIN_SEEDS`` distinct seeds of one item (or its only one) lie together in a text, a local (Smith-Waterman) alignment of the item with that
stretch scores it: match 2, mismatch -1, gap -1, divided by the score of a full match. A pair is only passed over before
if so few of the item's words stand in the stretch that no alignment can reach the least score. Not found: passages
edited so densely that fewer than ``MIN_SEEDS`` runs of ``SEED`` words survive.

The seeds and their items go to the tasks as sorted arrays: benchmarks are read in blocks of at most ``BLOCK`` items, so
their size has a bound whatever the benchmark; each block is one pass over the documents. A text is read and aligned
where it lies: no text is moved, and nothing is grouped but the pairs found.

Defined cases: null texts and items match nothing, nor do items shorter than a seed; repeated items or documents give a row
each (per doc_id and item_id the best score is kept); rows without an id are left out; an empty benchmark finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.storage import texts
from graphloom.llm.words import Runs

SEED, MIN_SEEDS = 3, 2
BLOCK = 20_000
_PLAIN = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def plain(text: str | None) -> Runs:
    """The words of a text in lower case, without ASCII punctuation."""
    return Runs((text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN))


def align(item: np.ndarray, stretch: np.ndarray) -> tuple[float, int]:
    """Best local alignment score of two word sequences as a share of a full match of ``item``, and its end in ``stretch``."""
    n = len(stretch)
    step = np.arange(n + 1)
    above = np.zeros(n + 1)
    best, end = 0.0, 0
    for word in item:
        row = np.zeros(n + 1)
        row[1:] = np.maximum(above[:-1] + np.where(stretch == word, 2.0, -1.0), above[1:] - 1)
        row = np.maximum(np.maximum.accumulate(row + step) - step, 0)
        at = int(row.argmax())
        if row[at] > best:
            best, end = float(row[at]), at
        above = row
    return best / (2 * len(item)), end


def _stretches(places: np.ndarray, seeds: np.ndarray, length: int, needed: int) -> Iterator[tuple[int, int]]:
    """Word ranges of a document around seeds that lie within two item lengths of each other.

    An alignment of at least half the full score spans at most two item lengths: each inserted word costs half a match.
    """
    order = np.argsort(places, kind="stable")
    places, seeds = places[order], seeds[order]
    breaks = np.nonzero(np.diff(places) > 2 * length)[0] + 1
    for part in np.split(np.arange(len(places)), breaks):
        if len(np.unique(seeds[part])) >= needed:
            yield max(0, int(places[part[0]]) - 2 * length), int(places[part[-1]]) + SEED + 2 * length


def _aligned_rows(items: list[tuple[int, np.ndarray]], seeds: np.ndarray, first: np.ndarray, owners: np.ndarray, least: float):
    """Per document and item with enough common seeds: the best alignment. ``owners[first[s]:first[s + 1]]`` hold seed ``s``."""
    needed = np.minimum(MIN_SEEDS, np.bincount(owners, minlength=len(items)))
    filled = np.zeros(1 << 20, bool)
    filled[(seeds >> np.uint64(44)).astype(np.int64)] = True

    def candidates(found: np.ndarray) -> dict[int, np.ndarray]:
        """Items with enough of the seeds ``found``, and which."""
        sizes = first[found + 1] - first[found]
        which = np.repeat(found, sizes)
        owner = owners[np.arange(len(which)) + np.repeat(first[found] - np.cumsum(sizes) + sizes, sizes)]
        order = np.argsort(owner, kind="stable")
        item, starts, counts = np.unique(owner[order], return_index=True, return_counts=True)
        return {int(i): which[order[a : a + n]] for i, a, n in zip(item, starts, counts, strict=True) if n >= needed[i]}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = plain(text)
                runs = own.hashes(SEED)
                at = np.nonzero(filled[(runs >> np.uint64(44)).astype(np.int64)])[0]
                if not len(at):
                    continue
                seed = np.minimum(np.searchsorted(seeds, runs[at]), len(seeds) - 1)
                at, seed = at[seeds[seed] == runs[at]], seed[seeds[seed] == runs[at]]
                if not len(at):
                    continue
                words = own.hashes(1)
                for i, which in candidates(np.unique(seed)).items():
                    item_id, item = items[i]
                    hit = np.isin(seed, which)
                    best = (0.0, 0)
                    for low, high in _stretches(at[hit], seed[hit], len(item), needed[i]):
                        stretch = words[low:high]
                        # No alignment scores above the share of the item's words that stand there at all.
                        if np.isin(item, stretch).sum() >= least * len(item):
                            score, end = align(item, stretch)
                            best = max(best, (score, low + end))
                    if best[0] >= least:
                        out.append((doc_id, item_id, *best))
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
            columns = zip(*out, strict=True) if out else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "score", "end_word"])

    return rows


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, item_id, score, end_word: the documents that hold a passage of an item, with the best alignment's score."""
    docs = texts(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    blocks = max(1, -(-items.count() // BLOCK))
    results = [_block(docs, items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), least) for b in range(blocks)]
    found = results[0]
    for more in results[1:]:
        found = found.union(more)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "end_word")).alias("m")).select("doc_id", "item_id", "m.*")


def _block(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    # The block's items, at most about BLOCK of them.
    runs = [(r["item_id"], plain(r["text"])) for r in items.distinct().orderBy("item_id", "text").collect()]
    words = [(i, r) for i, r in runs if r.n >= SEED]
    held = [np.unique(r.hashes(SEED)) for _, r in words]
    every = np.concatenate([*held, np.zeros(0, np.uint64)])
    order = np.argsort(every, kind="stable")
    seeds, first = np.unique(every[order], return_index=True)
    owners = np.repeat(np.arange(len(held)), [len(h) for h in held])[order]
    aligned = _aligned_rows([(i, r.hashes(1)) for i, r in words], seeds, np.r_[first, len(every)], owners, least)
    return docs.select("doc_id", "text").mapInArrow(aligned, "doc_id long, item_id long, score double, end_word long")
