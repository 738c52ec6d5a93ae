"""Repeated passages by relative Lempel-Ziv parsing against all documents.

The reference is the corpus itself, cut into content-defined blocks: the window of ``window`` words that starts at a word is
filed under its anchor, the smallest fingerprint of the runs of ``GRAM`` words inside it. Neighbouring windows mostly share
an anchor and make one block; two equal windows have equal anchors wherever they stand.

1. A pass gives each document's anchors. Anchors that occur once in the corpus index no repeated window and are dropped.
2. A second pass looks up the documents' windows under the anchors that are left: their fingerprints are counted within a
   batch first, so a passage that stands in a third of all documents is one announcement per batch and not a row each;
   windows alone in their batch ask the index, which sums announcements and questions per fingerprint.
3. Each document is parsed greedily from left to right: a factor starts at a word whose window is in the reference at
   another place and grows while the next window is, too; otherwise the word is a literal. As every window is looked up
   by itself, those that cross a factor boundary are checked as well. Factors are at least ``window`` words long and are
   the duplicate spans.

Windows are judged on the input; all words of a factor go. Fingerprints have 64 bits; anchor and window must both agree.

Defined cases: a null or empty text has no words; shorter texts than a window keep all words; repeated rows are copies of
each other like any documents with equal texts, and are removed whole if they have a window's length; documents are told
apart by a hash of their text, so ids may be null or repeat. All other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.storage import keep, texts
from graphloom.llm.words import Runs, mix, signed

GRAM = 8


def anchors(runs: Runs, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window of a text, and the fingerprints of its runs of ``GRAM`` words."""
    grams = runs.hashes(min(GRAM, window))
    width, low, span = window - min(GRAM, window) + 1, grams, 1
    if len(grams) < width:
        return np.zeros(0, np.uint64), grams
    while 2 * span <= width:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    return (np.minimum(low[: len(grams) - width + 1], low[width - span :]) if span < width else low), grams


def _anchor_rows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values, counts = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                own, grams = anchors(Runs(text), window)
                if len(own):
                    grams.sort()
                    own = np.unique(own)
                    keys.append(np.full(len(own), key, np.int64))
                    values.append(signed(own))
                    counts.append((np.searchsorted(grams, own, "right") - np.searchsorted(grams, own)).astype(np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, values, counts)], ["key", "anchor", "n"])

    return rows


def _window_rows(window: int):
    """Windows under shared anchors: resolved ones (n = 0), announcements (key null, n = 2) and questions (n = 1)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, prints = [], [], []
            for key, text, shared in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("anchors"), strict=True):
                runs = Runs(text)
                own, _ = anchors(runs, window)
                at = np.nonzero(np.isin(own, shared.values.to_numpy(zero_copy_only=False).view(np.uint64)))[0]
                if len(at):
                    keys.append(np.full(len(at), key, np.int64))
                    places.append(at.astype(np.int32))
                    prints.append(mix(runs.hashes(window)[at] ^ own[at]))
            if not keys:
                continue
            key, place, prints_ = np.concatenate(keys), np.concatenate(places), np.concatenate(prints)
            values, group, count = np.unique(prints_, return_inverse=True, return_counts=True)
            alone, known = count[group] == 1, values[count > 1]
            names = ["print", "n", "key", "place"]
            yield pa.RecordBatch.from_arrays([pa.array(signed(prints_[alone])), pa.array(np.ones(alone.sum(), np.int32)), pa.array(key[alone]), pa.array(place[alone])], names)
            if len(known):
                none = pa.nulls(len(known), pa.int64()), pa.nulls(len(known), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(signed(known)), pa.array(np.full(len(known), 2, np.int32)), *none], names)
                done = ~alone
                yield pa.RecordBatch.from_arrays([pa.array(signed(prints_[done])), pa.array(np.zeros(done.sum(), np.int32)), pa.array(key[done]), pa.array(place[done])], names)

    return rows


def parse(hits: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Greedy factors (first word, words) from the sorted starts of windows that the reference holds."""
    if not len(hits):
        return []
    breaks = np.nonzero(np.diff(hits) > 1)[0]
    first, last = hits[np.r_[0, breaks + 1]], hits[np.r_[breaks, len(hits) - 1]]
    return [(int(a), int(b - a + window)) for a, b in zip(first, last, strict=True)]


def _parsed_rows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, places in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("places"), strict=True):
                words = (text or b"").split()
                keep_word = np.ones(len(words), bool)
                if places.is_valid:
                    for first, length in parse(np.unique(places.values.to_numpy(zero_copy_only=False)), window):
                        keep_word[first : first + length] = False
                kept = words if keep_word.all() else [w for w, k in zip(words, keep_word, strict=True) if k]
                out[0].append(len(words))
                out[1].append(len(words) - len(kept))
                out[2].append(b" ".join(kept).decode())
            types = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out, types)], ["doc_id", "n_words", "n_removed", "kept"])

    return rows


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by a space): a row per row of ``docs``."""
    docs = texts(docs).select(F.xxhash64("text").alias("key"), "doc_id", "text")
    found = keep(docs.select("key", "text").mapInArrow(_anchor_rows(window), "key long, anchor long, n int"))
    shared = found.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    by_doc = keep(found.join(shared, "anchor", "left_semi").groupBy("key").agg(F.collect_set("anchor").alias("anchors")))
    windows = keep(docs.select("key", "text").join(by_doc, "key").mapInArrow(_window_rows(window), "print long, n int, key long, place int"))
    answered = windows.where("n > 0").withColumn("all", F.sum("n").over(Window.partitionBy("print"))).where("all > 1 AND key IS NOT NULL")
    hits = keep(
        answered.select("key", "place").union(windows.where("n = 0").select("key", "place")).groupBy("key").agg(F.collect_set("place").alias("places"))
    )
    return docs.join(hits, "key", "left").mapInArrow(_parsed_rows(window), "doc_id long, n_words long, n_removed long, kept string")
