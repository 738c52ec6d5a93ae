"""Periodic runs of words: stretches of a text that repeat themselves with one period.

A run is a stretch of at least ``min_words`` words and ``exponent`` periods in which words one period apart are equal, which no
neighbouring word extends; its period is the smallest one. Found by the branching-tandem test on an enhanced suffix array:

1. The suffix array of a document's words is built by prefix doubling, with its inverse and the lengths of common prefixes.
2. The intervals of suffixes with a common prefix of length d are enumerated from the LCP array with a stack of open
   intervals; no tree is built. A run of period d leaves at least ``max(exponent, min_words // d)`` suffixes in its interval.
3. For every suffix i of an interval outside its largest child, ``ISA[i + d]`` and ``ISA[i - d]`` are looked up: if they fall into
   the same interval but another child, a square of period d begins there that the next word does not continue.
   Largest children are left out, so all look-ups of a document together are O(n log n); they are vectorised in slices.
4. Each square is rotated to the left as far as the words agree. Squares with a multiple of a run's period inside that
   run are the same repetition; what is left and long enough is a run.

A run of these lengths repeats a window of ``min_words - min_words // exponent`` words. Documents whose windows of that length all
differ, by fingerprint, have no run and need no suffix array; equal windows have equal fingerprints, so none is missed. Words are
compared as such after that.

Defined cases: a null or blank text has no words and no runs; a text shorter than ``min_words`` has no runs; repeated rows come back
each; an empty table gives no rows; other columns of the table are ignored and only ``doc_id`` and the results come back. A very long text
costs O(n log n) time and O(n) memory in its own task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.storage import texts
from graphloom.llm.words import Runs

SLICE = 1 << 18
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def suffix_array(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a sequence of small integers, and its inverse, by prefix doubling."""
    n, step = len(words), 1
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    while True:
        key = (rank + 1) * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        step *= 2
        if step >= n or rank[order[-1]] == n - 1:
            return order, rank


def common_prefixes(words: np.ndarray, order: np.ndarray, place: np.ndarray) -> list[int]:
    """Entry k: the words that the suffixes at places k - 1 and k have in common; entry 0 is 0."""
    n, known = len(words), 0
    lcp, w, sa = [0] * n, words.tolist(), order.tolist()
    for i, k in enumerate(place.tolist()):
        if k:
            j = sa[k - 1]
            end = n - max(i, j)
            while known < end and w[i + known] == w[j + known]:
                known += 1
            lcp[k] = known
            known -= known > 0
        else:
            known = 0
    return lcp


def smaller_children(lcp: list[int], min_words: int, exponent: int) -> np.ndarray:
    """Rows (depth, first, last, child's first, child's last) of all but the largest child of each interval that is large enough."""
    rows: list[tuple[int, int, int, int, int]] = []
    stack: list[tuple[int, int, list[int]]] = [(0, 0, [])]
    for k in range(1, len(lcp) + 1):
        depth, first = lcp[k] if k < len(lcp) else -1, k - 1
        while stack and stack[-1][0] > depth:
            d, first, cuts = stack.pop()
            if d and k - first >= max(exponent, min_words // d):
                edges = [first, *cuts, k]
                sizes = [b - a for a, b in zip(edges, edges[1:])]
                largest = sizes.index(max(sizes))
                rows += [(d, first, k - 1, edges[c], edges[c + 1] - 1) for c in range(len(sizes)) if c != largest]
        if stack and stack[-1][0] == depth:
            stack[-1][2].append(k)
        elif depth >= 0:
            stack.append((depth, first, [k]))
    return np.array(rows, np.int64).reshape(-1, 5)


def branching_squares(order: np.ndarray, place: np.ndarray, children: np.ndarray) -> set[tuple[int, int]]:
    """Pairs (start, period) of the squares that the word after them does not continue."""
    n, found = len(order), set()
    sizes = children[:, 4] - children[:, 3] + 1
    ends = np.cumsum(sizes)
    for low in range(0, int(ends[-1]) if len(ends) else 0, SLICE):
        at = np.arange(low, min(low + SLICE, int(ends[-1])))
        row = np.searchsorted(ends, at, side="right")
        depth, first, last, own_first, own_last = children[row].T
        i = order[own_first + at - (ends[row] - sizes[row])]
        for partner, start in ((i + depth, i), (i - depth, i - depth)):
            inside = (partner >= 0) & (partner < n)
            p = place[np.where(inside, partner, 0)]
            hit = inside & (p >= first) & (p <= last) & ((p < own_first) | (p > own_last))
            found.update(zip(start[hit].tolist(), depth[hit].tolist()))
    return found


def rotated(words: np.ndarray, start: int, period: int) -> int:
    """How far left words one period apart stay equal, from ``start`` on."""
    step = 64
    while start > 0:
        low = max(0, start - step)
        differ = np.flatnonzero(words[low:start] != words[low + period : start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, step = low, 2 * step
    return 0


def runs_of(words: np.ndarray, min_words: int = 24, exponent: int = 3) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of integers, by start and period."""
    if len(words) < min_words:
        return []
    order, place = suffix_array(words)
    children = smaller_children(common_prefixes(words, order, place), min_words, exponent)
    ending: dict[int, list[tuple[int, int]]] = defaultdict(list)
    found = []
    for period, start in sorted((d, i) for i, d in branching_squares(order, place, children)):
        end = start + 2 * period
        if any(period % p == 0 and first <= start for first, p in ending[end]):
            continue  # several periods of a run that ends here
        first = rotated(words, start, period)
        ending[end].append((first, period))
        if end - first >= max(min_words, exponent * period):
            found.append((first, end - first, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _run_rows(min_words: int, exponent: int):
    window = min_words - min_words // exponent

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part, out = batch.slice(low, 256), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    words, runs = (text or b"").split(), []
                    windows = np.sort(Runs(text).hashes(window)) if len(words) >= min_words else np.zeros(0, np.uint64)
                    if (windows[1:] == windows[:-1]).any():
                        number: dict[bytes, int] = {}
                        runs = runs_of(np.array([number.setdefault(w, len(number)) for w in words], np.int64), min_words, exponent)
                    kept = words
                    if runs:
                        drop = np.zeros(len(words), bool)
                        for start, length, period in runs:
                            drop[start + period : start + length] = True
                        kept = [words[k] for k in np.flatnonzero(~drop).tolist()]
                    out.append((doc_id, len(words), [{"start": s, "length": n, "period": p} for s, n, p in runs], b" ".join(kept)))
                ids, counts, found, collapsed = zip(*out, strict=True)
                shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(found, shape), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return rows


def periodic_runs(docs: DataFrame, min_words: int = 24, exponent: int = 3) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words), collapsed: the text's words without what follows a run's first period."""
    return texts(docs).mapInArrow(_run_rows(min_words, exponent), SCHEMA)
