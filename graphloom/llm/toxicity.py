"""Toxicity of documents by a support vector machine over a gapped subsequence kernel.

Kernel. A word is described by its subsequences of ``ORDER`` characters that lie within a span of ``SPAN``, each weighted
by ``DECAY`` to the power of its span; the kernel of two words is the cosine of these descriptions. Characters inserted
into an insult only stretch some spans. A sentence's letters written apart ("i d i o t") are also read as one word.

Machine. Landmarks are words of the labelled documents; Nyström features are the kernel values to the landmarks times the
inverse square root of the landmarks' kernel matrix, and a linear machine (hinge loss) is trained on them (squared hinge loss, Newton steps). As the
decision is a weighted sum of kernel values, it folds into one weight per subsequence, so a word is scored by a few table
lookups. A document's features are the margins of its three most suspicious distinct words; a logistic curve fitted on
the training documents maps them to 0..1.

Training reads at most ``train_docs`` labelled documents, the first by a hash of their id and label (a documented bound);
words are their labelled sentences' parts: words much more frequent in toxic documents are positive, others negative.
Scoring covers every whole text in one pass without a shuffle. The model is a table of a few thousand numbers.

Defined cases: a null or empty text has no words and gets the score of a document without suspicious words; no usable
labels, or labels of one kind only, give score 0 to all; repeated rows get equal scores; labels without a document and
null labels are not used; a document labelled twice counts as toxic if one label says so.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from graphloom.llm.storage import texts
from graphloom.llm.words import mix

ORDER, SPAN, DECAY = 4, 6, 0.6
LANDMARKS = 400
START = "\x02"
CACHE = 200_000
#: Words described at a time.
CHUNK = 2_048
#: Clean words looked at for negatives, the frequent ones first.
CLEAN_WORDS = 100_000
#: Margins below this say no more.
FLOOR = -1.5
RIDGE = 0.001
APART = re.compile(r"(?<!\S)\w(?:[ .*_-]\w){3,}(?!\S)")
_OFFSETS = np.array([(0, *rest) for rest in combinations(range(1, SPAN), ORDER - 1)])
_WEIGHTS = DECAY ** (_OFFSETS[:, -1] + 1.0)
_EDGES = ".,;:!?\"'()[]{}<>«»¡¿…"


def words_of(text: str) -> set[str]:
    """Distinct words in lower case without outer punctuation, and letters written apart joined."""
    low = text.lower()
    found = {w.strip(_EDGES) for w in low.split()}
    for m in APART.finditer(low):
        found.add("".join(c for c in m[0] if c.isalnum()))
    return found


def parts(word: str) -> set[str]:
    """Runs of ``ORDER + 1`` characters, the start of the word counted as one."""
    bound = START + word
    return {bound[i : i + ORDER + 1] for i in range(len(bound) - ORDER)}


def describe(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, subsequence code, weight) of the words' subsequences, summed per code and scaled to unit length."""
    words = [START + w for w in words]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))  # characters from here to the word's end
    own, code, weight = [], [], []
    for offsets, w in zip(_OFFSETS, _WEIGHTS, strict=True):
        at = np.nonzero(room > offsets[-1])[0]
        key = np.zeros(len(at), np.uint64)
        for o in offsets:
            key = key * np.uint64(1 << 16) + chars[at + o]
        own.append(owner[at])
        code.append(key)
        weight.append(np.full(len(at), w))
    own, code, weight = map(np.concatenate, (own, code, weight))
    joint = mix(code) ^ mix(own.astype(np.uint64) + np.uint64(1 << 40))
    _, first, group = np.unique(joint, return_index=True, return_inverse=True)
    own, code, weight = own[first], code[first], np.bincount(group, weight, len(first))
    norm = np.sqrt(np.bincount(own, weight**2, len(words)))
    return own, code, weight / norm[own]


class Margins:
    """Decision values of words: folded weights per subsequence code, and the intercept."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, bias: float, curve: np.ndarray):
        self.codes, self.weights, self.bias, self.curve = codes, weights, bias, curve

    def of(self, words: list[str]) -> np.ndarray:
        """Margins of the words; words too short for an insult get the intercept."""
        out = np.full(len(words), self.bias)
        for low in range(0, len(words) if len(self.codes) else 0, CHUNK):
            out[low : low + CHUNK] += self._sums(words[low : low + CHUNK])
        return out

    def _sums(self, words: list[str]) -> np.ndarray:
        own, code, weight = describe(words)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = (self.codes[at] == code) & (np.fromiter(map(len, words), np.int64, len(words)) >= ORDER)[own]
        return np.bincount(own[hit], weight[hit] * self.weights[at[hit]], len(words))

    def scores(self, tops: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.column_stack([tops, np.ones(len(tops))]) @ self.curve, -30, 30)))


def top_margins(words: list[set[str]] | list[tuple[str, ...]], of: dict[str, float], floor: float) -> np.ndarray:
    """The three largest margins of each document's words, filled up with ``floor``."""
    out = np.full((len(words), 3), floor)
    for i, own in enumerate(words):
        best = sorted([of[w] for w in own], reverse=True)[:3]
        out[i, : len(best)] = np.maximum(best, floor)
    return out


def _features(words: list[str], codes: np.ndarray, marks: np.ndarray, root: np.ndarray) -> list[np.ndarray]:
    """Nyström features of the words in blocks of CHUNK: their kernel with each landmark (rows of ``marks`` over ``codes``), times ``root``."""
    blocks = []
    for low in range(0, len(words), CHUNK):
        own, code, weight = describe(words[low : low + CHUNK])
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        hit = np.nonzero(codes[at] == code)[0]
        hit = hit[np.argsort(own[hit], kind="stable")]
        columns, values = at[hit], weight[hit]
        bounds = np.searchsorted(own[hit], np.arange(min(CHUNK, len(words) - low) + 1))
        dense = np.zeros((len(bounds) - 1, marks.shape[0]))
        for i in range(len(dense)):
            part = slice(bounds[i], bounds[i + 1])
            dense[i] = marks[:, columns[part]] @ values[part]
        blocks.append(dense @ root)
    return blocks


def _machine_weights(blocks: list[np.ndarray], positives: int) -> np.ndarray:
    """Weights and intercept of the linear machine; the first rows are the positives. Both kinds count alike.

    A step adds up its normal equations over the blocks, so the driver holds the features once.
    """
    n, width = sum(map(len, blocks)), blocks[0].shape[1] + 1
    w = np.zeros(width)
    for _ in range(30):  # Newton steps on the squared hinge loss: least squares over the rows inside the margin
        left, right, low = RIDGE * np.eye(width), np.zeros(width), 0
        for block in blocks:
            good = np.arange(low, low + len(block)) < positives
            low += len(block)
            y, cost = np.where(good, 1.0, -1.0), np.where(good, 1 / positives, 1 / (n - positives))
            active = y * (block @ w[:-1] + w[-1]) < 1
            x = np.column_stack([block[active], np.ones(active.sum())])
            weighted = x * cost[active, None]
            left += weighted.T @ x
            right += weighted.T @ y[active]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def train(rows: list[tuple[str, int]], shares: tuple[float, float] = (1.0, 1.0)) -> Margins:
    """The machine for labelled texts. ``shares``: how many labelled documents a row of label 0 and of label 1 stands for."""
    nothing = Margins(np.zeros(0, np.uint64), np.zeros(0), -1.0, np.array([0.0, 0.0, 0.0, -30.0]))
    same: dict[str, str] = {}
    bags, labels = [tuple(same.setdefault(w, w) for w in sorted(words_of(t or ""))) for t, _ in rows], np.array([y for _, y in rows])
    if not (labels == 1).any() or not (labels == 0).any():
        return nothing
    counts, grams = [Counter(), Counter()], [Counter(), Counter()]
    for bag, y in zip(bags, labels, strict=True):
        counts[int(y)].update(bag)
        if y:
            grams[1].update(set().union(*map(parts, bag)))
    for bag, y in zip(bags, labels, strict=True):
        if not y:
            grams[0].update(grams[1].keys() & set().union(*map(parts, bag)))
    sizes = [(labels == y).sum() + 1.0 for y in (0, 1)]

    def odds(found: list[Counter], what: str, margin: float) -> float:
        """Log odds of a word or part of one in toxic against other documents, less ``margin`` standard errors."""
        n0, n1 = found[0][what] + 0.5, found[1][what] + 0.5
        return log(n1 / sizes[1]) - log(n0 / sizes[0]) - margin * sqrt(1 / n0 + 1 / n1)

    telling = {g for g in grams[1] if odds(grams, g, 3) > 1}
    word_odds = {w: odds(counts, w, 3) for w in counts[1] if len(w) >= ORDER}
    positive = sorted(
        (w for w, o in word_odds.items() if o > 1 or odds(counts, w, 0) > 1 and not telling.isdisjoint(parts(w))),
        key=lambda w: (-word_odds[w], w),
    )[:2000]
    if not positive:
        return nothing
    # Negatives: words of clean documents, the frequent ones and those that look most like the positives.
    taken = set(positive)
    clean = sorted((w for w in counts[0] if w not in taken and odds(counts, w, 0) < 1 and len(w) >= ORDER), key=lambda w: (-counts[0][w], w))[:CLEAN_WORDS]
    del counts, grams, word_odds, telling, same
    own, code, weight = describe(positive)
    codes, column = np.unique(code, return_inverse=True)
    near = Margins(codes, np.bincount(column, weight), 0.0, nothing.curve).of(clean)
    negative = clean[:5000] + [clean[i + 5000] for i in np.argsort(-near[5000:], kind="stable")[:8000]] + clean[5000 :: max(1, len(clean) // 8000)]
    marks = positive[: LANDMARKS // 2] + negative[5000 : 5000 + LANDMARKS // 4] + negative[: LANDMARKS // 4]
    own, code, weight = describe(marks)
    codes, column = np.unique(code, return_inverse=True)
    dense = np.zeros((len(marks), len(codes)))
    dense[own, column] = weight
    values, vectors = np.linalg.eigh(dense @ dense.T)
    root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
    features = _features(positive + negative, codes, dense, root)
    w = _machine_weights(features, len(positive))
    for _ in range(2):  # the clean words that still look worst join the negatives
        margins = Margins(codes, (root @ w[:-1]) @ dense, w[-1], nothing.curve).of(clean)
        worst = [clean[i] for i in np.argsort(-margins, kind="stable")[:1500]]
        features += _features(worst, codes, dense, root)
        w = _machine_weights(features, len(positive))
    machine = Margins(codes, (root @ w[:-1]) @ dense, w[-1], nothing.curve)
    known = sorted(set().union(*bags))
    of = dict(zip(known, machine.of(known), strict=True))
    tops = np.column_stack([top_margins(bags, of, FLOOR), np.ones(len(bags))])
    counted = np.where(labels == 1, shares[1], shares[0]) / max(shares)
    curve = np.zeros(4)
    for _ in range(30):  # Newton steps of a regularised logistic fit
        p = 1 / (1 + np.exp(-np.clip(tops @ curve, -30, 30)))
        hessian = (tops * (counted * p * (1 - p))[:, None]).T @ tops + np.eye(4)
        curve -= np.linalg.solve(hessian, tops.T @ (counted * (p - labels)) + curve)
    machine.curve = curve
    return machine


_margins: dict[str, float] = {}
_machine: list[str | None] = [None]


def _scored_rows(machine: Margins, version: str, name: str):
    """The rows' columns and their score as a last one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _margins
        if _machine[0] != version:
            cache.clear()
            _machine[0] = version
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                bags = [words_of(t or "") for t in part.column("text").to_pylist()]
                new = [w for w in set().union(*bags) if w not in cache]
                if len(cache) + len(new) > CACHE:
                    cache.clear()
                    new = list(set().union(*bags))
                cache.update(zip(new, machine.of(new).tolist(), strict=True))
                scores = machine.scores(top_margins(bags, cache, FLOOR))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*part.schema.names, name])

    return rows


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from; rows without an id belong to it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = 3000) -> Margins:
    """The machine learned from at most ``train_docs`` labelled documents outside the held-out fold, at most a quarter of them toxic."""
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    totals = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    chosen = None
    for label, most in ((0, train_docs - train_docs // 4), (1, train_docs // 4)):
        part = marked.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    ids = {r["doc_id"]: r["toxic"] for r in chosen.collect()}
    wanted = docs.sparkSession.createDataFrame(sorted(ids.items()), "doc_id long, toxic int")
    found = texts(docs).join(F.broadcast(wanted), "doc_id").select("doc_id", "text", "toxic").dropDuplicates(["doc_id"]).collect()
    rows = [(r["text"], r["toxic"]) for r in sorted(found, key=lambda r: r["doc_id"])]
    shares = tuple(totals.get(y, 0) / max(1, sum(1 for _, own in rows if own == y)) for y in (0, 1))
    return train(rows, shares if min(shares) > 0 else (1.0, 1.0))


def with_score(docs: DataFrame, machine: Margins, name: str = "score") -> DataFrame:
    """``docs`` with the score of ``text`` as a last column ``name``."""
    docs = docs.drop(name)
    version = str(hash((machine.weights.tobytes(), machine.codes.tobytes())))
    return docs.mapInArrow(_scored_rows(machine, version, name), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score(docs: DataFrame, machine: Margins) -> DataFrame:
    """doc_id, held_out, score, predicted: a row per row of ``docs``."""
    scored = with_score(texts(docs), machine)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
