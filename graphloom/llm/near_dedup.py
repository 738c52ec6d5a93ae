"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Signature: a shingle's fingerprint is placed on a ring of ``RING`` positions (the first permutation); a second, fixed
permutation of the ring, shifted by k places, gives coordinate k as the minimum over the shingles. All coordinates of a
shingle are therefore one contiguous slice of one table. Bands of five coordinates make the candidate buckets.

Links are always confirmed on the full shingle sets. Within a bucket no list of all pairs is ever made:

1. equal sets are one class, represented by its smallest id; buckets that hold the same classes are one;
2. every member of a bucket is compared with the bucket's smallest id, and confirmed links are merged to components;
3. buckets of more than ``BLOCK`` members that still fall into several components choose another centre, and so on until
   none is left or a round no longer saves a fifth of the pairs;
4. what is still split is compared in blocks of about ``BLOCK`` members a side inside tasks, on the full sets; members of a
   bucket's largest component only meet the others. One link between two components leaves the task.

With 40 bands of 5 rows a pair at similarity 0.8 shares no bucket with probability 1.3e-7.

Defined cases: null or blank text has an empty set and is linked with nothing; a text of fewer words than a shingle has
its word sequence as its one shingle; sets under four shingles can only reach 0.8 by being equal (step 1). A row without
doc_id gets no component and is not kept. Rows that repeat a doc_id are one document and each comes back; the component
joins all their links. Other columns of the table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.storage import keep, texts
from graphloom.llm.words import Runs, mix, signed

RING = 1 << 20
BANDS, ROWS = 40, 5
BLOCK = 512
_table: np.ndarray | None = None


def _slices() -> np.ndarray:
    """Row p: the values of ring position p under every shift of the second permutation."""
    global _table
    if _table is None:
        ring = np.random.default_rng(11).permutation(RING).astype(np.uint32)
        _table = np.lib.stride_tricks.sliding_window_view(np.concatenate([ring, ring[: BANDS * ROWS]]), BANDS * ROWS)
    return _table


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct fingerprints of the text's shingles."""
    runs = Runs((text or b"").lower())
    return np.unique(runs.hashes(min(size, runs.n))) if runs.n else np.zeros(0, np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of the circulant signature."""
    places = (mix(shingles ^ np.uint64(0x5BD1E995)) >> np.uint64(44)).astype(np.int64)
    table = _slices()
    signature = np.min([table[places[i : i + 2048]].min(axis=0) for i in range(0, len(places), 2048)], axis=0)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in signature.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys


def _signed_rows(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingle_set(text, size)
                with np.errstate(over="ignore"):
                    a, b = mix(s ^ np.uint64(1)).sum(dtype=np.uint64), mix(s ^ np.uint64(2)).sum(dtype=np.uint64)
                out[0].append(len(s))
                out[1].append(int(signed(np.array([a]))[0]))
                out[2].append(int(signed(np.array([b]))[0]))
                out[3].append(signed(band_keys(s)) if len(s) > 3 else None)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, types)], ["doc_id", "n", "h1", "h2", "bands"])

    return rows


def _set_rows(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            h1 = [int(signed(np.array([mix(s ^ np.uint64(1)).sum(dtype=np.uint64)]))[0]) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(h1, pa.int64()), pa.array([signed(s) for s in sets], pa.list_(pa.int64()))], ["rep", "h1", "shingles"]
            )

    return rows


def _best_links(percent: int):
    def rows(block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop_duplicates("rep").reset_index(drop=True)
        n, label, side = block["n"].to_numpy(), block["label"].to_numpy(), block["side"].to_numpy()
        rep = block["rep"].to_numpy()
        values, owner = np.concatenate(block["shingles"].to_list()), np.repeat(np.arange(len(block)), n)
        _, column, held = np.unique(values, return_inverse=True, return_counts=True)
        several = held[column] > 1  # the others are in no intersection
        owner, (kinds, column) = owner[several], np.unique(column[several], return_inverse=True)
        shared = np.zeros((len(block), len(block)), np.float32)  # whole numbers far below 2**24
        for at in range(0, len(kinds), 4096):
            here = (column >= at) & (column < at + 4096)
            dense = np.zeros((len(block), 4096), np.float32)
            dense[owner[here], column[here] - at] = 1
            shared += dense @ dense.T
        i, j = np.nonzero((label[:, None] < label[None, :]) & ((side[:, None] != side[None, :]) | (side[:, None] == 2)))
        both = shared[i, j].astype(np.int64)
        linked = 100 * both >= percent * (n[i] + n[j] - both)
        i, j = i[linked], j[linked]
        found = pd.DataFrame({"a": rep[i], "b": rep[j], "x": label[i], "y": label[j]})
        return found.drop_duplicates(["x", "y"])[["a", "b"]]

    return rows


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a").join(right, "b").select("a", "b", shared.alias("s"), (F.size("sa") + F.size("sb") - shared).alias("u"))
        .where(f"100 * s >= {percent} * u").select("a", "b")
    )


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over confirmed links), kept: a row per row of ``docs``."""
    docs = texts(docs)
    signatures = keep(docs.mapInArrow(_signed_rows(size), "doc_id long, n long, h1 long, h2 long, bands array<long>"))
    classes = keep(
        signatures.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    )
    entries = classes.where("bands IS NOT NULL").select("rep", "h1", "n", F.explode("bands").alias("bucket"))
    centres = entries.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("rep", "n", "h1")).alias("c")).where("size > 1")
    grouped = keep(entries.join(centres, "bucket"))
    possible = f"100 * least(n, c.n) >= {percent} * greatest(n, c.n) AND rep <> c.rep"
    stars = keep(grouped.where(possible).select(F.col("c.rep").alias("a"), F.col("rep").alias("b")).distinct())

    needed = grouped.where(possible).select("rep", "h1").union(grouped.where(possible).select("c.rep", "c.h1")).union(grouped.where("size > 2").select("rep", "h1")).distinct()
    source = docs.join(needed.select("rep").distinct(), docs["doc_id"] == F.col("rep"), "left_semi")
    sets = keep(
        source.mapInArrow(_set_rows(size), "rep long, h1 long, shingles array<long>").join(needed, ["rep", "h1"]).dropDuplicates(["rep"])
    )
    links = keep(_confirmed(stars, sets, percent))
    labels = components(links)

    # Buckets that hold the same classes ask for the same pairs: one of them is enough.
    crowded = grouped.where("size > 2").select("bucket", "rep", "n")
    alike = crowded.groupBy("bucket").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    members = crowded.join(alike.groupBy("m", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket")
    before, number = None, 0
    while True:
        labelled = members.join(labels, members["rep"] == labels["node"], "left").select("bucket", "rep", "n", F.coalesce("label", "rep").alias("label"))
        shares = labelled.groupBy("bucket", "label").agg(F.count("*").alias("k"))
        shape = shares.groupBy("bucket").agg(
            F.sum("k").alias("m"), F.max("k").alias("most"), F.max_by("label", F.struct("k", "label")).alias("main"),
            ((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("pairs"),
        )
        open_members = keep(labelled.join(shape.where("pairs > 0"), "bucket"))
        large = open_members.where(F.col("m") > BLOCK)
        left, held = large.agg(F.sum(F.col("pairs") / F.col("m")), F.count("*")).first()
        if not held or before is not None and left > 0.8 * before:
            break
        before, number = left, number + 1
        # The same classes choose the same centre in every bucket.
        centre = large.groupBy("bucket").agg(F.min_by(F.struct("rep", "n", "label"), F.xxhash64("rep", F.lit(number))).alias("c"))
        stars = large.join(centre, "bucket").where(f"label <> c.label AND {possible}")
        stars = keep(stars.select(F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b")).distinct())
        links = links.union(keep(_confirmed(stars, sets, percent)))
        labels = components(links)
        members = open_members.select("bucket", "rep", "n")

    # The rest in blocks. Members of a bucket's largest component need not meet each other, only the blocks of the others.
    small = F.col("label") != F.col("main")
    others, mains = (F.ceil(c / BLOCK).cast("int") for c in (F.col("m") - F.col("most"), F.col("most")))
    whole = F.col("m") <= BLOCK
    mine = F.when(whole, 0).when(small, F.pmod(F.xxhash64("rep"), others)).otherwise(others + F.pmod(F.xxhash64("rep"), mains)).cast("int")
    last = F.when(whole, 0).when(small, others + mains - 1).otherwise(others - 1)
    dealt = (
        open_members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        .select(
            "bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "rep", "n", "label",
            F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
        )
    )
    best = dealt.join(sets.select("rep", "shingles"), "rep").groupBy("bucket", "i", "j").applyInPandas(_best_links(percent), "a long, b long").distinct()
    labels = components(links.union(keep(best)))

    named = classes.select("n", "h1", "h2", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("n", "h1", "h2", F.coalesce("label", "rep").alias("component"))
    return signatures.drop("bands").join(named, ["n", "h1", "h2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(False)).alias("kept"),
    )
