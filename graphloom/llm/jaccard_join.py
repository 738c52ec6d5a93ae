"""Documents joined by the Jaccard similarity of their n-gram sets: a blocked sparse product of the document by n-gram incidence.

The product of the incidence matrix with its transpose holds every pair's overlap. Only the columns in which a pair must meet are
multiplied: in any one order of all n-grams, two sets of similarity t share one of their first n - ceil(t n) + 1 n-grams (the
prefix), and their overlap is at most what they share there plus the longer rest. The order puts n-grams that stand in many
prefixes last; every set is ordered by the same rule, so no pair is lost, however that list is chosen.

1. Equal sets are one class. Prefix entries are counted by n-gram; those of the smallest number of entries from ``HOT`` on that
   leaves at most ``HOTTEST`` n-grams go last, the most frequent at the end (16 MB, broadcast).
2. Columns with at least two classes are kept. Rounds of stars come first: all of a column is compared with one class of it, the likeliest
   pair of each class is confirmed and merged to components, and columns inside one component are done. Rounds end when few
   pairs are left or a round no longer saves a fifth of them.
3. The product: columns are dealt to blocks of about ``ROWS`` entries, longer columns in row blocks of ``LONG`` that the columns of one
   length share; a block adds up the overlaps of its pairs of different components whose sizes fit, and the sums of all blocks
   are added by pair. Pairs below the overlap that their sizes demand of the prefix are discarded.
4. The rest is confirmed on the full sets, made again from the texts of the documents concerned and multiplied in blocks of
   ``SIDE`` by ``SIDE`` classes.

Pairs inside one component are not listed: classes and components are what comes back.

Defined cases: null or blank text has an empty set and is linked with nothing; a text of fewer words than a shingle has its word
sequence as its one shingle; a row without doc_id is linked with nothing and has no component; rows that repeat a doc_id
are one document whose component joins all their links, and each comes back; an empty table gives no rows; other columns of the
table are ignored; a very long text is one row of the incidence and its words are hashed in its own task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.storage import keep, keep_until, texts
from graphloom.llm.words import Runs, mix, signed

HOT, HOTTEST = 8, 1 << 20
ROWS, LONG, SIDE = 16_384, 1024, 256
#: Pairs left per entry up to which no round of stars is worth its while.
FEW = 2
SEEN = 1 << 18
PENDING = 1 << 21


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct fingerprints of the text's shingles."""
    runs = Runs((text or b"").lower())
    return np.unique(runs.hashes(min(size, runs.n))) if runs.n else np.zeros(0, np.uint64)


def _set_rows(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                sets = [shingle_set(t, size) for t in part.column(1).cast(pa.binary()).to_pylist()]
                sizes = np.array([len(s) for s in sets], np.int64)
                flat, edges = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(sizes)])
                h1, h2 = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ np.uint64(k)))]) for k in (1, 2))
                sums = [signed(h[edges[1:]] - h[edges[:-1]]) for h in (h1, h2)]
                grams = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(signed(flat)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), *map(pa.array, sums), grams], ["doc_id", "n", "h1", "h2", "grams"])

    return rows


def _prefix_rows(percent: int, hot: np.ndarray, rank: np.ndarray):
    """Entries (gram, row, n) of the prefixes; ``hot`` n-grams go last, by rank. Sets that this task has seen already are passed over."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        for batch in batches:
            row, n, h1, h2 = (batch.column(k).to_numpy() for k in range(4))
            edges, values = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy()
            place = np.searchsorted(hot, values)
            place = np.minimum(place, max(len(hot) - 1, 0))
            late = np.where(hot[place] == values, rank[place], 0) if len(hot) else np.zeros(len(values), np.int64)
            picked, owner = [], []
            for k, key in enumerate(zip(n.tolist(), h1.tolist(), h2.tolist(), strict=True)):
                if key in seen:
                    continue
                seen.add(key)
                length = key[0] - -(-percent * key[0] // 100) + 1
                own = late[edges[k] : edges[k + 1]]
                at = np.argsort(own, kind="stable")[:length] if own.any() else np.arange(length)
                picked.append(edges[k] + at)
                owner.append(np.full(len(at), k))
            if len(seen) > SEEN:
                seen.clear()
            if picked:
                at, k = np.concatenate(picked), np.concatenate(owner)
                yield pa.RecordBatch.from_arrays([pa.array(values[at]), pa.array(row[k]), pa.array(n[k])], ["gram", "row", "n"])

    return rows


def _fits(a: str, b: str, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return F.expr(f"{percent} * greatest({a}, {b}) <= 100 * least({a}, {b})")


def _enough(shared: str, a: str, b: str, percent: int) -> Column:
    """Whether what two prefixes share leaves the overlap that the sizes demand within reach."""
    overlap = f"({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent}"
    return F.expr(f"{shared} >= {overlap} - ({percent} * greatest({a}, {b}) + 99) div 100 + 1")


def _product_rows(percent: int):
    """Overlaps (a, b, na, nb, shared) of a block's pairs with different labels, added up over its columns."""

    def rows(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("gram", kind="stable")
        cls, index = np.unique(block["cls"].to_numpy(), return_inverse=True)
        n, label = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
        n[index], label[index] = block["n"].to_numpy(), block["label"].to_numpy()
        gram, side = block["gram"].to_numpy(), block["side"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        sizes = np.diff(np.append(starts, len(gram)))
        keys, sums, waiting, held = [], [], [], 0

        def add_up() -> None:
            key, shared = np.unique(np.concatenate(waiting), return_counts=True)
            keys.append(key)
            sums.append(shared)
            waiting.clear()

        for m in np.unique(sizes).tolist():
            i, j = np.triu_indices(m, 1)
            firsts, step = starts[sizes == m], max(1, PENDING // max(len(i), 1))
            for low in range(0, len(firsts), step):
                columns = firsts[low : low + step, None]
                x, y = (columns + i).ravel(), (columns + j).ravel()
                whole = (side[x] == 2) | (side[x] != side[y])
                x, y = index[x[whole]], index[y[whole]]
                x, y = np.minimum(x, y), np.maximum(x, y)
                good = (label[x] != label[y]) & (percent * np.maximum(n[x], n[y]) <= 100 * np.minimum(n[x], n[y]))
                waiting.append(x[good] * len(cls) + y[good])
                held += int(good.sum())
                if held > PENDING:
                    add_up()
                    held = 0
        if waiting:
            add_up()
        key, at = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_inverse=True)
        shared = np.bincount(at, np.concatenate([*sums, np.zeros(0, np.int64)]), len(key)).astype(np.int64)
        x, y = key // max(len(cls), 1), key % max(len(cls), 1)
        return pd.DataFrame({"a": cls[x], "b": cls[y], "na": n[x], "nb": n[y], "shared": shared})

    return rows


def _overlap_rows(percent: int):
    """The pairs (a, b) of a block whose full sets reach the similarity; two sides of at most about SIDE sets each."""

    def rows(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        if not len(pairs) or not len(sets):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sets = sets.sort_values("cls")
        cls, sizes = sets["cls"].to_numpy(), sets["grams"].map(len).to_numpy()
        values, owner = np.concatenate(sets["grams"].to_list()), np.repeat(np.arange(len(sets)), sizes)
        _, column, held = np.unique(values, return_inverse=True, return_counts=True)
        shared = held[column] > 1  # the others are in no overlap
        owner, (_, column) = owner[shared], np.unique(column[shared], return_inverse=True)
        x, y = np.searchsorted(cls, pairs["a"].to_numpy()), np.searchsorted(cls, pairs["b"].to_numpy())
        overlap = np.zeros((len(cls), len(cls)), np.float32)  # whole numbers far below 2**24
        for low in range(0, int(column.max()) + 1 if len(column) else 0, 2048):
            here = (column >= low) & (column < low + 2048)
            dense = np.zeros((len(cls), 2048), np.float32)
            dense[owner[here], column[here] - low] = 1
            overlap += dense @ dense.T
        both = overlap[x, y].astype(np.int64)
        good = 100 * both >= percent * (sizes[x] + sizes[y] - both)
        return pairs.loc[good, ["a", "b"]]

    return rows


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the similarity.

    Classes lie in groups by their smallest neighbour and a group in sides of about SIDE classes, so a set travels to as many
    blocks as its class has sides to meet and not with every pair.
    """
    ends = pairs.select(F.col("a").alias("cls"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    near = ends.groupBy("cls").agg(F.least("cls", F.min("other")).alias("near"))
    sides = near.groupBy("near").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("sides"))
    side = near.join(sides, "near").select("cls", F.struct("near", F.pmod(F.xxhash64("cls"), "sides").alias("k")).alias("side"))
    wanted = keep(side.join(classes, "cls"))
    source = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    made = source.mapInArrow(_set_rows(size), "doc_id long, n long, h1 long, h2 long, grams array<long>")
    sets = keep(made.join(wanted.select("cls", "doc_id", "n", "h1", "h2"), ["doc_id", "n", "h1", "h2"]).dropDuplicates(["cls"]).select("cls", "grams"))
    left, right = (wanted.select(F.col("cls").alias(c), F.col("side").alias(f"s{c}")) for c in "ab")
    dealt = keep(pairs.join(left, "a").join(right, "b").select("a", "b", F.xxhash64(F.least("sa", "sb"), F.greatest("sa", "sb")).alias("block")))
    at = F.col("block").alias("at")
    members = dealt.select(at, F.col("a").alias("cls")).union(dealt.select(at, "b")).distinct().join(sets, "cls")
    return dealt.groupBy("block").cogroup(members.groupBy("at")).applyInPandas(_overlap_rows(percent), "a long, b long")


def _hot_grams(sets: DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that go last in the order, at most HOTTEST of them, and their ranks from 1 on: the more entries, the later."""
    none = np.zeros(0, np.int64)
    entries = sets.mapInArrow(_prefix_rows(percent, none, none), "gram long, row long, n long")
    counts = keep(entries.groupBy("gram").agg(F.count("*").alias("m")).where(F.col("m") > HOT))
    beyond, least = 0, HOT
    # Different counts c > HOT add up to no more than all entries, so they are about as many as the root of those.
    for m, grams in sorted(counts.groupBy("m").agg(F.count("*").alias("grams")).collect(), reverse=True):
        if beyond + grams > HOTTEST:
            least = m
            break
        beyond += grams
    found = counts.where(F.col("m") > least).toArrow()
    gram, m = found.column("gram").to_numpy(), found.column("m").to_numpy()
    rank = np.empty(len(gram), np.int64)
    rank[np.lexsort((gram, m))] = np.arange(1, len(gram) + 1)
    order = np.argsort(gram)
    return gram[order], rank[order]


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links of at least ``percent``): a row per row of ``docs``."""
    docs = texts(docs)
    made = docs.mapInArrow(_set_rows(size), "doc_id long, n long, h1 long, h2 long, grams array<long>")
    sets, release = keep_until(made.withColumn("row", F.monotonically_increasing_id()))
    alike = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "h1", "h2").agg(F.min(F.struct("row", "doc_id")).alias("first"))
    alike = keep(alike.select("n", "h1", "h2", F.col("first.row").alias("cls"), F.col("first.doc_id").alias("doc_id")))
    rows = keep(sets.drop("grams").join(alike.drop("doc_id"), ["n", "h1", "h2"], "left").withColumn("cls", F.when(F.col("doc_id").isNotNull(), F.col("cls"))))

    incidence = sets.where("n > 0 AND doc_id IS NOT NULL").select("row", "n", "h1", "h2", "grams")
    hot = docs.sparkSession.sparkContext.broadcast(_hot_grams(incidence, percent))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _prefix_rows(percent, *hot.value)(batches)

    entries = incidence.mapInArrow(ordered, "gram long, row long, n long")
    shared = entries.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").select("gram")
    entries = keep(entries.join(shared, "gram"))
    release()
    entries = keep(entries.join(rows.where("cls IS NOT NULL").select("row", "cls"), "row").select("gram", "cls", "n").distinct())

    links: DataFrame | None = None
    labels: DataFrame | None = None
    before, number = None, 0
    while True:
        labelled = entries.withColumn("label", F.col("cls")) if labels is None else (
            entries.join(labels, entries["cls"] == labels["node"], "left").select("gram", "cls", "n", F.coalesce("label", "cls").alias("label"))
        )
        columns = labelled.groupBy("gram", "label").agg(F.count("*").alias("m")).groupBy("gram").agg(
            F.sum("m").alias("m"), ((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias("pairs")
        )
        entries = keep(labelled.join(columns.where("pairs > 0"), "gram"))
        left, held = entries.agg(F.sum(F.col("pairs") / F.col("m")), F.count("*")).first()
        if not held or number and (left <= FEW * held or left > 0.8 * before):
            break
        before, number = left, number + 1
        centre = entries.groupBy("gram").agg(F.min_by(F.struct("cls", "n", "label"), F.xxhash64("cls", F.lit(number))).alias("c"))
        stars = entries.join(centre, "gram").where(F.col("label") != F.col("c.label")).select(
            F.least("cls", "c.cls").alias("a"), F.greatest("cls", "c.cls").alias("b"), F.col("n").alias("na"), F.col("c.n").alias("nb")
        ).where(_fits("na", "nb", percent)).groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb"))
        likely = keep(stars.where(_enough("shared", "na", "nb", percent)).select("a", "b", "shared"))
        # One pair for each class, the likeliest: full sets travel with pairs.
        most = likely.select(F.col("a").alias("c"), "*").union(likely.select(F.col("b").alias("c"), "*"))
        most = most.groupBy("c").agg(F.max_by(F.struct("a", "b"), F.struct("shared", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
        found = keep(_confirmed(keep(most), docs, alike, size, percent))
        links = found if links is None else links.union(found)
        labels = components(links)
        entries = entries.select("gram", "cls", "n")

    if held:
        # Columns cut into the same number of row blocks share them, so that a block adds up several columns.
        cuts = F.when(F.col("m") <= LONG, 1).otherwise(F.pow(2, F.ceil(F.log2(F.col("m") / LONG)))).cast("int")
        totals = entries.withColumn("cuts", cuts).groupBy("cuts").agg(F.ceil(F.count("*") / (ROWS * F.col("cuts"))).cast("int").alias("blocks"))
        dealt = entries.withColumn("cuts", cuts).join(F.broadcast(totals), "cuts")  # a row per power of two
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cls"), "cuts").cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select(
            F.struct("cuts", F.pmod(F.xxhash64("gram"), "blocks")).alias("block"),
            F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "gram", "cls", "n", "label",
            F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        )
        product = dealt.groupBy("block", "i", "j").applyInPandas(_product_rows(percent), "a long, b long, na long, nb long, shared long")
        pairs = product.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared")).where(_enough("shared", "na", "nb", percent))
        pairs = keep(pairs.select("a", "b"))
        found = _confirmed(pairs, docs, alike, size, percent)
        links = found if links is None else links.union(found)

    # Rows of one doc_id are one document, whatever their sets.
    repeated = rows.where("cls IS NOT NULL").groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where("a < z")
    same = rows.where("cls IS NOT NULL").join(repeated, "doc_id").select("a", F.col("cls").alias("b")).where("a <> b")
    labels = components(same if links is None else links.union(same))
    smallest = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least"))
    labelled = keep(smallest.join(labels, smallest["cls"] == labels["node"], "left").select("cls", "least", F.coalesce("label", "cls").alias("label")))
    component = labelled.join(labelled.groupBy("label").agg(F.min("least").alias("component")), "label").select("cls", "component")
    return rows.join(component, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
