"""Approximate nearest neighbours by multiprobe p-stable hashing with exact reranking.

Index: norms are cut into ranges, each ``RANGE`` times shorter than the one before, and every vector is lengthened by
sqrt(M^2 - |x|^2), M the upper end of its range, so that within a range the largest inner product is the smallest Euclidean
distance, and a long vector does not press the others into a few cells. The longest ranges that hold at most ``HEAD`` of
all vectors are compared with every query instead: with uneven norms most true neighbours are there. Each of ``tables`` hash tables cuts ``bits`` Gaussian (2-stable) projections into cells of a
width of ``width`` (in units of M); a vector's cells are its bucket. Every other vector is in every table; all ranges share the buckets.

Query: a table's home bucket and ``probes`` - 1 perturbed ones are visited, in the order of their estimated success:
perturbation sets are ordered once by the expected squared distances to the cell walls, and a query maps them to its
own walls, nearest first. Candidates of all buckets and tables are scored exactly, in double precision, and merged. Queries with fewer than k rows are then compared with all vectors, in blocks.

Work is dealt by (table, slot, part, chunk): slots take whole buckets by hash, parts split the vectors of a slot that
holds more than ``BLOCK`` and chunks its queries, both from counts, so no task grows with a hot bucket. Equal vectors are
one entry that carries its smallest k + 1 ids - no query can need more - so a vector that fills a third of the table is
not a hot bucket either. A task returns k rows for each of its queries.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an
id or vectors of another length than most; ties go to the smaller id; a repeated id with equal vectors is one row; only
tables with too few vectors give fewer than k rows; an empty table gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.storage import bounded, keep
from graphloom.llm.words import mix

BLOCK = 50_000
ASKING = 1_000  # queries of a block that is compared with all vectors
RANGE, HEAD = 1.05, 0.1


class Family:
    """The projections of all tables, and the order in which perturbations are tried."""

    def __init__(self, dim: int, norm: float, tables: int, bits: int, width: float, probes: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.norm, self.tables, self.bits, self.width = norm, tables, bits, width
        self.lines = rng.standard_normal((dim + 1, tables * bits))
        self.shift = rng.uniform(0, width, tables * bits)
        self.salt = rng.integers(1, 2**62, (tables, bits), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.sets = perturbations(bits, probes)

    def cells(self, x: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers and the places inside the cells, each (vectors, tables, bits)."""
        at = (np.column_stack([x / self.norm, extra]) @ self.lines + self.shift) / self.width
        cell = np.floor(at)
        shape = (len(x), self.tables, self.bits)
        return cell.astype(np.int64).reshape(shape), (at - cell).reshape(shape)

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """64-bit bucket keys from cell numbers (..., tables, bits)."""
        return mix((cells.astype(np.uint64) * self.salt).sum(axis=-1, dtype=np.uint64)).view(np.int64)

    def entries(self, x: np.ndarray, part: np.ndarray) -> np.ndarray:
        x = x * (RANGE ** part)[:, None]
        rest = np.sqrt(np.maximum(0, 1 - (x**2).sum(1) / self.norm**2))
        return self.keys(self.cells(x, rest)[0])

    def visits(self, q: np.ndarray) -> np.ndarray:
        """Bucket keys (queries, tables, probes) in the order of their estimated success; queries are scaled to M."""
        scaled = q * (self.norm / np.sqrt((q**2).sum(1)))[:, None]
        cell, inside = self.cells(scaled, np.zeros(len(q)))
        walls = np.concatenate([inside, 1 - inside], axis=-1)  # below, above
        order = np.argsort(walls, axis=-1)
        moves = np.zeros((2 * self.bits, self.bits), np.int64)
        moves[np.arange(2 * self.bits), np.arange(2 * self.bits) % self.bits] = np.repeat([-1, 1], self.bits)
        out = np.empty((len(q), self.tables, len(self.sets)), np.int64)
        for p, ranks in enumerate(self.sets):
            step = moves[order[..., ranks]].sum(axis=-2) if len(ranks) else 0
            out[..., p] = self.keys(cell + step)
        return out


def perturbations(bits: int, probes: int) -> list[list[int]]:
    """Sets of wall ranks (0 the nearest of 2 * bits) in the order of their expected score; the empty set first.

    The walls of one projection have ranks r and 2 * bits - 1 - r, so a valid set never holds both.
    """
    m = bits
    j = np.arange(1, m + 1)
    low = j * (j + 1) / (4 * (m + 1) * (m + 2))
    high = 1 - j[::-1] / (m + 1) + j[::-1] * (j[::-1] + 1) / (4 * (m + 1) * (m + 2))
    score = np.concatenate([low, high])
    found: list[list[int]] = [[]]
    heap: list[tuple[float, list[int]]] = [(float(score[0]), [0])]
    while heap and len(found) < probes:
        total, own = heapq.heappop(heap)
        if all(2 * m - 1 - r not in own for r in own):
            found.append(own)
        last = own[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - score[last] + score[last + 1], [*own[:-1], last + 1]))
            heapq.heappush(heap, (total + score[last + 1], [*own, last + 1]))
    return found


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.stack(column.to_list()).astype(np.float64) if len(column) else np.zeros((0, 1))
    return column.values.to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _entry_rows(family: Family, head: int):
    """A row per vector and table; the vectors of the norm ranges below ``head`` stand in one bucket of one more table."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("norm_range").to_numpy()
            keys = family.entries(_matrix(batch.column("v")), part.astype(np.float64))
            long, rest = np.nonzero(part < head)[0], np.nonzero(part >= head)[0]
            for t in range(family.tables + 1):
                at, bucket = (rest, keys[rest, t]) if t < family.tables else (long, np.zeros(len(long), np.int64))
                pick = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(bucket), batch.column("rep").take(pick), batch.column("v").take(pick)], ["t", "bucket", "rep", "v"])

    return rows


def _visit_rows(family: Family, slots: int):
    """A row per query, table and slot with the slot's buckets that the query visits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = family.visits(_matrix(batch.column("v")))
            slot = np.mod(keys, slots)
            for t in range(family.tables):
                for s in range(slots):
                    own = [k[m] for k, m in zip(keys[:, t], slot[:, t] == s, strict=True)]
                    at = np.nonzero([len(k) > 0 for k in own])[0]
                    pick = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), t, np.int32)), pa.array(np.full(len(at), s, np.int64)), batch.column("query_id").take(pick), batch.column("v").take(pick),
                         pa.array([own[i] for i in at], pa.list_(pa.int64()))], ["t", "slot", "query_id", "v", "buckets"],
                    )

    return rows


def _scored(k: int):
    def rows(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return pd.DataFrame({"query_id": [], "rep": [], "score": []}).astype({"query_id": "int64", "rep": "int64"})
        index = index.sort_values("bucket", kind="stable")
        bucket, rep, x = index["bucket"].to_numpy(), index["rep"].to_numpy(), _matrix(index["v"])
        starts = np.r_[0, np.nonzero(np.diff(bucket))[0] + 1]
        names, ends = bucket[starts], np.r_[starts[1:], len(bucket)]
        out = [[], [], []]
        for query_id, v, wanted in zip(queries["query_id"], queries["v"], queries["buckets"], strict=True):
            at = np.searchsorted(names, wanted)
            at = np.unique(at[names[np.minimum(at, len(names) - 1)] == wanted])
            if not len(at):
                continue
            pick = np.concatenate([np.arange(a, b) for a, b in zip(starts[at], ends[at], strict=True)])
            score = x[pick] @ np.asarray(v, np.float64)
            if len(pick) > k + 1:  # one more than k: the query itself may be among them
                edge = np.partition(score, -(k + 1))[-(k + 1)]
                pick, score = pick[score >= edge], score[score >= edge]
            best = np.lexsort((rep[pick], -score))[: k + 1]
            out[0].append(np.full(len(best), query_id))
            out[1].append(rep[pick[best]])
            out[2].append(score[best])
        columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pd.DataFrame({"query_id": columns[0].astype(np.int64), "rep": columns[1].astype(np.int64), "score": columns[2]})

    return rows


def _exact(a: str, b: str):
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, p: s + p)


def neighbours(
    vectors: DataFrame, is_query: str, k: int = 20, tables: int = 12, bits: int = 8, width: float = 2.0, probes: int = 110
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for the rows that fulfil the SQL test ``is_query``.

    ``vectors``: vec_id, embedding (array of float or double). Other columns are ignored but may be used in the test.
    """
    spark = vectors.sparkSession
    zero = F.lit(0.0)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    square = F.aggregate("embedding", zero, lambda s, x: s + x.cast("double") * x.cast("double"))
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite).where(square > 0)
    usable = usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), F.coalesce(F.expr(is_query), F.lit(False)).alias("asks"), square.alias("square")).withColumn("dim", F.size("v"))
    sizes = usable.groupBy("dim").agg(F.count("*").alias("n"), F.max("square").alias("square")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, count = sizes[0]["dim"], sizes[0]["n"]
    usable = usable.where(F.col("dim") == dim)
    longest = float(np.sqrt(sizes[0]["square"]))
    family = Family(dim, longest, tables, bits, width, probes)
    # Equal vectors are one entry with its smallest k + 1 ids; ranking is cut before the shuffle.
    alike = Window.partitionBy("v").orderBy("vec_id")
    classes = keep(
        usable.select("v", "vec_id").withColumn("r", F.row_number().over(alike)).where(F.col("r") <= k + 1)
        .groupBy("v").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
    )
    # Rounding must not tear vectors of one norm apart at the end of a range.
    norm_range = F.greatest(F.lit(0), F.floor(F.log(F.lit(longest) / F.sqrt(_exact("v", "v"))) / F.lit(float(np.log(RANGE))) + F.lit(1e-3))).cast("long")
    ranged = classes.select("rep", "v", norm_range.alias("norm_range"))
    head, held, of = 0, 0, classes.count()
    for row in ranged.groupBy("norm_range").agg(F.count("*").alias("n")).orderBy("norm_range").collect():
        held += row["n"]
        if held > HEAD * of:
            break
        head = row["norm_range"] + 1
    slots = -(-count // BLOCK)
    entries = ranged.mapInArrow(_entry_rows(family, head), f"t int, bucket long, rep long, v {usable.schema['v'].dataType.simpleString()}")
    entries = keep(entries.withColumn("slot", F.pmod("bucket", F.lit(slots))))
    asked = usable.where("asks").select(F.col("vec_id").alias("query_id"), "v").dropDuplicates(["query_id"])
    visits = keep(asked.mapInArrow(_visit_rows(family, slots), f"t int, slot long, query_id long, v {usable.schema['v'].dataType.simpleString()}, buckets array<long>"))
    if head:
        visits = visits.union(asked.select(F.lit(tables).alias("t"), F.lit(0).cast("long").alias("slot"), "query_id", "v", F.array(F.lit(0).cast("long")).alias("buckets")))
    found = keep(_best(entries, visits, k))
    ids = found.join(classes.select("rep", "ids"), "rep").select("query_id", F.size(F.filter("ids", lambda i: i != F.col("query_id"))).alias("n"))
    enough = ids.groupBy("query_id").agg(F.sum("n").alias("n")).where(F.col("n") >= k)
    short = keep(asked.join(enough, "query_id", "left_anti"))
    if not short.isEmpty():
        one = lambda df, *more: df.select(F.lit(0).alias("t"), F.lit(0).cast("long").alias("slot"), *more)
        every = one(classes, F.lit(0).cast("long").alias("bucket"), "rep", "v")
        asking = one(short, "query_id", "v", F.array(F.lit(0).cast("long")).alias("buckets"))
        found = found.join(short, "query_id", "left_anti").union(_best(every, asking, k, ASKING))
    # Scores once more, as one sum in a fixed order, so that equal vectors have equal scores in every plan.
    pairs = found.join(classes.withColumnRenamed("v", "cv"), "rep").join(asked, "query_id").withColumn("score", _exact("v", "cv"))
    rows = pairs.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _best(entries: DataFrame, visits: DataFrame, k: int, asking: int = BLOCK) -> DataFrame:
    """query_id, rep: the k + 1 best entries of each query in the buckets that it visits."""
    load = lambda df, name, most: df.groupBy("t", "slot").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    loads = load(entries, "parts", BLOCK).join(load(visits, "chunks", asking), ["t", "slot"])
    if bounded(loads, 100_000):
        loads = F.broadcast(loads)
    left, right = entries.join(loads, ["t", "slot"]), visits.join(loads, ["t", "slot"])
    left = left.withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = right.withColumn("chunk", F.pmod(F.xxhash64("query_id"), "chunks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = ["t", "slot", "part", "chunk"]
    scored = left.select(*key, "bucket", "rep", "v").groupBy(*key).cogroup(right.select(*key, "query_id", "v", "buckets").groupBy(*key)).applyInPandas(_scored(k), "query_id long, rep long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    return scored.dropDuplicates(["query_id", "rep"]).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("query_id", "rep")
