"""Lines that a site repeats on many of its pages.

For each host, the pages that hold a line are divided by the host's pages; a line above ``ratio`` is boilerplate of that
host and is dropped from its pages. Pages are counted by their text: exact copies of a page are one page in both counts,
so a page that was copied a thousand times does not make its own lines boilerplate. ``min_pages`` keeps a small host from
losing lines that only two or three pages share.

A host can only have (lines per page) / ratio boilerplate lines, so its list stays short however many pages it has.
Counts are combined before each shuffle, and documents are never grouped by host: the lists go to the documents, by
broadcast when their checked number is small and otherwise by a join that splits each host over ``SALTS`` keys.

Defined cases: a null text has no lines and stays null; a null host and an empty one are the same host; lines are compared
without outer spaces; blank lines are neither counted nor dropped; repeated rows are cleaned alike and count as one page;
other columns come back unchanged, except that n_lines and n_removed are set. A line is identified by a 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.storage import bounded, keep

BROADCAST_LINES = 200_000
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def site_lines(docs: DataFrame, host: str = "source", ratio: float = 0.02, min_pages: int = 5) -> DataFrame:
    """(host, line): the keys of the lines that exceed the ratio on their host."""
    pages = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.xxhash64("text").alias("page"), "text")
    totals = pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    lines = pages.select("host", "page", F.explode(_lines(F.col("text"))).alias("line")).where(F.trim("line") != "").select("host", "page", _key(F.col("line")).alias("line"))
    counts = lines.distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return counts.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("pages")).select("host", "line")


def drop_site_lines(docs: DataFrame, host: str = "source", ratio: float = 0.02, min_pages: int = 5) -> DataFrame:
    """``docs`` without boilerplate lines in ``text``, with n_lines (lines of the input) and n_removed."""
    found = keep(site_lines(docs, host, ratio, min_pages))
    lists = found.groupBy(F.col("host").alias("_host")).agg(F.collect_set("line").alias("_drop"))
    keyed = docs.drop("n_lines", "n_removed").withColumn("_host", F.coalesce(F.col(host).cast("string"), F.lit("")))
    if bounded(found, BROADCAST_LINES):
        joined = keyed.join(F.broadcast(lists), "_host", "left")
    else:
        salted = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int")).join(salted, ["_host", "_salt"], "left").drop("_salt")
    lines = _lines(F.col("text"))
    kept = F.filter(lines, lambda line: (F.trim(line) == "") | ~F.array_contains("_drop", _key(line)))
    kept = F.when(F.col("_drop").isNull(), lines).otherwise(kept)
    result = joined.withColumn("_kept", kept)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    cleaned = {"n_lines": n, "n_removed": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines) - F.size("_kept")).cast("long"), "text": F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n"))}
    return result.withColumns(cleaned).select(*docs.drop("n_lines", "n_removed").columns, "n_lines", "n_removed")
