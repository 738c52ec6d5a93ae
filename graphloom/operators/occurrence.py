"""Which entries of a vocabulary occur inside which texts, by an automaton over vocabulary blocks.

Texts are dealt to slices and entries to blocks of bounded size. A task holds one of each: it builds an Aho-Corasick automaton of its
entries and reads every text once, whatever the number of entries, so the only rows made are occurrences.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of a slice and entries of a block.
TEXT_SLICE = 20_000
ENTRY_BLOCK = 50_000


def _occurrences(slice_: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    import ahocorasick

    found: tuple[list[str], list[str]] = ([], [])
    automaton = ahocorasick.Automaton()
    everywhere = False
    for e in block["e"]:
        if e:
            automaton.add_word(e, e)
        else:
            everywhere = True
    automaton.make_automaton()
    for t in slice_["t"]:
        inside = {e for _, e in automaton.iter(t)} if len(automaton) else set()
        if everywhere:
            inside.add("")
        found[0].extend([t] * len(inside))
        found[1].extend(inside)
    return pd.DataFrame({"t": found[0], "e": found[1]}, dtype=object)


def contained_entries(texts: DataFrame, text: str, vocab: DataFrame, entry: str) -> DataFrame:
    """(text, entry) wherever the entry occurs inside the text; both already normalised, NULLs occur nowhere."""
    asked = texts.select(F.col(text).alias("t")).where(F.col("t").isNotNull()).distinct()
    entries = vocab.select(F.col(entry).alias("e")).where(F.col("e").isNotNull()).distinct()

    def parts(df: DataFrame, size: int):
        return df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int")).scalar()

    slices, blocks = parts(asked, TEXT_SLICE), parts(entries, ENTRY_BLOCK)
    left = asked.select("t", F.pmod(F.xxhash64("t"), slices).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    right = entries.select("e", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.pmod(F.xxhash64("e"), blocks).cast("int").alias("block"))
    found = left.groupBy("slice", "block").cogroup(right.groupBy("slice", "block")).applyInPandas(_occurrences, "t string, e string")
    return found.select(F.col("t").alias(text), F.col("e").alias(entry))
