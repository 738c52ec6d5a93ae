"""Secrets in texts: regular expressions behind an inverted index of trigrams.

Every rule states, as a disjunction of conjunctions of literals, what its pattern cannot match without; the literals'
trigrams make a Boolean query. The index holds postings (trigram, document) for the trigrams that any rule asks for.
A rule's candidates come from intersecting the postings of a conjunct (a count of distinct trigrams per document and
conjunct) and uniting conjuncts; only they are verified with the pattern. A rule without mandatory trigrams scans every
text. Everything is a DataFrame expression.

Matches are leftmost and do not overlap within a rule; a match whose value is too short is dropped after it has consumed
its text. Positions are code points, end exclusive: the text is split at the matches, and the lengths of the pieces and of
the matches give the positions, so no marker is written into the text.

Defined cases: a null text is empty; repeated rows are scanned alike; several rows with one doc_id share candidates, which
only adds verification; rows without doc_id are candidates of their own (null-safe join). Postings are counted per
document, so a trigram that is in a third of all texts is one row for each of them, spread by document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.storage import texts


@dataclass(frozen=True)
class Rule:
    """kind; pattern; the group whose length counts; its least length; literals (lower case) without which no match is
    possible: one list of literals for each alternative, none for a full scan."""

    kind: str
    pattern: str
    group: int
    least: int
    needs: tuple[tuple[str, ...], ...] = ()

    def conjuncts(self) -> list[list[str]]:
        return [sorted({literal[i : i + 3] for literal in part for i in range(len(literal) - 2)}) for part in self.needs]


# The base kinds, in the order in which they are listed.
RULES = (
    Rule(
        "assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12,
        (("password",), ("passwd",), ("secret",), ("token",), ("apikey",), ("api_key",)),
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, (("akia",),)),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id): the documents whose lower-cased text holds each of the wanted trigrams."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("doc_id", F.explode(present).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, kinds): the rules whose Boolean trigram query a document fulfils; documents without any are left out."""
    parts = [(rule.kind, f"{rule.kind}{i}", t, len(grams)) for rule in rules for i, grams in enumerate(rule.conjuncts()) for t in grams]
    wanted = docs.sparkSession.createDataFrame(parts, "kind string, part string, trigram string, needed int")
    hits = postings(docs, sorted({p[2] for p in parts})).join(F.broadcast(wanted), "trigram")
    met = hits.groupBy("doc_id", "kind", "part").agg(F.count_distinct("trigram").alias("n"), F.first("needed").alias("needed")).where("n = needed")
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, kind, place>> of a rule's matches that are long enough."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    rows = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("hit"), values.alias("value"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:int>>").alias("found"))
    placed = F.aggregate(
        rows, zero,
        lambda s, r: F.struct(
            (s["at"] + F.length(r["gap"]) + F.coalesce(F.length(r["hit"]), F.lit(0))).alias("at"),
            F.when(r["hit"].isNull(), s["found"]).otherwise(
                F.concat(s["found"], F.array(F.struct(
                    (s["at"] + F.length(r["gap"])).alias("start"), (s["at"] + F.length(r["gap"]) + F.length(r["hit"])).alias("end"), F.length(r["value"]).alias("value"))))
            ).alias("found"),
        ),
        lambda s: s["found"],
    )
    return F.filter(placed, lambda r: r["value"] >= rule.least)


def _named(spans: Column, place: int, kind: str) -> Column:
    return F.transform(spans, lambda r: F.struct(r["start"].alias("start"), F.lit(place).alias("place"), r["end"].alias("end"), F.lit(kind).alias("kind")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, found: array<struct<start, place, end, kind>> in order of start, then of the rule: a row per row of ``docs``."""
    docs = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    indexed = [rule for rule in rules if rule.needs]
    wanted = candidates(docs, tuple(indexed)).withColumnRenamed("doc_id", "candidate")
    joined = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("candidate")), "left")
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
    spans = []
    for place, rule in enumerate(rules):
        named = _named(_spans(F.col("text"), rule), place, rule.kind)
        test = F.col("text").rlike(rule.pattern) if not rule.needs else F.array_contains("kinds", rule.kind)
        spans.append(F.when(test, named).otherwise(none))
    return joined.select("doc_id", F.array_sort(F.concat(*spans)).alias("found"))


def joined_spans(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda r: F.concat_ws(":", r["kind"], r["start"].cast("string"), r["end"].cast("string"))), ",")
