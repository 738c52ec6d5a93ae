"""Deterministic answer scoring over tables of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as tx

# ---- fixed values -----------------------------------------------------------
PIPELINES = ("rag", "graphrag", "agentic_graphrag")
AGENT, BASE, GRAPH = "agentic_graphrag", "rag", "graphrag"
METRICS = ("em", "f1", "precision", "recall", "completeness", "grounded")
GRAPH_ERROR_PREFIX = "graph query error: "
# -----------------------------------------------------------------------------


def _same_set(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0)


def _match(parts: Column, gold_parts: Column) -> Column:
    def hit(mine: Column, gold: Column) -> Column:
        return tx.let(
            tx.names_of(gold),
            lambda wanted: _same_set(mine[0], wanted) | (tx.is_count(wanted) & _same_set(mine[1], wanted)),
        )

    found = tx.let(
        F.array(tx.names_of(parts), tx.numbers_of(parts)),
        lambda mine: (F.size(mine[0]) > 0) & F.coalesce(F.exists(gold_parts, lambda g: hit(mine, g)), F.lit(False)),
    )
    return F.when(found, 1.0).otherwise(0.0)


def exact_match(answer: Column, variants: Column) -> Column:
    """1.0 when the answer's name set equals a variant's, or its one number a count variant."""
    return _match(tx.answer_parts(answer), F.transform(variants, tx.answer_parts))


def _pair_f1(predicted: Column, gold: Column) -> Column:
    def times(words: Column, x: Column) -> Column:
        return F.size(F.filter(words, lambda w: w == x))

    def score(sides: Column) -> Column:
        mine, wanted = sides[0], sides[1]
        shared = F.aggregate(
            F.array_distinct(mine), F.lit(0), lambda s, x: s + F.least(times(mine, x), times(wanted, x))
        )
        total = F.size(mine) + F.size(wanted)
        return F.when(total == 0, 1.0).otherwise(F.lit(2.0) * shared / total)

    return tx.let(F.array(predicted, gold), score)


def _best_f1(parts: Column, gold_parts: Column) -> Column:
    tokens = F.flatten(parts)
    return F.coalesce(
        F.array_max(F.transform(gold_parts, lambda g: _pair_f1(tokens, F.flatten(g)))), F.lit(0.0)
    )


def token_f1(answer: Column, variants: Column) -> Column:
    """Token F1, best over the variants (2·shared / total tokens).

    Made for answer spans: work grows with the square of one answer's tokens.
    ``token_f1_table`` is the linear form for long texts.
    """
    return _best_f1(tx.answer_parts(answer), F.transform(variants, tx.answer_parts))


def token_f1_table(pairs: DataFrame, key: list[str]) -> DataFrame:
    """(key, f1) for texts of any length: tokens are counted in a shuffle.

    ``pairs``: key columns, answer, variants (array).
    """
    sides = pairs.select(
        *key, F.posexplode("variants").alias("variant", "gold"), "answer"
    )
    tokens = sides.select(
        *key, "variant",
        F.explode(
            F.array(
                F.struct(F.lit(True).alias("mine"), tx.answer_tokens(F.col("answer")).alias("words")),
                F.struct(F.lit(False).alias("mine"), tx.answer_tokens(F.col("gold")).alias("words")),
            )
        ).alias("s"),
    ).select(*key, "variant", "s.mine", F.explode("s.words").alias("token"))
    counted = (
        tokens.groupBy(*key, "variant", "token")
        .agg(F.count_if("mine").alias("p"), F.count_if(~F.col("mine")).alias("g"))
        .groupBy(*key, "variant")
        .agg(F.sum(F.least("p", "g")).alias("shared"), F.sum(F.col("p") + F.col("g")).alias("total"))
    )
    scored = sides.select(*key, "variant").join(counted, [*key, "variant"], "left").select(
        *key,
        F.when(F.col("total").isNull(), 1.0).otherwise(F.lit(2.0) * F.col("shared") / F.col("total")).alias("f1"),
    )
    best = scored.groupBy(*key).agg(F.max("f1").alias("f1"))
    return pairs.select(*key).join(best, key, "left").withColumn("f1", F.coalesce("f1", F.lit(0.0)))


def retrieval_metrics(retrieved: Column, gold: Column) -> Column:
    """struct(precision, recall, f1) over distinct non-empty document ids."""

    def ids(values: Column) -> Column:
        return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))

    mine, wanted = ids(retrieved), ids(gold)
    hits = F.size(F.array_intersect(mine, wanted))
    usable = F.coalesce((F.size(mine) > 0) & (F.size(wanted) > 0), F.lit(False))
    return F.struct(
        F.when(usable, hits / F.size(mine)).otherwise(0.0).alias("precision"),
        F.when(usable, hits / F.size(wanted)).otherwise(0.0).alias("recall"),
        F.when(usable, F.lit(2.0) * hits / (F.size(mine) + F.size(wanted))).otherwise(0.0).alias("f1"),
    )


def retrieval_table(retrieved: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """The same metrics from long tables (key, doc_id) of any size."""
    both = (
        retrieved.select(*key, "doc_id", F.lit(1).alias("r"), F.lit(0).alias("g"))
        .unionByName(gold.select(*key, "doc_id", F.lit(0).alias("r"), F.lit(1).alias("g")))
        .where(F.col("doc_id") != "")
        .groupBy(*key, "doc_id").agg(F.max("r").alias("r"), F.max("g").alias("g"))
        .groupBy(*key)
        .agg(F.sum("r").alias("n_r"), F.sum("g").alias("n_g"), F.sum(F.col("r") * F.col("g")).alias("hits"))
    )
    zero = F.lit(0.0)
    return both.select(
        *key,
        F.coalesce(F.try_divide("hits", "n_r"), zero).alias("precision"),
        F.coalesce(F.try_divide("hits", "n_g"), zero).alias("recall"),
        F.when((F.col("n_r") > 0) & (F.col("n_g") > 0), F.lit(2.0) * F.col("hits") / (F.col("n_r") + F.col("n_g")))
        .otherwise(zero).alias("f1"),
    )


def _padded(texts: Column) -> Column:
    cited = F.array_join(F.filter(texts, lambda t: t.isNotNull() & (t != "")), " ")
    return F.concat(F.lit(" "), tx.normalize_answer(cited), F.lit(" "))


def _support(names: Column, hay: Column) -> Column:
    def share(ns: Column) -> Column:
        found = F.filter(ns, lambda n: F.contains(hay, F.concat(F.lit(" "), n, F.lit(" "))))
        return F.when((F.size(ns) > 0) & (F.trim(hay) != ""), F.size(found) / F.size(ns)).otherwise(0.0)

    return tx.let(names, share)


def grounding(answer: Column, evidence: Column) -> Column:
    """Share of the answer's names that stand, as whole words, in the cited texts."""
    return tx.let(_padded(evidence), lambda hay: _support(tx.normalized_names(answer), hay))


def with_evidence(questions: DataFrame) -> DataFrame:
    """Adds what scoring needs of ground truth, citations and gold documents: ``_g``, ``_hay`` and ``_r``.

    Where the answers of several pipelines share them, they are prepared here once a question, before a question is spread to its answers.
    """
    none = F.array().cast("array<string>")
    cites = F.coalesce("citations", F.array().cast(dict(questions.dtypes)["citations"]))
    return questions.withColumns(
        {
            "_g": F.transform(F.coalesce("ground_truth", none), tx.answer_parts),
            "_hay": _padded(F.transform(cites, lambda c: c["snippet"])),
            "_r": retrieval_metrics(
                F.transform(cites, lambda c: c["source_id"]), F.coalesce("gold_doc_ids", none)
            ),
        }
    )


def score_answers(answers: DataFrame) -> DataFrame:
    """Adds the six metrics. Without ground truth all but ``grounded`` are NULL.

    ``answers``: answer, ground_truth, gold_doc_ids, citations
    (array<struct<source_id, snippet>>), or the columns of ``with_evidence`` for the last three. Every text is normalised once.
    """
    shared = answers if {"_g", "_hay", "_r"} <= set(answers.columns) else with_evidence(answers)
    prepared = shared.withColumn("_p", tx.answer_parts(F.col("answer")))
    has_gold = F.size("_g") > 0
    return prepared.withColumns(
        {
            "em": F.when(has_gold, _match(F.col("_p"), F.col("_g"))),
            "f1": F.when(has_gold, _best_f1(F.col("_p"), F.col("_g"))),
            "precision": F.when(has_gold, F.col("_r.precision")),
            "recall": F.when(has_gold, F.col("_r.recall")),
            "completeness": F.when(has_gold, F.col("_r.recall")),
            "grounded": _support(tx.names_of(F.col("_p")), F.col("_hay")),
        }
    ).drop("_p", "_g", "_hay", "_r")


def mean_scores(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of each metric; nothing to average scores zero."""
    means = [F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS]
    return (scored.groupBy(*by) if by else scored.groupBy()).agg(F.count(F.lit(1)).alias("n"), *means)


def mean_scores_by_type(scored: DataFrame) -> DataFrame:
    return mean_scores(
        scored.withColumn("qtype", F.coalesce(F.nullif("qtype", F.lit("")), F.lit("unknown"))), ["qtype"]
    )


# ---- verdicts -----------------------------------------------------------------------


def _pivoted(answers: DataFrame, key: list[str]) -> DataFrame:
    """One row per question with each pipeline's answer side by side."""
    picks = []
    for p in PIPELINES:
        mine = F.col("pipeline") == p
        picks += [
            F.max(F.when(mine, F.col("tokens_total"))).alias(f"t_{p}"),
            F.max(F.when(mine, F.col("status") == "error")).alias(f"e_{p}"),
            F.max(F.when(mine, F.coalesce("em", F.lit(0.0)))).alias(f"em_{p}"),
        ]
    return answers.groupBy(*key).agg(*picks, F.bool_or(F.size("ground_truth") > 0).alias("has_gold"))


def verdicts(scored: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Token multipliers, accuracy deltas and a one-sentence summary per question.

    ``scored``: key, pipeline, tokens_total, status, em, ground_truth.
    """
    key = key or ["run_id", "qid"]
    one = _pivoted(scored, key)

    def errored(p: str) -> Column:
        return F.coalesce(f"e_{p}", F.lit(False))

    def ratio(base: str) -> Column:
        spent, of = F.coalesce(f"t_{AGENT}", F.lit(0)), F.coalesce(f"t_{base}", F.lit(0))
        return F.when(~errored(AGENT) & ~errored(base) & (of > 0), F.bround(spent / of, 2))

    def delta(base: str) -> Column:
        return F.when(
            F.col("has_gold"),
            F.bround(F.coalesce(f"em_{AGENT}", F.lit(0.0)) - F.coalesce(f"em_{base}", F.lit(0.0)), 2),
        )

    out = one.select(
        *key,
        ratio(BASE).alias("token_multiplier_vs_rag"),
        ratio(GRAPH).alias("token_multiplier_vs_graphrag"),
        delta(BASE).alias("delta_rag"),
        delta(GRAPH).alias("delta_graphrag"),
        F.when(errored(AGENT), "Agentic GraphRAG errored")
        .when(errored(BASE), "RAG errored")
        .otherwise("RAG spent no tokens")
        .alias("_why"),
    )
    r = F.col("token_multiplier_vs_rag")
    d = F.col("delta_rag")
    at = F.when(r.isNotNull(), F.concat(F.lit(" at "), r.cast("string"), F.lit("x its tokens"))).otherwise(
        F.concat(F.lit(" ("), "_why", F.lit(": no cost ratio)"))
    )
    cost = F.when(r.isNotNull(), F.concat(F.lit("Agentic cost "), r.cast("string"), F.lit("x RAG tokens."))).otherwise(
        F.concat("_why", F.lit(": no cost ratio."))
    )
    summary = (
        F.when(d.isNull(), F.concat(F.lit("No ground truth for this query, so the accuracy delta is N/A. "), cost))
        .when(d > 0, F.concat(F.lit("Agentic was correct where RAG was not,"), at, F.lit(".")))
        .when(d < 0, F.concat(F.lit("Agentic lost to RAG on this query"), at, F.lit(".")))
        .otherwise(F.concat(F.lit("No accuracy gain over RAG"), at, F.lit(".")))
    )

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("n/a"))

    return out.select(
        *key, "token_multiplier_vs_rag", "token_multiplier_vs_graphrag",
        shown("delta_rag").alias("accuracy_delta_vs_rag"),
        shown("delta_graphrag").alias("accuracy_delta_vs_graphrag"),
        summary.alias("summary_line"),
    )


def merged_records(answers: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One row per question with a map pipeline -> record."""
    key = key or ["run_id", "qid"]
    keep = [c for c in answers.columns if c not in (*key, "pipeline")]
    return answers.groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.struct("pipeline", F.struct(*keep)))).alias("pipelines")
    )


def error_records(questions: DataFrame, answers: DataFrame, detail: str = "no answer was produced") -> DataFrame:
    """Every (question, pipeline), failed ones as error rows that keep what they spent.

    ``questions``: qid, pipeline expected. ``answers``: qid, pipeline, answer,
    status, tokens_total, error_detail.
    """
    joined = questions.join(answers, ["qid", "pipeline"], "left")
    failed = F.col("status").isNull() | (F.col("status") == "error")
    why = F.coalesce("error_detail", F.lit(detail))
    return joined.select(
        "qid", "pipeline",
        F.when(failed, "").otherwise(F.col("answer")).alias("answer"),
        F.when(failed, F.concat(F.lit("Pipeline failed: "), why)).alias("explanation"),
        F.coalesce("tokens_total", F.lit(0)).alias("tokens_total"),
        F.when(failed, "error").otherwise(F.col("status")).alias("status"),
        F.when(failed, why).alias("error_detail"),
    )


def has_error(status: Column, error_detail: Column) -> Column:
    """An answer to be tried again: failed, or given while a graph query failed."""
    return F.coalesce(status == "error", F.lit(False)) | F.coalesce(
        error_detail.startswith(GRAPH_ERROR_PREFIX), F.lit(False)
    )
