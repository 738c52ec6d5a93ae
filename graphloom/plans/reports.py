"""Run summaries, the run report, the dashboard and run comparison.

Everything starts from scored answers: one row per (run, question, pipeline),
see ``operators.scoring.score_answers``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import records as fmt
from graphloom.functions import text as tx
from graphloom.operators.scoring import AGENT, BASE, GRAPH, PIPELINES
from graphloom.session import cut_lineage

# ---- fixed values -----------------------------------------------------------
WORTH_IT = 0.5
OVERKILL = 0.05
QTYPES = ("lookup", "aggregation", "superlative", "temporal", "multi_hop")
#: metric, better direction, kind of delta, decimals shown
COMPARED = (
    ("em", "high", "absolute", 2), ("f1", "high", "absolute", 2), ("precision", "high", "absolute", 2),
    ("recall", "high", "absolute", 2), ("median_tokens", "low", "relative", 0),
    ("mean_latency_ms", "low", "relative", 0), ("f1_per_1k_tokens", "high", "absolute", 3),
    ("errors", "low", "absolute", 0),
)
NOTE_TITLED = "resolved to its page title"
NOTE_FOUND = "answer found in the graph evidence"
NOTE_RESOLVED = "resolved to"
NOTE_CONFLICT = "conflicting evidence"
# -----------------------------------------------------------------------------


def answered() -> Column:
    return F.coalesce(F.col("status") != "error", F.lit(True))


def _if_answered(value: Column) -> Column:
    return F.when(answered(), value)


def summarize_runs(scored: DataFrame, by: tuple[str, ...] = ("run_id", "pipeline")) -> DataFrame:
    """Accuracy, cost, latency and reliability per run and pipeline.

    Accuracy averages every scored answer, cost only the answered ones.
    """
    total = F.sum(_if_answered(F.col("tokens_total")))
    mean_tokens = F.avg(_if_answered(F.col("tokens_total")))
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("em").alias("em"),
        F.avg("f1").alias("f1"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("completeness").alias("completeness"),
        F.avg(_if_answered(F.col("grounded"))).alias("grounded"),
        mean_tokens.alias("mean_tokens"),
        F.median(_if_answered(F.col("tokens_total"))).alias("median_tokens"),
        F.coalesce(total, F.lit(0)).alias("total_tokens"),
        F.avg(_if_answered(F.col("tokens_in"))).alias("mean_input_tokens"),
        F.avg(_if_answered(F.col("tokens_out"))).alias("mean_output_tokens"),
        F.avg(_if_answered(F.col("latency_ms"))).alias("mean_latency_ms"),
        F.count_if(~answered()).alias("errors"),
        F.try_divide(F.avg("f1"), mean_tokens / 1000).alias("f1_per_1k_tokens"),
    )


def list_runs(answers: DataFrame, configs: DataFrame) -> DataFrame:
    """(run_id, dataset, started_at, n_questions, scored), newest first.

    ``started_at``: the header's, else the first record's, else the file's time.
    """
    seen = answers.groupBy("run_id").agg(
        F.countDistinct("qid").alias("n_questions"),
        F.bool_or(F.size("ground_truth") > 0).alias("scored"),
        F.min(F.nullif("timestamp", F.lit(""))).alias("_first"),
    )
    return (
        configs.join(seen, "run_id", "left")
        .select(
            "run_id", "run_config.dataset",
            F.coalesce(
                F.nullif("run_config.started_at", F.lit("")), "_first",
                F.date_format("file_time", "yyyy-MM-dd'T'HH:mm:ssXXX"),
            ).alias("started_at"),
            F.coalesce("n_questions", F.lit(0)).alias("n_questions"),
            F.coalesce("scored", F.lit(False)).alias("scored"),
        )
        .orderBy(F.col("started_at").desc(), "run_id")
    )


def search_runs(runs: DataFrame, text: str) -> DataFrame:
    """Runs whose id or configuration contains the text."""
    needle = text.strip().lower()
    if not needle:
        return runs
    hit = F.lit(False)
    for name in ("run_id", "dataset", "llm_model", "embedding_model", "llm_provider"):
        hit = hit | F.coalesce(F.lower(name).contains(needle), F.lit(False))
    return runs.where(hit)


def newest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc_nulls_last(), "run_id").limit(1)


# ---- report -----------------------------------------------------------------------


def headline(scored: DataFrame) -> DataFrame:
    """The report's first table per run and pipeline."""
    return summarize_runs(scored).select(
        "run_id", "pipeline", "em", "f1", "completeness", "grounded", "median_tokens",
        "mean_input_tokens", "mean_output_tokens",
        (F.coalesce("mean_latency_ms", F.lit(0.0)) / 1000).alias("mean_latency_s"), "errors",
    )


def side_by_side(scored: DataFrame) -> DataFrame:
    """One row per (run, question): em, f1, tokens and status of each pipeline."""
    out = []
    for p in PIPELINES:
        mine = F.col("pipeline") == p
        out += [
            F.max(F.when(mine, F.col("em"))).alias(f"em_{p}"),
            F.max(F.when(mine, F.col("tokens_total"))).alias(f"tokens_{p}"),
            F.max(F.when(mine, answered())).alias(f"ok_{p}"),
            F.max(F.when(mine, F.col("answer"))).alias(f"answer_{p}"),
        ]
    return scored.groupBy("run_id", "qid").agg(
        F.first("qtype", ignorenulls=True).alias("qtype"),
        F.bool_or(F.size("ground_truth") > 0).alias("has_gold"),
        F.max(F.when(F.col("pipeline") == AGENT, F.col("stop_reason"))).alias("stop_reason"),
        *out,
    )


def verdict_label(gap: Column) -> Column:
    return F.when(gap.isNull(), "—").when(gap >= WORTH_IT, "Worth it").when(gap <= OVERKILL, "Overkill").otherwise(
        "Marginal"
    )


def _ratio(drop_errors: bool) -> Column:
    ratio = F.try_divide(F.col(f"tokens_{AGENT}"), F.nullif(F.col(f"tokens_{BASE}"), F.lit(0)))
    if not drop_errors:
        return ratio
    return F.when(F.col(f"ok_{AGENT}") & F.col(f"ok_{BASE}"), ratio)


def gaps_by_type(sides: DataFrame) -> DataFrame:
    """Accuracy gap, mean of per-question token ratios and verdict per question type."""
    rows = sides.where(F.col("has_gold") & F.col("qtype").isin(*QTYPES))
    table = rows.groupBy("run_id", "qtype").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(f"em_{BASE}").alias("rag_em"),
        F.avg(f"em_{GRAPH}").alias("graphrag_em"),
        F.avg(f"em_{AGENT}").alias("agentic_em"),
        F.avg(_ratio(drop_errors=True)).alias("token_ratio"),
    )
    gap = F.col("agentic_em") - F.col("rag_em")
    return table.withColumn("gap", gap).withColumn("verdict", verdict_label(F.col("gap")))


def wins_and_losses(sides: DataFrame) -> DataFrame:
    """(run_id, qid, outcome): scored questions where the agent and the baseline differ."""
    agent, base = F.coalesce(f"em_{AGENT}", F.lit(0.0)), F.coalesce(f"em_{BASE}", F.lit(0.0))
    return sides.where(F.col("has_gold") & (agent != base)).select(
        "run_id", "qid", F.when(agent > base, "win").otherwise("loss").alias("outcome")
    )


def routing_split(sides: DataFrame) -> DataFrame:
    """Direct and loop routes: questions, median tokens, EM, and the estimated saving."""
    rows = sides.where(F.col(f"ok_{AGENT}")).withColumn(
        "route", F.when(F.col("stop_reason") == "direct_route", "direct").otherwise("loop")
    )
    table = rows.groupBy("run_id", "route").agg(
        F.count(F.lit(1)).alias("n"),
        F.median(f"tokens_{AGENT}").alias("median_tokens"),
        F.sum(f"tokens_{AGENT}").alias("tokens"),
        F.avg(F.when(F.col("has_gold"), F.col(f"em_{AGENT}"))).alias("em"),
    )
    loops = table.where(F.col("route") == "loop").select("run_id", F.col("median_tokens").alias("_loop"))
    saved = F.greatest(F.lit(0.0), F.col("_loop") * F.col("n") - F.col("tokens"))
    return table.join(loops, "run_id", "left").select(
        "run_id", "route", "n", "median_tokens", "em",
        F.when(F.col("route") == "direct", saved).alias("estimated_saving"),
    )


def agent_usage(steps: DataFrame) -> DataFrame:
    """Calls, tokens and time per agent type of a run."""
    return steps.groupBy("run_id", "agent_type").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("tokens_total").alias("tokens"),
        (F.sum("tokens_total") / F.count(F.lit(1))).alias("tokens_per_call"),
        F.avg("latency_ms").alias("ms_per_call"),
    )


def tool_counts(steps: DataFrame) -> DataFrame:
    return steps.groupBy("run_id", "tool_called").agg(F.count(F.lit(1)).alias("n"))


def stop_reasons(scored: DataFrame) -> DataFrame:
    return (
        scored.where(F.col("pipeline") == AGENT)
        .groupBy("run_id", F.coalesce(F.nullif("stop_reason", F.lit("")), F.lit("none")).alias("stop_reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def agent_runs(scored: DataFrame, steps: DataFrame) -> DataFrame:
    """(run_id, questions, changed, flagged_steps, median_steps)."""
    counted = steps.groupBy("run_id", "qid").agg(
        F.count(F.lit(1)).alias("n_steps"), F.count_if("strategy_change").alias("flagged")
    )
    mine = scored.where(F.col("pipeline") == AGENT).select("run_id", "qid", "strategy_changed")
    return mine.join(counted, ["run_id", "qid"], "left").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(F.coalesce("strategy_changed", F.lit(False))).alias("changed"),
        F.sum(F.coalesce("flagged", F.lit(0))).alias("flagged_steps"),
        F.median(F.coalesce("n_steps", F.lit(0))).alias("median_steps"),
    )


def step_histogram(scored: DataFrame, steps: DataFrame) -> DataFrame:
    """Questions per number of trace steps."""
    counted = steps.groupBy("run_id", "qid").agg(F.count(F.lit(1)).alias("n_steps"))
    mine = scored.where(F.col("pipeline") == AGENT).select("run_id", "qid")
    return mine.join(counted, ["run_id", "qid"], "left").groupBy(
        "run_id", F.coalesce("n_steps", F.lit(0)).alias("steps")
    ).agg(F.count(F.lit(1)).alias("questions"))


def verification_summary(steps: DataFrame) -> DataFrame:
    """How answers fared against the graph, from the verification steps' notes."""
    notes = F.col("notes")
    return (
        steps.where(F.col("agent_type") == "answer_verification")
        .groupBy("run_id")
        .agg(
            F.count(F.lit(1)).alias("checked"),
            F.count_if(notes.contains(NOTE_TITLED)).alias("titled"),
            F.count_if(notes.contains(NOTE_FOUND) | notes.contains(NOTE_RESOLVED)).alias("supported"),
            F.count_if(notes.contains(NOTE_CONFLICT)).alias("conflicts"),
        )
    )


def trace_totals(steps: DataFrame) -> DataFrame:
    """Total tokens and flagged steps of every trace."""
    return steps.groupBy("run_id", "qid").agg(
        F.sum("tokens_total").alias("total_tokens"), F.count_if("strategy_change").alias("changes")
    )


# ---- dashboard --------------------------------------------------------------------


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def dashboard_headline(scored: DataFrame) -> DataFrame:
    """Means over scored questions, zero where there is nothing to average."""
    return scored.where(F.size("ground_truth") > 0).groupBy("run_id", "pipeline").agg(
        _zero(F.avg("em")).alias("em"), _zero(F.avg("f1")).alias("f1"),
        _zero(F.avg("completeness")).alias("completeness"),
        _zero(F.median(_if_answered(F.col("tokens_total")))).alias("median_tokens"),
    )


def dashboard_costs(scored: DataFrame) -> DataFrame:
    """Cost, latency and reliability over every question, scored or not."""
    return scored.groupBy("run_id", "pipeline").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~answered()).alias("errors"),
        _zero(F.median(_if_answered(F.col("tokens_total")))).alias("median_tokens"),
        _zero(F.avg(_if_answered(F.col("tokens_in")))).alias("mean_input"),
        _zero(F.avg(_if_answered(F.col("tokens_out")))).alias("mean_output"),
        _zero(F.avg(_if_answered(F.col("latency_ms")))).alias("mean_latency"),
        _zero(F.avg(_if_answered(F.col("citations_count")))).alias("mean_citations"),
        F.avg(_if_answered(F.col("grounded"))).alias("grounded"),
    )


def dashboard_by_type(sides: DataFrame) -> DataFrame:
    """EM gap and token multiplier per question type; failed answers stay in."""
    rows = sides.where(F.col("has_gold") & F.col("qtype").isin(*QTYPES))
    return rows.groupBy("run_id", "qtype").agg(
        F.count(F.lit(1)).alias("n"),
        (_zero(F.avg(f"em_{AGENT}")) - _zero(F.avg(f"em_{BASE}"))).alias("em_gap"),
        _zero(F.avg(_ratio(drop_errors=False))).alias("multiplier"),
    )


def scatter_questions(scored: DataFrame) -> DataFrame:
    """Accuracy-vs-cost points of one run's questions."""
    return scored.where(F.col("f1").isNotNull()).select(
        "run_id", "pipeline", F.col("tokens_total").alias("x"), F.col("f1").alias("y"),
        F.concat(F.col("qid"), F.lit(" ("), F.coalesce("qtype", F.lit("null")), F.lit(")")).alias("label"),
    )


def scatter_runs(summary: DataFrame) -> DataFrame:
    """Accuracy-vs-cost points of whole runs."""
    return summary.where(F.col("median_tokens").isNotNull() & F.col("f1").isNotNull()).select(
        "pipeline", F.col("median_tokens").alias("x"), F.col("f1").alias("y"), F.col("run_id").alias("label")
    )


def best_runs(summary: DataFrame) -> DataFrame:
    """Best run by F1 and by F1 per 1k tokens of the agent, and tokens of all runs."""
    mine = F.col("pipeline") == AGENT

    def best(metric: str) -> Column:
        order = F.when(mine & F.col(metric).isNotNull(), F.struct((-F.col(metric)).alias("m"), F.col("run_id")))
        return F.min_by("run_id", order)

    return summary.agg(
        best("f1").alias("best_f1_run"),
        F.max(F.when(mine, F.col("f1"))).alias("best_f1"),
        best("f1_per_1k_tokens").alias("best_efficiency_run"),
        F.max(F.when(mine, F.col("f1_per_1k_tokens"))).alias("best_efficiency"),
        F.sum("total_tokens").alias("total_tokens"),
    )


def compare_runs(summary: DataFrame, baseline: str) -> DataFrame:
    """Every metric of every run next to the baseline run's.

    Differences too small to show at the metric's display precision are none.
    """
    tall = None
    for metric, better, kind, places in COMPARED:
        part = summary.select(
            "run_id", "pipeline", F.lit(metric).alias("metric"), F.lit(better).alias("better"),
            F.lit(kind).alias("kind"), F.lit(places).alias("places"), F.col(metric).cast("double").alias("v"),
            F.round(F.col(metric).cast("double"), places).alias("shown"),
        )
        tall = part if tall is None else tall.unionByName(part)
    tall = tall.where(F.col("v").isNotNull())
    base = tall.where(F.col("run_id") == baseline).select(
        "pipeline", "metric", F.col("v").alias("base_v"), F.col("shown").alias("base_shown")
    )
    top = tall.groupBy("pipeline", "metric").agg(F.max("shown").alias("_hi"), F.min("shown").alias("_lo"))
    rows = tall.join(base, ["pipeline", "metric"], "left").join(top, ["pipeline", "metric"])
    high = F.col("better") == "high"
    diff = F.when(F.col("run_id") != baseline, F.when(F.col("shown") == F.col("base_shown"), 0.0).otherwise(
        F.col("v") - F.col("base_v")
    ))
    shown_delta = F.when(
        (F.col("kind") == "relative") & (F.col("base_v") != 0), F.col("delta") / F.col("base_v") * 100
    ).otherwise(F.col("delta"))
    return rows.withColumn("delta", diff).select(
        "run_id", "pipeline", "metric", F.col("v").alias("value"), "delta", shown_delta.alias("shown_delta"),
        F.when(F.coalesce(F.col("delta"), F.lit(0.0)) == 0, "flat")
        .when((F.col("delta") > 0) == high, "gain").otherwise("loss").alias("tone"),
        ((F.col("shown") == F.when(high, F.col("_hi")).otherwise(F.col("_lo"))) & (F.col("_hi") != F.col("_lo"))).alias(
            "best"
        ),
    )


# ---- results table ----------------------------------------------------------------


def disagreements(sides: DataFrame) -> DataFrame:
    """Questions whose pipelines gave different answers (in the table's own form)."""
    answers = F.array(*[tx.table_answer_form(F.col(f"answer_{p}")) for p in PIPELINES])
    return sides.where(F.size(F.array_distinct(answers)) > 1)


def results_table(
    sides: DataFrame, qtype: str = "all", only_disagreeing: bool = False, sort: str = "qid"
) -> DataFrame:
    """The per-question table, filtered and in one of four orders."""
    rows = sides if qtype == "all" else sides.where(F.col("qtype") == qtype)
    if only_disagreeing:
        rows = disagreements(rows)
    gap = F.coalesce(f"em_{AGENT}", F.lit(0.0)) - F.coalesce(f"em_{BASE}", F.lit(0.0))
    rows = rows.withColumn("gap", F.when(F.col("has_gold"), gap).otherwise(0.0))
    orders = {
        "qid": [F.col("qid")],
        "qtype": [F.coalesce("qtype", F.lit("")), F.col("qid")],
        "gap": [F.col("gap").desc(), F.col("qid")],
        "tokens": [F.col(f"tokens_{AGENT}").desc_nulls_last(), F.col("qid")],
    }
    return rows.orderBy(*orders[sort], "run_id")


def query_outcomes(answers: DataFrame) -> DataFrame:
    """done / error / partial and the tokens of every question."""
    failed = F.col("status") == "error"
    return answers.groupBy("run_id", "qid").agg(
        F.when(F.bool_and(F.col("status") == "done"), "done").when(F.bool_and(failed), "error").otherwise("partial").alias(
            "status"
        ),
        F.sum("tokens_total").alias("tokens"),
        F.listagg(
            F.when(failed, F.concat("pipeline", F.lit(": "), F.coalesce("error_detail", F.lit("")))), F.lit("; ")
        ).alias("error"),
    )


def running_total(rows: DataFrame, key: str, order: str, value: str, ranges: int = 256) -> DataFrame:
    """Adds ``total_before``: the sum of ``value`` over the key's earlier rows.

    A key may hold a large part of all rows, so each key's order is cut into
    ranges at approximate quantiles: sums per range, a short running sum over
    the ranges, and a window only inside one range. The cuts are approximate
    and depend on the order in which sketches meet, so they are made once and
    kept; the totals are exact. Values of ``order`` must differ within a key.
    """
    cuts = cut_lineage(
        rows.groupBy(key).agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("_cuts"))
    )
    ranged = rows.join(cuts, key).withColumn(
        "_range", F.size(F.filter("_cuts", lambda c: c < F.col(order)))
    ).drop("_cuts")
    over_ranges = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(key, "_range").agg(F.sum(value).alias("_sum")).select(
        key, "_range", F.coalesce(F.sum("_sum").over(over_ranges), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(key, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(starts, [key, "_range"])
        .withColumn("total_before", F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_range", "_start")
    )


def token_ceiling(questions: DataFrame, cap: int) -> DataFrame:
    """Adds ``started``: whether a question of a run starts before its tokens reach the cap.

    ``questions``: run_id, seq, tokens, already (tokens spent earlier).
    """
    spent = F.coalesce("already", F.lit(0)) + F.col("total_before")
    return (
        running_total(questions, "run_id", "seq", "tokens")
        .withColumn("spent_before", spent)
        .withColumn("started", spent < cap)
        .drop("total_before")
    )


def display_row(summary: DataFrame) -> DataFrame:
    """Headline numbers as the screens show them."""
    return summary.select(
        "run_id", "pipeline", fmt.pct(F.col("em")).alias("em"), fmt.dec(F.col("f1")).alias("f1"),
        fmt.num(F.col("median_tokens")).alias("median_tokens"), fmt.millis(F.col("mean_latency_ms")).alias("latency"),
    )
