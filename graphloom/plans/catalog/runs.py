"""Scoring, run summaries, reports and run-file queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import records as fmt
from graphloom.operators import routing
from graphloom.operators import scoring as sc
from graphloom.plans import progress as pg
from graphloom.plans import reports as rp
from graphloom.plans.catalog import query
from graphloom.plans.catalog.sql import ANSWERS, BUILD, CITES, SCORED, SIDES, STEPS
from graphloom.plans.world import World
from graphloom.sources import runs as rf


def scored(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    return sc.score_answers(w.spread(sc.with_evidence(w.cited_questions())))


def sides(spark: SparkSession, sf: str) -> DataFrame:
    return rp.side_by_side(scored(spark, sf))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that summation order does not show."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _avg(expr: str) -> str:
    return f"round(avg({expr}), 6)"


@query(
    "ev5_score_answers",
    f"""WITH {SCORED} SELECT run_id, qid, pipeline, em, round(f1, 6) AS f1, round(precision, 6) AS precision,
    round(recall, 6) AS recall, round(grounded, 6) AS grounded FROM scored""",
)
def _score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scored(spark, sf).select("run_id", "qid", "pipeline", "em", "f1", "precision", "recall", "grounded"))


@query(
    "ev3_retrieval_table",
    f"""WITH {CITES}, d AS (SELECT qid, doc_id, max((l_returnflag <> 'A')::INT) AS r, max((l_returnflag <> 'N')::INT) AS g
       FROM cites GROUP BY ALL),
    s AS (SELECT qid, sum(r) AS nr, sum(g) AS ng, sum(r * g) AS h FROM d GROUP BY qid)
    SELECT qid, round(coalesce(h / nullif(nr, 0), 0), 6)::DOUBLE AS precision,
           round(coalesce(h / nullif(ng, 0), 0), 6)::DOUBLE AS recall,
           round(CASE WHEN nr > 0 AND ng > 0 THEN 2.0 * h / (nr + ng) ELSE 0 END, 6)::DOUBLE AS f1 FROM s""",
)
def _retrieval(spark: SparkSession, sf: str) -> DataFrame:
    cites = World(spark, sf).citations()
    return rounded(sc.retrieval_table(cites.where("l_returnflag <> 'A'"), cites.where("l_returnflag <> 'N'"), ["qid"]))


@query(
    "agg3_mean_scores",
    f"""WITH {SCORED} SELECT count(*) AS n, {_avg('em')} AS em, {_avg('f1')} AS f1, {_avg('precision')} AS precision,
    {_avg('recall')} AS recall, {_avg('recall')} AS completeness, {_avg('grounded')} AS grounded FROM scored WHERE has_gold""",
)
def _means(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sc.mean_scores(scored(spark, sf).where(F.col("em").isNotNull())))


@query(
    "agg4_mean_scores_by_type",
    f"""WITH {SCORED} SELECT coalesce(qtype, 'unknown') AS qtype, count(*) AS n, {_avg('em')} AS em, {_avg('f1')} AS f1,
    {_avg('precision')} AS precision, {_avg('recall')} AS recall, {_avg('recall')} AS completeness,
    {_avg('grounded')} AS grounded FROM scored WHERE has_gold GROUP BY 1""",
)
def _by_type(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sc.mean_scores_by_type(scored(spark, sf).where(F.col("em").isNotNull())))


_SUMMARY = f"""{SCORED}, summary AS (
  SELECT run_id, pipeline, count(*) AS n, avg(em) AS em, avg(f1) AS f1, avg(precision) AS precision, avg(recall) AS recall,
    avg(grounded) FILTER (status <> 'error') AS grounded,
    avg(tokens_total) FILTER (status <> 'error') AS mean_tokens,
    median(tokens_total) FILTER (status <> 'error') AS median_tokens,
    coalesce(sum(tokens_total) FILTER (status <> 'error'), 0)::BIGINT AS total_tokens,
    avg(tokens_in) FILTER (status <> 'error') AS mean_input_tokens,
    avg(tokens_out) FILTER (status <> 'error') AS mean_output_tokens,
    avg(latency_ms) FILTER (status <> 'error') AS mean_latency_ms,
    count(*) FILTER (status = 'error') AS errors,
    avg(f1) / (avg(tokens_total) FILTER (status <> 'error') / 1000) AS f1_per_1k_tokens
  FROM scored GROUP BY run_id, pipeline)"""


@query(
    "agg5_run_summary",
    f"""WITH {_SUMMARY} SELECT run_id, pipeline, n, round(em, 6) AS em, round(f1, 6) AS f1, round(precision, 6) AS precision,
    round(recall, 6) AS recall, round(recall, 6) AS completeness, round(grounded, 6) AS grounded,
    round(mean_tokens, 6) AS mean_tokens, median_tokens, total_tokens, round(mean_input_tokens, 6) AS mean_input_tokens,
    round(mean_output_tokens, 6) AS mean_output_tokens, round(mean_latency_ms, 4) AS mean_latency_ms, errors,
    round(f1_per_1k_tokens, 6) AS f1_per_1k_tokens FROM summary""",
)
def _summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rp.summarize_runs(scored(spark, sf))).withColumn("mean_latency_ms", F.round("mean_latency_ms", 4))


@query(
    "agg7_headline",
    f"""WITH {_SUMMARY} SELECT run_id, pipeline, round(em, 6) AS em, round(f1, 6) AS f1, round(recall, 6) AS completeness,
    round(grounded, 6) AS grounded, median_tokens, round(mean_input_tokens, 6) AS mean_input_tokens,
    round(mean_output_tokens, 6) AS mean_output_tokens, round(coalesce(mean_latency_ms, 0) / 1000, 6) AS mean_latency_s,
    errors FROM summary""",
)
def _headline(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rp.headline(scored(spark, sf)))


_LABEL = "CASE WHEN gap IS NULL THEN '—' WHEN gap >= 0.5 THEN 'Worth it' WHEN gap <= 0.05 THEN 'Overkill' ELSE 'Marginal' END"


@query(
    "agg8_gaps_by_type",
    f"""WITH {SIDES}, g AS (
      SELECT run_id, qtype, count(*) AS n, avg(em_b) AS rag_em, avg(em_g) AS graphrag_em, avg(em_a) AS agentic_em,
             avg(t_a / nullif(t_b, 0)) FILTER (ok_a AND ok_b) AS token_ratio, avg(em_a) - avg(em_b) AS gap
      FROM sides WHERE has_gold AND qtype IS NOT NULL GROUP BY ALL)
    SELECT run_id, qtype, n, round(rag_em, 6) AS rag_em, round(graphrag_em, 6) AS graphrag_em,
           round(agentic_em, 6) AS agentic_em, round(token_ratio, 6) AS token_ratio, round(gap, 6) AS gap,
           {_LABEL} AS verdict FROM g""",
)
def _gaps(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rp.gaps_by_type(sides(spark, sf)))


@query(
    "agg9_wins_and_losses",
    f"""WITH {SIDES} SELECT run_id, qid, CASE WHEN em_a > em_b THEN 'win' ELSE 'loss' END AS outcome
    FROM sides WHERE has_gold AND em_a <> em_b""",
)
def _wins(spark: SparkSession, sf: str) -> DataFrame:
    return rp.wins_and_losses(sides(spark, sf))


@query(
    "agg10_routing_split",
    f"""WITH {SIDES}, r AS (
      SELECT run_id, CASE WHEN stop_reason = 'direct_route' THEN 'direct' ELSE 'loop' END AS route, count(*) AS n,
             median(t_a) AS median_tokens, sum(t_a) AS tokens, avg(em_a) FILTER (has_gold) AS em
      FROM sides WHERE ok_a GROUP BY ALL)
    SELECT a.run_id, a.route, a.n, a.median_tokens, round(a.em, 6) AS em,
           CASE WHEN a.route = 'direct' THEN greatest(0, l.median_tokens * a.n - a.tokens) END::DOUBLE AS estimated_saving
    FROM r a LEFT JOIN r l ON l.run_id = a.run_id AND l.route = 'loop'""",
)
def _routing(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rp.routing_split(sides(spark, sf)))


@query(
    "agg11_agent_usage",
    f"""WITH {STEPS} SELECT run_id, agent_type, count(*) AS calls, sum(tokens_total)::BIGINT AS tokens,
    round(sum(tokens_total) / count(*), 6) AS tokens_per_call, round(avg(latency_ms), 4) AS ms_per_call FROM steps GROUP BY ALL""",
)
def _usage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rp.agent_usage(World(spark, sf).steps())).withColumn("ms_per_call", F.round("ms_per_call", 4))


@query("agg12_tool_counts", f"WITH {STEPS} SELECT run_id, tool_called, count(*) AS n FROM steps GROUP BY ALL")
def _tools(spark: SparkSession, sf: str) -> DataFrame:
    return rp.tool_counts(World(spark, sf).steps())


@query(
    "agg12_stop_reasons",
    f"""WITH {ANSWERS} SELECT run_id, coalesce(stop_reason, 'none') AS stop_reason, count(*) AS n FROM answers
    WHERE pipeline = 'agentic_graphrag' GROUP BY ALL""",
)
def _stops(spark: SparkSession, sf: str) -> DataFrame:
    return rp.stop_reasons(World(spark, sf).answers())


@query(
    "agg13_verification",
    f"""WITH {STEPS} SELECT run_id, count(*) AS checked,
      count(*) FILTER (contains(notes, 'resolved to its page title')) AS titled,
      count(*) FILTER (contains(notes, 'answer found in the graph evidence') OR contains(notes, 'resolved to')) AS supported,
      count(*) FILTER (contains(notes, 'conflicting evidence')) AS conflicts
    FROM steps WHERE agent_type = 'answer_verification' GROUP BY run_id""",
)
def _verified(spark: SparkSession, sf: str) -> DataFrame:
    return rp.verification_summary(World(spark, sf).steps())


@query(
    "agg14_dashboard_headline",
    f"""WITH {SCORED} SELECT run_id, pipeline, {_avg('em')} AS em, {_avg('f1')} AS f1, {_avg('recall')} AS completeness,
    coalesce(median(tokens_total) FILTER (status <> 'error'), 0) AS median_tokens
    FROM scored WHERE has_gold GROUP BY ALL""",
)
def _dash(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rp.dashboard_headline(scored(spark, sf)))


@query(
    "agg14_dashboard_costs",
    f"""WITH {SCORED} SELECT run_id, pipeline, count(*) AS n, count(*) FILTER (status = 'error') AS errors,
      median(tokens_total) FILTER (status <> 'error') AS median_tokens,
      round(avg(tokens_in) FILTER (status <> 'error'), 6) AS mean_input,
      round(avg(tokens_out) FILTER (status <> 'error'), 6) AS mean_output,
      round(avg(latency_ms) FILTER (status <> 'error'), 4) AS mean_latency,
      round(avg(citations_count) FILTER (status <> 'error'), 6) AS mean_citations,
      round(avg(grounded) FILTER (status <> 'error'), 6) AS grounded FROM scored GROUP BY ALL""",
)
def _costs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rp.dashboard_costs(scored(spark, sf))).withColumn("mean_latency", F.round("mean_latency", 4))


@query(
    "agg15_dashboard_by_type",
    f"""WITH {SIDES} SELECT run_id, qtype, count(*) AS n, round(avg(em_a) - avg(em_b), 6) AS em_gap,
    round(coalesce(avg(t_a / nullif(t_b, 0)), 0), 6) AS multiplier
    FROM sides WHERE has_gold AND qtype IS NOT NULL GROUP BY ALL""",
)
def _dash_type(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rp.dashboard_by_type(sides(spark, sf)))


@query(
    "agg16_step_histogram",
    f"""WITH {STEPS}, c AS (SELECT run_id, qid, count(*) AS n FROM steps GROUP BY ALL),
    q AS (SELECT replace(o_orderpriority, ' ', '_') AS run_id, 'q' || o_orderkey AS qid FROM scopes)
    SELECT q.run_id, coalesce(n, 0) AS steps, count(*) AS questions FROM q LEFT JOIN c USING (run_id, qid) GROUP BY ALL""",
)
def _histogram(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    return rp.step_histogram(w.answers(), w.steps())


_NUMBERED = f"""{STEPS}, marked AS (
  SELECT *, path_name IS NOT NULL AND CASE route WHEN 'lookup_direct' THEN path_name <> 'lookup'
    ELSE path_name NOT IN ('traversal','similarity_search','document_retrieval','multi_hop','aggregation','lookup') END AS off
  FROM steps),
numbered AS (
  SELECT run_id, qid, seq, row_number() OVER w AS step_n, sum(tokens_in) OVER w AS cum_in, sum(tokens_out) OVER w AS cum_out,
         (off AND count(*) FILTER (off) OVER w = 1) OR declared AS strategy_change, tokens_total
  FROM marked WINDOW w AS (PARTITION BY run_id, qid ORDER BY seq ROWS UNBOUNDED PRECEDING))"""


@query(
    "win3_numbered_steps",
    f"""WITH {_NUMBERED} SELECT run_id, qid, step_n::INT AS step_n, cum_in::BIGINT AS cum_tokens_in,
    cum_out::BIGINT AS cum_tokens_out, strategy_change FROM numbered""",
)
def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return routing.numbered_steps(World(spark, sf).steps(), ["run_id", "qid"], "seq").select(
        "run_id", "qid", "step_n", "cum_tokens_in", "cum_tokens_out", "strategy_change"
    )


@query(
    "agg29_trace_totals",
    f"""WITH {_NUMBERED} SELECT run_id, qid, sum(tokens_total)::BIGINT AS total_tokens,
    count(*) FILTER (strategy_change) AS changes FROM numbered GROUP BY ALL""",
)
def _traces(spark: SparkSession, sf: str) -> DataFrame:
    return rp.trace_totals(routing.numbered_steps(World(spark, sf).steps(), ["run_id", "qid"], "seq"))


@query(
    "ev16_strategy_changes",
    f"""WITH {_NUMBERED}, o AS (SELECT run_id, qid, bool_or(off OR declared) AS strategy_changed,
      arg_min(path_name, seq) FILTER (off) AS first_deviation FROM marked GROUP BY ALL) SELECT * FROM o""",
)
def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return routing.strategy_changes(World(spark, sf).steps(), ["run_id", "qid"], "seq")


@query(
    "agg16_agent_runs",
    f"""WITH {_NUMBERED}, t AS (SELECT run_id, qid, count(*) AS n, count(*) FILTER (strategy_change) AS f,
        bool_or(strategy_change) AS ch FROM numbered GROUP BY ALL),
    q AS (SELECT replace(o_orderpriority, ' ', '_') AS run_id, 'q' || o_orderkey AS qid FROM scopes)
    SELECT run_id, count(*) AS questions, count(*) FILTER (coalesce(ch, false)) AS changed,
      sum(coalesce(f, 0))::BIGINT AS flagged_steps, median(coalesce(n, 0)) AS median_steps
    FROM q LEFT JOIN t USING (run_id, qid) GROUP BY run_id""",
)
def _agent_runs(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    steps = routing.numbered_steps(w.steps(), ["run_id", "qid"], "seq")
    changed = steps.groupBy("run_id", "qid").agg(F.bool_or("strategy_change").alias("strategy_changed"))
    answers = w.answers().join(changed, ["run_id", "qid"], "left")
    return rp.agent_runs(answers, steps)


@query(
    "ev17_unreconciled",
    f"""WITH {STEPS}, s AS (SELECT run_id, qid, sum(tokens_in + tokens_out) AS step_tokens FROM steps GROUP BY ALL),
    t AS (SELECT replace(o_orderpriority, ' ', '_') AS run_id, 'q' || o_orderkey AS qid,
          o_orderkey % 3 + coalesce(q, 0) AS total_tokens
          FROM scopes LEFT JOIN (SELECT l_orderkey, sum(l_quantity::BIGINT + l_partkey % 50)::BIGINT AS q FROM lineitem GROUP BY 1)
          ON l_orderkey = o_orderkey)
    SELECT run_id, qid, total_tokens::BIGINT AS total_tokens, coalesce(step_tokens, 0)::BIGINT AS step_tokens
    FROM t LEFT JOIN s USING (run_id, qid) WHERE total_tokens <> coalesce(step_tokens, 0)""",
)
def _unreconciled(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    steps = w.steps()
    sums = steps.groupBy("run_id", "qid").agg(F.sum("tokens_total").alias("_t"))
    totals = (
        w.answers().where(F.col("pipeline") == sc.AGENT).select("run_id", "qid", "orderkey")
        .join(sums, ["run_id", "qid"], "left")
        .select("run_id", "qid", (F.col("orderkey") % 3 + F.coalesce("_t", F.lit(0))).alias("total_tokens"))
    )
    return routing.unreconciled(steps, totals, ["run_id", "qid"])


@query(
    "agg17_scatter_questions",
    f"""WITH {SCORED} SELECT run_id, pipeline, tokens_total AS x, round(f1, 6) AS y,
    qid || ' (' || coalesce(qtype, 'null') || ')' AS label FROM scored WHERE f1 IS NOT NULL""",
)
def _scatter(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rp.scatter_questions(scored(spark, sf)))


@query(
    "agg17_scatter_runs",
    f"WITH {_SUMMARY} SELECT pipeline, median_tokens AS x, round(f1, 6) AS y, run_id AS label FROM summary",
)
def _scatter_runs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rp.scatter_runs(rp.summarize_runs(scored(spark, sf))))


@query(
    "agg18_best_runs",
    f"""WITH {_SUMMARY}, a AS (SELECT * FROM summary WHERE pipeline = 'agentic_graphrag')
    SELECT (SELECT run_id FROM a ORDER BY f1 DESC, run_id LIMIT 1) AS best_f1_run, (SELECT round(max(f1), 6) FROM a) AS best_f1,
      (SELECT run_id FROM a ORDER BY f1_per_1k_tokens DESC, run_id LIMIT 1) AS best_efficiency_run,
      (SELECT round(max(f1_per_1k_tokens), 6) FROM a) AS best_efficiency,
      (SELECT sum(total_tokens)::BIGINT FROM summary) AS total_tokens""",
)
def _best(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rp.best_runs(rp.summarize_runs(scored(spark, sf))))


@query(
    "agg19_compare_runs",
    f"""WITH {_SUMMARY}, u AS (
      SELECT run_id, pipeline, m.metric, m.hi, m.rel, m.v::DOUBLE AS v, round(m.v::DOUBLE, m.p) AS shown FROM summary, LATERAL (VALUES
        ('em', true, false, em, 2), ('f1', true, false, f1, 2), ('precision', true, false, precision, 2),
        ('recall', true, false, recall, 2), ('median_tokens', false, true, median_tokens, 0),
        ('mean_latency_ms', false, true, mean_latency_ms, 0), ('f1_per_1k_tokens', true, false, f1_per_1k_tokens, 3),
        ('errors', false, false, errors, 0)) m(metric, hi, rel, v, p)),
    b AS (SELECT pipeline, metric, v AS bv, shown AS bs FROM u WHERE run_id = '1-URGENT'),
    t AS (SELECT pipeline, metric, max(shown) AS mx, min(shown) AS mn FROM u GROUP BY ALL),
    d AS (SELECT u.*, bv, mx, mn, CASE WHEN run_id <> '1-URGENT' THEN CASE WHEN shown = bs THEN 0 ELSE v - bv END END AS delta
          FROM u JOIN b USING (pipeline, metric) JOIN t USING (pipeline, metric))
    SELECT run_id, pipeline, metric, round(v, 3) AS value, round(delta, 3)::DOUBLE AS delta,
      round(CASE WHEN rel AND bv <> 0 THEN delta / bv * 100 ELSE delta END, 3)::DOUBLE AS shown_delta,
      CASE WHEN coalesce(delta, 0) = 0 THEN 'flat' WHEN (delta > 0) = hi THEN 'gain' ELSE 'loss' END AS tone,
      shown = CASE WHEN hi THEN mx ELSE mn END AND mx <> mn AS best FROM d""",
)
def _compare(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rp.compare_runs(rp.summarize_runs(scored(spark, sf)), "1-URGENT"), 3)


_VERDICT = f"""{SIDES}, v AS (
  SELECT *, CASE WHEN ok_a AND ok_b AND t_b > 0 THEN round_even(t_a / t_b, 2) END AS r,
    CASE WHEN ok_a AND ok_g AND t_g > 0 THEN round_even(t_a / t_g, 2) END AS rg,
    CASE WHEN has_gold THEN em_a - em_b END AS d, CASE WHEN has_gold THEN em_a - em_g END AS dg,
    CASE WHEN NOT ok_a THEN 'Agentic GraphRAG errored' WHEN NOT ok_b THEN 'RAG errored' ELSE 'RAG spent no tokens' END AS why
  FROM sides)"""


@query(
    "ev6_verdicts",
    f"""WITH {_VERDICT} SELECT run_id, qid, floor(r) AS m, floor(rg) AS mg, d, dg,
      CASE WHEN d IS NULL THEN 'na' WHEN d > 0 THEN 'gain' WHEN d < 0 THEN 'lost' ELSE 'none' END
        || CASE WHEN r IS NULL THEN ' ' || why ELSE '' END AS kind FROM v""",
)
def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    v = sc.verdicts(scored(spark, sf))
    line = F.col("summary_line")
    kind = (
        F.when(line.startswith("No ground truth"), "na").when(line.startswith("Agentic was"), "gain")
        .when(line.startswith("Agentic lost"), "lost").otherwise("none")
    )
    why = F.when(
        F.col("token_multiplier_vs_rag").isNull(),
        F.concat(F.lit(" "), F.regexp_extract(line, "(Agentic GraphRAG errored|RAG errored|RAG spent no tokens)", 1)),
    ).otherwise("")
    return v.select(
        "run_id", "qid", F.floor("token_multiplier_vs_rag").cast("double").alias("m"),
        F.floor("token_multiplier_vs_graphrag").cast("double").alias("mg"),
        F.col("accuracy_delta_vs_rag").try_cast("double").alias("d"),
        F.col("accuracy_delta_vs_graphrag").try_cast("double").alias("dg"), F.concat(kind, why).alias("kind"),
    )


@query(
    "ev7_merged_records",
    f"""WITH {ANSWERS} SELECT run_id, qid, count(*)::INT AS pipelines, max(answer) FILTER (pipeline = 'rag') AS rag_answer,
    sum(tokens_total)::BIGINT AS tokens FROM answers GROUP BY run_id, qid""",
)
def _merged(spark: SparkSession, sf: str) -> DataFrame:
    merged = sc.merged_records(World(spark, sf).answers())
    spent = F.aggregate(F.map_values("pipelines"), F.lit(0).cast("long"), lambda s, p: s + p["tokens_total"])
    return merged.select(
        "run_id", "qid", F.size("pipelines").alias("pipelines"), F.col("pipelines")["rag"]["answer"].alias("rag_answer"),
        spent.alias("tokens"),
    )


_TABLE_FORM = (
    "trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower({0}), '‘', ''''), '’', ''''), "
    "'\\b(a|an|the)\\b', ' ', 'g'), '[^A-Za-z0-9_\\s'']', ' ', 'g'), '\\s+', ' ', 'g'))"
)


@query(
    "set10_disagreements",
    f"""WITH {SIDES} SELECT run_id, qid FROM sides
    WHERE len(list_distinct([{_TABLE_FORM.format('a_b')}, {_TABLE_FORM.format('a_g')}, {_TABLE_FORM.format('a_a')}])) > 1""",
)
def _disagree(spark: SparkSession, sf: str) -> DataFrame:
    answers = World(spark, sf).answers().withColumns({"em": F.lit(0.0)})
    return rp.disagreements(rp.side_by_side(answers)).select("run_id", "qid")


@query(
    "flt11_results_table",
    f"""WITH {SIDES} SELECT run_id, qid, CASE WHEN has_gold THEN em_a - em_b ELSE 0 END AS gap, t_a AS tokens
    FROM sides WHERE qtype = 'multi_hop'""",
)
def _table(spark: SparkSession, sf: str) -> DataFrame:
    rows = rp.results_table(sides(spark, sf), qtype="multi_hop", sort="gap")
    return rows.select("run_id", "qid", "gap", F.col(f"tokens_{sc.AGENT}").alias("tokens"))


@query(
    "agg23_query_outcomes",
    f"""WITH {ANSWERS} SELECT run_id, qid, CASE WHEN bool_and(status = 'done') THEN 'done' WHEN bool_and(status = 'error') THEN 'error'
      ELSE 'partial' END AS status, sum(tokens_total)::BIGINT AS tokens, count(*) FILTER (status = 'error') AS failed
    FROM answers GROUP BY run_id, qid""",
)
def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    out = rp.query_outcomes(World(spark, sf).answers())
    return out.select(
        "run_id", "qid", "status", "tokens",
        F.size(F.filter(F.split(F.coalesce("error", F.lit("")), "; "), lambda e: e != "")).cast("long").alias("failed"),
    )


@query(
    "win6_token_ceiling",
    f"""WITH {ANSWERS}, q AS (SELECT run_id, orderkey, sum(tokens_total) AS t FROM answers GROUP BY ALL),
    s AS (SELECT run_id, orderkey, coalesce(sum(t) OVER (PARTITION BY run_id ORDER BY orderkey ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING), 0) AS before FROM q)
    SELECT run_id, orderkey, before::BIGINT AS spent_before, before < 10000000 AS started FROM s""",
)
def _ceiling(spark: SparkSession, sf: str) -> DataFrame:
    tokens = World(spark, sf).answers().groupBy("run_id", F.col("orderkey").alias("seq")).agg(
        F.sum("tokens_total").alias("tokens")
    ).withColumn("already", F.lit(0))
    return rp.token_ceiling(tokens, 10_000_000).select("run_id", F.col("seq").alias("orderkey"), "spent_before", "started")


@query(
    "flt8_answered_only",
    f"WITH {ANSWERS} SELECT pipeline, count(*) AS answered FROM answers WHERE status <> 'error' GROUP BY pipeline",
)
def _answered(spark: SparkSession, sf: str) -> DataFrame:
    return World(spark, sf).answers().where(rp.answered()).groupBy("pipeline").agg(F.count(F.lit(1)).alias("answered"))


@query(
    "ev22_error_records",
    f"""WITH {ANSWERS} SELECT qid, pipeline, CASE WHEN status = 'error' OR orderkey % 19 = 0 THEN '' ELSE answer END AS answer,
      CASE WHEN orderkey % 19 = 0 THEN 'error' ELSE status END AS status,
      CASE WHEN orderkey % 19 = 0 THEN 0 ELSE tokens_total END AS tokens_total,
      CASE WHEN orderkey % 19 = 0 THEN 'no answer was produced' ELSE error_detail END AS error_detail FROM answers""",
)
def _errors(spark: SparkSession, sf: str) -> DataFrame:
    answers = World(spark, sf).answers()
    expected = answers.select("qid", "pipeline")
    return sc.error_records(expected, answers.where(F.col("orderkey") % 19 != 0)).drop("explanation")


# ---- run files -----------------------------------------------------------------


LINES_PER_PART = 20_000


def run_lines(w: World) -> DataFrame:
    """Run files as lines: a header per run, then every question, some of them twice.

    Orders below a certain price were answered before (with an error in every
    third case) and are superseded by a later line.
    """
    # A line is some twenty times as long as its order's row, so that the parts of the table are too large for a task.
    parts = w.table("orders").count() // LINES_PER_PART + 1

    def record(p: Column) -> Column:
        tokens = F.struct(p["tokens_in"].alias("input"), p["tokens_out"].alias("output"), p["tokens_total"].alias("total"))
        return F.struct(
            p["pipeline"].alias("pipeline"), p["answer"].alias("answer"), tokens.alias("tokens"), p["latency_ms"].alias("latency_ms"),
            p["stop_reason"].alias("stop_reason"), p["status"].alias("status"), p["error_detail"].alias("error_detail"),
        )

    asked = w.asked()
    questions = asked.repartition(parts, "orderkey").withColumn(
        "pipelines", F.map_from_entries(F.transform("pipelines", lambda p: F.struct(p["pipeline"], record(p))))
    )

    def line(tries: int, status: Column) -> Column:
        pipes = F.transform_values("pipelines", lambda k, p: p.withField("status", F.coalesce(status, p["status"])))
        body = F.struct(
            "run_id", F.col("qid").alias("question_id"), F.col("qid").alias("question_text"), "qtype", "ground_truth",
            F.struct(F.col("qid").alias("query_id"), "timestamp", pipes.alias("pipelines")).alias("record"),
        )
        return F.struct((F.col("orderkey") + tries * 10_000_000_000).alias("line_no"), F.to_json(body).alias("value"))

    none = F.lit(None).cast("string")
    records = questions.select(
        "run_id",
        F.explode(
            F.when(
                F.col("orderkey") % 5 == 0,
                F.array(line(1, F.when(F.col("orderkey") % 3 == 0, "error")), line(2, none)),
            ).otherwise(F.array(line(1, none)))
        ).alias("l"),
    ).select("run_id", "l.*")
    headers = asked.select("run_id").distinct().select(
        "run_id", F.lit(0).cast("long").alias("line_no"),
        F.format_string('{"run_config": {"llm_model": "m", "dataset": "orders", "started_at": "2024-01-01T00:00:00"}}').alias(
            "value"
        ),
    )
    torn = headers.select("run_id", F.lit(2**62).alias("line_no"), F.lit('{"run_id": "unfinis').alias("value"))
    return headers.unionByName(records).unionByName(torn).select(
        "run_id", F.col("run_id").alias("file"), F.lit("2024-01-02 00:00:00").cast("timestamp").alias("file_time"), "line_no", "value"
    )


@query(
    "src5_read_run",
    f"""WITH {ANSWERS} SELECT run_id, qid, pipeline, answer, status, tokens_total FROM answers""",
)
def _read_run(spark: SparkSession, sf: str) -> DataFrame:
    records = rf.read_records(run_lines(World(spark, sf)))
    return rf.run_answers(records).select("run_id", "qid", "pipeline", "answer", "status", "tokens_total")


@query(
    "agg6_list_runs",
    f"""WITH {ANSWERS} SELECT run_id, 'orders' AS dataset, '2024-01-01T00:00:00' AS started_at,
    count(DISTINCT qid) AS n_questions, bool_or(has_gold) AS scored FROM answers GROUP BY run_id""",
)
def _list_runs(spark: SparkSession, sf: str) -> DataFrame:
    lines = run_lines(World(spark, sf))
    return rp.list_runs(rf.run_answers(rf.read_records(lines)), rf.run_headers(lines))


@query(
    "agg21_tokens_spent",
    f"""WITH {ANSWERS} SELECT run_id, sum(tokens_total * CASE WHEN orderkey % 5 = 0 THEN 2 ELSE 1 END)::BIGINT AS tokens
    FROM answers GROUP BY run_id""",
)
def _spent(spark: SparkSession, sf: str) -> DataFrame:
    lines = run_lines(World(spark, sf)).withColumn("r", F.from_json("value", rf.RECORD))
    return rf.tokens_spent(lines.where(F.col("r.question_id").isNotNull()).select("r.*"))


@query(
    "jn16_pending_questions",
    f"""WITH {ANSWERS} SELECT DISTINCT qid FROM answers a WHERE EXISTS (
      SELECT 1 FROM answers b WHERE b.qid = a.qid AND b.status = 'error')""",
)
def _pending(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    written = rf.written_questions(rf.read_records(run_lines(w)))
    return rf.pending_questions(w.answers().select("qid").distinct(), written)


@query(
    "win2_latest_status",
    f"""WITH {ANSWERS} SELECT run_id, count(*) AS written FROM (
      SELECT run_id, qid FROM answers GROUP BY ALL HAVING bool_and(status <> 'error')) GROUP BY run_id""",
)
def _latest(spark: SparkSession, sf: str) -> DataFrame:
    written = rf.written_questions(rf.read_records(run_lines(World(spark, sf))))
    return written.groupBy("run_id").agg(F.count(F.lit(1)).alias("written"))


@query(
    "snk8_submission",
    f"""WITH {ANSWERS} SELECT run_id, qid, max(stop_reason) AS stop_reason, max(answer) FILTER (pipeline = 'graphrag') AS graphrag_answer
    FROM answers GROUP BY ALL""",
)
def _submission(spark: SparkSession, sf: str) -> DataFrame:
    out = rf.submission(rf.read_records(run_lines(World(spark, sf))))
    return out.select(
        "run_id", "qid", F.col("pipelines")["agentic_graphrag"]["stop_reason"].alias("stop_reason"),
        F.col("pipelines")["graphrag"]["answer"].alias("graphrag_answer"),
    )


@query(
    "snk9_import_runs",
    f"""WITH {ANSWERS}, q AS (SELECT DISTINCT run_id, qid, qtype, orderkey FROM answers)
    SELECT CASE orderkey % 3 WHEN 0 THEN 'object' WHEN 1 THEN 'lines' ELSE 'submission' END || '-' || orderkey AS upload,
      qid AS question_id, qtype, 3 AS pipelines, orderkey % 3 = 2 AS unscored FROM q""",
)
def _import(spark: SparkSession, sf: str) -> DataFrame:
    lines = run_lines(World(spark, sf))
    records = rf.latest_records(
        lines.withColumn("question_id", F.get_json_object("value", "$.question_id")).where(F.col("question_id").isNotNull())
    )
    k = F.substring("question_id", 2, 20).cast("long")
    pipes = F.get_json_object("value", "$.record.pipelines")
    submission = F.concat(
        F.lit('{"run_id": "s", "run_config": {"started_at": "t"}, "questions": [{"qid": "'), "question_id",
        F.lit('", "question": "?", "qtype": '), F.coalesce(F.concat(F.lit('"'), F.get_json_object("value", "$.qtype"), F.lit('"')), F.lit("null")),
        F.lit(', "pipelines": '), pipes, F.lit("}]}"),
    )
    shape = F.when(k % 3 == 0, F.concat(F.lit('{"run_id": "o", "records": ['), "value", F.lit("]}"))).when(
        k % 3 == 1, F.concat(F.lit('{"run_config": {"seed": 1}}\n'), "value", F.lit("\n\n"), F.lit("{}"))
    ).otherwise(submission)
    name = F.when(k % 3 == 0, "object").when(k % 3 == 1, "lines").otherwise("submission")
    files = records.select(F.concat_ws("-", name, k.cast("string")).alias("upload"), shape.alias("value"))
    out = rf.imported_records(rf.parse_uploads(files))
    return out.where(F.col("question_id").isNotNull()).select(
        "upload", "question_id", "qtype", F.size("record.pipelines").alias("pipelines"),
        (F.col("upload").startswith("submission") & (F.size("ground_truth") == 0)).alias("unscored"),
    )


@query(
    "flt10_search_runs",
    """SELECT o_orderpriority AS run_id, count(*) AS n FROM orders WHERE contains(lower(o_orderpriority), 'e') GROUP BY 1""",
)
def _search(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    runs = World(spark, sf).table("orders").groupBy(F.col("o_orderpriority").alias("run_id")).agg(F.count(F.lit(1)).alias("n"))
    full = runs.select("run_id", "n", *[none.alias(c) for c in ("dataset", "llm_model", "embedding_model", "llm_provider")])
    return rp.search_runs(full, " E ").select("run_id", "n")


@query(
    "agg20_display_row",
    f"""WITH {_SUMMARY} SELECT run_id, pipeline, errors FROM summary""",
)
def _display(spark: SparkSession, sf: str) -> DataFrame:
    summary = rp.summarize_runs(scored(spark, sf))
    return rp.display_row(summary).join(summary.select("run_id", "pipeline", "errors"), ["run_id", "pipeline"]).where(
        F.col("em").endswith("%") & F.col("latency").rlike("(ms|s)$")
    ).select("run_id", "pipeline", "errors")


@query(
    "fn24_display_formats",
    """SELECT l_orderkey AS k, l_linenumber AS n, format('{:,}', floor(l_extendedprice)::BIGINT) AS num,
      CASE WHEN l_quantity > 0 THEN '+' ELSE '' END || printf('%.2f', l_quantity) AS signed,
      printf('%.0f', l_discount * 100) || '%' AS pct FROM lineitem""",
)
def _formats(spark: SparkSession, sf: str) -> DataFrame:
    return World(spark, sf).table("lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"),
        fmt.num(F.floor("l_extendedprice")).alias("num"), fmt.signed(F.col("l_quantity")).alias("signed"),
        fmt.pct(F.col("l_discount")).alias("pct"),
    )


# ---- build progress ---------------------------------------------------------------


@query(
    "win9_latest_stages",
    f"""WITH {BUILD} SELECT build_id, stage, min(seq) AS first_seq, arg_max(status, seq) AS status,
    arg_max(items_done, seq) AS items_done FROM build GROUP BY build_id, stage""",
)
def _stages(spark: SparkSession, sf: str) -> DataFrame:
    return pg.latest_stages(World(spark, sf).build_events()).select("build_id", "stage", "first_seq", "status", "items_done")


_PIPED = f"{BUILD}, piped AS (SELECT *, unnest(pipes) AS pipeline FROM build)"


@query(
    "str9_pipeline_states",
    f"""WITH {_PIPED} SELECT build_id, pipeline,
      CASE WHEN bool_or(status = 'ready') THEN 'ready' ELSE arg_max(status, seq) END AS status,
      CASE WHEN bool_or(status = 'ready') THEN 'ready' ELSE arg_max(stage, seq) END AS stage,
      arg_max(elapsed_ms, seq) AS elapsed_ms,
      coalesce(max(items_done) FILTER (stage = 'parse_infoboxes'), 0) AS documents,
      coalesce(max(items_done) FILTER (stage = 'embed_chunks'), 0) AS vectors FROM piped GROUP BY ALL""",
)
def _states(spark: SparkSession, sf: str) -> DataFrame:
    return pg.pipeline_states(World(spark, sf).build_events()).select(
        "build_id", "pipeline", "status", "stage", "elapsed_ms", "documents", "vectors"
    )


def _plan_values() -> str:
    return ", ".join(
        f"('{p}', '{s}', {pg.STAGE_WEIGHTS[s]})" for p, stages in pg.PIPELINE_STAGES.items() for s in stages
    )


@query(
    "agg26_percent_complete",
    f"""WITH {_PIPED}, latest AS (
      SELECT build_id, pipeline, stage, arg_max(status, seq) AS status, arg_max(items_done, seq) AS d FROM piped GROUP BY ALL),
    ready AS (SELECT build_id, pipeline, bool_or(status = 'ready') AS ready FROM piped GROUP BY ALL),
    w AS (SELECT build_id, pipeline, ready, s.weight, l.status,
      CASE WHEN l.status = 'done' THEN 1.0::DOUBLE WHEN l.status IS NULL THEN 0 ELSE least(1.0::DOUBLE, d::DOUBLE / 100) END AS f
      FROM ready JOIN (VALUES {_plan_values()}) s(pipeline, stage, weight) USING (pipeline)
      LEFT JOIN latest l USING (build_id, pipeline, stage) WHERE stage <> 'remove_previous' OR l.status IS NOT NULL)
    SELECT build_id, pipeline, CASE WHEN ready THEN 100 ELSE least(99, floor(round(sum(weight * f) / sum(weight) * 100, 6))) END::INT AS percent
    FROM w GROUP BY build_id, pipeline, ready""",
)
def _percent(spark: SparkSession, sf: str) -> DataFrame:
    return pg.percent_complete(World(spark, sf).build_events())


@query(
    "agg28_ready_times",
    f"""WITH {_PIPED} SELECT build_id, pipeline,
      coalesce(arg_min(elapsed_ms, seq) FILTER (status = 'ready'), arg_max(elapsed_ms, seq)) AS ms,
      bool_or(status = 'ready') AS is_ready FROM piped GROUP BY ALL""",
)
def _ready(spark: SparkSession, sf: str) -> DataFrame:
    return pg.ready_times(World(spark, sf).build_events())


@query(
    "win8_elapsed",
    f"""WITH {BUILD} SELECT build_id, seq, round((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY build_id))) / 1000.0, 3)
      AS elapsed_ms FROM build""",
)
def _elapsed(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pg.elapsed(World(spark, sf).build_events().drop("elapsed_ms")).select("build_id", "seq", "elapsed_ms"), 3)


@query(
    "agg27_loaded_totals",
    """WITH d AS (SELECT source AS dataset, count(*) AS documents, CASE WHEN source > 'src5' THEN sum(n_chars)::BIGINT END AS chunks,
        CASE WHEN lang_n > 3 THEN count(*) END AS vectors, max(doc_id)::VARCHAR AS built_at
      FROM documents JOIN (SELECT source AS s, count(DISTINCT lang) AS lang_n FROM documents GROUP BY 1) ON s = source GROUP BY source, lang_n)
    SELECT sum(documents)::BIGINT AS documents, coalesce(sum(chunks), 0)::BIGINT AS chunks,
      sum(coalesce(vectors, chunks, 0))::BIGINT AS vectors, sum(documents + 7)::BIGINT AS entities, 0::BIGINT AS relationships,
      (SELECT dataset FROM d ORDER BY built_at DESC, dataset DESC LIMIT 1) AS latest FROM d""",
)
def _totals(spark: SparkSession, sf: str) -> DataFrame:
    d = World(spark, sf).table("documents").groupBy(F.col("source").alias("dataset")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("_c"), F.countDistinct("lang").alias("_l"),
        F.max("doc_id").cast("string").alias("built_at"),
    ).select(
        "dataset", "documents", "built_at", F.when(F.col("dataset") > "src5", F.col("_c")).alias("chunks"),
        F.when(F.col("_l") > 3, F.col("documents")).alias("vectors"), F.lit(None).cast("long").alias("entities"),
        F.lit(7).cast("long").alias("events"), F.lit(None).cast("long").alias("relationships"),
    )
    return pg.loaded_totals(d)
