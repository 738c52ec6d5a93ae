"""SQL fragments shared by the comparison statements (DuckDB dialect)."""

from __future__ import annotations

from graphloom.functions.text import NUMBER_WORDS, OVERLAP_STOPWORDS


def slug(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), '+', ' plus '), '[^a-z0-9]+', '-', 'g'), '-')"


SCOPES = """scopes AS (
  SELECT o.*, c_name, c_nationkey, c_mktsegment, n_name, n_nationkey, n_regionkey,
         o_orderpriority AS sport, year(o_orderdate)::VARCHAR || '-Summer' AS games, n_name AS venue
  FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

FIGURES = """figures AS (
  SELECT l_orderkey, sum(l_quantity)::INT AS competitors, count(DISTINCT s_nationkey)::INT AS nations
  FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey)"""

EVENTS = f"""{SCOPES}, {FIGURES}, ev AS (
  SELECT {slug('sport')} || '-' || games || '-' || o_orderkey AS event_id, 'Race of ' || c_name AS event_name,
         'D' || o_orderkey AS doc_id,
         sport || ' at the ' || year(o_orderdate) || ' Summer Olympics – ' || o_orderkey AS title,
         sport, games, venue, o_orderkey,
         strftime(o_orderdate, '%-d %B') AS date_text, year(o_orderdate)::INT AS date_year,
         month(o_orderdate)::INT AS date_month, day(o_orderdate)::INT AS date_day_start,
         CASE o_orderstatus WHEN 'P' THEN 0.8 WHEN 'F' THEN 0.9 ELSE 1.0 END::DOUBLE AS parse_confidence,
         competitors, nations, c_name, c_mktsegment
  FROM scopes LEFT JOIN figures ON o_orderkey = l_orderkey)"""

PARTS = """parts AS (
  SELECT 'P' || p_partkey AS event_id, p_brand AS sport_name, p_type AS event_name, p_size AS y, p_partkey AS line_no
  FROM part),
edition_index AS (
  SELECT sport_name, event_name, y, arg_max(event_id, line_no) AS target FROM parts GROUP BY ALL),
links AS (
  SELECT d.etype, p.event_id AS src, i.target AS dst
  FROM parts p CROSS JOIN (VALUES ('PREV_EDITION', -1), ('NEXT_EDITION', 1)) d(etype, step)
  LEFT JOIN edition_index i ON i.sport_name = p.sport_name AND i.event_name = p.event_name AND i.y = p.y + d.step)"""

CENTRES = """e AS (SELECT 'v' || vec_id AS chunk_id, label, embedding::DOUBLE[] AS emb FROM embeddings),
x AS (SELECT label, unnest(emb) AS v, generate_subscripts(emb, 1) AS i FROM e),
c AS (SELECT 'label' || label AS qid, label, list(m ORDER BY i) AS vector FROM (SELECT label, i, avg(v) AS m FROM x GROUP BY ALL) GROUP BY label)"""

_WORDS = "[" + ", ".join(f"'{w}'" for w in NUMBER_WORDS) + "]"
_PARTICLES = "Mac|Mc|Van|Di|De|Le|La"


def _canonical(t: str) -> str:
    return (
        f"coalesce((list_position({_WORDS}, {t}) - 1)::VARCHAR, "
        f"CASE WHEN regexp_full_match({t}, '[0-9]+') THEN regexp_replace({t}, '^0+([0-9])', '\\1') ELSE {t} END)"
    )


def plain(x: str) -> str:
    """Lower case, apostrophes gone, folded, articles gone, one space."""
    lowered = f"regexp_replace(lower({x}), '[''’ʼ`]', '', 'g')"
    folded = f"regexp_replace(strip_accents(nfc_normalize({lowered})), '\\p{{P}}', ' ', 'g')"
    # No look-around in this dialect: chr(3) after every non-word character
    # lets neighbouring articles each keep a boundary of their own.
    spaced = f"regexp_replace({folded}, '([^\\p{{L}}\\p{{N}}_])', '\\1' || chr(3), 'g')"
    cut = f"regexp_replace({spaced}, '(^|' || chr(3) || ')(a|an|the)($|[^\\p{{L}}\\p{{N}}_])', '\\1 \\3', 'g')"
    bare = f"replace({cut}, chr(3), '')"
    return f"regexp_replace({bare}, '\\s+', ' ', 'g')"


def words(x: str) -> str:
    return f"list_transform(list_filter(string_split({x}, ' '), lambda t: t <> ''), lambda t: {_canonical('t')})"


def normalize(x: str) -> str:
    return f"array_to_string({words(plain(x))}, ' ')"


def marked(x: str) -> str:
    """Name boundaries replaced by chr(1)."""
    listed = f"regexp_replace({x}, '\\s*(?:,|;|&|\\band\\b)\\s*', chr(1), 'g')"
    guarded = f"regexp_replace({listed}, '({_PARTICLES})(\\p{{Lu}})', '\\1' || chr(2) || '\\2', 'g')"
    split = f"regexp_replace({guarded}, '(\\p{{Ll}})(\\p{{Lu}})', '\\1' || chr(1) || '\\2', 'g')"
    return f"replace({split}, chr(2), '')"


def names(x: str) -> str:
    """Distinct normalised names, sorted."""
    parts = f"string_split({plain(marked(x))}, chr(1))"
    return (
        f"list_sort(list_distinct(list_filter(list_transform({parts}, "
        f"lambda n: array_to_string({words('n')}, ' ')), lambda n: n <> '')))"
    )


def tokens(x: str) -> str:
    parts = f"string_split({plain(marked(x))}, chr(1))"
    return f"flatten(list_transform({parts}, lambda n: {words('n')}))"


def word_set(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'))"


STOP = "[" + ", ".join(f"'{w}'" for w in OVERLAP_STOPWORDS) + "]"

ANSWERS = f"""{SCOPES}, base AS (
  SELECT s.*, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS seg, array_to_string(list_transform(string_split(r_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS reg,
         (o_custkey % 30)::VARCHAR AS number, o_orderkey AS k, o_custkey AS c
  FROM scopes s JOIN region ON n_regionkey = r_regionkey),
answers AS (
  SELECT replace(o_orderpriority, ' ', '_') AS run_id, 'q' || k AS qid,
         CASE WHEN c % 7 <> 0 THEN ['lookup','aggregation','superlative','temporal','multi_hop'][(c % 5 + 1)::INT] END AS qtype,
         o_orderstatus <> 'P' AS has_gold,
         CASE WHEN k % 4 = 0 THEN number ELSE seg || reg END AS gold,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS timestamp, k AS orderkey, pipeline,
         CASE pipeline WHEN 'rag' THEN reg || ' and ' || seg WHEN 'graphrag' THEN 'Café ' || reg || ', the ' || seg
              ELSE CASE WHEN k % 4 = 0 THEN '0' || number || ' events' ELSE seg || reg END END AS answer,
         CASE WHEN k % m = 0 THEN 'error' ELSE 'done' END AS status,
         (k % 5000 + 100) * scale AS tokens_in, c % 300 + 5 AS tokens_out,
         CASE WHEN k % m = 0 AND k % 2 = 0 THEN 0 ELSE (k % 5000 + 100) * scale + c % 300 + 5 END AS tokens_total,
         o_totalprice / 10 * scale AS latency_ms,
         CASE WHEN pipeline = 'agentic_graphrag' THEN
           CASE WHEN c % 2 = 0 THEN 'direct_route' WHEN c % 3 = 0 THEN 'step_budget_exhausted' ELSE 'sufficient_evidence' END
         END AS stop_reason,
         CASE WHEN k % m = 0 THEN 'timed out' END AS error_detail
  FROM base CROSS JOIN (VALUES ('rag', 17, 3), ('graphrag', 11, 1), ('agentic_graphrag', 13, 2)) p(pipeline, m, scale))"""

CITES = """cites AS (
  SELECT 'q' || l_orderkey AS qid, 'p' || l_partkey AS doc_id, p_name AS snippet, l_returnflag
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

SCORED = f"""{ANSWERS}, {CITES},
named AS (
  SELECT *, {names('answer')} AS mine, CASE WHEN has_gold THEN {names('gold')} END AS wanted,
         list_sort(list_distinct(list_filter(string_split({normalize('answer')}, ' '),
           lambda t: regexp_full_match(t, '[0-9]+')))) AS numbers,
         {tokens('answer')} AS atok, {tokens('gold')} AS gtok
  FROM answers),
lists AS (
  SELECT qid, count(*) AS n_cites, list_distinct(list(doc_id)) AS got,
         coalesce(list_distinct(list(doc_id) FILTER (l_returnflag <> 'N')), []) AS gold_docs,
         ' ' || {normalize("string_agg(snippet, ' ')")} || ' ' AS hay
  FROM cites GROUP BY qid),
scored AS (
  SELECT a.*, coalesce(n_cites, 0) AS citations_count,
         CASE WHEN has_gold THEN CASE WHEN len(mine) > 0 AND (mine = wanted OR (len(wanted) = 1
           AND regexp_full_match(wanted[1], '[0-9]+') AND numbers = wanted)) THEN 1.0 ELSE 0.0 END END::DOUBLE AS em,
         CASE WHEN has_gold THEN 2.0 * list_sum(list_transform(list_distinct(atok), lambda x:
           least(len(list_filter(atok, lambda y: y = x)), len(list_filter(gtok, lambda y: y = x)))))
           / (len(atok) + len(gtok)) END::DOUBLE AS f1,
         CASE WHEN has_gold THEN CASE WHEN len(got) > 0 AND len(gold_docs) > 0
           THEN len(list_intersect(got, gold_docs)) / len(got) ELSE 0 END END::DOUBLE AS precision,
         CASE WHEN has_gold THEN CASE WHEN len(got) > 0 AND len(gold_docs) > 0
           THEN len(list_intersect(got, gold_docs)) / len(gold_docs) ELSE 0 END END::DOUBLE AS recall,
         CASE WHEN len(mine) > 0 AND hay IS NOT NULL
           THEN len(list_filter(mine, lambda n: contains(hay, ' ' || n || ' '))) / len(mine) ELSE 0 END::DOUBLE AS grounded
  FROM named a LEFT JOIN lists USING (qid))"""

SIDES = f"""{SCORED}, sides AS (
  SELECT run_id, qid, any_value(qtype) AS qtype, bool_or(has_gold) AS has_gold,
         max(stop_reason) FILTER (pipeline = 'agentic_graphrag') AS stop_reason,
         max(em) FILTER (pipeline = 'rag') AS em_b, max(em) FILTER (pipeline = 'graphrag') AS em_g,
         max(em) FILTER (pipeline = 'agentic_graphrag') AS em_a,
         max(tokens_total) FILTER (pipeline = 'rag') AS t_b,
         max(tokens_total) FILTER (pipeline = 'graphrag') AS t_g,
         max(tokens_total) FILTER (pipeline = 'agentic_graphrag') AS t_a,
         bool_and(status <> 'error') FILTER (pipeline = 'rag') AS ok_b,
         bool_and(status <> 'error') FILTER (pipeline = 'graphrag') AS ok_g,
         bool_and(status <> 'error') FILTER (pipeline = 'agentic_graphrag') AS ok_a,
         max(answer) FILTER (pipeline = 'rag') AS a_b, max(answer) FILTER (pipeline = 'graphrag') AS a_g,
         max(answer) FILTER (pipeline = 'agentic_graphrag') AS a_a
  FROM scored GROUP BY run_id, qid)"""

STEPS = f"""{SCOPES}, steps AS (
  SELECT replace(o_orderpriority, ' ', '_') AS run_id, 'q' || l_orderkey AS qid, l_linenumber * 100000000000000 + l_partkey * 10000000 + l_suppkey AS seq,
         CASE l_returnflag WHEN 'A' THEN 'graph_traversal' WHEN 'N' THEN 'answer_verification'
              ELSE 'similarity_search' END AS agent_type,
         'Q' || l_linenumber AS tool_called,
         CASE WHEN o_custkey % 2 = 0 THEN 'lookup_direct' ELSE 'loop' END AS route,
         CASE WHEN l_linestatus = 'O' THEN CASE l_returnflag WHEN 'A' THEN 'lookup' WHEN 'N' THEN 'multi_hop'
              ELSE 'similarity_search' END END AS path_name,
         l_discount >= 0.09 AS declared,
         l_quantity::BIGINT AS tokens_in, l_partkey % 50 AS tokens_out,
         l_quantity::BIGINT + l_partkey % 50 AS tokens_total, l_extendedprice / 100 AS latency_ms,
         CASE l_suppkey % 3 WHEN 0 THEN 'answer found in the graph evidence'
              WHEN 1 THEN 'answer named the event; resolved to its page title ''x'''
              ELSE 'answer not found in the graph evidence; conflicting evidence: nations' END AS notes
  FROM lineitem JOIN scopes ON l_orderkey = o_orderkey)"""

BUILD = """build AS (
  SELECT user_id AS build_id, event_id AS seq, ts, event_type,
         CASE WHEN event_type = 'signup' THEN 'ready' ELSE ['parse_infoboxes','chunk_documents','embed_chunks',
           'schema_install','load_vertices','load_edges','load_chunks','install_graph_queries','vector_index'][k % 9 + 1] END AS stage,
         CASE WHEN event_type = 'signup' THEN ['graphrag'] WHEN k % 2 = 0 THEN ['rag','agentic_graphrag']
              ELSE ['rag','graphrag','agentic_graphrag'] END AS pipes,
         CASE event_type WHEN 'signup' THEN 'ready' WHEN 'purchase' THEN 'done' ELSE 'running' END AS status,
         k AS items_done, 100 AS items_total, value AS elapsed_ms
  FROM (SELECT *, (json_extract_string(props, '$.k'))::INT AS k FROM events))"""
