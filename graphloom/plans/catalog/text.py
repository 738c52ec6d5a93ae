"""Text, record and vector-free scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import dates, records as rec, text as tx
from graphloom.operators import documents as docs
from graphloom.operators import evidence as ev
from graphloom.operators import routing
from graphloom.operators import scoring as sc
from graphloom.operators.linking import ground_intents
from graphloom.plans.catalog import query
from graphloom.plans.catalog import sql as q
from graphloom.plans.world import World


@query("fn3_normalize_answer", f"SELECT doc_id, md5({q.normalize('text')}) AS digest FROM documents")
def _normalize(spark: SparkSession, sf: str) -> DataFrame:
    return World(spark, sf).table("documents").select("doc_id", F.md5(tx.normalize_answer(F.col("text"))).alias("digest"))


@query(
    "fn1_fold",
    "SELECT doc_id, md5(regexp_replace(strip_accents(nfc_normalize(text)), '\\p{P}', ' ', 'g')) AS digest FROM documents",
)
def _fold(spark: SparkSession, sf: str) -> DataFrame:
    return World(spark, sf).table("documents").select("doc_id", F.md5(tx.fold(F.col("text"))).alias("digest"))


@query(
    "udf3_fold",
    "SELECT conv_id, turn, md5(regexp_replace(strip_accents(nfc_normalize(text)), '\\p{P}', ' ', 'g')) AS digest FROM conversations",
)
def _fold_turns(spark: SparkSession, sf: str) -> DataFrame:
    return World(spark, sf).table("conversations").select("conv_id", "turn", F.md5(tx.fold(F.col("text"))).alias("digest"))


@query(
    "fn5_split_names",
    f"""SELECT doc_id, len(x)::INT AS n, md5(array_to_string(x, '|')) AS digest FROM (
      SELECT doc_id, list_filter(list_transform(string_split({q.marked('text')}, chr(1)),
        lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS x FROM documents)""",
)
def _names(spark: SparkSession, sf: str) -> DataFrame:
    names = tx.split_names(F.col("text"))
    return World(spark, sf).table("documents").select(
        "doc_id", F.size(names).alias("n"), F.md5(F.array_join(names, "|")).alias("digest")
    )


@query(
    "fn6_answer_tokens",
    f"""SELECT doc_id, len(t)::INT AS tokens, len({q.names('text')})::INT AS names FROM (
      SELECT doc_id, text, {q.tokens('text')} AS t FROM documents)""",
)
def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    parts = tx.answer_parts(F.col("text"))
    return World(spark, sf).table("documents").select("doc_id", parts.alias("p")).select(
        "doc_id", F.size(F.flatten("p")).alias("tokens"), F.size(tx.names_of(F.col("p"))).alias("names")
    )


@query(
    "fn7_numbers",
    f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split({q.normalize('text')}, ' '),
      lambda t: regexp_full_match(t, '[0-9]+')))), ' ') AS numbers FROM documents""",
)
def _numbers(spark: SparkSession, sf: str) -> DataFrame:
    found = tx.numbers_of(tx.answer_parts(F.col("text")))
    return World(spark, sf).table("documents").select("doc_id", F.array_join(F.array_sort(found), " ").alias("numbers"))


@query(
    "ev2_token_f1_texts",
    f"""WITH p AS (SELECT a.conv_id, a.turn, {q.tokens('a.text')} AS mine, {q.tokens('b.text')} AS gold
      FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
    t AS (SELECT conv_id, turn, unnest(mine) AS w, 1 AS m, 0 AS g FROM p UNION ALL
          SELECT conv_id, turn, unnest(gold), 0, 1 FROM p),
    c AS (SELECT conv_id, turn, w, sum(m) AS m, sum(g) AS g FROM t GROUP BY ALL),
    s AS (SELECT conv_id, turn, sum(least(m, g)) AS shared, sum(m + g) AS total FROM c GROUP BY ALL)
    SELECT conv_id, turn, round(CASE WHEN total IS NULL THEN 1 ELSE 2.0 * shared / total END, 6)::DOUBLE AS f1
    FROM p LEFT JOIN s USING (conv_id, turn)""",
)
def _f1(spark: SparkSession, sf: str) -> DataFrame:
    turns = World(spark, sf).table("conversations")
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.array("text").alias("variants"))
    pairs = turns.select("conv_id", "turn", F.col("text").alias("answer")).join(nxt, ["conv_id", "turn"])
    return sc.token_f1_table(pairs, ["conv_id", "turn"]).select("conv_id", "turn", F.round("f1", 6).alias("f1"))


@query(
    "etl9_normalize_date",
    """SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p,
      CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE year(l_shipdate) END::INT AS date_year, month(l_shipdate)::INT AS date_month,
      day(l_shipdate)::INT AS date_day_start, CASE WHEN l_linenumber % 4 = 2 THEN day(l_shipdate) + 1 END::INT AS date_day_end
    FROM lineitem""",
)
def _date(spark: SparkSession, sf: str) -> DataFrame:
    d, n = F.col("l_shipdate"), F.col("l_linenumber")
    span = F.concat(F.dayofmonth(d).cast("string"), F.lit("–"), (F.dayofmonth(d) + 1).cast("string"), F.date_format(d, " MMMM yyyy"))
    raw = (
        F.when(n % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(n % 4 == 1, F.date_format(d, "MMMM d, yyyy"))
        .when(n % 4 == 2, span).otherwise(F.date_format(d, "d MMM"))
    )
    return World(spark, sf).table("lineitem").select(
        F.col("l_orderkey").alias("k"), n.alias("n"), F.col("l_partkey").alias("p"), dates.normalize_date(raw).alias("d")
    ).select("k", "n", "p", "d.*")


@query(
    "etl4_games",
    """SELECT o_orderkey AS k, year(o_orderdate) || '-Winter' AS games, year(o_orderdate)::INT AS year, 'Winter' AS season FROM orders""",
)
def _games(spark: SparkSession, sf: str) -> DataFrame:
    games = dates.games_id(F.concat(F.lit("the "), F.year("o_orderdate").cast("string"), F.lit("  WINTER Olympics")))
    return World(spark, sf).table("orders").select(F.col("o_orderkey").alias("k"), games.alias("games")).select(
        "k", "games", dates.games_year(F.col("games")).alias("year"), dates.games_season(F.col("games")).alias("season")
    )


@query(
    "etl6_leading_int",
    """SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, floor(l_extendedprice)::INT AS value, l_linenumber % 2 = 0 AS exact FROM lineitem""",
)
def _leading(spark: SparkSession, sf: str) -> DataFrame:
    figure = F.format_number(F.floor("l_extendedprice"), 0)
    raw = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" "), figure)).otherwise(F.concat(figure, F.lit(" teams")))
    return World(spark, sf).table("lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), docs.leading_int(raw).alias("x")
    ).select("k", "n", "p", "x.value", "x.exact")


@query(
    "etl3_sport_and_event_part",
    """SELECT o_orderkey AS k, o_orderpriority AS sport, 'Race ' || o_orderkey AS event FROM orders""",
)
def _sport(spark: SparkSession, sf: str) -> DataFrame:
    title = F.concat(F.col("o_orderpriority"), F.lit(" AT  the 1999 Summer Olympics - Race "), F.col("o_orderkey").cast("string"))
    return World(spark, sf).table("orders").select(
        F.col("o_orderkey").alias("k"), docs.sport_of(title).alias("sport"), tx.event_part(title).alias("event")
    )


@query("etl5_slug", f"SELECT doc_id, md5({q.slug('text')}) AS slug FROM documents")
def _slug(spark: SparkSession, sf: str) -> DataFrame:
    return World(spark, sf).table("documents").select("doc_id", F.md5(tx.slug(F.col("text"))).alias("slug"))


@query(
    "fn18_date_words",
    "SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}_]+', ' ', 'g'))) AS digest FROM documents",
)
def _date_words(spark: SparkSession, sf: str) -> DataFrame:
    return World(spark, sf).table("documents").select("doc_id", F.md5(tx.date_words(F.col("text"))).alias("digest"))


@query(
    "fn19_public_host",
    """SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) || ':8080' AS host FROM pages""",
)
def _host(spark: SparkSession, sf: str) -> DataFrame:
    secret = F.regexp_replace("url", "^([a-z]+)://([^/:?#]+)", "$1://user:pw@$2:8080")
    return World(spark, sf).table("pages").select("page_id", rec.public_host(secret).alias("host"))


@query(
    "fn20_estimated_tokens",
    "SELECT conv_id, turn, greatest(1, length(text) // 4)::INT AS tokens FROM conversations",
)
def _estimated(spark: SparkSession, sf: str) -> DataFrame:
    return World(spark, sf).table("conversations").select("conv_id", "turn", rec.estimated_tokens(F.col("text")).alias("tokens"))


@query(
    "fn21_reported_usage",
    """SELECT event_id, CASE user_id % 3 WHEN 0 THEN k WHEN 1 THEN k END::BIGINT AS input,
      CASE user_id % 3 WHEN 0 THEN 2 * k WHEN 1 THEN 3 * k END::BIGINT AS output,
      CASE user_id % 3 WHEN 0 THEN 3 * k WHEN 1 THEN 7 END::BIGINT AS total
    FROM (SELECT *, (json_extract_string(props, '$.k'))::INT AS k FROM events)""",
)
def _usage(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    a = F.format_string('{"usage_metadata": {"input_tokens": %d, "output_tokens": %d}}', k, k * 2)
    b = F.format_string(
        '{"response_metadata": {"token_usage": {"prompt_tokens": %d, "completion_tokens": %d, "total_tokens": 7}}}', k, k * 3
    )
    payload = F.when(F.col("user_id") % 3 == 0, a).when(F.col("user_id") % 3 == 1, b).otherwise("{}")
    return World(spark, sf).table("events").select("event_id", rec.reported_usage(payload).alias("u")).select("event_id", "u.*")


@query(
    "fn15_parse_reply",
    """SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN trim(text, e' \\n\\t\\r') ELSE 'yes ' || conv_id END AS answer,
      turn % 4 IN (0, 1) AS clean FROM conversations""",
)
def _reply(spark: SparkSession, sf: str) -> DataFrame:
    body = F.to_json(F.struct(F.concat(F.lit("yes "), F.col("conv_id").cast("string")).alias("answer"), F.col("text").alias("explanation")))
    turn = F.col("turn") % 4
    raw = (
        F.when(turn == 0, body).when(turn == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(turn == 2, F.concat(F.lit('{"answer":"yes '), F.col("conv_id").cast("string"), F.lit('", "expl')))
        .otherwise(F.col("text"))
    )
    parsed = World(spark, sf).table("conversations").select("conv_id", "turn", rec.parse_reply(raw).alias("r"), "text")
    return parsed.select(
        "conv_id", "turn", F.col("r.answer").alias("answer"),
        ((F.col("turn") % 4).isin(0, 1) & (F.col("r.explanation") == tx.strip(F.col("text")))).alias("clean"),
    )


@query(
    "fn16_strip_echo",
    """SELECT o_orderkey AS k, 'Race ' || o_orderkey AS answer FROM orders""",
)
def _echo(spark: SparkSession, sf: str) -> DataFrame:
    answer = F.concat(F.lit("Race "), F.col("o_orderkey").cast("string"), F.lit("; title: something else"))
    return World(spark, sf).table("orders").select(
        F.col("o_orderkey").alias("k"), ev.strip_echo(answer, ("title", "event_name", "nations")).alias("answer")
    )


@query(
    "fn23_run_ids",
    """SELECT c_name AS id, false AS bare, true AS fixed FROM customer""",
)
def _run_ids(spark: SparkSession, sf: str) -> DataFrame:
    return World(spark, sf).table("customer").select(
        F.col("c_name").alias("id"), rec.is_run_id(F.col("c_name")).alias("bare"),
        rec.is_run_id(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("fixed"),
    )


@query(
    "snk7_secret_rows",
    """SELECT doc_id FROM (SELECT doc_id, text || CASE WHEN doc_id % 9 = 0 THEN ' sk-' || md5(doc_id::VARCHAR) ELSE '' END AS text FROM documents)
    WHERE regexp_matches(text, 'sk-[A-Za-z0-9_-]{16,}|gsk_[A-Za-z0-9]{20,}|AIza[0-9A-Za-z_-]{35}|hf_[A-Za-z0-9]{30,}|gh[pousr]_[A-Za-z0-9]{36,}|eyJ[A-Za-z0-9_-]{10,}\\.eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]+')""",
)
def _secrets(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.sources.runs import secret_rows

    docs_ = World(spark, sf).table("documents")
    key = F.concat(F.lit(" sk-"), F.md5(F.col("doc_id").cast("string")))
    planted = docs_.select("doc_id", F.concat("text", F.when(F.col("doc_id") % 9 == 0, key).otherwise("")).alias("text"))
    return secret_rows(planted).select("doc_id")


@query(
    "flt13_ground_intents",
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS sport,
      CASE WHEN o_orderkey % 2 = 0 THEN n_name END AS venue FROM orders JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey""",
)
def _ground(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    intents = World(spark, sf).scopes().select(
        k.alias("k"), F.when(k % 3 == 0, "  ").otherwise(F.col("sport")).alias("sport"), "games",
        F.when(k % 2 == 0, F.upper("n_name")).otherwise("Nowhere").alias("venue"), F.lit("").alias("title"),
        F.lit("made-up").alias("event_id"), F.lit("nations").alias("target_field"),
        F.concat(F.lit("Which  race was held at "), F.lower("n_name"), F.lit("?")).alias("question"),
    )
    return ground_intents(intents).where(F.col("event_id").isNull() & F.col("title").isNull()).select("k", "sport", "venue")


_PROBLEM = """intents AS (
  SELECT o_orderkey AS k, ['LOOKUP', 'COUNT', 'ARGMAX', 'TRAVERSE'][o_orderkey % 4 + 1] AS op,
    o_custkey % 3 = 0 AS titled, o_custkey % 5 = 0 AS targeted, o_custkey % 2 = 0 AS constrained, o_custkey % 7 <> 0 AS venued
  FROM orders)"""


@query(
    "ev14_routing",
    f"""WITH {_PROBLEM}, r AS (SELECT *, CASE WHEN op = 'LOOKUP' AND titled AND targeted AND NOT constrained THEN 'lookup_direct'
        WHEN op IN ('COUNT', 'ARGMAX') THEN 'scoped_aggregate' ELSE 'loop' END AS route FROM intents)
    SELECT k, route AS route_initial,
      CASE WHEN op = 'COUNT' AND NOT constrained AND targeted AND titled THEN 'lookup_direct' ELSE route END AS route_refined,
      CASE WHEN titled AND op = 'TRAVERSE' THEN 'multi_hop' WHEN titled THEN 'lookup' WHEN venued THEN 'venue' ELSE 'traversal' END AS first_tool,
      CASE WHEN titled AND op = 'TRAVERSE' THEN 'multi_hop,lookup,' WHEN titled THEN 'lookup,multi_hop,' ELSE '' END
        || CASE WHEN venued THEN 'venue,' ELSE '' END || 'traversal' AS tools FROM r""",
)
def _route(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    op = F.element_at(F.array(*[F.lit(o) for o in ("LOOKUP", "COUNT", "ARGMAX", "TRAVERSE")]), (k % 4 + 1).cast("int"))
    some = F.array(F.struct(F.lit("nations").alias("field"), F.lit(">").alias("op"), F.lit(1.0).alias("value")))
    questions = World(spark, sf).table("orders").select(
        k.alias("k"), op.alias("operation"), F.when(c % 3 == 0, "a race").alias("title"), F.lit(None).cast("string").alias("event_id"),
        F.when(c % 5 == 0, " Nations ").alias("target_field"), F.when(c % 7 != 0, "hall").alias("venue"),
        F.lit("s").alias("sport"), F.lit("1999-Summer").alias("games"),
        F.when(c % 2 == 0, some).alias("constraints"),
    )
    out = routing.routed(questions)
    return out.select("k", "route_initial", "route_refined", "first_tool", F.array_join("tools", ",").alias("tools"))


@query(
    "ev15_stop_reason",
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'error' WHEN o_orderkey % 7 = 0 THEN 'disambiguation_required'
      WHEN o_orderkey % 5 = 0 THEN 'sufficient_evidence' WHEN o_totalprice >= 20000 AND o_custkey % 4 = 0 THEN 'token_budget_exhausted'
      WHEN o_custkey % 9 >= 6 THEN 'step_budget_exhausted' WHEN o_custkey % 2 = 0 THEN 'no_further_action_available' END AS reason
    FROM orders""",
)
def _stop(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    all_tools = F.array(*[F.lit(t) for t in ("lookup", "similarity_search", "document_retrieval")])
    rows = World(spark, sf).table("orders").select(
        k.alias("k"), (k % 11 == 0).alias("has_error"), (k % 7 == 0).alias("has_candidates"), (k % 5 == 0).alias("is_sufficient"),
        F.when(c % 4 == 0, F.col("o_totalprice")).otherwise(0).alias("tokens_used"), (c % 9).alias("step_count"),
        F.when(c % 2 == 0, all_tools).otherwise(F.array(F.lit("lookup"))).alias("tools_tried"),
    )
    return rows.select("k", routing.stop_reason().alias("reason"))
