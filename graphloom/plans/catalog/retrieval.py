"""Counting, ranking, lookup and traversal queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import dates, text as tx
from graphloom.operators import evidence as ev
from graphloom.operators import graph as g
from graphloom.operators import retrieval as rt
from graphloom.plans.catalog import query
from graphloom.plans.catalog.sql import EVENTS, PARTS, SCOPES, slug
from graphloom.plans.world import World

# One counting question per (nation, year, priority) that occurs; which anchors
# it states and what it asks follow from the nation.
COUNT_QUESTIONS = """
  SELECT DISTINCT n_name || '|' || games || '|' || sport AS qid, n_nationkey AS nk,
         year(o_orderdate) AS y,
         CASE WHEN n_nationkey % 4 IN (0, 1) THEN sport ELSE '' END AS sport,
         CASE WHEN n_nationkey % 4 IN (0, 1, 3) THEN games ELSE '' END AS games,
         CASE WHEN n_nationkey % 4 IN (0, 2, 3) THEN n_name ELSE '' END AS venue
  FROM scopes"""


def count_questions(w: World) -> DataFrame:
    w.scopes().createOrReplaceTempView("scopes")
    rows = w.spark.sql(COUNT_QUESTIONS)
    nk, y = F.col("nk"), F.col("y")
    first = F.concat(
        F.lit('{"field":"'), F.element_at(F.array(*[F.lit(x) for x in ("competitors", "nations", "date_year")]), nk % 3 + 1),
        F.lit('","op":"'), F.element_at(F.array(*[F.lit(x) for x in (">", "<", ">=", "<=", "=")]), y % 5 + 1),
        F.lit('","value":'), F.element_at(F.array(F.lit(90) + nk, F.lit(4), F.lit(1995)), nk % 3 + 1).cast("string"),
        F.lit("}"),
    )
    second = F.when(nk % 2 == 0, F.lit(',{"field":"competitors","op":"<","value":200}')).otherwise("")
    third = F.when(nk % 6 == 0, F.lit(',{"field":"nations","op":">=","value":2}')).otherwise("")
    payload = F.concat(F.lit("["), first, second, third, F.lit("]"))
    return rows.withColumn("constraints", rt.decode_constraints(payload))


_COUNT_SQL = f"""{EVENTS}, q AS ({COUNT_QUESTIONS}),
passing AS (
  SELECT q.qid, ev.*
  FROM q JOIN ev ON (q.sport = '' OR q.sport = ev.sport) AND (q.games = '' OR q.games = ev.games)
    AND (q.venue = '' OR q.venue = ev.venue)
  WHERE CASE nk % 3
          WHEN 0 THEN CASE y % 5 WHEN 0 THEN coalesce(competitors, 0) > 90 + nk WHEN 1 THEN coalesce(competitors, 0) < 90 + nk
            WHEN 2 THEN coalesce(competitors, 0) >= 90 + nk WHEN 3 THEN coalesce(competitors, 0) <= 90 + nk
            ELSE coalesce(competitors, 0) = 90 + nk END
          WHEN 1 THEN CASE y % 5 WHEN 0 THEN coalesce(nations, 0) > 4 WHEN 1 THEN coalesce(nations, 0) < 4
            WHEN 2 THEN coalesce(nations, 0) >= 4 WHEN 3 THEN coalesce(nations, 0) <= 4 ELSE coalesce(nations, 0) = 4 END
          ELSE CASE y % 5 WHEN 0 THEN date_year > 1995 WHEN 1 THEN date_year < 1995 WHEN 2 THEN date_year >= 1995
            WHEN 3 THEN date_year <= 1995 ELSE date_year = 1995 END END
    AND (nk % 2 <> 0 OR coalesce(competitors, 0) < 200) AND (nk % 6 <> 0 OR coalesce(nations, 0) >= 2)),
counts AS (
  SELECT q.qid, count(p.event_id) FILTER (parse_confidence >= 0.9) AS count_value,
         count(p.event_id) FILTER (parse_confidence < 0.9) AS excluded_count
  FROM q LEFT JOIN passing p USING (qid) GROUP BY q.qid)"""


@query("agg1_count_where", f"WITH {_COUNT_SQL} SELECT * FROM counts")
def _count(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    return rt.count_where(count_questions(w), w.events())


@query(
    "agg2_count_members",
    f"""WITH {_COUNT_SQL}
    SELECT qid, event_id, event_name, doc_id, title, competitors, date_year, nations FROM passing WHERE parse_confidence >= 0.9""",
)
def _members(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    return rt.count_members(count_questions(w), w.events())


@query(
    "agg2_first_members",
    f"""WITH {_COUNT_SQL}
    SELECT qid, event_id, event_name, doc_id, title, competitors, date_year, nations FROM passing WHERE parse_confidence >= 0.9
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY event_id, doc_id) <= 30""",
)
def _first_members(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    return rt.count_members(count_questions(w), w.events(), limit=rt.MAX_MEMBERS)


@query(
    "agg2_count_evidence",
    f"""WITH {_COUNT_SQL}
    SELECT q.qid, count_value AS "count", excluded_count,
           'Olympic events' || CASE WHEN q.sport <> '' THEN ' in ' || q.sport ELSE '' END
             || CASE WHEN q.games <> '' THEN ' at ' || q.games ELSE '' END
             || CASE WHEN q.venue <> '' THEN ' held at ' || q.venue ELSE '' END
             || ' with ' || ['competitors', 'nations', 'date_year'][nk % 3 + 1] || ' '
             || ['>', '<', '>=', '<=', '='][y % 5 + 1] || ' ' || [90 + nk, 4, 1995][nk % 3 + 1]
             || CASE WHEN nk % 2 = 0 THEN ' and competitors < 200' ELSE '' END
             || CASE WHEN nk % 6 = 0 THEN ' and nations >= 2' ELSE '' END AS counted,
           CASE WHEN count_value > 30 THEN '30 of ' || count_value END AS counted_events_listed
    FROM q JOIN counts USING (qid)""",
)
def _count_evidence(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    questions, events = count_questions(w), w.events()
    counts = rt.count_where(questions, events).join(
        questions.select("qid", rt.count_description(F.col("constraints")).alias("counted")), "qid"
    )
    rows = ev.from_counts(counts, rt.count_members(questions, events, limit=rt.MAX_MEMBERS))
    return rows.where(F.col("pos") == 0).select("qid", "count", "excluded_count", "counted", "counted_events_listed")


@query("agg22_excluded_total", f"WITH {_COUNT_SQL} SELECT sum(excluded_count)::BIGINT AS excluded FROM counts")
def _excluded(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    return rt.count_where(count_questions(w), w.events()).agg(F.sum("excluded_count").alias("excluded"))


@query(
    "flt3_clean_constraints",
    """SELECT e.event_id AS qid,
       CASE WHEN event_type IN ('view', 'click') AND k % 10 <> 0 THEN
         CASE event_type WHEN 'view' THEN 'competitors' ELSE 'date_year' END || ' > ' || k::DOUBLE ELSE '' END AS usable,
       CASE WHEN event_type IN ('view', 'click') AND k % 10 <> 0 THEN ''
         ELSE CASE event_type WHEN 'view' THEN 'Participants' WHEN 'click' THEN 'Year' ELSE event_type END
              || ' > ' || CASE WHEN k % 10 = 0 THEN 'many' ELSE k::VARCHAR END END AS dropped
    FROM (SELECT *, (json_extract_string(props, '$.k'))::INT AS k FROM events) e""",
)
def _clean(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    field = F.when(F.col("event_type") == "view", "Participants").when(F.col("event_type") == "click", "Year").otherwise(
        F.col("event_type")
    )
    value = F.when(k.cast("int") % 10 == 0, F.lit("many")).otherwise(k)
    raw = F.array(F.struct(field.alias("field"), F.lit(">").alias("op"), value.alias("value")))
    cleaned = rt.clean_constraints(raw)
    return World(spark, sf).table("events").select("event_id", cleaned.alias("c")).select(
        F.col("event_id").alias("qid"),
        F.array_join(F.transform("c.usable", lambda c: F.concat_ws(" ", c["field"], c["op"], c["value"].cast("string"))), "; ").alias(
            "usable"
        ),
        F.array_join("c.dropped", "; ").alias("dropped"),
    )


@query(
    "top1_argmax",
    f"""WITH {EVENTS}, q AS ({COUNT_QUESTIONS}),
    r AS (SELECT q.qid, ev.event_id, event_name, doc_id, title,
                 coalesce(CASE WHEN nk % 2 = 0 THEN nations ELSE competitors END, 0)::DOUBLE AS value
          FROM q JOIN ev ON (q.sport = '' OR q.sport = ev.sport) AND (q.games = '' OR q.games = ev.games)
            AND (q.venue = '' OR q.venue = ev.venue))
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY value DESC, event_id)::INT AS rank,
           event_id, event_name, doc_id, title, value
    FROM r QUALIFY rank <= 3""",
)
def _argmax(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    questions = count_questions(w).withColumn("field", F.when(F.col("nk") % 2 == 0, "nations").otherwise("gold"))
    return rt.argmax(questions, w.events())


def pages(w: World) -> DataFrame:
    """Event pages and the plain pages of customers."""
    plain = w.table("customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("doc_id"), F.col("c_name").alias("title")
    )
    return w.documents().unionByName(plain)


def lookup_questions(w: World) -> DataFrame:
    k = F.col("o_orderkey")
    base = w.events_base()
    title = (
        F.when(k % 5 == 1, F.col("event_name")).when(k % 5 == 2, F.col("title"))
        .when(k % 5 == 3, F.regexp_replace("event_name", "^Race of ", "")).when(k % 5 == 0, F.lit("ignored"))
        .otherwise("")
    )
    return base.select(
        F.concat(F.lit("q"), k.cast("string")).alias("qid"),
        F.when(k % 5 == 0, F.col("event_id")).otherwise("").alias("event_id"), title.alias("title"),
        "sport", "games", F.col("o_orderkey").alias("k"),
    )


@query(
    "jn1_lookup",
    f"""WITH {EVENTS}, hits AS (
      SELECT 'q' || a.o_orderkey AS qid, b.* FROM ev a JOIN ev b ON a.event_id = b.event_id WHERE a.o_orderkey % 5 = 0
      UNION ALL
      SELECT 'q' || a.o_orderkey, b.* FROM ev a JOIN ev b ON a.event_name = b.event_name WHERE a.o_orderkey % 5 = 1
      UNION ALL
      SELECT 'q' || a.o_orderkey, b.* FROM ev a JOIN ev b ON a.title = b.title WHERE a.o_orderkey % 5 = 2)
    SELECT qid, 'event' AS matched, event_id, doc_id, title, competitors, nations, date_text,
           c_name || '; ' || c_mktsegment || '; ' AS gold FROM hits
    UNION ALL
    SELECT 'q' || o_orderkey, 'document', NULL, 'C' || c_custkey, c.c_name, NULL, NULL, NULL, NULL
    FROM ev JOIN customer c ON c.c_name = ev.c_name WHERE o_orderkey % 5 = 3""",
)
def _lookup(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    return rt.lookup(lookup_questions(w), w.events(), pages(w)).select(
        "qid", "matched", "event_id", "doc_id", "title", "competitors", "nations", "date_text",
        rt.medal_text(F.col("gold")).alias("gold"),
    )


@query(
    "jn9_named_events",
    f"""WITH {EVENTS}, exact AS (
      SELECT 'q' || o_orderkey AS qid, event_id, doc_id FROM ev WHERE o_orderkey % 2 = 0),
    named AS (
      SELECT 'q' || a.o_orderkey AS qid, b.event_id, b.doc_id, b.games = a.games AS same
      FROM ev a JOIN ev b ON a.event_name = b.event_name WHERE a.o_orderkey % 2 = 1)
    SELECT qid, event_id, doc_id FROM exact UNION ALL
    SELECT qid, event_id, doc_id FROM named QUALIFY same = bool_or(same) OVER (PARTITION BY qid)""",
)
def _named(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    base = w.events_base()
    questions = base.select(
        F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("qid"), "sport", "games",
        F.when(F.col("o_orderkey") % 2 == 0, F.col("title")).otherwise(F.col("event_name")).alias("title"),
        F.lit(None).cast("string").alias("event_id"),
    )
    return rt.named_events(questions, base, w.documents()).select("qid", "event_id", "doc_id")


@query(
    "jn3_held_at",
    f"""WITH {EVENTS}
    SELECT 'e' || o_orderkey AS qid, 'venue' AS kind, venue, NULL AS event_id, NULL AS doc_id FROM ev
    UNION ALL
    SELECT 'v' || n_nationkey, 'event', venue, event_id, doc_id FROM nation JOIN ev ON venue = nation.n_name""",
)
def _held(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    base = w.events_base()
    anchors = base.select(
        F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("qid"), F.col("event_id").alias("anchor")
    ).unionByName(
        w.table("nation").select(F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("qid"),
                                 F.col("n_name").alias("anchor"))
    )
    return rt.held_at(anchors, base).select("qid", "kind", "venue", "event_id", "doc_id")


@query(
    "jn4_edition_walk",
    f"""WITH {PARTS}, s AS (
      SELECT event_id AS qid, event_id, y % 4 AS hops, CASE WHEN line_no % 2 = 0 THEN 'NEXT_EDITION' ELSE 'PREV_EDITION' END AS etype
      FROM parts),
    one AS (SELECT DISTINCT qid, dst, hops, s.etype FROM s JOIN links ON src = event_id AND links.etype = s.etype AND dst IS NOT NULL WHERE hops >= 1),
    two AS (SELECT DISTINCT qid, l.dst, hops, o.etype FROM one o JOIN links l ON l.src = o.dst AND l.etype = o.etype AND l.dst IS NOT NULL WHERE hops >= 2),
    three AS (SELECT DISTINCT qid, l.dst, hops, o.etype FROM two o JOIN links l ON l.src = o.dst AND l.etype = o.etype AND l.dst IS NOT NULL WHERE hops >= 3)
    SELECT qid, event_id FROM s WHERE hops = 0 UNION ALL SELECT qid, dst FROM one WHERE hops = 1
    UNION ALL SELECT qid, dst FROM two WHERE hops = 2 UNION ALL SELECT qid, dst FROM three WHERE hops = 3""",
)
def _walk(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    parts = w.parts()
    starts = parts.select(
        F.col("event_id").alias("qid"), "event_id", (F.col("prev_year") - 1899).alias("size"),
        F.when(F.col("line_no") % 2 == 0, "NEXT_EDITION").otherwise("PREV_EDITION").alias("edge_type"),
    ).withColumn("hops", F.col("size") % 4)
    edges = g.edition_links(parts).where(F.col("dst").isNotNull())
    return rt.edition_walk(starts, edges)


@query(
    "jn7_multi_hop",
    f"""WITH {PARTS}, names AS (SELECT 'P' || p_partkey AS event_id, p_name FROM part),
    back AS (SELECT DISTINCT src, dst FROM links WHERE etype = 'PREV_EDITION' AND dst IS NOT NULL),
    h1 AS (SELECT p.event_id AS qid, y % 3 + 1 AS hops, dst FROM parts p JOIN back ON src = p.event_id),
    h2 AS (SELECT DISTINCT qid, hops, b.dst FROM h1 JOIN back b ON b.src = h1.dst WHERE hops >= 2),
    h3 AS (SELECT DISTINCT qid, hops, b.dst FROM h2 JOIN back b ON b.src = h2.dst WHERE hops >= 3),
    r AS (SELECT DISTINCT qid, dst FROM h1 WHERE hops = 1 UNION ALL SELECT qid, dst FROM h2 WHERE hops = 2 UNION ALL SELECT qid, dst FROM h3 WHERE hops = 3)
    SELECT qid, dst AS event_id, n.p_name AS value FROM r JOIN names n ON n.event_id = dst""",
)
def _hop(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    parts = w.parts()
    events = parts.select(
        "event_id", "event_name", "doc_id", "title", F.col("sport_name").alias("sport"), F.col("games_id").alias("games"),
        dates.games_year(F.col("games_id")).alias("date_year"),
    )
    none = F.lit(None).cast("string")
    questions = parts.select(
        F.col("event_id").alias("qid"), none.alias("sport"), none.alias("games"), none.alias("title"), "event_id",
        F.lit("PREV_EDITION").alias("edge_type"), ((F.col("prev_year") - 1899) % 3 + 1).alias("hops"), F.lit("title").alias("target_field"),
    )
    return rt.multi_hop(questions, events, g.edition_links(parts), events.select("doc_id", "title")).select(
        "qid", "event_id", "value"
    )


# One question per (nation, year, month) with events there.
_VENUE_QUESTIONS = """
  SELECT DISTINCT n_name || '|' || year(o_orderdate) || '|' || month(o_orderdate) AS qid, n_name AS venue,
         CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE year(o_orderdate) || '-Summer' END AS games,
         CASE WHEN n_nationkey % 2 = 0 THEN '1-URGENT' END AS sport,
         year(o_orderdate) AS date_year, month(o_orderdate) AS date_month, 15 AS date_day_start
  FROM scopes"""


@query(
    "jn8_venue_events",
    f"""WITH {EVENTS}, q AS ({_VENUE_QUESTIONS}),
    r AS (SELECT q.qid, q.games AS g, q.date_month AS m, 15 AS d, e.*,
            CASE WHEN e.date_year = q.date_year THEN 0 ELSE 1 END AS t1,
            CASE WHEN q.sport IS NOT NULL AND e.event_id LIKE '1-urgent-%' THEN 0 ELSE 1 END AS t2
          FROM q JOIN ev e USING (venue)),
    best AS (SELECT * FROM r QUALIFY (t1, t2) = min((t1, t2)) OVER (PARTITION BY qid)),
    t AS (SELECT *, CASE WHEN date_month = m AND date_day_start = d THEN 0 ELSE 1 END AS t3 FROM best)
    SELECT qid, event_id, doc_id, nations::VARCHAR AS value FROM t QUALIFY t3 = min(t3) OVER (PARTITION BY qid)""",
)
def _venue(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    w.scopes().createOrReplaceTempView("scopes")
    questions = spark.sql(_VENUE_QUESTIONS).withColumns(
        {"question": F.lit("which event was it?"), "target_field": F.lit("nations")}
    )
    return rt.venue_events(questions, w.events()).select("qid", "event_id", "doc_id", "value")


@query(
    "flt5_narrow_to_date",
    f"""WITH {EVENTS}, q AS (SELECT 'q' || c_custkey AS qid, 'Race of ' || c_name AS event_name,
           CASE WHEN c_custkey % 2 = 0 THEN 'held on 5 March, was it?' ELSE 'when?' END AS question,
           c_custkey % 12 + 1 AS m FROM customer),
    r AS (SELECT q.qid, e.event_id,
           CASE WHEN question LIKE 'held%' AND date_text = '5 March' THEN 0
                WHEN date_month = m AND date_day_start = 10 THEN 1 ELSE 2 END AS t
          FROM q JOIN ev e USING (event_name))
    SELECT qid, event_id FROM r QUALIFY t = min(t) OVER (PARTITION BY qid)""",
)
def _dated(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    key = F.col("c_custkey")
    questions = w.table("customer").select(
        F.concat(F.lit("q"), key.cast("string")).alias("qid"), F.concat(F.lit("Race of "), F.col("c_name")).alias("event_name"),
        F.when(key % 2 == 0, "held on 5 March, was it?").otherwise("when?").alias("a_question"),
        F.lit(0).alias("a_year"), (key % 12 + 1).cast("int").alias("a_month"), F.lit(10).alias("a_day"),
    )
    rows = questions.join(w.events_base(), "event_name")
    return rt.narrow_to_date(rows).select("qid", "event_id")


@query("flt7_edition_of", f"WITH {SCOPES} SELECT o_orderkey AS k, games AS edition FROM scopes")
def _edition(spark: SparkSession, sf: str) -> DataFrame:
    return World(spark, sf).events_base().select(
        F.col("o_orderkey").alias("k"), dates.edition_of(F.col("event_id")).alias("edition")
    )


@query(
    "fn25_derived_event_id",
    f"WITH {SCOPES} SELECT o_orderkey AS k, {slug('sport')} || '-' || games || '-' || {slug('c_name')} AS event_id FROM scopes",
)
def _derived(spark: SparkSession, sf: str) -> DataFrame:
    title = F.concat(F.lit("Some sport at the 1999 Summer Olympics – "), F.col("c_name"))
    return World(spark, sf).scopes().select(
        F.col("o_orderkey").alias("k"), tx.event_id(F.col("sport"), F.col("games"), title).alias("event_id")
    )
