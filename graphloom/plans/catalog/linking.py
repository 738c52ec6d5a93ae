"""Vocabulary linking and anchor resolution queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import dates
from graphloom.operators import linking as lk
from graphloom.operators import retrieval as rt
from graphloom.plans.catalog import query
from graphloom.plans.catalog.sql import EVENTS, SCOPES
from graphloom.plans.world import World
from graphloom.session import cut_lineage


def vocab(w: World, column: str) -> DataFrame:
    """The distinct names of a scope column, kept: every linking step reads them."""
    return w.scopes().select(F.col(column).alias("entry")).distinct().cache()


def venue_queries(w: World) -> DataFrame:
    """What customers might type for a venue: exact, inside a phrase, a fragment, unrelated."""
    k = F.col("c_custkey")
    text = (
        F.when(k % 4 == 0, F.col("n_name")).when(k % 4 == 1, F.concat(F.lit("team "), k.cast("string"), F.lit(" of "), F.replace("n_name", F.lit("_"), F.lit(" "))))
        .when(k % 4 == 2, F.concat(F.lit("ION_"), F.col("n_nationkey").cast("string"))).otherwise(F.col("c_name"))
    )
    return w.table("customer").join(w.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.lower(text).alias("query")
    )


_QUERIES = """queries AS (
  SELECT DISTINCT lower(CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN 'team ' || c_custkey || ' of ' || replace(n_name, '_', ' ')
    WHEN 2 THEN 'ION_' || n_nationkey ELSE c_name END) AS query
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
entries AS (SELECT DISTINCT n_name AS entry FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(
    "jn10_link_vocabulary",
    f"""WITH {_QUERIES}, p AS (
      SELECT query, entry, replace(query, '_', ' ') AS q, replace(lower(entry), '_', ' ') AS e FROM queries CROSS JOIN entries),
    a AS (SELECT query, entry, CASE WHEN q = e THEN 'exact' ELSE 'contained' END AS tier FROM p WHERE contains(q, e)
          QUALIFY row_number() OVER (PARTITION BY query ORDER BY q = e DESC, length(entry) DESC, entry) = 1),
    b AS (SELECT query, min(entry) AS entry, 'container' AS tier FROM p WHERE contains(e, q) AND query NOT IN (SELECT query FROM a)
          GROUP BY query HAVING count(*) = 1)
    SELECT * FROM a UNION ALL SELECT * FROM b""",
)
def _link(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    return lk.link_vocabulary(venue_queries(w), vocab(w, "venue"))


@query(
    "jn11_resolve_venues",
    f"""WITH {_QUERIES}, p AS (SELECT query, entry, lower(entry) AS e FROM queries CROSS JOIN entries
      WHERE contains(query, lower(entry)) OR contains(lower(entry), query)),
    c AS (SELECT query, count(*) AS candidates, min(entry) AS only_one, min(entry) FILTER (e = query) AS exact FROM p GROUP BY query),
    s AS (SELECT query, entry, row_number() OVER (PARTITION BY query ORDER BY length(entry) DESC, entry) AS r FROM p),
    t AS (SELECT query, string_agg(entry, ', ' ORDER BY r) AS shown FROM s WHERE r <= 10 GROUP BY query),
    v AS (SELECT *, CASE WHEN candidates = 1 THEN only_one ELSE exact END AS venue FROM c JOIN t USING (query))
    SELECT query, venue, candidates, CASE WHEN venue IS NULL THEN shown || CASE WHEN candidates > 10
      THEN ' (+' || (candidates - 10) || ' more)' ELSE '' END END AS shown FROM v""",
)
def _venues(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    return lk.resolve_venues(venue_queries(w), vocab(w, "venue"))


@query(
    "jn12_resolve_games",
    f"""WITH {SCOPES} SELECT DISTINCT CASE o_orderkey % 3 WHEN 0 THEN year(o_orderdate)::VARCHAR
       WHEN 1 THEN 'the ' || year(o_orderdate) || ' summer games' ELSE games END AS query, games AS entry FROM scopes""",
)
def _games(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    k, y = F.col("o_orderkey") % 3, F.year("o_orderdate").cast("string")
    queries = w.scopes().select(
        F.when(k == 0, y).when(k == 1, F.concat(F.lit("the "), y, F.lit(" summer games"))).otherwise(F.col("games")).alias("query")
    )
    return lk.resolve_games(queries, vocab(w, "games"))


def questions(w: World) -> DataFrame:
    """One question text per order, naming its venue in full (and its date)."""
    s = w.scopes()
    return s.select(
        F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("qid"),
        F.concat(
            F.lit("Who won "), F.col("sport"), F.lit(" at "), F.col("n_name"), F.lit(", held on "),
            F.date_format("o_orderdate", "d MMMM yyyy"), F.lit(" ("), F.col("c_name"), F.lit(")?"),
        ).alias("question"),
        "sport", "games", "venue", "o_orderkey", "o_orderdate",
    )


@query(
    "jn13_mentions",
    f"""WITH {SCOPES}, e AS (SELECT DISTINCT n_name AS entry FROM scopes),
    t AS (SELECT 'q' || o_orderkey AS qid, 'who won ' || lower(sport) || ' at ' || lower(n_name) || ', held on ' || lower(c_name) AS t FROM scopes)
    SELECT qid, entry FROM t JOIN e ON regexp_matches(t, '(^|[^a-z0-9_])' || lower(entry) || '($|[^a-z0-9_])')""",
)
def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    return lk.mentions(questions(w).select("qid", "question"), vocab(w, "venue"))


def intents(w: World) -> DataFrame:
    """Parsed intents with the gaps and slips linking has to repair."""
    k = F.col("o_orderkey") % 6
    none = F.lit(None).cast("string")
    constraint = "array<struct<field:string,op:string,value:string>>"
    dated = F.array(
        F.struct(F.lit("date").alias("field"), F.lit("=").alias("op"), F.date_format("o_orderdate", "d MMMM yyyy").alias("value"))
    )
    return questions(w).select(
        "qid", "question", "o_orderkey",
        F.when(k == 1, none).otherwise(F.lower("sport")).alias("sport"),
        F.when(k.isin(2, 3), none).otherwise(F.substring("games", 1, 4)).alias("games"),
        F.when(k.isin(1, 4), none).when(k == 5, F.lit("atlantis hall")).otherwise(F.col("venue")).alias("venue"),
        F.when(k == 2, F.replace("games", F.lit("-"), F.lit(" "))).when(k == 4, F.lower("venue")).otherwise(none).alias("title"),
        none.alias("event_id"),
        F.when(k == 3, dated).otherwise(F.array().cast(constraint)).alias("constraints"),
    )


@query(
    "jn13_resolve_anchors",
    f"""WITH {SCOPES} SELECT 'q' || o_orderkey AS qid, sport, CASE WHEN o_orderkey % 6 = 3 THEN NULL ELSE games END AS games,
      CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE n_name END AS venue, NULL::VARCHAR AS title,
      year(o_orderdate)::INT AS date_year, month(o_orderdate)::INT AS date_month, day(o_orderdate)::INT AS date_day_start,
      CASE WHEN o_orderkey % 6 = 5 THEN 'venue' ELSE '' END AS unresolved FROM scopes""",
)
def _anchors(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    out = lk.resolve_anchors(cut_lineage(intents(w)), vocab(w, "sport"), vocab(w, "games"), vocab(w, "venue"))
    return out.select("qid", "sport", "games", "venue", "title", "date_year", "date_month", "date_day_start", "unresolved")


@query(
    "ev19_disambiguation",
    """SELECT 'q' || c_custkey AS qid, 'disambiguation_required' AS stop_reason, (SELECT count(DISTINCT c_nationkey) FROM customer)::INT AS candidates
    FROM customer WHERE c_custkey % 3 = 0""",
)
def _ambiguous(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    asked = w.table("customer").select(
        F.concat(F.lit("q"), k.cast("string")).alias("qid"), F.lit("what happened there?").alias("question"),
        F.when(k % 3 == 1, "5-low").alias("sport"), none.alias("games"), F.when(k % 3 != 2, "nation").alias("venue"),
        none.alias("title"), none.alias("event_id"),
        F.array().cast("array<struct<field:string,op:string,value:string>>").alias("constraints"),
    )
    out = lk.resolve_anchors(asked, vocab(w, "sport"), vocab(w, "games"), vocab(w, "venue"))
    return lk.needs_disambiguation(out).select(
        "qid", "stop_reason", F.regexp_extract("explanation", r"matches (\d+) venues", 1).cast("int").alias("candidates")
    )


@query(
    "flt14_date_constraints",
    """SELECT o_orderkey AS k, year(o_orderdate)::INT AS date_year, month(o_orderdate)::INT AS date_month, day(o_orderdate)::INT AS date_day_start FROM orders""",
)
def _constraints(spark: SparkSession, sf: str) -> DataFrame:
    def part(field: str, pattern: str):
        return F.struct(F.lit(field).alias("field"), F.lit("=").alias("op"), F.date_format("o_orderdate", pattern).alias("value"))

    given = F.array(part("date", "d MMMM"), part("date_text", "yyyy"), part("competitors", "yyyy"))
    # The year alone has no day; a later constraint only overrides what it states.
    return World(spark, sf).table("orders").select(F.col("o_orderkey").alias("k"), lk.date_constraints(given).alias("d")).select("k", "d.*")


@query(
    "jn14_date_coverage",
    f"""WITH {EVENTS} SELECT event_id FROM ev WHERE date_month = 2 AND date_day_start <= 14 AND date_day_start + o_orderkey % 5 >= 14""",
)
def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    base = World(spark, sf).events_base().withColumn(
        "date_day_end", F.when(F.col("o_orderkey") % 5 > 0, F.col("date_day_start") + F.col("o_orderkey") % 5).otherwise(0)
    )
    return base.where(rt.covers_date(F.lit(0), F.lit(2), F.lit(14))).select("event_id")


@query("src10_vocabulary", f"WITH {SCOPES} SELECT DISTINCT games AS entry, year(o_orderdate)::INT AS year FROM scopes")
def _vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return vocab(World(spark, sf), "games").select("entry", dates.games_year(F.col("entry")).alias("year"))
