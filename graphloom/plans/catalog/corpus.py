"""Document parsing, chunking, coverage and dataset description queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import describe as ds
from graphloom.operators import documents as docs
from graphloom.operators import retrieval as rt
from graphloom.plans.catalog import query
from graphloom.plans.catalog.sql import FIGURES, SCOPES, slug
from graphloom.plans.world import World
from graphloom.sources.corpus import validate_lines

PARSED = f"""{SCOPES}, {FIGURES}, pages AS (
  SELECT o_orderkey AS k, 'D' || o_orderkey AS doc_id, o_orderkey % 5 <> 4 AS is_event, s.*, competitors, nations,
    CASE WHEN o_orderkey % 11 = 0 THEN 'Order ' || o_orderkey
         ELSE sport || ' at the ' || year(o_orderdate) || ' Summer Olympics – ' || o_orderkey END AS title
  FROM scopes s LEFT JOIN figures ON o_orderkey = l_orderkey),
parsed AS (
  SELECT doc_id, title, k, CASE WHEN is_event THEN 'olympic event' WHEN k % 6 = 0 THEN 'venue' ELSE 'film' END AS infobox_type, is_event,
    CASE WHEN is_event THEN CASE WHEN k % 11 = 0 THEN doc_id ELSE {slug('sport')} || '-' || games || '-' || k END END AS event_id,
    CASE WHEN is_event THEN 'Race of ' || c_name END AS event_name,
    CASE WHEN is_event AND k % 9 <> 0 THEN games END AS games_id,
    CASE WHEN is_event AND k % 11 <> 0 THEN sport END AS sport_name,
    CASE WHEN is_event THEN n_name END AS venue_name,
    CASE WHEN is_event THEN competitors END AS competitors,
    CASE WHEN is_event AND k % 7 = 0 THEN competitors || ' teams' END AS competitors_text,
    CASE WHEN is_event THEN nations END AS nations,
    CASE WHEN is_event AND (k % 2 = 0 OR k % 9 <> 0) THEN year(o_orderdate) END::INT AS date_year,
    is_event AND k % 2 <> 0 AND k % 9 <> 0 AS date_year_from_games,
    CASE WHEN is_event THEN month(o_orderdate) END::INT AS date_month, CASE WHEN is_event THEN day(o_orderdate) END::INT AS date_day_start,
    CASE WHEN is_event THEN 'Jane ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || '|John Smith' ELSE '' END AS gold,
    CASE WHEN is_event THEN year(o_orderdate) - 1 END::INT AS prev_year,
    CASE WHEN is_event THEN round(1.0 - CASE WHEN k % 9 = 0 THEN 0.2 ELSE 0 END - CASE WHEN k % 11 = 0 THEN 0.2 ELSE 0 END
      - CASE WHEN k % 7 = 0 AND competitors IS NOT NULL THEN 0.1 ELSE 0 END, 2) ELSE 1 END::DOUBLE AS parse_confidence
  FROM pages)"""


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return docs.parse_documents(World(spark, sf).infobox_corpus())


@query("etl12_parse_documents", f"WITH {PARSED} SELECT * EXCLUDE (k) FROM parsed")
def _parse(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).select(
        "doc_id", "title", "infobox_type", "is_event", "event_id", "event_name", "games_id", "sport_name", "venue_name", "competitors",
        "competitors_text", "nations", "date_year", F.coalesce("date_year_from_games", F.lit(False)).alias("date_year_from_games"),
        "date_month", "date_day_start", F.array_join("gold", "|").alias("gold"), "prev_year", "parse_confidence",
    )


@query(
    "etl1_infobox_type",
    f"WITH {PARSED} SELECT infobox_type, count(*) AS documents FROM parsed GROUP BY infobox_type",
)
def _types(spark: SparkSession, sf: str) -> DataFrame:
    return docs.coverage_types(parsed(spark, sf))


@query(
    "etl2_infobox_rows",
    f"""WITH {PARSED}, f AS (SELECT p.doc_id, m.key, m.value FROM pages p, LATERAL (VALUES ('event', 'Race of ' || c_name),
        ('games', CASE WHEN k % 9 <> 0 THEN year(o_orderdate) || ' Summer' END), ('venue', n_name),
        (CASE WHEN k % 2 = 0 THEN 'date' ELSE 'dates' END,
         strftime(o_orderdate, '%-d %B') || CASE WHEN k % 2 = 0 THEN ' ' || year(o_orderdate) ELSE '' END),
        ('competitors', competitors || CASE WHEN k % 7 = 0 THEN ' teams' ELSE '' END), ('nations', nations::VARCHAR),
        ('gold', 'Jane ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || 'John Smith'),
        ('prev', (year(o_orderdate) - 1)::VARCHAR), ('next', (year(o_orderdate) + 1)::VARCHAR)) m(key, value)
      WHERE m.value IS NOT NULL AND (is_event OR k % 6 <> 0))
    SELECT doc_id, key, value FROM f""",
)
def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return docs.infobox_rows(World(spark, sf).infobox_corpus()).select("doc_id", "key", "value")


@query(
    "etl13_coverage_totals",
    f"""WITH {PARSED} SELECT count(*) AS total_documents, count(*) FILTER (is_event) AS target_events,
      count(DISTINCT infobox_type) AS infobox_types, count(*) FILTER (is_event AND parse_confidence < 1) AS low_confidence,
      count(*) FILTER (competitors_text IS NOT NULL) AS non_integer_competitors,
      count(*) FILTER (is_event AND sport_name IS NULL) AS missing_sport, count(*) FILTER (is_event AND games_id IS NULL) AS missing_games,
      count(*) FILTER (is_event AND (date_year IS NULL OR date_year_from_games)) AS dates_without_year,
      count(*) FILTER (is_event) AS concatenated_medallists FROM parsed""",
)
def _totals(spark: SparkSession, sf: str) -> DataFrame:
    return docs.coverage_totals(parsed(spark, sf))


@query(
    "etl13_coverage_fields",
    f"""WITH {PARSED}, c AS (SELECT count(*) AS n, count(event_name) AS event_name, count(games_id) AS games_id, count(sport_name) AS sport_name,
      count(venue_name) AS venue_name, count(*) FILTER (competitors <> 0) AS competitors, count(*) FILTER (nations <> 0) AS nations,
      count(*) AS date_text, count(gold) AS gold, count(prev_year) AS prev_year, count(*) AS next_year FROM parsed WHERE is_event)
    SELECT field, present, round(present / n * 100, 6) AS percent FROM (UNPIVOT c ON event_name, games_id, sport_name, venue_name, competitors,
      nations, date_text, gold, prev_year, next_year INTO NAME field VALUE present)""",
)
def _fields(spark: SparkSession, sf: str) -> DataFrame:
    return docs.coverage_fields(parsed(spark, sf)).withColumn("percent", F.round("percent", 6))


@query(
    "etl13_samples",
    f"""WITH {PARSED} SELECT doc_id, competitors_text FROM parsed WHERE competitors_text IS NOT NULL ORDER BY k LIMIT 10""",
)
def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return docs.coverage_samples(parsed(spark, sf), order="line_no")


CHUNKS = """worded AS (
  SELECT 'd' || doc_id AS doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS words FROM documents),
wins AS (
  SELECT doc_id, words, unnest(range(0, greatest(0, ceil((len(words) - 300) / 250)::INT) + 1))::INT AS seq FROM worded WHERE len(words) > 0),
chunks AS (
  SELECT doc_id || '_c' || seq AS chunk_id, doc_id, seq, words[seq * 250 + 1 : seq * 250 + 300] AS w FROM wins)"""


@query(
    "etl14_chunks",
    f"WITH {CHUNKS} SELECT chunk_id, doc_id, seq, len(w)::INT AS token_count, md5(array_to_string(w, ' ')) AS digest FROM chunks",
)
def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return docs.chunk_documents(World(spark, sf).chunk_source()).select(
        "chunk_id", "doc_id", "seq", "token_count", F.md5("text").alias("digest")
    )


@query(
    "jn5_document_chunks",
    f"""WITH {CHUNKS} SELECT 'q' || l.doc_id AS qid, c.chunk_id, c.seq FROM labels l JOIN chunks c ON c.doc_id = 'd' || l.doc_id""",
)
def _doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    asked = w.table("labels").select(
        F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("qid"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id")
    )
    return rt.document_chunks(asked, docs.chunk_documents(w.chunk_source())).select("qid", "chunk_id", "seq")


@query(
    "src11_chunk_texts",
    f"""WITH {CHUNKS} SELECT chunk_id, length(array_to_string(w, ' ')) AS chars FROM chunks
      WHERE chunk_id IN (SELECT 'd' || doc_id || '_c0' FROM labels)""",
)
def _chunk_texts(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    wanted = w.table("labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("_c0")).alias("chunk_id"))
    chunks = docs.chunk_documents(w.chunk_source())
    return chunks.join(wanted, "chunk_id", "left_semi").select("chunk_id", F.length("text").cast("long").alias("chars"))


# ---- dataset description --------------------------------------------------------


def titled(w: World) -> DataFrame:
    """Orders as titled records of one dataset per region, every fourth title a distance."""
    k = F.col("o_orderkey")
    region = w.table("region")
    s = w.scopes().join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return s.select(
        F.col("r_name").alias("dataset"),
        F.when(k % 4 == 0, "Running at 1500 metres").otherwise(
            F.concat(F.lit("Rowing at the "), F.year("o_orderdate").cast("string"), F.lit(" Summer Games of "), F.col("n_name"))
        ).alias("title"),
        F.when(k % 3 == 0, F.concat(F.lit("http://mirror.org/"), k.cast("string"))).otherwise(
            F.concat(F.lit("https://en.wikipedia.org/wiki/"), k.cast("string"))
        ).alias("url"),
        F.when(F.col("r_regionkey") == 0, F.lit("  African   corpus ")).alias("declared"), k.alias("k"),
    )


_TITLED = f"""{SCOPES}, titled AS (
  SELECT r_name AS dataset, o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'Running at 1500 metres'
      ELSE 'Rowing at the ' || year(o_orderdate) || ' Summer Games of ' || n_name END AS title,
    year(o_orderdate) AS y, n_regionkey FROM scopes JOIN region ON n_regionkey = r_regionkey)"""


@query(
    "etl17_topics",
    f"WITH {_TITLED} SELECT dataset, 'Summer Games' AS topic, count(*) FILTER (k % 4 <> 0) AS documents FROM titled GROUP BY dataset",
)
def _topics(spark: SparkSession, sf: str) -> DataFrame:
    return ds.topics(titled(World(spark, sf)))


@query(
    "etl18_year_spans",
    f"WITH {_TITLED} SELECT dataset, min(y) || '–' || max(y) AS span FROM titled WHERE k % 4 <> 0 GROUP BY dataset",
)
def _spans(spark: SparkSession, sf: str) -> DataFrame:
    return ds.year_spans(titled(World(spark, sf)))


@query(
    "etl15_describe",
    f"""WITH {_TITLED} SELECT dataset, CASE WHEN n_regionkey = 0 THEN 'African corpus' WHEN n_regionkey = 1 THEN 'Typed title'
        ELSE 'Wikipedia · Summer Games · ' || min(y) FILTER (k % 4 <> 0) || '–' || max(y) FILTER (k % 4 <> 0) END AS title,
      CASE n_regionkey WHEN 0 THEN 'declared' WHEN 1 THEN 'given' ELSE 'inferred' END AS title_source,
      count(*) AS documents, CASE WHEN n_regionkey = 1 THEN 'About it' END AS description
    FROM titled GROUP BY dataset, n_regionkey""",
)
def _describe(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    given = w.table("region").where("r_regionkey = 1").select(
        F.col("r_name").alias("dataset"), F.lit(" Typed  title ").alias("title"), F.lit("About it").alias("description")
    )
    return ds.describe(titled(w), given)


@query(
    "etl16_dominant_host",
    """WITH h AS (SELECT regexp_extract(url, '^[a-z]+') AS dataset, lower(regexp_extract(url, '^https?://(?:www\\.)?([^/:]+)', 1)) AS host FROM pages),
    x AS (SELECT dataset, CASE WHEN contains(host, 'example') THEN 'example' ELSE host END AS value,
          count(*) OVER (PARTITION BY dataset) AS t FROM h)
    SELECT dataset, value, count(*) AS n FROM x GROUP BY dataset, value, t HAVING count(*) > t / 2""",
)
def _hosts(spark: SparkSession, sf: str) -> DataFrame:
    host = ds.url_host(F.col("url"))
    rows = World(spark, sf).table("pages").select(
        F.regexp_extract("url", "^([a-z]+)", 1).alias("dataset"), F.when(host.contains("example"), "example").otherwise(host).alias("host")
    )
    return ds.majority(rows, "host")


@query(
    "etl19_clean_title",
    """SELECT page_id, nullif(left(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')), 80), '') AS title
    FROM pages""",
)
def _titles(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return World(spark, sf).table("pages").select("page_id", tx.clean_title(raw).alias("title"))


@query(
    "top7_common_grams",
    r"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+'))) AS word FROM documents)
    SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, length(word) DESC, word LIMIT 10""",
)
def _common(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)(\w+)"), F.lit(1)))
    counts = World(spark, sf).table("documents").select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.length("word").desc(), "word").limit(10)


# ---- validation --------------------------------------------------------------------


@query(
    "src2_validate_corpus",
    """SELECT source AS dataset, count(*) FILTER (doc_id % 50 <> 7) AS documents,
      min(doc_id) FILTER (doc_id % 50 = 7) AS first_bad_line,
      CASE WHEN count(*) FILTER (doc_id % 50 = 7) > 0 THEN 'text is missing or not text' END AS problem
    FROM documents GROUP BY source""",
)
def _validate(spark: SparkSession, sf: str) -> DataFrame:
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("doc_id") % 50 != 7, F.col("text")).alias("text")))
    return validate_lines(
        World(spark, sf).table("documents").select(F.col("source").alias("dataset"), F.col("doc_id").alias("line_no"), line.alias("value"))
    )


@query(
    "src3_doc_ids",
    "SELECT source AS dataset, count(*) AS n FROM documents GROUP BY source",
)
def _doc_ids(spark: SparkSession, sf: str) -> DataFrame:
    import uuid

    from graphloom.session import checkpoint_root
    from graphloom.sources.corpus import doc_ids

    folder = f"{checkpoint_root(spark)}/corpus-{uuid.uuid4().hex}"
    World(spark, sf).table("documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "source").write.partitionBy(
        "source"
    ).json(folder)
    found = doc_ids(spark, f"{folder}/*").withColumn("dataset", F.lit("x"))
    named = spark.read.option("basePath", folder).json(folder).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("dataset"))
    return named.join(found.select("doc_id"), "doc_id", "left_semi").groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
