"""Graph construction and upkeep queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import coverage as cov
from graphloom.operators import documents as docs
from graphloom.operators import graph as g
from graphloom.plans.catalog import query
from graphloom.plans.catalog.corpus import PARSED
from graphloom.plans.catalog.sql import PARTS
from graphloom.plans.world import World
from graphloom.session import kept


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return docs.parse_documents(World(spark, sf).infobox_corpus())


@query(
    "grf1_vertices",
    f"""WITH {PARSED} SELECT 'document' AS vtype, count(*) AS n FROM parsed
    UNION ALL SELECT 'event', count(DISTINCT event_id) FROM parsed UNION ALL SELECT 'games', count(DISTINCT games_id) FROM parsed
    UNION ALL SELECT 'sport', count(DISTINCT sport_name) FROM parsed UNION ALL SELECT 'venue', count(DISTINCT venue_name) FROM parsed""",
)
def _vertices(spark: SparkSession, sf: str) -> DataFrame:
    return g.vertex_ids(parsed(spark, sf)).groupBy("vtype").agg(F.count(F.lit(1)).alias("n"))


@query(
    "grf1_event_vertices",
    f"""WITH {PARSED} SELECT event_id, event_name, coalesce(competitors, 0) AS competitors, coalesce(competitors_text, '') AS competitors_text,
      coalesce(nations, 0) AS nations, coalesce(date_year, 0) AS date_year, parse_confidence FROM parsed WHERE is_event""",
)
def _events(spark: SparkSession, sf: str) -> DataFrame:
    return g.event_vertices(parsed(spark, sf)).select(
        "event_id", "event_name", "competitors", "competitors_text", "nations", "date_year", "parse_confidence"
    )


@query(
    "grf2_edges",
    f"""WITH {PARSED} SELECT 'DESCRIBES' AS etype, doc_id AS src, event_id AS dst FROM parsed WHERE is_event
    UNION ALL SELECT 'AT_GAMES', event_id, games_id FROM parsed WHERE games_id IS NOT NULL
    UNION ALL SELECT 'IN_SPORT', event_id, sport_name FROM parsed WHERE sport_name IS NOT NULL
    UNION ALL SELECT 'HELD_AT', event_id, venue_name FROM parsed WHERE venue_name IS NOT NULL""",
)
def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return g.edges(parsed(spark, sf), types=g.SCOPE_EDGES).select("etype", "src", "dst")


@query("grf3_edition_links", f"WITH {PARTS} SELECT etype, src, dst FROM links")
def _links(spark: SparkSession, sf: str) -> DataFrame:
    return g.edition_links(World(spark, sf).parts())


@query(
    "grf4_load_report",
    f"""WITH {PARTS} SELECT 'sport' AS item, count(DISTINCT p_brand) AS n FROM part
    UNION ALL SELECT 'edges', count(DISTINCT (etype, src, dst)) FROM links WHERE dst IS NOT NULL
    UNION ALL SELECT lower(etype) || CASE WHEN dst IS NULL THEN '_unresolved' ELSE '_resolved' END, count(*) FROM links GROUP BY 1""",
)
def _report(spark: SparkSession, sf: str) -> DataFrame:
    parts = World(spark, sf).parts()
    links = g.edition_links(parts)
    edges = links.where(F.col("dst").isNotNull())
    return g.load_report({"sport": g.name_vertices(parts, "sport_name")}, edges, links)


@query("grf5_relationship_count", f"WITH {PARTS} SELECT count(*) AS relationships FROM links WHERE dst IS NOT NULL")
def _relationships(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    plumbing = w.table("documents").select(
        F.lit("HAS_CHUNK").alias("etype"), F.col("doc_id").cast("string").alias("src"), F.col("doc_id").cast("string").alias("dst")
    )
    edges = g.edition_links(w.parts()).where(F.col("dst").isNotNull())
    return g.relationship_count(edges.unionByName(plumbing))


@query(
    "src9_venue_ids",
    f"""WITH {PARSED} SELECT DISTINCT venue_name AS id FROM parsed WHERE is_event AND venue_name <> ''""",
)
def _ids(spark: SparkSession, sf: str) -> DataFrame:
    return g.ids_of(g.vertex_ids(parsed(spark, sf)), "venue")


@query(
    "src10_names",
    f"""WITH {PARSED} SELECT DISTINCT 'games' AS vtype, games_id AS entry FROM parsed WHERE is_event AND games_id <> ''
    UNION ALL SELECT DISTINCT 'sport', sport_name FROM parsed WHERE is_event AND sport_name <> ''
    UNION ALL SELECT DISTINCT 'venue', venue_name FROM parsed WHERE is_event AND venue_name <> ''""",
)
def _vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return g.vocabulary(parsed(spark, sf))


@query(
    "grf6_live_counts",
    f"""WITH {PARSED} SELECT 'document' AS vtype, count(DISTINCT doc_id) AS n FROM parsed UNION ALL SELECT 'event', count(DISTINCT event_id) FROM parsed WHERE is_event
    UNION ALL SELECT 'games', count(DISTINCT games_id) FROM parsed WHERE is_event UNION ALL SELECT 'sport', count(DISTINCT sport_name) FROM parsed WHERE is_event
    UNION ALL SELECT 'venue', count(DISTINCT venue_name) FROM parsed WHERE is_event UNION ALL SELECT 'chunk', 0""",
)
def _live_counts(spark: SparkSession, sf: str) -> DataFrame:
    return g.live_counts(g.vertex_ids(parsed(spark, sf)))


@query(
    "jn2_event_view",
    f"""WITH {PARSED} SELECT event_id, doc_id, title, sport_name AS sport, games_id AS games, venue_name AS venue FROM parsed WHERE is_event""",
)
def _view(spark: SparkSession, sf: str) -> DataFrame:
    p = kept(parsed(spark, sf))
    view = g.event_view(g.event_vertices(p), g.edges(p, types=g.SCOPE_EDGES), g.document_vertices(p))
    return view.select("event_id", "doc_id", "title", "sport", "games", "venue")


def members(w: World) -> DataFrame:
    """Documents belong to their source; labelled ones also to 'labelled'."""
    docs_ = w.table("documents").select(
        F.col("source").alias("dataset"), F.lit("document").alias("vertex_type"), F.col("doc_id").cast("string").alias("id")
    )
    labels = w.table("labels").select(
        F.lit("labelled").alias("dataset"), F.lit("document").alias("vertex_type"), F.col("doc_id").cast("string").alias("id")
    )
    chunks = w.table("documents").select(
        F.col("lang").alias("dataset"), F.lit("chunk").alias("vertex_type"), F.concat("doc_id", F.lit("_c0")).alias("id")
    )
    return docs_.unionByName(labels).unionByName(chunks)


@query(
    "grf7_removable_ids",
    """SELECT 'document' AS vertex_type, doc_id::VARCHAR AS id, source AS dataset FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'chunk', doc_id || '_c0', lang FROM documents""",
)
def _removable(spark: SparkSession, sf: str) -> DataFrame:
    return g.removable_ids(members(World(spark, sf)))


@query("grf8_all_chunk_ids", "SELECT DISTINCT doc_id || '_c0' AS chunk_id FROM documents")
def _all_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return members(World(spark, sf)).where("vertex_type = 'chunk'").select(F.col("id").alias("chunk_id")).distinct()


@query(
    "grf9_registry_summary",
    """SELECT source AS dataset, count(DISTINCT doc_id) AS document, 0::BIGINT AS event, 0::BIGINT AS chunk FROM documents GROUP BY 1
    UNION ALL SELECT 'labelled', count(DISTINCT doc_id), 0, 0 FROM labels
    UNION ALL SELECT lang, 0, 0, count(DISTINCT doc_id) FROM documents GROUP BY 1""",
)
def _registry(spark: SparkSession, sf: str) -> DataFrame:
    return g.registry_summary(members(World(spark, sf)))


@query(
    "grf11_adoptable",
    "SELECT 'all' AS dataset FROM documents LIMIT 1",
)
def _adopt(spark: SparkSession, sf: str) -> DataFrame:
    docs_ = World(spark, sf).table("documents").select("doc_id", "source", "lang")
    corpora = docs_.select(F.explode(F.array(F.col("source"), F.col("lang"), F.lit("all"), F.lit("zz"))).alias("dataset"), "doc_id")
    return g.adoptable(docs_, corpora)


@query("grf12_missing_types", "SELECT 'chunk' AS vtype FROM part LIMIT 1")
def _missing(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    kinds = F.array(*[F.lit(t) for t in g.VERTEX_TYPES if t != "chunk"])
    return g.missing_types(w.table("part").select(F.explode(kinds).alias("vtype")))


@query(
    "grf13_corpus_listing",
    """SELECT source AS dataset, count(*) AS n_docs, source IN (SELECT source FROM documents JOIN labels USING (doc_id)) AS loaded,
      source AS title FROM documents GROUP BY source""",
)
def _listing(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.operators.describe import describe

    w = World(spark, sf)
    d = w.table("documents")
    files = d.groupBy(F.col("source").alias("dataset")).agg(F.count(F.lit(1)).alias("n_docs"))
    loaded = d.join(w.table("labels"), "doc_id", "left_semi").select(F.col("source").alias("dataset")).distinct()
    none = F.lit(None).cast("string")
    described = describe(
        d.select(F.col("source").alias("dataset"), none.alias("title"), none.alias("url"), none.alias("declared"))
    ).select("dataset", "title")
    return g.corpus_listing(files, loaded, described)


@query(
    "snk1_upsert",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS status,
      o_orderpriority AS priority, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS version FROM orders""",
)
def _upsert(spark: SparkSession, sf: str) -> DataFrame:
    orders = World(spark, sf).table("orders")
    old = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.lit(1).alias("version"))
    new = orders.where("o_orderkey % 2 = 0").select(
        F.col("o_orderkey").alias("id"), F.lit("new").alias("status"), F.lit(None).cast("string").alias("priority"), F.lit(2).alias("version")
    )
    return g.upsert(old, new, ["id"], "version")


@query(
    "snk2_unreferenced_edges",
    "SELECT 'O' || o_orderkey AS src, 'C' || o_custkey AS dst FROM orders WHERE o_custkey % 10 = 3",
)
def _stubs(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    edges = w.table("orders").select(
        F.lit("OF").alias("etype"), F.concat(F.lit("O"), "o_orderkey").alias("src"), F.concat(F.lit("C"), "o_custkey").alias("dst")
    )
    customers = w.table("customer").where("c_custkey % 10 <> 3").select(F.concat(F.lit("C"), "c_custkey").alias("id"))
    return g.missing_endpoints(edges, customers, "dst", "OF").select("src", "dst")


@query(
    "snk4_delete_vertices",
    """SELECT 'kept' AS what, count(*) AS n FROM customer WHERE c_acctbal >= 0 UNION ALL
    SELECT 'edges', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0 UNION ALL
    SELECT 'deleted', count(*) FROM customer WHERE c_acctbal < 0""",
)
def _delete(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    customer = w.table("customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), "c_acctbal")
    edges = w.table("orders").select(
        F.lit("OF").alias("etype"), F.concat(F.lit("O"), "o_orderkey").alias("src"), F.concat(F.lit("C"), "o_custkey").alias("dst")
    )
    kept, left, deleted = g.delete_vertices(customer, edges, customer.where("c_acctbal < 0").select("id"), "id")

    def counted(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n"))

    return counted("kept", kept).unionByName(counted("edges", left)).unionByName(
        deleted.select(F.lit("deleted").alias("what"), F.col("deleted").alias("n"))
    )


@query(
    "grf6_vertex_counts",
    "SELECT event_type AS vtype, count(*) AS n FROM events GROUP BY 1",
)
def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return World(spark, sf).table("events").groupBy(F.col("event_type").alias("vtype")).agg(F.count(F.lit(1)).alias("n"))


# ---- embedding coverage ------------------------------------------------------------


def coverage_tables(w: World) -> tuple[DataFrame, DataFrame]:
    """All vectors are chunks; each model covers the labels below its position plus seven."""
    vectors = w.vectors().select("chunk_id", "label")
    pairs = [
        vectors.where(F.col("label") < 7 + i).select(F.lit(m[0]).alias("model_key"), "chunk_id")
        for i, m in enumerate(cov.MODELS) if i != 1
    ]
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return vectors.select("chunk_id"), out


_MODELS = "m(position, model_key) AS (VALUES " + ", ".join(f"({i}, '{m[0]}')" for i, m in enumerate(cov.MODELS)) + ")"
_STATUS = f"""{_MODELS}, status AS (
  SELECT position::INT AS position, model_key, CASE WHEN position = 1 THEN 0 ELSE (SELECT count(*) FROM embeddings WHERE label < 7 + position) END AS chunks_done,
    (SELECT count(*) FROM embeddings) AS chunks_total, position <> 1 AS stored FROM m),
labelled AS (SELECT *, CASE WHEN NOT stored THEN 'not_stored' WHEN chunks_done = chunks_total THEN 'complete' ELSE 'incomplete' END AS state FROM status)"""


@query("agg24_coverage_status", f"WITH {_STATUS} SELECT * FROM labelled")
def _status(spark: SparkSession, sf: str) -> DataFrame:
    corpus, covered = coverage_tables(World(spark, sf))
    return cov.coverage_status(corpus, covered, cov.models(spark))


@query("ev23_searchable_models", f"WITH {_STATUS} SELECT model_key FROM labelled WHERE state = 'complete'")
def _searchable(spark: SparkSession, sf: str) -> DataFrame:
    corpus, covered = coverage_tables(World(spark, sf))
    return cov.searchable(cov.coverage_status(corpus, covered, cov.models(spark)))


@query(
    "ev20_switch_plan",
    f"""WITH {_STATUS}, s AS (SELECT list(model_key ORDER BY position) FILTER (stored) AS stored_models FROM labelled),
    o AS (SELECT model_key, state, list_filter(stored_models, lambda x: x <> model_key) AS others,
        CASE WHEN model_key <> 'bge-large-en-v1.5' THEN 'bge-large-en-v1.5' END AS deletes FROM labelled CROSS JOIN s),
    k AS (SELECT *, list_filter(others, lambda x: x IS DISTINCT FROM deletes) AS keeps FROM o)
    SELECT model_key, state = 'complete' AS instant, len(others) >= 2 AS parallel_needs_eviction,
      CASE WHEN len(others) >= 2 THEN array_to_string(others, ',') ELSE '' END AS parallel_evictable,
      least(len(others) + 1, 2)::INT AS parallel_stored_after, deletes AS replace_deletes,
      len(keeps) >= 2 AS replace_needs_eviction, CASE WHEN len(keeps) >= 2 THEN array_to_string(keeps, ',') ELSE '' END AS replace_evictable,
      array_to_string(keeps, ',') AS replace_keeps FROM k""",
)
def _plan(spark: SparkSession, sf: str) -> DataFrame:
    corpus, covered = coverage_tables(World(spark, sf))
    return cov.switch_plan(cov.coverage_status(corpus, covered, cov.models(spark)), "bge-large-en-v1.5")


@query(
    "jn17_missing_chunks",
    "SELECT 'v' || vec_id AS chunk_id FROM embeddings WHERE label >= 7",
)
def _pending(spark: SparkSession, sf: str) -> DataFrame:
    corpus, covered = coverage_tables(World(spark, sf))
    return cov.missing_chunks(corpus, covered, cov.MODELS[0][0])


@query("grf11_active_model", "SELECT 'bge-large-en-v1.5' AS active FROM embeddings LIMIT 1")
def _active(spark: SparkSession, sf: str) -> DataFrame:
    return cov.active_model(coverage_tables(World(spark, sf))[1])


@query("set8_uncovered_by_model", f"WITH {_STATUS} SELECT model_key, chunks_total - chunks_done AS missing FROM labelled")
def _uncovered(spark: SparkSession, sf: str) -> DataFrame:
    corpus, covered = coverage_tables(World(spark, sf))
    return cov.coverage_status(corpus, covered, cov.models(spark)).select(
        "model_key", (F.col("chunks_total") - F.col("chunks_done")).alias("missing")
    )
