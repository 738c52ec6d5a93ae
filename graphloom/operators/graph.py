"""Typed vertex and edge tables built from parsed documents, and their upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import dates

# ---- fixed values -----------------------------------------------------------
VERTEX_TYPES = ("document", "event", "games", "sport", "venue", "chunk")
PLUMBING_EDGES = ("HAS_CHUNK", "HAS_EMBEDDING")
SCOPE_EDGES = ("DESCRIBES", "AT_GAMES", "IN_SPORT", "HELD_AT")
EDITION_EDGES = ("PREV_EDITION", "NEXT_EDITION")
# -----------------------------------------------------------------------------

EVENT_NUMBERS = ("competitors", "nations", "date_month", "date_day_start", "date_day_end", "date_year")
EVENT_TEXTS = ("competitors_text", "nations_text", "date_text", "gold_noc", "win_value", "win_label")


def document_vertices(parsed: DataFrame, order: str = "line_no") -> DataFrame:
    """Document vertices; the last row of a doc_id wins, as for events (without ``order``: the largest row)."""
    rows = parsed.select(
        "doc_id", "title", "url",
        F.coalesce("infobox_type", F.lit("")).alias("infobox_type"),
        "approx_tokens",
        F.coalesce(F.col("wikipedia_pageid").cast("string"), F.lit("")).alias("wikipedia_pageid"),
        *([F.col(order).alias("_order")] if order in parsed.columns else []),
    )
    payload = F.struct("title", "url", "infobox_type", "approx_tokens", "wikipedia_pageid")
    last = F.struct("_order", payload) if "_order" in rows.columns else payload
    return rows.groupBy("doc_id").agg(F.max_by(payload, last).alias("v")).select("doc_id", "v.*")


def event_vertices(parsed: DataFrame, missing: str = "zero", order: str = "line_no") -> DataFrame:
    """Event vertices; the last document of an id wins.

    ``missing='zero'`` stores absent numbers as 0 the way the loader does,
    ``'null'`` keeps them NULL.
    """
    events = parsed.where("is_event")
    payload = [
        "event_name", *EVENT_NUMBERS, *EVENT_TEXTS, "gold", "silver", "bronze", "parse_confidence"
    ]
    latest = events.groupBy("event_id").agg(
        F.max_by(F.struct(*payload), order).alias("v")
    ).select("event_id", "v.*")
    numbers = {c: F.coalesce(c, F.lit(0)) for c in EVENT_NUMBERS} if missing == "zero" else {}
    texts = {c: F.coalesce(c, F.lit("")) for c in EVENT_TEXTS}
    return latest.withColumns({**numbers, **texts, "bronze": F.array_distinct("bronze")})


def games_vertices(parsed: DataFrame) -> DataFrame:
    return (
        parsed.where(F.col("is_event") & F.col("games_id").isNotNull())
        .select("games_id")
        .distinct()
        .select(
            "games_id",
            F.coalesce(dates.games_year(F.col("games_id")), F.lit(0)).alias("year"),
            F.coalesce(dates.games_season(F.col("games_id")), F.lit("")).alias("season"),
        )
    )


def name_vertices(parsed: DataFrame, column: str) -> DataFrame:
    """Sport or venue vertices: distinct names."""
    return parsed.where(F.col("is_event") & F.col(column).isNotNull()).select(column).distinct()


def vertex_ids(parsed: DataFrame) -> DataFrame:
    """(vtype, id) of every vertex the documents give rise to, in one pass."""
    event = F.col("is_event")

    def vertex(vtype: str, key: Column) -> Column:
        return F.struct(F.lit(vtype).alias("vtype"), key.cast("string").alias("id"))

    return (
        parsed.select(
            F.explode(
                F.array(
                    vertex("document", F.col("doc_id")),
                    *[
                        vertex(v, F.when(event, F.col(c)))
                        for v, c in (("event", "event_id"), ("games", "games_id"), ("sport", "sport_name"), ("venue", "venue_name"))
                    ],
                )
            ).alias("v")
        )
        .select("v.*")
        .where(F.col("id").isNotNull())
        .distinct()
    )


def ids_of(vertices: DataFrame, vtype: str) -> DataFrame:
    """(id): the distinct ids of one vertex type; ``vertices``: vtype, id."""
    return vertices.where(F.col("vtype") == vtype).select("id").where(F.col("id") != "").distinct()


def vocabulary(parsed: DataFrame) -> DataFrame:
    """(vtype, entry): the distinct Games, sport and venue names that questions may be linked to, in one pass."""
    return vertex_ids(parsed.where("is_event")).where(F.col("vtype").isin("games", "sport", "venue") & (F.col("id") != "")).select(
        "vtype", F.col("id").alias("entry")
    )


def live_counts(vertices: DataFrame, vtypes: tuple[str, ...] = ("document", "event", "games", "sport", "venue", "chunk")) -> DataFrame:
    """(vtype, n): distinct vertices per type, 0 for a type without any."""
    known = vertices.sparkSession.createDataFrame([(t,) for t in vtypes], "vtype string")
    counted = vertices.distinct().groupBy("vtype").agg(F.count(F.lit(1)).alias("n"))
    return known.join(counted, "vtype", "left").select("vtype", F.coalesce("n", F.lit(0)).alias("n"))


def chunks_of_hits(hits: DataFrame, edge_table: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits on embedding vertices with the chunk each belongs to: the columns of ``hits`` and of ``chunks``.

    ``hits``: embedding_id and more; the way back is the HAS_EMBEDDING edge, a hit without an edge or a chunk is dropped.
    """
    back = edge_table.where(F.col("etype") == "HAS_EMBEDDING").select(F.col("dst").alias("embedding_id"), F.col("src").alias("chunk_id"))
    return hits.join(back, "embedding_id").join(chunks, "chunk_id")


def edition_index(parsed: DataFrame, order: str = "line_no") -> DataFrame:
    """One event per (sport, event name, Games year): the last document wins."""
    return (
        parsed.where("is_event")
        .withColumn("year", dates.games_year(F.col("games_id")))
        .where(
            F.col("year").isNotNull() & (F.col("sport_name") != "") & (F.col("event_name") != "")
        )
        .groupBy("sport_name", "event_name", "year")
        .agg(F.max_by("event_id", order).alias("target"))
    )


def embedding_edges(coverage: DataFrame) -> DataFrame:
    """HAS_EMBEDDING edges from a chunk to its vector of each model; ``coverage``: model_key, chunk_id."""
    return coverage.select(
        F.lit("HAS_EMBEDDING").alias("etype"), F.col("chunk_id").alias("src"), F.concat_ws("|", "model_key", "chunk_id").alias("dst")
    ).distinct()


def edition_links(parsed: DataFrame, order: str = "line_no") -> DataFrame:
    """(etype, src, dst) per stated neighbour edition; dst NULL when unresolved.

    Both directions share one join: each event states up to two years.
    """
    stated = (
        parsed.where(F.col("is_event") & (F.col("sport_name") != "") & (F.col("event_name") != ""))
        .select(
            F.col("event_id").alias("src"), "sport_name", "event_name",
            F.explode(
                F.array(
                    F.struct(F.lit("PREV_EDITION").alias("etype"), F.col("prev_year").alias("year")),
                    F.struct(F.lit("NEXT_EDITION").alias("etype"), F.col("next_year").alias("year")),
                )
            ).alias("s"),
        )
        .select("src", "sport_name", "event_name", "s.etype", "s.year")
        .where(F.col("year").isNotNull())
    )
    return stated.join(
        edition_index(parsed, order), ["sport_name", "event_name", "year"], "left"
    ).select("etype", "src", F.col("target").alias("dst"))


def edges(
    parsed: DataFrame, chunks: DataFrame | None = None, order: str = "line_no", types: tuple[str, ...] | None = None
) -> DataFrame:
    """edges(etype, src, dst, date_text), one row per (etype, src, dst).

    ``types`` names the edge types wanted, all by default; editions are only linked where they are among them, as that
    reads ``parsed`` twice more.
    """
    wanted = (*SCOPE_EDGES, *EDITION_EDGES, "HAS_CHUNK") if types is None else types
    events = parsed.where("is_event")
    none = F.lit(None).cast("string")

    def edge(etype: str, src: str, dst: str, text: Column) -> Column:
        return F.struct(
            F.lit(etype).alias("etype"), F.col(src).alias("src"), F.col(dst).alias("dst"), text.alias("date_text")
        )

    out = events.select(
        F.explode(
            F.array(
                edge("DESCRIBES", "doc_id", "event_id", none),
                edge("AT_GAMES", "event_id", "games_id", none),
                edge("IN_SPORT", "event_id", "sport_name", none),
                edge("HELD_AT", "event_id", "venue_name", F.coalesce("date_text", F.lit(""))),
            )
        ).alias("e")
    ).select("e.*")
    if set(wanted) & set(EDITION_EDGES):
        out = out.unionByName(edition_links(parsed, order).withColumn("date_text", F.lit(None).cast("string")))
    out = out.where(F.col("dst").isNotNull())
    if types is not None:
        out = out.where(F.col("etype").isin(*types))
    if chunks is not None and "HAS_CHUNK" in wanted:
        out = out.unionByName(
            chunks.select(F.lit("HAS_CHUNK").alias("etype"), F.col("doc_id").alias("src"),
                          F.col("chunk_id").alias("dst"), F.lit(None).cast("string").alias("date_text"))
        )
    return out.groupBy("etype", "src", "dst").agg(F.max("date_text").alias("date_text"))


def load_report(vertices: dict[str, DataFrame], edge_table: DataFrame, links: DataFrame) -> DataFrame:
    """(item, n): vertices per type, edges without embeddings, edition resolution."""
    rows = [df.agg(F.lit(name).alias("item"), F.count(F.lit(1)).alias("n")) for name, df in vertices.items()]
    rows.append(
        edge_table.where(F.col("etype") != "HAS_EMBEDDING").agg(
            F.lit("edges").alias("item"), F.count(F.lit(1)).alias("n")
        )
    )
    rows.append(
        links.groupBy(
            F.concat(
                F.lower(F.col("etype")),
                F.when(F.col("dst").isNull(), "_unresolved").otherwise("_resolved"),
            ).alias("item")
        ).agg(F.count(F.lit(1)).alias("n"))
    )
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def relationship_count(edge_table: DataFrame) -> DataFrame:
    """Edges that relate entities (chunk and embedding plumbing left out)."""
    return edge_table.where(~F.col("etype").isin(*PLUMBING_EDGES)).agg(
        F.count(F.lit(1)).alias("relationships")
    )


def missing_endpoints(edge_table: DataFrame, ids: DataFrame, side: str, etype: str) -> DataFrame:
    """Edges of one type whose ``side`` ('src' or 'dst') names no vertex."""
    return edge_table.where(F.col("etype") == etype).join(
        ids.select(F.col(ids.columns[0]).alias(side)), side, "left_anti"
    )


def missing_types(actual: DataFrame, required: tuple[str, ...] = VERTEX_TYPES) -> DataFrame:
    """Required vertex types that hold no vertex."""
    spark = actual.sparkSession
    return spark.createDataFrame([(t,) for t in required], "vtype string").join(
        actual.select("vtype").distinct(), "vtype", "left_anti"
    )


def event_view(
    events: DataFrame, edge_table: DataFrame, documents: DataFrame
) -> DataFrame:
    """Events with their scope and one parent page, denormalised for the query operators.

    An event without a page drops out (inner join, as every query requires it).
    """

    # Every edge of an event meets the others once: the page edges with their titles, the scope edges as they are.
    pages = (
        edge_table.where(F.col("etype") == "DESCRIBES")
        .select(F.col("src").alias("doc_id"), F.col("dst").alias("event_id"))
        .join(documents.select("doc_id", "title"), "doc_id")
        .select("event_id", F.struct("doc_id", "title").alias("page"), F.lit(None).cast("string").alias("etype"), F.lit(None).cast("string").alias("dst"))
    )
    scoped = edge_table.where(F.col("etype").isin("IN_SPORT", "AT_GAMES", "HELD_AT")).select(
        F.col("src").alias("event_id"), F.lit(None).cast(pages.schema["page"].dataType).alias("page"), "etype", "dst"
    )

    def scope(etype: str, name: str) -> Column:
        return F.min(F.when(F.col("etype") == etype, F.col("dst"))).alias(name)

    views = (
        pages.unionByName(scoped).groupBy("event_id")
        .agg(F.min("page").alias("page"), scope("IN_SPORT", "sport"), scope("AT_GAMES", "games"), scope("HELD_AT", "venue"))
        .where(F.col("page").isNotNull())
    )
    return events.join(views.select("event_id", "page.doc_id", "page.title", "sport", "games", "venue"), "event_id")


# ---- keyed upkeep --------------------------------------------------------------


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last write wins per attribute: a NULL attribute leaves the stored one alone."""
    both = existing.unionByName(incoming, allowMissingColumns=True)
    attributes = [c for c in both.columns if c not in (*keys, version)]
    return both.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(version))).alias(c) for c in attributes],
        F.max(version).alias(version),
    )


def delete_vertices(
    vertices: DataFrame, edge_table: DataFrame, ids: DataFrame, key: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept vertices, kept edges, deleted count) after removing ``ids`` and touching edges."""
    gone = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    kept = vertices.join(gone, key, "left_anti")
    edges_kept = edge_table.join(gone.withColumnRenamed(key, "src"), "src", "left_anti").join(
        gone.withColumnRenamed(key, "dst"), "dst", "left_anti"
    )
    deleted = vertices.join(gone, key, "left_semi").agg(F.count(F.lit(1)).alias("deleted"))
    return kept, edges_kept, deleted


def removable_ids(members: DataFrame, dataset: str | None = None) -> DataFrame:
    """Ids only one dataset wrote; ``dataset`` narrows to that one."""
    alone = (
        members.groupBy("vertex_type", "id")
        .agg(F.min("dataset").alias("dataset"), F.max("dataset").alias("_last"))
        .where(F.col("dataset") == F.col("_last"))
        .drop("_last")
    )
    return alone if dataset is None else alone.where(F.col("dataset") == dataset)


def registry_summary(members: DataFrame) -> DataFrame:
    """Ids per dataset and vertex type, without the id lists."""
    return members.groupBy("dataset").pivot("vertex_type", ["document", "event", "chunk"]).agg(
        F.countDistinct("id")
    ).na.fill(0)


def adoptable(graph_docs: DataFrame, corpus_docs: DataFrame) -> DataFrame:
    """The first corpus (by name) whose ids contain every graph document.

    ``graph_docs``: doc_id. ``corpus_docs``: dataset, doc_id. Empty when none does.
    """
    wanted = graph_docs.select("doc_id").distinct()
    covered = (
        corpus_docs.select("dataset", "doc_id").distinct()
        .join(wanted, "doc_id", "left_semi")
        .groupBy("dataset").agg(F.count(F.lit(1)).alias("held"))
    )
    total = wanted.agg(F.count(F.lit(1))).scalar()
    return covered.where((F.col("held") == total) & (total > 0)).agg(F.min("dataset").alias("dataset")).where(
        F.col("dataset").isNotNull()
    )


def corpus_listing(files: DataFrame, registry: DataFrame, described: DataFrame) -> DataFrame:
    """Corpus files with their loaded state and description."""
    return (
        files.join(described, "dataset", "left")
        .join(registry.withColumn("loaded", F.lit(True)), "dataset", "left")
        .withColumn("loaded", F.coalesce("loaded", F.lit(False)))
    )
