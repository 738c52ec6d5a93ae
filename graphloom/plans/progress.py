"""Build progress: the state of each stage, of each pipeline, and its percentage.

``events``: build_id, seq, stage, pipeline_affected array<string>, status,
items_done, items_total, elapsed_ms, note.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
STAGE_WEIGHTS = {
    "parse_infoboxes": 5, "chunk_documents": 5, "embed_chunks": 40, "schema_install": 5, "remove_previous": 5,
    "load_vertices": 10, "load_edges": 5, "load_chunks": 10, "install_graph_queries": 5, "vector_index": 10,
}
STAGE_COUNTERS = {
    "parse_infoboxes": "documents", "chunk_documents": "chunks", "embed_chunks": "vectors",
    "load_vertices": "entities", "load_edges": "relationships",
}
PIPELINE_STAGES = {
    "rag": ("chunk_documents", "embed_chunks", "schema_install", "remove_previous", "load_chunks",
            "install_graph_queries", "vector_index"),
    "graphrag": ("parse_infoboxes", "schema_install", "remove_previous", "load_vertices", "load_edges",
                 "install_graph_queries"),
    "agentic_graphrag": tuple(STAGE_WEIGHTS),
}
OPTIONAL_STAGE = "remove_previous"
COUNTERS = ("documents", "chunks", "vectors", "entities", "relationships")
# -----------------------------------------------------------------------------


def latest_stages(events: DataFrame) -> DataFrame:
    """The most recent event per (build, stage) and the order stages first appeared in."""
    return events.groupBy("build_id", "stage").agg(
        F.min("seq").alias("first_seq"),
        F.max_by(F.struct("status", "items_done", "items_total", "elapsed_ms"), "seq").alias("e"),
    ).select("build_id", "stage", "first_seq", "e.*")


def per_pipeline(events: DataFrame) -> DataFrame:
    return events.withColumn("pipeline", F.explode("pipeline_affected"))


def pipeline_states(events: DataFrame) -> DataFrame:
    """Folded state per (build, pipeline): ready is final, counters keep their maximum."""
    rows = per_pipeline(events)
    last = F.max_by(F.struct("status", "stage", "items_done", "items_total", "elapsed_ms"), "seq")
    counters = [
        F.coalesce(
            F.max(F.when(F.col("stage").isin([s for s, c in STAGE_COUNTERS.items() if c == name]), F.col("items_done"))),
            F.lit(0),
        ).alias(name)
        for name in COUNTERS
    ]
    ready = F.bool_or(F.col("status") == "ready")
    return rows.groupBy("build_id", "pipeline").agg(ready.alias("is_ready"), last.alias("l"), *counters).select(
        "build_id", "pipeline",
        F.when(F.col("is_ready"), "ready").otherwise(F.col("l.status")).alias("status"),
        F.when(F.col("is_ready"), "ready").otherwise(F.col("l.stage")).alias("stage"),
        F.col("l.items_done").alias("items_done"), F.col("l.items_total").alias("items_total"),
        F.col("l.elapsed_ms").alias("elapsed_ms"), *COUNTERS,
    )


def stage_plan(spark: SparkSession) -> DataFrame:
    rows = [(p, s, STAGE_WEIGHTS[s]) for p, stages in PIPELINE_STAGES.items() for s in stages]
    return spark.createDataFrame(rows, "pipeline string, stage string, weight int")


def percent_complete(events: DataFrame) -> DataFrame:
    """(build_id, pipeline, percent): weighted stages, the running one by its items, 99 until ready."""
    rows = per_pipeline(events)
    latest = rows.groupBy("build_id", "pipeline", "stage").agg(
        F.max_by(F.struct("status", "items_done", "items_total"), "seq").alias("e")
    ).select("build_id", "pipeline", "stage", "e.*")
    ready = rows.groupBy("build_id", "pipeline").agg(F.bool_or(F.col("status") == "ready").alias("ready"))
    wanted = ready.join(stage_plan(events.sparkSession), "pipeline")
    fraction = F.when(F.col("status") == "done", 1.0).when(
        F.col("items_total") > 0, F.least(F.lit(1.0), F.col("items_done") / F.col("items_total"))
    ).otherwise(0.0)
    counted = wanted.join(latest, ["build_id", "pipeline", "stage"], "left").where(
        (F.col("stage") != OPTIONAL_STAGE) | F.col("status").isNotNull()
    )
    share = F.sum(F.col("weight") * fraction) / F.sum("weight")
    return counted.groupBy("build_id", "pipeline", "ready").agg(share.alias("share")).select(
        "build_id", "pipeline",
        F.when(F.col("ready"), 100).otherwise(F.least(F.lit(99), F.floor(F.round(F.col("share") * 100, 9)))).cast("int").alias(
            "percent"
        ),
    )


def ready_times(events: DataFrame) -> DataFrame:
    """(build_id, pipeline, ms, is_ready): time to ready, else the latest elapsed time."""
    rows = per_pipeline(events)
    first = F.min_by("elapsed_ms", F.when(F.col("status") == "ready", F.col("seq")))
    return rows.groupBy("build_id", "pipeline").agg(
        F.coalesce(first, F.max_by("elapsed_ms", "seq")).alias("ms"),
        F.bool_or(F.col("status") == "ready").alias("is_ready"),
    )


def elapsed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds elapsed_ms since the build's first event (start found by a partial aggregate)."""
    start = events.groupBy("build_id").agg(F.min(ts).alias("_start"))
    return events.join(start, "build_id").withColumn(
        "elapsed_ms",
        (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_start").cast("timestamp"))) / 1000.0,
    ).drop("_start")


def loaded_totals(datasets: DataFrame) -> DataFrame:
    """Totals over loaded datasets, absent figures from their stand-ins, and the newest build."""
    zero = F.lit(0)
    return datasets.agg(
        F.sum(F.coalesce("documents", zero)).alias("documents"),
        F.sum(F.coalesce("chunks", zero)).alias("chunks"),
        F.sum(F.coalesce("vectors", "chunks", zero)).alias("vectors"),
        F.sum(F.coalesce("entities", F.coalesce("documents", zero) + F.coalesce("events", zero))).alias("entities"),
        F.sum(F.coalesce("relationships", zero)).alias("relationships"),
        F.max_by("dataset", F.struct("built_at", "dataset")).alias("latest"),
    )
