"""Trial log: one JSON object per finished query, build, benchmark or embedding job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIAL = (
    "id string, at string, kind string, status string, subject string, dataset string, duration_ms double, "
    "tokens bigint, error string, llm_provider string, llm_model string"
)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """All readable entries; open fields stay available as a VARIANT payload."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    payload = F.try_parse_json("value")
    return (
        lines.withColumn("payload", payload)
        .where(F.col("payload").isNotNull() & F.trim("value").startswith("{"))
        .withColumn("t", F.from_json("value", TRIAL))
        .select("t.*", "payload")
    )


def newest(trials: DataFrame, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest first, optionally one kind and at most ``limit`` entries."""
    rows = trials if kind is None else trials.where(F.col("kind") == kind)
    rows = rows.orderBy(F.col("at").desc(), F.col("id"))
    return rows if limit is None else rows.limit(limit)


def visible(trials: DataFrame, kind: str = "all", status: str = "all", search: str = "") -> DataFrame:
    """The history filter: kind, status and a substring over five fields."""
    rows = trials
    if kind != "all":
        rows = rows.where(F.col("kind") == kind)
    if status != "all":
        rows = rows.where(F.col("status") == status)
    needle = search.strip().lower()
    if needle:
        hit = F.lit(False)
        for name in ("subject", "llm_model", "llm_provider", "dataset", "error"):
            hit = hit | F.coalesce(F.lower(name).contains(needle), F.lit(False))
        rows = rows.where(hit)
    return rows


def append_trials(entries: DataFrame, path: str) -> None:
    """Append entries with an id and the UTC time."""
    stamped = entries.withColumns(
        {"id": F.expr("uuid()"), "at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")}
    )
    stamped.write.mode("append").json(path)
