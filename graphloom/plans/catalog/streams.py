"""Streaming queries; the batch result over the same table is what they must reach."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import coverage as cov
from graphloom.plans import build
from graphloom.plans.catalog import query
from graphloom.plans.catalog.runs import _NUMBERED, _PIPED, run_lines
from graphloom.plans.catalog.sql import ANSWERS, BUILD, SCOPES
from graphloom.plans.world import World
from graphloom.session import checkpoint_root
from graphloom.sources.tables import TableStore
from graphloom.streaming import live


ROWS_PER_BATCH_FILE = 500_000
ORDERS_PER_RUN_FILE = 100_000
STEPS_PER_GROUP = 20_000


class StreamWorld(World):
    """The same mappings with one table read as a stream, some files per batch."""

    def __init__(self, spark: SparkSession, sf_dir: str, streamed: str, folder: str, files: int = 1) -> None:
        super().__init__(spark, sf_dir)
        self.streamed, self.folder, self.files = streamed, folder, files

    def table(self, name: str) -> DataFrame:
        if name == self.streamed:
            return live.tail_table(self.spark, self.folder, "*.parquet", self.files)
        return super().table(name)


def fed(
    spark: SparkSession, sf: str, name: str, stream: Callable[[StreamWorld], DataFrame], keys: list[str], first: bool = False,
    change: Callable[[DataFrame, int], DataFrame] = lambda df, half: df, forgets: bool = False, mode: str = "update",
) -> DataFrame:
    """The table that a stream over a growing folder leaves: two batches of files arrive, the stream runs and ends; two more, and it is started again.

    A batch has as many files, and the table as many buckets, as the rows need. Rows are dealt to the files by a hash, so they arrive out of order. With ``forgets`` all state has expired when it is started again, and
    every file is read once more.
    """
    root = f"{checkpoint_root(spark)}/feed-{uuid.uuid4().hex}"
    table = World(spark, sf).table(name)
    files = table.count() // ROWS_PER_BATCH_FILE + 1
    store = TableStore(spark, f"{root}/store", buckets=files + 3)
    for half in range(2):
        arriving = change(table.where(F.pmod(F.xxhash64(*table.columns), F.lit(2)) == half), half)
        arriving.repartition(2 * files, F.xxhash64(*table.columns)).write.mode("append").parquet(f"{root}/in")
        rows = stream(StreamWorld(spark, sf, name, f"{root}/in", files))
        live.drain_merged(rows, store, "out", keys, f"{root}/checkpoint{half * forgets}", first, mode=mode)
    return store.read("out")


@query(
    "str2_latest_record",
    "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id",
)
def _latest(spark: SparkSession, sf: str) -> DataFrame:
    def latest(w: StreamWorld) -> DataFrame:
        return live.latest_per_key(w.table("events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")

    return fed(spark, sf, "events", latest, ["user_id"]).select("user_id", "event_type", "event_id")


@query(
    "str3_live_summary",
    f"""WITH {SCOPES} SELECT replace(o_orderpriority, ' ', '_') AS run_id, n_name AS pipeline, count(*) AS n,
      count(*) FILTER (o_orderstatus = 'P') AS errors, round(avg(o_orderkey) FILTER (o_orderstatus <> 'P'), 4) AS mean_tokens,
      sum(o_orderkey) FILTER (o_orderstatus <> 'P')::BIGINT AS total_tokens,
      round(avg(o_totalprice) FILTER (o_orderstatus <> 'P'), 4) AS mean_latency_ms FROM scopes GROUP BY ALL""",
)
def _summary(spark: SparkSession, sf: str) -> DataFrame:
    def summary(w: StreamWorld) -> DataFrame:
        return live.live_summary(
            w.scopes().select(
                F.replace(F.col("o_orderpriority"), F.lit(" "), F.lit("_")).alias("run_id"), F.col("n_name").alias("pipeline"),
                F.when(F.col("o_orderstatus") == "P", "error").otherwise("done").alias("status"),
                F.col("o_orderkey").alias("tokens_total"), F.col("o_totalprice").alias("latency_ms"),
            )
        )

    out = fed(spark, sf, "orders", summary, ["run_id", "pipeline"])
    return out.select(
        "run_id", "pipeline", "n", "errors", F.round("mean_tokens", 4).alias("mean_tokens"), "total_tokens",
        F.round("mean_latency_ms", 4).alias("mean_latency_ms"),
    )


@query(
    "str4_numbered_trace",
    f"""WITH {_NUMBERED} SELECT run_id || '|' || qid AS run_key, seq AS order_no, step_n, cum_in::BIGINT AS cum_tokens_in,
      cum_out::BIGINT AS cum_tokens_out, strategy_change FROM numbered""",
)
def _trace(spark: SparkSession, sf: str) -> DataFrame:
    """Steps of a run lie in several files and arrive out of order."""
    groups = World(spark, sf).table("lineitem").count() // STEPS_PER_GROUP + 64

    def numbered(w: StreamWorld) -> DataFrame:
        return live.numbered_trace(
            w.steps().select(
                F.concat_ws("|", "run_id", "qid").alias("run_key"), F.col("seq").alias("order_no"), "route", "path_name", "declared",
                "tokens_in", "tokens_out",
            ),
            groups=groups,
        )

    return fed(spark, sf, "lineitem", numbered, ["run_key", "order_no"], mode="append").drop("_batch")


@query(
    "str5_stage_status",
    f"""WITH {BUILD} SELECT build_id, stage, min(seq) AS first_seq, arg_max(status, seq) AS status, arg_max(items_done, seq) AS items_done
    FROM build GROUP BY build_id, stage""",
)
def _stages(spark: SparkSession, sf: str) -> DataFrame:
    out = fed(spark, sf, "events", lambda w: live.stage_status(w.build_events()), ["build_id", "stage"])
    return out.select("build_id", "stage", "first_seq", "status", "items_done")


@query(
    "str7_token_ceiling",
    """SELECT o_orderpriority AS run_id, sum(o_custkey)::BIGINT AS spent, sum(o_custkey) < 2300000 AS may_start FROM orders GROUP BY 1""",
)
def _ceiling(spark: SparkSession, sf: str) -> DataFrame:
    def ceiling(w: StreamWorld) -> DataFrame:
        answers = w.table("orders").select(F.col("o_orderpriority").alias("run_id"), F.col("o_custkey").alias("tokens_total"))
        return live.token_ceiling(answers, 2_300_000)

    return fed(spark, sf, "orders", ceiling, ["run_id"]).drop("_batch")


@query("str8_unique_events", "SELECT event_id, user_id, 'first' AS copy FROM events")
def _unique(spark: SparkSession, sf: str) -> DataFrame:
    """Every event comes twice in its file, and half of them, changed, and all first files again after the state of their ids has expired."""

    def copies(df: DataFrame, half: int) -> DataFrame:
        twice = df.withColumn("copy", F.lit("first")).withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_n")
        late = World(spark, sf).table("events").where(F.pmod(F.xxhash64(*df.columns), F.lit(2)) == 0).withColumn("copy", F.lit("late"))
        return twice.unionByName(late) if half else twice

    def unique(w: StreamWorld) -> DataFrame:
        return live.unique_events(w.table("events").select("event_id", "user_id", "copy"), "event_id")

    return fed(spark, sf, "events", unique, ["event_id"], first=True, change=copies, forgets=True).drop("_batch")


@query(
    "str6_embed_stream",
    """WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents),
    r AS (SELECT doc_id, list_transform(range(0, 64), lambda i: ('0x' || substr(h, ((i % 32) * 2 + 1)::INT, 2))::INT / 255.0::DOUBLE * 2 - 1) AS raw FROM h),
    u AS (SELECT doc_id, list_transform(raw, lambda x: (x / sqrt(list_inner_product(raw, raw)))::FLOAT::DOUBLE) AS unit FROM r)
    SELECT 'd' || doc_id AS chunk_id, 1::BIGINT AS n, true AS covered, 64 AS dim,
      round(list_inner_product(unit, list_transform(range(1, 65), lambda i: i::DOUBLE)), 2) + 0.0::DOUBLE AS weighted FROM u""",
)
def _embed(spark: SparkSession, sf: str) -> DataFrame:
    """Four batches over two runs of the stream; the third batch's files are offered again, as after a crash, and add nothing."""
    root = f"{checkpoint_root(spark)}/feed-{uuid.uuid4().hex}"
    store, known, model = TableStore(spark, f"{root}/store", buckets=4), cov.models(spark), "gte-large-en-v1.5"
    chunks = World(spark, sf).chunk_source().select(F.col("doc_id").alias("chunk_id"), "text")
    for half in range(2):
        part = chunks.where(F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == half)
        part.repartition(2).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        live.embed_stream(stream, store, known, model, 64, f"{root}/checkpoint").awaitTermination()
    again = chunks.where(F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == 1).select(F.lit(model).alias("model_key"), "chunk_id", "text")
    build.add_vectors(store, again, known, model, 64, batch=(f"{root}/checkpoint", 3))
    weights = F.transform("emb", lambda x, i: x.cast("double") * (i + 1))
    vectors = store.read_partition("embedding", model).groupBy("chunk_id").agg(F.count("*").alias("n"), F.first("emb").alias("emb"))
    covered = store.read_partition("coverage", model).select("chunk_id", F.lit(True).alias("covered"))
    return vectors.join(covered, "chunk_id", "left").select(
        "chunk_id", "n", F.coalesce("covered", F.lit(False)).alias("covered"), F.size("emb").alias("dim"),
        F.round(F.aggregate(weights, F.lit(0.0), lambda s, x: s + x), 2).alias("weighted"),
    )


@query("str1_tail_records", f"WITH {ANSWERS} SELECT DISTINCT run_id, qid AS question_id, true AS live FROM answers")
def _tail(spark: SparkSession, sf: str) -> DataFrame:
    """Native run files, headers and repeated questions among their lines, written in two goes; one ends in a torn line."""
    root = f"{checkpoint_root(spark)}/feed-{uuid.uuid4().hex}"
    w = World(spark, sf)
    files = w.table("orders").count() // ORDERS_PER_RUN_FILE + 1
    store, lines = TableStore(spark, f"{root}/store", buckets=files + 3), run_lines(w).select("value")
    torn = spark.createDataFrame([('{"run_id": "torn", "questi',)], "value string")
    for half in range(2):
        part = lines.where(F.pmod(F.xxhash64("value"), F.lit(2)) == half)
        (part.union(torn) if half else part).repartition(2 * files).write.mode("append").text(f"{root}/in")
        records = live.tail_records(spark, f"{root}/in", files).select("run_id", "question_id", F.lit(True).alias("live"))
        live.drain_merged(records, store, "out", ["run_id", "question_id"], f"{root}/checkpoint")
    return store.read("out").drop("_batch")


@query(
    "str9_live_pipeline_states",
    f"""WITH {_PIPED} SELECT build_id, pipeline, CASE WHEN bool_or(status = 'ready') THEN 'ready' ELSE arg_max(status, seq) END AS status,
      arg_max(elapsed_ms, seq) AS elapsed_ms, coalesce(max(items_done) FILTER (stage = 'embed_chunks'), 0) AS vectors FROM piped GROUP BY ALL""",
)
def _states(spark: SparkSession, sf: str) -> DataFrame:
    out = fed(spark, sf, "events", lambda w: live.pipeline_status(w.build_events()), ["build_id", "pipeline"])
    return out.select("build_id", "pipeline", "status", "elapsed_ms", "vectors")
