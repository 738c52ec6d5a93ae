"""Incremental forms of the run, trace and build computations.

Sources are growing directories; every function takes and returns a streaming
DataFrame, so the caller chooses sink, trigger and checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.functions.records import is_run_id
from graphloom.operators.coverage import missing_chunks
from graphloom.operators.routing import off_route
from graphloom.plans.build import add_vectors
from graphloom.plans.progress import COUNTERS, STAGE_COUNTERS
from graphloom.session import checkpoint_root, kept_while
from graphloom.sources.runs import RECORD
from graphloom.sources.tables import TableStore


def tail_records(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Run records as they are appended to a directory of run files or to the records folder of a run store.

    Header lines and an unfinished last line hold no question and are passed over, as are invalid run ids.
    """
    reader = spark.readStream.schema(RECORD)
    lines = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(folder)
    return lines.where(F.col("question_id").isNotNull() & is_run_id(F.col("run_id")))


def tail_table(spark: SparkSession, folder: str, file_glob: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of one table as a stream; ``files_per_batch`` bounds a batch."""
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def latest_per_key(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest record per key (update or complete mode)."""
    rest = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def live_summary(answers: DataFrame) -> DataFrame:
    """Per-pipeline cost and reliability of a run still in progress.

    A median cannot be kept exactly in bounded state; its column says so.
    """
    ok = F.coalesce(F.col("status") != "error", F.lit(True))

    def answered(name: str) -> Column:
        return F.when(ok, F.col(name))

    return answers.groupBy("run_id", "pipeline").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~ok).alias("errors"),
        F.avg(answered("tokens_total")).alias("mean_tokens"),
        F.sum(answered("tokens_total")).alias("total_tokens"),
        F.avg(answered("latency_ms")).alias("mean_latency_ms"),
        F.percentile_approx(answered("tokens_total"), 0.5).alias("approx_median_tokens"),
    )


def _timeout(keep_ms: int | None) -> str:
    """Timers wake a running stream again and again; one that ends when its input does (``availableNow``) takes none."""
    return GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout


_STEPS = pa.schema([
    ("run_key", pa.dictionary(pa.int32(), pa.string())), ("order_no", pa.int64()), ("off_route", pa.bool_()), ("declared", pa.bool_()),
    ("tokens_in", pa.int64()), ("tokens_out", pa.int64()), ("seen_ms", pa.int64()),
])


def _packed(rows: list[tuple]) -> bytes:
    """Steps as compressed Arrow columns: a state store holds whole states in memory, of more than one version."""
    sink = pa.BufferOutputStream()
    columns = [pa.array(c, kind.value_type).dictionary_encode() if pa.types.is_dictionary(kind) else pa.array(c, kind)
               for c, kind in zip(zip(*rows, strict=True), _STEPS.types, strict=True)]
    with pa.ipc.new_stream(sink, _STEPS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.record_batch(columns, schema=_STEPS))
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> list[tuple]:
    table = pa.ipc.open_stream(bytes(packed)).read_all()
    return list(zip(*(c.to_pylist() for c in table.columns), strict=True))


def numbered_trace(steps: DataFrame, keep_ms: int | None = None, groups: int = 2_048) -> DataFrame:
    """Trace steps numbered, with running tokens and the first deviation flagged, in whatever order they arrive (append mode).

    ``steps``: run_key, order_no, route, path_name, declared, tokens_in, tokens_out. Runs share a state with the others of their hash,
    one of ``groups``: a call for each run would cost more than its few steps. State holds the runs' steps, packed, and those of a run go
    ``keep_ms`` after its last step where that is given. A group is held whole by a task: let ``groups`` grow with the steps. A step that arrives late takes its place, and it and the steps
    after it are emitted anew: write them to a table keyed by run_key and order_no.
    """
    marked = steps.withColumn("off_route", off_route(F.col("route"), F.col("path_name"))).select(
        F.pmod(F.xxhash64("run_key"), F.lit(groups)).alias("_group"),
        "run_key", "order_no", F.coalesce("off_route", F.lit(False)).alias("off_route"),
        F.coalesce("declared", F.lit(False)).alias("declared"), "tokens_in", "tokens_out",
    )
    kept = ["run_key", "order_no", "off_route", "declared", "tokens_in", "tokens_out"]
    out = (
        "run_key string, order_no long, step_n long, cum_tokens_in long, cum_tokens_out long, strategy_change boolean"
    )
    state_schema = "steps binary"

    def keep(rows: list[tuple], seen: dict[str, int], state: GroupState, now: int) -> None:
        if keep_ms:
            rows = [row for row in rows if seen[row[0]] + keep_ms > now]
        if not rows:
            state.remove()
            return
        state.update((_packed([(*row, seen[row[0]]) for row in rows]),))
        if keep_ms:
            state.setTimeoutDuration(max(1, min(seen[row[0]] for row in rows) + keep_ms - now))

    def advance(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs() if keep_ms else 0
        held = _unpacked(state.get[0]) if state.exists else []
        steps, seen = {row[:2]: row[:6] for row in held}, {row[0]: row[6] for row in held}
        if state.hasTimedOut:
            keep(list(steps.values()), seen, state, now)
            return
        # Plain rows cost less than frames where runs are short.
        since: dict[str, int] = {}
        for f in frames:
            for row in zip(*(f[c].tolist() for c in kept), strict=True):
                steps[row[:2]] = row
                since[row[0]] = min(row[1], since.get(row[0], row[1]))
        seen.update(dict.fromkeys(since, now))
        rows = [steps[k] for k in sorted(steps)]
        run, numbered = None, []
        for run_key, order_no, off, declared, tokens_in, tokens_out in rows:
            if run_key != run:
                run, n, spent_in, spent_out, deviated = run_key, 0, 0, 0, False
            n, spent_in, spent_out = n + 1, spent_in + int(tokens_in or 0), spent_out + int(tokens_out or 0)
            if run_key in since and order_no >= since[run_key]:
                numbered.append((run_key, order_no, n, spent_in, spent_out, bool(declared or off and not deviated)))
            deviated = deviated or bool(off)
        keep(rows, seen, state, now)
        yield pd.DataFrame(numbered, columns=["run_key", "order_no", "step_n", "cum_tokens_in", "cum_tokens_out", "strategy_change"])

    return marked.groupBy("_group").applyInPandasWithState(
        advance, out, state_schema, "append", _timeout(keep_ms)
    )


def token_ceiling(answers: DataFrame, cap: int) -> DataFrame:
    """Per run: tokens spent so far and whether a further question may start."""
    return answers.groupBy("run_id").agg(F.sum("tokens_total").alias("spent")).withColumn(
        "may_start", F.col("spent") < cap
    )


def stage_status(events: DataFrame) -> DataFrame:
    """Latest status per (build, stage)."""
    return events.groupBy("build_id", "stage").agg(
        F.max_by(F.struct("status", "items_done", "items_total"), "seq").alias("e"), F.min("seq").alias("first_seq")
    ).select("build_id", "stage", "first_seq", "e.*")


def pipeline_status(events: DataFrame) -> DataFrame:
    """Folded build events per (build, pipeline): ready sticks, counters keep their maximum."""
    counters = [
        F.coalesce(
            F.max(F.when(F.col("stage").isin([s for s, c in STAGE_COUNTERS.items() if c == name]), F.col("items_done"))),
            F.lit(0),
        ).alias(name)
        for name in COUNTERS
    ]
    return (
        events.withColumn("pipeline", F.explode("pipeline_affected"))
        .groupBy("build_id", "pipeline")
        .agg(
            F.bool_or(F.col("status") == "ready").alias("is_ready"),
            F.max_by(F.struct("status", "elapsed_ms", "items_done"), "seq").alias("l"),
            *counters,
        )
        .select(
            "build_id", "pipeline", F.when(F.col("is_ready"), "ready").otherwise(F.col("l.status")).alias("status"),
            F.col("l.elapsed_ms").alias("elapsed_ms"), F.col("l.items_done").alias("items_done"), *COUNTERS,
        )
    )


def unique_events(events: DataFrame, key: str, keep_ms: int | None = None) -> DataFrame:
    """Events once per id for as long as its state lives: where ``keep_ms`` is given, so long after the id was first let through.

    A repeat that comes later passes; a sink keyed by ``key`` that keeps the first row (``drain_merged`` with ``first``) leaves one.
    """
    if not keep_ms:
        return events.dropDuplicates([key])
    arrived = events.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", f"{keep_ms} milliseconds")
    return arrived.dropDuplicatesWithinWatermark([key]).drop("_arrived")


def drain_merged(
    stream: DataFrame, store: TableStore, name: str, keys: list[str], checkpoint: str, first: bool = False, partition_by: tuple[str, ...] = (),
    mode: str = "update",
) -> None:
    """Run a stream over everything available and merge what each batch emits into a keyed table.

    The last row of a key stays, or with ``first`` the first. A batch that is run again after a failure is published once, so the stream
    may be stopped and started with the same ``checkpoint`` at any time. The table's ``_batch`` orders the batches. A merge reads its rows
    more than once, so a batch is written first: each reading would run the stream's state through once more.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        order = store.version(name)
        rows = batch.withColumn("_batch", F.lit(-order if first else order).cast("long"))
        with kept_while(rows) as once:
            store.merge(name, once, keys, "_batch", partition_by, whole_rows=True, batch=(checkpoint, batch_id))

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def embed_stream(
    chunks: DataFrame, store: TableStore, known: DataFrame, model_key: str, dim: int, checkpoint: str,
    encoder: Callable[[list[str]], list[list[float]]] | None = None,
):
    """Embed arriving chunks batch by batch into the store's embedding and coverage tables.

    Each batch is appended as new files under its number; nothing stored is written again. Chunks the model covers are skipped,
    and a batch replayed after a failure is published once, so stopping and starting again only does what is missing.
    ``TableStore.compact`` merges the files of many batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        texts = batch.select(F.lit(model_key).alias("model_key"), "chunk_id", "text").dropDuplicates(["chunk_id"])
        if store.exists("coverage"):
            texts = missing_chunks(texts, store.read_partition("coverage", model_key), model_key)
        if not texts.isEmpty():
            add_vectors(store, texts, known, model_key, dim, encoder, (checkpoint, batch_id))

    return (
        chunks.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def drain(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """Run a stream over everything available and return the sink as a table.

    ``complete`` keeps the last full result, ``append`` every emitted row.
    """
    spark = stream.sparkSession
    root = folder or f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        part = f"{root}/out" if mode == "complete" else f"{root}/out/batch={batch_id}"
        batch.write.mode("overwrite").parquet(part)

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out").select(*stream.columns)
