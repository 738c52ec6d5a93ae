"""Sinks, streams over growing folders, running totals."""

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from graphloom.operators import coverage as cov
from graphloom.operators import scoring as sc
from graphloom.plans import reports as rp
from graphloom.plans.catalog import stores
from graphloom.session import checkpoint_root
from graphloom.sources import runs as rf
from graphloom.sources import trials as tr
from graphloom.sources.tables import TableStore
from graphloom.streaming import live
from tests.test_retrieval import record


def test_append_and_export(spark, tmp_path):
    records = spark.createDataFrame([(record("q1", "done", 3),)], "value string").select(F.from_json("value", rf.RECORD).alias("r")).select("r.*")
    configs = spark.createDataFrame([("r1", "d")], "run_id string, dataset string")
    for _ in range(2):
        rf.append_run(records, configs, str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs" / "records")).count() == 2
    rf.write_export(records, configs, str(tmp_path / "export"))
    for folder in ("runs", "export"):
        back = rf.read_store(spark, str(tmp_path / folder)).collect()
        assert [(r["run_id"], r["question_id"], r["ground_truth"], r["record"]["pipelines"]["rag"]["tokens"]["total"]) for r in back] == [("r1", "q1", ["a"], 3)]
        assert rf.read_store_headers(spark, str(tmp_path / folder)).first()["run_config"]["dataset"] == "d"
    assert live.drain(live.tail_records(spark, str(tmp_path / "runs" / "records")), "append", str(tmp_path / "tail")).count() == 2
    row = spark.read.json(str(tmp_path / "export" / "questions")).first()
    assert row["qid"] == "q1" and row["pipelines"]["rag"]["answer"] == "a"


def test_records_are_chosen_as_text_after_one_shuffle(spark, tmp_path):
    """Rows of a store are neither parsed nor sorted before the shuffle; the last one is parsed and is the same."""
    lines = [(record("q1", "done", 3),), (record("q2", "error", 5),)]
    records = spark.createDataFrame(lines, "value string").select(F.from_json("value", rf.RECORD).alias("r")).select("r.*")
    configs = spark.createDataFrame([("r1", "d")], "run_id string, dataset string")
    pipelines = F.transform_values("record.pipelines", lambda k, p: p.withField("answer", F.lit("old")).withField("latency_ms", F.lit(1.05)))
    for rows in (records.withColumn("record", F.col("record").withField("pipelines", pipelines)), records):
        rf.append_run(rows, configs, str(tmp_path))
    back = rf.read_store(spark, str(tmp_path))
    assert back.schema.simpleString() == records.select(*back.columns).schema.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, records.select(*back.columns).collect()))
    above, below = rf.read_store(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().split("REPARTITION_BY_COL")
    assert "max_by" in above and "from_json" in above and "max_by" not in below and "from_json" not in below and "get_json_object(record" in below


def test_questions_and_trials(spark, tmp_path):
    path = tmp_path / "questions.jsonl"
    path.write_text(json.dumps({"qid": "a", "question": "?", "answer": ["x"]}) + "\n\n")
    assert rf.read_questions(spark, str(path)).first()["answer"] == ["x"]
    tr.append_trials(spark.createDataFrame([("build", "done")], "kind string, status string"), str(tmp_path / "trials"))
    assert tr.read_trials(spark, str(tmp_path / "trials")).where("id is not null and kind = 'build'").count() == 1


def test_tail_records(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"run_config": {"dataset": "d"}}\n' + record("q1", "done", 3) + '\n{"run_id": "r1", "questi')
    stream = lambda: live.tail_records(spark, str(folder)).select("run_id", "question_id")
    assert live.drain(stream(), "append", str(tmp_path / "s")).count() == 1
    (folder / "b.json").write_text(record("q2", "done", 3) + "\n")
    assert {r["question_id"] for r in live.drain(stream(), "append", str(tmp_path / "s")).collect()} == {"q1", "q2"}


def test_embed_stream_resumes(spark, tmp_path):
    schema = "chunk_id string, text string"
    src, store = tmp_path / "chunks", TableStore(spark, str(tmp_path / "store"))
    for batch in (["a", "b"], ["c"]):
        spark.createDataFrame([(c, f"text {c}") for c in batch], schema).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        live.embed_stream(stream, store, cov.models(spark), "gte-large-en-v1.5", 8, str(tmp_path / "cp")).awaitTermination()
    parts = store.read("embedding")
    assert sorted(r["chunk_id"] for r in parts.collect()) == ["a", "b", "c"]
    assert parts.where(F.size("emb") != 8).count() == 0


def test_many_runs_share_a_state_and_a_late_step_takes_its_place(spark, tmp_path):
    schema = "run_key string, order_no long, route string, path_name string, declared boolean, tokens_in long, tokens_out long"
    step = lambda run, i: (run, i, "loop", "elsewhere", False, i, 1)
    arriving = [[step(f"r{r}", i) for r in range(20) for i in (1, 3)], [step(f"r{r}", 2) for r in range(10)]]
    for n, rows in enumerate(arriving):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        trace = live.numbered_trace(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), groups=3)
        out = live.drain(trace, "append", str(tmp_path / "run")).collect()
    got = sorted({(r["run_key"], r["order_no"]): (r["run_key"], r["order_no"], r["step_n"], r["cum_tokens_in"], r["strategy_change"])
                  for r in sorted(out, key=lambda r: r["step_n"])}.values())
    want = [(f"r{r}", i, n, s, n == 1) for r in range(20) for n, (i, s) in enumerate(((1, 1), (2, 3), (3, 6)) if r < 10 else ((1, 1), (3, 4)), 1)]
    assert got == sorted(want)


def test_steps_in_a_state_are_packed():
    rows = [(f"1-URGENT|q{k // 4}", k % 4 * 10**14 + k * 7919, k % 3 == 0, k % 5 == 0, k % 50, k % 49, 0) for k in range(10_000)]
    packed = live._packed(rows)
    assert live._unpacked(packed) == rows and len(packed) < 20 * len(rows)  # as plain columns some 70 bytes a step


def test_a_batch_is_computed_once(spark, tmp_path):
    """However often the merge reads its rows; the folder they were written to is gone again."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    spark.range(50).write.parquet(str(tmp_path / "in"))
    held = lambda: {p.name for p in pathlib.Path(checkpoint_root(spark).removeprefix("file:")).glob("kept-*")}
    before, store = held(), TableStore(spark, str(tmp_path / "store"), buckets=2)
    live.drain_merged(spark.readStream.schema("id long").parquet(str(tmp_path / "in")).mapInArrow(counted, "id long"), store, "out", ["id"], str(tmp_path / "cp"), mode="append")
    assert store.read("out").count() == 50 and made.value == 50 and held() == before


def test_parts_of_a_rebuilt_corpus_grow_with_its_pages(spark, monkeypatch):
    """A part is written by one task."""

    class Seen(Exception):
        pass

    def store(spark, root, buckets):
        raise Seen(buckets)

    monkeypatch.setattr(stores, "TableStore", store)
    monkeypatch.setattr(stores, "PAGES_PER_PART", 100)
    with pytest.raises(Seen, match="19"):  # 1,500 orders
        stores._rebuild(spark, "/root/testdata/sf0.001")


def test_cuts_of_a_running_total_are_made_once(spark):
    rows = spark.range(1000).selectExpr("id % 2 AS k", "id AS o", "id % 7 AS v")
    assert "percentile_approx" not in rp.running_total(rows, "k", "o", "v", ranges=16)._jdf.queryExecution().optimizedPlan().toString()


def test_running_total_is_exact(spark):
    rows = [("hot", i, i % 7) for i in range(500)] + [("cold", 3, 5), ("cold", 9, 1)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {(r["k"], r["o"]): r["total_before"] for r in rp.running_total(df, "k", "o", "v", ranges=16).collect()}
    want, spent = {}, {}
    for k, o, v in sorted(rows):
        want[(k, o)] = spent.get(k, 0)
        spent[k] = spent.get(k, 0) + v
    assert got == want


def test_streamed_embeddings_join_the_store(spark, tmp_path):
    store, known = TableStore(spark, str(tmp_path / "store")), cov.models(spark)
    key = known.first()["model_key"]
    chunks = lambda ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "chunk_id string, text string")
    for n, ids in enumerate((["a", "b"], ["b", "c"], ["c", "d"])):
        chunks(ids).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("chunk_id string, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        live.embed_stream(stream, store, known, key, 8, str(tmp_path / "check")).awaitTermination()
    rows = store.read("embedding").collect()
    assert sorted(r["chunk_id"] for r in rows) == ["a", "b", "c", "d"] and {len(r["emb"]) for r in rows} == {8}
    assert store.read("coverage").count() == 4


def test_answers_that_share_their_evidence_score_the_same(spark):
    cites, none = [("d1", "Lima and Rome"), ("d2", "Oslo")], None
    schema = "qid int, answers array<string>, ground_truth array<string>, gold_doc_ids array<string>, citations array<struct<source_id:string,snippet:string>>"
    asked = spark.createDataFrame([(1, ["Lima", "Oslo and Bern", ""], ["Lima"], ["d2"], cites), (2, ["7", "x"], none, none, none)], schema)
    spread = lambda df: df.withColumn("answer", F.explode("answers")).drop("answers")
    scored = lambda df: sorted(map(tuple, df.select("qid", "answer", *sc.METRICS).collect()))
    assert scored(sc.score_answers(spread(sc.with_evidence(asked)))) == scored(sc.score_answers(spread(asked)))
