"""Retrieval, linking, similarity, run files and streaming against small brute-force expectations."""

import json

import numpy as np
from pyspark.sql import functions as F

from graphloom.operators import linking as lk
from graphloom.operators import retrieval as rt
from graphloom.operators import similarity as sim
from graphloom.plans import reports as rp
from graphloom.sources import runs as rf
from graphloom.sources import trials as tr
from graphloom.streaming import live

EVENT = (
    "event_id string, event_name string, doc_id string, title string, sport string, games string, venue string, "
    "competitors int, nations int, date_year int, parse_confidence double"
)


def events(spark):
    rows = [
        ("a-2008-Summer-x", "X", "D1", "T1", "A", "2008-Summer", "Hall", 10, 3, 2008, 1.0),
        ("a-2012-Summer-x", "X", "D2", "T2", "A", "2012-Summer", "Hall", None, 5, 2012, 1.0),
        ("b-2012-Summer-y", "Y", "D3", "T3", "B", "2012-Summer", "Pool", 30, 9, 2012, 0.8),
    ]
    return spark.createDataFrame(rows, EVENT)


def ask(spark, *rows):
    return spark.createDataFrame(rows, "qid string, sport string, games string, venue string, c string, field string").withColumn(
        "constraints", rt.decode_constraints(F.col("c"))
    )


def test_count_rules(spark):
    q = ask(
        spark,
        ("all", None, "", None, "[]", ""),
        ("zero", "A", None, None, '[{"field":"competitors","op":"<","value":11}]', ""),
        ("unknown field", None, None, None, '[{"field":"gold","op":">","value":1}]', ""),
        ("unknown op", None, None, None, '[{"field":"nations","op":"~","value":1}]', ""),
        ("a third counts, too", None, None, None,
         '[{"field":"nations","op":">","value":1},{"field":"nations","op":">","value":2},{"field":"nations","op":">","value":99}]', ""),
        ("nothing", "C", None, None, "[]", ""),
    )
    got = {r["qid"]: (r["count_value"], r["excluded_count"]) for r in rt.count_where(q, events(spark)).collect()}
    assert got == {
        "all": (2, 1), "zero": (2, 0), "unknown field": (0, 0), "unknown op": (2, 1), "a third counts, too": (0, 0), "nothing": (0, 0),
    }
    strict = {r["qid"]: r["count_value"] for r in rt.count_where(q, events(spark), missing="null").collect()}
    assert strict["zero"] == 1


def test_argmax_and_lookup(spark):
    q = ask(spark, ("n", None, "2012-Summer", None, "[]", "nations"), ("c", "A", None, None, "[]", "gold"))
    got = [(r["qid"], r["rank"], r["event_id"]) for r in rt.argmax(q, events(spark)).orderBy("qid", "rank").collect()]
    assert got == [("c", 1, "a-2008-Summer-x"), ("c", 2, "a-2012-Summer-x"), ("n", 1, "b-2012-Summer-y"), ("n", 2, "a-2012-Summer-x")]
    pages = spark.createDataFrame([("D9", "Lonely page")], "doc_id string, title string")
    asked = spark.createDataFrame(
        [("1", "b-2012-Summer-y", "X"), ("2", "", "X"), ("3", None, "T3"), ("4", None, "Lonely page"), ("5", None, None)],
        "qid string, event_id string, title string",
    )
    found = sorted((r["qid"], r["doc_id"]) for r in rt.lookup(asked, events(spark), pages).collect())
    assert found == [("1", "D3"), ("2", "D1"), ("2", "D2"), ("3", "D3"), ("4", "D9")]


def test_walk_ends_where_it_is_asked_to(spark):
    edges = spark.createDataFrame([("PREV_EDITION", str(i), str(i - 1)) for i in range(1, 15)], "etype string, src string, dst string")
    starts = spark.createDataFrame(
        [("zero", "9", 0, ""), ("two", "9", 2, "OTHER"), ("many", "14", 50, "PREV_EDITION"), ("off", "2", 5, "PREV_EDITION")],
        "qid string, event_id string, hops int, edge_type string",
    )
    got = {r["qid"]: r["event_id"] for r in rt.edition_walk(starts, edges).collect()}
    assert got == {"zero": "9", "two": "7"}  # 50 hops back from 14 there is no edition


def test_linking_tiers(spark):
    vocab = spark.createDataFrame([(v,) for v in ("Athletics", "Short-track speed skating", "Speed skating", "Swimming", "Synchronized swimming")], "entry string")
    asked = spark.createDataFrame([(q,) for q in ("speed skating", "the athletics events", "synchronized", "zzz")], "query string")
    got = {r["query"]: (r["entry"], r["tier"]) for r in lk.link_vocabulary(asked, vocab).collect()}
    assert got == {
        "speed skating": ("Speed skating", "exact"), "the athletics events": ("Athletics", "contained"),
        "synchronized": ("Synchronized swimming", "container"),
    }
    venues = spark.createDataFrame([("Olympic Oval",), ("Richmond Olympic Oval",), ("Riocentro",), ("Riocentro – Pavilion 6",)], "entry string")
    text = spark.createDataFrame([("1", "Who won at Richmond Olympic Oval?"), ("2", "At Riocentro – Pavilion 6, who?"), ("3", "Riocentros")], "qid string, question string")
    assert {r["qid"]: r["entry"] for r in lk.longest_mention(text, venues).collect()} == {"1": "Richmond Olympic Oval", "2": "Riocentro – Pavilion 6"}
    found = {r["query"]: (r["venue"], r["candidates"]) for r in lk.resolve_venues(
        spark.createDataFrame([("Oval",), ("Riocentro",), ("Richmond",)], "query string"), venues).collect()}
    assert found == {"Oval": (None, 2), "Riocentro": ("Riocentro", 2), "Richmond": ("Richmond Olympic Oval", 1)}


def test_topk_plans_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data, asked = rng.normal(size=(300, 8)), rng.normal(size=(20, 8))
    vectors = spark.createDataFrame([(f"v{i}", list(map(float, v))) for i, v in enumerate(data)], "chunk_id string, emb array<float>")
    queries = spark.createDataFrame([(f"q{i}", list(map(float, v))) for i, v in enumerate(asked)], "qid string, vector array<double>")
    unit = data.astype(np.float32) / np.linalg.norm(data.astype(np.float32), axis=1, keepdims=True)
    want = {f"q{i}": [f"v{j}" for j in np.argsort(-(unit @ q))[:5]] for i, q in enumerate(asked)}

    def collect(df):
        out = {}
        for r in df.orderBy("qid", "rank").collect():
            out.setdefault(r["qid"], []).append(r["chunk_id"])
        return out

    assert collect(sim.topk_cosine(queries, vectors, 5)) == want
    monkeypatch.setattr(sim, "QUERY_BLOCK", 7)
    monkeypatch.setattr(sim, "VECTOR_BLOCK", 90)
    assert collect(sim.topk_cosine(queries, vectors, 5)) == want
    centres = sim.train_cells(vectors, 6)
    celled = sim.assign_cells(vectors, centres)
    assert collect(sim.topk_cells(queries, celled, centres, 5, nprobe=6)) == want
    few = collect(sim.topk_cells(queries, celled, centres, 5, nprobe=3))
    hit = sum(len(set(few[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))
    assert hit > 0.5


def record(qid, status, total, answer="a"):
    pipe = {"pipeline": "rag", "answer": answer, "status": status, "tokens": {"input": 1, "output": 1, "total": total}, "latency_ms": 1.0}
    return json.dumps({"run_id": "r1", "question_id": qid, "question_text": qid, "qtype": "lookup", "ground_truth": ["a"],
                       "record": {"query_id": qid, "timestamp": "2024", "pipelines": {"rag": pipe}}})


def test_run_files(spark, tmp_path):
    head = json.dumps({"run_config": {"dataset": "d", "started_at": "2024-05-01"}})
    (tmp_path / "r1.jsonl").write_text("\n".join([head, record("q1", "error", 5), record("q2", "done", 7), record("q1", "done", 9)]) + '\n{"torn')
    (tmp_path / "history.jsonl").write_text(head + "\n" + record("q1", "done", 1) + "\n")
    (tmp_path / "broken.jsonl").write_text(head + "\n{bad\n" + record("q1", "done", 1) + "\n")
    (tmp_path / "chunks2.jsonl").write_text(record("q1", "done", 1) + "\n")
    lines = rf.read_lines(spark, str(tmp_path))
    rows = {(r["run_id"], r["question_id"]): r["record"]["pipelines"]["rag"]["tokens"]["total"] for r in rf.read_records(lines).collect()}
    assert rows == {("r1", "q1"): 9, ("r1", "q2"): 7}
    assert [r["run_id"] for r in rf.corrupt_lines(lines).collect()] == ["broken"]
    records = rf.read_records(lines)
    written = rf.written_questions(records)
    asked = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "qid string")
    assert [r["qid"] for r in rf.pending_questions(asked, written).collect()] == ["q3"]
    listing = rp.list_runs(rf.run_answers(records), rf.run_headers(lines)).where("run_id = 'r1'").first()
    assert (listing["started_at"], listing["n_questions"], listing["scored"]) == ("2024-05-01", 2, True)


def test_lines_are_read_twice_and_never_dealt_by_file(spark, tmp_path):
    """One file may hold most lines; records without a question stay each by itself."""
    head = json.dumps({"run_config": {"dataset": "d"}})
    (tmp_path / "r1.jsonl").write_text("\n".join([head, record("q1", "done", 3), record("", "done", 4), record("", "done", 5)]))
    (tmp_path / "r2.jsonl").write_text("\n".join([json.dumps({"a": "run_config"}), head, record("q1", "done", 6)]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        records = rf.read_records(rf.read_lines(spark, str(tmp_path)))
        plan = records._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["run_id"], r["record"]["pipelines"]["rag"]["tokens"]["total"]) for r in records.collect()) == [("r1", 3), ("r1", 4), ("r1", 5)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and plan.count("FileScan text") == 2


def test_secret_guard(spark):
    clean = spark.createDataFrame([("fine",)], "t string")
    rf.assert_no_secret(clean)
    for value, literals in (("hf_" + "a" * 31, ()), ("my passphrase here", ("passphrase",))):
        try:
            rf.assert_no_secret(spark.createDataFrame([(value,)], "t string"), literals)
        except ValueError:
            continue
        raise AssertionError(value)


def test_trials(spark, tmp_path):
    lines = ['{"id":"1","at":"2024-01-01","kind":"query","status":"done","subject":"Rowing","x":{"y":1}}', "{torn",
             '{"id":"2","at":"2024-01-02","kind":"build","status":"error","error":"Timeout"}']
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    t = tr.read_trials(spark, str(tmp_path))
    assert [r["id"] for r in tr.newest(t).collect()] == ["2", "1"]
    assert [r["id"] for r in tr.newest(t, "query", 5).collect()] == ["1"]
    assert [r["id"] for r in tr.visible(t, status="error", search=" timeOUT ").collect()] == ["2"]


def test_stream_reaches_the_batch_result(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("r", i, "loop", "lookup" if i % 3 else "elsewhere", False, i, 1) for i in range(1, 8)]
    schema = "run_key string, order_no long, route string, path_name string, declared boolean, tokens_in long, tokens_out long"
    spark.createDataFrame(rows[:4], schema).coalesce(1).write.parquet(str(src))
    first = live.drain(live.numbered_trace(spark.readStream.schema(schema).parquet(str(src))), "append", str(tmp_path / "s"))
    assert first.count() == 4
    spark.createDataFrame(rows[4:], schema).coalesce(1).write.mode("append").parquet(str(src))
    out = live.drain(live.numbered_trace(spark.readStream.schema(schema).parquet(str(src))), "append", str(tmp_path / "s"))
    got = [(r["step_n"], r["cum_tokens_in"], r["strategy_change"]) for r in out.orderBy("step_n").collect()]
    assert got == [(i, sum(range(1, i + 1)), i == 3) for i in range(1, 8)]


def test_every_constraint_counts_and_hops_are_walked_as_asked(spark):
    events = spark.createDataFrame(
        [("e1", "n", "d1", "t", "S", "G", "V", 5, 3, 2000, 1.0)],
        "event_id string, event_name string, doc_id string, title string, sport string, games string, venue string, competitors int, nations int, date_year int, parse_confidence double",
    )
    three = [("competitors", ">", 1.0), ("nations", ">", 1.0), ("date_year", "=", 1999.0)]
    schema = "qid string, sport string, games string, venue string, constraints array<struct<field:string,op:string,value:double>>"
    asked = spark.createDataFrame([("q", "", "", "", three), ("p", "", "", "", three[:2])], schema)
    assert {r["qid"]: r["count_value"] for r in rt.count_where(asked, events).collect()} == {"q": 0, "p": 1}
    edges = spark.createDataFrame([("PREV_EDITION", f"e{i}", f"e{i + 1}") for i in range(15)], "etype string, src string, dst string")
    starts = spark.createDataFrame([(f"h{h}", "e0", h, None) for h in (0, 1, 2, 12, 20)], "qid string, event_id string, hops int, edge_type string")
    assert {r["qid"]: r["event_id"] for r in rt.edition_walk(starts, edges).collect()} == {"h0": "e0", "h1": "e1", "h2": "e2", "h12": "e12"}


def test_a_dated_event_beyond_the_eightieth_is_found(spark):
    rows = [(f"rowing-2012-Summer-{i:03d}", "n", f"d{i}", "t", "V", "rowing", "2012-Summer", 2012, 8, 3 if i == 99 else 9, None, "") for i in range(100)]
    schema = (
        "event_id string, event_name string, doc_id string, title string, venue string, sport string, games string, date_year int, date_month int, date_day_start int, "
        "date_day_end int, date_text string"
    )
    asked = spark.createDataFrame(
        [("q", "V", "2012-Summer", "rowing", "which?", 2012, 8, 3, None)],
        "qid string, venue string, games string, sport string, question string, date_year int, date_month int, date_day_start int, target_field string",
    )
    assert [r["event_id"] for r in rt.venue_events(asked, spark.createDataFrame(rows, schema)).collect()] == ["rowing-2012-Summer-099"]


def test_late_events_are_kept_and_repeats_dropped(spark, tmp_path):
    for i, row in enumerate([(1, "2024-05-09 00:00:00"), (2, "2024-05-01 00:00:00"), (3, "2024-05-02 00:00:00"), (2, "2024-05-01 00:00:00")]):
        spark.createDataFrame([row], "event_id long, ts string").write.parquet(f"{tmp_path}/in/part{i}")
    stream = spark.readStream.schema("event_id long, ts string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = live.drain(live.unique_events(stream, "event_id"), "append", str(tmp_path / "run"))
    assert sorted(r["event_id"] for r in out.collect()) == [1, 2, 3]


def test_counted_members_match_brute_force(spark):
    """NULL and empty anchors, missing figures, constraints that fail, a limit cut at the finest scopes first."""
    rows = [
        (f"e{i:03d}", "race", f"d{i}", "t", ["rowing", "chess", "", None][i % 4], ["g1", "g2"][i % 2], ["hall", None, ""][i % 3],
         [10, 20, None][i % 3], 1990 + i % 2, i % 5, 0.95 if i % 7 else 0.5)
        for i in range(200)
    ]
    cols = "event_id string, event_name string, doc_id string, title string, sport string, games string, venue string, competitors int, date_year int, nations int, parse_confidence double"
    events = spark.createDataFrame(rows, cols)
    asked = [
        ("a", None, None, None, []), ("b", "rowing", "", None, [("competitors", ">", 5.0)]), ("c", None, "g2", "hall", []), ("d", "chess", None, None, [("nations", "<=", 2.0), ("date_year", "=", 1991.0)]),
        ("e", "none", None, None, []), ("f", None, None, None, [("competitors", "=", 0.0)]), ("g", None, None, None, []),
    ]
    questions = spark.createDataFrame(asked, f"qid string, sport string, games string, venue string, constraints {rt.CONSTRAINTS}")
    tests = {">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b}

    def expected(limit):
        out = []
        for qid, sport, games, venue, limits in asked:
            fits = [
                r for r in rows
                if r[10] >= 0.9 and all(not want or have == want for want, have in zip((sport, games, venue), r[4:7]))
                and all(tests[op]({"competitors": r[7], "date_year": r[8], "nations": r[9]}[f] or 0, v) for f, op, v in limits)
            ]
            out += [(qid, r[0]) for r in sorted(fits)[:limit]]
        return sorted(out)

    for limit in (None, 3, 30, 1000):
        got = sorted((r["qid"], r["event_id"]) for r in rt.count_members(questions, events, limit=limit).collect())
        assert got == expected(limit)


def test_cells_that_no_query_probes_are_not_read(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = np.eye(8) * 10
    vectors = spark.createDataFrame([(f"v{i}", (centres[i % 8] + rng.normal(size=8)).tolist()) for i in range(400)], "chunk_id string, emb array<double>")
    celled = sim.write_cells(vectors, centres.tolist(), str(tmp_path / "cells"))
    queries = spark.createDataFrame([(f"q{i}", (centres[i % 2] + rng.normal(size=8)).tolist()) for i in range(10)], "qid string, vector array<double>")
    nprobe = sim.probes_for_recall(queries, celled, centres.tolist(), 10, recall=0.9)
    hits = sim.topk_cells(queries, celled, centres.tolist(), 10, nprobe)
    exact = {(r["qid"], r["chunk_id"]) for r in sim.topk_cosine(queries, vectors, 10).collect()}
    assert nprobe == 1 and len({(r["qid"], r["chunk_id"]) for r in hits.collect()} & exact) >= 0.9 * len(exact)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(", "") and "IN (0,1)" in plan
