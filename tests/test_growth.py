"""Steps that must not read, shuffle or hold more than once what they need once."""

import re
import time
import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from graphloom import session
from graphloom.operators import documents as docs
from graphloom.operators import evidence as ev
from graphloom.operators import graph as g
from graphloom.operators import retrieval as rt
from graphloom.operators import similarity as sim
from graphloom.plans import answer as an
from graphloom.plans.world import World

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def test_figures_of_an_order_take_one_shuffle(spark):
    assert plan(World(spark, SMALL).figures()).count("Exchange hashpartitioning") == 1


def test_field_lines(spark):
    """Every line break, blank lines and blanks at both ends; the first value counts; a line that is no field ends the block."""
    block = "[Infobox olympic event]\r\n  a: 1 \x0b\t b_2 :: x\u2028\n\u3000\n  c:\u00a0\n  a: 2\n  c: é\u00a0\n  9: no\n  d: 4"
    long = "[Infobox film]" + "\n" * 50_000 + "  a: b" + " " * 50_000 + "\n  b:c"
    rows = spark.createDataFrame([(1, block), (2, long), (3, ""), (4, None)], "id int, text string")
    got = {r["id"]: [tuple(e) for e in r["e"]] if r["e"] is not None else None for r in rows.select("id", docs.infobox_entries(F.col("text")).alias("e")).collect()}
    assert got == {1: [("a", "1"), ("b_2", ": x"), ("c", "é")], 2: [("a", "b"), ("b", "c")], 3: [], 4: None}


def test_scope_edges_read_the_documents_once(spark):
    parsed = docs.parse_documents(World(spark, SMALL).infobox_corpus())
    assert plan(g.edges(parsed, types=g.SCOPE_EDGES)).count("o_orderpriority") * 3 <= plan(g.edges(parsed)).count("o_orderpriority")
    every = g.edges(parsed).where(F.col("etype").isin(*g.SCOPE_EDGES))
    assert g.edges(parsed, types=g.SCOPE_EDGES).exceptAll(every).isEmpty() and every.exceptAll(g.edges(parsed, types=g.SCOPE_EDGES)).isEmpty()


def test_a_view_joins_twice(spark):
    edges = spark.createDataFrame(
        [("DESCRIBES", "d2", "e1"), ("DESCRIBES", "d1", "e1"), ("IN_SPORT", "e1", "s"), ("AT_GAMES", "e2", "g"), ("DESCRIBES", "d9", "e2"), ("HELD_AT", "e3", "v"),
         ("DESCRIBES", "d1", "e3"), ("HELD_AT", "e3", "u")], "etype string, src string, dst string",
    )
    pages = spark.createDataFrame([("d1", "one"), ("d2", None)], "doc_id string, title string")
    view = g.event_view(spark.createDataFrame([("e1",), ("e2",), ("e3",)], "event_id string"), edges, pages)
    assert sorted(map(tuple, view.select("event_id", "doc_id", "title", "sport", "games", "venue").collect())) == [
        ("e1", "d1", "one", "s", None, None), ("e3", "d1", "one", None, None, "u"),
    ]
    assert view._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_a_block_is_scored_in_bounded_memory():
    rng = np.random.default_rng(1)
    asked, pool = rng.normal(size=(600, 8)), rng.normal(size=(16_384, 8))
    q = pd.DataFrame({"qid": [f"q{i}" for i in range(600)], "vector": list(asked)})
    v = pd.DataFrame({"chunk_id": [f"v{i}" for i in range(16_384)], "emb": list(pool)})
    tracemalloc.start()
    got = sim._search(10)(q, v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20, peak
    assert len(got) == 6000
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    best = np.argsort(-(unit(asked)[599] @ unit(pool).T))[:10]
    assert got.loc[got["qid"] == "q599", "chunk_id"].tolist() == [f"v{i}" for i in best]


def test_questions_with_the_same_anchors_share_their_events(spark):
    """Found once, given to each; a question that quotes a date has its own. No shuffle or window sees the questions' rows."""
    cols = "event_id string, event_name string, doc_id string, title string, venue string, sport string, games string, date_year int, date_month int, date_day_start int, date_day_end int, date_text string"
    events = spark.createDataFrame(
        [(f"rowing-{2000 + i % 2}-Summer-{i:03d}", "n", f"d{i}", "t", "V", "rowing", f"{2000 + i % 2}-Summer", 2000 + i % 2, 8, 1 + i % 9, None, f"{1 + i % 9} August") for i in range(90)], cols
    )
    plain = [(f"q{k}", "V", None, None, "which of them?", 2001, None, None, "title") for k in range(200)]
    asked = spark.createDataFrame(
        [*plain, ("said", "V", None, None, "who won on 3 August, then?", 2001, None, None, "title"), (None, "V", None, None, "", 2001, None, None, None)],
        "qid string, venue string, games string, sport string, question string, date_year int, date_month int, date_day_start int, target_field string",
    )
    got = rt.venue_events(asked, events)
    found = {}
    for r in got.select("qid", "event_id", "value").collect():
        assert r["value"] == "t"
        found.setdefault(r["qid"], []).append(r["event_id"])
    odd = sorted(f"rowing-2001-Summer-{i:03d}" for i in range(1, 90, 2))
    assert {k: sorted(v) for k, v in found.items()} == {f"q{k}": odd for k in range(200)} | {"said": [x for x in odd if (int(x[-3:]) % 9) == 2]}
    lines = got.select("qid", "event_id")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(k for k, line in enumerate(lines) if "Join Inner" in line and "_alike" in line and "_slot" in line)
    depth, above = re.search(r"\w", lines[at]).start(), []
    for line in reversed(lines[:at]):
        if (own := re.search(r"\w", line).start()) < depth:
            depth = own
            above.append(line)
    assert above and not [line for line in above if re.search("Join|Aggregate|Window|Sort|Repartition", line)]


def test_questions_of_one_set_are_judged_and_answered_by_set(spark, monkeypatch):
    """The same evidence as when every question's rows are made first, and nothing kept that grows with questions times events."""
    cols = "event_id string, event_name string, doc_id string, title string, venue string, sport string, games string, competitors int, nations int, parse_confidence double, date_year int, date_month int, date_day_start int, date_day_end int, date_text string"
    rows = [(f"rowing-{2000 + i % 2}-Summer-{i:03d}", f"Race {i}", f"d{i}", f"Sculls of crew{i % 7}", "V", "rowing", f"{2000 + i % 2}-Summer", i, i % 5, 1.0, 2000 + i % 2, 8, 1 + i % 9, None, f"{1 + i % 9} August") for i in range(60)]
    events = spark.createDataFrame([*rows, rows[1]], cols)
    words = ["Which sculls of crew3?", "crew3 crew5 the of", "zzz the of", "", None, "sculls 2001 the", "was race in the 11?", "crew1 rowing, say", "who won on 3 August, then?"]
    asked = [(f"q{k}", words[k % 9], "TRAVERSE" if k % 2 else "LOOKUP", "X" if k % 40 == 3 else "V", ["title", "nations", None][k % 3], 2001) for k in range(160)]
    asked += [("twice", "zzz", "LOOKUP", "V", None, 2001), ("twice", "zzz", "LOOKUP", "V", None, 2000), (None, "zzz", "LOOKUP", "V", None, 2001)]
    questions = spark.createDataFrame(asked, "qid string, question string, operation string, venue string, target_field string, date_year int").withColumns(
        {c: F.lit(None).cast("string") for c in ("sport", "games", "title", "event_id")} | {c: F.lit(None).cast("int") for c in ("date_month", "date_day_start")} | {"constraints": F.array().cast(rt.CONSTRAINTS)}
    )
    chunks = spark.createDataFrame([(f"d{i}", f"c{i}-{j % 2}", f"sculls of crew{i}", j % 2) for i in range(9) for j in range(3)], "doc_id string, chunk_id string, text string, seq int")
    vectors = spark.createDataFrame([("c0-0", [1.0, 0.0]), ("c1-0", [0.0, 1.0])], "chunk_id string, emb array<double>")
    near = questions.where("qid is not null").select("qid", F.array(F.lit(1.0), F.lit(0.5)).alias("vector")).distinct()
    edges = spark.createDataFrame([], "etype string, src string, dst string")
    documents = events.select("doc_id", "title")
    first = an.direct_evidence(questions, events, edges, documents)
    verdict = ev.evaluate(questions, first)
    failed = {k: verdict.where(F.col("fallback_trigger") == k) for k in ("scope_coverage_fail", "groundedness_fail")}
    second = an.similarity_evidence(failed["scope_coverage_fail"], near, vectors, chunks)
    third = an.document_evidence(failed["groundedness_fail"].join(questions.select("qid", "question"), "qid"), first, chunks)
    key = lambda df: sorted(map(str, df.drop("pos").collect()))
    expected = key(ev.without_repeats(first.unionByName(second).unionByName(third)))
    kept, cut = [], an.cut_lineage

    def counted(df):
        kept.append(cut(df).count())
        return cut(df)

    monkeypatch.setattr(an, "cut_lineage", counted)
    got = an.answer_evidence(questions, events, edges, documents, chunks, near, vectors)
    assert key(got) == expected and {s for (s,) in got.select("source").distinct().collect()} == {"multi_hop", "similarity_search", "document_retrieval"}
    assert len(expected) > 5 * max(kept)


def test_rows_of_a_set_are_made_by_many_tasks(spark):
    """However small both sides are, their join is not one task; members met again and rows without a set are as in a plain join."""
    sets = spark.createDataFrame([(f"s{k % 2}", f"e{k}", k) for k in range(300)], "_alike string, event_id string, n int")
    members = spark.createDataFrame([(f"s{k % 3}", f"q{k}", None if k % 5 else "?") for k in range(90)] + [("s1", "q1", None)], "_alike string, qid string, a string")
    got = rt.spread(sets, members, "event_id")
    plain = members.join(sets, "_alike").drop("_alike").select(*got.columns)
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty() and got.count() == 61 * 150
    made = got.withColumn("_task", F.spark_partition_id()).groupBy("_task").count().collect()
    assert max(r["count"] for r in made) < got.count() / 5, made


def test_repeats_are_dropped_without_shuffling_what_is_not_read(spark):
    rows = ev.conform(spark.createDataFrame([("q", 3, "e", "long text", 1), ("q", 1, "e", "long text", 1), ("q", 2, "e", None, 1), ("r", 2, None, None, None)], "qid string, pos long, event_id string, text string, seq int"), "multi_hop")
    left = ev.without_repeats(rows)
    assert sorted(map(str, left.select("qid", "pos", "event_id", "text").collect())) == sorted(
        map(str, rows.where("pos <> 3").select("qid", "pos", "event_id", "text").collect())
    )
    dealt = [line for line in plan(left.select("qid", "event_id")).splitlines() if "SortAggregate" in line or "HashAggregate" in line]
    assert dealt and not any("any_value(text" in line or "any_value(seq" in line for line in dealt)


def test_shuffles_of_a_checkpoint_go_with_it(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(manager.getAllFiles().mkString("\n").split("\n"))
    before = files()
    cut = session.cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):  # files are removed in the background
        left = files() - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and cut.count() == 7
