"""Infobox parsing, graph construction and a build round trip."""

import json

from pyspark.sql import functions as F

from graphloom.operators import describe as ds
from graphloom.operators import documents as docs
from graphloom.operators import graph as g
from graphloom.plans import build
from graphloom.sources.corpus import CORPUS
from graphloom.sources.tables import TableStore

CANOE = """[Infobox film]
[Infobox Olympic event]
  event: Men's canoe sprint K-2 1,000 metres
  games: 2012 Summer
  venue: Eton Dorney

  dates: 6 to 8 August
  competitors: 23 teams
  nations: 12
  gold: Rudolf DombiRoland Kokeny
  gold: ignored
  bronze: A Bee
  bronze2: C Dee
  prev: 2008
  next: 2016
Prose begins: here
  venue: nowhere
"""


def page(doc_id, title, text):
    return {"doc_id": doc_id, "title": title, "url": f"https://en.wikipedia.org/{doc_id}", "text": text}


def corpus(spark, *pages):
    rows = [{**p, "wikidata_qid": None, "wikipedia_pageid": 1, "approx_tokens": 3} for p in pages]
    df = spark.createDataFrame(rows, CORPUS)
    return df.withColumn("line_no", F.regexp_extract("doc_id", r"(\d+)", 1).cast("long"))


def edition(n, year, name="Race"):
    text = f"[Infobox Olympic event]\n  event: {name}\n  games: {year} Summer\n  prev: {year - 4}\n  next: {year + 4}\n"
    return page(f"Q{n}", f"Rowing at the {year} Summer Olympics – {name} {n}", text)


def test_parse(spark):
    title = "Canoeing at the 2012 Summer Olympics – Men's K-2 +1000 metres"
    row = docs.parse_documents(corpus(spark, page("Q1", title, CANOE))).first()
    assert row["event_id"] == "canoeing-2012-Summer-men-s-k-2-plus-1000-metres"
    assert (row["competitors"], row["competitors_text"], row["nations"]) == (23, "23 teams", 12)
    assert (row["date_year"], row["date_year_from_games"], row["date_month"], row["date_day_start"]) == (2012, True, 8, 6)
    assert row["gold"] == ["Rudolf Dombi", "Roland Kokeny"] and row["bronze"] == ["A Bee", "C Dee"]
    assert row["venue_name"] == "Eton Dorney" and row["parse_confidence"] == 0.9
    assert row["parse_notes"] == ["competitors not an integer: '23 teams'"]
    film = docs.parse_documents(corpus(spark, page("Q2", "X", "[Infobox film]\n  event: y\n"))).first()
    assert (film["infobox_type"], film["is_event"], film["event_id"], film["parse_confidence"]) == ("film", False, None, 1.0)


def test_chunks(spark):
    df = spark.createDataFrame([("a", " ".join(f"w{i}" for i in range(10))), ("b", "a b c d e"), ("c", " ")], "doc_id string, text string")
    got = [r["text"] for r in docs.chunk_documents(df.where("doc_id = 'a'"), 4, 1).orderBy("seq").collect()]
    assert got == ["w0 w1 w2 w3", "w3 w4 w5 w6", "w6 w7 w8 w9"]
    assert [r["text"] for r in docs.chunk_documents(df.where("doc_id = 'b'"), 3, 1).orderBy("seq").collect()] == ["a b c", "c d e"]
    assert docs.chunk_documents(df.where("doc_id = 'c'")).count() == 0


def test_edition_links_use_the_last_duplicate(spark):
    p = docs.parse_documents(corpus(spark, edition(1, 2008), edition(2, 2012), edition(3, 2008)))
    links = {(r["etype"], r["src"], r["dst"]) for r in g.edition_links(p).collect() if r["dst"]}
    late = "rowing-2008-Summer-race-3"
    assert ("PREV_EDITION", "rowing-2012-Summer-race-2", late) in links
    assert sum(1 for x in links if x[2] == late) == 1


def test_dataset_title(spark):
    titles = [
        "Athletics at the 1996 Summer Olympics – Men's 1500 metres", "Rowing at the 2016 Summer Olympics – Women's eight",
        "Judo at the 2008 Summer Olympics", "Eton Dorney",
    ]
    rows = [("d", t, "https://en.wikipedia.org/x", None) for t in titles]
    df = spark.createDataFrame(rows, "dataset string, title string, url string, declared string")
    assert ds.describe(df).first()["title"] == "Wikipedia · Summer Olympics · 1996–2016"


def test_build_rebuild_and_embed(spark, tmp_path):
    path = tmp_path / "one.jsonl"
    path.write_text("\n".join(json.dumps(edition(i, 2000 + 4 * i)) for i in range(3)) + "\n\n")
    store = TableStore(spark, str(tmp_path / "store"))
    build.build_corpus(spark, str(path), store, "one", model_key="bge-large-en-v1.5", dim=16)
    assert store.read("event").count() == 3 and store.read("embedding").count() == 3
    view = build.event_view(store)
    assert view.where("sport = 'Rowing'").count() == 3
    path.write_text(json.dumps(edition(7, 2020)) + "\n")
    build.build_corpus(spark, str(path), store, "one")
    assert [r["event_id"] for r in store.read("event").collect()] == ["rowing-2020-Summer-race-7"]
    assert store.read("embedding").count() == 0 and store.read("coverage").count() == 0
    build.embed_missing(store, "bge-large-en-v1.5", 16)
    assert store.read("embedding").count() == 1
    build.drop_model(store, "bge-large-en-v1.5")
    assert store.read("embedding").count() == 0 and store.read("chunk").count() == 1


def test_bad_corpus_is_refused(spark, tmp_path):
    path = tmp_path / "bad.jsonl"
    path.write_text('{"doc_id": "a", "text": "t"}\n{"doc_id": 3, "text": "t"}\n')
    try:
        build.check_corpus(spark, str(path))
    except ValueError as error:
        assert "doc_id is missing or not text" in str(error)
    else:
        raise AssertionError("the corpus should have been refused")
