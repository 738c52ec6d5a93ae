"""Hand-computed expectations for the text functions and scores."""

import unicodedata

from pyspark.sql import functions as F

from graphloom.functions import dates, records as rec, text as tx
from graphloom.operators import scoring as sc


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    df = spark.createDataFrame([tuple(values.values())], schema) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_normalize_answer(spark):
    got = lambda t: one(spark, tx.normalize_answer(F.col("t")), t=t)
    assert got("The  Men's Sébastien—05") == "mens sebastien 5"
    assert got("10,000") == "10 0"
    assert got("twenty one") == "20 1"
    assert got("ﬁve ½ cups…") == "5 1⁄2 cups"
    assert got("") == ""


def test_fold_follows_the_unicode_rule(spark):
    sample = "한글 \u1112\u1161\u11ab Ångström “quoted” – ﬁ ﬂ № ½ ß ñ ç … ‥ ｆｕｌｌ ① ㎏ Ǆ"
    wanted = "".join(
        " " if unicodedata.category(c)[0] == "P" else c
        for c in unicodedata.normalize("NFKD", sample) if unicodedata.category(c) != "Mn"
    )
    assert one(spark, tx.fold(F.col("t")), t=sample) == wanted


def test_people_are_split(spark):
    split = lambda t: one(spark, tx.split_people(F.col("t")), t=t)
    assert split("Jane SmithJohn Doe") == ["Jane Smith", "John Doe"]
    assert split("Rosannagh MacLennan") == ["Rosannagh MacLennan"]
    assert split("Rosannagh MacLennanJane Smith") == ["Rosannagh MacLennan", "Jane Smith"]
    assert one(spark, tx.split_names(F.col("t")), t="A Bee, C Dee; E & F and G") == ["A Bee", "C Dee", "E", "F", "G"]


def test_exact_match(spark):
    em = lambda a, *g: one(spark, sc.exact_match(F.col("a"), F.col("g")), a=a, g=list(g))
    assert [em(a, "5") for a in ("5", "five", "05", "5 events", "5 or 6")] == [1, 1, 1, 1, 0]
    trio = "Dani KingLaura TrottJoanna Rowsell"
    assert em("Dani King, Laura Trott and Joanna Rowsell", trio) == 1
    assert em("Dani King, Laura Trott", trio) == 0
    assert em("Sebastian Vettel", "Sebastián Vettel") == 1
    assert em("", "x") == 0 and em("x") == 0 and em("b", "a", "b") == 1


def test_token_f1(spark):
    f1 = lambda a, g: round(one(spark, sc.token_f1(F.col("a"), F.col("g")), a=a, g=[g]), 6)
    assert f1("the United States team", "United States") == 0.8
    assert f1("marathon gold", "mens marathon event") == 0.4
    assert f1("", "") == 1 and f1("x", "") == 0
    assert f1("a b b c", "b b d") == round(2 * 2 / 6, 6)


def test_f1_table_agrees_with_the_expression(spark):
    rows = [(1, "b b c", ["b d", "b b c d"]), (2, "", [""]), (3, "x", ["y"]), (4, "x", []), (5, "Ann LeeBob Roe", ["bob roe ann"])]
    df = spark.createDataFrame(rows, "k int, answer string, variants array<string>")
    wide = {r["k"]: round(r["f"], 9) for r in df.select("k", sc.token_f1(F.col("answer"), F.col("variants")).alias("f")).collect()}
    tall = {r["k"]: round(r["f1"], 9) for r in sc.token_f1_table(df, ["k"]).collect()}
    assert wide == tall


def test_retrieval_and_grounding(spark):
    r = one(spark, sc.retrieval_metrics(F.col("a"), F.col("b")), a=["Q1", "Q2", "Q3", "Q1"], b=["Q1", "Q2", "Q4"])
    assert [round(v, 6) for v in r] == [0.666667] * 3
    assert list(one(spark, sc.retrieval_metrics(F.col("a"), F.col("b")), a=[], b=["Q1"])) == [0, 0, 0]
    g = lambda a, *e: one(spark, sc.grounding(F.col("a"), F.col("e")), a=a, e=list(e))
    assert g("Ann Lee and Bob Roe", "won by Ann Lee.") == 0.5
    assert g("", "x") == 0 and g("x") == 0


def test_dates(spark):
    d = lambda t: tuple(one(spark, dates.normalize_date(F.col("t")), t=t))
    assert d("6 to 8 August") == (None, 8, 6, None)
    assert d("12–14 August 2004") == (2004, 8, 12, 14)
    assert d("2004-08-12") == (2004, 8, 12, None)
    assert d("August 12, 2004") == (2004, 8, 12, None)
    assert d("30 June – 2 May 1999")[1] == 5  # calendar order, not text order
    assert d("") == (None, None, None, None)


def test_records(spark):
    reply = lambda t: tuple(one(spark, rec.parse_reply(F.col("t")), t=t))
    assert reply('```json\n{"answer": "5", "explanation": "e"}\n```') == ("5", "e")
    assert reply('{"answer": "a\\"b", "expl')[0] == 'a"b'
    assert reply("plain words") == ("plain words", "plain words")
    assert one(spark, rec.public_host(F.col("u")), u="https://me:pw@Host.org:81/x?y") == "host.org:81"
    assert one(spark, rec.is_run_id(F.col("u")), u="history") is False
    assert one(spark, rec.looks_secret(F.col("u")), u="key sk-" + "a" * 20) is True
    assert one(spark, tx.strip(F.col("u")), u="  x \n") == "x"


def test_a_cut_off_reply_of_any_length(spark):
    from graphloom.functions.records import parse_reply

    long = "word " * 20_000
    got = one(spark, parse_reply(F.col("t")), t='{"answer": "' + long + '", "explanation": "cut')
    assert got["answer"] == long.strip()
    assert one(spark, parse_reply(F.col("t")), t='```json\n{"answer": "a\\"b", "explanation": null}\n```')["explanation"] == "None"
    assert one(spark, parse_reply(F.col("t")), t='{"answer": "a\\u00e9b", "expl')["answer"] == "aéb"


def test_utf8_is_checked_on_the_bytes(spark, tmp_path):
    from graphloom.sources.corpus import read_corpus_lines, validate_lines

    (tmp_path / "good.jsonl").write_text('{"doc_id": "a", "text": "x \ufffd"}\n', encoding="utf-8")
    (tmp_path / "bad.jsonl").write_bytes(b'{"doc_id": "a", "text": "\xff\xfe"}\n')
    got = {r["dataset"]: r["problem"] for r in validate_lines(read_corpus_lines(spark, str(tmp_path))).collect()}
    assert got == {"good": None, "bad": "not valid UTF-8"}


def test_plain_texts_and_all_others_are_normalized_by_one_rule(spark):
    """Every character next to, inside and around words and articles: the short way of plain texts gives what the whole rule gives."""
    chars = [chr(c) for c in [*range(1, 0x3400), *range(0xFB00, 0x10000), *range(0x1F100, 0x1F250)]]
    rows = [(c, f"{c}The a{c}b, an{c} 007{c}{c}two {c} x_the{c}\n") for c in chars] + [("", ""), ("", "a"), ("", "A THE an"), ("", "x\n"), ("", "a\x01the"), ("", " \t a\tb")]
    lowered = F.regexp_replace(F.lower("t"), tx.APOSTROPHES, "")
    bare = F.regexp_replace(tx.fold(lowered), r"(?U)\b(a|an|the)\b", " ")
    whole = F.array_join(F.transform(F.filter(F.split(F.regexp_replace(bare, r"(?U)\s+", " "), " "), lambda t: t != ""), tx.canonical_token), " ")
    texts = spark.createDataFrame(rows, "c string, t string").select("c", whole.alias("whole"), tx.normalize_answer(F.col("t")).alias("got"))
    assert texts.where("whole <> got").limit(5).collect() == []
    plan = spark.range(1).select(tx.normalize_answer(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "*+\\z" in plan
