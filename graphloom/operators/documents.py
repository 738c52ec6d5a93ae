"""Corpus documents to typed columns: infobox parse, chunks, coverage report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import dates, text as tx

# ---- fixed values -----------------------------------------------------------
TARGET_INFOBOX = "olympic event"
HEADER = r"(?mdU)^\s*\[Infobox ([^\]]+)\]\s*$"
TARGET_BLOCK = r"(?mdU)^\s*\[Infobox \s*(?i:olympic event)\s*\]\s*$([\s\S]*)"
FIRST_BLOCK = r"(?mdU)^\s*\[Infobox [^\]]+\]\s*$([\s\S]*)"
LINE_ENDS = "\r\x0B\f\x1C\x1D\x1E\x85\u2028\u2029"
#: The field lines that a block starts with, blank lines among them; possessive, so that a block of any length needs no stack.
FIELD_LINES = (
    rf"^(?:[{tx.SPACES}]*\n)?+(?:[ \t]++[A-Za-z_][A-Za-z0-9_]*+[ \t]*+:[^\n]*+(?:\n(?:[{tx.SPACES}]*\n)?+|\z))*+"
)
TITLE_SPORT = r"(?iU)^(.*?)\s+at\s+the\s+\d{4}\b"
LEADING_NUMBER = r"^(\d[\d,]*)"
COVERAGE_FIELDS = (
    "event_name", "games_id", "sport_name", "venue_name", "competitors",
    "nations", "date_text", "gold", "prev_year", "next_year",
)
# -----------------------------------------------------------------------------


def infobox_type(text: Column) -> Column:
    """Lower-cased infobox type: the target type wherever it stands, else the first."""
    names = F.transform(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(HEADER), F.lit(1)),
        lambda n: F.lower(tx.strip(n)),
    )
    return F.when(F.array_contains(names, TARGET_INFOBOX), F.lit(TARGET_INFOBOX)).otherwise(
        F.try_element_at(names, F.lit(1))
    )


def infobox_entries(text: Column) -> Column:
    """array<struct<key, value>> of the block after the chosen header.

    The block ends at the first line that is neither blank nor a field; an
    empty value does not count and a repeated key keeps its first value.
    """
    body = F.when(text.rlike(TARGET_BLOCK), F.regexp_extract(text, TARGET_BLOCK, 1)).otherwise(
        F.regexp_extract(text, FIRST_BLOCK, 1)
    )
    for end in LINE_ENDS:
        body = F.replace(body, F.lit(end), F.lit("\n"))
    # One regular expression finds the lines; they are taken apart without any.
    found = F.transform(
        F.split(F.regexp_extract(body, FIELD_LINES, 0), "\n"),
        lambda line: F.struct(
            F.btrim(F.substring_index(line, ":", 1), F.lit(" \t")).alias("key"),
            tx.strip(F.substr(line, F.instr(line, ":") + 1)).alias("value"),
        ),
    )

    def first_per_key(pairs: Column) -> Column:
        def first(keys: Column) -> Column:
            repeated = F.size(F.array_distinct(keys)) < F.size(keys)
            return F.when(
                repeated, F.filter(pairs, lambda pair, i: F.array_position(keys, pair["key"]) == i + 1)
            ).otherwise(pairs)

        return tx.let(F.transform(pairs, lambda pair: pair["key"]), first)

    return tx.let(F.filter(found, lambda pair: (pair["key"] != "") & (pair["value"] != "")), first_per_key)


def infobox_fields(text: Column) -> Column:
    """map<key, value> of the infobox block."""
    return F.map_from_entries(infobox_entries(text))


def infobox_rows(corpus: DataFrame) -> DataFrame:
    """One row per (doc_id, pos, key, value)."""
    return corpus.select("doc_id", F.posexplode(infobox_entries(F.col("text"))).alias("pos", "e")).select(
        "doc_id", "pos", "e.key", "e.value"
    )


def sport_of(title: Column) -> Column:
    return F.nullif(tx.strip(F.regexp_extract(title, TITLE_SPORT, 1)), F.lit(""))


def leading_int(raw: Column) -> Column:
    """struct(value, exact): the leading integer and whether it is the whole value."""
    bare = tx.strip(raw)
    digits = F.regexp_extract(bare, LEADING_NUMBER, 1)
    return F.struct(
        dates.number(F.replace(digits, F.lit(","), F.lit(""))).alias("value"),
        F.coalesce((digits == bare) & (bare != ""), F.lit(False)).alias("exact"),
    )


def medallists(fields: Column, place: str) -> Column:
    """Names of one place, numbered ties included."""
    raw = F.array(*[F.try_element_at(fields, F.lit(k)) for k in (place, f"{place}2", f"{place}3")])
    return F.flatten(F.transform(F.filter(raw, lambda r: r.isNotNull()), tx.split_people))


def _quoted(raw: Column) -> Column:
    mark = F.when(raw.contains("'") & ~raw.contains('"'), F.lit('"')).otherwise(F.lit("'"))
    return F.concat(mark, raw, mark)


def parse_documents(corpus: DataFrame) -> DataFrame:
    """Every document with its parsed columns; non-target documents keep the head only.

    Input: doc_id, title, url, wikipedia_pageid, approx_tokens, text. Further
    columns (a line number, a dataset name) pass through.
    """
    head = corpus.select(
        *[c for c in corpus.columns if c not in ("title", "url", "text", "approx_tokens")],
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("approx_tokens", F.lit(0)).alias("approx_tokens"),
        infobox_type(F.col("text")).alias("infobox_type"),
        F.col("text").alias("_text"),
    ).withColumn("is_event", F.coalesce(F.col("infobox_type") == TARGET_INFOBOX, F.lit(False)))
    fielded = head.withColumn("_f", F.when(F.col("is_event"), infobox_fields(F.col("_text")))).drop("_text")

    def field(name: str) -> Column:
        return F.try_element_at(F.col("_f"), F.lit(name))

    raw = fielded.select(
        *[c for c in fielded.columns if c != "_f"],
        F.when(F.col("is_event"), F.coalesce(field("event"), F.col("title"))).alias("event_name"),
        dates.games_id(field("games")).alias("games_id"),
        F.when(F.col("is_event"), sport_of(F.col("title"))).alias("sport_name"),
        field("venue").alias("venue_name"),
        field("competitors").alias("_competitors"),
        field("nations").alias("_nations"),
        leading_int(field("competitors")).alias("_c"),
        leading_int(field("nations")).alias("_n"),
        F.coalesce(field("date"), field("dates")).alias("date_text"),
        medallists(F.col("_f"), "gold").alias("gold"),
        medallists(F.col("_f"), "silver").alias("silver"),
        medallists(F.col("_f"), "bronze").alias("bronze"),
        field("goldNOC").alias("gold_noc"),
        field("win_value").alias("win_value"),
        field("win_label").alias("win_label"),
        dates.first_year(field("prev")).alias("prev_year"),
        dates.first_year(field("next")).alias("next_year"),
    )
    dated = raw.withColumn("_d", dates.normalize_date(F.col("date_text"))).withColumn(
        "_bad_c", F.col("_competitors").isNotNull() & ~F.col("_c.exact")
    ).withColumn("_bad_n", F.col("_nations").isNotNull() & ~F.col("_n.exact"))
    event = F.col("is_event")
    penalty = (
        F.when(F.col("games_id").isNull(), 0.2).otherwise(0.0)
        + F.when(F.col("sport_name").isNull(), 0.2).otherwise(0.0)
        + F.when(F.col("_bad_c"), 0.1).otherwise(0.0)
        + F.when(F.col("_bad_n"), 0.1).otherwise(0.0)
    )
    notes = F.array(
        F.when(F.col("games_id").isNull(), F.lit("games not derivable")),
        F.when(F.col("sport_name").isNull(), F.lit("sport not derivable from title")),
        F.when(F.col("_bad_c"), F.concat(F.lit("competitors not an integer: "), _quoted(F.col("_competitors")))),
        F.when(F.col("_bad_n"), F.concat(F.lit("nations not an integer: "), _quoted(F.col("_nations")))),
    )
    from_games = F.col("_d.date_year").isNull() & dates.games_year(F.col("games_id")).isNotNull()
    title_event = tx.event_part(F.col("title"), any_case=True)
    title_games = dates.games_id(F.col("title"))
    kept = [c for c in fielded.columns if c != "_f"]
    return dated.select(
        *kept,
        F.when(
            event,
            F.coalesce(tx.event_id(F.col("sport_name"), title_games, title_event), F.col("doc_id")),
        ).alias("event_id"),
        "event_name", "games_id", "sport_name", "venue_name",
        F.col("_c.value").alias("competitors"),
        F.when(F.col("_bad_c"), F.col("_competitors")).alias("competitors_text"),
        F.col("_n.value").alias("nations"),
        F.when(F.col("_bad_n"), F.col("_nations")).alias("nations_text"),
        "date_text",
        F.coalesce("_d.date_year", dates.games_year(F.col("games_id"))).alias("date_year"),
        from_games.alias("date_year_from_games"),
        "_d.date_month", "_d.date_day_start", "_d.date_day_end",
        "gold", "silver", "bronze", "gold_noc", "win_value", "win_label", "prev_year", "next_year",
        F.when(event, F.bround(F.greatest(F.lit(0.0), 1.0 - penalty), 2)).otherwise(1.0).alias("parse_confidence"),
        F.when(event, F.filter(notes, lambda n: n.isNotNull())).otherwise(
            F.array().cast("array<string>")
        ).alias("parse_notes"),
    )


def chunk_documents(corpus: DataFrame, size: int = 300, overlap: int = 50) -> DataFrame:
    """Overlapping word windows of every document's whole text."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the window size")
    step = size - overlap
    worded = corpus.select(
        "doc_id", F.filter(F.split(F.col("text"), r"(?U)\s+"), lambda w: w != "").alias("words")
    ).where(F.size("words") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("words") - size) / step).cast("int"))
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("words", i * step + 1, F.lit(size)))
    return worded.select("doc_id", F.posexplode(windows).alias("seq", "window")).select(
        F.concat_ws("_c", F.col("doc_id").cast("string"), F.col("seq").cast("string")).alias("chunk_id"),
        "doc_id",
        F.array_join("window", " ").alias("text"),
        "seq",
        F.size("window").alias("token_count"),
    )


# ---- coverage report ----------------------------------------------------------


def coverage_totals(parsed: DataFrame) -> DataFrame:
    """One row of corpus totals."""
    event = F.col("is_event")
    return parsed.agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.count_if(event).alias("target_events"),
        F.countDistinct(F.coalesce("infobox_type", F.lit(""))).alias("infobox_types"),
        F.count_if(event & (F.col("parse_confidence") < 1.0)).alias("low_confidence"),
        F.count_if(event & F.col("competitors_text").isNotNull()).alias("non_integer_competitors"),
        F.count_if(event & F.col("sport_name").isNull()).alias("missing_sport"),
        F.count_if(event & F.col("games_id").isNull()).alias("missing_games"),
        F.count_if(
            event & F.col("date_text").isNotNull()
            & (F.col("date_year").isNull() | F.col("date_year_from_games"))
        ).alias("dates_without_year"),
        F.count_if(event & (F.size("gold") > 1)).alias("concatenated_medallists"),
    )


def coverage_types(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy(F.coalesce("infobox_type", F.lit("(none)")).alias("infobox_type")).agg(
        F.count(F.lit(1)).alias("documents")
    )


def coverage_fields(parsed: DataFrame) -> DataFrame:
    """Presence per field over the target events (a zero or empty list is absent)."""

    def present(name: str) -> Column:
        col = F.col(name)
        if name == "gold":
            return F.size(col) > 0
        if name in ("competitors", "nations", "prev_year", "next_year"):
            return col != 0
        return col != ""

    events = parsed.where("is_event")
    counted = events.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(present(f)).alias(f) for f in COVERAGE_FIELDS]
    )
    return counted.unpivot("n", list(COVERAGE_FIELDS), "field", "present").select(
        "field", "present", (F.col("present") / F.greatest(F.lit(1), F.col("n")) * 100).alias("percent")
    )


def coverage_samples(parsed: DataFrame, order: str = "doc_id", limit: int = 10) -> DataFrame:
    """The first sample of non-integer figures, in corpus order."""
    return (
        parsed.where(F.col("is_event") & F.col("competitors_text").isNotNull())
        .orderBy(order)
        .limit(limit)
        .select("doc_id", "competitors_text")
    )
