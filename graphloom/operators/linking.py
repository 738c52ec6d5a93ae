"""Linking anchors and question texts to vocabularies.

Containment of strings is found by automata over vocabulary blocks; containment
of word runs is decided by equality: the longer side is taken apart into its
runs of the lengths the shorter side actually has, and the two meet in a hash
join. No pair is formed that does not match, and both sides may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import dates, text as tx
from graphloom.operators.occurrence import contained_entries

# ---- fixed values -----------------------------------------------------------
MIN_VENUE_NAME = 6
SHOWN_CANDIDATES = 10
GAMES_AS_TITLE = r"(?iU)^\s*\d{4}[\s-]*(summer|winter)?(\s+olympics)?\s*$"
GAMES_IN_TEXT = r"(?U)\b(\d{4})\s+(summer|winter)\b"
FULL_DAY = (
    r"(?U)\b(\d{1,2}(?:\s*[–-]\s*\d{1,2})?\s+[a-z]+\s+\d{4}"
    r"|[a-z]+\s+\d{1,2}(?:\s*[–-]\s*\d{1,2})?,?\s+\d{4})\b"
)
BARE_DAY = (
    r"(?U)\b(\d{1,2})\s+(january|february|march|april|may|june|july|august"
    r"|september|october|november|december)\b"
)
# -----------------------------------------------------------------------------


def link_vocabulary(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(query, entry, tier): exact, else the longest entry inside the query, else
    the only entry around it. Unlinked queries are absent.

    ``queries``: query. ``vocab``: entry.
    """
    asked = queries.select("query").distinct().withColumn("q", tx.loose(F.col("query"))).where(F.col("q") != "")
    entries = vocab.select("entry").distinct().withColumn("e", tx.loose(F.col("entry"))).where(F.col("e") != "")
    inside = contained_entries(asked, "q", entries, "e").join(entries, "e")
    best = inside.groupBy("q").agg(
        F.min(
            F.struct(
                (F.col("e") != F.col("q")).alias("inexact"), (-F.length("entry")).alias("l"), "entry"
            )
        ).alias("b")
    )
    first = asked.join(best, "q").select(
        "query", F.col("b.entry").alias("entry"), F.when(F.col("b.inexact"), "contained").otherwise("exact").alias("tier")
    )
    rest = asked.join(first.select("query"), "query", "left_anti")
    wider = (
        contained_entries(entries, "e", rest, "q").join(entries, "e")
        .groupBy("q")
        .agg(F.count(F.lit(1)).alias("n"), F.min("entry").alias("entry"))
        .where(F.col("n") == 1)
    )
    second = rest.join(wider, "q").select("query", "entry", F.lit("container").alias("tier"))
    return first.unionByName(second)


def resolve_games(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(query, entry): vocabulary link, else the year with its season."""
    linked = link_vocabulary(queries, vocab).select("query", "entry")
    rest = queries.select("query").distinct().join(linked, "query", "left_anti")
    year = dates.first_year(F.col("query"))
    season = F.when(F.lower("query").contains("winter"), "Winter").otherwise("Summer")
    by_year = rest.select("query", F.concat_ws("-", year.cast("string"), season).alias("entry")).where(
        year.isNotNull()
    ).join(vocab.select("entry").distinct(), "entry", "left_semi")
    return linked.unionByName(by_year.select("query", "entry"))


def venue_candidates(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(query, candidate, exact): every entry inside or around the query."""
    asked = queries.select("query").distinct().withColumn("q", F.lower(tx.strip(F.col("query")))).where(F.col("q") != "")
    entries = vocab.select(F.col("entry").alias("candidate")).distinct().withColumn("e", F.lower("candidate"))
    inside = contained_entries(asked, "q", entries, "e")
    around = contained_entries(entries, "e", asked, "q")
    pairs = inside.select("q", "e").unionByName(around.select("q", "e")).distinct()
    return pairs.join(asked, "q").join(entries, "e").select(
        "query", "candidate", (F.col("q") == F.col("e")).alias("exact")
    )


def resolve_venues(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(query, venue, candidates, shown): the venue when it is certain.

    An ambiguous query has venue NULL, its number of candidates and the first
    ten of them (longest first) as text.
    """
    found = venue_candidates(queries, vocab)
    longest = Window.partitionBy("query").orderBy(F.length("candidate").desc(), "candidate")
    shown = (
        found.withColumn("r", F.row_number().over(longest))
        .where(F.col("r") <= SHOWN_CANDIDATES)
        .groupBy("query")
        .agg(F.array_sort(F.collect_list(F.struct("r", "candidate"))).alias("s"))
        .select("query", F.array_join(F.transform("s", lambda x: x["candidate"]), ", ").alias("_shown"))
    )
    counted = found.groupBy("query").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.min("candidate").alias("_only"),
        F.min(F.when(F.col("exact"), F.col("candidate"))).alias("_exact"),
    )
    venue = F.when(F.col("candidates") == 1, F.col("_only")).otherwise(F.col("_exact"))
    extra = F.col("candidates") - SHOWN_CANDIDATES
    return counted.join(shown, "query").select(
        "query",
        venue.alias("venue"),
        "candidates",
        F.when(
            venue.isNull(),
            F.when(extra > 0, F.concat("_shown", F.lit(" (+"), extra.cast("string"), F.lit(" more)"))).otherwise(
                F.col("_shown")
            ),
        ).alias("shown"),
    )


# ---- gazetteer over question texts --------------------------------------------------


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def mentions(questions: DataFrame, vocab: DataFrame) -> DataFrame:
    """(qid, entry) wherever the entry stands verbatim, as whole words, in the question.

    ``questions``: qid, question. ``vocab``: entry. Word runs meet by equality;
    the few meetings are then checked against the raw text (punctuation).
    """
    entries = vocab.select("entry").distinct().withColumn("w", _words(F.col("entry"))).where(F.size("w") > 0)
    sizes = entries.agg(F.array_sort(F.collect_set(F.size("w")))).scalar()
    texts = questions.select(F.lower("question").alias("t")).distinct().withColumn(
        "w", _words(F.col("t"))
    ).withColumn("_n", F.coalesce(sizes, F.array().cast("array<int>")))

    def runs(n: Column) -> Column:
        return F.when(
            n <= F.size("w"),
            F.transform(
                F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")
            ),
        ).otherwise(F.array().cast("array<string>"))

    grams = texts.select(
        "t", F.explode(F.array_distinct(F.flatten(F.transform("_n", runs)))).alias("run")
    )
    keyed = entries.select("entry", F.array_join("w", " ").alias("run"))
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.lower("entry"), F.lit(r"\E(?!\w)"))
    hits = grams.join(keyed, "run").where(F.regexp_like("t", quoted))
    return questions.select("qid", F.lower("question").alias("t")).join(
        hits.select("t", "entry"), "t"
    ).select("qid", "entry")


def longest_mention(questions: DataFrame, vocab: DataFrame, min_length: int = 1) -> DataFrame:
    """(qid, entry): the longest entry of at least ``min_length`` named in the question."""
    found = mentions(questions, vocab.where(F.length("entry") >= min_length))
    return found.groupBy("qid").agg(
        F.min(F.struct((-F.length("entry")).alias("l"), "entry")).alias("b")
    ).select("qid", F.col("b.entry").alias("entry"))


def _attach(df: DataFrame, found: DataFrame, key: str, name: str) -> DataFrame:
    return df.join(found.withColumnRenamed("entry", name), key, "left")


def date_constraints(constraints: Column) -> Column:
    """Date anchors out of an intent's constraints: the last stated part wins."""
    stated = F.transform(
        F.filter(constraints, lambda c: c["field"].isin("date", "dates", "date_text") & c["value"].isNotNull()),
        lambda c: dates.normalize_date(c["value"]),
    )

    def last(dates_: Column, part: str) -> Column:
        given = F.filter(F.transform(dates_, lambda d: d[part]), lambda v: v.isNotNull() & (v != 0))
        return F.try_element_at(given, F.lit(-1)).alias(part)

    parts = ("date_year", "date_month", "date_day_start")
    return tx.let(stated, lambda dates_: F.struct(*[last(dates_, p) for p in parts]))


def ground_intents(intents: DataFrame) -> DataFrame:
    """Blank anchors to NULL; a venue or event id the question does not contain is dropped."""
    asked = tx.question_form(F.col("question"))
    out = {c: F.when(tx.strip(F.col(c)) != "", F.col(c)) for c in ("sport", "games", "title", "target_field")}
    for c in ("venue", "event_id"):
        out[c] = F.when((tx.strip(F.col(c)) != "") & asked.contains(tx.question_form(F.col(c))), F.col(c))
    return intents.withColumns(out)


def resolve_anchors(
    intents: DataFrame, sports: DataFrame, games: DataFrame, venues: DataFrame
) -> DataFrame:
    """Intent anchors to graph entities, with what the question itself states filled in.

    ``intents``: qid, question, sport, games, venue, title, event_id and
    constraints array<struct<field, op, value>>. Vocabularies: entry. Adds
    date_year / date_month / date_day_start, ``recovered`` and ``unresolved``
    notes, and for an ambiguous venue its candidates.
    """

    def distinct(col: str) -> DataFrame:
        return intents.select(F.col(col).alias("query")).where(F.col("query").isNotNull() & (F.col("query") != ""))

    base = intents.withColumnsRenamed({"sport": "i_sport", "games": "i_games", "venue": "i_venue", "title": "i_title"})
    base = _attach(base, link_vocabulary(distinct("sport"), sports).select(F.col("query").alias("i_sport"), "entry"),
                   "i_sport", "sport")
    base = _attach(base, resolve_games(distinct("games"), games).select(F.col("query").alias("i_games"), "entry"),
                   "i_games", "games")
    resolved = resolve_venues(distinct("venue"), venues)
    base = base.join(
        resolved.select(F.col("query").alias("i_venue"), "venue", F.col("candidates").alias("venue_candidates"),
                        F.col("shown").alias("venue_shown")),
        "i_venue", "left",
    )
    # A Games id or a venue parsed into the title slot is that anchor, not an event name.
    as_games = resolve_games(
        distinct("title").where(F.col("query").rlike(GAMES_AS_TITLE)), games
    ).select(F.col("query").alias("i_title"), F.col("entry").alias("t_games"))
    as_venue = (
        venues.select("entry", F.lower("entry").alias("_t"))
        .groupBy("_t").agg(F.min("entry").alias("t_venue"))
    )
    base = base.join(as_games, "i_title", "left").withColumn("_t", F.lower(tx.strip(F.col("i_title")))).join(
        as_venue, "_t", "left"
    ).drop("_t")
    no_id = F.col("event_id").isNull()
    base = base.withColumns(
        {
            "t_games": F.when(no_id, F.col("t_games")),
            "t_venue": F.when(no_id & F.col("t_games").isNull(), F.col("t_venue")),
        }
    ).withColumns(
        {
            "title": F.when(F.col("t_games").isNull() & F.col("t_venue").isNull(), F.col("i_title")),
            "games": F.coalesce("games", "t_games"),
            "venue": F.coalesce("venue", "t_venue"),
        }
    )
    texts = intents.select("qid", "question")
    # The fullest mention around the parsed venue, and the fullest mention at all.
    longest = F.struct((-F.length("entry")).alias("l"), "entry")
    around = (F.length("entry") > F.length("venue")) & F.lower("entry").contains(F.lower("venue"))
    named = (
        mentions(texts, venues).join(base.select("qid", "venue"), "qid")
        .groupBy("qid")
        .agg(
            F.min(F.when(around, longest)).alias("f"),
            F.min(F.when(F.length("entry") >= MIN_VENUE_NAME, longest)).alias("a"),
        )
        .select("qid", F.col("f.entry").alias("v_full"), F.col("a.entry").alias("v_any"))
    )
    base = base.join(named, "qid", "left")
    base = _attach(base, longest_mention(texts, sports), "qid", "s_any")
    lowered = F.lower("question")
    base = base.withColumn(
        "entry",
        F.when(
            lowered.rlike(GAMES_IN_TEXT),
            F.concat_ws("-", F.regexp_extract(lowered, GAMES_IN_TEXT, 1),
                        F.initcap(F.regexp_extract(lowered, GAMES_IN_TEXT, 2))),
        ),
    ).join(games.select("entry", F.col("entry").alias("g_any")).distinct(), "entry", "left").drop("entry")

    def unresolved(col: str) -> Column:
        return (F.col(f"i_{col}") != "") & F.col(f"i_{col}").isNotNull()

    venue_failed = unresolved("venue") & F.col("venue").isNull()
    venue_open = F.col("venue").isNull() & ~F.coalesce(unresolved("venue"), F.lit(False))
    sport_open = F.col("sport").isNull() & ~F.coalesce(unresolved("sport"), F.lit(False))
    games_open = F.col("games").isNull() & ~F.coalesce(unresolved("games"), F.lit(False))
    base = base.withColumns(
        {
            "r_venue": F.coalesce("v_full", F.when(venue_open, F.col("v_any"))),
            "r_sport": F.when(sport_open, F.col("s_any")),
            "r_games": F.when(games_open, F.col("g_any")),
            "_venue_failed": F.coalesce(venue_failed, F.lit(False)),
            "_sport_failed": F.coalesce(unresolved("sport") & F.col("sport").isNull(), F.lit(False)),
            "_games_failed": F.coalesce(unresolved("games") & F.col("games").isNull(), F.lit(False)),
            "_d": date_constraints(F.col("constraints")),
        }
    ).withColumns(
        {
            "venue": F.coalesce("r_venue", "venue"),
            "sport": F.coalesce("sport", "r_sport"),
            "games": F.coalesce("games", "r_games"),
        }
    )
    day = F.nullif(F.regexp_extract(lowered, FULL_DAY, 1), F.lit(""))
    bare = F.when(
        F.col("games").isNotNull() & lowered.rlike(BARE_DAY),
        F.concat_ws(" ", F.regexp_extract(lowered, BARE_DAY, 1), F.regexp_extract(lowered, BARE_DAY, 2),
                    F.substring("games", 1, 4)),
    )
    open_date = F.coalesce("_d.date_month", "_d.date_day_start").isNull()
    base = base.withColumn("_r", F.when(open_date, dates.normalize_date(F.coalesce(day, bare))))
    dated = F.coalesce((F.col("_r.date_month") > 0) & (F.col("_r.date_day_start") > 0), F.lit(False))

    def note(name: str, col: str, tail: str = "") -> Column:
        return F.when(F.col(col).isNotNull(), F.concat(F.lit(f"{name}="), F.col(col), F.lit(tail)))

    return base.select(
        "qid", "question", "sport", "games", "venue", "title", "event_id",
        *[c for c in ("operation", "target_field", "constraints") if c in intents.columns],
        F.coalesce("_d.date_year", F.when(dated, F.col("_r.date_year"))).alias("date_year"),
        F.coalesce("_d.date_month", F.when(dated, F.col("_r.date_month"))).alias("date_month"),
        F.coalesce("_d.date_day_start", F.when(dated, F.col("_r.date_day_start"))).alias("date_day_start"),
        F.concat_ws(
            "; ",
            note("games", "t_games", " (parsed as an event title)"),
            note("venue", "t_venue", " (parsed as an event title)"),
            note("venue", "v_full", " (question names it in full)"),
            F.when(F.col("v_full").isNull(), note("venue", "r_venue")),
            note("sport", "r_sport"),
            note("games", "r_games"),
            F.when(
                dated,
                F.format_string("date=%d-%02d-%02d", "_r.date_year", "_r.date_month", "_r.date_day_start"),
            ),
        ).alias("recovered"),
        F.concat_ws(
            ", ",
            F.when(F.col("_sport_failed"), "sport"), F.when(F.col("_games_failed"), "games"),
            F.when(F.col("_venue_failed"), "venue"),
        ).alias("unresolved"),
        F.when(F.col("_venue_failed"), F.col("venue_candidates")).alias("venue_candidates"),
        F.when(F.col("_venue_failed"), F.col("venue_shown")).alias("venue_shown"),
    )


def needs_disambiguation(anchors: DataFrame) -> DataFrame:
    """Questions with an ambiguous venue and neither sport nor event to tell it by."""
    return anchors.where(
        (F.col("venue_candidates") > 1)
        & F.col("sport").isNull() & F.col("title").isNull() & F.col("event_id").isNull()
    ).select(
        "qid",
        F.concat(F.lit("Which venue did you mean: "), "venue_shown", F.lit("?")).alias("answer"),
        F.concat(
            F.lit("The venue in the question matches "), F.col("venue_candidates").cast("string"),
            F.lit(" venues and the question names no sport or event to tell them apart, so no answer was guessed."),
        ).alias("explanation"),
        F.lit("disambiguation_required").alias("stop_reason"),
    )
