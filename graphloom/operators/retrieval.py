"""The five retrieval queries over whole tables of questions.

``events`` is the denormalised event view: event_id, event_name, doc_id, title,
sport, games, venue, competitors, nations, date_*, medals, parse_confidence.
An anchor that is NULL or "" does not restrict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import dates, text as tx
from graphloom.session import cut_lineage

# ---- fixed values -----------------------------------------------------------
MIN_CONFIDENCE = 0.9
MAX_MEMBERS = 30
TOP_RANKED = 3
COUNT_FIELDS = ("competitors", "date_year", "nations")
FIELD_SYNONYMS = {
    "participants": "competitors", "athletes": "competitors", "entrants": "competitors",
    "competitor": "competitors", "countries": "nations", "nation": "nations", "nocs": "nations",
    "year": "date_year",
}
EVENT_ROW = (
    "event_id", "event_name", "doc_id", "title", "competitors", "competitors_text", "nations",
    "nations_text", "date_text", "date_year", "date_month", "date_day_start", "date_day_end",
    "gold", "silver", "bronze", "gold_noc", "win_value", "win_label", "parse_confidence",
)
#: Slots to which the events of questions with the same anchors are dealt, groups of such questions, and tasks that make their rows.
SLOTS, GROUPS, SPREAD_TASKS = 32, 64, 128
# -----------------------------------------------------------------------------

SCOPE = ("sport", "games", "venue")
CONSTRAINTS = "array<struct<field:string,op:string,value:double>>"


def decode_constraints(payload: Column) -> Column:
    """The intent's JSON constraint list as a typed array."""
    return F.from_json(payload, CONSTRAINTS)


def clean_constraints(raw: Column) -> Column:
    """struct(usable, dropped): synonyms mapped, values cast, the rest reported.

    ``raw`` is array<struct<field, op, value string>>.
    """

    def name(c: Column) -> Column:
        lowered = F.lower(c["field"])
        mapped = lowered
        for synonym, field in FIELD_SYNONYMS.items():
            mapped = F.when(lowered == synonym, F.lit(field)).otherwise(mapped)
        return mapped

    def ok(c: Column) -> Column:
        return name(c).isin(*COUNT_FIELDS) & c["value"].try_cast("double").isNotNull()

    usable = F.transform(
        F.filter(raw, ok),
        lambda c: F.struct(
            name(c).alias("field"), c["op"].alias("op"), c["value"].try_cast("double").alias("value")
        ),
    )
    dropped = F.transform(
        F.filter(raw, lambda c: ~F.coalesce(ok(c), F.lit(False))),
        lambda c: F.concat_ws(" ", c["field"], c["op"], c["value"]),
    )
    return F.struct(usable.alias("usable"), dropped.alias("dropped"))


def _given(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def _scope_key(present: Column, values: list[Column]) -> Column:
    """Join key of a scope: which anchors are set, and their values."""
    return F.concat_ws("\u0001", present, *[F.coalesce(v, F.lit("\u0002")) for v in values])


def question_scope(questions: DataFrame) -> DataFrame:
    """Adds ``scope``, the key that meets ``scoped`` rows."""
    mask = F.concat(*[F.when(_given(c).isNotNull(), "1").otherwise("0") for c in SCOPE])
    return questions.withColumn("scope", _scope_key(mask, [_given(c) for c in SCOPE]))


def scoped(rows: DataFrame) -> DataFrame:
    """Each row once per subset of the three anchors, keyed like the questions.

    Meant for pre-aggregated rows: the eight-fold copy happens after reduction.
    """
    keys = []
    for bits in range(8):
        on = [bool(bits >> (2 - i) & 1) for i in range(3)]
        mask = F.lit("".join("1" if b else "0" for b in on))
        # An event outside a vocabulary never answers to an anchor of it.
        known = F.lit(True)
        for b, c in zip(on, SCOPE):
            if b:
                known = known & _given(c).isNotNull()
        value = [_given(c) if b else F.lit(None).cast("string") for b, c in zip(on, SCOPE)]
        keys.append(F.when(known, _scope_key(mask, value)))
    return rows.withColumn("scope", F.explode(F.array(*keys))).where(F.col("scope").isNotNull())


def _passes(constraint: Column, value_of: dict[str, Column]) -> Column:
    field, op, limit = constraint["field"], constraint["op"], constraint["value"]
    actual = F.lit(None).cast("double")
    for name, col in value_of.items():
        actual = F.when(field == name, col.cast("double")).otherwise(actual)
    compared = (
        F.when(op == ">", actual > limit)
        .when(op == "<", actual < limit)
        .when(op == ">=", actual >= limit)
        .when(op == "<=", actual <= limit)
        .when(op == "=", actual == limit)
        .otherwise(F.lit(True))
    )
    return F.coalesce(field.isin(*value_of), F.lit(False)) & F.coalesce(compared, F.lit(False))


def _all_pass(missing: str) -> Column:
    values = {
        c: F.coalesce(F.col(c), F.lit(0)) if missing == "zero" else F.col(c) for c in COUNT_FIELDS
    }
    used = F.coalesce("constraints", F.array().cast(CONSTRAINTS))
    return F.forall(used, lambda c: _passes(c, values))


def _signatures(questions: DataFrame) -> DataFrame:
    return question_scope(questions).withColumn(
        "signature", F.sha2(F.concat_ws("\u0001", "scope", F.to_json("constraints")), 256)
    )


def count_where(
    questions: DataFrame, events: DataFrame, min_confidence: float = MIN_CONFIDENCE, missing: str = "zero"
) -> DataFrame:
    """(qid, count_value, excluded_count) per question.

    Events collapse to a histogram of their constrainable values before they
    meet a question, and questions collapse to distinct signatures, so no
    question is ever paired with single events.
    """
    histogram = events.groupBy(
        *SCOPE, *COUNT_FIELDS, (F.col("parse_confidence") >= min_confidence).alias("sure")
    ).agg(F.count(F.lit(1)).alias("n"))
    spread = scoped(histogram).groupBy("scope", *COUNT_FIELDS, "sure").agg(F.sum("n").alias("n"))
    asked = _signatures(questions)
    distinct = asked.select("signature", "scope", "constraints").dropDuplicates(["signature"])
    counted = (
        distinct.join(spread, "scope")
        .where(_all_pass(missing))
        .groupBy("signature")
        .agg(
            F.sum(F.when(F.col("sure"), F.col("n")).otherwise(0)).alias("count_value"),
            F.sum(F.when(~F.col("sure"), F.col("n")).otherwise(0)).alias("excluded_count"),
        )
    )
    return asked.join(counted, "signature", "left").select(
        "qid",
        F.coalesce("count_value", F.lit(0)).cast("long").alias("count_value"),
        F.coalesce("excluded_count", F.lit(0)).cast("long").alias("excluded_count"),
    )


def count_members(
    questions: DataFrame, events: DataFrame, limit: int | None = None,
    min_confidence: float = MIN_CONFIDENCE, missing: str = "zero",
) -> DataFrame:
    """The counted events per question, first ``limit`` by event id (None: all).

    Questions meet cells (a scope with constrainable values), never single events, to decide what passes. With a limit, a cell
    holds its first ``limit`` events only, cut at the finest scopes before they are copied to the coarser ones; without one, events
    stay at their finest scope and are read once, by the cells that pass.
    """
    asked = _signatures(questions)
    distinct = asked.select("signature", "scope", "constraints").dropDuplicates(["signature"])
    wanted = distinct.select("scope").distinct()
    rows = events.where(F.col("parse_confidence") >= min_confidence).select(
        *SCOPE, "event_id", "event_name", "doc_id", "title", *COUNT_FIELDS
    )
    # NULL and "" are the same anchor of a scope, and one cell.
    finest = F.to_json(F.struct(*[_given(c).alias(c) for c in SCOPE], *COUNT_FIELDS))
    shown = ("event_id", "event_name", "doc_id", "title", *COUNT_FIELDS)

    def passing(cells: DataFrame) -> DataFrame:
        return distinct.join(cells, "scope").where(_all_pass(missing)).select("signature", "cell")

    if limit is None:
        held = rows.withColumn("cell", finest)
        cells = scoped(held.select(*SCOPE, *COUNT_FIELDS, "cell").dropDuplicates(["cell"])).join(wanted, "scope", "left_semi")
        hits = passing(cells).join(held, "cell")
    else:
        def first(held: DataFrame, *key: str) -> DataFrame:
            by_id = Window.partitionBy(*key).orderBy("event_id", "doc_id")
            return held.withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= limit).drop("rank")

        kept = first(rows.withColumn("cell", finest), "cell").drop("cell")
        spread = scoped(kept).join(wanted, "scope", "left_semi").withColumn("cell", F.to_json(F.struct("scope", *COUNT_FIELDS)))
        spread = first(spread, "cell")
        hits = passing(spread.select("scope", *COUNT_FIELDS, "cell").dropDuplicates(["cell"])).join(spread, "cell")
        hits = first(hits.select("signature", *shown), "signature")
    return asked.select("qid", "signature").join(hits.select("signature", *shown), "signature").drop("signature")


def count_description(constraints: Column) -> Column:
    """"Olympic events in S at G held at V with competitors > 72"."""

    def part(word: str, name: str) -> Column:
        return F.when(_given(name).isNotNull(), F.concat(F.lit(f"{word} "), F.col(name)))

    def shown(value: Column) -> Column:
        return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))

    clauses = F.transform(
        constraints, lambda c: F.concat_ws(" ", c["field"], c["op"], shown(c["value"]))
    )
    with_clause = F.when(
        F.size(clauses) > 0, F.concat(F.lit("with "), F.array_join(clauses, " and "))
    )
    return F.concat_ws(
        " ", F.lit("Olympic events"), part("in", "sport"), part("at", "games"), part("held at", "venue"),
        with_clause,
    )


def argmax(
    questions: DataFrame, events: DataFrame, top: int = TOP_RANKED,
    missing: str = "zero", min_confidence: float | None = None,
) -> DataFrame:
    """Top events per question by ``field`` ('nations', anything else: competitors).

    The best of every finest scope are found first; only those few rows are
    spread over the coarser scopes and ranked again.
    """
    pool = events if min_confidence is None else events.where(F.col("parse_confidence") >= min_confidence)
    measures = F.array(
        *[
            F.struct(F.lit(f).alias("measure"), F.col(f).cast("double").alias("value"))
            for f in ("competitors", "nations")
        ]
    )
    ranked = pool.select(
        *SCOPE, "event_id", "event_name", "doc_id", "title", F.explode(measures).alias("m")
    ).select("*", "m.measure", "m.value").drop("m")
    if missing == "zero":
        ranked = ranked.withColumn("value", F.coalesce("value", F.lit(0.0)))
    best_first = [F.col("value").desc_nulls_last(), F.col("event_id"), F.col("doc_id")]
    finest = Window.partitionBy(*SCOPE, "measure").orderBy(*best_first)
    kept = ranked.withColumn("rank", F.row_number().over(finest)).where(F.col("rank") <= top).drop("rank")
    coarse = Window.partitionBy("scope", "measure").orderBy(*best_first)
    leaders = (
        scoped(kept).withColumn("rank", F.row_number().over(coarse)).where(F.col("rank") <= top)
    ).drop(*SCOPE)
    asked = question_scope(questions).withColumn(
        "measure", F.when(F.col("field") == "nations", "nations").otherwise("competitors")
    )
    return asked.select("qid", "scope", "measure").join(leaders, ["scope", "measure"]).select(
        "qid", "rank", "event_id", "event_name", "doc_id", "title", "value"
    )


def lookup(questions: DataFrame, events: DataFrame, documents: DataFrame) -> DataFrame:
    """Event rows by id, else by name or page title, else the page itself.

    ``questions``: qid, event_id, title. ``matched`` tells which of
    'event' / 'document' answered.
    """
    asked = questions.select("qid", _given("event_id").alias("_id"), _given("title").alias("_title"))
    row = [c for c in EVENT_ROW if c in events.columns]
    named = events.select(
        F.explode(
            F.array_distinct(
                F.array(
                    F.concat(F.lit("i:"), "event_id"),
                    F.concat(F.lit("t:"), "event_name"),
                    F.concat(F.lit("t:"), "title"),
                )
            )
        ).alias("_key"),
        *row,
    )
    key = F.when(F.col("_id").isNotNull(), F.concat(F.lit("i:"), "_id")).otherwise(
        F.concat(F.lit("t:"), "_title")
    )
    hits = asked.withColumn("_key", key).join(named, "_key").select(
        "qid", F.lit("event").alias("matched"), *row
    )
    rest = (
        asked.where(F.col("_title").isNotNull())
        .join(hits.select("qid").distinct(), "qid", "left_anti")
        .join(documents.select("doc_id", F.col("title").alias("_title")), "_title")
        .select("qid", F.lit("document").alias("matched"), "doc_id", F.col("_title").alias("title"))
    )
    return hits.unionByName(rest, allowMissingColumns=True)


def medal_text(names: Column) -> Column:
    """Names the way result rows carry them: each followed by "; "."""
    return F.array_join(F.transform(names, lambda n: F.concat(n, F.lit("; "))), "")


# ---- traversal ------------------------------------------------------------------


def held_at(anchors: DataFrame, events: DataFrame) -> DataFrame:
    """HELD_AT from (qid, anchor): an event gives its venue, a venue its events."""
    keyed = events.select(
        F.explode(F.array_distinct(F.array("event_id", "event_name"))).alias("anchor"), "venue"
    )
    from_event = (
        anchors.join(keyed, "anchor")
        .select("qid", F.lit("venue").alias("kind"), "venue")
        .distinct()
    )
    is_event = from_event.select("qid").distinct()
    from_venue = (
        anchors.join(is_event, "qid", "left_anti")
        .join(events.select(F.col("venue").alias("anchor"), "event_id", "event_name", "doc_id", "title"), "anchor")
        .select("qid", F.lit("event").alias("kind"), F.col("anchor").alias("venue"),
                "event_id", "event_name", "doc_id", "title")
    )
    return from_event.where(F.col("venue").isNotNull()).unionByName(from_venue, allowMissingColumns=True)


def edition_walk(starts: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Final frontier of a walk: (qid, event_id).

    ``starts``: qid, event_id, hops, edge_type. Each hop keeps a set; a question stops at its own hop count (none: the start
    set). An edge type other than NEXT_EDITION walks PREV_EDITION. The frontier is one written table per hop, so the walk
    goes as far as it is asked to and each hop reads the one before.
    """
    links = edge_table.where(F.col("etype").isin("PREV_EDITION", "NEXT_EDITION")).select(
        "etype", F.col("src").alias("event_id"), F.col("dst").alias("_next")
    )
    frontier = starts.select(
        "qid", "event_id", F.col("hops").alias("left"),
        F.when(F.col("edge_type") == "NEXT_EDITION", "NEXT_EDITION").otherwise("PREV_EDITION").alias("etype"),
    ).distinct()
    arrived = frontier.where(F.col("left") <= 0)
    frontier = cut_lineage(frontier.where(F.col("left") > 0))
    while not frontier.isEmpty():
        stepped = cut_lineage(
            frontier.join(links, ["etype", "event_id"])
            .select("qid", F.col("_next").alias("event_id"), (F.col("left") - 1).alias("left"), "etype")
            .distinct()
        )
        arrived = arrived.unionByName(stepped.where(F.col("left") <= 0))
        frontier = stepped.where(F.col("left") > 0)
    return arrived.select("qid", "event_id").distinct()


# ---- narrowing --------------------------------------------------------------------


def tier(*flags: Column) -> Column:
    """Position of the first flag that holds (their number when none does)."""
    out = F.lit(len(flags))
    for i in range(len(flags) - 1, -1, -1):
        out = F.when(F.coalesce(flags[i], F.lit(False)), F.lit(i)).otherwise(out)
    return out


def keep_best_tier(rows: DataFrame, tiers: list[Column], by: str = "qid", bounded: bool = False) -> DataFrame:
    """Per question, narrow by each tier in turn, never to nothing.

    Narrowing by one tier after another keeps exactly the rows with the
    smallest (tier 1, tier 2, ...) tuple, so one partial aggregate finds it and
    is joined back: a question with very many rows stays spread over tasks.
    ``bounded`` says every question has few rows; a window then saves the join.
    """
    tiered = rows.withColumn("_tier", F.struct(*[t.alias(f"t{i}") for i, t in enumerate(tiers)]))
    if bounded:
        best = F.min("_tier").over(Window.partitionBy(by))
        return tiered.withColumn("_best", best).where(F.col("_tier") == F.col("_best")).drop("_tier", "_best")
    best = tiered.groupBy(by).agg(F.min("_tier").alias("_tier"))
    return tiered.join(best, [by, "_tier"]).drop("_tier")


def games_tier(anchor: str = "a_games") -> Column:
    """The anchored edition by id segment, else by year, else everything."""
    games = F.nullif(F.col(anchor), F.lit(""))
    return tier(
        F.col("event_id").contains(F.concat(F.lit("-"), games, F.lit("-"))),
        F.col("date_year").cast("string") == F.regexp_extract(games, "^([^-]*)", 1),
    )


def narrow_to_games(rows: DataFrame, anchor: str = "a_games", bounded: bool = False) -> DataFrame:
    """Keep the anchored edition's rows; all rows when none belongs to it."""
    return keep_best_tier(rows, [games_tier(anchor)], bounded=bounded)


def covers_date(year: Column, month: Column, day: Column) -> Column:
    """Whether an event's recorded date covers the anchored one (0/NULL: not given)."""

    def set_(c: Column) -> Column:
        return F.coalesce(c != 0, F.lit(False))

    start = F.col("date_day_start")
    end = F.coalesce(F.nullif(F.col("date_day_end"), F.lit(0)), start)
    year_ok = ~(set_(year) & set_(F.col("date_year"))) | (F.col("date_year") == year)
    month_ok = ~(set_(month) & set_(F.col("date_month"))) | (F.col("date_month") == month)
    day_ok = ~(set_(day) & set_(start)) | day.between(start, end)
    return year_ok & month_ok & day_ok


def date_tier() -> Column:
    """Date text quoted by the question, else covering the anchored date, else everything.

    Reads the anchors a_question, a_year, a_month, a_day.
    """
    said = tx.date_words(F.col("date_text"))
    asked = F.concat(F.lit(" "), tx.date_words(F.col("a_question")), F.lit(" "))
    quoted = (F.length(said) >= 5) & asked.contains(F.concat(F.lit(" "), said, F.lit(" ")))
    return tier(quoted, covers_date(F.col("a_year"), F.col("a_month"), F.col("a_day")))


def narrow_to_date(rows: DataFrame, bounded: bool = False) -> DataFrame:
    """Keep rows whose date the question states; all rows when none matches."""
    return keep_best_tier(rows, [date_tier()], bounded=bounded)


def named_events(questions: DataFrame, events: DataFrame, documents: DataFrame) -> DataFrame:
    """The event a question names: by derived id when it exists, else by title or id.

    ``questions``: qid, sport, games, title, event_id. The second, general
    lookup only runs for questions the first one left open.
    """
    derived = F.when(
        _given("event_id").isNull(), tx.event_id(_given("sport"), _given("games"), _given("title"))
    )
    exact = questions.select("qid", derived.alias("event_id")).where(F.col("event_id").isNotNull())
    first = exact.join(events, "event_id").select("qid", *[c for c in EVENT_ROW if c in events.columns])
    open_ = questions.join(first.select("qid").distinct(), "qid", "left_anti")
    second = lookup(open_, events, documents).join(
        questions.select("qid", F.col("games").alias("a_games")), "qid"
    )
    return first.unionByName(
        narrow_to_games(second).drop("a_games", "matched"), allowMissingColumns=True
    )


def multi_hop(
    questions: DataFrame, events: DataFrame, edge_table: DataFrame, documents: DataFrame
) -> DataFrame:
    """Named event -> edition walk -> attributes of the event reached.

    ``questions``: qid, sport, games, title, event_id, edge_type, hops, target_field.
    """
    by_id = questions.where(_given("event_id").isNotNull()).select("qid", "event_id")
    by_name = questions.where(_given("event_id").isNull() & _given("title").isNotNull())
    found = named_events(by_name, events, documents).where(F.col("event_id").isNotNull()).select("qid", "event_id")
    unnamed = by_name.join(found.select("qid").distinct(), "qid", "left_anti")
    by_text = unnamed.select("qid", F.col("title").alias("_t")).join(
        events.select("event_id", F.col("event_name").alias("_t")), "_t"
    ).select("qid", "event_id")
    starts = by_id.unionByName(found).unionByName(by_text).join(
        questions.select("qid", "edge_type", "hops"), "qid"
    )
    reached = edition_walk(starts, edge_table)
    return with_target(
        reached.join(events, "event_id").join(
            questions.select("qid", F.coalesce(_given("target_field"), F.lit("event_name")).alias("target_field")),
            "qid",
        )
    )


def with_target(rows: DataFrame) -> DataFrame:
    """Adds ``value``: the row's field named by ``target_field`` ("" when it has none)."""
    value = F.lit("")
    for name in EVENT_ROW:
        if name not in rows.columns:
            continue
        col = medal_text(F.col(name)) if name in ("gold", "silver", "bronze") else F.col(name).cast("string")
        value = F.when(F.col("target_field") == name, col).otherwise(value)
    return rows.withColumn("value", value)


def quoting_questions(asked: DataFrame, events: DataFrame) -> DataFrame:
    """(qid) of the questions whose words hold some event's date text as a run; ``asked``: qid, a_question."""
    said = events.select(tx.date_words(F.col("date_text")).alias("_said")).where(F.length("_said") >= 5).distinct()
    sizes = said.select(F.size(F.split("_said", " ")).alias("_n")).distinct().agg(F.collect_set("_n").alias("_sizes"))
    words = asked.select("qid", F.split(tx.date_words(F.col("a_question")), " ").alias("_words")).join(F.broadcast(sizes))
    runs = words.select("qid", "_words", F.explode("_sizes").alias("_n")).where(F.col("_n") <= F.size("_words"))
    at = F.explode(F.sequence(F.lit(1), F.size("_words") - F.col("_n") + 1)).alias("_at")
    held = runs.select("qid", "_words", "_n", at).select("qid", F.array_join(F.slice("_words", F.col("_at"), F.col("_n")), " ").alias("_said"))
    return held.join(said, "_said", "left_semi").select("qid").distinct()


def venue_event_sets(questions: DataFrame, events: DataFrame, alone: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``venue_events`` gives, not yet spread over the questions: (own, sets, members).

    ``own``: rows by ``qid`` of the questions that quote some event's date, and of those in ``alone`` (qid). All others with the same anchors
    and target have the same events: ``sets`` are their rows by ``_alike``, ``members`` the questions (``qid``, ``_alike``, anchors).
    """
    asked = questions.where(_given("venue").isNotNull()).select(
        "qid", "venue",
        F.col("games").alias("a_games"), F.col("sport").alias("a_sport"),
        F.col("question").alias("a_question"), F.col("date_year").alias("a_year"),
        F.col("date_month").alias("a_month"), F.col("date_day_start").alias("a_day"),
        F.coalesce(_given("target_field"), F.lit("event_name")).alias("target_field"),
    )
    edition = dates.edition_of(F.col("event_id"))
    marked = F.concat(F.lit("-"), edition, F.lit("-"))
    head = F.when(
        F.coalesce(edition, F.lit("")) != "", F.concat(F.split_part(F.col("event_id"), marked, F.lit(1)), marked)
    ).otherwise(F.col("event_id"))
    placed = events.drop("sport", "games").withColumn("_head", F.coalesce(head, F.lit("")))
    cells = placed.groupBy("venue", "_head", "date_year").agg(F.min("event_id").alias("event_id"))
    games = F.nullif(F.col("a_games"), F.lit(""))
    in_edition = F.when(games.isNotNull(), edition == games).when(
        F.coalesce(F.col("a_year"), F.lit(0)) != 0,
        edition.startswith(F.concat(F.col("a_year").cast("string"), F.lit("-"))),
    )
    in_sport = F.col("event_id").startswith(F.concat(tx.slug(F.nullif(F.col("a_sport"), F.lit(""))), F.lit("-")))
    year = F.coalesce("date_year", F.lit(-1))

    def narrowed_by(rows: DataFrame, by: str) -> DataFrame:
        best = keep_best_tier(rows.join(cells, "venue"), [tier(in_edition), tier(in_sport), games_tier()], by=by)
        chosen = best.drop("event_id").withColumn("_year", year).drop("date_year")
        met = chosen.join(placed.withColumn("_year", year), ["venue", "_head", "_year"]).drop("_head", "_year")
        return keep_best_tier(met, [date_tier()], by=by)

    def digest(*cols: str) -> Column:
        return F.sha2(F.to_json(F.struct(*cols)), 256)

    anchors = ["venue", "a_games", "a_sport", "a_year", "a_month", "a_day"]
    single = quoting_questions(asked, placed)
    if alone is not None:
        single = single.union(alone.select("qid")).distinct()
    marked_asked = asked.join(single.withColumn("_single", F.lit(True)), "qid", "left")
    own = narrowed_by(marked_asked.where("_single").drop("_single"), "qid")
    alike = marked_asked.where("_single IS NULL AND qid IS NOT NULL").drop("_single").withColumns(
        {"_anchored": digest(*anchors), "_alike": digest(*anchors, "target_field")}
    )
    found = narrowed_by(alike.select("_anchored", *anchors).distinct().withColumn("a_question", F.lit("")), "_anchored")
    kinds = alike.select("_anchored", "_alike", "target_field").distinct()
    sets = found.drop(*anchors[1:], "a_question").join(kinds, "_anchored").drop("_anchored")
    return with_target(own), with_target(sets), alike.drop("_anchored", "venue", "target_field")


def spread(sets: DataFrame, members: DataFrame, *by: str) -> DataFrame:
    """Every member (``qid``, ``_alike``, ...) with every row of its set (``_alike``, ...), made by one join that is not shuffled again.

    Few sets with many rows and members each: rows are dealt to slots by ``by``, so that no task gets a whole set, and meet members in
    groups that are opened after the join. Both sides are small beside what they give, so the number of tasks is stated: sized
    by its input, the join would be one task.
    """
    rest = [c for c in members.columns if c != "_alike"]
    slots = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLOTS - 1).cast("long")))
    grouped = members.groupBy("_alike", F.pmod(F.xxhash64("qid"), F.lit(GROUPS)).alias("_group")).agg(F.collect_list(F.struct(*rest)).alias("_members"))
    asked = grouped.select("_alike", "_members", slots.alias("_slot")).repartition(SPREAD_TASKS, "_alike", "_slot")
    dealt = sets.withColumn("_slot", F.pmod(F.xxhash64(*by), F.lit(SLOTS))).repartition(SPREAD_TASKS, "_alike", "_slot")
    met = asked.join(dealt, ["_alike", "_slot"]).withColumn("_m", F.explode("_members"))
    return met.select(*[F.col(f"_m.{c}").alias(c) for c in rest], *[c for c in sets.columns if c != "_alike"])


def venue_events(questions: DataFrame, events: DataFrame, limit: int | None = None) -> DataFrame:
    """Events held at the anchored venue, narrowed by edition, sport, games and date, with their attributes.

    ``questions``: qid, venue, games, sport, question, date_year, date_month, date_day_start, target_field. ``limit``: keep so
    many per question after all narrowing, by event id (None: all). A venue's events are first reduced to cells of one
    edition, sport and year; the best cells of a question are chosen there, and only their events are read, so a
    question never meets all events of its venue. Questions that quote no event's date and have the same anchors have the same
    events: those are found once for all of them, and only then meet the questions, without a further shuffle of the result.
    """
    own, sets, members = venue_event_sets(questions, events)
    narrowed = own.unionByName(spread(sets, members, "event_id"))
    if limit is not None:
        by_id = Window.partitionBy("qid").orderBy("event_id", "doc_id")
        narrowed = narrowed.withColumn("_r", F.row_number().over(by_id)).where(F.col("_r") <= limit).drop("_r")
    return narrowed


def document_chunks(doc_ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every chunk of the asked documents (qid, doc_id), ordered by (doc_id, seq) within qid."""
    return doc_ids.select("qid", "doc_id").distinct().join(chunks, "doc_id")
