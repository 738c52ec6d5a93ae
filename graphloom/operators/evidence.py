"""Evidence rows: one shape for every tool, rendering, selection, checks, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators.retrieval import MAX_MEMBERS, medal_text

# ---- fixed values -----------------------------------------------------------
STRUCTURED = ("graph_traversal", "multi_hop", "aggregation_count", "aggregation_argmax")
PROSE = ("similarity_search", "document_retrieval")
CONTEXT_ROWS = 20
CHECK_ROWS = 8
CHECK_STRUCTURED = 4
CHECK_CHARS = 400
SNIPPET_CHARS = 600
MIN_OVERLAP = 2
FIGURE = (
    r"(?iU)\b(?!(?:1[89]|20)\d\d\b)(\d[\d,]*)\s+"
    r"(nations|countries|NOCs|competitors|athletes|participants)\b(?!\s*:)"
)
FIGURE_FIELDS = {
    "nations": "nations", "countries": "nations", "nocs": "nations",
    "competitors": "competitors", "athletes": "competitors", "participants": "competitors",
}
# -----------------------------------------------------------------------------

#: Every column an evidence row may carry, with its type.
COLUMNS = {
    "qid": "string", "pos": "long", "source": "string", "doc_id": "string", "chunk_id": "string",
    "event_id": "string", "event_name": "string", "title": "string", "counted_event": "string",
    "count": "long", "counted": "string", "counted_events_listed": "string", "excluded_count": "long",
    "competitors": "int", "competitors_text": "string", "nations": "int", "nations_text": "string",
    "date_text": "string", "date_year": "int", "date_month": "int", "date_day_start": "int",
    "date_day_end": "int", "gold": "string", "silver": "string", "bronze": "string",
    "gold_noc": "string", "win_value": "string", "win_label": "string", "parse_confidence": "double",
    "target_field": "string", "value": "string", "text": "string", "seq": "int", "score": "double",
}
_SHOWN = {
    "aggregation_count": (
        "count", "counted", "counted_events_listed", "counted_event", "title", "competitors", "date_year",
        "nations", "event_id",
    ),
    "aggregation_argmax": ("event_id", "event_name", "title", "value"),
    "graph_traversal": (
        "event_id", "event_name", "title", "competitors", "competitors_text", "nations", "nations_text",
        "date_text", "date_year", "date_month", "date_day_start", "date_day_end", "gold", "silver",
        "bronze", "gold_noc", "win_value", "win_label", "parse_confidence", "target_field", "value",
    ),
}


def conform(rows: DataFrame, source: str | None = None) -> DataFrame:
    """The evidence shape: known columns only, absent ones NULL."""
    have = set(rows.columns)

    def pick(name: str, kind: str) -> Column:
        if name == "source" and source is not None:
            col = F.lit(source)
        elif name in ("gold", "silver", "bronze") and name in have and dict(rows.dtypes)[name].startswith("array"):
            col = medal_text(F.col(name))
        elif name in have:
            col = F.col(name).cast(kind)
        else:
            col = F.lit(None).cast(kind)
        return col.alias(name)

    return rows.select(*[pick(n, k) for n, k in COLUMNS.items()])


def from_counts(counts: DataFrame, members: DataFrame, limit: int = MAX_MEMBERS) -> DataFrame:
    """The count row first, then the first counted events by id.

    ``counts``: qid, count_value, excluded_count, counted. ``members``: the
    counted events, at least the first ``limit`` of each question.
    """
    head = counts.select(
        "qid", F.lit(0).alias("pos"), F.col("count_value").alias("count"), "excluded_count", "counted",
        F.when(
            F.col("count_value") > limit, F.concat(F.lit(f"{limit} of "), F.col("count_value").cast("string"))
        ).alias("counted_events_listed"),
        F.lit("").alias("doc_id"),
    )
    by_id = Window.partitionBy("qid").orderBy("event_id", "doc_id")
    rest = (
        members.withColumn("pos", F.row_number().over(by_id)).where(F.col("pos") <= limit)
        .withColumnRenamed("event_name", "counted_event")
        .withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in ("competitors", "nations", "date_year")})
    )
    return conform(head, "aggregation_count").unionByName(conform(rest, "aggregation_count"))


def render(prefix: str = "") -> Column:
    """An evidence row as context text: its prose, else its non-empty fields."""

    def col(name: str) -> Column:
        return F.col(f"{prefix}{name}")

    def fields(names: tuple[str, ...]) -> Column:
        parts = []
        for name in names:
            value = col(name)
            if COLUMNS[name] == "string":
                # An empty field is left out; one that is only separators keeps its name.
                value = F.when(value != "", tx.strip(F.rtrim(tx.strip(value), F.lit(";"))))
            parts.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"))))
        return F.concat_ws("; ", *parts)

    source = col("source")
    structured = fields(_SHOWN["graph_traversal"])
    for name in ("aggregation_count", "aggregation_argmax"):
        structured = F.when(source == name, fields(_SHOWN[name])).otherwise(structured)
    return F.when(col("text") != "", tx.strip(col("text"))).otherwise(structured)


def without_repeats(rows: DataFrame) -> DataFrame:
    """Evidence appended again is dropped: the first of identical rows stays.

    Identical rows differ in ``pos`` only, so every column is taken by itself, and those that nobody reads afterwards are not shuffled.
    """
    payload = [c for c in rows.columns if c != "pos"]
    key = F.unhex(F.sha2(F.to_json(F.struct(*payload)), 256))
    return (
        rows.withColumn("_k", key)
        .groupBy("qid", "_k")
        .agg(F.min("pos").alias("pos"), *[F.any_value(c).alias(c) for c in payload if c != "qid"])
        .select(*rows.columns)
    )


def overlap_score(question: Column, text: Column) -> Column:
    """Default relevance: share of the question's words the text has."""
    asked = tx.word_set(question)
    return F.size(F.array_intersect(asked, tx.word_set(text))) / F.greatest(F.lit(1), F.size(asked))


def rerank(rows: DataFrame, score: Column, limit: int | None = None) -> DataFrame:
    """Adds ``rank`` per question by score, unscored rows last, ties in given order."""
    order = Window.partitionBy("qid").orderBy(score.desc_nulls_last(), "pos", "chunk_id")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def context_rows(evidence: DataFrame, score: Column, limit: int = CONTEXT_ROWS) -> DataFrame:
    """What the model is shown: structured rows in order, then prose by relevance."""
    prose = F.col("source").isin(*PROSE)
    order = Window.partitionBy("qid").orderBy(
        prose, F.when(prose, score).desc_nulls_last(), F.col("pos"), F.col("chunk_id")
    )
    return evidence.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def context_block(shown: DataFrame, empty: str = "No relevant evidence found.", questions: DataFrame | None = None) -> DataFrame:
    """(qid, context): numbered, sourced blocks of the shown rows."""
    source = F.coalesce(F.nullif(F.col("doc_id"), F.lit("")), F.nullif(F.col("event_id"), F.lit("")), F.lit("unknown"))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] [Source: "), source, F.lit("]\n"), render())
    return _joined(shown, block, empty, questions)


def chunk_context_block(shown: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """(qid, context) in the plain-retrieval layout."""
    block = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] [Doc: "), F.coalesce("doc_id", F.lit("unknown")),
        F.lit(" | Chunk: "), F.coalesce("chunk_id", F.lit("unknown")), F.lit("]\n"),
        tx.strip(F.coalesce("text", F.lit(""))),
    )
    return _joined(shown, block, "No relevant documents found.", questions)


def _joined(shown: DataFrame, block: Column, empty: str, questions: DataFrame | None) -> DataFrame:
    out = (
        shown.select("qid", "rank", block.alias("b"))
        .groupBy("qid")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "b"))).alias("l"))
        .select("qid", F.array_join(F.transform("l", lambda x: x["b"]), "\n\n").alias("context"))
    )
    if questions is None:
        return out
    return questions.select("qid").join(out, "qid", "left").withColumn(
        "context", F.coalesce("context", F.lit(empty))
    )


def check_sample(evidence: DataFrame) -> DataFrame:
    """Rows the groundedness check sees: up to four structured, then the newest prose."""
    prose = ~F.col("source").isin(*STRUCTURED) & (F.coalesce("text", F.lit("")) != "")
    forward = Window.partitionBy("qid", "_p").orderBy("pos", "chunk_id")
    backward = Window.partitionBy("qid", "_p").orderBy(F.col("pos").desc(), F.col("chunk_id").desc())
    marked = evidence.withColumn("_p", prose)
    head = marked.where(~F.col("_p")).withColumn("_r", F.row_number().over(forward)).where(
        F.col("_r") <= CHECK_STRUCTURED
    )
    tail = marked.where("_p").withColumn("_r", F.row_number().over(backward)).where(F.col("_r") <= CHECK_ROWS)
    order = Window.partitionBy("qid").orderBy("_p", "pos", "chunk_id")
    return (
        head.unionByName(tail)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= CHECK_ROWS)
        .select("qid", "rank", "source", F.substring(render(), 1, CHECK_CHARS).alias("line"))
    )


def _shared_words(text: Column) -> Column:
    return F.array_except(tx.word_set(text), F.array(*[F.lit(w) for w in tx.OVERLAP_STOPWORDS]))


def _pairs(words: Column) -> Column:
    """All pairs (x, y) of a sorted array."""
    return F.flatten(
        F.transform(words, lambda x, i: F.transform(F.slice(words, i + 2, F.size(words)), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    )


def _figures(overlaps: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("source").isin("aggregation_count", "aggregation_argmax")).alias("n_agg"),
        F.count_if(F.col("source").isin("graph_traversal", "multi_hop")).alias("n_walk"),
        F.bool_or(overlaps).alias("overlaps"),
        F.sum(F.coalesce("excluded_count", F.lit(0))).alias("excluded"),
    ]


def _seen_in_sets(asked: DataFrame, sets: DataFrame, members: DataFrame) -> DataFrame:
    """What a question's set shows of it, without joining its rows to its questions.

    A row overlaps a question if both hold the same pair of words (MIN_OVERLAP is 2). A set's rows are reduced to the words that some
    question of the set says, and to distinct pairs of them; questions look their pairs up there.
    """
    said = members.join(asked.select("qid", "question"), "qid").select(
        "_alike", "qid", F.array_sort(_shared_words(F.col("question"))).alias("words")
    )
    words = said.select("_alike", F.explode("words").alias("w")).distinct()
    lines = sets.select(F.col("qid").alias("_alike"), _shared_words(render()).alias("words")).withColumn("_line", F.monotonically_increasing_id())
    met = lines.select("_alike", "_line", F.explode("words").alias("w")).join(words, ["_alike", "w"])
    kept = met.groupBy("_alike", "_line").agg(F.array_sort(F.collect_list("w")).alias("words")).select("_alike", "words").distinct()
    held = kept.select("_alike", F.explode(_pairs(F.col("words"))).alias("pair")).distinct()
    overlapping = said.select("_alike", "qid", F.explode(_pairs(F.col("words"))).alias("pair")).join(held, ["_alike", "pair"], "left_semi")
    figures = sets.groupBy(F.col("qid").alias("_alike")).agg(*_figures(F.lit(False))).drop("overlaps")
    marks = overlapping.select("qid").distinct().withColumn("overlaps", F.lit(True))
    return members.select("qid", "_alike").join(figures, "_alike").join(marks, "qid", "left").drop("_alike")


def evaluate(questions: DataFrame, evidence: DataFrame, sets: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """Scope coverage, deterministic groundedness and the fallback they call for.

    ``questions``: qid, question, operation. ``sets``: evidence whose ``qid`` is that of a set, shown to every question that ``members``
    (qid, _alike) gives the set; these questions have no rows in ``evidence``.
    """
    asked = questions.select("qid", "question", "operation")
    shared = F.array_intersect(tx.word_set(F.col("question")), _shared_words(render()))
    seen = evidence.join(asked.select("qid", "question"), "qid").groupBy("qid").agg(*_figures(F.size(shared) >= MIN_OVERLAP))
    if sets is not None:
        seen = seen.unionByName(_seen_in_sets(asked, sets, members))
    rows = asked.join(seen, "qid", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("n", "n_agg", "n_walk", "excluded")}
    ).withColumn("overlaps", F.coalesce("overlaps", F.lit(False)) & (F.col("question") != ""))
    counting = F.col("operation").isin("COUNT", "ARGMAX")
    scope = F.when(F.col("n") == 0, False).when(counting, F.col("n_agg") > 0).otherwise(True)

    def said(col: str, what: str) -> Column:
        return F.concat(F.lit("scope: "), F.col(col).cast("string"), F.lit(f" {what}(s)"))

    scope_note = (
        F.when(F.col("n") == 0, F.lit("Empty evidence set"))
        .when(counting & (F.col("n_agg") > 0), said("n_agg", "aggregation result"))
        .when(counting, F.lit("COUNT/ARGMAX operation but no aggregation results in evidence"))
        .when(F.col("operation") == "LOOKUP", said("n", "lookup result"))
        .when((F.col("operation") == "TRAVERSE") & (F.col("n_walk") > 0), said("n_walk", "traversal result"))
        .when(F.col("operation") == "TRAVERSE", said("n", "fallback result"))
        .otherwise(said("n", "evidence item"))
    )
    ground_note = F.when(F.col("overlaps"), "deterministic groundedness: token overlap pass").otherwise(
        "deterministic groundedness: insufficient token overlap"
    )
    excluded_note = F.when(
        F.col("excluded") > 0, F.concat(F.lit("parse_confidence_excluded="), F.col("excluded").cast("string"))
    )
    return rows.select(
        "qid", "n", "excluded",
        scope.alias("scope_coverage_pass"),
        (scope & F.col("overlaps")).alias("groundedness_pass"),
        (scope & F.col("overlaps")).alias("is_sufficient"),
        F.when(~scope, "scope_coverage_fail").when(~F.col("overlaps"), "groundedness_fail").otherwise("none").alias(
            "fallback_trigger"
        ),
        F.when(~scope, scope_note).when(~F.col("overlaps"), ground_note).otherwise(
            F.concat_ws("; ", scope_note, ground_note, excluded_note)
        ).alias("notes"),
    )


def citations(shown: DataFrame, unique: bool = True) -> DataFrame:
    """(qid, source_id, chunk_id, ref_type, snippet); rows without a source are dropped.

    ``unique`` keeps one citation per (source, chunk), the first shown.
    """
    source = F.coalesce(F.nullif(F.col("doc_id"), F.lit("")), F.nullif(F.col("event_id"), F.lit("")))
    cited = shown.select(
        "qid", "rank", source.alias("source_id"), "chunk_id",
        F.when(F.coalesce("chunk_id", F.lit("")) != "", "chunk").otherwise("entity").alias("ref_type"),
        F.nullif(F.substring(render(), 1, SNIPPET_CHARS), F.lit("")).alias("snippet"),
    ).where(F.col("source_id").isNotNull())
    if not unique:
        return cited
    return (
        cited.groupBy("qid", "source_id", "chunk_id")
        .agg(F.min_by(F.struct("rank", "ref_type", "snippet"), "rank").alias("c"))
        .select("qid", "source_id", "chunk_id", "c.rank", "c.ref_type", "c.snippet")
    )


# ---- answers against evidence -------------------------------------------------------


def conflicts(evidence: DataFrame) -> DataFrame:
    """(qid, doc_id, field, infobox, stated): a page's prose states a figure once, differently."""
    prose = evidence.where((F.col("text") != "") & F.col("doc_id").isNotNull())
    words = F.regexp_extract_all("text", F.lit(FIGURE), F.lit(2))
    numbers = F.regexp_extract_all("text", F.lit(FIGURE), F.lit(1))
    kinds = F.create_map(*[F.lit(x) for pair in FIGURE_FIELDS.items() for x in pair])
    stated = (
        prose.select("qid", "doc_id", F.explode(F.arrays_zip(numbers.alias("n"), words.alias("w"))).alias("f"))
        .select(
            "qid", "doc_id",
            F.element_at(kinds, F.lower("f.w")).alias("field"),
            F.replace(F.col("f.n"), F.lit(","), F.lit("")).try_cast("long").alias("v"),
        )
        .groupBy("qid", "doc_id", "field")
        .agg(F.min("v").alias("stated"), F.max("v").alias("_top"))
        .where(F.col("stated") == F.col("_top"))
        .drop("_top")
    )
    rows = evidence.where((F.coalesce("text", F.lit("")) == "") & (F.coalesce("doc_id", F.lit("")) != ""))
    figures = rows.select(
        "qid", "doc_id", F.coalesce("title", "event_name", "doc_id").alias("name"),
        F.explode(
            F.array(
                F.struct(F.lit("nations").alias("field"), F.col("nations").cast("long").alias("infobox")),
                F.struct(F.lit("competitors").alias("field"), F.col("competitors").cast("long").alias("infobox")),
            )
        ).alias("f"),
    ).select("qid", "doc_id", "name", "f.field", "f.infobox").where(F.col("infobox") > 0).distinct()
    return figures.join(stated, ["qid", "doc_id", "field"]).where(F.col("infobox") != F.col("stated")).select(
        "qid", "doc_id", "field", "infobox", "stated",
        F.format_string("%s on %s (%s): infobox %d, page text %d", "field", "name", "doc_id", "infobox", "stated").alias(
            "line"
        ),
    )


def strip_echo(answer: Column, keys: tuple[str, ...]) -> Column:
    """Cut a copied ``key:`` field off the end of an answer."""
    names = "|".join(sorted((k for k in keys if len(k) > 2), key=len, reverse=True))
    head = tx.strip(F.regexp_extract(answer, rf"(?sU)^(.*?)[\s;,]+(?:{names})\s*:", 1))
    return F.coalesce(F.nullif(head, F.lit("")), answer)


def resolve_answers(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, answer, changed, supported, note): event names become page titles when unambiguous.

    ``answers``: qid, answer.
    """
    keys = tuple(c for c in COLUMNS if c not in ("qid", "pos"))
    rows = evidence.where(~F.col("source").isin(*PROSE) & (F.coalesce("text", F.lit("")) == ""))
    held = answers.select("qid", F.col("answer").alias("given")).withColumn(
        "answer", strip_echo(F.coalesce("given", F.lit("")), keys)
    ).withColumn("target", tx.normalize_answer(F.col("answer"))).withColumn(
        "names", F.transform(tx.split_names(F.col("answer")), tx.normalize_answer)
    )
    # Rows are rendered before the join, in generated code, and normalised after it, where lambdas evaluate all that stands inside them.
    named = rows.select(
        "qid", "title", F.lit(True).alias("_row"), render().alias("line"),
        F.coalesce(F.nullif(F.col("event_name"), F.lit("")), F.col("counted_event")).alias("event"), tx.event_part(F.col("title")).alias("part"),
    )
    hit = (F.col("target") != "") & (F.coalesce("title", F.lit("")) != "") & (
        (tx.normalize_answer(F.col("event")) == F.col("target")) | (tx.normalize_answer(F.col("part")) == F.col("target"))
    )
    # Names are looked for row by row; a name found in any row is supported.
    found = tx.let(
        F.concat(F.lit(" "), tx.normalize_answer(F.col("line")), F.lit(" ")),
        lambda line: F.filter("names", lambda n: (n != "") & line.contains(F.concat(F.lit(" "), n, F.lit(" ")))),
    )
    # One join on the question, on which the rows stay: an answer's rows are put together where they meet it.
    held = held.withColumn("_id", F.monotonically_increasing_id())
    out = held.join(named, "qid", "left").select(*held.columns, "_row", F.when(hit, F.col("title")).alias("t"), F.when(F.col("_row"), found).alias("f")).groupBy(
        *held.columns
    ).agg(
        F.min("t").alias("title"), F.max("t").alias("_last"), F.size(F.collect_set("t")).alias("n_titles"),
        F.size(F.array_distinct(F.flatten(F.collect_set("f")))).alias("n_found"), F.max("_row").alias("has_rows"),
    )
    wanted = F.array_distinct(F.filter("names", lambda n: n != ""))
    no_rows = F.col("has_rows").isNull() | (F.coalesce("given", F.lit("")) == "")
    to_title = F.coalesce(F.col("title") == F.col("_last"), F.lit(False)) & (tx.normalize_answer(F.col("title")) != F.col("target"))
    supported = (F.size(wanted) > 0) & (F.col("n_found") == F.size(wanted))
    base_note = F.when(
        F.col("n_titles") > 1,
        F.concat(F.lit("answer matches "), F.col("n_titles").cast("string"), F.lit(" events among the rows; left as given")),
    ).when(supported, "answer found in the graph evidence").otherwise("answer not found in the graph evidence")
    echo_note = F.when(
        F.col("answer") != F.col("given"),
        F.concat(F.lit("evidence field copied after the answer removed ('"), "given", F.lit("'); ")),
    ).otherwise("")
    return out.select(
        "qid",
        F.when(no_rows, F.col("given")).when(to_title, F.col("title")).otherwise(F.col("answer")).alias("answer"),
        F.when(no_rows, False).otherwise(to_title | (F.col("answer") != F.col("given"))).alias("changed"),
        F.when(~no_rows, to_title | supported).alias("supported"),
        F.when(no_rows, "no structured evidence to check the answer against")
        .when(
            to_title,
            F.concat(F.lit("answer named the event; resolved to its page title '"), "title", F.lit("'")),
        )
        .otherwise(F.concat(echo_note, base_note))
        .alias("note"),
    )
