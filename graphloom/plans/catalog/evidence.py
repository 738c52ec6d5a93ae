"""Evidence, citation and answer-check queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import documents as docs
from graphloom.operators import evidence as ev
from graphloom.operators import graph as g
from graphloom.operators import retrieval as rt
from graphloom.plans import answer as an
from graphloom.plans.catalog import query
from graphloom.plans.catalog.corpus import CHUNKS
from graphloom.plans.catalog.sql import CENTRES, EVENTS, STOP, normalize, word_set
from graphloom.plans.world import World
from graphloom.session import cut_lineage

# A question per customer; its structured evidence are the customer's orders,
# its prose the turns of the conversation of the same number.
_STRUCTURED = f"""{EVENTS}, rows AS (
  SELECT 'q' || right(event_name, 9)::BIGINT AS qid, 'multi_hop' AS source, o_orderkey AS pos, doc_id, NULL AS chunk_id, event_id, event_name,
    title, competitors, nations, NULL AS text FROM ev),
prose AS (
  SELECT 'q' || conv_id AS qid, 'document_retrieval' AS source, 1000000000 + turn AS pos, 'c' || conv_id AS doc_id,
    'c' || conv_id || '_c' || turn AS chunk_id, NULL AS event_id, NULL AS event_name, NULL AS title, NULL::INT AS competitors, NULL::INT AS nations, text
  FROM conversations),
evidence AS (SELECT * FROM rows UNION ALL SELECT * FROM prose)"""


def evidence(w: World) -> DataFrame:
    rows = w.events().select(
        F.concat(F.lit("q"), F.expr("cast(cast(right(event_name, 9) as bigint) as string)")).alias("qid"),
        F.regexp_extract("doc_id", r"(\d+)", 1).cast("long").alias("pos"), "doc_id", "event_id", "event_name", "title",
        "competitors", "nations",
    )
    prose = w.table("conversations").select(
        F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("qid"), (F.col("turn") + 1_000_000_000).alias("pos"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("doc_id"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_c"), F.col("turn").cast("string")).alias("chunk_id"),
        "text",
    )
    return ev.conform(rows, "multi_hop").unionByName(ev.conform(prose, "document_retrieval"))


_RENDER = """CASE WHEN text <> '' THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE concat_ws('; ', 'event_id: ' || event_id, 'event_name: ' || event_name,
  'title: ' || title, 'competitors: ' || competitors, 'nations: ' || nations) END"""


@query("fn13_render", f"WITH {_STRUCTURED} SELECT qid, pos, md5({_RENDER}) AS line FROM evidence")
def _render(spark: SparkSession, sf: str) -> DataFrame:
    return evidence(World(spark, sf)).select("qid", "pos", F.md5(ev.render()).alias("line"))


def questions(w: World) -> DataFrame:
    k = F.col("c_custkey")
    op = F.element_at(F.array(*[F.lit(o) for o in ("LOOKUP", "COUNT", "ARGMAX", "TRAVERSE")]), (k % 4 + 1).cast("int"))
    return w.table("customer").select(
        F.concat(F.lit("q"), k.cast("string")).alias("qid"),
        F.when(k % 3 == 0, F.lit("and the an thing was in on")).otherwise(
            F.concat(F.lit("Which race of "), F.col("c_name"), F.lit(" was the largest at the Olympics?"))
        ).alias("question"),
        op.alias("operation"),
    )


@query(
    "ev11_evaluate",
    f"""WITH {_STRUCTURED}, q AS (SELECT 'q' || c_custkey AS qid, ['LOOKUP','COUNT','ARGMAX','TRAVERSE'][c_custkey % 4 + 1] AS op,
      CASE WHEN c_custkey % 3 = 0 THEN 'and the an thing was in on' ELSE 'Which race of ' || c_name || ' was the largest at the Olympics?' END AS question FROM customer),
    s AS (SELECT qid, count(*) AS n, bool_or(len(list_filter(list_intersect({word_set('question')}, {word_set(_RENDER)}),
        lambda x: (NOT list_contains({STOP}, x)))) >= 2) AS has_overlap FROM evidence JOIN q USING (qid) GROUP BY qid),
    e AS (SELECT q.qid, coalesce(n, 0) AS n, (coalesce(n, 0) > 0 AND op NOT IN ('COUNT', 'ARGMAX')) AS scope_ok, coalesce(has_overlap, false) AS o2
          FROM q LEFT JOIN s USING (qid))
    SELECT qid, n, scope_ok AS scope_coverage_pass, scope_ok AND o2 AS is_sufficient,
      CASE WHEN NOT scope_ok THEN 'scope_coverage_fail' WHEN NOT o2 THEN 'groundedness_fail' ELSE 'none' END AS fallback_trigger FROM e""",
)
def _evaluate(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    return ev.evaluate(questions(w), evidence(w)).select("qid", "n", "scope_coverage_pass", "is_sufficient", "fallback_trigger")


_SHOWN = f"""{_STRUCTURED}, shown AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY source = 'document_retrieval', CASE WHEN source = 'document_retrieval' THEN length(text) END DESC,
    pos, chunk_id)::INT AS rank FROM evidence QUALIFY rank <= 20)"""


def shown(w: World) -> DataFrame:
    return ev.context_rows(evidence(w), F.length("text"))


@query("top5_context_rows", f"WITH {_SHOWN} SELECT qid, rank, source, pos FROM shown")
def _context_rows(spark: SparkSession, sf: str) -> DataFrame:
    return shown(World(spark, sf)).select("qid", "rank", "source", "pos")


@query(
    "fn14_context_block",
    f"""WITH {_SHOWN} SELECT qid, md5(string_agg('[' || rank || '] [Source: ' || doc_id || ']' || chr(10) || {_RENDER}, chr(10) || chr(10) ORDER BY rank)) AS digest
    FROM shown GROUP BY qid""",
)
def _block(spark: SparkSession, sf: str) -> DataFrame:
    return ev.context_block(shown(World(spark, sf))).select("qid", F.md5("context").alias("digest"))


@query(
    "fn14_chunk_context",
    f"""WITH {_SHOWN} SELECT qid, md5(string_agg('[' || rank || '] [Doc: ' || doc_id || ' | Chunk: ' || coalesce(chunk_id, 'unknown') || ']' || chr(10)
      || regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY rank)) AS digest FROM shown GROUP BY qid""",
)
def _chunk_block(spark: SparkSession, sf: str) -> DataFrame:
    return ev.chunk_context_block(shown(World(spark, sf))).select("qid", F.md5("context").alias("digest"))


@query(
    "ev21_citations",
    f"""WITH {_SHOWN} SELECT qid, doc_id AS source_id, chunk_id, min(rank) AS rank, CASE WHEN chunk_id IS NULL THEN 'entity' ELSE 'chunk' END AS ref_type,
      md5(left(arg_min({_RENDER}, rank), 600)) AS snippet FROM shown GROUP BY ALL""",
)
def _citations(spark: SparkSession, sf: str) -> DataFrame:
    return ev.citations(shown(World(spark, sf))).withColumn("snippet", F.md5("snippet"))


@query(
    "set9_citations_repeated",
    f"""WITH {_SHOWN} SELECT qid, count(*) AS n FROM shown GROUP BY qid""",
)
def _repeated(spark: SparkSession, sf: str) -> DataFrame:
    return ev.citations(shown(World(spark, sf)), unique=False).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))


@query(
    "set2_without_repeats",
    f"WITH {_STRUCTURED} SELECT qid, pos, source FROM evidence",
)
def _no_repeats(spark: SparkSession, sf: str) -> DataFrame:
    rows = evidence(World(spark, sf))
    again = rows.withColumn("pos", F.col("pos") + 5_000_000_000)
    return ev.without_repeats(rows.unionByName(again)).select("qid", "pos", "source")


@query(
    "top6_check_sample",
    f"""WITH {_STRUCTURED}, h AS (SELECT *, false AS p FROM evidence WHERE source = 'multi_hop'
        QUALIFY row_number() OVER (PARTITION BY qid ORDER BY pos) <= 4),
    t AS (SELECT *, true AS p FROM evidence WHERE source <> 'multi_hop' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY pos DESC) <= 8)
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY p, pos)::INT AS rank, source, md5(left({_RENDER}, 400)) AS line
    FROM (SELECT * FROM h UNION ALL SELECT * FROM t) QUALIFY rank <= 8""",
)
def _sample(spark: SparkSession, sf: str) -> DataFrame:
    return ev.check_sample(evidence(World(spark, sf))).withColumn("line", F.md5("line"))


@query(
    "top4_rerank",
    """WITH s AS (SELECT conv_id, turn, CASE WHEN role <> 'system' THEN length(text) END AS score FROM conversations)
    SELECT 'q' || conv_id AS qid, turn AS pos, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC NULLS LAST, turn)::INT AS rank FROM s""",
)
def _rerank(spark: SparkSession, sf: str) -> DataFrame:
    rows = World(spark, sf).table("conversations").select(
        F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("qid"), F.col("turn").alias("pos"), F.lit("").alias("chunk_id"),
        F.when(F.col("role") != "system", F.length("text")).alias("score"),
    )
    return ev.rerank(rows, F.col("score")).select("qid", "pos", "rank")


@query(
    "udf2_overlap_score",
    f"""SELECT conv_id, turn, round(len(list_intersect({word_set("'the role of ' || role || ' and of la'")}, {word_set('text')}))
      / len({word_set("'the role of ' || role || ' and of la'")}), 6) AS score FROM conversations""",
)
def _overlap(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.concat(F.lit("the role of "), F.col("role"), F.lit(" and of la"))
    return World(spark, sf).table("conversations").select(
        "conv_id", "turn", F.round(ev.overlap_score(asked, F.col("text")), 6).alias("score")
    )


@query(
    "jn18_conflicts",
    f"""WITH {EVENTS} SELECT 'q' || o_orderkey AS qid, doc_id, 'nations' AS field, nations::BIGINT AS infobox, (nations + o_orderkey % 3)::BIGINT AS stated
    FROM ev WHERE nations > 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0""",
)
def _conflicts(spark: SparkSession, sf: str) -> DataFrame:
    base = World(spark, sf).events().withColumn("k", F.regexp_extract("doc_id", r"(\d+)", 1).cast("long"))
    qid = F.concat(F.lit("q"), F.col("k").cast("string")).alias("qid")
    stated = (F.coalesce("nations", F.lit(0)) + F.col("k") % 3).cast("string")
    # Every fifth page gives two figures, which is no clean disagreement.
    text = F.concat(
        F.lit("In 2008 competitors: 28 nations: 13. "), stated, F.lit(" countries took part"),
        F.when(F.col("k") % 5 == 0, F.lit(", later 999 nations")).otherwise(""),
    )
    rows = base.select(qid, "doc_id", "event_id", "title", "nations", "competitors")
    prose = base.select(qid, "doc_id", text.alias("text"))
    both = ev.conform(rows, "multi_hop").unionByName(ev.conform(prose, "similarity_search"))
    return ev.conflicts(both).select("qid", "doc_id", "field", "infobox", "stated")


@query(
    "ev12_resolve_answers",
    f"""WITH {EVENTS}, g AS (SELECT event_name, count(*) AS n, min(title) AS title, min(o_orderkey) AS k FROM ev GROUP BY event_name),
    a AS (SELECT 'q' || right(event_name, 9)::BIGINT AS qid, event_name, n, title, right(event_name, 9)::BIGINT % 3 AS m,
      title AS first_title FROM g)
    SELECT qid, CASE m WHEN 0 THEN CASE WHEN n = 1 THEN title ELSE event_name END WHEN 1 THEN 'no such thing' ELSE title END AS answer,
      CASE WHEN m = 0 THEN true WHEN m = 1 THEN false ELSE true END AS supported, m = 0 AND n = 1 AS changed FROM a""",
)
def _resolve(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    rows = evidence(w).where("source = 'multi_hop'")
    named = rows.groupBy("qid", "event_name").agg(F.min("title").alias("title"))
    m = F.substring("qid", 2, 20).cast("long") % 3
    answers = named.select(
        "qid", F.when(m == 0, F.col("event_name")).when(m == 1, "no such thing").otherwise(F.col("title")).alias("answer")
    )
    return ev.resolve_answers(answers, rows).select("qid", "answer", "supported", "changed")


@query(
    "ev4_grounding",
    f"""WITH c AS (SELECT conv_id, ' ' || {normalize("string_agg(text, ' ' ORDER BY turn)")} || ' ' AS hay FROM conversations GROUP BY conv_id)
    SELECT conv_id, turn, round(CASE WHEN contains(hay, ' ' || n || ' ') AND n <> '' THEN 1 ELSE 0 END, 6)::DOUBLE AS grounded
    FROM (SELECT conv_id, turn, {normalize("lower(split_part(role, ' ', 1))")} AS n FROM conversations) JOIN c USING (conv_id)""",
)
def _grounding(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.operators.scoring import grounding

    turns = World(spark, sf).table("conversations")
    texts = turns.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts")
    )
    return turns.join(texts, "conv_id").select(
        "conv_id", "turn", F.round(grounding(F.lower("role"), F.col("texts")), 6).alias("grounded")
    )


# ---- the whole answer plan ---------------------------------------------------------


def plan_questions(w: World) -> DataFrame:
    """One question per customer over the event graph, of every route."""
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    few = F.array(F.struct(F.lit("competitors").alias("field"), F.lit(">").alias("op"), F.lit(100.0).alias("value")))
    op = F.element_at(F.array(*[F.lit(o) for o in ("LOOKUP", "COUNT", "ARGMAX", "TRAVERSE", "LOOKUP")]), (k % 5 + 1).cast("int"))
    return w.table("customer").join(w.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("q"), k.cast("string")).alias("qid"),
        F.concat(F.lit("Which race of "), F.col("c_name"), F.lit(" had most nations?")).alias("question"),
        op.alias("operation"), none.alias("sport"), none.alias("games"),
        F.when(k % 5 != 0, F.col("n_name")).alias("venue"),
        F.when(k % 5 == 0, F.concat(F.lit("Race of "), F.col("c_name"))).alias("title"), none.alias("event_id"),
        F.when(k % 5 == 1, few).otherwise(F.array().cast(rt.CONSTRAINTS)).alias("constraints"),
        F.lit("nations").alias("target_field"), F.lit(1998).alias("date_year"), F.lit(None).cast("int").alias("date_month"),
        F.lit(None).cast("int").alias("date_day_start"),
    )


_DIRECT = f"""{EVENTS}, q AS (SELECT 'q' || c_custkey AS qid, c_custkey % 5 AS m, c_custkey, n_name, 'Race of ' || c_name AS title FROM customer JOIN nation ON c_nationkey = n_nationkey),
    chain AS (SELECT sport, event_name, date_year AS y, arg_max(event_id, o_orderkey) AS target FROM ev GROUP BY ALL),
    steps AS (SELECT d.etype, e.event_id AS src, c.target AS dst FROM ev e CROSS JOIN (VALUES ('PREV_EDITION', -1), ('NEXT_EDITION', 1)) d(etype, step)
       JOIN chain c ON c.sport = e.sport AND c.event_name = e.event_name AND c.y = e.date_year + d.step),
    walks AS (SELECT 'w' || c_custkey AS qid, c_custkey, c_custkey % 3 AS hops,
       CASE WHEN c_custkey % 2 = 0 THEN 'PREV_EDITION' ELSE 'NEXT_EDITION' END AS etype,
       CASE WHEN c_custkey % 2 = 0 THEN arg_max(event_id, o_orderkey) ELSE arg_min(event_id, o_orderkey) END AS start
       FROM customer JOIN ev ON event_name = 'Race of ' || customer.c_name GROUP BY c_custkey),
    one AS (SELECT qid, hops, etype, dst FROM walks JOIN steps USING (etype) WHERE src = start AND hops > 0),
    reached AS (SELECT qid, start AS event_id FROM walks WHERE hops = 0 UNION ALL SELECT qid, dst FROM one WHERE hops = 1
       UNION ALL SELECT qid, steps.dst FROM one JOIN steps ON steps.etype = one.etype AND steps.src = one.dst WHERE hops = 2),
    looked AS (SELECT qid, 'graph_traversal' AS source, event_id FROM q JOIN ev ON event_name = q.title WHERE m = 0),
    counted AS (SELECT qid, 'aggregation_count' AS source, event_id FROM q JOIN ev ON venue = n_name WHERE m = 1 AND competitors > 100 AND parse_confidence >= 0.9
       QUALIFY row_number() OVER (PARTITION BY qid ORDER BY event_id) <= 30),
    heads AS (SELECT qid, 'aggregation_count', NULL FROM q WHERE m = 1),
    best AS (SELECT qid, 'aggregation_argmax' AS source, event_id FROM q JOIN ev ON venue = n_name WHERE m = 2
       QUALIFY row_number() OVER (PARTITION BY qid ORDER BY coalesce(nations, 0) DESC, event_id) <= 3),
    held AS (SELECT qid, 'multi_hop' AS source, event_id FROM (SELECT qid, event_id, CASE WHEN date_year = 1998 THEN 0 ELSE 1 END AS t FROM q JOIN ev ON venue = n_name
       WHERE m IN (3, 4)) QUALIFY t = min(t) OVER (PARTITION BY qid)),
    direct AS (SELECT * FROM looked UNION ALL SELECT * FROM counted UNION ALL SELECT * FROM heads UNION ALL SELECT * FROM best UNION ALL SELECT * FROM held
       UNION ALL SELECT qid, 'multi_hop', event_id FROM reached)"""


def walk_questions(w: World) -> DataFrame:
    """One walk per customer with events: from the last one back or from the first one on, by none, one or two editions."""
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    back = k % 2 == 0
    ends = w.events_base().groupBy("event_name").agg(
        F.max_by("event_id", "o_orderkey").alias("last"), F.min_by("event_id", "o_orderkey").alias("first")
    )
    return w.table("customer").withColumn("event_name", F.concat(F.lit("Race of "), F.col("c_name"))).join(ends, "event_name").select(
        F.concat(F.lit("w"), k.cast("string")).alias("qid"),
        F.when(k % 4 == 0, F.lit("zzz")).otherwise(F.concat(F.lit("Which edition of the "), F.col("event_name"), F.lit(" is it?"))).alias("question"),
        F.lit("TRAVERSE").alias("operation"), none.alias("sport"), none.alias("games"), none.alias("venue"), none.alias("title"),
        F.when(back, F.col("last")).otherwise(F.col("first")).alias("event_id"), F.array().cast(rt.CONSTRAINTS).alias("constraints"),
        F.lit("nations").alias("target_field"), F.lit(None).cast("int").alias("date_year"), F.lit(None).cast("int").alias("date_month"),
        F.lit(None).cast("int").alias("date_day_start"),
        F.when(back, "PREV_EDITION").otherwise("NEXT_EDITION").alias("edge_type"), (k % 3).cast("int").alias("hops"),
    )


def all_questions(w: World) -> DataFrame:
    asked = plan_questions(w).withColumns({"edge_type": F.lit("PREV_EDITION"), "hops": F.lit(1)})
    return asked.unionByName(walk_questions(w))


def event_links(w: World) -> DataFrame:
    return cut_lineage(g.edition_links(w.event_chain()).where(F.col("dst").isNotNull()))


@query("ev18_answer_evidence", f"WITH {_DIRECT} SELECT * FROM direct")
def _plan(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    return an.direct_evidence(cut_lineage(all_questions(w)), cut_lineage(w.events()), event_links(w), w.documents()).select(
        "qid", "source", "event_id"
    )


@query(
    "ev18_fallback_cascade",
    f"""WITH {_DIRECT}, {CHUNKS}, {CENTRES.replace("c AS (", "cen AS (")},
    asked AS (SELECT qid, c_custkey, ['LOOKUP','COUNT','ARGMAX','TRAVERSE','LOOKUP'][m + 1] AS op, m = 3 AS mute FROM q
      UNION ALL SELECT qid, c_custkey, 'TRAVERSE', c_custkey % 4 = 0 FROM walks),
    seen AS (SELECT a.qid, a.c_custkey, count(d.qid) = 0 OR (op IN ('COUNT', 'ARGMAX') AND count(d.qid) FILTER (starts_with(source, 'aggregation')) = 0) AS unscoped,
      count(event_id) = 0 OR bool_or(mute) AS ungrounded FROM asked a LEFT JOIN direct d USING (qid) GROUP BY a.qid, a.c_custkey, op),
    near AS (SELECT label, chunk_id FROM (SELECT cen.label, 'D' || substr(e.chunk_id, 2) || '_c0' AS chunk_id, list_cosine_similarity(vector, emb) AS score, e.chunk_id AS own
      FROM cen CROSS JOIN e) QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, chunk_id) <= 10),
    upper_chunks AS (SELECT 'D' || substr(chunk_id, 2) AS chunk_id, 'D' || substr(doc_id, 2) AS doc_id FROM chunks),
    second AS (SELECT qid, 'similarity_search' AS source, NULL AS event_id, chunk_id FROM seen JOIN near ON label = c_custkey % 10 JOIN upper_chunks USING (chunk_id) WHERE unscoped),
    third AS (SELECT DISTINCT qid, 'document_retrieval' AS source, NULL AS event_id, chunk_id FROM seen JOIN direct USING (qid) JOIN ev USING (event_id)
      JOIN upper_chunks USING (doc_id) WHERE ungrounded AND NOT unscoped)
    SELECT qid, source, event_id, NULL AS chunk_id FROM direct UNION ALL SELECT * FROM second UNION ALL SELECT * FROM third""",
)
def _cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Every route, walks over real links, then the two fallbacks: rows of all three passes.

    Questions without a word of sense are never grounded, so they go on to the chunks of the documents they found; questions
    without rows go on to the vectors of a label.
    """
    w = World(spark, sf)
    mute = (F.col("operation") == "TRAVERSE") & F.startswith(F.col("qid"), F.lit("q"))
    asked = cut_lineage(all_questions(w).withColumn("question", F.when(mute, "zzz").otherwise(F.col("question"))))
    # Documents get the ids of the events' pages, so document expansion finds text.
    chunks = docs.chunk_documents(
        w.chunk_source().withColumn("doc_id", F.concat(F.lit("D"), F.expr("substring(doc_id, 2)")))
    )
    vectors = w.vectors().select(F.concat(F.lit("D"), F.expr("substring(chunk_id, 2)"), F.lit("_c0")).alias("chunk_id"), "emb")
    queries = asked.select("qid", (F.expr("cast(substring(qid, 2) as bigint)") % 10).alias("label")).join(w.centroids().select("label", "vector"), "label").select("qid", "vector")
    return an.answer_evidence(asked, cut_lineage(w.events()), event_links(w), w.documents(), chunks, queries, vectors).select(
        "qid", "source", "event_id", "chunk_id"
    )


@query(
    "fn17_event_part",
    "SELECT o_orderkey AS k, 'Race – ' || o_orderkey AS part FROM orders",
)
def _part(spark: SparkSession, sf: str) -> DataFrame:
    title = F.concat(F.lit("X at the 1999 Summer Olympics — Race – "), F.col("o_orderkey").cast("string"))
    return World(spark, sf).table("orders").select(F.col("o_orderkey").alias("k"), tx.event_part(title).alias("part"))
