"""The star-schema test tables seen as a corpus graph and as benchmark runs.

An order is an event, its priority the sport, its year the Games, the
customer's nation the venue; parts form edition chains by size; line items are
trace steps and citations of the order's question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as tx


class World:
    """Lazily read tables of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ---- graph ---------------------------------------------------------------

    def scopes(self) -> DataFrame:
        """orders with sport, games and venue."""
        orders = self.table("orders")
        customer = self.table("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
        nation = self.table("nation").select("n_nationkey", "n_name", "n_regionkey")
        return (
            orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .withColumns(
                {
                    "sport": F.col("o_orderpriority"),
                    "games": F.concat(F.year("o_orderdate").cast("string"), F.lit("-Summer")),
                    "venue": F.col("n_name"),
                }
            )
        )

    def figures(self) -> DataFrame:
        """(order, competitors, nations) from the line items that exist."""
        supplier = self.table("supplier").select("s_suppkey", "s_nationkey")
        return (
            self.table("lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
            .repartition("l_orderkey")  # both steps of the distinct count meet on this one shuffle
            .groupBy("l_orderkey")
            .agg(
                F.sum("l_quantity").cast("int").alias("competitors"),
                F.countDistinct("s_nationkey").cast("int").alias("nations"),
            )
        )

    def events_base(self) -> DataFrame:
        """The event view without competitors and nations."""
        s = self.scopes()
        year = F.year("o_orderdate")
        return s.select(
            F.concat_ws("-", tx.slug(F.col("sport")), F.col("games"), F.col("o_orderkey").cast("string")).alias("event_id"),
            F.concat(F.lit("Race of "), F.col("c_name")).alias("event_name"),
            F.concat(F.lit("D"), F.col("o_orderkey").cast("string")).alias("doc_id"),
            F.concat(
                F.col("sport"), F.lit(" at the "), year.cast("string"), F.lit(" Summer Olympics – "),
                F.col("o_orderkey").cast("string"),
            ).alias("title"),
            "sport", "games", "venue", "o_orderkey",
            F.date_format("o_orderdate", "d MMMM").alias("date_text"),
            year.alias("date_year"), F.month("o_orderdate").alias("date_month"),
            F.dayofmonth("o_orderdate").alias("date_day_start"), F.lit(0).alias("date_day_end"),
            F.array(F.col("c_name"), F.col("c_mktsegment")).alias("gold"),
            F.col("c_mktsegment").alias("gold_noc"),
            F.when(F.col("o_orderstatus") == "P", 0.8).when(F.col("o_orderstatus") == "F", 0.9).otherwise(1.0).alias(
                "parse_confidence"
            ),
        )

    def events(self) -> DataFrame:
        base = self.events_base()
        return base.join(self.figures(), F.col("o_orderkey") == F.col("l_orderkey"), "left").drop(
            "l_orderkey", "o_orderkey"
        )

    def event_chain(self) -> DataFrame:
        """The events as parsed editions of a sport's race: each states the year before and after."""
        year = F.col("date_year")
        return self.events_base().select(
            "event_id", "event_name", "doc_id", F.col("sport").alias("sport_name"), F.col("games").alias("games_id"),
            (year - 1).alias("prev_year"), (year + 1).alias("next_year"), F.lit(True).alias("is_event"), F.col("o_orderkey").alias("line_no"),
        )

    def documents(self) -> DataFrame:
        return self.events_base().select("doc_id", "title")

    def parts(self) -> DataFrame:
        """Parts as parsed events of an edition chain (sizes are years)."""
        return self.table("part").select(
            F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("event_id"),
            F.concat(F.lit("DP"), F.col("p_partkey").cast("string")).alias("doc_id"),
            F.col("p_brand").alias("sport_name"), F.col("p_type").alias("event_name"),
            F.concat((F.col("p_size") + 1900).cast("string"), F.lit("-Summer")).alias("games_id"),
            (F.col("p_size") + 1899).alias("prev_year"), (F.col("p_size") + 1901).alias("next_year"),
            F.lit(True).alias("is_event"), F.col("p_partkey").alias("line_no"), F.col("p_name").alias("title"),
        )

    # ---- corpus --------------------------------------------------------------

    def infobox_corpus(self) -> DataFrame:
        """Orders rendered as infobox pages, with the irregular values the parser meets."""
        s = self.scopes().join(self.figures(), F.col("o_orderkey") == F.col("l_orderkey"), "left")
        key = F.col("o_orderkey")
        year = F.year("o_orderdate").cast("string")

        def line(name: str, value: Column) -> Column:
            return F.concat(F.lit(f"  {name}: "), value)

        competitors = F.when(key % 7 == 0, F.concat(F.col("competitors").cast("string"), F.lit(" teams"))).otherwise(
            F.col("competitors").cast("string")
        )
        kind = F.when(key % 5 == 4, "film").otherwise("Olympic event")
        body = F.concat_ws(
            "\n",
            F.when(key % 6 == 0, F.lit("[Infobox venue]")),
            F.concat(F.lit("[Infobox "), kind, F.lit("]")),
            line("event", F.concat(F.lit("Race of "), F.col("c_name"))),
            F.when(key % 9 != 0, line("games", F.concat(year, F.lit(" Summer")))),
            line("venue", F.col("n_name")),
            F.when(key % 2 == 0, line("date", F.date_format("o_orderdate", "d MMMM yyyy"))).otherwise(
                line("dates", F.date_format("o_orderdate", "d MMMM"))
            ),
            line("competitors", competitors),
            line("nations", F.col("nations").cast("string")),
            F.lit(""),
            line("gold", F.concat(F.lit("Jane "), F.initcap("c_mktsegment"), F.lit("John Smith"))),
            line("gold", F.lit("Never Used")),
            line("prev", (F.year("o_orderdate") - 1).cast("string")),
            line("next", (F.year("o_orderdate") + 1).cast("string")),
            F.lit("Prose starts here and runs on."),
            F.lit("  venue: not a field any more"),
        )
        title = F.when(key % 11 == 0, F.concat(F.lit("Order "), key.cast("string"))).otherwise(
            F.concat(F.col("sport"), F.lit(" at the "), year, F.lit(" Summer Olympics – "), key.cast("string"))
        )
        return s.select(
            F.concat(F.lit("D"), key.cast("string")).alias("doc_id"), title.alias("title"),
            F.concat(F.lit("https://en.wikipedia.org/"), key.cast("string")).alias("url"),
            key.alias("wikipedia_pageid"), F.length(body).alias("approx_tokens"), body.alias("text"),
            key.alias("line_no"),
        )

    def chunk_source(self) -> DataFrame:
        return self.table("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text")

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("chunk_id"), F.col("embedding").alias("emb"), "label"
        )

    def centroids(self) -> DataFrame:
        """One query vector per label: the mean of its vectors."""
        return (
            self.table("embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
            .groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
            .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("l"))
            .select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("qid"),
                    F.transform("l", lambda s: s["m"]).alias("vector"), "label")
        )

    # ---- benchmark runs --------------------------------------------------------

    def answers(self) -> DataFrame:
        """Three pipelines' answers to one question per order; a run per priority."""
        return self.spread(self.asked())

    @staticmethod
    def spread(asked: DataFrame) -> DataFrame:
        """A row per answer out of a row per question."""
        return asked.withColumn("p", F.explode("pipelines")).drop("pipelines").select("*", "p.*").drop("p")

    def asked(self) -> DataFrame:
        """The question of every order with its three answers in an array."""
        region = self.table("region")
        s = self.scopes().join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        seg, reg = F.initcap("c_mktsegment"), F.initcap("r_name")
        number = (cust % 30).cast("string")
        none = F.array().cast("array<string>")

        def record(name: str, answer: Column, bad: Column, scale: int, stop: Column) -> Column:
            spent_in = (key % 5000 + 100) * scale
            spent_out = cust % 300 + 5
            return F.struct(
                F.lit(name).alias("pipeline"), answer.alias("answer"),
                F.when(bad, "error").otherwise("done").alias("status"),
                spent_in.alias("tokens_in"), spent_out.alias("tokens_out"),
                F.when(bad & (key % 2 == 0), F.lit(0)).otherwise(spent_in + spent_out).alias("tokens_total"),
                (F.col("o_totalprice") / 10 * scale).alias("latency_ms"), stop.alias("stop_reason"),
                F.when(bad, F.lit("timed out")).alias("error_detail"),
            )

        no_stop = F.lit(None).cast("string")
        stop = F.when(cust % 2 == 0, "direct_route").when(cust % 3 == 0, "step_budget_exhausted").otherwise(
            "sufficient_evidence"
        )
        pipelines = F.array(
            record("rag", F.concat(reg, F.lit(" and "), seg), key % 17 == 0, 3, no_stop),
            record("graphrag", F.concat(F.lit("Café "), reg, F.lit(", the "), seg), key % 11 == 0, 1, no_stop),
            record(
                "agentic_graphrag",
                F.when(key % 4 == 0, F.concat(F.lit("0"), number, F.lit(" events"))).otherwise(F.concat(seg, reg)),
                key % 13 == 0, 2, stop,
            ),
        )
        kinds = F.array(*[F.lit(t) for t in ("lookup", "aggregation", "superlative", "temporal", "multi_hop")])
        return s.select(
            F.replace(F.col("o_orderpriority"), F.lit(" "), F.lit("_")).alias("run_id"),
            F.concat(F.lit("q"), key.cast("string")).alias("qid"),
            F.when(cust % 7 != 0, F.element_at(kinds, (cust % 5 + 1).cast("int"))).alias("qtype"),
            F.when(F.col("o_orderstatus") == "P", none).otherwise(
                F.array(F.when(key % 4 == 0, number).otherwise(F.concat(seg, reg)))
            ).alias("ground_truth"),
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
            F.col("o_orderkey").alias("orderkey"),
            pipelines.alias("pipelines"),
        )

    def citations(self) -> DataFrame:
        """(qid, doc_id, snippet, returned) of every question, from its line items."""
        part = self.table("part").select("p_partkey", "p_name")
        return self.table("lineitem").select("l_orderkey", "l_partkey", "l_returnflag").join(
            part, F.col("l_partkey") == F.col("p_partkey")
        ).select(
            F.concat(F.lit("q"), F.col("l_orderkey").cast("string")).alias("qid"),
            F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("doc_id"),
            F.col("p_name").alias("snippet"), "l_returnflag",
        )

    def cited_questions(self) -> DataFrame:
        """Questions with their three answers, their citation list and gold documents.

        An order has few line items, so the lists stay short.
        """
        lists = self.citations().groupBy("qid").agg(
            F.collect_list(F.struct(F.col("doc_id").alias("source_id"), "snippet")).alias("citations"),
            F.collect_set(F.when(F.col("l_returnflag") != "N", F.col("doc_id"))).alias("gold_doc_ids"),
        )
        return self.asked().join(lists, "qid", "left").withColumn(
            "citations_count", F.size(F.coalesce("citations", F.array().cast("array<struct<source_id:string,snippet:string>>")))
        )

    def steps(self) -> DataFrame:
        """Line items as trace steps of the agent."""
        flag, status = F.col("l_returnflag"), F.col("l_linestatus")
        run = self.scopes().select(
            "o_orderkey", F.replace(F.col("o_orderpriority"), F.lit(" "), F.lit("_")).alias("run_id"), "o_custkey"
        )
        tool = F.when(flag == "A", "lookup").when(flag == "N", "multi_hop").otherwise("similarity_search")
        return self.table("lineitem").join(run, F.col("l_orderkey") == F.col("o_orderkey")).select(
            "run_id", F.concat(F.lit("q"), F.col("l_orderkey").cast("string")).alias("qid"),
            (F.col("l_linenumber").cast("long") * 10**14 + F.col("l_partkey") * 10**7 + F.col("l_suppkey")).alias("seq"),
            F.when(flag == "A", "graph_traversal").when(flag == "N", "answer_verification").otherwise(
                "similarity_search"
            ).alias("agent_type"),
            F.concat(F.lit("Q"), F.col("l_linenumber").cast("string")).alias("tool_called"),
            F.when(F.col("o_custkey") % 2 == 0, "lookup_direct").otherwise("loop").alias("route"),
            F.when(status == "O", tool).alias("path_name"),
            (F.col("l_discount") >= 0.09).alias("declared"),
            F.col("l_quantity").cast("long").alias("tokens_in"), (F.col("l_partkey") % 50).alias("tokens_out"),
            (F.col("l_quantity").cast("long") + F.col("l_partkey") % 50).alias("tokens_total"),
            (F.col("l_extendedprice") / 100).alias("latency_ms"),
            F.when(F.col("l_suppkey") % 3 == 0, "answer found in the graph evidence")
            .when(F.col("l_suppkey") % 3 == 1, "answer named the event; resolved to its page title 'x'")
            .otherwise("answer not found in the graph evidence; conflicting evidence: nations").alias("notes"),
        )

    def build_events(self) -> DataFrame:
        """Clicks as build events: a build per user."""
        stages = F.array(*[F.lit(s) for s in (
            "parse_infoboxes", "chunk_documents", "embed_chunks", "schema_install", "load_vertices", "load_edges",
            "load_chunks", "install_graph_queries", "vector_index",
        )])
        k = F.get_json_object("props", "$.k").cast("int")
        stage = F.element_at(stages, (k % 9 + 1).cast("int"))
        return self.table("events").select(
            F.col("user_id").alias("build_id"), F.col("event_id").alias("seq"), "ts",
            F.when(F.col("event_type") == "signup", "ready").otherwise(stage).alias("stage"),
            F.when(F.col("event_type") == "signup", F.array(F.lit("graphrag")))
            .when(k % 2 == 0, F.array(F.lit("rag"), F.lit("agentic_graphrag")))
            .otherwise(F.array(F.lit("rag"), F.lit("graphrag"), F.lit("agentic_graphrag"))).alias("pipeline_affected"),
            F.when(F.col("event_type") == "signup", "ready").when(F.col("event_type") == "purchase", "done").otherwise(
                "running"
            ).alias("status"),
            k.alias("items_done"), F.lit(100).alias("items_total"), F.col("value").alias("elapsed_ms"),
        )
