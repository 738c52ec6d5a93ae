"""Dataset descriptions: declared name, dominant source, topic and year span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as tx

# ---- fixed values -----------------------------------------------------------
DECLARED_FIELDS = ("dataset", "collection", "corpus")
MIN_TOPIC_SHARE = 0.3
NEAR_COVER = 0.9
TOPIC_STOPWORDS = (
    "a an and at by de for from in is it la le of on or the to vs with list men's women's mixed "
    "team individual season kg metre metres km m"
).split()
TITLE_WORD = r"(?U)([^\W\d_][\w'’.&-]*)"
TITLE_YEAR = r"(?iU)\b(1[5-9]\d\d|20\d\d)\b(?!\s*(?:m|km|metres?|meters?|yards?|miles?)\b)"
URL_HOST = r"(?i)^https?://(?:www\.)?([^/:]+)"
KNOWN_HOSTS = {"wikipedia.org": "Wikipedia", "arxiv.org": "arXiv", "github.com": "GitHub"}
# -----------------------------------------------------------------------------


def url_host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, URL_HOST, 1)), F.lit(""))


def host_name(host: Column) -> Column:
    named = F.lit(None).cast("string")
    for domain, name in KNOWN_HOSTS.items():
        named = F.when((host == domain) | host.endswith("." + domain), F.lit(name)).otherwise(named)
    return F.coalesce(named, host)


def title_grams(title: Column) -> Column:
    """Distinct 1- to 3-word phrases that may name a topic."""

    def of_length(words: Column, n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda i: F.slice(words, i, F.lit(n)))

    def usable(gram: Column) -> Column:
        first, last = F.element_at(gram, 1), F.element_at(gram, -1)
        return (
            ~F.lower(first).isin(TOPIC_STOPWORDS)
            & ~F.lower(last).isin(TOPIC_STOPWORDS)
            & (F.length(last) >= 3)
        )

    grams = tx.let(
        F.regexp_extract_all(title, F.lit(TITLE_WORD), F.lit(1)),
        lambda words: F.concat(of_length(words, 1), of_length(words, 2), of_length(words, 3)),
    )
    return F.array_distinct(F.transform(F.filter(grams, usable), lambda g: F.array_join(g, " ")))


def topics(titles: DataFrame) -> DataFrame:
    """(dataset, topic, documents): the phrase most titles of a dataset share."""
    totals = titles.groupBy("dataset").agg(F.count("title").alias("n_titles"))
    counts = (
        titles.where(F.col("title").isNotNull())
        .select("dataset", F.explode(title_grams(F.col("title"))).alias("gram"))
        .groupBy("dataset", "gram")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = F.struct(-F.col("n"), -F.size(F.split("gram", " ")), F.col("gram"))
    best = (
        counts.groupBy("dataset")
        .agg(F.min(F.struct(order.alias("o"), "gram", "n")).alias("b"))
        .select("dataset", F.col("b.gram").alias("best"), F.col("b.n").alias("best_n"))
        .join(totals, "dataset")
        .where(F.col("best_n") >= MIN_TOPIC_SHARE * F.col("n_titles"))
    )
    # The best phrase competes with the longer phrases built on it; it wins only alone.
    longer = (
        counts.join(best, "dataset")
        .where(F.col("gram").contains(F.col("best")) & (F.col("n") >= NEAR_COVER * F.col("best_n")))
        .groupBy("dataset")
        .agg(
            F.min(
                F.struct(
                    (F.col("gram") == F.col("best")).alias("is_best"),
                    (-F.col("n")).alias("c"), (-F.length("gram")).alias("l"), "gram",
                )
            ).alias("w")
        )
    )
    return longer.select("dataset", F.col("w.gram").alias("topic"), (-F.col("w.c")).alias("documents"))


def year_spans(titles: DataFrame) -> DataFrame:
    """(dataset, span): years named in enough of the titles, distances excluded."""
    years = F.transform(
        F.regexp_extract_all(F.coalesce("title", F.lit("")), F.lit(TITLE_YEAR), F.lit(1)),
        lambda y: y.cast("int"),
    )
    return (
        titles.select("dataset", "title", years.alias("years"))
        .groupBy("dataset")
        .agg(
            F.count("title").alias("n_titles"),
            F.sum(F.size("years")).alias("n_years"),
            F.min(F.array_min("years")).alias("low"),
            F.max(F.array_max("years")).alias("high"),
        )
        .where((F.col("n_years") >= MIN_TOPIC_SHARE * F.col("n_titles")) & F.col("low").isNotNull())
        .select(
            "dataset",
            F.when(F.col("low") == F.col("high"), F.col("low").cast("string"))
            .otherwise(F.concat_ws("–", F.col("low").cast("string"), F.col("high").cast("string")))
            .alias("span"),
        )
    )


def majority(values: DataFrame, column: str) -> DataFrame:
    """(dataset, value, n): the value held by more than half of a dataset's documents.

    ``values`` has one row per document with ``documents`` = documents of the dataset.
    """
    totals = values.groupBy("dataset").agg(F.count(F.lit(1)).alias("documents"))
    return (
        values.where(F.col(column).isNotNull())
        .groupBy("dataset", column)
        .agg(F.count(F.lit(1)).alias("n"))
        .join(totals, "dataset")
        .where(F.col("n") > F.col("documents") / 2)
        .select("dataset", F.col(column).alias("value"), "n")
    )


def describe(records: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """One row per dataset: title, title_source, documents, description.

    ``records``: dataset (file stem), title, url, declared. ``given``: dataset,
    title, description typed by a user.
    """
    docs = records.groupBy("dataset").agg(F.count(F.lit(1)).alias("documents"))
    sources = majority(records.withColumn("host", url_host(F.col("url"))), "host").select(
        "dataset", host_name(F.col("value")).alias("source")
    )
    declared = majority(
        records.withColumn("declared", F.nullif(F.trim("declared"), F.lit(""))), "declared"
    ).select("dataset", tx.clean_title(F.col("value")).alias("declared_title"))
    joined = (
        docs.join(sources, "dataset", "left")
        .join(declared, "dataset", "left")
        .join(topics(records).select("dataset", "topic"), "dataset", "left")
        .join(year_spans(records), "dataset", "left")
    )
    if given is not None:
        joined = joined.join(
            given.select(
                "dataset",
                tx.clean_title(F.col("title")).alias("given_title"),
                tx.clean_title(F.col("description"), 500).alias("description"),
            ),
            "dataset", "left",
        )
    else:
        joined = joined.withColumns(
            {"given_title": F.lit(None).cast("string"), "description": F.lit(None).cast("string")}
        )
    inferred = F.when(
        F.coalesce("source", "topic").isNotNull(),
        tx.clean_title(F.concat_ws(" · ", "source", "topic", "span")),
    )
    return joined.withColumn("inferred", inferred).select(
        "dataset",
        F.coalesce("given_title", "declared_title", "inferred", "dataset").alias("title"),
        F.when(F.col("given_title").isNotNull(), "given")
        .when(F.col("declared_title").isNotNull(), "declared")
        .when(F.col("inferred").isNotNull(), "inferred")
        .otherwise("file")
        .alias("title_source"),
        "documents",
        "description",
    )
