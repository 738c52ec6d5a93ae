"""Registered queries of this subpackage, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import alignment, decontaminate, html_text, line_dedup, nearest, packing, runs, secrets, substring_dedup, surrogates, toxicity
from graphloom.llm.jaccard_join import jaccard_components
from graphloom.llm.near_dedup import near_duplicates
from graphloom.llm.storage import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assigned secrets, access keys and long hexadecimal runs of every document, as counts and spans."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda r: r["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = secrets.joined_spans(F.col("found"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def _sql_spans(kind: str, place: int, pattern: str, value: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {place} AS place, '{kind}' AS kind, start, start + length(hit) AS stop FROM (
      SELECT doc_id, hits[i] AS hit, vals[i] AS val, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda g: length(g))), 0))::BIGINT AS start
      FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
        SELECT doc_id, string_split_regex(coalesce(text, ''), '{p}') AS gaps, regexp_extract_all(coalesce(text, ''), '{p}') AS hits,
          regexp_extract_all(coalesce(text, ''), '{p}', {value}) AS vals FROM documents)))
      WHERE length(val) >= {least}"""


ORACLES["op2_secret_scan"] = f"""WITH f AS (
  {_sql_spans("assign", 0, secrets.RULES[0].pattern, 2, 12)}
  UNION ALL {_sql_spans("access", 1, r"AKIA[A-Z0-9]+", 0, 18)}
  UNION ALL {_sql_spans("hex", 2, r"[0-9a-f]+", 0, 16)}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256,
  coalesce(spans, '') AS spans FROM documents d LEFT JOIN g USING (doc_id)"""


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that more than 2 % of their source's pages share."""
    return line_dedup.drop_site_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


ORACLES["op3_line_dedup"] = """WITH p AS (SELECT DISTINCT coalesce(source, '') AS host, text FROM documents WHERE text IS NOT NULL),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
l AS (SELECT DISTINCT host, text, trim(line, ' ') AS line FROM (SELECT host, text, unnest(string_split(text, chr(10))) AS line FROM p) WHERE trim(line, ' ') <> ''),
b AS (SELECT host, line FROM (SELECT host, line, count(*) AS n FROM l GROUP BY ALL) JOIN t USING (host) WHERE n >= 5 AND n > 0.02 * pages),
d AS (SELECT doc_id, coalesce(source, '') AS host, string_split(text, chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, host, lines, unnest(range(1, len(lines) + 1)) AS i FROM d),
k AS (SELECT doc_id, string_agg(lines[i], chr(10) ORDER BY i) AS text, count(*) AS kept FROM e
  WHERE NOT EXISTS (FROM b WHERE b.host = e.host AND b.line = trim(lines[i], ' ')) GROUP BY doc_id)
SELECT doc_id, coalesce(k.text, CASE WHEN lines IS NULL THEN NULL ELSE '' END) AS text, coalesce(len(lines), 0)::BIGINT AS n_lines,
  (coalesce(len(lines), 0) - coalesce(kept, 0))::BIGINT AS n_removed FROM d LEFT JOIN k USING (doc_id)"""


@query
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose two-word shingle sets reach 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark items."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each document without its passages of 35 words that stand elsewhere, too."""
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    return nearest.neighbours(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


@query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    text = html_text.extract(table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with surrogates in the place of personal data. The key is a parameter; this one is for tests."""
    return surrogates.replace(table(spark, sf_dir, "documents"), key="an example key")


def looped_texts(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth, by the checksum of its id, goes round in a loop of its own words from some place on."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    made = docs.withColumn("words", words).withColumn("h", F.crc32(F.col("doc_id").cast("string")))
    made = made.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.expr("cast(g % greatest(n, 1) AS int)"))
    made = made.withColumn("p", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) AS int)"))
    loop = "concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) AS int))), 1, n - a))"
    return made.select("doc_id", F.expr(f"CASE WHEN h % 10 = 0 AND n > 0 THEN array_join({loop}, ' ') ELSE text END AS text"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least 24 words and three periods in every document, and the texts without their repetitions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    found = runs.periodic_runs(looped_texts(docs), min_words=24, exponent=3)
    best = F.expr(
        "aggregate(runs, cast(null AS struct<start: long, length: long, period: long>), (b, r) -> CASE WHEN b IS NULL OR "
        "r.length * b.period > b.length * r.period THEN r ELSE b END)"
    )
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of a byte-level and a piece vocabulary lie over each other in every document."""
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), *paths).drop("groups")


@query
def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingle sets reach 0.8."""
    return jaccard_components(table(spark, sf_dir, "documents"), size=5, percent=80)


ORACLES["op13_ngram_jaccard"] = """WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id"""
