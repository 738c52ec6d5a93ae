"""Vector functions and similarity search queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import vectors as vx
from graphloom.operators import coverage as cov
from graphloom.operators import documents as docs
from graphloom.operators import graph as g
from graphloom.operators import similarity as sim
from graphloom.plans.catalog import query
from graphloom.plans.catalog.corpus import CHUNKS
from graphloom.plans.catalog.sql import CENTRES
from graphloom.plans.world import World
from graphloom.session import checkpoint_root, cut_lineage

def _top(where: str) -> str:
    return f"""WITH {CENTRES}, s AS (
      SELECT qid, chunk_id, list_cosine_similarity(vector, emb) AS score FROM c CROSS JOIN e WHERE {where})
    SELECT qid, chunk_id, round(score, 5) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id)::INT AS rank
    FROM s QUALIFY rank <= 10"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("qid", "chunk_id", F.round("score", 5).alias("score"), "rank")


@query("top2_cosine", _top("true"))
def _exact(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    return _rounded(sim.topk_cosine(w.centroids(), w.vectors(), 10))


@query("top2_cosine_candidates", _top("e.label % 2 = 0"))
def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    return _rounded(sim.topk_cosine(w.centroids(), w.vectors(), 10, w.vectors().where("label % 2 = 0")))


@query("top3_cosine_cells", _top("true"))
def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell probed: the approximate plan with the exact rows."""
    w = World(spark, sf)
    centres = sim.train_cells(w.vectors(), 16)
    return _rounded(sim.topk_cells(w.centroids(), sim.assign_cells(w.vectors(), centres), centres, 10, nprobe=16))


@query(
    "top3_few_cells",
    f"""WITH {CENTRES} SELECT 'v' || vec_id AS qid, least(10, (SELECT count(*) FROM e))::BIGINT AS rows, true AS recall_reached, true AS fewer_cells
    FROM embeddings WHERE vec_id % 20 = 0""",
)
def _few_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Every twentieth vector searches a table partitioned by cell; the cells to probe are set on the mean vector of each label
    and every fortieth vector, and the recall of the whole set of queries is measured against the exact search."""
    w = World(spark, sf)
    vectors = w.vectors().select("chunk_id", "emb")
    centres = sim.train_cells(vectors, 16)
    celled = sim.write_cells(vectors, centres, f"{checkpoint_root(spark)}/cells-{uuid.uuid4().hex}")
    number = F.expr("cast(substring(chunk_id, 2) as bigint)")
    asked = vectors.where(number % 20 == 0).select(F.col("chunk_id").alias("qid"), F.col("emb").cast("array<double>").alias("vector"))
    sample = asked.where(F.expr("cast(substring(qid, 2) as bigint)") % 40 == 0).unionByName(w.centroids().select("qid", "vector"))
    # Set a little above what is asked for: other queries than the sample's follow.
    nprobe = sim.probes_for_recall(sample, celled, centres, 10, recall=0.95)
    hits = cut_lineage(sim.topk_cells(asked, celled, centres, 10, nprobe))
    # One row of counts: the recall over all queries.
    met = sim.topk_cosine(asked, vectors, 10).join(hits.select("qid", "chunk_id", F.lit(1).alias("hit")), ["qid", "chunk_id"], "left").agg(
        (F.count("hit") >= 0.9 * F.count("*")).alias("reached")
    ).first()["reached"]
    return hits.groupBy("qid").agg(F.count("*").alias("rows")).withColumns({"recall_reached": F.lit(met), "fewer_cells": F.lit(nprobe < len(centres))})


@query(
    "jn6_hits_with_text",
    f"""WITH {CHUNKS}, {CENTRES.replace("c AS (", "cen AS (")}, s AS (
      SELECT qid, chunk_id, list_cosine_similarity(vector, emb) AS score FROM cen CROSS JOIN e),
    t AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id)::INT AS rank FROM s QUALIFY rank <= 10)
    SELECT qid, k.chunk_id, rank, len(w)::INT AS token_count FROM t JOIN chunks k ON k.chunk_id = 'd' || substr(t.chunk_id, 2) || '_c0'""",
)
def _text(spark: SparkSession, sf: str) -> DataFrame:
    w = World(spark, sf)
    hits = sim.topk_cosine(w.centroids(), w.vectors(), 10).withColumn(
        "chunk_id", F.concat(F.lit("d"), F.expr("substring(chunk_id, 2)"), F.lit("_c0"))
    )
    return hits.join(docs.chunk_documents(w.chunk_source()), "chunk_id").select("qid", "chunk_id", "rank", "token_count")


@query(
    "jn6_edge_hits",
    f"""WITH {CHUNKS}, {CENTRES.replace("c AS (", "cen AS (")}, owned AS (
      SELECT 'm|' || k.chunk_id AS embedding_id, k.chunk_id, len(w)::INT AS token_count, emb FROM chunks k JOIN e ON 'd' || substr(e.chunk_id, 2) = k.doc_id WHERE seq = 0)
    SELECT qid, chunk_id, token_count, row_number() OVER (PARTITION BY qid ORDER BY list_cosine_similarity(vector, emb) DESC, embedding_id)::INT AS rank
    FROM cen CROSS JOIN owned QUALIFY rank <= 10""",
)
def _edge_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of one model stand at embedding vertices; hits go back over HAS_EMBEDDING edges to their chunks."""
    w = World(spark, sf)
    chunks = docs.chunk_documents(w.chunk_source())
    edges = g.embedding_edges(chunks.where("seq = 0").select(F.lit("m").alias("model_key"), "chunk_id"))
    number = F.concat(F.lit("m|d"), F.expr("substring(chunk_id, 2)"), F.lit("_c0"))
    held = w.vectors().select(number.alias("chunk_id"), "emb").join(edges.select(F.col("dst").alias("chunk_id")), "chunk_id", "left_semi")
    hits = sim.topk_cosine(w.centroids(), held, 10).withColumnRenamed("chunk_id", "embedding_id")
    return g.chunks_of_hits(hits, edges, chunks).select("qid", "chunk_id", "rank", "token_count")


@query(
    "fn9_l2_normalize",
    """SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: 3 * x / (3 * sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))))), 6) AS total,
      len(embedding) = 64 AS ok FROM embeddings""",
)
def _normalize(spark: SparkSession, sf: str) -> DataFrame:
    unit = vx.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3))
    return World(spark, sf).table("embeddings").select(
        "vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, v: s + v), 6).alias("total"), vx.has_dim(F.col("embedding"), 64).alias("ok")
    )


def _weighted(vector: str) -> Column:
    """Sum of position times component: one number that every component takes part in."""
    terms = F.transform(vector, lambda x, i: x.cast("double") * (i + 1))
    return F.round(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), 6).alias("weighted")


@query(
    "fn10_hash_vector",
    """WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents),
    r AS (SELECT doc_id, list_transform(range(0, 40), lambda i: ('0x' || substr(h, ((i % 32) * 2 + 1)::INT, 2))::INT / 255.0::DOUBLE * 2 - 1) AS raw FROM h)
    SELECT doc_id, round(raw[1] / sqrt(list_inner_product(raw, raw)), 6) AS first, round(raw[40] / sqrt(list_inner_product(raw, raw)), 6) AS last,
      round(list_inner_product(raw, list_transform(range(1, 41), lambda i: i::DOUBLE)) / sqrt(list_inner_product(raw, raw)), 6) AS weighted FROM r""",
)
def _hash(spark: SparkSession, sf: str) -> DataFrame:
    return World(spark, sf).table("documents").select("doc_id", vx.hash_vector(F.col("text"), 40).alias("v")).select(
        "doc_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"), _weighted("v")
    )


@query(
    "fn11_resolve_models",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'bge-large-en-v1.5' WHEN 1 THEN 'gte-large-en-v1.5' WHEN 2 THEN 'bge-large-en-v1.5' END AS model_key
    FROM documents""",
)
def _models(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 4
    name = F.when(k == 1, "ALIBABA-NLP/gte-large-en-v1.5").when(k == 2, "@cf/baai/bge-large-en-v1.5").when(k == 3, "no such model")
    names = World(spark, sf).table("documents").select("doc_id", name.alias("name"))
    return cov.resolve_models(names, cov.models(spark)).select("doc_id", "model_key")


@query(
    "fn12_prompted_texts",
    """SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN 'title: none | text: ' ELSE '' END || text) AS digest FROM documents""",
)
def _prompted(spark: SparkSession, sf: str) -> DataFrame:
    texts = World(spark, sf).table("documents").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, "embeddinggemma-300m").otherwise("gte-large-en-v1.5").alias("model_key"), "text"
    )
    return cov.prompted(texts, cov.models(spark), "document").select("doc_id", F.md5("prompt").alias("digest"))


@query(
    "udf1_encode",
    """WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents),
    r AS (SELECT doc_id, list_transform(range(0, 64), lambda i: ('0x' || substr(h, ((i % 32) * 2 + 1)::INT, 2))::INT / 255.0::DOUBLE * 2 - 1) AS raw FROM h),
    n AS (SELECT doc_id, raw, sqrt(list_inner_product(raw, raw)) AS norm FROM r),
    u AS (SELECT doc_id, list_transform(raw, lambda x: (x / norm)::FLOAT::DOUBLE) AS unit FROM n)
    SELECT 'd' || doc_id AS chunk_id, 64 AS dim,
      round(list_inner_product(unit, list_transform(range(1, 65), lambda i: i::DOUBLE)), 2) + 0.0::DOUBLE AS weighted FROM u""",
)
def _encode(spark: SparkSession, sf: str) -> DataFrame:
    texts = World(spark, sf).chunk_source().select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("prompt"))
    return cov.encode(texts, 64).select("chunk_id", F.size("emb").alias("dim"), F.round(_weighted("emb"), 2).alias("weighted"))


@query("snk3_wrong_dims", "SELECT 'v' || vec_id AS chunk_id FROM embeddings WHERE label = 3")
def _dims(spark: SparkSession, sf: str) -> DataFrame:
    known = cov.models(spark).withColumn("dim", F.lit(64))
    keys = F.array(*[F.lit(m[0]) for m in cov.MODELS])
    rows = World(spark, sf).vectors().select(
        F.element_at(keys, (F.col("label") % 5 + 1).cast("int")).alias("model_key"), "chunk_id",
        F.when(F.col("label") == 3, F.slice("emb", 1, 63)).otherwise(F.col("emb")).alias("emb"),
    )
    return cov.wrong_dims(rows, known).select("chunk_id")
