"""Retrieval: token overlap, BM25, kNN, rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dot, tokens


def _top(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    """k best by score, then by ties, with their rank from 0. The limit runs per partition before it is global."""
    best = scored.orderBy(F.desc("score"), *ties).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *ties)) - 1)


def overlap_search(chunks: DataFrame, query: list[str], k: int) -> DataFrame:
    """Number of distinct query tokens in the text."""
    q = F.array(*[F.lit(t) for t in query])
    return _top(chunks.select("chunk_id", F.size(F.array_intersect(F.array_distinct(tokens(F.col("text"))), q)).alias("score")).where("score > 0"), k, "chunk_id")


def bm25(chunks: DataFrame, query: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi BM25 with idf ln(1 + (N - df + 0.5) / (df + 0.5)).

    Only the query's terms are counted, while the texts are scanned; no inverted index of
    all terms is shuffled.
    """
    low = F.lower("text")
    counts = [F.regexp_count(low, F.lit(f"(?<![a-z0-9]){q}(?![a-z0-9])")).alias(f"tf{i}") for i, q in enumerate(query)]
    tf = chunks.where("text is not null").select("chunk_id", F.regexp_count(low, F.lit("[a-z0-9]+")).alias("len"), *counts)
    stats = tf.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(query))])
    score = F.lit(0.0)
    for i in range(len(query)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        f = F.col(f"tf{i}")
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    found = tf.where(" or ".join(f"tf{i} > 0" for i in range(len(query)))).crossJoin(F.broadcast(stats))
    return _top(found.select("chunk_id", F.round(score, 9).alias("score")), k, "chunk_id")


def knn_search(vectors: DataFrame, query: DataFrame, k: int, exclude_self: bool = True, candidates: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Nearest to one query vector (a one-row frame with ``vec_id, embedding``), among ``candidates(vec_id)`` if given, without ``exclude(vec_id)``. Missing vectors are skipped."""
    vectors = vectors.where("embedding is not null and size(embedding) > 0")
    if candidates is not None:
        vectors = vectors.join(candidates, "vec_id", "left_semi")
    if exclude is not None:
        vectors = vectors.join(exclude, "vec_id", "left_anti")
    q = query.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")).limit(1)
    scored = vectors.crossJoin(F.broadcast(q)).where((F.col("vec_id") != F.col("qid")) if exclude_self else F.lit(True))
    return _top(scored.select("vec_id", F.round(dot(F.col("embedding"), F.col("q")), 9).alias("score")), k, "vec_id")


def rrf(arms: list[DataFrame], k: int, offset: int = 61, priority: bool = False) -> DataFrame:
    """Reciprocal rank fusion of arms ``(id, rank from 0)``: sum of 1 / (offset + rank); ties by arm order or id."""
    tagged = None
    for i, arm in enumerate(arms):
        a = arm.select("id", (1 / (offset + F.col("rank"))).alias("s"), F.lit(i).alias("arm"))
        tagged = a if tagged is None else tagged.unionByName(a)
    fused = tagged.groupBy("id").agg(F.round(F.sum("s"), 12).alias("score"), F.min("arm").alias("arm"))
    return _top(fused, k, *(["arm", "id"] if priority else ["id"])).select("id", "score", "rank")


def in_scope(chunks: DataFrame, edges: DataFrame, wanted: list[str], column: str) -> DataFrame:
    """Chunks attached to any of the wanted shelves or themes."""
    return chunks.join(edges.where(F.col(column).isin(*wanted)).select("chunk_id").distinct(), "chunk_id", "left_semi")


def search_cards(cards: DataFrame, query: list[str], k: int) -> DataFrame:
    """Cards by distinct query tokens in title and summary; ties by card. ``cards(card_id, title, summary)``."""
    q = F.array(*[F.lit(t) for t in query])
    words = F.array_distinct(tokens(F.concat_ws(" ", "title", "summary")))
    return _top(cards.select("card_id", F.size(F.array_intersect(words, q)).alias("score")).where("score > 0"), k, "card_id")


def hybrid_search(chunks: DataFrame, vectors: DataFrame, query: list[str], k: int, vector: list[float] | None = None) -> DataFrame:
    """BM25 and vector neighbours, fused by rank. Without a query vector the best BM25 hit's serves as seed.

    Nothing matches: an empty result. A seed without a vector: the text arm alone.
    ``chunks(chunk_id, text)``, ``vectors(chunk_id, embedding)``.
    """
    text = bm25(chunks, query, k).select(F.col("chunk_id").alias("id"), "rank")
    arms = [text]
    named = vectors.select(F.col("chunk_id").alias("vec_id"), "embedding")
    if vector is not None:
        seed = chunks.sparkSession.createDataFrame([(list(map(float, vector)),)], "embedding array<double>").select(F.lit(None).cast(named.schema["vec_id"].dataType).alias("vec_id"), "embedding")
        arms.append(knn_search(named, seed, k, exclude_self=False).select(F.col("vec_id").alias("id"), "rank"))
    else:
        seed = named.join(text.where("rank = 0").select(F.col("id").alias("vec_id")), "vec_id", "left_semi")
        arms.append(knn_search(named, seed, k, exclude_self=False).select(F.col("vec_id").alias("id"), "rank"))
    return rrf(arms, k)
