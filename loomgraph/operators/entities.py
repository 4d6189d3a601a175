"""Entities from links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import prefix_of


def mode_of(links: DataFrame, value: str) -> DataFrame:
    """Most frequent value per term; ties by value. Counted before ranked, so hot terms shrink first."""
    counts = links.groupBy("term_id", value).agg(F.count("*").alias("n"))
    return counts.groupBy("term_id").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("x")).select("term_id", F.col("x.v").alias(value))


def build_entities(links: DataFrame, sample: int = 50) -> DataFrame:
    """Per term: mentions, distinct chunks, the first chunk ids, label and facet by frequency, last seen.

    The sample is by smallest id: the rank limit runs in every task before rows are
    shuffled, so no term's chunks are gathered whole.
    """
    pairs = links.groupBy("term_id", "chunk_id").agg(F.count("*").alias("m"), F.max("created_at").alias("seen"))
    base = pairs.groupBy("term_id").agg(F.sum("m").alias("mention_count"), F.count("*").alias("chunk_count"), F.max("seen").alias("last_seen"))
    nth = F.row_number().over(Window.partitionBy("term_id").orderBy("chunk_id"))
    first = pairs.select("term_id", "chunk_id").withColumn("nth", nth).where(F.col("nth") <= sample)
    ids = first.groupBy("term_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))
    out = base.join(mode_of(links, "surface"), "term_id").join(mode_of(links, "entity_type"), "term_id").join(ids, "term_id")
    return out.select("term_id", prefix_of(F.col("term_id")).alias("prefix"), F.col("surface").alias("label"), F.col("entity_type").alias("facet_hint"), "mention_count", "chunk_count", "chunk_ids", "last_seen")


def entity_edges(links: DataFrame) -> DataFrame:
    """Strongest link per (chunk, term)."""
    return links.groupBy("chunk_id", "term_id").agg(F.max("confidence").alias("confidence"))


def search_entities(entities: DataFrame, query: list[str], limit: int) -> DataFrame:
    """By number of query tokens in the label (and synonyms, where there is such a column), then chunks, then id."""
    words = F.split(F.lower("label"), "[^a-z0-9]+")
    if "synonyms" in entities.columns:
        words = F.array_union(words, F.split(F.lower(F.array_join(F.coalesce("synonyms", F.array().cast("array<string>")), " ")), "[^a-z0-9]+"))
    score = F.size(F.array_intersect(words, F.array(*[F.lit(q) for q in query])))
    return entities.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.desc("chunk_count"), "term_id").limit(limit)


def neighbourhood(edges: DataFrame, term: str, limit: int) -> DataFrame:
    """Terms mentioned in the same chunks, by number of chunks in common."""
    mine = edges.where(F.col("term_id") == term).select("chunk_id")
    near = edges.join(mine, "chunk_id", "left_semi").where(F.col("term_id") != term)
    return near.groupBy("term_id").agg(F.count_distinct("chunk_id").alias("shared")).orderBy(F.desc("shared"), "term_id").limit(limit)


def enrich(entities: DataFrame, terms: DataFrame, prefix: str) -> DataFrame:
    """Entities of the prefix take the ontology's label (and synonyms) where it knows them; others stay as they are."""
    t = terms.select(F.col("id").alias("__id"), F.col("label").alias("__label"), F.coalesce("synonyms", F.array().cast("array<string>")).alias("__synonyms")).dropDuplicates(["__id"])
    own = prefix_of(F.col("term_id")) == prefix
    j = entities.drop("synonyms").join(t, (F.col("term_id") == F.col("__id")) & own, "left")
    return j.withColumn("label", F.coalesce("__label", "label")).withColumn("synonyms", F.coalesce("__synonyms", F.array().cast("array<string>"))).drop("__id", "__label", "__synonyms")
