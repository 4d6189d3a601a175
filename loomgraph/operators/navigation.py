"""Read surface: terms and sources per shelf, activation from entities to shelves and themes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_tokens


def shelf_terms(texts: DataFrame, top: int = 100) -> DataFrame:
    """``texts(shelf_id, chunk_id, text)``: tf * (ln((1 + N) / (1 + df)) + 1) per shelf, df and N over chunks; ties by term."""
    words = texts.select("shelf_id", "chunk_id", F.explode(content_tokens(F.col("text"))).alias("term"))
    per = words.groupBy("shelf_id", "chunk_id", "term").agg(F.count("*").alias("c"))
    tf = per.groupBy("shelf_id", "term").agg(F.sum("c").alias("tf"))
    df = per.select("chunk_id", "term").distinct().groupBy("term").agg(F.count("*").alias("df"))
    n = texts.agg(F.count_distinct("chunk_id").alias("n"))
    scored = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("score", F.round(F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1), 9))
    rank = F.row_number().over(Window.partitionBy("shelf_id").orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("shelf_id", "term", "score", "rank")


def shelf_sources(attached: DataFrame, sources: DataFrame, top: int = 40) -> DataFrame:
    """Sources of each shelf by distinct chunks; ties by source. ``sources(chunk_id, source)``."""
    counts = attached.select("chunk_id", "shelf_id").distinct().join(sources, "chunk_id").groupBy("shelf_id", "source").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("shelf_id").orderBy(F.desc("n"), "source"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top)


def activated_themes(terms: DataFrame, resolved: DataFrame, shelves: DataFrame, members: DataFrame, limit: int = 20) -> DataFrame:
    """Themes by the number of shelves that the terms activate (their shelves and those one step away); ties by theme.

    ``terms(term_id)``, ``resolved(chunk_id, term_id, shelf_id)``, ``shelves(shelf_id, parent)``, ``members(theme_id, chunk_id)``.
    """
    seed = resolved.join(terms, "term_id", "left_semi").select("shelf_id").distinct()
    up = shelves.join(seed, "shelf_id", "left_semi").where("parent is not null").select(F.col("parent").alias("shelf_id"))
    down = shelves.join(seed.select(F.col("shelf_id").alias("parent")), "parent", "left_semi").select("shelf_id")
    active = seed.union(up).union(down).distinct()
    on = members.join(resolved.select("chunk_id", "shelf_id").distinct(), "chunk_id").select("theme_id", "shelf_id").distinct()
    return on.join(active, "shelf_id").groupBy("theme_id").agg(F.count("*").alias("n_shelves")).orderBy(F.desc("n_shelves"), "theme_id").limit(limit)


def mention_map(links: DataFrame) -> DataFrame:
    """Sorted distinct term ids of each chunk."""
    return links.groupBy("chunk_id").agg(F.array_sort(F.collect_set("term_id")).alias("term_ids"))


def shelf_facts(attached: DataFrame, docs: DataFrame, top: int = 40) -> DataFrame:
    """Documents of each shelf by distinct chunks, with kind and year; ties by document. ``docs(chunk_id, doc_id, source_type, year)``."""
    j = attached.select("chunk_id", "shelf_id").distinct().join(docs, "chunk_id")
    counts = j.groupBy("shelf_id", "doc_id").agg(F.count("*").alias("n"), F.min("source_type").alias("source_type"), F.max("year").alias("year"))
    rank = F.row_number().over(Window.partitionBy("shelf_id").orderBy(F.desc("n"), "doc_id"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top)


def shelf_entities(attached: DataFrame, links: DataFrame, top: int = 40) -> DataFrame:
    """Entities of each shelf by distinct chunks; ties by id."""
    counts = attached.select("chunk_id", "shelf_id").distinct().join(links.select("chunk_id", "term_id").distinct(), "chunk_id").groupBy("shelf_id", "term_id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("shelf_id").orderBy(F.desc("n"), "term_id"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top)


def shelf_context(shelves: DataFrame, top: int = 5) -> DataFrame:
    """What a labeller is told of a shelf: its parent's label and its ``top`` largest children's. (shelf_id, label, parent_label, child_labels)"""
    up = shelves.select(F.col("shelf_id").alias("parent"), F.col("label").alias("parent_label"))
    rank = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("chunk_count"), "shelf_id"))
    kids = shelves.where("parent is not null").withColumn("rank", rank).where(F.col("rank") <= top)
    below = kids.groupBy("parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x.label).alias("child_labels")).withColumnRenamed("parent", "shelf_id")
    return shelves.join(up, "parent", "left").join(below, "shelf_id", "left").select("shelf_id", "label", "parent_label", F.coalesce("child_labels", F.array().cast("array<string>")).alias("child_labels"))


def with_display_labels(shelves: DataFrame, named: DataFrame) -> DataFrame:
    """Fill ``display_label`` from ``named(shelf_id, name)`` where it has none; labels and structure stay as they are."""
    n = named.where("trim(name) <> ''").select("shelf_id", F.trim("name").alias("__name")).dropDuplicates(["shelf_id"])
    return shelves.join(n, "shelf_id", "left").withColumn("display_label", F.coalesce(F.nullif(F.trim("display_label"), F.lit("")), "__name")).drop("__name")


def labels_or_keywords(themes: DataFrame, named: DataFrame, words: DataFrame) -> DataFrame:
    """Theme labels of a model ``named(theme_id, name)``; where it gave none, the first three keywords ``words(theme_id, term, rank)``."""
    kw = words.where("rank <= 3").groupBy("theme_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x.term), " ").alias("kw"))
    n = named.where("trim(name) <> ''").select("theme_id", F.trim("name").alias("name")).dropDuplicates(["theme_id"])
    return themes.select("theme_id").join(n, "theme_id", "left").join(kw, "theme_id", "left").select("theme_id", F.coalesce("name", "kw", F.lit("unlabeled")).alias("label"))
