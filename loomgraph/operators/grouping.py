"""Bottom-up grouping: leaves of the support table under proposed or frozen groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_synonym(name: Column) -> Column:
    """No digits or punctuation, 2 to 30 characters, no Latin binomial."""
    return name.rlike(r"^[A-Za-z][A-Za-z \-]{0,28}[A-Za-z]$") & ~name.rlike("^[A-Z][a-z]{1,} [a-z]{1,}$")


def display_name(label: Column, synonyms: Column) -> Column:
    """Shortest clean synonym, ties by name; the label itself where there is none."""
    good = F.filter(synonyms, clean_synonym)
    ranked = F.array_sort(F.transform(good, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))
    return F.coalesce(F.get(ranked, F.lit(0)).getField("s"), label)


def concepts(label: Column) -> Column:
    """Parts of a group label at ``and``, comma and slash, singular (final s cut)."""
    parts = F.split(F.lower(F.trim(label)), r"\s*(?:\band\b|[,/])\s*")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(F.trim(p), "s+$", "")), lambda p: F.length(p) > 0)


def leaf_chunks(links: DataFrame) -> DataFrame:
    """Distinct chunks per mentioned term, every facet, no block list."""
    return links.select("chunk_id", "term_id").distinct().groupBy("term_id").agg(F.count("*").alias("n_chunks"))


def assign_leaves(links: DataFrame, anchors: DataFrame, anc: DataFrame) -> DataFrame:
    """``anchors(group, anchor)``: each leaf goes to the group of its nearest anchor (most ancestors), ties by group; others to none."""
    leaves = links.select("term_id").distinct()
    rank = anc.groupBy("term").agg(F.count("*").alias("above")).withColumnRenamed("term", "anchor")
    a = anchors.join(rank, "anchor", "left").withColumn("above", F.coalesce("above", F.lit(0)))
    reach = anc.select(F.col("term").alias("term_id"), F.col("ancestor").alias("anchor")).union(leaves.select("term_id", F.col("term_id").alias("anchor")))
    best = leaves.join(reach, "term_id").join(a, "anchor").groupBy("term_id").agg(F.min(F.struct((-F.col("above")).alias("n"), "group")).alias("x"))
    return best.select("term_id", F.col("x.group").alias("group"))


def grouped_shelves(links: DataFrame, assigned: DataFrame, min_support: int = 1) -> DataFrame:
    """Group shelves with distinct chunk counts, and a root that counts the union of all of them."""
    pairs = links.select("chunk_id", "term_id").distinct().join(assigned, "term_id")
    groups = pairs.select("group", "chunk_id").distinct().groupBy("group").agg(F.count("*").alias("chunk_count")).where(F.col("chunk_count") >= min_support)
    root = pairs.agg(F.count_distinct("chunk_id").alias("chunk_count")).select(F.lit("root").alias("shelf_id"), F.lit(None).cast("string").alias("parent"), "chunk_count")
    return groups.select(F.col("group").alias("shelf_id"), F.lit("root").alias("parent"), "chunk_count").unionByName(root)
