"""Surfaces to terms: mentions, dictionary recognition, links by vector, and what of the links the ontology knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dot, normalise
from .graphs import knn

ENTITY_TYPES = ("food", "food component", "nutrient", "micronutrient", "macronutrient", "dietary supplement", "dietary pattern", "medical condition", "biomarker", "allergen")


def known_links(links: DataFrame, terms: DataFrame) -> DataFrame:
    """Links whose term the ontology has. The distinct terms are what joins, not their links, where they are few."""
    return links.join(terms.select(F.col("id").alias("term_id")).distinct(), "term_id", "left_semi")


def unlinked_terms(denorm: DataFrame, links: DataFrame) -> DataFrame:
    """(chunk_id, term_id) of ``denorm(chunk_id, term_ids)`` without any link in the same chunk."""
    ids = denorm.select("chunk_id", F.explode(F.array_distinct("term_ids")).alias("term_id"))
    return ids.join(links.select("chunk_id", "term_id").distinct(), ["chunk_id", "term_id"], "left_anti")


def facet_terms(routed: DataFrame, denorm: DataFrame, facet: str) -> DataFrame:
    """(facet, chunk_id, term_id): links by their facet, and the chunks' own term ids under ``facet``; no floor, no block list."""
    a = routed.where("facet is not null").select("facet", "chunk_id", "term_id")
    b = denorm.select(F.lit(facet).alias("facet"), "chunk_id", F.explode("term_ids").alias("term_id"))
    return a.unionByName(b).distinct()


def repaired_mentions(raw: DataFrame, known_types: tuple[str, ...] = ENTITY_TYPES) -> DataFrame:
    """A recogniser's spans ``raw(chunk_id, text, pos, surface, start, end, label, score)`` made valid.

    Offsets outside of the text are found again by the surface's first occurrence (else the
    span goes), white space is squeezed, of equal (lower-case surface, start) the first by
    ``pos`` stays, unknown labels become ``other``, a missing score counts 1.
    """
    rows = raw.where("surface is not null and trim(surface) <> ''")
    bad = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.length("text"))
    rows = rows.withColumn("found", F.instr("text", F.col("surface")) - 1).where(~bad | (F.col("found") >= 0))
    begin = F.when(bad, F.col("found")).otherwise(F.col("start")).cast("int")
    rows = rows.withColumn("stop", F.when(bad, F.col("found") + F.length("surface")).otherwise(F.col("end")).cast("int")).withColumn("begin", begin)
    surface = F.trim(F.regexp_replace(F.substring("text", F.col("begin") + 1, F.col("stop") - F.col("begin")), r"\s+", " "))
    kind = F.when(F.col("label").isin(*known_types), F.col("label")).otherwise("other")
    out = rows.select("chunk_id", "pos", surface.alias("surface"), F.col("begin").alias("start"), F.col("stop").alias("end"), kind.alias("entity_type"), F.coalesce("score", F.lit(1.0)).alias("score"))
    first = F.row_number().over(Window.partitionBy("chunk_id", F.lower("surface"), "start").orderBy("pos"))
    return out.withColumn("n", first).where("n = 1").drop("n", "pos")


def dictionary_mentions(chunks: DataFrame, names: DataFrame, longest: int = 4) -> DataFrame:
    """Recognition by a dictionary ``names(name, term_id)``: every run of up to ``longest`` normalised words that is a name.

    (chunk_id, name, term_id, n). Runs are counted per chunk before they meet the names;
    a null text has none.
    """
    words = chunks.where("text is not null").select("chunk_id", F.split(normalise(F.col("text")), " ").alias("w"))
    runs = None
    for m in range(1, longest + 1):
        some = words.where(F.size("w") >= m).select("chunk_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))).alias("name"))  # noqa: B023
        runs = some if runs is None else runs.unionByName(some)
    counts = runs.groupBy("chunk_id", "name").agg(F.count("*").alias("n"))
    return counts.join(names.select("name", "term_id").distinct(), "name").select("chunk_id", "name", "term_id", "n")


def link_surfaces(surfaces: DataFrame, vectors: DataFrame, least: float, encoded: DataFrame) -> DataFrame:
    """Each surface's nearest term, if near enough: ``surfaces(surface)``, ``encoded(surface, embedding)``, ``vectors(vec_id, embedding)``.

    Surfaces equal but for case and outer blanks are searched once and share the result. (surface, term_no, sim)
    """
    key = F.lower(F.trim("surface"))
    asked = surfaces.select(key.alias("key")).distinct().join(encoded.select(key.alias("key"), "embedding").dropDuplicates(["key"]), "key")
    asked = asked.withColumn("vec_id", F.xxhash64("key"))
    near = knn(asked.select("vec_id", "embedding"), vectors, 1).where(F.col("sim") >= least)
    hit = asked.select("key", "vec_id").join(near.select(F.col("query_id").alias("vec_id"), F.col("neighbour_id").alias("term_no"), "sim"), "vec_id").select("key", "term_no", "sim")
    return surfaces.withColumn("key", key).join(hit, "key", "left").select("surface", "term_no", "sim")


def annotate_totals(mentions: DataFrame, links: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: chunks, mentions, links, links per mention, chunks with a link."""
    m = mentions.agg(F.count("*").alias("n_mentions"))
    k = links.agg(F.count("*").alias("n_links"), F.count_distinct("chunk_id").alias("n_linked"))
    c = chunks.agg(F.count("*").alias("n_chunks"))
    g = c.crossJoin(F.broadcast(m)).crossJoin(F.broadcast(k))
    share = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    return g.select("n_chunks", "n_mentions", "n_links", share("n_links", "n_mentions").alias("link_rate"), share("n_linked", "n_chunks").alias("coverage"))


def nearest_text(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """Similarity of all vectors to one (a one-row frame with ``embedding``)."""
    return vectors.crossJoin(F.broadcast(query.select(F.col("embedding").alias("q")).limit(1))).select("vec_id", dot(F.col("embedding"), F.col("q")).alias("sim"))
