"""Entity-link CSVs: aligned, ``;``-separated surfaces and URIs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import shorten_uri

SCHEMA = "chunk_id string, chunk_entities_ner string, chunk_uri_nel string"


def mentions(rows: DataFrame) -> DataFrame:
    """``rows(chunk_id, surfaces, uris)`` to one row per mention; zipped to the shorter list.

    Blank surfaces are skipped; a blank URI keeps the mention without a term. Null lists
    have no mention. Score and confidence are 1, spans start at 0 and end with the surface.
    """
    a, b = F.split("surfaces", ";"), F.split("uris", ";")
    n = F.least(F.size(a), F.size(b))
    zipped = F.arrays_zip(F.slice(a, F.lit(1), n).alias("surface"), F.slice(b, F.lit(1), n).alias("uri"))
    m = rows.where("surfaces is not null and uris is not null").select("chunk_id", F.posexplode(zipped).alias("pos", "z")).select("chunk_id", "pos", F.trim("z.surface").alias("surface"), F.trim("z.uri").alias("uri"))
    term = F.when(F.col("uri") != "", shorten_uri(F.col("uri")))
    return m.where("surface <> ''").select("chunk_id", "pos", "surface", term.alias("term_id"), F.lit(1.0).alias("confidence"), F.lit("dense").alias("method"), F.lit("other").alias("entity_type"), F.lit(0).alias("start"), F.length("surface").alias("end"))


def read_dir(spark: SparkSession, path: str) -> DataFrame:
    """All CSVs below ``path``; of rows with one chunk_id the last one (by file, then line) wins; files with another header are skipped."""
    raw = spark.read.option("header", False).option("multiLine", True).option("quote", '"').option("escape", '"').schema(SCHEMA).csv(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    head = raw.where("chunk_id = 'chunk_id'")
    good = head.where("chunk_entities_ner = 'chunk_entities_ner' and chunk_uri_nel = 'chunk_uri_nel'").select("file").distinct()
    rows = raw.where("chunk_id <> 'chunk_id'").join(good, "file", "left_semi")
    last = rows.withColumn("k", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("file"), F.desc("line")))).where("k = 1")
    return last.select("chunk_id", F.col("chunk_entities_ner").alias("surfaces"), F.col("chunk_uri_nel").alias("uris"))


def annotate(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Chunks with their linked term ids (sorted, distinct); chunks without mentions keep an empty list."""
    ids = found.where("term_id is not null").groupBy("chunk_id").agg(F.array_sort(F.collect_set("term_id")).alias("term_ids"))
    return chunks.drop("term_ids").join(ids, "chunk_id", "left").withColumn("term_ids", F.coalesce("term_ids", F.array().cast("array<string>")))
